"""Analytics over the logs of evaluations and syncs: windows per asset, ordered by time and id.

Running values are computed by chunks of time (see ``asof``), so a busy asset's history spreads over tasks.

Evaluations: evaluation_id, asset, ts, and ready or ready_count. Syncs: execution_id, asset, ts,
exit_code (null for stages that did not run, which count as neither success nor failure).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.times import micros
from evenkeel.operators.asof import CHUNK_US, asof_join, carry
from evenkeel.session import materialize


def latest_sync(sync_log: DataFrame) -> DataFrame:
    """All stage rows of each asset's last execution; of equal times the greatest execution id is last."""
    last = sync_log.groupBy("asset").agg(F.max_by("execution_id", F.struct("started_at", "execution_id")).alias("__last"))
    return sync_log.join(last.withColumnRenamed("asset", "__asset"), (F.col("asset") == F.col("__asset")) & (F.col("execution_id") == F.col("__last"))).drop("__asset", "__last")


def latest(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The columns of each key's last row."""
    picked = df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__row"))
    return picked.select(key, "__row.*")


def asset_status(assets: DataFrame, evals: DataFrame, syncs: DataFrame, suspended: DataFrame) -> DataFrame:
    """Each asset with its last evaluation, last sync and suspension reason; absent parts are null."""
    e = latest(evals, "asset", ["ts", "evaluation_id"], ["evaluation_id", "ready"])
    s = latest(syncs, "asset", ["ts", "execution_id"], ["execution_id", "exit_code"])
    return assets.select("asset").distinct().join(e, "asset", "left").join(s, "asset", "left").join(suspended.select("asset", "reason"), "asset", "left")


def execution_counts(evals: DataFrame, syncs: DataFrame) -> DataFrame:
    """(asset, evaluations, syncs): distinct ids of each."""
    e = evals.groupBy("asset").agg(F.count_distinct("evaluation_id").alias("evaluations"))
    s = syncs.groupBy("asset").agg(F.count_distinct("execution_id").alias("syncs"))
    return e.join(s, "asset", "full").select("asset", F.coalesce("evaluations", F.lit(0)).cast("long").alias("evaluations"), F.coalesce("syncs", F.lit(0)).cast("long").alias("syncs"))


def sync_order(sync_log: DataFrame) -> DataFrame:
    """(asset, execution_id, nth): each asset's executions in the order of their run stage."""
    runs = sync_log.where("stage = 'run'").select("asset", "execution_id", "started_at")
    return carry(runs, ["asset"], "started_at", ["started_at", "execution_id"], {"nth": ("sum", F.lit(1))}, current=True).select("asset", "execution_id", F.col("nth").cast("long").alias("nth"))


def stage_rows(plan: DataFrame, stages: list[str] | None = None) -> DataFrame:
    """Stage rows in order up to the first non-zero exit code of each execution."""
    chosen = plan if stages is None else plan.where(F.col("stage").isin(stages))
    before = Window.partitionBy("execution_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.max((F.col("exit_code") != 0).cast("int")).over(before)
    return chosen.withColumn("__failed", F.coalesce(failed, F.lit(0))).where("__failed = 0").drop("__failed")


def outcome(sync_log: DataFrame) -> DataFrame:
    """(execution_id, success, first_failed): stages that did not run don't count."""
    ran = sync_log.where("exit_code is not null")
    failed = F.col("exit_code") != 0
    return ran.groupBy("execution_id").agg(F.bool_and(~failed).alias("success"), F.min_by("stage", F.when(failed, F.col("pos"))).alias("__first")).select("execution_id", "success", F.when(~F.col("success"), F.col("__first")).alias("first_failed"))


def transitions(evals: DataFrame) -> DataFrame:
    """Evaluations at which an asset goes from Not Ready to Ready; before the first it is Not Ready."""
    ready = F.coalesce("ready", F.lit(False))
    found = carry(evals, ["asset"], "ts", ["ts", "evaluation_id"], {"__before": ("last", ready)})
    return found.where(ready & ~F.coalesce("__before", F.lit(False))).select(*evals.columns)


def failure_streak(syncs: DataFrame) -> DataFrame:
    """Syncs that ran, with ``streak``: failures in a row up to this one; a success has 0."""
    order = Window.partitionBy("asset", "__chunk").orderBy("ts", "execution_id").rowsBetween(Window.unboundedPreceding, 0)
    failed = (F.col("exit_code") != 0).cast("int")
    ran = syncs.where("exit_code is not null").withColumn("__chunk", F.floor(micros("ts") / CHUNK_US))
    counted = ran.withColumn("__failures", F.sum(failed).over(order)).withColumn("__success", F.max(F.when(failed == 0, F.col("__failures"))).over(order))

    # Of each chunk: its failures, and those up to its last success; from them the streak with which the next one begins.
    chunks = counted.groupBy("asset", "__chunk").agg(F.max("__failures").alias("all"), F.max("__success").alias("until"))
    along = Window.partitionBy("asset").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("before", F.coalesce(F.sum("all").over(along), F.lit(0)))
    begins = chunks.select("asset", "__chunk", (F.col("before") - F.coalesce(F.max(F.col("before") + F.col("until")).over(along), F.lit(0))).alias("__begin"))
    joined = counted.join(begins, ["asset", "__chunk"])
    streak = F.when(F.col("__success").isNotNull(), F.col("__failures") - F.col("__success")).otherwise(F.col("__failures") + F.col("__begin"))
    return joined.select(*syncs.columns, streak.alias("streak"))


def cooldown(streaks: DataFrame, initial_s: int = 30, cap_s: int = 1800) -> DataFrame:
    """Failures with wait_s, until_us (not before this time) and cleared_us (the next success, or null)."""
    success = F.when(F.col("exit_code") == 0, micros("ts"))
    seen = carry(streaks, ["asset"], "ts", ["ts", "execution_id"], {"cleared_us": ("last", success)}, descending=True)
    wait = F.least(F.lit(initial_s) * F.pow(F.lit(2), F.least(F.col("streak") - 1, F.lit(40))), F.lit(cap_s)).cast("long")
    found = seen.withColumn("wait_s", wait).where("streak > 0")
    return found.withColumn("until_us", micros("ts") + F.col("wait_s") * 1_000_000)


def suspend_points(streaks: DataFrame, limit: int = 3) -> DataFrame:
    """Failures whose streak reaches the limit, with a reason."""
    return streaks.where(F.col("streak") >= limit).withColumn("reason", F.format_string("%d consecutive failures", "streak"))


def degradation(evals: DataFrame, syncs: DataFrame) -> DataFrame:
    """First evaluations after one or more syncs with fewer Ready conditions than the last before: evaluation_id, asset, before, after."""
    e = evals.select("asset", "ts", F.lit(1).alias("kind"), F.col("evaluation_id").alias("id"), "ready_count")
    s = syncs.select("asset", "ts", F.lit(0).alias("kind"), F.col("execution_id").alias("id"), F.lit(None).cast("long").alias("ready_count"))
    values = {"before": ("last", F.col("ready_count")), "last_kind": ("last", F.col("kind"))}  # a sync right before is one since the last evaluation
    marked = carry(e.unionByName(s), ["asset"], "ts", ["ts", "kind", "id"], values).where("kind = 1")
    return marked.where("last_kind = 0 and ready_count < before").select(F.col("id").alias("evaluation_id"), "asset", "before", F.col("ready_count").alias("after"))


def suspension_intervals(points: DataFrame, evals: DataFrame) -> DataFrame:
    """(asset, execution_id, from_us, to_us): suspended until the next Ready evaluation; null if none came."""
    ready = evals.where("ready").select("asset", "ts", "evaluation_id")
    found = asof_join(points.select("asset", "execution_id", "ts"), ready, ["asset"], "ts", "ts", "evaluation_id", "end", "forward", equal=False)
    return found.select("asset", "execution_id", micros("ts").alias("from_us"), micros("end.ts").alias("to_us"))


def eligible(assets: DataFrame, running: DataFrame, suspended: DataFrame, cooling: DataFrame, now: Column) -> DataFrame:
    """(asset, allowed): auto-sync on, a sync defined, not running, not suspended, not cooling down at ``now``.

    assets: asset, auto_sync, sync; cooling: asset, until_us.
    """
    flag = lambda df, name: df.select("asset").distinct().withColumn(name, F.lit(True))
    cool = flag(cooling.where(F.col("until_us") > micros(now)), "cool")
    joined = assets.join(flag(running, "run"), "asset", "left").join(flag(suspended, "susp"), "asset", "left").join(cool, "asset", "left")
    allowed = F.coalesce("auto_sync", F.lit(False)) & F.col("sync").isNotNull() & F.col("run").isNull() & F.col("susp").isNull() & F.col("cool").isNull()
    return joined.select("asset", allowed.alias("allowed"))


def ttl_hits(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests with ``hit`` and the result that answers it: age under the time to live, which is ttl_s of the condition or else of the asset.

    requests: asset, condition_name, ts, request_id, condition_ttl_s, asset_ttl_s; results: asset,
    condition_name, cached_at, evaluation_id, result.
    """
    found = asof_join(requests, results, ["asset", "condition_name"], "ts", "cached_at", "evaluation_id", "cached")
    age = micros("ts") - micros("cached.cached_at")
    ttl = F.coalesce("condition_ttl_s", "asset_ttl_s")
    hit = F.coalesce(age < ttl * 1_000_000, F.lit(False))
    return found.select(*requests.columns, hit.alias("hit"), F.when(hit, F.col("cached.result")).alias("result"))


def due(last_evals: DataFrame, intervals: DataFrame, now: Column, k: int | None = None) -> DataFrame:
    """(asset, due_us, is_due): next evaluation of each asset with an interval; never run is due at once (null). The k soonest if k is given."""
    at = micros("ts") + F.col("interval_s") * 1_000_000
    found = intervals.where("interval_s is not null").join(last_evals, "asset", "left").select("asset", at.alias("due_us"))
    found = found.withColumn("is_due", F.coalesce(F.col("due_us") <= micros(now), F.lit(True)))
    return found if k is None else found.orderBy(F.asc_nulls_first("due_us"), "asset").limit(k)


def lock_overlaps(runs: DataFrame, ttl_s: int) -> DataFrame:
    """Runs (asset, execution_id, ts) with held_until_us, the end of the last lock taken before, and ``overlaps``: whether it still holds.

    A lock lasts ttl_s, or the run's own ``ttl_s`` where it has one. One pass with a running maximum, so a
    run that overlaps a thousand others is one row.
    """
    own = F.coalesce("ttl_s", F.lit(ttl_s)) if "ttl_s" in runs.columns else F.lit(ttl_s)
    end = micros("ts") + own.cast("long") * 1_000_000
    rows = carry(runs, ["asset"], "ts", ["ts", "execution_id"], {"held_until_us": ("max", end)})
    return rows.select("asset", "execution_id", "held_until_us", F.coalesce(F.col("held_until_us") >= micros("ts"), F.lit(False)).alias("overlaps"))


#: Runs of one asset and bucket that are paired in one task of the join.
BUCKET_ROWS = 5_000


def overlaps(runs: DataFrame, ttl_s: int) -> DataFrame:
    """(asset, earlier, later): pairs of a run and one that starts while its lock still holds (at most ttl after it).

    Time is cut into buckets of the ttl; a run looks into its own bucket and the one before, so the join
    has an equality on asset and bucket. A bucket of more than ``BUCKET_ROWS`` runs is split into parts of
    about that size, each of which meets the later runs on its own. ``lock_overlaps`` says which runs
    overlap without the pairs.
    """
    span = ttl_s * 1_000_000
    at = runs.select("asset", "execution_id", micros("ts").alias("us")).withColumn("bucket", F.floor(F.col("us") / span))
    parts = at.groupBy("asset", "bucket").agg(F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).cast("int").alias("parts"))
    full = materialize(parts.where("parts > 1"))
    with_parts = lambda df: df.join(full, ["asset", "bucket"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    a = with_parts(at.select("asset", F.col("execution_id").alias("earlier"), F.col("us").alias("a_us"), "bucket")).withColumn("part", F.pmod(F.xxhash64("earlier"), "parts").cast("int")).drop("parts")
    b = at.select("asset", F.col("execution_id").alias("later"), F.col("us").alias("b_us"), F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)).alias("bucket"))
    b = with_parts(b).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    after = (F.col("b_us") > F.col("a_us")) | ((F.col("b_us") == F.col("a_us")) & (F.col("later") > F.col("earlier")))
    return a.join(b, ["asset", "bucket", "part"]).where(after & (F.col("b_us") - F.col("a_us") <= span)).select("asset", "earlier", "later")


def link_evaluations(syncs: DataFrame, evals: DataFrame) -> DataFrame:
    """(execution_id, before_id, after_id): the last evaluation at or before a sync and the first after it."""
    e = evals.select("asset", "ts", "evaluation_id")
    before = asof_join(syncs.select("asset", "execution_id", "ts"), e, ["asset"], "ts", "ts", "evaluation_id", "b")
    both = asof_join(before, e, ["asset"], "ts", "ts", "evaluation_id", "a", "forward", equal=False)
    return both.select("execution_id", F.col("b.evaluation_id").alias("before_id"), F.col("a.evaluation_id").alias("after_id"))


def proposals(evals: DataFrame, results: DataFrame, entries: DataFrame, conditions: DataFrame, stages: DataFrame) -> DataFrame:
    """(asset, ready, sync, stages): each asset's last evaluation and what a sync would run; absent parts are null.

    The sync is that of the asset's first entry of which a condition isn't Ready in that evaluation.
    results: evaluation_id, condition_name, result; entries: asset, position, conditions, sync;
    conditions: conditions, condition_name; stages: sync, pos, stage (shown in order, joined by comma).
    """
    last = latest(evals, "asset", ["ts", "evaluation_id"], ["evaluation_id", "ready"])
    drifted = results.where("result <> 'Ready'").select("evaluation_id", "condition_name").join(last.select("asset", "evaluation_id"), "evaluation_id").select("asset", "condition_name")
    first = entries.join(conditions, "conditions").join(drifted, ["asset", "condition_name"]).groupBy("asset").agg(F.min_by("sync", "position").alias("sync"))
    shown = F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("pos", "stage"))), lambda x: x["stage"]), ",")
    plan = stages.groupBy("sync").agg(shown.alias("stages"))
    found = entries.select("asset").distinct().join(last, "asset", "left").join(first, "asset", "left").join(plan, "sync", "left")
    return found.select("asset", "ready", "sync", "stages")


def halt(assets: DataFrame, suspended: DataFrame, reason: str, at: Column) -> DataFrame:
    """Suspensions (asset, reason, suspended_us) after a halt: those there are stay, all other assets get one."""
    added = assets.select("asset").distinct().join(suspended.select("asset"), "asset", "left_anti").select("asset", F.lit(reason).alias("reason"), micros(at).alias("suspended_us"))
    return suspended.select("asset", "reason", "suspended_us").unionByName(added)


def resume(suspended: DataFrame, selected: DataFrame) -> DataFrame:
    """Suspensions without the selected assets."""
    return suspended.join(selected.select("asset"), "asset", "left_anti")


def alerts(failed_evals: DataFrame, points: DataFrame, skipped: DataFrame) -> DataFrame:
    """(kind, asset, id, message) of failed evaluations, suspensions and syncs skipped for a lock."""
    e = failed_evals.select(F.lit("EvaluateFailed").alias("kind"), "asset", F.col("evaluation_id").alias("id"), F.format_string("evaluation of %s failed: %s", F.col("asset").cast("string"), "detail").alias("message"))
    p = points.select(F.lit("Suspended").alias("kind"), "asset", F.col("execution_id").alias("id"), F.format_string("%s suspended: %s", F.col("asset").cast("string"), "reason").alias("message"))
    s = skipped.select(F.lit("SyncLockSkipped").alias("kind"), "asset", F.col("later").alias("id"), F.format_string("sync of %s skipped: lock held", F.col("asset").cast("string")).alias("message"))
    return e.unionByName(p).unionByName(s)
