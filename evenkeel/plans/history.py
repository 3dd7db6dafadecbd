"""Queries of the state history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.times import micros
from evenkeel.operators import history as H
from evenkeel.operators.triggers import coalesce_triggers as coalesce
from evenkeel.plans.fixtures import newest, table
from evenkeel.plans.registry import query
from evenkeel.session import ship_package


def _sync_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.stage_rows(table(spark, sf_dir, "sync_plan"))


@query("""
WITH last AS (SELECT asset, max(started_at) AS at FROM sync_log GROUP BY asset)
SELECT s.execution_id, s.stage, s.asset, epoch_us(s.started_at) AS started_us, s.exit_code FROM sync_log s JOIN last l ON s.asset = l.asset AND s.started_at = l.at""")
def latest_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.latest_sync(_sync_log(spark, sf_dir)).select("execution_id", "stage", "asset", micros("started_at").alias("started_us"), "exit_code")


STREAK_SQL = """
runs AS (SELECT *, sum(CASE WHEN exit_code = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY ts, execution_id) AS grp FROM syncs),
streaks AS (SELECT *, CAST(sum(exit_code) OVER (PARTITION BY asset, grp ORDER BY ts, execution_id) AS BIGINT) AS streak FROM runs)"""


def _streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.failure_streak(table(spark, sf_dir, "syncs"))


@query(f"""WITH {STREAK_SQL},
e AS (SELECT asset, max_by(evaluation_id, ts) AS evaluation_id, max_by(ready, ts) AS ready FROM evals GROUP BY asset),
s AS (SELECT asset, max_by(execution_id, ts) AS execution_id, max_by(exit_code, ts) AS exit_code FROM syncs GROUP BY asset),
x AS (SELECT asset, CAST(max(streak) AS VARCHAR) || ' failures' AS reason FROM streaks WHERE streak >= 3 GROUP BY asset)
SELECT u.asset, evaluation_id, ready, execution_id, exit_code, reason FROM users u LEFT JOIN e ON u.asset = e.asset LEFT JOIN s ON u.asset = s.asset LEFT JOIN x ON u.asset = x.asset""")
def asset_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = H.suspend_points(_streaks(spark, sf_dir)).groupBy("asset").agg(F.format_string("%d failures", F.max("streak")).alias("reason"))
    return H.asset_status(table(spark, sf_dir, "users"), table(spark, sf_dir, "evals"), table(spark, sf_dir, "syncs"), points)


@query("""
WITH e AS (SELECT asset, count(DISTINCT evaluation_id) AS n FROM eval_log GROUP BY asset), s AS (SELECT asset, count(DISTINCT execution_id) AS n FROM sync_log GROUP BY asset)
SELECT coalesce(e.asset, s.asset) AS asset, coalesce(e.n, 0) AS evaluations, coalesce(s.n, 0) AS syncs FROM e FULL JOIN s ON e.asset = s.asset""")
def execution_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.execution_counts(table(spark, sf_dir, "eval_log"), _sync_log(spark, sf_dir))


@query("SELECT asset, execution_id, row_number() OVER (PARTITION BY asset ORDER BY started_at, execution_id) AS nth FROM sync_log WHERE stage = 'run'")
def sync_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.sync_order(_sync_log(spark, sf_dir))


@query("SELECT execution_id, stage, pos, exit_code FROM sync_log")
def sync_stage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sync_log(spark, sf_dir).select("execution_id", "stage", "pos", "exit_code")


@query("""
SELECT execution_id, max(exit_code) = 0 AS success, min_by(stage, pos) FILTER (WHERE exit_code <> 0) AS first_failed FROM sync_log GROUP BY execution_id""")
def execution_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.outcome(_sync_log(spark, sf_dir))


@query("""
SELECT evaluation_id, asset, epoch_us(ts) AS at_us FROM (SELECT *, lag(ready, 1, false) OVER (PARTITION BY asset ORDER BY ts, evaluation_id) AS prev FROM evals) t WHERE ready AND NOT prev""")
def readiness_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.transitions(table(spark, sf_dir, "evals")).select("evaluation_id", "asset", micros("ts").alias("at_us"))


@query(f"WITH {STREAK_SQL} SELECT execution_id, asset, exit_code, streak FROM streaks")
def failure_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streaks(spark, sf_dir).select("execution_id", "asset", "exit_code", "streak")


COOL_SQL = f"""{STREAK_SQL},
cool AS (SELECT s.execution_id, s.asset, s.streak, CAST(least(30 * power(2, least(s.streak - 1, 40)), 1800) AS BIGINT) AS wait_s, epoch_us(s.ts) AS at_us,
  (SELECT min(epoch_us(o.ts)) FROM syncs o WHERE o.asset = s.asset AND o.exit_code = 0 AND o.ts > s.ts) AS cleared_us FROM streaks s WHERE s.streak > 0)"""


@query(f"WITH {COOL_SQL} SELECT execution_id, asset, streak, wait_s, at_us + wait_s * 1000000 AS until_us, cleared_us FROM cool")
def cooldown_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.cooldown(_streaks(spark, sf_dir)).select("execution_id", "asset", "streak", "wait_s", "until_us", "cleared_us")


@query(f"WITH {STREAK_SQL} SELECT execution_id, asset, streak, CAST(streak AS VARCHAR) || ' consecutive failures' AS reason FROM streaks WHERE streak >= 3")
def suspend_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.suspend_points(_streaks(spark, sf_dir)).select("execution_id", "asset", "streak", "reason")


@query("""
WITH p AS (SELECT evaluation_id, asset, ts, ready_count, lag(ready_count) OVER w AS before, lag(ts) OVER w AS prev_ts FROM evals WINDOW w AS (PARTITION BY asset ORDER BY ts, evaluation_id))
SELECT evaluation_id, asset, before, ready_count AS after FROM p WHERE ready_count < before AND EXISTS (SELECT 1 FROM syncs s WHERE s.asset = p.asset AND s.ts <= p.ts AND s.ts > p.prev_ts)""")
def degradation_after_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.degradation(table(spark, sf_dir, "evals"), table(spark, sf_dir, "syncs"))


@query(f"""WITH {STREAK_SQL},
pts AS (SELECT asset, execution_id, ts FROM streaks WHERE streak >= 3), r AS (SELECT asset, ts FROM evals WHERE ready)
SELECT p.asset, p.execution_id, epoch_us(p.ts) AS from_us, epoch_us(r.ts) AS to_us FROM pts p ASOF LEFT JOIN r ON p.asset = r.asset AND p.ts < r.ts""")
def suspension_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.suspension_intervals(H.suspend_points(_streaks(spark, sf_dir)), table(spark, sf_dir, "evals"))


@query(f"""WITH {COOL_SQL},
a AS (SELECT c_custkey AS asset, c_acctbal > 0 AS auto_sync, CASE WHEN c_nationkey < 20 THEN 's' END AS sync FROM customer),
now AS (SELECT max(epoch_us(ts)) AS us FROM events),
running AS (SELECT DISTINCT asset FROM syncs, now WHERE epoch_us(ts) + duration_s * 1000000 > us),
susp AS (SELECT DISTINCT asset FROM streaks WHERE streak >= 8), cooling AS (SELECT DISTINCT asset FROM cool, now WHERE at_us + wait_s * 1000000 > us)
SELECT asset, auto_sync AND sync IS NOT NULL AND asset NOT IN (SELECT asset FROM running) AND asset NOT IN (SELECT asset FROM susp) AND asset NOT IN (SELECT asset FROM cooling) AS allowed FROM a""")
def sync_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, streaks = newest(spark, sf_dir), _streaks(spark, sf_dir)
    assets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asset"), (F.col("c_acctbal") > 0).alias("auto_sync"), F.when(F.col("c_nationkey") < 20, "s").alias("sync"))
    running = table(spark, sf_dir, "syncs").where(micros("ts") + F.col("duration_s") * 1_000_000 > micros(now))
    return H.eligible(assets, running, H.suspend_points(streaks, 8), H.cooldown(streaks), now)


@query("""
WITH q AS (SELECT evaluation_id AS request_id, condition_name, asset, started_at + INTERVAL 30 MINUTE AS ts, CAST(CASE condition_name WHEN 'c0' THEN 7200 WHEN 'c3' THEN NULL ELSE 3600 END AS BIGINT) AS ttl FROM eval_log),
  r AS (SELECT condition_name, asset, started_at, result FROM eval_log),
  m AS (SELECT q.*, r.started_at AS cached_at, r.result FROM q ASOF LEFT JOIN r ON q.asset = r.asset AND q.condition_name = r.condition_name AND q.ts >= r.started_at)
SELECT request_id, condition_name, coalesce(epoch_us(ts) - epoch_us(cached_at) < ttl * 1000000, false) AS hit, CASE WHEN epoch_us(ts) - epoch_us(cached_at) < ttl * 1000000 THEN result END AS result FROM m""")
def ttl_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each evaluation asked for again after 30 minutes; c0 lives two hours, c3 not at all, the asset's default is one hour."""
    log = table(spark, sf_dir, "eval_log")
    own = F.when(F.col("condition_name") == "c0", 7200).cast("long")
    default = F.when(F.col("condition_name") != "c3", 3600).cast("long")
    requests = log.select("asset", "condition_name", (F.col("started_at") + F.expr("INTERVAL 30 MINUTES")).alias("ts"), F.col("evaluation_id").alias("request_id"), own.alias("condition_ttl_s"), default.alias("asset_ttl_s"))
    results = log.select("asset", "condition_name", F.col("started_at").alias("cached_at"), "evaluation_id", "result")
    return H.ttl_hits(requests, results).select("request_id", "condition_name", "hit", "result")


@query("""
WITH l AS (SELECT asset, max(ts) AS ts FROM evals GROUP BY asset), i AS (SELECT c_custkey AS asset, (c_custkey % 7 + 1) * 3600 AS interval_s FROM customer),
  d AS (SELECT i.asset, epoch_us(l.ts) + interval_s * 1000000 AS due_us FROM i LEFT JOIN l ON i.asset = l.asset)
SELECT asset, due_us, coalesce(due_us <= (SELECT max(epoch_us(ts)) FROM events), true) AS is_due FROM d ORDER BY due_us ASC NULLS FIRST, asset LIMIT 1400""")
def due_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 1400 soonest; top-k is the operator's own parameter."""
    last = table(spark, sf_dir, "evals").groupBy("asset").agg(F.max("ts").alias("ts"))
    intervals = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asset"), ((F.col("c_custkey") % 7 + 1) * 3600).alias("interval_s"))
    return H.due(last, intervals, newest(spark, sf_dir), 1400)


@query("""
WITH RECURSIVE t AS (SELECT asset, execution_id, epoch_us(ts) AS s, duration_s * 1000000 AS d, row_number() OVER (PARTITION BY asset ORDER BY ts, execution_id) AS n FROM syncs),
  w AS (SELECT asset, execution_id, n, true AS accepted, s + d AS until FROM t WHERE n = 1
    UNION ALL SELECT t.asset, t.execution_id, t.n, t.s >= w.until, CASE WHEN t.s >= w.until THEN t.s + t.d ELSE w.until END FROM w JOIN t ON t.asset = w.asset AND t.n = w.n + 1)
SELECT asset, execution_id, accepted FROM w""")
def coalesce_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    triggers = table(spark, sf_dir, "syncs").select("asset", "execution_id", micros("ts").alias("start_us"), "duration_s")
    return coalesce(triggers).select("asset", "execution_id", "accepted")


OVERLAP_SQL = """
pairs AS (SELECT a.asset, a.execution_id AS earlier, b.execution_id AS later FROM syncs a JOIN syncs b ON a.asset = b.asset
  AND (b.ts > a.ts OR (b.ts = a.ts AND b.execution_id > a.execution_id)) AND epoch_us(b.ts) - epoch_us(a.ts) <= 3600000000)"""


@query(f"WITH {OVERLAP_SQL} SELECT asset, earlier, later FROM pairs")
def overlapping_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.overlaps(table(spark, sf_dir, "syncs"), 3600)


@query("""
WITH w AS (SELECT asset, execution_id, epoch_us(ts) AS us, max(epoch_us(ts) + 3600000000) OVER (PARTITION BY asset ORDER BY ts, execution_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held_until_us FROM syncs)
SELECT asset, execution_id, held_until_us, coalesce(held_until_us >= us, false) AS overlaps FROM w""")
def lock_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which runs overlap, without the pairs of ``overlapping_runs``."""
    return H.lock_overlaps(table(spark, sf_dir, "syncs"), 3600)


@query("""
WITH e AS (SELECT asset, ts, evaluation_id FROM evals), b AS (SELECT s.execution_id, s.asset, s.ts, e.evaluation_id AS before_id FROM syncs s ASOF LEFT JOIN e ON s.asset = e.asset AND s.ts >= e.ts)
SELECT b.execution_id, b.before_id, e.evaluation_id AS after_id FROM b ASOF LEFT JOIN e ON b.asset = e.asset AND b.ts < e.ts""")
def link_sync_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.link_evaluations(table(spark, sf_dir, "syncs"), table(spark, sf_dir, "evals"))


@query("""
WITH last AS (SELECT asset, max_by(evaluation_id, ts) AS evaluation_id, max_by(ready, ts) AS ready FROM evals GROUP BY asset),
  judged AS (SELECT u.asset, max(l.ready) AS ready, bool_or(g.result <> 'Ready' AND g.condition_name IN ('c2', 'c3')) AS slow, bool_or(g.result <> 'Ready') AS any_drift
    FROM users u LEFT JOIN last l ON u.asset = l.asset LEFT JOIN eval_log g ON g.evaluation_id = l.evaluation_id GROUP BY u.asset)
SELECT asset, ready, CASE WHEN slow THEN 'full' WHEN any_drift THEN 'light' END AS sync, CASE WHEN slow THEN 'pre,run,post' WHEN any_drift THEN 'run' END AS stages FROM judged""")
def sync_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two entries for each user: conditions c2 and c3 with a full sync before c0 and c1 with a light one."""
    rules = spark.createDataFrame([(0, "slow", "full"), (1, "quick", "light")], "position int, conditions string, sync string")
    names = spark.createDataFrame([("slow", "c2"), ("slow", "c3"), ("quick", "c0"), ("quick", "c1")], "conditions string, condition_name string")
    stages = spark.createDataFrame([("full", 0, "pre"), ("full", 1, "run"), ("full", 2, "post"), ("light", 1, "run")], "sync string, pos int, stage string")
    entries = table(spark, sf_dir, "users").crossJoin(F.broadcast(rules))  # two rows
    return H.proposals(table(spark, sf_dir, "evals"), table(spark, sf_dir, "eval_log"), entries, names, stages)


@query(f"""WITH {STREAK_SQL},
old AS (SELECT asset, 'failures' AS reason, max(epoch_us(ts)) AS suspended_us FROM streaks WHERE streak >= 3 GROUP BY asset),
halted AS (SELECT * FROM old UNION ALL SELECT asset, 'halted', (SELECT max(epoch_us(ts)) FROM events) FROM users WHERE asset NOT IN (SELECT asset FROM old))
SELECT asset, reason, suspended_us FROM halted WHERE asset NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)""")
def halt_and_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All users halted, then those of one nation resumed."""
    old = H.suspend_points(_streaks(spark, sf_dir)).groupBy("asset").agg(F.lit("failures").alias("reason"), F.max(micros("ts")).alias("suspended_us"))
    selected = table(spark, sf_dir, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("asset"))
    return H.resume(H.halt(table(spark, sf_dir, "users"), old, "halted", newest(spark, sf_dir)), selected)


@query(f"""WITH {STREAK_SQL}, {OVERLAP_SQL}
SELECT 'EvaluateFailed' AS kind, asset, evaluation_id AS id, 'evaluation of ' || asset || ' failed: no condition is Ready' AS message FROM evals WHERE ready_count = 0
UNION ALL SELECT 'Suspended', asset, execution_id, asset || ' suspended: ' || streak || ' consecutive failures' FROM streaks WHERE streak >= 3
UNION ALL SELECT 'SyncLockSkipped', asset, later, 'sync of ' || asset || ' skipped: lock held' FROM pairs""")
def alert_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "evals").where("ready_count = 0").withColumn("detail", F.lit("no condition is Ready"))
    return H.alerts(failed, H.suspend_points(_streaks(spark, sf_dir)), H.overlaps(table(spark, sf_dir, "syncs"), 3600))
