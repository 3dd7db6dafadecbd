"""The continuous loop as streaming queries.

Streams are plain DataFrames from ``readStream``. Stateful rules that no built-in operator states see each
asset's rows in the order of event time (see ``ordered``). Sinks are idempotent: a batch that is replayed
after a failure adds nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators.export import merge_new
from evenkeel.streaming.ordered import Found, Rule, State, apply_in_order


def stream_eval(log: DataFrame, interval: str, delay: str) -> DataFrame:
    """(asset, window, evaluated, drifted, rate) per tumbling window of event time; late rows past the delay are dropped."""
    windows = log.withWatermark("ts", delay).groupBy(F.window("ts", interval).alias("window"), "asset")
    counted = windows.agg(F.count(F.lit(1)).alias("evaluated"), F.count_if(F.col("result") == "Drifted").alias("drifted"))
    return counted.withColumn("rate", F.round(F.col("drifted") / F.col("evaluated"), 6))


class Freshness(Rule):
    """Ready at the first row and after a gap, Drifted once nothing newer came for ``max_age_s``."""

    fields: dict[str, str] = {}
    state = "newest long, drifted boolean"
    output = "asset long, at_us long, state string, newest_us long, reason string"
    start = (None, False)

    def __init__(self, max_age_s: int):
        self.max_age_s, self.age = max_age_s, max_age_s * 1_000_000

    def _rows(self, at: list[int], drifted: list[bool], newest: list[int]) -> Found:
        reason = f"last updated {self.max_age_s}s ago, max age is {self.max_age_s}s"
        text = lambda there, none: np.array([there if d else none for d in drifted], object)
        return {"at_us": np.array(at, np.int64), "state": text("Drifted", "Ready"), "newest_us": np.array(newest, np.int64), "reason": text(reason, None)}

    def apply(self, state: State, rows: np.ndarray) -> tuple[State, Found]:
        newest, drifted = state
        times = rows["us"] if newest is None else np.concatenate([[newest], rows["us"]])
        gaps = np.flatnonzero(np.diff(times) > self.age)
        found = [(int(times[0]), False, int(times[0]))] if newest is None else []
        for n in gaps.tolist():
            if not (n == 0 and drifted):
                found.append((int(times[n]) + self.age, True, int(times[n])))
            found.append((int(times[n + 1]), False, int(times[n + 1])))
        columns = zip(*found, strict=True) if found else ([], [], [])
        return (int(times[-1]), drifted and not len(gaps)), self._rows(*map(list, columns))

    def passed(self, state: State, watermark: int) -> tuple[State, Found]:
        newest, drifted = state
        if newest is None or drifted or watermark - newest <= self.age:
            return state, {}
        return (newest, True), self._rows([newest + self.age], [True], [newest])

    def wake(self, state: State) -> int | None:
        newest, drifted = state
        return None if newest is None or drifted else newest + self.age + 1


def stream_freshness(log: DataFrame, max_age_s: int, delay: str) -> DataFrame:
    """(asset, at_us, state, newest_us, reason): when each asset (asset, ts, id) becomes Ready and, without a row for longer than ``max_age_s``, Drifted.

    Time is event time: the watermark's passing shows an asset that has gone silent, no row of it is
    needed. An age of just ``max_age_s`` is still Ready. The reason is that of the moment of drifting.
    """
    return apply_in_order(log, "asset", "ts", "id", Freshness(max_age_s), delay)


class Transitions(Rule):
    """Rows at which a key goes from Not Ready to Ready."""

    fields = {"ready": "?"}
    state = "ready boolean"
    output = "asset long, evaluation_id long"
    start = (False,)

    def apply(self, state: State, rows: np.ndarray) -> tuple[State, Found]:
        ready = rows["ready"]
        before = np.concatenate([[state[0]], ready[:-1]])
        return (bool(ready[-1]),), {"evaluation_id": rows["id"][ready & ~before]}


def stream_transitions(evals: DataFrame, delay: str) -> DataFrame:
    """(asset, evaluation_id) of evaluations (asset, ts, id, ready) that go from Not Ready to Ready; null counts as Not Ready."""
    return apply_in_order(evals, "asset", "ts", "id", Transitions(), delay)


class Guardrail(Rule):
    """Streaks of failures with their cooldown, suspension at the limit, and its end at the next Ready evaluation."""

    fields = {"is_sync": "?", "failed": "?", "ready": "?"}
    state = "streak long, suspended boolean"
    output = "asset long, id long, kind string, streak long, wait_s long"
    start = (0, False)

    def __init__(self, limit: int, initial_s: int, cap_s: int):
        self.limit, self.initial_s, self.cap_s = limit, initial_s, cap_s

    def _streaks(self, streak: int, failed: np.ndarray, reset: np.ndarray) -> np.ndarray:
        """The streak at each row, given the one before, failures, and rows that reset it."""
        failures = np.cumsum(failed) + streak
        return failures - np.maximum.accumulate(np.where(reset, failures, 0))

    def apply(self, state: State, rows: np.ndarray) -> tuple[State, Found]:
        streak, suspended = state
        failed, reset = rows["is_sync"] & rows["failed"], rows["is_sync"] & ~rows["failed"]
        ready = ~rows["is_sync"] & rows["ready"]
        streaks, resumes, at = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool), 0
        while at < len(rows):  # from one end of a suspension to the next
            here = self._streaks(streak, failed[at:], reset[at:])
            over = np.ones(len(here), bool) if suspended else np.maximum.accumulate(failed[at:] & (here >= self.limit))
            ends = np.flatnonzero(ready[at:] & over)
            stop = int(ends[0]) if len(ends) else len(here)
            streaks[at : at + stop] = here[:stop]
            if not len(ends):
                streak, suspended = int(here[-1]), bool(over[-1])
                break
            resumes[at + stop] = True
            streak, suspended, at = 0, False, at + stop + 1
        wait = np.minimum(self.initial_s * 2.0 ** np.minimum(streaks - 1, 40), self.cap_s).astype(np.int64)
        suspends = failed & (streaks >= self.limit)
        kinds = [("cooldown", failed, streaks, wait), ("suspend", suspends, streaks, wait * 0), ("resume", resumes, streaks * 0, wait * 0)]
        part = lambda of: np.concatenate([of(*k) for k in kinds])
        found = {"id": part(lambda _, m, s, w: rows["id"][m]), "kind": part(lambda k, m, s, w: np.full(m.sum(), k, object)), "streak": part(lambda _, m, s, w: s[m]), "wait_s": part(lambda _, m, s, w: w[m])}
        return (streak, suspended), found


def stream_guardrail(events: DataFrame, delay: str, limit: int = 3, initial_s: int = 30, cap_s: int = 1800) -> DataFrame:
    """(asset, id, kind, streak, wait_s): cooldown and suspend events of failures, resume events of suspended assets that become Ready.

    events: asset, ts, id, is_sync (else an evaluation), failed, ready. A success and a resume reset the streak.
    """
    return apply_in_order(events, "asset", "ts", "id", Guardrail(limit, initial_s, cap_s), delay)


def stream_dedup(df: DataFrame, keys: Sequence[str], ts: str | None = None, delay: str | None = None) -> DataFrame:
    """The first record of each key; with a delay, keys are forgotten once that far behind, so the state stays bounded."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys)) if ts and delay else df.dropDuplicates(list(keys))


def stream_link(syncs: DataFrame, evals: DataFrame, within: str, delay: str) -> DataFrame:
    """Pairs of a sync and the evaluations of its asset at most ``within`` later; both sides have a time ``ts``.

    They meet in time buckets as wide as ``within``: a row is held against those of the asset's bucket, not against
    all of the asset's that the state has. A sync is in each bucket that its evaluations may be in, mostly two.
    """
    width = max(1, syncs.sparkSession.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL {within})").head()[0])
    bucket = lambda ts: F.floor(F.unix_micros(ts) / width)
    end = F.col("ts") + F.expr(f"INTERVAL {within}")
    s = syncs.withWatermark("ts", delay).select(F.col("asset").alias("s_asset"), "execution_id", F.col("ts").alias("s_ts"), F.explode(F.sequence(bucket(F.col("ts")), bucket(end))).alias("s_bucket"))
    e = evals.withWatermark("ts", delay).select("asset", "evaluation_id", "ts", bucket(F.col("ts")).alias("bucket"))
    near = (F.col("asset") == F.col("s_asset")) & (F.col("bucket") == F.col("s_bucket")) & (F.col("ts") > F.col("s_ts")) & (F.col("ts") <= F.col("s_ts") + F.expr(f"INTERVAL {within}"))
    return s.join(e, near).select("asset", "execution_id", "evaluation_id")


def stream_gate(requests: DataFrame, gates: DataFrame) -> DataFrame:
    """Requests of assets whose gate (asset, open; a static table) is open; an asset without a gate is open."""
    return requests.join(gates.where(~F.col("open")).select("asset"), "asset", "left_anti")


def start_export(df: DataFrame, target: str, keys: Sequence[str], order: str, checkpoint: str, day: str) -> None:
    """Run a stream to its present end, appending each batch's new keys to the Parquet table ``target``.

    The checkpoint takes the watermark's place. A replayed batch finds its keys in the target. Rows of
    one key have the same ``day``, by which the target is partitioned: a batch reads its own days only.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        days = [r[0] for r in batch.select(day).distinct().collect()]  # one for each day in the batch
        present = spark.read.schema(batch.schema).parquet(target).where(F.col(day).isin(days))
        merge_new(present, batch, keys, order).write.partitionBy(day).mode("append").parquet(target)

    df.limit(0).sparkSession.createDataFrame([], df.schema).write.partitionBy(day).mode("ignore").parquet(target)
    df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream to its present end into Parquet at ``path``, with the number of the batch as ``__batch``.

    A batch writes a folder of its own, so a replay replaces it.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_result(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of a finished run; with keys, the last update of each."""
    rows = spark.read.parquet(path).drop("batch")
    if not keys:
        return rows.drop("__batch")
    others = [c for c in rows.columns if c not in keys and c != "__batch"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "__batch").alias("__last"))
    return last.select(*keys, "__last.*")
