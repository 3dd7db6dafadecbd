"""Queries of the streams: each runs to the end of its source and returns what it put out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.times import micros
from evenkeel.operators import graph as G
from evenkeel.operators.history import latest
from evenkeel.plans.fixtures import table
from evenkeel.plans.registry import query
from evenkeel.session import scratch_dir, ship_package
from evenkeel.streaming import streams as S
from evenkeel.streaming.ordered import keep_state_in_rocksdb


#: Bounds what a micro-batch reads.
FILES_PER_TRIGGER = 16


def _events(spark: SparkSession, folder: str, files: str = "events.parquet") -> DataFrame:
    """The event table as a stream; the schema is the table's."""
    ship_package(spark)
    keep_state_in_rocksdb(spark)
    schema = spark.read.parquet(f"{folder}/{files}").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", files.split("/")[-1]).option("maxFilesPerTrigger", FILES_PER_TRIGGER).parquet(folder)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def _log(events: DataFrame) -> DataFrame:
    """The evaluation log of an event stream: four conditions for each evaluation."""
    rows = events.where(F.col("event_type").isin("view", "click", "signup")).withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    result = F.when(F.col("value") < 25 * (F.col("k") + 1), "Ready").otherwise("Drifted")
    return rows.select(F.col("event_id").alias("evaluation_id"), F.concat(F.lit("c"), F.col("k").cast("string")).alias("condition_name"), F.col("user_id").alias("asset"), "ts", result.alias("result"))


def _evals(events: DataFrame) -> DataFrame:
    """Evaluations of an event stream: Ready if all four conditions are, that is below the least bound."""
    rows = events.where(F.col("event_type").isin("view", "click", "signup"))
    return rows.select(F.col("user_id").alias("asset"), "ts", F.col("event_id").alias("id"), F.col("event_id").alias("evaluation_id"), (F.col("value") < 25).alias("ready"))


def _finish(spark: SparkSession, df: DataFrame, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    path = scratch_dir(spark)
    S.run_to_end(df, path, scratch_dir(spark), mode)
    return S.read_result(spark, path, keys)


@query("""
SELECT asset, epoch_us(time_bucket(INTERVAL 1 DAY, started_at)) AS start_us, count(*) AS evaluated, count(*) FILTER (WHERE result = 'Drifted') AS drifted,
  round(count(*) FILTER (WHERE result = 'Drifted') / count(*), 6) AS rate FROM eval_log GROUP BY 1, 2""")
def stream_evaluate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = S.stream_eval(_log(_events(spark, sf_dir)), "1 day", "1 hour").select("asset", F.col("window.start").cast("timestamp_ntz").alias("start"), "evaluated", "drifted", "rate")
    done = _finish(spark, counted, "update", ("asset", "start"))
    return done.select("asset", micros("start").alias("start_us"), "evaluated", "drifted", "rate")


#: How late rows may be. A stream's end leaves the rows of its last hour waiting.
DELAY = "1 hour"


def _applied(name: str, ts: str = "ts") -> str:
    """SQL: the rows of ``name`` that the watermark, in milliseconds, has passed when the stream ends."""
    return f"(SELECT * FROM {name} WHERE epoch_us({ts}) <= (SELECT max(epoch_us({ts})) // 1000 * 1000 - 3600000000 FROM {name}))"


@query(f"""
WITH mark AS (SELECT max(epoch_us(ts)) // 1000 * 1000 - 3600000000 AS now FROM evals),
x AS (SELECT asset, us, lag(us) OVER (PARTITION BY asset ORDER BY us) AS prev, lead(us) OVER (PARTITION BY asset ORDER BY us) AS nxt FROM (SELECT DISTINCT asset, epoch_us(ts) AS us FROM {_applied('evals')}) t)
SELECT asset, us AS at_us, 'Ready' AS state, us AS newest_us, CAST(NULL AS VARCHAR) AS reason FROM x WHERE prev IS NULL OR us - prev > 86400000000
UNION ALL SELECT asset, us + 86400000000, 'Drifted', us, 'last updated 86400s ago, max age is 86400s' FROM x, mark WHERE coalesce(nxt, now) - us > 86400000000""")
def stream_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each asset's evaluations become fresh and, a day after the last, stale."""
    return _finish(spark, S.stream_freshness(_evals(_events(spark, sf_dir)), 86_400, DELAY))


TRANSITIONS_SQL = f"SELECT evaluation_id, asset FROM (SELECT *, lag(ready, 1, false) OVER (PARTITION BY asset ORDER BY ts, evaluation_id) AS prev FROM {_applied('evals')} u) t WHERE ready AND NOT prev"


@query(TRANSITIONS_SQL)
def stream_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finish(spark, S.stream_transitions(_evals(_events(spark, sf_dir)), DELAY))


@query(f"""
WITH RECURSIVE t AS (SELECT event_id AS id, user_id AS asset, event_type IN ('purchase', 'error') AS is_sync, event_type = 'error' AS failed, value < 25 AS ready,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {_applied('events')} e),
  w AS (SELECT asset, id, n, is_sync, failed, CAST(CASE WHEN is_sync AND failed THEN 1 ELSE 0 END AS BIGINT) AS streak, false AS suspended, false AS resumed FROM t WHERE n = 1
    UNION ALL SELECT t.asset, t.id, t.n, t.is_sync, t.failed,
      CASE WHEN t.is_sync AND t.failed THEN w.streak + 1 WHEN t.is_sync OR (w.suspended AND t.ready) THEN 0 ELSE w.streak END,
      CASE WHEN t.is_sync AND t.failed AND w.streak + 1 >= 3 THEN true WHEN NOT t.is_sync AND t.ready THEN false ELSE w.suspended END,
      NOT t.is_sync AND w.suspended AND t.ready FROM w JOIN t ON t.asset = w.asset AND t.n = w.n + 1)
SELECT asset, id, 'cooldown' AS kind, streak, CAST(least(30 * power(2, least(streak - 1, 40)), 1800) AS BIGINT) AS wait_s FROM w WHERE is_sync AND failed
UNION ALL SELECT asset, id, 'suspend', streak, 0 FROM w WHERE is_sync AND failed AND streak >= 3 UNION ALL SELECT asset, id, 'resume', 0, 0 FROM w WHERE resumed""")
def stream_guardrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_sync = F.col("event_type").isin("purchase", "error")
    rows = _events(spark, sf_dir).select(
        F.col("user_id").alias("asset"), "ts", F.col("event_id").alias("id"), is_sync.alias("is_sync"), (F.col("event_type") == "error").alias("failed"), (F.col("value") < 25).alias("ready")
    )
    return _finish(spark, S.stream_guardrail(rows, DELAY))


@query("SELECT evaluation_id, condition_name, asset, result FROM eval_log")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each log record twice, at the same event time."""
    twice = _log(_events(spark, sf_dir)).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return _finish(spark, S.stream_dedup(twice, ["evaluation_id", "condition_name"], "ts", "1 hour")).select("evaluation_id", "condition_name", "asset", "result")


@query("SELECT s.asset, s.execution_id, e.evaluation_id FROM syncs s JOIN evals e ON s.asset = e.asset AND e.ts > s.ts AND e.ts <= s.ts + INTERVAL 6 HOUR")
def stream_sync_eval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    syncs = _events(spark, sf_dir).where(F.col("event_type").isin("purchase", "error")).select(F.col("user_id").alias("asset"), F.col("event_id").alias("execution_id"), "ts")
    return _finish(spark, S.stream_link(syncs, _evals(_events(spark, sf_dir)), "6 HOURS", "1 hour"))


@query("""
WITH gated AS (SELECT e.dst AS asset, min(CASE WHEN r.ready THEN 1 ELSE 0 END) = 1 AS open FROM order_gate_edges e LEFT JOIN readiness r ON e.src = r.asset GROUP BY e.dst)
SELECT event_id AS request_id, concat('o', CAST(event_id AS VARCHAR(20))) AS asset FROM events WHERE concat('o', CAST(event_id AS VARCHAR(20))) NOT IN (SELECT asset FROM gated WHERE NOT open)""")
def stream_static_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event asks for the evaluation of the order of its number."""
    last = latest(table(spark, sf_dir, "evals"), "asset", ["ts", "evaluation_id"], ["ready"])
    ready = last.select(F.concat(F.lit("c"), F.col("asset").cast("string")).alias("asset"), "ready")
    nodes = table(spark, sf_dir, "lineage_nodes").withColumnRenamed("node", "asset")
    gates = G.gate(nodes, table(spark, sf_dir, "order_gate_edges"), ready)
    requests = _events(spark, sf_dir).select(F.col("event_id").alias("request_id"), F.concat(F.lit("o"), F.col("event_id").cast("string")).alias("asset"))
    return _finish(spark, S.stream_gate(requests, gates)).select("request_id", "asset")


@query("SELECT evaluation_id, condition_name, asset, result FROM eval_log")
def stream_export_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log exported as a stream, then replayed from the start with a fresh checkpoint: nothing is added."""
    target = scratch_dir(spark)
    for _ in range(2):
        log = _log(_events(spark, sf_dir)).withColumn("date", F.date_format("ts", "yyyy-MM-dd")).drop("ts")
        S.start_export(log, target, ["evaluation_id", "condition_name"], "result", scratch_dir(spark), "date")
    return spark.read.parquet(target).select("evaluation_id", "condition_name", "asset", "result")


@query(TRANSITIONS_SQL)
def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transitions of two drops of events, the stream being stopped and started again between them."""
    ship_package(spark)
    keep_state_in_rocksdb(spark)
    events = table(spark, sf_dir, "events")
    drops, path, checkpoint = scratch_dir(spark), scratch_dir(spark), scratch_dir(spark)
    middle = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    for part in (events.where(F.col("ts") < middle), events.where(F.col("ts") >= middle)):
        part.write.mode("append").parquet(drops)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES_PER_TRIGGER).parquet(drops).withColumn("ts", F.col("ts").cast("timestamp"))
        S.run_to_end(S.stream_transitions(_evals(stream), DELAY), path, checkpoint)
    return S.read_result(spark, path)
