"""Queries of sources, sinks and conditions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.times import date_key, parse_ts
from evenkeel.operators import conditions as C
from evenkeel.plans.fixtures import newest, table, viewed
from evenkeel.plans.registry import query
from evenkeel.session import scratch_dir, ship_package
from evenkeel.sources import assets as S

ORDER_SCHEMA = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
EVENT_JSON = "event_id long, user_id long, event_type string, value double, props string, note string"


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def scan_asset_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as CSV and read by name and schema."""
    path = scratch_dir(spark)
    S.read_asset(spark, f"{sf_dir}/orders.parquet").select(*[c.split()[0] for c in ORDER_SCHEMA.split(", ")]).write.option("header", True).csv(path)
    return S.read_asset(spark, path, "csv", ORDER_SCHEMA)


@query("SELECT c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS segment FROM customer")
def query_rows_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON, read back."""
    table(spark, sf_dir, "customer")
    rows = S.query_rows(spark, viewed("SELECT c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS segment FROM customer;"))
    return rows.select(F.from_json("row", "c_custkey long, c_name string, segment string").alias("r")).select("r.*")


@query("SELECT event_id, user_id, event_type, value, CASE WHEN event_type = 'error' THEN props END AS note, to_base64(encode(props)) AS raw FROM events")
def export_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with nulls and a binary column as JSON lines, read back."""
    path = scratch_dir(spark)
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.when(F.col("event_type") == "error", F.col("props")).alias("note"), F.col("props").cast("binary").alias("raw"), F.col("event_id").alias("row_id"))
    S.write_jsonl(rows, path, row_id="row_id")
    return spark.read.schema("event_id long, user_id long, event_type string, value double, note string, raw string").json(path)


@query("SELECT event_id, user_id, event_type, value, props, CAST(NULL AS VARCHAR) AS note FROM events")
def load_jsonl_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines into a staging table, twice: the second load replaces the first."""
    lines, staging = scratch_dir(spark), scratch_dir(spark)
    S.write_jsonl(table(spark, sf_dir, "events").drop("ts"), lines)
    S.load_jsonl(spark, lines, staging, single_column=True)
    return S.load_jsonl(spark, lines, staging, EVENT_JSON)


@query("SELECT evaluation_id, condition_name, asset, result, date FROM eval_log WHERE date >= '2024-01-10' AND date <= '2024-01-19'")
def append_log_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation log appended in two parts, and ten days of it read back."""
    path = scratch_dir(spark)
    log = table(spark, sf_dir, "eval_log").drop("date")
    for part in ("c0", "c1"), ("c2", "c3"):
        S.append_log(log.where(F.col("condition_name").isin(*part)), path)
    return S.read_log(spark, path, "2024-01-10", "2024-01-19").select("evaluation_id", "condition_name", "asset", "result", "date")


@query("""
WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN replace(CAST(ts AS VARCHAR), '-', '/') WHEN 1 THEN NULL ELSE CAST(ts AS VARCHAR) END AS v FROM events)
SELECT event_id, CASE WHEN regexp_matches(substr(v, 1, 10), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN substr(v, 1, 10) END AS date FROM t""")
def date_partition_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("ts").cast("string")
    mixed = F.when(F.col("event_id") % 4 == 0, F.replace(text, F.lit("-"), F.lit("/"))).when(F.col("event_id") % 4 != 1, text)
    return table(spark, sf_dir, "events").select("event_id", date_key(mixed).alias("date"))


def _fresh_sql(newest_sql: str, age: int) -> tuple[str, str]:
    us = f"(epoch_us(now) - epoch_us({newest_sql}))"
    state = f"CASE WHEN {newest_sql} IS NULL THEN 'Error' WHEN {us} <= {age * 1_000_000} THEN 'Ready' ELSE 'Drifted' END"
    reason = f"CASE WHEN {newest_sql} IS NULL THEN 'no timestamp' WHEN {us} > {age * 1_000_000} THEN 'last updated ' || CAST({us} // 1000000 AS VARCHAR) || 's ago, max age is {age}s' END"
    return state, reason


@query(f"""
WITH n AS (SELECT max(ts) AS now FROM events), m(asset, newest) AS (
  SELECT 'events', max(ts) FROM events UNION ALL SELECT 'orders', max(o_orderdate) FROM orders UNION ALL SELECT 'empty', max(ts) FROM events WHERE event_id < 0)
SELECT asset, {_fresh_sql("newest", 3600)[0]} AS state, {_fresh_sql("newest", 3600)[1]} AS reason FROM m, n""")
def freshness_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, events = newest(spark, sf_dir), table(spark, sf_dir, "events")
    tables = {"events": events, "orders": table(spark, sf_dir, "orders"), "empty": events.where("event_id < 0")}
    rules = {a: [C.freshness("o_orderdate" if a == "orders" else "ts", 3600, now)] for a in tables}
    return C.evaluate_assets(rules, tables).select("asset", "state", "reason")


@query(f"""
WITH n AS (SELECT max(ts) AS now FROM events), m AS (SELECT asset, max(started_at) AS newest FROM eval_log GROUP BY asset)
SELECT asset, {_fresh_sql("newest", 86400)[0]} AS state, {_fresh_sql("newest", 86400)[1]} AS reason FROM m, n""")
def freshness_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.freshness_by(table(spark, sf_dir, "eval_log"), ["asset"], "started_at", 86400, newest(spark, sf_dir))


@query(r"""
WITH t AS (SELECT event_id, CASE event_id % 6
    WHEN 0 THEN replace(CAST(ts AS VARCHAR), ' ', 'T') || 'Z' WHEN 1 THEN replace(CAST(ts AS VARCHAR), ' ', 'T') || '.750+02:00'
    WHEN 2 THEN CAST(epoch_us(ts) // 1000000 AS VARCHAR) WHEN 3 THEN CAST(epoch_us(ts) // 1000000 AS VARCHAR) || '.5'
    WHEN 4 THEN CAST(ts AS VARCHAR) ELSE NULL END AS v, epoch_us(ts) // 1000000 AS s FROM events)
SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(s AS DOUBLE) WHEN 1 THEN CAST(s - 7200 AS DOUBLE) WHEN 2 THEN CAST(s AS DOUBLE) WHEN 3 THEN s + 0.5 ELSE TRY_CAST(v AS DOUBLE) END AS epoch_s FROM t""")
def freshness_value_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    number = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")).cast("string")
    kind = F.col("event_id") % 6
    mixed = F.when(kind == 0, F.concat(text, F.lit("Z"))).when(kind == 1, F.concat(text, F.lit(".750+02:00"))).when(kind == 2, number)
    mixed = mixed.when(kind == 3, F.concat(number, F.lit(".5"))).when(kind == 4, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", parse_ts(mixed).alias("epoch_s"))


@query("""
SELECT 'at the limit' AS name, 'Ready' AS state, NULL AS reason FROM events HAVING count(*) > 0
UNION ALL SELECT 'past it', 'Drifted', 'last updated 3600s ago, max age is 3599s' UNION ALL SELECT 'no row', 'Error', 'no timestamp'""")
def freshness_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State by the files' modification times, an hour after the newest."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    newest_file = events.agg((F.unix_micros(F.max("_metadata.file_modification_time")) + 3_600_000_000).alias("us")).head()[0]
    now = F.timestamp_micros(F.lit(newest_file))
    cases = (("at the limit", events, 3600), ("past it", events, 3599), ("no row", events.where("event_id < 0"), 3600))
    return reduce(DataFrame.unionByName, [C.freshness_files(df, age, now).select(F.lit(name).alias("name"), "state", "reason") for name, df, age in cases])


SQL_CONDITIONS = {
    "true": "SELECT count(*) > 0 FROM orders",
    "false": "SELECT count(*) = 0 FROM orders;",
    "word": "SELECT 'TRUE' FROM region",
    "null": "SELECT CAST(NULL AS BOOLEAN) FROM region",
    "number": "SELECT count(*) FROM orders",
    "text": "SELECT r_name FROM region WHERE r_regionkey = 1",
    "no_row": "SELECT true FROM region WHERE r_regionkey < 0",
    "not_a_query": "DROP TABLE orders",
}


@query("""
SELECT name, state, CASE WHEN reason = '#' THEN 'not a boolean: ' || CAST((SELECT count(*) FROM orders) AS VARCHAR) WHEN reason = '@' THEN 'not a boolean: ' || (SELECT r_name FROM region WHERE r_regionkey = 1) ELSE reason END AS reason
FROM (VALUES ('true', 'Ready', NULL), ('false', 'Drifted', 'query returned false'), ('word', 'Ready', NULL), ('null', 'Error', 'null'), ('number', 'Error', '#'),
  ('text', 'Error', '@'), ('no_row', 'Error', 'no row'), ('not_a_query', 'Error', 'ParseException')) AS t(name, state, reason)""")
def sql_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders")
    table(spark, sf_dir, "region")
    parts = [C.sql_condition(spark, viewed(q)).select(F.lit(name).alias("name"), "*") for name, q in SQL_CONDITIONS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""
WITH t AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice < 0) AS bad FROM orders)
SELECT 'some' AS condition, CASE WHEN n > 0 THEN 'Ready' ELSE 'Drifted' END AS state, CASE WHEN NOT n > 0 THEN CAST(n AS VARCHAR) || ' rows, not > 0' END AS reason FROM t
UNION ALL SELECT 'none', CASE WHEN n = 0 THEN 'Ready' ELSE 'Drifted' END, CASE WHEN n <> 0 THEN CAST(n AS VARCHAR) || ' rows, not = 0' END FROM t
UNION ALL SELECT 'no_bad', CASE WHEN bad = 0 THEN 'Ready' ELSE 'Drifted' END, CASE WHEN bad <> 0 THEN CAST(bad AS VARCHAR) || ' rows, not = 0' END FROM t""")
def row_count_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [C.row_count(">", 0, name="some"), C.row_count("=", 0, name="none"), C.row_count("=", 0, F.col("o_totalprice") < 0, "no_bad")]
    return C.evaluate(table(spark, sf_dir, "orders"), rules).select("condition", "state", "reason")


def _verdict_sql(name: str, count: str, what: str) -> str:
    return f"SELECT '{name}' AS condition, CASE WHEN {count} = 0 THEN 'Ready' ELSE 'Drifted' END AS state, CASE WHEN {count} <> 0 THEN CAST({count} AS VARCHAR) || ' {what}' END AS reason"


@query(f"""
WITH t AS (SELECT count(*) FILTER (WHERE o_orderkey IS NULL) AS a, count(*) FILTER (WHERE nullif(o_orderpriority, '5-LOW') IS NULL) AS b FROM orders)
{_verdict_sql("key", "a", "null values")} FROM t UNION ALL {_verdict_sql("priority", "b", "null values")} FROM t""")
def not_null_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [C.not_null("o_orderkey", "key"), C.not_null(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")), "priority")]
    return C.evaluate(table(spark, sf_dir, "orders"), rules).select("condition", "state", "reason")


@query(f"""
WITH a AS (SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1) x),
  b AS (SELECT count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) x)
{_verdict_sql("orders", "n", "repeated keys")} FROM a UNION ALL {_verdict_sql("lineitem", "n", "repeated keys")} FROM b""")
def unique_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = C.evaluate(table(spark, sf_dir, "orders"), [C.unique("o_orderkey", name="orders")])
    b = C.evaluate(table(spark, sf_dir, "lineitem"), [C.unique("l_orderkey", "l_linenumber", name="lineitem")])
    return a.unionByName(b).select("condition", "state", "reason")


@query(f"""
WITH t AS (SELECT count(*) FILTER (WHERE o_orderstatus NOT IN ('P', 'O', 'F')) AS a, count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) AS b FROM orders)
{_verdict_sql("all", "a", "other values")} FROM t UNION ALL {_verdict_sql("closed", "b", "other values")} FROM t""")
def accepted_values_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [C.accepted_values("o_orderstatus", ["P", "O", "F"], "all"), C.accepted_values("o_orderstatus", ["O", "F"], "closed")]
    return C.evaluate(table(spark, sf_dir, "orders"), rules).select("condition", "state", "reason")


@query(f"""
WITH a AS (SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)),
  b AS (SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))
{_verdict_sql("all", "n", "orphan rows")} FROM a UNION ALL {_verdict_sql("solvent", "n", "orphan rows")} FROM b""")
def relationships_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    rules = [C.relationships("o_custkey", customers, "c_custkey", "all"), C.relationships("o_custkey", customers.where("c_acctbal > 0"), "c_custkey", "solvent")]
    return C.evaluate(table(spark, sf_dir, "orders"), rules).select("condition", "state", "reason")


@query(f"""
WITH t AS (SELECT count(*) FILTER (WHERE NOT (value >= 0)) AS a, count(*) FILTER (WHERE NOT (value < 100)) AS b FROM events)
{_verdict_sql("positive", "a", "rows failed")} FROM t UNION ALL {_verdict_sql("under_100", "b", "rows failed")} FROM t""")
def python_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf(T.BooleanType())
    def positive(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in values:
            yield v >= 0

    @F.pandas_udf(T.BooleanType())
    def under_100(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in values:
            yield v < 100

    ship_package(spark)
    rows = table(spark, sf_dir, "events").select(positive("value").alias("a"), under_100("value").alias("b"))
    return C.evaluate(rows, [C.python_condition(F.col("a"), "positive"), C.python_condition(F.col("b"), "under_100")]).select("condition", "state", "reason")


@query("""
SELECT c_custkey AS asset, coalesce(r, true) AS ready FROM customer LEFT JOIN (SELECT asset, min(CASE WHEN result = 'Ready' THEN 1 ELSE 0 END) = 1 AS r FROM eval_log GROUP BY asset) t ON c_custkey = asset""")
def condition_group_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "eval_log").withColumnRenamed("result", "state")
    return C.asset_ready(results, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asset")))


@query("SELECT evaluation_id, asset, CAST(count(*) FILTER (WHERE result = 'Ready') AS BIGINT) AS ready_count FROM eval_log GROUP BY evaluation_id, asset")
def ready_condition_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ready_count(table(spark, sf_dir, "eval_log"), "evaluation_id", "asset")


def asset_rules(spark: SparkSession, sf_dir: str) -> tuple[dict[str, list[C.Condition]], dict[str, DataFrame]]:
    """Conditions over three tables: five plain ones and two with a pass of their own."""
    now = newest(spark, sf_dir)
    tables = {n: table(spark, sf_dir, n) for n in ("events", "orders", "lineitem")}
    rules = {
        "events": [C.freshness("ts", 3600, now, "fresh"), C.not_null("user_id", "user"), C.accepted_values("event_type", ["view", "click", "signup", "purchase"], "type")],
        "orders": [C.freshness("o_orderdate", 3600, now, "fresh"), C.not_null("o_custkey", "customer")],
        "lineitem": [C.unique("l_orderkey", "l_linenumber", name="key"), C.relationships("l_orderkey", tables["orders"], "o_orderkey", "order")],
    }
    return rules, tables


@query(f"""
WITH n AS (SELECT max(ts) AS now FROM events), e AS (SELECT max(ts) AS newest, count(*) AS rows_, count(*) FILTER (WHERE user_id IS NULL) AS nulls, count(*) FILTER (WHERE event_type NOT IN ('view', 'click', 'signup', 'purchase')) AS others FROM events),
  o AS (SELECT max(o_orderdate) AS newest, count(*) FILTER (WHERE o_custkey IS NULL) AS nulls FROM orders),
  u AS (SELECT count(*) AS n FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) x),
  r AS (SELECT count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
SELECT 'events' AS asset, 'fresh' AS condition, 'Freshness' AS type, {_fresh_sql("newest", 3600)[0]} AS state, {_fresh_sql("newest", 3600)[1]} AS reason FROM e, n
UNION ALL SELECT 'orders', 'fresh', 'Freshness', {_fresh_sql("newest", 3600)[0]}, {_fresh_sql("newest", 3600)[1]} FROM o, n
UNION ALL SELECT 'events', 'user', 'NotNull', state, reason FROM ({_verdict_sql("x", "nulls", "null values")} FROM e) t
UNION ALL SELECT 'events', 'type', 'AcceptedValues', state, reason FROM ({_verdict_sql("x", "others", "other values")} FROM e) t
UNION ALL SELECT 'orders', 'customer', 'NotNull', state, reason FROM ({_verdict_sql("x", "nulls", "null values")} FROM o) t
UNION ALL SELECT 'lineitem', 'key', 'Unique', state, reason FROM ({_verdict_sql("x", "n", "repeated keys")} FROM u) t
UNION ALL SELECT 'lineitem', 'order', 'Relationships', state, reason FROM ({_verdict_sql("x", "n", "orphan rows")} FROM r) t""")
def evaluate_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.evaluate_assets(*asset_rules(spark, sf_dir))


@query("SELECT evaluation_id, condition_name, asset, epoch_us(started_at) AS started_us, result, CASE WHEN result = 'Drifted' THEN 'value too high' ELSE '' END AS detail FROM eval_log")
def eval_to_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evenkeel.functions.times import micros

    reason = F.when(F.col("result") == "Drifted", "value too high")
    nested = table(spark, sf_dir, "eval_log").groupBy("evaluation_id", "asset", "started_at").agg(F.collect_list(F.struct("condition_name", F.col("result").alias("state"), reason.alias("reason"))).alias("conditions"))
    return C.to_log_rows(nested).select("evaluation_id", "condition_name", "asset", micros("started_at").alias("started_us"), "result", "detail")
