"""Queries of inspection, export and the marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.json_text import parsed, value_cell
from evenkeel.operators import export as X
from evenkeel.operators import inspection as I
from evenkeel.operators import marts as M
from evenkeel.plans.fixtures import table
from evenkeel.plans.registry import query
from evenkeel.session import scratch_dir

TYPE_SQL = "CASE l_suppkey % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'view' ELSE 'materialized view' END"
COUNTS_SQL = f"""
b AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_shipdate < '2000-01-01' GROUP BY 1), a AS (SELECT l_suppkey, {TYPE_SQL} AS type, count(*) AS n FROM lineitem GROUP BY 1, 2),
counts AS (SELECT a.l_suppkey, a.type, b.n AS before, a.n AS after FROM a JOIN b ON a.l_suppkey = b.l_suppkey)"""


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_suppkey") % 3 == 0, "BASE TABLE").when(F.col("l_suppkey") % 3 == 1, "VIEW").otherwise("MATERIALIZED VIEW")
    after = table(spark, sf_dir, "lineitem").withColumn("object_type", kind)
    return I.compare_counts(after.where(F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz")), after, "l_suppkey")


@query(f"WITH {COUNTS_SQL} SELECT l_suppkey, type, before, after FROM counts")
def row_count_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


@query(f"WITH {COUNTS_SQL} SELECT s_nationkey, max(CASE WHEN before IS DISTINCT FROM after THEN 1 ELSE 0 END) = 1 AS changed FROM counts JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey")
def has_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _counts(spark, sf_dir).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return I.changed_groups(items, "s_nationkey")


def _inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "syncs").select("execution_id", "asset", F.col("ts").alias("inspected_at"), (F.col("duration_s") > 3000).alias("changed"))


@query("""
WITH i AS (SELECT execution_id, asset, ts, duration_s > 3000 AS changed FROM syncs), r AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts DESC, execution_id DESC) AS k FROM i WHERE changed)
SELECT asset, execution_id, row_number() OVER (PARTITION BY asset ORDER BY ts, execution_id) AS nth FROM r WHERE k <= 5""")
def list_inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five changed inspections of each asset."""
    return I.list_inspections(_inspections(spark, sf_dir), 5, changed_only=True).select("asset", "execution_id", "nth")


@query("SELECT execution_id, strftime(ts, '%Y%m%dT%H%M%S.%gZ') || '_' || CASE WHEN duration_s > 3000 THEN 'changed' ELSE 'nochange' END || '_' || execution_id AS key FROM syncs")
def inspection_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inspections(spark, sf_dir).select("execution_id", I.inspection_key(F.col("inspected_at"), F.col("changed"), F.col("execution_id")).alias("key"))


@query("""
SELECT execution_id, duration_s AS items FROM syncs WHERE exit_code = 0 AND execution_id NOT IN (SELECT execution_id FROM syncs WHERE duration_s > 3000) UNION ALL SELECT execution_id, -duration_s FROM syncs WHERE duration_s > 3000""")
def upsert_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    syncs = table(spark, sf_dir, "syncs")
    new = syncs.where("duration_s > 3000").select("execution_id", F.negative("duration_s").alias("items"))
    return I.upsert(syncs.where("exit_code = 0").select("execution_id", F.col("duration_s").alias("items")), new, "execution_id")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs whose labels are the property k and the event's type."""
    k = F.get_json_object("props", "$.k")
    labels = F.array(F.struct(F.lit("k").alias("key"), k.alias("value")), F.struct(F.lit("type").alias("key"), F.col("event_type").alias("value")))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("user_id").alias("execution_id"), labels.alias("labels"))


@query("SELECT event_id AS job_id FROM events WHERE json_extract_string(props, '$.k') = '69'")
def jobs_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.jobs_by_label(_jobs(spark, sf_dir), "k", "69").select("job_id")


@query("""
WITH j AS (SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS jobs FROM (SELECT DISTINCT user_id, event_id FROM events WHERE json_extract_string(props, '$.k') = '69') t GROUP BY user_id)
SELECT c_custkey AS execution_id, CASE WHEN c_custkey % 2 = 0 THEN '0' ELSE coalesce(j.jobs, '') END AS jobs FROM customer LEFT JOIN j ON c_custkey = user_id""")
def backfill_missing_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as inspections; the even ones have a job already."""
    jobs = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    inspections = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("execution_id"), jobs.alias("jobs"))
    found = I.backfill_jobs(inspections, I.jobs_by_label(_jobs(spark, sf_dir), "k", "69"))
    return found.select("execution_id", F.array_join("jobs", ",").alias("jobs"))


@query("""
WITH t AS (SELECT event_id, event_type AS e, json_extract_string(props, '$.k') AS k, CAST(round(value, 1) AS DECIMAL(12,1)) AS v FROM events)
SELECT event_id, k AS plain, 'null' AS missing, k || ', ' || e AS list, 'a=' || k || ', b' AS object, k || ', z=null, ' || v || ', ' || e || ', true' AS deep,
  'below=a=' || k || ', b, kinds=' || e || ', ' || k || ', none=null, share=' || v AS object_in_object, CAST(v AS VARCHAR) AS real,
  'Drifted (' || e || ')' AS judged, 'Ready' AS judged_without_reason, '["' || k || '","' || e || '"]' AS list_compared,
  '{"a":' || k || ',"b":""}' AS object_compared, '{"reason":"' || e || '","state":' || k || '}' AS other_state_compared, k AS plain_compared, '-' AS dash FROM t""")
def json_path_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a document made of each event: plain, nested in lists and objects, and as shown in comparisons."""
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    a_and_b = F.struct(F.lit("").alias("b"), k.cast("long").alias("a"))
    value = F.round("value", 1)
    mixed = F.concat(F.lit('[["'), k, F.lit('",{"z":null}],['), value.cast("string"), F.lit(',"'), kind, F.lit('"],true]'))
    below = F.struct(F.lit(None).cast("string").alias("none"), value.alias("share"), F.array(kind, k).alias("kinds"), a_and_b.alias("below"))
    nested = F.struct(
        k.cast("long").alias("k"), F.array(k, kind).alias("list"), F.struct(a_and_b.alias("object")).alias("deep"), value.alias("value"), below.alias("below"),
        F.struct(F.lit("Drifted").alias("state"), kind.alias("reason")).alias("judged"), F.struct(F.lit("Ready").alias("state"), F.lit("").alias("reason")).alias("ready"),
        F.struct(k.cast("long").alias("state"), kind.alias("reason")).alias("other"),
    )
    text = F.to_json(nested, {"ignoreNullFields": "false"})
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.substr(text, F.lit(1), F.length(text) - 1), F.lit(',"mixed" : '), mixed, F.lit("}")).alias("j"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a small file with millions of rows is one task's else
    values = rows.repartition(tasks, "event_id").select("event_id", parsed(F.col("j")).alias("value"))
    cell = lambda path, compare=False: value_cell(F.col("value"), path, compare)
    return values.select(
        "event_id", cell("k").alias("plain"), cell("none.there").alias("missing"), cell("list").alias("list"), cell("deep.object").alias("object"), cell("mixed").alias("deep"),
        cell("below").alias("object_in_object"), cell("value").alias("real"), cell("judged", True).alias("judged"), cell("ready", True).alias("judged_without_reason"),
        cell("list", True).alias("list_compared"), cell("deep.object", True).alias("object_compared"), cell("other", True).alias("other_state_compared"), cell("k", True).alias("plain_compared"), cell("none", True).alias("dash"),
    )


SOURCE_SQL = """
source AS (SELECT evaluation_id * 4 + CAST(substr(condition_name, 2) AS BIGINT) AS row_id, evaluation_id, condition_name, asset, result FROM eval_log),
marks AS (SELECT max(row_id) // 2 AS wm, max(row_id) * 6 // 10 AS upto FROM source)"""


def _source(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """The evaluation log with row ids, the watermark, and up to where the target has rows."""
    row_id = F.col("evaluation_id") * 4 + F.substring("condition_name", 2, 4).cast("long")
    rows = table(spark, sf_dir, "eval_log").select(row_id.alias("row_id"), "evaluation_id", "condition_name", "asset", "result")
    most = rows.agg(F.max("row_id")).head()[0] or 0
    return rows, most // 2, most * 6 // 10


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lambda kind: F.concat(F.lit("/logs/"), F.col("asset").cast("string"), F.lit("/"), F.col("execution_id").cast("string"), F.lit(f".{kind}"))
    return table(spark, sf_dir, "syncs").select("execution_id", path("stdout").alias("stdout_path"), F.when(F.col("exit_code") != 0, path("stderr")).alias("stderr_path"))


PATHS_SQL = """
paths AS (SELECT execution_id, '/logs/' || asset || '/' || execution_id || '.stdout' AS stdout_path, CASE WHEN exit_code <> 0 THEN '/logs/' || asset || '/' || execution_id || '.stderr' END AS stderr_path FROM syncs)"""


@query(f"""WITH {SOURCE_SQL}, {PATHS_SQL}, p AS (SELECT max(execution_id) // 2 AS wm FROM paths)
SELECT 'evaluations' AS name, count(*) AS rows, CAST(0 AS BIGINT) AS with_paths FROM source, marks WHERE row_id > wm
UNION ALL SELECT 'syncs', count(*), count(coalesce(stdout_path, stderr_path)) FROM paths, p WHERE execution_id > wm""")
def unexported_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, watermark, _ = _source(spark, sf_dir)
    paths = _paths(spark, sf_dir)
    half = (paths.agg(F.max("execution_id")).head()[0] or 0) // 2
    a = X.unexported(rows, "row_id", watermark).select(F.lit("evaluations").alias("name"), "*")
    return a.unionByName(X.unexported(paths, "execution_id", half, ["stdout_path", "stderr_path"]).select(F.lit("syncs").alias("name"), "*"))


@query(f"WITH {SOURCE_SQL}, x AS (SELECT s.* FROM source s, marks WHERE row_id > wm) SELECT row_id, condition_name, asset, result, (SELECT max(row_id) FROM x) AS watermark FROM x")
def extract_after_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, watermark, _ = _source(spark, sf_dir)
    found, new = X.extract(rows, "row_id", watermark)
    return found.crossJoin(F.broadcast(new)).select("row_id", "condition_name", "asset", "result", "watermark")


@query(f"WITH {SOURCE_SQL} SELECT evaluation_id, condition_name, result FROM source, marks WHERE row_id <= upto UNION ALL SELECT evaluation_id, condition_name, result FROM source, marks WHERE row_id > upto")
def merge_insert_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged rows from the watermark on, each twice, into a target that has 60 % of all ids: written and read."""
    rows, watermark, upto = _source(spark, sf_dir)
    target = X.BucketedTarget(spark, scratch_dir(spark), ["evaluation_id", "condition_name"], int(spark.conf.get("spark.sql.shuffle.partitions")))
    target.append(rows.where(F.col("row_id") <= upto))
    staging = X.extract(rows, "row_id", watermark)[0]
    target.merge(staging.unionByName(staging.withColumns({"result": F.lit("changed"), "row_id": F.col("row_id") + 1_000_000_000})), "row_id")
    return target.forget().select("evaluation_id", "condition_name", "result")


@query(f"""WITH {PATHS_SQL}
SELECT execution_id, CASE WHEN execution_id % 2 = 0 THEN 's3:/' || stdout_path ELSE stdout_path END AS stdout_path, CASE WHEN execution_id % 2 = 0 THEN 's3:/' || stderr_path ELSE stderr_path END AS stderr_path FROM paths""")
def rewrite_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paths(spark, sf_dir)
    even = rows.where("execution_id % 2 = 0").select(F.explode(F.array("stdout_path", "stderr_path")).alias("local")).where("local is not null")
    mapping = even.select("local", F.concat(F.lit("s3:/"), "local").alias("remote"))
    return X.rewrite_paths(rows, mapping, ["stdout_path", "stderr_path"])


@query(f"""WITH {PATHS_SQL}, p AS (SELECT max(execution_id) // 2 AS wm FROM paths)
SELECT stdout_path AS path FROM paths, p WHERE execution_id > wm UNION SELECT stderr_path FROM paths, p WHERE execution_id > wm AND stderr_path IS NOT NULL""")
def files_to_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paths(spark, sf_dir)
    half = (rows.agg(F.max("execution_id")).head()[0] or 0) // 2
    return X.upload_list(rows, "execution_id", half, ["stdout_path", "stderr_path"])


@query("SELECT 'eval_log' AS \"table\", count(*) AS rows FROM eval_log UNION ALL SELECT 'missing', -1 UNION ALL SELECT 'sync_run', count(*) FROM sync_run")
def export_all_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logs written out, and one export that fails between them."""

    def export(name: str) -> int:
        path = scratch_dir(spark)
        table(spark, sf_dir, name).write.parquet(path)
        return spark.read.parquet(path).count()

    def fail() -> int:
        return spark.read.parquet(scratch_dir(spark)).count()

    return X.export_all(spark, {"eval_log": lambda: export("eval_log"), "missing": fail, "sync_run": lambda: export("sync_run")})


@query("""
SELECT c_custkey, c_name, coalesce(n, 0) AS order_count, round(coalesce(total, 0.0), 2) AS order_total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) o ON c_custkey = o_custkey""")
def mart_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mart_customers(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"))


@query("SELECT o_orderstatus AS status, count(*) AS order_count, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS average FROM orders GROUP BY 1")
def mart_order_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mart_order_summary(table(spark, sf_dir, "orders"))


@query("SELECT p_type AS category, count(*) AS products, round(avg(p_retailprice), 4) AS average_price FROM part GROUP BY 1")
def mart_product_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mart_product_summary(table(spark, sf_dir, "part"))


@query("SELECT o_orderkey, o_custkey, c_name || ' ' || c_mktsegment AS customer, o_orderstatus AS status, o_totalprice AS amount FROM orders JOIN customer ON o_custkey = c_custkey")
def orders_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.orders_enriched(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))


@query("SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status, o_totalprice AS amount FROM orders")
def staging_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.staging_projection(table(spark, sf_dir, "orders"))
