"""Queries of rule and metadata tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.text import tags_to_labels as labels_of
from evenkeel.operators import rules as R
from evenkeel.plans.fixtures import table
from evenkeel.plans.registry import query


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets of asset_rule with two entries: their own, and one that is shared by all."""
    own = F.struct("conditions", "sync")
    shared = F.struct(F.lit("g0").alias("conditions"), F.lit("s0").alias("sync"))
    return table(spark, sf_dir, "asset_rule").select("asset", "connection", F.array(own, shared).alias("entries"))


def _syncs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syncs s0 to s4 with a map of arguments."""
    names = table(spark, sf_dir, "asset_rule").select("sync").distinct()
    return names.select("sync", F.create_map(F.lit("key"), F.concat(F.lit("run "), "sync")).alias("args"))


BOUND_SQL = """
entry AS (SELECT asset, 0 AS position, conditions, sync FROM asset_rule UNION ALL SELECT asset, 1, 'g0', 's0' FROM asset_rule),
bound AS (SELECT e.asset, e.position, e.conditions, e.sync, c.text, c.interval_s FROM entry e JOIN condition_catalog c ON e.conditions = c.conditions)"""


def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bind_rules(_assets(spark, sf_dir), table(spark, sf_dir, "condition_catalog"), _syncs(spark, sf_dir))


@query(f"WITH {BOUND_SQL} SELECT asset, position, conditions, sync, text FROM bound")
def bind_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir).select("asset", "position", "conditions", "sync", "text")


@query(f"WITH {BOUND_SQL} SELECT asset, position, replace(replace(text, '{{{{ asset.name }}}}', asset), '{{{{ sync.key }}}}', 'run ' || sync) AS text FROM bound")
def expand_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.expand_rules(_bound(spark, sf_dir), "text", values="args").select("asset", "position", "text")


@query(f"WITH {BOUND_SQL} SELECT asset, position, conditions, text FROM bound")
def dry_run_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.plan_rules(_bound(spark, sf_dir))


@query("""
SELECT asset, 'Conditions' AS kind, conditions AS name FROM asset_rule WHERE conditions NOT IN (SELECT conditions FROM condition_catalog)
UNION ALL SELECT asset, 'Sync', sync FROM asset_rule WHERE sync NOT IN ('s0', 's1', 's2', 's3')""")
def unresolved_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown condition groups, and syncs that a catalogue without s4 doesn't have."""
    rules, syncs = table(spark, sf_dir, "asset_rule"), _syncs(spark, sf_dir).where("sync <> 's4'")
    row = lambda df, kind, c: df.select("asset", F.lit(kind).alias("kind"), F.col(c).alias("name"))
    groups = R.unresolved(rules, "conditions", table(spark, sf_dir, "condition_catalog"), "conditions")
    return row(groups, "Conditions", "conditions").unionByName(row(R.unresolved(rules, "sync", syncs, "sync"), "Sync", "sync"))


@query("SELECT p_name AS name, p_brand AS kind, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.duplicates(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("kind")), ["name", "kind"])


@query("""
WITH every AS (
  SELECT o_custkey AS asset, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS r, o_orderkey AS position FROM orders)
SELECT asset, position AS entry, row_number() OVER (PARTITION BY asset ORDER BY r, position) - 1 AS merged FROM every""")
def overlay_merge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries of their customer: open ones before, finished ones generated, others after."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("asset"), F.col("o_orderkey").alias("position"), F.col("o_orderkey").alias("entry"), "o_orderstatus")
    part = lambda p: rows.where(p).drop("o_orderstatus")
    merged = R.merge_entries(part("o_orderstatus = 'O'"), part("o_orderstatus = 'F'"), part("o_orderstatus not in ('O', 'F')"))
    return merged.select("asset", "entry", F.col("merged").cast("long").alias("merged"))


LINKS_SQL = """
SELECT s.source_id, m.model_id FROM relation_source s JOIN relation_model m
  ON lower(s.db) = lower(m.db) AND lower(s.sch) = lower(m.sch) AND lower(s.ident) = lower(m.ident) AND s.origin <> m.origin"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.link_relations(table(spark, sf_dir, "relation_source"), table(spark, sf_dir, "relation_model"))


@query(LINKS_SQL)
def link_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir)


@query(f"""
WITH links AS ({LINKS_SQL}), edges AS (SELECT DISTINCT l_partkey AS upstream, l_orderkey AS asset FROM lineitem UNION ALL SELECT p_partkey + 1000000, p_partkey FROM part)
SELECT coalesce(l.model_id, e.upstream) AS upstream, e.asset FROM edges e LEFT JOIN links l ON e.upstream = l.source_id
WHERE e.asset NOT IN (SELECT source_id FROM links)""")
def rewire_upstreams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders upon parts and parts upon their origin, with the linked source parts replaced."""
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1_000_000).alias("upstream"), F.col("p_partkey").alias("asset"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("upstream"), F.col("l_orderkey").alias("asset")).distinct().unionByName(parts)
    links = _links(spark, sf_dir).select(F.col("source_id").alias("source"), F.col("model_id").alias("model"))
    return R.rewire_upstreams(edges, links)[0]


@query("""
WITH every AS (SELECT lower(db) AS db, lower(sch) AS sch, lower(ident) AS ident, origin FROM relation_source UNION ALL SELECT db, sch, ident, origin FROM relation_model)
SELECT db, sch, ident, count(*) AS n, array_to_string(list_sort(list(DISTINCT origin)), ',') AS origins FROM every GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def duplicate_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "relation_source").drop("source_id").unionByName(table(spark, sf_dir, "relation_model").drop("model_id"))
    return R.duplicate_outputs(every).withColumn("origins", F.array_join("origins", ","))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tests that depend on their parts; parts as models, the odd ones as sources."""
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("depends_on"))
    tests = orders.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("id"), F.lit("test").alias("kind"), "depends_on")
    kind = F.when(F.col("p_partkey") % 2 == 1, "source").when(F.col("p_size") > 25, "model").otherwise("macro")
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), kind.alias("kind"), F.array().cast("array<string>").alias("depends_on"))
    return tests.unionByName(parts)


@query("""
SELECT 'p' || l_partkey AS node, string_agg('o' || l_orderkey, ',' ORDER BY 'o' || l_orderkey) AS tests
FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l JOIN part ON p_partkey = l_partkey
WHERE p_partkey % 2 = 1 OR p_size > 25 GROUP BY l_partkey""")
def tests_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tests_by_model(_nodes(spark, sf_dir)).withColumn("tests", F.array_join("tests", ","))


@query("""
WITH d AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS dep FROM lineitem)
SELECT d.id, CASE WHEN p_partkey % 2 = 1 THEN 'source ' || p_name ELSE 'model ' || p_name END AS upstream FROM d JOIN part ON p_partkey = dep WHERE p_partkey % 2 = 1 OR p_size > 25""")
def resolve_upstreams(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("dep")).distinct()
    parts = table(spark, sf_dir, "part")
    named = lambda kind: F.concat(F.lit(f"{kind} "), "p_name").alias("name")
    sources = parts.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("id"), named("source"))
    models = parts.where("p_size > 25").select(F.col("p_partkey").alias("id"), named("model"))
    return R.resolve_upstreams(deps, sources, models)


@query("""
SELECT p_partkey, 'dbt/' || lower(p_brand) || '=,dbt/' || lower(p_type) || '=' AS labels FROM part WHERE lower(p_brand) < lower(p_type)
UNION ALL SELECT p_partkey, 'dbt/' || lower(p_type) || '=,dbt/' || lower(p_brand) || '=' FROM part WHERE lower(p_brand) > lower(p_type)""")
def tags_to_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand and type of a part as tags, the brand twice."""
    tags = F.array(F.lower("p_brand"), F.lower("p_type"), F.lower("p_brand"))
    entries = F.array_sort(F.map_entries(labels_of(tags)))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("labels"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each part that selects its name; every 7th by tag, every 11th without a selection, every 5th selects more."""
    name, key = F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey")
    command = F.when(key % 7 == 0, "dbt run --select tag:x").when(key % 11 == 0, "dbt run").when(key % 2 == 0, F.concat(F.lit("dbt run -s "), name)).otherwise(F.concat(F.lit("dbt run --select +"), name, F.lit("+2")))
    more = F.concat(command, F.lit(" -s tag:y --select extra_"), (key % 3).cast("string"), F.lit("+ -s"))
    command = F.when((key % 5 == 0) & (key % 7 != 0) & (key % 11 != 0), more).otherwise(command)
    return table(spark, sf_dir, "part").select(key.alias("job_id"), F.array(F.lit("dbt deps"), command).alias("commands"))


MAPPING_SQL = """
SELECT replace(p_name, ' ', '_') AS model, p_partkey AS job_id FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0
UNION SELECT concat('extra_', CAST(p_partkey % 3 AS VARCHAR)), p_partkey FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0"""


@query(f"SELECT model, string_agg(CAST(job_id AS VARCHAR), ',' ORDER BY job_id) AS job_ids FROM ({MAPPING_SQL}) t GROUP BY model")
def model_job_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.job_mapping(_jobs(spark, sf_dir)).withColumn("job_ids", F.array_join("job_ids", ","))


@query(f"SELECT model, l_orderkey AS run_id, job_id FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'O') l JOIN ({MAPPING_SQL}) m ON l_partkey = job_id")
def running_job_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open order lines as running jobs of their part."""
    status = F.when(F.col("l_linestatus") == "O", "running").otherwise("done").alias("status")
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("job_id"), status).distinct()
    return R.running_conflicts(runs, R.job_mapping(_jobs(spark, sf_dir)))


WARN_SQL = """
facts AS (SELECT c_custkey AS asset, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_entries, c_custkey % 3 AS n_upstreams, CASE WHEN c_nationkey < 20 THEN c_nationkey * 60 END AS min_interval FROM customer)"""


@query(f"""WITH {WARN_SQL}
SELECT asset, CASE WHEN n_entries = 0 THEN 'NoOnDrift' WHEN n_upstreams = 0 AND min_interval IS NULL THEN 'NoEvalTriggers' END AS warning FROM facts""")
def readiness_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "customer").join(entries, F.col("c_custkey") == F.col("o_custkey"), "left")
    interval = F.when(F.col("c_nationkey") < 20, F.col("c_nationkey") * 60)
    return R.rule_warnings(c.select(F.col("c_custkey").alias("asset"), F.coalesce("n", F.lit(0)).alias("n_entries"), (F.col("c_custkey") % 3).alias("n_upstreams"), interval.alias("min_interval")))


@query("SELECT r.asset, min(c.interval_s) AS min_interval FROM asset_rule r LEFT JOIN condition_catalog c ON r.conditions = c.conditions GROUP BY r.asset")
def min_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = table(spark, sf_dir, "asset_rule")
    return R.min_interval(assets.join(table(spark, sf_dir, "condition_catalog"), "conditions"), assets)


@query("""
WITH names AS (SELECT n_name, concat('g', CAST(n_nationkey AS VARCHAR)) AS conditions, concat('check ', n_name) AS condition_name FROM nation UNION ALL SELECT n_name, concat('g', CAST(n_nationkey AS VARCHAR)), 'fresh' FROM nation),
  listed AS (SELECT conditions, string_agg(condition_name, ',' ORDER BY condition_name) AS condition_names FROM names GROUP BY conditions)
SELECT 'connection' AS kind, connection AS name, count(DISTINCT asset) AS n_assets, NULL AS detail FROM asset_rule GROUP BY 2
UNION ALL SELECT 'sync', sync, count(DISTINCT asset), NULL FROM (SELECT asset, sync FROM asset_rule UNION ALL SELECT asset, 's0' FROM asset_rule) t GROUP BY 2
UNION ALL SELECT 'conditions', t.conditions, count(DISTINCT asset), max(condition_names) FROM (SELECT asset, conditions FROM asset_rule UNION ALL SELECT asset, 'g0' FROM asset_rule) t JOIN listed l ON t.conditions = l.conditions GROUP BY 2
UNION ALL SELECT 'asset', c_name, 1, concat('segment=', c_mktsegment, ' n', CAST(c_nationkey AS VARCHAR), ' ', CASE WHEN c_acctbal > 0 THEN 'auto' ELSE 'manual' END, ' g', CAST(c_nationkey AS VARCHAR), ':s', CAST(c_nationkey % 5 AS VARCHAR), ',g0:s0') FROM customer""")
def catalog_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds with their details as text: names of a condition group; labels, upstreams, sync mode and entries of an asset."""
    rows = _assets(spark, sf_dir).select("asset", "connection", F.posexplode("entries").alias("position", "entry")).select("asset", "connection", "position", "entry.*")
    group = F.concat(F.lit("g"), F.col("n_nationkey").cast("string"))
    names = table(spark, sf_dir, "nation").select(group.alias("conditions"), F.explode(F.array(F.concat(F.lit("check "), "n_name"), F.lit("fresh"))).alias("condition_name"))
    found = R.catalog(rows, names, ["Connection", "Sync", "Conditions"]).select("kind", "name", "n_assets", F.array_join("condition_names", ",").alias("detail"))
    nation = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    assets = table(spark, sf_dir, "customer").select(F.col("c_name").alias("asset"), F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("labels"), F.array(nation).alias("upstreams"), (F.col("c_acctbal") > 0).alias("auto_sync"))
    labels = F.array_join(F.transform(F.map_entries("labels"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    entries = F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["conditions"], e["sync"])), ",")
    detail = F.concat_ws(" ", labels, F.array_join("upstreams", ","), F.when(F.col("auto_sync"), "auto").otherwise("manual"), entries)
    summaries = R.asset_summaries(assets, rows).select(F.lit("asset").alias("kind"), F.col("asset").alias("name"), F.lit(1).cast("long").alias("n_assets"), detail.alias("detail"))
    return found.unionByName(summaries)
