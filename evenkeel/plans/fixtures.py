"""Input tables of the operators' queries, derived from the test tables by SQL that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

FIXTURES = {
    "eval_log": """
SELECT e.event_id AS evaluation_id, concat('c', CAST(k.i AS VARCHAR(4))) AS condition_name, e.user_id AS asset, e.ts AS started_at,
  CASE WHEN e.value < 25 * (k.i + 1) THEN 'Ready' ELSE 'Drifted' END AS result, substr(CAST(e.ts AS VARCHAR(32)), 1, 10) AS date
FROM events e CROSS JOIN (VALUES (0),(1),(2),(3)) AS k(i)
WHERE e.event_type IN ('view','click','signup')""",
    "sync_run": """
SELECT event_id AS execution_id, user_id AS asset, ts AS started_at, CAST(round(value * 60) AS BIGINT) AS duration_s,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS exit_code
FROM events WHERE event_type IN ('purchase','error')""",
    "sync_plan": """
SELECT r.event_id AS execution_id, s.stage, s.pos, r.user_id AS asset, r.ts AS started_at,
  CASE WHEN r.event_type = 'error' AND ((r.event_id % 2 = 0 AND s.stage = 'run') OR (r.event_id % 2 = 1 AND s.stage = 'pre')) THEN 1 ELSE 0 END AS exit_code
FROM events r CROSS JOIN (VALUES ('pre',0),('run',1),('post',2)) AS s(stage, pos)
WHERE r.event_type IN ('purchase','error')""",
    "lineage_edges": """
SELECT concat('n', CAST(c_nationkey AS VARCHAR(20))) AS src, concat('c', CAST(c_custkey AS VARCHAR(20))) AS dst FROM customer
UNION ALL SELECT concat('n', CAST(s_nationkey AS VARCHAR(20))), concat('s', CAST(s_suppkey AS VARCHAR(20))) FROM supplier
UNION ALL SELECT concat('c', CAST(o_custkey AS VARCHAR(20))), concat('o', CAST(o_orderkey AS VARCHAR(20))) FROM orders
UNION ALL SELECT DISTINCT concat('s', CAST(l_suppkey AS VARCHAR(20))), concat('o', CAST(l_orderkey AS VARCHAR(20))) FROM lineitem""",
    "lineage_nodes": """
SELECT DISTINCT node FROM (SELECT src AS node FROM lineage_edges UNION ALL SELECT dst FROM lineage_edges) t""",
    "part_edges": """
SELECT DISTINCT concat('o', CAST(l_orderkey AS VARCHAR(20))) AS src, concat('p', CAST(l_partkey AS VARCHAR(20)), 'm', substr(CAST(l_shipdate AS VARCHAR(32)), 1, 7)) AS dst FROM lineitem""",
    "cyclic_edges": """
SELECT DISTINCT concat('u', CAST(user_id AS VARCHAR(20)), 'd', period) AS src, concat('u', CAST(nxt AS VARCHAR(20)), 'd', period) AS dst
FROM (SELECT user_id, event_type, CAST(CAST(floor(CAST(substr(CAST(ts AS VARCHAR(32)), 9, 2) AS INT) / 3) AS INT) AS VARCHAR(4)) AS period,
  lead(user_id) OVER (PARTITION BY substr(CAST(ts AS VARCHAR(32)), 1, 13) ORDER BY ts, event_id) AS nxt FROM events) t
WHERE event_type = 'signup' AND nxt IS NOT NULL AND nxt <> user_id""",
    "relation_model": """
SELECT lower(p_brand) AS db, lower(p_type) AS sch, lower(p_name) AS ident, 'even' AS origin, min(p_partkey) AS model_id
FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2, 3""",
    "relation_source": """
SELECT upper(p_brand) AS db, p_type AS sch, upper(p_name) AS ident, CASE WHEN p_partkey % 4 = 1 THEN 'odd' ELSE 'even' END AS origin, p_partkey AS source_id
FROM part WHERE p_partkey % 2 = 1""",
    "asset_rule": """
SELECT c_name AS asset, c_mktsegment AS connection, concat('g', CAST(c_nationkey AS VARCHAR(4))) AS conditions, concat('s', CAST(c_nationkey % 5 AS VARCHAR(4))) AS sync
FROM customer""",
    "condition_catalog": """
SELECT concat('g', CAST(n_nationkey AS VARCHAR(4))) AS conditions, concat('check {{ asset.name }} against ', n_name, ' {{ sync.key }}') AS text, n_nationkey * 60 AS interval_s
FROM nation WHERE n_nationkey < 20""",
    "evals": """
SELECT evaluation_id, asset, started_at AS ts, CAST(sum(CASE WHEN result = 'Ready' THEN 1 ELSE 0 END) AS BIGINT) AS ready_count, min(CASE WHEN result = 'Ready' THEN 1 ELSE 0 END) = 1 AS ready
FROM eval_log GROUP BY evaluation_id, asset, started_at""",
    "syncs": "SELECT execution_id, asset, started_at AS ts, exit_code, duration_s FROM sync_run",
    "sync_log": """
SELECT p.* FROM sync_plan p WHERE NOT EXISTS (SELECT 1 FROM sync_plan q WHERE q.execution_id = p.execution_id AND q.pos < p.pos AND q.exit_code <> 0)""",
    "users": "SELECT DISTINCT user_id AS asset FROM events",
    "order_gate_edges": "SELECT src, dst FROM lineage_edges WHERE src LIKE 'c%'",
    "readiness": """
SELECT concat('c', CAST(asset AS VARCHAR(20))) AS asset, max_by(ready, ts) AS ready FROM evals GROUP BY asset""",
}


def needs(sql: str) -> list[str]:
    """Names of the tables and fixtures that a statement reads."""
    return [n for n in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql)) if n in FIXTURES or n in BASE]


#: Before the names of temporary views, so that a session's own views stay.
VIEW = "evenkeel_"


def viewed(sql: str) -> str:
    """``sql`` reading the views of tables and fixtures."""
    return re.sub(r"\b(FROM|JOIN)\s+(\w+)", lambda m: f"{m[1]} {VIEW}{m[2]}" if m[2] in FIXTURES or m[2] in BASE else m[0], sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or a fixture; it and what it is derived from are registered as temporary views."""
    if name in BASE:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    else:
        for n in needs(FIXTURES[name]):
            table(spark, sf_dir, n)
        df = spark.sql(viewed(FIXTURES[name]))
    df.createOrReplaceTempView(VIEW + name)
    return df


def with_fixtures(sql: str, recursive: bool = False) -> str:
    """``sql`` preceded by the fixtures it reads, as common table expressions."""
    found: list[str] = []

    def add(text: str) -> None:
        for n in needs(text):
            if n in FIXTURES and n not in found:
                add(FIXTURES[n])
                found.append(n)

    add(sql)
    ctes = ",\n".join(f"{n} AS ({FIXTURES[n]})" for n in found)
    body = sql.strip()
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    recursive = recursive or bool(own and own[1])
    if not ctes:
        return body
    rest = ",\n" + body[own.end() :] if own else "\n" + body
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{rest}"


def newest(spark: SparkSession, sf_dir: str, name: str = "events", column: str = "ts") -> Column:
    """The greatest time of a table, as the reference time of a query."""
    value = table(spark, sf_dir, name).agg(F.max(column).cast("string")).head()[0]
    return F.lit(value).cast("timestamp_ntz")
