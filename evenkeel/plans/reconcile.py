"""Reconciliation from end to end: evaluate, pick what drifted and may run, rebuild wave by wave, evaluate again."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators import conditions as C
from evenkeel.operators import graph as G
from evenkeel.operators.conditions import READY, Condition
from evenkeel.plans.fixtures import table
from evenkeel.plans.registry import query
from evenkeel.session import scratch_dir, side_by_side

Builder = Callable[[dict[str, DataFrame]], DataFrame]


def judge(tables: dict[str, DataFrame], rules: dict[str, Sequence[Condition]]) -> dict[str, tuple[bool, int]]:
    """Whether each table's conditions are all Ready, and its rows, from one query over all of them."""
    ruled = {a: rules[a] for a in tables if rules.get(a)}
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(a).alias("asset"), F.lit(True).alias("ready"), "n") for a, df in sorted(tables.items())]
    if ruled:
        states = C.evaluate_assets(ruled, tables)
        counts.append(states.groupBy("asset").agg(F.bool_and(F.col("state") == READY).alias("ready")).select("asset", "ready", F.lit(0).cast("long").alias("n")))
    found = reduce(DataFrame.unionByName, counts).groupBy("asset").agg(F.bool_and("ready").alias("ready"), F.sum("n").alias("n"))
    return {r["asset"]: (r["ready"], r["n"]) for r in found.collect()}


def reconcile(spark: SparkSession, tables: dict[str, DataFrame], rules: dict[str, Sequence[Condition]], upstreams: dict[str, Sequence[str]], builders: dict[str, Builder], most: int = 8) -> DataFrame:
    """(asset, wave, before, rebuilt, after, rows_before, rows_after) for each asset.

    Assets go in waves, upstreams first. A wave's assets are evaluated by one query; a drifted one with a
    builder is rebuilt if all its upstreams are Ready by then, up to ``most`` side by side; what was rebuilt
    is evaluated again by one query. States and counts of the assets, not rows, come to the driver.
    """
    nodes = spark.createDataFrame([(a,) for a in tables], "node string")
    pairs = [(u, a) for a, us in upstreams.items() for u in us]
    wave_of = {r["node"]: r["wave"] for r in G.waves(nodes, spark.createDataFrame(pairs, "src string, dst string")).collect()}
    tables, state, out = dict(tables), {}, []

    def rebuild(asset: str) -> DataFrame:
        path = scratch_dir(spark)
        builders[asset](tables).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    for wave in sorted({wave_of[a] for a in tables}):
        assets = sorted(a for a in tables if wave_of[a] == wave)
        before = judge({a: tables[a] for a in assets}, rules)
        drifted = [a for a in assets if not before[a][0] and a in builders and all(state[u] for u in upstreams.get(a, ()))]
        rebuilt = dict(zip(drifted, side_by_side(spark, [partial(rebuild, a) for a in drifted], most), strict=True))
        tables |= rebuilt
        after = before | (judge(rebuilt, rules) if rebuilt else {})
        state |= {a: after[a][0] for a in assets}
        out += [(a, wave, before[a][0], a in rebuilt, after[a][0], before[a][1], after[a][1]) for a in assets]
    return spark.createDataFrame(out, "asset string, wave long, before boolean, rebuilt boolean, after boolean, rows_before long, rows_after long")


@query("""
WITH c AS (SELECT count(*) AS n FROM customer), o AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphans FROM orders),
  stale AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'), good AS (SELECT count(DISTINCT o_custkey) AS n FROM orders), bad AS (SELECT count(*) AS n FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) x),
  l AS (SELECT count(*) AS n FROM lineitem)
SELECT 'customer' AS asset, CAST(0 AS BIGINT) AS wave, n > 0 AS before, false AS rebuilt, n > 0 AS after, n AS rows_before, n AS rows_after FROM c
UNION ALL SELECT 'lineitem', 0, bad.n = 0, false, bad.n = 0, l.n, l.n FROM bad, l
UNION ALL SELECT 'orders', 1, orphans = 0, false, orphans = 0, n, n FROM o
UNION ALL SELECT 'customer_totals', 2, false, true, true, stale.n, good.n FROM stale, good
UNION ALL SELECT 'line_totals', 1, false, bad.n = 0, bad.n = 0, stale.n, CASE WHEN bad.n = 0 THEN (SELECT count(DISTINCT l_orderkey) FROM lineitem) ELSE stale.n END FROM stale, bad""")
def reconcile_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of customers are rebuilt from orders; totals of lines wait, as lines have repeated keys."""
    tables = {n: table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem")}
    old = tables["orders"].where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"), F.lit(None).cast("double").alias("total"))
    tables |= {"customer_totals": old, "line_totals": old}
    rules = {
        "customer": [C.row_count(">", 0)],
        "orders": [C.relationships("o_custkey", tables["customer"], "c_custkey")],
        "lineitem": [C.unique("l_orderkey", "l_linenumber")],
        "customer_totals": [C.not_null("total"), C.unique("key")],
        "line_totals": [C.not_null("total"), C.unique("key")],
    }
    upstreams = {"orders": ["customer"], "customer_totals": ["orders"], "line_totals": ["lineitem"]}
    builders: dict[str, Builder] = {
        "customer_totals": lambda t: t["orders"].groupBy(F.col("o_custkey").alias("key")).agg(F.sum("o_totalprice").alias("total")),
        "line_totals": lambda t: t["lineitem"].groupBy(F.col("l_orderkey").alias("key")).agg(F.sum("l_extendedprice").alias("total")),
    }
    return reconcile(spark, tables, rules, upstreams, builders)
