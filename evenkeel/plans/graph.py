"""Queries of the lineage graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators import graph as G
from evenkeel.operators.history import latest
from evenkeel.operators.history import transitions as ready_transitions
from evenkeel.plans.fixtures import table
from evenkeel.plans.registry import query
from evenkeel.session import materialize


def _roots(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")


@query("SELECT src, dst FROM lineage_edges")
def build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as upstream lists of assets, taken apart again."""
    lists = table(spark, sf_dir, "lineage_edges").groupBy(F.col("dst").alias("asset")).agg(F.collect_list("src").alias("upstreams"))
    return G.build_edges(lists)


@query("""
WITH d AS (SELECT src AS node, string_agg(dst, ',' ORDER BY dst) AS downstreams FROM lineage_edges GROUP BY src),
  u AS (SELECT dst AS node, string_agg(src, ',' ORDER BY src) AS upstreams FROM lineage_edges GROUP BY dst)
SELECT coalesce(d.node, u.node) AS node, coalesce(upstreams, '') AS upstreams, coalesce(downstreams, '') AS downstreams FROM d FULL JOIN u ON d.node = u.node""")
def adjacency_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.adjacency(table(spark, sf_dir, "lineage_edges"))
    return found.select("node", F.array_join("upstreams", ",").alias("upstreams"), F.array_join("downstreams", ",").alias("downstreams"))


@query("""
WITH n AS (SELECT dst AS node, 'up' AS side, src AS neighbour FROM lineage_edges UNION ALL SELECT src, 'down', dst FROM lineage_edges),
  c AS (SELECT *, (count(*) OVER (PARTITION BY node, side) + 19) // 20 AS chunks FROM n)
SELECT node, side, CAST(CAST('0x' || substr(md5(neighbour), 1, 8) AS BIGINT) % chunks AS BIGINT) AS chunk, string_agg(neighbour, ',' ORDER BY neighbour) AS neighbours FROM c GROUP BY 1, 2, 3""")
def adjacency_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists in chunks of about 20, so that nations and suppliers are many rows."""
    return G.adjacency_chunks(table(spark, sf_dir, "lineage_edges"), 20).withColumn("neighbours", F.array_join("neighbours", ","))


def _closure_sql(roots: str, a: str, b: str, depth: int | None = None) -> str:
    limit = f" WHERE level < {depth}" if depth is not None else ""
    return f"""
WITH RECURSIVE r(node, level) AS (SELECT node, 0 FROM (VALUES {roots}) AS v(node) UNION SELECT e.{b}, r.level + 1 FROM r JOIN lineage_edges e ON e.{a} = r.node{limit})
SELECT node, CAST(min(level) AS BIGINT) AS level FROM r GROUP BY node"""


@query(_closure_sql("('o1'), ('o2'), ('o7')", "dst", "src"))
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.closure(table(spark, sf_dir, "lineage_edges"), _roots(spark, "o1", "o2", "o7"), "up")


@query(_closure_sql("('n3'), ('s1')", "src", "dst"))
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.closure(table(spark, sf_dir, "lineage_edges"), _roots(spark, "n3", "s1"), "down")


@query(
    """
WITH RECURSIVE u(node, level) AS (SELECT node, 0 FROM (VALUES ('c1'), ('s2')) AS v(node) UNION SELECT e.src, u.level + 1 FROM u JOIN lineage_edges e ON e.dst = u.node WHERE level < 2),
  d(node, level) AS (SELECT node, 0 FROM (VALUES ('c1'), ('s2')) AS v(node) UNION SELECT e.dst, d.level + 1 FROM d JOIN lineage_edges e ON e.src = d.node WHERE level < 1)
SELECT node FROM u UNION SELECT node FROM d"""
)
def neighborhood_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighborhood(table(spark, sf_dir, "lineage_edges"), _roots(spark, "c1", "s2"), 2, 1)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as nodes with their segment and nation as labels."""
    labels = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")), F.lit(""))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), labels.alias("labels"))


@query("SELECT 'c' || c_custkey AS node FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT 'c' || c_custkey FROM customer WHERE c_nationkey = 7")
def select_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _labelled(spark, sf_dir)
    return G.select_label(nodes, "segment", "BUILDING").union(G.select_label(nodes, "nation7")).distinct()


@query("""
WITH RECURSIVE up(node) AS (SELECT 'o1' UNION SELECT e.src FROM up JOIN lineage_edges e ON e.dst = up.node),
  picked AS (SELECT 'c' || c_custkey AS node FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_nationkey = 7) OR c_nationkey = 3),
  around AS (SELECT node FROM picked UNION SELECT dst FROM lineage_edges WHERE src IN (SELECT node FROM picked)),
  chosen AS (SELECT node FROM around UNION SELECT node FROM up UNION SELECT 'n5' UNION SELECT dst FROM lineage_edges WHERE src = 'n5')
SELECT node FROM chosen WHERE node NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') AND node <> 'n5'""")
def select_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selector strings over the whole lineage; customers have labels."""
    others = table(spark, sf_dir, "lineage_nodes").where("node not like 'c%'").withColumn("labels", F.create_map().cast("map<string,string>"))
    nodes = _labelled(spark, sf_dir).unionByName(others)
    include = ["label:segment=BUILDING,label:nation7+1", "label:nation3+1", "+o1", "n5+1"]
    return G.select(nodes, table(spark, sf_dir, "lineage_edges"), include, ["label:segment=MACHINERY", "n5"])


COMPONENTS_SQL = """
sym AS (SELECT src AS a, dst AS b FROM part_edges UNION SELECT dst, src FROM part_edges),
label(node, component) USING KEY (node) AS (
  SELECT DISTINCT a, a FROM sym
  UNION SELECT e.b, min(l.component) FROM label l JOIN sym e ON e.a = l.node JOIN recurring.label r ON r.node = e.b WHERE l.component < r.component GROUP BY e.b)"""


def _ordered_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All orders and the parts, by month, they consist of. The edges are written out, as they are read several times."""
    edges = materialize(table(spark, sf_dir, "part_edges"))
    orders = edges.select(F.col("src").alias("node"), F.lit("Asset").alias("kind"))
    parts = edges.select(F.col("dst").alias("node"), F.lit("Connection").alias("kind"))
    return orders.unionByName(parts).distinct(), edges


@query(f"WITH RECURSIVE {COMPONENTS_SQL} SELECT node, component FROM label WHERE node LIKE 'o%'")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(*_ordered_parts(spark, sf_dir))


@query(f"""WITH RECURSIVE {COMPONENTS_SQL},
a AS (SELECT component, count(*) AS assets FROM label WHERE node LIKE 'o%' GROUP BY component),
e AS (SELECT component, count(*) AS edges FROM part_edges JOIN label ON src = node GROUP BY component)
SELECT a.component, assets, coalesce(edges, 0) AS edges, (SELECT count(*) FROM a) > 100 AS too_many FROM a LEFT JOIN e ON a.component = e.component""")
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _ordered_parts(spark, sf_dir)
    return G.component_sizes(materialize(G.components(nodes, edges)), edges, 100)


@query("""
WITH RECURSIVE reach(a, b) AS (SELECT src, dst FROM cyclic_edges UNION SELECT r.a, e.dst FROM reach r JOIN cyclic_edges e ON r.b = e.src), cyc AS (SELECT a AS node FROM reach WHERE a = b)
SELECT node FROM cyc UNION SELECT b FROM reach WHERE a IN (SELECT node FROM cyc)""")
def cycle_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cycle_residue(table(spark, sf_dir, "cyclic_edges"))


@query("""
WITH RECURSIVE w(node, wave) AS (SELECT node, 0 FROM lineage_nodes UNION SELECT e.dst, w.wave + 1 FROM w JOIN lineage_edges e ON e.src = w.node)
SELECT node, CAST(max(wave) AS BIGINT) AS wave FROM w GROUP BY node""")
def convergence_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineage's nodes are those that its edges name."""
    return G.waves(None, table(spark, sf_dir, "lineage_edges"))


def _gated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All nodes, the edges from customers to orders, and the customers' last readiness."""
    nodes = table(spark, sf_dir, "lineage_nodes").withColumnRenamed("node", "asset")
    last = latest(table(spark, sf_dir, "evals"), "asset", ["ts", "evaluation_id"], ["ready"])
    return nodes, table(spark, sf_dir, "order_gate_edges"), last.select(F.concat(F.lit("c"), F.col("asset").cast("string")).alias("asset"), "ready")


GATE_SQL = """
gated AS (SELECT n.node AS asset, coalesce(min(CASE WHEN e.src IS NULL THEN NULL WHEN r.ready THEN 1 ELSE 0 END), 1) = 1 AS open
  FROM lineage_nodes n LEFT JOIN order_gate_edges e ON n.node = e.dst LEFT JOIN readiness r ON e.src = r.asset GROUP BY n.node)"""


@query(f"WITH {GATE_SQL} SELECT asset, open FROM gated")
def upstream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.gate(*_gated(spark, sf_dir))


@query(f"WITH {GATE_SQL} SELECT asset FROM gated WHERE open AND asset NOT IN (SELECT asset FROM readiness WHERE ready)")
def initial_evaluation_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.initial_set(*_gated(spark, sf_dir))


@query("""
WITH t AS (SELECT asset, ready, lag(ready, 1, false) OVER (PARTITION BY asset ORDER BY ts, evaluation_id) AS prev FROM evals), b AS (SELECT DISTINCT concat('c', CAST(asset AS VARCHAR(20))) AS cause FROM t WHERE ready AND NOT prev)
SELECT DISTINCT e.dst AS asset, b.cause FROM b JOIN lineage_edges e ON e.src = b.cause""")
def propagate_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    became = ready_transitions(table(spark, sf_dir, "evals")).select(F.concat(F.lit("c"), F.col("asset").cast("string")).alias("asset"))
    return G.propagate(became, table(spark, sf_dir, "lineage_edges"))
