"""Connected components of an edge table: spanning forests inside tasks, contraction, and star rounds.

1. Each task turns the edges that it reads into a forest of stars, by hooking and pointer jumping over all
   of them at once: each node is hung onto the least node that it reaches there. So of n nodes a task has
   at most n - 1 edges go on, and a hub is in each task's forest once.
2. A node with several such labels connects them to the least. Only these edges between labels go on, to
   be turned into forests and contracted likewise, as long as that at least halves them.
3. Where it doesn't, alternating large-star and small-star rounds do the rest: each hangs neighbours onto
   the least node they can see, and costs two grouped minima and two joins; their number grows with the
   logarithm of a component's size. A round's rows say whether they have moved, so that the end is known
   from one column of what it wrote.

All steps end in the shared scratch folder: neither lineage nor a lost executor costs more than a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.session import discard, materialize, ship_package

#: Edges that a task takes up at once, and nodes of a forest above which it is given out.
EDGES, NODES = 500_000, 1_000_000


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node reachable of each of the nodes 0 to n-1 along edges (a, b)."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (jumped := label[label]) is not None and (jumped != label).any():
            label = jumped
    return label


def _stars(a: pa.Array, b: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Edges (node, least node of its component) that connect what (a, b) connect."""
    coded = pa.concat_arrays([a, b]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    code = rank[coded.indices.to_numpy()]
    label = least_labels(code[: len(a)], code[len(a) :], len(order))
    leaf = np.flatnonzero(label != np.arange(len(label)))
    names = coded.dictionary.take(order)
    return names.take(pa.array(leaf)), names.take(pa.array(label[leaf]))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[pa.Array, pa.Array]] = []
    kept = fresh = 0
    out = lambda a, b: pa.RecordBatch.from_arrays([a, b], ["a", "b"])
    join = lambda k: pa.concat_arrays([x[k] for x in held])
    for batch in batches:
        held.append((batch.column(0), batch.column(1)))
        fresh += len(batch)
        if fresh >= EDGES:
            held, fresh = [_stars(join(0), join(1))], 0
            kept = len(held[0][0])
            if kept >= NODES:
                yield out(*held[0])
                held = []
    if held:
        yield out(*_stars(join(0), join(1)))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b"), (F.col("m") < F.col("a")).alias("moved"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"), (F.max("moved") | (F.min("b") < F.max("b"))).alias("moved"))
    hung = edges.select("a", "b").join(least.select(F.col("a").alias("c"), "m"), F.col("a") == F.col("c")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"), F.lit(True).alias("moved"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"), "moved")).groupBy("a", "b").agg(F.max("moved").alias("moved"))


def spanning_forest(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b): edges with the components of ``edges``, at most one less than the nodes of each task; ends are not null."""
    ship_package(edges.sparkSession)
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("a"), F.col(b).alias("b"))
    kind = dict(pairs.dtypes)["a"]
    return pairs.select("a", F.col("b").cast(kind).alias("b")).mapInArrow(_forest, f"a {kind}, b {kind}")


def _star_rounds(star: DataFrame) -> DataFrame:
    """(node, component) of a table of edges (a, b) with a > b that ``materialize`` wrote."""
    while True:
        star, old = materialize(_small_star(_large_star(star))), star
        discard(old)
        if not star.agg(F.max("moved")).head()[0]:
            return star.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _labels(star: DataFrame) -> DataFrame:
    """(node, component) of a forest (a, b) that ``materialize`` wrote."""
    pairs = star.unionByName(star.select(F.col("b").alias("a"), "b"))
    least = materialize(pairs.groupBy("a").agg(F.min("b").alias("m")))
    between = materialize(spanning_forest(pairs.join(least, "a"), "b", "m"))
    left, before = between.count(), star.count()
    discard(star)
    if not left:
        return least.select(F.col("a").alias("node"), F.col("m").alias("component"))
    top = (_labels if 2 * left <= before else _star_rounds)(between)
    found = least.join(top.withColumnRenamed("node", "m"), "m", "left")
    return found.select(F.col("a").alias("node"), F.coalesce("component", "m").alias("component"))


def component_labels(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node reachable, for each node that an edge to another node touches.

    Edges with a null end count as absent.
    """
    return _labels(materialize(spanning_forest(edges, a, b)))
