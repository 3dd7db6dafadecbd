"""Exact top-k search by inner product, with distances bounded by segment means and deviations.

For vectors cut into segments of length L with means m and standard deviations s,
|q - x|^2 >= sum L * ((m_q - m_x)^2 + (s_q - s_x)^2), the closer the finer the segments. As
2 * q.x = |q|^2 + |x|^2 - |q - x|^2 and the sum of L * (m^2 + s^2) is |x|^2 at every resolution, the
distance bound says q.x <= f(q).f(x) with f the means and deviations, each times the root of L.

1. Candidates fall into groups of a bounded size by hash, queries too. Each query is searched in one
   group first; the k-th best score there is its threshold.
2. Every other tile (group of candidates, group of queries) is searched coarse to fine: 1, 4, 16, ...
   segments drop the pairs whose bound stays under the threshold, exact scores of the pairs left decide,
   and at most the k best of a tile come out.
3. The best k of all tiles, by score and then the smaller key, are the result.

The queries are a stated set that is held against all rows, in blocks: the work is their product. How
many pairs the bounds drop depends on the vectors (README); what is left is computed exactly.

Rows whose key is null, or whose vector is null or holds a null or non-finite component, take no part;
scaled components beyond 2^27 are cut to that. Vectors of another length than the query's aren't its
candidates; empty vectors have score 0 with each other. A row is never the candidate of a query with
the same key; of several vectors with one key the best score counts. An empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import prepared
from evenkeel.llm.vectors import kept, matrix, whole
from evenkeel.session import discard, materialize

#: Bytes of a group's vectors (as int) and most rows in it; queries that are scored in one go.
GROUP_BYTES, GROUP_ROWS, GO_ROWS = 8 << 20, 16_384, 256
NO_SCORE = -np.inf


def resolutions(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine: powers of four, of two components in a segment at least."""
    out, n = [], 1
    while 2 * n <= dim:
        out.append(n)
        n *= 4
    return out


def features(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments of each row, each times the root of the segment's length."""
    starts = np.arange(segments) * x.shape[1] // segments
    length = np.diff(np.append(starts, x.shape[1]))
    mean = np.add.reduceat(x, starts, axis=1) / length
    deviation = np.sqrt(np.add.reduceat(np.square(x - np.repeat(mean, length, axis=1)), starts, axis=1) / length)
    return np.hstack([mean, deviation]) * np.tile(np.sqrt(length), 2)


def best_in_tile(q_keys: np.ndarray, q: np.ndarray, least: np.ndarray, keys: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(places of queries, keys, scores) of each query's ``k`` best candidates of score ``least`` or more, and the number of exact scores.

    Candidates are in the order of their keys.
    """
    dim = x.shape[1]
    sure = dim * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) < 2**53  # else floats aren't exact
    fx, fq = x.astype(np.float64), q.astype(np.float64)
    slack = 1e-9 * np.linalg.norm(fx, axis=1) * np.linalg.norm(fq, axis=1).max(initial=0) + 1e-6
    coarse = [(features(fq, n), features(fx, n)) for n in resolutions(dim)]
    at, found, scores, exact = [], [], [], 0
    for a in range(0, len(q), GO_ROWS):
        go = slice(a, a + GO_ROWS)
        alive = q_keys[go, None] != keys[None, :]
        for f, g in coarse:
            columns = np.flatnonzero(alive.any(axis=0))
            alive[:, columns] &= f[go] @ g[columns].T + slack[columns] >= least[go, None]
        columns = np.flatnonzero(alive.any(axis=0))
        alive = alive[:, columns]
        exact += int(alive.sum())
        all_scores = fq[go] @ fx[columns].T if sure else q[go] @ x[columns].T
        alive &= all_scores >= least[go, None]
        for row, (some, score) in enumerate(zip(alive, all_scores, strict=True)):
            places = np.flatnonzero(some)
            order = places[np.argsort(-score[places], kind="stable")]  # equal scores stay in the order of keys
            names = keys[columns[order]]
            if len(order) > k:
                top = np.sort(np.unique(names, return_index=True)[1])[:k] if len(names) else order[:0]
                order, names = order[top], names[top]
            at += [a + row] * len(order)
            found.append(names)
            scores.append(score[order].astype(np.int64))
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return np.array(at, np.int64), join(found), join(scores), exact


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        is_query = table.column("least").is_valid()
        queries, others = table.filter(is_query), table.filter(pa.compute.invert(is_query)).sort_by("key")
        column = lambda t, c: t.column(c).to_numpy()
        at, key, score, exact = best_in_tile(column(queries, "key"), matrix(queries.column("v"), dim), column(queries, "least"), column(others, "key"), matrix(others.column("v"), dim), k)
        first = np.arange(len(at)) == 0
        return pa.table({"query": column(queries, "key")[at], "key": key, "score": score, "exact": np.where(first, exact, 0)})

    return run


def best_matches(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query, rank, key, score, scored): for each row of ``queries`` its ``k`` best rows of ``df``; both have the columns key and vector.

    ``scored`` counts the pairs behind a tile's first row whose exact score was computed.
    """
    prepared(df.sparkSession)
    vectors = lambda t: kept(t, vector).where(t[key].isNotNull()).select(t[key].cast("long").alias("key"), whole(t[vector]).alias("v"))
    rows = vectors(df).withColumn("dim", F.size("v"))
    asked = vectors(queries).withColumn("dim", F.size("v"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).head()
    most = max(1, min(GROUP_ROWS, GROUP_BYTES // (4 * max(1, size.dim or 0))))
    group_count = -(-size.n // most) or 1
    asked_count = -(-asked.count() // most) or 1
    group = lambda n: F.pmod(F.xxhash64("key", "v"), F.lit(n)).cast("int")
    rows = rows.withColumn("c", group(group_count))
    asked = asked.withColumn("q", group(asked_count))
    every = lambda df, c, a, b: df.withColumn(c, F.explode(F.sequence(F.lit(a), F.lit(b))))

    def searched(asked: DataFrame, a: int, b: int) -> DataFrame:
        """Results of the tiles of the candidates' groups a to b."""
        columns = ["dim", "c", "q", "key", "v", "least"]
        others = every(rows.where(F.col("c").between(a, b)), "q", 0, asked_count - 1).withColumn("least", F.lit(None).cast("double"))
        tiles = every(asked, "c", a, b).select(*columns).unionByName(others.select(*columns))
        return tiles.groupBy("dim", "c", "q").applyInArrow(_search(k), "query long, key long, score long, exact long")

    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    ranked = lambda df: df.groupBy("query", "key").agg(F.max("score").alias("score"), F.sum("exact").alias("scored")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    asked = asked.withColumn("least", F.lit(NO_SCORE))
    near = searched(asked, 0, 0)
    if group_count == 1:
        return ranked(near).select("query", "rank", "key", "score", "scored")
    near = materialize(ranked(near))
    least = near.where(F.col("rank") == k).select(F.col("query").alias("key"), F.col("score").cast("double").alias("known"))
    asked = materialize(asked.join(least, "key", "left").select("key", "v", "dim", "q", F.coalesce("known", "least").alias("least")))
    far = materialize(searched(asked, 1, group_count - 1))
    discard(asked)
    return ranked(far.unionByName(near.select("query", "key", "score", F.col("scored").alias("exact")))).select("query", "rank", "key", "score", "scored")


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best matches of each embedding whose id is divisible by 50 among all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = best_matches(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding", 5)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("key").alias("vec_id"), "score")


OP12_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.v, v.v) AS BIGINT) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) t WHERE rank <= 5
"""
