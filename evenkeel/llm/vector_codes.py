"""Product codes of vectors, the nearest codebook entries found by slicing and intersecting bitmasks.

A vector is cut into equal parts; each part position has a codebook of at most 64 entries. For each
dimension of a part the entries' coordinates are sorted once, and each place in that order carries the
mask of all entries before it. To look up a part:

1. The entries next to it along each dimension give an initial radius, the least of their distances.
2. In each dimension the entries within the radius are a range of the sorted coordinates, and two
   prefix masks give the range as one uint64. The masks of all dimensions are ANDed.
3. Whatever is as near as the initial guess lies in the box, so the bits left are the exact
   candidates; their distances decide, and the lower index of equal ones.

Codebooks are learned over all rows: a round sums the parts of each entry within tasks and then over
them (entries x dimensions sums, whatever the input); only these sums pass the driver. Tasks get the
codebooks, 64 x dimensions whole numbers, with the function.

Rows whose vector is null or holds a null or non-finite component are dropped, and so are those of
another length than the row with the least key; scaled components beyond 2^27 are cut to that. Parts of
a length that isn't divisible differ by one at most, the longer ones first; a part without components
has code 0 and error 0. Rows with a null key are coded like others and come last in the choice of the
first entries, in which equal keys go by their vectors. Repeated rows are rows. A table of under 64
rows has as many entries. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm.common import prepared
from evenkeel.llm.vectors import kept, matrix, whole
from evenkeel.session import materialize

PARTS, ENTRIES, ROUNDS = 16, 64, 2
ALL = np.uint64(2**64 - 1)


class Slices:
    """A codebook of one part position: entries (at most 64) by dimension in sorted order, with prefix masks."""

    def __init__(self, entries: np.ndarray):
        if len(entries) > 64:
            raise ValueError("a codebook has at most 64 entries")
        self.entries = entries
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, self.order, axis=0)
        bits = np.uint64(1) << self.order.astype(np.uint64)
        none = np.zeros((1, entries.shape[1]), np.uint64)
        self.before = np.concatenate([none, np.bitwise_or.accumulate(bits, axis=0)])

    def guess(self, x: np.ndarray) -> np.ndarray:
        """A distance that some entry has from each row of ``x``: the least of the neighbours along each dimension."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        for d in range(x.shape[1]):
            after = np.searchsorted(self.sorted[:, d], x[:, d])
            for at in (after - 1, after):
                entry = self.order[at.clip(0, len(self.entries) - 1), d]
                np.minimum(best, np.square(x - self.entries[entry]).sum(axis=1), out=best)
        return best

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries within ``radius`` of each row of ``x`` in every dimension."""
        masks = np.full(len(x), ALL)
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            masks &= self.before[high, d] & ~self.before[low, d]
        return masks

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry, the lower of equal ones, and its squared distance."""
        code, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        if not x.shape[1] or not len(x):
            return code, least
        guess = self.guess(x)
        masks = self.candidates(x, np.sqrt(guess.astype(np.float64)).astype(np.int64) + 1)
        least[:] = np.iinfo(np.int64).max
        left = np.arange(len(x))
        while len(left):
            mask = masks[left]
            low = mask & (~mask + np.uint64(1))
            entry = np.log2(low.astype(np.float64)).astype(np.int64)
            distance = np.square(x[left] - self.entries[entry]).sum(axis=1)
            nearer = distance < least[left]
            least[left[nearer]], code[left[nearer]] = distance[nearer], entry[nearer]
            masks[left] = mask ^ low
            left = left[mask != low]
        return code, least


def cuts(dim: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, and its end."""
    return [0, *np.cumsum([len(x) for x in np.array_split(np.arange(dim), parts)]).tolist()]


def _books(entries: np.ndarray, at: list[int]) -> list[Slices]:
    return [Slices(entries[:, a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _learned(rows: DataFrame, entries: np.ndarray, at: list[int]) -> np.ndarray:
    """The entries after one round: componentwise floors of the means of the parts assigned to each."""
    books, (size, dim) = _books(entries, at), entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((size, dim), np.int64), np.zeros((size, dim), np.int64)
        for batch in batches:
            x = matrix(batch.column("v"), dim)
            for book, a, b in zip(books, at[:-1], at[1:], strict=True):
                code, _ = book.nearest(x[:, a:b])
                np.add.at(total[:, a:b], code, x[:, a:b])
                count[:, a:b] += np.bincount(code, minlength=size)[:, None]
        entry, place = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(entry), pa.array(place), pa.array(count[entry, place]), pa.array(total[entry, place])], ["entry", "place", "n", "total"])

    parts = rows.select("v").mapInArrow(run, "entry long, place long, n long, total long")
    sums = parts.groupBy("entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = entries.copy()
    for r in sums.collect():  # entries x dimensions rows
        out[r.entry, r.place] = int(r.total) // r.n
    return out


def codebook_text(entries: np.ndarray, parts: int) -> str:
    """All components by part, entry and place, joined by comma."""
    at = cuts(entries.shape[1], parts)
    return ",".join(str(x) for a, b in zip(at[:-1], at[1:], strict=True) for x in entries[:, a:b].ravel().tolist())


def vector_codes(df: DataFrame, key: str, vector: str, label: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(key, label, code, error) of each vector that is kept, and the entries (index, component) behind the codes."""
    prepared(df.sparkSession)
    rows = kept(df, vector).select(df[key].alias("key"), df[label].alias("label"), whole(df[vector]).alias("v"))
    first = [r.v for r in rows.orderBy(F.asc_nulls_last("key"), "v").limit(entries).select("v").collect()]
    dim = len(first[0]) if first else 0
    rows = rows.where(F.size("v") == dim)
    first = [v for v in first if len(v) == dim]
    table = np.array(first, np.int64).reshape(len(first), dim)
    at = cuts(dim, parts)
    for _ in range(rounds if first else 0):
        table = _learned(rows, table, at)
    books = _books(table, at) if first else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), dim)
            found = [book.nearest(x[:, a:b]) for book, a, b in zip(books, at[:-1], at[1:], strict=True)]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            error = np.sum([e for _, e in found], axis=0)
            text = pa.array([c.tobytes().hex() for c in codes], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), text, pa.array(error, pa.int64())], ["key", "label", "code", "error"])

    schema = T.StructType([rows.schema["key"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return rows.mapInArrow(run, schema), table


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors summed over equal labels, null being one.

    The sums are a table of their own: Spark broadcasts them if they are small, and else splits the rows of a common label.
    """
    coded = materialize(coded)
    sums = materialize(coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, their errors, and the digest of the codebooks."""
    coded, table = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")
    digest = hashlib.sha256(codebook_text(table, PARTS).encode()).hexdigest()
    return with_label_errors(coded).select(F.col("key").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round_sql(n: int) -> str:
    """One assignment to the codebook b{n}; and the codebook that it gives."""
    return f"""
a{n} AS (SELECT vec_id, label, part, v, e, dist FROM (
    SELECT p.*, e, list_sum(list_transform(list_zip(p.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist,
      row_number() OVER (PARTITION BY vec_id, p.part ORDER BY list_sum(list_transform(list_zip(p.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e) AS nth
    FROM p JOIN b{n} b ON b.part = p.part) t WHERE nth = 1),
b{n + 1} AS (SELECT b.part, b.e, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN (
    SELECT part, e, list(mean ORDER BY i) AS c FROM (
      SELECT part, e, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS mean FROM a{n}, (SELECT unnest(range(1, 5)) AS i) t GROUP BY part, e, i) t GROUP BY part, e) m
    ON m.part = b.part AND m.e = b.e)"""


OP11_SQL = f"""
WITH q AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, part, v[part * 4 + 1:part * 4 + 4] AS v FROM q, (SELECT unnest(range(0, 16)) AS part) t),
b0 AS (SELECT part, e, v AS c FROM (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e FROM p) t WHERE e < 64),
{_round_sql(0)},{_round_sql(1)},{_round_sql(2)},
r AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label),
s AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, e, i)) AS h FROM (SELECT part, e, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM b2) t)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM r, s
"""
