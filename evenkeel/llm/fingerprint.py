"""Document fingerprints from prefix polynomial hashes.

A text's code points give prefix arrays modulo two primes. From them any two spans can be compared
in constant time, the longest common extension of two places is found by binary search, and the
hashes of all windows come at once; the least window hashes of each of 64 bins form a sketch. The
fingerprint is the hash of the whole text followed by the sketch, as text.

A null text is an empty one. Null keys come after all others, and rows of one key in the order of
their texts' hashes; repeated rows each get a row. An empty table gives no rows; a single row is its own
next. Other columns are not read. A task holds three texts whole (a row's, its edited form and the next) and
the prefix arrays of one stretch of each, so long texts take a small multiple of their own size.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import documents, prepared
from evenkeel.llm.words import mix
from evenkeel.session import materialize

PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (911_382_323, 972_663_749)
WINDOW, BINS, EMPTY = 12, 64, 0xFFFF
#: Rows in a range of keys, at most about.
RANGE_ROWS = 50_000
#: Code points whose prefix arrays are held at once.
STRETCH = 1 << 16
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _power_arrays(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """At least n powers of each base and of its inverse, by doubling; kept, as n is bounded by a stretch."""
    if _powers and len(_powers[0][0]) >= n:
        return _powers
    made = []
    for p, b in zip(PRIMES, BASES, strict=True):
        pair = []
        for base in (b, pow(b, -1, p)):
            a = np.ones(1, np.uint64)
            while len(a) < max(n, 1 << 12):
                a = np.concatenate([a, a * np.uint64(pow(base, len(a), p)) % np.uint64(p)])
            pair.append(a)
        made.append(tuple(pair))
    _powers[:] = made
    return made


def _prefixes(text: str) -> list[np.ndarray]:
    """Prefix array of a stretch for each prime."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    out = []
    for p, (up, _) in zip(PRIMES, _power_arrays(len(points) + 1), strict=True):
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(points * up[: len(points)] % np.uint64(p), out=sums[1:])
        out.append(sums % np.uint64(p))
    return out


class PrefixHash:
    """Prefix arrays of a text; spans are [i, j) in code points.

    Kept are the prefix hashes at the borders of stretches and the arrays of the stretch last asked for, so that
    a long text takes no more memory than its own and a stretch's. ``each``, if given, is called with every stretch.
    """

    def __init__(self, text: str, each: Callable[[str], object] | None = None):
        self.text, self.n = text, len(text)
        self.borders = [(0,) * len(PRIMES)]
        self.held: tuple[int, list[np.ndarray]] = (-1, [])
        for part in range(-(-self.n // STRETCH)):
            ends = [int(h[-1]) for h in self._stretch(part)]
            self.borders.append(self._moved(part, ends))
            if each:
                each(text[part * STRETCH : (part + 1) * STRETCH])

    def _stretch(self, part: int) -> list[np.ndarray]:
        if self.held[0] != part:
            self.held = part, _prefixes(self.text[part * STRETCH : (part + 1) * STRETCH])
        return self.held[1]

    def _moved(self, part: int, local: list[int]) -> tuple[int, ...]:
        """Prefix hashes from the text's start for those from the start of a stretch."""
        if not part:
            return tuple(local)
        return tuple((x + pow(b, part * STRETCH, p) * y) % p for p, b, x, y in zip(PRIMES, BASES, self.borders[part], local, strict=True))

    def at(self, i: int) -> tuple[int, ...]:
        """Hash of the first i code points, for each prime."""
        part, rest = divmod(i, STRETCH)
        return self._moved(part, [int(h[rest]) for h in self._stretch(part)]) if rest else self.borders[part]

    def span(self, i: int, j: int) -> tuple[int, ...]:
        """Hash of a span, the same wherever the span stands."""
        return tuple((y - x) * pow(b, -i, p) % p for p, b, x, y in zip(PRIMES, BASES, self.at(i), self.at(j), strict=True))

    def windows(self, k: int) -> Iterator[np.ndarray]:
        """64-bit hashes of all windows of k code points (k up to a stretch), stretch by stretch."""
        for start in range(0, self.n - k + 1, STRETCH):
            local = self._stretch(0) if self.n <= STRETCH else _prefixes(self.text[start : start + STRETCH + k - 1])
            many = len(local[0]) - k
            out = np.zeros(many, np.uint64)
            for p, h, (_, down) in zip(PRIMES, local, _power_arrays(many), strict=True):
                q = np.uint64(p)
                out = (out << np.uint64(32)) | (h[k:] + q - h[:-k]) % q * down[:many] % q
            yield mix(out)


def spans_equal(a: PrefixHash, i: int, b: PrefixHash, j: int, length: int) -> bool:
    return i + length <= a.n and j + length <= b.n and a.span(i, i + length) == b.span(j, j + length)


def longest_common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """Greatest length of equal spans that start at i in one text and j in the other."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if spans_equal(a, i, b, j, mid):
            low = mid
        else:
            high = mid - 1
    return low


def sketch(h: PrefixHash) -> np.ndarray:
    """For each bin 16 bits of the least window hash in it; EMPTY where there is none."""
    if not h.n:
        return np.full(BINS, EMPTY, np.uint16)
    least = np.full(BINS, 2**64 - 1, np.uint64)
    for x in h.windows(min(WINDOW, h.n)):
        np.minimum.at(least, (x & np.uint64(BINS - 1)).astype(np.int64), x >> np.uint64(6))
    return np.where(least == np.uint64(2**64 - 1), EMPTY, mix(least) % np.uint64(EMPTY)).astype(np.uint16)


def fingerprint(h: PrefixHash) -> str:
    head = "".join(f"{x:08x}" for x in h.span(0, h.n))
    return f"{head}{h.n & 0xFFFFFFFF:08x}{sketch(h).astype('>u2').tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """Share of equal bins among those that either has; equal fingerprints are 1, those of empty texts else 0."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f[24:]), ">u2") for f in (a, b))
    used = (x != EMPTY) | (y != EMPTY)
    return float(((x == y) & used).sum() / used.sum()) if used.any() else 0.0


def with_next(df: DataFrame, key: str, text: str, buckets: int | None = None) -> DataFrame:
    """Rows (bucket, last, key, text) such that, ordered, each row's next has the next smaller key.

    Spark's range partitioning of the keys alone says where each of about ``buckets`` ranges begins; these
    places, one for each ``RANGE_ROWS`` rows or so, are a small table. Each range goes to one partition and is
    sorted there. After a range's rows comes a copy of the first row of the next range (``last`` is true),
    and after the smallest key that of the largest, so each row finds its next in its own partition. Null
    keys come after all others; rows of equal key are ordered, and spread over ranges, by the hash of their
    text.
    """
    spark = df.sparkSession
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    rows = df.select(df[key].cast("long").alias("key"), F.coalesce(df[text], F.lit("")).alias("text"))
    place = {"no_key": F.col("key").isNull(), "negative": F.negative(F.coalesce("key", F.lit(0).cast("long"))), "hash": F.xxhash64("text")}
    placed = rows.withColumns(place)
    ranges = placed.select(*place).repartitionByRange(n, *place).withColumn("range", F.spark_partition_id())
    heads = materialize(ranges.groupBy("range").agg(F.min(F.struct(*place)).alias("head")).select("head.*"))
    bounds = sorted(map(tuple, heads.collect()))
    if not bounds:
        return rows.select(F.lit(0).alias("bucket"), F.lit(False).alias("last"), "key", "text")

    @F.pandas_udf("int")
    def bucket_of(no_key: pd.Series, negative: pd.Series, hashed: pd.Series) -> pd.Series:
        found = [bisect.bisect_right(bounds, p) - 1 for p in zip(no_key.tolist(), negative.tolist(), hashed.tolist(), strict=True)]
        return pd.Series(found, dtype=np.int32)

    order = Window.orderBy(*place)
    numbered = heads.withColumn("bucket", F.row_number().over(order) - 1)
    before = numbered.withColumn("to", F.pmod(F.col("bucket") - 1, F.lit(len(bounds)))).drop("bucket")
    tail = placed.join(F.broadcast(before), list(place)).dropDuplicates(["to"]).select(F.col("to").alias("bucket"), F.lit(True).alias("last"), "key", "text")
    both = placed.select(bucket_of(*place).alias("bucket"), F.lit(False).alias("last"), "key", "text").unionByName(tail)
    both = both.repartitionById(len(bounds), F.col("bucket"))
    return both.sortWithinPartitions("bucket", "last", F.desc_nulls_last("key"), F.xxhash64("text"))


OP8_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_prefix long"
)


def _compare(ordered: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in OP8_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    held, rows = None, []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for part in ordered:
        for last, key, text in zip(*(part.column(c).to_pylist() for c in ("last", "key", "text")), strict=True):
            own = PrefixHash(text)
            now = (key, own, fingerprint(own))
            if held is not None:
                old_key, old, old_mark = held
                cut = old.n // 3
                edited = old.text[: old.n - cut] + text[:cut]
                digest = hashlib.sha256()
                new = PrefixHash(edited, lambda part: digest.update(part.encode("utf-8", "surrogatepass")))
                mark = fingerprint(new)
                same = longest_common_extension(old, 0, new, 0)
                rows.append((old_key, old.n, digest.hexdigest(), old_mark, mark, likeness(old_mark, mark), likeness(old_mark, now[2]), same))
            held = None if last else now
        if len(rows) >= 1000:
            yield batch()
            rows.clear()
    if rows:
        yield batch()


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its edited text, whose end comes from the next document."""
    return with_next(documents(prepared(spark), sf_dir), "doc_id", "text").mapInArrow(_compare, OP8_SCHEMA)
