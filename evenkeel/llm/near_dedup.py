"""Near-duplicate documents from bottom-k sketches of one hash function.

1. A document's set of 5-word shingle hashes gives its size, a digest, and a sketch: its 64 least
   hashes, or all of them in a set of up to 128. Documents of equal sets are one class, represented by
   the least key.
2. Inverted lists: each class enters the lists of its rarest retained values, as many as are needed
   for two classes at the threshold to meet (the prefix rule: of k values of which t are shared, the
   first k - t + 1 in any common order meet). Sets of up to 128 are listed whole, where t follows from
   the threshold itself; sets of more than 96, whose partners may have more than 128, by their 64
   least hashes. Values of common passages are thus hardly ever listed.
3. Each list has a pivot, its class with the most widely shared sketch. Members are paired with the
   pivot alone. Two whole sketches tell the similarity; else the sketch of the union estimates it and
   drops the hopeless pairs, and exact Jaccard on the full sets decides. Components of these links
   come next.
4. Members that did not reach their pivot's component are compared with all members of the pivot's
   other components, set by set, in blocks of bounded size inside a task; only links come out. So no
   pair within a group is lost, and none is emitted but a link.

Two documents at the threshold are missed only if one has more than 128 shingles and their sketches
share less than 28 of 64 values where 48 are expected (less than one in ten million).

Rows without words or with a null key are linked with nothing; a row with a null key has no
component and is kept. Rows that share a key count as one document, which is linked by any of its
texts. Repeated rows are rows of one key. Of equal sets, and of pivots of equal width, the smaller key
comes first, which changes no component. Tasks hold the texts of an Arrow batch, or of a tile, whole. An
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm.common import documents, prepared
from evenkeel.llm.words import Words, chunked, mix
from evenkeel.operators.components import component_labels
from evenkeel.session import discard, materialize

SHINGLE, SKETCH = 5, 64
#: Sets up to this size are kept whole; those of a size above PERCENT of it may have partners that are not.
WHOLE = 128
PERCENT = 75
#: Least shared values of two full sketches at the threshold, and of the union's sketch.
SHARED, LIKELY = 28, 28
#: Members compared with each other in one go.
BLOCK_ROWS = 512
#: Parts of a class of equal sets; members of a pivot in one part of the join that marks stragglers, a pivot of fewer being one part.
SALTS, PART_ROWS = 256, 10_000


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words than a shingle, one hash of them all."""
    for _, run in chunked(texts):
        words = Words(run, fold=True)
        hashes, _ = words.windows(SHINGLE)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                yield np.unique(hashes[a : b - SHINGLE + 1])
            elif b > a:
                short = np.uint64(b - a)
                for h in words.hash[a:b]:
                    short = mix(np.array([short], np.uint64) ^ h)[0]
                yield np.array([short], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


SKETCHES = "key long, n long, one long, two long, sketch array<long>"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        n, one, two, sketch = [], [], [], []
        for s in shingle_sets(batch.column("text").to_pylist()):
            n.append(len(s))
            digest = mix(s ^ np.uint64(0x5DEECE66D))
            one.append(int(digest.sum(dtype=np.uint64).view(np.int64)))
            two.append(int(mix(digest).sum(dtype=np.uint64).view(np.int64)))
            sketch.append(s[: len(s) if len(s) <= WHOLE else SKETCH].view(np.int64))
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sketch])])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sketch)))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), lists], ["key", "n", "one", "two", "sketch"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of shingles reach the threshold."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


@F.pandas_udf(T.BooleanType())
def _confirmed(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for one, two in pairs:
        yield pd.Series([similar(a, b) for a, b in zip(shingle_sets(list(one)), shingle_sets(list(two)), strict=True)], dtype=bool)


def _links_in_block(table: pa.Table) -> pa.Table:
    """Links of a block's stragglers with its members; classes of one component are linked already."""
    key, component, text = (table.column(c).to_pylist() for c in ("key", "component", "text"))
    straggler = np.array(table.column("straggler").to_pylist(), bool)
    sets = list(shingle_sets(text))
    size = np.array([len(s) for s in sets], np.int64)
    values, coded = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    group = pd.factorize(np.array(component, np.int64))[0] if component else np.zeros(0, np.int64)
    a, b = [], []
    mark = np.zeros(len(values), np.int64)
    for x in np.flatnonzero(straggler).tolist():
        own = coded[start[x] : start[x + 1]]
        mark[own] = 1
        both = np.add.reduceat(np.append(mark[coded], 0), start[:-1]) * (size > 0)
        mark[own] = 0
        near = (100 * both >= PERCENT * (size + size[x] - both)) & (both > 0) & (group != group[x])
        for y in np.flatnonzero(near).tolist():
            a.append(key[x])
            b.append(key[y])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _estimated(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose sizes allow the threshold and whose sketches make it possible; ``certain`` if they are whole sets."""
    side = lambda c: sketches.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    known = pairs.join(side("a"), "a").join(side("b"), "b")
    known = known.where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")).withColumn("certain", F.greatest("n_a", "n_b") <= WHOLE)
    both = F.array_intersect(_ordered("s_a"), _ordered("s_b"))
    union = F.slice(F.array_sort(F.array_union(_ordered("s_a"), _ordered("s_b"))), 1, SKETCH)
    exact = 100 * F.size(both) >= PERCENT * (F.col("n_a") + F.col("n_b") - F.size(both))
    return known.where(F.when(F.col("certain"), exact).otherwise(F.size(F.array_intersect(both, union)) * SKETCH >= F.size(union) * LIKELY)).select("a", "b", "certain")


def _ordered(c: str) -> Column:
    """Sketch values in the order of their unsigned hashes."""
    return F.transform(c, lambda x: x.bitwiseXOR(F.lit(-(2**63)).cast("long")))


def _classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one, two, class): the least key of each set that has a row; and the same by part of the class, for all parts with rows.

    A class of any number of rows is joined part by part.
    """
    parts = sets.groupBy("one", "two", "part").agg(F.min("key").alias("key"))
    classes = parts.groupBy("one", "two").agg(F.min("key").alias("class"))
    return classes, parts.drop("key").join(classes, ["one", "two"])


def near_links(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Members (key, n, class: least key of the same set) and links between classes (a, b)."""
    prepared(docs.sparkSession)
    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].cast("binary").alias("text"))
    sets = materialize(rows.mapInArrow(_sketches, SKETCHES)).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    linkable = sets.where("key is not null and n > 0")
    classes, by_part = _classes(linkable)
    members = sets.join(by_part, ["one", "two", "part"], "left").select("key", "n", F.when(F.col("key").isNotNull() & (F.col("n") > 0), F.col("class")).alias("class"))
    sketches = linkable.join(classes.withColumnRenamed("class", "key"), ["one", "two", "key"])
    sketches = materialize(sketches.select("key", "one", "n", "sketch").dropDuplicates(["key", "one"]))

    entry = lambda whole, values: F.transform(values, lambda x: F.struct(F.lit(whole).alias("whole"), x.alias("value")))
    none = F.array().cast("array<struct<whole:boolean,value:bigint>>")
    entries = F.concat(F.when(F.col("n") <= WHOLE, entry(True, F.col("sketch"))).otherwise(none), F.when(F.col("n") > WHOLE * PERCENT // 100, entry(False, F.slice("sketch", 1, SKETCH))).otherwise(none))
    listed = sketches.select("key", "one", "n", F.explode(entries).alias("entry")).select("key", "one", "n", "entry.whole", "entry.value")
    common = materialize(listed.groupBy("whole", "value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    shared = listed.join(common, ["whole", "value"])
    own = Window.partitionBy("key", "one", "whole")
    t = F.when(F.col("whole"), F.ceil(F.col("n") * PERCENT / 100)).otherwise(F.lit(SHARED))
    shared = shared.select(
        "key", "whole", "value", "df", F.row_number().over(own.orderBy("df", "value")).alias("place"), (F.count(F.lit(1)).over(own) - t + 1).alias("places"), F.sum("df").over(own).alias("width")
    )  # values that no other class has come first in the order of rarity: they use up places
    lists = materialize(shared.where("place <= places").select("key", "whole", "value", "width"))
    pivots = lists.groupBy("whole", "value").agg(F.max(F.struct("width", F.negative("key").alias("minus"))).alias("top"), F.count(F.lit(1)).alias("size"))
    pivots = pivots.where("size > 1").select("whole", "value", F.negative("top.minus").alias("pivot"))
    groups = materialize(lists.join(pivots, ["whole", "value"]).select("pivot", "key").distinct())

    spokes = groups.where("pivot <> key").select(F.col("pivot").alias("a"), F.col("key").alias("b"))
    words = rows.where("key is not null")
    likely = materialize(_estimated(spokes, sketches).distinct())
    full = lambda c: words.select(F.col("key").alias(c), F.col("text").alias(f"t_{c}"))
    confirmed = likely.where("not certain").join(full("a"), "a").join(full("b"), "b").where(_confirmed("t_a", "t_b")).select("a", "b").distinct()
    links = materialize(confirmed.unionByName(likely.where("certain").select("a", "b")))

    labels = component_labels(links, "a", "b")
    with_component = groups.join(labels.withColumnRenamed("node", "key"), "key", "left").select("pivot", "key", F.coalesce("component", "key").alias("component"))
    sizes = with_component.groupBy("pivot", "component").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("pivot") == F.col("key")).alias("is_hub"))
    hubs = sizes.groupBy("pivot").agg(
        F.sum("n").alias("size"), F.sum(F.when(~F.col("is_hub"), F.col("n")).otherwise(0)).alias("out"), F.max(F.when(F.col("is_hub"), F.col("component"))).alias("hub")
    ).where("out > 0 and size > 2")
    hubs = materialize(hubs.withColumn("salts", F.ceil(F.col("size") / PART_ROWS)))
    large = materialize(hubs.where("salts > 1").select("pivot", "salts"))  # at most one for each PART_ROWS members, so Spark may find it small
    salt = F.pmod(F.xxhash64("key"), F.coalesce("salts", F.lit(1)))
    salted = with_component.join(large, "pivot", "left").select("pivot", "key", "component", salt.alias("salt"))
    hubs = hubs.select("pivot", "size", "out", "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    seen = salted.join(hubs, ["pivot", "salt"]).withColumn("straggler", F.col("component") != F.col("hub"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_ROWS).cast("int")
    hashed = F.xxhash64("key")
    seen = seen.withColumns({"rows": blocks("out"), "columns": blocks("size")})
    as_row = seen.where("straggler").select("pivot", "key", "component", "straggler", F.pmod(hashed, "rows").alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns").cast("long") - 1)).alias("c"))
    as_column = seen.select("pivot", "key", "component", F.lit(False).alias("straggler"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows").cast("long") - 1)).alias("r"), F.pmod(hashed, "columns").alias("c"))
    tiles = as_row.unionByName(as_column.select(*as_row.columns))
    tiles = tiles.join(words, "key").select("pivot", "r", "c", "key", "component", "straggler", "text")
    late = tiles.groupBy("pivot", "r", "c").applyInArrow(_links_in_block, "a long, b long")
    all_links = links.unionByName(materialize(late.distinct()))
    discard(common, lists, groups, likely, hubs, sketches)
    return members, all_links


def near_components(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_shingles, component_id and kept for each row."""
    members, links = near_links(docs, key, text)
    labels = component_labels(links, "a", "b").withColumnRenamed("node", "class")
    found = members.join(labels, "class", "left").withColumn("component_id", F.coalesce("component", "class", "key"))
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir), "doc_id", "text")


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5) t
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id WHERE 100 * pair.n >= 75 * (x.n + y.n - pair.n)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
component AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN size ON d.doc_id = size.doc_id JOIN component ON d.doc_id = component.doc_id
"""


def without_near_copies(docs: DataFrame) -> DataFrame:
    """Of each component the document with the least key, whole."""
    gone = near_components(docs, "doc_id", "text").where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), docs["doc_id"].alias("key"))
    return rows.join(gone, F.col("key") == F.col("gone"), "left_anti").select("row.*")
