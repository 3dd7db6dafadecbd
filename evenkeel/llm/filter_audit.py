"""What each of five filters removes, in every order, from survival words of the documents.

A document fails some of the filters. Its survival word has a bit for each of the 32 subsets of
filters, set if the document survives all filters of that subset. Carry-save adders sum the words of a
part of the corpus and a label by position, 32 sums at once: three words of one weight become a word of
that weight and one of twice the weight. The sums say how many documents each subset leaves, and every
figure of every order is a difference of two or four of them, so documents are read once, not once an
order.

Tasks add up the words of what they read; their sums (parts x labels x 32 numbers) are all that is
shuffled then. Documents that share a text are found by digest, a common text in ``SALTS`` parts.

A null text counts as empty, a null part as the empty string. A null key is nobody's copy and nobody's
original; rows that share key and text don't fail for each other. Of several labels of a document each
counts; null labels and labels of other documents count as none. Repeated rows are documents each.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm.common import documents, prepared
from evenkeel.session import materialize

LETTERS = "ABCDE"
WORDS = 1 << len(LETTERS)
SALTS = 256
#: Sums that a task holds before it gives them out.
HELD = 10_000


def content_failures(text: Column) -> dict[str, Column]:
    """Filters A to D on a whole text that isn't null: too few words, repeated words, capitals, marks."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failed(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """(key, part, fails): of each document the filters that it fails, as bits in the order of the letters."""
    whole = F.coalesce(docs[text], F.lit(""))
    bits = sum((F.when(c, 1 << n).otherwise(0) for n, c in enumerate(content_failures(F.col("text")).values())), F.lit(0))
    rows = docs.select(docs[key].alias("key"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), whole.alias("text"))
    rows = materialize(rows.select("key", "part", F.md5("text").alias("digest"), bits.alias("fails")))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    groups = salted.where("key is not null").groupBy("digest", "salt").agg(F.min("key").alias("least"), F.max("key").alias("greatest"))
    repeated = groups.groupBy("digest").agg(F.min("least").alias("first"), F.max("greatest").alias("last")).where("first < last").select("digest", "first")
    copies = salted.join(groups.select("digest", "salt").join(repeated, "digest"), ["digest", "salt"], "left")
    late = F.when(F.coalesce(F.col("key") > F.col("first"), F.lit(False)), 1 << LETTERS.index("E")).otherwise(0)
    return copies.select("key", "part", (F.col("fails") + late).alias("fails"))


def labelled(rows: DataFrame, labels: DataFrame, key: str, flags: Sequence[str]) -> DataFrame:
    """``rows`` with ``label``: a bit for each of the flags that has a 1 for the key."""
    known = labels.where(labels[key].isNotNull()).groupBy(labels[key].alias("key"))
    known = known.agg(*[F.coalesce(F.max((labels[f] == 1).cast("int")), F.lit(0)).alias(f"flag_{n}") for n, f in enumerate(flags)])
    bits = sum((F.col(f"flag_{n}") * (1 << n) for n in range(len(flags))), F.lit(0))
    return rows.join(known.select("key", bits.alias("label")), "key", "left").withColumn("label", F.coalesce("label", F.lit(0)))


def survival_word(fails: int) -> int:
    """A bit for each subset of filters: whether none of it is failed."""
    return sum(1 << subset for subset in range(WORDS) if not subset & fails)


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the words (uint32) have each bit: carry-save adders turn threes of a weight into one and a carry."""
    counts, weight = np.zeros(32, np.int64), 1
    while len(words):
        carries = [words[:0]]
        while (n := len(words) // 3) > 0:
            a, b, c = words[:n], words[n : 2 * n], words[2 * n : 3 * n]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * n :]])
        for word in words.tolist():
            counts += weight * (word >> np.arange(32) & 1)
        words, weight = np.concatenate(carries), weight * 2
    return counts


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, int], np.ndarray] = {}

    def out() -> pa.RecordBatch:
        keys, sums = list(held), pa.array(np.concatenate(list(held.values())) if held else np.zeros(0, np.int64))
        ends = pa.array(np.arange(len(keys) + 1) * 32, pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.ListArray.from_arrays(ends, sums)], ["part", "label", "survive"])

    for batch in batches:
        words = batch.column("word").to_numpy().astype(np.uint32)
        names = batch.column("part").dictionary_encode()
        label = batch.column("label").to_numpy()
        group = names.indices.to_numpy().astype(np.int64) * 256 + label
        order = np.argsort(group, kind="stable")
        found, starts = np.unique(group[order], return_index=True)
        for g, some in zip(found.tolist(), np.split(order, starts[1:]), strict=True):
            k = (names.dictionary[g // 256].as_py(), g % 256)
            held[k] = held.get(k, 0) + positional_counts(words[some])
        if len(held) > HELD:
            yield out()
            held.clear()
    yield out()


def subset_survivors(rows: DataFrame, flags: Sequence[str]) -> DataFrame:
    """(part, all, and each flag): arrays of the documents that each subset of filters leaves. rows: part, fails, label (at most 8 flags)."""
    prepared(rows.sparkSession)
    word = F.get(F.array(*[F.lit(survival_word(f)) for f in range(WORDS)]), F.col("fails"))
    sums = rows.select("part", F.col("label").cast("int").alias("label"), word.cast("long").alias("word")).mapInArrow(_sums, "part string, label int, survive array<long>")
    of = lambda n: F.lit(True) if n is None else F.col("label").bitwiseAND(1 << n) != 0
    total = lambda n: F.array(*[F.coalesce(F.sum(F.when(of(n), F.get("survive", F.lit(s)))), F.lit(0)) for s in range(WORDS)])
    return sums.groupBy("part").agg(total(None).alias("all"), *[total(n).alias(f) for n, f in enumerate(flags)])


def orders() -> list[dict]:
    """Each step of each order: its filter's bit and the subset before it."""
    out = []
    for order in permutations(range(len(LETTERS))):
        before = 0
        for step, n in enumerate(order, 1):
            out.append({"filter_order": "".join(LETTERS[x] for x in order), "step": step, "bit": 1 << n, "before": before})
            before |= 1 << n
    return out


def order_report(survivors: DataFrame, flags: Sequence[str]) -> DataFrame:
    """A row for each part, order and step, with what the step's filter does there.

    shapley sums the filter's removals over all orders: a subset without it comes just before it in
    |subset|! * (4 - |subset|)! of them.
    """
    steps = F.from_json(F.lit(json.dumps(orders())), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    shares = []
    for n in range(len(LETTERS)):
        weight = [0] * WORDS
        for s in range(WORDS):
            if not s >> n & 1:
                times = factorial(s.bit_count()) * factorial(len(LETTERS) - 1 - s.bit_count())
                weight[s] += times
                weight[s | 1 << n] -= times
        shares.append(sum((F.get("all", F.lit(s)) * w for s, w in enumerate(weight)), F.lit(0)))
    rows = survivors.withColumn("shares", F.array(*shares)).select("*", F.inline(steps))
    left = lambda column, subset: F.get(column, subset)
    before, after = F.col("before"), F.col("before").bitwiseOR(F.col("bit"))
    lost = lambda column: left(column, before) - left(column, after)
    everything, nothing = F.lit(WORDS - 1), F.lit(0)
    place = F.log2("bit").cast("int")
    return rows.select(
        "part", "filter_order", "step", F.substr(F.lit(LETTERS), place + 1, F.lit(1)).alias("filter"),
        left("all", after).alias("kept"), lost("all").alias("removed"),
        (left("all", nothing) - left("all", F.col("bit")) - lost("all")).alias("redundant"),
        (left("all", everything.bitwiseXOR(F.col("bit"))) - left("all", everything)).alias("unique_fails"),
        *[lost(f).alias(f) for f in flags], F.get("shares", place).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What filters A to E remove from the documents of each source, in all 120 orders."""
    rows = failed(documents(spark, sf_dir), "doc_id", "text", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("good_lost"), F.col("toxic").alias("toxic_lost"))
    flags = ["good_lost", "toxic_lost"]
    return order_report(subset_survivors(labelled(rows, labels, "doc_id", flags), flags), flags).drop("filter")


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS m FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
g AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, m),
x(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM x a JOIN x b ON b.l <> a.l JOIN x c ON c.l NOT IN (a.l, b.l)
  JOIN x d ON d.l NOT IN (a.l, b.l, c.l) JOIN x e ON e.l NOT IN (a.l, b.l, c.l, d.l)),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS before FROM o, (SELECT unnest(range(1, 6)) AS step) t),
r AS (SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (WHERE m & CAST(before + bit AS BIGINT) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE m & CAST(before AS BIGINT) = 0 AND m & bit <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE m & CAST(before AS BIGINT) <> 0 AND m & bit <> 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE m = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE m & CAST(before AS BIGINT) = 0 AND m & bit <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE m & CAST(before AS BIGINT) = 0 AND m & bit <> 0), 0) AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
