"""Removal of blocks of lines that an earlier document has, by pairwise patience alignment.

1. Lines (white space at both ends aside) are hashed; blank lines have no hash. A line that two or
   more documents hold is shared, however common. So are two lines with none but blank ones between them.
2. Documents fall into ``GROUPS`` groups by the hash of their key. A document is aligned with the first
   holder, by key, in each group of each of its shared lines and pairs, if that comes earlier. So a
   block's first holder is always among the partners, and groups of copies of any size cost each
   document a bounded number of alignments for each line, never all pairs.
3. Patience diff aligns the two lists of hashes: lines unique on both sides anchor, the stretches
   between anchors are aligned likewise, and matches grow outward over equal lines.
4. Aligned blocks of at least ``BLOCK_LINES`` lines or ``BLOCK_CHARS`` characters go from the later
   document; the earlier one keeps them. Blocks are judged on the input.
5. First holders may have a line in another order, or a block less long. So long lines and pairs that are
   still there bring further holders: the first in each of ``GROWTH`` times as many other groups, and so
   on, and all of them once a line has no more holders than there are groups. Of documents with equal
   lines the first stands for all. So in the end a document has been aligned with all that can take
   anything more from it: nothing is given up, and what is still there costs all pairs of its holders.

A null text has no lines and stays null. Rows with a null key stay as they are and are nobody's
source. Rows that share a key are one document for the counts and are aligned separately. Tasks hold the
line hashes of two documents whole. An empty
text is one blank line. An empty table gives no rows; other columns go through, whatever their names.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.json_text import let
from evenkeel.llm.common import documents, prepared
from evenkeel.session import materialize

#: Groups of documents in the first round, each of which gives a partner for each line.
GROUPS = 8
#: How many times as many groups the next round has.
GROWTH = 16
BLOCK_LINES, BLOCK_CHARS = 2, 40
BLANK = 0


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by the first, whose seconds rise."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(tops, j)
        back.append(ends[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            ends.append(n)
        else:
            tops[at], ends[at] = j, n
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b) of equal entries, rising on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once: dict[int, int] = {}
        for i in range(a0, a1):
            once[a[i]] = -1 if a[i] in once else i
        twice: dict[int, int] = {}
        for j in range(b0, b1):
            twice[b[j]] = -1 if b[j] in twice else j
        anchors = _rising([(i, twice[x]) for x, i in once.items() if i >= 0 and twice.get(x, -1) >= 0])
        if not anchors:
            continue
        cuts = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        out.extend(anchors)
        for (i, j), (k, m) in zip(cuts[:-1], cuts[1:], strict=True):
            if k - i > 1 and m - j > 1:
                todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def common_blocks(later: list[int], earlier: list[int], sizes: list[int]) -> list[int]:
    """Places in the later document of lines in aligned blocks that are long enough."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(later, earlier), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            held = [x for x in block if later[x] != BLANK]
            if len(held) >= BLOCK_LINES or sum(sizes[x] for x in held) >= BLOCK_CHARS:
                out += block
            block = []
        block.append(i)
        last = (i, j)
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _align(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for later, earlier, sizes in rows:
        yield pd.Series([common_blocks(list(a), list(b), list(s)) for a, b, s in zip(later, earlier, sizes, strict=True)], dtype=object)


#: Spark infers a filter from ``explode`` and would call a deterministic function for it too: twice the work, and twice the Python workers at a time.
_align = _align.asNondeterministic()


def _elements(hashes: str, sizes: str) -> Column:
    """Each line that isn't blank, and each two that follow each other with their distance: hash ``x``, place ``at``, place ``to`` of the second, and ``able``.

    An element is able if a block can consist of it, being long enough or two lines; each block holds such an element.
    """
    line = lambda x, i: F.struct(x.alias("x"), i.alias("at"), i.alias("to"), (F.get(sizes, i) >= BLOCK_CHARS).alias("able"))
    placed = F.filter(F.transform(hashes, line), lambda p: p.x != BLANK)

    def both(lines: Column) -> Column:
        n = F.greatest(F.size(lines) - 1, F.lit(0))
        pair = lambda p, q: F.struct(F.xxhash64(p.x, q.x, q.at - p.at).alias("x"), p.at.alias("at"), q.at.alias("to"), F.lit(True).alias("able"))
        return F.concat(lines, F.zip_with(F.slice(lines, F.lit(1), n), F.slice(lines, F.lit(2), n), pair))

    return let(placed, both)


def _gone(pairs: DataFrame, lined: DataFrame) -> DataFrame:
    """(key, text_hash, line): numbers of the lines that alignment of each document with its partners (key, text_hash, first) removes."""
    later = lined.select("key", "text_hash", F.col("hashes").alias("later"), "sizes")
    earlier = lined.select(F.col("key").alias("first"), F.col("hashes").alias("earlier"))
    aligned = pairs.join(later, ["key", "text_hash"]).join(earlier, "first").select("key", "text_hash", _align("later", "earlier", "sizes").alias("gone"))
    return aligned.select("key", "text_hash", F.explode("gone").alias("line")).distinct()


def _by_document(gone: DataFrame) -> DataFrame:
    return gone.groupBy("key", "text_hash").agg(F.collect_list("line").alias("gone"))


def _open(elements: DataFrame, gone: DataFrame) -> DataFrame:
    """Elements of which a line is left."""
    known = elements.join(_by_document(gone), ["key", "text_hash"], "left")
    left = F.col("gone").isNull() | ~F.array_contains("gone", F.col("at")) | ~F.array_contains("gone", F.col("to"))
    return known.where(left).drop("gone")


def removed_lines(docs: DataFrame, key: str, text: str, groups: int | None = GROUPS) -> DataFrame:
    """(key, text_hash, gone): numbers of the lines to remove, for each document that loses any.

    groups: first holders that a shared line has in the first round; None aligns each document with all
    earlier holders of its shared lines at once, which takes all pairs of a common line and removes the same.
    """
    prepared(docs.sparkSession)
    stripped = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(docs[key].alias("key"), F.xxhash64(text).alias("text_hash"), stripped.alias("lines"))
    hashed = F.transform("lines", lambda x: F.when(x == "", F.lit(BLANK).cast("long")).otherwise(F.xxhash64(x)))
    lined = materialize(rows.select("key", "text_hash", hashed.alias("hashes"), F.transform("lines", F.char_length).alias("sizes")).distinct())

    held = lined.select("key", "text_hash", F.explode(_elements("hashes", "sizes")).alias("e")).select("key", "text_hash", F.col("e.x").alias("line"), "e.at", "e.to", "e.able")
    group = F.pmod(F.xxhash64("key"), F.lit(groups or 1))
    firsts = F.array_compact(F.array(*[F.min(F.when(group == g, F.col("key"))) for g in range(groups or 1)]))
    lines = held.groupBy("line").agg(F.min("key").alias("least"), F.max("key").alias("greatest"), firsts.alias("firsts")).where("least < greatest")
    lines = materialize(lines.select("line", "least", "firsts"))  # a table of its own, so that Spark can split a common line's rows in the join
    earlier = F.filter("firsts", lambda f: f < F.col("key")).alias("firsts")
    shared = materialize(held.join(lines, "line").where("least < key").select("key", "text_hash", "line", "at", "to", "able", earlier))
    firsts = lines.select("line", F.col("least").alias("key"))
    if groups is None:
        holders = shared.select("line", "key").unionByName(firsts).distinct().withColumnRenamed("key", "first")
        every = shared.select("key", "text_hash", "line").distinct().join(holders, "line").where("first < key")
        return _by_document(_gone(every.select("key", "text_hash", "first").distinct(), lined))

    pairs = materialize(shared.select("key", "text_hash", F.explode("firsts").alias("first")).distinct())
    gone = materialize(_gone(pairs, lined))
    elements = materialize(_open(shared.where("able").select("key", "text_hash", "line", "at", "to"), gone))
    if elements.isEmpty():
        return _by_document(gone)
    alike = F.xxhash64("hashes").alias("alike")
    own = lined.select("key", "text_hash", alike).join(lined.groupBy(alike).agg(F.min("key").alias("key")), ["key", "alike"]).select("key", "text_hash")
    holders = shared.join(elements.select("line").distinct(), "line", "left_semi").join(own, ["key", "text_hash"], "left_semi").select("line", "key")
    holders = materialize(holders.unionByName(firsts.join(elements.select("line").distinct(), "line", "left_semi")).distinct())
    counts = materialize(holders.groupBy("line").agg(F.count(F.lit(1)).alias("n")))
    while not elements.isEmpty():
        groups *= GROWTH
        wanted = counts.join(elements.select("line").distinct(), "line", "left_semi")
        group = F.when(F.col("n") > groups, F.pmod(F.xxhash64("key", F.lit(groups)), F.lit(groups)))
        alone = F.when(F.col("n") <= groups, F.col("key"))  # these lines have had all of their holders then
        further = materialize(holders.join(wanted, "line").groupBy("line", group.alias("group"), alone.alias("alone")).agg(F.min("key").alias("first")).select("line", "first"))
        met = elements.select("key", "text_hash", "line").distinct().join(further, "line").where("first < key")
        new = materialize(met.select("key", "text_hash", "first").distinct().join(pairs, ["key", "text_hash", "first"], "left_anti"))
        more = materialize(_gone(new, lined).join(gone, ["key", "text_hash", "line"], "left_anti"))
        gone, pairs = gone.unionByName(more), pairs.unionByName(new)
        unfinished = elements.join(counts.where(F.col("n") > groups).select("line"), "line", "left_semi")
        elements = materialize(_open(unfinished, gone))
    return _by_document(gone)


def without_common_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A struct ``row`` of the columns but the text, n_lines, n_removed, and the text that is left."""
    gone = removed_lines(docs, key, text).withColumnsRenamed({"key": "__key", "text_hash": "__hash", "gone": "__gone"})
    rest = F.struct(*[c for c in docs.columns if c != text])
    rows = docs.select(docs[key].alias("key"), F.xxhash64(text).alias("text_hash"), docs[text].alias("text"), rest.alias("row"))
    found = rows.join(gone, (F.col("key") == F.col("__key")) & (F.col("text_hash") == F.col("__hash")), "left")
    lines = F.split("text", "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__gone", i)), "\n")
    return found.select(
        "row",
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left).alias("text"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text without the blocks that an earlier document has."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return without_common_lines(docs, "doc_id", "text").select("row.doc_id", "n_lines", "n_removed", "text")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with common blocks of lines cut out of the text; documents of which nothing is left go."""
    cut = without_common_lines(docs, "doc_id", "text").where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    columns = [F.col(c) if c == "text" else F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias(c) if c == "n_chars" else F.col(f"row.{c}") for c in docs.columns]
    return cut.select(*columns)
