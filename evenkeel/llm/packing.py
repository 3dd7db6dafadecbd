"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

1. Tokenise and cut (Arrow batches): a row for each piece, without its ids.
2. Supersteps by classes of falling length. Pieces between capacity/(k+1) and capacity/k, of which a
   sequence holds k at most, are a class for each k up to 15; below, a class ends at two thirds of its start.
3. In a superstep the class's pieces and the gaps of the sequences so far are sorted by size. A gap
   has as many slots as the class's longest piece surely fits in, at least one. All pieces sweep the
   slots at once: each takes its successor, the least slot that holds it. Where several want the same
   slot, rank decides: a slot adds one to the height of the sorted line and a piece takes one off,
   and a piece's slot is the last before it on its own height. That is what longest-first best fit gives.
4. Pieces that no slot is left for open new sequences, k neighbours each. Offsets follow within a
   sequence, gaps shrink, and the next superstep sees them so, until no class is left.

Pieces and gaps are tables; every step is a window over a bounded part of them: a size's rows are
split into buckets of about ``BUCKET_ROWS`` by hash, a height has at most two rows for each size, a
sequence at most ``capacity`` pieces. A line of no more than ``BUCKET_ROWS`` rows in all is one such part,
so that its superstep needs neither counts nor broadcasts: Spark keeps a thread a minute for each shuffle
and broadcast, and small supersteps follow each other fast. The number of supersteps follows the
capacity, not the corpus. The driver sees one row for each class.

A null text is an empty document: its one piece is the final id. Rows with equal keys, and rows with
a null key, are documents of their own; who of equally long pieces gets which place follows the order
of the rows. A task tokenises a text whole. An empty table gives no rows; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import documents, prepared
from evenkeel.session import discard, materialize

CAPACITY = 2048
END_ID = b"\0\0\0\0"
CACHED_WORDS = 500_000
letters = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
_words: dict[str, WordIds] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The parts of a tokenizer file that the short cuts of ``WordIds`` rest on (fixed values).
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


class WordIds(dict):
    """Ids of a word between ASCII white space, as little-endian bytes; filled as words come.

    Such a tokenizer drops white space and never joins what stands on its two sides, so a text's ids
    are its words' ids one after the other. A text with a special token's opening is tokenised whole.
    Words of Latin letters go to the tokenizer's model at once, as there is nothing to normalise but
    the case; a tail of punctuation is a word of its own to the tokenizer. A file with another
    normalizer or pre-tokenizer is used without these short cuts, a whole text at a time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        parts = json.loads(self.tokenizer.to_str())
        normalizer, pre = ((parts[x] or {}).get(y) for x, y in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        specials = all(t["content"].startswith("<|") for t in parts["added_tokens"])
        self.by_word = normalizer == NORMALIZER and pre == PRE_TOKENIZERS and specials and parts["post_processor"] is None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte_letters = {b: b for b in shown} | {b: 256 + n for n, b in enumerate(hidden)}

    def encode(self, raw: bytes) -> bytes:
        return array("I", self.tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        stem = word.rstrip(b".,;:!?")
        if stem != word:
            ids = self[stem] + self[word[len(stem) :]] if is_word(stem) else self.encode(word)
        elif word.isalpha():  # ASCII letters
            lower = word.lower()
            ids = array("I", [t.id for t in self.model.tokenize(lower.decode())]).tobytes() if lower == word else self[lower]
        elif is_word(word):
            spelled = word.decode().lower().encode().decode("latin-1").translate(self.byte_letters)
            ids = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        else:
            ids = self.encode(word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = ids
        return ids

    def text(self, raw: bytes) -> bytes:
        return b"".join(map(self.__getitem__, raw.split())) if self.by_word and b"<|" not in raw else self.encode(raw)


def is_word(stem: bytes) -> bool:
    """Whether it is made of Latin letters only, precomposed and of one lower-case letter each."""
    return stem.isalpha() or bool(letters.fullmatch(stem.decode("utf-8", "replace")))


def word_ids(path: str) -> WordIds:
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document: its ids and a final id 0, cut after each ``capacity`` ids."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path)
        for batch in batches:
            out = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = ids_of.text(raw or b"") + END_ID
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = [x.split()[0] for x in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        ids_of.clear()  # the worker outlives the task and goes on to other stages

    prepared(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, PIECES)


HARMONIC, SHRINK = 15, 1.5
BUCKET_ROWS = 200_000


def classes(capacity: int) -> list[int]:
    """Greatest length of each class, falling; a class ends above the next one's greatest length."""
    tops = [capacity // k for k in range(1, min(HARMONIC, capacity) + 1)]
    while (top := int(tops[-1] / SHRINK if len(tops) > HARMONIC else capacity // (HARMONIC + 1))) >= 1:
        tops.append(top)
    return sorted({*tops, 1}, reverse=True)


def _heights(rows: DataFrame, short: bool = False) -> DataFrame:
    """``rows`` (size, is_piece, id, nth) with ``height``, the number of slots less that of pieces up to each.

    The line runs by falling size, slots before pieces. For a piece it is the height before it, so
    that a piece and the slot it takes have the same. A short line has at most ``BUCKET_ROWS`` rows.
    """
    if short:
        line = Window.orderBy(F.desc("size"), "is_piece", "id", "nth").rowsBetween(Window.unboundedPreceding, 0)
        height = F.sum(F.when(F.col("is_piece"), -1).otherwise(1)).over(line) + F.col("is_piece").cast("long")
        return rows.withColumn("height", height)
    sizes = rows.groupBy("size", "is_piece").agg(F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).alias("buckets"))
    dealt = rows.join(F.broadcast(sizes), ["size", "is_piece"]).withColumn("bucket", F.pmod(F.xxhash64("id", "nth"), "buckets")).drop("buckets")
    totals = dealt.groupBy("size", "is_piece", "bucket").agg(F.count(F.lit(1)).alias("n"))
    line = Window.orderBy(F.desc("size"), "is_piece", "bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    step = F.when(F.col("is_piece"), -F.col("n")).otherwise(F.col("n"))
    starts = totals.select("size", "is_piece", "bucket", F.coalesce(F.sum(step).over(line), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("size", "is_piece", "bucket").orderBy("id", "nth"))
    placed = dealt.withColumn("place", place).join(F.broadcast(starts), ["size", "is_piece", "bucket"])
    return placed.withColumn("height", F.when(F.col("is_piece"), F.col("start") - F.col("place") + 1).otherwise(F.col("start") + F.col("place"))).drop("place", "start", "bucket")


def _slots(top: int) -> Column:
    """The number of slots for pieces of up to ``top`` that a gap has."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.col("room") / top))


def _is_short(gaps: DataFrame, n_gaps: int, n_pieces: int, top: int, low: int, capacity: int) -> bool:
    """Whether a class's line has at most ``BUCKET_ROWS`` rows; counted if the greatest number of gaps doesn't tell."""
    if n_pieces + n_gaps * max(1, capacity // top) <= BUCKET_ROWS:
        return True
    return n_pieces <= BUCKET_ROWS and n_pieces + (gaps.where(F.col("room") >= low).agg(F.sum(_slots(top))).head()[0] or 0) <= BUCKET_ROWS


def superstep(pieces: DataFrame, gaps: DataFrame, top: int, low: int, capacity: int, number: int, short: bool = False) -> DataFrame:
    """The pieces (id, length, ...) of one class with sequence_id, offset, and room: that of its sequence before."""
    slots = _slots(top)
    open_gaps = gaps.where(F.col("room") >= low).select(F.floor(F.col("room") / slots).cast("long").alias("size"), F.lit(False).alias("is_piece"), F.col("sequence_id").alias("id"), F.explode(F.sequence(F.lit(1).cast("long"), slots)).alias("nth"), "room")
    rest = F.struct(*pieces.columns).alias("piece")
    rows = pieces.select(F.col("length").alias("size"), F.lit(True).alias("is_piece"), "id", F.lit(0).cast("long").alias("nth"), F.lit(None).cast("long").alias("room"), rest)
    line = _heights(open_gaps.withColumn("piece", F.lit(None).cast(rows.schema["piece"].dataType)).unionByName(rows), short)
    same = Window.partitionBy("height").orderBy(F.desc("size"), "is_piece")
    line = line.withColumn("slot", F.lag(F.when(~F.col("is_piece"), F.struct("id", "room"))).over(same)).where("is_piece")
    first_new = F.col("slot").isNull()
    group = F.when(first_new, F.floor(-F.col("height") / (capacity // top))).otherwise(F.col("slot.id"))
    seated = line.select("piece.*", first_new.alias("new"), group.alias("group"), F.coalesce("slot.room", F.lit(capacity)).cast("long").alias("room"))
    mates = Window.partitionBy("new", "group").orderBy("id")
    before = F.coalesce(F.sum("length").over(mates.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sequence = F.when(F.col("new"), F.lit(number << 44) + F.col("group")).otherwise(F.col("group"))
    return seated.select(*pieces.columns, sequence.alias("sequence_id"), (F.lit(capacity) - F.col("room") + before).alias("offset"), "new", before.alias("before"))


def _gaps_after(gaps: DataFrame | None, placed: DataFrame, capacity: int) -> DataFrame:
    """Rooms once the placed pieces are in; full sequences go."""
    opened = F.when(F.col("new") & (F.col("before") == 0), F.lit(capacity)).otherwise(0)
    change = placed.select("sequence_id", (opened - F.col("length")).cast("long").alias("room"))
    change = change if gaps is None else gaps.unionByName(change)
    return change.groupBy("sequence_id").agg(F.sum("room").alias("room")).where("room > 0")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    columns = pieces.columns
    tops = classes(capacity)
    number = F.size(F.filter(F.array(*map(F.lit, tops)), lambda x: x >= F.col("length")))
    numbered = pieces.select("*", number.alias("class"), F.monotonically_increasing_id().alias("id"))
    pieces = materialize(numbered.hint("rebalance", "class"), "class")
    found = pieces.groupBy("class").agg(F.min("length").alias("low"), F.max("length").alias("top"), F.count(F.lit(1)).alias("n")).collect()  # a row for each class
    gaps, done, most = None, [], 0  # most: at least the number of gaps
    for r in sorted(found, key=lambda r: r["class"]):
        ours = pieces.where(F.col("class") == r["class"]).drop("class")
        if 2 * r["low"] > capacity:  # each has a sequence of its own
            step = ours.select("*", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
            gaps, old = materialize(step.select("sequence_id", (F.lit(capacity) - F.col("length")).cast("long").alias("room")).where("room > 0")), gaps
            done.append(step.select(*columns, "sequence_id", "offset"))
        else:
            now = gaps if gaps is not None else pieces.sparkSession.createDataFrame([], "sequence_id long, room long")
            short = _is_short(now, most, r["n"], r["top"], r["low"], capacity)
            placed = materialize(superstep(ours, now, r["top"], r["low"], capacity, (1 << 18) + r["class"], short))
            gaps, old = materialize(_gaps_after(gaps, placed, capacity)), gaps
            done.append(placed.select(*columns, "sequence_id", "offset"))
        most += r["n"]
        if old is not None:
            discard(old)
    if gaps is None:
        return pieces.select(*columns, F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    discard(gaps)
    return reduce(DataFrame.unionByName, done)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(token_pieces(documents(spark, sf_dir)))
