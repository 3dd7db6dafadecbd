"""Removal of passages that an earlier document already has, located by Aho-Corasick automata.

A passage is any run of ``WINDOW`` consecutive words. Documents are dealt into blocks of a few
megabytes by a hash of their key, and every step works on (something, block) rows, of which even the
most common passage has at most one for each block:

1. Each block lists the anchors of its documents, the least hash of the word 5-grams of each window.
   Equal windows have equal anchors, so a window can recur only if its anchor does.
2. Blocks hash those windows whose anchor recurs. The least document of each window hash is where
   the passage comes from; the blocks that hold it later need that document's passages.
3. Each block compiles the anchor phrases of the passages it needs into its own automaton, streams
   all its documents through it, and grows each occurrence word by word along the passage. Grown
   stretches of WINDOW words and more are marked if the passage's document is earlier.

Hashes only choose what to compile; the words themselves decide. The automata are sharded by block,
so their size follows the block and not the corpus.

A null text has no words. Rows with a null key are nobody's source and count as later than all
others. Rows with equal keys are never each other's source. A document with fewer than WINDOW words
keeps them all. Repeated rows are documents of one key. A task holds a block's texts whole. An empty
table gives no rows; other columns go through in a struct, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm.common import documents, prepared
from evenkeel.llm.words import Words, chunked

WINDOW, GRAM = 13, 5
BLOCK_BYTES = 4 << 20
BLOCKS_PER_PARTITION = 32
#: Null keys are dealt as numbers from here on.
NO_KEY = 2**63 - 1 - (1 << 20)
_word = re.compile(rb"[^\x20\x09-\x0D]+")


def _keys(table: pa.Table) -> np.ndarray:
    return table.column("key").to_numpy().astype(np.int64)


def _texts(table: pa.Table) -> list[bytes | None]:
    return table.column("text").to_pylist()


def _windows(table: pa.Table) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: index of the first text, words, text, anchor and start of each window."""
    for at, texts in chunked(_texts(table)):
        words = Words(texts)
        grams, _ = words.windows(GRAM)
        n = len(words.hash) - WINDOW + 1
        if n <= 0:
            continue
        least = grams[:n].copy()
        for k in range(1, WINDOW - GRAM + 1):
            np.minimum(least, grams[k : k + n], out=least)
        owner = np.repeat(np.arange(len(texts)), np.diff(words.first))
        start = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
        yield at, words, owner[start], least[start], start


def _span_of_keys(values: list[np.ndarray], keys: list[np.ndarray], name: str) -> pa.Table:
    """Distinct values, each with its least key and once more with its greatest if that is another."""
    value, key = np.concatenate(values or [np.zeros(0, np.uint64)]), np.concatenate(keys or [np.zeros(0, np.int64)])
    order = np.argsort(value, kind="stable")
    value, key = value[order], key[order]
    head = np.flatnonzero(np.diff(value, prepend=value[:1] ^ np.uint64(1))) if len(value) else np.zeros(0, np.int64)
    low = np.minimum.reduceat(key, head) if len(head) else key
    high = np.maximum.reduceat(key, head) if len(head) else key
    two = high != low
    value = value[head].view(np.int64)
    return pa.table({name: np.concatenate([value, value[two]]), "key": np.concatenate([low, high[two]])})


def _changes(value: np.ndarray, owner: np.ndarray) -> np.ndarray:
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return keep


def _anchors(table: pa.Table) -> pa.Table:
    values, keys, key = [], [], _keys(table)
    for at, _, owner, anchor, _ in _windows(table):
        new = _changes(anchor, owner)
        values.append(anchor[new])
        keys.append(key[at + owner[new]])
    return _span_of_keys(values, keys, "anchor")


def _recurring(table: pa.Table, anchors: pa.Table) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray]]:
    known = np.sort(anchors.column("anchor").to_numpy().view(np.uint64))
    if not len(known):
        return
    for at, words, owner, anchor, start in _windows(table):
        place = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
        hit = known[place] == anchor
        if hit.any():
            yield at, words, owner[hit], start[hit]


def _window_hashes(table: pa.Table, anchors: pa.Table) -> pa.Table:
    values, keys = [], []
    if table.num_rows:
        key = _keys(table)
        for at, words, owner, start in _recurring(table, anchors):
            values.append(words.windows(WINDOW)[0][start])
            keys.append(key[at + owner])
    return _span_of_keys(values, keys, "hash")


def _passages(table: pa.Table, anchors: pa.Table) -> pa.Table:
    """The passages of each document, as the words of each run of windows whose anchors recur."""
    sources, out = [], []
    if table.num_rows:
        key = _keys(table)
        for at, words, owner, start in _recurring(table, anchors):
            head = np.flatnonzero((np.diff(start, prepend=-2) != 1) | (np.diff(owner, prepend=-1) != 0))
            tail = np.append(head[1:], len(start)) - 1
            for o, a, b in zip(owner[head].tolist(), start[head].tolist(), start[tail].tolist(), strict=True):
                sources.append(int(key[at + o]))
                out.append(words.data[words.start[a] : words.end[b + WINDOW - 1]])
    return pa.table({"source": pa.array(sources, pa.int64()), "passage": pa.array(out, pa.binary())})


def _anchor_places(words: Words, wanted: np.ndarray) -> np.ndarray:
    """Where the anchors of the wanted windows (by start) stand; of equal hashes the first counts."""
    grams, _ = words.windows(GRAM)
    places = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1)[wanted]
    return wanted + places.argmin(axis=1)


class Locator:
    """An automaton over the anchor phrases of passages.

    Only windows whose hash is in ``present`` (sorted) count, each from its least source. A word is
    two letters, so that no node has many children.
    """

    UNKNOWN = "\u3fff\u3fff"

    def __init__(self, sources: list[int], passages: list[bytes], present: np.ndarray):
        import ahocorasick

        self.letters: dict[bytes, str] = {}
        self.passages: list[tuple[int, np.ndarray]] = []
        self.entries: list[list[tuple[int, int]]] = []
        order = sorted(range(len(sources)), key=sources.__getitem__)
        hashes, at_passage, at_start = [], [], []
        runs = list(chunked([passages[i] for i in order]))
        for n, (at, run) in enumerate(runs):
            words = Words(run)
            found, inside = words.windows(WINDOW)
            if len(found) and len(present):
                place = np.minimum(np.searchsorted(present, found), len(present) - 1)
                wanted = np.flatnonzero(inside & (present[place] == found))
                hashes.append(found[wanted])
                at_passage.append(np.full(len(wanted), n))
                at_start.append(wanted)
        self.any = any(map(len, hashes))
        if not self.any:
            return
        _, first = np.unique(np.concatenate(hashes), return_index=True)  # passages stand in the order of their sources
        run_of, start = np.concatenate(at_passage)[first], np.concatenate(at_start)[first]
        numbers: dict[str, int] = {}
        for n in np.unique(run_of).tolist():
            at, run = runs[n]
            words = Words(run)
            wanted = np.sort(start[run_of == n])
            places = np.unique(_anchor_places(words, wanted))
            owner = np.searchsorted(words.first, places, side="right") - 1
            for o in np.unique(owner).tolist():
                text = self.spell(run[o].split(), grow=True)
                number = len(self.passages)
                self.passages.append((sources[order[at + o]], self.codes(text)))
                for p in (places[owner == o] - words.first[o]).tolist():
                    key = text[2 * p : 2 * (p + GRAM)]
                    if key not in numbers:
                        numbers[key] = len(self.entries)
                        self.entries.append([])
                    self.entries[numbers[key]].append((number, p))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for key, number in numbers.items():
            self.automaton.add_word(key, number)
        self.automaton.make_automaton()

    def spell(self, words: list[bytes], grow: bool = False) -> str:
        letters = self.letters
        if grow:
            for w in words:
                if w not in letters:
                    n = len(letters)
                    letters[w] = chr(0x100 + n // 512) + chr(0x4000 + n % 512)
            return "".join(map(letters.__getitem__, words))
        return "".join([letters.get(w, self.UNKNOWN) for w in words])

    @staticmethod
    def codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-16-le"), "<u4")

    def removed(self, words: list[bytes], key: int) -> np.ndarray:
        """Which words lie in a passage whose source is before ``key``."""
        out = np.zeros(len(words), bool)
        if not self.any or len(words) < WINDOW:
            return out
        text = self.spell(words)
        codes, grown = None, {}
        for end, number in self.automaton.iter(text):
            at = (end + 1) // 2 - GRAM
            for n, p in self.entries[number]:
                source, passage = self.passages[n]
                if source >= key or source >= NO_KEY or grown.get((n, at - p), -1) >= at:
                    continue
                if codes is None:
                    codes = self.codes(text)
                back = min(at, p)
                length = back + min(len(codes) - at, len(passage) - p)
                differ = np.flatnonzero(codes[at - back : at - back + length] != passage[p - back : p - back + length])
                split = np.searchsorted(differ, back)
                low = differ[split - 1] + 1 if split else 0
                high = differ[split] if split < len(differ) else length
                grown[(n, at - p)] = at - back + high - 1
                if high - low >= WINDOW:
                    out[at - back + low : at - back + high] = True
        return out


def kept_text(raw: bytes, removed: np.ndarray) -> bytes:
    """The stretches of text between removed words, one to a line."""
    at = [m.span() for m in _word.finditer(raw)]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], removed, [True]])))
    return b"\n".join(raw[at[a][0] : at[b - 1][1]] for a, b in zip(edges[0::2], edges[1::2], strict=True))


def _locate(with_text: bool):
    def run(table: pa.Table, passages: pa.Table) -> pa.Table:
        texts, keys = (_texts(table), _keys(table)) if table.num_rows else ([], [])
        present = [w.windows(WINDOW)[0] for _, run in chunked(texts) for w in [Words(run)]] if passages.num_rows else []
        present = np.unique(np.concatenate(present)) if present else np.zeros(0, np.uint64)
        locator = Locator(passages.column("source").to_pylist(), passages.column("passage").to_pylist(), present)
        sizes, gone, digests, kept = [], [], [], []
        for raw, key in zip(texts, keys, strict=True):
            words = (raw or b"").split()
            removed = locator.removed(words, int(key))
            n = int(removed.sum())
            sizes.append(len(words))
            gone.append(n)
            if with_text:
                kept.append(kept_text(raw, removed) if n else raw)
            else:
                left = [w for w, r in zip(words, removed.tolist(), strict=True) if not r] if n else words
                digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
        columns = {"row": table.column("row"), "n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(gone, pa.int64())}
        last = {"kept": pa.array(kept, pa.binary())} if with_text else {"kept_sha256": pa.array(digests, pa.string())}
        return pa.table(columns | last)

    return run


def remove_repeats(docs: DataFrame, key: str, text: str, with_text: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A struct ``row`` of the columns but the text, n_words, n_removed, and kept (the text that is left) or kept_sha256."""
    spark = prepared(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text))).head()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_blocks // BLOCKS_PER_PARTITION))
    rest = [c for c in docs.columns if c != text]
    block_of = lambda c: F.pmod(F.xxhash64(c), F.lit(n_blocks))
    number = F.coalesce(docs[key].cast("long"), F.lit(NO_KEY) + F.pmod(F.xxhash64(text), F.lit(1 << 20)))
    dealt = docs.select(number.alias("key"), docs[text].cast("binary").alias("text"), F.struct(*rest).alias("row"))
    dealt = dealt.select(block_of("key").alias("block"), "*").repartition(parts, "block")

    anchors = dealt.groupBy("block").applyInArrow(_anchors, "anchor long, key long")
    by_anchor = Window.partitionBy("anchor")
    recurring = (
        anchors.select("anchor", "key", F.min("key").over(by_anchor).alias("first"), F.max("key").over(by_anchor).alias("last"))
        .where("first < last")
        .select(block_of("key").alias("block"), "anchor")
    )
    both = lambda: dealt.groupBy("block").cogroup(recurring.groupBy("block"))
    hashes = both().applyInArrow(_window_hashes, "hash long, key long")
    needs = hashes.select("key", F.min("key").over(Window.partitionBy("hash")).alias("source")).where("source < key")
    needs = needs.where(F.col("source") < NO_KEY).select("source", block_of("key").alias("block")).distinct()
    passages = both().applyInArrow(_passages, "source long, passage binary")
    wanted = needs.join(passages, "source").select("block", "source", "passage")

    last_field = T.StructField("kept", T.BinaryType()) if with_text else T.StructField("kept_sha256", T.StringType())
    schema = T.StructType([dealt.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), last_field])
    return dealt.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(_locate(with_text), schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return remove_repeats(docs, "doc_id", "text", with_text=False).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13) t),
source AS (SELECT s, min(doc_id) AS source FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN source ON win.s = source.s CROSS JOIN (SELECT unnest(range(0, 13)) AS k) ks WHERE source < doc_id),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.p) AS text FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p WHERE gone.p IS NULL GROUP BY word.doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN removed ON d.doc_id = removed.doc_id
"""


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of the text; documents of which nothing is left go."""
    cut = remove_repeats(docs, "doc_id", "text").where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.col("kept").cast("string")
    columns = [text.alias(c) if c == "text" else F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias(c) if c == "n_chars" else F.col(f"row.{c}") for c in docs.columns]
    return cut.select(*columns)
