"""Sampled segmentations over a SentencePiece vocabulary, and lossless decoding.

The lattice of a text has an edge for each vocabulary piece that matches at a place, and for each
character without a piece of its own an edge that stands for its UTF-8 byte pieces. An edge weighs
``theta`` times the log weight of its piece, which falls with the piece's rank in the vocabulary.
A forward pass sums the weights of all ways to each place; sampling then goes backward from the end
and picks each last piece in proportion to the sums. The random numbers come from the row's key,
the seed and the place, so a row has the same sample in any partition and any run.

No piece has a space after another character, so the lattice falls apart at the start of each run
of spaces, and the stretches in between are sampled on their own: the forward sums are computed
once for each distinct stretch of a batch, and all rows' draws are made together.

A null text gives null; an empty one the pieces of the leading space alone. A null key is a key of its
own (that of 0), and rows that share key and text share their sample. Lattices are made for stretches
of up to about ``CHARS`` characters at a time, so long texts take no more memory than short ones; only
a single stretch without a space is taken whole. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from evenkeel.llm.common import documents, prepared
from evenkeel.llm.words import Spans, mix, spans

SPACE_MARK = "▁"
FALLBACK = 1 << 24
TABLE_BITS = 20
COMMON_ROWS = 3000
CHARS = 1_000_000
_loaded: dict[str, Vocabulary] = {}
_common: dict[tuple[str, float], Common] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces by hash, their log weights, and byte pieces; the space mark is read as a space."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.path = path
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes: list[bytes] = []
        pieces, ids, ranks = [], [], []
        for i in range(len(sp)):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
                continue
            if sp.is_control(i) or sp.is_unknown(i):
                self.bytes.append(b"")
                continue
            text = piece.replace(SPACE_MARK, " ")
            if re.search("[^ ] ", text):
                raise ValueError(f"the piece {piece!r} has a space inside")
            self.bytes.append(text.encode())
            pieces.append(text)
            ids.append(i)
            ranks.append(max(0.0, -sp.get_score(i)))
        prefixes = {p[:n]: -1 for p in pieces for n in range(1, len(p))} | {p: i for i, p in enumerate(pieces)}
        points = np.frombuffer("".join(prefixes).encode("utf-32-le"), "<u4").astype(np.uint64)
        ends = np.cumsum([len(p) for p in prefixes])
        self.longest = max(map(len, pieces))
        self.hash = spans(mix(points + np.uint64(1)), np.concatenate([[0], ends[:-1]]), ends)
        number = np.fromiter(prefixes.values(), np.int64, len(prefixes))
        self.ids = np.where(number >= 0, np.array(ids)[number], -1)
        self.weight = np.where(number >= 0, -np.log(np.array(ranks) + 2)[number], 0.0)
        self.byte_weight = -np.log(len(sp))
        self.tables = []
        left = np.arange(len(prefixes))
        for shift in (64 - TABLE_BITS, 64 - 2 * TABLE_BITS, 4):
            table = np.full(1 << TABLE_BITS, -1, np.int32)
            slot = self.slot(self.hash[left], shift)
            table[slot] = left
            left = left[table[slot] != left]
            self.tables.append((shift, table))
        if len(left):
            raise ValueError("vocabulary hashes collide")
        self.reach = {c for p in pieces if len(p) > 1 for c in p if c != " "}
        joined = "".join(map(re.escape, sorted(self.reach)))
        self.stretch = re.compile(f" +[{joined}]*|[{joined}]+|.", re.DOTALL)

    @staticmethod
    def slot(h: np.ndarray, shift: int) -> np.ndarray:
        return ((h >> np.uint64(shift)) & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the beginning of a piece with this hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        rest = np.arange(len(h))
        for shift, table in self.tables:
            n = table[self.slot(h[rest], shift)]
            rest, n = rest[n >= 0], n[n >= 0]
            same = self.hash[n] == h[rest]
            out[rest[same]] = n[same]
            rest = rest[~same]  # its place is another's, so it may stand in the next table
            if not len(rest):
                break
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


class Lattices:
    """Backward edges of the lattices of distinct stretches, with cumulative chances by state.

    Stretches are numbered by falling length, so those that reach place n are the first ones; the
    state of stretch w at its place n (from 1 on) is base[n] + w. Edges of a state stand together;
    ``key`` is the state times 2**32 plus the cumulative chance of its edges in 2**32nds.
    """

    def __init__(self, v: Vocabulary, stretches: list[str], theta: float):
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        ranked = np.argsort(-sizes, kind="stable")
        self.rank = np.empty(len(ranked), np.int64)
        self.rank[ranked] = np.arange(len(ranked))
        self.length = sizes[ranked]
        longest = int(self.length[0]) if len(ranked) else 0
        reach = np.searchsorted(-self.length, -np.arange(1, longest + 1), side="right")  # stretches of at least 1, 2, ... letters
        self.base = np.concatenate([[0, 0], np.cumsum(reach)])

        points = np.frombuffer("".join([stretches[i] for i in ranked.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4")
        first = np.cumsum(self.length) - self.length
        owner = np.repeat(np.arange(len(ranked)), self.length)
        at = np.arange(len(points))
        end_of = (first + self.length)[owner]
        span = Spans(mix(points.astype(np.uint64) + np.uint64(1)))
        begin, size, piece, weight = [], [], [], []
        for n in range(1, v.longest + 1):
            at = at[at + n <= end_of[at]]
            if not len(at):
                break
            found = v.find(span(at, at + n))
            begun = np.flatnonzero(found >= 0)
            hit = begun[v.ids[found[begun]] >= 0]
            begin.append(at[hit])
            piece.append(v.ids[found[hit]])
            weight.append(theta * v.weight[found[hit]])
            size.append(np.full(len(hit), n, np.int16))
            if n == 1:
                bare = np.delete(at, hit)
                begin.append(bare)
                size.append(np.ones(len(bare), np.int16))
                piece.append(FALLBACK + points[bare].astype(np.int64))
                utf8 = 1 + (points[bare] >= 0x80) + (points[bare] >= 0x800) + (points[bare] >= 0x10000)
                weight.append(theta * v.byte_weight * utf8)
            at = at[begun]
        begin, size, piece, weight = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begin, size, piece, weight))
        stretch = owner[begin]
        place = begin - first[stretch] + size
        state = self.base[place] + stretch
        order = np.argsort(state, kind="stable")
        state, stretch, place, self.size, self.piece, log_in = state[order], stretch[order], place[order], size[order], piece[order], weight[order]

        forward = np.zeros(int(self.base[-1]))
        before = self.base[place - self.size] + stretch if len(state) else state
        inner = place > self.size
        cuts = np.searchsorted(state, self.base[1:])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # all edges that end at place 1, 2, ...
            if a == b:
                continue
            part = log_in[a:b]
            np.add(part, forward[before[a:b]], out=part, where=inner[a:b])
            head = np.flatnonzero(np.diff(state[a:b], prepend=-1))
            top = np.maximum.reduceat(part, head)
            spread = np.repeat(top, np.diff(np.append(head, b - a)))
            forward[state[a:b][head]] = top + np.log(np.add.reduceat(np.exp(part - spread), head))
        chance = np.exp(log_in - forward[state]) if len(state) else log_in
        # In whole numbers, so that the sums within a state don't depend on what else is in the batch.
        head = np.flatnonzero(np.diff(state, prepend=-1))
        share = np.floor(chance * 2.0**32).astype(np.int64)
        if len(state):
            total = np.cumsum(share)
            share = total - np.repeat(total[head] - share[head], np.diff(np.append(head, len(state))))
            share[np.append(head[1:], len(state)) - 1] = 1 << 32
        self.key = (state << 32) + share

    def sample(self, stretch: np.ndarray, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each occurrence of a stretch, one after the other; and how many each has.

        stream: a number for each occurrence from which its random numbers follow.
        """
        stretch = self.rank[stretch]
        live, left = np.arange(len(stretch)), self.length[stretch].copy()
        steps, step = [], 0
        while len(live):
            draw = (mix(stream[live] + np.uint64(step * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(32)).astype(np.int64)
            edge = np.searchsorted(self.key, (self.base[left] + stretch[live] << 32) + draw, side="right")
            steps.append((live, self.piece[edge]))
            left = left - self.size[edge]
            live, left, step = live[left > 0], left[left > 0], step + 1
        counts = np.zeros(len(stretch), np.int64)
        for live, _ in steps:
            counts[live] += 1
        ends = np.cumsum(counts)
        out = np.zeros(ends[-1] if len(ends) else 0, np.int64)
        for n, (live, pieces) in enumerate(steps):
            out[ends[live] - 1 - n] = pieces
        return out, counts


def expand_bytes(v: Vocabulary, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace fallback edges by their byte pieces; and how many pieces each edge became."""
    bare = np.flatnonzero(pieces >= FALLBACK)
    sizes = np.ones(len(pieces), np.int64)
    coded = {c: chr(c).encode("utf-8", "surrogatepass") for c in np.unique(pieces[bare] - FALLBACK).tolist()}
    for c, raw in coded.items():
        sizes[pieces == FALLBACK + c] = len(raw)
    start = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.int32)
    whole = pieces < FALLBACK
    out[start[whole]] = pieces[whole]
    for c, raw in coded.items():
        at = start[bare[pieces[bare] == FALLBACK + c]]
        for k, byte in enumerate(raw):
            out[at + k] = v.byte_ids[byte]
    return out, sizes


class Common:
    """Lattices of the stretches that came at least twice among a worker's first rows, kept for all later ones.

    A stretch's samples are the same whichever lattices they come from.
    """

    def __init__(self) -> None:
        self.counts: Counter[str] = Counter()
        self.rows = 0
        self.numbers: dict[str, int] = {}
        self.lattices: Lattices | None = None

    def learn(self, v: Vocabulary, theta: float, found: list[list[str]]) -> None:
        if self.lattices is None:
            for f in found:
                self.counts.update(f)
            self.rows += len(found)
            if self.rows >= COMMON_ROWS:
                self.numbers = {s: n for n, s in enumerate(s for s, k in self.counts.items() if k > 1)}
                self.lattices = Lattices(v, list(self.numbers), theta)
                self.counts.clear()


def sample_pieces(v: Vocabulary, texts: list[str | None], keys: list[int | None], seed: int, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and how many each has."""
    common = _common.setdefault((v.path, theta), Common())
    found = [v.stretch.findall(" " + t) if t is not None else [] for t in texts]
    key = mix(np.array([(k or 0) & (2**64 - 1) for k in keys], np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    ids, totals = [], np.zeros(len(texts), np.int64)
    for part in _parts(found):
        some, counts = _sample_stretches(v, theta, common, key, part)
        ids.append(some)
        np.add.at(totals, [row for row, _, _ in part], counts)
    common.learn(v, theta, found)
    return np.concatenate(ids) if ids else np.zeros(0, np.int32), totals


def _parts(found: list[list[str]]) -> Iterator[list[tuple[int, int, list[str]]]]:
    """Runs of (row, number of the first stretch, stretches) of about CHARS characters."""
    part, size = [], 0
    for row, stretches in enumerate(found):
        at = 0
        for i, s in enumerate(stretches):
            if size + len(s) > CHARS and size:
                part.append((row, at, stretches[at:i]))
                yield part
                part, size, at = [], 0, i
            size += len(s)
        part.append((row, at, stretches[at:]))
    if part:
        yield part


def _sample_stretches(v: Vocabulary, theta: float, common: Common, key: np.ndarray, part: list[tuple[int, int, list[str]]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the stretches one after the other, and how many each entry of ``part`` has."""
    known, n_known, numbers = common.numbers, len(common.numbers), {}
    counts = np.fromiter((len(s) for _, _, s in part), np.int64, len(part))
    number = lambda s: known[s] if s in known else n_known + numbers.setdefault(s, len(numbers))
    stretch = np.fromiter((number(x) for _, _, s in part for x in s), np.int64, int(counts.sum()))
    entry = np.repeat(np.arange(len(part)), counts)
    nth = np.arange(len(entry)) - np.repeat(np.cumsum(counts) - counts, counts) + np.array([at for _, at, _ in part], np.int64)[entry]
    stream = mix(key[np.array([r for r, _, _ in part], np.int64)[entry]] + nth.astype(np.uint64))

    old = np.flatnonzero(stretch < n_known)
    new = np.flatnonzero(stretch >= n_known)
    parts = [(new, *Lattices(v, list(numbers), theta).sample(stretch[new] - n_known, stream[new]))]
    if len(old):
        parts.append((old, *common.lattices.sample(stretch[old], stream[old])))
    per_stretch = np.zeros(len(stretch), np.int64)
    for at, _, sizes in parts:
        per_stretch[at] = sizes
    start = np.cumsum(per_stretch) - per_stretch
    pieces = np.zeros(int(per_stretch.sum()), np.int64)
    for at, found_pieces, sizes in parts:
        pieces[np.repeat(start[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(found_pieces))] = found_pieces
    ids, per_edge = expand_bytes(v, pieces)
    edge_entry = np.repeat(entry, per_stretch)
    return ids, np.bincount(edge_entry, weights=per_edge, minlength=len(part)).astype(np.int64)


def sampled_encoding(df: DataFrame, key: str, text: str, model: str | None = None, seed: int = 1, theta: float = 2.0, rows: int = 1000) -> DataFrame:
    """key, ids, n_pieces, decoded_crc32 and lossless (the ids decode to the text) for each row."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                ids, counts = sample_pieces(v, texts, keys, seed, theta)
                ends = np.concatenate([[0], np.cumsum(counts)])
                crc, same = [], []
                for n, t in enumerate(texts):
                    back = v.decode(ids[ends[n] : ends[n + 1]].tolist()) if t is not None else None
                    same.append(back == t)
                    crc.append(None if back is None else zlib.crc32(back.encode("utf-8", "surrogatepass")))
                null = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids), mask=null)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), lists, pa.array(counts), pa.array(crc, pa.int64()), pa.array(same)], ["key", "ids", "n_pieces", "decoded_crc32", "lossless"]
                )

    prepared(df.sparkSession)
    out = df.select(df[key].cast("long").alias("key"), df[text].alias("text"))
    out = out.mapInArrow(run, "key long, ids array<int>, n_pieces long, decoded_crc32 long, lossless boolean")
    return out.withColumnRenamed("key", key)


def op3_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_encoding(documents(spark, sf_dir), "doc_id", "text")
