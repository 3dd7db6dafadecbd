"""The corpus operators against brute force, exact round trips and odd input."""

import bisect
import hashlib
import io
import math
import random
import struct
import tracemalloc
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from evenkeel.llm import fingerprint as FP
from evenkeel.llm import language_id as LI
from evenkeel.llm import line_dedup as LD
from evenkeel.llm import media as M
from evenkeel.llm import near_dedup as ND
from evenkeel.llm import packing as P
from evenkeel.llm import queries
from evenkeel.llm import sentencepiece_sampling as SP
from evenkeel.llm import sharding as SH
from evenkeel.llm import substring_dedup as SD
from evenkeel.llm import url_filter as UF
from evenkeel.llm import words as WORDS
from evenkeel.llm.common import BATCH, prepared
from tests.oracle import duck, rows_of_frame, rows_of_sql

#: Holders from which a line counts as common.
RARE = 64
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(30_000))
ODD = [None, "", " ", "\n\n", "a", "…", "a b c d e f g h i j k l m", "x" * 50_000, LONG, "ÀÉ\u2003b\x1cc \U0001f600 ▁ <|endoftext|>", "1234 !!"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]


def frame(spark, texts, start=0):
    rows = [(start + i, t, "en" if i % 2 else "fr", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    """Odd texts, repeated rows, a null key, and columns named like the operators' own."""
    df = frame(spark, [*ODD, "same text here for all of us to see again and again and again now", "same text here for all of us to see again and again and again now"])
    df = df.unionByName(df.where("doc_id in (4, 6, 8)")).unionByName(frame(spark, ["a b c d e f g h i j k l m", None]).withColumn("doc_id", F.lit(None).cast("long")))
    for c in ("key", "row", "block", "kept", "n_words", "shard", "bucket", "length", "lang_pred", "component_id", "__gone", "hashes", "order"):
        df = df.withColumn(c, F.lit(1))
    return df


# 1


def test_shards_move_only_into_the_new_one_and_follow_weights(spark):
    keys = spark.range(20_000).withColumn("id", F.when(F.col("id") == 7, None).otherwise(F.col("id")))
    found = keys.select("id", SH.rendezvous_shard(F.col("id"), [1, 2, 1]).alias("a"), SH.rendezvous_shard(F.col("id"), [1, 2, 1, 4]).alias("b")).collect()
    assert all(r.b in (r.a, 3) for r in found)
    counts = Counter(r.a for r in found)
    assert abs(counts[1] / 20_000 - 0.5) < 0.02
    assert abs(Counter(r.b for r in found)[3] / 20_000 - 0.5) < 0.02


def test_slots_are_gapless_with_repeated_rows(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (0, None), (1, 5), (0, 1), (0, 2)], "shard int, x int")
    found = defaultdict(list)
    for r in SH.with_slots(df, "shard", "slot", buckets=3).collect():
        found[r.shard].append(r.slot)
    assert {k: sorted(v) for k, v in found.items()} == {0: [0, 1, 2, 3, 4], 1: [0]}
    assert SH.with_slots(df.limit(0), "shard", "slot").count() == 0


def test_shards_of_odd_rows(spark):
    df = odd(spark)
    found = SH.shard_texts(df, "doc_id", "text", 16).collect()
    assert len(found) == df.count()
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == texts
    assert len({r.shard for r in found if r.doc_id is None}) == 1
    assert SH.shard_texts(df.limit(0), "doc_id", "text", 16).count() == 0


def test_op1(spark, sf, docs):
    rows = queries.QUERIES["op1_sharding"](spark, sf).collect()
    for shard in range(16):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    found = {r.doc_id: r for r in rows}
    assert len(found) == len(docs)
    assert all(found[i].size == len(t.encode()) + 1 and found[i].text_crc32 == zlib.crc32(t.encode()) and found[i].grown_shard in (found[i].shard, 16) for i, t in docs)


def shard_by_hand(key, shards):
    """Rendezvous hashing of one key with the hash worked out anew."""
    def score(shard):
        h = xxhash.xxh64(struct.pack("<i", shard), seed=xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()).intdigest()
        return -math.log(((h >> 11) + 0.5) * 2.0**-53)

    return min(range(shards), key=lambda s: (score(s), s))


def test_op1_shards_are_those_of_the_highest_score(spark, sf, docs):
    found = {r.doc_id: (r.shard, r.grown_shard) for r in queries.QUERIES["op1_sharding"](spark, sf).collect()}
    assert found == {i: (shard_by_hand(i, 16), shard_by_hand(i, 17)) for i, _ in docs}


# 2


def test_patience():
    assert LD.patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert LD.patience([5, 1, 5, 2], [1, 5, 2, 5]) == [(1, 0), (2, 1), (3, 2)]
    assert LD.patience([], [1]) == []
    assert LD.patience([7, 7, 7], [7, 7]) == [(0, 0), (1, 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=12), st.lists(st.integers(1, 6), max_size=12))
def test_patience_is_an_alignment(a, b):
    found = LD.patience(a, b)
    assert all(a[i] == b[j] for i, j in found)
    assert all(x < z and y < w for (x, y), (z, w) in zip(found, found[1:], strict=False))


def test_line_dedup_removes_blocks_from_the_later_document(spark):
    a = ["first line that is long enough to count alone", "short", "other", "the end of a"]
    b = ["own words of b", "short", "other", "more of b"]
    c = ["only", "short", "here"]
    df = frame(spark, ["\n".join(x) for x in (a, b, c)] + ["  " + a[0] + "\t\nrest", None, ""])
    kept = {r.row.doc_id: r for r in LD.without_common_lines(df, "doc_id", "text").collect()}
    assert kept[0].text == "\n".join(a)
    assert kept[1].text == "own words of b\nmore of b"
    assert kept[2].text == "\n".join(c)
    assert kept[3].text == "rest"
    assert kept[4].text is None
    assert kept[5].text == ""
    assert [kept[i].n_removed for i in range(6)] == [0, 2, 0, 1, 0, 0]


def test_line_dedup_of_a_large_group_of_copies(spark):
    text = "\n".join(f"line number {i} of the text that all have" for i in range(5))
    df = frame(spark, [f"{text}\nown {i}" for i in range(RARE * 3)])
    found = {r.row.doc_id: r for r in LD.without_common_lines(df, "doc_id", "text").collect()}
    assert found[0].n_removed == 0
    assert all(found[i].text == f"own {i}" for i in range(1, RARE * 3))


def without_lines_of_all_earlier(texts):
    """The texts left when each document is aligned with every earlier one."""
    lines = [t.split("\n") for t in texts]
    marks = [[hash(x.strip()) if x.strip() else LD.BLANK for x in rows] for rows in lines]
    out = []
    for i, rows in enumerate(lines):
        gone = {x for j in range(i) for x in LD.common_blocks(marks[i], marks[j], [len(y.strip()) for y in rows])}
        out.append("\n".join(y for x, y in enumerate(rows) if x not in gone))
    return out


def test_line_dedup_finds_common_blocks_beside_rarer_lines(spark):
    rng = random.Random(2)
    blocks = [f"begin {b}\nend {b}" if b % 2 else f"one line of common block {b} that is long enough" for b in range(6)]
    texts = ["\n".join([f"own {i}", *(blocks[b] for b in sorted(rng.sample(range(6), 3))), f"rare {i // 2}", f"own end {i}"]) for i in range(RARE * 3)]
    holders = Counter(line for t in texts for line in t.split("\n"))
    assert min(holders[b.split("\n")[0]] for b in blocks) > RARE
    found = {r.row.doc_id: r.text for r in LD.without_common_lines(frame(spark, texts), "doc_id", "text").collect()}
    assert [found[i] for i in range(len(texts))] == without_lines_of_all_earlier(texts)


@pytest.mark.parametrize("between", ["\n", "\n\n \n"])
def test_line_dedup_finds_pairs_of_lines_that_stand_alone_in_the_first_documents(spark, between):
    pair = f"x{between}y"
    texts = ["own a\nx\nend a", "own b\ny\nend b", f"own c\n{pair}\nend c", f"own d\n{pair}\nend d", "x", f"{pair}\nz"]
    found = {r.row.doc_id: r.text for r in LD.without_common_lines(frame(spark, texts), "doc_id", "text").collect()}
    assert [found[i] for i in range(len(texts))] == without_lines_of_all_earlier(texts)
    assert (found[2], found[3], found[5]) == (texts[2], "own d\nend d", "z")


def removed_places(texts, left):
    """Number of lines gone from each text, by line."""
    return [Counter(a.split("\n")) - Counter(b.split("\n")) for a, b in zip(texts, left, strict=True)]


def test_op2_against_alignment_with_all_earlier_documents(spark, sf, docs):
    found = {r.doc_id: r for r in queries.QUERIES["op2_line_dedup"](spark, sf).collect()}
    assert len(found) == len(docs)
    assert all(found[i].n_lines == len(t.split("\n")) and found[i].n_removed <= found[i].n_lines for i, t in docs)
    texts = [t for _, t in docs]
    mine, brute = removed_places(texts, [found[i].text for i, _ in docs]), removed_places(texts, without_lines_of_all_earlier(texts))
    assert all(not a - b for a, b in zip(mine, brute, strict=True))
    assert sum(x.total() for x in mine) >= 0.99 * sum(x.total() for x in brute)


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_of_a_table_of_hot_lines(spark, seed):
    """A line in every document, a clause in a third, rare lines, and blocks in any order."""
    rng = random.Random(seed)
    clause = [f"clause {i}" for i in range(10)]
    texts = []
    for i in range(240):
        parts = [["the line that all documents have, without any exception"], [f"own {i}"], [f"rare {rng.randrange(200)}"]]
        parts += [clause] * (rng.random() < 0.3) + [[f"x{rng.randrange(9)}", f"y{rng.randrange(9)}"]]
        rng.shuffle(parts)
        texts.append("\n".join(x for p in parts for x in p))
    found = {r.row.doc_id: r.text for r in LD.without_common_lines(frame(spark, texts), "doc_id", "text").collect()}
    want = without_lines_of_all_earlier(texts)
    left = lambda rows: sum(len(t.split("\n")) for t in rows)
    most, least = left(texts) - left(want), left(texts) - left(found[i] for i in range(len(texts)))
    assert least >= 0.98 * most
    assert all("clause 5" not in found[i] for i in range(len(texts)) if sum("clause 5" in t for t in texts[:i]))


def shuffled_common_lines(n, documents=100):
    """Documents with the same lines in another order each, and a line of their own after each."""
    rng = random.Random(n)
    common = [f"common line number {i} of those that all of the documents have, {i}" for i in range(n)]
    return ["\n".join(x for i, c in enumerate(rng.sample(common, n)) for x in (c, f"own {d} {i}")) for d in range(documents)]


@pytest.mark.parametrize("n", [30, 100, 300])
def test_common_lines_in_any_order_bring_further_partners(spark, n):
    texts = shuffled_common_lines(n)
    found = {r.row.doc_id: r.text for r in LD.without_common_lines(frame(spark, texts), "doc_id", "text").collect()}
    mine, brute = removed_places(texts, [found[i] for i in range(len(texts))]), removed_places(texts, without_lines_of_all_earlier(texts))
    assert all(not a - b for a, b in zip(mine, brute, strict=True))
    assert sum(x.total() for x in mine) >= 0.99 * sum(x.total() for x in brute)


def test_documents_are_aligned_once(spark):
    """A second call for a filter that Spark infers would hold two Python workers a task."""
    lined = spark.createDataFrame([(1, 1, [5, 6, 7], [50, 50, 50]), (2, 2, [5, 6, 8], [50, 50, 50])], "key long, text_hash long, hashes array<long>, sizes array<int>")
    gone = LD._gone(spark.createDataFrame([(2, 2, 1)], "key long, text_hash long, first long"), lined)
    assert gone._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(gone.collect()) == [(2, 2, 0), (2, 2, 1)]


def test_all_earlier_holders_as_partners(spark):
    rng = random.Random(4)
    texts = shuffled_common_lines(30, 40) + ["\n".join(rng.choices(["aa", "bb", "cc", "", "a line that is long enough to count alone, is it"], k=8)) for _ in range(40)]
    left = {r.key: r.gone for r in LD.removed_lines(frame(spark, texts), "doc_id", "text", groups=None).collect()}
    found = ["\n".join(x for n, x in enumerate(t.split("\n")) if n not in left.get(i, ())) for i, t in enumerate(texts)]
    assert found == without_lines_of_all_earlier(texts)


# 3


def test_sampled_pieces_decode_and_repeat(spark, docs):
    df = frame(spark, [*ODD, *[t for _, t in docs[:40]]])
    df = df.unionByName(df.where("doc_id = 6"))
    one = SP.sampled_encoding(df, "doc_id", "text").collect()
    two = SP.sampled_encoding(df.repartition(5), "doc_id", "text", rows=7).collect()
    assert all(r.lossless for r in one)
    assert {(r.doc_id, tuple(r.ids or ())) for r in one} == {(r.doc_id, tuple(r.ids or ())) for r in two}
    other = SP.sampled_encoding(df, "doc_id", "text", seed=2).collect()
    assert {tuple(r.ids or ()) for r in one} != {tuple(r.ids or ()) for r in other}
    assert SP.sampled_encoding(df.limit(0), "doc_id", "text").count() == 0


def test_op3_is_a_round_trip_of_all_documents(spark, sf, docs):
    """The ids of the query decode to each whole text, by a decoder of its own, and are those of the text sampled alone."""
    v = SP.vocabulary(SP.default_model())
    found = {r.doc_id: r for r in queries.QUERIES["op3_sentencepiece_sampling"](spark, sf).collect()}
    assert len(found) == len(docs)
    model = sentencepiece.SentencePieceProcessor(model_file=SP.default_model())
    for i, t in docs:
        r = found[i]
        pieces = [model.id_to_piece(x) for x in r.ids]
        raw = b"".join(bytes([int(p[3:5], 16)]) if model.is_byte(x) else p.encode() for x, p in zip(r.ids, pieces, strict=True))
        assert raw.decode("utf-8", "surrogatepass").replace("\u2581", " ")[1:] == t.replace("\u2581", " ")
        assert (r.n_pieces, r.lossless, r.decoded_crc32) == (len(r.ids), True, zlib.crc32(t.encode()))
    for i, t in docs[:20]:
        assert SP.sample_pieces(v, [t], [i], 1, 2.0)[0].tolist() == found[i].ids


def test_samples_do_not_depend_on_the_parts(docs, monkeypatch):
    v = SP.vocabulary(SP.default_model())
    texts, keys = [None, "", "a b", *(t for _, t in docs[:20]), LONG], list(range(24))
    whole, counts = SP.sample_pieces(v, texts, keys, 1, 2.0)
    for chars in (1, 100, 5000):
        monkeypatch.setattr(SP, "CHARS", chars)
        ids, sizes = SP.sample_pieces(v, texts, keys, 1, 2.0)
        assert np.array_equal(ids, whole) and np.array_equal(sizes, counts)


def test_samples_follow_the_lattice():
    """Frequencies of the segmentations of one stretch against their weights, all enumerated."""
    v = SP.vocabulary(SP.default_model())
    word, theta, n = " than", 1.0, 40_000
    weights = {}

    def walk(at, ids, total):
        if at == len(word):
            weights[tuple(ids)] = np.exp(total)
            return
        for end in range(at + 1, len(word) + 1):
            found = [k for k, b in enumerate(v.bytes) if b == word[at:end].encode() and k > 258]
            if found:
                rank = np.flatnonzero(v.ids == found[0])[0]
                walk(end, [*ids, found[0]], total + theta * v.weight[rank])

    walk(0, [], 0.0)
    ids, counts = SP.sample_pieces(v, [word[1:]] * n, list(range(n)), 3, theta)
    ends = np.cumsum(counts)
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True))
    total = sum(weights.values())
    assert set(seen) <= set(weights)
    assert all(abs(seen[k] / n - w / total) < 0.015 for k, w in weights.items())


# 4


def brute_repeats(rows):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("block_bytes", [2_000, 4 << 20])
def test_substring_dedup(spark, docs, block_bytes):
    rng = random.Random(5)
    pool = ["the", "of", "and", "to"]
    rows = docs + [(10_000 + i, " ".join(rng.choice(pool) for _ in range(60))) for i in range(60)] + [(20_000 + i, "a b " * 20) for i in range(5)]
    rows += [(30_000, None), (30_001, ""), (30_002, "one two three four five six seven eight nine ten eleven twelve thirteen"), (30_003, "x one two three four five six seven eight nine ten eleven twelve thirteen y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.row.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in SD.remove_repeats(df, "doc_id", "text", with_text=False, block_bytes=block_bytes).collect()}
    assert found == brute_repeats(rows)


def test_substring_text_keeps_what_stands_between(spark):
    shared = " ".join(f"s{i}" for i in range(13))
    df = frame(spark, [f"a {shared} b", f"c\td {shared}\ne  f"])
    found = {r.row.doc_id: bytes(r.kept).decode() for r in SD.remove_repeats(df, "doc_id", "text").collect()}
    assert found == {0: f"a {shared} b", 1: "c\td\ne  f"}


# 5


def test_language_id_on_held_out_documents(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    found = queries.QUERIES["op5_language_id"](spark, sf).collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_language_id_without_letters_or_rows(spark):
    df = frame(spark, [None, "", "12 !?", "le chat est la", "the cat is here and there", "²½", "Ⅷ ①", "²½ été"])
    model = LI.train(df.select("doc_id", "text", "lang"), "doc_id")
    found = {r.doc_id: (r.lang_pred, r.score) for r in LI.with_language(df, "text", model).collect()}
    assert [found[i] for i in (0, 1, 2, 5, 6)] == [("und", 0.0)] * 5
    assert found[7][0] in ("en", "fr")
    none = LI.train(df.limit(0).select("doc_id", "text", "lang"), "doc_id")
    assert {r.lang_pred for r in LI.with_language(df, "text", none).collect()} == {"und"}


def test_language_id_decoding_by_hand(spark):
    """Counts, log-odds, margins and losses of one model computed with dictionaries."""
    texts = ["el perro come", "a dog sleeps", "le chien mange", "der hund isst"]
    languages = ["es", "en", "fr", "de"]
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(texts, languages, strict=True))] * 3, "doc_id long, text string, lang string")
    model = LI.train(df, "doc_id")
    assert model.languages == sorted(languages)

    def counts(text):
        raw = " " + " ".join(text.lower().split()) + " "
        return Counter(tuple(raw[i : i + n]) for n in (2, 3, 4) for i in range(len(raw) - n + 1))

    tables = [counts(t) for t in texts]
    per = {x: t for x, t in zip(languages, tables, strict=True)}
    share = {x: {g: (per[x][g] + 0.1) / (sum(per[x].values()) + 0.1 * LI.FEATURES) for t in tables for g in t} for x in languages}
    rest = {x: 0.1 / (sum(per[x].values()) + 0.1 * LI.FEATURES) for x in languages}
    for text in ["el hund", "perro", "the chien", "mange isst dog come"]:
        features = {(g, x) for t in [*texts, text] for found, raw in [(np.concatenate(list(LI.grams(t))), " " + " ".join(t.split()) + " ")] for g, x in zip(found.tolist(), [raw[i : i + n] for n in (2, 3, 4) for i in range(len(raw) - n + 1)], strict=True)}
        assert len(features) == len({g for g, _ in features})  # no two n-grams share a feature here
        loss = dict.fromkeys(languages, 0.0)
        for bit in range(model.codes.shape[1]):
            up = [x for x, c in zip(model.languages, model.codes[:, bit], strict=True) if c > 0]
            down = [x for x in languages if x not in up]
            odds = lambda g: np.log(np.mean([share[x].get(g, rest[x]) for x in up])) - np.log(np.mean([share[x].get(g, rest[x]) for x in down]))  # noqa: B023, E731
            found = counts(text)
            n = sum(found.values())
            margin = sum(k * odds(g) for g, k in found.items()) / n * min(n, 200) ** 0.5
            for x in languages:
                loss[x] += model.weights[bit] * np.log1p(np.exp(-margin if x in up else margin))
        lang, score, _ = model.decide(text)
        assert lang == min(sorted(languages), key=loss.get)
        chances = {x: np.exp(-4 * v) for x, v in loss.items()}
        assert abs(score - chances[lang] / sum(chances.values())) < 1e-4


@pytest.mark.parametrize("stretch", [7, 64])
def test_grams_of_stretches_are_those_of_the_whole(monkeypatch, stretch):
    texts = ["", "a", "  the   cat\n\nsat…on  ", "x" * 200, "é à " * 40]
    whole = [Counter(np.concatenate(list(LI.grams(t)) or [[]]).tolist()) for t in texts]
    monkeypatch.setattr(LI, "STRETCH", stretch)
    assert [Counter(np.concatenate(list(LI.grams(t)) or [[]]).tolist()) for t in texts] == whole


def test_many_languages_and_repeated_keys(spark):
    rows = [(None if i % 3 else 7, f"{chr(97 + i % 26)}{chr(97 + i // 26)}xq " * 8, f"l{i:03}") for i in range(600)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = LI.train(df, "doc_id")
    assert len(model.languages) == 600
    assert sum(model.decide(t)[0] == x for _, t, x in rows[:600]) > 550
    assert LI.train(df.withColumn("lang", F.when(F.col("lang") < "l002", F.col("lang"))), "doc_id").languages == ["l000", "l001"]
    dirty = df.limit(3).withColumn("text", F.lit("12 ½")).withColumn("lang", F.lit("none"))
    assert "none" not in LI.train(df.unionByName(dirty), "doc_id").languages


def test_a_long_text_takes_bounded_memory():
    model = LI.Model(["a", "b"], iter([np.ones(LI.FEATURES), np.arange(LI.FEATURES) + 1.0]))
    text = "quite a long text of words " * 400_000
    tracemalloc.start()
    model.decide(text)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 200e6


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 40])
def test_codewords_differ(n):
    codes = LI.codewords(n)
    assert len({tuple(c) for c in codes.tolist()}) == n
    if n > 7:
        assert min((a != b).sum() for i, a in enumerate(codes) for b in codes[:i]) > 10


# 6


def test_wav_round_trip():
    for n in (0, 1, 63, 64, 1001):
        payload = bytes(i % 256 for i in range(n))
        assert M.from_wav(M.to_wav(payload)) == (payload, M.RATE_IN)


def test_resampling_keeps_a_tone_and_its_level():
    t = np.arange(16_000) / 16_000
    y = M.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32), 16_000, 8_000)
    want = np.sin(2 * np.pi * 440 * np.arange(8_000) / 8_000)
    assert np.abs(y[200:-200] - want[200:-200]).max() < 0.02
    up = M.resample(want.astype(np.float32), 8_000, 12_000)
    assert np.abs(up[200:-200] - np.sin(2 * np.pi * 440 * np.arange(12_000) / 12_000)[200:-200]).max() < 0.02


def test_hysteresis():
    assert M.segments(np.array([0, 2, 1, 1, 0, 1, 2, 2.0]), 2, 1) == [(1, 4), (6, 8)]
    assert M.segments(np.array([0.5, 0.5]), 2, 1) == []


@pytest.mark.parametrize("size", [64, 448, 512, 576, 640, 704, 768, 832])
def test_the_last_bytes_of_a_clip_are_in_the_last_frame(size):
    payload = bytes(random.Random(size).choices(range(256), k=size))
    other = payload[:-64] + bytes(255 - x for x in payload[-64:])
    (a, _), (b, _) = (M.features(x, M.RATE_IN) for x in (payload, other))
    assert len(a) == len(b) == 1 + max(0, -(-(-(-size * 3 // 8) - M.FRAME) // M.HOP))
    assert np.abs(a[-1] - b[-1]).max() > 1e-3
    texts = ["a" * (size - 64) + x * 64 for x in ("b", "~")]
    assert M.clip(texts[0]).feature != M.clip(texts[1]).feature


def plain_mel(samples, rate):
    """Log-mel frames by the definitions: zero-stuffing, convolution, and a discrete Fourier transform term by term."""
    up, down = 3, 8
    assert (M.RATE_OUT / rate, M.RATE_OUT) == (up / down, 6_000)
    x = (np.frombuffer(samples, np.uint8) - 128.0) / 128
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    t = np.arange(-M.TAPS * down, M.TAPS * down + 1)
    h = np.sinc(t / down) * (0.54 + 0.46 * np.cos(np.pi * t / (M.TAPS * down)))
    y = np.convolve(stuffed, h / h.sum() * up)[M.TAPS * down :][: len(stuffed)][::down]
    n = 1 + max(0, -(-(len(y) - 256) // 128))
    y = np.concatenate([y, np.zeros(256 + (n - 1) * 128 - len(y))])
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 255)
    terms = np.exp(-2j * np.pi * np.outer(np.arange(256), np.arange(129)) / 256)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, 2595 * np.log10(1 + 3000 / 700), 18)]
    out = []
    for i in range(n):
        power = np.abs((y[i * 128 : i * 128 + 256] * w) @ terms) ** 2
        f = np.arange(129) * 6000 / 256
        out.append([np.log((power * np.clip(np.minimum((f - a) / (b - a), (c - f) / (c - b)), 0, None)).sum() + 1e-6) for a, b, c in zip(edges, edges[1:], edges[2:], strict=False)])
    return np.array(out)


def test_op6(spark, sf, docs):
    found = {r.doc_id: r for r in queries.QUERIES["op6_audio_features"](spark, sf).collect()}
    assert len(found) == len(docs)
    for n, (i, t) in enumerate(docs):
        raw = t.encode()
        padded = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        with io.BytesIO() as file:
            with wave.open(file, "wb") as w:
                w.setparams((1, 1, 16_000, len(padded), "NONE", ""))
                w.writeframes(padded)
            media = file.getvalue()
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        duration = len(padded) / 16_000
        spans = [(x.start_s, x.end_s) for x in r.tensors]
        assert r.tensor_shape == [32, 16] and {len(x.mel) for x in r.tensors} == {512}
        assert r.duration_s == duration and all(a < b <= duration for a, b in spans) and spans[-1][1] == duration
        assert all(x.start_s < x.end_s <= duration for x in r.loud_spans)
        if n < 40:
            mel = plain_mel(padded, 16_000)
            assert r.n_frames == len(mel) and len(spans) == -(-len(mel) // 32)
            stored = np.concatenate([np.array(x.mel).reshape(32, 16) for x in r.tensors])
            assert np.abs(stored[: len(mel)] - mel).max() < 0.02
            assert np.allclose(stored[len(mel) :], np.log(1e-6), atol=1e-4)
            steps = np.concatenate([mel.mean(axis=0), mel.std(axis=0)]) * 16
            assert np.abs(np.frombuffer(bytes.fromhex(r.feature), "<i2") - steps).max() < 1
    assert M.text_payload(None) == (b"\0" * 64, 0)


def test_tensors_have_a_fixed_shape(spark, docs):
    df = frame(spark, [docs[0][1], "", None, "x" * 20_000, ""])
    rows = M.audio_columns(df.withColumn("media", F.lit(1)), "text").toArrow()
    assert rows.num_rows == 5
    array = M.as_fixed_shape(pa.array([x for r in rows["tensors"].to_pylist() for t in r for x in t["mel"]], pa.float32()))
    assert isinstance(array, pa.FixedShapeTensorArray)
    assert array.to_numpy_ndarray().shape == (sum(map(len, rows["tensors"].to_pylist())), M.TENSOR_FRAMES, M.MELS)
    by_id = {r["doc_id"]: r for r in rows.to_pylist()}
    assert {k: v for k, v in by_id[1].items() if k not in ("doc_id", "lang")} == {k: v for k, v in by_id[4].items() if k not in ("doc_id", "lang")}
    assert by_id[2]["media"] == by_id[1]["media"] and len(by_id[1]["media"]) == 64 + M.HEADER.size


# 7


def test_word_ids_are_the_tokenizers(docs):
    ids = P.word_ids(P.default_tokenizer())
    for text in [*(t for t in ODD if t), *(t for _, t in docs[:50]), "don't I'LL 'sx a'b", "ǅ İstanbul ŉ ſ Ÿ", "J̌ áb.́ été. «où» … x…."]:
        want = np.array(ids.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert ids.text(text.encode()) == want


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_word_ids_of_any_text(text):
    ids = P.word_ids(P.default_tokenizer())
    assert ids.text(text.encode()) == np.array(ids.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_another_tokenizer_is_used_as_it_is(docs):
    import public_tokenizers

    ids = P.word_ids(public_tokenizers.path("byte_bpe_50k.json"))
    assert not ids.by_word
    for _, text in docs[:5]:
        assert ids.text(text.encode()) == np.array(ids.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def best_fit_decreasing(lengths, capacity):
    gaps, opened = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, length)
        if at == len(gaps):
            opened, room = opened + 1, capacity
        else:
            room = gaps.pop(at)
        if room > length:
            bisect.insort(gaps, room - length)
    return opened


def sequences(rows, capacity):
    """Number of sequences, all of them without gaps or overlaps."""
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


def test_tasks_leave_no_words_in_their_workers(spark):
    P.token_pieces(frame(spark, [f"word{i} other{i}" for i in range(500)])).collect()

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, P._words.values()))], pa.int64())], ["n"])

    found = spark.range(0, 64, 1, 64).mapInArrow(held, "n long").collect()
    assert len(found) == 64 and not any(r.n for r in found)


@pytest.mark.parametrize(("capacity", "longest"), [(60, 60), (7, 3), (1, 1)])
def test_packing_is_as_good_as_best_fit_decreasing(spark, capacity, longest):
    rng = random.Random(capacity)
    lengths = [rng.randint(1, longest) for _ in range(400)] + [longest // 3 + 1] * 300  # a third and more of one length
    df = spark.createDataFrame([(i % 50, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    found = P.pack(df, capacity).collect()
    assert sorted((r.ids_crc32, r.length) for r in found) == list(enumerate(lengths))
    assert sequences(found, capacity) <= best_fit_decreasing(lengths, capacity)


def test_short_lines_take_no_broadcast_and_give_the_same_heights(spark):
    rows = [(size, piece, n, 0) for n in range(60) for size, piece in ((n % 7 + 1, False), (n % 5 + 1, True))]
    df = spark.createDataFrame(rows, "size long, is_piece boolean, id long, nth long")
    heights = lambda short: sorted(tuple(r) for r in P._heights(df, short).select("size", "is_piece", "id", "nth", "height").collect())
    assert heights(True) == heights(False)
    pieces = spark.createDataFrame([(n, 5 + n % 4) for n in range(50)], "id long, length long")
    gaps = spark.createDataFrame([(n, 9 + n % 9) for n in range(50)], "sequence_id long, room long")
    assert P._is_short(gaps, 50, 50, 8, 5, 32)
    plans = [P.superstep(pieces, gaps, 8, 5, 32, 1, short)._jdf.queryExecution().optimizedPlan().toString() for short in (True, False)]
    assert ["Join" in plan for plan in plans] == [False, True]
    placed = [sorted(tuple(r) for r in P.superstep(pieces, gaps, 8, 5, 32, 1, short).collect()) for short in (True, False)]
    assert placed[0] == placed[1]


def test_buckets_of_a_size_give_the_same_heights(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(rng.randint(1, 5), rng.random() < 0.5, i, 0) for i in range(300)]
    df = spark.createDataFrame(rows, "size long, is_piece boolean, id long, nth long")
    want, height = [], 0
    for size, is_piece, _, _ in sorted(rows, key=lambda r: (-r[0], r[1])):
        want.append((size, is_piece, height if is_piece else height + 1))
        height += -1 if is_piece else 1
    for most in (10**6, 7):
        monkeypatch.setattr(P, "BUCKET_ROWS", most)
        assert sorted((r["size"], r.is_piece, r.height) for r in P._heights(df).collect()) == sorted(want)


def test_op7(spark, sf, docs):
    found = queries.QUERIES["op7_best_fit_packing"](spark, sf).collect()
    tokenizer = P.word_ids(P.default_tokenizer()).tokenizer
    want = {}
    for i, t in docs:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        for n, a in enumerate(range(0, len(ids), 2048)):
            want[i, n] = (a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found} == want
    assert sequences(found, 2048) == best_fit_decreasing([r.length for r in found], 2048)


# 8


def test_prefix_hashes():
    a, b = FP.PrefixHash("xxabcabcabd"), FP.PrefixHash("abcabx")
    assert FP.spans_equal(a, 2, a, 5, 3)
    assert not FP.spans_equal(a, 5, a, 8, 3)
    assert FP.longest_common_extension(a, 2, b, 0) == 5
    assert FP.longest_common_extension(a, 5, b, 0) == 5
    assert FP.longest_common_extension(a, 0, b, 0) == 0


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=30), st.text("ab", max_size=30), st.integers(0, 29), st.integers(0, 29))
def test_longest_common_extension(a, b, i, j):
    i, j = min(i, len(a)), min(j, len(b))
    want = 0
    while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
        want += 1
    assert FP.longest_common_extension(FP.PrefixHash(a), i, FP.PrefixHash(b), j) == want


@settings(max_examples=60, deadline=None)
@given(st.text("ab\U0001f600", max_size=60), st.sampled_from([12, 16, 25]))
def test_fingerprints_do_not_depend_on_the_stretches(text, stretch):
    whole = FP.PrefixHash(text)
    mark = FP.fingerprint(whole)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(FP, "STRETCH", stretch)
        cut = FP.PrefixHash(text)
        assert FP.fingerprint(cut) == mark
        spans = [(i, j) for i in range(0, len(text), 5) for j in range(i, len(text) + 1, 3)]
        found = [cut.span(*x) for x in spans]
        same = FP.longest_common_extension(cut, 0, FP.PrefixHash(text[:-1] + "c"), 0) if text else 0
    assert found == [whole.span(*x) for x in spans]
    assert same == max(0, len(text) - 1)


def test_a_text_of_50_mb_is_fingerprinted_in_bounded_memory():
    text = "longer words of a text é " * 2_000_000
    schema = pa.schema([("last", pa.bool_()), ("key", pa.int64()), ("text", pa.string())])
    batches = [pa.record_batch([[False], [2], [text]], schema), pa.record_batch([[True], [1], ["end"]], schema)]
    tracemalloc.start()
    rows = [r for b in FP._compare(iter(batches)) for r in b.to_pylist()]
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 500e6
    assert [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows] == [(2, len(text), hashlib.sha256((text[: len(text) - len(text) // 3] + "end").encode()).hexdigest())]


def test_words_do_not_depend_on_the_stretches(monkeypatch):
    texts = [b"", b"One two  three\tfour five six seven", b" x " * 40, b"a" * 100 + b" b c d e f g"]
    whole = WORDS.Words(texts, fold=True)
    want = whole.windows(5)
    monkeypatch.setattr(WORDS, "CHUNK_BYTES", 16)
    cut = WORDS.Words(texts, fold=True)
    assert all(np.array_equal(getattr(cut, x), getattr(whole, x)) for x in ("start", "end", "hash", "first"))
    assert all(np.array_equal(a, b) for a, b in zip(cut.windows(5), want, strict=True))


def brute_op8(rows):
    ordered = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        mark, new, other = (FP.fingerprint(FP.PrefixHash(x)) for x in (t, edited, after))
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), mark, new, FP.likeness(mark, new), FP.likeness(mark, other))
    return out


def row_op8(r):
    return (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)


def test_op8(spark, sf, docs):
    found = queries.QUERIES["op8_fingerprint"](spark, sf).collect()
    assert {r.doc_id: row_op8(r) for r in found} == brute_op8(docs)
    assert np.mean([r.near_edited for r in found]) > 0.4 > 0.05 > np.mean([r.near_next for r in found])


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_next_documents(spark, buckets):
    rows = [(i * 7 % 23 * 10, f"text {i} " * (i % 5 + 1)) for i in range(23)] + [(10_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = FP.with_next(df, "doc_id", "text", buckets).mapInArrow(FP._compare, FP.OP8_SCHEMA).collect()
    assert {r.doc_id: row_op8(r) for r in found} == brute_op8(rows)


def test_rows_of_one_key_spread_over_ranges(spark):
    rows = [(5, f"text {i}") for i in range(60)] + [(None, f"no key {i}") for i in range(30)] + [(9, "nine"), (1, "one"), (1, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    some, whole = FP.with_next(df, "doc_id", "text", 12), FP.with_next(df, "doc_id", "text", 1)
    shares = Counter(r.bucket for r in some.where("not last").collect())
    assert max(shares.values()) < 30
    assert Counter(map(tuple, some.mapInArrow(FP._compare, FP.OP8_SCHEMA).collect())) == Counter(map(tuple, whole.mapInArrow(FP._compare, FP.OP8_SCHEMA).collect()))


# 9


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_with_sql(spark, sf, name):
    assert rows_of_frame(queries.QUERIES[name](spark, sf)) == rows_of_sql(duck(sf), queries.ORACLE_SQL[name])


URLS = [
    None, "", "org", "http://ORG/", "https://Example.ORG/es/1?x", "http://a.example.org/en/123", "http://example.org/en/", "http://badexample.org/es/", "http://example.org", "http://x.com/fr", "http://x.com/fr/",
    "http://com/de/#a", "http://example.org:80/es/", "a://b://example.org/es/", "://x.com/de/", "http://x.com?/fr/", "http://u@example.org/es/\n/x",
]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in UF.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[2:]) if fits else (host, path, None, "allow")


def test_urls(spark):
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS)], "page_id long, url string, rule int")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in UF.judge_urls(df, "url", UF.RULES).collect()}
    assert found == {i: brute_url(u) for i, u in enumerate(URLS)}
    assert UF.judge_urls(df.limit(0), "url", UF.RULES).count() == 0


def test_urls_by_join(spark):
    rules = [*UF.RULES, ("a.org", "", "allow"), ("a.org", "/x", "block"), ("org", "/xyz/", "block"), ("b.org", "", "block"), ("b.org", "", "allow"), ("example.org", "/en/1/2", "allow"), ("x.com", "/fr/abc", "block")]
    urls = [*URLS, "http://a.org", "http://q.a.org/xyz/1", "http://a.org/xy", "http://b.org/", "http://example.org/en/1/23/4", "http://x.com/fr/abcd", "http://x.com/fr/ab", "http://x.com/fr/abcd"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, rule int")
    want = {tuple(r) for r in UF.judge_urls(df, "url", rules).select("page_id", "host", "path", "rule", "verdict").collect()}
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    assert {tuple(r) for r in UF.judge_by_join(df, "url", table).select("page_id", "host", "path", "rule", "verdict").collect()} == want
    assert UF.judge_by_join(df.limit(0), "url", table).count() == 0
    assert {r.verdict for r in UF.judge_by_join(df, "url", table.limit(0), "block").collect()} == {"block"}


def test_url_rules_without_path_and_ties():
    trie = UF.build_trie([("a.org", "", "allow"), ("a.org", "/x", "allow"), ("org", "/xyz/", "block"), ("b.org", "", "block"), ("b.org", "", "allow")])
    assert UF.longest_match(trie, "q.a.org", "") == ("a.org", "allow")
    assert UF.longest_match(trie, "a.org", "/xyz/1") == ("org/xyz/", "block")
    assert UF.longest_match(trie, "b.org", "/") == ("b.org", "block")
    with pytest.raises(ValueError, match="begins"):
        UF.build_trie([("a", "x", "allow")])


# 10


def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("part_rows", [ND.PART_ROWS, 20])
def test_near_dedup(spark, docs, monkeypatch, part_rows):
    monkeypatch.setattr(ND, "PART_ROWS", part_rows)
    rng = random.Random(3)
    base = [f"v{rng.randrange(400)}" for _ in range(150)]
    rows = list(docs)
    for k in range(150):  # a group of near copies around a text, with chains and stragglers
        words = list(base if k % 3 else rows[-1][1].split() if k > 3 else base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(30)}"
        rows.append((10_000 + k, " ".join(words)))
    rows += [(20_000, "A b C"), (20_001, "a B c"), (20_002, "a b"), (20_003, None), (20_004, ""), (20_005, "q w e r t"), (20_006, "Q W E\tR T")]
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in ND.near_components(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert found == brute_near(rows)


def test_rows_that_share_a_key(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(1, a), (2, b), (5, a + " x"), (5, b + " x"), (5, b + " x"), (7, a)], "doc_id long, text string")
    found = ND.near_components(df, "doc_id", "text").collect()
    assert len(found) == 6
    assert {r.component_id for r in found} == {1}


# all


def test_odd_rows_go_through_every_operator(spark):
    df = odd(spark)
    n = df.count()
    ids = Counter(r[0] for r in df.select("doc_id").collect())
    assert ND.near_components(df, "doc_id", "text").count() == n
    kept = SD.remove_repeats(df, "doc_id", "text").collect()
    assert Counter(r.row.doc_id for r in kept) == ids
    assert {r.n_removed for r in kept if r.row.doc_id is None} == {0, 13}
    lines = LD.without_common_lines(df, "doc_id", "text").collect()
    assert Counter(r.row.doc_id for r in lines) == ids
    pieces = P.pack(P.token_pieces(df)).collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == ids
    model = LI.train(df.select("doc_id", "text", "lang"), "doc_id")
    assert LI.with_language(df, "text", model).count() == n
    assert Counter(r.doc_id for r in FP.with_next(df, "doc_id", "text").mapInArrow(FP._compare, FP.OP8_SCHEMA).collect()) == ids
    assert SP.sampled_encoding(df, "doc_id", "text").where("lossless").count() == n
    audio = M.audio_columns(df.withColumn("feature", F.lit(1)), "text").collect()
    assert Counter(r.doc_id for r in audio) == ids
    features = defaultdict(set)
    for r in audio:
        features[r.text or ""].add((r.feature, bytes(r.media), r.n_frames))
    assert all(len(x) == 1 for x in features.values())
    judged = UF.judge_urls(df.withColumn("url", F.concat(F.lit("http://x.com/fr/"), "text")).withColumn("rule", F.lit(1)), "url", UF.RULES)
    assert Counter(r.doc_id for r in judged.collect()) == ids
    for stage in (LI.keep_identified, LD.without_repeated_lines, ND.without_near_copies, SD.without_repeats):
        assert stage(df).columns == df.columns


def test_settings_of_the_caller_stay(spark):
    own = spark.newSession()
    rows, size = BATCH
    own.conf.set(rows, "77")
    prepared(own)
    assert (own.conf.get(rows), own.conf.get(size)) == ("77", str(BATCH[size]))

    def measure(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    long = own.range(0, 60, 1, 1).select("id", F.repeat(F.lit("x"), 500_000).alias("t"))
    found = long.mapInArrow(measure, "n long, size long").collect()
    assert sum(r.n for r in found) == 60
    assert max(r["size"] for r in found) < 10e6


def test_empty_tables_go_through_every_stage(spark):
    none = frame(spark, []).limit(0)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, none, "")
        assert out.count() == 0
        assert n == len(corpus_pipeline.STAGES) - 1 or out.columns == none.columns
    assert FP.with_next(none, "doc_id", "text").mapInArrow(FP._compare, FP.OP8_SCHEMA).count() == 0
    assert M.audio_columns(none, "text").count() == 0
    assert SP.sampled_encoding(none, "doc_id", "text").count() == 0


def test_pipeline(spark, sf, docs):
    """Each stage by brute force where that is plain; the last by its own rules."""
    df = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, df, sf)
    assert kept.columns == df.columns
    model = LI.train(df.where(~LI.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), "doc_id")
    judged = {i: model.decide(t) for i, t in docs}
    assert {r.doc_id for r in kept.collect()} == {i for i, (lang, _, ambiguous) in judged.items() if lang != "und" and not ambiguous}
    assert kept.count() > 0.98 * len(docs)
    lines = stages["line_dedup"](spark, kept, sf)
    rows = [(r.doc_id, r.text) for r in lines.collect()]
    before = sorted((r.doc_id, r.text) for r in kept.collect())
    brute, texts, left = without_lines_of_all_earlier([t for _, t in before]), [t for _, t in before], dict(rows)
    assert set(left) >= {i for (i, _), b in zip(before, brute, strict=True) if b.strip()}
    mine, most = removed_places(texts, [left.get(i, "") for i, _ in before]), removed_places(texts, brute)
    assert all(not a - b for (i, _), a, b in zip(before, mine, most, strict=True) if i in left)
    assert sum(x.total() for x in mine) >= 0.99 * sum(x.total() for x in most)
    near = stages["near_dedup"](spark, lines, sf)
    assert {r.doc_id for r in near.collect()} == {i for i, x in brute_near(rows).items() if x[2]}
    rows = [(r.doc_id, r.text) for r in near.collect()]
    cut = {r.doc_id: r for r in stages["substring_dedup"](spark, near, sf).collect()}
    for i, (n, gone, digest) in brute_repeats(rows).items():
        if gone < n or not n:
            assert hashlib.sha256(b" ".join((cut[i].text or "").encode().split())).hexdigest() == digest
            assert cut[i].n_chars == len(cut[i].text)
        else:
            assert i not in cut
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == set(cut)


def test_line_dedup_goes_on_to_the_one_holder_that_takes_the_rest(spark):
    a, b = "a long line that is a block of its own, number one", "a long line that is a block of its own, number two"
    rows = [(n, f"{b}\n{a}\nfiller {n}") for n in range(40)] + [(50, f"{a}\nbetween\n{b}"), (60, f"{a}\nof mine\n{b}"), (61, f"{a}\n{a}\nother\n{b}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda groups: {r["key"]: sorted(r["gone"]) for r in LD.removed_lines(docs, "doc_id", "text", groups).collect()}
    assert found(1) == found(8) == found(None)
    assert found(1)[60] == [0, 2]
