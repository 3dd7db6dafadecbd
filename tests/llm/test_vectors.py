"""Vector codes, exact search and the filter audit against brute force and on odd rows."""

import hashlib
import math
import random
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evenkeel.llm import filter_audit as FA
from evenkeel.llm import queries
from evenkeel.llm import topk_search as TK
from evenkeel.llm import vector_codes as VC
from evenkeel.llm.vectors import MOST
from tests.oracle import duck, rows_of_frame, rows_of_sql

SCHEMA = "vec_id long, embedding array<float>, label int"
NEW = ["op11_vector_codes", "op12_topk_search", "op13_filter_audit"]


@pytest.mark.parametrize("name", NEW)
def test_queries_with_sql(spark, sf, name):
    assert rows_of_frame(queries.QUERIES[name](spark, sf)) == rows_of_sql(duck(sf), queries.ORACLE_SQL[name])


def vectors(n=300, dim=32, seed=5):
    """Random vectors with ties, repeated rows, and rows that are left out; (id, vector or None, label)."""
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0, 0.02), 3) for _ in range(dim)], rng.choice([None, 1, 1, 2])) for i in range(n)]
    rows += [(i + n, rows[7][1], 3) for i in range(n // 2)]  # copies of one
    rows += [rows[9], rows[9], (None, rows[3][1], None)]
    odd = [None, [None] * dim, [0.0] * (dim - 1) + [math.nan], [math.inf] + [0.0] * (dim - 1), [0.0] * (dim - 1) + [None]]
    rows += [(5000 + 50 * i, v, 1) for i, v in enumerate(odd)]
    rows += [(6000, [0.5], 1), (6050, [], 1), (6100, [], 2), (6150, [3.0e38] * dim, 2), (6200, [-3.0e38] * dim, 2)]
    return rows


def scaled(v):
    ok = v is not None and all(x is not None and math.isfinite(x) for x in v)
    return [max(-MOST, min(MOST, math.floor(256 * float(np.float32(x))))) for x in v] if ok else None


def clashing(df):
    for c in ("key", "v", "dim", "q", "c", "least", "score", "code", "error", "__label", "part", "fails", "text_", "digest", "salt", "word", "flag_0"):
        df = df.withColumn(c, F.lit("x"))
    return df


# 11


def coded_by_hand(rows, parts, entries, rounds):
    found = sorted(((i, scaled(v), label) for i, v, label in rows if scaled(v) is not None), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(found[0][1])
    first = [v for _, v, _ in found[:entries] if len(v) == dim]
    found = [r for r in found if len(r[1]) == dim]
    at = VC.cuts(dim, parts)
    book = [list(v) for v in first]

    def nearest(v, a, b):
        return min((sum((v[j] - c[j]) ** 2 for j in range(a, b)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        new = [list(c) for c in book]
        for a, b in zip(at[:-1], at[1:], strict=True):
            groups = {}
            for _, v, _ in found:
                groups.setdefault(nearest(v, a, b)[1], []).append(v)
            for e, members in groups.items():
                for j in range(a, b):
                    new[e][j] = sum(v[j] for v in members) // len(members)
        book = new
    out = []
    for i, v, label in found:
        near = [nearest(v, a, b) for a, b in zip(at[:-1], at[1:], strict=True)]
        out.append((i, label, bytes(e for _, e in near).hex(), sum(d for d, _ in near)))
    return sorted(out, key=repr), book


@pytest.mark.parametrize(("parts", "entries", "dim"), [(4, 64, 32), (5, 7, 32), (16, 64, 5)])
def test_codes_are_those_of_a_full_search(spark, parts, entries, dim):
    rows = vectors(120, dim)
    coded, table = VC.vector_codes(clashing(spark.createDataFrame(rows, SCHEMA).repartition(5)), "vec_id", "embedding", "label", parts, entries, 2)
    expected, book = coded_by_hand(rows, parts, entries, 2)
    assert sorted(map(tuple, coded.collect()), key=repr) == expected
    assert table.tolist() == book


@given(st.data())
@settings(max_examples=60, deadline=None)
def test_bitmasks_give_the_nearest_entry(data):
    dims, entries = data.draw(st.integers(1, 5)), data.draw(st.integers(1, 64))
    number = st.integers(-4, 4) if data.draw(st.booleans()) else st.integers(-MOST, MOST)
    row = st.lists(number, min_size=dims, max_size=dims)
    book = np.array(data.draw(st.lists(row, min_size=entries, max_size=entries)), np.int64)
    x = np.array(data.draw(st.lists(row, min_size=1, max_size=20)), np.int64)
    distance = np.square(x[:, None, :] - book[None]).sum(axis=2)
    code, least = VC.Slices(book).nearest(x)
    assert code.tolist() == distance.argmin(axis=1).tolist()
    assert least.tolist() == distance.min(axis=1).tolist()


def test_masks_hold_the_entries_of_a_box():
    book = np.array([[0, 0], [5, 1], [5, 9], [2, 2]])
    masks = VC.Slices(book).candidates(np.array([[4, 1]]), np.array([2]))
    assert masks.tolist() == [0b1010]


def test_label_errors_and_empty_tables(spark):
    coded = spark.createDataFrame([(1, None, "a", 3), (2, None, "b", 4), (3, 7, "c", 5)], "key long, label int, code string, error long")
    assert {r.key: r.label_error for r in VC.with_label_errors(coded).collect()} == {1: 7, 2: 7, 3: 5}
    none = spark.createDataFrame([], SCHEMA)
    assert VC.with_label_errors(VC.vector_codes(none, "vec_id", "embedding", "label")[0]).count() == 0
    assert VC.codebook_text(np.array([[1, -2, 3, 4], [5, 6, 7, 8]]), 2) == "1,-2,5,6,3,4,7,8"
    with pytest.raises(ValueError, match="64"):
        VC.Slices(np.zeros((65, 2), np.int64))


def test_op11_digest(spark, sf):
    coded, table = VC.vector_codes(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding", "label")
    digest = {r.codebooks_sha256 for r in queries.QUERIES["op11_vector_codes"](spark, sf).collect()}
    assert digest == {hashlib.sha256(VC.codebook_text(table, 16).encode()).hexdigest()}


# 12


def found_by_hand(rows, k, every):
    known = [(i, scaled(v)) for i, v, _ in rows if i is not None and scaled(v) is not None]
    out = []
    for q in sorted({i for i, _ in known if i % every == 0}):
        best = {}
        for i, x in known:
            for j, v in known:
                if j == q and i != q and len(v) == len(x):
                    best[i] = max(best.get(i, -math.inf), sum(a * b for a, b in zip(v, x, strict=True)))
        ranked = sorted(best.items(), key=lambda b: (-b[1], b[0]))[:k]
        out += [(q, n, i, s) for n, (i, s) in enumerate(ranked, 1)]
    return out


@pytest.mark.parametrize("most", [16, 100, 10_000])
def test_search_finds_the_best(spark, monkeypatch, most):
    monkeypatch.setattr(TK, "GROUP_ROWS", most)
    monkeypatch.setattr(TK, "GO_ROWS", 3)
    rows = [*vectors(150, 8), (100, [0.1] * 8, 1), (100, [-0.1] * 8, 2)]  # a key of three vectors
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    found = TK.best_matches(df, df.where("vec_id % 50 = 0"), "vec_id", "embedding", 5)
    assert sorted((r.query, r.rank, r.key, r.score) for r in found.collect()) == found_by_hand(rows, 5, 50)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame(vectors(20, 4), SCHEMA)
    assert TK.best_matches(none, none, "vec_id", "embedding", 5).count() == 0
    assert TK.best_matches(some, none, "vec_id", "embedding", 5).count() == 0
    assert TK.best_matches(none, some, "vec_id", "embedding", 5).count() == 0


@given(st.integers(1, 40), st.integers(0, 2**32 - 1))
@settings(max_examples=40, deadline=None)
def test_bounds_hold_at_every_resolution_and_get_closer(dim, seed):
    rng = np.random.default_rng(seed)
    q, x = rng.normal(0, 50, (5, dim)).round(), rng.normal(0, 50, (7, dim)).round()
    before = None
    for n in TK.resolutions(dim):
        bound = TK.features(q, n) @ TK.features(x, n).T
        assert (bound >= q @ x.T - 1e-6).all()
        if before is not None and dim % n == 0:
            assert (bound <= before + 1e-6).all()
        before = bound if dim % n == 0 else None


def test_coarse_bounds_leave_few_pairs_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(TK, "GROUP_ROWS", 500)
    rng = np.random.default_rng(3)
    centres = np.repeat(rng.normal(0, 0.3, (20, 8)), 8, axis=1)  # smooth in segments
    rows = [(i, (centres[i % 20] + rng.normal(0, 0.01, 64)).tolist(), 0) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = TK.best_matches(df, df.where("vec_id % 50 = 0"), "vec_id", "embedding", 5).collect()
    assert len(found) == 400
    assert sum(r.scored for r in found) < 0.35 * 80 * 4000


# 13


def audited_by_hand(docs, labels):
    words = lambda t: [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, source in docs:
        w, t = words(t or ""), t or ""
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t],
        }
        of = [x for x in labels if x[0] == i and i is not None]
        rows.append((source or "", {k for k, v in fails.items() if v}, any(x[1] == 1 for x in of), any(x[2] == 1 for x in of)))
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in permutations("ABCDE"):
            here = own
            for step, f in enumerate(order, 1):
                gone, left = [r for r in here if f in r[1]], [r for r in here if f not in r[1]]
                shapley[f] += len(gone)
                redundant = sum(f in r[1] for r in own) - len(gone)
                lines.append((part, "".join(order), step, f, len(left), len(gone), redundant, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)))
                here = left
        out += [(*x[:3], *x[4:], shapley[x[3]]) for x in lines]
    return sorted(out)


def test_audit_of_odd_documents(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(80)]
    texts = [None, "", " \t\x0b", "A B C", "a|b", "é" * 19 + "A", "x" * 100_000, " ".join(["Zz"] * 60), " ".join(vocabulary), " ".join(vocabulary) + " 5 %", " ".join(f"w{i}" for i in range(200_000))]
    docs = [(i, rng.choice(texts), rng.choice([None, "", "s", "t"])) for i in range(150)]
    docs += [docs[3], docs[3], (None, texts[8], "s"), (None, texts[8], "s"), (7, texts[9], "lone")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 160, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)).withColumn("label", F.lit(1)).withColumn("first", F.lit(0))
    known = spark.createDataFrame(labels, "doc_id long, good_lost int, toxic_lost int").withColumn("key", F.lit(1))
    flags = ["good_lost", "toxic_lost"]
    rows = FA.labelled(FA.failed(df, "doc_id", "text", "source"), known, "doc_id", flags)
    found = FA.order_report(FA.subset_survivors(rows, flags), flags)
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *flags, "shapley"]
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == audited_by_hand(docs, labels)
    assert found.where("filter <> substr(filter_order, step, 1)").count() == 0
    empty = FA.labelled(FA.failed(df.limit(0), "doc_id", "text", "source"), known, "doc_id", flags)
    assert FA.order_report(FA.subset_survivors(empty, flags), flags).count() == 0
    unlabelled = FA.labelled(FA.failed(df, "doc_id", "text", "source"), known.limit(0), "doc_id", flags)
    assert FA.order_report(FA.subset_survivors(unlabelled, flags), flags).agg(F.sum("good_lost")).head()[0] == 0


@given(st.lists(st.integers(0, 2**32 - 1), max_size=200))
@settings(max_examples=60, deadline=None)
def test_carry_save_sums(words):
    assert FA.positional_counts(np.array(words, np.uint32)).tolist() == [sum(w >> b & 1 for w in words) for b in range(32)]


def test_survival_words():
    for fails in range(32):
        assert [FA.survival_word(fails) >> s & 1 for s in range(32)] == [int(not s & fails) for s in range(32)]


def test_many_parts_are_given_out_in_between(spark, monkeypatch):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("part"), (F.col("id") % 32).cast("int").alias("fails"), F.lit(1).alias("label"))
    monkeypatch.setattr(FA, "HELD", 100)
    found = FA.subset_survivors(rows.unionByName(rows), ["good"]).collect()
    assert len(found) == 3000
    assert all(r["all"] == r.good == [2 * int(not s & int(r.part) % 32) for s in range(32)] for r in found)
