"""Edge cases of the operators."""

import datetime as dt
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evenkeel.functions.json_text import REAL, json_cell, json_text, parsed, plain_json, real_text, value_cell
from evenkeel.functions.text import expand_template, selected_models, tags_to_labels
from evenkeel.functions.times import date_key, parse_ts
from evenkeel.operators import components as CO
from evenkeel.operators import conditions as C
from evenkeel.operators import export as X
from evenkeel.operators import graph as G
from evenkeel.operators import history as H
from evenkeel.operators import inspection as I
from evenkeel.operators import rules as R
from evenkeel.operators import triggers as TR
from evenkeel.operators.asof import asof_join, carry
from evenkeel.plans import load_all, registry

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def now(minutes):
    return F.lit(str(at(minutes))).cast("timestamp_ntz")


def one(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(("age_s", "state"), [(0, "Ready"), (60, "Ready"), (61, "Drifted"), (-5, "Ready")])
def test_freshness_is_inclusive_and_future_is_ready(spark, age_s, state):
    df = spark.createDataFrame([(T0,)], "ts timestamp_ntz")
    found = one(C.evaluate(df, [C.freshness("ts", 60, F.lit(str(T0 + dt.timedelta(seconds=age_s))).cast("timestamp_ntz"))]))
    assert found[0][2] == state
    assert (found[0][3] == "last updated 61s ago, max age is 60s") == (state == "Drifted")


def test_freshness_of_no_rows_is_an_error(spark):
    df = spark.createDataFrame([], "ts timestamp_ntz")
    assert one(C.evaluate(df, [C.freshness("ts", 60, now(0))]))[0][2:] == ("Error", "no timestamp")


def test_conditions_ignore_nulls_and_empty_tables_pass(spark):
    df = spark.createDataFrame([(None,), (None,), (1,)], "x int")
    parent = spark.createDataFrame([(1,)], "y int")
    rules = [C.unique("x"), C.accepted_values("x", [1]), C.relationships("x", parent, "y"), C.not_null("x")]
    assert {r.condition: r.state for r in C.evaluate(df, rules).collect()} == {"unique": "Ready", "accepted_values": "Ready", "relationships": "Ready", "not_null": "Drifted"}
    assert {r.state for r in C.evaluate(df.limit(0), rules).collect()} == {"Ready"}
    assert C.evaluate(df, []).count() == 0


def test_a_merge_does_not_shuffle_its_target(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        target = X.BucketedTarget(spark, str(tmp_path / "target"), ["k", "c"], 5)
        target.append(spark.createDataFrame([(i, "a", i) for i in range(50)], "k long, c string, v long"))
        staged = spark.createDataFrame([(i, c, v) for i in range(40, 60) for c in "ab" for v in (200, 100)], "k long, c string, v long")
        plan = target.new_rows(staged, "v")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert "Bucketed: true" in plan
        for _ in range(2):  # the second time there is nothing new
            target.merge(staged, "v")
            assert spark.table(target.name).count() == 50 + 10 + 20
        found = {(r.k, r.c): r.v for r in target.forget().collect()}
        assert found == {(i, "a"): i for i in range(50)} | {(i, "a"): 100 for i in range(50, 60)} | {(i, "b"): 100 for i in range(40, 60)}
        assert not spark.catalog.tableExists(target.name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_several_keys_share_one_pass(spark, sf):
    """Grouping sets give the same as one pass each, nulls and repeated sets included, and read the table once."""
    rng = random.Random(8)
    rows = [tuple(rng.choice([None, *range(n)]) for n in (40, 6, 9)) for _ in range(60)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    keys = [("a",), ("a", "b"), ("c", "b", "a"), ("b", "a"), ("c",)]
    rules = [C.unique(*k, name=",".join(k)) for k in keys]
    apart = {tuple(r) for c in rules for r in C.evaluate(df, [c]).collect()}
    assert {tuple(r) for r in C.evaluate(df, rules).collect()} == apart
    assert {r.state for r in C.evaluate(df.limit(0), rules).collect()} == {"Ready"}
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    uniques = [C.unique("l_orderkey", name="o"), C.unique("l_orderkey", "l_linenumber", name="ol"), C.unique("l_partkey", "l_suppkey", name="ps")]
    plan = C.evaluate(lines, uniques)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_plain_conditions_share_one_aggregate(spark):
    df = spark.range(10).withColumnRenamed("id", "x")
    plan = C.evaluate(df, [C.not_null("x"), C.row_count(">", 3), C.accepted_values("x", [1])])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1


@pytest.mark.parametrize(
    ("query", "state"),
    [
        ("SELECT true", "Ready"),
        ("WITH t AS (SELECT 1 AS a) SELECT a = 2 FROM t", "Drifted"),
        ("SELECT 'False'", "Drifted"),
        ("SELECT 1", "Error"),
        ("SELECT NULL", "Error"),
        ("SELECT true WHERE false", "Error"),
        ("SELECT true; SELECT true", "Error"),
        ("CREATE TABLE t (a INT)", "Error"),
        ("INSERT INTO t VALUES (1)", "Error"),
        ("SELECT nothing FROM nowhere", "Error"),
        ("VALUES (true) -- trailing", "Ready"),
    ],
)
def test_sql_condition(spark, query, state):
    assert one(C.sql_condition(spark, query))[0][0] == state


@pytest.mark.parametrize(
    ("text", "seconds"),
    [
        ("1970-01-01T00:01:00Z", 60.0),
        ("1970-01-01t00:01:00.999z", 60.0),
        ("1970-01-01 01:01:00+01:00", 60.0),
        ("1969-12-31T23:01:00-01:00", 60.0),
        ("1970-01-01T00:01:00", None),
        ("12.5", 12.5),
        ("soon", None),
        ("2024-13-01T00:00:00Z", None),
        (None, None),
    ],
)
def test_parse_ts(spark, text, seconds):
    assert one(spark.createDataFrame([(text,)], "v string").select(parse_ts("v"))) == [(seconds,)]


def test_date_key_looks_only_at_the_shape(spark):
    df = spark.createDataFrame([("2024-99-99T1",), ("24-01-01",), ("2024-1-01 0",), (None,)], "t string")
    assert [r[0] for r in df.select(date_key("t")).collect()] == ["2024-99-99", None, None, None]


def test_templates_keep_unknown_variables(spark):
    df = spark.createDataFrame([("{{ asset.name }} {{ asset.modelName }} {{ sync.a }} {{ sync.b }} {{ x }}", "t", {"a": "1"})], "t string, n string, m map<string,string>")
    filled = df.select(expand_template(F.col("t"), F.col("n"), F.lit(None).cast("string"), F.col("m")), expand_template(F.col("t"), F.col("n"), F.lit("mod"), F.lit(None).cast("map<string,string>")))
    assert one(filled) == [("t t 1 {{ sync.b }} {{ x }}", "t mod {{ sync.a }} {{ sync.b }} {{ x }}")]


def test_selected_models(spark):
    cases = {
        "dbt run --select +a+2": ["a"], "dbt run -s b": ["b"], "dbt run --select tag:x": [], "dbt run": [], "dbt run --select": [],
        "dbt run --select a -s b": ["a", "b"], " x -s tag:x --select 2+c+ -s d": ["c", "d"], "--select -s a": ["-s"], "-s + -s a+b": ["a+b"],
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r.c: r.m for r in df.select("c", selected_models(F.col("c")).alias("m")).collect()} == cases


@pytest.mark.parametrize(
    ("text", "want"),
    [("a", (0, ["a"], 0)), ("+a", (None, ["a"], 0)), ("a+", (0, ["a"], None)), ("2+a+3", (2, ["a"], 3)), ("+label:k=v,a+1", (None, ["label:k=v", "a"], 1)), ("a+b", (0, ["a+b"], 0)), ("a+b+", (0, ["a+b"], None)), ("0+a", (0, ["a"], 0))],
)
def test_selectors_are_taken_apart(text, want):
    assert G.parse_selector(text) == want


@pytest.mark.parametrize("text", ["", "+", "++", "2+", "a,,b", ",a", "+1+2"])
def test_selectors_without_a_pattern_are_refused(text):
    if text == "+1+2":
        assert G.parse_selector(text) == (None, ["1"], 2)
        return
    with pytest.raises(ValueError, match="empty part"):
        G.parse_selector(text)


def test_selectors_over_a_graph(spark):
    labels = {"a": {"team": "x"}, "b": {"team": "y", "daily": ""}, "c": {"team": "x", "daily": ""}, "d": {}, "e": {"ops": ""}}
    n = spark.createDataFrame(list(labels.items()), "node string, labels map<string,string>")
    e = edges(spark, *map(tuple, ("ab", "bc", "de", "be")))
    pick = lambda *include, exclude=(): "".join(sorted(r.node for r in G.select(n, e, include, exclude).collect()))
    assert pick() == "abcde"
    assert pick("b") == "b"
    assert pick("+c") == "abc"
    assert pick("b+") == "bce"
    assert pick("1+e") == "bde"
    assert pick("label:team=x,label:daily") == "c"
    assert pick("+label:team=y+1", "d") == "abcde"
    assert pick("a+", exclude=["label:ops", "c"]) == "ab"
    assert pick(exclude=["+e"]) == "c"
    for wrong in ("z", "label:none", "label:team=z", "label:"):
        with pytest.raises(ValueError, match="no node|needs a key"):
            pick(wrong)


def test_catalogue_kinds(spark):
    rules = spark.createDataFrame([("a", "w", "s1", "g1"), ("b", "w", None, "g1"), ("b", "w", "s1", "g2")], "asset string, connection string, sync string, conditions string")
    names = spark.createDataFrame([("g1", "y"), ("g1", "x"), ("g1", "x")], "conditions string, condition_name string")
    found = {(r.kind, r.name, r.n_assets, tuple(r.condition_names or ())) for r in R.catalog(rules, names, ["Sync", "CONDITIONS"]).collect()}
    assert found == {("sync", "s1", 2, ()), ("conditions", "g1", 2, ("x", "y")), ("conditions", "g2", 1, ())}
    with pytest.raises(ValueError, match="no such kind: origin"):
        R.catalog(rules, names, ["origin"])


def test_proposals_take_the_first_drifted_entry(spark):
    evals = spark.createDataFrame([("a", at(1), 1, False), ("a", at(2), 2, False), ("b", at(1), 3, True), ("c", at(1), 4, False)], "asset string, ts timestamp_ntz, evaluation_id int, ready boolean")
    results = spark.createDataFrame([(1, "x", "Drifted"), (2, "x", "Ready"), (2, "y", "Drifted"), (2, "z", "Drifted"), (3, "x", "Ready"), (4, "x", "Error")], "evaluation_id int, condition_name string, result string")
    entries = spark.createDataFrame([(a, *e) for a in "abcd" for e in ((0, "g1", "s1"), (1, "g2", "s2"), (2, "g3", "s3"))], "asset string, position int, conditions string, sync string")
    names = spark.createDataFrame([("g1", "x"), ("g2", "y"), ("g3", "z")], "conditions string, condition_name string")
    stages = spark.createDataFrame([("s1", 1, "run"), ("s2", 1, "run"), ("s2", 0, "pre")], "sync string, pos int, stage string")
    found = set(one(H.proposals(evals, results, entries, names, stages)))
    assert found == {("a", False, "s2", "pre,run"), ("b", True, None, None), ("c", False, "s1", "run"), ("d", None, None, None)}


def test_json_cell(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, null, "x"]}, "o": {"k": "v", "e": ""}, "s": {"state": "Drifted", "reason": "old"}, "n": null}',)], "j string")
    cell = lambda p, c=False: json_cell(F.col("j"), p, c)
    assert one(df.select(cell("a.b"), cell("o"), cell("s", True), cell("n"), cell("n", True), cell("a.z"))) == [("1, null, x", "e, k=v", "Drifted (old)", "null", "-", "null")]


def displayed(v):
    """What a value reads like, by recursion."""
    if isinstance(v, (bool, type(None))):
        return json.dumps(v)
    if isinstance(v, list):
        return ", ".join(map(displayed, v))
    if isinstance(v, dict):
        return ", ".join(k if x == "" else f"{k}={displayed(x)}" for k, x in sorted(v.items()))
    return v if isinstance(v, str) else str(v)


VALUES = [
    [], {}, [[], {}], {"z": [], "a": {}}, [["a"], {"k": 1}], {"k": {"b": "", "a": {"c": [1.0, -0.5]}}}, "", "a, b", 'q"u\\o\n', "é", "", "1.5", ["", 1.5],
    0, -7, 1.5, -2.0, 1234567.25, 2**63, True, ["", {"": ""}], {"a:b": "c:d", "e": ":", "f": '"', "g": '\\"'}, {"state": 5, "reason": "r"}, {"state": "S"}, {"state": "S", "reason": 5},
    {"state": "S", "reason": ""}, {"state": "1.5", "reason": "1.5"}, {"state": 1.5}, ["x" * 20_000 + '"' * 20_000],
]


def test_json_cells_of_any_depth(spark):
    rows = [(n, json.dumps({"v": {"w": v}}, ensure_ascii=bool(n % 2))) for n, v in enumerate(VALUES)]
    found = spark.createDataFrame(rows, "n int, j string").select("n", json_cell(F.col("j"), "v.w").alias("shown"), json_cell(F.col("j"), "v.w", True).alias("compared")).collect()
    for n, text, compared in found:
        v = VALUES[n]
        assert text == displayed(v)
        if isinstance(v, dict) and isinstance(v.get("state"), str):
            assert compared == (f"{v['state']} ({v['reason']})" if isinstance(v.get("reason"), str) and v["reason"] else v["state"])
        elif isinstance(v, (list, dict)):
            assert compared == json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        else:
            assert compared == displayed(v)


def test_json_paths_and_text_that_is_no_json(spark):
    df = spark.createDataFrame([('{"a": [{"b": 1}], "c": "s", "d\'e": 1, "f g": null}',), ("[1,",), (None,)], "j string")
    cell = lambda p, c=False: json_cell(F.col("j"), p, c)
    assert one(df.select(cell("a.b"), cell("a.0"), cell("c.d"), cell("d'e"), cell("f g"), cell("f g", True), cell("x", True))) == [("null", "null", "null", "1", "null", "-", "-"), *[("null",) * 5 + ("-", "-")] * 2]


def test_json_with_parts_that_do_not_belong_together_is_no_json(spark):
    texts = ['{"a": 1.5, "b": 1 2}', '{"a": 1.5, "b": tr ue}', '{"a": 1.5, "b": "c}', '{"a": 1.5, "b": -2e0, "c-1": "-0 1.5"}']
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, j string").select("n", parsed(F.col("j")).alias("v"))
    assert one(df.select("n", value_cell(F.col("v"), "a"), value_cell(F.col("v"), "b"), value_cell(F.col("v"), "c-1"))) == [*[(n, "null", "null", "null") for n in range(3)], (3, "1.5", "-2.0", "-0 1.5")]


def test_json_cells_read_each_text_once(spark, sf):
    load_all()
    query = registry.QUERIES["json_path_cell"](spark, sf)
    plan = query._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(REAL) == 1
    assert query.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize(
    ("number", "text"),
    [("1e3", "1000.0"), ("1.50", "1.5"), ("100", "100.0"), ("1e15", "1000000000000000.0"), ("1.5e16", "1.5e16"), ("1e16", "1e16"), ("123456789.125", "123456789.125"), ("-1e-5", "-0.00001"), ("1.25e-4", "0.000125"), ("1e-7", "1e-7"), ("-1.5E-9", "-1.5e-9"), ("18446744073709551616", "1.8446744073709552e19"), ("-0", "-0.0")],
)
def test_real_numbers(spark, number, text):
    df = spark.createDataFrame([(number,)], "n string")
    assert df.select(real_text(F.col("n"))).head()[0] == text
    if number != "100":
        assert df.select(plain_json(json_text(F.concat(F.lit('{"a": ['), F.col("n"), F.lit("]}")), "a"))).head()[0] == f"[{text}]"


def test_tags_to_labels(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(tags_to_labels(F.col("t"))).collect()] == [{"dbt/b": "", "dbt/a": ""}, {}]


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def nodes(spark, names):
    return spark.createDataFrame([(n, "Asset") for n in names], "node string, kind string")


def test_closures_do_not_depend_on_each_other(spark):
    e = edges(spark, ("A", "B"), ("B", "C"), ("B", "E"))
    roots = spark.createDataFrame([("A",), ("C",)], "node string")
    both = G.closure(e, roots, "down").union(G.closure(e, roots, "up")).select("node").distinct()
    assert {r.node for r in both.collect()} == {"A", "B", "C", "E"}
    assert {(r.node, r.level) for r in G.closure(e, roots.where("node = 'A'"), "down", 1).collect()} == {("A", 0), ("B", 1)}


def test_cycles(spark):
    e = edges(spark, ("r", "a"), ("a", "b"), ("b", "a"), ("b", "t"), ("x", "y"))
    assert {r.node for r in G.cycle_residue(e).collect()} == {"a", "b", "t"}
    with pytest.raises(ValueError, match="cycle"):
        G.waves(nodes(spark, "rabtxy"), e).collect()


def test_waves_take_the_longest_path(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"))
    assert {(r.node, r.wave) for r in G.waves(nodes(spark, "abcd"), e).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 0)}


def test_deep_closures_fold_their_levels(spark):
    n = 2 * G.FOLD + 3
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(n)] + [("n5", "n1"), ("n9", "n9")], "src string, dst string")
    roots = spark.createDataFrame([("n0",)], "node string")
    assert {(r.node, r.level) for r in G.closure(e, roots).collect()} == {(f"n{i}", i) for i in range(n + 1)}


def test_peeling_counts_repeated_edges_once(spark):
    e = edges(spark, *map(tuple, ("ab", "ab", "bc", "ac", "xx", "xc")))
    assert {r.node for r in G.cycle_residue(e).collect()} == {"x", "c"}
    e = edges(spark, *map(tuple, ("ab", "ab", "bc", "ac")))
    assert {(r.node, r.wave) for r in G.waves(nodes(spark, "az"), e).collect()} == {("a", 0), ("z", 0), ("b", 1), ("c", 2)}
    assert G.waves(nodes(spark, "az"), e.limit(0)).count() == 2
    assert G.cycle_residue(e.limit(0)).count() == 0


def waves_by_hand(names, pairs):
    above = {n: {a for a, b in pairs if b == n} for n in names}
    found = {}
    while ready := [n for n in names if n not in found and above[n] <= found.keys()]:
        found |= {n: 1 + max((found[a] for a in above[n]), default=-1) for n in ready}
    return found


@pytest.mark.parametrize("seed", range(3))
def test_waves_of_random_graphs(spark, seed):
    """Chains, trees, merges and, apart from them, rings with what hangs below."""
    rng = random.Random(seed)
    n = 60
    pairs = {(f"n{rng.randrange(max(0, i - 4), i)}", f"n{i}") for i in range(1, n) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))}
    e = edges(spark, *pairs)
    names = [f"n{i}" for i in range(n)]
    assert {r.node: r.wave for r in G.waves(nodes(spark, names), e).collect()} == waves_by_hand(names, pairs)
    rings = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(3)} | {("r1", "r2"), ("r2", "r1"), ("r2", "s1"), ("s1", "s2"), ("n0", "s3"), ("s2", "s3")}
    ends = {x for p in pairs | rings for x in p}
    left = {r.node for r in G.cycle_residue(edges(spark, *pairs, *rings)).collect()}
    assert left == ends - waves_by_hand(ends, pairs | rings).keys()


def test_waves_of_a_chain_and_a_ladder(spark):
    """A chain of a thousand is hung in ten rounds; a ladder has to be peeled, in more rounds than are kept as tables."""
    chain = spark.range(1000).select(F.concat(F.lit("c"), "id").alias("src"), F.concat(F.lit("c"), (F.col("id") + 1).cast("string")).alias("dst"))
    ladder = [(f"{a}{i}", f"{b}{i + 1}") for i in range(10) for a in "xy" for b in "xy"]
    found = {r.node: r.wave for r in G.waves(nodes(spark, ["c0"]), chain.unionByName(edges(spark, *ladder, ("c500", "x0")))).collect()}
    assert len(found) == 1001 + 22
    assert all(found[f"c{i}"] == i for i in range(1001))
    assert all(found[f"x{i}"] == 501 + i for i in range(11))
    assert found["y0"] == 0
    assert all(found[f"y{i}"] == 501 + i for i in range(1, 11))


def test_forests_connect_the_same_with_fewer_edges(spark, monkeypatch):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(500)] + [(None, "n1"), ("q", "q"), ("lone", "pair")]
    e = edges(spark, *pairs).coalesce(1)
    forest = [tuple(r) for r in CO.spanning_forest(e, "src", "dst").collect()]
    assert len(forest) <= 41
    assert {(r.node, r.component) for r in CO.component_labels(e.repartition(7), "src", "dst").collect()} == {(x, "lone") for x in ("lone", "pair")} | {(f"n{i}", "n0") for i in range(40)}
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([i + 1])], ["a", "b"]) for i in range(20)]
    monkeypatch.setattr(CO, "EDGES", 3)
    whole = [(a, b) for x in CO._forest(iter(batches)) for a, b in zip(*(c.to_pylist() for c in x.columns), strict=True)]
    assert whole == [(i, 0) for i in range(1, 21)]
    monkeypatch.setattr(CO, "NODES", 3)
    parts = [len(x) for x in CO._forest(iter(batches))]
    assert len(parts) > 1
    assert sum(parts) == 20
    assert list(CO._forest(iter([]))) == []


def test_components_of_a_long_chain(spark):
    e = edges(spark, *[(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)], ("z1", "z2"))
    found = {r.node: r.component for r in G.components(nodes(spark, [f"n{i:03d}" for i in range(61)] + ["z2", "alone"]), e).collect()}
    assert set(found.values()) == {"n000", "z1", "alone"}
    assert found["n060"] == "n000"


def test_gate(spark):
    ready = spark.createDataFrame([("a", True), ("b", False)], "asset string, ready boolean")
    e = edges(spark, ("a", "x"), ("b", "y"), ("a", "y"), ("q", "z"))
    assets = spark.createDataFrame([(n,) for n in "axyz"], "asset string")
    assert {(r.asset, r.open) for r in G.gate(assets, e, ready).collect()} == {("a", True), ("x", True), ("y", False), ("z", False)}
    assert {r.asset for r in G.initial_set(assets, e, ready).collect()} == {"x"}


def test_label_without_match_is_an_error(spark):
    n = spark.createDataFrame([("a", {"k": "v"})], "node string, labels map<string,string>")
    assert G.select_label(n, "k").count() == 1
    with pytest.raises(ValueError, match="no node"):
        G.select_label(n, "k", "w")


def test_merge_order(spark):
    rows = lambda *p: spark.createDataFrame([("a", x, t) for x, t in p], "asset string, position int, text string")
    merged = R.merge_entries(rows((0, "b0"), (1, "b1")), rows((0, "g")), rows((0, "a")))
    assert [r.text for r in merged.orderBy("merged").collect()] == ["b0", "b1", "g", "a"]


def syncs(spark, codes):
    return spark.createDataFrame([(i, 1, at(i), c) for i, c in enumerate(codes)], "execution_id long, asset long, ts timestamp_ntz, exit_code int")


def test_streak_cooldown_and_suspension(spark):
    streaks = H.failure_streak(syncs(spark, [1, 1, None, 1, 0, 1]))
    assert [r.streak for r in streaks.orderBy("execution_id").collect()] == [1, 2, 3, 0, 1]
    cool = H.cooldown(streaks, 30, 100).orderBy("execution_id").collect()
    assert [r.wait_s for r in cool] == [30, 60, 100, 30]
    assert [r.cleared_us is None for r in cool] == [False, False, False, True]
    assert [r.execution_id for r in H.suspend_points(streaks, 3).collect()] == [3]


def test_transitions_start_from_not_ready(spark):
    df = spark.createDataFrame([(i, 1, at(i), r) for i, r in enumerate([True, True, None, True, False])], "evaluation_id long, asset long, ts timestamp_ntz, ready boolean")
    assert sorted(r.evaluation_id for r in H.transitions(df).collect()) == [0, 3]


def test_asof_sides(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 5)], "k int, t long")
    right = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 3, 3), (1, 7, 4), (1, 7, 5)], "k int, t long, id int")
    pick = lambda d, e: {(r.k, r.t): r.m and r.m.id for r in asof_join(left, right, ["k"], "t", "t", "id", "m", d, e).collect()}
    assert pick("backward", True) == {(1, 5): 2, (1, 1): None, (2, 5): None}
    assert pick("backward", False) == {(1, 5): 3, (1, 1): None, (2, 5): None}
    assert pick("forward", True) == {(1, 5): 1, (1, 1): 3, (2, 5): None}
    assert pick("forward", False) == {(1, 5): 4, (1, 1): 3, (2, 5): None}


def test_lock_overlap_is_inclusive(spark):
    runs = spark.createDataFrame([(1, 1, at(0)), (2, 1, at(60)), (3, 1, at(121)), (4, 2, at(1))], "execution_id long, asset long, ts timestamp_ntz")
    assert one(H.overlaps(runs, 3600)) == [(1, 1, 2)]


def test_stages_stop_at_the_first_failure(spark):
    plan = spark.createDataFrame([(1, "pre", 0, 0), (1, "run", 1, 2), (1, "post", 2, 0), (2, "pre", 0, None), (2, "run", 1, 0)], "execution_id long, stage string, pos int, exit_code int")
    kept = H.stage_rows(plan)
    assert {(r.execution_id, r.stage) for r in kept.collect()} == {(1, "pre"), (1, "run"), (2, "pre"), (2, "run")}
    assert {tuple(r) for r in H.outcome(kept).collect()} == {(1, False, "run"), (2, True, None)}


def test_triggers(spark):
    df = spark.createDataFrame([(1, i, s * 1_000_000, d) for i, (s, d) in enumerate([(0, 10), (5, 100), (10, 1), (10, 9), (11, 1)])], "asset long, execution_id long, start_us long, duration_s long")
    assert {r.execution_id: r.accepted for r in TR.coalesce_triggers(df).collect()} == {0: True, 1: False, 2: True, 3: False, 4: True}
    assert TR.coalesce_triggers(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [3, 40, 100_000])
def test_triggers_of_a_busy_asset_over_many_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(TR, "BLOCK", block)
    rng = random.Random(block)
    rows = [(asset, i, rng.randrange(n) * 86_400_000_000, rng.choice([None, -5, 0, 1, 86_400, 5 * 86_400, 40 * 86_400])) for asset, n in ((1, 400), (2, 30), (3, 1)) for i in range(n)]
    odd = [(None, 1, 5, 1), (1, 999, None, 1), (2, 5, rows[405][2], 86_400)]  # no asset, no start, a repeated execution
    df = spark.createDataFrame([*rows, *odd], "asset long, execution_id long, start_us long, duration_s long").repartition(5)
    found = sorted(tuple(r) for r in TR.coalesce_triggers(df).where("asset is not null and start_us is not null").select("asset", "execution_id", "start_us", "accepted").collect())
    expected, until = [], {}
    for asset, i, start, length in sorted([*rows, odd[2]], key=lambda r: (r[0], r[2], r[1], r[3] is not None, r[3] or 0)):
        take = start >= until.get(asset, start)
        if take:
            until[asset] = start + max(length or 0, 0) * 1_000_000
        expected.append((asset, i, start, take))
    assert sorted((a, s, t) for a, _, s, t in found) == sorted((a, s, t) for a, _, s, t in expected)
    assert [r.accepted for r in TR.coalesce_triggers(df).where("asset is null or start_us is null").collect()] == [False, False]


def test_lock_overlaps_with_own_ttl(spark):
    runs = spark.createDataFrame([(1, 1, at(0), 600), (2, 1, at(5), None), (3, 1, at(7), 60), (4, 1, at(10), 60), (5, 1, at(12), 1), (6, 2, at(1), 60)], "execution_id long, asset long, ts timestamp_ntz, ttl_s long")
    assert {r.execution_id: r.overlaps for r in H.lock_overlaps(runs, 60).collect()} == {1: False, 2: True, 3: True, 4: True, 5: False, 6: False}


def test_split_buckets_give_the_same_pairs(spark, monkeypatch):
    rng = random.Random(7)
    times = [(i, i % 2, at(rng.randrange(0, 200))) for i in range(150)]
    runs = spark.createDataFrame(times, "execution_id long, asset long, ts timestamp_ntz")
    monkeypatch.setattr(H, "BUCKET_ROWS", 4)
    near = lambda a, b: a[1] == b[1] and (a[2], a[0]) < (b[2], b[0]) and b[2] - a[2] <= dt.timedelta(hours=1)
    assert sorted(tuple(r) for r in H.overlaps(runs, 3600).collect()) == sorted((a[1], a[0], b[0]) for a in times for b in times if near(a, b))


def test_merge_is_insert_only_and_drops_repeats(spark):
    target = spark.createDataFrame([(1, "old")], "k int, v string")
    staged = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a")], "k int, v string")
    assert one(X.merge_new(target, staged, ["k"], "v")) == [(2, "a")]


def test_watermark_stays_without_rows(spark):
    rows, mark = X.extract(spark.createDataFrame([(1,), (2,)], "id long"), "id", 5)
    assert rows.count() == 0
    assert one(mark) == [(5,)]


def test_changes_treat_null_as_a_value(spark):
    schema = "i array<struct<before:int,after:int>>"
    df = spark.createDataFrame([([(1, 1), (None, None)],), ([(None, 1)],), ([],)], schema)
    assert [r[0] for r in df.select(I.has_changes(F.col("i"))).collect()] == [False, True, False]


def test_halt_keeps_reasons(spark):
    assets = spark.createDataFrame([("a",), ("b",)], "asset string")
    old = spark.createDataFrame([("a", "failures", 1)], "asset string, reason string, suspended_us long")
    halted = H.halt(assets, old, "halted", now(0))
    assert {(r.asset, r.reason) for r in halted.collect()} == {("a", "failures"), ("b", "halted")}
    assert [r.asset for r in H.resume(halted, assets.where("asset = 'a'")).collect()] == ["b"]


SCENARIOS = {
    "chain": [("a", "b"), ("b", "c")],
    "fan_in": [("a", "c"), ("b", "c")],
    "fan_out": [("a", "b"), ("a", "c")],
    "diamond": [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")],
}


@pytest.mark.parametrize("name", sorted(SCENARIOS))
def test_scenarios_converge_in_waves(spark, name):
    """Every asset becomes open exactly when the waves before its own are Ready."""
    e = edges(spark, *SCENARIOS[name])
    names = sorted({x for p in SCENARIOS[name] for x in p})
    assets = spark.createDataFrame([(n,) for n in names], "asset string")
    wave = {r.node: r.wave for r in G.waves(nodes(spark, names), e).collect()}
    for w in range(max(wave.values()) + 1):
        ready = spark.createDataFrame([(n, wave[n] < w) for n in names], "asset string, ready boolean")
        assert {r.asset for r in G.initial_set(assets, e, ready).collect()} == {n for n in names if wave[n] == w}


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("current", [False, True])
def test_running_values_do_not_depend_on_the_chunks(spark, current, descending):
    rows = [(i % 3, at(i * 7 % 50), i, None if i % 4 else i) for i in range(60)]
    df = spark.createDataFrame(rows, "asset int, ts timestamp_ntz, id int, v int")
    values = {"total": ("sum", F.col("id")), "near": ("last", F.col("v"))}
    found = [{tuple(r) for r in carry(df, ["asset"], "ts", ["ts", "id"], values, current, descending, chunk).collect()} for chunk in (60_000_000, 600_000_000, 10**12)]
    want = set()
    for asset, ts, i, v in rows:
        inside = lambda r: r[0] == asset and ((r[1], r[2]) > (ts, i) if descending else (r[1], r[2]) < (ts, i)) or (current and r[2] == i)  # noqa: B023, E731
        seen = sorted(filter(inside, rows), key=lambda r: (r[1], r[2]), reverse=descending)
        want.add((asset, ts, i, v, sum(r[2] for r in seen), next((r[3] for r in reversed(seen) if r[3] is not None), None)))
    assert found == [want] * 3


def test_edges_are_written_once_for_all_selectors(spark, monkeypatch):
    from evenkeel.operators import graph as G

    written, before = [], G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, *more: (written.append(df.columns), before(df, *more))[1])
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    nodes = spark.createDataFrame([(n, {}) for n in "abcd"], "node string, labels map<string,string>")
    found = G.select(nodes, edges, ["a+1", "+c", "1+d"], ["b"])
    assert sorted(r.node for r in found.collect()) == ["a", "c", "d"]
    assert [c for c in written if "level" not in c] == [["src", "dst"]]


@pytest.mark.parametrize("name", ["connected_components", "component_sizes", "adjacency_chunks"])
def test_edges_that_are_read_again_are_not_computed_again(spark, sf, name):
    from evenkeel.plans import load_all, registry

    load_all()
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_tables_that_grow_with_the_graph_are_not_broadcast(spark, monkeypatch):
    from evenkeel.operators import peeling as P

    plans, before = [], P.materialize
    monkeypatch.setattr(P, "materialize", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), before(df))[1])
    monkeypatch.setattr(P, "FEW", 0, raising=False)
    chain = [(f"c{n}", f"c{n + 1}") for n in range(40)]
    found = G.cycle_residue(edges(spark, *chain, ("c3", "d"), ("c5", "d"), ("x", "y"), ("y", "x"), ("y", "c40")))
    assert {r.node for r in found.collect()} == {"x", "y", "c40"}
    assert len(plans) > 10
    assert not [p for p in plans if "Broadcast" in p]


def test_a_wide_layer_is_set_aside(spark, monkeypatch):
    from evenkeel.operators import peeling as P

    written, before = [], P.materialize
    record = lambda df: (table := before(df), written.append(table.count()))[0]
    for module in (G, P):
        monkeypatch.setattr(module, "materialize", record)
    upper = [(f"n{n % 2}", f"c{n}") for n in range(20)]
    lower = [(f"c{(n + k * k) % 20}", f"o{n}") for n in range(400) for k in range(5)]
    found = {r.node: r.wave for r in G.waves(None, edges(spark, *upper, *lower)).collect()}
    assert found == {"n0": 0, "n1": 0} | {c: 1 for _, c in upper} | {o: 2 for _, o in lower}
    assert sum(written) < 1.5 * len(upper + lower)


def test_cycles_above_a_wide_layer(spark):
    pairs = [("a", "b"), ("b", "a"), *((x, f"s{n}") for n in range(9) for x in "ar"), *(("r", f"t{n}") for n in range(9) for _ in range(2)), ("r", "m"), ("m", "t1")]
    e = edges(spark, *pairs)
    assert {r.node for r in G.cycle_residue(e).collect()} == {"a", "b", *(f"s{n}" for n in range(9))}
    rest = e.where("src not in ('a', 'b')")
    assert {r.node: r.wave for r in G.waves(nodes(spark, "rz"), rest).collect()} == {"r": 0, "z": 0, "m": 1, **{f"{k}{n}": 1 for k in "st" for n in range(9)}, "t1": 2}


def test_groups_of_an_asset_are_not_held_before_the_shuffle(spark):
    rules = spark.range(50).select(F.concat(F.lit("a"), F.col("id") % 20).alias("asset"), F.lit("w").alias("connection"), F.lit("s1").alias("sync"), F.lit("g1").alias("conditions"), F.col("id").alias("position"))
    names = spark.createDataFrame([("g1", "x")], "conditions string, condition_name string")
    assets = rules.select("asset").distinct()
    found, summaries = R.catalog(rules, names), R.asset_summaries(assets, rules)
    for plan in (df._jdf.queryExecution().executedPlan().toString() for df in (found, summaries)):
        dealt = plan[plan.index("REPARTITION_BY_NUM") :].split("Aggregate")
        assert "hashpartitioning(kind, name, asset" not in plan.replace("#", "").translate(str.maketrans("", "", "0123456789"))
        assert "Range" in dealt[0]  # nothing is grouped between reading and dealing
    assert "Broadcast" not in summaries._jdf.queryExecution().executedPlan().toString()
    assert {(r.kind, r.name, r.n_assets) for r in found.where("kind <> 'asset'").collect()} == {("connection", "w", 20), ("sync", "s1", 20), ("conditions", "g1", 20)}
    assert {r.asset: len(r.entries) for r in summaries.collect()} == {f"a{n}": 2 + (n < 10) for n in range(20)}
