"""Scratch tables: where they go, and that they can be deleted."""

import os
import threading

import pytest

from evenkeel.operators import conditions as C
from evenkeel.plans.reconcile import reconcile
from evenkeel.session import discard, materialize, scratch_scope, shared_folder, side_by_side


def test_a_cluster_needs_a_shared_folder():
    assert shared_folder(None, "local[8]") is None
    assert shared_folder("/shared", "local[8]") == "/shared"
    assert shared_folder("/shared", "yarn") == "/shared"
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://host"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(None, master)


def test_discarded_tables_are_gone(spark):
    df = materialize(spark.range(10).selectExpr("id", "id % 2 AS half"), "half")
    assert df.where("half = 1").count() == 5
    path = df._evenkeel_path.removeprefix("file://")
    assert os.path.isdir(path)
    discard(df)
    assert not os.path.exists(path)
    discard(df, spark.range(1))


def test_scopes_delete_what_was_written_inside(spark):
    outer = materialize(spark.range(3))
    with scratch_scope():
        one = materialize(spark.range(3))
        with pytest.raises(ZeroDivisionError), scratch_scope():
            two = materialize(one)
            raise ZeroDivisionError
        assert not os.path.exists(two._evenkeel_path) and os.path.isdir(one._evenkeel_path)
    assert not os.path.exists(one._evenkeel_path)
    assert outer.count() == 3
    discard(outer)


def test_scopes_of_two_threads_are_apart(spark):
    meet, kept, seen = threading.Barrier(2, timeout=60), {}, {}

    def work(name, first_to_leave):
        with scratch_scope():
            kept[name] = materialize(spark.range(3))
            meet.wait()
            if not first_to_leave:
                meet.wait()  # the other has left its scope
                seen[name] = kept[name].count()
        if first_to_leave:
            meet.wait()

    threads = [threading.Thread(target=work, args=x) for x in (("a", True), ("b", False))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert seen == {"b": 3}
    assert not any(os.path.exists(df._evenkeel_path) for df in kept.values())


def test_what_runs_side_by_side_is_in_the_callers_scope(spark):
    meet = threading.Barrier(3, timeout=60)

    def work(n):
        meet.wait()
        return materialize(spark.range(n))

    with scratch_scope():
        found = side_by_side(spark, [lambda n=n: work(n) for n in (1, 2, 3)])
        assert [df.count() for df in found] == [1, 2, 3]
    assert not any(os.path.exists(df._evenkeel_path) for df in found)
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, [lambda: 1 / 0])


def test_assets_of_a_wave_are_rebuilt_side_by_side(spark):
    """Four builders wait for each other; what stands below them is rebuilt after them, and below a failed one not at all."""
    meet = threading.Barrier(4, timeout=60)
    bad = spark.range(3).selectExpr("id", "CAST(NULL AS BIGINT) AS x")
    names = [f"a{i}" for i in range(4)]

    def build(tables):
        meet.wait()
        return spark.range(5).selectExpr("id", "id AS x")

    tables = dict.fromkeys([*names, "below", "stuck", "free"], bad) | {"root": spark.range(2).selectExpr("id", "id AS x")}
    rules = {a: [C.not_null("x")] for a in tables if a != "free"}
    upstreams = {a: ["root"] for a in names} | {"below": names, "stuck": ["stuck_up"]} | {"free": ["a0"]}
    tables["stuck_up"], rules["stuck_up"] = bad, [C.not_null("x")]
    builders = dict.fromkeys(names, build) | {"below": lambda t: t["a0"].union(t["a1"]), "stuck": lambda t: t["root"]}
    found = {r.asset: tuple(r)[1:] for r in reconcile(spark, tables, rules, upstreams, builders).collect()}
    assert found == {
        **dict.fromkeys(names, (1, False, True, True, 3, 5)), "root": (0, True, False, True, 2, 2), "below": (2, False, True, True, 3, 10),
        "stuck_up": (0, False, False, False, 3, 3), "stuck": (1, False, False, False, 3, 3), "free": (2, True, False, True, 3, 3),
    }
