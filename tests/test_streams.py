"""Rules of the streams on rows in any order, by hand and as streams."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evenkeel.session import scratch_dir, ship_package
from evenkeel.streaming import ordered as O
from evenkeel.streaming import streams as S

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "asset long, ts timestamp, id long, is_sync boolean, failed boolean, ready boolean"


def us(t):
    return round((t - T0).total_seconds() * 1_000_000) + round(T0.timestamp() * 1_000_000)


def guarded(rows, limit=3):
    """What the guardrail does with one asset's rows (is_sync, failed, ready, id), one after the other."""
    out, streak, suspended = [], 0, False
    for is_sync, failed, ready, number in rows:
        if is_sync and failed:
            streak += 1
            out.append((number, "cooldown", streak, min(30 * 2 ** (streak - 1), 1800)))
            if streak >= limit:
                suspended = True
                out.append((number, "suspend", streak, 0))
        elif is_sync:
            streak = 0
        elif ready and suspended:
            streak, suspended = 0, False
            out.append((number, "resume", 0, 0))
    return sorted(out)


def in_parts(rule, rows, cuts):
    """The columns that a rule gives for rows that come in parts."""
    state, out = rule.start, []
    dtype = np.dtype([("us", "i8"), ("id", "i8"), *rule.fields.items()])
    edges = [0, *sorted(cuts), len(rows)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            state, found = rule.apply(state, np.array(rows[a:b], dtype))
            out += list(zip(*found.values(), strict=True))
    return state, out


@given(st.lists(st.tuples(st.booleans(), st.booleans(), st.booleans()), max_size=60), st.lists(st.integers(0, 60), max_size=4))
@settings(max_examples=200, deadline=None)
def test_guardrail_in_parts(rows, cuts):
    rows = [(n, n, *r) for n, r in enumerate(rows)]
    _, found = in_parts(S.Guardrail(3, 30, 1800), rows, [min(c, len(rows)) for c in cuts])
    assert sorted((int(a), b, int(c), int(d)) for a, b, c, d in found) == guarded([(*r[2:], r[1]) for r in rows])


@given(st.lists(st.integers(0, 25), min_size=1, max_size=40), st.lists(st.integers(0, 40), max_size=4))
@settings(max_examples=200, deadline=None)
def test_freshness_in_parts(gaps, cuts):
    times = np.cumsum(gaps).tolist()
    rule = S.Freshness(0)
    rule.age = 10
    state, found = in_parts(rule, [(t, 0) for t in times], [min(c, len(times)) for c in cuts])
    expected = [(times[0], "Ready", times[0])]
    for a, b in zip(times[:-1], times[1:], strict=True):
        if b - a > 10:
            expected += [(a + 10, "Drifted", a), (b, "Ready", b)]
    assert [(int(a), s, int(n)) for a, s, n, _ in found] == expected
    assert rule.wake(state) == times[-1] + 11
    assert rule.passed(state, times[-1] + 10)[1] == {}
    state, late = rule.passed(state, times[-1] + 11)
    assert late["at_us"].tolist() == [times[-1] + 10]
    assert late["state"].tolist() == ["Drifted"]
    assert rule.wake(state) is None
    _, after = rule.apply(state, np.array([(times[-1] + 40, 0)], [("us", "i8"), ("id", "i8")]))
    assert after["state"].tolist() == ["Ready"]  # it has drifted already


def test_delays():
    assert [O.seconds_of(x) for x in ("1 hour", "30 minutes", " 2 days", "1 second")] == [3600, 1800, 172_800, 1]
    with pytest.raises(ValueError, match="delay"):
        O.seconds_of("soon")


class Drops:
    """A folder of files, and a stream over it that is stopped and started again after each drop."""

    def __init__(self, spark):
        ship_package(spark)
        O.keep_state_in_rocksdb(spark)
        self.spark, self.folder, self.path, self.checkpoint = spark, scratch_dir(spark), scratch_dir(spark), scratch_dir(spark)

    def run(self, rows, query):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)
        S.run_to_end(query(self.spark.readStream.schema(SCHEMA).parquet(self.folder)), self.path, self.checkpoint)

    def result(self):
        return S.read_result(self.spark, self.path)


def rows_of(n, seed, assets=3):
    rng = random.Random(seed)
    return [(rng.randrange(assets), T0 + dt.timedelta(seconds=rng.randrange(3600)), i, rng.random() < 0.6, rng.random() < 0.8, rng.choice([True, False, None])) for i in range(n)]


def applied(rows, delay):
    mark = max(r[1] for r in rows) - dt.timedelta(seconds=delay)
    return sorted((r for r in rows if r[1] <= mark), key=lambda r: (r[1], r[2]))


def test_drops_in_the_wrong_order_give_the_result_of_one_run(spark):
    rows = rows_of(300, 1)
    first, second = [r for r in rows if r[1] < T0 + dt.timedelta(minutes=30)], [r for r in rows if r[1] >= T0 + dt.timedelta(minutes=30)]
    end = [(0, T0 + dt.timedelta(hours=4), 1000, False, False, False)]
    drops = Drops(spark)
    for part in (second, first, end):
        drops.run(part, lambda df: S.stream_guardrail(df, "2 hours"))
    found = {a: sorted((r.id, r.kind, r.streak, r.wait_s) for r in drops.result().collect() if r.asset == a) for a in range(3)}
    due = applied(rows + end, 7200)
    assert len(due) == len(rows)
    assert found == {a: guarded([(r[3], r[4], bool(r[5]), r[2]) for r in due if r[0] == a]) for a in range(3)}


def test_transitions_of_late_rows_and_of_rows_that_are_too_late(spark):
    rows = [(1, T0 + dt.timedelta(minutes=m), m, False, False, ready) for m, ready in ((10, True), (30, False), (50, True), (20, True), (40, None))]
    too_late = [(1, T0 + dt.timedelta(minutes=5), 5, False, False, True)]
    drops = Drops(spark)
    query = lambda df: S.stream_transitions(df.select("asset", "ts", "id", "ready"), "30 minutes")
    drops.run(rows[:3], query)  # the watermark is at 20 minutes now
    assert [r.evaluation_id for r in drops.result().collect()] == [10]
    drops.run(rows[4:] + too_late, query)
    drops.run([(2, T0 + dt.timedelta(hours=3), 99, False, False, True)], query)
    assert sorted(r.evaluation_id for r in drops.result().collect()) == [10, 50]


def test_a_silent_asset_drifts_without_a_row(spark):
    hour = lambda h, a, n: (a, T0 + dt.timedelta(hours=h), n, False, False, True)
    drops = Drops(spark)
    query = lambda df: S.stream_freshness(df.select("asset", "ts", "id"), 7200, "1 hour")
    drops.run([hour(0, 1, 1), hour(0, 2, 2), hour(1, 1, 3)], query)
    drops.run([hour(2, 1, 4), hour(4, 1, 5)], query)  # the watermark is at 3 hours: 2 is silent
    at = lambda h: us(T0 + dt.timedelta(hours=h))
    found = lambda: sorted((r.asset, r.at_us, r.state, r.newest_us, r.reason) for r in drops.result().collect())
    reason = "last updated 7200s ago, max age is 7200s"
    assert found() == [(1, at(0), "Ready", at(0), None), (2, at(0), "Ready", at(0), None), (2, at(2), "Drifted", at(0), reason)]
    drops.run([hour(9, 2, 6), hour(12, 3, 7)], query)
    more = [(1, at(6), "Drifted", at(4), reason), (2, at(9), "Ready", at(9), None)]
    assert found() == sorted([(1, at(0), "Ready", at(0), None), (2, at(0), "Ready", at(0), None), (2, at(2), "Drifted", at(0), reason), *more])


def test_a_backlog_goes_bucket_by_bucket(spark, monkeypatch):
    monkeypatch.setattr(O, "DELAYS", 1)
    monkeypatch.setattr(O.Frames, "ROWS", 10)
    rows = rows_of(400, 2, assets=1)
    drops = Drops(spark)
    drops.run(rows, lambda df: S.stream_guardrail(df, "5 minutes"))
    found = sorted((r.id, r.kind, r.streak, r.wait_s) for r in drops.result().collect())
    assert found == guarded([(r[3], r[4], bool(r[5]), r[2]) for r in applied(rows, 300)])


def test_state_calls_follow_the_slots_and_not_the_keys(spark):
    """A null key is a key of its own, and one slot holds as many keys as there are."""
    rows = [(None if n % 50 == 0 else n % 50, T0 + dt.timedelta(minutes=n // 50), n, False, False, n // 50 % 2 == 1) for n in range(200)]
    drops = Drops(spark)
    query = lambda df: O.apply_in_order(df.select("asset", "ts", "id", "ready"), "asset", "ts", "id", S.Transitions(), "30 minutes", slots=1)
    drops.run(rows[100:] + rows[:100], query)
    drops.run([(1, T0 + dt.timedelta(hours=3), 999, False, False, False)], query)
    found = sorted((r.asset or 0, r.evaluation_id) for r in drops.result().collect())
    assert found == sorted((n % 50, n) for n in range(200) if n // 50 % 2 == 1)
    assert drops.result().where("asset is null").count() == 2
    states = spark.read.format("statestore").option("stateVarName", "states").load(drops.checkpoint)
    assert states.count() == 1


def test_links_meet_in_buckets_and_none_is_lost(spark, tmp_path):
    """Syncs and evaluations at and around the bounds of buckets and of the interval."""
    hour, base = 3600, round(T0.timestamp()) // 21600 * 21600
    at = lambda s: dt.datetime.fromtimestamp(base + s, dt.timezone.utc)
    offsets = [0, 1, 3 * hour, 6 * hour - 1, 6 * hour, 6 * hour + 1, 9 * hour, 12 * hour, 12 * hour + 1, 30 * hour]
    rows = [(a, at(s), n) for a in (1, 2) for n, s in enumerate(offsets)]
    ship_package(spark)
    spark.createDataFrame(rows, "asset long, ts timestamp, n long").coalesce(1).write.parquet(str(tmp_path / "rows"))
    stream = lambda name: spark.readStream.schema("asset long, ts timestamp, n long").parquet(str(tmp_path / "rows")).withColumnRenamed("n", name)
    linked = S.stream_link(stream("execution_id"), stream("evaluation_id"), "6 HOURS", "1 hour")
    assert re.search(r"bucket#\d+L? = s_bucket#\d+", linked._jdf.queryExecution().analyzed().toString())
    path = scratch_dir(spark)
    S.run_to_end(linked, path, scratch_dir(spark))
    found = sorted((r.asset, r.execution_id, r.evaluation_id) for r in S.read_result(spark, path).collect())
    assert found == [(a, n, m) for a in (1, 2) for n, s in enumerate(offsets) for m, e in enumerate(offsets) if s < e <= s + 6 * hour]
