"""Rules that need a key's rows in the order of event time, whatever order they arrive in.

Keys are dealt over ``SLOTS`` slots by hash, and a slot has one state: a call between Python and the state costs some
0.4 ms, so that calls for each key would take most of the time. Rows wait in a map state, by time bucket as wide as ``DELAYS`` delays of the watermark, and a timer of event time is
set for the first of them. When the watermark passes it, the rows behind the watermark are applied in the
order of (us, id), bucket by bucket, and the rest goes on waiting. So late rows within the delay give the
same result as rows in order, rows later than that are dropped by Spark, and a slot's rows in memory are
those of one bucket or some ``HELD`` rows, not those of a micro-batch. The rule's states of a slot's keys
are one packed array. Rows ahead of the watermark at a
stream's end stay in the state, for a restart from its checkpoint.

The state is that of ``transformWithState``, which needs the RocksDB state store: ``keep_state_in_rocksdb``
sets it for a session that has no store of its own choice.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Delays in a bucket. Applied rows leave it, so in a steady stream it holds what the delay holds, and a backlog comes bucket by bucket.
DELAYS = 100
#: Slots over which keys are dealt, and rows that a slot takes up at once.
SLOTS, HELD = 512, 100_000
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}

State = tuple
Found = dict[str, np.ndarray]


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Use RocksDB for state unless the session names a store of its own."""
    if "RocksDB" not in (spark.conf.get(STORE, None) or ""):
        spark.conf.set(STORE, ROCKSDB)


def seconds_of(delay: str) -> int:
    """Seconds of a delay like ``1 hour`` or ``30 minutes``."""
    parts = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day)s?\s*", delay)
    if not parts:
        raise ValueError(f"a delay is a whole number of seconds, minutes, hours or days, not {delay!r}")
    return int(parts[1]) * UNITS[parts[2]]


class Rule:
    """What is done with the rows of a key in order. State is a tuple of plain values.

    ``apply`` gets the rows that are due, sorted; ``passed`` is told the watermark after them; ``wake`` names
    the time (us) at which the watermark's passing matters without a row, if any.
    """

    fields: dict[str, str]
    state: str
    output: str
    start: State

    def apply(self, state: State, rows: np.ndarray) -> tuple[State, Found]:
        raise NotImplementedError

    def passed(self, state: State, watermark: int) -> tuple[State, Found]:
        return state, {}

    def wake(self, state: State) -> int | None:
        return None


class Frames:
    """Result columns of several keys, put together into frames of ``ROWS`` rows or a little more."""

    ROWS = 20_000

    def __init__(self, name: str):
        self.name, self.keys, self.parts, self.size = name, [], [], 0

    def add(self, key: int | None, found: Found) -> Iterator[pd.DataFrame]:
        size = len(next(iter(found.values()))) if found else 0
        if size:
            self.keys += [key] * size
            self.parts.append(found)
            self.size += size
        if self.size >= self.ROWS:
            yield from self.rest()

    def rest(self) -> Iterator[pd.DataFrame]:
        if self.parts:
            yield pd.DataFrame({self.name: pd.array(self.keys, "Int64")} | {c: np.concatenate([p[c] for p in self.parts]) for c in self.parts[0]})
        self.keys, self.parts, self.size = [], [], 0


class InOrder(StatefulProcessor):
    """Runs a rule for each key of a slot; see the module."""

    def __init__(self, rule: Rule, key: str, width_us: int):
        self.rule, self.key, self.width = rule, key, max(1, width_us)
        self.dtype = np.dtype([("null", "?"), ("key", "i8"), ("us", "i8"), ("id", "i8"), *rule.fields.items()])
        kinds = {"long": "i8", "boolean": "?"}
        self.packed = np.dtype([("null", "?"), ("key", "i8"), *((c.split()[0], kinds[c.split()[1]]) for c in rule.state.split(", "))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long", "rows binary")
        self.state = handle.getValueState("states", "packed binary")

    def _wake_at(self, us: int, after: int = -1) -> None:
        self.handle.registerTimer(max(-(-us // 1000) - 1, after + 1, 0))  # a timer has expired once the watermark is greater

    def _wait(self, rows: np.ndarray) -> None:
        bucket = rows["us"] // self.width
        for b in np.unique(bucket).tolist():
            held = self.waiting.getValue((b,))
            self.waiting.updateValue((b,), ((bytes(held[0]) if held else b"") + rows[bucket == b].tobytes(),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        least, parts, size = None, [], 0
        for frame in rows:
            part = np.empty(len(frame), self.dtype)
            part["null"] = frame[self.key].isna()
            for c, name in (("key", self.key), *((c, c) for c in self.dtype.names[2:])):
                part[c] = frame[name].fillna(0).to_numpy(self.dtype[c])
            if len(part):
                least = int(part["us"].min() if least is None else min(least, part["us"].min()))
            parts.append(part)
            size += len(part)
            if size >= HELD:
                self._wait(np.concatenate(parts))
                parts, size = [], 0
        if size:
            self._wait(np.concatenate(parts))
        if least is not None:
            self._wake_at(least)
        return iter(())

    def _apply(self, states: dict[int | None, State], rows: np.ndarray, held: Frames) -> Iterator[pd.DataFrame]:
        rows = rows[np.lexsort((rows["id"], rows["us"], rows["key"], rows["null"]))]
        first = np.flatnonzero(np.concatenate([[True], (rows["key"][1:] != rows["key"][:-1]) | (rows["null"][1:] != rows["null"][:-1])]))
        names = [None if null else k for null, k in rows[["null", "key"]][first].tolist()]
        for key, at, end in zip(names, first.tolist(), [*first[1:].tolist(), len(rows)], strict=True):
            states[key], found = self.rule.apply(states.get(key, self.rule.start), rows[at:end])
            yield from held.add(key, found)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        packed = np.frombuffer(bytes(self.state.get()[0]), self.packed) if self.state.exists() else np.empty(0, self.packed)
        states = {None if null else k: tuple(state) for null, k, *state in packed.tolist()}
        held, rest, done, parts, size = Frames(self.key), None, [], [], 0
        for b in sorted(k[0] for k in list(self.waiting.keys())):
            if b * self.width > watermark:
                rest = b * self.width
                break
            rows = np.frombuffer(bytes(self.waiting.getValue((b,))[0]), self.dtype)
            due = rows["us"] <= watermark
            parts.append(rows[due])
            size += len(parts[-1])
            if size >= HELD:
                yield from self._apply(states, np.concatenate(parts), held)
                parts, size = [], 0
            if not due.all():
                if due.any():
                    self.waiting.updateValue((b,), (rows[~due].tobytes(),))
                rest = int(rows["us"][~due].min())
                break
            done.append(b)
        if size:
            yield from self._apply(states, np.concatenate(parts), held)
        if rest is None:
            self.waiting.clear()
        else:
            for b in done:
                self.waiting.removeKey((b,))
        wake = [] if rest is None else [rest]
        for k, before in states.items():
            states[k], found = self.rule.passed(before, watermark)
            yield from held.add(k, found)
            at = self.rule.wake(states[k])
            if at is not None:
                wake.append(at)
        yield from held.rest()
        self.state.update((np.array([(k is None, k or 0, *s) for k, s in states.items()], self.packed).tobytes(),))
        if wake:
            self._wake_at(min(wake), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def apply_in_order(df: DataFrame, key: str, ts: str, number: str, rule: Rule, delay: str, slots: int = SLOTS) -> DataFrame:
    """``rule.output`` for the rows of each key, a long, in the order of (ts, number); rows more than ``delay`` late are dropped.

    A stream keeps its number of slots as long as its checkpoint.
    """
    slot = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(slots)).cast("int").alias("__slot")
    rows = df.withWatermark(ts, delay).select(slot, F.col(key).cast("long").alias(key), F.col(ts), F.unix_micros(ts).alias("us"), F.col(number).cast("long").alias("id"), *rule.fields)
    width = DELAYS * seconds_of(delay) * 1_000_000
    return rows.groupBy("__slot").transformWithStateInPandas(InOrder(rule, key, width), rule.output, "append", "eventTime")
