"""Folds that also wake up by themselves: what is due goes out without a further event, and silent keys leave no state.

A timed fold is a fold with two more functions: when a state is due, and what happens then. Over a log, replay() lets
time pass between events; over a stream, follow() keeps one timer a key, by event time or by the clock.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tarnfold.streaming import folds

#: The name of Spark's state store that holds timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class TimedFold:
    """fold: (state, event with ts) -> (state, outputs); due: state -> its time, or None; expire: (state, time) -> (state, outputs).

    Times are milliseconds. A state of None is not kept.
    """

    fold: folds.Fold
    due: Callable[[Any], int | None]
    expire: Callable[[Any, int], tuple[Any, list[tuple]]]

    def until(self, state: Any, now: int) -> tuple[Any, list[tuple]]:
        """What is due up to now, each at its own time."""
        out: list[tuple] = []
        while state is not None and (at := self.due(state)) is not None and at <= now:
            state, rows = self.expire(state, at)
            out += rows
        return state, out

    def step(self, state: Any, event: dict) -> tuple[Any, list[tuple]]:
        state, before = self.until(state, event["ts"])
        if event.get("_end"):
            return state, before
        state, rows = self.fold(state, event)
        return state, before + rows


def throttle(gap_ms: int, forget_ms: int | None = None) -> TimedFold:
    """The first value (payload) at once, then changed values at most every gap; a held one comes when the gap is over.

    Output: ts, payload. forget_ms: a key without events for so long after its last value is forgotten.
    """

    def due(s: dict) -> int | None:
        if s["held"] is not None:
            return s["at"] + gap_ms
        return None if forget_ms is None else s["seen"] + forget_ms

    def expire(s: dict, now: int) -> tuple[Any, list[tuple]]:
        if s["held"] is None:
            return None, []
        changed = s["held"] != s["sent"]
        return s | {"at": now if changed else s["at"], "sent": s["held"], "held": None}, [(now, s["held"])] * changed

    def fold(s: dict | None, e: dict) -> tuple[Any, list[tuple]]:
        s = s or {"at": None, "sent": None, "held": None}
        s |= {"seen": e["ts"]}
        if s["at"] is not None and e["ts"] < s["at"] + gap_ms:
            return s | {"held": e["payload"]}, []
        if e["payload"] == s["sent"]:
            return s, []
        return s | {"at": e["ts"], "sent": e["payload"]}, [(e["ts"], e["payload"])]

    return TimedFold(fold, due, expire)


def registry(ttl_ms: int) -> TimedFold:
    """Runners by their beats: each comes up with its first beat and goes when none came for its time to live. Output: ts, up."""

    def fold(s: dict | None, e: dict) -> tuple[Any, list[tuple]]:
        return {"seen": max(e["ts"], (s or e)["seen" if s else "ts"])}, [] if s else [(e["ts"], True)]

    return TimedFold(fold, lambda s: s["seen"] + ttl_ms, lambda s, now: (None, [(now, False)]))


def replay(log: DataFrame, keys: list[str], timed: TimedFold, schema: str, until: int | None = None, order: str = "seq") -> DataFrame:
    """The outputs over a log whose events are in the order of ts, then `order`; what is due up to `until` (None: ever) at the end."""
    ends = log.select(*keys).distinct().withColumns({"ts": F.lit((1 << 62) if until is None else until).cast("long"), "_end": F.lit(True)})
    both = log.withColumn("_end", F.lit(False)).unionByName(ends, allowMissingColumns=True)
    return folds.replay(both.withColumn("_at", F.struct("_end", "ts", order)), keys, timed.step, schema, order="_at")


class Processor(StatefulProcessor):
    """A timed fold over the events of a key: its state as text, and the timer that is set."""

    def __init__(self, timed: TimedFold, keys: list[str], names: list[str], order: str, by_clock: bool):
        self.timed, self.keys, self.names, self.order, self.by_clock = timed, keys, names, order, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "state string, timer long")

    def keep(self, state: Any, timer: int | None) -> None:
        due = None if state is None else self.timed.due(state)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if state is None:
            self.kept.clear()
        else:
            self.kept.update((json.dumps(state), due))

    def load(self) -> tuple[Any, int | None]:
        if not self.kept.exists():
            return None, None
        text, timer = self.kept.get()
        return json.loads(text), timer

    def rows(self, key: tuple, out: list[tuple]) -> Iterator[Row]:
        make = Row(*self.keys, *self.names)
        return (make(*key, *r) for r in out)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state, timer = self.load()
        out: list[tuple] = []
        events = [r.asDict() for r in rows]
        if self.by_clock:
            now = timerValues.getCurrentProcessingTimeInMs()
            events = [e | {"ts": now} for e in sorted(events, key=lambda e: e[self.order])]
        for e in sorted(events, key=lambda e: (e["ts"], e[self.order])):
            state, more = self.timed.step(state, e)
            out += more
        self.keep(state, timer)
        return self.rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        state, timer = self.load()
        if state is None:
            return iter(())
        at = expiredTimerInfo.getExpiryTimeInMs()
        state, out = self.timed.until(state, at)
        self.keep(state, None if timer == at else timer)
        return self.rows(key, out)


def follow(stream: DataFrame, keys: list[str], timed: TimedFold, schema: str, order: str = "seq", by_clock: bool = False) -> DataFrame:
    """The same over a stream with the columns ts (milliseconds), `order` and what the fold reads.

    by_clock: times are those at which events come in, and timers go by the clock; else by event time, for which the
    stream needs a watermark. The session needs STORE as its state store: with_timers() sets it.
    """
    types = dict(stream.dtypes)
    full = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + schema
    names = [c.split()[0] for c in schema.split(", ")]
    return stream.groupBy(*keys).transformWithState(Processor(timed, keys, names, order, by_clock), full, "append", "ProcessingTime" if by_clock else "EventTime")


def with_timers(spark: SparkSession) -> SparkSession:
    """The session, with the state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark
