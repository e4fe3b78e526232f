"""Snapshots of runs as a stream: typed state, changed entries out, state of bounded age.

Each run's snapshot lies in map states (artifacts, work items, gates, sections, openings of issues by place), so an event
reads and writes only what it names. After each micro-batch the entries that it changed come out, in the form of
operators.snapshots.entries(), as upserts by (run_id, kind, key) and, for issues, n1. Applied one after the other they
make the entries of state.snapshot() over the same events. Events at or before the newest place of their run have been
seen and change nothing. When the watermark has passed a run's newest event by `keep_ms`, its state is let go and one
row of kind "expired" says so.

The session has to use the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.snapshots import _things
from .work_items import ROCKSDB

OUT = "run_id string, kind string, key string, status string, n1 long, n2 long, n3 long"
_row = Row(*(c.split()[0] for c in OUT.split(", ")))


class Held:
    """A map state read through a cache, which remembers what a micro-batch has changed."""

    def __init__(self, state):
        self.state, self.cache, self.changed = state, {}, {}

    def get(self, key):
        if key not in self.cache:
            self.cache[key] = self.state.getValue((key,)) if self.state.containsKey((key,)) else None
        return self.cache[key]

    def put(self, key, value: tuple) -> None:
        self.cache[key] = self.changed[key] = value

    def flush(self) -> Iterator[tuple]:
        for key, value in self.changed.items():
            self.state.updateValue((key,), value)
            yield key, value


class RunSnapshots(StatefulProcessor):
    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "state string, n_events long, last_ord long, due long")
        self.maps = {
            "artifact": handle.getMapState("artifacts", "name string", "path string, at long, event_id long"),
            "item": handle.getMapState("items", "id string", "status string, queued long, started long, finished long"),
            "gate": handle.getMapState("gates", "gate string", "ok string"),
            "section": handle.getMapState("sections", "section string", "state string"),
            "issue": handle.getMapState("issues", "ord long", "issue_id string, status string, resolved long"),
            "first": handle.getMapState("first_openings", "issue_id string", "ord long"),
        }

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, n, last, due = self.run.get() if self.run.exists() else (None, 0, -1, None)
        held = {name: Held(m) for name, m in self.maps.items()}
        latest, began = 0, last
        for r in sorted(rows, key=lambda r: r.ord):
            latest = max(latest, r.micros // 1000)
            if r.ord <= last:
                continue
            last, n = r.ord, n + 1
            if r.kind == "state":
                state = r.value
            elif r.kind is not None:
                _MOVES[r.kind](held, r)
        if due is None or latest + self.keep_ms > due:
            if due is not None:
                self.handle.deleteTimer(due)
            due = latest + self.keep_ms
            self.handle.registerTimer(due)
        self.run.update((state, n, last, due))
        if last == began:
            return
        yield _row(key[0], "run", "", state, n, last, None)
        for name, path_at_event in held["artifact"].flush():
            path, at, event_id = path_at_event
            yield _row(key[0], "artifact", name, path, at, event_id, None)
        for item, (status, queued, started, finished) in held["item"].flush():
            yield _row(key[0], "item", item, status, queued, started, finished)
        for place, (issue_id, status, resolved) in held["issue"].flush():
            yield _row(key[0], "issue", issue_id, status, place, resolved, None)
        for name in ("gate", "section"):
            for thing, (status,) in held[name].flush():
                yield _row(key[0], name, thing, status, None, None, None)
        for _ in held["first"].flush():
            pass

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, n, last, _ = self.run.get()
        for m in self.maps.values():
            m.clear()
        self.run.clear()
        yield _row(key[0], "expired", "", state, n, last, None)

    def close(self) -> None:
        pass


def _queued(held: dict[str, Held], r: Row) -> None:
    if held["item"].get(r.key) is None:
        held["item"].put(r.key, ("queued", r.ord, None, None))


def _started(held: dict[str, Held], r: Row) -> None:
    if (own := held["item"].get(r.key)) is not None:
        held["item"].put(r.key, ("running", own[1], r.micros, own[3]))


def _finished(held: dict[str, Held], r: Row) -> None:
    if (own := held["item"].get(r.key)) is not None:
        held["item"].put(r.key, ("finished", own[1], own[2], r.micros))


def _opened(held: dict[str, Held], r: Row) -> None:
    held["issue"].put(r.ord, (r.key, "OPEN", None))
    if r.key is not None and held["first"].get(r.key) is None:
        held["first"].put(r.key, (r.ord,))


def _resolved(held: dict[str, Held], r: Row) -> None:
    if r.key is not None and (first := held["first"].get(r.key)) is not None:
        held["issue"].put(first[0], (r.key, "RESOLVED", r.micros))


_MOVES: dict[str, Callable[[dict[str, Held], Row], None]] = {
    "artifact": lambda held, r: held["artifact"].put(r.key, (" ".join(x for x in (r.value, r.extra) if x is not None), r.micros, r.event_number)),
    "queued": _queued, "started": _started, "finished": _finished, "opened": _opened, "resolved": _resolved,
    "gate": lambda held, r: held["gate"].put(r.key, (r.value,)),
    "section": lambda held, r: held["section"].put(r.key, (r.value,)),
}


def snapshot_stream(events: DataFrame, keep_ms: int = 86_400_000, delay: str = "10 minutes") -> DataFrame:
    """events (run_id, ord, event_id, ts timestamp, type, payload) as a stream: the rows of OUT, in update mode."""
    if events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    things = F.filter(_things(exploded=False), lambda x: x["kind"] != "run")
    own = events.withWatermark("ts", delay).withColumn("x", F.get(things, F.lit(0)))
    own = own.withColumn("x", F.when(F.col("x.key").isNotNull() | F.col("x.kind").isin("opened", "resolved"), F.col("x")))  # items without an id count in the run alone
    own = own.select(F.col("run_id").cast("string").alias("run_id"), F.col("ord").cast("long").alias("ord"), "ts", F.unix_micros("ts").alias("micros"), F.expr("try_cast(event_id as long)").alias("event_number"), "x.kind", "x.key", "x.value", "x.extra")
    return own.groupBy("run_id").transformWithState(RunSnapshots(keep_ms), OUT, "update", "eventTime")
