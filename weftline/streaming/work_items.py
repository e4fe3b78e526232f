"""The state machine of work items as a stream with typed state of bounded age.

For each run the state holds a map from item to status and the place of the newest event. Every event comes out as the
row that state.transitions() gives it in batch; illegal moves name a reason. Events at or before the newest place of
their run (delivered again, or out of order over micro-batches) come out as "late" and move nothing. When the watermark
has passed a run's newest event by `keep_ms`, items that haven't finished come out as "expired" and the run's state is
let go, so state grows with the runs of that time, not with the log. The state survives restarts in the checkpoint.

The session has to use the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.events import field
from ..operators.state import MOVES

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "run_id string, work_item_id string, ord long, event string, before string, after string, reason string"
_row = Row(*(c.split()[0] for c in OUT.split(", ")))


def move(event: str, before: str | None) -> tuple[str | None, str | None]:
    """Status after the event, and why the move is illegal (None: it is legal)."""
    to, wanted = MOVES[event]
    if wanted is None:
        return (to, None) if before is None else (before, "queued again")
    if before is None:
        return None, "unknown item"
    return to, None if before == wanted else f"not {wanted}"


class WorkItems(StatefulProcessor):
    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "id string", "status string, ord long")
        self.newest = handle.getValueState("newest", "ord long, due long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        run_id, (last, due) = key[0], self.newest.get() if self.newest.exists() else (-1, None)
        latest = 0
        for r in sorted(rows, key=lambda r: r.ord):
            latest = max(latest, r.ms)
            if r.work_item_id is None:
                yield _row(run_id, None, r.ord, r.event, None, None, "no id")
                continue
            own = (r.work_item_id,)
            before = self.items.getValue(own)[0] if self.items.containsKey(own) else None
            if r.ord <= last:
                yield _row(run_id, r.work_item_id, r.ord, r.event, before, before, "late")
                continue
            last = r.ord
            after, reason = move(r.event, before)
            if after is not None and after != before:
                self.items.updateValue(own, (after, r.ord))
            yield _row(run_id, r.work_item_id, r.ord, r.event, before, after, reason)
        if due is None or latest + self.keep_ms > due:
            if due is not None:
                self.handle.deleteTimer(due)
            due = latest + self.keep_ms
            self.handle.registerTimer(due)
        self.newest.update((last, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for (item,), (status, place) in sorted(self.items.iterator()):
            if status != "finished":
                yield _row(key[0], item, place, None, status, status, "expired")
        self.items.clear()
        self.newest.clear()

    def close(self) -> None:
        pass


def work_item_stream(events: DataFrame, keep_ms: int = 3_600_000, delay: str = "10 minutes") -> DataFrame:
    """events (run_id, ord, ts timestamp, type, payload) as a stream: the rows of OUT, in append mode."""
    if events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    own = events.where(F.col("type").isin(list(MOVES))).withWatermark("ts", delay)
    own = own.select(F.col("run_id").cast("string").alias("run_id"), F.col("ord").cast("long").alias("ord"), "ts", F.unix_millis("ts").alias("ms"), field("work_item_id").alias("work_item_id"), F.col("type").alias("event"))
    return own.groupBy("run_id").transformWithState(WorkItems(keep_ms), OUT, "append", "eventTime")
