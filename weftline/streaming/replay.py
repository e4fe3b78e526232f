"""The event log as a stream: incremental replay, idempotent ingest, call pairing, windows.

Streams have event time in ts (timestamp) and hold state for a bounded time by watermark.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SNAPSHOT = "run_id string, run_state string, n_events long, last_ord long, artifacts string, work_items string, issues string, gates string, sections string"
_STATE = "snapshot string"


def reduce_event(snapshot: dict, event: dict) -> dict:
    """One event folded into a snapshot; unknown types only count."""
    payload, kind = json.loads(event["payload"] or "{}"), event["type"]
    item = payload.get("work_item_id")
    if kind == "RUN_STATE_CHANGED" and payload.get("new_state"):
        snapshot["run_state"] = payload["new_state"]
    elif kind == "ARTIFACT_WRITTEN" and payload.get("name"):
        snapshot["artifacts"][payload["name"]] = event["ord"]
    elif kind == "WORK_ITEM_QUEUED":
        snapshot["work_items"].setdefault(item, "queued")
    elif kind in ("WORK_ITEM_STARTED", "WORK_ITEM_FINISHED") and item in snapshot["work_items"]:
        snapshot["work_items"][item] = "running" if kind == "WORK_ITEM_STARTED" else "finished"
    elif kind == "ISSUE_OPENED" and payload.get("issue"):
        snapshot["issues"].append([payload["issue"].get("issue_id"), "OPEN"])
    elif kind == "ISSUE_RESOLVED":
        for own in snapshot["issues"]:
            if own[0] == payload.get("issue_id"):
                own[1] = "RESOLVED"
                break
    elif kind == "GATE_RUN_FINISHED":
        snapshot["gates"][payload.get("gate")] = payload.get("ok")
    elif kind == "SECTION_STATE_CHANGED":
        snapshot["sections"][payload.get("section")] = payload.get("new_state")
    snapshot["n_events"] += 1
    snapshot["last_ord"] = max(snapshot["last_ord"], event["ord"])
    return snapshot


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    snapshot = json.loads(state.get[0]) if state.exists else {"run_state": None, "artifacts": {}, "work_items": {}, "issues": [], "gates": {}, "sections": {}, "n_events": 0, "last_ord": -1}
    rows = pd.concat(list(batches)).sort_values("ord")
    for event in rows.to_dict("records"):
        snapshot = reduce_event(snapshot, event)
    state.update((json.dumps(snapshot, sort_keys=True),))
    yield pd.DataFrame({
        "run_id": [key[0]], "run_state": [snapshot["run_state"]], "n_events": [snapshot["n_events"]], "last_ord": [snapshot["last_ord"]],
        **{k: [json.dumps(snapshot[k], sort_keys=True)] for k in ("artifacts", "work_items", "issues", "gates", "sections")},
    })


def replay_stream(events: DataFrame) -> DataFrame:
    """A snapshot of each run after each micro-batch that has events of it (update mode); the state survives
    restarts in the checkpoint. Events of a run arrive in order over micro-batches."""
    own = events.select(F.col("run_id").cast("string").alias("run_id"), F.col("ord").cast("long").alias("ord"), "type", "payload")
    return own.groupBy("run_id").applyInPandasWithState(_fold, SNAPSHOT, _STATE, "update", GroupStateTimeout.NoTimeout)


def ingest_once(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event_id once, however often it is delivered within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def pair_calls_stream(starts: DataFrame, finishes: DataFrame, delay: str = "10 minutes", longest: str = "1 hour") -> DataFrame:
    """Starts (call_id, started_at) with the finish of the call within the longest time: an interval join."""
    a = starts.withWatermark("started_at", delay)
    b = finishes.withColumnRenamed("call_id", "finished_call").withWatermark("finished_at", delay)
    met = a.join(b, F.expr(f"call_id = finished_call AND finished_at >= started_at AND finished_at <= started_at + INTERVAL {longest}"), "leftOuter")
    return met.select("call_id", "started_at", "finished_at")


def windowed_counts(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows, late ones within the delay (an extension)."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")


def upsert_sink(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: a table of the newest row of each key, each batch written beside the last and named by
    its number, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        out = f"{path}/{number % 2}"
        if number:
            old = spark.read.parquet(f"{path}/{(number - 1) % 2}")
            batch = batch.unionByName(old.join(batch.select(key), key, "left_anti"))
        batch.write.mode("overwrite").parquet(out)

    return write


def with_dead_letters(write: Callable[[DataFrame], None], path: str, tries: int = 3) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that tries a batch again and in the end keeps it as dead letters, never drops it."""

    def run(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for k in range(tries):
                try:
                    return write(kept)
                except Exception:  # whatever the outside sink raises
                    if k == tries - 1:
                        kept.write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            kept.unpersist()

    return run
