"""The event log: hash chain, replay into snapshots, summaries. Events are (run_id, ord, event_id, ts, type, payload)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Event types that a timeline shows.
MAJOR = ["RUN_CREATED", "RUN_STATE_CHANGED", "WORK_ITEM_QUEUED", "WORK_ITEM_STARTED", "WORK_ITEM_FINISHED", "ARTIFACT_WRITTEN", "GATE_RUN_FINISHED", "ISSUE_OPENED", "ISSUE_RESOLVED", "PR_OPENED"]
TERMINAL = ["DONE", "FAILED", "CANCELLED"]


def event_hash(event_id: Column, ts: Column, kind: Column, payload: Column, prev: Column) -> Column:
    """sha256 of the fields one after the other; payload is JSON text with sorted keys."""
    return F.sha2(F.concat(event_id, ts, kind, payload, F.coalesce(prev, F.lit(""))), 256)


def chain_breaks(events: DataFrame) -> DataFrame:
    """Rows (with prev_hash and event_hash as text) that break their run's chain; rows without either hash are passed over."""
    own = events.where("event_hash is not null and prev_hash is not null")
    own = own.withColumn("before", F.lag("event_hash").over(Window.partitionBy("run_id").orderBy("ord")))
    right = event_hash(F.col("event_id"), F.col("ts"), F.col("type"), F.col("payload"), F.col("prev_hash"))
    reason = F.when(F.col("before").isNotNull() & (F.col("before") != F.col("prev_hash")), "prev_hash").when(right != F.col("event_hash"), "event_hash")
    return own.withColumn("reason", reason).where("reason is not null").select("run_id", "ord", "event_id", "reason")


def field(name: str) -> Column:
    return F.get_json_object("payload", f"$.{name}")


def replay(events: DataFrame) -> DataFrame:
    """A snapshot per run. The fold decomposes: the last state, the last write of each artifact, the first queued
    item of each id with its last start and finish; each an aggregate by key. Issues, gates and sections: state.snapshot()."""
    state = events.where("type = 'RUN_STATE_CHANGED'").where(field("new_state").isNotNull()).groupBy("run_id").agg(F.max_by(field("new_state"), "ord").alias("run_state"))
    artifacts = events.where("type = 'ARTIFACT_WRITTEN'").groupBy("run_id", field("name").alias("name")).agg(F.max_by(F.struct(field("path").alias("path"), field("sha256").alias("sha256"), "ts", "event_id"), "ord").alias("entry")).where("name is not null")
    artifacts = artifacts.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "entry")))).alias("artifacts"))
    at = lambda kind, f: F.when(F.col("type") == kind, f)
    own = events.where(F.col("type").startswith("WORK_ITEM_")).withColumn("id", field("work_item_id"))
    queued = F.min(at("WORK_ITEM_QUEUED", F.col("ord"))).over(Window.partitionBy("run_id", "id"))
    own = own.withColumn("queued", queued).where(F.col("ord") >= F.col("queued"))  # what comes before an item is queued moves nothing
    items = own.groupBy("run_id", "id").agg(
        F.min("queued").alias("queued"),
        F.max_by(at("WORK_ITEM_STARTED", F.col("ts")), at("WORK_ITEM_STARTED", F.col("ord"))).alias("started_at"),
        F.max_by(at("WORK_ITEM_FINISHED", F.col("ts")), at("WORK_ITEM_FINISHED", F.col("ord"))).alias("finished_at"),
        F.max_by(F.when(F.col("type") == "WORK_ITEM_STARTED", "running").otherwise("finished"), F.when(F.col("type") != "WORK_ITEM_QUEUED", F.col("ord"))).alias("moved"),
    )
    items = items.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("queued", "id", F.coalesce("moved", F.lit("queued")).alias("status"), "started_at", "finished_at"))).alias("work_items"))
    runs = events.groupBy("run_id").agg(F.count("*").alias("n_events"), F.max("ord").alias("last_ord"))
    return runs.join(state, "run_id", "left").join(artifacts, "run_id", "left").join(items, "run_id", "left")


def numbered(events: DataFrame, width: int = 1 << 16) -> DataFrame:
    """events with number: an event's place in its run, from 1. Places are counted within stretches of `width` ords and
    moved by the counts of earlier stretches, so a task orders at most one stretch of a run."""
    block = F.floor(F.col("ord") / width).alias("_block")
    keyed = events.withColumn("_block", block)
    earlier = Window.partitionBy("run_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = keyed.groupBy("run_id", "_block").agg(F.count("*").alias("_n")).select("run_id", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("run_id", "_block").orderBy("ord"))
    return keyed.withColumn("_own", own).join(before, ["run_id", "_block"]).withColumn("number", F.col("_before") + F.col("_own")).drop("_block", "_own", "_before")


def replay_from(events: DataFrame, after: int) -> DataFrame:
    """What a resume has to read: events after the checkpoint's count."""
    return events.where(F.col("ord") > after)


def run_list(snapshots: DataFrame, events: DataFrame, **equal: str) -> DataFrame:
    """Runs with their first and (in terminal states) last time."""
    times = events.groupBy("run_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last"))
    met = snapshots.join(times, "run_id").withColumn("finished_at", F.when(F.col("run_state").isin(TERMINAL), F.col("last"))).drop("last")
    for k, v in equal.items():
        met = met.where(F.col(k) == v) if v else met
    return met


def timeline(events: DataFrame) -> DataFrame:
    message = (
        F.when(F.col("type") == "RUN_STATE_CHANGED", F.concat(F.lit("state: "), F.coalesce(field("new_state"), F.lit("?"))))
        .when(F.col("type") == "ARTIFACT_WRITTEN", F.concat(F.lit("wrote "), F.coalesce(field("name"), F.lit("?"))))
        .when(F.col("type").startswith("WORK_ITEM_"), F.concat(F.lower(F.regexp_replace("type", "WORK_ITEM_", "")), F.lit(" "), F.coalesce(field("work_item_id"), F.lit("?"))))
        .otherwise(F.lower("type"))
    )
    return events.where(F.col("type").isin(MAJOR)).select("run_id", "ord", "ts", "type", message.alias("message"))


def run_summary(events: DataFrame) -> DataFrame:
    """Duration, finished and failed work items (by the success field), and the number of timeline rows."""
    done = F.col("type") == "WORK_ITEM_FINISHED"
    return events.groupBy("run_id").agg(
        (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("duration_us"), F.count_if(done & ~(F.coalesce(field("success"), F.lit("true")) == "false")).alias("n_finished"),
        F.count_if(done & (field("success") == "false")).alias("n_failed"), F.count_if(F.col("type").isin(MAJOR)).alias("n_timeline"),
    )


def incomplete_workers(events: DataFrame, workers: DataFrame) -> DataFrame:
    done = events.where("type = 'WORK_ITEM_FINISHED'").select("run_id", field("work_item_id").alias("worker")).distinct()
    return events.select("run_id").distinct().join(F.broadcast(workers.select("worker").agg(F.collect_set("worker").alias("w")))).select("run_id", F.explode("w").alias("worker")).join(done, ["run_id", "worker"], "left_anti")


def completeness(present: DataFrame, required: list[str]) -> DataFrame:
    """present (run_id, name): percent of the required names."""
    return present.groupBy("run_id").agg((100 * F.count_distinct(F.when(F.col("name").isin(required), F.col("name"))) / len(required)).alias("score"))
