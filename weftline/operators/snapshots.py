"""Snapshots that can be stored, merged and resumed: state as a table of registers.

A register is what one thing of a run (its state, an artifact, a gate, a section, a work item's queueing, start or
finish, an issue's opening or resolution) keeps of the events about it: how many there were, the first place and the
last event. Registers of two disjoint stretches of a log merge by sum, least and latest, so
merge(fold(a), fold(b)) equals fold(a and b) in any order, and assemble() makes of them what state.snapshot() makes of
the events. Folding and merging are aggregations by (run, kind, key), combined before they travel: a run of any length
is no single task's work. Only assembling gathers a run's registers, which are its snapshot.

Events are (run_id, ord, event_id, ts, type, payload). An event without the field that names its thing counts in the
run alone. Starts and finishes before an item is queued, and resolutions before an issue is opened, move nothing, also
where the two lie on different sides of a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .events import chain_breaks, field

_KEYS = ["run_id", "kind", "key", "part"]


def _things(exploded: bool = True) -> Column:
    """The registers an event writes, as an array or a row each: kind, key, part (which tells openings of one id apart), value, extra."""
    a = lambda kind, key, value=F.lit(None), part=F.lit(None), extra=F.lit(None): F.struct(
        F.lit(kind).alias("kind"), key.cast("string").alias("key"), part.cast("long").alias("part"), value.cast("string").alias("value"), extra.cast("string").alias("extra")
    )
    kind = F.col("type")
    item = field("work_item_id")
    own = (
        F.when((kind == "RUN_STATE_CHANGED") & field("new_state").isNotNull(), a("state", F.lit(""), field("new_state")))
        .when((kind == "ARTIFACT_WRITTEN") & field("name").isNotNull(), a("artifact", field("name"), field("path"), extra=field("sha256")))
        .when(kind == "WORK_ITEM_QUEUED", a("queued", item))
        .when(kind == "WORK_ITEM_STARTED", a("started", item))
        .when(kind == "WORK_ITEM_FINISHED", a("finished", item))
        .when((kind == "ISSUE_OPENED") & field("issue").isNotNull(), a("opened", field("issue.issue_id"), part=F.col("ord")))
        .when(kind == "ISSUE_RESOLVED", a("resolved", field("issue_id")))
        .when((kind == "GATE_RUN_FINISHED") & field("gate").isNotNull(), a("gate", field("gate"), field("ok").cast("boolean")))
        .when((kind == "SECTION_STATE_CHANGED") & field("section").isNotNull(), a("section", field("section"), field("new_state")))
    )
    found = F.filter(F.array(a("run", F.lit("")), own), lambda x: x.isNotNull())
    return F.explode(found) if exploded else found


def _together(registers: DataFrame) -> DataFrame:
    return registers.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def fold(events: DataFrame) -> DataFrame:
    """run_id, kind, key, part, n, first, last (ord, value, extra, ts, event_id) of the last event."""
    each = events.select("run_id", "ord", "ts", F.col("event_id").cast("string").alias("event_id"), _things().alias("x"))
    last = F.struct("ord", F.col("x.value").alias("value"), F.col("x.extra").alias("extra"), "ts", "event_id")
    return _together(each.select("run_id", "x.kind", "x.key", "x.part", F.lit(1).cast("long").alias("n"), F.col("ord").alias("first"), last.alias("last")))


def merge(*registers: DataFrame) -> DataFrame:
    """Registers of all stretches together; the stretches have no event in common."""
    met = registers[0]
    for more in registers[1:]:
        met = met.unionByName(more)
    return _together(met)


def assemble(registers: DataFrame) -> DataFrame:
    """The snapshot of each run, with the fields of state.snapshot(). Registers are read once: those of one thing meet by
    its key, then things by their run."""
    kind, last = F.col("kind"), F.col("last")
    of = lambda name, value: F.when(kind == name, value)
    family = F.when(kind.isin("queued", "started", "finished"), "item").when(kind.isin("opened", "resolved"), "issue").otherwise(kind)
    things = registers.groupBy("run_id", family.alias("kind"), "key").agg(
        F.max("n").alias("n"), F.max("last").alias("last"), F.min(of("queued", F.col("first"))).alias("queued"),
        *(F.max(of(name, F.struct("last.ord", "last.ts"))).alias(c) for name, c in (("started", "s"), ("finished", "f"), ("resolved", "r"))),
        F.array_sort(F.collect_list(of("opened", F.col("part")))).alias("parts"),
    )
    after = lambda c: F.when(F.col(c)["ord"] > F.col("queued"), F.col(c))
    things = things.withColumn("s", after("s")).withColumn("f", after("f"))
    written = F.struct(last["value"].alias("path"), last["extra"].alias("sha256"), last["ts"].alias("ts"), last["event_id"].alias("event_id"))
    status = F.when(F.col("f.ord").isNotNull() & (F.col("s.ord").isNull() | (F.col("f.ord") > F.col("s.ord"))), "finished").when(F.col("s.ord").isNotNull(), "running").otherwise("queued")
    item = F.struct("queued", F.col("key").alias("id"), status.alias("status"), F.col("s.ts").alias("started_at"), F.col("f.ts").alias("finished_at"))

    def issue(ord_: Column, k: Column) -> Column:
        """The k-th opening of an id; a resolution after the first closes that one."""
        closed = F.coalesce((k == 0) & F.col("key").isNotNull() & (F.col("r.ord") > ord_), F.lit(False))
        return F.struct(ord_.alias("ord"), F.col("key").alias("issue_id"), F.when(closed, "RESOLVED").otherwise("OPEN").alias("status"), F.when(closed, F.col("r.ts")).alias("resolved_at"))

    gathered = lambda value: F.array_sort(F.collect_list(value))
    runs = things.groupBy("run_id").agg(
        F.max(of("run", F.col("n"))).alias("n_events"), F.max(of("run", last["ord"])).alias("last_ord"), F.max(of("state", last["value"])).alias("run_state"),
        gathered(of("artifact", F.struct(F.col("key").alias("name"), written.alias("entry")))).alias("artifacts"),
        gathered(F.when((kind == "item") & F.col("queued").isNotNull(), item)).alias("work_items"),
        F.array_sort(F.flatten(F.collect_list(of("issue", F.transform("parts", issue))))).alias("issues"),
        gathered(of("gate", F.struct(F.col("key").alias("gate"), last["value"].cast("boolean").alias("ok")))).alias("gates"),
        gathered(of("section", F.struct(F.col("key").alias("section"), last["value"].alias("section_state")))).alias("sections"),
    ).where("n_events is not null")
    some = lambda name, value: F.when(F.size(name) > 0, value).alias(name)
    maps = ("artifacts", "gates", "sections")
    parts = [some(c, F.map_from_entries(c) if c in maps else F.col(c)) for c in ("artifacts", "work_items", "issues", "gates", "sections")]
    return runs.select("run_id", "n_events", "last_ord", "run_state", *parts)


def tail(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Events past what the stored registers have seen of their run; all events of runs they don't know."""
    seen = stored.where("kind = 'run'").select("run_id", F.col("last.ord").alias("_seen"))
    return events.join(seen, "run_id", "left").where(F.col("_seen").isNull() | (F.col("ord") > F.col("_seen"))).drop("_seen")


def resumed(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Registers of the whole log: the stored ones and the tail folded onto them."""
    return merge(stored, fold(tail(events, stored)))


def resume_report(events: DataFrame, stored: DataFrame, workers: list[str]) -> DataFrame:
    """run_id, resumed_from_state (null: a fresh run), n_new (events since the checkpoint), workers_to_rerun: those that
    the stored state hasn't seen finish, in the order given."""
    known = stored.groupBy("run_id").agg(
        F.max(F.when(F.col("kind") == "state", F.col("last.value"))).alias("resumed_from_state"), F.collect_set(F.when((F.col("kind") == "finished") & F.col("key").isin(workers), F.col("key"))).alias("done"),
    )
    new = tail(events, stored).groupBy("run_id").agg(F.count("*").alias("n_new"))
    met = known.join(new, "run_id", "full")
    wanted = F.array(*map(F.lit, workers)) if workers else F.array().cast("array<string>")
    rest = F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))
    return met.select("run_id", "resumed_from_state", F.coalesce("n_new", F.lit(0)).cast("long").alias("n_new"), rest.alias("workers_to_rerun"))


def intact(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events (with event_hash and prev_hash) of runs whose hash chain holds, and the breaks of the others, so that a
    full replay folds nothing that was tampered with."""
    breaks = chain_breaks(events)
    return events.join(breaks.select("run_id").distinct(), "run_id", "left_anti"), breaks


def save_checkpoint(registers: DataFrame, path: str, number: int) -> None:
    """A checkpoint is a folder of its own, complete once Spark has committed it; a number that is written again
    replaces itself, so a job that failed on the way can be run again."""
    registers.write.mode("overwrite").parquet(f"{path}/checkpoint={number}")


def latest_checkpoint(spark: SparkSession, path: str) -> tuple[int, DataFrame] | None:
    """The number and registers of the newest complete checkpoint, or None."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    complete = [int(n.partition("=")[2]) for n in names if n.startswith("checkpoint=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return (max(complete), spark.read.parquet(f"{path}/checkpoint={max(complete)}")) if complete else None


def resume(spark: SparkSession, path: str, events: DataFrame) -> DataFrame:
    """Registers of the whole log, from the newest checkpoint where there is one."""
    found = latest_checkpoint(spark, path)
    return resumed(events, found[1]) if found else fold(events)


def entries(snapshots: DataFrame) -> DataFrame:
    """A row for each thing of a snapshot: run_id, kind, key, status, and three numbers whose meaning is the kind's
    (run: events, last place; artifact: time, event; item: queued, start, finish; issue: place, resolution)."""
    none = F.lit(None)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    a = lambda kind, key, status, *n: F.struct(
        F.lit(kind).alias("kind"), key.cast("string").alias("key"), status.cast("string").alias("status"), *((n[k] if k < len(n) else none).cast("long").alias(f"n{k + 1}") for k in range(3))
    )
    pairs = lambda c: F.map_entries(c)
    lists = [
        F.array(a("run", F.lit(""), F.col("run_state"), F.col("n_events"), F.col("last_ord"))),
        F.transform(pairs("artifacts"), lambda x: a("artifact", x["key"], F.concat_ws(" ", x["value"]["path"], x["value"]["sha256"]), micros(x["value"]["ts"]), x["value"]["event_id"])),
        F.transform("work_items", lambda x: a("item", x["id"], x["status"], x["queued"], micros(x["started_at"]), micros(x["finished_at"]))),
        F.transform("issues", lambda x: a("issue", x["issue_id"], x["status"], x["ord"], micros(x["resolved_at"]))),
        F.transform(pairs("gates"), lambda x: a("gate", x["key"], x["value"])),
        F.transform(pairs("sections"), lambda x: a("section", x["key"], x["value"])),
    ]
    empty = F.filter(lists[0], lambda _: F.lit(False))
    return snapshots.select("run_id", F.explode(F.concat(*(F.coalesce(x, empty) for x in lists))).alias("x")).select("run_id", "x.*")
