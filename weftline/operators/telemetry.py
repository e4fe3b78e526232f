"""Runs and their events: filters, pages, aggregates, and updates as joins.

Runs have event_id (key), run_id, agent_name, job_type, status, product, parent_run_id, start_time, created_at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PAGE = 1000
MAX_BATCH = 1000


def filter_runs(runs: DataFrame, **equal: object) -> DataFrame:
    """Rows that match every given value; empty values ask for nothing."""
    wanted = [F.col(k) == F.lit(v) for k, v in equal.items() if v not in (None, "")]
    return runs.where(reduce(lambda a, b: a & b, wanted)) if wanted else runs


def page_of_runs(runs: DataFrame, limit: int = 100, offset: int = 0, **equal: object) -> DataFrame:
    """Newest first, ties by event_id; with the total before paging. limit 1..1000, offset 0 or more."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError("limit is 1 to 1000 and offset not negative")
    found = filter_runs(runs, **equal)
    total = found.agg(F.count("*").alias("total"))
    page = found.orderBy(F.desc("start_time"), "event_id").offset(offset).limit(limit)
    return page.join(F.broadcast(total))  # one row


def run_by_event_id(runs: DataFrame, event_id: object) -> DataFrame:
    return runs.where(F.col("event_id") == F.lit(event_id)).limit(1)


def latest_run(runs: DataFrame, key: str = "run_id", at: str = "created_at") -> DataFrame:
    """The newest row of each key, ties by event_id; an aggregate, so no key is sorted in one place."""
    rest = [c for c in runs.columns if c not in (key, at, "event_id")]
    best = F.max(F.struct(at, "event_id", *rest)).alias("_best")
    return runs.groupBy(key).agg(best).select(key, "_best.*")


def events_of_run(events: DataFrame, run_id: object) -> DataFrame:
    return events.where(F.col("run_id") == F.lit(run_id)).orderBy("ts", "event_id")


def metadata(runs: DataFrame) -> DataFrame:
    """Distinct agents and job types: kind, name, in order of name, with the number of its kind."""
    kinds = [runs.select(F.lit(kind).alias("kind"), F.col(c).alias("name")).where(F.col(c).isNotNull()).distinct() for kind, c in (("agent", "agent_name"), ("job_type", "job_type"))]
    found = kinds[0].union(kinds[1])
    return found.join(F.broadcast(found.groupBy("kind").agg(F.count("*").alias("n"))), "kind").select("kind", "name", "n").orderBy("kind", "name")


def runs_by_agent(runs: DataFrame) -> DataFrame:
    return runs.groupBy("agent_name").agg(F.count("*").alias("n_runs")).orderBy(F.desc("n_runs"), "agent_name")


def recent_runs(runs: DataFrame, reference: Column) -> DataFrame:
    """Runs that began in the day up to the reference time, a real timestamp comparison."""
    return runs.agg(F.count_if(F.col("start_time") >= reference - F.expr("INTERVAL 1 DAY")).alias("recent_24h"))


def metrics(runs: DataFrame, reference: Column) -> DataFrame:
    """Total, recent, and the runs of each agent, a row per agent."""
    whole = runs.agg(F.count("*").alias("total_runs"), F.count_if(F.col("start_time") >= reference - F.expr("INTERVAL 1 DAY")).alias("recent_24h"))
    return runs_by_agent(runs).join(F.broadcast(whole))


def patch_runs(runs: DataFrame, patches: DataFrame, updated_at: Column) -> DataFrame:
    """Non-null fields of the patch (one row per event_id) overwrite; a null never does."""
    fields = [c for c in patches.columns if c != "event_id"]
    new = patches.select("event_id", *[F.col(c).alias(f"_new_{c}") for c in fields], F.lit(True).alias("_hit"))
    joined = runs.join(new, "event_id", "left")
    columns = [F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in runs.columns if c != "updated_at"]
    was = F.col("updated_at") if "updated_at" in runs.columns else F.lit(None).cast("timestamp")
    return joined.select(*columns, F.when(F.col("_hit"), updated_at).otherwise(was).alias("updated_at"))


def new_runs(runs: DataFrame, incoming: DataFrame) -> DataFrame:
    """Idempotent ingest: the first row of each event_id (by ord) that isn't stored yet."""
    first = incoming.withColumn("_k", F.row_number().over(Window.partitionBy("event_id").orderBy("ord"))).where("_k = 1").drop("_k")
    return first.join(runs.select("event_id"), "event_id", "left_anti")


def batch_upload(runs: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored rows after the batch, and counts of created, existing and failed (no event_id) rows; rows stand
    alone, so a bad one doesn't undo the others."""
    good = incoming.where("event_id is not null")
    added = new_runs(runs, good)
    counts = incoming.agg(F.count("*").alias("received"), F.count_if(F.col("event_id").isNull()).alias("failed")).join(F.broadcast(added.agg(F.count("*").alias("created"))))
    counts = counts.select("created", (F.col("received") - F.col("failed") - F.col("created")).alias("existing"), "failed")
    return runs.unionByName(added.select(*runs.columns)), counts


def batch_upload_transactional(runs: DataFrame, incoming: DataFrame) -> DataFrame:
    """All of the batch or nothing: a row without event_id, or more than 1000 rows, leaves the table as it was."""
    ok = incoming.agg(((F.count_if(F.col("event_id").isNull()) == 0) & (F.count("*") <= MAX_BATCH)).alias("_ok"))
    added = new_runs(runs, incoming.where("event_id is not null")).join(F.broadcast(ok)).where("_ok")
    return runs.unionByName(added.select(*runs.columns))


def associate_commits(runs: DataFrame, commits: DataFrame) -> DataFrame:
    """commit_hash (7 to 40 characters) and commit_source (manual, llm or ci) by event_id; invalid requests change nothing."""
    valid = commits.where(F.length("commit_hash").between(7, 40) & F.col("commit_source").isin("manual", "llm", "ci"))
    return runs.join(valid.select("event_id", "commit_hash", "commit_source"), "event_id", "left")


def children(runs: DataFrame, parent: object) -> DataFrame:
    return filter_runs(runs, parent_run_id=parent)


def keep_newest(rows: DataFrame, by: str, n: int, key: str) -> DataFrame:
    """Retention: all but the newest n rows of each key, which are to go."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by), "event_id"))
    return rows.withColumn("_k", place).where(F.col("_k") > n).drop("_k")


def keep_last_half(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Outbox truncation: of each key's rows the later half, by position."""
    w = Window.partitionBy(key)
    placed = rows.withColumn("_k", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count("*").over(w))
    return placed.where(F.col("_k") > F.floor(F.col("_n") / 2)).drop("_k", "_n")


def budget(calls: DataFrame, key: str, order: str, spend: str, cap: float) -> DataFrame:
    """Running total of each key, its use of the cap in percent, and whether the cap is passed."""
    total = F.sum(spend).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return calls.withColumn("running", total).withColumn("percent", F.bround(100 * F.col("running") / cap, 1)).withColumn("breached", F.col("running") > cap)


def first_breach(calls: DataFrame, key: str, order: str, spend: str, cap: float) -> DataFrame:
    return budget(calls, key, order, spend, cap).where("breached").groupBy(key).agg(F.min(order).alias("breached_at"))


def api_cost(calls: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Cost of input and output tokens by a price per million; unknown models cost nothing."""
    table = F.create_map(*[x for m, (a, b) in prices.items() for x in (F.lit(m), F.struct(F.lit(a).alias("i"), F.lit(b).alias("o")))])
    price = F.try_element_at(table, F.col("model"))
    cost = (F.col("input_tokens") * price["i"] + F.col("output_tokens") * price["o"]) / 1e6
    return calls.withColumn("cost", F.coalesce(F.bround(cost, 6), F.lit(0.0)))


def pair_calls(turns: DataFrame) -> DataFrame:
    """Starts paired with the next finish of the same call: call_id, started, finished (null if none follows)."""
    w = Window.partitionBy("call_id").orderBy("ord")
    nxt = turns.withColumn("next_kind", F.lead("kind").over(w)).withColumn("next_ord", F.lead("ord").over(w))
    return nxt.where("kind = 'start'").select("call_id", F.col("ord").alias("started"), F.when(F.col("next_kind") == "finish", F.col("next_ord")).alias("finished"))
