"""Streams against the batch form of the same question."""

import json

from pyspark.sql import functions as F

from weftline.operators import events
from weftline.streaming import replay

SCHEMA = "run_id string, ord long, event_id string, ts timestamp, type string, payload string"


def rows(n):
    kinds = [("WORK_ITEM_QUEUED", "work_item_id"), ("WORK_ITEM_STARTED", "work_item_id"), ("ARTIFACT_WRITTEN", "name"), ("RUN_STATE_CHANGED", "new_state"), ("WORK_ITEM_FINISHED", "work_item_id")]
    return [(f"r{k % 3}", k, f"e{k}", f"2024-01-01 00:{k // 60:02d}:{k % 60:02d}", kinds[k % 5][0], json.dumps({kinds[k % 5][1]: f"v{k % 4}"})) for k in range(n)]


def frame(spark, part):
    return spark.createDataFrame(part, SCHEMA.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))


def test_replay_stream_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    whole = rows(60)
    for k in range(3):  # three micro-batches, with a restart after each
        frame(spark, whole[20 * k : 20 * k + 20]).coalesce(1).write.mode("append").parquet(source)
        stream = replay.replay_stream(spark.readStream.schema(SCHEMA).parquet(source))
        q = stream.writeStream.outputMode("update").foreachBatch(replay.upsert_sink(out, "run_id")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.run_id: r for r in spark.read.parquet(f"{out}/0").collect()}  # the third batch has number 2
    want = {r.run_id: r for r in events.replay(frame(spark, whole)).collect()}
    assert got.keys() == want.keys()
    for run, w in want.items():
        assert (got[run].run_state, got[run].n_events, got[run].last_ord) == (w.run_state, w.n_events, w.last_ord)
        assert set(json.loads(got[run].artifacts)) == set(w.artifacts or {})
        assert json.loads(got[run].work_items) == {i.id: i.status for i in w.work_items or []}


def test_stream_and_batch_have_the_same_issues_gates_and_sections(spark, tmp_path):
    from weftline.operators import state

    kinds = ["ISSUE_OPENED", "ISSUE_RESOLVED", "GATE_RUN_FINISHED", "SECTION_STATE_CHANGED", "ISSUE_OPENED"]
    item = lambda k: f"v{k * k % 7}"
    whole = [(f"r{k % 3}", k, f"e{k}", f"2024-01-01 00:{k // 60:02d}:{k % 60:02d}", kinds[k % 5], json.dumps({"issue": {"issue_id": item(k)}, "issue_id": item(k), "gate": item(k), "ok": k % 2 == 0, "section": item(k), "new_state": f"s{k % 4}"})) for k in range(90)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        frame(spark, whole[30 * k : 30 * k + 30]).coalesce(1).write.mode("append").parquet(source)
        stream = replay.replay_stream(spark.readStream.schema(SCHEMA).parquet(source))
        q = stream.writeStream.outputMode("update").foreachBatch(replay.upsert_sink(out, "run_id")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.run_id: r for r in spark.read.parquet(f"{out}/0").collect()}
    want = {r.run_id: r for r in state.snapshot(frame(spark, whole)).collect()}
    assert got.keys() == want.keys() and any(i.status == "RESOLVED" for w in want.values() for i in w.issues)
    for run, w in want.items():
        assert json.loads(got[run].issues) == [[i.issue_id, i.status] for i in w.issues]
        assert json.loads(got[run].gates) == w.gates and json.loads(got[run].sections) == w.sections


def test_ingest_once(spark, tmp_path):
    source = str(tmp_path / "in")
    for _ in range(2):
        frame(spark, rows(10)).coalesce(1).write.mode("append").parquet(source)
    q = replay.ingest_once(spark.readStream.schema(SCHEMA).parquet(source)).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 10


def test_pairs_and_windows(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.sql("select 'c1' as call_id, timestamp'2024-01-01 00:00:00' as started_at union all select 'c2', timestamp'2024-01-01 00:01:00'").write.parquet(a)
    spark.sql("select 'c1' as call_id, timestamp'2024-01-01 00:00:30' as finished_at").write.parquet(b)
    starts = spark.readStream.schema("call_id string, started_at timestamp").parquet(a)
    finishes = spark.readStream.schema("call_id string, finished_at timestamp").parquet(b)
    q = replay.pair_calls_stream(starts, finishes).writeStream.format("memory").queryName("pairs").trigger(availableNow=True).start()
    q.awaitTermination()
    assert ("c1", 30) in [(r.call_id, (r.finished_at - r.started_at).seconds) for r in spark.table("pairs").collect() if r.finished_at]
    batch = frame(spark, rows(30)).withColumnRenamed("type", "event_type")
    assert replay.windowed_counts(batch).agg(F.sum("n")).first()[0] == 30


def test_dead_letters_keep_the_batch(spark, tmp_path):
    def broken(_):
        raise RuntimeError("sink is down")

    replay.with_dead_letters(broken, str(tmp_path / "dead"))(spark.range(5), 7)
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 5
