"""Stored and merged snapshots, the state machine as a stream, the loop of repairs, letters sent again."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import events, fixing, snapshots, state
from weftline.streaming import letters, work_items
from weftline.streaming import snapshots as streamed

SCHEMA = "run_id string, ord long, event_id string, ts string, type string, payload string"
KINDS = ["RUN_STATE_CHANGED", "ARTIFACT_WRITTEN", "WORK_ITEM_QUEUED", "WORK_ITEM_STARTED", "WORK_ITEM_FINISHED", "ISSUE_OPENED", "ISSUE_RESOLVED", "GATE_RUN_FINISHED", "SECTION_STATE_CHANGED", "OTHER"]


def log(n, seed=1):
    rnd, out = random.Random(seed), []
    for k in range(n):
        thing = lambda p: f"{p}{rnd.randrange(4)}" if rnd.random() < 0.93 else None
        payload = {"work_item_id": thing("w"), "name": thing("a"), "path": "p", "sha256": str(k), "new_state": thing("S"), "gate": thing("g"), "ok": rnd.random() < 0.5, "section": f"s{rnd.randrange(3)}", "issue_id": thing("i"), "issue": {"issue_id": thing("i")}}
        out.append((f"r{rnd.randrange(5)}", k, f"e{k}", f"2024-01-01 00:{k // 60 % 60:02d}:{k % 60:02d}", rnd.choice(KINDS), json.dumps({a: b for a, b in payload.items() if b is not None})))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))


def plain(df):
    columns = sorted(df.columns)
    return sorted(str([r[c] for c in columns]) for r in df.collect())


def test_registers_make_the_snapshot(spark):
    own = frame(spark, log(900)).where("not (type = 'GATE_RUN_FINISHED' and get_json_object(payload, '$.gate') is null)")
    assert plain(snapshots.assemble(snapshots.fold(own))) == plain(state.snapshot(own))


def test_any_stretches_in_any_order_merge_to_the_whole(spark):
    rows, rnd = log(700, 2), random.Random(3)
    whole = plain(snapshots.assemble(snapshots.fold(frame(spark, rows))))
    for _ in range(2):
        parts = [[], [], []]
        for r in rows:
            parts[rnd.randrange(3)].append(r)
        a, b, c = (snapshots.fold(frame(spark, p)) for p in parts)
        assert plain(snapshots.assemble(snapshots.merge(snapshots.merge(c, a), b))) == whole
        assert plain(snapshots.assemble(snapshots.merge(a, snapshots.merge(b, c)))) == whole
    assert snapshots.assemble(snapshots.fold(frame(spark, rows).limit(0))).count() == 0


def test_resume_from_stored_checkpoints(spark, tmp_path):
    rows, path = log(600, 4), str(tmp_path / "cp")
    whole = frame(spark, rows)
    assert snapshots.latest_checkpoint(spark, path) is None
    want = plain(snapshots.assemble(snapshots.fold(whole)))
    assert plain(snapshots.assemble(snapshots.resume(spark, path, whole))) == want
    for number, upto in ((1, 200), (2, 450)):
        snapshots.save_checkpoint(snapshots.resume(spark, path, frame(spark, rows[:upto])), path, number)
        assert snapshots.latest_checkpoint(spark, path)[0] == number
    (tmp_path / "cp" / "checkpoint=3").mkdir()  # a checkpoint that was never committed
    assert snapshots.latest_checkpoint(spark, path)[0] == 2
    stored = snapshots.latest_checkpoint(spark, path)[1]
    assert snapshots.tail(whole, stored).count() == 150
    assert plain(snapshots.assemble(snapshots.resume(spark, path, whole))) == want
    report = {r.run_id: r for r in snapshots.resume_report(whole, stored, ["w9", "w0", "w1"]).collect()}
    done = {(r[0], json.loads(r[5]).get("work_item_id")) for r in rows[:450] if r[4] == "WORK_ITEM_FINISHED"}
    assert sum(r.n_new for r in report.values()) == 150
    assert all(r.workers_to_rerun == [w for w in ("w9", "w0", "w1") if (run, w) not in done] for run, r in report.items())


def test_resolution_past_the_checkpoint_closes_what_was_opened_before(spark):
    issue = lambda k, kind, i: ("r", k, f"e{k}", "2024-01-01 00:00:00", kind, json.dumps({"issue_id": i, "issue": {"issue_id": i}}))
    before, after = [issue(0, "ISSUE_RESOLVED", "a"), issue(1, "ISSUE_OPENED", "a"), issue(2, "ISSUE_OPENED", "a"), issue(3, "ISSUE_OPENED", "b")], [issue(4, "ISSUE_RESOLVED", "a"), issue(5, "ISSUE_OPENED", "c")]
    met = snapshots.assemble(snapshots.merge(snapshots.fold(frame(spark, before)), snapshots.fold(frame(spark, after))))
    assert [(i.issue_id, i.status) for i in met.first().issues] == [("a", "RESOLVED"), ("a", "OPEN"), ("b", "OPEN"), ("c", "OPEN")]


def test_runs_with_a_broken_chain_are_not_folded(spark):
    rows = []
    for run in ("good", "bad"):
        prev = None
        for k in range(5):
            import hashlib

            fields = (f"{run}{k}", "2024-01-01 00:00:00", "OTHER", "{}")
            own = hashlib.sha256("".join([*fields, prev or ""]).encode()).hexdigest()
            rows.append((run, k, *fields, prev or "", own if (run, k) != ("bad", 3) else "0" * 64))
            prev = own
    own = spark.createDataFrame(rows, SCHEMA + ", prev_hash string, event_hash string")
    held, breaks = snapshots.intact(own)
    assert {r.run_id for r in held.collect()} == {"good"} and {r.run_id for r in breaks.collect()} == {"bad"}


def test_numbers_of_a_long_run(spark):
    rows = [("long", k * 3) for k in range(1000)] + [("short", k) for k in (5, 900, 901)]
    own = spark.createDataFrame(rows, "run_id string, ord long").repartition(5)
    got = sorted((r.run_id, r.number, r.ord) for r in events.numbered(own, 64).collect())
    assert got == [("long", k + 1, 3 * k) for k in range(1000)] + [("short", k + 1, o) for k, o in enumerate((5, 900, 901))]


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, work_items.ROCKSDB)
    yield spark
    spark.conf.unset(key)


def test_state_machine_stream(rocks, tmp_path):
    spark, source, out = rocks, str(tmp_path / "in"), str(tmp_path / "out")
    rows = [r for r in log(240, 6) if r[4].startswith("WORK_ITEM")]
    read = lambda: spark.readStream.schema(SCHEMA.replace("ts string", "ts timestamp")).parquet(source)

    def run(part):
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        q = work_items.work_item_stream(read(), keep_ms=3_600_000, delay="1 minute").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    for k in range(3):  # a restart between any two
        run(rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3])
    got = spark.read.parquet(out)
    want = state.transitions(frame(spark, rows))
    assert plain(got.where("reason is null or reason not in ('late', 'expired')")) == plain(want) and {"unknown item", "queued again", "not running", "not queued", "no id"} <= {r.reason for r in got.collect()}
    run([("r0", 1, "again", "2024-01-01 00:04:00", "WORK_ITEM_QUEUED", '{"work_item_id": "w0"}')])  # delivered again
    assert [r.work_item_id for r in spark.read.parquet(out).where("reason = 'late'").collect()] == ["w0"]
    run([("other", 1, "x", "2024-01-03 00:00:00", "WORK_ITEM_QUEUED", '{"work_item_id": "w0"}')])  # two days on: the others are let go
    run([("r0", 10_000, "y", "2024-01-03 00:00:01", "WORK_ITEM_STARTED", '{"work_item_id": "w1"}')])
    late = spark.read.parquet(out)
    last = {}
    for r in want.orderBy("ord").collect():
        if r.after is not None:
            last[r.run_id, r.work_item_id] = r.after
    assert {(r.run_id, r.work_item_id) for r in late.where("reason = 'expired'").collect()} == {k for k, s in last.items() if s != "finished"}
    assert [r.reason for r in late.where("ord = 10000").collect()] == ["unknown item"]


def test_snapshot_stream(rocks, tmp_path):
    """Upserts of a stream with restarts make the entries of the whole snapshot."""
    spark, source, out = rocks, str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(a, b, str(b), *rest) for a, b, _, *rest in log(300, 8) if not (rest[1].startswith("WORK_ITEM") and "work_item_id" not in json.loads(rest[2]))]
    rows = [r for r in rows if not (r[4] == "GATE_RUN_FINISHED" and "gate" not in json.loads(r[5]))]

    def run(part):
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        events_ = spark.readStream.schema(SCHEMA.replace("ts string", "ts timestamp")).parquet(source)
        made = streamed.snapshot_stream(events_, keep_ms=3_600_000, delay="1 minute")
        q = made.writeStream.outputMode("update").foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/b={n}")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    for k in range(3):
        run(rows[k * 100 : (k + 1) * 100])
    run(rows[:5])  # delivered again
    kept = {}
    for r in spark.read.parquet(out).orderBy("batch").collect():
        kept[r.run_id, r.kind, r.key, r.n1 if r.kind == "issue" else None] = (r.status, r.n1, r.n2, r.n3)
    want = snapshots.entries(state.snapshot(frame(spark, rows))).collect()
    assert {(r.run_id, r.kind, r.key, r.n1 if r.kind == "issue" else None): (r.status, r.n1, r.n2, r.n3) for r in want} == kept
    run([("new", 0, "0", "2024-01-02 00:00:00", "OTHER", "{}")])
    run([("new", 1, "1", "2024-01-02 00:00:01", "OTHER", "{}")])
    assert {r.run_id for r in spark.read.parquet(out).where("kind = 'expired'").collect()} == {r[0] for r in rows}


def test_stream_needs_its_state_store(spark):
    with pytest.raises(ValueError):
        work_items.work_item_stream(frame(spark, log(3)))


def test_fix_loop(spark):
    pages = [("clean", "all well"), ("one", "AA"), ("three", "AA BB CC"), ("four", "AA BB CC DD"), ("no_repair", "AA XX"), ("grows", "GG"), ("null", None)]
    rules = [fixing.Rule(c, "error", c, c) for c in ("AA", "BB", "CC", "DD", "GG")] + [fixing.Rule("XX", "blocker", "XX"), fixing.Rule("warned", "warn", "well")]
    repairs = {c: (lambda x, c=c: F.regexp_replace(x, c, "")) for c in ("AA", "BB", "CC", "DD")} | {"GG": lambda x: F.concat(x, F.lit("GG"))}
    seen = []

    def check(open_):
        seen.append({r.slug for r in open_.collect()})
        return fixing.issues_of(open_, rules)

    got = {r.slug: (r.verdict, r.rounds, r.open_check) for r in fixing.fix_loop(spark, spark.createDataFrame(pages, "slug string, content string"), check, repairs).collect()}
    assert got == {"clean": ("clean", 0, None), "one": ("clean", 1, None), "three": ("clean", 3, None), "four": ("given_up", 3, "DD"), "no_repair": ("blocked", 0, "XX"), "grows": ("given_up", 3, "GG"), "null": ("clean", 0, None)}
    assert seen == [set(got), {"one", "three", "four", "grows"}, {"three", "four", "grows"}, {"three", "four", "grows"}]
    assert fixing.fix_loop(spark, spark.createDataFrame([], "slug string, content string"), check, repairs).count() == 0


def test_letters_are_sent_again(spark, tmp_path):
    path, rows = str(tmp_path / "box"), spark.createDataFrame([(k, f"row {k % 7}") for k in range(10)] + [(0, "row 0")], "k long, text string")
    letters.post(rows, path, "batch-1")
    slept, taken, calls = [], [], []

    def send(batch):  # fails twice, then takes all but one row
        calls.append(batch.count())
        if len(calls) <= 2:
            raise RuntimeError("down")
        refused = batch.where("k = 4").select("letter_id")
        taken.extend(r.k for r in batch.where("k <> 4").collect())
        return refused if len(calls) < 5 else None

    first = letters.flush(spark, path, rows.schema, send, sleep=slept.append)
    assert first == {"delivered": 9, "refused": 1} and slept == [1, 2, 4] and calls == [10, 10, 10, 1]
    assert sorted(taken) == [0, 1, 2, 3, 5, 6, 7, 8, 9]  # each once
    second = letters.flush(spark, path, rows.schema, lambda b: taken.extend(r.k for r in b.collect()), sleep=slept.append)
    assert second == {"delivered": 1, "refused": 0} and taken[-1] == 4 and len(taken) == 10
    letters.post(rows, path, "batch-2")  # the same rows once more: the ledger has them
    assert letters.flush(spark, path, rows.schema, lambda b: taken.append("again")) == {"delivered": 0, "refused": 0} and "again" not in taken


def test_assemble_reads_registers_once(spark, tmp_path):
    rows = [("r", 1, "e1", None, "WORK_ITEM_QUEUED", '{"work_item_id":"w"}'), ("r", 2, "e2", None, "ISSUE_OPENED", '{"issue":{"issue_id":"i"}}'), ("r", 3, "e3", None, "ISSUE_RESOLVED", '{"issue_id":"i"}'), ("r", 4, "e4", None, "ISSUE_OPENED", '{"issue":{"issue_id":"i"}}'), ("q", 1, "e5", None, "GATE_RUN_FINISHED", '{"gate":"g","ok":true}')]
    events_ = spark.createDataFrame(rows, "run_id string, ord long, event_id string, ts timestamp, type string, payload string")
    snapshots.fold(events_).write.parquet(str(tmp_path / "registers"))
    made = snapshots.assemble(spark.read.parquet(str(tmp_path / "registers")))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    got = {r.run_id: r for r in made.collect()}
    assert [(i.ord, i.status) for i in got["r"].issues] == [(2, "RESOLVED"), (4, "OPEN")] and [w.status for w in got["r"].work_items] == ["queued"]
    assert got["r"].gates is None and got["q"].gates == {"g": True} and got["q"].issues is None and got["q"].n_events == 1
