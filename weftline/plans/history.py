"""Queries on histories: snapshots that are stored, merged and resumed, and what follows from them.

Events become an event log of nine types by one projection that both engines read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events, files, fixing, snapshots, state
from ..sources.tables import Rounds, spread
from .catalogue import MD, PRODUCT, REPO, markdown, query, table

_TYPE = """CASE event_type WHEN 'signup' THEN 'WORK_ITEM_QUEUED' WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'WORK_ITEM_QUEUED' ELSE 'WORK_ITEM_STARTED' END
WHEN 'click' THEN CASE WHEN event_id % 4 = 0 THEN 'GATE_RUN_FINISHED' ELSE 'WORK_ITEM_FINISHED' END WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'SECTION_STATE_CHANGED' ELSE 'ARTIFACT_WRITTEN' END
ELSE CASE event_id % 4 WHEN 0 THEN 'RUN_STATE_CHANGED' WHEN 1 THEN 'ISSUE_RESOLVED' ELSE 'ISSUE_OPENED' END END"""
_FIELDS = """user_id AS run_id, event_id AS ord, ts, {} AS type, 'w' || CAST(event_id % 5 AS STRING) AS item, 'a' || CAST(event_id % 7 AS STRING) AS name, 'S' || CAST(event_id % 5 AS STRING) AS new_state,
'g' || CAST(event_id % 3 AS STRING) AS gate, value > 20 AS ok, 's' || CAST(event_id % 3 AS STRING) AS section, 'i' || CAST(event_id % 6 AS STRING) AS issue_id, md5(CAST(event_id AS STRING)) AS sha""".format(_TYPE)
_LOG = f"ev AS (SELECT {_FIELDS} FROM events)"
WORKERS = [f"w{k}" for k in range(6)]


def log(spark, d):
    """The whole table of events as a log."""
    fields = spark.sql(f"SELECT {_FIELDS} FROM {{events}}", events=spread(table(spark, d, "events")))
    payload = F.struct(F.col("item").alias("work_item_id"), "name", F.concat(F.lit("p/"), "name").alias("path"), F.col("sha").alias("sha256"), "new_state", "gate", "ok", "section", "issue_id", F.struct("issue_id").alias("issue"))
    return fields.select("run_id", "ord", F.col("ord").cast("string").alias("event_id"), "ts", "type", F.to_json(payload).alias("payload"))


#: A row for each thing of each run's snapshot, straight from the events.
_SNAPSHOT = f"""{_LOG},
iq AS (SELECT run_id, item, min(ord) AS q FROM ev WHERE type = 'WORK_ITEM_QUEUED' GROUP BY ALL),
im AS (SELECT run_id, item, q, max(ord) FILTER (type = 'WORK_ITEM_STARTED') AS so, arg_max(epoch_us(ts), ord) FILTER (type = 'WORK_ITEM_STARTED') AS s,
       max(ord) FILTER (type = 'WORK_ITEM_FINISHED') AS fo, arg_max(epoch_us(ts), ord) FILTER (type = 'WORK_ITEM_FINISHED') AS f FROM ev JOIN iq USING (run_id, item) WHERE ord >= q GROUP BY run_id, item, q),
op AS (SELECT run_id, issue_id, ord, min(ord) OVER (PARTITION BY run_id, issue_id) AS first FROM ev WHERE type = 'ISSUE_OPENED'),
re AS (SELECT run_id, issue_id, max(ord) AS r, arg_max(epoch_us(ts), ord) AS rt FROM ev WHERE type = 'ISSUE_RESOLVED' GROUP BY ALL),
sn AS (SELECT run_id, 'run' AS kind, '' AS key, arg_max(new_state, ord) FILTER (type = 'RUN_STATE_CHANGED') AS status, count(*) AS n1, max(ord) AS n2, NULL::BIGINT AS n3 FROM ev GROUP BY run_id
UNION ALL SELECT run_id, 'artifact', name, arg_max('p/' || name || ' ' || sha, ord), arg_max(epoch_us(ts), ord), max(ord), NULL FROM ev WHERE type = 'ARTIFACT_WRITTEN' GROUP BY run_id, name
UNION ALL SELECT run_id, 'item', item, CASE WHEN fo IS NOT NULL AND (so IS NULL OR fo > so) THEN 'finished' WHEN so IS NOT NULL THEN 'running' ELSE 'queued' END, q, s, f FROM im
UNION ALL SELECT run_id, 'issue', issue_id, CASE WHEN ord = first AND r > ord THEN 'RESOLVED' ELSE 'OPEN' END, ord, CASE WHEN ord = first AND r > ord THEN rt END, NULL FROM op LEFT JOIN re USING (run_id, issue_id)
UNION ALL SELECT run_id, 'gate', gate, arg_max(ok, ord)::VARCHAR, NULL, NULL, NULL FROM ev WHERE type = 'GATE_RUN_FINISHED' GROUP BY run_id, gate
UNION ALL SELECT run_id, 'section', section, arg_max(new_state, ord), NULL, NULL, NULL FROM ev WHERE type = 'SECTION_STATE_CHANGED' GROUP BY run_id, section)"""


@query(f"WITH {_SNAPSHOT} SELECT * FROM sn")
def snapshot_whole(spark, d):
    return snapshots.entries(state.snapshot(log(spark, d)))


def _stored(spark, own):
    """Registers of each run up to its latest checkpoint, written: both the tail and the merge read them."""
    at = state.latest_checkpoint(state.checkpoints(own, 20)).select("run_id", "last_ord")
    return Rounds(spark, "registers").cut(snapshots.fold(own.join(at, "run_id").where("ord <= last_ord").drop("last_ord")))


@query(f"WITH {_SNAPSHOT} SELECT * FROM sn")
def snapshot_resumed(spark, d):
    """Cut at each run's latest checkpoint; what is stored and the tail make the whole."""
    own = log(spark, d)
    return snapshots.entries(snapshots.assemble(snapshots.resumed(own, _stored(spark, own))))


@query(f"""WITH {_LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ord) AS k, count(*) OVER (PARTITION BY run_id) AS c FROM ev),
p AS (SELECT * FROM n WHERE k <= c // 20 * 20), w AS (SELECT unnest(range(6)) AS k), d AS (SELECT DISTINCT run_id, item FROM p WHERE type = 'WORK_ITEM_FINISHED')
SELECT r.run_id, (SELECT arg_max(new_state, ord) FROM p WHERE p.run_id = r.run_id AND type = 'RUN_STATE_CHANGED') AS resumed_from_state, (SELECT count(*) FROM n WHERE n.run_id = r.run_id AND k > c // 20 * 20) AS n_new,
       (SELECT string_agg('w' || w.k, ',' ORDER BY w.k) FROM w WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.run_id = r.run_id AND d.item = 'w' || w.k)) AS workers_to_rerun FROM (SELECT DISTINCT run_id FROM ev) r""")
def resume_reports(spark, d):
    own = log(spark, d)
    return snapshots.resume_report(own, _stored(spark, own), WORKERS).withColumn("workers_to_rerun", F.array_join("workers_to_rerun", ","))


@query(f"WITH {_LOG} SELECT run_id, ord, row_number() OVER (PARTITION BY run_id ORDER BY ord) AS number FROM ev")
def events_numbered(spark, d):
    return events.numbered(log(spark, d), 500).select("run_id", "ord", "number")


@query(f"""WITH {_LOG}, e AS (SELECT run_id, item AS work_item_id, ord, type AS event, min(ord) FILTER (type = 'WORK_ITEM_QUEUED') OVER (PARTITION BY run_id, item) AS q FROM ev WHERE type LIKE 'WORK_ITEM_%'),
m AS (SELECT *, CASE WHEN ord >= q THEN CASE WHEN event = 'WORK_ITEM_STARTED' THEN 'running' WHEN event = 'WORK_ITEM_FINISHED' THEN 'finished' WHEN ord = q THEN 'queued' END END AS t FROM e),
b AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY run_id, work_item_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m)
SELECT run_id, work_item_id, ord, event, before, coalesce(t, before) AS after, CASE WHEN event = 'WORK_ITEM_QUEUED' THEN CASE WHEN before IS NOT NULL THEN 'queued again' END WHEN before IS NULL THEN 'unknown item'
  WHEN event = 'WORK_ITEM_STARTED' AND before <> 'queued' THEN 'not queued' WHEN event = 'WORK_ITEM_FINISHED' AND before <> 'running' THEN 'not running' END AS reason FROM b""")
def work_item_transitions(spark, d):
    return state.transitions(log(spark, d))


#: What the loop looks for in pages, and what it repairs them by.
RULES = [
    fixing.Rule("template_tokens", "blocker", "__[A-Z0-9_]+__", "template_tokens"), fixing.Rule("conflicts", "error", "(?m)^<<<<<<<"), fixing.Rule("foss_licensing", "error", "commercial license", "foss_licensing"),
    fixing.Rule("invalid_claim_marker", "error", "<!-- claim_id:", "invalid_claim_marker"), fixing.Rule("placeholder_content", "error", "TODO", "placeholder_content"), fixing.Rule("bare_links", "warn", "http://"),
]
_FIRST = "CASE WHEN regexp_matches(content, '__[A-Z0-9_]+__') THEN 'template_tokens' WHEN regexp_matches(content, '(?m)^<<<<<<<') THEN 'conflicts' WHEN regexp_matches(content, 'commercial license') THEN 'foss_licensing' WHEN regexp_matches(content, '<!-- claim_id:') THEN 'invalid_claim_marker' WHEN regexp_matches(content, 'TODO') THEN 'placeholder_content' END"
_WITHOUT = "array_to_string(list_filter(string_split(content, chr(10)), lambda x: NOT regexp_matches(x, '{}')), chr(10))"
_REPAIRED = f"""CASE c WHEN 'template_tokens' THEN regexp_replace(replace(content, '__PRODUCT_NAME__', 'Acme'), '__[A-Z0-9_]+__', '', 'g') WHEN 'foss_licensing' THEN {_WITHOUT.format('(?i)commercial licen[sc]e|purchase|pricing|free trial|buy now')}
WHEN 'invalid_claim_marker' THEN regexp_replace(content, '<!--\\s*claim_id:[^>]*-->\\s*', '', 'g') WHEN 'placeholder_content' THEN {_WITHOUT.format('(?i)\\b(TODO|TBD|FIXME|XXX|PLACEHOLDER)\\b')} END"""
_ROUNDS = ", ".join(f"j{k} AS (SELECT slug, content, {_FIRST} AS c FROM p{k}), p{k + 1} AS (SELECT slug, {_REPAIRED} AS content FROM j{k} WHERE c <> 'conflicts')" for k in range(4))


@query(f"WITH {MD}, p0 AS (SELECT slug, content FROM md), {_ROUNDS} " + " UNION ALL ".join(
    f"SELECT slug, md5(content) AS content_md5, CASE WHEN c IS NULL THEN 'clean' WHEN c = 'conflicts' THEN 'blocked' ELSE 'given_up' END AS verdict, {k} AS rounds, c AS open_check FROM j{k}" + (" WHERE c IS NULL OR c = 'conflicts'" if k < 3 else "") for k in range(4)))
def fix_rounds(spark, d):
    """All pages through the loop: the final pages and verdicts."""
    known = files.repairs(PRODUCT, REPO)
    out = fixing.fix_loop(spark, markdown(spark, d).select("slug", "content"), lambda pages: fixing.issues_of(pages, RULES), {r.check: known[r.repair] for r in RULES if r.repair})
    return out.select("slug", F.md5("content").alias("content_md5"), "verdict", "rounds", "open_check")
