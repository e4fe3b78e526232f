"""Every operator as a named query on the supplied tables, with the same question in DuckDB's SQL.

Documents hold no Markdown, so checks and gates run over a projection: a rule by document and line number puts
headings, fences, links, markers and phrases around whole documents' lines. It is written once, as SQL that both
engines read, and is a fixed function of the rows: no row is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checks, claims, events, evidence, files, gates, links, telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PRODUCT = "Acme"
REPO = "https://github.com/acme/tool"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------------------------------- projections

_MARK = "md5(CAST(doc_id % 20 AS STRING)) || md5(CAST(doc_id % 20 + {} AS STRING))"
#: What stands in place of line x, by (31 doc_id + 17 line) % 48; other lines stay.
_LINES = [
    "'## ' || x", "'#### ' || x", "'- ' || x", "'```python'", "'```'", "x || ' [click here](../page-' || CAST(doc_id % 40 AS STRING) || '.md)'", "'TODO: ' || x",
    "'This library cannot export FBX format.'", "'This library can export FBX format.'", "'You can install the package with pip install.'", "'The Reader class reads OBJ files.'",
    "'password = \"abcdefgh12345\"'", "'![](img.png) ' || x", "'Use __PRODUCT_NAME__ here.'", "'<<<<<<< HEAD'", "'[site](http://example.com/a) [two](//cdn.example.com/x)'",
    "'| a | b | c | d | e | f | g |'", "''", f"'<!-- claim_id: ' || {_MARK.format(1)} || ' -->'", f"'[claim: ' || {_MARK.format(2)} || ']'", "x || ' kinda awesome'", "'Error: ' || x",
    "'the the ' || x || ' ,'", "'# Overview'", "'See https://github.com/other/tool for more.'", "'A commercial license is needed.'", "'          - deep ' || x", "'[ ](page.md) [text]( )'",
]
_FRONT = [
    "''", "'---' || chr(10) || 'title: Acme page' || chr(10) || 'description: about' || chr(10) || 'permalink: /p/' || chr(10) || 'layout: plain' || chr(10) || '---' || chr(10)",
    "'---' || chr(10) || 'title: page' || chr(10) || '---' || chr(10)", "'---' || chr(10) || '# note' || chr(10) || 'title: Acme' || chr(10) || 'url_path: /q/' || chr(10) || '---' || chr(10)",
]
_SLUGS = ["getting-started", "index", "how-to", "faq", "showcase", "guide", "page", "troubleshoot"]


def _choose(key: str, values: list[str], otherwise: str | None = None) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + (f" ELSE {otherwise}" if otherwise else "") + " END"


_SLUG = _choose("doc_id % 8", [f"'{s}-'" for s in _SLUGS]) + " || CAST(doc_id AS STRING)"
_LINE = _choose("(doc_id * 31 + i * 17) % 48", _LINES, "x")
_SPARK_MD = f"SELECT doc_id, source, {_SLUG} AS slug, {_choose('doc_id % 4', _FRONT)} || array_join(transform(split(text, chr(10)), (x, i) -> {_LINE}), chr(10)) AS content FROM {{docs}}"
_DUCK_LINE = _choose("(doc_id * 31 + (i - 1) * 17) % 48", _LINES, "x")
MD = f"md AS (SELECT doc_id, source, {_SLUG} AS slug, {_choose('doc_id % 4', _FRONT)} || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: {_DUCK_LINE}), chr(10)) AS content FROM documents)"
LINES = (
    MD + ", l0 AS (SELECT slug, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT slug, string_split(content, chr(10)) AS l FROM md)), "
    r"l1 AS (SELECT slug, line, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM l0), l2 AS (SELECT *, starts_with(t, '```') AS fence FROM l1), "
    "lines AS (SELECT *, sum(fence::INT) OVER (PARTITION BY slug ORDER BY line) % 2 = 1 OR fence AS inside FROM l2)"
)


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SPARK_MD.format(docs="{docs}"), docs=table(spark, sf_dir, "documents"))


def md_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.lines_of(markdown(spark, sf_dir))


def runs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("agent_name"), F.col("o_orderpriority").alias("job_type"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("start_time"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("price"),
    )


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an event log: one run a user, types mapped, payloads made of the row."""
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'RUN_CREATED' WHEN 'view' THEN 'WORK_ITEM_STARTED' WHEN 'click' THEN 'WORK_ITEM_FINISHED' WHEN 'purchase' THEN 'ARTIFACT_WRITTEN' ELSE 'RUN_STATE_CHANGED' END")
    payload = F.to_json(F.struct(F.concat(F.lit("a"), (F.col("event_id") % 7).cast("string")).alias("name"), F.concat(F.lit("S"), (F.col("event_id") % 5).cast("string")).alias("new_state"), F.concat(F.lit("w"), (F.col("event_id") % 3).cast("string")).alias("work_item_id")))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("event_id"), "ts", kind.alias("type"), payload.alias("payload"))


_EVENTS = (
    "ev AS (SELECT user_id AS run_id, event_id AS ord, CASE event_type WHEN 'signup' THEN 'RUN_CREATED' WHEN 'view' THEN 'WORK_ITEM_STARTED' WHEN 'click' THEN 'WORK_ITEM_FINISHED' "
    "WHEN 'purchase' THEN 'ARTIFACT_WRITTEN' ELSE 'RUN_STATE_CHANGED' END AS type, ts, 'a' || (event_id % 7) AS name, 'S' || (event_id % 5) AS new_state, 'w' || (event_id % 3) AS item FROM events)"
)
_ISSUE = "slug, line, detail, severity"

# ------------------------------------------------------------------------------------------- telemetry


@query("SELECT o_orderpriority AS agent_name, count(*) AS n_runs FROM orders GROUP BY 1")
def runs_by_agent(spark, d):
    return telemetry.runs_by_agent(runs_table(spark, d))


@query("SELECT o_orderkey AS event_id, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 50")
def runs_page(spark, d):
    return telemetry.page_of_runs(runs_table(spark, d), 100, 50, status="F", product="").select("event_id", "total")


@query("SELECT run_id, event_id FROM (SELECT o_custkey AS run_id, o_orderkey AS event_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def run_latest(spark, d):
    return telemetry.latest_run(runs_table(spark, d)).select("run_id", "event_id")


@query("WITH k AS (SELECT DISTINCT 'agent' AS kind, o_orderpriority AS name FROM orders UNION ALL SELECT DISTINCT 'job_type', o_orderpriority FROM orders) SELECT kind, name, count(*) OVER (PARTITION BY kind) AS n FROM k")
def runs_metadata(spark, d):
    return telemetry.metadata(runs_table(spark, d))


@query("SELECT count(*) FILTER (o_orderdate >= TIMESTAMP '1997-01-02' - INTERVAL 1 DAY) AS recent_24h FROM orders")
def runs_recent(spark, d):
    return telemetry.recent_runs(runs_table(spark, d), F.lit("1997-01-02").cast("timestamp"))


@query("SELECT o_orderpriority AS agent_name, count(*) AS n_runs, (SELECT count(*) FROM orders) AS total_runs, (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01') AS recent_24h FROM orders GROUP BY 1")
def runs_metrics(spark, d):
    return telemetry.metrics(runs_table(spark, d), F.lit("1997-01-02").cast("timestamp"))


@query("SELECT event_id, event_type FROM events WHERE user_id = 7")
def run_event_stream(spark, d):
    e = table(spark, d, "events").withColumn("run_id", F.col("user_id"))
    return telemetry.events_of_run(e, 7).select("event_id", "event_type")


@query("SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 3 = 0 THEN 'P' ELSE o_orderstatus END AS status, o_orderkey % 2 = 0 AS touched FROM orders")
def runs_patch(spark, d):
    r = runs_table(spark, d).select("event_id", "status")
    p = r.where("event_id % 2 = 0 or event_id % 3 = 0").select("event_id", F.when(F.col("event_id") % 3 == 0, "P").alias("status"))
    out = telemetry.patch_runs(r, p, F.lit("2024-01-01").cast("timestamp"))
    return out.select("event_id", "status", (F.col("updated_at").isNotNull() & (F.col("event_id") % 2 == 0)).alias("touched"))


@query("SELECT count(*) FILTER (o_orderkey % 10 = 0) AS created, count(*) FILTER (o_orderkey % 10 <> 0) AS existing, 0::BIGINT AS failed FROM orders")
def runs_batch_upload(spark, d):
    r = runs_table(spark, d)
    return telemetry.batch_upload(r.where("event_id % 10 <> 0"), r.withColumn("ord", F.col("event_id")))[1]


@query("SELECT count(*) AS n FROM orders WHERE o_orderkey % 10 <> 0")
def runs_batch_transactional(spark, d):
    r = runs_table(spark, d)
    bad = r.withColumn("ord", F.col("event_id")).withColumn("event_id", F.when(F.col("event_id") % 100 > 0, F.col("event_id")))
    return telemetry.batch_upload_transactional(r.where("event_id % 10 <> 0"), bad).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 4 < 3 THEN CASE o_orderkey % 4 WHEN 0 THEN 'ci' WHEN 1 THEN 'llm' ELSE 'manual' END END AS commit_source FROM orders")
def runs_commits(spark, d):
    r = runs_table(spark, d)
    c = r.select("event_id", F.substring(F.md5(F.col("event_id").cast("string")), 1, 8).alias("commit_hash"), F.element_at(F.array(*map(F.lit, ("ci", "llm", "manual", "mail"))), (F.col("event_id") % 4 + 1).cast("int")).alias("commit_source"))
    return telemetry.associate_commits(r, c).select("event_id", "commit_source")


@query("SELECT run_id, event_id FROM (SELECT o_custkey AS run_id, o_orderkey AS event_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k > 5")
def runs_retention(spark, d):
    return telemetry.keep_newest(runs_table(spark, d), "created_at", 5, "run_id").select("run_id", "event_id")


@query("SELECT run_id, event_id FROM (SELECT o_custkey AS run_id, o_orderkey AS event_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE k > n // 2")
def outbox_truncation(spark, d):
    return telemetry.keep_last_half(runs_table(spark, d), "run_id", "event_id").select("run_id", "event_id")


@query("SELECT o_custkey AS run_id, min(o_orderkey) AS breached_at FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS c FROM orders) WHERE c > 8 GROUP BY 1")
def budget_first_breach(spark, d):
    return telemetry.first_breach(runs_table(spark, d).withColumn("one", F.lit(1)), "run_id", "event_id", "one", 8)


@query("WITH t AS (SELECT conv_id AS call_id, turn AS ord, CASE WHEN role = 'user' THEN 'start' ELSE 'finish' END AS kind FROM conversations), n AS (SELECT *, lead(kind) OVER w AS nk, lead(ord) OVER w AS no FROM t WINDOW w AS (PARTITION BY call_id ORDER BY ord)) SELECT call_id, ord AS started, CASE WHEN nk = 'finish' THEN no ELSE -1 END AS finished FROM n WHERE kind = 'start'")
def call_pairing(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("call_id"), F.col("turn").alias("ord"), F.when(F.col("role") == "user", "start").otherwise("finish").alias("kind"))
    return telemetry.pair_calls(c).withColumn("finished", F.coalesce("finished", F.lit(-1)))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN round((length(text) * 3.0 + 15.0 * turn) / 1e6, 6) ELSE 0.0 END AS cost FROM conversations")
def call_cost(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("model"), F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens"))
    return telemetry.api_cost(c, {"user": (3.0, 15.0)}).select("conv_id", "turn", F.round("cost", 6).alias("cost"))


# ------------------------------------------------------------------------------------ events and replay


@query(f"WITH {_EVENTS} SELECT run_id, count(*) AS n_events, max(ord) AS last_ord, arg_max(new_state, ord) FILTER (type = 'RUN_STATE_CHANGED') AS run_state, count(DISTINCT name) FILTER (type = 'ARTIFACT_WRITTEN') AS n_artifacts FROM ev GROUP BY 1")
def run_snapshot_replay(spark, d):
    s = events.replay(event_rows(spark, d))
    return s.select("run_id", "n_events", "last_ord", "run_state", F.coalesce(F.size("artifacts"), F.lit(0)).cast("long").alias("n_artifacts"))


@query(f"WITH {_EVENTS} SELECT run_id, ord, type, CASE type WHEN 'RUN_STATE_CHANGED' THEN 'state: ' || new_state WHEN 'ARTIFACT_WRITTEN' THEN 'wrote ' || name WHEN 'RUN_CREATED' THEN 'run_created' ELSE lower(replace(type, 'WORK_ITEM_', '')) || ' ' || item END AS message FROM ev")
def event_timeline(spark, d):
    return events.timeline(event_rows(spark, d)).drop("ts")


@query(f"WITH {_EVENTS} SELECT run_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us, count(*) FILTER (type = 'WORK_ITEM_FINISHED') AS n_finished, 0::BIGINT AS n_failed, count(*) AS n_timeline FROM ev GROUP BY 1")
def run_summaries(spark, d):
    return events.run_summary(event_rows(spark, d))


def _chained(spark, d):
    from pyspark.sql import Window

    e = event_rows(spark, d).withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")).cast("string"))
    prev = F.sha2(F.coalesce(F.lag("event_id").over(Window.partitionBy("run_id").orderBy("ord")), F.lit("")), 256)
    e = e.withColumn("prev_hash", F.when(F.col("ord") % 11 > 0, prev))
    return e.withColumn("event_hash", F.when(F.col("ord") % 5 == 0, "x").otherwise(F.sha2("event_id", 256)))


@query(f"""WITH {_EVENTS}, c AS (SELECT run_id, ord, sha256(coalesce(lag(ord::VARCHAR) OVER (PARTITION BY run_id ORDER BY ord), '')) AS p, CASE WHEN ord % 5 = 0 THEN 'x' ELSE sha256(ord::VARCHAR) END AS h FROM ev),
h AS (SELECT *, lag(h) OVER (PARTITION BY run_id ORDER BY ord) AS b FROM c WHERE ord % 11 > 0)
SELECT run_id, ord, CASE WHEN b IS NOT NULL AND b <> p THEN 'prev_hash' ELSE 'event_hash' END AS reason FROM h""")
def event_chain_breaks(spark, d):
    return events.chain_breaks(_chained(spark, d)).select("run_id", "ord", "reason")


@query("SELECT user_id AS run_id, event_id AS ord FROM events WHERE event_id > 5000")
def replay_incremental(spark, d):
    return events.replay_from(event_rows(spark, d), 5000).select("run_id", "ord")


@query(f"WITH {_EVENTS}, w AS (SELECT unnest(['w0', 'w1', 'w2', 'w3']) AS worker) SELECT r.run_id, w.worker FROM (SELECT DISTINCT run_id FROM ev) r, w WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.run_id = r.run_id AND e.type = 'WORK_ITEM_FINISHED' AND e.item = w.worker)")
def incomplete_workers(spark, d):
    return events.incomplete_workers(event_rows(spark, d), spark.createDataFrame([(f"w{k}",) for k in range(4)], "worker string"))


# ------------------------------------------------------------------------------------- text and evidence

_TOK = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) > 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "], x))"
_PRIORITY = "CAST(substr(source, 4) AS INT) % 7 + 1"


@query(f"WITH t AS (SELECT doc_id, {_TOK} AS t FROM documents), e AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM t) SELECT doc_id, term, round(count(*) / n, 9) AS tf FROM e GROUP BY doc_id, n, term")
def doc_tokens_tf(spark, d):
    return evidence.term_frequencies(table(spark, d, "documents")).withColumn("tf", F.round("tf", 9))


@query(f"WITH e AS (SELECT unnest(list_distinct({_TOK})) AS term FROM documents) SELECT term, count(*) AS df, round(ln(1 + (SELECT count(*) FROM documents) / count(*)), 9) AS idf FROM e GROUP BY term")
def corpus_idf(spark, d):
    return evidence.inverse_frequencies(table(spark, d, "documents")).withColumn("idf", F.round("idf", 9))


_VEC = f"""WITH t AS (SELECT doc_id, {_TOK} AS t FROM documents), q AS (SELECT item_id AS query_id, {_TOK} AS t FROM benchmark),
idf AS (SELECT term, ln(1 + (SELECT count(*) FROM documents) / count(*)) AS idf FROM (SELECT unnest(list_distinct(t)) AS term FROM t) GROUP BY term),
dv AS (SELECT doc_id, term, count(*) / n * any_value(idf) AS w FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM t) JOIN idf USING (term) GROUP BY doc_id, n, term),
qv AS (SELECT query_id, term, count(*) / n * any_value(idf) AS v FROM (SELECT query_id, len(t) AS n, unnest(t) AS term FROM q) JOIN idf USING (term) GROUP BY query_id, n, term),
s AS (SELECT query_id, doc_id, sum(w * v) AS dot FROM dv JOIN qv USING (term) GROUP BY 1, 2),
r AS (SELECT query_id, doc_id, round(least(1, dot / (nd * nq)), 9) AS score FROM s JOIN (SELECT doc_id, sqrt(sum(w * w)) AS nd FROM dv GROUP BY 1) USING (doc_id) JOIN (SELECT query_id, sqrt(sum(v * v)) AS nq FROM qv GROUP BY 1) USING (query_id))
SELECT query_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM r) WHERE k <= 5"""


@query(_VEC)
def tfidf_cosine_topk(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return evidence.cosine_topk(q, table(spark, d, "documents")).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def _claims(spark, d):
    b = table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim_text"), claims.claim_kind(F.col("text")).alias("claim_kind"))


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", F.expr(_PRIORITY).alias("priority"))


_EVIDENCE = f"""d AS (SELECT doc_id, {_PRIORITY} AS p, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w, list_distinct({_TOK}) AS t FROM documents),
c AS (SELECT item_id AS claim_id, list_distinct(list_append(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 2), 'feature')) AS a, list_distinct({_TOK}) AS t, list_append({_TOK}, 'feature') AS k FROM benchmark),
m AS (SELECT claim_id, doc_id, any_value(p) AS p FROM (SELECT claim_id, unnest(a) AS x FROM c) JOIN (SELECT doc_id, p, unnest(w) AS x FROM d) USING (x) GROUP BY 1, 2),
b AS (SELECT claim_id, doc_id, count(*) AS n FROM (SELECT claim_id, unnest(t) AS x FROM c) JOIN (SELECT doc_id, unnest(t) AS x FROM d) USING (x) GROUP BY 1, 2),
h AS (SELECT claim_id, doc_id, count(*) AS n FROM (SELECT claim_id, unnest(k) AS x FROM c) JOIN (SELECT doc_id, unnest(w) AS x FROM d) USING (x) GROUP BY 1, 2),
s AS (SELECT claim_id, doc_id, round(least(1, 0.3 * (8 - m.p) / 7 + 0.4 * coalesce(b.n / (len(c.t) + len(d.t) - b.n), 0) + 0.3 * coalesce(h.n, 0) / len(c.k)), 9) AS score
  FROM m JOIN c USING (claim_id) JOIN d USING (doc_id) LEFT JOIN b USING (claim_id, doc_id) LEFT JOIN h USING (claim_id, doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0.05)"""


@query(f"WITH {_EVIDENCE} SELECT claim_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 20")
def evidence_topk_docs(spark, d):
    return evidence.evidence_topk(_claims(spark, d), _docs(spark, d)).select("claim_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_EVIDENCE}, n AS (SELECT c.claim_id, count(r.doc_id) AS n FROM c LEFT JOIN (SELECT * FROM r WHERE rank <= 20) r USING (claim_id) GROUP BY 1) SELECT count(*) AS total_claims, count(*) FILTER (n > 0) AS claims_with_evidence, sum(n)::BIGINT AS total_evidence, round(avg(n), 2) AS average FROM n")
def evidence_coverage(spark, d):
    c = _claims(spark, d)
    return evidence.coverage(c, evidence.evidence_topk(c, _docs(spark, d)))


@query("""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '\\S+') AS w, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '\\S'))) AS n_s FROM documents),
y AS (SELECT doc_id, len(w) AS n_w, n_s, list_sum(list_transform(list_transform(w, lambda x: lower(regexp_replace(x, '[^a-zA-Z]', '', 'g'))), lambda x: CASE WHEN x = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN ends_with(x, 'e') THEN 1 ELSE 0 END) END)) AS n_y, length(trim(text)) AS n FROM w)
SELECT doc_id, round(CASE WHEN n < 10 OR n_w = 0 OR n_s = 0 THEN 0 ELSE greatest(0, least(20, 0.39 * n_w / n_s + 11.8 * n_y / n_w - 15.59)) END, 6) AS grade FROM y""")
def readability_grade(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.round(T.reading_grade(F.col("text")) * 1e6) / 1e6).alias("grade"))


@query("SELECT doc_id, round(CASE WHEN trim(text) = '' THEN 0 ELSE len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*($|#|//|/\\*|\\*|--|<!--)'))) / len(string_split(text, chr(10))) END, 9) AS ratio FROM documents")
def content_ratio(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(files.content_ratio(F.col("text")), 9).alias("ratio"))


# ---------------------------------------------------------------------------------------------- claims

_STATEMENTS = r"""a AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS raw FROM (SELECT doc_id, string_split(content, chr(10)) AS l FROM md)),
b AS (SELECT doc_id, line, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS t FROM a),
c AS (SELECT *, regexp_matches(t, '[.!?:]$')::INT AS e FROM b WHERE t <> '' AND (NOT starts_with(t, '#') OR regexp_matches(lower(t), 'supports|can|enables|install|usage|format|provides'))),
p AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM c),
w AS (SELECT doc_id, n, string_agg(t, ' ' ORDER BY line) AS claim_text, max(line) AS end_line FROM p GROUP BY 1, 2 HAVING max(e) = 1),
st AS (SELECT doc_id, claim_text, coalesce(lag(end_line) OVER (PARTITION BY doc_id ORDER BY n), 0) + 1 AS start_line, end_line FROM w)"""
_KIND = """CASE WHEN regexp_matches(x, 'does not support|not supported|not yet implemented|not implemented|cannot|limitation|unsupported') THEN 'limitation'
WHEN regexp_matches(x, 'install|setup|usage:|how to|getting started|maven|nuget') THEN 'workflow'
WHEN regexp_matches(x, 'api includes|api provides|class for|class that|function exports|function imports|function for|method for') THEN 'api'
WHEN regexp_matches(x, 'class|function|method|interface') AND NOT regexp_matches(x, 'format|file type|reads|writes') THEN 'api'
WHEN regexp_matches(x, 'reads|writes|file type') THEN 'format'
WHEN x LIKE '%provides%' AND regexp_matches(x, 'class|function|method|api') AND x NOT LIKE '%format%' THEN 'api'
WHEN x LIKE '%provides%' AND NOT regexp_matches(x, 'class|function|method|api') THEN CASE WHEN x LIKE '%format%' THEN 'format' ELSE 'feature' END
WHEN regexp_matches(x, 'import|export') THEN CASE WHEN regexp_matches(x, 'model|file|format|fbx|obj|stl') THEN 'format' WHEN regexp_matches(x, 'module|package') THEN 'feature' ELSE 'format' END
WHEN x LIKE '%format%' THEN CASE WHEN regexp_matches(x, 'obj|stl|fbx|pdf|file') THEN 'format' WHEN regexp_matches(x, 'multiple|various|many|3d') THEN 'feature' ELSE 'format' END ELSE 'feature' END"""


def _statements(spark, d):
    return claims.statements(markdown(spark, d).select("doc_id", F.col("content").alias("text")))


@query(f"WITH {MD}, {_STATEMENTS} SELECT doc_id, md5(claim_text) AS digest, start_line, end_line FROM st")
def sentence_extract(spark, d):
    return _statements(spark, d).select("doc_id", F.md5(F.encode("claim_text", "UTF-8")).alias("digest"), "start_line", "end_line")


@query(f"WITH {MD}, {_STATEMENTS}, k AS (SELECT *, lower(claim_text) AS x FROM st) SELECT {_KIND} AS claim_kind, count(*) AS n FROM k GROUP BY 1")
def claim_kind_histogram(spark, d):
    kinds = _statements(spark, d).select(claims.claim_kind(F.col("claim_text")).alias("claim_kind"), F.lit("inference").alias("truth_status"))
    return claims.kind_histogram(kinds).select("claim_kind", F.col("n_claims").alias("n"))


@query(rf"""WITH {MD}, {_STATEMENTS} SELECT doc_id, start_line, CASE WHEN regexp_matches(claim_text, '(?i)\byour job is to\b|\bwe don.t need\b|\bcode in module\b|\btodo\b|\bfixme\b|\bhack\b|\bworkaround\b') THEN 'developer_instruction'
WHEN regexp_matches(claim_text, '0x[0-9a-fA-F]{{4,}}|(?i:\bjcid\w+)|(?i:\bguid[_-])|(?i:\w+\s*\(\d+\s*bytes?\)\s*:)|(?i:\bsection\s+\d+\.\d+)|\b(?:MUST|SHALL|SHOULD)\s+(?:be|have|contain)\b|\b(?:CompactID|FileNode|ExtendedGUID|PartitionID|ObjectDeclaration|PropertySet|OutlineElementRTL)\b|["'']0x[0-9A-Fa-f]{{2}}["'']') THEN 'internal_detail'
WHEN len(list_filter(regexp_extract_all(claim_text, '[A-Z][a-z]+(?:[A-Z][a-z]+){{2,}}'), lambda m: length(m) > 10)) > 0 OR len(regexp_extract_all(claim_text, '\b[a-z]+(?:_[a-z]+)+\b|\b[a-z]+[A-Z]\w+\b')) > 0.15 * len(regexp_extract_all(claim_text, '\S+')) THEN 'internal_detail' ELSE 'user_facing' END AS audience FROM st""")
def claim_audience(spark, d):
    return _statements(spark, d).select("doc_id", "start_line", claims.audience(F.col("claim_text")).alias("audience"))


def _claim_rows(spark, d):
    s = _statements(spark, d).join(table(spark, d, "documents").select("doc_id", F.expr(_PRIORITY).alias("source_priority")), "doc_id")
    kind = claims.claim_kind(F.col("claim_text"))
    confident = F.element_at(F.array(*map(F.lit, ("high", "medium", "low"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return s.select(
        claims.claim_id(F.col("claim_text"), kind).alias("claim_id"), "claim_text", kind.alias("claim_kind"), F.when(F.col("doc_id") % 2 == 0, "fact").otherwise("inference").alias("truth_status"),
        confident.alias("confidence"), "source_priority", (F.col("doc_id") * 100000 + F.col("start_line")).alias("ord"), F.struct(F.col("doc_id").cast("string").alias("path"), "start_line", "end_line").alias("citation"),
    )


@query(rf"""WITH {MD}, {_STATEMENTS}, k AS (SELECT st.*, lower(claim_text) AS x FROM st), r AS (SELECT k.*, {_KIND} AS kind, {_PRIORITY} AS pr FROM k JOIN documents USING (doc_id)),
i AS (SELECT *, sha256(lower(regexp_replace(claim_text, '\s+', ' ', 'g')) || '|' || kind) AS claim_id FROM r)
SELECT claim_id, count(*) AS n_citations, CASE WHEN bool_or(doc_id % 2 = 0) THEN 'fact' ELSE 'inference' END AS truth_status, CASE min(doc_id % 3) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, min(pr)::INT AS source_priority FROM i GROUP BY 1""")
def claim_dedup(spark, d):
    return claims.merge_claims(_claim_rows(spark, d)).select("claim_id", F.size("citations").cast("long").alias("n_citations"), "truth_status", "confidence", "source_priority")


@query(rf"""WITH {MD}, {_STATEMENTS}, k AS (SELECT *, lower(claim_text) AS x FROM st), r AS (SELECT x, {_KIND} AS kind FROM k),
g AS (SELECT CASE kind WHEN 'limitation' THEN 'limitations' WHEN 'workflow' THEN CASE WHEN regexp_matches(x, 'install|setup') THEN 'install_steps' WHEN regexp_matches(x, 'getting started|quickstart|first|begin') THEN 'quickstart_steps' ELSE 'workflow_claims' END WHEN 'feature' THEN 'key_features' WHEN 'api' THEN 'key_features' END AS name,
sha256(regexp_replace(x, '\s+', ' ', 'g') || '|' || kind) AS id FROM r) SELECT name, count(DISTINCT id) AS n FROM g WHERE name IS NOT NULL GROUP BY 1""")
def claim_groups(spark, d):
    return claims.claim_groups(claims.merge_claims(_claim_rows(spark, d))).select("name", F.size("claim_ids").cast("long").alias("n"))


@query(rf"""WITH {MD}, {_STATEMENTS}, k AS (SELECT *, lower(claim_text) AS x FROM st), r AS (SELECT x, {_KIND} AS kind FROM k), f AS (SELECT DISTINCT x, upper(regexp_extract(x, '\b(obj|fbx|stl|dae|gltf|glb|ply|3ds|off|one|pdf|dwg|dxf)\b', 1)) AS format FROM r WHERE kind = 'format')
SELECT format, CASE WHEN regexp_matches(x, 'does not|cannot|not supported|unsupported') THEN 'unknown' ELSE 'implemented' END AS status, CASE WHEN regexp_matches(x, 'import|read') THEN 'import' WHEN regexp_matches(x, 'export|write') THEN 'export' WHEN x LIKE '%both%' THEN 'both' ELSE 'unknown' END AS direction, count(*) AS n FROM f WHERE format <> '' GROUP BY ALL""")
def claim_formats(spark, d):
    return claims.supported_formats(claims.merge_claims(_claim_rows(spark, d))).groupBy("format", "status", "direction").agg(F.count("*").alias("n"))


def _polar(spark, d):
    """Benchmark passages, every third negated, as claims that contradict each other."""
    b = table(spark, d, "benchmark")
    both = b.select((2 * F.col("item_id")).alias("claim_id"), F.concat(F.lit("Supports "), "text").alias("claim_text"), (F.col("item_id") % 7 + 1).alias("source_priority"))
    return both.union(b.select(2 * F.col("item_id") + 1, F.concat(F.lit("Does not support "), "text"), F.col("item_id") % 5 + 1)).withColumn("truth_status", F.lit("fact")).withColumn("confidence", F.lit("high"))


_POLAR = r"""q AS (SELECT 2 * item_id AS claim_id, 'Supports ' || text AS t, item_id % 7 + 1 AS p, true AS yes FROM benchmark UNION ALL SELECT 2 * item_id + 1, 'Does not support ' || text, item_id % 5 + 1, false FROM benchmark),
qq AS (SELECT *, list_distinct(regexp_extract_all(lower(t), '[\p{L}\p{N}_]+')) AS w, CASE WHEN regexp_matches(lower(t), 'format|read|write|import|export') THEN 'format' WHEN regexp_matches(lower(t), 'install|setup|usage') THEN 'workflow' WHEN regexp_matches(lower(t), 'class|function|method|api') THEN 'api' ELSE 'feature' END AS s, nullif(regexp_extract(lower(t), '\b(obj|fbx|stl|dae|gltf|glb|ply|3ds|off|one|pdf|dwg|dxf)\b', 1), '') AS f FROM q),
pp AS (SELECT least(a.claim_id, b.claim_id) AS claim_a_id, greatest(a.claim_id, b.claim_id) AS claim_b_id, CASE WHEN a.claim_id < b.claim_id THEN a.p ELSE b.p END AS pa, CASE WHEN a.claim_id < b.claim_id THEN b.p ELSE a.p END AS pb FROM qq a JOIN qq b ON a.yes AND NOT b.yes AND (a.s = b.s OR a.f = b.f)
 WHERE len(list_intersect(a.w, b.w)) >= 0.3 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))),
co AS (SELECT claim_a_id, claim_b_id, CASE WHEN abs(pa - pb) >= 2 THEN 'prefer_higher_priority' WHEN abs(pa - pb) = 1 THEN 'manual_review_required' ELSE 'unresolved' END AS resolution, CASE WHEN pa <= pb THEN claim_a_id ELSE claim_b_id END AS winning_claim_id FROM pp)"""


@query(f"WITH {_POLAR} SELECT * FROM co")
def contradiction_pairs(spark, d):
    return claims.contradictions(_polar(spark, d))


@query(f"WITH {_POLAR}, lo AS (SELECT CASE WHEN winning_claim_id = claim_a_id THEN claim_b_id ELSE claim_a_id END AS claim_id, arg_max(resolution, claim_a_id * 1000000 + claim_b_id) AS r FROM co WHERE resolution <> 'unresolved' GROUP BY 1) SELECT claim_id, CASE WHEN r = 'prefer_higher_priority' THEN 'inference' ELSE 'fact' END AS truth_status, CASE WHEN r = 'prefer_higher_priority' THEN 'low' ELSE 'high' END AS confidence FROM q LEFT JOIN lo USING (claim_id)")
def contradiction_downgrade(spark, d):
    c = _polar(spark, d)
    return claims.downgrade_losers(c, claims.contradictions(c)).select("claim_id", "truth_status", "confidence")


# -------------------------------------------------------------------------------------- checks and gates


def _rows(df: DataFrame) -> DataFrame:
    return df.select("slug", "line", "detail", "severity")


@query(rf"""WITH {LINES}, g AS (SELECT slug, line, text, regexp_extract_all(lower(text), '\S+') AS w FROM lines), h AS (SELECT * FROM g WHERE len(list_filter(w, lambda x: regexp_matches(x, '{"|".join(checks.TECHNICAL_TERMS)}'))) <= 0.2 * len(w))
SELECT slug, line, detail, 'warn' AS severity FROM (SELECT slug, line, unnest(list_filter([CASE WHEN regexp_matches(text, '\s+,') THEN 'space before comma' END, CASE WHEN regexp_matches(text, '\s+\.') THEN 'space before period' END, CASE WHEN regexp_matches(text, '[a-z]\.[A-Z]') THEN 'no space after period' END, CASE WHEN regexp_matches(text, '\b(the the|a a|an an)\b') THEN 'repeated word' END], lambda z: z IS NOT NULL)) AS detail FROM h)""")
def check_grammar(spark, d):
    return _rows(checks.grammar(md_lines(spark, d)))


@query(rf"""WITH {LINES}, s AS (SELECT *, length(t) AS n, length(regexp_extract(text, '^(\s*)', 1)) // 2 AS depth FROM lines WHERE regexp_matches(t, '^([-*]|\d+\.)\s+'))
SELECT slug, line, 'long bullet: ' || n AS detail, CASE WHEN n > 200 THEN 'error' ELSE 'warn' END AS severity FROM s WHERE n > 150 UNION ALL SELECT slug, line, 'deep bullet: ' || depth, 'warn' FROM s WHERE depth > 3""")
def check_bullets(spark, d):
    return _rows(checks.bullets(md_lines(spark, d)))


@query(rf"""WITH {LINES} SELECT slug, line, p AS detail, 'warn' AS severity FROM lines, (SELECT unnest(['kinda', 'sorta', 'gonna', 'wanna', 'you guys', 'awesome', 'super', 'retty']) AS p) WHERE regexp_matches(text, '(?i)\b' || p || '\b')""")
def check_tone(spark, d):
    return _rows(checks.tone(md_lines(spark, d)))


@query(rf"""WITH {LINES} SELECT slug, line, k::VARCHAR AS detail, 'error' AS severity FROM lines, (SELECT unnest(range(0, 8)) AS k, unnest(['\bTODO\b', '\bTBD\b', '\bFIXME\b', '\bXXX\b', '\bPLACEHOLDER\b', '\bCOMING SOON\b', '\[INSERT.*?\]', '\{{.*?TBD.*?\}}']) AS p) WHERE regexp_matches(text, '(?i)' || p)""")
def check_completeness(spark, d):
    return _rows(checks.completeness(md_lines(spark, d)))


_SKIPS = r"h AS (SELECT slug, line, length(regexp_extract(t, '^(#+)', 1)) AS v FROM lines WHERE starts_with(t, '#')), k AS (SELECT *, lag(v) OVER (PARTITION BY slug ORDER BY line) AS w FROM h)"


@query(f"WITH {LINES}, {_SKIPS} SELECT slug, line, w || ' to ' || v AS detail, 'error' AS severity FROM k WHERE v > w + 1")
def check_headings_skip(spark, d):
    return _rows(checks.heading_skips(md_lines(spark, d)))


@query(rf"WITH {LINES}, {_SKIPS} SELECT slug, line, w || ' to ' || v AS detail, 'warn' AS severity FROM k WHERE v > w + 1 UNION ALL SELECT slug, line, 'no alt text', 'warn' FROM lines WHERE regexp_matches(text, '!\[\s*\]\(')")
def gate_accessibility(spark, d):
    return _rows(gates.accessibility(md_lines(spark, d)))


@query(rf"""WITH {LINES}, m AS (SELECT *, (regexp_matches(t, '^(---|```|#|-|\*|>)') OR t = '')::INT AS b FROM lines), i AS (SELECT *, sum(b) OVER (PARTITION BY slug ORDER BY line) AS g FROM m),
r AS (SELECT slug, g, count(*) FILTER (b = 0) AS n, min(line) FILTER (b = 0) AS f FROM i GROUP BY 1, 2), z AS (SELECT slug, max(g) AS g FROM i GROUP BY 1)
SELECT r.slug, f AS line, 'long paragraph: ' || n AS detail, 'warn' AS severity FROM r JOIN z ON r.slug = z.slug AND r.g < z.g WHERE n > 10
UNION ALL SELECT slug, 1, 'no headings: ' || n, 'warn' FROM (SELECT slug, count(*) AS n, count(*) FILTER (starts_with(t, '#')) AS h FROM lines WHERE t <> '' AND NOT regexp_matches(t, '^(---|```)') GROUP BY 1) WHERE n > 50 AND h = 0""")
def check_paragraphs(spark, d):
    return _rows(checks.paragraphs(md_lines(spark, d)))


@query(rf"WITH {LINES} SELECT slug, line, unnest(regexp_extract_all(text, '(?i)\[claim:\s*([a-f0-9\-]{{36,64}})\]', 1)) AS detail, 'error' AS severity FROM lines")
def check_claim_markers(spark, d):
    return _rows(checks.claim_markers(md_lines(spark, d)))


_BODY = r"regexp_replace(regexp_replace(content, '(?s)^---\s*\n.*?\n---\s*\n', ''), '(?s)```.*?```', '', 'g')"


@query(rf"WITH {MD}, n AS (SELECT slug, len(regexp_extract_all({_BODY}, '\S+')) AS n, len(regexp_extract_all(content, '(?i)<!--\s*claim_id:\s*[a-f0-9\-]{{36,64}}\s*-->|\[claim:\s*[a-f0-9\-]+\]')) AS c FROM md) SELECT slug, 1::BIGINT AS line, c || '/' || n AS detail, 'warn' AS severity FROM n WHERE n > 100 AND c < n / 100")
def check_density(spark, d):
    return _rows(checks.density(markdown(spark, d)))


@query(rf"""WITH {MD}, f AS (SELECT slug, nullif(regexp_extract(content, '(?s)^---\s*\n(.*?\n)---(?:\s*\n|$)', 1), '') AS b FROM md), w AS (SELECT slug, unnest(range(2, len(x) + 2)) AS line, unnest(x) AS x FROM (SELECT slug, string_split(b, chr(10)) AS x FROM f WHERE b IS NOT NULL))
SELECT slug, 1::BIGINT AS line, 'no front matter' AS detail, 'blocker' AS severity FROM f WHERE b IS NULL
UNION ALL SELECT slug, 1, n, 'error' FROM f, (SELECT unnest(['title', 'description', 'url']) AS n, unnest(['title', 'description', '(?:permalink|url_path)']) AS p) WHERE b IS NOT NULL AND NOT regexp_matches(b, '(?m)^' || p || ':')
UNION ALL SELECT slug, line, 'comment', 'error' FROM w WHERE regexp_matches(x, '^\s*#[^#]')""")
def check_front_matter(spark, d):
    return _rows(checks.front_matter_complete(markdown(spark, d)))


@query(rf"WITH {LINES} SELECT slug, line, 'blank text' AS detail, 'error' AS severity FROM (SELECT slug, line, unnest(regexp_extract_all(text, '\[\s+\]\([^\)]+\)')) FROM lines) UNION ALL SELECT slug, line, 'blank url', 'error' FROM (SELECT slug, line, unnest(regexp_extract_all(text, '\[[^\]]+\]\(\s+\)')) FROM lines)")
def check_links(spark, d):
    return _rows(checks.blank_links(md_lines(spark, d)))


@query(rf"""WITH {MD} SELECT slug, r AS "check" FROM (SELECT slug, unnest(list_filter([
CASE WHEN regexp_matches(slug, 'getting-started|quickstart') AND NOT regexp_matches(content, '(?i)developer guide|next steps|learn more') THEN 'usability.user_journey' END,
CASE WHEN (slug LIKE '%index%' OR slug IN ('home', 'landing')) AND NOT regexp_matches(content, '(?i)get started|download|install|try|explore|learn more|read the|check out') THEN 'usability.call_to_action_presence' END,
CASE WHEN regexp_matches(slug, 'how-to|howto|guide') AND NOT regexp_matches(content, '(?im)^#+\s*prerequisites') THEN 'usability.prerequisites_clarity' END,
CASE WHEN NOT (slug LIKE '%\_index%' ESCAPE '\' OR slug = 'index') AND len(regexp_extract_all(content, '\[([^\]]+)\]\(([^\)]+)\)')) < 2 THEN 'usability.related_links' END], lambda z: z IS NOT NULL)) AS r FROM md)""")
def check_page_rules(spark, d):
    return checks.page_rules(markdown(spark, d)).select("slug", "check")


@query(rf"""WITH {LINES} SELECT slug, line, 'no alt text' AS detail, 'error' AS severity FROM (SELECT slug, line, unnest(regexp_extract_all(text, '!\[\s*\]\(')) FROM lines)
UNION ALL SELECT slug, line, 'click here', 'error' FROM (SELECT slug, line, unnest(regexp_extract_all(text, '(?i)\[click here\]')) FROM lines)
UNION ALL SELECT slug, line, 'columns: ' || c, 'warn' FROM (SELECT slug, line, fence, length(text) - length(replace(text, '|', '')) - 1 AS c FROM lines) WHERE c > 5 AND NOT fence
UNION ALL SELECT slug, line, 'code line: ' || length(text), 'warn' FROM lines WHERE length(text) > 100 AND inside AND NOT fence""")
def check_line_rules(spark, d):
    return _rows(checks.line_rules(md_lines(spark, d)))


@query(rf"""WITH {LINES}, h AS (SELECT slug, line, regexp_replace(regexp_replace(t, '^#+\s*', ''), '^\s+|\s+$', '', 'g') AS h FROM lines WHERE starts_with(t, '#'))
SELECT slug, line, h AS detail, 'warn' AS severity FROM h WHERE len(regexp_extract_all(h, '\S+')) <= 2 AND lower(h) NOT LIKE '%acme%' AND lower(h) NOT IN ('overview', 'introduction', 'examples', 'usage', 'installation')""")
def check_heading_text(spark, d):
    return _rows(checks.headings(md_lines(spark, d), PRODUCT))


@query(rf"""WITH {LINES}, e AS (SELECT slug, line, text, coalesce(sum(CASE WHEN starts_with(t, '#') THEN 0 ELSE len(regexp_extract_all(t, '[.!?]')) END) OVER (PARTITION BY slug ORDER BY line ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) AS n FROM lines)
SELECT slug, line, 'no introduction' AS detail, 'warn' AS severity FROM e WHERE regexp_matches(text, '^##\s+') AND n = 0""")
def check_disclosure(spark, d):
    return _rows(checks.disclosure(md_lines(spark, d)))


@query(rf"""WITH {LINES}, e AS (SELECT *, max((length(t) > 20)::INT) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS b, max((length(t) > 20)::INT) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS a, sum(fence::INT) OVER (w) AS n FROM lines WINDOW w AS (PARTITION BY slug ORDER BY line)),
f AS (SELECT *, lead(line) OVER (PARTITION BY slug ORDER BY line) IS NOT NULL AS c FROM e WHERE fence)
SELECT slug, line, 'no introduction' AS detail, 'warn' AS severity FROM f WHERE n % 2 = 1 AND c AND coalesce(b, 0) = 0 UNION ALL SELECT slug, line, 'no explanation', 'warn' FROM f WHERE n % 2 = 0 AND coalesce(a, 0) = 0""")
def check_example_clarity(spark, d):
    return _rows(checks.example_clarity(md_lines(spark, d)))


@query(rf"WITH {LINES} SELECT slug, line, p AS detail, 'warn' AS severity FROM lines, (SELECT unnest(['Error:', 'Exception:', 'Warning:', 'Failed:', 'Cannot:']) AS p) WHERE regexp_matches(slug, 'troubleshoot|error|faq') AND NOT inside AND regexp_matches(text, p)")
def check_error_messages(spark, d):
    return _rows(checks.error_messages(md_lines(spark, d)))


@query(rf"WITH {LINES}, m AS (SELECT slug, line, unnest(regexp_extract_all(text, '(?i)<!--\s*claim_id:\s*([a-f0-9\-]{{36,64}})\s*-->', 1)) AS id FROM lines) SELECT slug, line, id AS detail, 'error' AS severity FROM m WHERE id NOT IN (SELECT md5(k::VARCHAR) || md5((k + 1)::VARCHAR) FROM (SELECT unnest(range(0, 10)) AS k))")
def check_claim_validity(spark, d):
    known = spark.range(10).select(F.concat(F.md5(F.col("id").cast("string")), F.md5((F.col("id") + 1).cast("string"))).alias("claim_id"))
    return _rows(checks.unknown_claims(md_lines(spark, d), known))


@query(rf"WITH {LINES} SELECT slug, line, lower(regexp_extract(text, '(?i)(commercial licen[sc]e|purchase|pricing|paid plan|free trial|subscription|buy now|temporary license)', 1)) AS detail, 'error' AS severity FROM lines WHERE NOT inside AND regexp_matches(text, '(?i)commercial licen[sc]e|purchase|pricing|paid plan|free trial|subscription|buy now|temporary license')")
def check_licensing(spark, d):
    return _rows(checks.licensing(md_lines(spark, d), "Acme FOSS"))


@query(rf"WITH {MD} SELECT slug, 1::BIGINT AS line, 'no product name' AS detail, 'warn' AS severity FROM md WHERE lower(content) NOT LIKE '%acme%' UNION ALL SELECT slug, 1, u, 'error' FROM (SELECT slug, unnest(list_distinct(regexp_extract_all(content, 'https://github\.com/[\w.-]+/[\w.-]+'))) AS u FROM md) WHERE u <> 'https://github.com/acme/tool'")
def check_terminology(spark, d):
    return _rows(checks.terminology(markdown(spark, d), PRODUCT, REPO))


@query(r"""WITH l AS (SELECT page_id AS slug, unnest(range(1, len(x) + 1)) AS line, unnest(x) AS text FROM (SELECT page_id, string_split(html, chr(10)) AS x FROM pages))
SELECT slug, line, d AS detail, s AS severity FROM l, (SELECT unnest(['blocker', 'blocker', 'blocker', 'warn', 'error']) AS s, unnest(['script', 'handler', 'javascript url', 'data url', 'unsafe tag']) AS d, unnest(['(?i)<script[^>]*>', '(?i)\bon(click|load|error|mouseover|submit|focus|blur|change|keyup|keydown)=', '(?i)javascript:', '(?i)data:text/html', '(?i)<(iframe|embed|object|applet|meta|base|link)[^>]*>']) AS p) WHERE regexp_matches(text, p)""")
def gate_xss(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("slug"), F.col("html").alias("content"))
    return _rows(gates.xss(checks.lines_of(p)))


@query(rf"WITH {LINES} SELECT slug, line, d AS detail, 'blocker' AS severity FROM lines, (SELECT unnest(['PASSWORD', 'TOKEN']) AS d, unnest(['(?i)password\s*[=:]\s*[\"'']?[^\s\"'']{{8,}}[\"'']?', '(?i)token\s*[=:]\s*[\"'']?[a-zA-Z0-9_\-]{{20,}}[\"'']?']) AS p) WHERE NOT inside AND regexp_matches(text, p)")
def gate_sensitive(spark, d):
    return _rows(gates.sensitive(md_lines(spark, d), extended=True))


@query(rf"""WITH {LINES}, u AS (SELECT slug, line, unnest(regexp_extract_all(text, '\[[^\]]*\]\(([^)]+)\)', 1)) AS u FROM lines WHERE NOT inside)
SELECT slug, line, u AS detail, CASE WHEN starts_with(u, '//') THEN 'warn' ELSE 'error' END AS severity FROM u WHERE starts_with(u, 'http://') OR starts_with(u, '//')""")
def gate_links(spark, d):
    return _rows(gates.external_links(md_lines(spark, d)))


@query(rf"WITH {LINES} SELECT slug, line, unnest(list_distinct(regexp_extract_all(text, '__[A-Z][A-Z0-9_]*__'))) AS detail, 'blocker' AS severity FROM lines WHERE NOT inside")
def gate_tokens(spark, d):
    return _rows(gates.unresolved_tokens(md_lines(spark, d)))


@query(rf"WITH {LINES} SELECT slug, line, substr(text, 1, 7) AS detail, 'blocker' AS severity FROM lines WHERE regexp_matches(text, '^(<{{7}}|={{7}}|>{{7}})')")
def gate_conflicts(spark, d):
    return _rows(gates.conflict_markers(md_lines(spark, d)))


@query(rf"WITH {MD}, f AS (SELECT slug, coalesce(regexp_extract(content, '(?s)^---\s*\n(.*?\n)---(?:\s*\n|$)', 1), '') AS b FROM md) SELECT slug, 1::BIGINT AS line, n AS detail, 'error' AS severity FROM f, (SELECT unnest(['title', 'layout', 'permalink']) AS n) WHERE NOT regexp_matches(b, '(?m)^' || n || ':')")
def gate_front_matter(spark, d):
    return _rows(gates.required_front_matter(markdown(spark, d)))


@query(rf"WITH {MD} SELECT slug, 1::BIGINT AS line, 'short' AS detail, 'warn' AS severity FROM md WHERE length(regexp_replace(regexp_replace(content, '(?s)^---\s*\n.*?\n---\s*\n', ''), '^\s+|\s+$', '', 'g')) < 100 UNION ALL SELECT slug, 1, 'lorem ipsum', 'error' FROM md WHERE lower(content) LIKE '%lorem ipsum%'")
def gate_content(spark, d):
    return _rows(gates.content_length(markdown(spark, d)))


@query("SELECT page_id AS slug, 1::BIGINT AS line, strlen(html)::VARCHAR AS detail, 'error' AS severity FROM pages WHERE strlen(html) > 2000")
def gate_size(spark, d):
    return _rows(gates.page_size(table(spark, d, "pages").select(F.col("page_id").alias("slug"), F.col("html").alias("content")), 2000))


def _gate_issues(spark, d):
    return gates.all_gates(md_lines(spark, d))


_GATE_ISSUES = rf"""{LINES}, gi AS (
SELECT 'gate_11_tokens' AS "check", slug, 'blocker' AS severity FROM (SELECT slug, unnest(list_distinct(regexp_extract_all(text, '__[A-Z][A-Z0-9_]*__'))) FROM lines WHERE NOT inside)
UNION ALL SELECT 'gate_12_conflicts', slug, 'blocker' FROM lines WHERE regexp_matches(text, '^(<{{7}}|={{7}}|>{{7}})')
UNION ALL SELECT 'gate_2_tone', slug, 'warn' FROM lines WHERE regexp_matches(text, '(?i)\bkinda\b'))"""


def _some_issues(spark, d):
    lines = md_lines(spark, d)
    tone = checks.tone(lines).where("detail = 'kinda'").withColumn("check", F.lit("gate_2_tone"))
    return gates.unresolved_tokens(lines).unionByName(gates.conflict_markers(lines)).unionByName(tone)


@query(f"WITH {_GATE_ISSUES}, g AS (SELECT unnest(['gate_11_tokens', 'gate_12_conflicts', 'gate_2_tone', 'gate_none']) AS \"check\") SELECT g.\"check\", count(gi.slug) AS n_issues, count(*) FILTER (gi.severity IN ('blocker', 'error')) = 0 AS ok FROM g LEFT JOIN gi ON g.\"check\" = gi.\"check\" GROUP BY 1")
def gate_roll_up(spark, d):
    return gates.roll_up(spark, _some_issues(spark, d), ["gate_11_tokens", "gate_12_conflicts", "gate_2_tone", "gate_none"])


@query(f"WITH {_GATE_ISSUES} SELECT count(*) FILTER (severity = 'blocker') AS n_blocker, count(*) FILTER (severity = 'error') AS n_error, count(*) FILTER (severity = 'warn') AS n_warn, count(*) FILTER (severity = 'info') AS n_info FROM gi")
def issue_severity_counts(spark, d):
    return gates.severity_counts(_some_issues(spark, d))


@query(f"WITH {_GATE_ISSUES}, p AS (SELECT slug, bool_or(severity IN ('blocker', 'error')) AS bad FROM gi GROUP BY 1) SELECT count(*) FILTER (NOT bad) AS pages_passed, count(*) FILTER (bad) AS pages_failed FROM p")
def pages_pass_fail(spark, d):
    return gates.pages_pass_fail(_some_issues(spark, d))


_SCORED = rf"""{LINES}, si AS (SELECT 'content_quality' AS dimension, slug, 'warn' AS severity FROM lines, (SELECT unnest(['kinda', 'sorta', 'gonna', 'wanna', 'you guys', 'awesome', 'super', 'retty']) AS p) WHERE regexp_matches(text, '(?i)\b' || p || '\b')
UNION ALL SELECT 'usability', slug, 'warn' FROM lines, (SELECT unnest(['Error:', 'Exception:', 'Warning:', 'Failed:', 'Cannot:']) AS p) WHERE regexp_matches(slug, 'troubleshoot|error|faq') AND NOT inside AND regexp_matches(text, p)),
sc AS (SELECT d.dimension, count(si.slug) AS n FROM (SELECT unnest(['content_quality', 'technical_accuracy', 'usability']) AS dimension) d LEFT JOIN si USING (dimension) GROUP BY 1),
s5 AS (SELECT dimension, CASE WHEN n = 0 THEN 5 WHEN n > 6 THEN 2 ELSE 3 END AS score FROM sc)"""


def _scored(spark, d):
    lines = md_lines(spark, d)
    return checks.tone(lines).unionByName(checks.error_messages(lines))


@query(f"WITH {_SCORED} SELECT dimension, score FROM s5")
def issue_scores(spark, d):
    return gates.dimension_scores(spark, _scored(spark, d))


@query(f"WITH {_SCORED} SELECT CASE WHEN (SELECT min(score) FROM s5) <= 2 OR w > 10 THEN 'REJECT' WHEN (SELECT bool_or(score = 3) FROM s5) OR w >= 5 THEN 'NEEDS_CHANGES' ELSE 'PASS' END AS route FROM (SELECT count(*) / greatest(1, count(DISTINCT slug)) AS w FROM si)")
def issue_route(spark, d):
    found = _scored(spark, d)
    return gates.route(gates.dimension_scores(spark, found), found)


@query()
def all_page_checks(spark, d):
    found = checks.all_checks(markdown(spark, d), _roles(spark, d), PRODUCT)
    return _rows(found.withColumn("detail", F.when(F.col("check").endswith("claim_grounding"), "x").otherwise(F.col("detail"))))  # as its own query has it


def _roles(spark, d):
    m = markdown(spark, d)
    section = F.expr("CASE doc_id % 5 WHEN 0 THEN 'products' WHEN 1 THEN 'docs' WHEN 2 THEN 'reference' WHEN 3 THEN 'kb' ELSE 'blog' END")
    return m.select("slug", links.page_role(section, F.regexp_replace("slug", "-[0-9]+$", ""), F.col("slug").startswith("index")).alias("page_role"))


_ROLE = """CASE WHEN doc_id % 8 = 1 AND doc_id % 5 = 1 THEN 'toc' WHEN doc_id % 8 = 1 AND doc_id % 5 = 0 THEN 'landing' WHEN doc_id % 5 = 1 THEN 'workflow_page'
WHEN doc_id % 5 = 3 THEN CASE doc_id % 8 WHEN 3 THEN 'landing' WHEN 2 THEN 'feature_showcase' WHEN 4 THEN 'feature_showcase' ELSE 'troubleshooting' END WHEN doc_id % 5 = 2 THEN 'api_reference' ELSE 'landing' END"""


@query(f"WITH {MD} SELECT slug, {_ROLE} AS page_role FROM md")
def page_roles(spark, d):
    return _roles(spark, d)


# ------------------------------------------------------------------------------------ links and planning


@query(rf"""WITH {LINES}, u AS (SELECT slug, line, unnest(regexp_extract_all(text, '\[[^\]]*\]\(([^)\s]+)\)', 1)) AS target FROM lines WHERE NOT inside), v AS (SELECT * FROM u WHERE NOT regexp_matches(target, '^([a-zA-Z][a-zA-Z0-9+.-]*:|//|#)') AND regexp_replace(target, '[#?].*$', '') <> ''),
k AS (SELECT DISTINCT slug, line, target FROM v) SELECT slug, line, target FROM k WHERE NOT (target = 'page.md' OR regexp_matches(target, '^\.\./page-1?[0-9]\.md$'))""")
def broken_links(spark, d):
    known = spark.range(20).select(F.concat(F.lit("../page-"), F.col("id").cast("string"), F.lit(".md")).alias("path")).union(spark.createDataFrame([("page.md",)], "path string"))
    return links.broken_links(links.relative_links(md_lines(spark, d)), known)


@query(rf"""WITH {LINES}, u AS (SELECT slug, line, unnest(regexp_extract_all(text, '\[[^\]]*\]\(([^)\s]+)\)', 1)) AS target FROM lines WHERE NOT inside), v AS (SELECT * FROM u WHERE NOT regexp_matches(target, '^([a-zA-Z][a-zA-Z0-9+.-]*:|//|#)') AND regexp_replace(target, '[#?].*$', '') <> ''),
r AS (SELECT slug, line, CASE WHEN starts_with(target, '../') THEN substr(target, 4) ELSE 'docs/' || target END AS path FROM v) SELECT path, 'docs/' || slug AS file, line FROM r WHERE NOT regexp_matches(path, '^page-1?[0-9]\.md$')""")
def phantom_links(spark, d):
    refs = links.relative_links(md_lines(spark, d)).select(F.concat(F.lit("docs/"), "slug").alias("file"), "line", "target")
    return links.phantom_paths(refs, spark.range(20).select(F.concat(F.lit("page-"), F.col("id").cast("string"), F.lit(".md")).alias("path")))


@query("SELECT 'p' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'orphan' ELSE 'missing' END AS kind FROM documents WHERE (doc_id % 7 = 0) <> (doc_id % 11 = 0)")
def plan_vs_actual(spark, d):
    p = table(spark, d, "documents").select("doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"))
    return links.plan_against_pages(p.where("doc_id % 7 <> 0"), p.where("doc_id % 11 <> 0"))


@query("SELECT source AS section, lang AS url_path, count(*) AS n_pages FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def url_collisions(spark, d):
    p = table(spark, d, "documents").select(F.col("source").alias("section"), F.col("lang").alias("url_path"), F.col("doc_id").cast("string").alias("path"))
    return links.url_collisions(p).drop("paths")


@query("SELECT doc_id % 50 AS claim_id, count(DISTINCT source) AS n_sections FROM documents WHERE source <> 'src3' GROUP BY 1 HAVING count(DISTINCT source) > 1")
def claim_reuse(spark, d):
    u = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("claim_id"), F.when(F.col("source") == "src3", "blog").otherwise(F.col("source")).alias("section"))
    return links.reused_claims(u)


_QUOTAS = """SELECT CASE doc_id % 5 WHEN 0 THEN 'products' WHEN 1 THEN 'docs' WHEN 2 THEN 'reference' WHEN 3 THEN 'kb' ELSE 'blog' END AS section, 1 + count(*) % 3 AS min_pages, count(DISTINCT source) AS max_pages, count(DISTINCT lang) AS n_mandatory"""


@query(f"""WITH q AS ({_QUOTAS} FROM documents GROUP BY 1),
v AS (SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS n_workflows, (SELECT count(*) FROM benchmark) AS n_symbols, (SELECT count(DISTINCT source) FROM documents) AS n_features, (SELECT count(*) FROM labels) AS score),
m AS (SELECT section, min_pages, greatest(min_pages, floor(max_pages * 0.7 + 1e-9)::BIGINT) AS tier_max, CASE section WHEN 'products' THEN 1 WHEN 'docs' THEN n_mandatory + n_workflows WHEN 'reference' THEN 1 + n_symbols // 3
  WHEN 'kb' THEN n_mandatory + least(n_features, 5) ELSE 1 + (score > 200)::INT END AS target FROM q, v) SELECT section, target, tier_max, greatest(min_pages, least(target, tier_max)) AS effective FROM m""")
def quotas_tier(spark, d):
    """Sections' quotas from the documents, evidence counted over the tables."""
    q = spark.sql(f"{_QUOTAS} FROM {{docs}} GROUP BY 1", docs=table(spark, d, "documents"))
    counts = {"n_workflows": ("conversations", F.count_distinct("conv_id")), "n_symbols": ("benchmark", F.count("*")), "n_features": ("documents", F.count_distinct("source")), "score": ("labels", F.count("*"))}
    rows = [table(spark, d, t).agg(n.alias(name)) for name, (t, n) in counts.items()]
    volume = rows[0]
    for one in rows[1:]:
        volume = volume.join(F.broadcast(one))  # one row each
    return links.effective_quotas(q, volume, "standard")


@query(f"WITH {MD}, r AS (SELECT slug, CASE doc_id % 5 WHEN 0 THEN 'products' WHEN 1 THEN 'docs' WHEN 2 THEN 'reference' WHEN 3 THEN 'kb' ELSE 'blog' END AS section, '/' || slug || '/' AS u FROM md), k AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY slug) AS k FROM r), t AS (SELECT section, list(u ORDER BY k) AS l FROM k WHERE k <= 2 GROUP BY 1) SELECT r.slug, array_to_string(coalesce(CASE WHEN r.section = 'blog' THEN l[:1] ELSE l END, []), ',') AS links FROM r LEFT JOIN t ON t.section = CASE r.section WHEN 'docs' THEN 'reference' WHEN 'kb' THEN 'docs' WHEN 'blog' THEN 'products' END")
def cross_links(spark, d):
    m = markdown(spark, d).select("slug", F.expr("CASE doc_id % 5 WHEN 0 THEN 'products' WHEN 1 THEN 'docs' WHEN 2 THEN 'reference' WHEN 3 THEN 'kb' ELSE 'blog' END").alias("section"), F.concat(F.lit("/"), "slug", F.lit("/")).alias("url_path"))
    return links.cross_links(m).select("slug", F.array_join("links", ",").alias("links"))


@query("SELECT source AS section, doc_id, k FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id % 3, n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 4")
def optional_pages(spark, d):
    c = table(spark, d, "documents").select(F.col("source").alias("section"), "doc_id", (F.col("doc_id") % 3).alias("priority"), F.col("n_chars").alias("quality"), F.col("doc_id").alias("slug"))
    return links.optional_pages(c, 4).select("section", "doc_id", F.col("k").cast("long").alias("k"))


# --------------------------------------------------------------------------------------- files and diffs


@query("SELECT 'd/' || doc_id AS path, CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN doc_id % 10 = 0 THEN 'unexpected' ELSE 'mismatch' END AS kind FROM documents WHERE NOT (doc_id % 9 = 0 AND doc_id % 10 = 0) AND (doc_id % 9 = 0 OR doc_id % 10 = 0 OR doc_id % 13 = 0)")
def hash_diff(spark, d):
    f = table(spark, d, "documents").select("doc_id", F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))
    now = f.withColumn("sha256", F.when(F.col("doc_id") % 13 == 0, F.lit("x")).otherwise(F.col("sha256")))
    return files.hash_diff(f.where("doc_id % 10 <> 0"), now.where("doc_id % 9 <> 0"))


_UP = ", ".join(
    f"t{k - 1} AS (SELECT substr(key, 1, CASE WHEN length(key) = {k} THEN {k - 1} ELSE length(key) END) AS key, CASE WHEN max(length(t.key)) = {k} THEN sha256(string_agg(hash, '' ORDER BY t.key)) ELSE any_value(hash) END AS hash FROM t{k} t GROUP BY 1)"
    for k in range(5, 0, -1)
)


@query(f"""WITH l AS (SELECT sha256('d/' || doc_id) AS key, sha256('d/' || doc_id || '|' || text) AS hash FROM documents),
d AS (SELECT least(5, greatest(0, ceil(ln(count(*) / 16.0) / ln(16) - 1e-12)))::INT AS d FROM l),
t5 AS (SELECT substr(l.key, 1, d) AS key, sha256(string_agg(hash, '' ORDER BY l.key)) AS hash FROM l, d GROUP BY 1), {_UP}
SELECT hash AS fingerprint, (SELECT count(*) FROM documents) AS n_files, (SELECT sum(strlen(text))::BIGINT FROM documents) AS n_bytes FROM t0""")
def tree_fingerprint(spark, d):
    f = table(spark, d, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    return files.tree_fingerprint(f)


@query("SELECT doc_id, sha256('d/' || doc_id || '|' || text) AS h FROM documents")
def file_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", files.file_hash(F.concat(F.lit("d/"), F.col("doc_id").cast("string")), F.col("text")).alias("h"))


@query("SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 5 = 0 THEN 'create' WHEN doc_id % 3 = 0 THEN 'replace' ELSE 'skip' END AS action FROM documents")
def patch_plan(spark, d):
    f = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    drafts = f.withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return files.patches(drafts, f.where("doc_id % 5 <> 0")).select("path", "action")


@query(r"""WITH l AS (SELECT doc_id, regexp_matches(text, '(?i)the') AS met, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)the'))) AS n FROM documents)
SELECT count(*) AS n_files, sum(n)::BIGINT AS added, sum(n)::BIGINT AS deleted, count(*) FILTER (2 * n > 50) AS n_over, count(*) FILTER (NOT met) AS n_form_only, count(*) <= 100 AND count(*) FILTER (2 * n > 50) = 0 AS ok FROM l""")
def diff_budget(spark, d):
    """One word replaced in all texts: the lines that hold it are the diff."""
    f = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("original"), F.regexp_replace("text", "(?i)the", "a").alias("modified"))
    return files.diff_budget(f, 100, 50)


@query("SELECT event_type AS section, 'k' AS key, 'integer' AS type, true AS required FROM events GROUP BY 1")
def schema_vote(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("section"), F.col("event_id").alias("doc"), F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return files.schema_vote(e)


@query("SELECT url, regexp_extract(url, '\\.([a-z0-9]+)$', 1) AS ext FROM pages")
def page_extensions(spark, d):
    return table(spark, d, "pages").select("url", F.regexp_extract("url", r"\.([a-z0-9]+)$", 1).alias("ext"))


@query(rf"""WITH {LINES}, n AS (SELECT *, sum(fence::INT) OVER (PARTITION BY slug ORDER BY line) AS n FROM lines), b AS (SELECT *, (n - 1) // 2 AS b FROM n WHERE n > 0 AND inside),
g AS (SELECT slug, min(line) AS line, array_to_string(list(text ORDER BY line) FILTER (NOT fence), chr(10)) AS code, arg_min(t, line) AS first, count(*) FILTER (fence) AS f FROM b GROUP BY slug, b)
SELECT slug, line, CASE WHEN length(first) > 3 THEN 'python' ELSE 'text' END AS language, md5(coalesce(code, '')) AS digest FROM g WHERE f = 2""")
def code_fences(spark, d):
    return files.fences(md_lines(spark, d)).select("slug", "line", "language", F.md5(F.encode("code", "UTF-8")).alias("digest"))


@query()
def snippet_checks(spark, d):
    f = files.fences(md_lines(spark, d))
    return f.select("slug", "line", files.snippet_quality(F.col("code")).alias("reason"), files.python_parses(F.col("code")).alias("parses"), files.closing_brace(F.col("code")).alias("brace"))


@query(r"SELECT doc_id AS id, unnest(regexp_extract_all(text, '(?i)(token\s*[=:]\s*[\"'']?[a-zA-Z0-9_\-]{20,}[\"'']?)', 1)) AS value FROM documents")
def secret_scan(spark, d):
    return files.find_secrets(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), [gates.TOKEN]).select("id", "value")


@query(r"SELECT doc_id, md5(regexp_replace(text, '(?i)token\s*[=:]\s*[\"'']?[a-zA-Z0-9_\-]{20,}[\"'']?', '[REDACTED:TOKEN]', 'g')) AS digest FROM documents")
def redact_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.encode(files.redact(F.col("text"), [gates.TOKEN]), "UTF-8")).alias("digest"))


@query(rf"WITH {MD} SELECT slug, md5(array_to_string(list_filter(string_split(content, chr(10)), lambda x: NOT regexp_matches(x, '(?i)\b(TODO|TBD|FIXME|XXX|PLACEHOLDER)\b')), chr(10))) AS digest FROM md")
def repair_placeholders(spark, d):
    fix = files.repairs(PRODUCT, REPO)["placeholder_content"]
    return markdown(spark, d).select("slug", F.md5(F.encode(fix(F.col("content")), "UTF-8")).alias("digest"))


@query(rf"WITH {MD} SELECT slug, md5(regexp_replace(content, '(?i)\[claim:\s*([a-f0-9\-]+)\]', '<!-- claim_id: \1 -->', 'g')) AS digest FROM md")
def repair_claim_markers(spark, d):
    fix = files.repairs(PRODUCT, REPO)["claim_markers"]
    return markdown(spark, d).select("slug", F.md5(F.encode(fix(F.col("content")), "UTF-8")).alias("digest"))


@query()
def repair_pages(spark, d):
    m = markdown(spark, d)
    lines = checks.lines_of(m)
    found = checks.claim_markers(lines).unionByName(checks.completeness(lines).withColumn("check", F.lit("x.placeholder_content")))
    return files.apply_repairs(m, found, PRODUCT, REPO).select("slug", F.md5(F.encode("content", "UTF-8")).alias("digest"))


@query("SELECT l.quality, l.toxic, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY 1, 2")
def label_crosstab(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
