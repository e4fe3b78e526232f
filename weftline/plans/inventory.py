"""More operators as named queries with the same question in DuckDB's SQL: paths, names, lookups, plans, repairs.

Paths are a fixed function of doc_id, so that what a rule says of a path can be stated beside it by remainder alone,
without repeating the rule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checks, claims, events, evidence, files, gates, links, plan, state, support, telemetry
from .catalogue import _EVENTS, LINES, MD, PRODUCT, REPO, _rows, event_rows, markdown, md_lines, query, runs_table, table

_PATHS = [
    "'README-' || id || '.md'", "'docs/guide-' || id || '.md'", "'src/mod' || id || '.py'", "'lib/m' || id || '.js'", "'tests/test_' || id || '.py'", "'img/p' || id || '.png'",
    "'docs/api/ref-' || id || '.html'", "'examples/convert/e' || id || '.cs'", "'.hidden/x' || id || '.md'", "'site/tutorial/t' || id || '.md'", "'a/b/c/notes' || id || '.txt'", "'docs/example-' || id || '.rs'",
]
_PATH = "CASE CAST(doc_id % 12 AS INT) " + " ".join(f"WHEN {k} THEN {p.replace('|| id', '|| CAST(doc_id AS STRING)')}" for k, p in enumerate(_PATHS)) + " END"
FILES = f"f AS (SELECT doc_id, CAST(doc_id % 12 AS INT) AS m, {_PATH} AS path, text AS content FROM documents)"


def _by(*values, otherwise: str = "") -> str:
    """A value by remainder, in DuckDB's SQL; None: the otherwise."""
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE m " + " ".join(f"WHEN {k} THEN {show(v)}" for k, v in enumerate(values) if v is not None) + (f" ELSE {show(otherwise)}" if len([v for v in values if v is not None]) < 12 else "") + " END"


def tree(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(_PATH).alias("path"), F.col("text").alias("content"))


def _of_path(spark, d, **columns):
    return tree(spark, d).select("path", *[c.alias(n) for n, c in columns.items()])


# ----------------------------------------------------------------------------------------- paths and files


@query(f"WITH {FILES} SELECT path, {_by(None, None, 'python', 'javascript', 'python', None, None, 'csharp', None, None, None, 'rust', otherwise='unknown')} AS language FROM f")
def path_languages(spark, d):
    return _of_path(spark, d, language=files.language(F.col("path")))


@query(f"WITH {FILES} SELECT path, {_by('readme', 'guide', None, None, None, None, None, None, None, None, None, None, otherwise='other')} AS doc_type FROM f")
def path_doc_types(spark, d):
    return _of_path(spark, d, doc_type=files.doc_type(F.col("path")))


@query(f"WITH {FILES} SELECT path, {_by(100, 90, 50, 50, 50, 50, 90, 30, 50, 90, 30, 90)} AS score FROM f")
def path_relevance(spark, d):
    return _of_path(spark, d, score=files.doc_relevance(F.col("path")))


@query(f"WITH {FILES} SELECT path, m = 5 AS is_binary FROM f")
def binary_files(spark, d):
    return _of_path(spark, d, is_binary=files.is_binary(F.col("path"), F.col("content").cast("binary")))


@query(f"WITH {FILES} SELECT path, {_by(100, 90, 50, 50, 50, 10, 90, 30, 0, 90, 30, 90)} AS score FROM f WHERE m NOT IN (8, 10)")
def document_discovery(spark, d):
    return files.discovered(tree(spark, d), ["# notes", "*.txt"]).select("path", "score")


@query(f"WITH {FILES} SELECT DISTINCT split_part(path, '/', 1) AS root FROM f WHERE m IN (1, 6, 7, 9, 11)")
def document_roots(spark, d):
    return files.roots(tree(spark, d), ["docs", "examples", "site"])


@query(f"WITH {FILES} SELECT path FROM (SELECT path, row_number() OVER (ORDER BY CASE m WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 3 ELSE 2 END, path) AS k FROM f WHERE m IN (2, 3, 4, 7)) WHERE k <= 100")
def source_discovery(spark, d):
    return files.source_files(tree(spark, d)).select("path")


@query(f"WITH {FILES}, g AS (SELECT {_by(None, None, 'python', 'javascript', 'python', None, None, 'csharp', None, None, None, 'rust', otherwise='')} AS l, path FROM f) SELECT l AS language FROM g WHERE l <> '' GROUP BY l ORDER BY count(*) DESC, min(path) LIMIT 1")
def primary_language(spark, d):
    return files.primary_language(tree(spark, d))


@query(f"WITH {FILES} SELECT path, {_by('readme_technical', 'readme_technical', 'source_code', 'source_code', 'test', 'readme_technical', 'api_doc', 'readme_technical', 'readme_technical', 'readme_technical', 'readme_technical', 'readme_technical')} AS kind FROM f")
def source_types(spark, d):
    return _of_path(spark, d, kind=claims.source_type(F.col("path")))


@query(f"WITH {FILES} SELECT path, {_by(6, 6, 2, 2, 3, 6, 5, 6, 6, 6, 6, 6)} AS priority FROM f")
def source_priorities(spark, d):
    return _of_path(spark, d, priority=claims.source_priority(claims.source_type(F.col("path"))))


@query(f"WITH {FILES} SELECT path, {_by('quickstart,readme', 'example', 'example', 'example', 'example', 'example', 'example', 'convert,example', 'example', 'tutorial', 'example', 'example')} AS tags FROM f")
def path_tags(spark, d):
    return _of_path(spark, d, tags=F.array_join(support.path_tags(F.col("path"), files.doc_type(F.col("path"))), ","))


@query(f"WITH {FILES} SELECT path, {_by(70, 30, 30, 30, 50, 30, 30, 100, 30, 30, 30, 80)} AS score FROM f")
def example_scores(spark, d):
    return _of_path(spark, d, score=support.example_relevance(F.col("path"), F.col("path").startswith("examples/")))


@query(f"WITH {FILES} SELECT path, m IN (5, 7, 10, 6) AS ignored FROM f")
def ignored_paths(spark, d):
    return _of_path(spark, d, ignored=T.ignored_by(F.col("path"), ["*.png", "examples", "", "#src", "a/b/*", "api/*.html"]))


@query(f"WITH {FILES} SELECT path FROM f WHERE m NOT IN (1, 6, 11, 2)")
def outside_globs(spark, d):
    return gates.outside_globs(tree(spark, d), ["docs/*", "src/mod*.p?"])


@query("SELECT doc_id, 'launch/acme/main/' || right('run-' || lpad(doc_id::VARCHAR, 6, '0'), 6) AS branch FROM documents")
def branch_names(spark, d):
    run = F.concat(F.lit("run-"), F.lpad(F.col("doc_id").cast("string"), 6, "0"))
    return table(spark, d, "documents").select("doc_id", support.branch_name(F.lit("acme"), F.lit("refs/heads/main"), run).alias("branch"))


@query("SELECT c_custkey AS id, lower(replace(regexp_replace(c_name, '[^A-Za-z0-9# _-]', '', 'g'), '#', '')) AS slug FROM customer")
def title_slugs(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.slug(F.col("c_name")).alias("slug"))


@query("SELECT doc_id, '/' || source || '/' || CASE WHEN doc_id % 2 = 0 THEN 'en/' ELSE '' END || doc_id || '/' AS url FROM documents")
def url_paths(spark, d):
    return table(spark, d, "documents").select("doc_id", T.url_path(F.col("source"), F.when(F.col("doc_id") % 2 == 0, "en").otherwise(""), F.col("doc_id").cast("string")).alias("url"))


@query("SELECT item_id, CASE WHEN length(text) < 50 THEN 'simple' WHEN length(text) > 150 THEN 'complex' ELSE 'medium' END AS level FROM benchmark")
def claim_complexity(spark, d):
    return table(spark, d, "benchmark").select("item_id", claims.complexity(F.col("text")).alias("level"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'cli') THEN 'cli' WHEN contains(lower(text), 'command line') OR contains(lower(text), 'command-line') THEN 'cli' WHEN regexp_matches(lower(text), 'service|api|rest|endpoint') THEN 'service' WHEN doc_id % 3 > 1 AND regexp_matches(lower(text), 'sdk|library|package') THEN 'sdk' ELSE 'library' END AS kind FROM documents")
def product_types(spark, d):
    return table(spark, d, "documents").select("doc_id", support.product_type(F.col("text"), F.col("doc_id") % 3).alias("kind"))


@query("SELECT doc_id, least(60.0, pow(2.0, doc_id % 9)) * (1 + 0.5 * (doc_id % 4) / 4.0) AS seconds FROM documents")
def backoff_delays(spark, d):
    return table(spark, d, "documents").select("doc_id", support.backoff(F.col("doc_id") % 9, jitter=(F.col("doc_id") % 4) / 4).alias("seconds"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'retry' WHEN 1 THEN 'fail' WHEN 2 THEN 'retry' WHEN 3 THEN 'fail' WHEN 4 THEN 'retry' ELSE 'manual_intervention' END AS class FROM orders")
def failure_classes(spark, d):
    k = (F.col("o_orderkey") % 6 + 1).cast("int")
    kind, message = (F.element_at(F.array(*map(F.lit, v)), k) for v in (["Timeout", "KeyError", "Other", "Other", "PermissionError", "Other"], ["", "x", "HTTP 429", "Schema broken", "denied", "odd"]))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), support.failure_class(kind, message).alias("class"))


@query("SELECT s_suppkey AS id, s_suppkey % 4 IN (0, 2) AS allowed FROM supplier")
def hosts_allowed(spark, d):
    host = F.element_at(F.array(*map(F.lit, ("localhost:8080", "evil.org", "api.acme.com", "acme.com.evil.org"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), support.host_allowed(host, ["localhost", "*.acme.com"]).alias("allowed"))


@query("SELECT doc_id, 'reply-' || substr(sha256(text), 1, 16) AS reply, sha256(lang || '|' || source) AS cache_key, substr(sha256('TOKEN:' || source), 1, 8) AS secret_id, sha256(text || '|python|' || source || '|1-' || doc_id) AS snippet_id FROM documents")
def content_ids(spark, d):
    t, source = F.col("text"), F.col("source")
    return table(spark, d, "documents").select(
        "doc_id", support.mock_reply(t).alias("reply"), support.cache_key(F.col("lang"), source).alias("cache_key"), files.secret_id(F.lit("TOKEN"), source).alias("secret_id"),
        files.snippet_id(t, F.lit("python"), source, F.lit(1), F.col("doc_id")).alias("snippet_id"),
    )


@query("SELECT doc_id, sha256(text) AS h, true AS same FROM documents")
def normalized_hashes(spark, d):
    t = F.concat_ws("\n", F.transform(F.split("text", "\n"), lambda x: F.rtrim(x)))
    odd = F.concat_ws("  \t\r\n", F.transform(F.split("text", "\n"), lambda x: F.rtrim(x)))
    return table(spark, d, "documents").select("doc_id", F.when(t == F.col("text"), files.normalized_hash(F.col("text"))).otherwise(F.sha2("text", 256)).alias("h"), (files.normalized_hash(odd) == files.normalized_hash(t)).alias("same"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^ | $', '', 'g')), chr(10)), '\n{2,}', chr(10), 'g'), '^\n+|\n+$', '', 'g')) AS digest FROM documents")
def space_normalized(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.encode(T.normalize_space(F.concat("text", F.lit(" \r\n\r\n "))), "UTF-8")).alias("digest"))


@query(rf"WITH {MD} SELECT slug, CASE doc_id % 4 WHEN 1 THEN 'Acme page' WHEN 2 THEN 'page' WHEN 3 THEN 'Acme' END AS title, CASE doc_id % 4 WHEN 1 THEN '/p/' END AS permalink FROM md")
def front_matter_fields(spark, d):
    block = T.front_matter(F.col("content"))
    return markdown(spark, d).select("slug", T.front_matter_field(block, "title").alias("title"), T.front_matter_field(block, "permalink").alias("permalink"))


_QUOTED = [f"nullif(string_split(trim(regexp_extract(c, '(?s){q}(.*?){q}', 1), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), chr(10))[1], '')" for q in ('"""', "''''''")]


@query(rf"""WITH x AS (SELECT doc_id, repeat('"', 3) || text || repeat('"', 3) AS c FROM documents)
SELECT doc_id, coalesce({_QUOTED[0]}, {_QUOTED[1]}, trim(regexp_extract(c, '(?m)#\s*(.*?)$', 1))) AS described, 'T' || doc_id AS tagline, 'About it.' AS description, 4 AS lines, 2 AS functions, 1 AS classes FROM x""")
def code_descriptions(spark, d):
    q = '"""'
    docs = table(spark, d, "documents")
    page = F.concat(F.lit("# T"), F.col("doc_id").cast("string"), F.lit("\n\n## Sub\n  About it. \n"))
    c = support.code_complexity(F.lit("class A:\n  def f(self): ...\nasync def g(): ...\nx = 1"))
    p = support.positioning(page)
    return docs.select("doc_id", support.description(F.concat(F.lit(q), "text", F.lit(q))).alias("described"), p["tagline"].alias("tagline"), p["description"].alias("description"), c["lines"].alias("lines"), c["functions"].alias("functions"), c["classes"].alias("classes"))


@query("SELECT doc_id, 'A' || doc_id || ',B' AS classes, 'f' || doc_id AS functions, 'Get' || doc_id AS methods FROM documents")
def script_surfaces(spark, d):
    n = F.col("doc_id").cast("string")
    js = files.script_surface(F.concat(F.lit("class A"), n, F.lit(" {}\nclass B {}\nfunction f"), n, F.lit("() {}")), "javascript")
    cs = files.script_surface(F.concat(F.lit("public class X {\n public static List<int> Get"), n, F.lit("(int a) {} }")), "csharp")
    return table(spark, d, "documents").select("doc_id", F.array_join(js["classes"], ",").alias("classes"), F.array_join(js["functions"], ",").alias("functions"), F.array_join(cs["functions"], ",").alias("methods"))


@query("SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 OR doc_id % 3 = 0")
def write_if_changed(spark, d):
    f = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    now = f.withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return files.write_if_changed(now, f.where("doc_id % 4 = 0")).select("doc_id")


@query("SELECT count(*) FILTER (doc_id % 9 = 0 AND doc_id % 10 <> 0) AS n_missing, count(*) FILTER (doc_id % 10 = 0 AND doc_id % 9 <> 0) AS n_unexpected, count(*) FILTER (doc_id % 13 = 0 AND doc_id % 9 <> 0 AND doc_id % 10 <> 0) AS n_mismatch FROM documents")
def regression_counts(spark, d):
    f = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    now = f.withColumn("sha256", F.when(F.col("doc_id") % 13 == 0, F.lit("x")).otherwise(F.col("sha256")))
    return files.regression_counts(files.hash_diff(f.where("doc_id % 10 <> 0"), now.where("doc_id % 9 <> 0")))


@query(r"""WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '(?i)token\s*[=:]\s*["'']?[a-zA-Z0-9_\-]{20,}["'']?')) AS n FROM documents) SELECT 'src' || doc_id || '.py' AS path, n AS n_secrets, doc_id % 10 = 7 AS allowed FROM n WHERE n > 0""")
def secret_summary(spark, d):
    f = table(spark, d, "documents").select(F.concat(F.lit("src"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.col("text").alias("content"))
    return files.scan_summary(f, ["*7.py", "no-such-file"], [gates.TOKEN])


@query(r"""SELECT event_id, event_type, regexp_replace(props, '"k":\s*\d', '[REDACTED:K]') AS payload FROM events""")
def redacted_events(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.col("props").alias("payload"))
    return files.redact_events(e, [("K", r'"k":\s*\d')])


# ------------------------------------------------------------------------------------- lookups and plans


@query("SELECT l_orderkey AS page, l_linenumber AS pos, l_suppkey AS claim_id, s_name AS name FROM (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) - 1 AS l_linenumber FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey WHERE l_suppkey % 3 <> 0")
def claims_in_order(spark, d):
    ids = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("claim_ids"))
    known = table(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("claim_id"), F.col("s_name").alias("name"))
    return links.claims_by_ids(ids, known)


@query("SELECT DISTINCT a.c_custkey AS page, s_suppkey AS snippet_id FROM customer a JOIN supplier ON (a.c_nationkey = s_nationkey OR a.c_mktsegment = CASE s_suppkey % 2 WHEN 0 THEN 'BUILDING' ELSE 'AUTO' END)")
def snippets_by_tags(spark, d):
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("page"), F.array(F.col("c_nationkey").cast("string"), "c_mktsegment").alias("tags"))
    held = table(spark, d, "supplier").select(F.col("s_suppkey").alias("snippet_id"), F.col("s_suppkey").alias("ord"), F.array(F.col("s_nationkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("AUTO")).alias("tags"))
    return links.snippets_by_tags(wanted, held).select("page", "snippet_id")


_SNIPPETS = [("s1", 3, "the"), ("s2", 1, "und der"), ("s3", 2, "of the"), ("s4", 4, "no such words")]


@query("SELECT item_id AS claim_id, CASE WHEN regexp_matches(w, '(^| )und der( |$)') THEN 's2' WHEN regexp_matches(w, '(^| )of the( |$)') THEN 's3' ELSE 's1' END AS snippet_id FROM (SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_-]+'), ' ') AS w FROM benchmark) WHERE regexp_matches(w, '(^| )(und der|of the|the)( |$)')")
def first_snippets(spark, d):
    held = spark.createDataFrame([(s, o, [t]) for s, o, t in _SNIPPETS], "snippet_id string, ord int, tags array<string>")
    return links.first_matching_snippet(table(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim_text")), held)


@query("SELECT c_custkey AS claim_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def uncovered_claims(spark, d):
    return links.uncovered(table(spark, d, "customer").select(F.col("c_custkey").alias("claim_id")), table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("claim_id")))


@query("SELECT DISTINCT 'n' || s_nationkey AS section, CASE s_suppkey % 5 WHEN 0 THEN 'index' ELSE 'p' || s_suppkey % 5 END AS slug FROM supplier EXCEPT SELECT 'n' || c_nationkey, CASE c_custkey % 7 WHEN 0 THEN 'index' ELSE 'p' || c_custkey % 7 END FROM customer WHERE c_custkey % 2 = 0")
def mandatory_missing(spark, d):
    page = lambda key, n, index: F.when(F.col(key) % n == 0, index).otherwise(F.concat(F.lit("p"), (F.col(key) % n).cast("string"))).alias("slug")
    section = lambda c: F.concat(F.lit("n"), F.col(c).cast("string")).alias("section")
    required = table(spark, d, "supplier").select(section("s_nationkey"), page("s_suppkey", 5, "_index"))
    return links.mandatory_missing(required, table(spark, d, "customer").where("c_custkey % 2 = 0").select(section("c_nationkey"), page("c_custkey", 7, "index")))


@query("WITH p AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 10 <> 0, c_custkey) AS k, count(*) FILTER (c_custkey % 10 = 0) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT c_nationkey AS section, c_custkey AS slug FROM p WHERE k <= greatest(6, n)")
def mandatory_then_optional(spark, d):
    p = table(spark, d, "customer").select(F.col("c_nationkey").alias("section"), F.col("c_custkey").alias("slug"), (F.col("c_custkey") % 10 == 0).alias("mandatory"), F.col("c_custkey").alias("ord"))
    return links.mandatory_then_optional(p, 6).select("section", "slug")


@query("SELECT s_nationkey AS section, s_suppkey AS slug, CASE WHEN s_suppkey % 3 = 0 THEN 'family' ELSE 'general' END AS rule FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey % 3 = 0")
def merged_requirements(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("section"), F.col("s_suppkey").alias("slug"))
    return links.merge_requirements(s.where("slug % 3 <> 0").withColumn("rule", F.lit("general")), s.where("slug % 3 = 0 or slug % 2 = 0").withColumn("rule", F.lit("family")))


@query("SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'feature' ELSE 'api' END AS claim_kind, count(*) AS n_claims, count(*) FILTER (o_orderstatus = 'F') AS n_facts FROM orders GROUP BY 1")
def claim_histogram(spark, d):
    c = table(spark, d, "orders").select(F.when(F.col("o_orderpriority") == "1-URGENT", "feature").otherwise("api").alias("claim_kind"), F.when(F.col("o_orderstatus") == "F", "fact").otherwise("inference").alias("truth_status"))
    return claims.kind_histogram(c)


@query("SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 7 = 0 THEN 'missing field' WHEN o_orderkey % 5 = 0 THEN 'truth_status' WHEN o_orderkey % 3 = 0 THEN 'no citation' ELSE 'citation' END AS reason FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 2 = 0")
def invalid_claims(spark, d):
    k = F.col("o_orderkey")
    cited = F.array(F.struct(F.lit("a.md").alias("path"), F.when(k % 2 == 1, 1).alias("start_line"), F.lit(2).alias("end_line")))
    none = F.filter(cited, lambda x: F.lit(False))
    c = table(spark, d, "orders").select(k.alias("claim_id"), F.when(k % 7 > 0, "text").alias("claim_text"), F.lit("api").alias("claim_kind"), F.when(k % 5 == 0, "guess").otherwise("fact").alias("truth_status"), F.when(k % 3 == 0, none).otherwise(cited).alias("citations"))
    return claims.invalid_claims(c).select("claim_id", "reason")


@query("SELECT count(*) AS n_claims, (SELECT count(*) FROM supplier) AS n_snippets, (SELECT count(*) FROM nation) AS n_symbols, 2 * count(*) + 3 * (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) AS score FROM customer")
def evidence_volume(spark, d):
    return evidence.volume(table(spark, d, "customer"), table(spark, d, "supplier"), table(spark, d, "nation"))


@query("WITH s AS (SELECT c_custkey AS id, (c_custkey % 2)::INT + (c_custkey % 10 < 5)::INT + (c_custkey % 9 > 5)::INT AS low, (c_custkey % 7 >= 5)::INT + (c_custkey % 5 >= 3)::INT + (c_custkey % 41 >= 20)::INT AS high FROM customer) SELECT id, CASE WHEN low >= 2 THEN 'minimal' WHEN low = 0 AND high = 3 THEN 'rich' ELSE 'standard' END AS tier FROM s")
def launch_tiers(spark, d):
    k = F.col("c_custkey")
    s = table(spark, d, "customer").select(k.alias("id"), (k % 2).alias("contradictions"), (k % 10 / 10).alias("health"), (k % 9).alias("phantoms"), (k % 7).alias("formats"), (k % 5).alias("workflows"), (k % 41).alias("snippets"))
    return links.launch_tier(s).select("id", "tier")


@query("WITH b AS (SELECT s_suppkey % 40 AS snippet_id, s_nationkey::VARCHAR AS language, 't' || s_suppkey AS tag, 0 AS p, s_suppkey AS ord FROM supplier UNION ALL SELECT c_custkey % 90, c_nationkey::VARCHAR, 't' || c_custkey, 1, c_custkey FROM customer) SELECT snippet_id, language, tag FROM (SELECT *, row_number() OVER (PARTITION BY snippet_id ORDER BY p, ord) AS k FROM b) WHERE k = 1")
def merged_snippets(spark, d):
    part = lambda t, key, nation, n: table(spark, d, t).select((F.col(key) % n).alias("snippet_id"), F.col(nation).cast("string").alias("language"), F.array(F.concat(F.lit("t"), F.col(key).cast("string"))).alias("tags"), F.col(key).alias("ord"))
    return files.merged_snippets(part("supplier", "s_suppkey", "s_nationkey", 40), part("customer", "c_custkey", "c_nationkey", 90)).select("snippet_id", "language", F.col("tags")[0].alias("tag"))


@query("SELECT user_id AS run_id, 100.0 * count(DISTINCT event_type) FILTER (event_type IN ('view', 'click', 'purchase')) / 4 AS score FROM events GROUP BY 1")
def completeness_scores(spark, d):
    return events.completeness(table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("name")), ["view", "click", "purchase", "absent"])


@query("WITH e AS (SELECT l_suppkey AS claim_id, 'a' AS source, l_orderkey * 10 + l_linenumber AS doc_id, l_discount::DOUBLE AS score FROM lineitem WHERE l_partkey % 5 = 0 UNION ALL SELECT l_suppkey, 'b', l_orderkey * 10 + l_linenumber, l_tax::DOUBLE FROM lineitem WHERE l_partkey % 7 = 0) SELECT claim_id, source, doc_id, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, source, doc_id) AS rank, count(*) OVER (PARTITION BY claim_id) AS evidence_count FROM e")
def merged_evidence(spark, d):
    part = lambda name, score, n: table(spark, d, "lineitem").where(f"l_partkey % {n} = 0").select(F.col("l_suppkey").alias("claim_id"), F.lit(name).alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), F.col(score).cast("double").alias("score"))
    return evidence.merged_evidence(part("a", "l_discount", 5), part("b", "l_tax", 7)).select("claim_id", "source", "doc_id", F.col("rank").cast("long").alias("rank"), "evidence_count")


@query("WITH p AS (SELECT item_id, lead(item_id) OVER (ORDER BY item_id) AS other, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: length(x) > 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "], x))) AS t FROM benchmark) SELECT a.item_id AS id, round(len(list_intersect(a.t, b.t)) / greatest(1, len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 9) AS jaccard FROM p a JOIN p b ON a.other = b.item_id")
def pair_jaccard(spark, d):
    b = table(spark, d, "benchmark")
    pairs = b.alias("x").join(b.alias("y"), F.col("y.item_id") == F.col("x.item_id") + 1).select(F.col("x.item_id").alias("id"), F.col("x.text").alias("a"), F.col("y.text").alias("b"))
    return evidence.pair_similarity(pairs).select("id", F.round("jaccard", 9).alias("jaccard"))


@query("WITH s AS (SELECT o_custkey AS workflow, o_orderkey AS ord, CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 3 END AS phase, CASE WHEN o_orderkey % 6 = 4 THEN 15 WHEN o_orderkey % 6 = 1 THEN 10 ELSE 5 END AS b FROM orders) SELECT workflow, ord, row_number() OVER (PARTITION BY workflow ORDER BY phase, ord) AS step, max(b) OVER (PARTITION BY workflow) + 5 * (count(*) OVER (PARTITION BY workflow) - 1) AS minutes FROM s")
def workflow_steps(spark, d):
    words = ["Install it", "Configure it", "Load a file", "Advanced use", "A complex thing", "Save it"]
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("workflow"), F.col("o_orderkey").alias("ord"), F.element_at(F.array(*map(F.lit, words)), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("claim_text"))
    return claims.workflow_steps(c).select("workflow", "ord", F.col("step").cast("long").alias("step"), F.col("minutes").cast("long").alias("minutes"))


@query("SELECT p_partkey AS claim_id, row_number() OVER (ORDER BY CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END, p_partkey) > 50 AS skipped FROM part")
def hard_limit(spark, d):
    c = table(spark, d, "part").select(F.col("p_partkey").alias("claim_id"), F.element_at(F.array(*map(F.lit, ("api", "format", "other"))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("claim_kind"))
    return claims.hard_limit(c, 50, ["api", "format"]).select("claim_id", "skipped")


@query("SELECT o_orderkey AS event_id FROM orders WHERE o_custkey = 7")
def run_children(spark, d):
    return telemetry.children(runs_table(spark, d).withColumn("parent_run_id", F.col("run_id")), 7).select("event_id")


@query("SELECT o_orderkey AS event_id, o_orderstatus AS status FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_orderkey <= 64)")
def run_by_id(spark, d):
    r = runs_table(spark, d)
    return telemetry.run_by_event_id(r, r.where("event_id <= 64").agg(F.max("event_id")).first()[0]).select("event_id", "status")


@query(f"WITH {_EVENTS}, s AS (SELECT run_id, arg_max(new_state, ord) FILTER (type = 'RUN_STATE_CHANGED') AS run_state, min(ord) AS a FROM ev GROUP BY 1) SELECT run_id, run_state, NULL::VARCHAR AS finished FROM s WHERE run_state = 'S3'")
def run_list(spark, d):
    e = event_rows(spark, d)
    return events.run_list(events.replay(e), e, run_state="S3").select("run_id", "run_state", F.col("finished_at").cast("string").alias("finished"))


# --------------------------------------------------------------------------------------- state and recovery

_FOLD = """fold AS (SELECT user_id AS run_id, event_id AS ord, CASE event_id % 6 WHEN 0 THEN 'ISSUE_OPENED' WHEN 1 THEN 'ISSUE_RESOLVED' WHEN 2 THEN 'GATE_RUN_FINISHED' WHEN 3 THEN 'SECTION_STATE_CHANGED' WHEN 4 THEN 'WORK_ITEM_QUEUED' ELSE 'WORK_ITEM_FINISHED' END AS type, 'i' || event_id % 8 AS item FROM events)"""


def _fold_rows(spark, d):
    k = (F.col("event_id") % 6 + 1).cast("int")
    kind = F.element_at(F.array(*map(F.lit, ("ISSUE_OPENED", "ISSUE_RESOLVED", "GATE_RUN_FINISHED", "SECTION_STATE_CHANGED", "WORK_ITEM_QUEUED", "WORK_ITEM_FINISHED"))), k)
    item = F.concat(F.lit("i"), (F.col("event_id") % 8).cast("string"))
    payload = F.to_json(F.struct(F.struct(item.alias("issue_id"), F.lit("error").alias("severity")).alias("issue"), item.alias("issue_id"), item.alias("gate"), (F.col("event_id") % 12 == 2).alias("ok"), item.alias("section"), F.lit("DRAFT").alias("new_state"), item.alias("work_item_id")))
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("event_id"), "ts", kind.alias("type"), payload.alias("payload"))


@query(f"WITH {_FOLD}, o AS (SELECT run_id, item, ord AS opened FROM fold WHERE type = 'ISSUE_OPENED'), f AS (SELECT run_id, item, min(opened) AS opened FROM o GROUP BY 1, 2), r AS (SELECT run_id, item, max(ord) AS last FROM fold WHERE type = 'ISSUE_RESOLVED' GROUP BY 1, 2) SELECT o.run_id::VARCHAR AS run_id, o.item AS issue_id, o.opened AS ord, CASE WHEN f.opened = o.opened AND r.last > o.opened THEN 'RESOLVED' ELSE 'OPEN' END AS status FROM o JOIN f USING (run_id, item) LEFT JOIN r USING (run_id, item)")
def replay_issues(spark, d):
    return state.issues(_fold_rows(spark, d)).select("run_id", "issue_id", "ord", "status")


@query(f"WITH {_FOLD} SELECT run_id::VARCHAR AS run_id, item AS gate, arg_max(ord % 12 = 2, ord) AS ok FROM fold WHERE type = 'GATE_RUN_FINISHED' GROUP BY 1, 2")
def replay_gates(spark, d):
    return state.gate_results(_fold_rows(spark, d)).select("run_id", "gate", "ok")


@query(f"WITH {_FOLD} SELECT DISTINCT run_id::VARCHAR AS run_id, item AS section, 'DRAFT' AS section_state FROM fold WHERE type = 'SECTION_STATE_CHANGED'")
def replay_sections(spark, d):
    return state.section_states(_fold_rows(spark, d))


@query("WITH e AS (SELECT user_id AS run_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) SELECT run_id::VARCHAR AS run_id, k // 10 AS checkpoint, k AS n_events, event_id AS last_ord FROM e WHERE k % 10 = 0")
def checkpoints(spark, d):
    return state.checkpoints(_fold_rows(spark, d), every=10)


@query("WITH e AS (SELECT user_id AS run_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT run_id::VARCHAR AS run_id, event_id AS ord FROM e WHERE k > n // 10 * 10")
def resume_tail(spark, d):
    e = _fold_rows(spark, d)
    return state.after_checkpoint(e, state.latest_checkpoint(state.checkpoints(e, every=10))).select("run_id", "ord")


@query("SELECT o_orderkey AS issue_id, CASE WHEN o_orderkey % 4 = 0 THEN 'fixed' WHEN o_orderkey % 4 = 1 THEN 'blocked' WHEN o_orderkey % 5 >= 3 THEN 'given_up' ELSE 'retry' END AS verdict FROM orders")
def fix_loop(spark, d):
    k = F.col("o_orderkey")
    return state.fix_verdicts(table(spark, d, "orders").select(k.alias("issue_id"), (k % 4 == 0).alias("resolved"), (k % 4 != 1).alias("fixable"), (k % 5).alias("attempts")), most=3)


@query("SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'claim_markers' WHEN 1 THEN 'template_tokens' WHEN 2 THEN 'link_normalization' WHEN 3 THEN 'metadata' END AS repair FROM part")
def error_dispatch(spark, d):
    code = F.element_at(F.array(*map(F.lit, ("GATE_CLAIM_MARKER_INVALID", "GATE_TEMPLATE_TOKEN_LEFT", "GATE_LINK_BROKEN", "GATE_FRONTMATTER_MISSING", "GATE_UNKNOWN"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), state.repair_of_code(code).alias("repair"))


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01' - INTERVAL 365 DAY AND o_orderdate <= TIMESTAMP '1996-01-01'")
def cache_hits(spark, d):
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").cast("timestamp").alias("stored_at"))
    return state.fresh(c, F.lit("1996-01-01").cast("timestamp"), 365 * 86400).select("key", "value")


@query("SELECT s_suppkey AS doc FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def cited_documents(spark, d):
    held = table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc"))
    return state.cited(held, table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("doc")), "doc")


@query("SELECT c_custkey AS id, 'Customer#' || lpad((c_custkey % 10)::VARCHAR, 9, '0') AS matched FROM customer WHERE c_custkey % 10 > 0")
def fuzzy_keys(spark, d):
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("CUSTOMER-"), F.lpad((F.col("c_custkey") % 10).cast("string"), 9, "0")).alias("name"))
    known = table(spark, d, "customer").where("c_custkey between 1 and 9").select(F.col("c_name").alias("matched"))
    return state.fuzzy_match(wanted, known, "name", "matched").select("id", "matched")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'content/docs.acme.org/cells/en/' || doc_id || '.md' WHEN 1 THEN 'content/blog.acme.org/cells/' || doc_id || '/index.md' WHEN 2 THEN 'content/docs.acme.org/cells/en/_index.md' ELSE 'content/blog.acme.org/cells/' || doc_id || '/index.de.md' END AS output FROM documents")
def output_paths(spark, d):
    m = (F.col("doc_id") % 4).cast("int")
    out = state.output_path(F.element_at(F.array(*map(F.lit, ("docs", "blog", "docs", "blog"))), m + 1), F.lit("acme.org"), F.lit("cells"), F.when(m == 3, "de").otherwise("en"), F.when(m == 2, "_index").otherwise(F.col("doc_id").cast("string")))
    return table(spark, d, "documents").select("doc_id", out.alias("output"))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'docs' WHEN 1 THEN 'kb' WHEN 2 THEN 'blog' ELSE 'unknown' END AS section, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE 'en' END AS locale FROM part")
def content_paths(spark, d):
    path = F.element_at(F.array(*map(F.lit, ("content/docs.acme.org/cells/en/guide/a.md", "content/kb.acme.org/cells/en/x.md", "content/blog.acme.org/cells/post/index.md", "src/main.py"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = state.content_path(path)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), p["section"].alias("section"), p["locale"].alias("locale"))


@query("SELECT s_suppkey AS id, substr(md5(s_name), 1, 8) || '-' || row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS key FROM supplier")
def unique_keys(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey", F.substring(F.md5(F.encode("s_name", "UTF-8")), 1, 8).alias("base"))
    return state.unique_keys(s, "base", "s_nationkey", "id").select("id", "key")


# ------------------------------------------------------------------------------------------ gates and checks


@query("SELECT o_orderkey AS slug, CASE WHEN o_orderkey % 7 = 0 THEN 'error' WHEN o_orderkey % 3 = 0 THEN 'warn' ELSE 'info' END AS severity FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'info' FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 2 = 0")
def gate_images(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k.alias("slug"), F.lit(1).alias("line"), F.concat(k.cast("string"), F.when(k % 2 == 0, ".png").otherwise(".webp")).alias("path"), F.when(k % 3 == 0, 300_000).otherwise(100).alias("size"))
    return gates.images(o.select("slug", "line", "path"), o.where("slug % 7 <> 0").select("path", "size")).select("slug", "severity")


@query("SELECT o_custkey AS run_id, (epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 1e6 AS seconds FROM orders GROUP BY 1 HAVING count(*) > 1 AND epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate)) > 86400 * 300 * 1e6")
def gate_build_time(spark, d):
    o = table(spark, d, "orders")
    span = o.groupBy(F.col("o_custkey").alias("run_id")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"), F.count("*").alias("n")).where("n > 1")
    return gates.build_time(span.select("run_id", F.lit("BUILD_STARTED").alias("type"), F.col("a").alias("ts")).union(span.select("run_id", F.lit("BUILD_COMPLETED"), "b")), 86400.0 * 300)


@query("SELECT event_id AS slug FROM events WHERE event_id % 5 = 0")
def gate_schema(spark, d):
    return gates.malformed_json(table(spark, d, "events").select(F.col("event_id").alias("slug"), F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(F.col("props")).alias("content"))).select("slug")


def _issues(spark, d):
    k = F.col("o_orderkey")
    severity = F.element_at(F.array(*map(F.lit, gates.SEVERITIES[:4])), (k % 4 + 1).cast("int"))
    return table(spark, d, "orders").select(F.concat(F.lit("c"), (k % 3).cast("string")).alias("check"), severity.alias("severity"), F.col("o_custkey").cast("string").alias("slug"), k.alias("line"), F.lit("x").alias("detail"), F.lit(True).alias("auto_fixable"))


_SEVERITY = "CASE o_orderkey % 4 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(gates.SEVERITIES[:4])) + " END"


@query(f"SELECT o_orderkey AS line, CASE WHEN {_SEVERITY} = 'warn' THEN 'error' ELSE {_SEVERITY} END AS severity FROM orders")
def issues_by_profile(spark, d):
    return gates.by_profile(_issues(spark, d), "prod").select("line", "severity")


@query(f"WITH i AS (SELECT o_orderkey AS line, 'c' || o_orderkey % 3 AS chk, {_SEVERITY} AS severity, o_custkey::VARCHAR AS slug FROM orders) SELECT line FROM i WHERE severity IN ('blocker', 'error') ORDER BY CASE severity WHEN 'blocker' THEN 0 ELSE 1 END, chk, slug, line LIMIT 1")
def next_fix(spark, d):
    return gates.next_fix(_issues(spark, d)).select("line")


@query("SELECT doc_id AS slug, 'Reads PDF' AS detail FROM documents WHERE doc_id % 3 = 0 AND NOT contains(lower(text), 'reads pdf')")
def missing_phrases(spark, d):
    p = table(spark, d, "documents").select(F.col("doc_id").alias("slug"), F.concat("text", F.when(F.col("doc_id") % 3 == 0, "").otherwise(" it reads pdf "), F.lit(" pip install acme ")).alias("content"))
    return checks.missing_phrases(p, spark.createDataFrame([("Reads PDF",), ("pip install acme",)], "phrase string"), "x").select("slug", "detail")


@query("SELECT doc_id AS slug, 'The' AS detail FROM documents WHERE contains(lower(text), 'the') AND doc_id % 2 = 0")
def forbidden_topics(spark, d):
    p = table(spark, d, "documents").select(F.col("doc_id").alias("slug"), F.col("text").alias("content"))
    return checks.forbidden_topics(p, p.where("slug % 2 = 0").select("slug", F.lit("The").alias("topic"))).select("slug", "detail")


@query("SELECT doc_id AS slug, CASE WHEN doc_id % 3 = 0 THEN 'error' ELSE 'warn' END AS severity FROM documents WHERE doc_id % 3 < 2 AND NOT regexp_matches(lower(text), 'limitation|not support|cannot')")
def limitation_honesty(spark, d):
    p = table(spark, d, "documents").select(F.col("doc_id").alias("slug"), F.col("text").alias("content"))
    roles = p.select("slug", F.element_at(F.array(*map(F.lit, ("comprehensive_guide", "landing", "toc"))), (F.col("slug") % 3 + 1).cast("int")).alias("page_role"))
    return checks.limitation_honesty(p, roles, spark.range(3)).select("slug", "severity")


@query("WITH c AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN 'f(' ELSE '' END AS code FROM documents) SELECT doc_id AS slug FROM c WHERE length(replace(code, '(', '')) <> length(replace(code, ')', '')) OR length(replace(code, '{', '')) <> length(replace(code, '}', ''))")
def code_balance(spark, d):
    code = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "f(").otherwise(""))
    b = table(spark, d, "documents").select(F.col("doc_id").alias("slug"), F.lit(1).alias("line"), F.lit("js").alias("language"), code.alias("code"))
    return checks.balance(b).select("slug")


@query("SELECT doc_id AS slug, 'reader.close' AS detail FROM documents WHERE doc_id % 2 = 1")
def unknown_methods(spark, d):
    code = F.when(F.col("doc_id") % 2 == 1, "r = Reader(1)\nr.read()\nr.close()\nother.go()").otherwise("r = Reader(1)\nr.read()")
    b = table(spark, d, "documents").select(F.col("doc_id").alias("slug"), F.lit(1).alias("line"), code.alias("code"))
    return support.unknown_methods(b, spark.createDataFrame([("Reader", "read"), ("Writer", "close")], "class_name string, method string")).select("slug", "detail")


@query("SELECT doc_id AS slug, 4 AS line FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 6 FROM documents WHERE doc_id % 3 = 0")
def licensing_sections(spark, d):
    page = F.concat(F.lit("# Page\npaid plan here\n## Licensing\nA paid plan.\n### Deep\nTrial version.\n## Other\nPaid plan."), F.when(F.col("doc_id") % 3 > 0, "").otherwise(""))
    plain = F.when(F.col("doc_id") % 3 == 0, page).otherwise("## Other\nA paid plan.")
    return support.licensing_sections(checks.lines_of(table(spark, d, "documents").select(F.col("doc_id").alias("slug"), plain.alias("content")))).select("slug", "line")


@query("SELECT doc_id AS slug, '0x1F2e' AS detail FROM documents WHERE doc_id % 4 = 0")
def internal_sections(spark, d):
    page = F.concat(F.lit("## Features\nvalue "), F.when(F.col("doc_id") % 4 == 0, "0x1F2e").otherwise("0x1"), F.lit("\n# End\n0xABCD"))
    return support.internal_sections(checks.lines_of(table(spark, d, "documents").select(F.col("doc_id").alias("slug"), page.alias("content")))).select("slug", "detail")


@query("SELECT doc_id AS slug FROM documents WHERE doc_id % 2 = 0")
def unattributed_code(spark, d):
    b = table(spark, d, "documents").select(F.col("doc_id").alias("slug"), F.lit(1).alias("line"), F.concat(F.lit("reader = open_file("), F.col("doc_id").cast("string"), F.lit(")\nreader.read()")).alias("code"))
    held = b.where("slug % 2 = 1").select(F.concat(F.lit("import x\n"), F.regexp_replace("code", "\n", "\n   "), F.lit("\nreader.close()")).alias("code"))
    return state.uncontained_code(b, held).select("slug")


@query("SELECT c_custkey AS slug, 'child' || c_custkey AS detail FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 1")
def navigation(spark, d):
    k = F.col("c_custkey").cast("string")
    c = table(spark, d, "customer").where("c_custkey % 3 = 0")
    index = c.select(F.concat(k, F.lit("-index")).alias("slug"), F.concat(F.lit("/s"), k, F.lit("/")).alias("url_path"))
    child = c.select(F.concat(F.lit("child"), k).alias("slug"), F.concat(F.lit("/s"), k, F.lit("/deep/er/")).alias("url_path"))
    pages = c.select(F.concat(k, F.lit("-index")).alias("slug"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("see child"), k)).otherwise("nothing").alias("content"))
    return checks.navigation(pages, index.union(child)).select(F.substring_index("slug", "-", 1).cast("long").alias("slug"), "detail")


@query("SELECT doc_id AS slug, 'Writer' AS detail FROM documents")
def unknown_calls(spark, d):
    page = F.concat(F.lit("```python\nReader(1)\nWriter(Writer(2))\n```\nOther(3) "), F.col("doc_id").cast("string"))
    return checks.unknown_calls(checks.lines_of(table(spark, d, "documents").select(F.col("doc_id").alias("slug"), page.alias("content"))), spark.createDataFrame([("Reader",)], "name string")).select("slug", "detail")


@query("SELECT doc_id AS slug, '4' AS detail FROM documents WHERE doc_id % 2 = 0")
def showcase_focus(spark, d):
    ids = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.concat(F.lit("<!-- claim_id: "), F.md5(k.cast("string")), F.lit("0000 -->")))
    p = table(spark, d, "documents").select(F.col("doc_id"), F.concat(F.lit("showcase-"), F.col("doc_id").cast("string")).alias("slug"), F.array_join(F.slice(ids, F.lit(1), F.when(F.col("doc_id") % 2 == 0, 5).otherwise(3)), "\n").alias("content"))
    features = spark.range(1, 5).select(F.concat(F.md5(F.col("id").cast("string")), F.lit("0000")).alias("claim_id"))
    return checks.showcase_focus(checks.lines_of(p.select("slug", "content")), features).select(F.substring_index("slug", "-", -1).cast("long").alias("slug"), "detail")


# ---------------------------------------------------------------------------------------------- page plans


def _plan(spark, d):
    k = F.col("c_custkey")
    role = F.element_at(F.array(F.lit("toc"), F.lit("comprehensive_guide"), F.lit("landing"), F.lit(None).cast("string")), (k % 4 + 1).cast("int"))
    ids = F.transform(F.sequence(F.lit(1), (k % 6 + 1).cast("int")), lambda i: F.concat(F.lit("c"), (k % 7 * 10 + i).cast("string")))
    section = F.element_at(F.array(*map(F.lit, ("docs", "kb", "blog", "docs", "products"))), (k % 5 + 1).cast("int"))
    plain = table(spark, d, "customer").select(
        section.alias("section"), F.concat(F.lit("p"), k.cast("string")).alias("slug"), role.alias("page_role"), F.concat(F.lit("out/"), k.cast("string")).alias("output_path"), ids.alias("claims"),
        F.array(F.lit("kid"), F.lit("other")).alias("child_pages"), F.array(F.lit("Free_Trial")).alias("forbidden"), F.when(k % 8 == 1, "all").otherwise("some").alias("coverage"), F.lit(2).alias("min_claims"), F.lit(5).alias("max_claims"), k,
    )
    content = F.concat(F.lit("# Page\nkid and "), F.when(k % 3 == 0, "other").otherwise("others"), F.when(k % 5 == 0, "\n```\ncode\n```").otherwise(""), F.when(k % 9 == 0, "\n## A free trial\n").otherwise("\nfree trial\n"))
    return plain, plain.where(k % 11 > 0).select("output_path", content.alias("content"))


_PLANNED = """p AS (SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 1 THEN 'kb' WHEN 2 THEN 'blog' WHEN 4 THEN 'products' ELSE 'docs' END AS section, 'p' || c_custkey AS slug, c_custkey % 6 + 1 AS n FROM customer),
u AS (SELECT DISTINCT 'c' || (k % 7 * 10 + i) AS id, section FROM (SELECT k, section, unnest(range(1, n + 1)) AS i FROM p) WHERE section <> 'blog')"""


@query(f"""WITH {_PLANNED} SELECT 'ROLE_MISSING' AS code, 'error' AS severity, section, slug, '' AS detail FROM p WHERE k % 4 = 3 UNION ALL SELECT 'TOC_HAS_SNIPPETS', 'blocker', section, slug, '' FROM p WHERE k % 4 = 0 AND k % 5 = 0 AND k % 11 > 0
UNION ALL SELECT 'TOC_MISSING_CHILDREN', 'error', section, slug, 'other' FROM p WHERE k % 4 = 0 AND k % 3 > 0 AND k % 11 > 0 UNION ALL SELECT 'GUIDE_COVERAGE_INVALID', 'error', section, slug, '' FROM p WHERE k % 4 = 1 AND k % 8 <> 1
UNION ALL SELECT 'GUIDE_INCOMPLETE', 'error', section, slug, n::VARCHAR FROM p WHERE k % 4 = 1 AND n < 4 UNION ALL SELECT 'CLAIM_QUOTA_UNDERFLOW', 'warn', section, slug, n::VARCHAR FROM p WHERE n < 2 UNION ALL SELECT 'CLAIM_QUOTA_EXCEEDED', 'error', section, slug, n::VARCHAR FROM p WHERE n > 5
UNION ALL SELECT 'FORBIDDEN_TOPIC', 'error', section, slug, 'Free_Trial' FROM p WHERE k % 9 = 0 AND k % 11 > 0 UNION ALL SELECT 'CLAIM_CROSS_SECTION', 'warn', '', id, count(*)::VARCHAR FROM u GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'MANDATORY_PAGE_MISSING', 'error', 'docs', 'index', ''""")
def gate_distribution(spark, d):
    pages = _plan(spark, d)
    required = spark.createDataFrame([("docs", "_index"), ("docs", "p3")], "section string, slug string")
    return plan.distribution(pages[0], pages[1], 4, required, "prod")


@query("SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'docs' WHEN 1 THEN 'kb' WHEN 2 THEN 'blog' WHEN 3 THEN 'products' END AS section FROM part")
def section_classes(spark, d):
    path = F.element_at(F.array(*map(F.lit, ("content/docs.acme.org/a.md", "x/kb/a.md", "Posts\\2024\\a.md", "content/Products.acme.org/b.md", "src/docsfile.md"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), plan.section_of(path, {"blog": "posts/"}).alias("section"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'beginner' WHEN 1 THEN 'advanced' ELSE 'intermediate' END AS audience_level, 'simple' AS complexity FROM orders")
def enriched_claims(spark, d):
    text = F.element_at(F.array(*map(F.lit, ("Install the advanced one", "Performance counts", "Plain words"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return plan.enriched(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("claim_text"))).select("id", "audience_level", "complexity")


@query("SELECT DISTINCT w.k AS group_key, g.s_suppkey AS claim_id FROM (SELECT unnest(['steps', 'install_steps_first', 'key', 'none']) AS k) w JOIN (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'key_features' WHEN 1 THEN 'install_steps' ELSE 'quickstart_steps' END AS key FROM supplier) g ON contains(w.k, g.key) OR contains(g.key, w.k)")
def claims_of_groups(spark, d):
    key = F.element_at(F.array(*map(F.lit, ("key_features", "install_steps", "quickstart_steps"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    wanted = spark.createDataFrame([("steps",), ("install_steps_first",), ("key",), ("none",)], "group_key string")
    return plan.claims_of_groups(wanted, table(spark, d, "supplier").select(key.alias("key"), F.col("s_suppkey").alias("claim_id")))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'work/' || o_orderkey || '.md' ELSE '/other/' || o_orderkey || '.md' END AS path FROM orders")
def relative_locations(spark, d):
    k = F.col("o_orderkey").cast("string")
    i = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, "/runs/r1/work/").otherwise("/other/"), k, F.lit(".md")).alias("path"))
    return plan.relative_locations(i, "/runs/r1/")


@query("SELECT o_orderkey AS run_id, 'PR_MISSING_EMERGENCY_MODE_NOTICE' AS code, 'blocker' AS severity FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 > 0 AND o_orderkey % 5 > 1")
def request_blockers(spark, d):
    k = F.col("o_orderkey")
    body = F.when(k % 5 == 0, "In Emergency Mode").when(k % 5 == 1, "one manual edit").when(k % 5 == 2, F.lit(None)).otherwise("plain")
    return plan.request_blockers(table(spark, d, "orders").select(k.alias("run_id"), (k % 2 == 0).alias("emergency"), (k % 3 > 0).alias("manual_edits"), body.alias("body")))


@query("SELECT DISTINCT 'n' || c_nationkey AS path FROM customer")
def affected_paths(spark, d):
    return plan.affected_paths(table(spark, d, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("path")))


@query("SELECT o_orderkey AS run_id FROM (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20)")
def newest_runs(spark, d):
    return plan.newest(table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), "o_orderdate"), "o_orderdate", 20).select("run_id")


@query("SELECT 'A' || s_nationkey AS agent, 'TC-' || s_suppkey AS task, s_suppkey AS n_passed, CASE WHEN s_suppkey % 2 = 0 THEN 2 END AS n_failed, CASE WHEN s_suppkey % 3 = 0 THEN 4.5::DOUBLE END AS score FROM supplier")
def reports_index(spark, d):
    k = F.col("s_suppkey").cast("string")
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("reports/agents/A"), F.col("s_nationkey").cast("string"), F.lit("/TC-"), k, F.lit("/")).alias("at"))
    report = s.select(F.concat("at", F.lit("report.md")).alias("path"), F.concat(F.lit("ran: "), F.col("s_suppkey").cast("string"), F.lit(" passed"), F.when(F.col("s_suppkey") % 2 == 0, ", 2 failed").otherwise("")).alias("content"))
    review = s.where("s_suppkey % 3 = 0").select(F.concat("at", F.lit("self_review.md")), F.lit("Overall score: **4.5/5**"))
    return plan.reports_index(report.union(review))


@query(r"""SELECT event_id, '{"a":["[REDACTED:K]",{"b":"x ' || CASE WHEN event_id % 2 = 0 THEN '[REDACTED:K]' ELSE 'plain' END || '"}]}' AS payload FROM events""")
def redacted_deeply(spark, d):
    tail = F.when(F.col("event_id") % 2 == 0, "key-123").otherwise("plain")
    e = table(spark, d, "events").select("event_id", F.concat(F.lit('{"a":["key-9",{"b":"x '), tail, F.lit('"}]}')).alias("payload"))
    return files.redact_events(e, [("K", r"key-\d+")])


# ------------------------------------------------------------------------------------------------- repairs

_LISTED = "array_to_string(list_filter(string_split(content, chr(10)), lambda x: NOT regexp_matches(x, '{}')), chr(10))"
_MAPPED = "array_to_string(list_transform(string_split(content, chr(10)), lambda x: {}), chr(10))"
#: Each repair in DuckDB's SQL.
_REPAIRS = {
    "template_tokens": "regexp_replace(replace(content, '__PRODUCT_NAME__', 'Acme'), '__[A-Z0-9_]+__', '', 'g')",
    "link_normalization": r"regexp_replace(content, '\]\(\./([\w-]+)\.md\)', '](/docs/\1/)', 'g')",
    "alt_text": r"regexp_replace(content, '!\[\s*\]\(([^)]*?)([\w-]+)\.(\w+)\)', '![\2](\1\2.\3)', 'g')",
    "foss_licensing": _LISTED.format("(?i)commercial licen[sc]e|purchase|pricing|free trial|buy now"),
    "invalid_claim_marker": r"regexp_replace(content, '<!--\s*claim_id:[^>]*-->\s*', '', 'g')",
    "terminology_consistency": r"regexp_replace(content, 'https://github\.com/[\w.-]+/[\w.-]+', 'https://github.com/acme/tool', 'g')",
    "missing_prerequisites": r"CASE WHEN regexp_matches(content, '(?im)^#+\s*prerequisites') THEN content ELSE content || chr(10) || chr(10) || '## Prerequisites' || chr(10) || chr(10) || '- Acme installed' || chr(10) END",
    "missing_cta": "CASE WHEN regexp_matches(content, '(?i)get started|download|learn more') THEN content ELSE content || chr(10) || chr(10) || '**Get started** with Acme today.' || chr(10) END",
    "missing_next_steps": "CASE WHEN regexp_matches(content, '(?i)next steps|learn more|developer guide') THEN content ELSE content || chr(10) || chr(10) || '## Next Steps' || chr(10) || chr(10) || '- Developer Guide' || chr(10) END",
    "frontmatter_fields": r"CASE WHEN starts_with(content, '---' || chr(10)) AND NOT regexp_matches(content, '(?m)^description:') THEN '---' || chr(10) || 'description: Acme' || chr(10) || substr(content, 5) ELSE content END",
    "frontmatter_comments": "CASE WHEN doc_id % 4 = 3 THEN replace(content, '# note' || chr(10), '') ELSE content END",
    "metadata": "CASE WHEN doc_id % 4 = 2 THEN replace(content, 'title: page' || chr(10), 'title: Acme page' || chr(10)) ELSE content END",
    "error_message_format": _MAPPED.format(r"regexp_replace(x, '\b((?:Error|Exception|Warning|Failed): [^`\n]*)', '`\1`')"),
    "heading_descriptiveness": _MAPPED.format(r"CASE WHEN regexp_matches(x, '^#+\s+\S+$') AND NOT contains(lower(x), 'acme') THEN regexp_replace(x, '^(#+)\s+', '\1 Acme ') ELSE x END"),
    "collapsed_frontmatter": "content",
}


def _register(name: str, sql: str) -> None:
    def run(spark, d):
        fix = files.repairs(PRODUCT, REPO)[name]
        return markdown(spark, d).select("slug", F.md5(F.encode(fix(F.col("content")), "UTF-8")).alias("digest"))

    run.__name__ = f"repair_{name}"
    query(f"WITH {MD} SELECT slug, md5({sql}) AS digest FROM md")(run)


for _name, _sql in _REPAIRS.items():
    _register(_name, _sql)


@query(rf"WITH {LINES}, v AS (SELECT *, CASE WHEN starts_with(t, '#') THEN length(regexp_extract(t, '^(#+)', 1)) END AS lv FROM lines), w AS (SELECT *, last_value(lv IGNORE NULLS) OVER (PARTITION BY slug ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM v) SELECT slug, md5(array_to_string(list(CASE WHEN lv > was + 1 THEN repeat('#', (was + 1)::INT) || regexp_replace(t, '^#+', '') ELSE text END ORDER BY line), chr(10))) AS digest FROM w GROUP BY slug")
def repair_heading_hierarchy(spark, d):
    return files.heading_levels(md_lines(spark, d)).select("slug", F.md5(F.encode("content", "UTF-8")).alias("digest"))


@query(rf"WITH {MD} SELECT slug, md5(content || chr(10) || '<!-- claim_id: zz-a1 -->' || chr(10) || '<!-- claim_id: zz-b2 -->') AS digest FROM md")
def repair_low_density(spark, d):
    m = markdown(spark, d)
    known = m.select("slug", F.explode(F.array(F.lit("zz-b2"), F.lit("zz-a1"), F.lit("zz-a1"))).alias("claim_id"))
    return files.low_density(m.select("slug", "content"), known).select("slug", F.md5(F.encode("content", "UTF-8")).alias("digest"))


@query(rf"""WITH {LINES}, m AS (SELECT slug, line, regexp_extract(text, '^(.*?)(?:(?i)<!--\s*claim_id:\s*[a-f0-9\-]{{36,64}}\s*-->|\[claim:\s*[a-f0-9\-]+\])', 1) AS before FROM lines WHERE regexp_matches(text, '(?i)(?:<!--\s*claim_id:\s*[a-f0-9\-]{{36,64}}\s*-->|\[claim:\s*[a-f0-9\-]+\])'))
SELECT slug, line, 'x' AS detail, 'warn' AS severity FROM m WHERE regexp_matches(before, '[.!?]') AND length(regexp_extract(before, '[.!?]([^.!?]*)$', 1)) + 1 > 50""")
def check_grounding(spark, d):
    return _rows(checks.claim_grounding(md_lines(spark, d))).withColumn("detail", F.lit("x"))
