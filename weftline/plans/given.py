"""Queries whose answers the supplied values decide, not their ids: paths named by the texts' digests, hosts and links of
pages, calls and secrets within texts. Their SQL states each rule again over the whole string."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims, files, gates, links, support
from .catalogue import query, table


def _digit(k: int, values: list[str]) -> str:
    """One of sixteen values by digit k of a text's digest; both engines read it."""
    return f"CASE substr(md5(text), {k}, 1) " + " ".join(f"WHEN '{d:x}' THEN '{v}'" for d, v in enumerate(values)) + " END"


_FOLDERS = ["", "docs/", "docs/api/", "src/", "lib/core/", "tests/", "examples/convert/", "site/tutorial/", "documentation/design/", ".cache/", "a/b/c/", "spec/", "samples/merge/", "reference/", "img/", "docs/examples/"]
_NAMES = ["README", "CHANGELOG", "contributing", "LICENSE", "install", "user-guide", "tutorial", "api", "architecture", "faq", "example", "quickstart", "setup", "notes", "parse_model", "test_render"]
_ENDS = [".md", ".py", ".js", ".ts", ".cs", ".java", ".go", ".rs", ".rb", ".php", ".cpp", ".c", ".png", ".zip", ".txt", ""]
_PATH = f"{_digit(1, _FOLDERS)} || {_digit(2, _NAMES)} || '-' || CAST(doc_id AS STRING) || {_digit(3, _ENDS)}"
_IGNORED = ["*.png", "examples", "", "#src", "docs/ex*", "a/b/*"]

#: The rules of paths in SQL: name, extension, depth and lower case first, then one expression a rule.
_TREE = f"""t0 AS (SELECT doc_id, {_PATH} AS path, text FROM documents),
t1 AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, lower(path) AS p, len(string_split(path, '/')) AS depth FROM t0),
tree AS (SELECT *, CASE WHEN contains(name, '.') THEN lower(regexp_extract(name, '[^.]*$')) ELSE '' END AS ext FROM t1)"""
_LANGUAGE = "CASE ext WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'cs' THEN 'csharp' WHEN 'java' THEN 'java' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'rb' THEN 'ruby' WHEN 'php' THEN 'php' WHEN 'cpp' THEN 'cpp' WHEN 'c' THEN 'c' ELSE 'unknown' END"
_DOC_TYPE = r"""CASE WHEN regexp_matches(name, '(?i)^readme') THEN 'readme' WHEN regexp_matches(name, '(?i)^changelog') THEN 'changelog' WHEN regexp_matches(name, '(?i)^contributing') THEN 'contributing'
WHEN regexp_matches(name, '(?i)^license') THEN 'license' WHEN regexp_matches(name, '(?i)^install') THEN 'install' WHEN regexp_matches(name, '(?i)guide') THEN 'guide' WHEN regexp_matches(name, '(?i)tutorial') THEN 'tutorial'
WHEN regexp_matches(name, '(?i)api') THEN 'api' WHEN regexp_matches(name, '(?i)architecture|design') THEN 'architecture' WHEN regexp_matches(name, '(?i)faq') THEN 'faq' ELSE 'other' END"""
_RELEVANCE = "CASE WHEN depth = 1 AND starts_with(upper(name), 'README') THEN 100 WHEN regexp_matches(path, '^(docs|documentation|site)/') THEN 90 WHEN starts_with(upper(name), 'README') THEN 80 WHEN depth <= 2 THEN 50 ELSE 30 END"
_BINARY = "ext IN ('png', 'zip') OR contains(text, chr(0))"
_KIND = """CASE WHEN regexp_matches(p, 'pyproject\\.toml|setup\\.py|package\\.json|pom\\.xml|cargo\\.toml|go\\.mod') THEN 'manifest' WHEN regexp_matches(p, 'src/|lib/') AND NOT regexp_matches(p, 'test|spec|__pycache__') THEN 'source_code'
WHEN regexp_matches(p, 'test|spec') THEN 'test' WHEN regexp_matches(p, 'implementation|architecture|design|adr|tech') THEN 'implementation_doc' WHEN regexp_matches(p, 'api|reference') THEN 'api_doc' ELSE 'readme_technical' END"""
_SKIPPED = "ext = 'png' OR regexp_matches(path, '(^|/)examples(/|$)') OR regexp_matches(path, '(^|/)docs/ex') OR regexp_matches(path, '(^|/)a/b/')"
_TAGS = " UNION ALL ".join(
    f"SELECT path, '{tag}' AS tag FROM kinds WHERE {rule}"
    for tag, rule in [
        ("quickstart", "regexp_matches(p, 'quickstart|quick_start|getting_started') OR doc_type = 'readme'"), ("readme", "doc_type = 'readme'"), ("tutorial", "contains(p, 'tutorial')"), ("example", "contains(p, 'example')"),
        ("convert", "regexp_matches(p, 'convert|conversion')"), ("merge", "contains(p, 'merge')"), ("extract", "contains(p, 'extract')"), ("parse", "regexp_matches(p, 'parse|parsing')"), ("render", "contains(p, 'render')"),
        ("architecture", "doc_type = 'architecture'"),
    ]
)


def tree(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(_PATH).alias("path"), F.col("text").alias("content"))


@query(f"""WITH {_TREE}, kinds AS (SELECT *, {_DOC_TYPE} AS doc_type, {_KIND} AS kind FROM tree), tags AS (SELECT path, string_agg(tag, ',' ORDER BY tag) AS tags FROM ({_TAGS}) GROUP BY 1)
SELECT kinds.path, {_LANGUAGE} AS language, doc_type, {_RELEVANCE} AS relevance, {_BINARY} AS is_binary, kind, CASE kind WHEN 'manifest' THEN 1 WHEN 'source_code' THEN 2 WHEN 'test' THEN 3 WHEN 'implementation_doc' THEN 4 WHEN 'api_doc' THEN 5 ELSE 6 END AS priority,
coalesce(tags, 'example') AS tags, CASE WHEN starts_with(kinds.path, 'examples/') THEN 100 WHEN regexp_matches(kinds.path, '(?i)^(docs|documentation)/[^/]*example') THEN 80 WHEN depth = 1 THEN 70 WHEN regexp_matches(kinds.path, '^(tests|test|__tests__|spec)/') THEN 50 ELSE 30 END AS example_score,
{_SKIPPED.replace('path', 'kinds.path')} AS ignored FROM kinds LEFT JOIN tags USING (path)""")
def path_attributes(spark, d):
    """All rules that say what a path is."""
    path = F.col("path")
    kind = claims.source_type(path)
    return tree(spark, d).select(
        "path", files.language(path).alias("language"), files.doc_type(path).alias("doc_type"), files.doc_relevance(path).alias("relevance"), files.is_binary(path, F.col("content").cast("binary")).alias("is_binary"),
        kind.alias("kind"), claims.source_priority(kind).alias("priority"), F.array_join(support.path_tags(path, files.doc_type(path)), ",").alias("tags"),
        support.example_relevance(path, path.startswith("examples/")).alias("example_score"), T.ignored_by(path, _IGNORED).alias("ignored"),
    )


@query(rf"WITH {_TREE} SELECT path, {_DOC_TYPE} AS doc_type, CASE WHEN {_BINARY} THEN 10 ELSE {_RELEVANCE} END AS score FROM tree WHERE NOT regexp_matches(path, '(^|/)\.[^/]+/') AND NOT ({_SKIPPED})")
def documents_found(spark, d):
    return files.discovered(tree(spark, d), _IGNORED).select("path", "doc_type", "score")


@query(f"WITH {_TREE} SELECT DISTINCT split_part(path, '/', 1) AS root FROM tree WHERE split_part(path, '/', 1) IN ('docs', 'documentation', 'site', 'examples', 'samples')")
def roots_found(spark, d):
    return files.roots(tree(spark, d), ["docs", "documentation", "site", "examples", "samples"])


@query(f"""WITH {_TREE} SELECT path FROM tree WHERE ext IN ('py', 'js', 'cs')
ORDER BY CASE WHEN starts_with(path, 'src/') THEN 0 WHEN starts_with(path, 'lib/') THEN 1 WHEN regexp_matches(path, '(^|/)tests?/') THEN 3 ELSE 2 END, path LIMIT 100""")
def sources_found(spark, d):
    """The hundred sources that come first: the limit is the operator's own."""
    return files.source_files(tree(spark, d)).select("path")


@query(f"WITH {_TREE}, l AS (SELECT path, {_LANGUAGE} AS language FROM tree) SELECT language FROM l WHERE language <> 'unknown' GROUP BY 1 ORDER BY count(*) DESC, min(path) LIMIT 1")
def language_of_tree(spark, d):
    return files.primary_language(tree(spark, d))


@query(r"""WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages)
SELECT page_id, host, regexp_matches(host, '\.example\.com$') OR regexp_matches(host, '^www\..*\.example\.or.$') OR host = 'blog.example.net:443' AS allowed FROM h""")
def hosts_of_pages(spark, d):
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    return table(spark, d, "pages").select("page_id", host.alias("host"), support.host_allowed(host, ["*.example.com", "www.*.example.or?", "blog.example.net:443"]).alias("allowed"))


_HREF = r"""<a href="([^"]*)">"""
_TITLE_WORD = r"[^\s.,!?]+"
_AT = "CASE length(w) % 4 WHEN 0 THEN w WHEN 1 THEN w || '.md' WHEN 2 THEN w || '/_index.md' ELSE w || '/index.md' END"


@query(rf"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS target FROM pages), w AS (SELECT DISTINCT unnest(regexp_extract_all(regexp_extract(html, '<title>([^<]*)</title>', 1), '{_TITLE_WORD}')) AS w FROM pages),
f AS (SELECT {_AT} AS path FROM w), n AS (SELECT DISTINCT page_id, target, regexp_replace(regexp_replace(target, '[#?].*$', ''), '^/+|/+$', '', 'g') AS p FROM l)
SELECT page_id AS slug, target FROM n WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.path = n.p) AND NOT EXISTS (SELECT 1 FROM f WHERE f.path = n.p || '.md') AND NOT EXISTS (SELECT 1 FROM f WHERE f.path = n.p || '/_index.md') AND NOT EXISTS (SELECT 1 FROM f WHERE f.path = n.p || '/index.md')""")
def broken_links_of_pages(spark, d):
    """Links of the pages' navigation to files that are named by the words of all titles."""
    pages = table(spark, d, "pages")
    found = pages.select(F.col("page_id").alias("slug"), F.lit(1).alias("line"), F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("target"))
    words = pages.select(F.explode(F.regexp_extract_all(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(_TITLE_WORD), F.lit(0))).alias("w")).distinct()
    return links.broken_links(found, words.select(F.expr(_AT).alias("path"))).select("slug", "target")


_W = "[A-Za-z]{3,}"


@query(f"""WITH c AS (SELECT conv_id || '-' || turn AS slug, list_transform(regexp_extract_all(text, '{_W}'), lambda x: lower(x)) AS w FROM conversations), b AS (SELECT list_transform(regexp_extract_all(text, '{_W}'), lambda x: lower(x)) AS w FROM benchmark),
s AS (SELECT DISTINCT unnest(w[:-2]) AS c, unnest(w[2:]) AS m FROM b WHERE len(w) > 1), k AS (SELECT slug, w[1] AS c, w[2] AS m FROM c WHERE len(w) > 2 UNION SELECT slug, w[1], w[3] FROM c WHERE len(w) > 2)
SELECT slug, k.c || '.' || k.m AS detail FROM k WHERE k.c IN (SELECT c FROM s) AND NOT EXISTS (SELECT 1 FROM s WHERE s.c = k.c AND s.m = k.m)""")
def unknown_methods_of_turns(spark, d):
    """Calls in code of the turns' own words against a surface of all neighbouring words of the benchmark."""
    words = F.regexp_extract_all("text", F.lit(_W), F.lit(0))
    w = lambda k: F.get("w", F.lit(k))
    turns = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("slug"), F.lit(1).alias("line"), words.alias("w")).where(F.size("w") > 2)
    code = F.concat(F.lit("x = "), F.initcap(w(0)), F.lit("(1)\nx."), w(1), F.lit("()\n"), F.lower(w(0)), F.lit("."), w(2), F.lit("()"))
    pairs = table(spark, d, "benchmark").select(words.alias("w")).where(F.size("w") > 1)
    pairs = pairs.select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("c"), F.slice("w", F.lit(2), F.size("w")).alias("m"))).alias("x"))
    return support.unknown_methods(turns.select("slug", "line", code.alias("code")), pairs.select(F.col("x.c").alias("class_name"), F.col("x.m").alias("method"))).select("slug", "detail")


#: What is put at the end of a text, by a digit of its digest: a secret of each kind made of that digest, near misses, nothing.
_ADDED = [
    "'AKIA' || upper(substr(h, 1, 16))", "'aws_secret_access_key = ' || h || substr(h, 1, 8)", "'API-Key: ' || h", "'sk-' || h || substr(h, 1, 16)", "'Password=' || substr(h, 1, 9)", "'-----BEGIN RSA PRIVATE KEY-----'",
    "'ghp_' || h || substr(h, 1, 4)", "'xoxb-' || substr(h, 1, 12)", "'Bearer ' || h", "'Authorization: Basic ' || h || '='", "'token: ' || h", "'AKIA' || substr(h, 1, 12)", "'sk-' || h", "'password=' || substr(h, 1, 5)", "'-----BEGIN PRIVATE KEY-----'", "''",
]
_WITH_SECRET = "text || chr(10) || CASE substr(h, 32, 1) " + " ".join(f"WHEN '{k:x}' THEN {v}" for k, v in enumerate(_ADDED)) + " END"
_MORE = [*gates.SECRETS, gates.TOKEN]


def _in_sql(pattern: str) -> str:
    return pattern.replace("'", "''")


def _grouped(pattern: str) -> str:
    return f"(?i)({pattern[4:]})" if pattern.startswith("(?i)") else f"({pattern})"


def _secretive(spark, d):
    return table(spark, d, "documents").withColumn("h", F.md5(F.encode("text", "UTF-8"))).select("doc_id", F.expr(_WITH_SECRET).alias("text"))


_SECRETIVE = f"s AS (SELECT doc_id, {_WITH_SECRET} AS text FROM (SELECT *, md5(text) AS h FROM documents))"


@query(f"WITH {_SECRETIVE} " + " UNION ALL ".join(f"SELECT doc_id AS id, '{k}' AS kind, unnest(regexp_extract_all(text, '{_in_sql(_grouped(p))}', 1)) AS value FROM s" for k, p in _MORE))
def secrets_by_kind(spark, d):
    """All kinds of secrets in all texts."""
    return files.find_secrets(_secretive(spark, d).withColumnRenamed("doc_id", "id"), _MORE)


_REDACTED = "text"
for _kind, _pattern in _MORE:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_in_sql(_pattern)}', '[REDACTED:{_kind}]', 'g')"


@query(f"WITH {_SECRETIVE} SELECT doc_id, md5({_REDACTED}) AS digest FROM s")
def redacted_by_kind(spark, d):
    return _secretive(spark, d).select("doc_id", F.md5(F.encode(files.redact(F.col("text"), _MORE), "UTF-8")).alias("digest"))


@query(f"WITH {_SECRETIVE}, n AS (SELECT 'src/' || md5(text) || '.py' AS path, " + " + ".join(f"len(regexp_extract_all(text, '{_in_sql(p)}'))" for _, p in _MORE) + " AS n FROM s) SELECT path, sum(n)::BIGINT AS n_secrets, contains(path, 'ab') OR regexp_matches(path, '0\\.py$') AS allowed FROM n GROUP BY 1 HAVING sum(n) > 0")
def secrets_by_file(spark, d):
    own = _secretive(spark, d).select(F.concat(F.lit("src/"), F.md5(F.encode("text", "UTF-8")), F.lit(".py")).alias("path"), F.col("text").alias("content"))
    return files.scan_summary(own, ["ab", "*0.py"], _MORE)


@query("WITH e AS (SELECT event_id, floor(abs(value) / 15) AS n, regexp_extract(props, '[0-9]+')::INT / 100.0 AS j FROM events) SELECT event_id, round(least(60.0, pow(2.0, n)) * (1 + 0.5 * j), 9) AS seconds FROM e")
def backoff_of_events(spark, d):
    """Delays by the value of an event, with the number in its properties as the jitter."""
    jitter = F.regexp_extract("props", "[0-9]+", 0).cast("int") / 100
    return table(spark, d, "events").select("event_id", F.round(support.backoff(F.floor(F.abs("value") / 15), jitter=jitter), 9).alias("seconds"))
