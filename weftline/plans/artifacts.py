"""Queries on artifacts: typed front matter and contracts, validation by schema, URLs, strategies, scorers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import frontmatter
from ..operators import evidence, links, plan, state
from ..sources import schema
from .catalogue import query, table

#: Front matter made of a document's own words, by six forms; both engines read the text.
_W = [f"coalesce(@at(regexp_extract_all(text, '[A-Za-z]+'@group), {k}), 'w{k}')" for k in range(1, 5)]
_FORMS = [
    "'title: \"' || {0} || ': ' || {1} || '\"' || chr(10) || 'tags: [' || {2} || ', ''' || {3} || ''', ]' || chr(10) || 'weight: ' || CAST(doc_id % 100 AS STRING) || ' # order'",
    "'title: ' || {0} || chr(10) || 'keywords:' || chr(10) || '  - ' || {1} || chr(10) || chr(10) || '  # more' || chr(10) || '  - \"' || {2} || '\"' || chr(10) || 'draft: ' || CASE WHEN doc_id % 4 = 0 THEN 'True' ELSE 'false' END",
    "'title: ' || {0} || chr(10) || 'aliases:' || chr(10) || {1} || ' without colon' || chr(10) || '- ' || {2} || chr(10) || 'params.x: 1' || chr(10) || 'two words: ' || {3} || chr(10) || 'ratio: -' || CAST(doc_id % 7 AS STRING) || '.5e2'",
    "'date: 2024-01-' || CAST(10 + doc_id % 20 AS STRING) || chr(10) || 'title: ''' || {0} || ' \"' || {1} || '\" # kept''' || chr(10) || 'empty:'",
    "'title: first ' || {0} || chr(10) || 'tags: []' || chr(10) || 'title: ' || CAST(doc_id AS STRING)",
    "'# nothing but a comment'",
]
_BLOCK = "CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN {f.format(*_W)}" for k, f in enumerate(_FORMS)) + " END"
_PATH = "CASE doc_id % 4 WHEN 0 THEN 'content/docs.acme.org/tool/en/' WHEN 1 THEN 'content/blog.acme.org/tool/' WHEN 2 THEN 'content/kb.acme.org/tool/en/' ELSE 'other/' END || CAST(doc_id AS STRING) || CASE WHEN doc_id % 9 = 0 THEN '.txt' ELSE '.md' END"


def _pages(spark, d):
    fields = f"doc_id, {_PATH} AS path, '---' || chr(10) || {_BLOCK.replace('@group', ', 0').replace('@at', 'try_element_at')} || chr(10) || '---' || chr(10) || text AS content"
    return spark.sql(f"SELECT {fields} FROM {{docs}}", docs=table(spark, d, "documents"))


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_ENTRIES = rf"""b AS (SELECT doc_id, {_PATH} AS path, {_BLOCK.replace("@group", "").replace("@at", "list_extract")} AS block FROM documents),
l0 AS (SELECT doc_id, path, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS x FROM (SELECT doc_id, path, string_split(block, chr(10)) AS x FROM b)),
l AS (SELECT doc_id, path, i, {_TRIM.format("x")} AS s FROM l0),
h AS (SELECT *, starts_with(s, '- ') AS dash, {_TRIM.format("substr(s, 1, greatest(instr(s, ':') - 1, 0))")} AS k, {_TRIM.format("substr(s, instr(s, ':') + 1)")} AS v, instr(s, ':') AS c FROM l WHERE s <> '' AND NOT starts_with(s, '#')),
g AS (SELECT *, c > 1 AND NOT regexp_matches(k, '[. ]') AS good FROM h),
o AS (SELECT *, last_value(CASE WHEN NOT dash THEN CASE WHEN good AND v = '' THEN i ELSE -1 END END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own FROM g),
it AS (SELECT doc_id, own AS i, string_agg(regexp_replace({_TRIM.format("substr(s, 3)")}, '^[''"]+|[''"]+$', '', 'g'), '|' ORDER BY o.i) AS items FROM o WHERE dash AND own > 0 GROUP BY 1, 2),
p AS (SELECT *, {_TRIM.format("regexp_replace(v, ' #.*$', '')")} AS p FROM g WHERE good AND v <> ''),
q AS (SELECT *, regexp_matches(p, '^"(.*")?$|^''(.*'')?$') AS quoted FROM p),
t AS (SELECT *, CASE WHEN quoted THEN substr(p, 2, greatest(length(p) - 2, 0)) ELSE p END AS t, NOT quoted AND regexp_matches(p, '^\[.*\]$') AS listed FROM q),
e AS (SELECT doc_id, path, i, k AS key, CASE WHEN listed THEN 'array_string' WHEN NOT quoted AND lower(p) IN ('true', 'false') THEN 'boolean' WHEN NOT quoted AND regexp_matches(p, '^[+-]?\d+$') THEN 'integer'
        WHEN NOT quoted AND regexp_matches(p, '^[+-]?(\d+\.\d*|\.\d+|\d+[eE])([eE]?[+-]?\d+)?$') THEN 'number' WHEN regexp_matches(t, '^\d{{4}}-\d{{2}}-\d{{2}}') THEN 'date' ELSE 'string' END AS type,
      CASE WHEN listed THEN array_to_string(list_filter(list_transform(string_split(substr(p, 2, length(p) - 2), ','), lambda x: regexp_replace({_TRIM.format("x")}, '^[''"]+|[''"]+$', '', 'g')), lambda x: x <> ''), '|') ELSE t END AS value FROM t
      UNION ALL SELECT g.doc_id, path, g.i, k, 'array_string', coalesce(items, '') FROM g LEFT JOIN it ON it.doc_id = g.doc_id AND it.i = g.i WHERE good AND v = '' AND NOT dash),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY i DESC) AS n FROM e) WHERE n = 1)"""


@query(f"WITH {_ENTRIES} SELECT doc_id, key, type, value FROM f")
def front_matter_typed(spark, d):
    """Lists, nested quotes, comments and bad lines."""
    e = _pages(spark, d).select("doc_id", F.explode(frontmatter.front_matter_entries(F.col("content"))).alias("e"))
    return e.select("doc_id", "e.key", "e.type", F.coalesce("e.text", F.array_join("e.items", "|")).alias("value"))


@query(f"""WITH {_ENTRIES}, s AS (SELECT *, CASE WHEN path LIKE '%docs.acme%' THEN 'docs' WHEN path LIKE '%blog.acme%' THEN 'blog' WHEN path LIKE '%kb.acme%' THEN 'kb' END AS section FROM f WHERE path LIKE '%.md'),
n AS (SELECT section, count(DISTINCT doc_id) AS n_all FROM s GROUP BY 1), v AS (SELECT section, key, type, count(*) AS n FROM s WHERE section IS NOT NULL GROUP BY ALL)
SELECT section, key, arg_min(type, lpad((1000000000 - n)::VARCHAR, 10, '0') || type) AS type, sum(n)::BIGINT AS n_pages, sum(n) = any_value(n_all) AS required FROM v JOIN n USING (section) GROUP BY section, key""")
def section_contracts(spark, d):
    return plan.contracts(_pages(spark, d))


_PROPS = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 89, "multipleOf": 3}}}


@query("""WITH k AS (SELECT event_id, (props ->> 'k')::INT AS k FROM events), r AS (SELECT event_id, unnest(CASE WHEN k < 10 THEN ['minimum'] WHEN k > 89 THEN ['maximum'] ELSE [] END || CASE WHEN k % 3 <> 0 THEN ['multipleOf'] ELSE [] END) AS keyword FROM k WHERE k IS NOT NULL)
SELECT event_id, '$.k' AS path, keyword FROM r UNION ALL SELECT event_id, '$.k', 'required' FROM k WHERE k IS NULL AND event_id IN (SELECT event_id FROM events WHERE props IS NOT NULL)""")
def props_violations(spark, d):
    return schema.validate(table(spark, d, "events").select("event_id", "props"), "props", _PROPS)


_TALK = {
    "type": "object", "required": ["conv_id", "turns", "title"],
    "properties": {
        "conv_id": {"type": "integer"},
        "turns": {"type": "array", "minItems": 3, "items": {"type": "object", "required": ["role", "n"], "properties": {"role": {"enum": ["user", "assistant"]}, "n": {"type": "number", "exclusiveMinimum": 40, "maximum": 400}, "first": {"type": "string", "pattern": "^[A-Z]", "maxLength": 9}}}},
    },
}


@query("""WITH t AS (SELECT conv_id, role, length(text) AS n, regexp_extract(text, '^\\S*') AS first, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations),
v AS (SELECT conv_id, '$.turns[' || i || ']' AS p, unnest(CASE WHEN role NOT IN ('user', 'assistant') THEN ['.role enum'] ELSE [] END || CASE WHEN n <= 40 THEN ['.n exclusiveMinimum'] WHEN n > 400 THEN ['.n maximum'] ELSE [] END
  || CASE WHEN NOT regexp_matches(first, '^[A-Z]') THEN ['.first pattern'] ELSE [] END || CASE WHEN length(first) > 9 THEN ['.first maxLength'] ELSE [] END) AS x FROM t)
SELECT conv_id, p || split_part(x, ' ', 1) AS path, split_part(x, ' ', 2) AS keyword FROM v UNION ALL SELECT DISTINCT conv_id, '$.title', 'required' FROM t UNION ALL SELECT conv_id, '$.turns', 'minItems' FROM t GROUP BY conv_id HAVING count(*) < 3""")
def nested_violations(spark, d):
    """A document for each conversation, with its turns as a nested list."""
    turn = F.struct(F.col("turn").alias("turn"), "role", "text")
    talks = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    turns = F.transform("t", lambda x: F.struct(x["role"].alias("role"), F.length(x["text"]).alias("n"), F.regexp_extract(x["text"], r"^\S*", 0).alias("first")))
    artifact = talks.select("conv_id", F.to_json(F.struct("conv_id", turns.alias("turns"))).alias("j"))
    return schema.validate(artifact, "j", _TALK)


#: Content paths made of the addresses of pages.
_CONTENT = r"""CASE page_id % 5 WHEN 0 THEN 'content/docs.acme.org/' || h || '/' || l || '/Part ' || l || '/' || n || '.md' WHEN 1 THEN 'content/kb.acme.org/' || h || '/' || l || '/_index.md' WHEN 2 THEN 'content/blog.acme.org/' || h || '/' || n || '/index.' || l || '.md'
WHEN 3 THEN 'content/docs.acme.org/' || h || '/../' || n || '.md' ELSE 'content/docs.acme.org/' || h || '/en/' || n || '/index.md' END"""
_PARTS = r"SELECT page_id, regexp_extract(url, '://([a-zA-Z0-9-]+)', 1) AS h, CASE WHEN regexp_extract(url, '/([a-z][a-z])/', 1) = '' THEN 'en' ELSE regexp_extract(url, '/([a-z][a-z])/', 1) END AS l, regexp_extract(url, '([0-9]+)', 1) AS n FROM "


@query(f"""WITH x AS ({_PARTS}pages), y AS (SELECT *, CASE WHEN l = 'en' THEN '' ELSE '/' || l END AS lp FROM x)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN lp || '/' || lower(h) || '/part-' || l || '/' || n || '/' WHEN 1 THEN lp || '/' || lower(h) || '/' WHEN 2 THEN lp || '/' || lower(h) || '/' || n || '/' WHEN 4 THEN '/' || lower(h) || '/' || n || '/' END AS url FROM y""")
def content_urls(spark, d):
    paths = spark.sql(f"SELECT page_id, {_CONTENT} AS path FROM ({_PARTS.replace(chr(92), chr(92) * 2)}{{pages}})", pages=table(spark, d, "pages"))
    return paths.select("page_id", state.url_of_content(F.col("path")).alias("url"))


_SECTION = "CASE doc_id % 5 WHEN 0 THEN 'products' WHEN 1 THEN 'docs' WHEN 2 THEN 'kb' WHEN 3 THEN 'blog' ELSE 'reference' END"
_ROLE_SLUG = "CASE doc_id % 7 WHEN 0 THEN 'overview' WHEN 1 THEN 'developer-guide' WHEN 2 THEN 'faq' WHEN 3 THEN 'how-to-' || CAST(doc_id AS STRING) ELSE 'page-' || CAST(doc_id AS STRING) END"


@query(f"""WITH a AS (SELECT doc_id, {_SECTION} AS section, {_ROLE_SLUG} AS slug, length(text) % 9 AS w, doc_id % 11 = 0 AS ix FROM documents),
r AS (SELECT *, CASE WHEN ix AND section = 'docs' THEN 'toc' WHEN slug = 'developer-guide' THEN 'guide' WHEN slug = 'overview' AND section = 'products' THEN 'landing' WHEN section = 'docs' THEN 'workflow'
  WHEN section = 'kb' THEN CASE WHEN slug = 'faq' THEN 'landing' WHEN slug LIKE 'how-to%' THEN 'showcase' ELSE 'trouble' END WHEN section = 'reference' THEN 'api' ELSE 'landing' END AS r FROM a)
SELECT doc_id, CASE WHEN r = 'landing' AND section = 'products' THEN 'Product positioning' WHEN r = 'toc' THEN 'Navigation hub' WHEN r = 'guide' THEN 'All usage scenarios' WHEN r = 'workflow' THEN 'How-to guide' WHEN r = 'showcase' THEN 'Prominent feature how-to'
  WHEN r = 'trouble' THEN 'Problem-solution' WHEN r = 'landing' AND section = 'blog' THEN 'Synthesized overview' ELSE section || ' page content' END AS primary_focus,
  CASE WHEN r = 'landing' AND section = 'products' THEN 5 WHEN r = 'toc' THEN 0 WHEN r = 'guide' THEN w WHEN r IN ('workflow', 'showcase') THEN 3 WHEN r = 'landing' AND section = 'blog' THEN 10 ELSE 1 END AS min_claims,
  CASE WHEN r = 'toc' THEN 2 WHEN r = 'guide' THEN 50 WHEN r IN ('workflow', 'showcase') THEN 8 WHEN r = 'trouble' THEN 5 WHEN r = 'landing' AND section = 'blog' THEN 20 ELSE 10 END AS max_claims,
  CASE WHEN r = 'landing' AND section = 'products' THEN 2 WHEN r IN ('toc', 'guide', 'trouble') THEN 2 WHEN r = 'workflow' THEN 1 WHEN r = 'showcase' THEN 3 ELSE 0 END AS n_forbidden FROM r""")
def content_strategies(spark, d):
    own = spark.sql(f"SELECT doc_id, {_SECTION} AS section, {_ROLE_SLUG} AS slug, length(text) % 9 AS w, doc_id % 11 = 0 AS ix FROM {{docs}}", docs=table(spark, d, "documents"))
    role = links.page_role(F.col("section"), F.col("slug"), F.col("ix"))
    found = own.select("doc_id", plan.content_strategy(role, F.col("section"), F.col("w")).alias("x"))
    return found.select("doc_id", "x.primary_focus", "x.min_claims", "x.max_claims", F.size("x.forbidden").alias("n_forbidden"))


_SET = r"list_distinct(list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) > 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in evidence.STOPWORDS) + "], x)))"


@query(f"""WITH c AS (SELECT conv_id, turn, {_SET.format("text")} AS a, {_SET.format("coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '')")} AS b FROM conversations)
SELECT conv_id, turn, round(CASE WHEN len(list_intersect(a, b)) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(a || b)) ELSE 0 END, 9) AS similarity FROM c""")
def scored_pairs(spark, d):
    """Each turn of a conversation and the next one, by a scorer that is chosen by name."""
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    pairs = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("a"), F.coalesce(after, F.lit("")).alias("b"))
    return evidence.score_pairs(pairs, "jaccard").select("conv_id", "turn", F.round("similarity", 9).alias("similarity"))
