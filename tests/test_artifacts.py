"""Front matter, schemas, contracts, URLs and scorers on cases written out."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import frontmatter
from weftline.operators import evidence, plan, state
from weftline.sources import schema


def entries(spark, page):
    row = spark.createDataFrame([(page,)], "content string").select(frontmatter.front_matter_entries(F.col("content")).alias("e")).first()
    return None if row.e is None else {x.key: (x.type, x.text if x.items is None else x.items) for x in row.e}


def test_front_matter(spark):
    page = "---\ntitle: \"A: b # c\"\ntags: [x, 'y', , \"z\"]\nweight: 10 # n\nratio: -1.5e3\nwhole: 1e5\ndraft: True\ndate: 2024-01-02\nkeywords:\n\n  # c\n  - one\n  - \"two\"\nbad line\n  - lost\nparams.x: 1\ntwo words: 1\n: no key\nempty:\ntitle: last\n---\nbody\n---\n"
    assert entries(spark, page) == {
        "title": ("string", "last"), "tags": ("array_string", ["x", "y", "z"]), "weight": ("integer", "10"), "ratio": ("number", "-1.5e3"), "whole": ("number", "1e5"), "draft": ("boolean", "True"),
        "date": ("date", "2024-01-02"), "keywords": ("array_string", ["one", "two"]), "empty": ("array_string", []),
    }
    assert entries(spark, "---\ntitle: \"A: b # c\"\n---\n") == {"title": ("string", '"A: b')}  # a comment begins before the quote ends
    assert entries(spark, "---\na: ''\nb: \"\nc: []\nd: '12'\ne: \"2024-05-06 x\"\n---\n") == {"a": ("string", ""), "b": ("string", ""), "c": ("array_string", []), "d": ("string", "12"), "e": ("date", "2024-05-06 x")}
    assert entries(spark, "no front matter") is None and entries(spark, None) is None
    one = spark.createDataFrame([(page,)], "content string").select(frontmatter.front_matter_value(F.col("content"), "weight").alias("w"), frontmatter.parsed(frontmatter.front_matter(F.col("content")))["bad"].alias("bad")).first()
    assert one.w.text == "10" and one.bad == ["bad line", "- lost", "params.x: 1", "two words: 1", ": no key"]


SCHEMA = {
    "$schema": "x", "type": "object", "required": ["a", "b"], "additionalProperties": False,
    "properties": {
        "a": {"type": "integer", "minimum": 3, "exclusiveMaximum": 9}, "b": {"type": ["string", "null"], "pattern": "^x", "minLength": 1, "maxLength": 3},
        "c": {"type": "array", "minItems": 1, "maxItems": 5, "items": {"type": "object", "required": ["k"], "properties": {"k": {"enum": ["u", "v", 1, None]}}}},
        "d": {"anyOf": [{"type": "string"}, {"type": "number", "multipleOf": 0.5}]}, "e": {"not": {"type": "null"}}, "odd name": {"const": True}, "f": {"allOf": [{"minimum": 1}, {"maximum": 2}]},
    },
}


def test_schema(spark):
    docs = [
        '{"a":1,"b":"xyzz"}', '{"a":3.0,"b":null}', '{"a":"s"}', "[1]", "nope", None, '{"a":5,"b":"x","c":[],"z":1}', '{"a":5,"b":"x","c":[{"k":"u"},{"k":"w"},{},7,{"k":null}],"d":0.3,"e":null}', '{"a":9,"b":"","d":1.5,"e":{}}',
        '{"a":4.5,"b":"x","odd name":false,"f":3,"c":{"k":1}}',
    ]
    rows = spark.createDataFrame(list(enumerate(docs)), "id int, j string")
    got = {}
    for r in schema.validate(rows, "j", SCHEMA).collect():
        got.setdefault(r.id, set()).add((r.path, r.keyword))
    assert got == {
        0: {("$.a", "minimum"), ("$.b", "maxLength")}, 2: {("$.a", "type"), ("$.b", "required")}, 3: {("$", "type")}, 4: {("$", "json")}, 6: {("$.c", "minItems"), ("$.z", "additionalProperties")},
        7: {("$.c[1].k", "enum"), ("$.c[2].k", "required"), ("$.c[3]", "type"), ("$.d", "anyOf"), ("$.e", "not")}, 8: {("$.a", "exclusiveMaximum"), ("$.b", "minLength"), ("$.b", "pattern")},
        9: {("$.a", "type"), ("$.odd name", "const"), ("$.f", "maximum"), ("$.c", "type")},
    }
    assert [r.id for r in schema.valid(rows, "j", SCHEMA).collect()] == [1]
    with pytest.raises(ValueError, match="dependentRequired"):
        schema.validate(rows, "j", {"dependentRequired": {}})


def test_additional_properties_by_schema(spark):
    rows = spark.createDataFrame([('{"a":1,"b":"x","c":[2]}',)], "j string")
    assert [(r.path, r.keyword) for r in schema.validate(rows, "j", {"properties": {"a": False}, "additionalProperties": {"type": "string"}}).collect()] == [("$.a", "false"), ("$.c", "type")]


def test_contracts(spark):
    page = lambda fields: "---\n" + fields + "\n---\n"
    pages = [("docs/a.md", page("title: x\nweight: 1")), ("docs/b.MD", page("title: y\nweight: z")), ("docs/c.md", page("title: 2\nweight: 2")), ("docs/d.md", "none"), ("docs/e.txt", page("other: 1")), ("blog/f.md", page("date: 2024-01-01"))]
    got = {(r.section, r.key): (r.type, r.n_pages, r.required) for r in plan.contracts(spark.createDataFrame(pages, "path string, content string"), {"docs": "docs/", "blog": "blog/"}).collect()}
    assert got == {("docs", "title"): ("string", 3, True), ("docs", "weight"): ("integer", 3, True), ("blog", "date"): ("date", 1, True)}


def test_urls_of_content(spark):
    cases = {
        "content/docs.x.org/cells/en/overview.md": "/cells/overview/", "content/docs.x.org/cells/fr/guide/A B!.md": "/fr/cells/guide/a-b/", "docs.x.org\\cells\\fr\\_index.md": "/fr/cells/",
        "content/docs.x.org/cells/en/dir/page/index.md": "/cells/dir/page/", "content/blog.x.org/cells/post/index.fr.md": "/fr/cells/post/", "content/blog.x.org/cells/post/index.md": "/cells/post/",
        "content/docs.x.org/cells/en/page.fr.md": "/cells/page/", "content/docs.x.org/cells/page.md": None, "content/docs.x.org": None, "content/docs.x.org/../en/page.md": None,
    }
    rows = spark.createDataFrame(list(cases.items()), "path string, want string")
    got = rows.select("path", state.url_of_content(F.col("path")).alias("u"), state.url_of_content(F.col("path"), default_in_folder=True).alias("v")).collect()
    assert {r.path: r.u for r in got} == cases
    assert {r.path: r.v for r in got}["content/docs.x.org/cells/en/overview.md"] == "/en/cells/overview/"


def test_scorers_by_name(spark):
    pairs = spark.createDataFrame([("same words here", "here same words"), ("one thing", "other matter")], "a string, b string")
    assert [r.similarity for r in evidence.score_pairs(pairs).collect()] == [1.0, 0.0] == [r.similarity for r in evidence.score_pairs(pairs, "jaccard").collect()]
    with pytest.raises(ValueError):
        evidence.score_pairs(pairs, "unknown")


def test_claims_of_groups_by_parts_of_keys(spark):
    import random

    rnd = random.Random(4)
    key = lambda n: "".join(rnd.choice("ab_") for _ in range(n))
    base = [key(rnd.randrange(1, 30)) for _ in range(40)]
    known = [(k[rnd.randrange(len(k)) :][: rnd.randrange(1, 14)] if n % 2 else k, n) for n, k in enumerate(base)] + [("", 99), (None, 98)]
    wanted = [k[rnd.randrange(len(k)) :][: rnd.randrange(1, 25)] for k in base[:20]] + base[20:25] + ["", "none"]
    got = plan.claims_of_groups(spark.createDataFrame([(w,) for w in wanted], "group_key string"), spark.createDataFrame(known, "key string, claim_id long")).collect()
    assert {(r.group_key, r.claim_id) for r in got} == {(w, c) for w in wanted for k, c in known if w and k and (w in k or k in w)} and len(got) == len(set(got))
