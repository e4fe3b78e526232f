from pyspark.sql import functions as F

from weftline.operators import checks, support


def one(spark, expression, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expression.alias("x")).first().x


def test_decisions(spark):
    c = F.col
    assert one(spark, support.backoff(c("a")), a=3) == 8.0 and one(spark, support.backoff(c("a")), a=30) == 60.0
    kinds = [("Timeout", ""), ("X", "error 429"), ("ValueError", "bad"), ("X", "schema mismatch"), ("X", "?")]
    assert [one(spark, support.failure_class(c("k"), c("m")), k=k, m=m) for k, m in kinds] == ["retry", "retry", "fail", "fail", "manual_intervention"]
    hosts = [one(spark, support.host_allowed(c("h"), ["a.org", "*.b.org", "c.org:80"]), h=h) for h in ("a.org", "a.org:8080", "x.b.org", "c.org", "c.org:80", "d.org")]
    assert hosts == [True, True, True, False, True, False]
    assert one(spark, support.branch_name(c("p"), c("r"), c("i")), p="tool", r="refs/heads/main", i="RUN-1-abcdefgh") == "launch/tool/main/abcdef"
    assert one(spark, support.path_tags(c("p"), c("t")), p="docs/Tutorial_convert.md", t="readme") == ["convert", "quickstart", "readme", "tutorial"]
    assert one(spark, support.description(c("v")), v="x = 1\n'''First\nmore'''") == "First"
    r = one(spark, support.positioning(c("v")), v="text\n# Name here\n\n## Sub\nThe description\n")
    assert (r.tagline, r.description) == ("Name here", "The description")
    assert one(spark, support.update_front_matter(c("v"), {"a": "2", "b": "3"}), v="---\na: 1\n---\nbody") == "---\na: 2\nb: 3\n---\nbody"


def test_sections_and_methods(spark):
    text = "# Licensing\ntrial version\n## Deeper\nproprietary\n# Other\ntrial version"
    lines = checks.lines_of(spark.createDataFrame([("p", text)], "slug string, content string"))
    assert [r.line for r in support.licensing_sections(lines).orderBy("line").collect()] == [2, 4]
    blocks = spark.createDataFrame([("p", 1, "s = Scene()\ns.load(1)\ns.fly()\nOther.x()")], "slug string, line long, code string")
    surface = spark.createDataFrame([("Scene", "load")], "class_name string, method string")
    assert [r.detail for r in support.unknown_methods(blocks, surface).collect()] == ["scene.fly"]
