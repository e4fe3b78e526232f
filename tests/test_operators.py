"""Operators on small literal inputs, for what the supplied tables don't show."""

import json
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import checks, claims, events, evidence, files, gates, links, telemetry
from weftline.sources import events as sources


def column(spark, values, expression, schema="v string"):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, {schema}")
    return [r.x for r in frame.select("k", expression(F.col("v")).alias("x")).orderBy("k").collect()]


def test_tokens_are_unicode(spark):
    assert column(spark, ["Größe der Tür, and its ends_1", "", None], T.tokens) == [["größe", "der", "tür", "ends_1"], [], None]


def test_slug_paths_and_globs(spark):
    assert column(spark, ["Héllo, World_Page!", "  --a  b-- "], T.slug) == ["hello-world-page", "a-b"]
    frame = spark.createDataFrame([("docs/a/b.md", "../c.md#x", "docs/c.md"), ("a.md", "/x/./y", "x/y"), ("a/b.md", "../../z", "z")], "base string, target string, want string")
    assert all(r.got == r.want for r in frame.select("want", T.resolve_path(F.col("base"), F.col("target")).alias("got")).collect())
    assert column(spark, ["src/app.pyc", "build/x.txt", "a/build/x", "docs/a.md"], lambda c: T.ignored_by(c, ["# c", "*.pyc", "build/", "!keep"])) == [True, True, True, False]
    assert column(spark, ["a/docs/x.md", "docs/x.md", "x.md"], lambda c: T.ignored_by(c, ["docs/*.md"])) == [True, True, False]


@pytest.mark.parametrize(("text", "kind"), [
    ("This does not support X", "limitation"), ("How to begin", "workflow"), ("A class for shapes", "api"), ("The method of file type reads", "format"),
    ("It provides speed", "feature"), ("It provides a format", "format"), ("Export a module", "feature"), ("Import models", "format"), ("many formats", "feature"), ("Plain", "feature"),
])
def test_claim_kind(spark, text, kind):
    assert column(spark, [text], claims.claim_kind) == [kind]


def test_source_types(spark):
    paths = ["pyproject.toml", "src/a.py", "src/test_a.py", "docs/architecture.md", "docs/api.md", "README.md"]
    kinds = column(spark, paths, claims.source_type)
    assert kinds == ["manifest", "source_code", "test", "implementation_doc", "api_doc", "readme_technical"]
    assert column(spark, [*kinds, "none"], claims.source_priority) == [1, 2, 3, 4, 5, 6, 7]


def test_statements_follow_lines(spark):
    text = "# A heading.\nFirst part\n\nends here.\nTwo: \nTail without end"
    got = claims.statements(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("n").collect()
    assert [(r.claim_text, r.start_line, r.end_line) for r in got] == [("First part ends here.", 1, 4), ("Two:", 5, 5)]


def test_merge_keeps_first_and_best(spark):
    rows = [("c", "b text", "feature", "inference", "low", 5, 2, "p2"), ("c", "a text", "feature", "fact", "medium", 3, 1, "p1")]
    r = claims.merge_claims(spark.createDataFrame(rows, "claim_id string, claim_text string, claim_kind string, truth_status string, confidence string, source_priority int, ord int, citation string")).first()
    assert (r.claim_text, r.truth_status, r.confidence, r.source_priority, r.citations) == ("a text", "fact", "medium", 3, ["p1", "p2"])


def test_contradictions_resolve_by_priority(spark):
    rows = [("a", "Supports OBJ format in full", 1), ("b", "Does not support OBJ format in full", 5), ("c", "No support for OBJ format in full", 2), ("d", "unrelated words entirely here", 1)]
    frame = spark.createDataFrame(rows, "claim_id string, claim_text string, source_priority int").withColumn("truth_status", F.lit("fact")).withColumn("confidence", F.lit("high"))
    found = claims.contradictions(frame)
    assert sorted((r.claim_a_id, r.claim_b_id, r.resolution, r.winning_claim_id) for r in found.collect()) == [("a", "b", "prefer_higher_priority", "a"), ("a", "c", "manual_review_required", "a")]
    after = {r.claim_id: r.confidence for r in claims.downgrade_losers(frame, found).collect()}
    assert after == {"a": "high", "b": "low", "c": "high", "d": "high"}


def test_evidence_thresholds_and_limit(spark):
    docs = spark.createDataFrame([(k, "alpha beta gamma" if k < 25 else "nothing shared", 7) for k in range(30)], "doc_id long, text string, priority int")
    one = spark.createDataFrame([(1, "alpha beta delta", "feature")], "claim_id long, claim_text string, claim_kind string")
    got = evidence.evidence_topk(one, docs, k=20).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(20))
    assert abs(got[0].score - (0.3 / 7 + 0.4 * 2 / 4 + 0.3 * 2 / 4)) < 1e-9
    pairs = spark.createDataFrame([("same words here", "here same words"), ("one thing", "other matter"), ("", "x")], "a string, b string")
    assert [r.tfidf for r in evidence.pair_similarity(pairs).collect()] == [1.0, 0.0, 0.0]


def page(spark, content, slug="page"):
    return spark.createDataFrame([(slug, content)], "slug string, content string")


def found(df):
    return sorted((r.check.split(".")[-1], r.line, r.detail) for r in df.collect())


def test_checks_on_a_page(spark):
    content = "# One\n### Three\n" + "\n".join("plain line" for _ in range(11)) + "\n- bullet\n" + "\n".join("tail" for _ in range(12))
    lines = checks.lines_of(page(spark, content))
    assert found(checks.heading_skips(lines)) == [("heading_hierarchy", 2, "1 to 3")]
    assert found(checks.paragraphs(lines)) == [("paragraph_structure", 3, "long paragraph: 11")]  # the run to the end stays open
    fenced = checks.lines_of(page(spark, "text\n```\n# not a heading __TOKEN__\n```\n__REAL__ http"))
    assert found(gates.unresolved_tokens(fenced)) == [("gate_11_tokens", 5, "__REAL__")]


def test_navigation_and_anti_joins(spark):
    plan = spark.createDataFrame([("index", "/a/"), ("x", "/a/x/"), ("y", "/a/y/"), ("z", "/b/z/")], "slug string, url_path string")
    assert found(checks.navigation(page(spark, "see x", "index"), plan)) == [("navigation_clarity", 1, "y")]
    files_ = spark.createDataFrame([("docs/a.md",), ("docs/sub/_index.md",)], "path string")
    refs = spark.createDataFrame([("docs/a.md", 1, "sub"), ("docs/a.md", 2, "b.md"), ("docs/a.md", 3, "../docs/a.md")], "file string, line int, target string")
    assert [r.path for r in links.phantom_paths(refs, files_).collect()] == ["docs/b.md"]
    rel = spark.createDataFrame([("p", 1, "docs/sub/"), ("p", 2, "docs/gone")], "slug string, line long, target string")
    assert [r.target for r in links.broken_links(rel, files_).collect()] == ["docs/gone"]


def test_snippets(spark):
    codes = ["", "x", "a = 1\nb = 2", "# c\n# d\n# e\nx\ny = 1\n#"]
    assert column(spark, codes, files.snippet_quality) == ["empty_code", "too_short", None, None]
    assert column(spark, ["a = 1", "a ="], files.python_parses) == [True, False]
    assert column(spark, ["f {\n{ }\n}", "{"], files.closing_brace) == [3, 0]
    surface = column(spark, ["class A: pass\ndef f(): pass\nMAX = 1\nmin_ = 2"], files.python_surface)[0]
    assert (surface.classes, surface.functions, surface.constants) == (["A"], ["f"], ["MAX"])
    assert column(spark, ["Python3", "py", "rust2021", ""], files.normalize_language) == ["python", "python", "rust", "text"]


def test_diffs_and_patches(spark):
    changes = spark.createDataFrame([("a", "1\n2\n3", "1\n2x\n3\n4"), ("b", "x  y\r\n", "x y\n")], "path string, original string, modified string")
    assert sorted((r.path, r.added, r.deleted) for r in files.diff_lines(changes).collect()) == [("a", 2, 1), ("b", 1, 1)]
    r = files.diff_budget(changes, 5, 2).first()
    assert (r.n_files, r.n_over, r.n_form_only, r.ok) == (2, 1, 1, False)


def test_snippets_by_tags_makes_pairs_once(spark):
    wanted = spark.createDataFrame([(1, ["x", "y", "x"]), (2, ["y"]), (2, ["z"]), (3, [None, "w"]), (4, []), (None, ["x"])], "page int, tags array<string>")
    held = spark.createDataFrame([("s", 1, ["x", "y", "z"]), ("t", 2, ["z", None]), ("u", 3, ["v"])], "snippet_id string, ord int, tags array<string>")
    found = links.snippets_by_tags(wanted, held)
    assert sorted((r.page or 0, r.snippet_id, r.ord) for r in found.collect()) == [(0, "s", 1), (1, "s", 1), (2, "s", 1), (2, "t", 2)]
    joined = found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in joined  # no pair of members is made distinct afterwards


def test_snippets_by_tags_of_large_classes(spark):
    """Classes of more members than a block holds, a page and a snippet without an id among them: pairs come from loops over blocks,
    above the last join, so that no join makes a row of each."""
    wanted = spark.range(700).select(F.when(F.col("id") != 650, F.col("id")).alias("page"), F.array(F.when(F.col("id") < 600, "x").otherwise("y"), F.lit("z")).alias("tags"))
    held = spark.range(800).select(F.when(F.col("id") != 7, F.col("id")).alias("snippet_id"), F.col("id").alias("ord"), F.array(F.when(F.col("id") < 500, "x").otherwise("y")).alias("tags"))
    found = links.snippets_by_tags(wanted, held)
    assert found.columns == ["page", "snippet_id", "ord"]
    r = found.agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("page", F.lit(-1)), "ord").alias("n_distinct"), F.count_if(F.col("page").isNull()).alias("n_null"), F.count_if(F.col("snippet_id").isNull()).alias("n_open"), F.count_if((F.coalesce("page", F.lit(650)) < 600) != (F.col("ord") < 500)).alias("n_wrong")).first()
    assert tuple(r) == (600 * 500 + 100 * 300, 600 * 500 + 100 * 300, 300, 600, 0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Join")


def test_schema_vote_ties_by_name(spark):
    rows = [("s", 1, "a", "1"), ("s", 2, "a", "x"), ("s", 1, "b", "true")]
    got = {r.key: (r.type, r.required) for r in files.schema_vote(spark.createDataFrame(rows, "section string, doc int, key string, value string")).collect()}
    assert got == {"a": ("integer", True), "b": ("boolean", False)}


def test_fingerprint_depends_on_content_alone(spark):
    rows = [(f"p{k}", f"c{k}") for k in range(50)]
    one = files.tree_fingerprint(spark.createDataFrame(rows, "path string, content string")).first()
    two = files.tree_fingerprint(spark.createDataFrame(rows[::-1], "path string, content string").repartition(7)).first()
    other = files.tree_fingerprint(spark.createDataFrame([*rows[1:], ("p0", "c")], "path string, content string")).first()
    assert one == two != other
    assert files.tree_fingerprint(spark.createDataFrame([], "path string, content string")).first().fingerprint == "0" * 64


def test_repairs(spark):
    fixes = files.repairs("Acme", "https://github.com/acme/tool")
    assert set(len(column(spark, ["text"], f)) for f in fixes.values()) == {1}
    assert column(spark, ["see [claim: ab-12] ok"], fixes["claim_markers"]) == ["see <!-- claim_id: ab-12 --> ok"]
    assert column(spark, ["![ ](img/my-pic.png)"], fixes["alt_text"]) == ["![my-pic](img/my-pic.png)"]
    assert column(spark, ["[a](./x-y.md)"], fixes["link_normalization"]) == ["[a](/docs/x-y/)"]
    assert column(spark, ["---\n# note\ntitle: t\n---\nbody\n# Head"], fixes["frontmatter_comments"]) == ["---\ntitle: t\n---\nbody\n# Head"]
    assert column(spark, ["keep\nTODO this\nkeep"], fixes["placeholder_content"]) == ["keep\nkeep"]
    lines = checks.lines_of(page(spark, "# a\n#### b"))
    assert files.heading_levels(lines).first().content == "# a\n## b"
    assert column(spark, ["# A\nx"], lambda c: files.insert_at_anchor(c, "A", "new")) == ["# A\n\nnew\n\nx"]
    with pytest.raises(Exception, match="no heading"):
        column(spark, ["x"], lambda c: files.insert_at_anchor(c, "A", "new"))
    assert column(spark, ["1\n2\n3\n4"], lambda c: files.replace_lines(c, 2, 3, "n")) == ["1\nn\n4"]


def test_redaction_leaves_no_secret(spark):
    secret = "AKIA" + "A" * 16
    out = column(spark, [f"x {secret} password: hunter2hunter2 y"], files.redact)[0]
    assert secret not in out and "hunter2" not in out and out.count("[REDACTED:") == 2


def test_scores_and_route(spark):
    def rows(*severities, fixable=False):
        return spark.createDataFrame([("usability.x", s, f"p{k}", 1, "", fixable) for k, s in enumerate(severities)], "check string, severity string, slug string, line long, detail string, auto_fixable boolean")

    def score(df):
        return {r.dimension: r.score for r in gates.dimension_scores(spark, df).collect()}["usability"]

    assert [score(rows(*x)) for x in ((), ("blocker",), ("error",) * 3, ("warn",) * 7, ("error",), ("warn",) * 4, ("warn",))] == [5, 1, 2, 2, 3, 3, 3]
    assert score(rows("warn", fixable=True)) == 4
    for issues, want in ((rows(), "PASS"), (rows("warn", fixable=True), "PASS"), (rows("error"), "NEEDS_CHANGES"), (rows("blocker"), "REJECT")):
        assert gates.route(gates.dimension_scores(spark, issues), issues).first().route == want


def test_replay_folds_work_items(spark):
    rows = [("r", k, f"e{k}", str(k), t, json.dumps(p)) for k, (t, p) in enumerate([
        ("WORK_ITEM_QUEUED", {"work_item_id": "w"}), ("WORK_ITEM_STARTED", {"work_item_id": "w"}), ("WORK_ITEM_STARTED", {"work_item_id": "unknown"}),
        ("ARTIFACT_WRITTEN", {"name": "a", "path": "1"}), ("ARTIFACT_WRITTEN", {"name": "a", "path": "2"}), ("RUN_STATE_CHANGED", {"new_state": "DONE"}), ("WORK_ITEM_FINISHED", {"work_item_id": "w"}),
    ])]
    r = events.replay(spark.createDataFrame(rows, "run_id string, ord long, event_id string, ts string, type string, payload string")).first()
    assert r.run_state == "DONE" and r.artifacts["a"].path == "2" and r.n_events == 7
    assert [(w.id, w.status) for w in r.work_items] == [("w", "finished")]


def test_event_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    frame = spark.createDataFrame([("e1", "r", "t1", "A", '{"b":1,"a":2}'), ("e2", "r", "t2", "B", "{}")], "event_id string, run_id string, ts string, type string, payload string").coalesce(1)
    sources.append_events(frame, path)
    got = sources.read_events(spark, path).orderBy("ord").collect()
    assert [(r.ord, r.event_id, r.type) for r in got] == [(1, "e1", "A"), (2, "e2", "B")]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.txt").write_text('{"event_id":"e1","run_id":"r","ts":"t","type":"A"}\n\nnot json\n')
    assert sources.read_events(spark, str(tmp_path / "bad"), tolerant=True).count() == 1
    with pytest.raises(Exception, match="malformed"):
        sources.read_events(spark, str(tmp_path / "bad")).collect()


def test_artifacts_and_files(spark, tmp_path):
    path = str(tmp_path / "artifact")
    stamp = sources.write_artifact(spark.createDataFrame([("n", 1)], "name string, size int"), path).first()
    assert re.fullmatch("[0-9a-f]{64}", stamp.sha256)
    assert sources.load_artifact(spark, path, "name string, size int", ["name"]).first().name == "n"
    assert sources.load_artifact_or_default(spark, str(tmp_path / "none"), "a int", [(1,)]).first().a == 1
    (tmp_path / "tree/sub").mkdir(parents=True)
    (tmp_path / "tree/a.txt").write_text("x")
    (tmp_path / "tree/sub/b.txt").write_text("yy")
    got = sources.manifest(sources.scan_files(spark, str(tmp_path / "tree"))).collect()
    assert [(r.path, r.size, r.n_files, r.n_bytes) for r in got] == [("a.txt", 1, 2, 3), ("sub/b.txt", 2, 2, 3)]
    assert sources.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}
    assert sources.package_manifest('[project]\nname = "n"\ndependencies = ["b", "a"]\n', "toml")["dependencies"] == ["a", "b"]


def test_patch_ignores_nulls_and_batches(spark):
    runs = spark.createDataFrame([(1, "a"), (2, "b")], "event_id long, status string")
    patched = telemetry.patch_runs(runs, spark.createDataFrame([(1, None), (2, "c")], "event_id long, status string"), F.current_timestamp())
    assert sorted((r.event_id, r.status, r.updated_at is not None) for r in patched.collect()) == [(1, "a", True), (2, "c", True)]
    more = spark.createDataFrame([(2, "x", 1), (3, "y", 2), (3, "z", 3), (None, "w", 4)], "event_id long, status string, ord int")
    table, counts = telemetry.batch_upload(runs, more)
    assert sorted((r.event_id, r.status) for r in table.collect()) == [(1, "a"), (2, "b"), (3, "y")]
    assert tuple(counts.first()) == (1, 2, 1)
    assert telemetry.batch_upload_transactional(runs, more).count() == 2
    with pytest.raises(ValueError, match="limit"):
        telemetry.page_of_runs(runs, 0)


def test_word_boundaries_are_those_of_ascii(spark):
    """As the SQL's engine reads them: a letter beyond ASCII ends a word."""
    lines = checks.lines_of(spark.createDataFrame([("p", "vu éan an jour\nthe theé, todoé: fixme\nthethe the")], "slug string, content string"))
    assert [(r.line, r.detail) for r in checks.grammar(lines).orderBy("line").collect()] == [(1, "repeated word"), (2, "repeated word")]
    assert [(r.line, r.detail) for r in checks.completeness(lines).orderBy("detail").collect()] == [(2, "0"), (2, "2")]


def test_logs_of_many_runs_share_files(spark, tmp_path):
    rows = [(f"e{r}-{k}", f"r{r}" if r else None, "2024-01-01", "T", "{}", k) for r in range(300) for k in range(r % 4 + 1)]
    own = spark.createDataFrame(rows, "event_id string, run_id string, ts string, type string, payload string, ord int")
    sources.append_events(own, str(tmp_path / "log"), together=("run_id", "ord"))
    assert len(list((tmp_path / "log").glob("**/part-*"))) < 50
    found = sources.read_events(spark, str(tmp_path / "log"), by="run_id")
    assert sorted((r.event_id, r.ord) for r in found.collect()) == sorted((r[0], r[5] + 1) for r in rows)
