"""Validation gates over pages, their scores, and the decision that follows.

A gate gives issue rows as the checks do; GATES is the registry of those that need lines alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import front_matter, strip
from .checks import _each, heading_skips, issue

#: What pages mustn't hold.
XSS = [
    ("blocker", "script", r"(?i)<script[^>]*>"), ("blocker", "handler", r"(?i)\bon(click|load|error|mouseover|submit|focus|blur|change|keyup|keydown)="),
    ("blocker", "javascript url", r"(?i)javascript:"), ("warn", "data url", r"(?i)data:text/html"),
    ("error", "unsafe tag", r"(?i)<(iframe|embed|object|applet|meta|base|link)[^>]*>"),
]
SECRETS = [
    ("AWS_ACCESS_KEY", r"AKIA[0-9A-Z]{16}"),
    ("AWS_SECRET_KEY", r"(?i)aws_secret_access_key\s*=\s*[\"']?[\w/+=]{40}[\"']?"),
    ("GENERIC_API_KEY", r"(?i)api[_-]?key\s*[=:]\s*[\"']?[a-zA-Z0-9_\-]{32,}[\"']?"),
    ("OPENAI_KEY", r"sk-[a-zA-Z0-9]{48}"),
    ("PASSWORD", r"(?i)password\s*[=:]\s*[\"']?[^\s\"']{8,}[\"']?"),
    ("PRIVATE_KEY", r"-----BEGIN (RSA |EC )?PRIVATE KEY-----"),
    ("GITHUB_TOKEN", r"ghp_[a-zA-Z0-9]{36}"),
    ("SLACK_TOKEN", r"xox[baprs]-[a-zA-Z0-9-]{10,}"),
    ("BEARER_TOKEN", r"(?i)bearer\s+[a-zA-Z0-9_\-\.]{20,}"),
    ("BASIC_AUTH", r"(?i)authorization:\s*basic\s+[a-zA-Z0-9+/=]{20,}"),
]
#: An extension: assignments of tokens.
TOKEN = ("TOKEN", r"(?i)token\s*[=:]\s*[\"']?[a-zA-Z0-9_\-]{20,}[\"']?")
SEVERITIES = ["blocker", "error", "warn", "info"]
DIMENSIONS = ["content_quality", "technical_accuracy", "usability"]
MAX_PAGE_BYTES = 500 * 1024


def xss(lines: DataFrame) -> DataFrame:
    found = _each(lines.where(~F.col("inside")), [(f"{s}|{n}", p) for s, n, p in XSS])
    return issue(found, "gate_s1_xss", F.substring_index("hit", "|", 1), F.col("line"), F.substring_index("hit", "|", -1))


def sensitive(lines: DataFrame, extended: bool = False) -> DataFrame:
    return issue(_each(lines.where(~F.col("inside")), SECRETS + [TOKEN] * extended), "gate_s2_sensitive", "blocker", F.col("line"), F.col("hit"))


def external_links(lines: DataFrame) -> DataFrame:
    plain = lines.where(~F.col("inside"))
    links = plain.withColumn("u", F.explode(F.regexp_extract_all("text", F.lit(r"\[[^\]]*\]\(([^)]+)\)"), F.lit(1))))
    images = plain.withColumn("u", F.explode(F.regexp_extract_all("text", F.lit(r"(?i)<img[^>]+src=[\"']([^\"']+)[\"']"), F.lit(1))))
    a = issue(links.where(F.col("u").startswith("http://")), "gate_s3_links", "error", F.col("line"), F.col("u"))
    b = issue(links.where(F.col("u").startswith("//")), "gate_s3_links", "warn", F.col("line"), F.col("u"))
    return a.union(b).union(issue(images.where(F.col("u").startswith("http://")), "gate_s3_links", "error", F.col("line"), F.col("u")))


def unresolved_tokens(lines: DataFrame) -> DataFrame:
    found = lines.where(~F.col("inside")).withColumn("token", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(__[A-Z][A-Z0-9_]*__)"), F.lit(1)))))
    return issue(found, "gate_11_tokens", "blocker", F.col("line"), F.col("token"))


def conflict_markers(lines: DataFrame) -> DataFrame:
    return issue(lines.where(F.col("text").rlike("^(<{7}|={7}|>{7})")), "gate_12_conflicts", "blocker", F.col("line"), F.substring("text", 1, 7))


def accessibility(lines: DataFrame) -> DataFrame:
    alt = lines.where(F.col("text").rlike(r"!\[\s*\]\("))
    return heading_skips(lines, "gate_6_accessibility", "warn").union(issue(alt, "gate_6_accessibility", "warn", F.col("line"), "no alt text"))


def required_front_matter(pages: DataFrame) -> DataFrame:
    own = pages.withColumn("b", front_matter(F.col("content")))
    lacks = F.filter(F.array(*[F.when(~F.coalesce(F.col("b").rlike(f"(?m)^{f}:"), F.lit(False)), F.lit(f)) for f in ("title", "layout", "permalink")]), lambda x: x.isNotNull())
    return issue(own.withColumn("f", F.explode(lacks)), "gate_4_front_matter", "error", F.lit(1), F.col("f"))


def content_length(pages: DataFrame) -> DataFrame:
    rest = F.length(strip(F.regexp_replace("content", r"(?s)^---\s*\n.*?\n---\s*\n", "")))
    short = issue(pages.where(rest < 100), "gate_7_quality", "warn", F.lit(1), "short")
    return short.union(issue(pages.where(F.lower("content").contains("lorem ipsum")), "gate_7_quality", "error", F.lit(1), "lorem ipsum"))


def page_size(pages: DataFrame, most: int = MAX_PAGE_BYTES) -> DataFrame:
    return issue(pages.where(F.octet_length("content") > most), "gate_p1_size", "error", F.lit(1), F.octet_length("content").cast("string"))


def malformed_json(rows: DataFrame) -> DataFrame:
    """Rows (slug, content) that aren't JSON."""
    return issue(rows.where(F.try_parse_json("content").isNull()), "gate_1_schema", "blocker", F.lit(1), "not JSON")


def images(refs: DataFrame, files: DataFrame, most: int = 200 * 1024) -> DataFrame:
    """refs (slug, line, path) against files (path, size): missing, large, or not of the lean format."""
    met = refs.join(files, "path", "left")
    missing = issue(met.where("size is null"), "gate_p2_images", "error", F.col("line"), F.col("path"))
    large = issue(met.where(F.col("size") > most), "gate_p2_images", "warn", F.col("line"), F.col("path"))
    return missing.union(large).union(issue(met.where("size is not null").where(~F.lower("path").endswith(".webp")), "gate_p2_images", "info", F.col("line"), F.col("path")))


def build_time(events: DataFrame, most_s: float = 60.0) -> DataFrame:
    """Runs whose last build took longer: run_id, seconds."""
    at = lambda kind: F.max(F.when(F.col("type") == kind, F.col("ts")))
    found = events.groupBy("run_id").agg(at("BUILD_STARTED").alias("a"), at("BUILD_COMPLETED").alias("b"))
    return found.select("run_id", (F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))).alias("us")).where(F.col("us") > most_s * 1e6).select("run_id", (F.col("us") / 1e6).alias("seconds"))


def outside_globs(files: DataFrame, globs: list[str]) -> DataFrame:
    """Changed files that no allowed pattern covers."""
    from ..functions.text import glob_to_regex

    return files.where(~F.col("path").rlike("|".join(map(glob_to_regex, globs)) or "^$")).select("path")


GATES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "gate_s1_xss": xss, "gate_s2_sensitive": sensitive, "gate_s3_links": external_links, "gate_11_tokens": unresolved_tokens,
    "gate_12_conflicts": conflict_markers, "gate_6_accessibility": accessibility,
}


def all_gates(lines: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [g(lines) for g in GATES.values()])


def roll_up(spark, issues: DataFrame, gates: list[str] | None = None) -> DataFrame:
    """A row per gate, also without issues: ok unless a blocker or error stands."""
    names = spark.createDataFrame([(g,) for g in gates or GATES], "check string")
    own = issues.groupBy("check").agg(F.count("*").alias("n_issues"), F.count_if(F.col("severity").isin("blocker", "error")).alias("n_bad"))
    return names.join(own, "check", "left").select("check", F.coalesce("n_issues", F.lit(0)).alias("n_issues"), (F.coalesce("n_bad", F.lit(0)) == 0).alias("ok"))


def by_profile(issues: DataFrame, profile: str) -> DataFrame:
    """Severities as the profile has them: local softens errors to warnings, prod hardens warnings."""
    severity = {"local": F.when(F.col("severity") == "error", "warn").otherwise(F.col("severity")), "prod": F.when(F.col("severity") == "warn", "error").otherwise(F.col("severity"))}
    return issues.withColumn("severity", severity.get(profile, F.col("severity")))


# --------------------------------------------------------------------------------------------- scores


def severity_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), c)


def ordered(issues: DataFrame) -> DataFrame:
    return issues.orderBy(severity_rank(F.col("severity")), "check", "slug", "line", "detail")


def next_fix(issues: DataFrame) -> DataFrame:
    """The first open blocker or error."""
    return ordered(issues.where(F.col("severity").isin("blocker", "error"))).limit(1)


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES])


def pages_pass_fail(issues: DataFrame) -> DataFrame:
    per = issues.groupBy("slug").agg(F.max(F.col("severity").isin("blocker", "error")).alias("bad"))
    return per.agg(F.count_if(~F.col("bad")).alias("pages_passed"), F.count_if("bad").alias("pages_failed"))


def dimension_scores(spark, issues: DataFrame) -> DataFrame:
    """Each dimension's score from 1 (blockers) to 5 (nothing found)."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    own = issues.groupBy(F.substring_index("check", ".", 1).alias("dimension")).agg(n("blocker"), n("error"), n("warn"), F.count("*").alias("n"), F.count_if("auto_fixable").alias("fixable"))
    score = (
        F.when(F.col("n").isNull(), 5).when(F.col("blocker") > 0, 1).when(F.col("error") >= 3, 2).when(F.col("warn") > 6, 2).when(F.col("error") >= 1, 3)
        .when(F.col("warn") >= 4, 3).when(F.col("warn") >= 1, F.when(F.col("fixable") == F.col("n"), 4).otherwise(3)).otherwise(5)
    )
    return spark.createDataFrame([(d,) for d in DIMENSIONS], "dimension string").join(own, "dimension", "left").select("dimension", score.alias("score"))


def route(scores: DataFrame, issues: DataFrame) -> DataFrame:
    """REJECT, NEEDS_CHANGES or PASS, one row."""
    s = scores.agg(F.min("score").alias("low"), F.max((F.col("score") == 3).cast("int")).alias("three"))
    n = issues.agg(
        F.count_if(F.col("severity") == "blocker").alias("b"), F.count_if((F.col("severity") == "error") & ~F.col("auto_fixable")).alias("e"),
        (F.count_if(F.col("severity") == "warn") / F.greatest(F.lit(1), F.count_distinct("slug"))).alias("w"),
    )
    reject = (F.col("b") > 0) | (F.col("low") <= 2) | (F.col("e") >= 3) | (F.col("w") > 10)
    change = (F.col("three") == 1) | (F.col("e") >= 1) | (F.col("w") >= 5)
    return s.join(F.broadcast(n)).select(F.when(reject, "REJECT").when(change, "NEEDS_CHANGES").otherwise("PASS").alias("route"))


def worst_per_page(issues: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("slug").orderBy(severity_rank(F.col("severity")), "check", "line", "detail")
    return issues.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k)
