"""The page plan against the pages: content distribution, sections, audiences, reports, requests for review.

A plan is (section, slug, page_role, output_path, claims, child_pages, forbidden, coverage, min_claims, max_claims);
pages are (output_path, content).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_in
from .links import mandatory_missing, reused_claims
from .state import SECTIONS

#: Words that tell for whom a claim is.
BEGINNER = ["install", "setup", "getting started", "quick start", "introduction"]
ADVANCED = ["custom", "optimize", "performance", "advanced", "extend"]


PROFILES = ["local", "ci", "prod"]
#: The severity of each finding under the profiles, in their order.
SEVERITY_OF = {
    "ROLE_MISSING": ("warn", "warn", "error"),
    "TOC_HAS_SNIPPETS": ("warn", "error", "blocker"),
    "TOC_MISSING_CHILDREN": ("warn", "error", "error"),
    "GUIDE_COVERAGE_INVALID": ("warn", "error", "error"),
    "GUIDE_INCOMPLETE": ("warn", "error", "error"),
    "CLAIM_QUOTA_UNDERFLOW": ("warn", "warn", "warn"),
    "CLAIM_QUOTA_EXCEEDED": ("warn", "warn", "error"),
    "FORBIDDEN_TOPIC": ("error", "error", "error"),
    "CLAIM_CROSS_SECTION": ("warn", "warn", "warn"),
    "MANDATORY_PAGE_MISSING": ("warn", "error", "error"),
}
#: What a page of a role is about, the topics it leaves out, and the claims it takes at least and at most; the
#: least of a guide is the number of workflows. A role with a section counts there alone; other pages get the last row.
STRATEGIES = [
    ("landing", "products", "Product positioning", ["detailed_api", "troubleshooting"], 5, 10),
    ("toc", None, "Navigation hub", ["duplicate_child_content", "code_snippets"], 0, 2),
    ("comprehensive_guide", None, "All usage scenarios", ["installation", "troubleshooting"], None, 50),
    ("workflow_page", None, "How-to guide", ["other_workflows"], 3, 8),
    ("feature_showcase", None, "Prominent feature how-to", ["general_features", "api_reference", "other_features"], 3, 8),
    ("troubleshooting", None, "Problem-solution", ["features", "installation"], 1, 5),
    ("landing", "blog", "Synthesized overview", [], 10, 20),
]


def distribution(plan: DataFrame, pages: DataFrame, n_workflows: int, required: DataFrame, profile: str = "local") -> DataFrame:
    """code, severity, section, slug, detail of everything in which the pages depart from the plan's distribution of content:
    roles missing; contents pages with code or without some of their children; guides that leave workflows out; claims
    under or over the quota; forbidden topics in headings; claims of several sections; mandatory pages (required:
    section, slug) that the plan lacks."""

    level = PROFILES.index(profile)

    def found(rows: DataFrame, code: str, detail: Column | None = None) -> DataFrame:
        return rows.select(F.lit(code).alias("code"), F.lit(SEVERITY_OF[code][level]).alias("severity"), "section", "slug", (F.lit("") if detail is None else detail).alias("detail"))

    n = F.coalesce(F.array_size("claims"), F.lit(0))
    drafts = plan.join(pages, "output_path")
    contents = drafts.where("page_role = 'toc'")
    word = lambda c: F.concat(F.lit(r"\b\Q"), c, F.lit(r"\E\b"))
    lost = F.filter("child_pages", lambda c: ~F.rlike(F.col("content"), word(c)))
    guides = plan.where("page_role = 'comprehensive_guide'").where(F.lit(n_workflows > 0))
    headings = F.lower(F.array_join(F.regexp_extract_all("content", F.lit(r"(?m)^#{1,6}[ \t]+(.+)$"), F.lit(1)), " "))
    topics = drafts.withColumn("headings", headings).select("section", "slug", "headings", F.explode("forbidden").alias("topic"))
    used = plan.select(F.explode("claims").alias("claim_id"), "section").distinct()
    parts = [
        found(plan.where("page_role is null"), "ROLE_MISSING"),
        found(contents.where(F.contains("content", F.lit("```"))), "TOC_HAS_SNIPPETS"),
        found(contents.withColumn("lost", lost).where(F.size("lost") > 0), "TOC_MISSING_CHILDREN", F.array_join("lost", ", ")),
        found(guides.where(~F.coalesce(F.col("coverage") == "all", F.lit(False))), "GUIDE_COVERAGE_INVALID"),
        found(guides.where(n < n_workflows), "GUIDE_INCOMPLETE", n.cast("string")),
        found(plan.where(n < F.coalesce("min_claims", F.lit(0))), "CLAIM_QUOTA_UNDERFLOW", n.cast("string")),
        found(plan.where(n > F.coalesce("max_claims", F.lit(999))), "CLAIM_QUOTA_EXCEEDED", n.cast("string")),
        found(topics.where(F.contains("headings", F.replace(F.lower("topic"), F.lit("_"), F.lit(" ")))), "FORBIDDEN_TOPIC", F.col("topic")),
        found(reused_claims(used).withColumn("section", F.lit("")).withColumnRenamed("claim_id", "slug"), "CLAIM_CROSS_SECTION", F.col("n_sections").cast("string")),
        found(mandatory_missing(required, plan.select("section", "slug")), "MANDATORY_PAGE_MISSING"),
    ]
    return reduce(DataFrame.unionByName, parts)


def section_of(path: Column, roots: dict[str, str] | None = None) -> Column:
    """The section whose root the path begins with, else the one that a folder or a site's name in it shows; or null."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    out = F.when(F.lit(False), F.lit(""))
    for name, root in sorted((roots or {}).items()):
        out = out.when(p.startswith(root.replace("\\", "/").lower()), name)
    for name in SECTIONS:
        out = out.when(p.contains(f"/{name}/") | p.rlike(rf"(^|/){name}\.[a-z0-9-]+\."), name)
    return out


def audience_level(text: Column) -> Column:
    t = F.lower(text)
    return F.when(any_in(t, BEGINNER), "beginner").when(any_in(t, ADVANCED), "advanced").otherwise("intermediate")


def enriched(claims: DataFrame) -> DataFrame:
    """claims (claim_text) with what is said of them without a model: audience level, complexity, prerequisites, use
    cases, popularity of the target."""
    from .claims import complexity

    none = F.array().cast("array<string>")
    return claims.withColumns({"audience_level": audience_level(F.col("claim_text")), "complexity": complexity(F.col("claim_text")), "prerequisites": none, "use_cases": none, "target_persona": F.lit("developers")})


#: Keys meet by their first so many characters, so a key of n characters has at most GRAM * n parts.
GRAM = 8


def claims_of_groups(wanted: DataFrame, groups: DataFrame) -> DataFrame:
    """wanted (group_key) with the claims of every group (key, claim_id) whose key holds it or is held by it: both ways the
    beginning of the shorter key meets parts of that length of the longer one by equality, and only these are compared."""

    def parts(c: str) -> Column:
        at = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length(c) - i + 1)), lambda n: F.substring(F.col(c), i, n))
        return F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), at))))

    begin = lambda c: F.substring(c, 1, GRAM)
    known = groups.where(F.length("key") > 0).select("key", "claim_id")
    asked = wanted.where(F.length("group_key") > 0).select("group_key").distinct()
    inner = asked.select("group_key", parts("group_key").alias("part")).join(known.withColumn("part", begin("key")), "part").where(F.contains("group_key", "key"))
    outer = known.select("key", "claim_id", parts("key").alias("part")).join(asked.withColumn("part", begin("group_key")), "part").where(F.contains("key", "group_key"))
    return inner.select("group_key", "claim_id").union(outer.select("group_key", "claim_id")).distinct()


def relative_locations(issues: DataFrame, folder: str) -> DataFrame:
    """issues with path relative to a run's folder, so that reports of different runs compare."""
    base = folder.rstrip("/") + "/"
    plain = F.replace("path", F.lit("\\"), F.lit("/"))
    return issues.withColumn("path", F.when(plain.startswith(base), F.substring(plain, len(base) + 1, 1 << 30)).otherwise(F.col("path")))


def request_blockers(requests: DataFrame) -> DataFrame:
    """requests (run_id, emergency, manual_edits, body): those in emergency mode with manual edits whose text says neither."""
    told = any_in(F.lower(F.coalesce("body", F.lit(""))), ["emergency mode", "manual edit"])
    return requests.where(F.col("emergency") & F.col("manual_edits") & ~told).select("run_id", F.lit("PR_MISSING_EMERGENCY_MODE_NOTICE").alias("code"), F.lit("blocker").alias("severity"))


def affected_paths(patches: DataFrame) -> DataFrame:
    """The distinct paths of a bundle of patches, in order."""
    return patches.select("path").where("path is not null").distinct().orderBy("path")


def newest(rows: DataFrame, at: str, n: int | None = None, key: str = "run_id") -> DataFrame:
    """Rows by time, newest first (ties by key), the first n where asked for: listings of runs and golden records."""
    ordered = rows.orderBy(F.desc(at), key)
    return ordered if n is None else ordered.limit(n)


def reports_index(reports: DataFrame) -> DataFrame:
    """reports (path agents/<agent>/<task>/report.md or self_review.md, content): agent, task, tests run and passed,
    score, in order."""
    parts = F.split("path", "/")
    own = reports.select(F.get(parts, F.size(parts) - 3).alias("agent"), F.get(parts, F.size(parts) - 2).alias("task"), F.get(parts, F.size(parts) - 1).alias("name"), "content").where("task like 'TC-%'")
    number = lambda p: F.try_to_number(F.nullif(F.regexp_extract("content", p, 1), F.lit("")), F.lit("999999")).cast("long")
    report = F.col("name") == "report.md"
    passed, score = number(r"(?i)(\d+)\s+passed"), F.regexp_extract("content", r"(?i)score[^\d]{0,20}(\d+(?:\.\d+)?)\s*/\s*5", 1)
    out = own.groupBy("agent", "task").agg(F.max(F.when(report, passed)).alias("n_passed"), F.max(F.when(report, number(r"(?i)(\d+)\s+failed"))).alias("n_failed"), F.max(F.when(~report, F.nullif(score, F.lit("")).cast("double"))).alias("score"))
    return out.orderBy("agent", "task")


def content_strategy(role: Column, section: Column, n_workflows: Column) -> Column:
    """primary_focus, forbidden, min_claims, max_claims of a page by its role and section."""

    def row(focus: Column, forbidden: list[str], least: Column, most: int) -> Column:
        topics = F.array(*map(F.lit, forbidden)) if forbidden else F.array().cast("array<string>")
        return F.struct(focus.alias("primary_focus"), topics.alias("forbidden"), least.cast("int").alias("min_claims"), F.lit(most).alias("max_claims"))

    out = F.when(F.lit(False), row(F.lit(""), [], F.lit(0), 0))
    for own, where, focus, forbidden, least, most in STRATEGIES:
        out = out.when((role == own) & (F.lit(True) if where is None else section == where), row(F.lit(focus), forbidden, n_workflows if least is None else F.lit(least), most))
    return out.otherwise(row(F.concat(F.coalesce(section, F.lit("")), F.lit(" page content")), [], F.lit(1), 10))


def contracts(pages: DataFrame, roots: dict[str, str] | None = None) -> DataFrame:
    """section, key, type, n_pages, required: what front matter the Markdown pages (path, content) of each section have.
    A key's type is that of most of its values, ties by name; a key is required where every page with front matter has it."""
    from ..functions.frontmatter import front_matter_entries

    own = pages.where(F.lower("path").rlike(r"\.(md|markdown)$")).select(section_of(F.col("path"), roots).alias("section"), front_matter_entries(F.col("content")).alias("e"))
    own = own.where(F.col("section").isNotNull() & (F.size("e") > 0))
    sizes = own.groupBy("section").agg(F.count("*").alias("n_all"))
    votes = own.select("section", F.explode("e").alias("e")).groupBy("section", F.col("e.key").alias("key"), F.col("e.type").alias("type")).agg(F.count("*").alias("n"))
    best = votes.groupBy("section", "key").agg(F.min_by("type", F.struct((-F.col("n")).alias("n"), "type")).alias("type"), F.sum("n").alias("n_pages"))
    return best.join(sizes, "section").select("section", "key", "type", "n_pages", (F.col("n_pages") == F.col("n_all")).alias("required"))
