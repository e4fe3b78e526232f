"""Links, plans and references as joins: what is named but missing, and what is there but not named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import resolve_path

MARKDOWN_LINK = r"\[[^\]]*\]\(([^)\s]+)\)"

#: About how many members of a class are one block.
_BLOCK = 256


def relative_links(lines: DataFrame) -> DataFrame:
    """slug, line, target of links outside code, without those that lead to another host or inside the page."""
    found = lines.where(~F.col("inside")).select("slug", "line", F.explode(F.regexp_extract_all("text", F.lit(MARKDOWN_LINK), F.lit(1))).alias("target"))
    return found.where(~F.col("target").rlike("^([a-zA-Z][a-zA-Z0-9+.-]*:|//|#)") & (F.regexp_replace("target", "[#?].*$", "") != ""))


def ancestors(paths: DataFrame) -> DataFrame:
    """Every folder above any path, once."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return paths.where(F.size(parts) > 1).select(F.explode(up).alias("path")).distinct()


def phantom_paths(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs (file, line, target) whose resolved path is neither a file nor a folder of files."""
    resolved = refs.withColumn("path", resolve_path(F.col("file"), F.col("target")))
    known = files.select("path").union(ancestors(files.select("path"))).distinct()
    return resolved.join(known, "path", "left_anti").select("path", "file", "line").orderBy("path", "file", "line")


def broken_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """links (slug, line, target): none of the target, target.md, target/_index.md and target/index.md is there."""
    plain = F.regexp_replace(F.regexp_replace("target", "[#?].*$", ""), "^/+|/+$", "")
    forms = F.array(plain, F.concat(plain, F.lit(".md")), F.concat(plain, F.lit("/_index.md")), F.concat(plain, F.lit("/index.md")))
    tried = links.select("slug", "line", "target", F.explode(forms).alias("path"))
    found = tried.join(files.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    return found.groupBy("slug", "line", "target").agg(F.max(F.coalesce("there", F.lit(False))).alias("there")).where("not there").select("slug", "line", "target")


def plan_against_pages(planned: DataFrame, actual: DataFrame) -> DataFrame:
    """path, kind: orphan (there but not planned) or missing (planned but not there)."""
    a = planned.select("path").distinct().withColumn("p", F.lit(True))
    b = actual.select("path").distinct().withColumn("a", F.lit(True))
    met = a.join(b, "path", "full_outer")
    return met.where("p is null or a is null").select("path", F.when(F.col("p").isNull(), "orphan").otherwise("missing").alias("kind"))


def uncovered(claims: DataFrame, referenced: DataFrame) -> DataFrame:
    return claims.select("claim_id").distinct().join(referenced.select("claim_id"), "claim_id", "left_anti")


def mandatory_missing(required: DataFrame, planned: DataFrame) -> DataFrame:
    """(section, slug) that the rules require and the plan lacks; _index counts as index."""
    same = lambda df: df.select("section", F.when(F.col("slug") == "_index", "index").otherwise(F.col("slug")).alias("slug")).distinct()
    return same(required).join(same(planned), ["section", "slug"], "left_anti")


def url_collisions(pages: DataFrame) -> DataFrame:
    """(section, url_path) of more than one page, with their paths in order."""
    found = pages.groupBy("section", "url_path").agg(F.count("*").alias("n_pages"), F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("paths"))
    return found.where("n_pages > 1")


def reused_claims(used: DataFrame) -> DataFrame:
    """used (claim_id, section): claims of more than one section other than the blog."""
    return used.where("section <> 'blog'").groupBy("claim_id").agg(F.count_distinct("section").alias("n_sections")).where("n_sections > 1")


def claims_by_ids(ids: DataFrame, claims: DataFrame) -> DataFrame:
    """ids (page, claim_ids) as rows in the order of the list; unknown ids are left out."""
    return ids.select("page", F.posexplode("claim_ids").alias("pos", "claim_id")).join(claims, "claim_id").orderBy("page", "pos")


def snippets_by_tags(wanted: DataFrame, snippets: DataFrame) -> DataFrame:
    """wanted (page, tags) with each snippet (snippet_id, tags, ord) that shares a tag: page, snippet_id, ord.

    Pages and snippets with equal sets of tags are a class each. Classes meet by tag and are made distinct; then blocks of
    their members do, dealt evenly over the tasks. Each page and snippet lies in one block, so pairs are made once, as two
    loops over a pair of blocks: they are neither joined nor sorted nor shuffled, however many there are."""
    own = lambda df, tags, *keys: df.select(*keys, F.explode("tags").alias("tag")).where("tag is not null").groupBy(*keys).agg(F.array_sort(F.collect_set("tag")).alias(tags))
    pages, held = own(wanted, "a", "page"), own(snippets, "b", "snippet_id", "ord")
    each = lambda df, tags: df.select(tags).distinct().withColumn("tag", F.explode(tags))
    met = each(pages, "a").join(each(held, "b"), "tag").select("a", "b").distinct()
    pairs = _blocks(pages, "a", F.struct("page"), "pages").join(met, "a").join(_blocks(held, "b", F.struct("snippet_id", "ord"), "held"), "b")
    dealt = pairs.select("pages", "held").repartition(4 * wanted.sparkSession.sparkContext.defaultParallelism)  # by number: few bytes in, many rows out
    return dealt.select("held", F.inline("pages")).select("page", F.inline("held"))


def _blocks(rows: DataFrame, tags: str, member: Column, name: str) -> DataFrame:
    """tags, name: lists of about _BLOCK members each, as many as the rows of equal tags need."""
    parts = rows.groupBy(tags).agg(F.ceil(F.count("*") / _BLOCK).alias("parts"))
    dealt = rows.join(parts, tags).withColumn("part", F.pmod(F.xxhash64(member), F.col("parts")))
    return dealt.groupBy(tags, "part").agg(F.collect_list(member).alias(name)).drop("part")


def first_matching_snippet(claims: DataFrame, snippets: DataFrame) -> DataFrame:
    """The first snippet (by ord) any of whose tags is a word or a run of words of the claim: tags are matched as
    word runs, so claims and tags meet by equality instead of by comparing all with all."""
    tags = snippets.select("snippet_id", "ord", F.explode("tags").alias("tag")).withColumn("tag", F.lower("tag"))
    w = F.regexp_extract_all(F.lower("claim_text"), F.lit(r"(?U)([\w-]+)"), F.lit(1))
    grams = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    own = claims.select("claim_id", w.alias("w")).select("claim_id", F.explode(F.array_distinct(F.concat(grams(1), grams(2), grams(3)))).alias("tag"))
    return own.join(tags, "tag").groupBy("claim_id").agg(F.min_by("snippet_id", F.struct("ord", "snippet_id")).alias("snippet_id"))


def cross_links(pages: DataFrame) -> DataFrame:
    """Neighbours over sections: docs to the first two of reference, kb to the first two of docs, blog to the
    first of products; slug, links in order."""
    rank = F.row_number().over(Window.partitionBy("section").orderBy("slug"))
    tops = pages.withColumn("k", rank).where("k <= 2").groupBy("section").agg(F.array_sort(F.collect_list(F.struct("k", "url_path"))).alias("t"))
    target = F.when(F.col("section") == "docs", "reference").when(F.col("section") == "kb", "docs").when(F.col("section") == "blog", "products")
    n = F.when(F.col("section") == "blog", 1).otherwise(2)
    met = pages.withColumn("to", target).withColumn("n", n).join(tops.withColumnRenamed("section", "to"), "to", "left")
    return met.select("slug", "section", F.coalesce(F.transform(F.slice("t", F.lit(1), F.col("n")), lambda x: x["url_path"]), F.array().cast("array<string>")).alias("links"))


def rewrite_links(content: Column, url_of_section: dict[str, str]) -> Column:
    """Relative links into another section become absolute ones."""
    out = content
    for section, base in url_of_section.items():
        out = F.regexp_replace(out, rf"\]\((?:\.\./)+{section}/([^)]*?)(?:\.md)?/?\)", f"]({base}/$1/)")
    return out


def page_role(section: Column, slug: Column, is_index: Column) -> Column:
    kb = F.when(slug == "faq", "landing").when(slug.rlike("how-to|howto|showcase"), "feature_showcase").otherwise("troubleshooting")
    return (
        F.when(is_index & (section == "docs"), "toc").when((slug == "developer-guide") | slug.endswith("/developer-guide"), "comprehensive_guide")
        .when(slug.isin("overview", "index", "_index") & (section == "products"), "landing").when(section == "docs", "workflow_page")
        .when(section == "kb", kb).when(section == "reference", "api_reference").otherwise("landing")
    )


def effective_quotas(quotas: DataFrame, volume: DataFrame, tier: str) -> DataFrame:
    """quotas (section, min_pages, max_pages, n_mandatory) and one row of evidence counts."""
    share = {"minimal": 0.3, "standard": 0.7, "rich": 1.0}.get(tier, 0.7)
    v = quotas.join(F.broadcast(volume))
    most = F.greatest("min_pages", F.floor(F.col("max_pages") * share + 1e-9))
    target = (
        F.when(F.col("section") == "products", 1).when(F.col("section") == "docs", F.col("n_mandatory") + F.col("n_workflows"))
        .when(F.col("section") == "reference", 1 + F.floor(F.col("n_symbols") / 3)).when(F.col("section") == "kb", F.col("n_mandatory") + F.least("n_features", F.lit(5)))
        .when(F.col("section") == "blog", 1 + (F.col("score") > 200).cast("int")).otherwise(F.col("min_pages"))
    )
    v = v.withColumn("tier_max", most.cast("long")).withColumn("target", target.cast("long"))
    return v.select("section", "target", "tier_max", F.greatest("min_pages", F.least("target", "tier_max")).cast("long").alias("effective"))


def launch_tier(signals: DataFrame) -> DataFrame:
    """signals: one row of contradictions, health, phantoms, formats, workflows, snippets -> tier."""
    low = (F.col("contradictions") > 0).cast("int") + (F.col("health") < 0.5).cast("int") + (F.col("phantoms") > 5).cast("int")
    high = (F.col("formats") >= 5).cast("int") + (F.col("workflows") >= 3).cast("int") + (F.col("snippets") >= 20).cast("int")
    return signals.withColumn("tier", F.when(low >= 2, "minimal").when((low == 0) & (high >= 3), "rich").otherwise("standard"))


def optional_pages(candidates: DataFrame, n: int) -> DataFrame:
    """The first n of each section by priority, then quality, then slug."""
    w = Window.partitionBy("section").orderBy("priority", F.desc("quality"), "slug")
    return candidates.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)


def mandatory_then_optional(pages: DataFrame, most: int) -> DataFrame:
    """All mandatory pages of a section, then optional ones (by ord) up to the cap."""
    w = Window.partitionBy("section")
    placed = pages.withColumn("k", F.row_number().over(w.orderBy(F.desc("mandatory"), "ord"))).withColumn("m", F.count_if("mandatory").over(w))
    return placed.where(F.col("k") <= F.greatest(F.lit(most), F.col("m"))).drop("k", "m")


def merge_requirements(general: DataFrame, family: DataFrame) -> DataFrame:
    """Mandatory pages of both, the general one where both name a slug."""
    both = general.withColumn("origin", F.lit(0)).unionByName(family.withColumn("origin", F.lit(1)))
    k = F.row_number().over(Window.partitionBy("section", "slug").orderBy("origin"))
    return both.withColumn("k", k).where("k = 1").drop("k", "origin")
