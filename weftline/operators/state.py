"""State of a run beside the plain replay: issues, gates, sections, checkpoints, fixes, caches, content paths.

Events are (run_id, ord, event_id, ts, type, payload). Every fold decomposes into aggregates by key, so a long run
is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .events import field, numbered, replay

#: What an error code is repaired by; sections by the first part of a site's name.
REPAIR_OF_CODE = [("CLAIM_MARKER", "claim_markers"), ("TEMPLATE_TOKEN", "template_tokens"), ("LINK", "link_normalization"), ("FRONTMATTER", "metadata"), ("HEADING", "heading_hierarchy")]
SECTIONS = ["products", "docs", "reference", "kb", "blog"]


def issues(events: DataFrame) -> DataFrame:
    """run_id, issue_id, ord, issue, status, resolved_at: a row per opening. A resolution closes the first opening of
    its id that stands before it; the last resolution gives the time."""
    opened = events.where("type = 'ISSUE_OPENED'").select("run_id", field("issue.issue_id").alias("issue_id"), "ord", field("issue").alias("issue")).where("issue is not null")
    first = F.min("ord").over(Window.partitionBy("run_id", "issue_id"))
    solved = events.where("type = 'ISSUE_RESOLVED'").groupBy("run_id", field("issue_id").alias("issue_id")).agg(F.max_by(F.struct("ord", "ts"), "ord").alias("last"))
    met = opened.withColumn("first", first).join(solved, ["run_id", "issue_id"], "left")
    closed = (F.col("ord") == F.col("first")) & (F.col("last.ord") > F.col("ord"))
    return met.select("run_id", "issue_id", "ord", "issue", F.when(closed, "RESOLVED").otherwise("OPEN").alias("status"), F.when(closed, F.col("last.ts")).alias("resolved_at"))


def gate_results(events: DataFrame) -> DataFrame:
    """run_id, gate, ok, ord: the last result of each gate."""
    last = F.max_by(F.struct(field("ok").cast("boolean").alias("ok"), "ord"), "ord").alias("x")
    return events.where("type = 'GATE_RUN_FINISHED'").groupBy("run_id", field("gate").alias("gate")).agg(last).select("run_id", "gate", "x.ok", "x.ord")


def section_states(events: DataFrame) -> DataFrame:
    """run_id, section, section_state: the last state of each section."""
    return events.where("type = 'SECTION_STATE_CHANGED'").groupBy("run_id", field("section").alias("section")).agg(F.max_by(field("new_state"), "ord").alias("section_state"))


def snapshot(events: DataFrame) -> DataFrame:
    """The whole snapshot of each run: what events.replay() gives, and issues (in order of opening), gates and sections."""
    opened = issues(events).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("ord", "issue_id", "status", "resolved_at"))).alias("issues"))
    gates = gate_results(events).groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("gate", "ok")))).alias("gates"))
    sections = section_states(events).groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "section_state")))).alias("sections"))
    return replay(events).join(opened, "run_id", "left").join(gates, "run_id", "left").join(sections, "run_id", "left")


def checkpoints(events: DataFrame, every: int) -> DataFrame:
    """run_id, checkpoint (from 1), n_events, last_ord: one after every so many events of a run."""
    own = numbered(events).withColumnRenamed("number", "n_events")
    return own.where(F.col("n_events") % every == 0).select("run_id", F.floor(F.col("n_events") / every).alias("checkpoint"), "n_events", F.col("ord").alias("last_ord"))


def latest_checkpoint(found: DataFrame) -> DataFrame:
    return found.groupBy("run_id").agg(F.max(F.struct("checkpoint", "n_events", "last_ord")).alias("x")).select("run_id", "x.*")


def after_checkpoint(events: DataFrame, latest: DataFrame) -> DataFrame:
    """What a resume has to read: events past the run's latest checkpoint, all of them where it has none."""
    at = latest.select("run_id", F.col("last_ord").alias("_at"))
    return events.join(at, "run_id", "left").where(F.col("_at").isNull() | (F.col("ord") > F.col("_at"))).drop("_at")


def fix_verdicts(tried: DataFrame, most: int = 3) -> DataFrame:
    """tried (issue_id, resolved, fixable, attempts): fixed, blocked (nothing can fix it), given_up or retry."""
    verdict = F.when(F.col("resolved"), "fixed").when(~F.col("fixable"), "blocked").when(F.col("attempts") >= most, "given_up").otherwise("retry")
    return tried.select("issue_id", verdict.alias("verdict"))


def repair_of_code(code: Column) -> Column:
    """The repair for an error code, or null."""
    out = F.when(F.lit(False), F.lit(""))
    for part, name in REPAIR_OF_CODE:
        out = out.when(code.contains(part), name)
    return out


def fresh(cache: DataFrame, now: Column, seconds: int) -> DataFrame:
    """cache (key, value, stored_at): entries that haven't expired, the newest of each key."""
    own = cache.where((F.col("stored_at") > now - F.make_dt_interval(secs=F.lit(seconds))) & (F.col("stored_at") <= now))
    rest = [c for c in cache.columns if c not in ("key", "stored_at")]
    return own.groupBy("key").agg(F.max(F.struct("stored_at", *rest)).alias("x")).select("key", "x.*")


def cited(held: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Documents or files that any evidence names."""
    return held.join(evidence.select(key).distinct(), key, "left_semi")


def plain_key(name: Column) -> Column:
    """Letters and digits alone, lower case."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def fuzzy_match(wanted: DataFrame, known: DataFrame, name: str, matched: str) -> DataFrame:
    """wanted with the first known name that is equal but for case and marks: an equality join of plain keys."""
    first = known.groupBy(plain_key(F.col(matched)).alias("_key")).agg(F.min(matched).alias(matched))
    return wanted.withColumn("_key", plain_key(F.col(name))).join(first, "_key").drop("_key")


def uncontained_code(blocks: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Blocks (slug, line, code) that no snippet of the catalogue (code) holds, white space aside. Blocks and snippets
    meet by their lines: a snippet that holds a block holds its longest line, so only those are compared."""
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    space = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    longest = F.array_max(F.transform(lines(F.col("code")), lambda x: F.struct(F.length(x), x.alias("x"))))["x"]
    own = blocks.withColumn("plain", space(F.col("code"))).withColumn("_line", longest)
    known = catalogue.select(space(F.col("code")).alias("known"), F.explode(F.array_distinct(lines(F.col("code")))).alias("_line"))
    held = own.join(known, "_line").where(F.contains("known", "plain")).select("slug", "line").distinct()
    return own.drop("_line", "plain").join(held, ["slug", "line"], "left_anti")


def output_path(section: Column, domain: Column, family: Column, locale: Column, slug: Column) -> Column:
    """Where a page is written: blog posts as folders with the language in the name, other sections by folder of it."""
    base = F.concat_ws("/", F.lit("content"), F.concat_ws(".", section, domain), family)
    post = F.concat(base, F.lit("/"), slug, F.when(locale == "en", "/index.md").otherwise(F.concat(F.lit("/index."), locale, F.lit(".md"))))
    return F.when(section == "blog", post).otherwise(F.concat(base, F.lit("/"), locale, F.lit("/"), slug, F.lit(".md")))


def content_path(path: Column) -> Column:
    """section, family, locale (en where a blog post names none) and slug of a content path; unknown elsewhere."""
    parts = F.split(path, "/")
    section = F.substring_index(F.get(parts, F.lit(1)), ".", 1)
    known = (F.get(parts, F.lit(0)) == "content") & section.isin(SECTIONS)
    name = F.get(parts, F.size(parts) - 1)
    post = F.regexp_extract(name, r"^index\.([a-z]{2})\.md$", 1)
    locale = F.when(section == "blog", F.when(post == "", "en").otherwise(post)).otherwise(F.get(parts, F.lit(3)))
    slug = F.when(section == "blog", F.get(parts, F.size(parts) - 2)).otherwise(F.regexp_replace(name, r"\.md$", ""))
    return F.struct(F.when(known, section).otherwise("unknown").alias("section"), F.when(known, F.get(parts, F.lit(2))).alias("family"), F.when(known, locale).alias("locale"), F.when(known, slug).alias("slug"))


def component(part: Column) -> Column:
    """A part of a URL: lower case, spaces as hyphens, other marks gone; null where it would lead elsewhere."""
    plain = F.regexp_replace(F.replace(F.lower(part), F.lit(" "), F.lit("-")), r"[^a-z0-9\-_.]", "")
    return F.when(~F.contains(part, F.lit("..")) & ~part.rlike(r"[/\\]"), plain)


def url_of_content(path: Column, default: str = "en", default_in_folder: bool = False) -> Column:
    """The URL path of a content file, or null where the path is too short, names no language, or a part is not allowed.

    content/<site>/<family>/<language>/<folders>/<name>.md; a blog's path has no language, its file's name may
    (index.fr.md). Index files of sections (_index.md) stand for their folder, bundles (index.md) for theirs as well."""
    parts = F.split(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^content/", ""), "/")
    site, family, name = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.size(parts) - 1)
    blog = site.startswith("blog.")
    index, bundle = name.rlike(r"^_index\."), name.rlike(r"^index\.")
    slug = F.when(index, "").when(bundle, F.when(F.size(parts) > 3, F.get(parts, F.size(parts) - 2)).otherwise("")).otherwise(F.regexp_replace(F.regexp_replace(name, r"\.[a-z]{2}\.md$", ""), r"\.md$", ""))
    length = F.size(parts) - F.when(bundle, 4).otherwise(3)
    inner = F.when(length > 0, F.slice(parts, F.lit(3), F.greatest(length, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    suffix = F.regexp_extract(name, r"\.([a-z]{2})\.md$", 1)
    locale = F.when(blog, F.when(suffix == "", default).otherwise(suffix)).otherwise(F.get(inner, F.lit(0)))
    folders = F.when(blog, inner).otherwise(F.slice(inner, F.lit(2), F.size(inner)))
    shown = F.when((locale == default) & F.lit(not default_in_folder), "").otherwise(component(locale))
    each = F.transform(F.filter(F.concat(F.array(shown, component(family)), F.transform(folders, component), F.array(component(slug))), lambda x: x.isNull() | (x != "")), lambda x: x)
    whole = F.concat(F.lit("/"), F.array_join(each, "/"), F.lit("/"))
    return F.when((F.size(parts) >= 3) & locale.isNotNull() & ~F.exists(each, lambda x: x.isNull()), F.regexp_replace(whole, "/{2,}", "/"))


def unique_keys(rows: DataFrame, base: str, within: str, order: str) -> DataFrame:
    """rows with key: base and a number that counts the rows of `within`."""
    return rows.withColumn("key", F.concat_ws("-", base, F.row_number().over(Window.partitionBy(within).orderBy(order)).cast("string")))


#: The status that a work item's event brings, and the status it has to have before.
MOVES = {"WORK_ITEM_QUEUED": ("queued", None), "WORK_ITEM_STARTED": ("running", "queued"), "WORK_ITEM_FINISHED": ("finished", "running")}


def transitions(events: DataFrame) -> DataFrame:
    """run_id, work_item_id, ord, event, before, after, reason: a row for each event of a work item, reason null where
    the move is legal. Once an item is queued, starts and finishes move it whatever it was; queueing it again doesn't."""
    own = events.where(F.col("type").isin(list(MOVES))).select("run_id", field("work_item_id").alias("work_item_id"), "ord", F.col("type").alias("event"))
    item = Window.partitionBy("run_id", "work_item_id")
    queued = F.min(F.when(F.col("event") == "WORK_ITEM_QUEUED", F.col("ord"))).over(item)
    to = F.when(F.col("event") == "WORK_ITEM_STARTED", "running").when(F.col("event") == "WORK_ITEM_FINISHED", "finished").when(F.col("ord") == F.col("queued"), "queued")
    own = own.withColumn("queued", queued).withColumn("to", F.when(F.col("ord") >= F.col("queued"), to))
    before = F.last("to", True).over(item.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("before", before)
    reason = (
        F.when(F.col("work_item_id").isNull(), "no id")
        .when((F.col("event") == "WORK_ITEM_QUEUED"), F.when(F.col("before").isNotNull(), "queued again"))
        .when(F.col("before").isNull(), "unknown item")
        .when((F.col("event") == "WORK_ITEM_STARTED") & (F.col("before") != "queued"), "not queued")
        .when((F.col("event") == "WORK_ITEM_FINISHED") & (F.col("before") != "running"), "not running")
    )
    known = F.col("work_item_id").isNotNull()
    return own.select("run_id", "work_item_id", "ord", "event", F.when(known, F.col("before")).alias("before"), F.when(known, F.coalesce("to", "before")).alias("after"), reason.alias("reason"))
