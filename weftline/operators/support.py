"""Smaller decisions and lookups: retries, hosts, names, tags, sections, and the semantic checks of pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_in, ascii_edges, glob_to_regex, sha_id, strip
from .checks import issue

#: Error names by what to do about them, tags by what a path holds, terms of the semantic checks.
NETWORK_ERRORS = ["ConnectionError", "Timeout", "TimeoutError", "URLError", "HTTPError"]
LOGIC_ERRORS = ["ValueError", "TypeError", "KeyError", "AttributeError"]
PATH_TAGS = {
    "quickstart": ["quickstart", "quick_start", "getting_started"], "tutorial": ["tutorial"], "example": ["example"], "convert": ["convert", "conversion"],
    "merge": ["merge"], "extract": ["extract"], "parse": ["parse", "parsing"], "render": ["render"],
}
TYPE_TAGS = {"readme": ["quickstart", "readme"], "implementation_notes": ["implementation"], "architecture": ["architecture"], "api_docs": ["api"]}
COMMERCIAL_TERMS = ascii_edges(r"evaluation\s+limit|paid\s+plan|trial\s+version|\bproprietary\b|enterprise\s+edition|premium\s+feature|subscription\s+required")
INTERNAL_TERMS = ascii_edges(r"\b0x[0-9a-fA-F]{4,}\b|\bjcid[A-Za-z0-9_]+\b|\bCompactID\b|\bFileNode\b|\b[A-F0-9]{8}-[A-F0-9]{4}-[A-F0-9]{4}-[A-F0-9]{4}-[A-F0-9]{12}\b")


def backoff(attempt: Column, base: float = 1.0, factor: float = 2.0, cap: float = 60.0, jitter: Column | None = None) -> Column:
    """Seconds before a try: growing, capped, and up to half as much again by a jitter between 0 and 1."""
    delay = F.least(base * F.pow(F.lit(factor), attempt), F.lit(cap))
    return delay if jitter is None else delay * (1 + 0.5 * jitter)


def failure_class(kind: Column, message: Column) -> Column:
    """retry, fail, or manual_intervention for what is not known."""
    m = F.lower(message)
    retry = kind.isin([*NETWORK_ERRORS, "RateLimitError", "PermissionError"]) | any_in(m, ["429", "rate limit", "503", "504", "service unavailable", "eagain", "ewouldblock"])
    fail = any_in(m, ["validation", "schema"]) | kind.isin(["ValidationError", *LOGIC_ERRORS, "AssertionError", "FileNotFoundError"])
    return F.when(retry, "retry").when(fail, "fail").otherwise("manual_intervention")


def host_allowed(host: Column, allowed: list[str]) -> Column:
    """Exact, by pattern, or without the port where the rule has none."""
    bare = F.substring_index(host, ":", 1)
    return reduce(lambda a, b: a | b, [(host == p) | host.rlike(glob_to_regex(p)) | ((F.lit(":" not in p)) & bare.rlike(glob_to_regex(p))) for p in allowed], F.lit(False))


def branch_name(product: Column, ref: Column, run_id: Column) -> Column:
    return F.concat_ws("/", F.lit("launch"), product, F.substring_index(ref, "/", -1), F.substring(F.substring_index(run_id, "-", -1), 1, 6))


def product_type(text: Column, n_platforms: Column) -> Column:
    t = F.lower(text)
    return (
        F.when(any_in(t, ["command-line", "cli", "command line"]), "cli").when(any_in(t, ["service", "api", "rest", "endpoint"]), "service")
        .when(any_in(t, ["sdk", "library", "package"]) & (n_platforms > 1), "sdk").otherwise("library")
    )


def path_tags(path: Column, doc_type: Column) -> Column:
    """Tags of a document by its type and path, in order; example where nothing says more."""
    p = F.lower(path)
    found = [F.when(any_in(p, words), F.array(F.lit(tag))).otherwise(F.array().cast("array<string>")) for tag, words in PATH_TAGS.items()]
    found += [F.when(doc_type == kind, F.array(*map(F.lit, tags))).otherwise(F.array().cast("array<string>")) for kind, tags in TYPE_TAGS.items()]
    tags = F.array_sort(F.array_distinct(F.concat(*found)))
    return F.when(F.size(tags) == 0, F.array(F.lit("example"))).otherwise(tags)


def example_relevance(path: Column, in_root: Column) -> Column:
    docs = path.rlike("(?i)^(docs|documentation)/[^/]*example")
    return F.when(in_root, 100).when(docs, 80).when(~path.contains("/"), 70).when(path.rlike("^(tests|test|__tests__|spec)/"), 50).otherwise(30)


def code_complexity(content: Column) -> Column:
    """Lines, functions and classes of a source text."""
    n = lambda p: F.size(F.filter(F.split(content, "\n"), lambda x: x.rlike(p)))
    return F.struct(F.size(F.split(content, "\n")).alias("lines"), n(r"^\s*(async\s+)?(def|function)\s").alias("functions"), n(r"^\s*(public\s+|export\s+)?class\s").alias("classes"))


def positioning(content: Column) -> Column:
    """The first top heading within 2000 characters, and the first plain line of the nine after it."""
    lines = F.split(F.left(content, F.lit(2000)), "\n")
    at = F.array_position(F.transform(lines, lambda x: x.startswith("# ")), True)
    after = F.filter(F.transform(F.slice(lines, (at + 1).cast("int"), F.lit(9)), strip), lambda x: (x != "") & ~x.startswith("#"))
    return F.when(at > 0, F.struct(strip(F.substring(F.get(lines, (at - 1).cast("int")), 3, 2000)).alias("tagline"), F.coalesce(F.get(after, F.lit(0)), F.lit("")).alias("description")))


def description(code: Column) -> Column:
    """First line of the first docstring, else the first comment."""
    quoted = lambda q: F.nullif(F.split(strip(F.regexp_extract(code, f"(?s){q}(.*?){q}", 1)), "\n")[0], F.lit(""))
    return F.coalesce(quoted('"""'), quoted("'''"), strip(F.regexp_extract(code, r"(?m)#\s*(.*?)$", 1)))


def cache_key(*parts: Column) -> Column:
    return sha_id(*parts)


def mock_reply(prompt: Column) -> Column:
    """A reply that depends on the prompt alone, for runs without a model."""
    return F.concat(F.lit("reply-"), F.substring(F.sha2(prompt, 256), 1, 16))


def update_front_matter(content: Column, fields: dict[str, str]) -> Column:
    """Fields replaced where the block has them, else added at its end; a block is made where there is none."""
    out = F.when(content.rlike(r"^---\s*\n"), content).otherwise(F.concat(F.lit("---\n---\n"), content))
    for k, v in fields.items():
        line = f"{k}: {v}".replace("\\", "\\\\").replace("$", "\\$")
        has = F.regexp_extract(out, r"(?s)^---\s*\n(.*?)---", 1).rlike(f"(?m)^{k}:")
        out = F.when(has, F.regexp_replace(out, rf"(?m)^{k}:.*$", line)).otherwise(F.regexp_replace(out, r"(?s)^(---\s*\n.*?)(---)", f"$1{line}\n$2"))
    return out


def sections(lines: DataFrame, keywords: list[str]) -> DataFrame:
    """Lines of sections whose heading holds a keyword: until the next heading of the same level or a higher one.
    A line belongs to a section if the last heading at or above each level, from the marked one up, is the marked
    one; that is a running maximum over heading levels, no range join."""
    level = F.when(F.col("t").rlike("^#{1,6}(?!#)"), F.length(F.regexp_extract("t", "^(#+)", 1)))
    own = lines.withColumn("level", level).withColumn("hit", F.col("level").isNotNull() & any_in(F.lower("t"), keywords))
    w = Window.partitionBy("slug").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.lit(False)
    for k in range(1, 7):
        ended = F.max(F.when(F.col("level") <= k, F.col("line"))).over(w)
        marked = F.max(F.when(F.col("hit") & (F.col("level") == k), F.col("line"))).over(w)
        inside = inside | (marked.isNotNull() & (marked == ended))
    return own.withColumn("in_section", inside).where("in_section and level is null").drop("level", "hit", "in_section")


def licensing_sections(lines: DataFrame) -> DataFrame:
    found = sections(lines, ["licen", "pricing", "plan"]).where(F.col("text").rlike(f"(?i){COMMERCIAL_TERMS}"))
    return issue(found, "semantic_accuracy.licensing_accuracy", "warn", F.col("line"), F.left(strip(F.col("text")), F.lit(80)), True)


def internal_sections(lines: DataFrame) -> DataFrame:
    found = sections(lines, ["feature", "capabilit", "overview"]).where(F.col("text").rlike(INTERNAL_TERMS))
    return issue(found, "semantic_accuracy.content_relevance", "warn", F.col("line"), F.regexp_extract("text", f"({INTERNAL_TERMS})", 1))


def unknown_methods(blocks: DataFrame, surface: DataFrame) -> DataFrame:
    """Calls object.method( in code blocks (slug, line, code) where the class is known (surface: class_name,
    method) and the method isn't; variables take the class that the block assigns to them."""
    pair = lambda text, p: F.transform(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)), lambda m: F.struct(F.lower(F.regexp_extract(m, p, 1)).alias("a"), F.lower(F.regexp_extract(m, p, 2)).alias("b")))
    named = blocks.select("slug", "line", F.explode(F.array_distinct(pair(F.col("code"), r"\b([a-zA-Z_]\w*)\s*=\s*([A-Z]\w*)\s*\("))).alias("x")).select("slug", "line", F.col("x.a").alias("name"), F.col("x.b").alias("of"))
    named = named.groupBy("slug", "line", "name").agg(F.max("of").alias("of"))
    calls = blocks.select("slug", "line", F.explode(F.array_distinct(pair(F.col("code"), r"\b([a-zA-Z_]\w*)\s*\.\s*([a-zA-Z_]\w*)\s*\("))).alias("x")).select("slug", "line", F.col("x.a").alias("name"), F.col("x.b").alias("method"))
    resolved = calls.join(named, ["slug", "line", "name"], "left").select("slug", "line", F.coalesce("of", "name").alias("class_name"), "method").distinct()
    known = surface.select(F.lower("class_name").alias("class_name"), F.lower("method").alias("method"))
    wrong = resolved.join(known.select("class_name").distinct(), "class_name", "left_semi").join(known, ["class_name", "method"], "left_anti")
    return issue(wrong, "semantic_accuracy.api_hallucination", "warn", F.col("line"), F.concat_ws(".", "class_name", "method"))


def quick_order(rows: DataFrame, phases: list[str], phase: str, order: str) -> DataFrame:
    """Rows by a fixed order of phases, then by their own order, numbered over each key's rows."""
    rank = F.array_position(F.array(*map(F.lit, phases)), F.col(phase))
    return rows.withColumn("step", F.row_number().over(Window.partitionBy("key").orderBy(rank, order)))
