"""Files, snippets, fingerprints, diffs, schemas, secrets and repairs.

Files are (path, content) with content as text, or (path, sha256, size).
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_edges, normalize_space, strip
from ..sources.events import hash_tree
from .gates import SECRETS

#: Extensions by language, weights and patterns of discovery.
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "cs": "csharp", "java": "java", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "cpp": "cpp", "c": "c"}
ALIASES = {"py": "python", "python3": "python", "js": "javascript", "ts": "typescript", "c#": "csharp", "cs": "csharp", "sh": "bash", "shell": "bash", "yml": "yaml", "": "text"}
DOC_NAMES = [("readme", "(?i)^readme"), ("changelog", "(?i)^changelog"), ("contributing", "(?i)^contributing"), ("license", "(?i)^license"), ("install", "(?i)^install"), ("guide", "(?i)guide"), ("tutorial", "(?i)tutorial"), ("api", "(?i)api"), ("architecture", "(?i)architecture|design"), ("faq", "(?i)faq")]
BINARY = "png jpg jpeg gif webp ico pdf zip gz tar jar dll so exe bin woff woff2".split()
COMMENTS = ["#", "//", "/*", "*", "--", "<!--"]


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.when(basename(path).contains("."), F.substring_index(basename(path), ".", -1)).otherwise(""))


def language(path: Column) -> Column:
    table = F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("unknown"))


def is_binary(path: Column, content: Column, unreadable: bool = False) -> Column:
    """By extension, or a zero byte in the first 8192 of binary content; `unreadable` where content is null."""
    return F.coalesce(extension(path).isin(BINARY) | (F.locate("\x00", F.decode(F.substring(content, 1, 8192), "ISO-8859-1")) > 0), F.lit(unreadable))


def doc_type(path: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in DOC_NAMES:
        out = out.when(basename(path).rlike(pattern), name)
    return out.otherwise("other")


def doc_relevance(path: Column) -> Column:
    depth = F.size(F.split(path, "/"))
    readme = F.upper(basename(path)).startswith("README")
    return F.when((depth == 1) & readme, 100).when(path.rlike("^(docs|documentation|site)/"), 90).when(readme, 80).when(depth <= 2, 50).otherwise(30)


def discovered(files: DataFrame, ignored: list[str], mode: str = "respect") -> DataFrame:
    """Documents with type, score and the ignore mark, best first; hidden folders are skipped."""
    from ..functions.text import ignored_by

    mark = ignored_by(F.col("path"), ignored) if mode != "ignore" else F.lit(False)
    own = files.where(~F.col("path").rlike(r"(^|/)\.[^/]+/")).withColumn("ignored", mark)
    own = own.where(~F.col("ignored")) if mode == "respect" else own
    binary = is_binary(F.col("path"), F.col("content").cast("binary"))
    return own.select("path", doc_type(F.col("path")).alias("doc_type"), F.when(binary, 10).otherwise(doc_relevance(F.col("path"))).alias("score"), "ignored").orderBy(F.desc("score"), "path")


def roots(files: DataFrame, names: list[str]) -> DataFrame:
    return files.select(F.substring_index("path", "/", 1).alias("root")).where(F.col("root").isin(names)).distinct().orderBy("root")


def source_files(files: DataFrame, most: int = 100) -> DataFrame:
    p = F.col("path")
    rank = F.when(p.startswith("src/"), 0).when(p.startswith("lib/"), 1).when(p.rlike("(^|/)tests?/"), 3).otherwise(2)
    return files.where(extension(p).isin("py", "js", "cs")).withColumn("rank", rank).orderBy("rank", "path").limit(most)


def primary_language(files: DataFrame) -> DataFrame:
    """The language of most weight: 3 a code file, ties by first path; unknown without code."""
    own = files.select("path", language(F.col("path")).alias("language")).where("language <> 'unknown'")
    best = own.groupBy("language").agg((3 * F.count("*")).alias("w"), F.min("path").alias("first")).agg(F.min_by("language", F.struct((-F.col("w")).alias("w"), "first")).alias("language"))
    return best.select(F.coalesce("language", F.lit("unknown")).alias("language"))


def file_hash(path: Column, content: Column) -> Column:
    return F.sha2(F.concat(F.encode(path, "UTF-8"), F.lit("|").cast("binary"), F.encode(content, "UTF-8")), 256)


def tree_fingerprint(files: DataFrame, wide: int = 16) -> DataFrame:
    """One hash over all files (each path once), number of files and bytes; 64 zeros without files.

    Files are hashed where they are; their hashes meet in a tree by the hash of the path (sources.events.hash_tree)."""
    leaves = files.select(F.sha2("path", 256).alias("key"), file_hash(F.col("path"), F.col("content")).alias("hash"), F.octet_length("content").cast("long").alias("n"))
    return hash_tree(leaves, wide).select(F.col("hash").alias("fingerprint"), F.col("n_leaves").alias("n_files"), F.col("n").alias("n_bytes"))


def normalized_hash(content: Column) -> Column:
    """sha256 with one kind of line end and no trailing blanks."""
    return F.sha2(F.regexp_replace(F.regexp_replace(content, "\r\n", "\n"), r"(?m)[ \t]+$", ""), 256)


def hash_diff(golden: DataFrame, current: DataFrame) -> DataFrame:
    """path, kind (missing, unexpected, mismatch) of what differs."""
    met = golden.select("path", F.col("sha256").alias("g")).join(current.select("path", F.col("sha256").alias("c")), "path", "full_outer")
    kind = F.when(F.col("c").isNull(), "missing").when(F.col("g").isNull(), "unexpected").when(F.col("g") != F.col("c"), "mismatch")
    return met.select("path", kind.alias("kind")).where("kind is not null")


def regression_counts(diff: DataFrame) -> DataFrame:
    return diff.agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("missing", "unexpected", "mismatch")])


def patches(drafts: DataFrame, tree: DataFrame) -> DataFrame:
    """What each draft (path, content) does to the tree (path, content): create, replace (with the hash that must
    be there) or nothing."""
    met = drafts.join(tree.select("path", F.sha2("content", 256).alias("before")), "path", "left").withColumn("after", F.sha2("content", 256))
    action = F.when(F.col("before").isNull(), "create").when(F.col("before") == F.col("after"), "skip").otherwise("replace")
    return met.select("path", action.alias("action"), F.when(action == "replace", F.col("before")).alias("expected_before_hash"))


def _lines_in(text: str | None) -> list[str]:
    """What newlines end, and what stands behind the last one."""
    lines = (text or "").split("\n")
    return lines if lines[-1] else lines[:-1]


def _changed_lines(a: list[str], b: list[str]) -> tuple[int, int]:
    """Lines added and deleted by the shortest diff: those outside the longest common subsequence, a bit per line of a."""
    at: dict[str, int] = {}
    for k, line in enumerate(a):
        at[line] = at.get(line, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for line in b:
        hit = row & at.get(line, 0)
        if hit:
            row = (row + hit | row - hit) & full
    common = len(a) - row.bit_count()
    return len(b) - common, len(a) - common


def _changed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        counts = [_changed_lines(_lines_in(a), _lines_in(b)) for a, b in zip(rows["original"], rows["modified"], strict=True)]
        yield rows.drop(columns=["original", "modified"]).assign(added=[a for a, _ in counts], deleted=[d for _, d in counts])


def diff_lines(changes: DataFrame) -> DataFrame:
    """path, lines added and deleted, no more than there have to be; the line alignment has no SQL form, so it runs on batches of rows."""
    return changes.select("path", "original", "modified").mapInPandas(_changed, "path string, added long, deleted long")


def diff_budget(changes: DataFrame, most_files: int, most_lines: int) -> DataFrame:
    """Totals, files over the line budget, changes of form alone, and whether the budget is kept."""
    same = normalize_space(F.coalesce("original", F.lit(""))) == normalize_space(F.coalesce("modified", F.lit("")))
    met = changes.select(same.alias("form_only"), "original", "modified").mapInPandas(_changed, "form_only boolean, added long, deleted long")
    out = met.agg(F.count("*").alias("n_files"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.count_if(F.col("added") + F.col("deleted") > most_lines).alias("n_over"), F.count_if("form_only").alias("n_form_only"))
    return out.withColumn("ok", (F.col("n_files") <= most_files) & (F.col("n_over") == 0))


def write_if_changed(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows (path, content) whose content isn't stored under their path."""
    return incoming.withColumn("h", F.sha2("content", 256)).join(stored.select("path", F.sha2("content", 256).alias("h")), ["path", "h"], "left_anti").drop("h")


# ------------------------------------------------------------------------------------------ snippets


def fences(lines: DataFrame) -> DataFrame:
    """Closed fenced blocks: slug, line (of the opening), language, code; an open one at the end is dropped."""
    w = Window.partitionBy("slug").orderBy("line")
    numbered = lines.withColumn("n", F.sum(F.col("fence").cast("int")).over(w)).where("n > 0").withColumn("block", F.floor((F.col("n") - 1) / 2)).where(F.col("inside") | F.col("fence"))
    grouped = numbered.groupBy("slug", "block").agg(F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("line", "text", "fence"))).alias("x")).where(F.size(F.filter("x", lambda y: y["fence"])) == 2)
    first = strip(F.regexp_replace(F.col("x")[0]["text"], r"^\s*```", ""))
    return grouped.select("slug", "line", normalize_language(first).alias("language"), F.array_join(F.transform(F.filter("x", lambda y: ~y["fence"]), lambda y: y["text"]), "\n").alias("code"))


def normalize_language(name: Column) -> Column:
    table = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.lit(v))])
    plain = F.lower(F.regexp_replace(name, r"\s.*$", ""))
    return F.coalesce(F.try_element_at(table, plain), F.try_element_at(table, F.regexp_replace(plain, r"\d+$", "")), F.regexp_replace(plain, r"\d+$", ""))


def content_ratio(code: Column) -> Column:
    """Lines that are neither blank nor comments, of all lines."""
    lines = F.split(code, "\n")
    plain = F.filter(F.transform(lines, strip), lambda t: (t != "") & ~F.exists(F.array(*map(F.lit, COMMENTS)), lambda c: F.startswith(t, c)))
    return F.when(strip(code) == "", 0.0).otherwise(F.size(plain) / F.size(lines))


def snippet_quality(code: Column, least: int = 2, most: int = 300, ratio: float = 0.3) -> Column:
    """Why a snippet is rejected, or null."""
    n = F.size(F.filter(F.split(code, "\n"), lambda x: x.rlike(r"\S")))
    return F.when(strip(code) == "", "empty_code").when(n < least, "too_short").when(n > most, "too_long").when(content_ratio(code) < ratio, "low_content_ratio")


def snippet_id(code: Column, lang: Column, path: Column, start: Column, end: Column) -> Column:
    return F.sha2(F.concat_ws("|", code, lang, path, F.concat_ws("-", start.cast("string"), end.cast("string"))), 256)


def merged_snippets(*parts: DataFrame) -> DataFrame:
    """Catalogues one after the other; of equal ids the first; by language, first tag, id."""
    both = None
    for k, p in enumerate(parts):
        p = p.where("snippet_id is not null").withColumn("_part", F.lit(k))
        both = p if both is None else both.unionByName(p)
    place = F.row_number().over(Window.partitionBy("snippet_id").orderBy("_part", "ord"))
    return both.withColumn("_k", place).where("_k = 1").drop("_k", "_part").orderBy("language", F.try_element_at("tags", F.lit(1)), "snippet_id")


def _python_parses(code: pd.Series) -> pd.Series:
    def good(x: str | None) -> bool:
        try:
            ast.parse(x or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
        return True

    return code.map(good)


def python_parses(code: Column) -> Column:
    """Whether a text is Python; parsing has no SQL form."""
    return F.pandas_udf(_python_parses, "boolean")(code)


def _python_surface(code: pd.Series) -> pd.DataFrame:
    """Names that a module defines at its top level, in order of name."""

    def of(x: str | None) -> tuple[list[str], list[str], list[str]]:
        try:
            tree = ast.parse(x or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return [], [], []
        names = [t.id for n in tree.body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)]
        return (
            sorted({n.name for n in tree.body if isinstance(n, ast.ClassDef)}),
            sorted({n.name for n in tree.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)}),
            sorted({n for n in names if n.isupper()}),
        )

    return pd.DataFrame([of(x) for x in code], columns=["classes", "functions", "constants"])


def python_surface(code: Column) -> Column:
    return F.pandas_udf(_python_surface, "classes array<string>, functions array<string>, constants array<string>")(code)


def _closing_brace(code: pd.Series) -> pd.Series:
    def of(x: str | None) -> int:
        depth = 0
        for n, line in enumerate((x or "").split("\n"), start=1):
            for c in line:
                depth += (c == "{") - (c == "}")
                if c == "}" and depth == 0:
                    return n
        return 0

    return code.map(of)


def closing_brace(code: Column) -> Column:
    """Line (from 1) on which the first brace of the text closes; 0 if it doesn't."""
    return F.pandas_udf(_closing_brace, "int")(code)


def script_surface(code: Column, lang: str) -> Column:
    """Classes and functions of JavaScript or C# by pattern."""
    patterns = {"javascript": (r"\bclass\s+(\w+)", r"\bfunction\s+(\w+)"), "csharp": (r"\bclass\s+(\w+)", r"\b(?:public|private|internal|static)\s+[\w<>\[\]]+\s+(\w+)\s*\(")}[lang]
    return F.struct(*[F.array_sort(F.array_distinct(F.regexp_extract_all(code, F.lit(p), F.lit(1)))).alias(n) for n, p in zip(("classes", "functions"), patterns, strict=True)])


# ------------------------------------------------------------------------------------ schema inference


def value_type(value: Column) -> Column:
    v = strip(value)
    return (
        F.when(v.isNull() | (v == ""), "unknown").when(F.lower(v).isin("true", "false"), "boolean").when(v.rlike(r"^[+-]?\d+$"), "integer")
        .when(v.rlike(r"^[+-]?\d*\.\d+([eE][+-]?\d+)?$"), "number").when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), "date").when(v.startswith("["), "array_string")
        .when(v.startswith("{"), "object").otherwise("string")
    )


def schema_vote(fields: DataFrame) -> DataFrame:
    """fields (section, doc, key, value): a key is required if every document of the section has it; its type is
    the most frequent one, ties by name."""
    n = fields.groupBy("section").agg(F.count_distinct("doc").alias("n_docs"))
    types = fields.groupBy("section", "key", value_type(F.col("value")).alias("type")).agg(F.count("*").alias("c"))
    best = types.groupBy("section", "key").agg(F.min_by("type", F.struct((-F.col("c")).alias("c"), "type")).alias("type"))
    has = fields.groupBy("section", "key").agg(F.count_distinct("doc").alias("n_with"))
    return has.join(best, ["section", "key"]).join(n, "section").select("section", "key", "type", (F.col("n_with") == F.col("n_docs")).alias("required"))


# --------------------------------------------------------------------------------------------- secrets


def secret_id(kind: Column, value: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", kind, value), 256), 1, 8)


def _as_match(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def find_secrets(texts: DataFrame, patterns: list[tuple[str, str]] = SECRETS) -> DataFrame:
    """id, kind, value of every match."""
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all("text", F.lit(f"({p})" if not p.startswith("(?i)") else f"(?i)({p[4:]})"), F.lit(1)), _as_match(k)) for k, p in patterns]))
    return texts.select("id", F.explode(found).alias("x")).select("id", "x.*")


def redact(text: Column, patterns: list[tuple[str, str]] = SECRETS) -> Column:
    """Every match becomes a placeholder of its kind."""
    for kind, pattern in patterns:
        text = F.regexp_replace(text, pattern, f"[REDACTED:{kind}]")
    return text


def redact_events(events: DataFrame, patterns: list[tuple[str, str]] = SECRETS) -> DataFrame:
    """Payload text redacted, all other fields as they are."""
    return events.withColumn("payload", redact(F.col("payload"), patterns))


def scan_summary(files: DataFrame, allowed: list[str], patterns: list[tuple[str, str]] = SECRETS) -> DataFrame:
    """path, n_secrets, allowed: files with secrets; allow-listed by name, substring or pattern."""
    from ..functions.text import glob_to_regex

    found = find_secrets(files.select(F.col("path").alias("id"), F.col("content").alias("text")), patterns).groupBy("id").agg(F.count("*").alias("n_secrets"))
    rule = F.lit(False)
    for a in allowed:
        rule = rule | (F.col("id").contains(a) if "*" not in a else F.col("id").rlike(glob_to_regex(a)))
    return found.select(F.col("id").alias("path"), "n_secrets", rule.alias("allowed"))


# --------------------------------------------------------------------------------------------- repairs


def _lines(content: Column, to) -> Column:
    return F.array_join(F.transform(F.split(content, "\n"), to), "\n")


#: check -> repair of the whole text; the dispatcher applies those that a page's issues name, in this order.
def repairs(product: str, repo_url: str) -> dict[str, object]:
    def bullet(x: Column) -> Column:
        parts = F.slice(F.split(x, ", "), 1, 3)
        return F.when(x.rlike(r"^\s*[-*]\s") & (F.length(x) > 150) & (F.size(F.split(x, ", ")) > 1), F.array_join(F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(F.concat(F.lit("- "), p))), "\n")).otherwise(x)

    return {
        "claim_markers": lambda c: F.regexp_replace(c, r"(?i)\[claim:\s*([a-f0-9\-]+)\]", "<!-- claim_id: $1 -->"),
        "frontmatter_comments": lambda c: F.when(c.startswith("---"), F.concat(F.regexp_replace(F.regexp_extract(c, r"(?s)^(---\s*\n.*?\n---)", 1), r"(?m)^\s*#[^#\n].*\n", ""), F.regexp_replace(c, r"(?s)^---\s*\n.*?\n---", ""))).otherwise(c),
        "template_tokens": lambda c: F.regexp_replace(F.regexp_replace(c, "__PRODUCT_NAME__", product), "__[A-Z0-9_]+__", ""),
        "link_normalization": lambda c: F.regexp_replace(c, r"\]\(\./([\w-]+)\.md\)", "](/docs/$1/)"),
        "alt_text": lambda c: F.regexp_replace(c, r"!\[\s*\]\(([^)]*?)([\w-]+)\.(\w+)\)", "![$2]($1$2.$3)"),
        "placeholder_content": lambda c: F.array_join(F.filter(F.split(c, "\n"), lambda x: ~x.rlike(ascii_edges(r"(?i)\b(TODO|TBD|FIXME|XXX|PLACEHOLDER)\b"))), "\n"),
        "foss_licensing": lambda c: F.array_join(F.filter(F.split(c, "\n"), lambda x: ~x.rlike(r"(?i)commercial licen[sc]e|purchase|pricing|free trial|buy now")), "\n"),
        "invalid_claim_marker": lambda c: F.regexp_replace(c, r"<!--\s*claim_id:[^>]*-->\s*", ""),
        "error_message_format": lambda c: _lines(c, lambda x: F.regexp_replace(x, ascii_edges(r"(?<!`)\b((?:Error|Exception|Warning|Failed): [^`\n]*)"), "`$1`")),
        "terminology_consistency": lambda c: F.regexp_replace(c, r"https://github\.com/[\w.-]+/[\w.-]+", repo_url),
        "bullet_splitting": lambda c: _lines(c, bullet),
        "metadata": lambda c: F.when(~F.lower(F.regexp_extract(c, r"(?m)^title:\s*(.*)$", 1)).contains(product.lower()), F.regexp_replace(c, r"(?m)^title:\s*(.*)$", f"title: {product} $1")).otherwise(c),
        "missing_prerequisites": lambda c: F.when(~c.rlike(r"(?im)^#+\s*prerequisites"), F.concat(c, F.lit(f"\n\n## Prerequisites\n\n- {product} installed\n"))).otherwise(c),
        "missing_cta": lambda c: F.when(~c.rlike("(?i)get started|download|learn more"), F.concat(c, F.lit(f"\n\n**Get started** with {product} today.\n"))).otherwise(c),
        "missing_next_steps": lambda c: F.when(~c.rlike("(?i)next steps|learn more|developer guide"), F.concat(c, F.lit("\n\n## Next Steps\n\n- Developer Guide\n"))).otherwise(c),
        "frontmatter_fields": lambda c: F.when(c.startswith("---\n") & ~c.rlike(r"(?m)^description:"), F.regexp_replace(c, r"^---\n", f"---\ndescription: {product}\n")).otherwise(c),
        "heading_descriptiveness": lambda c: _lines(c, lambda x: F.when(x.rlike(r"^#+\s+\S+$") & ~F.lower(x).contains(product.lower()), F.regexp_replace(x, r"^(#+)\s+", f"$1 {product} ")).otherwise(x)),
        "collapsed_frontmatter": lambda c: F.regexp_replace(c, r"(?m)^(title: [^:\n]*?) (description|permalink|layout): ", "$1\n$2: "),
        "example_clarity": lambda c: F.regexp_replace(c, r"(?m)(^|\n\n)(```\w+\n)", "$1The following example shows this:\n\n$2"),
        "snippet_attribution": lambda c: F.regexp_replace(c, r"(?m)(^|\n\n)(```\w+\n)", "$1<!-- source: catalogue -->\n$2"),
    }


def heading_levels(lines: DataFrame) -> DataFrame:
    """Pages with each skipped heading level brought back to one more than the level before it."""
    w = Window.partitionBy("slug").orderBy("line")
    level = F.when(F.col("t").startswith("#"), F.length(F.regexp_extract("t", "^(#+)", 1)))
    own = lines.withColumn("level", level).withColumn("was", F.last("level", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    fixed = F.when(F.col("level") > F.col("was") + 1, F.concat(F.repeat(F.lit("#"), F.col("was") + 1), F.regexp_replace("t", "^#+", ""))).otherwise(F.col("text"))
    return own.select("slug", "line", fixed.alias("x")).groupBy("slug").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "x"))), lambda y: y["x"]), "\n").alias("content"))


def paragraph_breaks(content: Column) -> Column:
    """Paragraphs of more than ten lines as two halves of their sentences; front matter as it is."""

    def halves(p: Column) -> Column:
        s = F.split(F.regexp_replace(p, "\n", " "), r"(?<=\.)\s+")
        half = F.ceil(F.size(s) / 2).cast("int")
        return F.concat(F.array_join(F.slice(s, F.lit(1), half), " "), F.lit("\n\n"), F.array_join(F.slice(s, half + 1, F.size(s)), " "))

    long = lambda p: (F.size(F.split(p, "\n")) > 10) & ~p.rlike(r"^(---|```|#|-|\*|>)")
    return F.array_join(F.transform(F.split(content, "\n\n"), lambda p: F.when(long(p), halves(p)).otherwise(p)), "\n\n")


def low_density(pages: DataFrame, claims: DataFrame, most: int = 5) -> DataFrame:
    """pages (slug, content) with up to five claims (slug, claim_id) they don't name yet as comments at the end."""
    lacks = pages.join(claims, "slug").where(~F.contains("content", "claim_id"))
    some = lacks.groupBy("slug").agg(F.slice(F.array_sort(F.collect_set("claim_id")), 1, most).alias("ids"))
    tail = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("\n<!-- claim_id: "), i, F.lit(" -->"))), "")
    return pages.join(some, "slug", "left").select("slug", F.concat("content", F.coalesce(tail, F.lit(""))).alias("content"))


def apply_repairs(pages: DataFrame, issues: DataFrame, product: str, repo_url: str) -> DataFrame:
    """pages with the repairs that their issues (slug, check) ask for."""
    asked = issues.groupBy("slug").agg(F.collect_set("check").alias("asked"))
    out = pages.join(asked, "slug", "left")
    for name, repair in repairs(product, repo_url).items():
        hit = F.coalesce(F.array_contains(F.transform("asked", lambda c: F.substring_index(c, ".", -1)), name), F.lit(False))
        out = out.withColumn("content", F.when(hit, repair(F.col("content"))).otherwise(F.col("content")))
    return out.drop("asked")


def insert_at_anchor(content: Column, anchor: str, new: str) -> Column:
    """New text after the first heading of that name; fails where there is none."""
    pattern = rf"(?m)^(#+\s*\Q{anchor}\E[ \t]*)$"
    parts = F.regexp_instr(content, F.lit(pattern))
    head = F.regexp_extract(content, pattern, 1)
    end = parts + F.length(head) - 1
    return F.when(parts == 0, F.raise_error(F.lit(f"no heading {anchor}"))).otherwise(F.concat(F.left(content, end), F.lit(f"\n\n{new}\n"), F.substring(content, end + 1, F.length(content))))


def replace_lines(content: Column, start: int, end: int, new: str) -> Column:
    lines = F.split(content, "\n")
    return F.array_join(F.concat(F.slice(lines, 1, start - 1), F.array(F.lit(new)), F.slice(lines, F.lit(end + 1), F.greatest(F.size(lines) - end, F.lit(0)))), "\n")
