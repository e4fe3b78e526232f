"""Claims: statements out of texts, their kinds, merging, contradictions and groups.

Texts are (doc_id, text); statements have an explicit order, because what follows depends on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_in, ascii_edges, normalize_claim, sha_id, split_words, strip, words

#: Words and phrases that decide a claim's kind, subject and polarity.
LIMITATION = ["does not support", "not supported", "not yet implemented", "not implemented", "cannot", "limitation", "unsupported"]
WORKFLOW = ["install", "setup", "usage:", "how to", "getting started", "pip install", "npm install", "maven", "nuget"]
API_STRONG = ["api includes", "api provides", "class for", "class that", "function exports", "function imports", "function for", "method for"]
API_WEAK = ["class", "function", "method", "interface"]
FORMAT_CONTEXT = ["format", "file type", "reads", "writes"]
NEGATIVE = ["does not support", "not supported", "cannot", "not yet implemented", "not implemented", "limitation", "unsupported", "no support for"]
FORMATS = ascii_edges(r"\b(obj|fbx|stl|dae|gltf|glb|ply|3ds|off|one|pdf|dwg|dxf)\b")
HEADING_MARKERS = ["supports", "can", "enables", "install", "usage", "format", "provides"]
BOOST = [
    "support", "can", "enable", "provide", "allow", "install", "use", "usage", "format", "read", "write", "does not",
    "cannot", "limitation", "not yet", "class", "function", "method", "api", "interface",
]
DEVELOPER = ascii_edges(r"(?i)\byour job is to\b|\bwe don.t need\b|\bcode in module\b|\btodo\b|\bfixme\b|\bhack\b|\bworkaround\b")
INTERNAL = [ascii_edges(p) for p in (
    r"0x[0-9a-fA-F]{4,}", r"(?i)\bjcid\w+", r"(?i)\bguid[_\-]", r"(?i)\w+\s*\(\d+\s*bytes?\)\s*:", r"(?i)\bsection\s+\d+\.\d+",
    r"\b(?:MUST|SHALL|SHOULD)\s+(?:be|have|contain)\b",
    r"\b(?:CompactID|FileNode|ExtendedGUID|PartitionID|ObjectDeclaration|PropertySet|OutlineElementRTL)\b",
    r"""["']0x[0-9A-Fa-f]{2}["']""",
)]
CODE_WORD = ascii_edges(r"\b[a-z]+(?:_[a-z]+)+\b|\b[a-z]+[A-Z]\w+\b")
CAMEL = r"([A-Z][a-z]+(?:[A-Z][a-z]+){2,})"
PRIORITIES = {"manifest": 1, "source_code": 2, "test": 3, "implementation_doc": 4, "api_doc": 5, "readme_technical": 6, "readme_marketing": 7}


def statements(docs: DataFrame) -> DataFrame:
    """Sentences over lines: stripped non-empty lines are gathered until one ends in . ! ? or a colon; heading
    lines without a marker word are skipped; an unfinished tail is dropped; a sentence starts on the line after
    the last one's end. Empty lines come after one another in one window per document."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "raw")).select("doc_id", (F.col("k") + 1).alias("line"), strip(F.col("raw")).alias("t"))
    plain = ~F.col("t").startswith("#") | any_in(F.lower("t"), HEADING_MARKERS)
    lines = lines.where((F.col("t") != "") & plain).withColumn("ends", F.col("t").rlike(r"[.!?:]$").cast("int"))
    w = Window.partitionBy("doc_id").orderBy("line")
    placed = lines.withColumn("n", F.coalesce(F.sum("ends").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct("line", "t")))
    whole = placed.groupBy("doc_id", "n").agg(parts.alias("p"), F.max("line").alias("end_line"), F.max("ends").alias("ended")).where("ended = 1")
    text = F.array_join(F.transform("p", lambda x: x["t"]), " ")
    before = F.lag("end_line").over(Window.partitionBy("doc_id").orderBy("n"))
    found = whole.select("doc_id", "n", text.alias("claim_text"), (F.coalesce(before, F.lit(0)) + 1).cast("long").alias("start_line"), F.col("end_line").cast("long"))
    return found.withColumn("boosted", any_in(F.lower("claim_text"), BOOST))


def claim_kind(text: Column) -> Column:
    """An ordered cascade from the narrowest kind to the widest."""
    t = F.lower(text)
    has = lambda *w: any_in(t, list(w))
    porting = F.when(has("model", "file", "format", "fbx", "obj", "stl"), "format").when(has("module", "package"), "feature").otherwise("format")
    formats = F.when(has("obj", "stl", "fbx", "pdf", "file"), "format").when(has("multiple", "various", "many", "3d"), "feature").otherwise("format")
    code = has("class", "function", "method", "api")
    return (
        F.when(has(*LIMITATION), "limitation").when(has(*WORKFLOW), "workflow").when(has(*API_STRONG), "api")
        .when(has(*API_WEAK) & ~has(*FORMAT_CONTEXT), "api").when(has("reads", "writes", "file type"), "format")
        .when(has("provides") & code & ~has("format"), "api").when(has("provides") & ~code & has("format"), "format")
        .when(has("provides") & ~code, "feature").when(has("import", "export"), porting).when(has("format"), formats).otherwise("feature")
    )


def source_type(path: Column) -> Column:
    """By what the path holds, the strongest evidence first."""
    p = F.lower(path)
    has = lambda *w: any_in(p, list(w))
    return (
        F.when(has("pyproject.toml", "setup.py", "package.json", "pom.xml", "*.csproj", "cargo.toml", "go.mod"), "manifest")
        .when(has("src/", "lib/") & ~has("test", "spec", "__pycache__"), "source_code").when(has("test", "spec"), "test")
        .when(has("implementation", "architecture", "design", "adr", "tech"), "implementation_doc").when(has("api", "reference"), "api_doc")
        .otherwise("readme_technical")
    )


def source_priority(kind: Column) -> Column:
    table = F.create_map(*[x for k, v in PRIORITIES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, kind), F.lit(7))


def audience(text: Column) -> Column:
    """developer_instruction, internal_detail or user_facing."""
    internal = text.rlike("|".join(f"(?:{p})" for p in INTERNAL))
    camel = F.exists(F.regexp_extract_all(text, F.lit(CAMEL), F.lit(1)), lambda m: F.length(m) > 10)
    n = F.size(split_words(text))
    coded = F.regexp_count(text, F.lit(CODE_WORD)) > 0.15 * n
    return F.when(text.rlike(DEVELOPER), "developer_instruction").when(internal | camel | ((n > 0) & coded), "internal_detail").otherwise("user_facing")


def complexity(text: Column) -> Column:
    return F.when(F.length(text) < 50, "simple").when(F.length(text) > 150, "complex").otherwise("medium")


def claim_id(text: Column, kind: Column, product: str = "") -> Column:
    return sha_id(normalize_claim(text, product), kind)


def merge_claims(claims: DataFrame) -> DataFrame:
    """One row per claim_id: the first text (by ord), all citations in order, fact if any is, the highest
    confidence, the least source_priority."""
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    merged = claims.groupBy("claim_id").agg(
        F.min_by("claim_text", "ord").alias("claim_text"), F.min_by("claim_kind", "ord").alias("claim_kind"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "citation"))), lambda x: x["citation"]).alias("citations"),
        F.when(F.max((F.col("truth_status") == "fact").cast("int")) == 1, "fact").otherwise("inference").alias("truth_status"),
        F.max(rank).alias("r"), F.min("source_priority").alias("source_priority"),
    )
    return merged.withColumn("confidence", F.when(F.col("r") == 3, "high").when(F.col("r") == 2, "medium").otherwise("low")).drop("r")


def invalid_claims(claims: DataFrame) -> DataFrame:
    """Claims that break the structure, with the reason."""
    bad_citation = F.exists("citations", lambda c: c["path"].isNull() | c["start_line"].isNull() | c["end_line"].isNull())
    reason = (
        F.when(F.col("claim_id").isNull() | F.col("claim_text").isNull() | F.col("claim_kind").isNull(), "missing field")
        .when(~F.coalesce(F.col("truth_status").isin("fact", "inference"), F.lit(False)), "truth_status")
        .when(F.col("citations").isNull() | (F.size("citations") == 0), "no citation").when(bad_citation, "citation")
    )
    return claims.withColumn("reason", reason).where("reason is not null")


def kind_histogram(claims: DataFrame) -> DataFrame:
    return claims.groupBy("claim_kind").agg(F.count("*").alias("n_claims"), F.count_if(F.col("truth_status") == "fact").alias("n_facts"))


def claim_groups(claims: DataFrame) -> DataFrame:
    """Named groups of claim ids, each in order."""
    t = F.lower("claim_text")
    flow = F.when(any_in(t, ["install", "setup"]), "install_steps").when(any_in(t, ["getting started", "quickstart", "first", "begin"]), "quickstart_steps").otherwise("workflow_claims")
    group = F.when(F.col("claim_kind") == "limitation", "limitations").when(F.col("claim_kind") == "workflow", flow).when(F.col("claim_kind").isin("feature", "api"), "key_features")
    return claims.withColumn("name", group).where("name is not null").groupBy("name").agg(F.array_sort(F.collect_list("claim_id")).alias("claim_ids"))


def supported_formats(claims: DataFrame) -> DataFrame:
    """Of format claims the format, whether it is implemented, and the direction."""
    t = F.lower("claim_text")
    status = F.when(any_in(t, ["does not", "cannot", "not supported", "unsupported"]), "unknown").otherwise("implemented")
    direction = F.when(any_in(t, ["import", "read"]), "import").when(any_in(t, ["export", "write"]), "export").when(t.contains("both"), "both").otherwise("unknown")
    found = claims.where("claim_kind = 'format'").select("claim_id", F.upper(F.regexp_extract(t, FORMATS, 1)).alias("format"), status.alias("status"), direction.alias("direction"))
    return found.where("format <> ''")


def core_meaning(text: Column) -> Column:
    """subject, affirmative, format (null if none is named)."""
    t = F.lower(text)
    subject = (
        F.when(any_in(t, ["format", "read", "write", "import", "export"]), "format").when(any_in(t, ["install", "setup", "usage"]), "workflow")
        .when(any_in(t, ["class", "function", "method", "api"]), "api").otherwise("feature")
    )
    named = F.upper(F.regexp_extract(t, FORMATS, 1))
    return F.struct(subject.alias("subject"), (~any_in(t, NEGATIVE)).alias("affirmative"), F.nullif(named, F.lit("")).alias("format"))


def similar_pairs(claims: DataFrame, threshold: float = 0.3, salt: int = 8) -> DataFrame:
    """claim_a_id < claim_b_id with a Jaccard similarity of all their words of at least the threshold.

    Only claims of opposite polarity can contradict each other, so affirmative claims meet negative ones on
    shared words of the prefix (rarest words first), never all with all; frequent words are dealt over salts."""
    own = claims.select("claim_id", F.array_distinct(words(F.col("claim_text"))).alias("w"), core_meaning(F.col("claim_text")).alias("m")).where(F.size("w") > 0)
    each = own.select("claim_id", F.size("w").alias("n"), F.col("m.affirmative").alias("yes"), F.explode("w").alias("word"))
    rare = each.groupBy("word").agg(F.count("*").alias("df"))
    order = F.row_number().over(Window.partitionBy("claim_id").orderBy("df", "word"))
    prefix = each.join(rare, "word").withColumn("k", order).where(F.col("k") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1)
    side = lambda yes, name, deal: prefix.where("yes" if yes else "not yes").select("word", F.col("claim_id").alias(name), F.col("n").alias(f"n_{name}"), deal.alias("salt"))
    a = side(True, "yes_id", F.pmod(F.xxhash64("claim_id"), F.lit(salt)).cast("int"))
    b = side(False, "no_id", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    met = a.join(b, ["word", "salt"]).where((F.col("n_yes_id") >= threshold * F.col("n_no_id")) & (F.col("n_no_id") >= threshold * F.col("n_yes_id")))
    met = met.select("yes_id", "no_id").distinct()
    of = lambda c: own.select(F.col("claim_id").alias(c), F.col("w").alias(f"w_{c}"), F.col("m").alias(f"m_{c}"))
    full = met.join(of("yes_id"), "yes_id").join(of("no_id"), "no_id")
    both = F.size(F.array_intersect("w_yes_id", "w_no_id"))
    alike = both >= threshold * (F.size("w_yes_id") + F.size("w_no_id") - both) - 1e-12
    same = (F.col("m_yes_id.subject") == F.col("m_no_id.subject")) | (F.col("m_yes_id.format") == F.col("m_no_id.format"))
    return full.where(alike & same).select(F.least("yes_id", "no_id").alias("claim_a_id"), F.greatest("yes_id", "no_id").alias("claim_b_id"))


def contradictions(claims: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Similar claims of one subject or format and opposite polarity, and how their priorities resolve them."""
    pairs = similar_pairs(claims, threshold)
    of = lambda c, k: claims.select(F.col("claim_id").alias(c), F.col("source_priority").alias(k))
    found = pairs.join(of("claim_a_id", "a"), "claim_a_id").join(of("claim_b_id", "b"), "claim_b_id")
    gap = F.abs(F.col("a") - F.col("b"))
    resolution = F.when(gap >= 2, "prefer_higher_priority").when(gap == 1, "manual_review_required").otherwise("unresolved")
    winner = F.when(F.col("a") <= F.col("b"), F.col("claim_a_id")).otherwise(F.col("claim_b_id"))
    return found.select("claim_a_id", "claim_b_id", resolution.alias("resolution"), winner.alias("winning_claim_id"))


def downgrade_losers(claims: DataFrame, found: DataFrame) -> DataFrame:
    """Losers of resolved contradictions become inferences of low confidence; the last contradiction in order
    decides for a claim that loses more than once."""
    loser = F.when(F.col("winning_claim_id") == F.col("claim_a_id"), F.col("claim_b_id")).otherwise(F.col("claim_a_id"))
    lost = found.where("resolution <> 'unresolved'").select(loser.alias("claim_id"), "resolution", "claim_a_id", "claim_b_id")
    lost = lost.groupBy("claim_id").agg(F.max_by("resolution", F.struct("claim_a_id", "claim_b_id")).alias("resolution"))
    auto = F.col("resolution") == "prefer_higher_priority"
    joined = claims.join(lost, "claim_id", "left")
    return joined.withColumns({"truth_status": F.when(auto, "inference").otherwise(F.col("truth_status")), "confidence": F.when(auto, "low").otherwise(F.col("confidence"))})


def workflow_steps(claims: DataFrame) -> DataFrame:
    """Steps of each workflow in five phases, stable inside a phase, numbered; and its time estimate."""
    t = F.lower("claim_text")
    phase = F.when(any_in(t, ["install"]), 0).when(any_in(t, ["setup", "configure"]), 1).when(any_in(t, ["basic", "create", "load"]), 2).when(any_in(t, ["advanced"]), 4).otherwise(3)
    w = Window.partitionBy("workflow")
    numbered = claims.withColumn("phase", phase).withColumn("step", F.row_number().over(w.orderBy("phase", "ord")))
    base = F.max(F.when(t.contains("complex"), 15).when(t.contains("config"), 10).otherwise(5)).over(w)
    return numbered.withColumn("minutes", base + 5 * (F.count("*").over(w) - 1))


def hard_limit(claims: DataFrame, most: int, kinds: list[str]) -> DataFrame:
    """Ordered by kind and id, the first `most` stay; the others are marked as skipped."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, kinds)), F.col("claim_kind")), F.lit(0))
    rank = F.when(rank == 0, len(kinds) + 1).otherwise(rank)
    top = claims.select("claim_id", rank.alias("_r")).orderBy("_r", "claim_id").limit(most).select("claim_id", F.lit(True).alias("_in"))
    return claims.join(top, "claim_id", "left").withColumn("skipped", F.col("_in").isNull()).drop("_in")
