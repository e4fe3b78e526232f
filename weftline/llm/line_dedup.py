"""Near-duplicate lines by an exact set-similarity self-join, in DataFrame operations alone.

A line is the set of its words. It goes if an earlier line (by doc_id, then line number) has a Jaccard
similarity of at least 0.8 with it; equal sets are similar whatever their size. The join is the prefix-filter
one over a line's tokens in order of rarity. Single rare tokens are shared by ever more lines as a corpus grows,
so the prefix is taken of neighbouring pairs in that order: of a set of n tokens a similar one breaks up at most
lost = 0.75 floor(0.2 n) + 0.25 n of the n - 1 pairs (two for each token that is missing, one for each that comes
in), so both prefixes of lost + 1 pairs hold a shared one. Sets of under four words can only match equal sets.

- Rarity is the frequency of the token's hash bucket over all texts, on a logarithmic scale: a table of fixed size
  (2^16 numbers) in a scalar subquery. Frequency and hash are packed into one 64-bit number, so that sorting numbers
  sorts by rarity.
- Lines of equal sets collapse first (partial aggregation), and only the earliest of each goes on: a line
  that a third of all documents hold is one row.
- Postings (pair, line) are read in order of lines. Of the first line of a pair's list, the one with most copies so far
  and the one before it, over all its lists, a line is tried against the closest by its sketch and the earliest: a large
  group of near copies is settled with two comparisons a member. Only lines that this leaves open are joined with all earlier lines of their lists. No list
  is collected, and none is cut. Lists that can be long, since both their words are frequent, are read in shares;
  the join of open lines is not, so shares change no result.
- Length and position of the shared pair bound the overlap first. Then does a sketch, 64 bits of which each token
  turns one: tokens that two sets share cancel out, so sketches differ in no more bits than the sets in tokens. Postings
  carry both, so lists alone tell which lines are compared exactly, on the sets of the lines concerned.

Defined results: null text stays null and counts as no line; lines without a word always stay; rows of equal
doc_id and text count as one document and are cleaned alike; rows of one doc_id and different texts are documents of
their own, in an order that a hash of the text gives; a null doc_id comes before all others; an empty
table gives no rows; a document whose lines all go keeps its row with an empty text; other columns are kept. A
document has at most 2^27 lines (more raise an error).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

SIMILARITY = 0.8
RARITY_BITS = 16
#: Lists of pairs whose rarer word stands more often than this are read in shares of about so many lines.
SHARE = 50_000
#: Prefixes, postings and what is compared in their lists are shuffled in so many slices by their hash, one after the other, so that fewer of them stand on disk at once.
SLICES = 4
#: A set that more than 1 / HOT of all lines hold is met by a broadcast: fewer than HOT sets can be such.
HOT = 1000
_LINE_BITS = 27
_SCALE = 900  # steps of the logarithmic scale for each doubling
_RARITY = (1 << 15) - 1


def _spaced(text: Column) -> Column:
    """The text with spaces alone between the words of a line."""
    return F.when(text.rlike(r"[\x09\x0B-\x0D]"), F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text)


def _words(line: Column) -> Column:
    """Words of a line of _spaced() text; an empty one stands between neighbouring spaces."""
    return F.split(line, " ")


def _tokens(line: Column) -> Column:
    """Distinct hashes of the words of a line of _spaced() text."""
    return F.array_remove(F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _document(text: Column, apart: bool) -> Column:
    """Where doc_ids repeat, leading bits of the hash of a text, above the place for a line number."""
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), _LINE_BITS + 1), _LINE_BITS) if apart else F.when(text.isNotNull(), F.lit(0).cast("long"))


def _number(at: Column) -> Column:
    return at.bitwiseAND((1 << _LINE_BITS) - 1).cast("int")


def _bucket(word: Column) -> Column:
    return F.hash(word).bitwiseAND((1 << RARITY_BITS) - 1)


def frequencies(docs: DataFrame) -> DataFrame:
    """One row: by hash bucket of words how often it occurs in all texts, as _SCALE log2(1 + n), under 2^15, times 2^48;
    and the least such value of words whose lists are read in shares."""
    words = docs.select(F.explode(_words(F.replace(_spaced(F.col("text")), F.lit("\n"), F.lit(" ")))).alias("w"))
    counts = words.groupBy(_bucket(F.col("w")).alias("b")).agg(F.count("*").alias("n"))
    every = counts.union(docs.sparkSession.range(1 << RARITY_BITS).select(F.col("id").cast("int"), F.lit(0).cast("long"))).groupBy("b").agg(F.sum("n").alias("n"))
    scaled = F.least(F.lit(_RARITY), F.floor(_SCALE * F.log2(1 + F.col("n")))).cast("long")
    packed = every.select(F.shiftleft(F.col("b").cast("long"), 15).bitwiseOR(scaled).alias("x"), "n")
    by_bucket = F.transform(F.sort_array(F.collect_list("x")), lambda x: F.shiftleft(x.bitwiseAND(_RARITY), 48))
    share = F.greatest(F.lit(float(SHARE)), 16 * F.avg("n"))
    return packed.agg(by_bucket.alias("counts"), F.ceil(_SCALE * F.log2(1 + share)).cast("int").alias("share"))


def _needed(n: Column, m: Column) -> Column:
    """Least overlap of two sets of n and m tokens that are similar."""
    return F.ceil(F.lit(SIMILARITY / (1 + SIMILARITY)) * (n + m) - 1e-9)


_SIZE = (1 << 28) - 1


def _size_of(shape: Column) -> Column:
    return F.shiftright(shape, 28).bitwiseAND(_SIZE)


def _possible(one: Column, other: Column) -> Column:
    """Length filter, and position filter for a pair of tokens that two sets share; of their shapes."""
    n, m, p, q = _size_of(one), _size_of(other), one.bitwiseAND(_SIZE), other.bitwiseAND(_SIZE)
    by_length = (n >= F.lit(SIMILARITY) * m - 1e-9) & (m >= F.lit(SIMILARITY) * n - 1e-9)
    return by_length & (F.least(p, q) + F.least(n - p, m - q) >= _needed(n, m))


def _close(one: Column, other: Column, s: Column, z: Column) -> Column:
    """The sketches' bound of the difference of two lines; of their shapes and sketches."""
    n, m = _size_of(one), _size_of(other)
    return F.bit_count(s.bitwiseXOR(z)) <= n + m - 2 * _needed(n, m)


def _same_line(end: int) -> Column:
    return F.col(f"doc_id{end}").eqNullSafe(F.col("doc_id")) & (F.col(f"at{end}") == F.col("at"))


def _with(df: DataFrame, lines: DataFrame, end: int, *columns: str) -> DataFrame:
    """df with the columns, their names ending in end, that lines has of line doc_id<end>, at<end>."""
    own = lines.select("doc_id", "at", *[F.col(c).alias(f"{c}{end}") for c in columns])
    return df.join(own, _same_line(end)).drop("doc_id", "at")


def _similar(near: DataFrame, docs: DataFrame, apart: bool, scratch: Scratch, name: str) -> DataFrame:
    """Of the pairs (later line: doc_id1, at1; earlier: doc_id2, at2) the later ones whose sets are similar. The texts of the
    lines concerned are read again: cheaper than to keep the sets of all lines."""
    ends = F.explode(F.array(*[F.struct(F.col(f"doc_id{end}").alias("doc_id"), F.col(f"at{end}").alias("at")) for end in (1, 2)]))
    h = F.shiftleft(F.shiftright("at", _LINE_BITS), _LINE_BITS)
    by_doc = near.select(ends.alias("x")).select("x.*").groupBy(F.col("doc_id").alias("_doc_id"), h.alias("_h")).agg(F.collect_set("at").alias("_wanted"))  # at most a document's lines
    by_doc = by_doc.hint("shuffle_hash")  # it grows with the input, so it is not broadcast at any size
    met = docs.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (_document(F.col("text"), apart) == F.col("_h"))).select("doc_id", F.split(_spaced(F.col("text")), "\n").alias("lines"), "_wanted")
    each = F.transform("_wanted", lambda at: F.struct(at.alias("at"), F.get(F.col("lines"), _number(at)).alias("line")))
    sets = met.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.at", _tokens(F.col("x.line")).alias("tokens"))
    sets = scratch.write(sets, f"{name}-sets")
    scratch.drop()
    both = F.size(F.array_intersect("tokens1", "tokens2"))
    full = _with(_with(near, sets, 1, "tokens"), sets, 2, "tokens").where(both >= _needed(F.size("tokens1"), F.size("tokens2")))
    found = scratch.write(full.select(F.col("doc_id1").alias("doc_id"), F.col("at1").alias("at")).distinct(), name)
    scratch.drop(f"{name}-sets", f"{name}-near")
    return found


def _keyed(docs: DataFrame, table: DataFrame, apart: bool) -> DataFrame:
    """doc_id, at (line number, above it _document()), k1 and k2 (hashes of the set), n, the sketch s, and the prefix
    as hashes of pairs: their lowest 15 bits are 0, or the share that reads the line where lists can be long."""
    lines = docs.select("doc_id", _document(F.col("text"), apart).alias("h"), F.posexplode(F.split(_spaced(F.col("text")), "\n")).alias("k", "line"))
    number = F.when(F.col("k") < 1 << _LINE_BITS, F.col("k").cast("long")).otherwise(F.raise_error(F.lit("a text of too many lines")).cast("long"))
    # a filter on the tokens themselves would be pushed below and cost a second tokenisation
    lines = lines.where(F.trim(F.col("line")) != "").select("doc_id", F.col("h").bitwiseOR(number).alias("at"), "line")
    lines = lines.withColumn("counted", table.select("counts").scalar()).withColumn("limit", F.shiftleft(table.select("share").scalar().cast("long"), 48))
    packed = lambda w: F.get(F.col("counted"), _bucket(w)).bitwiseOR(F.shiftrightunsigned(F.xxhash64(w), 16))
    distinct = F.array_distinct(F.transform(F.array_remove(_words(F.col("line")), ""), packed))  # `counted` once only: else each row gets a copy
    ordered = lines.select("doc_id", "at", "limit", F.sort_array(distinct).alias("tokens"))
    sketch = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))))  # the lowest 6 bits of a word's hash
    # at most `lost` neighbouring pairs of a set are broken up in a similar one, so one of the first lost + 1 is shared
    size = F.size("tokens")
    lost = F.floor(0.75 * F.floor((1 - SIMILARITY) * size + 1e-9) + 0.25 * size + 1e-9).cast("int")
    shares = lambda a: F.least(F.lit(_RARITY), F.ceil(F.pow(F.lit(2.0), (a - F.col("limit")) / float(_SCALE << 48))))
    part = lambda a: F.when(a < F.col("limit"), 0).otherwise(1 + F.pmod(F.xxhash64("doc_id", "at"), shares(a)))
    pair = lambda a, b: F.xxhash64(a, b).bitwiseAND(~_RARITY).bitwiseOR(part(a))
    prefix = F.when(size >= 4, F.zip_with(F.slice("tokens", F.lit(1), lost + 1), F.slice("tokens", F.lit(2), lost + 1), pair))
    return ordered.select("doc_id", "at", F.xxhash64("tokens").alias("k1"), F.hash("tokens").alias("k2"), size.alias("n"), sketch.alias("s"), prefix.alias("prefix"))


def _listed(reps: DataFrame, part: int) -> DataFrame:
    """Of a slice of the postings those that share their pair with another line: token, doc_id, at, shape (copies by their
    logarithm, size, place of the pair), s (the sketch), prev (the line's pair before this one), k (place in the list; high where it is one of several shares),
    tries: of up to three earlier lines those that shapes and sketches let be similar, led by the bits in which sketches differ."""
    shape = F.shiftleft(F.floor(F.log2("m")).cast("long"), 56).bitwiseOR(F.shiftleft(F.col("n").cast("long"), 28))
    postings = reps.select("doc_id", "at", shape.alias("shape"), "s", "prefix", F.posexplode("prefix").alias("p", "token"))
    postings = postings.where(F.pmod(F.shiftright("token", 15), F.lit(SLICES)) == part)
    prev = F.shiftright(F.get("prefix", F.col("p") - 1), 15)
    postings = postings.select("token", "doc_id", "at", F.col("shape").bitwiseOR(F.col("p").cast("long")).alias("shape"), "s", prev.alias("prev"))
    # most pairs stand in one line: a count alone finds them, and only the others are put in order
    shared = F.col("token").bitwiseAND(_RARITY) > 0
    postings = postings.withColumn("size", F.count("*").over(Window.partitionBy("token"))).where((F.col("size") > 1) | shared)
    in_order, me = Window.partitionBy("token").orderBy("doc_id", "at"), F.struct("doc_id", "at", "shape", "s")
    most = F.max(F.struct(F.shiftright("shape", 56).alias("m"), "doc_id", "at", "shape", "s")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    ranked = postings.select("*", F.row_number().over(in_order).alias("k"), F.first(me).over(in_order).alias("head"), most.alias("most"), F.lag(me).over(in_order).alias("prior"))
    three = F.array_distinct(F.array("head", F.struct("most.doc_id", "most.at", "most.shape", "most.s"), "prior"))
    able = F.filter(three, lambda e: _possible(F.col("shape"), e["shape"]) & _close(F.col("shape"), e["shape"], F.col("s"), e["s"]))
    apart = lambda e: F.bit_count(F.col("s").bitwiseXOR(e["s"])).alias("apart")
    tries = F.when(F.col("k") > 1, F.transform(able, lambda e: F.struct(apart(e), e["doc_id"].alias("doc_id"), e["at"].alias("at"))))
    return ranked.select(F.shiftright("token", 15).alias("token"), "doc_id", "at", "shape", "s", "prev", F.when(shared, 1 << 30).otherwise(F.col("k")).alias("k"), tries.alias("tries"))


def _classes(keyed: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Lines whose set other lines have too: doc_id, at and m, how many have it, which is 0 for all but the earliest; and, of
    all sets of four words or more, the earliest line with n, s, prefix and m. Prefixes take no part in the aggregation."""
    line = F.struct("doc_id", "at")
    several = keyed.groupBy("k1", "k2").agg(F.min(line).alias("first"), F.count("*").alias("m")).where("m > 1")
    several = scratch.write(several, "several")
    limit = keyed.count() / HOT
    hot, others = F.broadcast(several.where(F.col("m") > limit)), several.where(F.col("m") <= limit)
    each = keyed.select("doc_id", "at", "k1", "k2")
    met = each.join(hot, ["k1", "k2"]).unionByName(each.join(hot, ["k1", "k2"], "left_anti").join(others, ["k1", "k2"]))
    members = scratch.write(met.select("doc_id", "at", F.when(line == F.col("first"), F.col("m")).otherwise(0).alias("m")), "members")
    scratch.drop("several")
    known = members.select(F.col("doc_id").alias("_doc_id"), F.col("at").alias("_at"), "m")
    classes = None
    for part in range(SLICES):
        mine = lambda d, a: F.pmod(F.xxhash64(d, a), F.lit(SLICES)) == part  # noqa: B023, E731
        some = keyed.where("n >= 4").where(mine("doc_id", "at")).select("doc_id", "at", "n", "s", "prefix")
        of_some = known.where(mine("_doc_id", "_at")).hint("shuffle_hash")  # the few are hashed, prefixes are not sorted
        some = some.join(of_some, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("at") == F.col("_at")), "left").drop("_doc_id", "_at")
        some = scratch.write(some.withColumn("m", F.coalesce("m", F.lit(1))).where("m > 0"), f"classes-{part}")
        scratch.drop()
        classes = some if classes is None else classes.union(some)
    return members, classes


def _repeated(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, at of every line that an earlier line resembles; whether doc_ids repeat, so that `at` holds hashes of texts."""
    scratch = Scratch(spark, "lines")
    docs = docs.select("doc_id", "text").where("text is not null")
    apart = bool(docs.groupBy("doc_id").count().where("count > 1").limit(1).count())
    if apart:
        docs = scratch.write(docs.dropDuplicates(["doc_id", "text"]), "docs")
    table = scratch.write(frequencies(docs), "counts")
    scratch.drop()
    keyed = scratch.write(_keyed(docs, table, apart), "keyed")
    members, classes = _classes(keyed, scratch)
    same = members.where("m = 0").select("doc_id", "at")
    scratch.drop("keyed")
    slices = []
    for part in range(SLICES):
        slices.append(scratch.write(_listed(classes, part), f"listed-{part}"))
        scratch.drop()
    listed = reduce(DataFrame.union, slices)
    scratch.drop("counts", *(f"classes-{part}" for part in range(SLICES)))
    line1, line2 = ([F.col(c).alias(f"{c}{end}") for c in ("doc_id", "at")] for end in (1, 2))
    tried = listed.where(F.size("tries") > 0).select(*line1, F.explode("tries").alias("e"))
    # of all lists the closest and the earliest line first: they settle most of a large group of near copies
    earliest = F.struct("e.doc_id", "e.at")
    best = tried.groupBy("doc_id1", "at1").agg(F.min("e").alias("close"), F.min(earliest).alias("early"))
    best = best.select("doc_id1", "at1", F.explode(F.array_distinct(F.array(F.struct("close.doc_id", "close.at"), "early"))).alias("e"))
    near = scratch.write(best.select("doc_id1", "at1", F.col("e.doc_id").alias("doc_id2"), F.col("e.at").alias("at2")), "led-near")
    scratch.drop()
    gone = _similar(near, docs, apart, scratch, "led")
    # lines that this leaves open meet all earlier ones of their lists
    held = ["shape", "s", "prev"]
    open_ = listed.where("k > 1").select("token", *line1, *[F.col(c).alias(f"{c}1") for c in held])
    open_ = scratch.write(open_.join(gone, _same_line(1), "left_anti"), "open")
    scratch.drop()
    earlier = F.struct(F.col("doc_id2").alias("d"), F.col("at2").alias("a")) < F.struct(F.col("doc_id1").alias("d"), F.col("at1").alias("a"))
    shapes = F.col("shape1"), F.col("shape2")
    # where two lines share the pair before too, they have met in its list: of a run of shared pairs only the first counts
    begins = F.coalesce(F.col("prev1") != F.col("prev2"), F.lit(True))
    able = earlier & begins & _possible(*shapes) & _close(*shapes, F.col("s1"), F.col("s2"))
    met = []
    for part, some in enumerate(slices):
        mine = open_.where(F.pmod("token", F.lit(SLICES)) == part)
        others = some.select("token", *line2, *[F.col(c).alias(f"{c}2") for c in held])
        late = mine.join(others.hint("merge"), "token").where(able).select("doc_id1", "at1", "doc_id2", "at2")
        met.append(scratch.write(late.distinct(), f"late-near-{part}"))
        scratch.drop()
    scratch.drop(*(f"listed-{part}" for part in range(SLICES)), "open")
    late = _similar(reduce(DataFrame.union, met), docs, apart, scratch, "late")
    # a near line's equal copies are among `same` already
    found = scratch.write(same.union(gone).union(late).distinct(), "found")
    scratch.drop("members", "led", "late", "docs", *(f"late-near-{part}" for part in range(SLICES)))
    return found, apart


def repeated_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, line_no of every line that an earlier line resembles."""
    return _repeated(spark, docs)[0].select("doc_id", _number(F.col("at")).alias("line_no"))


def dedup_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with their columns; from text go the lines that an earlier line resembles."""
    found, apart = _repeated(spark, docs)
    h = F.shiftleft(F.shiftright("at", _LINE_BITS), _LINE_BITS)
    gone = found.groupBy(F.col("doc_id").alias("_doc_id"), h.alias("_h")).agg(F.collect_list(_number(F.col("at"))).alias("_gone"))  # at most a document's lines
    joined = docs.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (_document(F.col("text"), apart) == F.col("_h")), "left")
    lines = F.split("text", "\n")
    stay = F.filter(F.transform(lines, lambda x, k: F.when(~F.array_contains("_gone", k), x)), lambda x: x.isNotNull())
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
