"""N-gram Jaccard self-join by MinHash bands.

Texts become sets of five-word shingles (a text of one to four words is one shingle). Equal sets form a class;
from there on only classes are compared. Signatures are cut into bands, their number and rows chosen for the
target recall at the threshold; classes that share a band hash meet in a bucket.

A bucket is not expanded into its pairs. Its members are chained to its leader, and the chains give candidate
groups (minimum labels with pointer jumping, a table a round). Inside a candidate group all classes are verified
against each other on their full sets, in blocks of about BLOCK classes a side, dealt by hash so that a huge
group spreads over many tasks. A task hands on the number of links of each class and a spanning forest of the
links, never a row per pair; so copies cost nothing, no link between different texts is lost, and the rows stay
in proportion to the documents. The forests' connected groups are the result.

Defined results: null text counts as empty; a text without words is linked to nothing; copies are links of
each other; the leader of a bucket is its smallest key and the class id is the smallest doc_id; repeated
doc_ids give a row each; an empty table gives no rows; other columns are ignored by near_groups() and kept by
drop_near_copies().
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, planes, text_or_empty, unplanes, word_hashes

N = 5
SIMILARITY = 0.8
RECALL = 0.998
BLOCK = 400
BLOCK_BYTES = 16_000_000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = 128) -> tuple[int, int]:
    """Bands and rows with the fewest chance meetings at half the threshold among those that reach the recall."""
    best = None
    for rows in range(1, 13):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= most:
            stray = 1 - (1 - (similarity / 2) ** rows) ** bands
            best = min(best or (stray, bands, rows), (stray, bands, rows))
    return best[1], best[2]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(text: str, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word windows."""
    words = word_hashes(text)
    if not len(words):
        return words
    k = min(n, len(words))
    sums = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):
        sums = (sums + words[i : i + len(sums)]) * _MULTIPLIERS[i % 7]
    return np.unique(mixed(sums))


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 11):
        rnd = np.random.default_rng(seed)
        size = bands * rows
        self.a = (rnd.integers(1, 1 << 63, size, dtype=np.uint64) << np.uint64(1) | np.uint64(1))[:, None]
        self.b = rnd.integers(0, 1 << 63, size, dtype=np.uint64)[:, None]
        self.bands, self.rows = bands, rows

    def __call__(self, shingle: np.ndarray) -> list[int]:
        """A signed 64-bit hash of each band of the signature."""
        least = None
        for low in range(0, len(shingle), 2048):
            now = (self.a * shingle[low : low + 2048] + self.b).min(axis=1)
            least = now if least is None else np.minimum(least, now)
        parts = mixed(least >> np.uint64(20)).reshape(self.bands, self.rows)
        out = np.arange(self.bands, dtype=np.uint64)
        for r in range(self.rows):
            out = mixed(out * _MULTIPLIERS[0] + parts[:, r])
        return out.view(np.int64).tolist()


def class_key(shingle: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingle.tobytes())


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, h (hash of the text), key of the set (null without words), band hashes."""

    def run(batches):
        sign = MinHash(bands, rows)
        for batch in batches:
            keys, hashes = [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text, n)
                keys.append(class_key(found) if len(found) else None)
                hashes.append(sign(found) if len(found) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], ["doc_id", "h", "key", "bands"])

    keyed = text_or_empty(docs).select("doc_id", F.xxhash64("text").alias("h"), "text")
    return keyed.mapInArrow(run, "doc_id long, h long, key binary, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """key, sorted shingles of each wanted class; read again from the texts of its first document."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                found = [x for x in (shingles(t, n) for t in batch.column(1).slice(low, 256).to_pylist()) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([class_key(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], ["key", "shingles"])

    left = text_or_empty(docs).alias("d")
    some = left.join(wanted.select("rep").distinct(), F.col("d.doc_id").eqNullSafe(F.col("rep")), "left_semi")
    return some.mapInArrow(run, "key binary, shingles binary").join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def groups(edges: DataFrame, scratch: Scratch, name: str = "labels") -> DataFrame:
    """node, label: the smallest node of its connected group."""
    both = scratch.write(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label"))
    labels = scratch.write(labels, f"{name}-0")
    k = 0
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("label").alias("theirs"))
        near = both.join(of, "b").groupBy("a").agg(F.min("theirs").alias("theirs")).withColumnRenamed("a", "node")
        moved = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "theirs").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = moved.join(jump, "label").select("node", F.least("label", "further").alias("label"), "was")
        k += 1
        new = scratch.write(new, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        labels = new.select("node", "label")
        if not new.where("label <> was").limit(1).count():
            scratch.drop(f"{name}-edges")
            return labels


def _links_in_block(table: pa.Table, similarity: float) -> pa.Table:
    """For the classes of two blocks: how many documents each is linked to in the other, and links enough to
    connect what is connected (a spanning forest, at most one link a class)."""
    keys = table.column("key").to_pylist()
    sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("shingles")]
    sizes = np.array([len(x) for x in sets], dtype=np.float64)
    order, where = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    by = np.argsort(where, kind="stable")
    where, row = where[by], row[by]
    both = np.zeros((len(sets), len(sets)), dtype=np.float64)
    width = min(4096, len(order))
    cuts = np.searchsorted(where, np.arange(0, len(order) + width, width))
    for low, a, b in zip(range(0, len(order), width), cuts, cuts[1:], strict=False):
        some = np.zeros((len(sets), width), dtype=np.float32)
        some[row[a:b], where[a:b] - low] = 1
        both += some @ some.T
    linked = both >= similarity * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(linked, False)
    block = np.array(table.column("block").to_pylist())
    if table.column("left")[0] != table.column("right")[0]:  # pairs within a block are counted where left is right
        linked &= block[:, None] != block[None, :]
    counts = linked @ np.array(table.column("copies").to_pylist(), dtype=np.int64)
    ones, others, fresh = [], [], np.ones(len(sets), dtype=bool)
    for root in range(len(sets)):
        stack = [root] if fresh[root] else []
        fresh[root] = False
        while stack:
            one = stack.pop()
            new = np.flatnonzero(linked[one] & fresh)
            fresh[new] = False
            ones += [keys[one]] * len(new)
            others += [keys[k] for k in new]
            stack += new.tolist()
    return pa.table([pa.array(keys + ones, pa.binary()), pa.array([None] * len(keys) + others, pa.binary()), pa.array([*counts.tolist(), *[0] * len(ones)], pa.int64())], names=["key", "other", "n"])


def _grouped(spark: SparkSession, docs: DataFrame, n: int, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, h (hash of the text), grp (null without words), class_id, n_links; and the links."""
    bands, rows = choose_bands(similarity, recall)
    scratch = Scratch(spark, "near")
    signed = scratch.write(signatures(docs, n, bands, rows), "signed")
    met = signed.where("key is not null").select("key", F.explode("bands").alias("bucket")).distinct()
    met = scratch.write(met.join(met.groupBy("bucket").agg(F.min("key").alias("leader"), F.count("*").alias("m")).where("m > 1"), "bucket").select("bucket", "key", "leader"), "met")
    classes = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    wanted = scratch.write(classes.join(met.select("key").distinct(), "key", "left_semi"), "wanted")
    sets = scratch.write(sets_of(docs, wanted, n), "sets")
    edges = met.where("key <> leader").select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()
    members = groups(edges, scratch, "met").withColumnRenamed("node", "key").join(wanted, "key").join(sets, "key")
    members = scratch.write(members.withColumn("size", F.octet_length("shingles")), "members")
    sides = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_BYTES)).cast("int")
    placed = members.join(members.groupBy("label").agg(sides.alias("sides")), "label").withColumn("block", F.pmod(F.xxhash64("key"), F.col("sides")).cast("int"))
    dealt = placed.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    dealt = dealt.select("label", F.least("block", "to").alias("left"), F.greatest("block", "to").alias("right"), "block", "key", "copies", "shingles")
    compared = scratch.write(dealt.groupBy("label", "left", "right").applyInArrow(lambda t: _links_in_block(t, similarity), "key binary, other binary, n long"), "compared")
    links = scratch.write(compared.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")), "links")
    labels = groups(links, scratch).withColumnRenamed("node", "key").join(wanted, "key")
    tops = labels.groupBy("label").agg(F.min("rep").alias("class_id"))
    counted = compared.where("other is null").groupBy("key").agg(F.sum("n").alias("links"))
    result = labels.join(tops, "label").select("key", "label", "class_id").join(counted, "key")
    grouped = classes.select("key", "copies", F.col("rep").alias("own")).join(result, "key", "left")
    grouped = grouped.select("key", F.coalesce("label", "key").alias("grp"), F.coalesce("class_id", "own").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    found = signed.select("doc_id", "h", "key").join(grouped, "key", "left").select("doc_id", "h", "grp", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    found = scratch.write(found, "found")
    scratch.drop("signed", "met", "wanted", "sets", "members", "compared")
    return found, links


def near_groups(spark: SparkSession, docs: DataFrame, n: int = N, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """doc_id, class_id (smallest doc_id of its group), n_links (other documents of that similarity); and the
    verified pairs of classes (a, b: keys) that hold the groups together."""
    found, links = _grouped(spark, docs, n, similarity, recall)
    return found.select("doc_id", "class_id", "n_links"), links


def drop_near_copies(spark: SparkSession, docs: DataFrame, n: int = N, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of docs, all columns, one document of each group: the one with the smallest doc_id (then hash of
    its text; null ids last). Texts without words stay."""
    found, _ = _grouped(spark, docs, n, similarity, recall)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("x")
    one = found.where("grp is not null").groupBy("grp").agg(first).select("x.doc_id", "x.h")
    bare = found.where("grp is null").select("doc_id", "h").distinct()
    keep = one.union(bare).select(F.col("doc_id").alias("_doc_id"), F.col("h").alias("_h"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_h"))
    stay = docs.join(keep, same, "left_semi")
    again = found.where("grp is not null").groupBy("doc_id", "h").agg(F.count("*").alias("m")).where("m > 1").select(F.col("doc_id").alias("_doc_id"), F.col("h").alias("_h"))
    if not again.limit(1).count():
        return stay
    # rows repeated with their id: one of each stays
    return stay.join(again, same, "left_anti").unionByName(stay.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
