"""Resampling towards a target distribution by hashed word features (importance weights, Gumbel top-k).

Words are found by an Aho-Corasick automaton whose patterns are distinct words between two delimiters. Each pattern
carries the word's CRC-32 and length, so a scan of the delimited bytes gives out payloads in order and no word of the
dictionary is hashed again. Payloads of neighbouring words compose to the CRC of the words joined by a space: appending
n bytes multiplies a CRC by x^(8n), for which a few 32 x 32 bit matrices do. A task's dictionary grows with what it
reads, up to ROOM words of at most LONG bytes; what no pattern matches is found by the gaps between matches and hashed
directly, so the dictionary decides about time alone.

One pass writes each document's buckets (two bytes a feature); counts, weights and scores come from that table, texts
are read once. Counts travel as at most `buckets` rows a task. Ranks: the lowest score that can be drawn is bounded by
an approximate percentile and checked by a count; what lies above it is sorted by range over all tasks, and a row per
partition gives the offsets. Only narrow rows are shuffled.

Defined results: null text has no words; a null doc_id is hashed as an empty one and comes after others in ties; rows
are treated alone, and rows equal in score and doc_id are ranked in order of the table of buckets; an empty table
gives no rows, an empty target counts nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, prefix_sums, text_or_empty
from .fill_middle import flat, slices

BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024
ROOM = 250_000
LONG = 48
SLICE = 1 << 20
_FOUND = "doc_id long, n_words long, n_features long, place long, buckets binary"
_SCORED = "doc_id long, n_words long, n_features long, place long, weight long, score long"

#: A-Z become a-z, every other ASCII byte that is no digit or letter a space; all other bytes belong to words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class Dictionary:
    """Words met so far between delimiters, with CRC and length; an automaton over most of them."""

    def __init__(self, room: int = ROOM):
        self.room = room
        self.places: dict[bytes, int] = {}
        self.crcs: list[int] = []
        self.built = 0  # words in the automaton
        self.automaton = None
        self.table = np.zeros(0, dtype=np.uint32)

    def _build(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for word, k in self.places.items():
            self.automaton.add_word(f" {word.decode('latin-1')} ", k)
        self.automaton.make_automaton()
        self.table, self.built = np.array(self.crcs, dtype=np.uint32), len(self.crcs)

    def scan(self, delimited: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRC, length and start of each word of bytes that begin and end with a space."""
        if len(self.places) > max(2000, 2 * self.built) or self.built < len(self.places) == self.room:
            self._build()
        space = np.frombuffer(delimited, dtype=np.uint8) == 32
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        crcs, known = np.zeros(len(starts), dtype=np.uint32), np.zeros(len(starts), dtype=bool)
        if self.automaton is not None:
            given = np.fromiter(chain.from_iterable(self.automaton.iter(delimited.decode("latin-1"))), dtype=np.int64).reshape(-1, 2)
            at = np.searchsorted(ends, given[:, 0])  # a match ends at the delimiter after its word
            crcs[at], known[at] = self.table[given[:, 1]], True
        gaps = np.flatnonzero(~known)
        crcs[gaps] = [self._crc(delimited[a:b]) for a, b in zip(starts[gaps].tolist(), ends[gaps].tolist(), strict=True)]
        return crcs, ends - starts, starts

    def _crc(self, word: bytes) -> int:
        k = self.places.get(word)
        if k is not None:
            return self.crcs[k]
        crc = zlib.crc32(word)
        if len(self.places) < self.room and len(word) <= LONG:
            self.places[word] = len(self.crcs)
            self.crcs.append(crc)
        return crc


def _times(matrix: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """Bit matrix (a column for each of 32 bits) times each CRC."""
    out = np.zeros_like(crcs)
    for bit in range(32):
        out ^= np.where(crcs >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def _one_byte() -> np.ndarray:
    """What a zero byte does to a CRC, as a bit matrix."""
    out = np.array([1 << bit for bit in range(32)], dtype=np.uint32)
    for _ in range(8):
        out = out >> np.uint32(1) ^ np.where(out & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return out


def append(crcs: np.ndarray, more: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs of texts followed by texts of known CRC and length."""
    matrix, out, left = _one_byte(), crcs.copy(), lengths.copy()
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] = _times(matrix, out[odd])
        left >>= 1
        matrix = _times(matrix, matrix)
    return out ^ more


def features(data: np.ndarray, at: np.ndarray, dictionary: Dictionary, most: int = 1, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, features of each text, and the features' buckets, text by text; texts lie end to end in
    data. Features are all runs of one to `most` words."""
    n = len(at) - 1
    size = np.diff(at)
    begin = at[:-1] + 1 + np.arange(n)  # a delimiter stands before every text
    delimited = np.full(len(data) + n + 1, 32, dtype=np.uint8)
    delimited[np.arange(len(data)) + np.repeat(1 + np.arange(n), size)] = np.frombuffer(data.tobytes().translate(_FOLD), dtype=np.uint8)
    crcs, lengths, starts = dictionary.scan(delimited.tobytes())
    text = np.searchsorted(begin, starts, "right") - 1
    found, owner = [crcs], [text]
    run = crcs
    led = append(np.full(len(crcs), zlib.crc32(b" "), dtype=np.uint32), crcs, lengths) if most > 1 else crcs
    for k in range(1, most):  # the word k places on, with the space before it, goes to the run's end
        run = append(run[:-1], led[k:], lengths[k:] + 1) if len(run) > 1 else run[:0]
        inside = text[: len(run)] == text[k : k + len(run)]
        found.append(run[inside])
        owner.append(text[: len(run)][inside])
    n_words = np.bincount(text, minlength=n)
    if most == 1:
        return n_words, n_words, crcs % np.uint32(buckets)
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return n_words, np.bincount(owners, minlength=n), (np.concatenate(found) % np.uint32(buckets))[order]


def _kind(buckets: int):
    return np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")


def find_features(rows: DataFrame, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """rows (doc_id, text without nulls): doc_id, n_words, n_features, place in the partition, buckets (little-endian)."""

    def run(batches):
        dictionary, place, kind = Dictionary(), 0, _kind(buckets)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                n_words, n_features, own = features(*flat(part.column(1)), dictionary, most, buckets)
                ends = np.concatenate([[0], np.cumsum(n_features)]) * kind.itemsize
                raw = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(own.astype(kind))])
                places = np.arange(place, place + len(part))
                place += len(part)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, places)), raw], ["doc_id", "n_words", "n_features", "place", "buckets"])

    return rows.mapInArrow(run, _FOUND)


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features lie in each bucket."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_numbers(batch.column(0), buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    counted = found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in counted.collect():  # a row per bucket
        out[r.bucket] = r.n
    return out


def _numbers(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of binaries end to end, and where each row's begin."""
    kind = _kind(buckets)
    _, offsets, data = column.cast(pa.large_binary()).buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return np.frombuffer(raw.tobytes(), dtype=kind), (at - at[0]) // kind.itemsize


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 ln ratio) of smoothed shares of each bucket, in the target over in the documents."""
    t_all, s_all, k = float(target.sum()), float(source.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for t, s in zip(target.tolist(), source.tolist(), strict=True)], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """The id's Gumbel noise, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(found: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """weight (sum of gains) and score (weight and noise) of what find_features() gave."""

    def run(batches):
        for batch in batches:
            numbers, at = _numbers(batch.column(4), len(gain))
            sums = np.concatenate([[0], np.cumsum(gain[numbers])])
            weight = sums[at[1:]] - sums[at[:-1]]
            scores = weight + np.array([noise(d, seed) for d in batch.column(0).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weight, pa.int64()), pa.array(scores, pa.int64())], [c.split()[0] for c in _SCORED.split(", ")])

    return found.select("doc_id", "n_words", "n_features", "place", "buckets").mapInArrow(run, _SCORED)


def draw(spark: SparkSession, scratch: Scratch, scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """scored with rank: 1, 2, 3 and so on for the floor(percent N / 100) highest scores among documents of enough words."""
    enough = F.col("n_words") >= least_words
    share = 1 - percent / 100 - 1e-3
    n, bound = scored.where(enough).agg(F.count("*"), F.percentile_approx("score", max(share, 0.0), 10_000)).first()
    k = percent * n // 100
    if k and scored.where(enough & (F.col("score") >= bound)).count() < k:
        bound = None  # the percentile was too far off: all are candidates
    top = enough & (F.lit(k > 0) if bound is None else (F.col("score") >= bound) & F.lit(k > 0))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place"), F.asc("n_features")]
    sorted_ = scored.where(top).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    placed = scratch.write(sorted_, "placed")  # id: partition, and row in it, in order of the ranges
    part = F.shiftrightunsigned("id", 33)
    totals = [(r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()]  # a row a partition
    bases = spark.createDataFrame(prefix_sums(totals), "part long, base long")
    rank = F.col("base") + F.col("id").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(bases), "part").withColumn("rank", F.when(rank <= k, rank))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(scored.where(~top).withColumn("rank", F.lit(None).cast("long")).select(*columns))


def resample(
    spark: SparkSession, docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (null: not drawn) of every document."""
    scratch = Scratch(spark, "importance")
    found = scratch.write(find_features(text_or_empty(docs), most, buckets), "found")
    wanted = find_features(target.select(F.lit(None).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), most, buckets)
    gain = gains(bucket_counts(wanted, buckets), bucket_counts(found, buckets))
    scored = scratch.write(score(found, gain, seed), "scored")
    scratch.drop("found")
    return draw(spark, scratch, scored, percent, least_words)


def drawn_documents(spark: SparkSession, docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The documents that are drawn, with their texts and all their columns; rows of one doc_id are drawn together, rows
    without one never."""
    ids = resample(spark, docs, target, **parameters).where("rank is not null").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
