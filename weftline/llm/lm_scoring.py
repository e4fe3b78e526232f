"""Language-model scores by deleted interpolation.

P(w | v) mixes the maximum-likelihood estimates of the pair (v, w), of w, and a uniform one. The three weights
depend on how often the context v was seen (buckets of its binary logarithm) and are learned by
expectation-maximisation on deleted counts: each training token is held out in turn, so its own count is taken
from every estimate that judges it.

Counts at scale. Tokens are not shuffled one by one. Pass A turns stretches of about BLOCK tokens into blocks:
word numbers, and the 64-bit hashes of the block's distinct words. Each block then asks once for each distinct
word and pair: its sorted keys are cut by their leading bits into buckets, with the block's own training counts
(the map-side aggregate). A bucket adds up the counts of all blocks and answers each block in its own order.
Buckets grow in number with the data, keys are hashes, and a block sends a frequent pair once, so no word,
pair or source makes one task large. A document longer than a block is cut into pieces whose sums are added up.
EM runs on the driver over a histogram of bounded size: context bucket x quarter-octave bins of the two ratios.

Defined results: null text counts as empty (the end token alone); a null doc_id counts as held out; repeated
doc_ids give a row each; an empty table gives no rows; with no training documents all estimates are 0 but the
uniform one; other columns are ignored.
"""

from __future__ import annotations

import zlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_HASHES, Scratch, planes, text_or_empty, unplanes

BLOCK = 800_000
BUCKET_KEYS = 500_000
FOLDS = 10
ALPHA = 0.1
EM_STEPS = 30
_BINS, _STEP = 200, 4  # quarter octaves; bin 0: the estimate is 0
_LEVELS = 48

_BLOCKS = "block long, row array<long>, doc_id array<long>, held array<boolean>, size array<int>, ids binary, words binary, n_keys long"
_ASKED = "bucket long, block long, keys binary, counts binary"
_SAID = "bucket long, block long, counts binary, n_words long, n_tokens long"
_COUNTED = "block long, row array<long>, doc_id array<long>, held array<boolean>, size array<int>, ids binary, of_words binary, of_pairs binary"
_SCORES = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


_END = b"\n"  # no word holds it


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit keys of word pairs, the lowest bit 1."""
    x = first * np.uint64(0x9E3779B97F4A7C15) ^ (second >> np.uint64(31)) ^ (second << np.uint64(33))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (x ^ (x >> np.uint64(32))) | np.uint64(1)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == 0


def pieces(text: str, size: int):
    """Hashes of the words and the end, each piece led by its context; the first context is the end."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    words.append(_END)
    end = WORD_HASHES[_END]
    for at in range(0, len(words), size):
        part = words[at : at + size]
        hashes = np.fromiter(map(WORD_HASHES.__getitem__, part), dtype=np.uint64, count=len(part))
        yield np.concatenate([np.array([WORD_HASHES[words[at - 1]] if at else end], dtype=np.uint64), hashes])


def to_blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    def block(number, held):
        rows, docs_, out, hashes = zip(*held, strict=True)
        words, ids = np.unique(np.concatenate(hashes), return_inverse=True)
        sizes = np.array([len(h) - 1 for h in hashes], dtype=np.int32)
        view = Block(ids.astype(np.uint32), sizes, np.array(out), words)
        columns = [[number], [list(rows)], [list(docs_)], [list(out)], [sizes.tolist()], [planes(view.ids)], [planes(words)], [len(view.keys)]]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in _BLOCKS.split(", ")])

    def run(batches):
        part, row, number, held, n = TaskContext.get().partitionId() << 32, 0, 0, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = held_out(doc_id)
                for piece in pieces(text, size):
                    held.append((part + row, doc_id, out, piece))
                    n += len(piece)
                    if n >= size:
                        yield block(part + number, held)
                        held, n, number = [], 0, number + 1
                row += 1
        if held:
            yield block(part + number, held)

    return text_or_empty(docs).mapInArrow(run, _BLOCKS)


class Block:
    """Tokens of a block, their pairs, and its sorted keys of words and pairs."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, held: np.ndarray, words: np.ndarray | None):
        self.ids, self.sizes = ids, sizes
        ends = np.cumsum(sizes.astype(np.int64) + 1)
        first = np.zeros(len(ids), dtype=bool)
        first[ends - sizes - 1] = True  # contexts that lead a piece
        self.at = np.flatnonzero(~first)
        self.token, self.context = ids[self.at], ids[self.at - 1]
        self.train = np.repeat(~held, sizes)
        self.starts = np.cumsum(sizes, dtype=np.int64) - sizes
        top = int(ids.max()) + 1 if len(ids) else 1
        self.pairs, self.pair = np.unique(self.context.astype(np.uint64) * np.uint64(top) + self.token, return_inverse=True)
        self.n_words = top
        if words is not None:
            both = pair_keys(words[(self.pairs // np.uint64(top)).astype(np.int64)], words[(self.pairs % np.uint64(top)).astype(np.int64)])
            both = np.concatenate([words, both])
            self.order = np.argsort(both, kind="stable")
            self.keys = both[self.order]

    def own_counts(self) -> np.ndarray:
        words = np.bincount(self.token[self.train], minlength=self.n_words)
        pairs = np.bincount(self.pair[self.train], minlength=len(self.pairs))
        return np.concatenate([words, pairs])[self.order].astype(np.uint64)

    def back(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts in order of keys -> of words, of pairs."""
        own = np.empty(len(counts), dtype=np.uint64)
        own[self.order] = counts
        return own[: self.n_words], own[self.n_words :]


def rows_of(batch: pa.RecordBatch):
    for k in range(batch.num_rows):  # one at a time: a row is a whole block
        yield batch.slice(k, 1).to_pylist()[0]


@contextmanager
def few_rows(spark: SparkSession, n: int = 4):
    """Arrow batches of n rows, for tables whose rows are blocks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def _block_of(ids: bytes, sizes: list[int], held: list[bool], words: bytes | None) -> Block:
    return Block(unplanes(ids, np.uint32), np.array(sizes, dtype=np.int64), np.array(held, dtype=bool), None if words is None else unplanes(words, np.uint64))


def ask(blocks: DataFrame, bits: int) -> DataFrame:
    """A row per block and bucket: sorted keys as differences, and the block's training counts of them."""

    def run(batches):
        for batch in batches:
            for r in rows_of(batch):
                block = _block_of(r["ids"], r["size"], r["held"], r["words"])
                counts = block.own_counts()
                bucket = (block.keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(block.keys), dtype=np.int64)
                cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
                rows = [(int(bucket[a]), r["block"], planes(np.diff(block.keys[a:b], prepend=np.uint64(0))), planes(counts[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
                for low in range(0, len(rows), 64):
                    columns = zip(*rows[low : low + 64], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "keys", "counts"])

    return blocks.select("block", "held", "size", "ids", "words").mapInArrow(run, _ASKED)


def answer(table: pa.Table) -> pa.Table:
    """All blocks' questions of one bucket -> the sums, for each block in its own order."""
    keys = [np.cumsum(unplanes(k, np.uint64), dtype=np.uint64) for k in table.column("keys").to_pylist()]
    counts = [unplanes(c, np.uint64) for c in table.column("counts").to_pylist()]
    sizes = np.cumsum([len(k) for k in keys])
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(distinct), dtype=np.uint64)
    np.add.at(sums, where, np.concatenate(counts))
    words = sums[(distinct & np.uint64(1)) == 0]
    back = np.split(sums[where], sizes[:-1])
    n = len(keys)
    return pa.table({
        "bucket": table.column("bucket"), "block": table.column("block"), "counts": pa.array([planes(b) for b in back], pa.binary()),
        "n_words": pa.array([int((words > 0).sum())] + [0] * (n - 1), pa.int64()), "n_tokens": pa.array([int(words.sum())] + [0] * (n - 1), pa.int64()),
    })


def join_counts(blocks: pa.Table, said: pa.Table) -> pa.Table:
    """One block and its answers in order of buckets -> the block with counts of its words and pairs."""
    r = blocks.to_pylist()[0]
    parts = sorted(zip(said.column("bucket").to_pylist(), said.column("counts").to_pylist(), strict=True))
    block = _block_of(r["ids"], r["size"], r["held"], r["words"])
    words, pairs = block.back(np.concatenate([unplanes(c, np.uint64) for _, c in parts]))
    out = {k: [r[k]] for k in ("block", "row", "doc_id", "held", "size", "ids")} | {"of_words": [planes(words)], "of_pairs": [planes(pairs)]}
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), *[pa.binary()] * 3]
    return pa.table([pa.array(out[k], t) for k, t in zip(out, types, strict=True)], names=list(out))


def _level(context: np.ndarray) -> np.ndarray:
    """Bucket of a context count: 0 for unseen, else one more than the binary logarithm."""
    return np.minimum(np.floor(np.log2(np.maximum(context, 0.5))).astype(np.int64) + 1, _LEVELS - 1)


def _bin(ratio: np.ndarray) -> np.ndarray:
    return np.where(ratio > 0, np.clip(np.floor(np.log2(np.maximum(ratio, 1e-300)) * _STEP).astype(np.int64) + _BINS // 4, 1, _BINS - 1), 0)


def _middle(b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, 2.0 ** ((b - _BINS // 4 + 0.5) / _STEP), 0.0)


def _counts(r: dict) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray]:
    block = _block_of(r["ids"], r["size"], r["held"], None)
    words, pairs = unplanes(r["of_words"], np.uint64).astype(np.float64), unplanes(r["of_pairs"], np.uint64).astype(np.float64)
    return block, words[block.token], words[block.context], pairs[block.pair]


def deleted_histogram(counted: DataFrame, n: int, v: int) -> DataFrame:
    """How many training tokens fall into each cell of context bucket and ratios, their own count deleted."""

    def run(batches):
        for batch in batches:
            for r in rows_of(batch):
                block, word, context, pair = _counts(r)
                word, context, pair = (x[block.train] - 1 for x in (word, context, pair))
                single = _bin(word / max(n - 1, 1) * (v + 1))
                double = _bin(np.where(context > 0, pair / np.maximum(context, 1), 0) * (v + 1))
                cells, counts = np.unique((_level(context) * _BINS + double) * _BINS + single, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts)], ["cell", "n"])

    return counted.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def em(cells: np.ndarray, counts: np.ndarray, steps: int = EM_STEPS) -> np.ndarray:
    """Weights of pair, word and uniform estimate for each context bucket; unseen contexts have no pair."""
    level, double, single = cells // (_BINS * _BINS), cells // _BINS % _BINS, cells % _BINS
    likely = np.stack([_middle(double), _middle(single), np.ones(len(cells))])
    weights = np.full((_LEVELS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    for _ in range(steps):
        share = weights[level].T * likely
        share *= counts / share.sum(axis=0)
        new = np.stack([np.bincount(level, s, minlength=_LEVELS) for s in share], axis=1) + 0.01 * weights
        weights = new / new.sum(axis=1, keepdims=True)
    return weights


def scores(counted: DataFrame, weights: np.ndarray, n: int, v: int) -> DataFrame:
    weights = weights.tolist()

    def run(batches):
        mix = np.array(weights)
        for batch in batches:
            for r in rows_of(batch):
                block, word, context, pair = _counts(r)
                own = mix[_level(context)]
                p = own[:, 0] * np.where(context > 0, pair / np.maximum(context, 1), 0) + own[:, 1] * (word / max(n, 1)) + own[:, 2] / (v + 1)
                base = np.log10((word + ALPHA) / (n + ALPHA * (v + 1)))
                sums = [np.add.reduceat(x, block.starts) for x in ((word > 0).astype(np.int64), base, np.log10(p))]
                yield pa.RecordBatch.from_arrays([pa.array(r["row"], pa.int64()), pa.array(r["doc_id"], pa.int64()), pa.array(r["held"], pa.bool_()), pa.array(block.sizes, pa.int64()), *map(pa.array, sums)], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    found = counted.mapInArrow(run, _SCORES)
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    whole = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *sums)
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def score_documents(spark: SparkSession, docs: DataFrame, block: int = BLOCK, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    scratch = Scratch(spark, "lm")
    blocks = scratch.write(to_blocks(docs, block), "blocks")
    n_keys = blocks.agg(F.sum("n_keys")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, n_keys / bucket_keys)))))
    with few_rows(spark):
        said = scratch.write(ask(blocks, bits).groupBy("bucket").applyInArrow(answer, _SAID), "said")
        v, n = (int(x or 0) for x in said.agg(F.sum("n_words"), F.sum("n_tokens")).first())
        scratch.drop()
        counted = scratch.write(blocks.groupBy("block").cogroup(said.select("block", "bucket", "counts").groupBy("block")).applyInArrow(join_counts, _COUNTED), "counted")
        scratch.drop("blocks", "said")
        found = deleted_histogram(counted, n, v).toPandas()
        weights = em(found["cell"].to_numpy(dtype=np.int64), found["n"].to_numpy(dtype=np.float64))
        result = scratch.write(scores(counted, weights, n, v), "scores")
    scratch.drop("counted")
    return result
