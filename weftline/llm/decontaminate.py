"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all documents give the idf (a table of fixed size).
2. TF-IDF rows of the benchmark's passages, weighted up, and of all documents, over the words of the benchmark, are
   factorised by a distributed randomised SVD: the products with the sparse rows run on the executors, only matrices
   of bounded size (words of the block x rank) come to the driver. All documents together weigh as much as DOCUMENTS
   rows, so that passages keep their share of the space however many documents there are.
3. Every document is cut into overlapping windows of words. A window's cosine with each passage in the latent
   space is found where an upper bound, a running sum over words, lets it reach the threshold; words whose weight in
   that space is under 0.01 are left out of both.
   Cosines shrink where a passage is short for the window or so widespread that its own copies lower its weights, so
   a count of words goes beside them: a leak keeps half a passage's words, hence so many of its rarer ones, whatever
   their weights. Windows of this count fit the passage's length, and it misses no leak that lies within REACH times
   that length.
4. Candidates are verified on the words themselves: the longest common subsequence of passage and window, and,
   for paraphrases that keep less of the order, also the passage's weighted words and its answer (its last words).

The benchmark is read in blocks of about ITEMS passages, one pass over the documents a block, so nothing that
is broadcast grows with either table. The latent space of a block has more directions than the block has passages:
with fewer, passages shrink in it and even exact copies miss the threshold. No document is shuffled: each is searched where it is read.

Defined results: null text counts as empty and is clean; passages without words match nothing; ties keep all
items, in order; a passage without item_id is searched like any other, its null comes last in item_ids; rows are treated alone, so repeated and null doc_ids give a row each; an empty table gives no
rows, an empty benchmark clean ones; other columns are ignored by find_leaks() and kept by drop_leaks().
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty

WINDOW, STRIDE = 64, 32
ITEMS = 200
DOCUMENTS = 1000
RANK, OVERSAMPLE = 256, 16  # ITEMS / RANK stays well under 1
EMPHASIS = 4.0
COSINE = 0.3
REACH, RARER = 1.5, 0.7
LCS_ALONE, LCS_WITH_ANSWER, WEIGHT_SHARE, ANSWER_SHARE = 0.75, 0.5, 0.6, 0.75
_BITS, _SLOTS = 17, 22
_MASK = (1 << _BITS) - 1
#: ASCII marks become spaces; letters, digits and all bytes beyond ASCII make words.
_MARKS = bytes(b if b > 127 or chr(b).isalnum() or b == 95 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case words as UTF-8."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_MARKS).split()


def hashes(words) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.int64)


def bucket(word: bytes) -> int:
    return zlib.crc32(word) & _MASK


def span_of(n: int) -> int:
    """For a passage of n words the stride of windows twice as long, so that REACH * n words lie in one of them."""
    span = STRIDE
    while span < REACH * n:
        span = span * 3 // 2 if span & (span - 1) == 0 else span // 3 * 4  # 32, 48, 64, 96, ...
    return span


def cut(sizes: np.ndarray, window: int, stride: int) -> tuple[np.ndarray, ...]:
    """Windows of texts of these sizes that stand in a row: text, start in it, start and end in the row."""
    per = np.where(sizes > 0, -(-np.maximum(1, sizes - (window - stride)) // stride), 0)
    text = np.repeat(np.arange(len(sizes)), per)
    local = (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * stride
    first = (np.cumsum(sizes) - sizes)[text]
    return text, local, first + local, first + np.minimum(local + window, sizes[text])


def held_enough(term: np.ndarray, sizes: np.ndarray, span: int, shares: np.ndarray, most: np.ndarray, rows: int = 1 << 14) -> list[list[int]]:
    """(number of the window in cut(sizes, 2 * span, span), column) where the shares of a window's distinct words reach 1."""
    count = np.where(sizes > 0, np.maximum(1, -(-sizes // span) - 1), 0)
    firsts, base = np.cumsum(sizes) - sizes, np.cumsum(count) - count
    at = np.flatnonzero(most[term] > 0)
    text = np.searchsorted(firsts + sizes, at, side="right")
    local = (at - firsts[text]) // span  # in the windows of this number and the one before
    one, two = local < count[text], local > 0
    width = len(shares)
    keys = np.concatenate([(base[text] + local)[one] * width + term[at[one]], (base[text] + local - 1)[two] * width + term[at[two]]])
    keys.sort()
    keys = keys[np.flatnonzero(np.diff(keys, prepend=-1))]
    window, term = keys // width, keys % width
    begins = np.flatnonzero(np.diff(window, prepend=-1))
    if len(begins):  # the most that any column can reach
        sizes = np.diff(np.append(begins, len(keys)))
        able = np.repeat(np.add.reduceat(most[term], begins) >= 1 - 1e-4, sizes)
        window, term = window[able], term[able]
        begins = np.flatnonzero(np.diff(window, prepend=-1))
    out, low = [], 0
    while low < len(begins):  # bounded pieces
        high = max(low + 1, int(np.searchsorted(begins, begins[low] + rows)))
        end = begins[high] if high < len(begins) else len(term)
        held = np.add.reduceat(shares[term[begins[low] : end]], begins[low:high] - begins[low], axis=0)
        out += [[int(window[begins[low + k]]), c] for k, c in np.argwhere(held >= 1 - 1e-4).tolist()]
        low = high
    return out


def windows(n: int) -> range:
    """Starts of the windows of a text of n words; the last reaches its end."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE) if n else range(0)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """bucket, documents with a word in it; and in bucket -1 the number of documents. At most 2^17 + 1 rows."""

    def run(batches):
        counts, n = np.zeros(1 << _BITS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts[hashes(set(words_of(text))) & _MASK] += 1  # a bucket named twice still gets 1
                n += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], n))], ["bucket", "n"])

    return text_or_empty(docs).select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def idf_table(docs: DataFrame) -> np.ndarray:
    rows = document_frequencies(docs).toPandas()
    counts = np.zeros((1 << _BITS) + 1)
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return np.log((1 + counts[-1]) / (1 + counts[:-1])).astype(np.float64) + 1e-3


def weigh(words: list[bytes], idf: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Distinct words and their TF-IDF of length 1."""
    tf: dict[bytes, float] = {}
    for w in words:
        tf[w] = tf.get(w, 0.0) + idf[bucket(w)]
    v = np.array(list(tf.values()))
    return list(tf), v / max(np.linalg.norm(v), 1e-12)


# ------------------------------------------------------------------------------------- randomised SVD


def sparse_rows(docs: DataFrame, numbers: dict[bytes, int], idf: np.ndarray) -> DataFrame:
    """Of each document that holds any of the numbered words: their numbers (int32) and TF-IDF (float32), where the
    TF-IDF of all its words has length 1."""

    def run(batches):
        for batch in batches:
            terms, weights = [], []
            for text in batch.column(0).to_pylist():
                count = Counter(words_of(text))
                found = list(map(numbers.get, count))
                w = np.fromiter(count.values(), dtype=np.float64, count=len(count)) * idf[hashes(count) & _MASK]
                own = np.array([k for k, t in enumerate(found) if t is not None], dtype=np.int64)
                if len(own):
                    terms.append(np.array([found[k] for k in own], dtype=np.int32).tobytes())
                    weights.append((w[own] / max(np.linalg.norm(w), 1e-12)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), pa.array(weights, pa.binary())], ["terms", "weights"])

    return text_or_empty(docs).select("text").mapInArrow(run, "terms binary, weights binary")


def gram_times(rows: DataFrame, z: np.ndarray) -> np.ndarray:
    """Transposed rows times rows times z, which has a row per word: partial sums on each task, met by word."""
    shared, schema = rows.sparkSession.sparkContext.broadcast(z.astype(np.float32)), "term int, y binary"

    def emit(out, terms: list[int]):
        for low in range(0, len(terms), 2048):
            some = terms[low : low + 2048]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([out[t].tobytes() for t in some], pa.binary())], ["term", "y"])

    def part(batches):
        z = shared.value
        out, met = np.zeros_like(z), np.zeros(len(z), dtype=bool)
        for batch in batches:
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t, x = np.frombuffer(t, dtype=np.int32), np.frombuffer(x, dtype=np.float32)
                out[t] += np.outer(x, x @ z[t])
                met[t] = True
        yield from emit(out, np.flatnonzero(met).tolist())

    def whole(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[t] = sums.get(t, 0.0) + np.frombuffer(y, dtype=np.float32).astype(np.float64)
        yield from emit(sums, list(sums))

    out = np.zeros(z.shape)
    for r in rows.mapInArrow(part, schema).repartition("term").mapInArrow(whole, schema).collect():
        out[r.term] = np.frombuffer(r.y)
    return out


def latent_space(rows: DataFrame, share: float, passages: list[tuple[list[int], np.ndarray]], n_words: int, rank: int = RANK) -> np.ndarray:
    """Right singular vectors, a row per word, of the documents' rows, their squares times `share`, and the passages' on
    top of each other: one power iteration from random directions, then the small factor."""
    width = min(rank + OVERSAMPLE, n_words)

    def times(z: np.ndarray) -> np.ndarray:
        out = share * gram_times(rows, z)
        for t, x in passages:
            out[t] += np.outer(x, x @ z[t])
        return out

    q = np.linalg.qr(times(np.random.default_rng(7).standard_normal((n_words, width))))[0]
    small = q.T @ times(q)
    values, u = np.linalg.eigh((small + small.T) / 2)
    best = [k for k in np.argsort(values)[::-1][:rank] if values[k] > 1e-9 * max(values.max(), 1e-12)]
    return q @ u[:, best]


# --------------------------------------------------------------------------------------------- search


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, a bit per word of a."""
    at: dict = {}
    for k, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for places in filter(None, map(at.get, b)):
        hit = row & places
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


class Item:
    def __init__(self, item_id: int, words: list[bytes], idf: np.ndarray):
        self.item_id, self.words = item_id, words
        self.answer = words[-max(4, len(words) // 4) :]
        self.weight = {w: float(idf[bucket(w)]) for w in words}
        self.total = sum(self.weight.values())

    def found_in(self, words: list[bytes]) -> float:
        """Share of the passage's words found in order, or 0 if that is no leak."""
        here = set(words)
        if sum(map(here.__contains__, self.words)) < LCS_WITH_ANSWER * len(self.words):  # bounds what follows
            return 0.0
        share = lcs(self.words, words) / len(self.words)
        if share >= LCS_ALONE:
            return share
        if share < LCS_WITH_ANSWER:
            return 0.0
        kept = sum(x for w, x in self.weight.items() if w in here) / self.total
        return share if kept >= WEIGHT_SHARE and lcs(self.answer, words) >= ANSWER_SHARE * len(self.answer) else 0.0


class Index:
    """Latent vectors of a block of passages and of the words that speak for any of them, and counts of rarer words."""

    def __init__(self, items: list[Item], vectors: dict[bytes, np.ndarray], idf: np.ndarray):
        self.items, self.idf = items, idf
        rank = len(next(iter(vectors.values()), np.zeros(1)))
        self.queries = np.zeros((len(items), rank))
        for k, item in enumerate(items):
            names, weights = weigh(item.words, idf)
            self.queries[k] = sum((x * vectors[w] for w, x in zip(names, weights, strict=True) if w in vectors), np.zeros(rank))
        names = sorted(vectors)
        table = np.array([vectors[w] for w in names]).reshape(-1, rank)
        most = np.concatenate([np.abs(table[k : k + 4096] @ self.queries.T).max(axis=1, initial=0.0) for k in range(0, len(table), 4096)]) if len(table) else np.zeros(0)
        # words by hash; the last row: other words
        of_names, in_items = hashes(names), [hashes(item.words) for item in items]
        own = np.unique(np.concatenate([of_names, *in_items]))
        strong = np.flatnonzero(most >= 0.01)
        at = np.searchsorted(own, of_names[strong])
        self.table = np.zeros((len(own) + 1, rank), dtype=np.float32)
        self.table[at] = table[strong]
        self.most = np.zeros(len(own) + 1)
        self.most[at] = most[strong]
        self.queries = self.queries.astype(np.float32)
        # by stride of windows: numbers of its passages, each word's share of the count a leak needs, its most
        spans: dict[int, list[int]] = {}
        for k, item in enumerate(items):
            spans.setdefault(span_of(len(item.words)), []).append(k)
        self.counts = {}
        for span, numbers in sorted(spans.items()):
            shares = np.zeros((len(own) + 1, len(numbers)), dtype=np.float32)
            for c, k in enumerate(numbers):
                n, free = len(in_items[k]), int((1 - LCS_WITH_ANSWER) * len(in_items[k]))
                order = np.lexsort((in_items[k], -idf[in_items[k] & _MASK]))
                rarer = in_items[k][order[: max(free + 1, math.ceil(RARER * n))]]
                np.add.at(shares[:, c], np.searchsorted(own, rarer), 1 / (len(rarer) - free))
            self.counts[span] = np.array(numbers), shares, shares.max(axis=1).astype(np.float64)
        # the number of each word by its hash: one slot a word, and a short list of those whose slot is taken
        self.slot = np.full(1 << _SLOTS, len(own), dtype=np.int32)
        self.slot[own & ((1 << _SLOTS) - 1)] = np.arange(len(own))
        self.own = np.append(own, -1)
        self.others = [(int(h), k) for k, h in enumerate(own.tolist()) if self.slot[h & ((1 << _SLOTS) - 1)] != k]

    def terms(self, found: np.ndarray) -> np.ndarray:
        term = self.slot[found & ((1 << _SLOTS) - 1)].astype(np.int64)
        term[self.own[term] != found] = len(self.own) - 1
        for h, k in self.others:
            term[found == h] = k
        return term

    def candidates(self, texts: list[list[bytes]]) -> list[tuple[int, int, int, int]]:
        """(text, start and end of a stretch, number of item) wherever the latent cosine reaches the threshold or
        the window holds as many of the passage's rarer words as a leak needs."""
        sizes = np.array([len(w) for w in texts], dtype=np.int64)
        found = hashes(chain.from_iterable(texts))
        weight, term = self.idf[found & _MASK], self.terms(found)
        text, local, starts, ends = cut(sizes, WINDOW, STRIDE)
        squares = np.concatenate([[0.0], np.cumsum(weight * weight)])
        bounds = np.concatenate([[0.0], np.cumsum(weight * self.most[term])])
        length = np.sqrt(np.maximum(squares[ends] - squares[starts], 1e-12))
        out = []
        able, single = np.flatnonzero(bounds[ends] - bounds[starts] >= COSINE * length), weight.astype(np.float32)
        for low in range(0, len(able), 1024):  # bounded pieces
            some = able[low : low + 1024]
            latent = np.array([single[a:b] @ self.table[term[a:b]] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
            for k, j in np.argwhere(latent @ self.queries.T >= COSINE * length[some, None]).tolist():
                k, reach = some[k], max(STRIDE, len(self.items[j].words))
                out.append((int(text[k]), max(0, int(local[k]) - reach), int(local[k]) + WINDOW + reach, j))
        for span, (numbers, shares, most) in self.counts.items():
            text, local, _, _ = cut(sizes, 2 * span, span)
            out += [(int(text[k]), int(local[k]), int(local[k]) + 2 * span, int(numbers[c])) for k, c in held_enough(term, sizes, span, shares, most)]
        return out

    def leaks(self, texts: list[str | None]) -> list[dict[int, float]]:
        """For each text, item_id -> share of the item's words found in order."""
        out: list[dict[int, float]] = [{} for _ in texts]
        for low in range(0, len(texts) if self.items else 0, 256):
            words = [words_of(t or "") for t in texts[low : low + 256]]
            for i, start, end, k in self.candidates(words):
                item, own = self.items[k], out[low + i]
                if own.get(item.item_id, 0.0) < 1:
                    share = item.found_in(words[i][start:end])
                    if share:
                        own[item.item_id] = max(share, own.get(item.item_id, 0.0))
        return out


def build_index(spark: SparkSession, docs: DataFrame, passages: list[tuple[int, str]], idf: np.ndarray) -> Index:
    items = [Item(i, w, idf) for i, w in ((i, words_of(t or "")) for i, t in passages) if w]
    if not items:
        return Index([], {}, idf)
    terms = sorted({w for item in items for w in item.words})  # other words speak for no passage; they only count in lengths
    numbers = {w: k for k, w in enumerate(terms)}
    own = []
    for item in items:
        names, weights = weigh(item.words, idf)
        own.append(([numbers[w] for w in names], EMPHASIS * weights))
    scratch = Scratch(spark, "lsa")
    rows = scratch.write(sparse_rows(docs, numbers, idf), "rows")
    space = latent_space(rows, DOCUMENTS / max(DOCUMENTS, rows.count()), own, len(terms), max(RANK, len(items) * RANK // ITEMS))
    scratch.drop("rows")
    return Index(items, dict(zip(terms, space, strict=True)), idf)


def _nulls_last(item_id: int | None) -> tuple[bool, int]:
    return item_id is None, item_id or 0


def in_order(items: list) -> list[tuple[int | None, str]]:
    """Passages by id, those without one last, then by text."""
    return sorted(((r.item_id, r.text) for r in items), key=lambda x: (*_nulls_last(x[0]), x[1]))


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, block: int = ITEMS) -> DataFrame:
    """doc_id, leaked, item_ids (ascending), share (most of any item's words found in order)."""
    idf = idf_table(docs)
    items = benchmark.where("text is not null").select("item_id", "text").distinct()
    blocks = max(1, -(-items.count() // min(block, ITEMS)))
    found = None
    for k in range(blocks):  # a bounded block of passages against all documents
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast(build_index(spark, docs, in_order(some), idf))

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                hits = index.leaks(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(h, key=_nulls_last) for h in hits], pa.list_(pa.int64())), pa.array([max(h.values(), default=0.0) for h in hits], pa.float64())], ["doc_id", "item_ids", "share"])

        part = text_or_empty(docs).mapInArrow(run, "doc_id long, item_ids array<long>, share double")
        if blocks > 1:
            part = part.where(F.size("item_ids") > 0)
        found = part if found is None else found.union(part)
    if blocks > 1:  # leaks are few: only they meet by document
        hits = found.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.max("share").alias("share"))
        hits = hits.select(F.col("doc_id").alias("_doc_id"), "item_ids", "share")
        found = docs.select("doc_id").join(hits, F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left")
        found = found.select("doc_id", F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("share", F.lit(0.0)).alias("share"))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("leaked"), "item_ids", "share")


def drop_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, block: int = ITEMS) -> DataFrame:
    """The rows of docs, all columns, in which no benchmark passage is found; judged in place, so nothing is joined."""
    idf = idf_table(docs)
    items = benchmark.where("text is not null").select("item_id", "text").distinct()
    blocks, at = max(1, -(-items.count() // min(block, ITEMS))), docs.columns.index("text")
    stay = docs
    for k in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast(build_index(spark, docs, in_order(some), idf))

        def run(batches, shared=shared):
            for batch in batches:
                yield batch.filter(pa.array([not x for x in shared.value.leaks(batch.column(at).to_pylist())], pa.bool_()))

        stay = stay.mapInArrow(run, docs.schema)
    return stay
