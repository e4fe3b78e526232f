"""Repeated passages by sliding sentence spans.

At every sentence begins a run, and at every sentence ends one: the fewest consecutive sentences, two at least,
that hold MIN_WORDS words. A sentence has at most MAX_WORDS words: longer stretches without an end mark are cut
after every so many. Runs are hashed (128 bits) and met globally; of equal runs the first, by doc_id and place, stays, and every sentence that any other run covers goes.
A passage that is as long as a run is covered from end to end by runs inside it: by the one that begins at each
sentence or, where that reaches beyond the passage, by the one that ends with it.

Hashes are counted with map-side aggregation, and only rows of repeated hashes travel on. Hashes of more than a
thousandth of all runs, fewer than a thousand by that, are broadcast, so their rows stay where they are; no other
hash fills a task of the shuffled joins.

Defined results: null text stays null; white space between words doesn't matter; runs shorter than MIN_WORDS
at the end of a text are no runs; rows of equal doc_id and text count as one document and are cleaned alike; rows of one doc_id and different texts are
documents of their own, in an order that a hash of the text gives;
a null doc_id comes first; an empty table gives no rows; a text that loses all its sentences stays as an empty
one; other columns are kept.
"""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

MIN_SENTENCES = 2
MIN_WORDS = 15
MAX_WORDS = 40
#: A hash with more than this part of all runs is hot: fewer than HOT can be, so they are broadcast.
HOT = 1000

#: A sentence with the marks and white space after it; a mark inside a word or number ends nothing.
_SENTENCE = re.compile(r"(?:[^.!?\n]|[.!?](?=[^\s.!?]))+[.!?]*\s*|[.!?\n]+\s*")
_WORDY = re.compile(r"\w")
_PIECE = re.compile(rf"\s*(?:\S+\s*){{1,{MAX_WORDS}}}")


def sentences(text: str) -> list[str]:
    """Stretches that make up the text again; what holds no word goes with the sentence before it."""
    out: list[str] = []
    for part in _SENTENCE.findall(text):
        if out and not _WORDY.search(part):
            out[-1] += part
        elif len(part) > 2 * MAX_WORDS and len(part.split()) > MAX_WORDS:
            out += _PIECE.findall(part)
        else:
            out.append(part)
    return out


def runs(text: str) -> list[tuple[int, int, int, int]]:
    """Hash (two signed halves), first sentence, sentences of every run."""
    words = [s.split() for s in sentences(text)]
    plain = [" ".join(w) for w in words]
    before = [0, *accumulate(map(len, words))]
    found: set[tuple[int, int]] = set()
    end, begin = 0, 0
    for at in range(len(words)):
        end = max(end, at + MIN_SENTENCES)
        while end < len(words) and before[end] - before[at] < MIN_WORDS:
            end += 1
        if end <= len(words) and before[end] - before[at] >= MIN_WORDS:
            found.add((at, end))
        last = at + 1  # the run that ends here
        while last - begin > MIN_SENTENCES and before[last] - before[begin + 1] >= MIN_WORDS:
            begin += 1
        if last - begin >= MIN_SENTENCES and before[last] - before[begin] >= MIN_WORDS:
            found.add((begin, last))
    out = []
    for at, end in sorted(found):
        digest = xxhash.xxh3_128_digest(" ".join(plain[at:end]))
        out.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), at, end - at))
    return out


def repeated_spans(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, h (hash of the text), numbers of the sentences that go."""

    def find(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                rows = [(d, h, a, b, at << 16 | min(n, 65535)) for d, h, t in zip(*(some.column(k).to_pylist() for k in range(3)), strict=True) for a, b, at, n in runs(t)]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "h", "a", "b", "span"])

    keyed = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h"), "text")
    spans = scratch.write(keyed.mapInArrow(find, "doc_id long, h long, a long, b long, span long"), "spans")
    again = scratch.write(spans.groupBy("a", "b").agg(F.count("*").alias("m")).where("m > 1"), "again")
    # counts of all hashes sum up to the rows, so fewer than HOT hashes can hold more than a share of 1 / HOT each
    limit = spans.count() / HOT
    hot, others = F.broadcast(again.where(F.col("m") > limit).select("a", "b")), again.where(F.col("m") <= limit).select("a", "b")
    met_hot = scratch.write(spans.join(hot, ["a", "b"]), "met-hot")
    met = scratch.write(spans.join(hot, ["a", "b"], "left_anti").join(others, ["a", "b"]), "met")
    first = lambda df: df.groupBy("a", "b").agg(F.min(F.struct("doc_id", "h", "span")).alias("first"))
    later = met_hot.join(F.broadcast(first(met_hot)), ["a", "b"]).unionByName(met.join(first(met), ["a", "b"]))
    later = later.where(F.struct("doc_id", "h", "span") > F.col("first"))
    start, n = F.shiftright("span", 16), F.col("span").bitwiseAND(65535)
    each = later.select("doc_id", "h", F.explode(F.sequence(start, start + n - 1)).alias("k")).distinct()
    gone = scratch.write(each.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list("k")).alias("gone")), "gone")  # at most a document's sentences
    scratch.drop("spans", "again", "met-hot", "met")
    return gone


def dedup_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with their columns, texts without repeated sentences, and n_sentences, removed (their numbers)."""
    gone = repeated_spans(spark, docs, Scratch(spark, "spans"))
    gone = gone.select(F.col("doc_id").alias("_doc_id"), F.col("h").alias("_h"), F.col("gone").alias("removed"))
    extra = [c for c in docs.columns if c not in ("n_sentences", "removed")]
    joined = docs.select(*extra).join(gone, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.xxhash64("text") == F.col("_h")), "left").select(*extra, "removed")
    at = extra.index("text")

    def clean(batches):
        for batch in batches:
            texts, counts = [], []
            for text, out in zip(batch.column(at).to_pylist(), batch.column("removed").to_pylist(), strict=True):
                parts = sentences(text or "")
                counts.append(len(parts))
                if out:
                    out = set(out)
                    text = "".join(s for k, s in enumerate(parts) if k not in out)
                texts.append(text)
            columns = [*batch.columns, pa.array(counts, pa.int64())]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "n_sentences"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields)
    return joined.mapInArrow(clean, f"{schema}, n_sentences long")
