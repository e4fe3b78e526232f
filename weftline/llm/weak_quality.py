"""Quality and toxicity from weak labels.

Overlapping labellers vote good, bad or abstain on every document, each on evidence of its own: of quality, measures of
the page, each of which knows one kind of bad page and abstains elsewhere (that a page has no symbols doesn't make it
good, so none votes good; silence of all does); of toxicity, lists of insults, and lexicons of words and word beginnings that mark toxic texts among the
annotated ones. A lexicon is learnt from one fold of the annotated rows and says nothing of these rows themselves, so
that its accuracy isn't judged on what it was made of. Votes are counted by pattern over all documents (a few
thousand patterns at most) and expectation-maximisation finds how often each labeller votes either way or abstains in
each class. The annotators' table anchors the classes: its votes are trusted (TRUST), the prior starts as the
share among annotated rows, and in the labellers' rates these weigh ANCHOR times as much as all others (labellers that
never meet can't be told right from wrong by each other). The posterior of a document's pattern is a soft label, from which a hashed linear scorer learns (words and their first
letters, and buckets of page measures). There are two such models, quality and toxicity, over one pass of features.

Bounded by parameters: lexicons are learnt from at most about SAMPLE / 2 annotated documents, the scorer is fitted on at
most 2 SAMPLE, half of them annotated, in one task. Counting votes and scoring cover all documents, one pass each
and no shuffle of texts.

Defined results: null text counts as empty; rows are treated alone, so ties, repeated and null doc_ids give a
row each; several annotations of a document count as their maximum, a null annotation as none; without annotations
the heuristics stand alone; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty
from .quality_rules import Page, sampled

SAMPLE = 10_000
DIMS = 1 << 18
EPOCHS = 6
EM_STEPS = 50
TRUST = 0.98
ANCHOR = 10.0  # how much the annotated rows weigh against all others together
FOLDS = 3
#: What makes a feature part of a lexicon: documents of its fold that hold it, the share of toxic ones, features at most.
SUPPORT, PRECISION, LEXICON = 3, 0.8, 300
#: What a labeller says of rows that it was made of: nothing, and that isn't counted.
MISSING = 2
START = 4.0  # log odds that one vote is worth before anything is known of its labeller

#: Insults that the toxicity labellers look for, each labeller for its own.
INSULTS = (
    frozenset(["idiot", "moron", "stupid", "dumb"]),
    frozenset(["pathetic", "worthless", "disgusting", "loser"]),
    frozenset(["scum", "trash", "filth", "vermin"]),
    frozenset(["clown", "jerk", "bastard", "imbecile"]),
)
_LETTERS = re.compile(r"[^\W\d_]+")

Vote = int


def measures(page: Page) -> tuple[float, float, float, float]:
    n = max(1, page.n_words)
    return page.n_symbols / n, page.n_capitals / n, page.n_repeat_words / n, page.n_dup_lines / max(1, len(page.lines))


def votes(page: Page, words: set[str], lexicons: list[frozenset[str]] = []) -> tuple[tuple[Vote, ...], tuple[Vote, ...]]:  # noqa: B006
    """Of quality (1 good, -1 bad, 0 abstains) and of toxicity (1 toxic, -1 not, 0 abstains)."""
    symbols, capitals, repeats, lines = measures(page)
    some = page.n_words >= 10
    quality = tuple(-int(x) for x in (symbols > 0.1, some and capitals > 0.5, repeats > 0.5, not some, lines > 0.5))
    toxicity = [int(not words.isdisjoint(own)) for own in INSULTS]
    held = marks(words) if lexicons else set()
    toxicity += [MISSING if not own else 0 if not some else -1 if held.isdisjoint(own) else 1 for own in lexicons]  # an empty one knows nothing
    return quality, tuple(toxicity)


class LabelModel:
    """Two classes, labellers independent given the class; EM over counts of vote patterns. Of each labeller the rates
    of all three answers are estimated in either class. A pattern's first vote is the annotators'."""

    def __init__(self, patterns: dict[tuple[Vote, ...], int], steps: int = EM_STEPS):
        width = len(next(iter(patterns), (0,)))
        v = np.array(list(patterns) or [(0,) * width]) + 1
        n = np.array(list(patterns.values()) or [0], dtype=np.float64)
        said = v[:, 0] != 1
        good = (n * (v[:, 0] == 2)).sum()
        self.anchored = n[said].sum() > 0
        self.prior = (good + 1) / (n[said].sum() + 2)
        weight = n * np.where(said, max(1.0, ANCHOR * n[~said].sum() / max(1.0, n[said].sum())), 1.0)
        told = v[:, 1:] != MISSING + 1
        post = 1 / (1 + np.exp(-(np.log(self.prior / (1 - self.prior)) + START * ((v[:, 1:] - 1) * told).sum(axis=1))))
        post = np.where(said, np.where(v[:, 0] == 2, TRUST, 1 - TRUST), post)  # the annotators and the majority, to begin with
        self.table = np.full((width, 2, 3), 1.0)
        self.table[0] = [[TRUST, 1, 1 - TRUST], [1 - TRUST, 1, TRUST]]
        for _ in range(steps):
            self.prior = ((n * post).sum() + 1) / (n.sum() + 2)
            for j, (c, share) in product(range(1, width), enumerate((1 - post, post))):
                counts = np.bincount(v[:, j], weight * share, minlength=4)[:3] + 0.1
                self.table[j, c] = counts / counts.sum()
            post = self._posterior(v)

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        logs = np.concatenate([np.log(self.table), np.zeros((len(self.table), 2, 1))], axis=2)  # nothing for a missing vote
        odds = np.log(self.prior / (1 - self.prior)) + sum(logs[j, 1, v[:, j]] - logs[j, 0, v[:, j]] for j in range(v.shape[1]))
        return 1 / (1 + np.exp(-odds))

    def posterior(self, pattern: tuple[Vote, ...]) -> float:
        return float(self._posterior(np.array([pattern]) + 1)[0])


def marks(words: set[str]) -> set[str]:
    """What a lexicon may hold: words and their beginnings."""
    return words | {f"^{w[:4]}" for w in words}


def words_of(text: str) -> set[str]:
    return set(_LETTERS.findall(text.lower()))


def buckets(page: Page) -> list[str]:
    """Page measures as words that no text holds."""
    return [f"#{k}:{min(9, int(10 * x))}" for k, x in enumerate(measures(page))] + [f"#n:{page.n_words.bit_length()}"]


def slots(word: str) -> tuple[int, int]:
    """Two hashed features of a word: itself and its first letters."""
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % DIMS, zlib.crc32(("^" + word[:4]).encode("utf-8", "surrogatepass")) % DIMS


def fit_scorer(rows: list[tuple[np.ndarray, float, float]], epochs: int = EPOCHS, seed: int = 5) -> np.ndarray:
    """Logistic regressions of quality and toxicity on soft labels: weights by slot, the last slot the bias."""
    weights, scale = np.zeros((2, DIMS + 1)), np.full((2, DIMS + 1), 1e-3)
    rnd = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rnd.permutation(len(rows)):
            at, *labels = rows[k]
            norm = 1 / np.sqrt(len(at))
            for head, label in enumerate(labels):
                p = 1 / (1 + np.exp(-np.clip(weights[head, at].sum() * norm, -30, 30)))
                step = (p - label) * norm
                scale[head, at] += step * step
                weights[head, at] -= 0.5 * step / np.sqrt(scale[head, at])
    return weights.astype(np.float32)


class Scorer(dict):
    """word -> its weight for quality + i times that for toxicity."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.both = weights[0] + 1j * weights[1].astype(np.complex128)

    def __missing__(self, word: str) -> complex:
        if len(self) > 1_000_000:
            self.clear()
        a, b = slots(word)
        self[word] = found = complex(self.both[a] + self.both[b])
        return found

    def __call__(self, page: Page, words: set[str]) -> tuple[float, float]:
        names = [*words, *buckets(page)]
        total = (sum(map(self.__getitem__, names)) + complex(self.both[-1])) / np.sqrt(2 * len(names) + 1)
        return tuple(float(1 / (1 + np.exp(-np.clip(x, -30, 30)))) for x in (total.real, total.imag))


def learn_lexicons(docs: DataFrame, said: DataFrame, folds: int = FOLDS) -> list[frozenset[str]]:
    """Features of toxic texts, a lexicon for each fold of the annotated rows. docs (doc_id, text), said (doc_id, t, fold)."""
    def run(batches):
        for batch in batches:
            rows = [(fold, t, m) for text, t, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True) for m in marks(words_of(text))]
            columns = zip(*rows, strict=True) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["fold", "t", "mark"])

    met = docs.join(said.where("t is not null"), "doc_id").select("text", F.col("t").cast("long"), F.col("fold").cast("long"))
    counted = met.mapInArrow(run, "fold long, t long, mark string").groupBy("fold", "mark").agg(F.sum("t").alias("toxic"), F.count("*").alias("n"))
    own = counted.where((F.col("toxic") >= SUPPORT) & (F.col("toxic") >= PRECISION * F.col("n")))
    first = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("toxic"), "n", "mark"))
    rows = own.withColumn("k", first).where(F.col("k") <= LEXICON).collect()  # folds x LEXICON rows
    return [frozenset(r.mark for r in rows if r.fold == k) for k in range(folds)]


def cast_votes(docs: DataFrame, lexicons: list[frozenset[str]], said: dict[int, int], under: int, sample: int) -> DataFrame:
    """doc_id, fold (of annotated rows that lexicons were learnt from), the votes, and for chosen rows the scorer's slots."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for doc_id, h, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                page, words = Page(text), words_of(text)
                chosen = (h % (1 << 30) < under or doc_id in said) and h not in seen and len(seen) < 2 * sample
                at = None
                if chosen:
                    seen.add(h)
                    at = np.array([s for w in sorted(words | set(buckets(page))) for s in slots(w)] + [DIMS], dtype=np.int32).tobytes()
                quality, toxicity = votes(page, words, lexicons)
                fold = said.get(doc_id)
                if fold is not None and lexicons:
                    toxicity = tuple(MISSING if k == len(INSULTS) + fold else x for k, x in enumerate(toxicity))
                for column, value in zip(out, (doc_id, ",".join(map(str, quality)), ",".join(map(str, toxicity)), at), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.binary()), strict=True)], ["doc_id", "quality", "toxicity", "at"])

    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text")
    return keyed.mapInArrow(run, "doc_id long, quality string, toxicity string, at binary")


def with_annotations(cast: DataFrame, labels: DataFrame) -> DataFrame:
    """cast, each pattern led by the annotators' vote."""
    said = labels.groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    own = lambda c: F.coalesce(2 * F.col(c) - 1, F.lit(0)).cast("string")
    met = cast.join(said, "doc_id", "left")
    return met.select(F.concat_ws(",", own("q"), "quality").alias("quality"), F.concat_ws(",", own("t"), "toxicity").alias("toxicity"), "at")


def fit_models(met: DataFrame) -> dict[str, LabelModel]:
    """A model of each kind, from how often its patterns occur among all documents."""
    out = {}
    for name in ("quality", "toxicity"):
        rows = met.groupBy(name).count().collect()  # patterns: 3 ^ 6 and 3 * 2 ^ 4 * 4 ^ 3 at most
        out[name] = LabelModel({tuple(map(int, r[name].split(","))): r["count"] for r in rows})
    return out


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, dict[str, LabelModel]]:
    """The scorer's weights, and the label models behind them."""
    labels = labels.select("doc_id", "quality", "toxic").where("doc_id is not null")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold")
    chosen = sampled(labels, sample // 2).groupBy("doc_id").agg(F.max("toxic").alias("t")).limit(sample).select("doc_id", "t", fold).collect()
    small = spark.createDataFrame([(r.doc_id, r.t, r.fold) for r in chosen], "doc_id long, t int, fold int")  # `sample` rows at most
    lexicons = learn_lexicons(text_or_empty(docs), F.broadcast(small)) if chosen else []
    under = (sample // 2 << 30) // max(1, docs.count())

    def fit(batches):
        rows = [(np.frombuffer(a, dtype=np.int32), q, t) for batch in batches for a, q, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
        soft = [(at, models["quality"].posterior(tuple(map(int, q.split(",")))), models["toxicity"].posterior(tuple(map(int, t.split(","))))) for at, q, t in rows]
        soft.sort(key=lambda r: (r[1], r[2], r[0].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([fit_scorer(soft).tobytes()], pa.binary())], ["weights"])

    scratch = Scratch(spark, "quality")
    cast = scratch.write(cast_votes(text_or_empty(docs), lexicons, {r.doc_id: r.fold for r in chosen}, under, sample), "votes")
    met = with_annotations(cast, labels)
    models = fit_models(met)
    picked = met.where("at is not null").select("at", "quality", "toxicity").orderBy(F.xxhash64("at"), "at", "quality", "toxicity").limit(2 * sample)
    raw = picked.mapInArrow(fit, "weights binary").collect()
    scratch.drop("votes")
    weights = np.frombuffer(raw[0].weights, dtype=np.float32).reshape(2, -1) if raw else np.zeros((2, DIMS + 1), dtype=np.float32)
    return weights, models


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, quality and toxicity (probabilities), kept (good and not toxic)."""
    shared = spark.sparkContext.broadcast(train(spark, docs, labels, sample)[0])  # two heads of DIMS numbers

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer(Page(t), words_of(t)) for t in batch.column(1).to_pylist()]
            quality, toxicity = (pa.array([x[k] for x in found], pa.float64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), quality, toxicity], ["doc_id", "quality", "toxicity"])

    scored = text_or_empty(docs).mapInArrow(run, "doc_id long, quality double, toxicity double")
    return scored.withColumn("kept", (F.col("quality") >= 0.5) & (F.col("toxicity") < 0.5))
