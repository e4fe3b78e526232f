"""Quality rules as a short-circuit cascade.

Every rule is a predicate that rejects a page. On a sample each rule is timed and counted alone; the rules
are then tried in order of rejections per second, so that most bad pages leave after the cheapest rule that
can see them. The verdict is the OR of the rules, so neither the sample nor the clock changes it: they change
only how much work a page costs and which rule is named first.

One pass, no shuffle: a page is judged where it is read.

Defined results: null text counts as empty (no words, fails the length rule); each row is judged alone, so
ties, repeated and null doc_ids give one row each; an empty table gives no rows; other columns are kept by
filter_documents() and ignored by judge().
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_or_empty

#: The symbols that count, and the thresholds of the rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOL_PERCENT = 10
CAPITAL_PERCENT = 50
DUP_LINE_PERCENT = 50
WORD_CHARS = (2, 15)
#: Pages that the estimate of costs reads, about; a parameter of judge().
SAMPLE = 1000


class Page:
    """What rules ask of a text, each computed when first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[str]:
        return WORD.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len("".join(self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_capitals(self) -> int:
        return sum(map(str.isupper, self.words))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if WORD.search(x)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside any three-word window that the text holds more than once."""
        n = len(self.words)
        if n < 4:
            return 0
        known: dict[str, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in self.words), dtype=np.int64, count=n)
        pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
        triples, where, counts = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
        if len(triples) == n - 2:
            return 0
        again = counts[where] > 1
        covered = np.zeros(n, dtype=bool)
        for shift in range(3):
            covered[shift : shift + n - 2] |= again
        return int(covered.sum())


Rule = Callable[[Page], bool]
RULES: dict[str, Rule] = {
    "length": lambda p: p.n_words < MIN_WORDS,
    "repeats": lambda p: 100 * p.n_repeat_words > REPEAT_PERCENT * p.n_words,
    "symbols": lambda p: 100 * p.n_symbols > SYMBOL_PERCENT * p.n_words,
    "capitals": lambda p: 100 * p.n_capitals > CAPITAL_PERCENT * p.n_words,
    "dup_lines": lambda p: 100 * p.n_dup_lines > DUP_LINE_PERCENT * len(p.lines),
    "word_length": lambda p: not WORD_CHARS[0] * p.n_words <= p.word_chars <= WORD_CHARS[1] * p.n_words,
}


def sampled(docs: DataFrame, size: int) -> DataFrame:
    """About `size` rows, the same in every run: those whose hash (of all their columns, so that rows of one or no
    doc_id are told apart) falls under a threshold, and of these 2 * size at most, should many rows be equal."""
    n = docs.count()
    return docs if n <= size else docs.where(F.pmod(F.xxhash64(*docs.columns), F.lit(1 << 30)) < (size << 30) // n).limit(2 * size)


def estimates(docs: DataFrame, rules: dict[str, Rule] | None = None, size: int = SAMPLE) -> DataFrame:
    """A row per rule: seconds and rejections over the sample, each rule alone on fresh pages."""
    rules = rules or RULES

    def run(batches):
        sums = {name: [0, 0, 0] for name in rules}
        for batch in batches:
            for text in batch.column(1).to_pylist():
                for name, rule in rules.items():
                    began = time.perf_counter_ns()
                    hit = rule(Page(text))
                    own = sums[name]
                    own[0] += 1
                    own[1] += hit
                    own[2] += time.perf_counter_ns() - began
        columns = zip(*[(k, *v) for k, v in sums.items()], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rule", "n", "rejected", "cost_ns"])

    found = sampled(text_or_empty(docs), size).mapInArrow(run, "rule string, n long, rejected long, cost_ns long")
    return found.groupBy("rule").agg(F.sum("n").alias("n"), F.sum("rejected").alias("rejected"), F.sum("cost_ns").alias("cost_ns"))


def cascade_order(docs: DataFrame, rules: dict[str, Rule] | None = None, size: int = SAMPLE) -> list[str]:
    """Rule names by rejections per cost, best first; ties and unseen rules by name."""
    rules = rules or RULES
    seen = {r.rule: r.rejected / max(r.cost_ns, 1) for r in estimates(docs, rules, size).collect()}
    return sorted(rules, key=lambda name: (-seen.get(name, 0.0), name))


def judge(docs: DataFrame, rules: dict[str, Rule] | None = None, size: int = SAMPLE, counts: bool = True) -> DataFrame:
    """doc_id, the counts (null unless asked for), kept, and the first rule of the cascade that rejects."""
    rules = rules or RULES
    order = [(name, rules[name]) for name in cascade_order(docs, rules, size)]
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for text in batch.column(1).to_pylist():
                page = Page(text)
                by = next((name for name, rule in order if rule(page)), None)
                values = [getattr(page, f) for f in fields] if counts else [None] * 5
                for column, value in zip(out, [*values, by is None, by], strict=True):
                    column.append(value)
            types = [*[pa.int64()] * 5, pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], ["doc_id", *fields, "kept", "rejected_by"])

    return text_or_empty(docs).mapInArrow(run, f"doc_id long, {', '.join(f'{f} long' for f in fields)}, kept boolean, rejected_by string")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def filter_documents(docs: DataFrame, rules: dict[str, Rule] | None = None, size: int = SAMPLE) -> DataFrame:
    """The rows whose page no rule rejects, with all their columns; judged in place, so nothing is joined."""
    rules = rules or RULES
    order = [(name, rules[name]) for name in cascade_order(docs, rules, size)]
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            pages = (Page(text or "") for text in batch.column(at).to_pylist())
            keep = [not any(rule(page) for _, rule in order) for page in pages]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
