import random
import re
from collections import Counter

import pytest

from weftline.llm.line_dedup import dedup_lines
from weftline.llm.ngram_join import choose_bands, drop_near_copies, near_groups
from weftline.llm.span_dedup import dedup_spans, runs, sentences


def similar(a, b, s=0.8):
    both = len(a & b)
    return both > 0 and both >= s * (len(a) + len(b) - both) - 1e-9


def brute_lines(texts):
    order = sorted({(d, t) for d, t in texts if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen, out = [], {}
    ids = Counter(d for d, _ in order)
    for d, t in order:
        kept = []
        for line in t.split("\n"):
            w = frozenset(line.split())
            if not (w and any(similar(w, v) for v in seen)):
                kept.append(line)
            if w:
                seen.append(w)
        out[(d, t)] = "\n".join(kept)
    return out, ids


def test_line_dedup(spark, docs, empty, texts):
    plain = [(d, None if t is None else t.replace("　", " ").replace("\x1c", " ").replace("﻿", "")) for d, t in texts if d != 5 or t.startswith("another")]
    frame = spark.createDataFrame(plain, "doc_id long, text string").repartition(3)
    want, _ = brute_lines(plain)
    got = [(r.doc_id, r.text) for r in dedup_lines(spark, frame).collect()]
    assert sorted(map(str, got)) == sorted(str((d, None if t is None else want[(d, t)])) for d, t in plain)
    cleaned = dedup_lines(spark, docs)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    assert dedup_lines(spark, empty).count() == 0


def test_line_dedup_near_and_position(spark):
    base = "a b c d e f g h i j"
    rows = [(1, base), (2, "a b c d e f g h i x"), (3, "z y x w v u t s r q"), (4, "a b c d e f g h x y"), (5, "j i h g f e d c b a"), (6, "one two"), (7, "two one"), (8, "one two three")]
    got = {r.doc_id: r.text for r in dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == base and got[2] == "" and got[3] and got[4] == "" and got[5] == "" and got[6] == "one two" and got[7] == "" and got[8]


def test_line_dedup_four_words_within_five(spark):
    five = "a b c d e".split()
    rows = []
    for k in range(5):
        own = [f"{w}{k}" for w in five]
        four = own[:k] + own[k + 1 :]
        rows += [(10 * k, " ".join(own)), (10 * k + 1, " ".join(four)), (10 * k + 5, " ".join(f"{w}x" for w in four)), (10 * k + 6, " ".join(f"{w}x" for w in own))]
    rows += [(100, "p q r s"), (101, "p q r"), (102, "p q r t")]
    got = {r.doc_id: r.text for r in dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: "" if d < 100 and d % 10 in (1, 6) else t for d, t in rows}


def test_line_dedup_of_all_sizes(spark):
    """Sets of one word to thirty, many near each other, against a comparison of all lines with all earlier ones."""
    rnd = random.Random(12)
    rows, lines = [], []
    for d in range(60):
        own = []
        for _ in range(8):
            if lines and rnd.random() < 0.6:
                w = rnd.choice(lines).split()
                for _ in range(rnd.randrange(0, 4)):
                    at = rnd.randrange(len(w))
                    w = rnd.choice([w[:at] + w[at + 1 :] or w, w[:at] + [f"n{rnd.randrange(900)}"] + w[at:], w[:at] + [rnd.choice("abcdef")] + w[at + 1 :]])
            else:
                w = [rnd.choice([rnd.choice("abcdefghij"), f"n{rnd.randrange(900)}"]) for _ in range(rnd.randrange(1, rnd.choice([3, 6, 13, 31])))]
            own.append(rnd.choice([" ", "  ", "\t"]).join(w))
            lines.append(" ".join(w))
        rows.append((d, "\n".join(own)))
    want, _ = brute_lines(rows)
    got = {r.doc_id: r.text for r in dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {d: want[(d, t)] for d, t in rows} and sum(got[d] != t for d, t in rows) > 30


def test_line_dedup_reads_long_lists_in_shares(spark, monkeypatch):
    from weftline.llm import line_dedup

    monkeypatch.setattr(line_dedup, "SHARE", 3)
    base = [f"w{k}" for k in range(12)]
    rows = [(d, " ".join(base[: d % 12] + [f"x{d}", f"y{d}"][: 1 + d % 2] + base[d % 12 + 1 :])) for d in range(60)]
    want, _ = brute_lines(rows)
    got = {r.doc_id: r.text for r in dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: want[(d, t)] for d, t in rows}


def test_line_dedup_compares_no_lines_that_lists_tell_apart(spark, monkeypatch):
    """Lines of few words share pairs by chance: postings tell such pairs apart, they are neither written nor joined with lines."""
    from weftline.llm import line_dedup

    rnd, pairs, write = random.Random(3), [], line_dedup.Scratch.write

    def counted(self, df, name):
        found = write(self, df, name)
        pairs.extend([found.count()] if "doc_id2" in df.columns else [])
        return found

    monkeypatch.setattr(line_dedup.Scratch, "write", counted)
    rows = [(d, " ".join(rnd.sample([f"w{k}" for k in range(30)], 12))) for d in range(600)] + [(600, "a b c d e f"), (601, "f e d c b")]
    want, _ = brute_lines(rows)
    got = {r.doc_id: r.text for r in dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: want[(d, t)] for d, t in rows} and got[601] == ""
    assert 0 < sum(pairs) < len(rows)


def test_bands_reach_recall():
    bands, rows = choose_bands(0.8, 0.998)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.998


def brute_near(texts):
    sets = []
    for _, t in texts:
        w = (t or "").encode().split()
        k = min(5, len(w))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(find(i), []).append(texts[i][0])
    top = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return sorted(str((texts[i][0], top[find(i)], links[i])) for i in range(len(texts)))


def test_near_groups(spark, docs, empty, texts):
    found, _ = near_groups(spark, docs)
    assert sorted(str((r.doc_id, r.class_id, r.n_links)) for r in found.collect()) == brute_near(texts)
    kept = drop_near_copies(spark, docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and 7 in ids and not {100, 101, 102, 103, 104} & set(ids) and ids.count(3) == 1 and 205 not in ids
    assert near_groups(spark, empty)[0].count() == 0 and drop_near_copies(spark, empty).count() == 0


def test_near_groups_over_blocks(spark, monkeypatch):
    from weftline.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    base = [f"w{k}" for k in range(200)]
    rows = [(d, " ".join(base[:d] + [f"x{d}"] + base[d + 1 :])) for d in range(20)] + [(50 + d, " ".join(base)) for d in range(3)]
    found, _ = near_groups(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(str((r.doc_id, r.class_id, r.n_links)) for r in found.collect()) == brute_near(rows)


def brute_spans(texts):
    order = sorted({(d, t) for d, t in texts if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen, out = set(), {}
    for d, t in order:
        gone = set()
        for a, b, at, n in runs(t):
            if (a, b) in seen:
                gone.update(range(at, at + n))
            seen.add((a, b))
        out[(d, t)] = "".join(s for k, s in enumerate(sentences(t)) if k not in gone)
    return out


def test_span_dedup(spark, docs, empty, texts):
    own = [(d, t) for d, t in texts if d != 5]
    want = brute_spans(own)
    got = dedup_spans(spark, docs.where("doc_id is null or doc_id <> 5"))
    assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == sorted(str((d, None if t is None else want[(d, t)])) for d, t in own)
    assert set(docs.columns) <= set(got.columns) and dedup_spans(spark, empty).count() == 0


def all_spans(text):
    """Every span of several consecutive sentences that is long enough; sentences by a plain split, each of 40 words at most."""
    parts = []
    for s in re.findall(r"[^.]*\.\s*", text):
        w = s.split(" ")
        w = [x + " " for x in w[:-1]] + [w[-1]] if w[-1] else [x + " " for x in w[:-1]]
        parts += ["".join(w[k : k + 40]) for k in range(0, len(w), 40)]
    assert "".join(parts) == text and parts == sentences(text)
    n = [len(s.split()) for s in parts]
    for a in range(len(parts)):
        for b in range(a + 1, len(parts) + 1):
            if b - a >= 2 and sum(n[a:b]) >= 15:
                yield a, b, " ".join(" ".join(parts[a:b]).split())


@pytest.mark.parametrize("hot", [1, 50, 1000])  # no hash is hot, some are, all that repeat are
def test_span_dedup_against_all_spans(spark, monkeypatch, hot):
    from weftline.llm import span_dedup

    monkeypatch.setattr(span_dedup, "HOT", hot)
    rnd = random.Random(9)
    make = lambda n: " ".join(f"w{rnd.randrange(100000)}" for _ in range(n - 1)) + f" e{rnd.randrange(100000)}."
    passages = [[40, 27], [32, 21], [31, 20], [20, 40, 3], [3, 40], [5, 5, 5], [35, 2, 35, 2], [8, 8, 8, 8], [60], [14, 1], [41], [95, 3]]
    passages = [[make(n) for n in p] for p in passages]
    rows = [(d, " ".join(make(rnd.randrange(1, 45)) if rnd.random() < 0.3 else " ".join(rnd.choice(passages)) for _ in range(8))) for d in range(12)]
    rows += [(50 + k, " ".join([make(9), *p, make(9)])) for k, p in enumerate(passages)]
    seen, want = set(), {}
    for d, t in rows:
        gone = set()
        for a, b, s in all_spans(t):
            if s in seen:
                gone.update(range(a, b))
            seen.add(s)
        want[d] = "".join(s for k, s in enumerate(sentences(t)) if k not in gone)
    got = dedup_spans(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id: r.text for r in got.collect()} == want


@pytest.mark.parametrize("text", ["", "a. b! c?", "no end", "3.14 is pi. Yes", "...", "\n\nx.\n"])
def test_sentences_make_up_the_text(text):
    assert "".join(sentences(text)) == text


def test_prefixes_of_pairs_lose_no_similar_sets():
    """The prefix lemma of line_dedup, on random sets."""
    import math
    import random

    def prefix(s):
        s, n = sorted(s), len(s)
        lost = math.floor(0.75 * math.floor(0.2 * n + 1e-9) + 0.25 * n + 1e-9)
        return set(zip(s[: lost + 1], s[1 : lost + 2], strict=False))

    rnd, met = random.Random(1), 0
    for _ in range(20000):
        x = set(rnd.sample(range(500), rnd.randrange(4, 60)))
        y = x - set(rnd.sample(sorted(x), rnd.randrange(0, len(x) // 5 + 1)))
        while rnd.random() < 0.8:
            y.add(rnd.randrange(500))
        if len(y) >= 4 and similar(x, y):
            met += 1
            assert prefix(x) & prefix(y)
    assert met > 5000


def test_one_id_with_different_texts(spark):
    """Each text is a document; what they share stays in one of them, the same in every run."""
    passage = "Some words of a long passage that both of the texts hold and that is longer than one run needs to be. It goes on for a second sentence of some length here."
    frame = spark.createDataFrame([(5, f"{passage}\nonly the first one has this"), (5, f"{passage}\nanother line stands in the second"), (5, None)], "doc_id long, text string")
    for clean in (dedup_lines, dedup_spans):
        got = sorted(r.text or "" for r in clean(spark, frame).collect())
        assert len(got) == 3 and got[0] == "" and sum("long passage" in t for t in got) == 1
        assert sum("only the first" in t for t in got) == 1 == sum("stands in the second" in t for t in got)
        assert got == sorted(r.text or "" for r in clean(spark, frame.repartition(3)).collect())
