import math
import random
import zlib
from collections import Counter

import numpy as np

from weftline.llm import lm_scoring
from weftline.llm.decontaminate import drop_leaks, find_leaks, lcs

from .conftest import SCHEMA, rows, words


def tokens(t):
    return (t or "").encode().lower().split() + [b"\n"]


def test_lm_scores(spark, docs, empty, texts):
    got = lm_scoring.score_documents(spark, docs, block=300, bucket_keys=500).collect()
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in texts}
    c = Counter()
    for d, t in texts:
        if not held[d]:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), held[d], len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for d, t in texts)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    again = lm_scoring.score_documents(spark, docs).collect()  # other blocks, same scores
    assert np.allclose(sorted(r.score for r in got), sorted(r.score for r in again))
    assert lm_scoring.score_documents(spark, empty).count() == 0


def test_lm_scores_against_plain_em(spark, docs, texts):
    """Token by token, with the estimates themselves instead of bins."""
    runs = [(d, zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0, ["\n", *tokens(t)[:-1], "\n"]) for d, t in texts]
    c, pairs = Counter(), Counter()
    for _, held, w in runs:
        if not held:
            c.update(w[1:])
            pairs.update(zip(w, w[1:], strict=False))
    n, v = sum(c.values()), len(c)
    level = lambda x: min(int(math.floor(math.log2(max(x, 0.5)))) + 1, 47)
    rows = []
    for _, held, w in runs:
        for a, b in () if held else zip(w, w[1:], strict=False):
            context = c[a] - 1
            rows.append((level(context), (pairs[a, b] - 1) / max(context, 1) if context > 0 else 0.0, (c[b] - 1) / (n - 1), 1 / (v + 1)))
    weights = {k: [1 / 3] * 3 for k in {level(x) for x in range(n)} | {0}} | {0: [0, 0.5, 0.5]}
    for _ in range(lm_scoring.EM_STEPS):
        new = {k: [0.01 * x for x in own] for k, own in weights.items()}
        for k, *p in rows:
            share = [w * x for w, x in zip(weights[k], p, strict=True)]
            for j in range(3):
                new[k][j] += share[j] / sum(share)
        weights = {k: [x / sum(own) for x in own] for k, own in new.items()}
    want = []
    for d, _, w in runs:
        p = [sum(x * y for x, y in zip(weights[level(c[a])], ((pairs[a, b] / max(c[a], 1)) if c[a] > 0 else 0, c[b] / n, 1 / (v + 1)), strict=True)) for a, b in zip(w, w[1:], strict=False)]
        want.append((str(d), len(p), sum(map(math.log10, p))))
    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in lm_scoring.score_documents(spark, docs).collect())
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]
    assert all(abs(x[2] - y[2]) <= 0.02 * abs(y[2]) + 0.05 for x, y in zip(got, sorted(want), strict=True))


def test_lm_is_a_distribution():
    weights = lm_scoring.em(np.array([0]), np.array([1.0]))
    assert np.allclose(weights.sum(axis=1), 1) and (weights[:, 2] > 0).all() and weights[0, 0] == 0


def test_lm_beats_unigrams_on_held_out(spark):
    rnd = random.Random(5)
    frame = spark.createDataFrame([(i, " ".join(f"{a} {a}x" for a in rnd.choices("abcdefgh", k=60))) for i in range(200)], "doc_id long, text string")
    got = [r for r in lm_scoring.score_documents(spark, frame).collect() if r.held_out]
    assert got and sum(r.score for r in got) > sum(r.base_score for r in got) + 10 * len(got)


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def test_lcs():
    rnd = random.Random(2)
    for _ in range(200):
        a, b = (rnd.choices("abcde", k=rnd.randrange(0, 14)) for _ in range(2))
        assert lcs(a, b) == brute_lcs(a, b)


def test_leaks(spark, docs, empty):
    rnd = random.Random(8)
    items = [(k, " ".join(words(rnd, 40)).capitalize() + ".") for k in range(30)] + [(30, None), (31, ""), (5, "")]
    plant = []
    for k in range(6):
        w = items[k][1].split()
        host = words(rnd, 150)
        changed = [x if j % 6 != 3 else "other" for j, x in enumerate(w)]  # a paraphrase: every sixth word
        plant.append((1000 + k, " ".join(host[:70] + (w if k % 2 else changed) + host[70:])))
    frame = spark.createDataFrame(rows(plant), SCHEMA).union(docs)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block in (1024, 10):
        got = {r.doc_id: r for r in find_leaks(spark, frame, benchmark, block=block).collect()}
        assert all(got[1000 + k].leaked and got[1000 + k].item_ids == [k] for k in range(6))
        assert sum(r.leaked for r in got.values()) == 6
    kept = drop_leaks(spark, frame, benchmark)
    assert kept.columns == frame.columns and kept.count() == docs.count()
    assert find_leaks(spark, empty, benchmark).count() == 0
    assert find_leaks(spark, docs, benchmark.limit(0)).where("leaked").count() == 0


def test_passages_without_id(spark):
    rnd = random.Random(9)
    passages = [" ".join(words(rnd, 30)) for _ in range(4)]
    benchmark = spark.createDataFrame([(None, passages[0]), (1, passages[1]), (None, passages[2]), (1, passages[3])], "item_id long, text string")
    texts = [(k, " ".join([*words(rnd, 40), p, *words(rnd, 40)])) for k, p in enumerate(passages)] + [(4, " ".join([*words(rnd, 30), passages[1], *words(rnd, 30), passages[2]]))]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    for block in (1024, 2):
        got = {r.doc_id: r.item_ids for r in find_leaks(spark, frame, benchmark, block=block).collect()}
        assert got == {0: [None], 1: [1], 2: [None], 3: [1], 4: [1, None]}
        assert drop_leaks(spark, frame, benchmark, block=block).count() == 0


def planted(rnd, passages, hosts, each):
    """Documents with `each` passages, by turns exact and with every sixth word changed, and the pairs that are leaks by brute force."""
    texts, pairs = [], set()
    for d in range(hosts):
        host = words(rnd, 60)
        for k in rnd.sample(range(len(passages)), each):
            own = passages[k].split()
            copy = own if rnd.random() < 0.5 else [x if j % 6 != 3 else "other" for j, x in enumerate(own)]
            host += copy + words(rnd, 70)
            if brute_lcs(own, copy) >= 0.75 * len(own):
                pairs.add((d, k))
        texts.append((d, " ".join(host)))
    return texts, pairs


def test_leaks_of_a_large_benchmark(spark):
    rnd = random.Random(4)
    passages = [" ".join(words(rnd, rnd.randrange(15, 60))) for _ in range(1020)]
    texts, pairs = planted(rnd, passages, 100, 3)
    benchmark = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    got = find_leaks(spark, spark.createDataFrame(texts, "doc_id long, text string"), benchmark).collect()
    assert len(pairs) > 250 and len(pairs & {(r.doc_id, k) for r in got for k in r.item_ids}) >= 0.9 * len(pairs)


def test_leaks_in_a_third_of_all_documents(spark):
    """A passage's own copies lower its weights; short and long passages alike stay found."""
    rnd = random.Random(6)
    passages = [" ".join(words(rnd, n)) for n in (15, 18, 22, 30, 40, 59, 90, 150)]
    texts, pairs = planted(rnd, passages, 150, 3)
    texts += [(200 + d, " ".join(words(rnd, 200))) for d in range(20)]
    benchmark = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    got = find_leaks(spark, spark.createDataFrame(texts, "doc_id long, text string"), benchmark).collect()
    assert len(pairs) > 400 and {(r.doc_id, k) for r in got for k in r.item_ids} == pairs


def test_pipeline_stages_compose(spark, docs, tmp_path):
    import corpus_pipeline

    good = docs.select("doc_id", "text", "lang", "source", "n_chars")
    good.repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "some passage that no document holds at all here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(str(tmp_path / f"out-{name}"))
        at = spark.read.parquet(str(tmp_path / f"out-{name}"))
        kept.append(at)
    assert all(x.columns == good.columns for x in kept[:-1])
    assert kept[0].count() >= kept[2].count() >= kept[3].count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).agg({"length": "sum"}).first()[0] == at.agg({"length": "sum"}).first()[0]


def brute_pipeline(documents, passages):
    """The stages one after the other, each by comparison of all with all."""
    from tokenizers import Tokenizer

    from weftline.llm.common import tokenizer_path
    from weftline.llm.quality_rules import RULES, Page

    from .test_dedup_joins import brute_lines, similar

    kept = [(d, t) for d, t in documents if not any(rule(Page(t or "")) for rule in RULES.values())]
    lines, _ = brute_lines(kept)
    kept = [(d, lines[(d, t)]) for d, t in kept]
    sets = [frozenset(tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))) if t.split() else frozenset() for _, t in kept]
    label = list(range(len(kept)))
    for _ in kept:  # until labels stand still, at most as often as there are documents
        was = list(label)
        for i in range(len(kept)):
            for j in range(len(kept)):
                if similar(sets[i], sets[j]):
                    label[i] = min(label[i], label[j])
        if was == label:
            break
    order = lambda k: (kept[k][0] is None, kept[k][0] or 0)
    first = {g: min((k for k in range(len(kept)) if label[k] == g), key=order) for g in set(label)}
    kept = [x for k, x in enumerate(kept) if not sets[k] or first[label[k]] == k]
    clean = lambda t: "".join(c if c.isalnum() or c == "_" else " " for c in t.lower()).split()
    kept = [(d, t) for d, t in kept if not any(p and " ".join(clean(p)) in " ".join(clean(t)) for p in passages)]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return {(d, zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4").tobytes())) for d, t in kept}


def test_pipeline_against_brute_force(spark, tmp_path):
    """Nulls, empty texts, near copies, repeated lines, leaks, extra columns with the operators' own names; and an empty table."""
    import corpus_pipeline
    from weftline.llm.packing import pack

    rnd = random.Random(21)
    passages = [" ".join(words(rnd, 30)).capitalize() for _ in range(3)]
    documents = [(d, "\n".join(" ".join(words(rnd, rnd.randrange(15, 40))) for _ in range(6))) for d in range(30)]
    documents += [(100 + d, documents[d][1].replace(documents[d][1].split()[9], "other", 1)) for d in range(5)]
    documents += [(200 + d, documents[10 + d][1] + "\n" + documents[4][1].split("\n")[0]) for d in range(3)]
    documents += [(300 + k, " ".join(words(rnd, 60)) + "\n" + p + "\n" + " ".join(words(rnd, 60))) for k, p in enumerate(passages)]
    documents += [(400, None), (401, ""), (402, "short text"), (None, "\n".join(" ".join(words(rnd, 30)) for _ in range(4)))]
    spark.createDataFrame(list(enumerate(passages)) + [(9, None), (10, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.createDataFrame(rows(documents), SCHEMA).repartition(3)
    at.write.parquet(str(tmp_path / "documents.parquet"))
    want = brute_pipeline(documents, [p for p in passages])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {d for d, _ in want} and len(want) > 30
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == SCHEMA.replace(",", "").split()[::2]
        at.write.parquet(str(tmp_path / f"out-{name}"))
        at = spark.read.parquet(str(tmp_path / f"out-{name}"))
    pieces = {}
    for r in pack(spark, at, with_ids=True).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert {(d, zlib.crc32(b"".join(r.ids for r in sorted(p, key=lambda r: r.start)))) for d, p in pieces.items()} == want
    assert sum(r.length for r in out) == sum(r.length for p in pieces.values() for r in p)
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none/benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_leaks_by_length_and_frequency(spark):
    """Recall of verbatim passages in long hosts: short and long ones, of rare words and of words that most documents hold."""
    rnd = random.Random(17)
    common = [f"c{k}" for k in range(60)]
    host = lambda n: [rnd.choice(common) if rnd.random() < 0.5 else f"h{rnd.randrange(10**6)}" for _ in range(n)]
    passages = [" ".join(rnd.choice(common) if kind == "common" else f"r{rnd.randrange(10**6)}" for _ in range(n)) for kind in ("rare", "common") for n in (5, 6, 8, 12, 20, 40, 64, 100) for _ in range(4)]
    texts = [(d, " ".join(host(150) + passages[d].split() + host(150))) for d in range(len(passages))] + [(1000 + d, " ".join(host(300))) for d in range(60)]
    benchmark = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    got = {(r.doc_id, k) for r in find_leaks(spark, spark.createDataFrame(texts, "doc_id long, text string"), benchmark).collect() for k in r.item_ids}
    missed = [(d, len(passages[d].split())) for d in range(len(passages)) if (d, d) not in got]
    assert len(missed) <= 0.1 * len(passages), missed


def test_latent_space_of_all_documents(spark):
    """The fit reads every document, however many there are: its products and its space are those of the dense rows of all."""
    from weftline.llm import decontaminate as d

    rnd = random.Random(12)
    texts = [(k, " ".join(words(rnd, rnd.randrange(0, 30)))) for k in range(3000)]
    terms = sorted({w for _, t in texts for w in d.words_of(t)})[::3]
    idf = np.linspace(1, 2, 1 << 17)
    dense = np.zeros((len(texts), len(terms)))
    for k, t in texts:
        names, weights = d.weigh(d.words_of(t), idf)
        own = {w: x for w, x in zip(names, weights, strict=True)}
        dense[k] = [own.get(w, 0.0) for w in terms]
    held = d.sparse_rows(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), {w: k for k, w in enumerate(terms)}, idf).cache()
    assert held.count() == (dense.any(axis=1)).sum() > 2000
    z = np.random.default_rng(1).standard_normal((len(terms), 20))
    assert np.allclose(d.gram_times(held, z), dense.T @ (dense @ z), rtol=1e-3, atol=1e-3)
    space = d.latent_space(held, 0.5, [([0, 2], np.array([30.0, 40.0]))], len(terms), 8)
    assert np.allclose(space.T @ space, np.eye(8), atol=1e-6)
    assert abs(np.abs(space[:, 0] @ np.eye(len(terms))[[0, 2]].T @ [0.6, 0.8]) - 1) < 0.01


def test_leaks_recall_against_brute_force(spark):
    """Every stretch of every document, of REACH times a passage's length at each word, by found_in() alone."""
    from weftline.llm import decontaminate as d

    rnd = random.Random(14)
    passages = [" ".join(words(rnd, n)) for n in (12, 20, 35, 60) for _ in range(5)]
    texts, _ = planted(rnd, passages, 60, 2)
    for k in range(40):  # half of a passage, or two thirds with gaps
        own = rnd.choice(passages).split()
        part = own[: len(own) // 2] if k % 2 else [w for j, w in enumerate(own) if j % 3]
        texts.append((100 + k, " ".join(words(rnd, 50) + part + words(rnd, 50))))
    buckets = [{d.bucket(w) for w in d.words_of(t)} for _, t in texts]
    idf = np.log((1 + len(texts)) / (1 + np.bincount([b for own in buckets for b in own], minlength=1 << 17))) + 1e-3
    want = set()
    for k, p in enumerate(passages):
        item = d.Item(k, d.words_of(p), idf)
        reach = int(d.REACH * len(item.words))
        for i, t in texts:
            w = d.words_of(t)
            if any(item.found_in(w[at : at + reach]) for at in range(max(1, len(w) - reach + 1))):
                want.add((i, k))
    found = find_leaks(spark, spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(list(enumerate(passages)), "item_id long, text string"))
    got = {(r.doc_id, k) for r in found.collect() for k in r.item_ids}
    assert len(want) > 100 and len(want & got) >= 0.9 * len(want)
