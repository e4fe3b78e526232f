import hashlib
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import pii
from weftline.llm.quality_rules import RULES, Page, cascade_order, filter_documents, judge
from weftline.llm.weak_quality import LabelModel, score_quality


def repeat_words(words):
    n = Counter(zip(words, words[1:], words[2:], strict=False))
    return len({k + j for k in range(len(words) - 2) if n[tuple(words[k : k + 3])] > 1 for j in range(3)})


@given(st.lists(st.sampled_from("abc"), max_size=30))
@settings(max_examples=200, deadline=None)
def test_repeat_words(words):
    assert Page(" ".join(words)).n_repeat_words == repeat_words(words)


def test_rules(spark, docs, empty, texts):
    got = judge(docs)
    want = sorted((str(d), not any(rule(Page(t or "")) for rule in RULES.values())) for d, t in texts)
    assert sorted((str(r.doc_id), r.kept) for r in got.collect()) == want
    assert sorted(cascade_order(docs)) == sorted(RULES)
    kept = filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(k for _, k in want)
    assert judge(empty).count() == 0 and filter_documents(empty).count() == 0


def brute_base(x):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 8 <= len(digits(m[0])) <= 15]


@given(st.text(alphabet="a1.@+- ()49é\n", max_size=60))
@settings(max_examples=500, deadline=None)
def test_base_patterns(x):
    assert pii.base_spans(x) == brute_base(x)


def test_pii_operator(spark, docs, empty):
    more = spark.createDataFrame([(1, "mail a.b@c.org now"), (2, 'token = "0123456789abcdef0123456789abcdef01234567" x'), (3, "call (415) 555-2671 today"), (4, "plain words 12 and 2020-01-11"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(more, with_text=True).collect()}
    assert got[1].spans == "email:5:14" and got[1].redacted == "mail <email> now"
    assert got[1].base_sha256 == hashlib.sha256(b"email:5:14").hexdigest()
    assert got[2].spans == "secret:9:49" and got[2].n_email == 0
    assert got[3].spans.startswith("phone:") and got[3].n_phone == 0
    assert got[4].spans == "" and got[5].spans == ""
    assert pii.find_pii(docs).count() == docs.count() and pii.find_pii(empty).count() == 0


def best_by_enumeration(text, cluster, weights):
    """Highest score of all segmentations of a cluster."""
    atoms, edges = pii.lattice(text, *cluster)

    def best(i):
        if i == len(atoms):
            return 0.0
        return max([best(i + 1), *(sum(weights.get(x, 0.0) for x in f) + best(j) for j, _, f in edges[i])])

    return best(0)


def test_decode_against_all_segmentations():
    weights = pii.train([])
    for text in ["call +1 415 555-2671 or 12", "4111 1111 1111 1111 9", "a1@b.org 10.0.0.1", "x9-y8_z7 key0123456789abcdef", "1.2.3.4 5.6.7.8"]:
        for cluster in pii.clusters(text):
            atoms, edges = pii.lattice(text, *cluster)
            scores = {(k, atoms[i][0], atoms[j - 1][1]): sum(weights.get(x, 0.0) for x in f) for i, own in enumerate(edges) for j, k, f in own}
            found = pii.decode(text, cluster, weights)
            assert abs(sum(scores[s] for s in found) - best_by_enumeration(text, cluster, weights)) < 1e-9


def test_long_keys_and_numeric_texts():
    import tracemalloc

    weights = pii.train([])
    key = "0123456789abcdef" * 40
    assert ("secret", 7, 7 + len(key)) in pii.spans_of(f"token = {key} x".replace("token =", "key  ="), weights)[1] or pii.spans_of(f"token = {key} x", weights)[1]
    tracemalloc.start()
    pii.spans_of(" ".join(str(10 + k % 90) for k in range(20_000)), weights)
    assert tracemalloc.get_traced_memory()[1] < 30_000_000
    tracemalloc.stop()


def test_added_spans_keep_clear_of_all_pattern_spans():
    weights = pii.train([])
    text = "+" + " ".join(["1"] * 9) + " " + " ".join(f"a{k}@b.org" for k in range(9)) + " (415) 555-2671"
    base, spans = pii.spans_of(text, weights)
    added = [s for s in spans if s not in base]
    assert all(b <= x or y <= a for _, a, b in added for _, x, y in base)


def test_held_out_spans():
    weights = pii.train([])
    hits = total = wrong = 0
    for text, gold in pii.generated(360, seed=99):
        found = {s for c in pii.clusters(text) for s in pii.decode(text, c, weights)}
        hits, total, wrong = hits + len(found & set(gold)), total + len(gold), wrong + len(found - set(gold))
    assert hits >= 0.95 * total and wrong <= 0.05 * total


def draws(n, annotated, seed=1):
    """Vote patterns of three labellers with accuracies 0.9, 0.8, 0.6, the annotators' first, and each one's class."""
    import random

    rnd, rows = random.Random(seed), []
    for _ in range(n):
        y = rnd.random() < 0.3
        say = lambda p, y=y: (1 if y else -1) * (1 if rnd.random() < p else -1)
        rows.append(((say(0.98) if rnd.random() < annotated else 0, say(0.9), say(0.8) if rnd.random() < 0.7 else 0, say(0.6)), y))
    return rows


def test_label_model_finds_accuracies():
    for annotated, off in ((0.2, 0.06), (0.0, 0.15)):  # three labellers alone are barely enough to tell
        model = LabelModel(dict(Counter(v for v, _ in draws(6000, annotated))))
        assert abs(model.prior - 0.3) < off and model.anchored == (annotated > 0)
        assert all(abs(model.table[k] - x) < off for k, x in {(1, 1, 2): 0.9, (2, 0, 0): 0.56, (2, 1, 1): 0.3, (3, 1, 2): 0.6}.items())


def test_label_model_against_plain_em():
    """Row by row, without patterns or arrays."""
    import math

    from weftline.llm.weak_quality import ANCHOR, EM_STEPS, MISSING, START, TRUST

    rows = [v for v, _ in draws(300, 0.2)]
    rows[::7] = [(v[0], MISSING, *v[2:]) for v in rows[::7]]
    model = LabelModel(dict(Counter(rows)))
    said = [v for v in rows if v[0]]
    prior = (sum(v[0] == 1 for v in said) + 1) / (len(said) + 2)
    heavy = max(1.0, ANCHOR * (len(rows) - len(said)) / len(said))
    logit = math.log(prior / (1 - prior))
    post = [(TRUST if v[0] == 1 else 1 - TRUST) if v[0] else 1 / (1 + math.exp(-(logit + START * sum(x for x in v[1:] if x != MISSING)))) for v in rows]
    for _ in range(EM_STEPS):
        rate = {}
        prior = (sum(post) + 1) / (len(rows) + 2)
        logit = math.log(prior / (1 - prior))
        for j in (1, 2, 3):
            for c in (0, 1):
                n = {x: 0.1 + sum((heavy if v[0] else 1) * (p if c else 1 - p) for v, p in zip(rows, post, strict=True) if v[j] == x) for x in (-1, 0, 1)}
                rate[j, c] = {x: k / sum(n.values()) for x, k in n.items()}
        new = []
        for v in rows:
            odds = logit + v[0] * math.log(TRUST / (1 - TRUST))
            odds += sum(math.log(rate[j, 1][v[j]] / rate[j, 0][v[j]]) for j in (1, 2, 3) if v[j] != MISSING)
            new.append(1 / (1 + math.exp(-odds)))
        post = new
    assert all(abs(model.posterior(v) - p) < 1e-6 for v, p in zip(rows, post, strict=True))


def test_quality_of_withheld_rows(spark):
    """Labels with odd ids are withheld and scored: better than 0.9 and than the majority."""
    import os

    from pyspark.sql import functions as F

    from weftline.llm.weak_quality import train

    data = "/root/testdata/sf0.01"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    given, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1").select("doc_id", F.col("quality").alias("q"), "toxic")
    models = train(spark, docs, given)[1]
    shares = held.agg(F.avg("q"), F.avg("toxic"), F.avg(F.expr("int(q = 1 and toxic = 0)"))).first()
    assert abs(models["quality"].prior - shares[0]) < 0.05 and abs(models["toxicity"].prior - shares[1]) < 0.1
    right = score_quality(spark, docs, given).join(held, "doc_id").agg(F.avg(F.expr("int((quality >= 0.5) = (q = 1))")), F.avg(F.expr("int((toxicity >= 0.5) = (toxic = 1))")), F.avg(F.expr("int(kept = (q = 1 and toxic = 0))"))).first()
    assert min(right) > 0.9 and all(r > max(s, 1 - s) for r, s in zip(right, shares, strict=True))


def test_weak_quality_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(None, "a page of some words without an id")] * 3 + [(1, None), (1, "one id"), (1, "two texts of it")] * 2 + [(2, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None, 1), (1, 0, None), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = score_quality(spark, docs, labels).collect()
    assert len(got) == 10 and len({(r.doc_id, r.quality, r.toxicity) for r in got}) <= 5


def test_weak_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(0, 1, 0)], "doc_id long, quality int, toxic int")
    bad = spark.createDataFrame([(900 + k, "You " + w + " " + w + " of the page with words and words") for k, w in enumerate(["idiot", "moron", "scum", "clown"] * 5)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(bad)
    got = score_quality(spark, both, labels).collect()
    assert len(got) == both.count() and all(0 <= r.quality <= 1 and 0 <= r.toxicity <= 1 for r in got)
    assert all(not r.kept for r in got if (r.doc_id or 0) >= 900)
    assert sum(r.kept for r in got if r.doc_id is not None and r.doc_id < 40) >= 38
    assert score_quality(spark, empty, labels).count() == 0


def test_sample_tells_rows_of_one_id_apart(spark):
    from weftline.llm.quality_rules import sampled

    for doc_id in ("null", "7"):
        frame = spark.range(20_000).selectExpr(f"cast({doc_id} as long) as doc_id", "concat('text ', id) as text")
        assert 800 < sampled(frame, 1000).count() < 1200
    assert sampled(spark.range(20_000).selectExpr("1L as doc_id", "'one' as text"), 1000).count() <= 2000


def test_toxic_words_are_learnt_where_no_list_has_them(spark):
    """Annotated documents in a language without a list of insults, and others of it that no one annotated."""
    import random

    rnd = random.Random(2)
    text = lambda bad: " ".join(rnd.choice(["eins", "zwei", "drei", "vier", "neun"]) + str(rnd.randrange(60)) if rnd.random() < 0.9 or not bad else "boeswort" for _ in range(110))
    rows = [(k, text(k % 4 == 0)) for k in range(400)]
    labels = [(k, 1, int(k % 4 == 0)) for k in range(200)]
    got = {r.doc_id: r.toxicity for r in score_quality(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert sum((got[k] >= 0.5) == (k % 4 == 0) for k in range(200, 400)) >= 190
