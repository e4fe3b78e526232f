"""Operators that gather nothing without bound, against plain versions of themselves."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import evidence, files
from weftline.sources import events as sources


def test_numbers_of_lines_over_many_splits(spark, tmp_path):
    rnd = random.Random(1)
    want = {}
    (tmp_path / "log").mkdir()
    for name in ("a", "b", "c"):
        lines = [json.dumps({"event_id": f"{name}{k}", "run_id": name, "ts": "t", "type": "x" * rnd.randrange(200)}) for k in range(400)]
        want |= {json.loads(x)["event_id"]: k + 1 for k, x in enumerate(lines)}
        (tmp_path / "log" / f"{name}.ndjson").write_text("\n".join(x + "\n" * (rnd.random() < 0.2) for x in lines))  # blank lines among them
    saved = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        found = sources.read_events(spark, str(tmp_path / "log"))
        assert spark.read.text(str(tmp_path / "log")).rdd.getNumPartitions() > 12
        assert {r.event_id: r.ord for r in found.select("event_id", "ord").collect()} == want
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


def plain_tree(leaves, wide=16):
    depth = 0
    while len(leaves) > wide * 16**depth:
        depth += 1
    level = dict(leaves)
    for digits in range(depth, -1, -1):
        up = {}
        for key in sorted(level):
            up.setdefault(key[:digits], []).append(level[key])
        level = {k: hashlib.sha256("".join(v).encode()).hexdigest() for k, v in up.items()}
    return level.get("", "0" * 64)


@pytest.mark.parametrize("n", [0, 1, 16, 17, 300, 700])
def test_hash_tree(spark, n):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    leaves = [(sha(f"k{k}"), sha(f"h{k}"), k) for k in range(n)]
    for rows in (leaves, leaves[::-1]):
        got = sources.hash_tree(spark.createDataFrame(rows, "key string, hash string, n long").repartition(3)).first()
        assert (got.hash, got.n, got.n_leaves) == (plain_tree([x[:2] for x in leaves]), sum(x[2] for x in leaves), n)


def test_artifact_hash_depends_on_rows_alone(spark, tmp_path):
    rows = [(k % 40, f"text {k % 40}\nline") for k in range(100)]  # some rows more than once
    frame = lambda r: spark.createDataFrame(r, "k long, text string")
    one = sources.write_artifact(frame(rows), "x/one", root=str(tmp_path)).first()
    two = sources.write_artifact(frame(rows[::-1]).repartition(5), str(tmp_path / "two")).first()
    other = sources.write_artifact(frame(rows[1:]), "three", root=str(tmp_path)).first()
    assert one == two != other and one.size == sum(p.stat().st_size for p in (tmp_path / "x/one").glob("part-*"))
    for path in ("../x", "/etc/x", "a/../../b", "a\\..\\..\\b", "file:/x", ""):
        with pytest.raises(ValueError):
            sources.write_artifact(frame(rows), path, root=str(tmp_path))


def plain_topk(claims, docs, k, least=0.05):
    import re

    from weftline.functions.text import STOPWORDS

    cut = lambda t: re.findall(r"\w+", t.lower())
    telling = lambda w: [x for x in w if len(x) > 2 and x not in STOPWORDS]
    out = set()
    for c, text, kind in claims:
        w, found = cut(text), []
        keys, mine = [*telling(w), kind], set(telling(w))
        asked = {x for x in w if len(x) >= 2} | {kind}
        for d, body, priority in docs:
            if body is None or priority is None or asked.isdisjoint(own := set(cut(body))):
                continue
            theirs = set(telling(own))
            both = len(mine & theirs)
            score = min(1, 0.3 * (8 - priority) / 7 + 0.4 * (both / (len(mine) + len(theirs) - both) if both else 0) + 0.3 * sum(x in own for x in keys) / len(keys))
            if round(score, 9) > least:
                found.append((-round(score, 9), d))
        out |= {(c, n + 1, d) for n, (_, d) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("block", [1, 4000])
def test_evidence_topk_with_copies_and_blocks(spark, block):
    """A third of the documents are copies of one text, so that ties are decided by doc_id alone."""
    rnd = random.Random(2)
    text = lambda n: " ".join(rnd.choice(["the", "of", "alpha", "beta", "gamma", "delta", "feature", "io", "x", "mesh", "file"]) for _ in range(n))
    hot = text(12)
    docs = [(k, hot if k % 3 == 0 else text(rnd.randrange(1, 30)), 3 if k % 3 == 0 else rnd.randrange(1, 8)) for k in range(300)] + [(900, None, 1), (901, "alpha", None)]
    claims = [(k, text(rnd.randrange(1, 9)), rnd.choice(["feature", "format"])) for k in range(6)] + [(7, "", "feature")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, priority int").repartition(5)
    asked = spark.createDataFrame(claims, "claim_id long, claim_text string, claim_kind string")
    for k in (1, 7):
        got = evidence.evidence_topk(asked, frame, k=k, block=block)
        assert {(r.claim_id, r["rank"], r.doc_id) for r in got.collect()} == plain_topk(claims, docs, k)
    assert evidence.evidence_topk(asked.limit(0), frame).count() == 0 and evidence.evidence_topk(asked, frame.limit(0)).count() == 0


def test_fingerprint_is_the_tree_of_paths(spark):
    rows = [(f"p{k}", f"c{k}é") for k in range(40)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = files.tree_fingerprint(spark.createDataFrame(rows, "path string, content string").withColumn("other", F.lit(1))).first()
    assert got.fingerprint == plain_tree([(sha(p), sha(f"{p}|{c}")) for p, c in rows]) and got.n_files == 40 and got.n_bytes == sum(len(c.encode()) for _, c in rows)


@pytest.mark.parametrize("block", [4000, 3])
def test_cosine_topk_with_copies_and_blocks(spark, block):
    """Many equal documents, repeated and null ids, queries in one block or several: as by comparison of all with all."""
    import math
    import random
    from collections import Counter, defaultdict

    from weftline.operators import evidence

    rnd = random.Random(3)
    vocabulary = [f"word{k}" for k in range(40)]
    texts = [(d, " ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 30)))) for d in range(60)]
    texts += [(200 + d, texts[7][1]) for d in range(90)] + [(5, "word1 word2 word3"), (5, "word1 word9"), (None, "word1"), (400, ""), (401, None)]
    queries = [(q, " ".join(rnd.choices([*vocabulary, "unknown"], k=8))) for q in range(10)] + [(10, texts[7][1]), (11, ""), (None, "word1")]
    tokens = [(d, (t or "").split()) for d, t in texts]
    df = Counter(w for _, t in tokens for w in set(t))

    def vectors(rows):
        counts, out = Counter((i, len(t), w) for i, t in rows if i is not None for w in t), defaultdict(lambda: defaultdict(list))
        for (i, n, w), c in counts.items():
            if w in df:
                out[i][w].append(c / n * math.log(1 + len(texts) / df[w]))
        return out

    norm = lambda v: math.sqrt(sum(x * x for own in v.values() for x in own))
    d, want = vectors(tokens), set()
    for q, v in vectors([(q, t.split()) for q, t in queries]).items():
        scores = [(-round(min(1, sum(sum(v[w]) * sum(x[w]) for w in v.keys() & x.keys()) / norm(v) / norm(x)), 9), i) for i, x in d.items() if v.keys() & x.keys()]
        want |= {(q, i, -s) for s, i in sorted(scores)[:5]}
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = evidence.cosine_topk(spark.createDataFrame(queries, "query_id long, text string"), frame, block=block)
    got = {(r.query_id, r.doc_id, r.score) for r in found.collect()}
    assert {x[:2] for x in got} == {x[:2] for x in want} and len(got) == len(want) > 50
