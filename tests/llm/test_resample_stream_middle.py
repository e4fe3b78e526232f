import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import bpe_stream, fill_middle, importance
from weftline.llm.common import tokenizer_path

# fill in the middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_middle(doc_id, text):
    tokens = TOKEN.findall(text)
    x = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if text == "" or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle(spark, docs, empty, texts):
    made = fill_middle.transform(docs)
    back = fill_middle.restore(made.withColumn("line", F.lit("kept"))).collect()
    show = lambda d, w, t: str((d, *w, t))
    assert sorted(show(r.doc_id, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r.text) for r in back) == sorted(show(d, plain_middle(d, t or ""), t or "") for d, t in texts)
    assert all(r.line == "kept" for r in back) and {r.form for r in back} == {"plain", "psm", "spm"}
    assert fill_middle.transform(empty).count() == 0
    assert fill_middle.restore(spark.createDataFrame([("plain", None)], "form string, output string")).first().text is None


@given(st.lists(st.tuples(st.integers(0, 10**6), st.text(alphabet="ab é漢<>PSM \n\t\x1c", max_size=40)), min_size=1, max_size=30), st.sampled_from([1, 3, 7, 1 << 18]))
@settings(max_examples=200, deadline=None)
def test_fill_middle_over_blocks_of_bytes(rows, block):
    saved, fill_middle.BLOCK = fill_middle.BLOCK, block
    try:
        data, at = fill_middle.flat(pa.array([t for _, t in rows]))
        made = fill_middle.rearrange(data, at, fill_middle.hashes([d for d, _ in rows], 42))
        out = fill_middle.texts_of(made["out"], made["out_at"]).to_pylist()
        assert [(n, fill_middle.FORMS[f], o) for n, f, o in zip(made["n"], made["form"], out, strict=True)] == [(w[0], w[1], w[4]) for w in (plain_middle(d, t) for d, t in rows)]
        again, places = fill_middle.rebuild(made["out"], made["out_at"], made["form"])
        assert fill_middle.texts_of(again, places).to_pylist() == [t for _, t in rows]
    finally:
        fill_middle.BLOCK = saved


def test_outputs_that_fit_no_form_are_refused():
    for out, form in (("<P>a<S>b", fill_middle.PSM), ("<S>a<P>b<M>c", fill_middle.PSM), ("x<P>a<S>b<M>c", fill_middle.PSM)):
        data, at = fill_middle.flat(pa.array([out]))
        with pytest.raises(ValueError):
            fill_middle.rebuild(data, at, np.array([form]))


# byte-pair encoding

BITS = ["a", "b", "the", "'", "'s", "'re", "'r", "'ll", "1", "2²", "é", "e\u0301", "\u0323", "漢", "\u1100\u1161\u11a8", "각", " ", "\n", "\u3000", "\x1c", "\x85", "İ", "Σ", "ΑΣ", "<|endoftext|>", "<|end", "<|startoftext|>", "!", "!?", "_", "\u0344", "\u0f73", "ﬁ", "ǅ", "😀", "\u200d", "\u212a", "\u212b"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def vocabulary():
    return bpe_stream.Vocabulary(tokenizer_path("word_bpe_49k.json"), room=500)


def in_blocks(vocabulary, text, step):
    encoder = bpe_stream.Encoder(vocabulary)
    raw = b"".join([*(encoder.feed(text[k : k + step]) for k in range(0, len(text), step)), encoder.finish()])
    return np.frombuffer(raw, dtype="<u4").tolist()


@pytest.mark.parametrize("long", [4, 256])
def test_stream_equals_library(vocabulary, library, monkeypatch, long):
    monkeypatch.setattr(bpe_stream, "LONG", long)
    rnd = random.Random(long)
    for _ in range(1500):
        text = "".join(rnd.choice(BITS if rnd.random() < 0.5 else BITS[:12]) for _ in range(rnd.randrange(0, 50)))
        want = library.encode(text, add_special_tokens=False).ids
        for step in (rnd.randrange(1, 9), 10_000):
            assert in_blocks(vocabulary, text, step) == want, text
        raw = np.array(want, dtype="<u4").tobytes()
        assert bpe_stream.Decoder(vocabulary)(raw) == library.decode(want, skip_special_tokens=False)


def test_words_longer_than_the_window(vocabulary, library):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz" if k % 2 else "aeh") for _ in range(20_000)) for k in range(6)]
    for text in [*texts, "a" * 30_000, "ha" * 15_000, "'" * 9001, "the" * 9000, "=-" * 9000, "1" * 3000]:
        want = library.encode(text, add_special_tokens=False).ids
        assert in_blocks(vocabulary, text, 777) == want
        stream = bpe_stream.RunStream(vocabulary)
        for k in range(0, len(text), 1000):
            stream.feed(text[k : k + 1000])
            assert len(stream.word.held) <= vocabulary.merges.window + 1  # memory doesn't grow with the word


def test_lookahead_suffices():
    """All strings over two letters: tokens that end `lookahead` symbols before a prefix's end stay whatever follows."""
    rnd = random.Random(3)
    for _ in range(60):
        tokens, merges = ["a", "b"], []
        for _ in range(rnd.randrange(1, 7)):
            pair = (rnd.choice(tokens), rnd.choice(tokens))
            if pair[0] + pair[1] not in tokens:
                merges.append(pair)
                tokens.append(pair[0] + pair[1])
        reach = bpe_stream.lookahead(merges)
        table = bpe_stream.Merges({t: k for k, t in enumerate(tokens)}, merges)
        ids = {c: k for k, c in enumerate("ab")}
        cut = lambda s: [tokens[x] for x in table.merge([ids[c] for c in s])]  # noqa: B023, E731
        for prefix in map("".join, itertools.product("ab", repeat=7)):
            stable, end = [], 0
            for t in cut(prefix):
                end += len(t)
                if end > len(prefix) - reach:
                    break
                stable.append(t)
            for more in map("".join, itertools.product("ab", repeat=3)):
                assert cut(prefix + more)[: len(stable)] == stable, (merges, prefix, more)


def test_decoding_joins_bytes_of_one_character(library):
    """A byte-level vocabulary: characters whose bytes lie in several tokens, and bytes that are no text."""
    path = tokenizer_path("byte_bpe_50k.json")
    vocabulary, tokenizer = bpe_stream.Vocabulary(path), Tokenizer.from_file(path)
    text = "漢字 é 😀 naïve <|endoftext|>"
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    decoder = bpe_stream.Decoder(vocabulary)
    assert "".join([*(decoder.feed([i]) for i in ids), decoder.finish()]) == text
    for broken in (ids[:1], ids[1:], ids[::2], ids[::-1]):
        assert bpe_stream.Decoder(vocabulary)(np.array(broken, dtype="<u4").tobytes()) == tokenizer.decode(broken, skip_special_tokens=False)
    with pytest.raises(ValueError):
        bpe_stream.Encoder(vocabulary)  # its words are cut in another way


def test_bpe_operator(spark, docs, empty, texts, library):
    got = bpe_stream.decode(bpe_stream.encode(docs)).collect()
    want = [(d, library.encode(t or "", add_special_tokens=False).ids) for d, t in texts]
    assert sorted(str((r.doc_id, r.n_tokens, np.frombuffer(r.ids, dtype="<u4").tolist(), r.text)) for r in got) == sorted(str((d, len(x), x, library.decode(x, skip_special_tokens=False))) for d, x in want)
    assert bpe_stream.encode(empty).count() == 0


# resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, most):
    found = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return found, [" ".join(found[k : k + n]) for n in range(1, most + 1) for k in range(len(found) - n + 1)]


def plain_resample(rows, target, most=1, buckets=10_000, percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in plain_features(text, most)[1]) for texts in ([x for _, x in rows], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for doc_id, text in rows:
        found, own = plain_features(text, most)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in own)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(found) >= least])
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    k = percent * len(drawn) // 100
    ranked = [(*r[:4], n + 1 if n < k else None) for n, r in enumerate(drawn)]
    return sorted(map(str, ranked + [(*r[:4], None) for r in out if not r[4]]))


@pytest.mark.parametrize("most,percent,room", [(1, 10, 250_000), (3, 50, 30), (2, 100, 0)])
def test_resample(spark, docs, empty, texts, monkeypatch, most, percent, room):
    monkeypatch.setattr(importance.Dictionary.__init__, "__defaults__", (room,))  # words beyond the room count all the same
    target = [texts[k][1] for k in (3, 8, 12)] + [None, ""]
    benchmark = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(spark, docs, benchmark, most=most, percent=percent).collect()
    assert sorted(str((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in got) == plain_resample(texts, target, most, percent=percent)
    if most == 1:
        assert importance.resample(spark, empty, benchmark).count() == 0
        assert importance.resample(spark, docs, benchmark.limit(0), percent=0).where("rank is not null").count() == 0
        ids = {r.doc_id for r in got if r["rank"]} - {None}
        drawn = importance.drawn_documents(spark, docs, benchmark)
        assert drawn.columns == docs.columns and {r.doc_id for r in drawn.collect()} == ids


def test_dictionary_grows_and_stops(monkeypatch):
    rnd = random.Random(7)
    dictionary = importance.Dictionary(room=3000)
    vocabulary = [f"w{rnd.randrange(10**6)}é" for _ in range(5000)] + ["x" * 60]
    for _ in range(20):
        chosen = [rnd.choice(vocabulary) for _ in range(2000)]
        crcs, lengths, starts = dictionary.scan((" " + "  ".join(chosen) + " ").encode())
        assert crcs.tolist() == [zlib.crc32(w.encode()) for w in chosen] and lengths.tolist() == [len(w.encode()) for w in chosen]
    assert dictionary.built == len(dictionary.places) == 3000


def test_crcs_compose():
    rnd = random.Random(1)
    parts = [(rnd.randbytes(rnd.randrange(0, 40)), rnd.randbytes(rnd.randrange(0, 300))) for _ in range(200)]
    a, b = (np.array([zlib.crc32(p[k]) for p in parts], dtype=np.uint32) for k in (0, 1))
    assert importance.append(a, b, np.array([len(p[1]) for p in parts])).tolist() == [zlib.crc32(x + y) for x, y in parts]


def test_ranks_when_the_percentile_is_off(spark, monkeypatch):
    """Should the bound exclude too many, all are sorted."""
    monkeypatch.setattr(F, "percentile_approx", lambda *_: F.max("score"))
    scored = spark.range(1000).selectExpr("id as doc_id", "30L as n_words", "30L as n_features", "id as place", "0L as weight", "pmod(id * 7919, 1000) as score").repartition(5)
    got = importance.draw(spark, importance.Scratch(spark, "test"), scored, 10, 20).where("rank is not null").orderBy("rank").collect()
    assert [r.score for r in got] == list(range(999, 899, -1)) and [r["rank"] for r in got] == list(range(1, 101))
