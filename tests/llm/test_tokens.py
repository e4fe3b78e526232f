import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm.common import Encoder, tokenizer_path
from weftline.llm.packing import pack
from weftline.llm.token_files import SequenceReader, read_documents, write_sequences


@pytest.fixture(scope="module")
def ids(texts):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [(d, tokenizer.encode(t or "", add_special_tokens=False).ids) for d, t in texts]


def test_encoder_equals_library(texts, ids):
    encoder = Encoder(tokenizer_path(), room=50)
    for _ in range(2):
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in encoder([t or "" for _, t in texts])] == [x for _, x in ids]


def test_literals_of_special_tokens():
    """As the plain call of the library has them, inside words and beside spaces too."""
    tokenizer, encoder = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path())
    texts = ["a <|endoftext|> b", "x<|endoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext", "a <| b |> c", " <|endoftext|>\n"]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in encoder(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_read_back_over_as_many_tasks_as_files(spark, docs):
    _, files = write_sequences(spark, docs)
    assert read_documents(files).rdd.getNumPartitions() == files.count()


def test_token_files_round_trip(spark, docs, empty, texts, ids, tmp_path):
    folder, files = write_sequences(spark, docs, length=64, rows=4, out=str(tmp_path / "out"))
    got = read_documents(files).orderBy("start").collect()
    order = sorted(range(len(ids)), key=lambda k: (ids[k][0] is not None, ids[k][0] or 0))
    assert [r.doc_id for r in got] == [ids[k][0] for k in order]
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, dtype="<u4").tolist()) for r in got) == sorted((str(d), [*x, 0]) for d, x in ids)
    starts = np.cumsum([r.n_tokens for r in got]) - [r.n_tokens for r in got]
    assert [r.start for r in got] == starts.tolist()
    first = files.orderBy("base").first()
    reader = SequenceReader(first.path + ".arrow")
    seq, mask = reader.sequence(0)
    assert len(seq) == 64 and mask.sum() == min(64, first.n_tokens)
    assert not seq.flags.owndata  # a view of the mapped file
    assert write_sequences(spark, empty, out=str(tmp_path / "none"))[1].count() == 0


def test_packing_covers_every_token_once(spark, docs, empty, ids):
    out = pack(spark, docs, length=50, with_ids=True).collect()
    rows = sorted(out, key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in rows:
        assert r.sequence_id * 50 + r.offset == at and r.length <= 50 - r.offset
        at += r.length
    assert at == sum(len(x) + 1 for _, x in ids)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in out)
    whole = {}
    for r in rows:
        whole.setdefault((r.sequence_id * 50 + r.offset - r.start), []).append(r)
    joined = sorted((str(p[0].doc_id), np.frombuffer(b"".join(r.ids for r in sorted(p, key=lambda r: r.start)), dtype="<u4").tolist()) for p in whole.values())
    assert joined == sorted((str(d), [*x, 1]) for d, x in ids)
    assert pack(spark, empty).count() == 0
    assert pack(spark, docs).agg(F.sum("length")).first()[0] == at
