"""Packing by concatenate-and-cut.

Pass 1 encodes every document, appends the end id and writes the ids with their place in the partition.
Prefix sums over the partitions' token totals (one row a partition) then give every document its offset
in the one long run of tokens; pass 2 cuts that run every `length` tokens and emits one boundary record
per piece. No row is shuffled, only the last sequence is short, and a hot source or a very long document
costs no more than its tokens.

Defined results: null text counts as empty (the end id alone); null or repeated doc_ids are packed as
they are, one document a row; an empty table gives no pieces; other columns are ignored. The order of
the run is the order of input partitions and of rows in them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, encoder_of, prefix_sums, text_or_empty, tokenizer_path, vocab_bytes

LENGTH = 2048
END_ID = 1
_TOKENS = "doc_id long, part int, at long, n long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def encode(docs: DataFrame, path: str, end_id: int, width: int) -> DataFrame:
    """doc_id, its partition, tokens of the partition before it, its tokens, ids of `width` bytes each."""

    def run(batches):
        encoder, part, at = encoder_of(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                rows = batch.slice(low, 256)
                found = [np.frombuffer(x + end, dtype="<u4") for x in encoder(rows.column(1).to_pylist())]
                sizes = np.array([len(x) for x in found], dtype=np.int64)
                starts = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                ids = [x.astype(f"<u{width}").tobytes() for x in found]
                parts = pa.array(np.full(len(ids), part, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([rows.column(0), parts, pa.array(starts), pa.array(sizes), pa.array(ids, pa.binary())], ["doc_id", "part", "at", "n", "ids"])

    return text_or_empty(docs).mapInArrow(run, _TOKENS)


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: which stretch of which document lies where in which sequence."""
    path = path or tokenizer_path()
    width = vocab_bytes(path)
    scratch = Scratch(spark, "pack")
    tokens = scratch.write(encode(docs, path, end_id, width), "tokens")
    totals = [(r.part, r.n) for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect()]
    bases = spark.createDataFrame(prefix_sums(totals), "part int, base long")  # one row a partition

    def cut(batches):
        for batch in batches:
            doc, first, total, raw = (batch.column(k) for k in range(4))
            out = [[] for _ in range(8)]
            for doc_id, begin, n, ids in zip(doc.to_pylist(), first.to_pylist(), total.to_pylist(), raw, strict=True):
                ids = np.frombuffer(ids.as_buffer(), dtype=f"<u{width}").astype("<u4").tobytes()
                at = 0
                while at < n:
                    sequence, offset = divmod(begin + at, length)
                    size = min(length - offset, n - at)
                    piece = ids[4 * at : 4 * (at + size)]
                    for column, value in zip(out, (doc_id, at, size, zlib.crc32(piece), n, sequence, offset, piece if with_ids else None), strict=True):
                        column.append(value)
                    at += size
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:7]), pa.array(out[7], pa.binary())], names)

    names = [x.split()[0] for x in _PIECES.split(", ")]
    placed = tokens.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("at")).alias("at"), "n", "ids")
    pieces = placed.mapInArrow(cut, _PIECES)
    if with_ids:
        return pieces
    pieces = scratch.write(pieces.drop("ids"), "pieces")
    scratch.drop("tokens")
    return pieces
