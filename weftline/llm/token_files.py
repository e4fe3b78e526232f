"""Token ids as Arrow files of fixed-size lists.

Each partition of the documents, ordered by doc_id, becomes one Arrow file whose rows are sequences of
exactly `length` ids and as many mask bits, in record batches of `rows` sequences; memory-mapped, sequence
k is a zero-copy slice. A second small file beside it holds where each document starts. Only one row per
file goes to the driver. A task names its files after its attempt, and only the names that committed
tasks report are read, so lost or repeated tasks leave nothing that counts.

Defined results: null text counts as empty (the end id alone); null doc_ids come first; equal doc_ids
stand in order of their texts' hashes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, encoder_of, prefix_sums, text_or_empty, tokenizer_path, vocab_bytes

LENGTH = 2048
ROWS = 128
END_ID = 0
_FILES = "first_doc long, first_hash long, path string, n_docs long, n_tokens long"
_DOCS = "doc_id long, start long, n_tokens long, path string, ids binary"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class SequenceFile:
    """Writer of one file: takes ids of whole documents, gives out full sequences as batches fill."""

    def __init__(self, uri: str, width: int, length: int, rows: int):
        fs, path = _open(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.type, self.length, self.rows = pa.uint16() if width == 2 else pa.uint32(), length, rows
        self.schema = pa.schema([("ids", pa.list_(self.type, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = fs.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.held, self.n_held = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        while self.n_held >= self.rows * self.length:
            self._flush(self.rows * self.length)

    def _flush(self, n: int) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, dtype=np.uint32)
        now, rest = flat[:n], flat[n:]
        self.held, self.n_held = [rest], len(rest)
        size = -(-len(now) // self.length) * self.length
        ids = np.zeros(size, dtype=self.type.to_pandas_dtype())
        ids[: len(now)] = now
        mask = pa.array(np.arange(size) < len(now))
        batch = [pa.FixedSizeListArray.from_arrays(pa.array(ids, self.type), self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(batch, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            self._flush(self.n_held)
        self.writer.close()
        self.sink.close()


class SequenceReader:
    """Random access: memory-mapped where the file is local, ranged reads elsewhere."""

    def __init__(self, uri: str):
        from pyarrow import fs

        system, path = _open(uri)
        self.file = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        self.reader = pa.ipc.open_file(self.file)
        self.length = self.reader.schema.field("ids").type.list_size
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        batch, row = self.reader.get_batch(k // self.rows), k % self.rows
        cut = slice(row * self.length, (row + 1) * self.length)
        ids = batch.column(0).values.to_numpy(zero_copy_only=True)[cut]
        return ids, batch.column(1).values.slice(row * self.length, self.length).to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Ids from place `start` of the file on, across batches."""
        out, per = [], self.rows * self.length
        while n > 0:
            k, at = divmod(start, per)
            flat = self.reader.get_batch(k).column(0).values.to_numpy(zero_copy_only=True)[at : at + n]
            out.append(flat)
            start, n = start + len(flat), n - len(flat)
        return np.concatenate(out) if len(out) != 1 else out[0]


def write_sequences(spark: SparkSession, docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, rows: int = ROWS, out: str | None = None) -> tuple[str, DataFrame]:
    """Folder of the files, and a table of them in order: path, documents, tokens, tokens before."""
    path = path or tokenizer_path()
    width = vocab_bytes(path)
    scratch = Scratch(spark, "tokens")
    folder = out or scratch.path("files")

    def run(batches):
        encoder, end = encoder_of(path), np.array([end_id], dtype="<u4").tobytes()
        uri, file, at, where, first = f"{folder}/{uuid.uuid4().hex}", None, 0, [[], [], []], None
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                if file is None:
                    file, first = SequenceFile(f"{uri}.arrow", width, length, rows), (part.column(0)[0].as_py(), part.column(1)[0].as_py())
                for doc_id, raw in zip(part.column(0).to_pylist(), encoder(part.column(2).to_pylist()), strict=True):
                    ids = np.frombuffer(raw + end, dtype="<u4")
                    file.add(ids)
                    for column, value in zip(where, (doc_id, at, len(ids)), strict=True):
                        column.append(value)
                    at += len(ids)
        if file is None:
            return
        file.close()
        table = pa.table([pa.array(c, pa.int64()) for c in where], names=["doc_id", "start", "n_tokens"])
        system, name = _open(f"{uri}.docs.arrow")
        with system.open_output_stream(name) as sink, pa.ipc.new_file(sink, table.schema) as writer:
            writer.write_table(table, max_chunksize=65536)
        yield pa.RecordBatch.from_arrays([pa.array([first[0]], pa.int64()), pa.array([first[1]], pa.int64()), pa.array([uri]), pa.array([len(table)]), pa.array([at])], ["first_doc", "first_hash", "path", "n_docs", "n_tokens"])

    keyed = text_or_empty(docs).select("doc_id", F.xxhash64("text").alias("h"), "text")
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    files = scratch.write(ordered.mapInArrow(run, _FILES), "manifest").collect()  # a row a file
    files.sort(key=lambda r: (r.first_doc is not None, r.first_doc or 0, r.first_hash))
    bases = prefix_sums([(k, r.n_tokens) for k, r in enumerate(files)])
    rows_ = [(r.path, r.n_docs, r.n_tokens, base) for r, (_, base) in zip(files, bases, strict=True)]
    return folder, spark.createDataFrame(rows_, "path string, n_docs long, n_tokens long, base long")


def read_documents(files: DataFrame) -> DataFrame:
    """The documents back from the files: doc_id, start in the whole run, tokens, ids (little-endian, 32 bits)."""

    def run(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = SequenceReader(f"{uri}.arrow")
                system, name = _open(f"{uri}.docs.arrow")
                index = pa.ipc.open_file(system.open_input_file(name))
                for k in range(index.num_record_batches):
                    for low in range(0, (part := index.get_batch(k)).num_rows, 512):
                        some = part.slice(low, 512)
                        starts, sizes = some.column(1).to_pylist(), some.column(2).to_pylist()
                        ids = [reader.tokens(a, n).astype("<u4").tobytes() for a, n in zip(starts, sizes, strict=True)]
                        yield pa.RecordBatch.from_arrays([some.column(0), pa.array([a + base for a in starts], pa.int64()), some.column(2), pa.array([uri] * len(ids)), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "path", "ids"])

    # a given number of partitions is not merged, so every file can have a task
    return files.select("path", "base").repartition(max(1, files.count()), "path").mapInArrow(run, _DOCS)
