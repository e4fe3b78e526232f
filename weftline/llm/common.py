"""Shared pieces of the training-data operators: scratch tables, words, token ids."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Where it is unset, a local session, whose tasks all run on
    this machine, gets one of its own; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir() + "/weftline-shared"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Tables written once to the shared folder: they cut lineage and outlive lost executors.

    drop() removes what no later plan reads, and lets go of the shuffles of finished steps; what a returned
    DataFrame still reads stays.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/weftline-{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        except BaseException:
            self.drop("")  # a failed step leaves no tables behind
            raise
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:  # "" is the whole folder
            path = jvm.org.apache.hadoop.fs.Path(self.path(name).rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()  # Spark's cleaner takes away shuffle files of what no one refers to any more


def slim(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra ones can't clash with what an operator adds."""
    return docs.select(*columns)


def text_or_empty(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def prefix_sums(totals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(partition, total) in order of partition -> (partition, sum of the totals before it)."""
    totals = sorted(totals)
    sums = [0, *accumulate(n for _, n in totals)]
    return [(p, s) for (p, _), s in zip(totals, sums, strict=False)]


#: Stretches that the byte-level pre-tokeniser never joins with what stands next to them: letters up to
#: a mark or a space, else a run of non-space, each with the one space before it; else white space.
_CHUNK = re.compile("(?: ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,!?;:|\\s]|\\Z))| ?\\S+|\\s+(?!\\S)|\\s+")
#: White space on which regular expression libraries disagree; such texts are encoded in one piece.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85᠎​﻿]")


class Encoder:
    """Token ids of texts by the tokenizers library, as little-endian unsigned 32-bit integers.

    Byte-level BPE works on pre-tokens, so each distinct chunk of a batch is encoded once by the
    library and looked up afterwards. The memory of chunks is emptied when it holds `room` of them.
    """

    def __init__(self, path: str, room: int = 1_500_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cluster's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        #: Literals that the library takes out before it cuts chunks; texts that hold one are encoded in one piece.
        self.literal = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        self.known: dict[str, bytes] = {}
        self.room = room
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _encode_lines(self, parts: list[list[str]]) -> list[bytes]:
        """Each part's chunks joined by line ends, every one of which is a pre-token and so an id of its own."""
        out = []
        for part, found in zip(parts, self.tokenizer.encode_batch_fast(["\n".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.line_end).tolist()
            if len(ends) != len(part) - 1:  # a chunk holds the id of a line end: not in byte-level vocabularies
                out += self._encode(part)
                continue
            raw = ids.tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip([0, *(e + 1 for e in ends)], [*ends, len(ids)], strict=True)]
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.room:
            self.known.clear()
        known, held, missing = self.known, [], set()
        for text in texts:
            chunks = [] if _ODD_SPACE.search(text) or self.literal.search(text) else _CHUNK.findall(text)
            ids = list(map(known.get, chunks))
            if None in ids:
                missing.update([c for c, x in zip(chunks, ids, strict=True) if x is None])
                held.append((text, chunks, ids))
            else:
                held.append((text, None, b"".join(ids)) if chunks else (text, [], None))
        spaces = [c for c in missing if c.isspace()]
        known.update(zip(spaces, self._encode(spaces), strict=True))
        words = list(missing.difference(spaces))
        known.update(zip(words, self._encode_lines([words[at : at + 128] for at in range(0, len(words), 128)]), strict=True))
        out = []
        for text, chunks, ids in held:
            if chunks is None:
                out.append(ids)
            elif ids is None:  # empty, or with odd spaces or literals
                out.append(self._encode([text])[0] if text else b"")
            else:
                out.append(b"".join([known[c] if x is None else x for c, x in zip(chunks, ids, strict=True)]))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's encoder: what it has learnt about chunks serves its later tasks too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocab_bytes(path: str) -> int:
    """2 where every id of the vocabulary fits unsigned 16-bit integers, else 4."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size(True) <= 1 << 16 else 4


def planes(a: np.ndarray) -> bytes:
    """Bytes by significance, so that the zeros of small numbers stand together and compress."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unplanes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(raw, dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(flat.T).view(dtype).reshape(-1)


class WordHash(dict):
    """Hash of each word, the lowest bit 0; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word) & ~1
        return h


WORD_HASHES = WordHash()


def word_hashes(text: str) -> np.ndarray:
    """Hashes of a text's words, in order."""
    words = text.encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(WORD_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
