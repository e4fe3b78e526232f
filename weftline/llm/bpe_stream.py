"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as an incremental state machine.

Lookahead. Compare the merges of a prefix under two continuations. Left of some frontier they agree; at first the
frontier is the prefix's end. It moves left only when a merge (a, b) joins the token a, which ends there, under one
continuation: then it stands before a. The next move is a merge (c, y) of a higher rank, and y, which starts at
the frontier, is a or has grown from a to the right, so a is a first part of y, of a first part of y, and so on. The
longest such chain, summed over the lengths of its left parts, is how far a continuation can reach: lookahead()
finds it in one pass over the merges from the last to the first. A token that ends that many symbols before the end
of what has been read is stable and can be emitted, and what follows a token's end is encoded as if it stood alone.

So a word of any length passes through a window of a few times the lookahead (667 bytes for the word vocabulary of
49,408 ids). Text comes in blocks of any size. What is held between blocks is an unfinished run of non-space
(up to LONG characters, then streamed), the tail that may be a special token's literal, characters that still compose
with their successors (a run of combining marks as long as it lasts), an apostrophe that may open a contraction, and
the window. Encodings of short runs and words are remembered in tables of at most 2 ROOM entries each; these forget
what has not been asked for lately.

Decoding feeds ids to a machine whose state is whether a separator is due and the bytes of an unfinished character;
bytes that can't become text turn into U+FFFD, as the tokenizers library has it.

Ids equal the library's for every character that Python's Unicode tables know; later ones count as neither letter nor
number here.

Defined results: null text counts as empty (no ids, empty text); rows are treated alone, so ties, repeated rows and
null doc_ids give a row each; ids outside the vocabulary are passed over when decoding; an empty table gives no rows;
other columns are ignored by encode() and kept by decode().
"""

from __future__ import annotations

import codecs
import heapq
import json
import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import text_or_empty, tokenizer_path

BLOCK = 1 << 15
LONG = 256
ROOM = 300_000
_NONE = 1 << 62
#: What the vocabulary's file says of normalising and of cutting words.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space of the Unicode property, which is what the pattern's \s means.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"

_SPLIT = regex.compile(f"[{SPACES}]+")
_SEPARATORS = regex.compile("[\x1c-\x1f]")  # str.split takes these for white space too
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")  # of runs without white space
_RUNS = {"letters": regex.compile(r"\p{L}+"), "others": regex.compile(r"[^\p{L}\p{N}]+")}
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself if it shows, else 256 and on."""
    shows = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shows else chr(next(rest)) for b in range(256)]


def lookahead(merges: list[tuple[str, str]], suffix: str = "") -> int:
    """Symbols before the end of a prefix beyond which no continuation changes tokens. The merges are proper: each
    part is a symbol or made by an earlier merge."""
    made_of = {a + b: a for a, b in merges}
    reach: dict[str, int] = {}  # longest chain of later merges that can follow, by the token at the frontier
    longest = 0
    for a, b in reversed(merges):
        here = len(a.removesuffix(suffix)) + reach.get(a, 0)
        longest = max(longest, here)
        part: str | None = b
        while part is not None:
            reach[part] = max(reach.get(part, 0), here)
            part = made_of.get(part)
    return longest


class Merges:
    """A vocabulary's merges by pair of ids, its symbols for bytes inside and at the end of words, and its lookahead."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.pairs = {vocab[a] << 32 | vocab[b]: k << 32 | vocab[a + b] for k, (a, b) in enumerate(merges)}
        letters = byte_letters()
        self.inside = [vocab.get(c, -1) for c in letters]
        self.last = [vocab.get(c + suffix, -1) for c in letters]
        self.sizes = {i: len(t.removesuffix(suffix)) for t, i in vocab.items()}
        self.reach = lookahead(merges, suffix)
        self.window = 4 * max(self.reach, max(self.sizes.values(), default=1), 1)

    def merge(self, ids: list[int]) -> list[int]:
        """Lowest rank first, of equal ones the leftmost."""
        return self._few(ids) if len(ids) <= 48 else self._many(ids)

    def _few(self, ids: list[int]) -> list[int]:
        get = self.pairs.get
        found = [get(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while found and (best := min(found)) < _NONE:
            k = found.index(best)
            ids[k : k + 2] = [best & 0xFFFFFFFF]
            del found[k]
            if k:
                found[k - 1] = get(ids[k - 1] << 32 | ids[k], _NONE)
            if k < len(found):
                found[k] = get(ids[k] << 32 | ids[k + 1], _NONE)
        return ids

    def _many(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.pairs.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(x, k) for k in range(n - 1) if (x := get(ids[k] << 32 | ids[k + 1], _NONE)) < _NONE]
        heapq.heapify(heap)
        while heap:
            x, k = heapq.heappop(heap)
            right = after[k]
            if ids[k] < 0 or right < 0 or get(ids[k] << 32 | ids[right]) != x:
                continue  # one of the two has been merged since
            ids[k], ids[right] = x & 0xFFFFFFFF, -1
            after[k] = far = after[right]
            if far >= 0:
                before[far] = k
                if (y := get(ids[k] << 32 | ids[far], _NONE)) < _NONE:
                    heapq.heappush(heap, (y, k))
            if (near := before[k]) >= 0 and (y := get(ids[near] << 32 | ids[k], _NONE)) < _NONE:
                heapq.heappush(heap, (y, near))
        return [x for x in ids if x >= 0]


class WordStream:
    """One word, fed in pieces: tokens come out once no continuation can change them."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, b""

    def feed(self, piece: bytes) -> list[int]:
        self.held += piece
        out: list[int] = []
        at, own = 0, self.merges
        while len(self.held) - at > own.window + 1:  # the last byte read may be the word's last
            end = 0
            for token in own.merge([own.inside[b] for b in self.held[at : at + own.window]]):
                end += own.sizes[token]
                if end > own.window - own.reach:
                    end -= own.sizes[token]
                    break
                out.append(token)
            at += end
        self.held = self.held[at:] if at else self.held
        return out

    def finish(self) -> list[int]:
        held, self.held = self.held, b""
        if not held:
            return []
        return self.merges.merge([*(self.merges.inside[b] for b in held[:-1]), self.merges.last[held[-1]]])


@cache
def _composing() -> frozenset[str]:
    """Characters that may compose with one before them."""
    out = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            out.add(chr(int(parts[1], 16)))
    return frozenset(out)


def composes(c: str) -> bool:
    """Whether what stands before c can change with it under NFC."""
    if c < "̀":
        return False
    first = unicodedata.normalize("NFD", c)[0]
    return unicodedata.combining(first) != 0 or first in _composing() or c in _composing()


class RunStream:
    """One run of non-space, fed in pieces: special tokens' literals, NFC, lower case, words."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.word = vocab, WordStream(vocab.merges)
        self.raw = self.plain = self.cut = ""
        self.kind: str | None = None  # of the word that goes on

    def feed(self, piece: str, final: bool = False) -> list[int]:
        self.raw += piece
        out, at, special = [], 0, self.vocab.special
        for found in self.vocab.literal.finditer(self.raw):
            out += self._normalized(self.raw[at : found.start()], True)
            out.append(special[found.group()])
            at = found.end()
        end = len(self.raw) if final else max(at, len(self.raw) - self.vocab.longest_literal + 1)
        out += self._normalized(self.raw[at:end], final)
        self.raw = self.raw[end:]
        return out

    def finish(self) -> list[int]:
        return self.feed("", True)

    def _normalized(self, piece: str, final: bool) -> list[int]:
        self.plain += piece
        end = len(self.plain)
        if not final:
            end -= 1
            while end > 0 and composes(self.plain[end]):
                end -= 1
        now, self.plain = self.plain[: max(end, 0)], self.plain[max(end, 0) :]
        if not now.isascii():
            now = unicodedata.normalize("NFC", now).replace("Σ", "σ")  # one by one, whatever stands beside it
        return self._words(now.lower(), final)

    def _words(self, piece: str, final: bool) -> list[int]:
        text, self.cut = self.cut + piece, ""
        out: list[int] = []
        at = 0
        if self.kind:
            found = _RUNS[self.kind].match(text)
            at = found.end() if found else 0
            out += self.word.feed(text[:at].encode())
            if at < len(text) or final:
                out += self.word.finish()
                self.kind = None
        for found in _WORD.finditer(text, at):
            word = found.group()
            if not final and word[0] == "'" and len(text) - found.start() < 3 and word not in _CONTRACTIONS:
                self.cut = text[found.start() :]
                break
            out += self.word.feed(word.encode())
            if not final and found.end() == len(text) and word not in _CONTRACTIONS and not (len(word) == 1 and unicodedata.category(word)[0] == "N"):
                self.kind = "letters" if _RUNS["letters"].match(word) else "others"
                break
            out += self.word.finish()
        return out


class Recent(dict):
    """What `find` says of texts of at most LONG characters, for those asked lately: two generations of `room` each."""

    def __init__(self, find: Callable[[str], bytes], room: int):
        super().__init__()
        self.find, self.room = find, room
        self.older: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text)
        if found is None:
            found = self.find(text)
        if len(text) <= LONG:
            if len(self) >= self.room:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


class Vocabulary:
    """A vocabulary's file; runs and words are tables of ids (little-endian, 32 bits) of whole short ones."""

    def __init__(self, path: str, room: int = ROOM):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model = said["model"]
        suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges, suffix)
        self.runs, self.words = Recent(self._run, room), Recent(self._word, room)
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        literals = sorted(self.special, key=len, reverse=True)
        self.literal = regex.compile("|".join(map(regex.escape, literals)) or "(?!)")
        self.longest_literal = max(map(len, literals), default=1)
        normalizers = [n["type"] for n in (said["normalizer"] or {}).get("normalizers", [])]
        cuts = [p.get("pattern", {}).get("Regex") for p in (said["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.encodes = normalizers == NORMALIZERS and cuts[:1] == [WORDS]  # other ways of cutting can be decoded only
        decoder = (said["decoder"] or {}).get("type")
        own = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        if decoder is None:  # tokens as they stand, a space between them
            self.separator, self.pieces = b" ", {i: t.encode() for i, t in own.items()}
        elif decoder == "ByteLevel":
            codes = {c: b for b, c in enumerate(byte_letters())}
            self.separator, self.pieces = b"", {i: bytes(codes[c] for c in t) if all(c in codes for c in t) else t.encode() for i, t in own.items()}
        else:
            raise ValueError(f"no decoding for {decoder}")

    def _word(self, word: str) -> bytes:
        stream = WordStream(self.merges)
        return _packed(stream.feed(word.encode()) + stream.finish())

    def _run(self, run: str) -> bytes:
        if max(run) < "\u0300" and not self.literal.search(run):  # nothing composes, no special token
            return b"".join(map(self.words.__getitem__, _WORD.findall(run.lower())))
        return _packed(RunStream(self).feed(run, True))


class Encoder:
    """Blocks of one text in, ids (little-endian, 32 bits) out as soon as they are stable."""

    def __init__(self, vocab: Vocabulary):
        if not vocab.encodes:
            raise ValueError("the vocabulary's file normalises or cuts words in another way")
        self.vocab, self.tail = vocab, ""
        self.run: RunStream | None = None

    def feed(self, block: str) -> bytes:
        out = []
        if self.run:
            gap = _SPLIT.search(block)
            if gap is None:
                return _packed(self.run.feed(block))
            out.append(_packed(self.run.feed(block[: gap.start()], True)))
            self.run, block = None, block[gap.end() :]
        text = self.tail + block
        runs = _SPLIT.split(text) if _SEPARATORS.search(text) else text.split()
        self.tail = runs.pop() if runs and not _SPLIT.match(text, len(text) - 1) else ""
        out += map(self.vocab.runs.__getitem__, filter(None, runs))
        if len(self.tail) > LONG:
            self.run = RunStream(self.vocab)
            out.append(_packed(self.run.feed(self.tail)))
            self.tail = ""
        return b"".join(out)

    def finish(self) -> bytes:
        tail, run, self.tail, self.run = self.tail, self.run, "", None
        return _packed(run.finish()) if run else self.vocab.runs[tail] if tail else b""

    def __call__(self, text: str) -> bytes:
        if len(text) <= BLOCK:
            return self.feed(text) + self.finish()
        return b"".join([*(self.feed(text[k : k + BLOCK]) for k in range(0, len(text), BLOCK)), self.finish()])


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class Decoder:
    """Ids in, text out as soon as its bytes are whole characters."""

    def __init__(self, vocab: Vocabulary):
        self.pieces, self.separator = vocab.pieces, vocab.separator
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: list[int]) -> str:
        found = [p for i in ids if (p := self.pieces.get(i)) is not None]
        if not found:
            return ""
        raw = self.separator.join(found)
        raw, self.begun = (self.separator + raw if self.begun else raw), True
        return self.machine.decode(raw)

    def finish(self) -> str:
        rest, self.begun = self.machine.decode(b"", True), False
        self.machine.reset()
        return rest

    def __call__(self, raw: bytes) -> str:
        ids = np.frombuffer(raw, dtype="<u4")
        return "".join([*(self.feed(ids[k : k + BLOCK].tolist()) for k in range(0, len(ids), BLOCK)), self.finish()])


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary_of(path: str) -> Vocabulary:
    """The worker's vocabulary: the runs it has met serve its later tasks too."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, 32 bits)."""
    path = path or tokenizer_path("word_bpe_49k.json")

    def run(batches):
        encoder = Encoder(vocabulary_of(path))
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                ids = [encoder(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return text_or_empty(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with text, what its ids say; null ids give a null text."""
    path = path or tokenizer_path("word_bpe_49k.json")
    schema = StructType([f for f in encoded.schema.fields if f.name != "text"] + [StructField("text", StringType())])
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches):
        decoder = Decoder(vocabulary_of(path))
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [None if raw is None else decoder(raw) for raw in part.column(kept.index("ids")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], schema.names)

    return encoded.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)
