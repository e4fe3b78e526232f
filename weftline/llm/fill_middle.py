"""Fill-in-the-middle by displacement scatter.

The bytes of many texts lie end to end. One scan marks where tokens (white space and the word after it) start, so
hashed cuts become byte places; then every byte's place in the output is its own place plus a shift that changes
only where a prefix, middle or suffix starts. These changes stand in a difference array, its cumulative sum is every
byte's shift, and one scatter builds all outputs. restore() finds the three markers in an output, builds the same
shifts from them and gathers. Both work through blocks of BLOCK bytes with the sum carried over, so memory is a
few times the rows of one slice (SLICE bytes of text or one longer text), whatever the length. Nothing is shuffled.

A text that holds a marker stays plain, and no marker's end is another's begin, so an output other than plain holds
each marker once, wherever a cut falls beside "<" or ">".

Defined results: null text counts as empty (plain); a null doc_id is hashed as an empty one; rows are treated alone,
so ties and repeated rows give equal rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import text_or_empty

SEED = 42
RATE = 50  # of a hundred texts are rearranged,
SPM = 80  # of a hundred of these with the suffix first
SLICE = 4 << 20
BLOCK = 1 << 18
#: The markers before prefix, suffix and middle.
MARKS = (b"<P>", b"<S>", b"<M>")
PLAIN, PSM, SPM_FORM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"], dtype=object)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[m[1] for m in MARKS]] = True
_COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts without nulls, end to end, and where each begins (and the last one ends)."""
    wide = column.cast(pa.large_string())
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def texts_of(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most `limit` bytes of text each, or one longer text."""
    ends = np.cumsum(np.asarray(pc.binary_length(batch.column(column)), dtype=np.int64))
    low = 0
    while low < batch.num_rows:
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(low, high - low)
        low = high


def token_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where tokens start: at a text's first byte, and at white space after a byte of a word."""
    space = _SPACE[data]
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[at[:-1][at[:-1] < at[1:]]] = True
    return np.flatnonzero(begin)


def markers(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of markers and the text each stands in."""
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    found = np.flatnonzero((data[:-2] == MARKS[0][0]) & _LETTER[data[1:-1]] & (data[2:] == MARKS[0][2]))
    text = np.searchsorted(at, found, "right") - 1
    inside = found + 3 <= at[text + 1]
    return found[inside], text[inside]


def displacement(begin: np.ndarray, sizes: np.ndarray, form: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of prefix, middle and suffix of each text and the jump of the shift there. `sizes` (texts x 3) are their
    bytes, `begin` and `out` where the texts start before and after."""
    p, m, s = sizes.T
    starts = begin[:, None] + np.stack([np.zeros_like(p), p, p + m], axis=1)
    shift = np.zeros_like(sizes)
    psm, spm = form == PSM, form == SPM_FORM
    shift[psm] = np.stack([np.full_like(p, 3), s + 9, 6 - m], axis=1)[psm]
    shift[spm] = np.stack([s + 6, s + 9, 3 - p - m], axis=1)[spm]
    shift += (out - begin)[:, None]
    flat_shift = shift.reshape(-1)
    return starts.reshape(-1), np.diff(flat_shift, prepend=0)


def shifted(n: int, starts: np.ndarray, jumps: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Blocks of the n bytes and, for each byte, its place on the other side."""
    carry = 0
    for low in range(0, n, BLOCK):
        high = min(n, low + BLOCK)
        a, b = np.searchsorted(starts, (low, high))
        difference = np.zeros(high - low, dtype=np.int64)
        np.add.at(difference, starts[a:b] - low, jumps[a:b])
        shift = np.cumsum(difference) + carry
        carry = int(shift[-1])
        yield slice(low, high), shift + np.arange(low, high)


def hashes(doc_ids: list[int | None], seed: int) -> np.ndarray:
    """The first four 32-bit words of each id's sha256."""
    found = b"".join(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).digest()[:16] for d in doc_ids)
    return np.frombuffer(found, dtype=">u4").reshape(-1, 4).astype(np.int64)


def rearrange(data: np.ndarray, at: np.ndarray, h: np.ndarray, rate: int = RATE, spm: int = SPM) -> dict[str, np.ndarray]:
    """Tokens, form, bytes of the three parts, and the outputs with their places."""
    starts, size = token_starts(data, at), np.diff(at)
    first = np.searchsorted(starts, at[:-1])
    n = np.searchsorted(starts, at[1:]) - first
    form = np.where(h[:, 2] % 100 >= rate, PLAIN, np.where(h[:, 3] % 100 < spm, SPM_FORM, PSM))
    form[size == 0] = PLAIN
    form[markers(data, at)[1]] = PLAIN
    units = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    places = np.append(starts, 0)[np.minimum(first[:, None] + units, len(starts))]
    places = np.where(units < n[:, None], places, at[1:, None])
    sizes = np.diff(np.concatenate([at[:-1, None], places, at[1:, None]], axis=1), axis=1)
    out_at = np.concatenate([[0], np.cumsum(size + np.where(form == PLAIN, 0, 9))])
    out = np.empty(out_at[-1], dtype=np.uint8)
    for block, to in shifted(len(data), *displacement(at[:-1], sizes, form, out_at[:-1])):
        out[to] = data[block]
    p, _, s = sizes.T
    zero = np.zeros_like(p)
    for kind, before in ((PSM, (zero, p + 3, p + s + 6)), (SPM_FORM, (s + 3, zero, p + s + 6))):
        own = form == kind
        for mark, place in zip(MARKS, before, strict=True):
            out[(out_at[:-1] + place)[own][:, None] + np.arange(3)] = np.frombuffer(mark, dtype=np.uint8)
    return {"n": n, "form": form, "sizes": sizes, "out": out, "out_at": out_at}


def rebuild(out: np.ndarray, out_at: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts again, from outputs and forms alone."""
    moved = np.flatnonzero(form != PLAIN)
    place, text = markers(out, out_at)
    own = form[text] != PLAIN
    place, text = place[own], text[own]
    if not np.array_equal(text, np.repeat(moved, 3)):
        raise ValueError("an output that is not plain holds each marker once")
    place = place.reshape(-1, 3)
    letters = out[place + 1]
    order = np.where((form[moved] == PSM)[:, None], [m[1] for m in MARKS], [MARKS[k][1] for k in (1, 0, 2)])
    if not np.array_equal(letters, order) or not np.array_equal(place[:, 0], out_at[moved]):
        raise ValueError("the markers of an output don't fit its form")
    parts = np.diff(np.concatenate([place, out_at[moved + 1][:, None]], axis=1), axis=1) - 3  # between markers
    sizes = np.zeros((len(form), 3), dtype=np.int64)
    sizes[:, 0] = np.diff(out_at)
    spm = form[moved] == SPM_FORM
    sizes[moved] = np.stack([np.where(spm, parts[:, 1], parts[:, 0]), parts[:, 2], np.where(spm, parts[:, 0], parts[:, 1])], axis=1)
    at = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))])
    data = np.empty(at[-1], dtype=np.uint8)
    for block, source in shifted(len(data), *displacement(at[:-1], sizes, form, out_at[:-1])):
        data[block] = out[source]
    return data, at


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars (code points, null if plain), output."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                data, at = flat(part.column(1))
                made = rearrange(data, at, hashes(part.column(0).to_pylist(), seed), rate, spm)
                lead = (data & 0xC0) != 0x80
                chars: list[list[int | None]] = [[], []]
                for begin, (p, m, _), form in zip(at[:-1].tolist(), made["sizes"].tolist(), made["form"].tolist(), strict=True):
                    chars[0].append(None if form == PLAIN else np.count_nonzero(lead[begin : begin + p]))
                    chars[1].append(None if form == PLAIN else np.count_nonzero(lead[begin + p : begin + p + m]))
                columns = [part.column(0), pa.array(made["n"], pa.int64()), pa.array(FORMS[made["form"]], pa.string()), *(pa.array(c, pa.int64()) for c in chars), texts_of(made["out"], made["out_at"])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return text_or_empty(docs).mapInArrow(run, _COLUMNS)


def restore(made: DataFrame) -> DataFrame:
    """made with text, the exact text that stands behind form and output; a null output gives a null text."""
    schema = StructType([f for f in made.schema.fields if f.name != "text"] + [StructField("text", StringType())])
    kept = [f.name for f in schema.fields[:-1]]
    form_at, out_at = kept.index("form"), kept.index("output")
    codes = {name: k for k, name in enumerate(FORMS)}

    def run(batches):
        for batch in batches:
            for part in slices(batch, out_at):
                column = part.column(out_at)
                data, at = flat(column.fill_null(""))
                form = np.array([codes[x] if known else PLAIN for x, known in zip(part.column(form_at).to_pylist(), column.is_valid().to_pylist(), strict=True)], dtype=np.int64)
                text = texts_of(*rebuild(data, at, form))
                yield pa.RecordBatch.from_arrays([*part.columns, pc.if_else(column.is_valid(), text, None)], schema.names)

    return made.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)
