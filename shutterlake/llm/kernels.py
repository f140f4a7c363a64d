"""Vectorised text kernels over Arrow string columns.

A kernel works on the UTF-8 buffer of many texts at once, so that no Python object is made per word. Texts are taken in
slices of about ``SLICE_BYTES``, which bounds the temporary arrays (one text longer than that forms a slice of its own).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19
#: Longest token that is hashed byte by byte in step with all others; the rest of a longer one is hashed on its own.
IN_STEP = 64
FNV_OFFSET, FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
ROLL = np.uint64(0x9E3779B97F4A7C15)

_bytes = np.arange(256)
#: ASCII upper case to lower case; all other bytes stay.
FOLD = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
#: Bytes of words: digits, lower-case ASCII letters and all of every non-ASCII character, after FOLD.
WORD = ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)


class Texts:
    """A slice of a string column: ``buf`` holds the bytes of all texts, ``at[i]:at[i + 1]`` those of text i."""

    def __init__(self, first: int, buf: np.ndarray, at: np.ndarray):
        self.first, self.buf, self.at = first, buf, at

    def __len__(self) -> int:
        return len(self.at) - 1

    def bytes(self, i: int) -> bytes:
        return self.buf[self.at[i] : self.at[i + 1]].tobytes()

    def text(self, i: int) -> str:
        return self.bytes(i).decode("utf-8", "replace")


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """Slices of a string column in order; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        hi = min(hi, len(column))
        yield Texts(lo, buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def runs(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True bytes, which never cross from one text into the next."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = mask.copy(), mask.copy()
    start[1:] &= ~mask[:-1]
    end[:-1] &= ~mask[1:]
    inner = at[:-1][at[:-1] < n]
    start[inner] = mask[inner]
    inner = at[1:][at[1:] > 0] - 1
    end[inner] = mask[inner]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def hash_runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run, the same on every machine."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    lens = ends - starts
    order = np.argsort(np.minimum(lens, IN_STEP + 1).astype(np.uint16), kind="stable")[::-1]
    s, short = starts[order], np.minimum(lens, IN_STEP)[order]
    h = np.full(len(s), FNV_OFFSET)
    active = np.searchsorted(-short, -np.arange(int(short[0])), "left")
    for k, m in enumerate(active):
        h[:m] = (h[:m] ^ buf[s[:m] + k]) * FNV_PRIME
    out[order] = h
    for i in np.flatnonzero(lens > IN_STEP):
        out[i] ^= np.uint64(xxhash.xxh64_intdigest(buf[starts[i] + IN_STEP : ends[i]].tobytes()))
    return mix(out ^ lens.astype(np.uint64))


class Words:
    """The words of a slice, ASCII case folded: ``hash[at[i]:at[i + 1]]`` are those of text i."""

    def __init__(self, texts: Texts):
        self.buf = FOLD[texts.buf]
        self.starts, self.ends = runs(WORD[self.buf], texts.at)
        self.hash = hash_runs(self.buf, self.starts, self.ends)
        self.at = np.searchsorted(self.starts, texts.at)

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def joined(self, lo: int, hi: int) -> bytes:
        """The words lo..hi with single spaces between, for exact comparison."""
        return b" ".join(self.buf[self.starts[k] : self.ends[k]].tobytes() for k in range(lo, hi))


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on; the last ``size - 1`` positions are missing."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for k in range(1, size):
        h *= ROLL
        h += words[k : k + n]
    return mix(h ^ np.uint64(size))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of every text and where each text's begin; a shorter text is one shingle of all its words."""
    count = words.counts()
    number = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(number)]).astype(np.int64)
    out = np.empty(at[-1], np.uint64)
    full = grams(words.hash, size)
    long = np.flatnonzero(count >= size)
    if len(long):
        take = np.repeat(words.at[long] - np.concatenate([[0], np.cumsum(number[long])[:-1]]), number[long]) + np.arange(number[long].sum())
        out[np.repeat(at[long] - np.concatenate([[0], np.cumsum(number[long])[:-1]]), number[long]) + np.arange(number[long].sum())] = full[take]
    for i in np.flatnonzero((count > 0) & (count < size)):
        out[at[i]] = grams(words.hash[words.at[i] : words.at[i + 1]], int(count[i]))[0]
    return out, at


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of values[at[i]:at[i + 1]] for each i."""
    total = np.concatenate([np.zeros(1, np.float64 if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[at[1:]] - total[at[:-1]]


def frugal(run):
    """``run``, a function of Arrow batches, after which its worker hands freed memory back to the system.

    Workers are used again for later tasks; without this each keeps what its largest task took.
    """

    def both(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return both


def flag(run):
    """A Column function of a text column that is true or false, from ``run``, a function of Arrow arrays of texts.

    Only the texts go to Python and only the flags come back; the rows stay in the JVM.
    """
    own = frugal(run)

    def both(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from own(columns)

    return F.arrow_udf(both, "boolean")
