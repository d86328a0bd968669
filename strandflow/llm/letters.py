"""Letters and letter windows of sequence texts: the ground that the record-level deduplicators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = 8  # letters of a window, and the fewest letters that make a record a case
NUCLEOTIDE = np.zeros(256, bool)
NUCLEOTIDE[[ord(c) for c in "ACGTUN"]] = True
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


def letters(text: Column) -> Column:
    """A-Z of the upper-cased text, all else left out; null stays null."""
    return F.regexp_replace(F.upper(text), "[^A-Z]", "")


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: equal inputs stay equal, others spread over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array without nulls, not copied."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    n = len(col)
    _, off, data = col.buffers()
    off = np.frombuffer(off, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def packed(data: np.ndarray, width: int) -> np.ndarray:
    """Code of the ``width`` letters that begin at each place (5 bits a letter, wide windows folded)."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    one = (data - np.uint8(65)).astype(np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out <<= np.uint64(5)
        out |= one[j : j + n]
        if j == 11 and width > 12:
            out = mix(out)
    return out


def window_starts(off: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places in the joined bytes at which a window of one text begins, and where each text's run of them starts."""
    counts = np.maximum(np.diff(off) - width + 1, 0)
    starts = np.concatenate([[0], np.cumsum(counts)])
    total = int(starts[-1])
    return np.arange(total) + np.repeat(off[:-1] - starts[:-1], counts), starts


def picked(data: np.ndarray, off: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts with the given numbers."""
    if len(own) == len(off) - 1:
        return data, off
    size = np.diff(off)[own]
    out = np.concatenate([[0], np.cumsum(size)])
    return data[np.arange(int(out[-1])) + np.repeat(off[:-1][own] - out[:-1], size)], out


def window_counts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text its number of distinct windows, and of those that are all nucleotide codes.

    Texts without such a window, which are most, are counted by places, repeats included.
    """
    at, starts = window_starts(off)
    all_, few = np.diff(starts), np.concatenate([[0], np.cumsum(~NUCLEOTIDE[data])])
    text = np.repeat(np.arange(len(all_)), all_)
    some = np.bincount(text[few[at + WINDOW] == few[at]], minlength=len(all_))
    own = np.flatnonzero(some)
    if len(own):
        d, o = picked(data, off, own)
        at, starts = window_starts(o)
        bits = np.uint64(5 * WINDOW)
        code = np.sort((np.repeat(np.arange(len(own), dtype=np.uint64), np.diff(starts)) << bits) | packed(d, WINDOW)[at])
        code = code[np.concatenate([[True], code[1:] != code[:-1]])]
        plain = np.ones(len(code), bool)
        for j in range(WINDOW):
            plain &= NUCLEOTIDE[((code >> np.uint64(5 * j)) & np.uint64(31)).astype(np.int64) + 65]
        text = (code >> bits).astype(np.int64)
        all_[own], some[own] = np.bincount(text, minlength=len(own)), np.bincount(text[plain], minlength=len(own))
    return all_, some


def distinct_windows(text: bytes) -> np.ndarray:
    """Sorted distinct window codes of one text of letters."""
    return np.unique(packed(np.frombuffer(text, np.uint8), WINDOW))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Windows in both divided by windows in either."""
    if not len(a) or not len(b):
        return 0.0
    i = np.searchsorted(a, b)
    i[i == len(a)] = 0
    both = int((a[i] == b).sum())
    return both / (len(a) + len(b) - both)
