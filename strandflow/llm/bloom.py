"""Bloom filters that partitions fill apart and Spark merges slice by slice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import letters as L

HASHES = 4
MOST_BITS = 1 << 29  # 64 MB: what is sent to each executor never exceeds this
SLICE = 1 << 13  # bytes of a filter that travel and are merged together
SPARSE = SLICE // 2  # set bits up to which a slice travels as places of two bytes each
_PARTS = pa.schema([("at", pa.int64()), ("once", pa.binary()), ("again", pa.binary())])


def places(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bit numbers of 64-bit keys, HASHES columns; ``bits`` is a power of two."""
    a, b = L.mix(keys + L._A), L.mix(keys ^ L._B) | np.uint64(1)
    with np.errstate(over="ignore"):
        at = a[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)[None, :]
        return (L.mix(at) & np.uint64(bits - 1)).astype(np.int64)


def set_bits(bitmap: np.ndarray, at: np.ndarray) -> None:
    at = at.reshape(-1)
    np.bitwise_or.at(bitmap, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def all_set(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)


def size_for(rows: int, per_row: int, most: int) -> int:
    """Bits of a filter: a power of two with at least ``per_row`` a row, within one slice and ``most``."""
    return max(SLICE * 8, min(most, 1 << max(1, rows * per_row - 1).bit_length()))


def encoded(part: np.ndarray) -> bytes:
    """A slice as bytes: the places of its bits if they are few, else the slice itself."""
    if part.any():
        on = np.flatnonzero(np.unpackbits(part, bitorder="little"))
        return on.astype(np.uint16).tobytes() if len(on) < SPARSE else part.tobytes()
    return b""


def decoded(data: bytes) -> np.ndarray:
    if len(data) == SLICE:
        return np.frombuffer(data, np.uint8)
    out = np.zeros(SLICE * 8, np.uint8)
    out[np.frombuffer(data, np.uint16)] = 1
    return np.packbits(out, bitorder="little")


def merged_filter(keyed: DataFrame, key, bits: int, twice: bool) -> bytearray:
    """Bits of a filter of the keys of a frame, or (``twice``) of those that may occur more than once.

    ``key`` takes a record batch to its 64-bit keys. Each partition fills two filters, of what it saw once
    and of what it saw again; merged slice by slice, a bit counts as seen again if it is so in one
    partition, or seen at all in two. A key that occurs twice has all its bits set; one that doesn't may
    have them by chance.

    A slice with few bits travels as places, so a partition sends at most ``4 * HASHES`` bytes a row however
    large the filter is, and each slice is merged in a task of its own share. Only the result, ``bits`` in
    all, comes to the driver.
    """
    n = bits // 8

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(n, np.uint8), np.zeros(n if twice else 0, np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = places(key(batch), bits)
            if twice:
                at = at[np.lexsort(at.T)]
                same = np.concatenate([[False], (at[1:] == at[:-1]).all(1)])
                set_bits(again, at[same | all_set(once, at)])
            set_bits(once, at)
        used = np.flatnonzero(once.reshape(-1, SLICE).any(1))
        for k in range(0, len(used), 512):
            some = [int(s) * SLICE for s in used[k : k + 512]]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([encoded(once[s : s + SLICE]) for s in some], pa.binary()), pa.array([encoded(again[s : s + SLICE]) if twice else b"" for s in some], pa.binary())], schema=_PARTS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, once, again = None, None, None  # the slices come sorted, so one is open at a time

        def out() -> Iterator[pa.RecordBatch]:
            bits_ = again if twice else once
            if k is not None and bits_.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([encoded(bits_)], pa.binary())], names=["at", "on"])

        for batch in batches:
            for at, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
                a, b = decoded(a), decoded(b)
                if at != k:
                    yield from out()
                    k, once, again = at, a, b
                else:
                    again = again | b | (once & a)
                    once = once | a
        yield from out()

    parts = keyed.mapInArrow(fill, "at long, once binary, again binary")
    result = bytearray(n)
    for r in parts.repartition("at").sortWithinPartitions("at").mapInArrow(merge, "at long, on binary").toLocalIterator():
        result[r["at"] : r["at"] + SLICE] = decoded(bytes(r["on"])).tobytes()
    return result


def filter_of(keyed: DataFrame, rows: int, per_row: int = 8) -> bytearray:
    """Filter of the values of a frame with one column of type long; beyond MOST_BITS it fills up and lets more through."""
    return merged_filter(keyed, lambda b: b.column(0).to_numpy().view(np.uint64), size_for(rows, per_row, MOST_BITS), twice=False)


def passing(df: DataFrame, column: str, mask: bytearray) -> DataFrame:
    """The rows whose value of a column of type long (never null) the filter may hold, found where they are."""
    at = df.columns.index(column)
    shared = df.sparkSession.sparkContext.broadcast(bytes(mask))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(all_set(bits, places(batch.column(at).to_numpy().view(np.uint64), len(bits) * 8))))

    return df.mapInArrow(run, df.schema)
