"""Records that differ only in how they are written, collapsed with the help of Bloom filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from . import bloom
from . import letters as L

BITS_PER_ROW = 8  # a singleton then passes for a possible repeat with a probability of 0.003, and of 0.03 at most
MAX_BITS = bloom.MOST_BITS  # of a filter: more rows make more ranges of digests, each with a filter of its own
PREFIX = 1 << 31  # ranges are cut from the first 31 bits of a digest


def canonical(text: Column) -> Column:
    """The chains of letters of a text in sorted order, joined by ':'.

    Case, blanks, hyphens, digits, punctuation and the order of chains leave no trace; any run of
    ``: / | ;`` separates chains and empty chains don't count. Null gives null.
    """
    kept = F.regexp_replace(F.upper(text), "[^A-Z:/|;]", "")
    return F.array_join(F.array_sort(F.filter(F.split(kept, "[:/|;]+"), lambda c: F.length(c) > 0)), ":")


def _digests(col: pa.Array) -> np.ndarray:
    """The first 64 bits of each 32-byte digest of a column without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, off, data = col.buffers()
    begin = int(np.frombuffer(off, np.int64 if pa.types.is_large_binary(col.type) else np.int32)[col.offset])
    return np.frombuffer(data, np.uint64, count=len(col) * 4, offset=begin).reshape(-1, 4)[:, 0]


def _flagged(rows: DataFrame, seen: bytearray, bits: int) -> DataFrame:
    """(id, h): the digest stays where the filter says that it may occur again, and is null elsewhere. Staged, so that the filter can go."""
    shared = rows.sparkSession.sparkContext.broadcast(bytes(seen))

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            if batch.num_rows:
                hit = bloom.all_set(mask, bloom.places(_digests(batch.column(1)), bits))
                yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(pa.array(hit), batch.column(1), pa.scalar(None, pa.binary()))], names=["id", "h"])

    out = staged(rows.select("id", "h").mapInArrow(flag, "id long, h binary"), "flagged")
    shared.destroy()
    return out


def format_copies(df: DataFrame, id_col: str = "sequence_id", text_col: str = "sequence", max_bits: int = MAX_BITS, per_row: int = BITS_PER_ROW) -> DataFrame:
    """(keep_id, member_id, n_copies) for every usable record; keep_id is the smallest id of its record.

    Records are the same if ``canonical`` says so. Two passes: Bloom filters over the canonical digests
    find what may repeat; only those rows are shuffled and grouped exactly, by SHA-256. All others are
    singletons (n_copies 1) and never move.

    A filter has ``per_row`` bits a row. Rows beyond what ``max_bits`` hold are divided by the first bits of
    their digests into as many ranges as they need, each with a filter and passes of its own, so that the
    filters never fill up, however many rows there are. The digests are then staged once, sorted within
    their partitions: a range's pass skips the pages of the others, and no row is shuffled for it.

    Grouping has map-side partial counts, and members come back by a join that splits a hot group. Rows
    with null id, null text or fewer than 8 letters are left out; an id that occurs twice counts once.
    """
    c = canonical(F.col(text_col))
    enough = F.length(L.letters(F.col(text_col))) >= L.WINDOW
    digest = F.sha2(c, 256)
    rows = df.where(F.col(id_col).isNotNull() & enough).select(F.col(id_col).cast("long").alias("id"), F.unhex(digest).alias("h"))
    n, max_bits = df.count(), 1 << (max(max_bits, bloom.SLICE * 8).bit_length() - 1)
    ranges = max(1, -(-n * per_row // max_bits))
    if ranges > 1:
        p = F.shiftright(F.conv(F.substring(F.hex("h"), 1, 8), 16, 10).cast("long"), 1)
        rows = staged(rows.select("id", "h", p.alias("p")).sortWithinPartitions("p"), "digests")
    bits = bloom.size_for(-(-n // ranges), per_row, max_bits)
    flagged = None
    for r in range(ranges):
        part = rows.where((F.col("p") >= PREFIX * r // ranges) & (F.col("p") < PREFIX * (r + 1) // ranges)) if ranges > 1 else rows
        one = _flagged(part, bloom.merged_filter(part.select("h"), lambda b: _digests(b.column(0)), bits, twice=True), bits)
        flagged = one if flagged is None else flagged.unionByName(one)
    possible = flagged.where("h is not null").distinct()
    groups = possible.groupBy("h").agg(F.min("id").alias("keep_id"), F.count("*").alias("n_copies"))
    grouped = possible.join(groups, "h").select("keep_id", F.col("id").alias("member_id"), "n_copies")
    single = flagged.where("h is null").select(F.col("id").alias("keep_id"), F.col("id").alias("member_id"), F.lit(1).cast("long").alias("n_copies"))
    return grouped.unionByName(single)


def records(df: DataFrame, id_col: str = "sequence_id", text_col: str = "sequence", max_bits: int = MAX_BITS) -> DataFrame:
    """(keep_id, n_copies): one row per record, with its number of copies (itself included)."""
    return format_copies(df, id_col, text_col, max_bits).where("keep_id = member_id").select("keep_id", "n_copies")
