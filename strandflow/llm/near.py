"""Groups of records that share most of their content (small edits, gains, losses, moved stretches)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import staged
from . import letters as L
from .pairs import LEADERS, few_pairs, pair_runs, prefix_windows, verified

SLOTS, CHUNK, ERRORS, BITS = 24, 3, 1, 32
PARTS, GROUP_BITS = 16, 2  # chunks of a nucleotide signature, and the bits of a window's hash that number its slot in one
MANY = 64  # distinct windows from which a text of nucleotides only has no keys of the other kind


def signatures(data: np.ndarray, off: np.ndarray, slots: int = SLOTS, bits: int = BITS) -> np.ndarray:
    """b-bit minwise signatures, one row per text: of each slot's smallest window hash the lowest ``bits`` bits.

    Every text must have a window. The share of slots in which two texts differ estimates 1 - similarity.
    """
    at, starts = L.window_starts(off)
    code = L.mix(L.packed(data, L.WINDOW)[at] + np.uint64(1))
    odd = L.mix(np.arange(1, slots + 1, dtype=np.uint64) * L._A)
    out = np.empty((len(off) - 1, slots), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    with np.errstate(over="ignore"):
        for s in range(slots):
            low = np.minimum.reduceat(code * (odd[s] | np.uint64(1)) + odd[s], starts[:-1])
            out[:, s] = L.mix(low) & mask
    return out


def chunk_keys(sig: np.ndarray, chunk: int = CHUNK, errors: int = ERRORS) -> np.ndarray:
    """Multi-index keys, one row per signature.

    The slots are split into chunks of ``chunk``; for each chunk and each choice of ``errors`` slots that
    may be wrong, the key hashes the others. Two signatures that differ in fewer than
    ``chunks * (errors + 1)`` slots have, by the pigeonhole, a chunk with at most ``errors`` wrong slots,
    and thus a key in common.
    """
    keys = []
    for c in range(0, sig.shape[1], chunk):
        for n, kept in enumerate(combinations(range(c, min(c + chunk, sig.shape[1])), chunk - errors)):
            h = np.full(len(sig), c * 64 + n + 1, np.uint64)
            for s in kept:
                h = L.mix(h + sig[:, s] + L._A)
            keys.append(h)
    return np.stack(keys, 1)


def grouped_signatures(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Minwise signatures, one row per text, of ``PARTS`` chunks with ``2 ** GROUP_BITS`` slots each.

    A chunk deals the windows by their hash to its slots, and a slot is the smallest hash among its own.
    So no window fills two slots of a chunk, as it often would where there are only 65,536 to choose from. A
    slot without windows takes the chunk's smallest hash.
    """
    at, starts = L.window_starts(off)
    code = L.mix(L.packed(data, L.WINDOW)[at] + np.uint64(1))
    odd = L.mix(np.arange(1, PARTS + 1, dtype=np.uint64) * L._B) | np.uint64(1)
    groups = 1 << GROUP_BITS
    out = np.empty((len(off) - 1, PARTS, groups), np.uint64)
    none = ~np.uint64(0)
    with np.errstate(over="ignore"):
        for c in range(PARTS):
            h, own = code * odd[c] + odd[c], (code >> np.uint64(GROUP_BITS * c)) & np.uint64(groups - 1)
            for g in range(groups):
                out[:, c, g] = np.minimum.reduceat(np.where(own == g, h, none), starts[:-1])
    least = np.broadcast_to(out.min(2, keepdims=True), out.shape)
    return L.mix(np.where(out == none, least, out)).reshape(len(out), -1)


def key_kinds(data: np.ndarray, off: np.ndarray, at_least: float) -> tuple[np.ndarray, np.ndarray]:
    """(general, nucleotide): which texts need the keys of ``signatures``, and which those of ``grouped_signatures``.

    Every text needs one kind, and two texts of similarity ``at_least`` have a kind in common, for certain.
    With ``share = at_least / (1 + at_least)``, they have at least ``share`` of their two numbers of windows
    together in common. A text without the general kind has less than ``share`` of other windows than of
    nucleotides, one without the nucleotide kind has less than ``share`` of these, so such two have fewer. Few
    windows need the general kind, of which those of twice as many (at 0.5) have either.
    """
    n, plain = L.window_counts(data, off)
    share = at_least / (1 + at_least) - 1e-9
    return (n - plain >= share * n) | (n < MANY), (plain >= share * n) & (n >= at_least * MANY)


def signature_keys(texts: DataFrame, slots: int = SLOTS, chunk: int = CHUNK, errors: int = ERRORS, bits: int = BITS, at_least: float = 0.5) -> DataFrame:
    """(key, id) for every multi-index key of texts (id, letters).

    Nucleotides have few different windows, so unrelated texts often agree in the two slots of a general key,
    and ever more of them the larger the table. Their keys take three of the four slots of a
    ``grouped_signatures`` chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, off = L.buffers(batch.column(1))
            general, plain = map(np.flatnonzero, key_kinds(data, off, at_least))
            for own, sign in ((general, lambda *t: chunk_keys(signatures(*t, slots, bits), chunk, errors)), (plain, lambda *t: L.mix(chunk_keys(grouped_signatures(*t), 1 << GROUP_BITS, 1)))):
                if len(own):
                    keys = sign(*L.picked(data, off, own))
                    ids = np.repeat(batch.column(0).to_numpy()[own], keys.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], names=["key", "id"])

    return texts.select("id", "letters").mapInArrow(run, "key long, id long")


def _open_members(long_runs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, strays) of the long keys (key, id) whose members are in several components.

    Of each key the largest component is the main one; strays are the members outside of it, with the
    key's size. Both are (key, id, component, main, size).
    """
    found = staged(found, "found")
    member = long_runs.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    parts = staged(member.groupBy("key", "component").agg(F.count("*").alias("n")), "parts")
    main = parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("size"), F.count("*").alias("k")).where("k > 1")
    m = staged(member.join(main.drop("k"), "key"), "split")
    return m, m.where("component <> main")


def _between(members: DataFrame, strays: DataFrame) -> DataFrame:
    """(a, b), a < b: strays with all members of their keys that are in other components."""
    a, b = members.select("key", F.col("id").alias("a"), F.col("component").alias("ca")), strays.select("key", F.col("id").alias("b"), F.col("component").alias("cb"))
    return a.join(b, "key").where("ca <> cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _with_links(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after further links (a, b), which often there are none of."""
    links = staged(links, "links")
    if links.isEmpty():
        return found
    return connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links), "a", "b")


def near_groups(df: DataFrame, id_col: str = "sequence_id", text_col: str = "sequence", at_least: float = 0.5, leaders: int = LEADERS, **sign: int) -> DataFrame:
    """(group_id, member_id): every record of a group of two or more, group_id being its smallest id.

    Records group when their 8-letter-window similarity is ``at_least``, directly or through others.

    1. Records with the same letters become one text, so copies never meet each other in a bucket.
    2. Texts get b-bit minwise signatures; a multi-index Hamming join over chunks of slots gives
       candidates: all pairs within the signature distance of ``chunk_keys`` and most beyond it (at the
       defaults a pair of similarity 0.5 shares no key with probability 0.004, of 0.6 with 0.0002).
       Nucleotide texts have longer keys, and more of them (``signature_keys``), with about the same loss.
    3. Candidates are checked exactly, and components of the links found.
    4. A key shared by more than ``leaders`` texts gives only pairs with its leaders. Its members that then
       are in different components are compared with each other, or, where those are many pairs, through
       their rare windows (``prefix_windows``), of which a frequent one is split in the same way: pairs with
       leaders first, then only members that are still apart. No link is lost, and none is made between
       records that are already together.

    Null texts, and texts with fewer than 8 letters, are in no group; rows with a null id are left out;
    a repeated id counts once; an empty table gives no rows. Other columns are not looked at.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), L.letters(F.col(text_col)).alias("letters")).where(F.col("id").isNotNull() & (F.length("letters") >= L.WINDOW))
    texts = staged(rows.groupBy("letters").agg(F.min("id").alias("id")), "texts")
    runs = staged(pair_runs(signature_keys(texts, at_least=at_least, **sign), leaders), "runs")
    pairs = runs.where("kind = 0").select("a", "b").where("a <> b").distinct()
    links = staged(verified(pairs, texts, at_least), "links")
    found = connected_components(links, "a", "b")
    long_runs = runs.where("kind = 1").select("key", F.col("a").alias("id"))
    if not long_runs.isEmpty():
        m, strays = _open_members(long_runs, found)
        if few_pairs(strays.agg(F.sum("size")), m):
            rest = _between(m, strays)
        else:
            rare = prefix_windows(texts.join(m.select("id"), "id", "left_semi"), at_least).withColumnRenamed("w", "key")
            again = staged(pair_runs(rare, leaders), "runs")
            comp = m.select("id", "component").distinct()
            met = again.where("kind = 0").select("a", "b").distinct().join(comp.toDF("a", "ca"), "a").join(comp.toDF("b", "cb"), "b").where("ca <> cb").select("a", "b")
            found = _with_links(found, verified(met.join(pairs, ["a", "b"], "left_anti"), texts, at_least))
            rest = _between(*_open_members(again.where("kind = 1").select("key", F.col("a").alias("id")), found))
        found = _with_links(found, verified(rest.join(pairs, ["a", "b"], "left_anti"), texts, at_least))
    found = staged(found, "found")
    # Records to texts by a digest of the letters: the letters themselves need not move again.
    keyed = rows.select("id", F.unhex(F.sha2("letters", 256)).alias("h"))
    first = keyed.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    member = keyed.join(first.where("n > 1").select("h", "rep"), "h").select("id", "rep").where("id <> rep")
    # A text that is alone but has copies is a component of its own.
    copies = member.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(F.coalesce("component", "rep").alias("group_id"), F.col("id").alias("member_id"))
    grouped = found.select(F.col("component").alias("group_id"), F.col("node").alias("member_id"))
    alone = member.select(F.col("rep").alias("group_id"), F.col("rep").alias("member_id")).distinct().join(found.select(F.col("node").alias("member_id")), "member_id", "left_anti").select("group_id", "member_id")
    return grouped.unionByName(copies).unionByName(alone).distinct()
