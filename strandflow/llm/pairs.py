"""Candidate pairs from a shared key, and their exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import staged
from . import letters as L

LEADERS = 64  # ids up to which a key gives all its pairs
FEW = 8  # ids of a longer key that all its others are paired with
KEPT = 2000  # texts of which a task keeps the windows
RUNS = "kind int, key long, a long, b long"
_RUNS = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _batch(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(key), pa.array(a), pa.array(b)], schema=_RUNS)


def pair_runs(keyed: DataFrame, leaders: int = LEADERS) -> DataFrame:
    """Pairs of ids that share a key, of a table (key long, id long).

    Kind 0 rows are pairs a < b. A key with up to ``leaders`` ids gives all its pairs, a longer one those of
    its first ``leaders`` ids and those of its first ``FEW`` with all others; all its ids then follow as
    kind 1 rows (key, id in a), from which the caller gets the remaining pairs in an exact way (see
    ``prefix_pairs``). So output is linear in the input.
    Sorting is Spark's (it spills); the scan over sorted rows holds one batch and ``leaders`` ids.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ck, cid, first = None, np.zeros(0, np.int64), None  # the open run: its key, its ids or, if long, its leaders
        for batch in batches:
            key, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            if first is not None and key[0] == ck:  # a long run goes on
                n = int(np.searchsorted(key, ck, side="right"))
                yield from long_part(ck, first, ids[:n])
                key, ids = key[n:], ids[n:]
                if not len(key):
                    continue
            if first is None and len(cid):
                key, ids = np.concatenate([np.full(len(cid), ck), key]), np.concatenate([cid, ids])
            first = None
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([begin, [len(key)]]))
            keep = np.repeat(size <= leaders, size)
            last = int(begin[-1])
            keep[last:] = False
            k, i = key[keep], ids[keep]
            d = 1
            while d < len(k):
                same = np.flatnonzero(k[:-d] == k[d:])
                if not len(same):
                    break
                yield _batch(0, k[same], np.minimum(i[same], i[same + d]), np.maximum(i[same], i[same + d]))
                d += 1
            for s, n in zip(begin[:-1], size[:-1]):
                if n > leaders:
                    yield from whole_long(key[s], ids[s : s + n])
            ck, cid = key[last], ids[last:]
            if len(cid) > leaders:
                yield from whole_long(ck, cid)
                first, cid = cid[:leaders], np.zeros(0, np.int64)
        if first is None and len(cid) > 1:
            x, y = np.triu_indices(len(cid), 1)
            yield _batch(0, np.full(len(x), ck), np.minimum(cid[x], cid[y]), np.maximum(cid[x], cid[y]))

    def whole_long(key: int, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        lead = ids[:leaders]
        x, y = np.triu_indices(len(lead), 1)
        yield _batch(0, np.full(len(x), key), np.minimum(lead[x], lead[y]), np.maximum(lead[x], lead[y]))
        yield _batch(1, np.full(len(lead), key), lead, lead)
        yield from long_part(key, lead, ids[leaders:])

    def long_part(key: int, lead: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        lead = lead[:FEW]
        for at in range(0, len(ids), 4096):
            part = ids[at : at + 4096]
            x, y = np.repeat(lead, len(part)), np.tile(part, len(lead))
            yield _batch(0, np.full(len(x), key), np.minimum(x, y), np.maximum(x, y))
            yield _batch(1, np.full(len(part), key), part, part)

    return keyed.select("key", "id").repartition("key").sortWithinPartitions("key", "id").mapInArrow(scan, RUNS)


def few_pairs(pairs: DataFrame, members: DataFrame) -> bool:
    """Whether the number of pairs left (one value) is of the order of what ``pair_runs`` gives for the members of long keys.

    Both ways to compare them are exact; this only picks the cheaper one.
    """
    return (pairs.first()[0] or 0) <= LEADERS * members.count()


def window_rows(texts: DataFrame) -> DataFrame:
    """(id, w): the distinct windows of texts (id, letters)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = L.buffers(batch.column(1))
            for i, key in enumerate(batch.column(0).to_pylist()):
                if off[i + 1] - off[i] >= L.WINDOW:
                    w = np.unique(L.packed(data[off[i] : off[i + 1]], L.WINDOW)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), key)), pa.array(w)], names=["id", "w"])

    return texts.select("id", "letters").mapInArrow(run, "id long, w long")


def prefix_windows(texts: DataFrame, at_least: float) -> DataFrame:
    """(id, w): the windows of texts (id, letters) of which two texts of that similarity share one.

    Prefix filtering: with each text's windows ordered from rare to common, these are the first
    ``n - ceil(at_least * n) + 1``. A stretch that stands in very many texts comes last and is mostly left out.
    """
    w = staged(window_rows(texts.select("id", "letters").dropDuplicates(["id"])), "windows")
    freq = w.groupBy("w").agg(F.count("*").alias("f"))
    rare_first = Window.partitionBy("id").orderBy("f", "w")
    ranked = w.join(freq, "w").withColumn("r", F.row_number().over(rare_first)).withColumn("n", F.count("*").over(Window.partitionBy("id")))
    return staged(ranked.where((F.col("r") <= F.col("n") - F.ceil(F.col("n") * F.lit(at_least)) + 1) & (F.col("f") > 1)).select("id", "w"), "prefix")


def prefix_pairs(left: DataFrame, right: DataFrame, at_least: float) -> DataFrame:
    """(a, b): all pairs of left and right texts (id, letters) that can have the similarity, found through their rare windows (``prefix_windows``)."""
    prefix = prefix_windows(left.select("id", "letters").unionByName(right.select("id", "letters")), at_least)
    a = prefix.join(left.select("id").distinct(), "id", "left_semi").withColumnRenamed("id", "a")
    b = prefix.join(right.select("id").distinct(), "id", "left_semi").withColumnRenamed("id", "b")
    return a.join(b, "w").where("a <> b").select("a", "b").distinct()


def verified(pairs: DataFrame, texts: DataFrame, at_least: float, earlier: bool = False) -> DataFrame:
    """The pairs (a, b) whose texts have a window similarity of ``at_least``; with ``earlier`` only those in which b came before a.

    ``texts`` is (id, letters), for ``earlier`` also ``at``; of equal times the smaller id came first. Pairs may
    have a ``bound``: texts within so many edits are similar for certain (0: no such bound), so the bounded
    edit distance settles them, and only the others' windows are compared. Both joins ask for the texts by
    id, so Spark shuffles them once and reads that exchange twice; only the left text travels with the
    pairs. Windows of a text that comes again among the last ``KEPT`` are not made again.
    """
    at = F.col("at") if earlier else F.lit(0).cast("long").alias("at")
    t = texts.select("id", "letters", at)
    left, right = t.toDF("a", "ta", "at_a"), t.toDF("b", "tb", "at_b")
    joined = pairs.join(left, "a").join(right, "b")
    if earlier:
        joined = joined.where("at_b < at_a or (at_b = at_a and b < a)")
    sure = F.lit(False)
    if "bound" in pairs.columns:
        sure = F.when(F.col("bound") > 0, F.expr("levenshtein(ta, tb, bound)") >= 0).otherwise(False)
    joined = joined.withColumn("sure", sure)
    open_ = lambda c: F.when(~F.col("sure"), F.col(c)).otherwise("")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def windows(key: int, data: np.ndarray) -> np.ndarray:
            if key not in kept:
                if len(kept) >= KEPT:
                    kept.clear()
                kept[key] = np.unique(L.packed(data, L.WINDOW)) if len(data) >= L.WINDOW else np.zeros(0, np.uint64)
            return kept[key]

        for batch in batches:
            a, b, keep = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in (0, 1, 2))
            (da, oa), (db, ob) = L.buffers(batch.column(3)), L.buffers(batch.column(4))
            for i in np.flatnonzero(~keep).tolist():
                keep[i] = L.similarity(windows(int(a[i]), da[oa[i] : oa[i + 1]]), windows(int(b[i]), db[ob[i] : ob[i + 1]])) >= at_least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return joined.select("a", "b", "sure", open_("ta").alias("ta"), open_("tb").alias("tb")).mapInArrow(check, "a long, b long")
