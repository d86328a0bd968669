"""Checks of newly arrived records against all records accepted before, over a segment index that only grows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, scratch_path, staged
from . import bloom
from . import letters as L
from .pairs import FEW, LEADERS, few_pairs, prefix_pairs, verified

SEGMENTS = 12
LONG_WINDOW = 16
SHORT = 32  # letters under which nucleotide texts are keyed by 8 letters, too
_NUCLEOTIDE = np.zeros(256, bool)
_NUCLEOTIDE[[ord(c) for c in "ACGTUN"]] = True
_SEGMENT = "key long, id long, place long"
_PART = 21  # bits of each of the three numbers in a place; larger ones count as the largest, which loses no pair


def substring_hashes(data: np.ndarray, off: np.ndarray, short: int = SHORT) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each place of each text at which 8 letters begin, and where each text's hashes start.

    Where the 8 letters are all nucleotide codes, of which there are too few to tell texts apart, the
    hash takes the 16 letters from there, unless the text ends before or has fewer than ``short`` letters.
    """
    at, starts = L.window_starts(off)
    h = L.mix(L.packed(data, L.WINDOW)[at] + np.uint64(1))
    few = np.concatenate([[0], np.cumsum(~_NUCLEOTIDE[data])])
    counts = np.diff(starts)
    text_end, size = np.repeat(off[1:], counts), np.repeat(np.diff(off), counts)
    plain = (few[at + L.WINDOW] == few[at]) & (at + LONG_WINDOW <= text_end) & (size >= short)
    if plain.any():
        h[plain] = L.mix(h[plain] + L.mix(L.packed(data, L.WINDOW)[at[plain] + LONG_WINDOW - L.WINDOW] + L._A))
    return h, starts


def stored_segments(data: np.ndarray, off: np.ndarray, segments: int = SEGMENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, key, position): of each of ``segments`` equal stretches of a text its substring of least hash."""
    h, starts = substring_hashes(data, off)
    counts = np.diff(starts)
    n = np.minimum(counts, segments)
    text = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    begin = starts[:-1][text] + k * counts[text] // n[text]
    if not len(begin):
        return text, h[:0], text
    key = np.minimum.reduceat(h, begin)
    where = np.flatnonzero(h == np.repeat(key, np.diff(begin, append=len(h))))
    where = where[np.searchsorted(where, begin)]  # the first in each stretch
    return text, key, where - starts[:-1][text]


def _least_of_neighbours(h: np.ndarray, starts: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = np.diff(starts)
    reach = np.maximum(counts // (2 * segments), 1)
    texts, keys, places = [], [], []
    for w in np.unique(reach):  # texts with the same reach together
        own = np.flatnonzero((reach == w) & (counts > 0))
        size = counts[own]
        at = np.arange(int(size.sum())) + np.repeat(starts[:-1][own] - (np.cumsum(size) - size), size)
        low, text, pos = h[at], np.repeat(own, size), at - np.repeat(starts[:-1][own], size)
        span = 1
        while span < w:  # minimum of the w values from each place on, by doubling
            step = min(span, w - span)
            less = low[step:] < low[:-step]
            low[:-step] = np.where(less, low[step:], low[:-step])
            pos[:-step] = np.where(less, pos[step:], pos[:-step])
            span += step
        ok = np.zeros(len(low), bool)
        if len(low) >= w:
            ok[: len(low) - w + 1] = text[: len(low) - w + 1] == text[w - 1 :]
        ok[1:] &= ~ok[:-1] | (text[1:] != text[:-1]) | (low[1:] != low[:-1])
        texts.append(text[ok])
        keys.append(low[ok])
        places.append(pos[ok])
    if not texts:
        return np.zeros(0, np.int64), h[:0], np.zeros(0, np.int64)
    return np.concatenate(texts), np.concatenate(keys), np.concatenate(places)


def probe_substrings(data: np.ndarray, off: np.ndarray, segments: int = SEGMENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, key, position): the substrings of each text that a stored segment of a text up to twice as short could equal.

    These are the least of some ``windows / (2 * segments)`` neighbours. The least substring of a stored
    stretch that stands whole in the probing text is always among them, wherever it has moved to. Texts
    that may meet ones under ``SHORT`` letters are probed with 8-letter keys as well.
    """
    text, key, pos = _least_of_neighbours(*substring_hashes(data, off), segments)
    own = np.flatnonzero((np.diff(off) >= SHORT) & (np.diff(off) < 2 * SHORT + L.WINDOW))
    size = np.diff(off)[own]
    if len(own):
        at = np.arange(int(size.sum())) + np.repeat(off[:-1][own] - (np.cumsum(size) - size), size)
        t, k, p = _least_of_neighbours(*substring_hashes(data[at], np.concatenate([[0], np.cumsum(size)]), 1 << 30), segments)
        text, key, pos = np.concatenate([text, own[t]]), np.concatenate([key, k]), np.concatenate([pos, p])
    return text, key, pos


def _distinct_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    code = L.packed(data, L.WINDOW)
    out = np.zeros(len(off) - 1, np.int64)
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        if b - a >= L.WINDOW:
            w = np.sort(code[a : b - L.WINDOW + 1])
            out[i] = 1 + np.count_nonzero(w[1:] != w[:-1])
    return out


def _keys(texts: DataFrame, cut, segments: int) -> DataFrame:
    """(key, id, place) of the texts' substrings; place holds a text's number of distinct windows, its length and the substring's position."""
    most = (1 << _PART) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                data, off = L.buffers(batch.column(1))
                text, key, pos = cut(data, off, segments)
                n, size, pos = (np.minimum(x, most) for x in (_distinct_counts(data, off)[text], np.diff(off)[text], pos))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(batch.column(0).to_numpy()[text]), pa.array((n << 2 * _PART) | (size << _PART) | pos)], names=["key", "id", "place"])

    return texts.select("id", "letters").mapInArrow(run, _SEGMENT)


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    most = np.int64((1 << _PART) - 1)
    return place >> 2 * _PART, (place >> _PART) & most, place & most


def edit_bound(n_a, n_b, at_least: float, segments: int = SEGMENTS):
    """Edits (of single letters) that leave two texts of so many distinct windows at the similarity for certain.

    An edit takes at most 8 windows from a text and adds at most 8, so after d edits the similarity is at
    least ``(n - 8 d) / (n + 8 d)``. With fewer edits than segments one stored segment stays whole.
    """
    return np.minimum(segments - 1, np.maximum(n_a, n_b) * (1 - at_least) // (8 * (1 + at_least))).astype(np.int64)


_CAND = "kind int, key long, a long, b long, bound int"


def candidates(stored: DataFrame, probes: DataFrame, leaders: int = LEADERS, at_least: float = 0.5, segments: int = SEGMENTS) -> DataFrame:
    """Kind 0: (probe a, stored b) with a key in common, b among the first ``leaders`` of the key.

    Pairs whose numbers of distinct windows already rule the similarity out are left out. bound is the
    ``edit_bound`` of a pair whose lengths and whose substrings' positions differ by no more than it, else 0.
    A key with more stored texts pairs each probe with the first ``FEW`` only, and also gives kind 1 rows (key,
    probe a) and kind 2 rows (key, every other stored b). Sorting is Spark's; the scan holds one batch and
    ``leaders`` ids.
    """
    cols = [F.col(c) for c in ("key", "id", "place")]
    both = stored.select(*cols, F.lit(0).alias("probe")).unionByName(probes.select(*cols, F.lit(1).alias("probe")))

    def out(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray, bound: np.ndarray | None = None) -> pa.RecordBatch:
        bound = np.zeros(len(a), np.int32) if bound is None else bound.astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(key), pa.array(a), pa.array(b), pa.array(bound)], names=["kind", "key", "a", "b", "bound"])

    def pairs(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        """Of columns (id, place) of both sides."""
        (na, la, pa_), (nb, lb, pb) = _unpacked(a[1]), _unpacked(b[1])
        ok = np.minimum(na, nb) >= at_least * np.maximum(na, nb)
        bound = edit_bound(na, nb, at_least, segments)
        near = (np.abs(la - lb) <= bound) & (np.abs(pa_ - pb) <= bound)
        return out(0, key[ok], a[0, ok], b[0, ok], np.where(near, bound, 0)[ok])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ck, lead, more = None, np.zeros((2, 0), np.int64), False  # the key at the last batch's end, its leaders, has it others
        for batch in batches:
            key, *cols, probe = (batch.column(i).to_numpy() for i in range(4))
            if not len(key):
                continue
            cols = np.stack(cols)
            ids = cols[0]
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            end = np.concatenate([begin[1:], [len(key)]])
            first_probe = begin + np.add.reduceat(1 - probe.astype(np.int64), begin)  # stored rows come first
            n_stored, n_probe = first_probe - begin, end - first_probe
            old = lead.shape[1] if ck is not None and key[0] == ck else 0
            # All keys but the first (which may go on from the last batch) with few stored ids, at once.
            small = np.flatnonzero((n_stored > 0) & (n_probe > 0) & (n_stored <= leaders))
            if old:
                small = small[small > 0]
            if len(small):
                reps = n_probe[small] * n_stored[small]
                base = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
                ns = np.repeat(n_stored[small], reps)
                left, right = np.repeat(first_probe[small], reps) + base // ns, np.repeat(begin[small], reps) + base % ns
                yield pairs(np.repeat(key[begin[small]], reps), cols[:, left], cols[:, right])
            one = [int(i) for i in np.flatnonzero(n_stored > leaders)]
            for i in sorted({*one, *([0] if old else [])}):
                s, p, e, k = begin[i], first_probe[i], end[i], key[begin[i]]
                carried, had = (lead, more) if i == 0 and old else (np.zeros((2, 0), np.int64), False)
                room = leaders - carried.shape[1]
                mine = np.concatenate([carried, cols[:, s : min(p, s + room)]], axis=1)
                late = ids[min(p, s + room) : p]
                has = had or len(late) > 0
                if len(late):  # once a key is long, its leaders after the first few are left open as well
                    rest = late if had else np.concatenate([mine[0, FEW:], late])
                    yield out(2, np.full(len(rest), k), rest, rest)
                if e > p and mine.shape[1]:
                    met = mine[:, :FEW] if has else mine
                    for at in range(p, e, 4096):
                        q = cols[:, at : min(at + 4096, e)]
                        m = q.shape[1] * met.shape[1]
                        yield pairs(np.full(m, k), np.repeat(q, met.shape[1], axis=1), np.tile(met, q.shape[1]))
                    if has:
                        yield out(1, np.full(e - p, k), ids[p:e], ids[p:e])
                if i == len(begin) - 1:
                    lead_next, more_next = mine, has
            i = len(begin) - 1
            if n_stored[i] > leaders or (i == 0 and old):
                lead, more = lead_next, more_next
            else:
                lead, more = cols[:, begin[i] : first_probe[i]], False
            ck = key[-1]

    return both.repartition("key").sortWithinPartitions("key", "probe", "id").mapInArrow(scan, _CAND)


def micros(time: Column) -> Column:
    """Microseconds of a time without zone since 1970, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), time.cast("timestamp_ntz"))


def first_texts(df: DataFrame, id_col: str, text_col: str, time_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): the usable rows as (id, at, h), and each distinct text (id, at, h, letters) at its first arrival; h is a digest of the letters."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), micros(F.col(time_col)).alias("at"), L.letters(F.col(text_col)).alias("letters")).where(F.col("id").isNotNull() & F.col("at").isNotNull() & (F.length("letters") >= L.WINDOW))
    h = F.unhex(F.sha2("letters", 256)).alias("h")
    texts = rows.groupBy("letters").agg(F.min(F.struct("at", "id")).alias("f")).select("f.id", "f.at", h, "letters")
    return rows.select("id", "at", h), texts


def earlier_similar(texts: DataFrame, stored: DataFrame, probes: DataFrame, at_least: float, leaders: int = LEADERS, segments: int = SEGMENTS) -> DataFrame:
    """(id) of the probing texts to which some text that arrived earlier has a similarity of ``at_least``.

    ``texts`` (id, at, letters) has all texts; ``stored`` and ``probes`` their keys. Of the texts only those
    that some probe met are taken up. Probes that a long key's leaders don't settle are compared with its
    other stored texts, or, where those are many pairs, through their rare windows.
    """
    cand = staged(candidates(stored, probes, leaders, at_least, segments), "cand")
    met = cand.select(F.explode(F.array("a", "b")).alias("id"))
    texts = staged(bloom.passing(texts, "id", bloom.filter_of(met, 2 * cand.count())), "met")

    def checked(pairs: DataFrame) -> DataFrame:
        return verified(pairs, texts, at_least, earlier=True).select(F.col("a").alias("id")).distinct()

    found = checked(cand.where("kind = 0 and a <> b").groupBy("a", "b").agg(F.max("bound").alias("bound")))
    probing, further = cand.where("kind = 1").select("key", "a"), cand.where("kind = 2").select("key", "b")
    if further.isEmpty():
        return found
    found = staged(found, "found")
    far = staged(further.distinct(), "far")
    left_open = probing.join(found.withColumnRenamed("id", "a"), "a", "left_anti").distinct()
    left_open = staged(left_open.join(far.groupBy("key").agg(F.count("*").alias("n")), "key"), "open")
    if few_pairs(left_open.agg(F.sum("n")), far):
        return found.unionByName(checked(left_open.join(far, "key").select("a", "b").where("a <> b").distinct())).distinct()
    open_ = left_open.select("a").distinct()
    left = texts.join(open_.withColumnRenamed("a", "id"), "id", "left_semi")
    right = texts.join(far.select(F.col("b").alias("id")), "id", "left_semi")
    return found.unionByName(checked(prefix_pairs(left, right, at_least))).distinct()


class SegmentIndex:
    """A segment index over accepted records in a folder: new batches are probed against it and then appended.

    Tables under ``path``: ``texts`` (id, at, h, letters), one row per distinct text, and ``segments`` (key,
    id, n, place): a fixed number of stretches of each text, each by its least substring, with the text's
    length and the substring's position.

    A batch is probed with its own selected substrings. What it meets is verified by a bounded edit
    distance where lengths and positions allow one, and else by the window similarity, as moved stretches
    and long gains have no such bound. The history's digests, segments and texts are cut down where they
    are to what the batch names, its segments and texts by filters of the probes and of the ids met (at most
    64 MB; a batch beyond that lets more through and loses nothing), so only as much moves as the batch
    needs. Appending writes new files only.
    """

    def __init__(self, spark: SparkSession, path: str, segments: int = SEGMENTS, at_least: float = 0.5, leaders: int = LEADERS):
        self.spark, self.path, self.segments, self.at_least, self.leaders = spark, path.rstrip("/"), segments, at_least, leaders

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:  # no batch has been appended yet
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def texts(self) -> DataFrame:
        return self._read("texts", "id long, at long, h binary, letters string")

    def segment_rows(self) -> DataFrame:
        return self._read("segments", _SEGMENT)

    def _own(self, batch: DataFrame, id_col: str, text_col: str, time_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(rows, texts that the index has, texts that it lacks) of a batch."""
        rows, own = first_texts(batch, id_col, text_col, time_col)
        own, old = staged(own, "batch"), self.texts()
        if old.isEmpty():
            return rows, own.limit(0), own
        known = staged(old.select("h").join(own.select("h"), "h", "left_semi").distinct(), "known")
        return rows, own.join(known, "h", "left_semi"), own.join(known, "h", "left_anti")

    def check(self, batch: DataFrame, id_col: str = "sequence_id", text_col: str = "sequence", time_col: str = "created_at", append: bool = False) -> DataFrame:
        """(id) of the batch's rows that repeat, or nearly repeat, an accepted text or an earlier row of the batch.

        Earlier means a smaller time, then a smaller id; accepted texts count as earlier whatever their
        time. The result is written before the index may grow; with ``append`` the batch then joins it.

        Rows with null id, time or text, or fewer than 8 letters, are no case and no partner; equal times are
        ordered by id; repeated rows count once; an empty batch gives no rows.
        """
        with scratch(self.spark) as keep:
            rows, known, new = self._own(batch, id_col, text_col, time_col)
            fresh = staged(_keys(new, stored_segments, self.segments), "segments")
            probes = staged(_keys(new, probe_substrings, self.segments), "probes")
            stored = bloom.passing(self.segment_rows(), "key", bloom.filter_of(probes.select("key"), probes.count())).unionByName(fresh)
            first = F.lit(-(2**62)).cast("long")
            texts = self.texts().select("id", first.alias("at"), "letters").unionByName(new.select("id", "at", "letters"))
            near = earlier_similar(texts, stored, probes, self.at_least, self.leaders, self.segments)
            # A row repeats its text if the index had that, or if another row of the batch brought it first.
            marks = new.select("h", F.col("id").alias("f")).unionByName(known.select("h", F.lit(None).cast("long").alias("f")))
            again = rows.join(marks, "h").where("f is null or id <> f").select("id")
            out = staged(near.unionByName(again).distinct(), "repeats")
            keep.append(out)
            if append:
                self._grow(new, fresh)
        return out

    def append(self, batch: DataFrame, id_col: str = "sequence_id", text_col: str = "sequence", time_col: str = "created_at") -> None:
        """Adds the batch's texts that the index lacks."""
        with scratch(self.spark):
            _, _, new = self._own(batch, id_col, text_col, time_col)
            self._grow(new, _keys(new, stored_segments, self.segments))

    def _grow(self, new: DataFrame, segments: DataFrame) -> None:
        # Texts last: an append that broke off and is done again then finds them missing, and segments may repeat.
        segments.write.mode("append").parquet(f"{self.path}/segments")
        new.select("id", "at", "h", "letters").write.mode("append").parquet(f"{self.path}/texts")


def repeats_since(df: DataFrame, since: str, id_col: str = "sequence_id", text_col: str = "sequence", time_col: str = "created_at", lot: str = "month", path: str | None = None, **index: float) -> DataFrame:
    """(id) of the rows created at or after ``since`` that repeat, or nearly repeat, an earlier row.

    The rows before ``since`` are appended to a ``SegmentIndex`` (at ``path``, else in the shared folder); the
    others come in lots, in order of time, each checked against the index and its own earlier rows and
    then appended. A lot is a ``day``, ``week`` or ``month``: the result is the same, as rows within a lot are
    compared in their order, and larger lots take fewer jobs. Nulls and ties as in ``SegmentIndex.check``.
    """
    spark = df.sparkSession
    ix = SegmentIndex(spark, path or scratch_path(spark, "index"), **index)
    time = F.col(time_col).cast("timestamp_ntz")
    start = F.lit(since).cast("timestamp_ntz")
    ix.append(df.where(time < start), id_col, text_col, time_col)
    new = df.where(time >= start)
    cut = F.date_trunc(lot, time.cast("date")).cast("date")
    lots = [r[0] for r in new.select(cut.alias("lot")).distinct().orderBy("lot").collect()]  # one for each day at most
    out = None
    for n, first in enumerate(lots):
        found = ix.check(new.where(cut == F.lit(first)), id_col, text_col, time_col, append=n + 1 < len(lots))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "id long")
