"""Corpus documents that hold passages of test items, word for word or with other numbers, names and units."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from . import bloom
from . import letters as L
from .tokens import words, words_as_written

SPAN = 13
MIN_LITERAL = 6  # literal words that a template window needs; others are compared word for word
RARE = 0.01  # a word in at most this share of all documents and items is a name
FEW_TEXTS = 2  # and so is a word in at most so many
LOWER = 0.1  # a word that is written small in less than this share of its texts is a name
AFTER_NUMBER = 0.5  # a word that follows a number in this share of its texts is a unit
FILLERS = 3  # so many words in one place of otherwise equal item templates make the place a slot
REWORKED = 0.5  # share of an item's windows that makes a consistent match a re-parameterised copy
BROADCAST_WINDOWS = 100_000  # item windows (some 250 bytes each) up to which they are sent to the executors
CHUNK = 200_000  # words that are looked at together
KINDS = ("number", "code", "unit", "name")
_P = np.uint64(0x100000001B3)
_AFTER = regex.compile(r"\d[^\w]+([^\W\d_]+)(?![\w])")


@dataclass(frozen=True)
class Typing:
    """What the words of the texts are, found from their counts: ``literal`` words and ``units``; all others are placeholders."""

    literal: frozenset[str]
    units: frozenset[str]

    def kind(self, word: str) -> int | None:
        """Placeholder type of a lower-cased word (index into KINDS), None for a literal. Depends on the word alone."""
        if word.isdecimal():
            return 0
        if not word.isalpha() and any(c.isdecimal() for c in word) and any(c.isalpha() for c in word):
            return 1
        if word in self.units:
            return 2
        return None if word in self.literal else 3


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n, small, after) of the words without digits of all texts (one column).

    n counts the texts that hold the word, small those in which it stands lower-cased somewhere, after those
    in which it directly follows a number. The row of the empty word counts the texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, small, after = Counter(), Counter(), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), *[pa.array([c[w] for w in n], pa.int64()) for c in (n, small, after)]], names=["word", "n", "small", "after"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen = set(words_as_written(text))
                low = {w for w in seen if w.islower() and w.isalpha()}
                n[""] += 1  # no word is empty
                n.update({w.lower() for w in seen if w.isalpha()})
                small.update(low)
                after.update({w.lower() for w in _AFTER.findall(text)})
                if len(n) > 200_000:
                    yield out()
                    n, small, after = Counter(), Counter(), Counter()
        if n:
            yield out()

    found = texts.mapInArrow(count, "word string, n long, small long, after long")
    return found.groupBy("word").agg(F.sum("n").alias("n"), F.sum("small").alias("small"), F.sum("after").alias("after"))


def learn_typing(texts: DataFrame, items: DataFrame, rare: float = RARE) -> Typing:
    """The ``Typing`` of the words of texts and items (one column each), from counts over all of them.

    Names are words in at most the share ``rare`` of the texts (or in ``FEW_TEXTS``), words that are hardly
    ever written small, and words that stand where otherwise equal templates of items hold different words.
    Units are words that mostly follow a number. Only the others are collected: at most the distinct words
    of a text / ``rare`` of them.
    """
    counted = staged(word_counts(texts.unionByName(items)), "words")
    total = counted.where("word = ''").first()
    least = max(FEW_TEXTS, rare * total["n"]) if total else 0
    common = counted.where((F.col("n") > least) & (F.col("word") != "")).collect()
    units = frozenset(r["word"] for r in common if r["after"] >= AFTER_NUMBER * r["n"])
    literal = frozenset(r["word"] for r in common if r["small"] >= LOWER * r["n"]) - units
    first, side = Typing(literal, units), SPAN // 2

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, word = [], []
            for text in batch.column(0).to_pylist():
                ws = words(text)
                t = [w if (k := first.kind(w)) is None else f"<{k}>" for w in ws]
                for i in range(side, len(ws) - side):
                    if t[i] == ws[i]:
                        key.append(_hash(" ".join([*t[i - side : i], "_", *t[i + 1 : i + 1 + side]])))
                        word.append(ws[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(word, pa.string())], names=["key", "word"])

    at = staged(items.mapInArrow(contexts, "key long, word string"), "contexts")
    slots = at.groupBy("key").agg(F.count_distinct("word").alias("fillers")).where(F.col("fillers") >= FILLERS)
    filler = at.join(slots, "key", "left").groupBy("word").agg((F.count("fillers") / F.count("*")).alias("share")).where("share >= 0.5")
    return Typing(literal - {r["word"] for r in filler.collect()}, units)


class Vocabulary(dict):
    """word -> number, with a hash of the word and of what stands for it in a template, for each number; emptied when large."""

    def __init__(self, typing: Typing, most: int = 1_000_000):
        super().__init__()
        self.typing, self.most = typing, most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.exact, self.template, self.literal = (np.zeros(1 << 12, t) for t in (np.uint64, np.uint64, bool))

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == len(self.exact):
            self.exact, self.template, self.literal = (np.concatenate([x, np.zeros_like(x)]) for x in (self.exact, self.template, self.literal))
        kind = self.typing.kind(word)
        self.exact[n] = _hash(word)
        self.template[n] = self.exact[n] if kind is None else _hash(f"<{KINDS[kind]}>")
        self.literal[n] = kind is None
        self[word] = n
        return n

    def numbers(self, ws: list[str]) -> np.ndarray:
        if len(self) > self.most:
            self.reset()
        return np.fromiter(map(self.__getitem__, ws), np.int64, len(ws))


def rolled(h: np.ndarray, span: int) -> np.ndarray:
    """Hash of each run of ``span`` word hashes."""
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    mixed = h ^ (h >> np.uint64(29))
    with np.errstate(over="ignore"):
        for j in range(span):
            out *= _P
            out += mixed[j : j + n]
    return out


def _windows(src: DataFrame, typing: Typing, span: int, min_literal: int, mask: bytearray | None, names: tuple[str, str]) -> DataFrame:
    """(key, row, id, at, n, w, slots) of the template windows of a frame (row, id, text).

    key hashes the template, or, of windows with fewer than ``min_literal`` literal words, the words
    themselves, since a run of placeholders says nothing. w has the words, slots a hash of type and word for
    each placeholder, n is the text's number of windows. With ``mask``, only windows whose key the filter may hold.
    """
    id_type = src.schema["id"].dataType.simpleString()
    row, at_name = names
    spark = src.sparkSession
    shared = spark.sparkContext.broadcast((typing, bytes(mask) if mask is not None else None))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = shared.value
        vocab = Vocabulary(known)
        bits = None if bits is None else np.frombuffer(bits, np.uint8)
        for batch in batches:
            texts, first = batch.column(2).to_pylist(), 0
            while first < len(texts):
                ws, ends, last = [], [], first
                while last < len(texts) and len(ws) < CHUNK:
                    ws += words(texts[last])
                    ends.append(len(ws))
                    last += 1
                out = part(vocab, bits, ws, np.array(ends))
                if out is not None:
                    text, *cols = out
                    take = pa.array(text + first)
                    yield pa.RecordBatch.from_arrays([cols[0], batch.column(0).take(take), batch.column(1).take(take), *cols[1:]], names=["key", row, "id", at_name, "n", "w", "slots"])
                first = last

    def part(vocab: Vocabulary, bits: np.ndarray | None, ws: list[str], ends: np.ndarray) -> tuple | None:
        no = vocab.numbers(ws)
        if len(no) < span:
            return None
        text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        whole = text[: len(no) - span + 1] == text[span - 1 :]
        many = np.concatenate([[0], np.cumsum(vocab.literal[no])])
        rich = many[span:] - many[:-span] >= min_literal
        key = np.where(rich, rolled(vocab.template[no], span), ~rolled(vocab.exact[no], span))
        places = np.flatnonzero(whole)
        if bits is not None:
            places = places[bloom.all_set(bits, bloom.places(key[places], len(bits) * 8))]
        if not len(places):
            return None
        of = text[places]
        begin = np.concatenate([[0], ends[:-1]])[of]
        words_of = no[places[:, None] + np.arange(span)]
        slot = ~vocab.literal[words_of]
        hashes = (vocab.exact[words_of] ^ (vocab.template[words_of] * _P))[slot].view(np.int64)
        offsets = np.concatenate([[0], np.cumsum(slot.sum(1))]).astype(np.int32)
        w = pa.array([" ".join(ws[i : i + span]) for i in places.tolist()], pa.string())
        n = ends[of] - begin - span + 1
        return of, pa.array(key[places].view(np.int64)), pa.array(places - begin), pa.array(n), w, pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes))

    return src.select("row", "id", "text").mapInArrow(scan, f"key long, {row} long, id {id_type}, {at_name} long, n long, w string, slots array<long>")


def _distinct(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """Number of distinct values (places, or hashes, mixed with the group's number) of each group."""
    if value.dtype == np.uint64:
        code = L.mix(value + (group.astype(np.uint64) + np.uint64(1)) * L._A)
        order = np.argsort(code)
        code = code[order]
        new = np.concatenate([[True], code[1:] != code[:-1]]) if len(code) else np.zeros(0, bool)
        return np.bincount(group[order[new]], minlength=groups)
    code = np.unique((group << 32) | value)
    return np.bincount(code >> 32, minlength=groups)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each document and item, of window pairs in which the rows of a document stand together."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def done(table: pa.Table) -> pa.RecordBatch:
        t = table.combine_chunks()
        row, item, n, at, item_at, same = (t.column(c).to_numpy() for c in ("row", "item_row", "item_n", "at", "item_at", "same"))
        order = np.lexsort((item, row))
        first = np.flatnonzero(np.concatenate([[True], (np.diff(row[order]) != 0) | (np.diff(item[order]) != 0)]))
        group = np.empty(len(row), np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(row)))
        k, of = len(first), order[first]
        exact, places, met = _distinct(group[same], at[same], k), _distinct(group, at, k), _distinct(group, item_at, k)
        x, y = (t.column(c).combine_chunks() for c in ("slots", "item_slots"))
        each = np.repeat(group, x.value_lengths().to_numpy())
        x, y = (c.flatten().to_numpy().view(np.uint64) for c in (x, y))
        with np.errstate(over="ignore"):
            xy = (x ^ (x >> np.uint64(32))) * _P + y
        pairs = _distinct(each, xy, k)
        consistent = (_distinct(each, x, k) == pairs) & (_distinct(each, y, k) == pairs)
        ids, names = t.column("id").combine_chunks().take(pa.array(of)), t.column("item").combine_chunks().take(pa.array(of))
        return pa.RecordBatch.from_arrays([ids, names, pa.array(exact), pa.array(places - exact), pa.array(consistent), pa.array(met / n[of])], names=["id", "item", "exact_windows", "template_windows", "consistent", "item_share"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK // 4:
            table = pa.Table.from_batches(held)
            row = table.column("row").to_numpy()
            cut = int(np.searchsorted(row, row[-1]))  # the last document may go on
            if cut:
                yield done(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
            rows = table.num_rows - cut
    if held:
        yield done(pa.Table.from_batches(held))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "item_text", span: int = SPAN, min_literal: int = MIN_LITERAL, slots: str = "consistent", rare: float = RARE, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(id, item, exact_windows, template_windows, consistent, item_share, kind) for each document and item with a window in common.

    Words become typed placeholders where they are numbers, codes (letters with digits), units or names
    (see ``learn_typing``); windows of ``span`` placeholders and words meet by a hash join. Windows with
    fewer than ``min_literal`` literal words stand for themselves, so runs of placeholders don't meet.

    exact_windows counts the document's windows that the item has word for word, template_windows further
    ones that match with other slot values; ``consistent`` says whether over all of them each slot value of
    the item stands for one of the document and the reverse; item_share is the share of the item's windows
    met. kind is ``exact`` with an exact window, ``reworked`` for a consistent match of ``REWORKED`` of the
    item or more (a re-parameterised question), else ``frame``. With slots="same" the slot check asks for
    equal values and the words are compared, so that only exact windows are left.

    A filter of the item windows' keys (bounded) goes to the documents, which are read whole where they
    are; only windows that may meet an item move. Items stay a table; it is broadcast up to
    ``broadcast_windows`` windows, and joined by shuffle beyond.

    Null texts and texts with fewer than ``span`` words match nothing; equal rows come out once per row;
    empty tables give no rows; other columns are left out.
    """
    row = F.monotonically_increasing_id().alias("row")
    it = items.select(row, F.col(item_col).alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null")
    src = docs.select(row, F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    typing = learn_typing(src.select("text"), it.select("text"), rare)
    there = staged(_windows(it, typing, span, min_literal, None, ("item_row", "item_at")), "items").withColumnsRenamed({"id": "item", "w": "item_w", "slots": "item_slots", "n": "item_n"})
    n = there.count()
    mask = bloom.filter_of(there.select("key"), n, 16)
    here = staged(_windows(src, typing, span, min_literal, mask, ("row", "at")).drop("n"), "hits")
    same = F.col("w") == F.col("item_w")
    cols = ["row", "id", "item_row", "item", "item_n", "at", "item_at", same.alias("same"), "slots", "item_slots"]
    if n <= broadcast_windows:
        met = here.repartition("row").sortWithinPartitions("row").join(F.broadcast(there), "key")
        met = (met.where(same) if slots == "same" else met).select(*cols)
    else:
        met = here.join(there, "key")
        met = (met.where(same) if slots == "same" else met).select(*cols).repartition("row").sortWithinPartitions("row")
    kinds = (docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString())
    per = met.mapInArrow(_pairs, "id {}, item {}, exact_windows long, template_windows long, consistent boolean, item_share double".format(*kinds))
    kind = F.when(F.col("exact_windows") > 0, "exact").when(F.col("consistent") & (F.col("item_share") >= REWORKED), "reworked").otherwise("frame")
    return per.withColumn("kind", kind)
