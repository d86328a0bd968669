"""Texts above a size limit, cut into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import TOKEN

LIMIT, OVERLAP = 1024, 64
# Natural boundaries from best to least: blank line; end of a sentence; end of a line; clause mark; white space.
BOUNDARIES = tuple(re.compile(p) for p in (r"\n\s*\n\s*", r"[.!?…]+[\"'”’)\]]*\s+|[。！？]+\s*", r"\n\s*", r"[,;:]\s+", r"\s+"))
FILL = 0.5  # a better boundary is taken if the piece gets at least this share of the limit


def cut_places(starts: np.ndarray, text: str) -> list[list[int]]:
    """For each kind of boundary the sorted numbers of the tokens that begin right after one."""
    out = []
    for pattern in BOUNDARIES:
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        at = np.searchsorted(starts, ends)
        out.append(np.unique(at[(at > 0) & (at < len(starts))]).tolist())
    return out


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP, fill: float = FILL) -> list[tuple[int, int, int, int]]:
    """Pieces (first token, tokens, first character, end character) of a text; none if it is within the limit.

    Token offsets are the prefix sums of the sizes, one per token. From a piece's first token the last
    boundary under the limit is found by binary search in the sorted boundaries, best kind first; a kind
    that would leave the piece under ``fill`` of the limit yields to the next. Where all kinds do, the last
    boundary of any kind counts, and only without any is the cut a hard one at the limit. The next piece steps back by ``overlap`` tokens. A piece ends with
    the white space after its last token, so pieces less their overlaps give back the text.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under limit")
    if len(text) <= limit:  # a token has a character at least
        return []
    starts = np.fromiter((m.start() for m in TOKEN.finditer(text)), np.int64)
    n = len(starts)
    if n <= limit:
        return []
    kinds = cut_places(starts, text)
    out, s = [], 0
    while True:
        if n - s <= limit:
            out.append((s, n - s, int(starts[s]) if s else 0, len(text)))
            return out
        least = s + max(overlap + 1, int(limit * fill))
        last = [places[k - 1] for places in kinds if (k := bisect_right(places, s + limit))]
        end = next((p for p in last if p >= least), max([p for p in last if p > s + overlap], default=s + limit))
        out.append((s, end - s, int(starts[s]) if s else 0, int(starts[end])))
        s = end - overlap


def split_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """(id, piece, first_token, n_tokens, start, end[, text]) for every piece of every text above ``limit`` tokens.

    Pieces have at most ``limit`` tokens, begin with the last ``overlap`` tokens of the one before, and end
    at natural boundaries where there are any. Each text is cut on its own, whole, with no shuffle; texts
    with no more than ``limit`` characters can't be above it and never leave the scan.

    Null, blank and short texts give no pieces; rows that occur twice give their pieces twice; a null id
    stays null; an empty table gives no rows; other columns are left out.
    """
    kind = df.schema[id_col].dataType
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > limit)
    schema = f"id {kind.simpleString()}, piece long, first_token long, n_tokens long, start long, end long" + ", text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, which, texts = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for k, p in enumerate(cut(text, limit, overlap)):
                    which.append(i)
                    rows.append((k, *p))
                    if with_text:
                        texts.append(text[p[2] : p[3]])
            if rows:
                cols = [batch.column(0).take(pa.array(which)), *[pa.array(c, pa.int64()) for c in zip(*rows)]]
                names = ["id", "piece", "first_token", "n_tokens", "start", "end"]
                if with_text:
                    cols.append(pa.array(texts, pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(run, schema)
