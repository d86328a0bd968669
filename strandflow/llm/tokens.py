"""Tokens of the public WordPunct tokenizer, and words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

TOKEN = re.compile(r"\w+|[^\w\s]+")
WORD = re.compile(r"[^\W_]+")


def count_tokens(text: str | None) -> int:
    """Number of tokens; 0 for null."""
    return len(TOKEN.findall(text)) if text else 0


def _count(texts: pd.Series) -> pd.Series:
    return texts.map(count_tokens).astype("int64")


def token_count(text: Column) -> Column:
    """Number of tokens of a text column, in Arrow batches."""
    return F.pandas_udf(_count, LongType())(text)


def words_as_written(text: str | None) -> list[str]:
    """Maximal runs of letters and digits."""
    return WORD.findall(text) if text else []


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, lower-cased."""
    if not text:
        return []
    # Lower-casing may change the length of letters beyond ASCII, so there it comes after the cut.
    return WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in WORD.findall(text)]
