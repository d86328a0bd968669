"""Batch scorers: the one place where an opaque model function meets the data."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.bio import usable_text

BATCH_SIZE = 32
# Status codes that no retry or skip can mend.
FATAL_CODES = frozenset({401, 402, 403})


class FatalScorerError(RuntimeError):
    """The scorer refuses all further work (authentication, payment, permission)."""


class ScorerError(RuntimeError):
    """One batch failed."""

    def __init__(self, message: str, status_code: int | None = None):
        super().__init__(message)
        self.status_code = status_code


class Scorer(Protocol):
    """list of items in, list of as many results out. Must be picklable, as executors run it."""

    name: str

    def score_batch(self, items: list[dict[str, Any]], action: str, params: dict[str, Any]) -> list[Any]: ...


class LocalScorer:
    """A deterministic stand-in for a model: numbers derived from the item's digest, or from a function of the text."""

    def __init__(self, name: str = "local", function: Callable[[dict[str, Any]], Any] | None = None, key: str = "score"):
        self.name, self.function, self.key = name, function, key

    def score_batch(self, items: list[dict[str, Any]], action: str, params: dict[str, Any]) -> list[Any]:
        if self.function:
            return [self.function(x) for x in items]
        out = []
        for x in items:
            h = hashlib.sha256(json.dumps(x, sort_keys=True).encode()).digest()
            if action == "encode":
                out.append({"embedding": [b / 255 for b in h[:8]]})
            else:
                out.append({self.key: int.from_bytes(h[:4], "big") / 2**32})
        return out


class RateLimit:
    """At most ``calls`` in any ``period`` seconds, in one task; a job of n tasks gives each its n-th part."""

    def __init__(self, calls: int, period: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.calls, self.period, self.clock, self.sleep = calls, period, clock, sleep
        self.at: list[float] = []

    def wait(self) -> None:
        now = self.clock()
        self.at = [t for t in self.at if now - t < self.period]
        if len(self.at) >= self.calls:
            self.sleep(self.period - (now - self.at[0]))
        self.at.append(self.clock())


def run_batch(scorer: Scorer, items: list[dict[str, Any]], action: str, params: dict[str, Any], skip_on_error: bool, attempts: int = 3, wait: float = 0.0) -> tuple[list[Any], list[str | None]]:
    """(results, errors) of one batch, each as long as ``items``.

    A batch is tried ``attempts`` times with doubling waits. Results of another length fail the batch, and a
    result {error: ...} fails its item. A failed item has result None; without ``skip_on_error`` a failed
    batch raises. Fatal codes always raise.
    """
    for k in range(attempts):
        try:
            got = scorer.score_batch(items, action, params)
            if len(got) != len(items):
                raise ScorerError(f"{len(got)} results for {len(items)} items")
            break
        except FatalScorerError:
            raise
        except Exception as e:
            if getattr(e, "status_code", None) in FATAL_CODES:
                raise FatalScorerError(str(e)) from e
            if k == attempts - 1:
                if not skip_on_error:
                    raise
                return [None] * len(items), [str(e)] * len(items)
            if wait:
                time.sleep(wait * 2**k)
    out, errors = [], []
    for r in got:
        bad = isinstance(r, dict) and "error" in r
        if bad and r.get("status_code") in FATAL_CODES:
            raise FatalScorerError(str(r["error"]))
        if bad and not skip_on_error:
            raise ScorerError(str(r["error"]), r.get("status_code"))
        out.append(None if bad else r)
        errors.append(str(r["error"]) if bad else None)
    return out, errors


def score(df: DataFrame, scorer: Scorer, action: str = "predict", item_columns: Sequence[str] = ("sequence",), id_column: str = "sequence_id", params: dict[str, Any] | None = None, batch_size: int = BATCH_SIZE, skip_on_error: bool = False, rate: tuple[int, float] | None = None) -> DataFrame:
    """(id, response, error): a scorer's response as JSON for each row, null with an error where it failed.

    Rows go through ``mapInPandas`` partition by partition in batches of ``batch_size``; the number of
    partitions bounds how many run at once. Rows whose first item column is null, blank, 'nan' or 'none'
    don't go to the scorer and get an error. Stage the result before use: a plan that is run twice calls
    the scorer twice.
    """
    params = dict(params or {})
    kind = df.schema[id_column].dataType.simpleString()
    src = df.select(id_column, *item_columns, usable_text(item_columns[0]).alias("_ok"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limit = RateLimit(*rate) if rate else None
        for pdf in frames:
            for at in range(0, len(pdf), batch_size):
                part = pdf.iloc[at : at + batch_size]
                ok = part["_ok"].to_numpy()
                items = part.loc[ok, list(item_columns)].to_dict("records")
                results: list[Any] = []
                errors: list[str | None] = []
                if items:
                    if limit:
                        limit.wait()
                    results, errors = run_batch(scorer, items, action, params, skip_on_error)
                r, e = iter(results), iter(errors)
                response = [next(r) if x else None for x in ok]
                error = [next(e) if x else "unusable input" for x in ok]
                yield pd.DataFrame({id_column: part[id_column].to_numpy(), "response": [None if x is None else json.dumps(x) for x in response], "error": error})

    return src.mapInPandas(run, f"{id_column} {kind}, response string, error string")


def scored_udf(df: DataFrame, function: Callable[[pd.Series], pd.Series], column: str, name: str) -> DataFrame:
    """Adds a column from a function over whole batches of values (a fitness function, say)."""
    from pyspark.sql.types import DoubleType

    return df.withColumn(name, F.pandas_udf(function, DoubleType())(F.col(column)))
