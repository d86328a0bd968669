"""Filters over wide frames and over the store's long score table.

Each filter is a small frozen description. ``apply(df)`` gives the surviving rows of a wide frame,
``spec()`` a JSON-able form that ``filter_from_spec`` reads back. ``needs_all`` says that the filter
compares rows with each other, so that a stream can't go through it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bio
from .checks import check_name
from .sampling import bottom_n, percentile_keep, sample_random, sample_spread, top_n


def clean_number(c: Column) -> Column:
    """A number, with NaN as null."""
    return F.when(~F.isnan(c.cast("double")), c.cast("double"))


class Filter:
    """A step from rows to fewer rows."""

    needs_all: ClassVar[bool] = False
    kinds: ClassVar[dict[str, type[Filter]]] = {}

    def __init_subclass__(cls) -> None:
        Filter.kinds[cls.__name__] = cls

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def spec(self) -> dict[str, Any]:
        return {"type": type(self).__name__, **asdict(self)}

    @classmethod
    def from_spec(cls, spec: dict[str, Any]) -> Filter:
        return cls(**spec)


FUNCTIONS: dict[str, Callable] = {}


def named(function: Callable) -> Callable:
    """Registers a function under its name, so that filters and generators that use it can be saved and loaded."""
    FUNCTIONS[function.__name__] = function
    return function


def filter_from_spec(spec: dict[str, Any]) -> Filter:
    """The filter that a ``spec()`` describes; ValueError for unknown types."""
    rest = dict(spec)
    kind = rest.pop("type", None)
    if kind not in Filter.kinds:
        raise ValueError(f"unknown filter type {kind!r}")
    return Filter.kinds[kind].from_spec(rest)


@dataclass(frozen=True)
class Threshold(Filter):
    """Keeps min <= column <= max (either bound may be None). Null and NaN go, unless ``keep_na``."""

    column: str
    min: float | None = None
    max: float | None = None
    keep_na: bool = False

    def predicate(self, c: Column) -> Column:
        v = clean_number(c)
        ok = F.lit(True) if self.keep_na else v.isNotNull()
        within = F.lit(True)
        if self.min is not None:
            within = within & (v >= self.min)
        if self.max is not None:
            within = within & (v <= self.max)
        return (v.isNull() | within) if self.keep_na else (ok & within)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.predicate(F.col(check_name(self.column))))

    def in_store(self, ids: DataFrame, predictions: DataFrame, model: str | None = None) -> DataFrame:
        """The ids (sequence_id) whose score of this type passes; with ``keep_na`` also those without a score.

        An id passes if one of its scores does; without bounds and with ``keep_na`` every id passes.
        """
        if self.keep_na and self.min is None and self.max is None:
            return ids.select("sequence_id").distinct()
        p = predictions.where(F.col("prediction_type") == self.column)
        if model is not None:
            p = p.where(F.col("model_name") == model)
        hit = p.where(self.predicate(F.col("value"))).select("sequence_id")
        found = ids.select("sequence_id").distinct().join(hit, "sequence_id", "left_semi")
        if not self.keep_na:
            return found
        return found.unionByName(ids.select("sequence_id").distinct().join(p.select("sequence_id"), "sequence_id", "left_anti"))


@dataclass(frozen=True)
class LengthRange(Filter):
    """Keeps texts of min to max characters, bounds included. A null text goes if there is a bound."""

    min: int | None = None
    max: int | None = None
    column: str = "sequence"

    def apply(self, df: DataFrame) -> DataFrame:
        n, ok = F.length(F.col(check_name(self.column))), F.lit(True)
        if self.min is not None:
            ok = ok & (n >= self.min)
        if self.max is not None:
            ok = ok & (n <= self.max)
        return df.where(ok)


@dataclass(frozen=True)
class HammingRange(Filter):
    """Adds the Hamming distance to a reference (``hamming_distance``, or ``..._normalized``) and keeps min to max."""

    reference: str
    max: float | None = None
    min: float | None = None
    normalize: bool = False
    column: str = "sequence"

    def apply(self, df: DataFrame) -> DataFrame:
        c = F.col(check_name(self.column))
        name = "hamming_distance_normalized" if self.normalize else "hamming_distance"
        d = (bio.hamming_normalized if self.normalize else bio.hamming)(c, F.lit(self.reference))
        out, ok = df.withColumn(name, d), F.lit(True)
        if self.min is not None:
            ok = ok & (F.col(name) >= self.min)
        if self.max is not None:
            ok = ok & (F.col(name) <= self.max)
        return out.where(ok)


@dataclass(frozen=True)
class Conserved(Filter):
    """Keeps texts with one of the given residues at each 0-based position; a text that ends before one goes."""

    positions: dict[int, Sequence[str]]
    reference_length: int | None = None
    column: str = "sequence"

    def apply(self, df: DataFrame) -> DataFrame:
        c, ok = F.col(check_name(self.column)), F.lit(True)
        for p, residues in self.positions.items():
            ok = ok & F.substring(c, int(p) + 1, 1).isin(*residues)
        if self.reference_length is not None:
            ok = ok & (F.length(c) == self.reference_length)
        return df.where(ok)

    def spec(self) -> dict[str, Any]:
        return {**super().spec(), "positions": {str(k): list(v) for k, v in self.positions.items()}}

    @classmethod
    def from_spec(cls, spec: dict[str, Any]) -> Filter:
        return cls(**{**spec, "positions": {int(k): list(v) for k, v in spec["positions"].items()}})


@dataclass(frozen=True)
class Alphabet(Filter):
    """Keeps texts that are not empty and have no character outside the alphabet; null goes."""

    alphabet: str = bio.AMINO_ACIDS
    column: str = "sequence"

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(bio.matches_alphabet(F.col(check_name(self.column)), self.alphabet))


@dataclass(frozen=True)
class Ranking(Filter):
    """Keeps the best by a column: the ``n`` largest (or smallest), or a percentile of them.

    ``percentile`` p keeps values at or above the (1 - p/100) quantile, linearly interpolated (at or below
    the p/100 quantile if ascending), ties included. Null and NaN go. Ties of ``n`` fall to the smaller
    id, or are broken by the whole row where there is no id column.
    """

    column: str
    n: int | None = None
    percentile: float | None = None
    ascending: bool = False
    method: str = "top"
    id_column: str = "sequence_id"
    needs_all: ClassVar[bool] = True

    def apply(self, df: DataFrame) -> DataFrame:
        check_name(self.column)
        if (self.n is None) == (self.percentile is None):
            raise ValueError("give either n or percentile")
        low = self.ascending or self.method == "bottom"
        if self.percentile is not None:
            return percentile_keep(df, self.column, self.percentile, low)
        return (bottom_n if low else top_n)(df, self.column, self.n, self.id_column)


@dataclass(frozen=True)
class Sample(Filter):
    """Keeps ``n`` rows: at random (by a seeded hash of the id), the ``top`` by score, or ``spread`` evenly over the ranks."""

    n: int
    method: str = "random"
    score_column: str | None = None
    seed: int = 42
    id_column: str = "sequence_id"
    needs_all: ClassVar[bool] = True

    def apply(self, df: DataFrame) -> DataFrame:
        if self.method == "random":
            return sample_random(df, self.n, self.id_column, self.seed)
        if self.score_column is None:
            raise ValueError(f"method {self.method!r} needs a score column")
        if self.method == "top":
            return top_n(df, self.score_column, self.n, self.id_column)
        if self.method == "spread":
            return sample_spread(df, self.n, self.score_column, self.id_column)
        raise ValueError(f"unknown method {self.method!r}")

    def keep_earlier(self, df: DataFrame, earlier: DataFrame) -> DataFrame:
        """Rows sampled earlier (ids in ``earlier``) stay; the rest is drawn from the others up to ``n``."""
        old = df.join(earlier.select(self.id_column).distinct(), self.id_column, "left_semi").select(df.columns)
        have = old.count()
        if have >= self.n:
            return old
        others = df.join(earlier.select(self.id_column), self.id_column, "left_anti").select(df.columns)
        return old.unionByName(Sample(self.n - have, self.method, self.score_column, self.seed, self.id_column).apply(others))


@dataclass(frozen=True)
class Custom(Filter):
    """Any function from frame to frame. Code can't be stored, so it has a spec only under a ``name`` that ``FUNCTIONS`` knows when it is loaded."""

    function: Callable[[DataFrame], DataFrame]
    all_rows: bool = False
    must_have: str | None = None
    name: str | None = None

    @property
    def needs_all(self) -> bool:  # type: ignore[override]
        return self.all_rows

    def apply(self, df: DataFrame) -> DataFrame:
        out = df.transform(self.function)
        if self.must_have and self.must_have not in out.columns:
            raise ValueError(f"the filter's result must have a column {self.must_have!r}")
        return out

    def spec(self) -> dict[str, Any]:
        if self.name is None:
            raise ValueError("a custom filter without a name has no spec")
        return {"type": "Custom", "name": self.name, "all_rows": self.all_rows, "must_have": self.must_have}

    @classmethod
    def from_spec(cls, spec: dict[str, Any]) -> Custom:
        if spec["name"] not in FUNCTIONS:
            raise KeyError(f"no function named {spec['name']!r}")
        return cls(FUNCTIONS[spec["name"]], spec["all_rows"], spec["must_have"], spec["name"])


@dataclass(frozen=True)
class Composite(Filter):
    """Filters one after the other; neighbouring predicates become one in the optimizer."""

    filters: Sequence[Filter] = field(default_factory=tuple)

    @property
    def needs_all(self) -> bool:  # type: ignore[override]
        return any(f.needs_all for f in self.filters)

    def apply(self, df: DataFrame) -> DataFrame:
        for f in self.filters:
            df = f.apply(df)
        return df

    def spec(self) -> dict[str, Any]:
        return {"type": "Composite", "filters": [f.spec() for f in self.filters]}

    @classmethod
    def from_spec(cls, spec: dict[str, Any]) -> Filter:
        return cls(tuple(filter_from_spec(s) for s in spec["filters"]))


def combine(*filters: Filter) -> Composite:
    return Composite(tuple(filters))
