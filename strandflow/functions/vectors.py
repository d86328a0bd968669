"""Column functions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def vec_sum(v: Column | str) -> Column:
    return F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x)


def vec_mean(v: Column | str) -> Column:
    """Mean; null if empty."""
    v = _double(v)
    return F.when(F.size(v) > 0, vec_sum(v) / F.size(v))


def reduce_values(v: Column | str, how: str) -> Column:
    """mean, max, min or sum of an array; nested arrays are flattened by the caller. Null if empty."""
    v = _double(v)
    got = {"mean": vec_mean(v), "sum": vec_sum(v), "max": F.array_max(v), "min": F.array_min(v)}
    if how not in got:
        raise ValueError(f"unknown reduction {how!r}")
    return F.when(F.size(v) > 0, got[how])


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def mean_rows(m: Column) -> Column:
    """Mean of the rows of a matrix (array of equal-length arrays)."""
    m = m.cast("array<array<double>>")
    total = F.aggregate(F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0))), F.element_at(m, 1), lambda s, r: F.zip_with(s, r, lambda x, y: x + y))
    return F.when(F.size(m) > 0, F.transform(total, lambda x: x / F.size(m)))


def reduce_rows(m: Column, how: str) -> Column:
    """mean, sum, first or last of the rows of a matrix."""
    if how == "mean":
        return mean_rows(m)
    m = m.cast("array<array<double>>")
    if how == "sum":
        return F.when(F.size(m) > 0, F.transform(mean_rows(m), lambda x: x * F.size(m)))
    if how in ("first", "last"):
        return F.when(F.size(m) > 0, F.element_at(m, 1 if how == "first" else -1))
    raise ValueError(f"unknown reduction {how!r}")


def argmax_symbol(logits: Column | str, alphabet: str) -> Column:
    """The alphabet's symbol with the largest logit; of ties the first."""
    v = _double(logits)
    at = F.array_position(v, F.array_max(v))
    return F.substring(F.lit(alphabet), at.cast("int"), F.lit(1))


def softmax(v: Column | str, temperature: float = 1.0) -> Column:
    """Probabilities at a temperature."""
    v = _double(v)
    e = F.transform(v, lambda x: F.exp((x - F.array_max(v)) / F.lit(float(temperature))))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def top_probabilities(p: Column, top_k: int | None = None, top_p: float | None = None) -> Column:
    """Probabilities with all but the largest ``top_k``, or all beyond the mass ``top_p``, set to 0, normalised again.

    The most likely entry always stays; ties at the border of ``top_k`` stay together.
    """
    kept = p
    if top_k:
        desc = F.sort_array(p, asc=False)
        least = F.element_at(desc, F.least(F.lit(int(top_k)), F.size(p)))
        kept = F.transform(kept, lambda x: F.when(x >= least, x).otherwise(0.0))
    if top_p is not None:
        full = kept
        kept = F.transform(full, lambda x: F.when(F.aggregate(F.filter(full, lambda y: y > x), F.lit(0.0), lambda s, y: s + y) < float(top_p), x).otherwise(0.0))
    return F.transform(kept, lambda x: x / F.aggregate(kept, F.lit(0.0), lambda s, y: s + y))


def sample_symbol(p: Column, alphabet: str, u: Column) -> Column:
    """The alphabet's symbol at the uniform number ``u`` of the distribution ``p``."""
    state = F.aggregate(p, F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("c")), lambda s, x: F.struct((s["i"] + (s["c"] + x <= u).cast("int")).alias("i"), (s["c"] + x).alias("c")))
    return F.substring(F.lit(alphabet), F.least(state["i"] + 1, F.lit(len(alphabet))), F.lit(1))
