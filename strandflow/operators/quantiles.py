"""Exact quantiles of a column of any size: a sketch brackets the ranks, a counting pass finds the values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_K = 400  # rank error of a KLL sketch of this size: about 0.7 % at 99 % confidence
RANK_ERROR = 0.02
MAX_VALUES = 100_000  # distinct values of a bracket that are looked at together


def exact_quantile(df: DataFrame, value: Column, p: float, k: int = SKETCH_K, error: float = RANK_ERROR, most: int = MAX_VALUES) -> float | None:
    """The quantile of the non-null, non-NaN values, with linear interpolation; None without any.

    A mergeable sketch of the values in a bracket, at first all, gives a narrower one around the wanted
    rank; a pass counts what is below it and in it. A sketch that missed still tells on which side the rank
    lies, so the bracket shrinks each time, until it holds at most ``most`` distinct values. Only these, and
    single numbers, come to the driver. RuntimeError if a bracket can't be made narrower.
    """
    v = df.select(value.cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, a, b = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    at = (n - 1) * p
    first, last = math.floor(at), math.ceil(at)  # 0-based ranks of the two neighbours
    below, within = 0, n
    while True:
        inside = v.where((F.col("v") >= a) & (F.col("v") <= b))
        if inside.agg(F.approx_count_distinct("v")).first()[0] <= most or a == b:
            break
        rank = (first - below) / max(1, within - 1)
        q = lambda r: F.kll_sketch_get_quantile_double("s", F.lit(min(1.0, max(0.0, r))))
        lo, hi = inside.agg(F.kll_sketch_agg_double("v", F.lit(k)).alias("s")).select(q(rank - error), q(rank + error)).first()
        under, to = v.agg(F.count(F.when(F.col("v") < lo, 1)), F.count(F.when(F.col("v") <= hi, 1))).first()
        old = (a, b)
        if under > first:
            b = lo
        elif to <= last:
            a = hi
        else:
            a, b = lo, hi
        if (a, b) == old:
            if within > MAX_VALUES:
                raise RuntimeError("the bracket of a quantile can't be narrowed")
            break
        below, to = v.agg(F.count(F.when(F.col("v") < a, 1)), F.count(F.when(F.col("v") <= b, 1))).first()
        within = to - below
    found, seen = [], below
    for r in inside.groupBy("v").agg(F.count("*").alias("c")).orderBy("v").collect():
        for rank in (first, last)[len(found) :]:
            if rank < seen + r["c"]:
                found.append(r["v"])
        seen += r["c"]
    x, y = found
    return x if x == y else x + (y - x) * (at - first)
