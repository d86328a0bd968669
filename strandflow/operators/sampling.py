"""Top-k, percentile and sampling operators, all with defined ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .checks import check_name
from .quantiles import exact_quantile


def _tie(df: DataFrame, id_column: str) -> list[Column]:
    """What breaks ties: the id, or a digest of the row where there is none."""
    if id_column in df.columns:
        return [F.col(id_column).asc_nulls_last()]
    return [F.xxhash64(*df.columns)] if df.columns else []


def top_n(df: DataFrame, column: str, n: int, id_column: str = "sequence_id") -> DataFrame:
    """The n rows with the largest non-null, non-NaN value; ties to the smaller id. Plans as TakeOrderedAndProject."""
    c = F.col(check_name(column))
    return df.where(c.isNotNull() & ~F.isnan(c.cast("double"))).orderBy(c.desc(), *_tie(df, id_column)).limit(max(0, n))


def bottom_n(df: DataFrame, column: str, n: int, id_column: str = "sequence_id") -> DataFrame:
    """The n rows with the smallest non-null, non-NaN value; ties to the smaller id."""
    c = F.col(check_name(column))
    return df.where(c.isNotNull() & ~F.isnan(c.cast("double"))).orderBy(c.asc(), *_tie(df, id_column)).limit(max(0, n))


def percentile_keep(df: DataFrame, column: str, percentile: float, ascending: bool = False) -> DataFrame:
    """Rows at or above the (1 - percentile/100) quantile, or at or below the percentile/100 one; ties stay.

    The quantile is exact with linear interpolation (``exact_quantile``), and is found when this is called.
    """
    if not 0 <= percentile <= 100:
        raise ValueError("percentile must be within 0 and 100")
    c = F.col(check_name(column)).cast("double")
    rows = df.where(c.isNotNull() & ~F.isnan(c))
    p = percentile / 100 if ascending else 1 - percentile / 100
    cut = exact_quantile(rows, c, p)
    if cut is None:
        return rows
    return rows.where(c <= cut) if ascending else rows.where(c >= cut)


def sample_random(df: DataFrame, n: int, id_column: str = "sequence_id", seed: int = 42) -> DataFrame:
    """n rows without replacement, chosen by a seeded digest of the id: the same rows on every run, cluster and engine."""
    key = F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f":{seed}"))) if id_column in df.columns else F.xxhash64(*df.columns, F.lit(seed))
    return df.orderBy(key, *_tie(df, id_column)).limit(max(0, n))


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank0") -> DataFrame:
    """Adds the 0-based rank of each row in a total order, without a window over all rows.

    Rows are range-partitioned by the order; each partition counts its own, and a partition's first rank is
    the sum of the counts before it (one number per partition on the driver).
    """
    part = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id())
    part = part.withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), 33))
    from ..session import staged

    part = staged(part, "ranked")
    before, total = [], 0
    for r in part.groupBy("_pid").agg(F.count("*").alias("n")).orderBy("_pid").collect():
        before.append((r["_pid"], total))
        total += r["n"]
    starts = df.sparkSession.createDataFrame(before, "_pid int, _before long")
    return part.join(F.broadcast(starts), "_pid").withColumn(name, F.col("_at") + F.col("_before")).drop("_pid", "_at", "_before")


def sample_spread(df: DataFrame, n: int, column: str, id_column: str = "sequence_id") -> DataFrame:
    """n rows evenly spaced over the ranks by a score, both ends included; all rows if there are no more than n.

    Rows go in ascending order, nulls last, ties by id; the k-th is at floor(k * (rows - 1) / (n - 1)).
    """
    total = df.count()
    if n <= 0:
        return df.limit(0)
    if total <= n:
        return df
    rank = ranked(df, [F.col(check_name(column)).asc_nulls_last(), *_tie(df, id_column)])
    if n == 1:
        return rank.where("rank0 = 0").drop("rank0")
    spark = df.sparkSession
    wanted = spark.range(n).select((F.floor(F.col("id") * F.lit(total - 1) / F.lit(n - 1))).cast("long").alias("rank0")).distinct()
    return rank.join(F.broadcast(wanted) if n <= 100_000 else wanted, "rank0", "left_semi").drop("rank0").select(df.columns)


def ordered_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order (keep-first deduplication). Null keys are equal to each other."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
