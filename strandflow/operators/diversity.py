"""Diversity of a set of sequences, and summaries of numeric columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bio import characters


def kmers(df: DataFrame, k: int, column: str = "sequence") -> DataFrame:
    """(kmer): every substring of length k of every text."""
    if k < 1:
        raise ValueError("k must be at least 1")
    # A look-ahead matches at every place, so one pass over the text gives all.
    return df.select(F.explode(F.regexp_extract_all(column, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))).alias("kmer"))


def kmer_counts(df: DataFrame, k: int, column: str = "sequence") -> DataFrame:
    """(kmer, n), counted map-side first."""
    return kmers(df, k, column).groupBy("kmer").agg(F.count("*").alias("n"))


def motif_diversity(df: DataFrame, k: int = 3, column: str = "sequence", top: int = 5) -> DataFrame:
    """(unique_kmers, total_kmers, diversity_ratio, most_common) in one row; ties of the top by the k-mer.

    No k-mers give 0, 0, 0.0 and an empty list.
    """
    c = kmer_counts(df, k, column)
    best = c.orderBy(F.desc("n"), "kmer").limit(top).collect()
    common = F.array(*[F.struct(F.lit(r["kmer"]).alias("kmer"), F.lit(r["n"]).alias("n")) for r in best]) if best else F.array().cast("array<struct<kmer:string,n:bigint>>")
    total = c.agg(F.count("*").alias("unique_kmers"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_kmers"))
    ratio = F.when(F.col("total_kmers") > 0, F.col("unique_kmers") / F.col("total_kmers")).otherwise(0.0)
    return total.select("unique_kmers", "total_kmers", ratio.alias("diversity_ratio"), common.alias("most_common"))


def shannon_entropy(df: DataFrame, column: str = "sequence", normalize: bool = True) -> DataFrame:
    """(shannon_entropy): mean over positions of the symbol entropy, gaps '-' left out; 0.0 for no texts.

    Symbols are counted per position in two hash aggregates. ``normalize`` divides by log2(20).
    """
    sym = df.select(F.posexplode(characters(column)).alias("p", "s")).where("s <> '-'")
    n = sym.groupBy("p", "s").agg(F.count("*").alias("n"))
    # Sum over symbols of n * log2 needs the position's total, so the counts are gathered by position (at most an alphabet of them).
    per = n.groupBy("p").agg(F.sum("n").alias("t"), F.collect_list("n").alias("l"))
    h = per.select((-F.aggregate("l", F.lit(0.0), lambda s, x: s + x / F.col("t") * F.log2(x / F.col("t") + 1e-10))).alias("h"))
    scale = math.log2(20) if normalize else 1.0
    return h.agg((F.coalesce(F.avg("h"), F.lit(0.0)) / scale).alias("shannon_entropy"))


def diversity_metrics(df: DataFrame, column: str = "sequence") -> DataFrame:
    """One row: n_sequences, n_unique, uniqueness_ratio, shannon_entropy, and motif diversity for k = 3 and 5."""
    base = df.agg(F.count("*").alias("n_sequences"), F.count_distinct(column).alias("n_unique"))
    base = base.withColumn("uniqueness_ratio", F.when(F.col("n_sequences") > 0, F.col("n_unique") / F.col("n_sequences")).otherwise(0.0))
    out = base.withColumn("shannon_entropy", F.lit(shannon_entropy(df, column).first()[0]))
    for k in (3, 5):
        m = kmer_counts(df, k, column).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        out = out.withColumns({f"unique_{k}mers": F.lit(m[0]), f"total_{k}mers": F.lit(m[1]), f"diversity_ratio_{k}mer": F.lit(m[0] / m[1] if m[1] else 0.0)})
    return out


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, lo, n) of equal-width bins from the least to the largest value; the last bin has both its ends.

    Null and NaN are left out; a column with one value fills bin 0.
    """
    v = F.col(column).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(v.alias("v"))
    a, b = rows.agg(F.min("v"), F.max("v")).first()
    if a is None:
        return rows.select(F.lit(0).cast("long").alias("bin"), F.col("v").alias("lo"), F.lit(0).cast("long").alias("n")).limit(0)
    width = (b - a) / bins
    at = (F.least(F.floor((F.col("v") - F.lit(a)) / F.lit(width)), F.lit(bins - 1)) if width > 0 else F.lit(0)).cast("long")
    return rows.select(at.alias("bin")).groupBy("bin").agg(F.count("*").alias("n")).select("bin", (F.lit(a) + F.col("bin") * F.lit(width)).alias("lo"), "n")


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr): Pearson correlation of every pair of columns, all in one aggregate."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def group_quartiles(df: DataFrame, by: str, column: str) -> DataFrame:
    """(by, n, least, q1, median, q3, most, mean) per group: what a box plot shows."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = df.groupBy(by).agg(F.count(column).alias("n"), F.min(column).alias("least"), q.alias("q"), F.max(column).alias("most"), F.avg(column).alias("mean"))
    return g.select(by, "n", "least", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "most", "mean")


def summarize(df: DataFrame) -> DataFrame:
    """(column_name, data_type, non_null, nulls, n_unique, mean, std, least, most): one row per column, in one aggregate."""
    numeric = {"byte", "short", "integer", "long", "float", "double", "decimal"}
    aggs: list[Column] = []
    for i, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        num = f.dataType.typeName() in numeric
        v = c.cast("double") if num else F.lit(None).cast("double")
        aggs += [F.count(c).alias(f"n{i}"), F.count(F.when(c.isNull(), 1)).alias(f"z{i}"), F.count_distinct(c).alias(f"u{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}")]
    rows = [F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f"n{i}").alias("non_null"), F.col(f"z{i}").alias("nulls"), F.col(f"u{i}").alias("n_unique"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"), F.col(f"a{i}").alias("least"), F.col(f"b{i}").alias("most")) for i, f in enumerate(df.schema)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


OPS = ("count", "mean", "sum", "min", "max", "std", "p50", "p90", "p95", "p99")


def aggregates(df: DataFrame, specs: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """(metric, value) for each field and operation; field '__rows__' has only 'count'.

    Numbers and booleans count; fields of other types, absent fields and fields without values give no rows.
    std is the sample deviation, 0.0 for one value; percentiles interpolate linearly.
    """
    numeric = {"byte", "short", "integer", "long", "float", "double", "decimal", "boolean"}
    out: list[tuple[str, Column, Column]] = []
    for field, ops in specs:
        if field == "__rows__":
            out += [("__rows__.count", F.count("*").cast("double"), F.lit(True)) for op in ops if op == "count"]
            continue
        if field not in df.columns or df.schema[field].dataType.typeName() not in numeric:
            continue
        v = F.col(field).cast("int").cast("double") if df.schema[field].dataType.typeName() == "boolean" else F.col(field).cast("double")
        has = F.count(v) > 0
        table = {"count": F.count(v).cast("double"), "mean": F.avg(v), "sum": F.sum(v), "min": F.min(v), "max": F.max(v), "std": F.coalesce(F.stddev_samp(v), F.lit(0.0)), **{f"p{p}": F.percentile(v, F.lit(p / 100)) for p in (50, 90, 95, 99)}}
        for op in ops:
            if op not in table:
                raise ValueError(f"unknown operation {op!r}")
            out.append((f"{field}.{op}", table[op], has))
    if not out:
        return df.sparkSession.createDataFrame([], "metric string, value double")
    one = df.agg(*[F.when(has, x).alias(f"v{i}") for i, (_, x, has) in enumerate(out)])
    rows = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"v{i}").alias("value")) for i, (name, _, _) in enumerate(out)])
    return one.select(F.explode(rows).alias("r")).select("r.*").where("value is not null")
