"""Score cutoffs that keep a target fraction of each source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import staged

SKETCH_K = 400  # rank error of a KLL sketch of this size: about 0.7 % at 99 % confidence
RANK_ERROR = 0.02
MAX_BRACKET = 200_000  # distinct values of a source that one task may sort
BROADCAST_SOURCES = 20_000
GRID = 50  # each further pass narrows a bracket to about three of so many parts
ROUNDS = 8  # after which a bracket that holds the cutoff is sorted whatever its size


def source_rows(df: DataFrame, id_col: str = "prediction_id", model_col: str = "model_name", type_col: str = "prediction_type", value_col: str = "value") -> DataFrame:
    """(id, model_name, prediction_type, value): records once per id, names trimmed and lower-cased.

    Rows with a null id, name or value, or a NaN value, are left out. An id whose rows differ in name or
    value counts once for each of them.
    """
    name = lambda c: F.lower(F.trim(F.col(c)))
    rows = df.select(F.col(id_col).cast("long").alias("id"), name(model_col).alias("model_name"), name(type_col).alias("prediction_type"), F.col(value_col).cast("double").alias("value"))
    rows = rows.where("id is not null and model_name is not null and prediction_type is not null and value is not null and not isnan(value)")
    return rows.dropDuplicates(["id", "model_name", "prediction_type", "value"])


def cutoffs(rows: DataFrame, keep: float = 0.2, k: int = SKETCH_K, error: float = RANK_ERROR, max_bracket: int = MAX_BRACKET) -> DataFrame:
    """(model_name, prediction_type, n_rows, cutoff, n_kept, n_ties) per source of ``source_rows``.

    The cutoff is the highest value for which at least ``keep`` of the source's rows have it or more;
    n_kept counts the rows at or above it, n_ties those at it.

    A KLL sketch per source (mergeable, so built map-side) gives values around the target rank, one below
    and one above by ``error``. A second pass counts the rows above the bracket and each value within it,
    and a running count finds the exact cutoff. Where the sketch missed, or a bracket holds more
    than ``max_bracket`` distinct values, the pass is repeated for that source's bracket: the result is
    exact whatever the sketch's luck. Sources stay a table; none is collected.
    """
    src = ["model_name", "prediction_type"]
    sk = rows.groupBy(*src).agg(F.count("*").alias("n"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sk"), F.min("value").alias("least"), F.max("value").alias("most"))
    q = lambda p: F.kll_sketch_get_quantile_double("sk", F.lit(min(1.0, max(0.0, p))))
    # Rows that a cutoff must keep; the small subtraction undoes the rounding of the product.
    need = F.greatest(F.ceil(F.col("n") * F.lit(keep) - F.lit(1e-9)), F.lit(1)).cast("long")
    open_ = sk.select(*src, "n", need.alias("need"), "least", "most", q(1 - keep - error).alias("lo"), q(1 - keep + error).alias("hi"))
    open_ = staged(open_, "brackets")
    done, round_ = None, 0
    while True:
        round_ += 1
        b = F.broadcast(open_) if open_.count() <= BROADCAST_SOURCES else open_
        inside = F.when(F.col("value") <= F.col("hi"), F.col("value"))
        counted = rows.join(b, src).where(F.col("value") >= F.col("lo")).groupBy(*src, inside.alias("v")).agg(F.count("*").alias("c"))
        counted = staged(counted, "counts")
        above = counted.groupBy(*src).agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("above"), F.sum("c").alias("reached"), F.count("v").alias("distinct"))
        state = open_.join(above, src, "left").fillna(0, ["above", "reached", "distinct"])
        # The bracket holds the cutoff if what is above it is too few and what it reaches is enough.
        hit = (F.col("above") < F.col("need")) & (F.col("reached") >= F.col("need"))
        state = staged(state.withColumn("ok", hit & ((F.col("distinct") <= max_bracket) | (F.col("lo") == F.col("hi")) | F.lit(round_ >= ROUNDS))).withColumn("hit", hit), "state")
        w = Window.partitionBy(*src).orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
        ok = state.where("ok").select(*src, "n", "need", "above")
        run = counted.where("v is not null").join(ok, src).withColumn("upto", F.col("above") + F.sum("c").over(w))
        got = run.where("upto >= need and upto - c < need").select(*src, F.col("n").alias("n_rows"), F.col("v").alias("cutoff"), F.col("upto").alias("n_kept"), F.col("c").alias("n_ties"))
        done = got if done is None else done.unionByName(got)
        rest = state.where("not ok")
        if rest.isEmpty():
            return done
        # Missed above: the cutoff is beyond hi; missed below: it is under lo; too wide: halve by a new sketch.
        narrow = rest.where("hit").select(*src).join(rows, src).join(rest.select(*src, "lo", "hi", "need", "above"), src).where("value between lo and hi")
        mid = narrow.groupBy(*src, "need", "above").agg(F.count("*").alias("m"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sk"))
        # A sketch answers for constant ranks only, so a grid of them is asked and the right ones are picked.
        grid = F.kll_sketch_get_quantile_double("sk", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
        at = F.floor((1 - (F.col("need") - F.col("above")) / F.col("m")) * GRID).cast("int")
        mid = mid.select(*src, F.get(grid, F.greatest(at - 1, F.lit(0))).alias("nlo"), F.get(grid, F.least(at + 2, F.lit(GRID))).alias("nhi"))
        lo = F.when(F.col("hit"), F.col("nlo")).when(F.col("above") >= F.col("need"), F.col("hi")).otherwise(F.col("least"))
        hi = F.when(F.col("hit"), F.col("nhi")).when(F.col("above") >= F.col("need"), F.col("most")).otherwise(F.col("lo"))
        open_ = staged(rest.join(mid, src, "left").select(*src, "n", "need", "least", "most", lo.alias("lo"), hi.alias("hi")), "brackets")


def kept_rows(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """The rows of ``source_rows`` at or above their source's cutoff."""
    c = staged(cuts.select("model_name", "prediction_type", "cutoff"), "cutoffs")
    c = F.broadcast(c) if c.count() <= BROADCAST_SOURCES else c
    return rows.join(c, ["model_name", "prediction_type"]).where("value >= cutoff")


def keep_fraction(df: DataFrame, keep: float = 0.2, **cols: str) -> tuple[DataFrame, DataFrame]:
    """(cutoffs, kept rows) of a table of scores; the distinct usable rows are staged once for all passes."""
    rows = staged(source_rows(df, **cols), "scores")
    cuts = staged(cutoffs(rows, keep), "cuts")
    return cuts, kept_rows(rows, cuts)
