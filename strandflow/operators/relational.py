"""Joins, upserts, pivots and id sets of the sequence store, as functions from frames to frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bio
from .checks import check_name
from .sampling import ordered_first


# --- Joins --------------------------------------------------------------------------------------


def join_using(left: DataFrame, right: DataFrame, on: str = "sequence_hash", how: str = "inner") -> DataFrame:
    """Equi-join on one column of both sides. Columns: the left's in order, then the right's without the key.

    A right or full join keeps the key of whichever side has it. Other column names must differ.
    """
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"unknown join {how!r}")
    check_name(on)
    clash = (set(left.columns) & set(right.columns)) - {on}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    out = left.join(right, on, how)
    return out.select(*left.columns, *[c for c in right.columns if c != on])


def merge_columns(left: DataFrame, right: DataFrame, on: str = "id", suffix: str = "_enriched") -> DataFrame:
    """Left join; columns of the right that the left has too get a suffix."""
    renamed = right.select(*[F.col(c).alias(c if c == on or c not in left.columns else c + suffix) for c in right.columns])
    return join_using(left, renamed, on, "left")


def semi_lookup(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows whose key is among ``keys``; repeats in ``keys`` don't matter."""
    return df.join(keys.select(on), on, "left_semi").select(df.columns)


def count_matching(store: DataFrame, texts: DataFrame, column: str = "sequence") -> DataFrame:
    """(n_matching): how many of the given texts, repeats included, the store has by hash."""
    hashes = store.select(F.col("hash")).where("hash is not null").distinct()
    return texts.select(bio.store_hash(column).alias("hash")).join(hashes, "hash").agg(F.count("*").alias("n_matching"))


def embeddings_concat(embeddings: DataFrame, models: Sequence[str], id_column: str = "sequence_id", model_column: str = "model_name", values: str = "values") -> DataFrame:
    """(id, values): per id that has an embedding of every model, the vectors joined in the order of ``models``.

    One aggregate rather than a chain of joins. Of several vectors of one model the largest counts.
    """
    picks = [F.max(F.when(F.col(model_column) == m, F.col(values))).alias(f"v{i}") for i, m in enumerate(models)]
    wide = embeddings.where(F.col(model_column).isin(*models)).groupBy(id_column).agg(*picks)
    have_all = reduce(lambda a, b: a & b, [F.col(f"v{i}").isNotNull() for i in range(len(models))])
    return wide.where(have_all).select(id_column, F.concat(*[f"v{i}" for i in range(len(models))]).alias(values))


# --- Id sets ------------------------------------------------------------------------------------


def status_roll_up(df: DataFrame, keys: Sequence[str], status: str, any_of: Sequence[tuple[str, Sequence[str]]], all_of: Sequence[tuple[str, Sequence[str]]], default: str) -> DataFrame:
    """(keys, status): one status for the statuses of a key's rows, compared without regard to case.

    The first of ``any_of`` (name, statuses) of which some row has a status, else the first of ``all_of``
    whose statuses all rows have, else ``default``; null statuses match nothing.
    """
    s = F.lower(F.trim(F.col(status)))
    out = F.lit(default)
    low = lambda xs: [x.lower() for x in xs]
    for name, some in reversed(all_of):
        out = F.when(F.bool_and(F.coalesce(s.isin(low(some)), F.lit(False))), name).otherwise(out)
    for name, some in reversed(any_of):
        out = F.when(F.bool_or(F.coalesce(s.isin(low(some)), F.lit(False))), name).otherwise(out)
    return df.groupBy(*keys).agg(out.alias("status"))


def id_set(df: DataFrame, id_column: str = "sequence_id") -> DataFrame:
    """Distinct non-null ids."""
    return df.select(F.col(id_column).cast("long").alias("sequence_id")).where("sequence_id is not null").distinct()


def ids_intersect(*sets: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), [s.select("sequence_id") for s in sets])


def ids_union(*sets: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [s.select("sequence_id") for s in sets]).distinct()


def ids_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("sequence_id").distinct().join(b.select("sequence_id"), "sequence_id", "left_anti")


# --- Latest rows, attachment and pivots ---------------------------------------------------------


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by the order columns, descending. Plans with a WindowGroupLimit before the shuffle."""
    return ordered_first(df, keys, [F.col(c).desc_nulls_last() for c in order])


def latest_value(predictions: DataFrame, kind: str, model: str | None = None, name: str | None = None) -> DataFrame:
    """(sequence_id, <name>): the value of the largest prediction_id of a type; one hash aggregate, no sort."""
    p = predictions.where(F.col("prediction_type") == kind)
    if model is not None:
        p = p.where(F.col("model_name") == model)
    return p.groupBy("sequence_id").agg(F.max_by("value", "prediction_id").alias(name or kind))


def attach_latest(base: DataFrame, predictions: DataFrame, kinds: Sequence[str], model: str | None = None) -> DataFrame:
    """``base`` with one column per type, holding the latest value or null. Names that the base has are skipped."""
    want = [check_name(k) for k in kinds if k not in base.columns]
    if not want:
        return base
    return join_using(base, pivot_latest(predictions, want, model), "sequence_id", "left")


def column_names(kinds: Sequence[str]) -> list[str]:
    """A column name for each type; types that differ in case only, which Spark's columns can't, get a number from the second on."""
    seen: dict[str, int] = {}
    out = []
    for k in kinds:
        n = seen[k.lower()] = seen.get(k.lower(), 0) + 1
        out.append(k if n == 1 else f"{k}_{n}")
    return out


def pivot_latest(predictions: DataFrame, kinds: Sequence[str], model: str | None = None) -> DataFrame:
    """One row per sequence_id with the latest value of each type, by conditional max_by in one aggregate. Names as in ``column_names``."""
    p = predictions.where(F.col("prediction_type").isin(*kinds) & F.col("sequence_id").isNotNull())
    if model is not None:
        p = p.where(F.col("model_name") == model)
    kind = F.col("prediction_type")
    aggs = [F.max_by(F.when(kind == k, F.col("value")), F.when(kind == k, F.col("prediction_id"))).alias(c) for k, c in zip(kinds, column_names(kinds))]
    return p.groupBy("sequence_id").agg(*aggs)


def prediction_types(predictions: DataFrame) -> list[str]:
    """The distinct types that can be column names, sorted. (A driver-side list: types are few by design.)"""
    from .checks import IDENTIFIER

    found = [r[0] for r in predictions.select("prediction_type").where("prediction_type is not null").distinct().orderBy("prediction_type").collect()]
    return [t for t in found if IDENTIFIER.match(t)]


def export_wide(sequences: DataFrame, predictions: DataFrame, kinds: Sequence[str] | None = None, generation: DataFrame | None = None) -> DataFrame:
    """Every sequence with its latest value per type; unscored sequences stay. Generation columns come by their largest value."""
    out = attach_latest(sequences, predictions, prediction_types(predictions) if kinds is None else kinds)
    if generation is not None:
        cols = [c for c in generation.columns if c not in ("sequence_id", *out.columns)]
        out = join_using(out, generation.groupBy("sequence_id").agg(*[F.max(c).alias(c) for c in cols]), "sequence_id", "left")
    return out


def working_frame(ids: DataFrame, sequences: DataFrame, predictions: DataFrame, kinds: Sequence[str] | None = None, generation: DataFrame | None = None) -> DataFrame:
    """``export_wide`` for an id set, with ``source_label``: the label of the latest generation row, or null."""
    base = semi_lookup(sequences, ids, "sequence_id")
    out = attach_latest(base, semi_lookup(predictions, ids, "sequence_id"), prediction_types(predictions) if kinds is None else kinds)
    if generation is None:
        return out.withColumn("source_label", F.lit(None).cast("string"))
    label = generation.groupBy("sequence_id").agg(F.max_by("label", "metadata_id").alias("source_label"))
    return join_using(out, label, "sequence_id", "left")


# --- Cache checks -------------------------------------------------------------------------------


def uncached(ids: DataFrame, predictions: DataFrame, kind: str, model: str) -> DataFrame:
    """The ids without a row of this type and model, or with a null value that isn't marked failed."""
    p = predictions.where((F.col("prediction_type") == kind) & (F.col("model_name") == model))
    failed = F.coalesce(F.get_json_object("metadata", "$.status") == "failed", F.lit(False))
    done = p.groupBy("sequence_id").agg(F.bool_or(F.col("value").isNotNull() | failed).alias("done")).where("done")
    return ids.select("sequence_id").distinct().join(done.select("sequence_id"), "sequence_id", "left_anti")


def with_prediction(ids: DataFrame, predictions: DataFrame, kind: str, model: str | None = None) -> DataFrame:
    """The ids that have a non-null value of this type."""
    p = predictions.where((F.col("prediction_type") == kind) & F.col("value").isNotNull())
    if model is not None:
        p = p.where(F.col("model_name") == model)
    return ids.select("sequence_id").distinct().join(p.select("sequence_id"), "sequence_id", "left_semi")


# --- Writes as functions ------------------------------------------------------------------------


def upsert_non_null(log: DataFrame, keys: Sequence[str], value: str = "value", order: str = "prediction_id") -> DataFrame:
    """Of an append log one row per key: the smallest id, and the last non-null value (null if there is none)."""
    got = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    return log.groupBy(*keys).agg(F.min(order).alias(order), got.alias(value))


def upsert_replace(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of an append log the last row per key; null keys are equal to each other."""
    return latest(log, keys, order)


def insert_if_absent(store: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The store's rows and the new ones whose key it lacks (of several the first by order)."""
    cond = reduce(lambda a, b: a & b, [F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    first = ordered_first(new, keys, [F.col(c).asc_nulls_last() for c in (order or keys)])
    fresh = first.alias("n").join(store.alias("s"), cond, "left_anti")
    return store.unionByName(fresh.select(store.columns))


def number_rows(df: DataFrame, start: int, order: Sequence[Column], name: str) -> DataFrame:
    """Dense ids from ``start`` in a total order, without a window over all rows."""
    from .sampling import ranked

    return ranked(df, order, name).withColumn(name, F.col(name) + F.lit(start))


def dedup_new(store: DataFrame, batch: DataFrame, hash_column: Column, position: str) -> DataFrame:
    """The batch's rows with a hash (column ``hash``) that neither the store nor an earlier row of the batch has."""
    hashed = batch.withColumn("hash", hash_column)
    first = ordered_first(hashed, ["hash"], [F.col(position).asc_nulls_last()])
    return first.join(store.select("hash"), "hash", "left_anti").select(hashed.columns)
