"""Entity-attribute-value rows reshaped into one typed row per entity."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

MAX_ATTRIBUTES = 2000


@dataclass(frozen=True)
class Attribute:
    """One column of the wide table: its key parts, its name and its type."""

    key: tuple[str, ...]
    name: str
    kind: str  # boolean, bigint or double (string for texts)


def _name(key: tuple[str, ...], taken: set[str]) -> str:
    base = "__".join(re.sub(r"\W+", "_", k, flags=re.ASCII).strip("_") or "x" for k in key)
    name, n = base, 2
    while name.lower() in taken:
        name, n = f"{base}_{n}", n + 1
    taken.add(name.lower())
    return name


def cells(df: DataFrame, entity: str, key_cols: list[str], order: str, value: Column) -> DataFrame:
    """(entity, attributes, cell_id, value): of each cell the row with the largest ``order``, and its value.

    One hash aggregate with map-side combine, so that an entity with a third of all rows shrinks to its
    cells before the shuffle. Of equal orders the largest value counts.
    """
    names = [F.lower(F.trim(F.col(c))).alias(f"k{i}") for i, c in enumerate(key_cols)]
    rows = df.select(F.col(entity).alias("entity"), *names, F.col(order).cast("long").alias("cell_id"), value.alias("value"))
    ok = F.col("entity").isNotNull() & F.col("cell_id").isNotNull() & F.col("value").isNotNull()
    for i in range(len(key_cols)):
        ok &= F.col(f"k{i}").isNotNull()
    best = rows.where(ok).groupBy("entity", *[f"k{i}" for i in range(len(key_cols))])
    top = best.agg(F.max(F.struct("cell_id", "value")).alias("top"))
    return top.select("entity", *[f"k{i}" for i in range(len(key_cols))], "top.cell_id", "top.value")


def discover(table: DataFrame, n_keys: int, max_attributes: int = MAX_ATTRIBUTES) -> list[Attribute]:
    """The attributes of ``cells`` and their types, in order of name: boolean if all values are 0 or 1, bigint if all are whole, else double.

    One aggregate per attribute is collected; more than ``max_attributes`` raise ValueError, as a table
    can't be that wide.
    """
    keys = [f"k{i}" for i in range(n_keys)]
    v = F.col("value")
    found = table.groupBy(*keys).agg(F.bool_and((v == 0) | (v == 1)).alias("flag"), F.bool_and((v == F.floor(v)) & (F.abs(v) < 2.0**53)).alias("whole"))
    rows = found.orderBy(*keys).limit(max_attributes + 1).collect()
    if len(rows) > max_attributes:
        raise ValueError(f"more than {max_attributes} attributes: raise max_attributes or pivot in parts")
    taken: set[str] = {"entity"}
    return [Attribute(tuple(r[k] for k in keys), _name(tuple(r[k] for k in keys), taken), "boolean" if r["flag"] else "bigint" if r["whole"] else "double") for r in rows]


def pivot_cells(table: DataFrame, attributes: list[Attribute], with_ids: bool = False) -> DataFrame:
    """One row per entity with one conditional aggregate per attribute, cast to its type.

    Attributes get numbers first, so each aggregate tests one integer. ``table`` has at most one row per
    cell, so a row's size is bounded and no entity can be hot. ``with_ids`` adds ``<name>__id``, the row a
    cell came from. Cells of attributes not given are left out.
    """
    n_keys = len(attributes[0].key) if attributes else 0
    keys = [f"k{i}" for i in range(n_keys)]
    spark = table.sparkSession
    if not attributes:
        return table.select("entity").distinct()
    number = spark.createDataFrame([(*a.key, i) for i, a in enumerate(attributes)], ", ".join(f"{k} string" for k in keys) + ", no int")
    numbered = table.join(F.broadcast(number), keys).select("entity", "no", "cell_id", "value").repartition("entity")
    aggs = []
    for i, a in enumerate(attributes):
        aggs.append(F.max(F.when(F.col("no") == i, F.col("value"))).cast(a.kind).alias(a.name))
        if with_ids:
            aggs.append(F.max(F.when(F.col("no") == i, F.col("cell_id"))).alias(f"{a.name}__id"))
    return numbered.groupBy("entity").agg(*aggs)


def wide_table(df: DataFrame, entity: str = "sequence_id", key_cols: tuple[str, ...] = ("model_name", "prediction_type"), order: str = "prediction_id", value: str = "value", with_ids: bool = False, max_attributes: int = MAX_ATTRIBUTES) -> tuple[DataFrame, list[Attribute]]:
    """(wide table, attributes) of numeric entity-attribute-value rows.

    The attribute list and the types come from the data first; then one conditional aggregate per
    attribute. Names are compared trimmed and lower-cased. Of a cell's rows the one with the largest
    ``order`` counts. Rows with a null entity, name, order or value, or a NaN value, fill no cell; an
    entity without any cell has no row; an empty table gives one without rows or attributes. Other
    columns of ``df``, whatever their names, are not looked at.
    """
    v = F.col(value).cast("double")
    table = staged(cells(df, entity, list(key_cols), order, F.when(~F.isnan(v), v)), "cells")
    attributes = discover(table, len(key_cols), max_attributes)
    return pivot_cells(table, attributes, with_ids).withColumnRenamed("entity", entity), attributes


def unpivot_ids(wide: DataFrame, attributes: list[Attribute], entity: str = "sequence_id", key_names: tuple[str, ...] = ("model_name", "prediction_type"), id_name: str = "prediction_id") -> DataFrame:
    """One row per filled cell of a wide table built ``with_ids``."""
    if not attributes:
        return wide.select(entity, *[F.lit(None).cast("string").alias(k) for k in key_names], F.lit(None).cast("long").alias(id_name)).where(F.lit(False))
    entries = F.array(*[F.struct(F.lit(i).alias("no"), F.col(f"`{a.name}__id`").alias("id")) for i, a in enumerate(attributes)])
    names = F.array(*[F.struct(*[F.lit(p).alias(k) for p, k in zip(a.key, key_names)]) for a in attributes])
    long = wide.select(entity, F.explode(F.filter(entries, lambda e: e["id"].isNotNull())).alias("e"))
    named = long.select(entity, F.element_at(names, F.col("e.no") + 1).alias("n"), F.col("e.id").alias(id_name))
    return named.select(entity, *[F.col(f"n.{k}").alias(k) for k in key_names], id_name)
