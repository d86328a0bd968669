"""Values, vectors, matrices and structures taken out of scorers' JSON responses, in the JVM."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import reduce_rows, reduce_values

REDUCTIONS = ("mean", "max", "min", "sum")
# Keys that a response may hold its one number under, in order of precedence.
SCALAR_KEYS = ("value", "score", "prediction", "log_prob", "embedding")
STRUCTURE_KEYS = ("pdb", "cif", "structure", "pdb_string", "mmcif")
EMBEDDING_KEYS = ("embedding", "embeddings", "mean_representations", "seqcoding")


@dataclass(frozen=True)
class Extraction:
    """The number under ``key`` goes to ``column``; an array needs a reduction."""

    key: str
    column: str
    reduction: str | None = None

    def __post_init__(self) -> None:
        if self.reduction is not None and self.reduction not in REDUCTIONS:
            raise ValueError(f"unknown reduction {self.reduction!r}")


def resolve(extractions: str | Sequence[str | Extraction], columns: str | Mapping[str, str] | None = None) -> list[Extraction]:
    """Extractions with their column names.

    One name for ``columns`` goes with one extraction; a mapping must name extracted keys only; keys occur once.
    """
    items = [extractions] if isinstance(extractions, str) else list(extractions)
    keys = [x if isinstance(x, str) else x.key for x in items]
    if len(set(keys)) < len(keys):
        raise ValueError("a response key occurs twice")
    if isinstance(columns, str):
        if len(items) != 1:
            raise ValueError("one column name goes with one extraction")
        names: Mapping[str, str] = {keys[0]: columns}
    else:
        names = columns or {}
        if unknown := set(names) - set(keys):
            raise ValueError(f"columns for keys that aren't extracted: {sorted(unknown)}")
    out = []
    for x, k in zip(items, keys):
        own = k if isinstance(x, str) else x.column
        out.append(Extraction(k, names.get(k, own), None if isinstance(x, str) else x.reduction))
    return out


def at_path(json_column: Column | str, path: str) -> Column:
    """Text at a dotted path of a JSON column; null where a step is missing."""
    c = F.col(json_column) if isinstance(json_column, str) else json_column
    return F.get_json_object(c, "$." + path)


def scalar(json_column: Column | str, key: str, reduction: str | None = None) -> Column:
    """The number under a key. An array gives null without a reduction; with one, a level of nesting is flattened first."""
    raw = at_path(json_column, key)
    plain = raw.try_cast("double")
    if reduction is None:
        return plain
    nested = F.flatten(F.from_json(raw, "array<array<double>>"))
    flat = F.from_json(raw, "array<double>")
    values = F.when(raw.rlike(r"^\s*\[\s*\["), nested).otherwise(flat)
    return F.when(raw.startswith("["), reduce_values(F.filter(values, lambda x: x.isNotNull()), reduction)).otherwise(plain)


def first_scalar(json_column: Column | str, encode: bool = False) -> Column:
    """The response's one value as text: the first known key, or the only key's value."""
    c = F.col(json_column) if isinstance(json_column, str) else json_column
    keys = (*(("embeddings",) if encode else ()), *SCALAR_KEYS)
    names = F.json_object_keys(c)
    only = F.when(F.size(names) == 1, F.element_at(F.map_values(F.from_json(c, "map<string,string>")), 1))
    return F.coalesce(*[F.get_json_object(c, f"$.{k}") for k in keys], only)


def embedding(json_column: Column | str, key: str = "embedding", layer: int | None = None, reduction: str | None = None) -> Column:
    """A vector (array<double>) under a key.

    A list of {layer, embedding} gives the asked layer, or its last entry; a matrix needs a reduction of
    its rows (mean, sum, first, last) and is null without one.
    """
    raw = at_path(json_column, key)
    layered = F.from_json(raw, "array<struct<layer:int,embedding:array<double>>>")
    chosen = F.filter(layered, lambda x: x["layer"] == layer) if layer is not None else layered
    matrix = F.from_json(raw, "array<array<double>>")
    from_matrix = reduce_rows(matrix, reduction) if reduction else F.lit(None).cast("array<double>")
    flat = F.from_json(raw, "array<double>")
    return F.when(raw.rlike(r"^\s*\[\s*\{"), F.when(F.size(chosen) > 0, F.element_at(chosen, -1)["embedding"])).when(raw.rlike(r"^\s*\[\s*\["), from_matrix).otherwise(flat)


def embedding_by(function: Callable[[Any], Sequence[float] | None], json_column: Column | str) -> Column:
    """A vector (array<double>) that a function takes out of the parsed response, in Arrow batches; None gives null."""

    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[float] | None:
            v = None if t is None else function(json.loads(t))
            return None if v is None else [float(x) for x in v]

        return pd.Series([one(t) for t in texts], dtype=object)

    return F.pandas_udf(run, "array<double>")(json_column)


def unpivot_matrix(df: DataFrame, ids: Sequence[str], values: str, rows: str, cols: str, prefix: str = "") -> DataFrame:
    """(ids, prediction_type, value): each cell of a matrix as ``<prefix><row><position><column>``; position is 1-based.

    ``values`` is an array of arrays, ``rows`` and ``cols`` its labels. Null cells are left out.
    """
    r = df.select(*ids, F.col(rows).alias("_r"), F.col(cols).alias("_c"), F.posexplode(values).alias("_i", "_row"))
    c = r.select(*ids, "_r", "_c", "_i", F.posexplode("_row").alias("_j", "value"))
    name = F.concat(F.lit(prefix), F.element_at("_r", F.col("_i") + 1), (F.col("_i") + 1).cast("string"), F.element_at("_c", F.col("_j") + 1))
    return c.where("value is not null").select(*ids, name.alias("prediction_type"), F.col("value").cast("double").alias("value"))


def unpivot_list(df: DataFrame, ids: Sequence[str], items: str, prefix: str = "") -> DataFrame:
    """(ids, prediction_type, value) of a JSON list of {mutation, value}."""
    x = df.select(*ids, F.explode(F.from_json(items, "array<struct<mutation:string,value:double>>")).alias("_x"))
    return x.where("_x.value is not null").select(*ids, F.concat(F.lit(prefix), "_x.mutation").alias("prediction_type"), F.col("_x.value").alias("value"))


def structure(json_column: Column | str, key: str = "pdb", index: int = 0, plddt_key: str | None = None) -> Column:
    """struct(format, structure_str, plddt) under a key: a text, or an entry of a list of texts."""
    raw = at_path(json_column, key)
    listed = F.from_json(raw, "array<string>")
    text = F.when(raw.startswith("["), F.get(listed, F.lit(index))).otherwise(raw)
    kind = "cif" if "cif" in key.lower() else "pdb"
    score = scalar(json_column, plddt_key, "mean") if plddt_key else F.lit(None).cast("double")
    return F.when(text.isNotNull(), F.struct(F.lit(kind).alias("format"), text.alias("structure_str"), score.alias("plddt")))


def flatten_generated(json_column: Column | str) -> Column:
    """array<struct(sequence, log_prob)> of a generator's response.

    Forms: an object with ``sequence``, or with ``sequences`` of texts, objects or {heavy, light} pairs
    (joined by ':'); a list of these; and a list of lists.
    """
    c = F.col(json_column) if isinstance(json_column, str) else json_column
    one = "struct<sequence:string,heavy:string,light:string,log_prob:double,score:double>"

    def seq(x: Column) -> Column:
        s = F.coalesce(x["sequence"], F.when(x["heavy"].isNotNull() | x["light"].isNotNull(), F.concat_ws(":", x["heavy"], x["light"])))
        return F.struct(s.alias("sequence"), F.coalesce(x["log_prob"], x["score"]).alias("log_prob"))

    def texts(j: Column) -> Column:
        return F.transform(F.from_json(j, "array<string>"), lambda x: F.struct(x.alias("sequence"), F.lit(None).cast("double").alias("log_prob")))

    def items(j: Column) -> Column:
        return F.when(j.rlike(r'^\s*\[\s*"'), texts(j)).otherwise(F.transform(F.from_json(j, f"array<{one}>"), seq))

    inner = F.get_json_object(c, "$.sequences")
    nested = F.flatten(F.transform(F.from_json(c, f"array<array<{one}>>"), lambda r: F.transform(r, seq)))
    listed_inner = F.flatten(F.transform(F.from_json(c, f"array<struct<sequences:array<{one}>>>"), lambda r: F.transform(r["sequences"], seq)))
    single = F.array(seq(F.from_json(c, one)))
    got = F.when(c.rlike(r"^\s*\[\s*\["), nested).when(c.rlike(r'^\s*\[\s*\{\s*"sequences"'), listed_inner).when(c.rlike(r"^\s*\["), items(c)).when(inner.isNotNull(), items(inner)).otherwise(single)
    return F.filter(got, lambda x: x["sequence"].isNotNull() & (x["sequence"] != ""))


def payload(columns: Mapping[str, str], params: Mapping[str, Any] | None = None) -> Column:
    """A request {items: [{field: column...}], params} as JSON."""
    item = F.struct(*[F.col(c).alias(f) for f, c in columns.items()])
    parts = [F.array(item).alias("items")]
    body = F.to_json(F.struct(*parts))
    if params:
        return F.concat(F.regexp_replace(body, r"\}$", ""), F.lit(',"params":' + json.dumps(dict(params), sort_keys=True) + "}"))
    return body


_TAIL = re.compile(r"\.|\[\*\]")


def path_tail(path: str) -> str:
    """The last field of a response path: 'results[*].pdb' and 'response.pdb' give 'pdb'."""
    parts = [p for p in _TAIL.split(path.strip()) if p]
    return parts[-1] if parts else path


def classify(key: str) -> str:
    """structure, embedding or scalar, by the name of a response key."""
    low = key.lower()
    if low in STRUCTURE_KEYS or "pdb" in low or "cif" in low:
        return "structure"
    return "embedding" if low in EMBEDDING_KEYS else "scalar"


def parse_mapping(mapping: Mapping[str, Any]) -> list[tuple[str, str, str]]:
    """(column, response key, kind) for each entry: a key, a path, a '${{ path }}' or {path: ...}."""
    out = []
    for column, value in mapping.items():
        if isinstance(value, Mapping):
            value = value.get("path") or value.get("jmespath") or ""
            if not value:
                raise ValueError(f"the mapping of {column!r} has no path")
        if not isinstance(value, str):
            raise ValueError(f"the mapping of {column!r} must be a text or have a path")
        if value.startswith("${{") and value.endswith("}}"):
            value = value[3:-2].strip()
        key = path_tail(value)
        out.append((column, key, classify(key)))
    return out
