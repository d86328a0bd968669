"""A lazy, immutable frame of sequences: a DataFrame with metadata, and verbs grouped in namespaces."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bio, extract
from .operators import relational as R
from .operators.checks import check_expression, check_name
from .scoring import BATCH_SIZE, Scorer, score
from .session import staged
from .sources import readers, writers

META_KEY = "strandflow"
MOLECULES = ("protein", "dna", "rna", "unknown")


@dataclass(frozen=True)
class FrameMeta:
    """What a frame is about; kept in the sequence column's field metadata, which Parquet files carry along."""

    sequence_column: str = "sequence"
    id_column: str = "id"
    molecule_type: str = "unknown"
    alphabet: str | None = None
    created_by: str = "strandflow"
    extensions: Mapping[str, Any] = field(default_factory=dict)
    version: str = "0.1"

    def __post_init__(self) -> None:
        if self.molecule_type not in MOLECULES:
            raise ValueError(f"unknown molecule type {self.molecule_type!r}")


def normalize(df: DataFrame, sequence_column: str = "sequence", id_column: str = "id") -> DataFrame:
    """Rows with the canonical columns id, sequence, sequence_hash, length first, and all others after them.

    id is the first of the id column, ``id`` and ``sequence_id`` that isn't null, else ``seq_<row number>``.
    Map and struct columns become JSON. A missing sequence column, null sequences and no rows raise ValueError.
    """
    seq = next((c for c in (sequence_column, "sequence") if c in df.columns), None)
    if seq is None:
        raise ValueError(f"no sequence column {sequence_column!r}; there are {df.columns}")
    if df.isEmpty():
        raise ValueError("no rows")
    if not df.where(F.col(seq).isNull()).isEmpty():
        raise ValueError("a row has no sequence")
    ids = [F.col(c).cast("string") for c in dict.fromkeys((id_column, "id", "sequence_id")) if c in df.columns]
    rid = F.coalesce(*ids) if ids else F.lit(None).cast("string")
    if not ids or not df.where(rid.isNull()).isEmpty():
        numbered = R.number_rows(df.withColumn("_n", F.monotonically_increasing_id()), 1, [F.col("_n")], "_row").drop("_n")
        df, rid = numbered, F.coalesce(*ids, F.concat(F.lit("seq_"), F.col("_row").cast("string")))
    done = {seq, id_column, "id", "sequence_id", "sequence_hash", "length", "_row"}
    rest = [F.to_json(F.col(c)).alias(c) if df.schema[c].dataType.typeName() in ("map", "struct") else F.col(c) for c in df.columns if c not in done]
    s = F.col(seq).cast("string")
    return df.select(rid.alias("id"), s.alias("sequence"), bio.sequence_hash(s).alias("sequence_hash"), bio.sequence_length(s).alias("length"), *rest)


def infer_molecule(df: DataFrame, column: str = "sequence") -> str:
    """The only type other than unknown that the sequences have, else unknown."""
    kinds = df.agg(F.collect_set(bio.detect_type(column)).alias("k")).first()["k"] or []
    known = [k for k in kinds if k != "unknown"]
    return known[0] if len(known) == 1 else "unknown"


class SequenceFrame:
    """Every verb gives a new frame; nothing runs before ``collect``, ``count`` or a write."""

    def __init__(self, df: DataFrame, meta: FrameMeta | None = None):
        self.df, self.meta = df, meta or FrameMeta()

    # --- making frames ---

    @classmethod
    def wrap(cls, df: DataFrame, molecule_type: str | None = None, **normal: str) -> SequenceFrame:
        out = normalize(df, **normal)
        return cls(out, FrameMeta(molecule_type=molecule_type or infer_molecule(out)))

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Sequence[Mapping[str, Any]], **options: Any) -> SequenceFrame:
        if not rows:
            raise ValueError("no rows")
        names = list(dict.fromkeys(k for r in rows for k in r))
        flat = [tuple(json.dumps(v) if isinstance(v := r.get(k), dict) else v for k in names) for r in rows]
        return cls.wrap(spark.createDataFrame(flat, names), **options)

    @classmethod
    def from_fasta(cls, spark: SparkSession, path: str, **options: Any) -> SequenceFrame:
        return cls.wrap(readers.read_fasta(spark, path), **options)

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, sequence_column: str = "sequence", **options: Any) -> SequenceFrame:
        return cls.wrap(readers.read_csv_strings(spark, path, sequence_column), sequence_column=sequence_column, **options)

    @classmethod
    def from_json(cls, spark: SparkSession, path: str, **options: Any) -> SequenceFrame:
        return cls.wrap(readers.read_json_rows(spark, path), **options)

    @classmethod
    def from_run_result(cls, spark: SparkSession, path: str, **options: Any) -> SequenceFrame:
        df = readers.read_run_result(spark, path)
        seq, rid = readers.infer_columns(df.columns)
        if seq is None:
            raise ValueError(f"no sequence column among {df.columns}")
        return cls.wrap(df, sequence_column=seq, id_column=rid or "id", **options)

    @classmethod
    def from_lab(cls, df: DataFrame, records: str = "records") -> SequenceFrame:
        rows = readers.lab_rows(df, records)
        return cls.wrap(rows, molecule_type=readers.lab_molecule_type(rows))

    @classmethod
    def from_dataset(cls, catalog: readers.Catalog, key: str) -> SequenceFrame:
        return cls.read(catalog.spark, catalog.frame_path(key))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> SequenceFrame:
        """A frame that ``write`` wrote; Parquet without its metadata raises ValueError."""
        df = spark.read.parquet(path)
        for f in df.schema:
            if META_KEY in f.metadata:
                return cls(df, FrameMeta(**json.loads(f.metadata[META_KEY])))
        raise ValueError(f"{path} has no frame metadata")

    # --- verbs on the whole ---

    def then(self, df: DataFrame, **meta: Any) -> SequenceFrame:
        return SequenceFrame(df, replace(self.meta, **meta) if meta else self.meta)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def count(self) -> int:
        return self.df.count()

    def shape(self) -> tuple[int, int]:
        return self.df.count(), len(self.df.columns)

    def head(self, n: int = 5) -> DataFrame:
        return self.df.limit(max(0, n))

    def collect(self) -> list[dict[str, Any]]:
        return [r.asDict(recursive=True) for r in self.df.collect()]

    def write(self, path: str, mode: str = "errorifexists") -> SequenceFrame:
        """Parquet with the metadata; gives the frame over what was written, with an empty plan."""
        c = self.meta.sequence_column
        body = json.dumps(asdict(self.meta))
        cols = [F.col(x).alias(x, metadata={META_KEY: body}) if x == c else F.col(x) for x in self.df.columns]
        self.df.select(*cols).write.mode(mode).parquet(path)
        return SequenceFrame.read(self.df.sparkSession, path)

    def merge_columns(self, other: DataFrame | SequenceFrame, on: str = "id") -> SequenceFrame:
        return self.then(R.merge_columns(self.df, other.df if isinstance(other, SequenceFrame) else other, on))

    def add_column(self, name: str, expr: str) -> SequenceFrame:
        return self.then(self.df.withColumn(check_name(name), F.expr(check_expression(expr))))

    @cached_property
    def query(self) -> Query:
        return Query(self)

    @cached_property
    def bio(self) -> Bio:
        return Bio(self)

    @cached_property
    def io(self) -> Io:
        return Io(self)

    @cached_property
    def models(self) -> Models:
        return Models(self)

    @cached_property
    def protocols(self) -> Protocols:
        return Protocols(self)

    @cached_property
    def lab(self) -> Lab:
        return Lab(self)


class _Namespace:
    def __init__(self, frame: SequenceFrame):
        self.frame, self.df = frame, frame.df


class Query(_Namespace):
    """Relational verbs."""

    def select(self, *columns: str) -> SequenceFrame:
        """Columns by name, or one comma-separated string of names."""
        names = [c.strip() for x in columns for c in x.split(",")]
        return self.frame.then(self.df.select(*[check_name(c) for c in names]))

    def filter(self, expr: str) -> SequenceFrame:
        """Rows for which a SQL predicate holds."""
        return self.frame.then(self.df.where(F.expr(check_expression(expr))))

    def join(self, other: SequenceFrame, on: str = "sequence_hash", how: str = "inner") -> SequenceFrame:
        right = other.df.select(*[c for c in other.df.columns if c == on or c not in self.df.columns])
        return self.frame.then(R.join_using(self.df, right, on, how))

    def sort(self, *by: str, ascending: bool = True) -> SequenceFrame:
        """One direction for all columns; nulls last in both."""
        keys = [F.col(check_name(c)) for c in by]
        return self.frame.then(self.df.orderBy(*[k.asc_nulls_last() if ascending else k.desc_nulls_last() for k in keys]))

    def limit(self, n: int) -> SequenceFrame:
        if n < 0:
            raise ValueError("limit must not be negative")
        return self.frame.then(self.df.limit(n))

    def group_by(self, *columns: str, agg: Mapping[str, str]) -> SequenceFrame:
        """Aggregates as {name: SQL expression}; at least one."""
        if not agg:
            raise ValueError("give at least one aggregate")
        aggs = [F.expr(check_expression(e)).alias(check_name(n)) for n, e in agg.items()]
        return self.frame.then(self.df.groupBy(*[check_name(c) for c in columns]).agg(*aggs))


class Bio(_Namespace):
    """Sequence functions as lazy columns."""

    def _c(self) -> str:
        return self.frame.meta.sequence_column

    def length(self, name: str = "length") -> SequenceFrame:
        return self.frame.then(self.df.withColumn(name, bio.sequence_length(self._c())))

    def detect_type(self, name: str = "molecule_type") -> SequenceFrame:
        return self.frame.then(self.df.withColumn(name, bio.detect_type(self._c())))

    def reverse_complement(self, name: str = "reverse_complement") -> SequenceFrame:
        if self.frame.meta.molecule_type == "protein":
            raise ValueError("a protein has no reverse complement")
        return self.frame.then(self.df.withColumn(name, bio.reverse_complement(self._c())))

    def translate(self, name: str = "protein") -> SequenceFrame:
        if self.frame.meta.molecule_type == "protein":
            raise ValueError("a protein can't be translated")
        return self.frame.then(self.df.withColumn(name, bio.translate_codons(self._c())))


class Models(_Namespace):
    """Columns from a scorer, by the frame's id."""

    def _scored(self, scorer: Scorer, action: str, params: dict[str, Any] | None, batch_size: int, value: Column, column: str) -> SequenceFrame:
        m = self.frame.meta
        got = staged(score(self.df, scorer, action, [m.sequence_column], m.id_column, params, batch_size), "responses")
        return self.frame.merge_columns(got.select(F.col(m.id_column), value.alias(check_name(column))), m.id_column)

    def predict(self, scorer: Scorer, column: str | None = None, action: str = "predict", params: dict[str, Any] | None = None, batch_size: int = BATCH_SIZE) -> SequenceFrame:
        """Adds the response's one value as text (``extract.first_scalar``), under ``<model>_<action>`` unless named."""
        return self._scored(scorer, action, params, batch_size, extract.first_scalar("response", action == "encode"), column or re.sub(r"\W", "_", f"{scorer.name}_{action}"))

    def embed(self, scorer: Scorer, column: str | None = None, layer: int | None = None, params: dict[str, Any] | None = None, batch_size: int = BATCH_SIZE) -> SequenceFrame:
        """Adds the response's vector, of the asked layer if it has several, under ``<model>_embedding`` unless named."""
        value = F.coalesce(extract.embedding("response", "embedding", layer), extract.embedding("response", "embeddings", layer))
        given = {**(params or {}), **({} if layer is None else {"layer": layer})}
        return self._scored(scorer, "encode", given, batch_size, value, column or re.sub(r"\W", "_", f"{scorer.name}_embedding"))


class Protocols(_Namespace):
    """Protocol runs joined back."""

    def run(self, protocol: Any, inputs: Mapping[str, Any], scorers: Mapping[str, Scorer], path: str, join_on: str = "id", **options: Any) -> SequenceFrame:
        """Runs a protocol over a store at ``path`` and joins the rows it selects to this frame (left)."""
        from .plans.protocols import run_protocol

        run = run_protocol(self.df.sparkSession, protocol, inputs, scorers, path, **options)
        return self.frame.query.join(SequenceFrame(run.selected, self.frame.meta), join_on, "left")


class Lab(_Namespace):
    """Lab results joined back."""

    def merge(self, other: SequenceFrame, on: str = "id", how: str = "left") -> SequenceFrame:
        return self.frame.query.join(other, on, how)


class Io(_Namespace):
    """Sinks."""

    def to_parquet(self, path: str, mode: str = "errorifexists") -> SequenceFrame:
        return self.frame.write(path, mode)

    def to_fasta(self, path: str, metadata: Sequence[str] = (), **options: Any) -> None:
        writers.write_fasta(self.df, path, sequence=self.frame.meta.sequence_column, id_column=self.frame.meta.id_column, metadata=list(metadata), **options)

    def to_csv(self, path: str, mode: str = "errorifexists") -> None:
        writers.write_csv(self.df, path, mode)

    def to_json(self, path: str, mode: str = "errorifexists") -> None:
        writers.write_json(self.df, path, mode)

    def to_dataset(self, root: str, dataset_id: str, force: bool = False, **options: Any) -> str:
        c = self.frame.meta.sequence_column
        body = json.dumps(asdict(self.frame.meta))
        df = self.df.select(*[F.col(x).alias(x, metadata={META_KEY: body}) if x == c else F.col(x) for x in self.df.columns])
        return writers.write_dataset(df, root, dataset_id, force=force, **options)

    def to_order(self, service_id: str, name: str | None = None) -> dict[str, Any]:
        return writers.order_payload(self.df, service_id, name)
