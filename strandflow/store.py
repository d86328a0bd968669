"""A store of sequences, scores, embeddings and provenance in append-only Parquet tables.

Every table is a folder of Parquet files; a write appends files and never changes old ones. Reads go
through views that keep, of the rows of one key, what an upsert would have kept. ``compact`` rewrites a
table to its view when the log has grown. One writer at a time.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bio
from .operators import relational as R
from .operators.checks import check_name, check_select
from .session import staged

# The tables and their columns.
TABLES = {
    "sequences": "sequence_id long, sequence string, length long, hash string, created_at timestamp_ntz",
    "predictions": "prediction_id long, sequence_id long, model_name string, prediction_type string, value double, metadata string, created_at timestamp_ntz",
    "embeddings": "embedding_id long, sequence_id long, model_name string, layer int, values array<float>, dimension int, created_at timestamp_ntz",
    "structures": "structure_id long, sequence_id long, model_name string, format string, structure_str string, plddt double, metadata string, created_at timestamp_ntz",
    "pipeline_runs": "run_id string, pipeline_type string, config string, status string, created_at timestamp_ntz, updated_at timestamp_ntz, definition_id string",
    "stage_completions": "stage_id string, run_id string, stage_name string, status string, input_count long, output_count long, completed_at timestamp_ntz",
    "pipeline_metadata": "key string, value string, created_at timestamp_ntz",
    "generation_metadata": "metadata_id long, sequence_id long, run_id string, model_name string, temperature double, top_k int, top_p double, num_return_sequences int, do_sample boolean, repetition_penalty double, max_length int, sampling_params string, label string, metadata string, created_at timestamp_ntz",
    "filter_results": "filter_id long, run_id string, stage_name string, sequence_id long, passed boolean, created_at timestamp_ntz",
    "sequence_attributes": "sequence_id long, attr_name string, attr_value string",
    "pipeline_context": "run_id string, key string, value string, created_at timestamp_ntz",
    "pipeline_definitions": "definition_id string, pipeline_type string, input_schema_json string, stages_json string, created_at timestamp_ntz",
    "pipeline_blobs": "blob_id string, content string, created_at timestamp_ntz",
    "prediction_column_registry": "column_name string, model_name string, action string, definition_id string, stage_name string, registered_at timestamp_ntz",
}
# Keys under which later rows replace earlier ones, and keys under which the first row stays.
REPLACED = {"embeddings": ["sequence_id", "model_name", "layer"], "pipeline_runs": ["run_id"], "pipeline_metadata": ["key"], "sequence_attributes": ["sequence_id", "attr_name"], "pipeline_context": ["run_id", "key"], "pipeline_definitions": ["definition_id"]}
KEPT = {"stage_completions": ["stage_id"], "generation_metadata": ["sequence_id", "run_id"], "filter_results": ["run_id", "stage_name", "sequence_id"], "pipeline_blobs": ["blob_id"], "prediction_column_registry": ["column_name", "model_name", "action"]}
IDS = {"sequences": "sequence_id", "predictions": "prediction_id", "embeddings": "embedding_id", "structures": "structure_id", "generation_metadata": "metadata_id", "filter_results": "filter_id"}
BATCH = "_batch"


def content_id(value: Any) -> str:
    """32 hex digits of the SHA-256 of a text, or of the JSON with sorted keys."""
    text = value if isinstance(value, str) else json.dumps(value, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:32]


class Store:
    """The tables under a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, str(path).rstrip("/")

    # --- reading and appending ---

    def log(self, table: str) -> DataFrame:
        """All rows ever appended, with the number of the batch that brought them."""
        if table not in TABLES:
            raise ValueError(f"unknown table {table!r}")
        schema = f"{TABLES[table]}, {BATCH} long"
        try:
            if table == "sequences":  # may have grown columns
                return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{table}")
            return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def append(self, table: str, rows: DataFrame) -> None:
        """Appends rows with the table's columns (missing ones as null; created_at as now)."""
        schema = self.spark.createDataFrame([], TABLES[table]).schema
        now = F.lit(datetime.now()).cast("timestamp_ntz")
        cols = []
        for f in schema:
            if f.name in rows.columns:
                cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
            else:
                cols.append((now if f.name in ("created_at", "completed_at", "registered_at") else F.lit(None).cast(f.dataType)).alias(f.name))
        extra = [F.col(c).cast("string").alias(check_name(c)) for c in rows.columns if table == "sequences" and c not in schema.names]
        rows.select(*cols, *extra, F.lit(time.time_ns()).alias(BATCH)).write.mode("append").parquet(f"{self.path}/{table}")

    def table(self, name: str) -> DataFrame:
        """The table as if every write had been an upsert or insert."""
        log = self.log(name)
        order = [BATCH, *([IDS[name]] if name in IDS else [])]
        if name == "predictions":
            keys = ["sequence_id", "prediction_type", "model_name"]
            at = F.struct(BATCH, "prediction_id")
            some = F.col("value").isNotNull()
            row = F.struct("value", "metadata", "created_at")
            best = F.coalesce(F.max_by(F.when(some, row), F.when(some, at)), F.max_by(row, at))
            g = log.groupBy(*keys).agg(F.min("prediction_id").alias("prediction_id"), best.alias("r"))
            return g.select("prediction_id", "sequence_id", "model_name", "prediction_type", "r.value", "r.metadata", "r.created_at")
        if name in REPLACED:
            log = R.latest(log, REPLACED[name], order)
        elif name in KEPT:
            log = R.ordered_first(log, KEPT[name], [F.col(c).asc_nulls_last() for c in order])
        return log.drop(BATCH)

    def compact(self, name: str) -> None:
        """Rewrites a table's log to its view: written beside it first, then swapped in, on any filesystem that Spark reads."""
        rows = self.table(name).withColumn(BATCH, F.lit(0).cast("long"))
        new, now, old = (self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}") for x in (f"_{name}.new", name, f"_{name}.old"))
        fs = now.getFileSystem(self.spark._jsc.hadoopConfiguration())
        rows.write.mode("overwrite").parquet(new.toString())
        fs.delete(old, True)
        if fs.exists(now):
            fs.rename(now, old)
        fs.rename(new, now)
        fs.delete(old, True)

    def next_id(self, table: str) -> int:
        """The largest id given plus one; 1 in an empty table."""
        return (self.log(table).agg(F.max(IDS[table])).first()[0] or 0) + 1

    def query(self, sql: str) -> DataFrame:
        """A SELECT over the tables, as views."""
        check_select(sql)
        for t in TABLES:
            self.table(t).createOrReplaceTempView(t)
        return self.spark.sql(sql)

    # --- sequences ---

    def add_sequences(self, rows: DataFrame, columns: Sequence[str] | None = None, position: str | None = None) -> DataFrame:
        """Adds texts the store lacks; gives ``rows`` with the sequence_id of each, repeats included.

        ``columns`` (several) makes a record of several inputs: its hash is over all, and its text is the
        first one's. Null or empty texts raise ValueError. New ids follow the first position of each text.
        """
        single = not columns or len(columns) == 1
        text = columns[0] if columns else "sequence"
        pos = position or "_pos"
        src = rows if position else rows.withColumn("_pos", F.monotonically_increasing_id())
        src = staged(src.withColumn("hash", bio.store_hash(text) if single else bio.row_hash(columns)), "input")
        if not src.where(F.col("hash").isNull() | (F.length(text) == 0)).isEmpty():
            raise ValueError("null or empty sequence in the input")
        old = self.log("sequences")
        new = R.dedup_new(old, src, F.col("hash"), pos)
        numbered = R.number_rows(new, self.next_id("sequences"), [F.col(pos), F.col("hash")], "sequence_id")
        extra = [c for c in (columns or []) if c != "sequence"] if not single else []
        out = numbered.select("sequence_id", F.col(text).alias("sequence"), F.length(text).cast("long").alias("length"), "hash", *extra)
        if not new.isEmpty():
            self.append("sequences", out)
        # Only the batch's hashes are looked up, so the log is scanned but not moved.
        ids = R.semi_lookup(self.log("sequences").select("hash", "sequence_id"), src.select("hash").distinct(), "hash").groupBy("hash").agg(F.min("sequence_id").alias("sequence_id"))
        return src.drop("sequence_id").join(ids, "hash").drop("hash", *([] if position else ["_pos"]))

    def find(self, sequence: str) -> DataFrame:
        return self.table("sequences").where(F.col("hash") == hashlib.sha256(sequence.encode()).hexdigest()[:32])

    def count_matching(self, texts: DataFrame, column: str = "sequence") -> int:
        return R.count_matching(self.log("sequences"), texts, column).first()[0]

    # --- scores and vectors ---

    def _number(self, table: str, rows: DataFrame) -> DataFrame:
        rows = staged(rows.drop(IDS[table]), table)
        return R.number_rows(rows, self.next_id(table), [F.col("sequence_id").asc_nulls_last(), F.xxhash64(*[c for c in rows.columns if not rows.schema[c].dataType.typeName().startswith("map")])], IDS[table])

    def add_predictions(self, rows: DataFrame) -> None:
        """Rows (sequence_id, prediction_type, model_name, value[, metadata]); NaN counts as null."""
        v = F.col("value").cast("double")
        self.append("predictions", self._number("predictions", rows.withColumn("value", F.when(~F.isnan(v), v))))

    def add_embeddings(self, rows: DataFrame) -> None:
        """Rows (sequence_id, model_name, values[, layer])."""
        self.append("embeddings", self._number("embeddings", rows.withColumn("dimension", F.size("values"))))

    def add_structures(self, rows: DataFrame) -> None:
        self.append("structures", self._number("structures", rows))

    def latest_structures(self) -> DataFrame:
        """The latest structure per sequence; of equal times the larger id."""
        return R.latest(self.table("structures"), ["sequence_id"], ["created_at", "structure_id"])

    def uncached(self, ids: DataFrame, kind: str, model: str) -> DataFrame:
        return R.uncached(ids, self.log("predictions"), kind, model)

    def with_prediction(self, ids: DataFrame, kind: str, model: str | None = None) -> DataFrame:
        return R.with_prediction(ids, self.log("predictions"), kind, model)

    def embeddings_concat(self, models: Sequence[str]) -> DataFrame:
        return R.embeddings_concat(self.table("embeddings"), models)

    def working_frame(self, ids: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
        return R.working_frame(ids, self.table("sequences"), self.table("predictions"), kinds, self.table("generation_metadata"))

    def export_wide(self, kinds: Sequence[str] | None = None) -> DataFrame:
        return R.export_wide(self.table("sequences"), self.table("predictions"), kinds)

    def export_parquet(self, table: str, path: str) -> None:
        self.table(table).write.option("compression", "snappy").parquet(path)

    def export_csv(self, path: str) -> None:
        self.export_wide().write.option("header", True).csv(path)

    # --- provenance and control ---

    def add_generation(self, rows: DataFrame) -> None:
        """Rows (sequence_id, run_id, ...); the first row of a sequence and run stays."""
        self.append("generation_metadata", self._number("generation_metadata", rows))

    def add_filter_results(self, run_id: str, stage: str, passed: DataFrame, seen: DataFrame) -> None:
        """Which of the seen ids passed a stage."""
        rows = seen.select("sequence_id").distinct().join(passed.select("sequence_id").distinct().withColumn("passed", F.lit(True)), "sequence_id", "left").select("sequence_id", F.coalesce("passed", F.lit(False)).alias("passed"))
        self.append("filter_results", self._number("filter_results", rows.withColumns({"run_id": F.lit(run_id), "stage_name": F.lit(stage)})))

    def set_attributes(self, rows: DataFrame) -> None:
        """Rows (sequence_id, attr_name, attr_value); later values replace earlier ones."""
        self.append("sequence_attributes", rows)

    def _one(self, table: str, **row: Any) -> None:
        self.append(table, self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {self._type(table, k)}" for k in row)))

    @staticmethod
    def _type(table: str, column: str) -> str:
        return dict(x.strip().split(" ", 1) for x in TABLES[table].split(", "))[column]

    def put(self, key: str, value: str) -> None:
        self._one("pipeline_metadata", key=key, value=value)

    def get(self, key: str) -> str | None:
        r = self.table("pipeline_metadata").where(F.col("key") == key).first()
        return r["value"] if r else None

    def put_context(self, run_id: str, key: str, value: Any) -> None:
        self._one("pipeline_context", run_id=run_id, key=key, value=json.dumps(value))

    def get_context(self, run_id: str, key: str) -> Any:
        r = self.table("pipeline_context").where((F.col("run_id") == run_id) & (F.col("key") == key)).first()
        return json.loads(r["value"]) if r else None

    def complete_stage(self, run_id: str, stage: str, n_in: int, n_out: int, status: str = "completed") -> None:
        self._one("stage_completions", stage_id=f"{run_id}_{stage}", run_id=run_id, stage_name=stage, status=status, input_count=n_in, output_count=n_out)

    def stage_done(self, run_id: str, stage: str) -> tuple[int, int] | None:
        """(input, output) counts of a completed stage."""
        r = self.table("stage_completions").where((F.col("stage_id") == f"{run_id}_{stage}") & (F.col("status") == "completed")).first()
        return (r["input_count"], r["output_count"]) if r else None

    def set_run(self, run_id: str, status: str, kind: str = "DataPipeline", config: dict | None = None, definition_id: str | None = None) -> None:
        self._one("pipeline_runs", run_id=run_id, pipeline_type=kind, config=json.dumps(config or {}), status=status, definition_id=definition_id)

    def save_definition(self, kind: str, stages: list[dict], input_schema: list[str] | None = None, inline: int = 5000) -> str:
        """Saves a definition under its content hash; texts over ``inline`` characters go to the blob table once."""
        def slim(x: Any) -> Any:
            if isinstance(x, str) and len(x) > inline:
                b = content_id(x)
                self._one("pipeline_blobs", blob_id=b, content=x)
                return {"$blob": b}
            if isinstance(x, dict):
                return {k: slim(v) for k, v in x.items()}
            return [slim(v) for v in x] if isinstance(x, list) else x

        body = slim(stages)
        key = content_id({"type": kind, "stages": body, "inputs": input_schema})
        self._one("pipeline_definitions", definition_id=key, pipeline_type=kind, input_schema_json=json.dumps(input_schema), stages_json=json.dumps(body))
        return key

    def load_definition(self, definition_id: str) -> tuple[str, list[dict]]:
        r = self.table("pipeline_definitions").where(F.col("definition_id") == definition_id).first()
        if r is None:
            raise KeyError(definition_id)

        def full(x: Any) -> Any:
            if isinstance(x, dict):
                if set(x) == {"$blob"}:
                    return self.table("pipeline_blobs").where(F.col("blob_id") == x["$blob"]).first()["content"]
                return {k: full(v) for k, v in x.items()}
            return [full(v) for v in x] if isinstance(x, list) else x

        return r["pipeline_type"], full(json.loads(r["stages_json"]))

    def stats(self) -> DataFrame:
        """(table_name, n_rows) of the main tables."""
        parts = [self.table(t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n_rows")) for t in ("sequences", "predictions", "embeddings", "structures", "generation_metadata")]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
