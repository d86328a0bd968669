"""Scoring of a stream of sequences, micro-batch by micro-batch, into filters and a sink."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import Filter
from ..plans.pipeline import Predict
from ..session import shared_dir
from ..store import Store


def check_streamable(filters: Sequence[Filter]) -> None:
    """ValueError if a filter compares rows with each other."""
    for f in filters:
        if f.needs_all:
            raise ValueError(f"{type(f).__name__} needs all rows and can't follow a stream")


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def score_stream(rows: DataFrame, stage: Predict, filters: Sequence[Filter], out: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None, store: Store | None = None) -> StreamingQuery:
    """Scores each micro-batch of rows (sequence_id, sequence, ...), filters it and writes what is left to ``out``.

    A batch's responses are staged before use, so the scorer is called once per batch. Rows that lack a value
    are dropped. Each batch overwrites its own folder ``out/batch=<n>``, so a batch that runs again after a
    failure leaves no doubles; the checkpoint keeps what was read. With a ``store``, scores are saved there
    too, and rows whose values it has are not scored again. Available input is processed, then the query ends.
    """
    check_streamable(filters)
    spark = rows.sparkSession
    shared_dir(spark)

    def batch(df: DataFrame, n: int) -> None:
        from ..session import staged

        df = staged(df, "batch")
        todo = df
        if store is not None:
            todo = df.join(stage.missing(df.select("sequence_id"), store), "sequence_id", "left_semi").select(df.columns)
        responses = staged(stage.score_rows(todo), "responses")
        if store is not None:
            stage.save(responses, store)
            from ..operators.relational import attach_latest

            wide = attach_latest(df, store.table("predictions").where(F.col("model_name") == stage.scorer.name), stage.columns)
        else:
            wide = df.join(stage.wide(responses).drop("error"), "sequence_id")
        for c in stage.columns:
            wide = wide.where(F.col(c).isNotNull())
        for f in filters:
            wide = f.apply(wide)
        wide.write.mode("overwrite").parquet(f"{out}/batch={n}")
        if on_batch:
            on_batch(spark.read.parquet(f"{out}/batch={n}"), n)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def filter_stream(rows: DataFrame, filters: Sequence[Filter], out: str, checkpoint: str) -> StreamingQuery:
    """Row-wise filters over a stream, appended to a Parquet folder exactly once."""
    check_streamable(filters)
    for f in filters:
        rows = f.apply(rows)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_stream(rows: DataFrame, keys: Sequence[str], order: str, name: str, checkpoint: str) -> StreamingQuery:
    """The latest row per key of a stream, kept up to date in a memory table (complete mode), for small key sets."""
    cols = [c for c in rows.columns if c not in keys]
    agg = rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("r")).select(*keys, "r.*")
    return agg.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
