"""Writers: FASTA, CSV, JSON, PDB, order payloads and dataset folders."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fasta_records(df: DataFrame, sequence: str = "sequence", id_column: str = "id", metadata: list[str] | None = None, wrap: int | None = None) -> DataFrame:
    """(value): '>id|description|other' and the sequence, on one line or wrapped; null metadata is left out."""
    if sequence not in df.columns:
        raise ValueError(f"no column {sequence!r}; there are {df.columns}")
    s = F.col(sequence)
    if wrap:
        s = F.regexp_replace(F.regexp_replace(s, rf"(.{{{wrap}}})", "$1\n"), r"\n$", "")
    rest = sorted(metadata or [], key=lambda c: c != "description")
    rid = F.col(id_column).cast("string") if id_column in df.columns else F.concat(F.lit("sequence_"), (F.monotonically_increasing_id() + 1).cast("string"))
    return df.select(F.concat(F.lit(">"), F.concat_ws("|", rid, *[F.col(c).cast("string") for c in rest]), F.lit("\n"), s).alias("value"))


def write_fasta(df: DataFrame, path: str, mode: str = "errorifexists", **options: Any) -> None:
    fasta_records(df, **options).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header, nulls as ''."""
    df.write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_pdb(df: DataFrame, path: str, column: str = "pdb", mode: str = "errorifexists") -> None:
    """Structure texts one after the other."""
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Snappy Parquet."""
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def order_payload(df: DataFrame, service_id: str, name: str | None = None, max_rows: int = 100_000) -> dict[str, Any]:
    """{service_id, sequences: [{id, sequence, name}]}: an order is one document, so more than ``max_rows`` rows raise ValueError."""
    label = F.coalesce(F.col(name), F.col("id")) if name and name in df.columns else F.col("id")
    rows = df.select("id", "sequence", label.alias("name")).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"an order has at most {max_rows} sequences")
    return {"service_id": service_id, "sequences": [r.asDict() for r in rows]}


def write_dataset(df: DataFrame, root: str, dataset_id: str, kind: str = "sequences", tags: list[str] | None = None, force: bool = False) -> str:
    """A dataset folder with the frame and its dataset.yaml (as JSON, which is YAML); refuses to overwrite unless forced."""
    folder = Path(root, dataset_id)
    if folder.exists() and not force:
        raise FileExistsError(str(folder))
    folder.mkdir(parents=True, exist_ok=True)
    df.write.mode("overwrite" if force else "errorifexists").parquet(str(folder / "frame.parquet"))
    (folder / "dataset.yaml").write_text(json.dumps({"id": dataset_id, "type": kind, "tags": tags or [], "attrs": {"frame_path": "frame.parquet"}}, indent=1))
    return str(folder)
