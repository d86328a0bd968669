"""Readers: FASTA, CSV, JSON, PDB, plain text, result files, lab envelopes, and dataset folders."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEQUENCE_NAMES = ("sequence", "seq", "protein_sequence", "dna_sequence")
ID_NAMES = ("id", "sequence_id", "name", "identifier")


def _not_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no records in {what}")
    return df


def read_fasta(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """(id, sequence, description, metadata) of FASTA files; files are split between tasks, never read whole.

    A record ends where a line begins with '>'; its sequence lines are joined and trimmed. A header
    ``id|a|b`` gives metadata {metadata_1: a, metadata_2: b}; ``id text`` gives a description; an empty
    one the id 'sequence'. Records without sequence are dropped. Lines before the first header are a
    record named ``sequence_1``. With ``check``, files without records raise ValueError.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    # Every record but a file's first lost its '>' to the separator; the first keeps it, or has no header.
    firsts = raw.where("at = 0").groupBy("f").agg(F.min("n").alias("n")).select("n", F.lit(True).alias("first"))
    lines = F.transform(F.split("value", r"\r\n|\r|\n"), lambda x: F.trim(x))
    full = lambda c: F.filter(c, lambda x: x != "")
    rest = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
    # A file's first record may come after blank lines; of others the first line is the header, even if blank.
    rec = raw.select("n", lines.alias("l")).join(firsts, "n", "left").withColumn("l", F.when(F.col("first"), full(F.col("l"))).otherwise(F.col("l"))).where(F.size("l") > 0)
    bare = F.col("first").isNotNull() & ~F.startswith(F.element_at("l", 1), F.lit(">"))
    head = F.when(bare, None).otherwise(F.trim(F.regexp_replace(F.element_at(F.col("l"), 1), r"^>+", "")))
    body = full(F.when(bare, F.col("l")).otherwise(rest(F.col("l"))))
    rec = rec.select("n", head.alias("h"), F.array_join(body, "").alias("sequence")).where(F.length("sequence") > 0)
    parts = F.transform(F.split("h", r"\|"), lambda x: F.trim(x))
    meta = F.map_from_entries(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x, i: F.struct(F.concat(F.lit("metadata_"), (i + 1).cast("string")).alias("k"), x.alias("v"))))
    piped = F.col("h").contains("|")
    rid = F.when(F.col("h").isNull(), "sequence_1").when(F.col("h") == "", "sequence").when(piped, F.element_at(parts, 1)).otherwise(F.element_at(F.split("h", " ", 2), 1))
    desc = F.when(~piped & F.col("h").contains(" "), F.trim(F.element_at(F.split("h", " ", 2), 2)))
    out = rec.select(rid.alias("id"), "sequence", desc.alias("description"), F.when(piped, meta).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"))
    return _not_empty(out, path) if check else out


def read_csv_strings(spark: SparkSession, path: str, sequence_key: str | None = "sequence", check: bool = True) -> DataFrame:
    """CSV with a header, every value a string, missing ones ''. A missing sequence column or no rows raise ValueError."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if sequence_key and sequence_key not in df.columns:
        raise ValueError(f"no column {sequence_key!r}; there are {df.columns}")
    out = df.na.fill("")
    return _not_empty(out, path) if check else out


def read_json_rows(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Rows of JSON: an object, an array, one object a line, or an envelope {"items": [...]} or {"query": [...]}.

    Files by suffix: ``.jsonl`` and ``.jsonl.gz`` are read line by line and split between tasks; others as
    one document each. Entries that aren't objects raise ValueError.
    """
    lines = path.endswith((".jsonl", ".jsonl.gz", ".ndjson"))
    df = spark.read.option("mode", "FAILFAST" if check else "PERMISSIVE").option("multiLine", not lines).json(path)
    if "_corrupt_record" in df.columns:
        df = spark.read.option("mode", "FAILFAST" if check else "PERMISSIVE").json(path)
    for key in ("items", "query"):
        if df.columns == [key] and df.schema[key].dataType.typeName() == "array":
            if df.schema[key].dataType.elementType.typeName() != "struct":
                raise ValueError("an entry is not an object")
            df = df.select(F.explode(key).alias("r")).select("r.*")
    if not df.columns:
        raise ValueError(f"no objects in {path}")
    return _not_empty(df, path) if check else df


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """(pdb): one row per MODEL/ENDMDL block with the lines before the first; a file without models is one row.

    Lines between models and after the last are left out. A blank file raises ValueError.
    """
    raw = spark.read.text(path, wholetext=True)
    text = F.regexp_replace("value", r"\r\n?", "\n")
    models = F.regexp_extract_all(text, F.lit(r"(?s)(?:^|\n)(MODEL.*?\nENDMDL[^\n]*)"), F.lit(1))
    has = F.contains(text, F.lit("MODEL")) & F.contains(text, F.lit("ENDMDL")) & (F.size(models) > 0)
    rows = raw.where(F.trim("value") != "").select(F.explode(F.when(has, models).otherwise(F.array(text))).alias("pdb"))
    return _not_empty(rows.select(F.regexp_replace("pdb", r"^\s+|\s+$", "").alias("pdb")).where("pdb <> ''"), path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(sequence) by suffix: FASTA, CSV with a column 'sequence', or text with one sequence a line."""
    suffix = Path(path).suffix.lower()
    if suffix in (".fasta", ".fa", ".faa", ".fna"):
        return read_fasta(spark, path).select("sequence")
    if suffix == ".csv":
        return read_csv_strings(spark, path).select("sequence")
    if suffix == ".txt":
        return spark.read.text(path).select(F.trim("value").alias("sequence")).where("sequence <> ''")
    raise ValueError(f"unknown suffix {suffix!r}")


def infer_columns(columns: list[str]) -> tuple[str | None, str | None]:
    """(sequence column, id column) among the names that tools use."""
    low = {c.lower(): c for c in reversed(columns)}
    pick = lambda names: next((low[n] for n in names if n in low), None)
    return pick(SEQUENCE_NAMES), pick(ID_NAMES)


def read_run_result(spark: SparkSession, path: str) -> DataFrame:
    """A run's result table: a CSV, or the first CSV of a zip (read on the driver, as archives are single files)."""
    if path.endswith(".zip"):
        import io

        import pandas as pd

        with zipfile.ZipFile(path) as z:
            name = next((n for n in sorted(z.namelist()) if n.endswith(".csv")), None)
            if name is None:
                raise ValueError("no CSV in the archive")
            return spark.createDataFrame(pd.read_csv(io.BytesIO(z.read(name))))
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def read_results(spark: SparkSession, source: Any) -> DataFrame:
    """Result records from a list of dicts, a JSONL file (also .gz), or the first .jsonl of a zip."""
    if isinstance(source, list):
        return spark.createDataFrame([json.dumps(r) for r in source], "string").transform(lambda d: spark.read.json(d.rdd.map(lambda r: r[0]))) if source else spark.createDataFrame([], "id string")
    if str(source).endswith(".zip"):
        with zipfile.ZipFile(source) as z:
            name = next((n for n in sorted(z.namelist()) if n.endswith(".jsonl")), None)
            if name is None:
                raise ValueError("no .jsonl in the archive")
            return read_results(spark, [json.loads(x) for x in z.read(name).decode().splitlines() if x.strip()])
    return spark.read.json(str(source))


def lab_rows(df: DataFrame, records: str = "records", max_keys: int = 5000) -> DataFrame:
    """Lab result records, one JSON text per row, as a wide frame.

    Each record's entity id (or its construct name) becomes id; its representation, if it differs from the
    id, the sequence; tags, metrics and parameters become columns tag_*, metric_* and param_*. The keys
    are discovered first, as a frame needs fixed columns; more than ``max_keys`` of one kind raise ValueError.
    """
    schema = "array<struct<entity:struct<entity_id:string,type:string,representation:string>,tags:map<string,string>,metrics:map<string,double>,parameters:map<string,string>>>"
    r = df.select(F.explode(F.from_json(records, schema)).alias("r")).select("r.*")
    rid = F.coalesce(F.nullif(F.col("entity.entity_id"), F.lit("")), F.nullif(F.col("tags")["construct_name"], F.lit("")), F.concat(F.lit("row_"), F.monotonically_increasing_id().cast("string")))
    rep = F.col("entity.representation")
    cols = [rid.alias("id"), F.when(rep.isNotNull() & (rep != rid) & (rep != ""), rep).otherwise(rid).alias("sequence"), F.col("entity.type").alias("entity_type")]
    for field, prefix in (("tags", "tag_"), ("metrics", "metric_"), ("parameters", "param_")):
        keys = sorted(x[0] for x in r.select(F.explode(F.map_keys(field)).alias("k")).distinct().limit(max_keys + 1).collect())
        if len(keys) > max_keys:
            raise ValueError(f"more than {max_keys} keys in {field}: raise max_keys or read in parts")
        cols += [F.col(field)[k].alias(prefix + k) for k in keys]
    return r.select(*cols)


def lab_molecule_type(df: DataFrame) -> str:
    """The molecule type that the records' entity types imply."""
    kinds = {r[0] for r in df.select("entity_type").where(F.col("entity_type").isin("dna_sequence", "protein", "aa_sequence")).distinct().collect()}
    return "dna" if "dna_sequence" in kinds else "protein" if kinds & {"protein", "aa_sequence"} else "unknown"


def read_yaml(path: str | Path) -> dict:
    """A YAML (or JSON) document."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml
    except ImportError as e:
        try:
            return json.loads(text)
        except ValueError:
            raise RuntimeError("reading YAML needs the yaml package") from e
    return yaml.safe_load(text) or {}


class Catalog:
    """Dataset folders: every folder under ``root`` with a dataset.yaml (id, type, tags, attrs)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)

    def entries(self) -> list[dict[str, Any]]:
        """All datasets by id; two with one id raise ValueError."""
        out: dict[str, dict[str, Any]] = {}
        for p in sorted(self.root.rglob("dataset.yaml")):
            d = read_yaml(p)
            key = str(d.get("id") or p.parent.name)
            if key in out:
                raise ValueError(f"dataset id {key!r} occurs twice")
            out[key] = {"id": key, "type": d.get("type"), "tags": [str(t) for t in d.get("tags") or []], "attrs": d.get("attrs") or {}, "path": str(p.parent)}
        return list(out.values())

    def listing(self, kind: str | None = None, tag: str | None = None) -> DataFrame:
        """(id, type, tags, path), filtered by type and tag."""
        df = self.spark.createDataFrame([(e["id"], e["type"], e["tags"], e["path"]) for e in self.entries()], "id string, type string, tags array<string>, path string")
        if kind is not None:
            df = df.where(F.col("type") == kind)
        return df.where(F.array_contains("tags", tag)) if tag is not None else df

    def get(self, key: str) -> dict[str, Any]:
        """A dataset by id or path."""
        for e in self.entries():
            if key in (e["id"], e["path"]):
                return e
        raise KeyError(key)

    def frame_path(self, key: str) -> str:
        """The dataset's frame: attrs.frame_path, or its only Parquet file or folder."""
        e = self.get(key)
        if p := e["attrs"].get("frame_path"):
            return str(Path(e["path"], p))
        found = sorted(Path(e["path"]).glob("*.parquet"))
        if len(found) != 1:
            raise ValueError(f"dataset {key!r} has {len(found)} Parquet files; name one in attrs.frame_path")
        return str(found[0])
