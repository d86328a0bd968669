"""Output rules: which result rows are selected, their union, and what is logged of them."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bio import annotation_json
from ..operators import sampling
from ..operators.diversity import aggregates
from ..session import staged
from ..sources.readers import read_yaml
from .expressions import evaluate, evaluate_tree, template, where

DEFAULT_LIMIT = 200
POSITION = "_position"


def with_position(df: DataFrame) -> DataFrame:
    """Adds the rows' order of arrival, where they have none yet."""
    return df if POSITION in df.columns else df.withColumn(POSITION, F.monotonically_increasing_id())


def select_rows(df: DataFrame, rule: Mapping[str, Any]) -> DataFrame:
    """The rows that a rule {where, order_by: [{field, order}], limit} selects.

    Sorting is stable by arrival, nulls last; a field that isn't there sorts nothing. The limit is 200 if
    absent, none if null, and may be an expression over the first row.
    """
    df = with_position(df)
    if rule.get("where"):
        df = where(df, rule["where"])
    keys = []
    for o in rule.get("order_by") or []:
        if o.get("field") in df.columns:
            c = F.col(f"`{o['field']}`")
            keys.append(c.desc_nulls_last() if o.get("order", "asc") == "desc" else c.asc_nulls_last())
    keys.append(F.col(POSITION).asc())
    limit = rule.get("limit", DEFAULT_LIMIT)
    if limit is None:
        return df.orderBy(*keys)
    expr = template(str(limit))
    if expr is not None:
        first = df.orderBy(*keys).first()
        limit = int(evaluate(expr, first.asDict())) if first else DEFAULT_LIMIT
    return df.orderBy(*keys).limit(int(limit))


def union_rules(df: DataFrame, rules: Sequence[Mapping[str, Any]]) -> DataFrame:
    """The rows of all rules, equal rows once, in the order in which rules first selected them.

    Without rules there are no rows. A rule's rows are ranked within its limit, or, without one, over range
    partitions, so that they never meet in one task.
    """
    df = with_position(df)
    cols = [c for c in df.columns if c != POSITION]
    out = None
    for i, rule in enumerate(rules):
        sel = select_rows(df, rule)
        keys = []
        for o in rule.get("order_by") or []:
            if o.get("field") in df.columns:
                c = F.col(f"`{o['field']}`")
                keys.append(c.desc_nulls_last() if o.get("order", "asc") == "desc" else c.asc_nulls_last())
        keys.append(F.col(POSITION).asc())
        if rule.get("limit", DEFAULT_LIMIT) is None:
            ranked = sampling.ranked(sel, keys, "_rank")
        else:
            ranked = sel.withColumn("_rank", F.row_number().over(Window.partitionBy(F.lit(i)).orderBy(*keys)).cast("long"))
        ranked = ranked.withColumn("_rule", F.lit(i))
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        return df.limit(0).drop(POSITION)
    first = out.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.min(F.struct("_rule", "_rank")).alias("_o"))
    return first.orderBy("_o").select(*[F.col(f"`{c}`") for c in cols])


def combine_rules(df: DataFrame, rules: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Every selected row with ``params``, ``metrics``, ``tags`` (maps; of a repeated key the last rule wins) and ``artifacts`` (JSON list) of its rules' log entries."""
    df = with_position(df)
    out = None
    for i, rule in enumerate(rules):
        marked = select_rows(df, rule).select(POSITION, F.lit(i).alias("_rule"))
        out = marked if out is None else out.unionByName(marked)
    if out is None:
        out = df.select(POSITION, F.lit(0).alias("_rule")).limit(0)
    chosen = out.groupBy(POSITION).agg(F.array_sort(F.collect_set("_rule")).alias("_rules"))  # at most one entry per rule
    logs = [r.get("log") or {} for r in rules]

    def maps(part: str):
        entries = F.array(*[F.create_map(*[F.lit(x) for k, v in (log.get(part) or {}).items() for x in (str(k), str(v))]).cast("map<string,string>") for log in logs]) if logs else F.array().cast("array<map<string,string>>")
        keys = sorted({str(k) for log in logs for k in (log.get(part) or {})})
        if not keys:
            return F.create_map().cast("map<string,string>").alias(part)

        def last(key: str):
            vals = F.filter(F.transform("_rules", lambda i: F.element_at(F.element_at(entries, i + 1), key)), lambda x: x.isNotNull())
            return F.when(F.size(vals) > 0, F.element_at(vals, -1))

        pick = [x for k in keys for x in (F.lit(k), last(k))]
        return F.map_filter(F.create_map(*pick), lambda k, v: v.isNotNull()).alias(part)

    arts = F.array(*[F.array(*[F.lit(json.dumps(a, sort_keys=True)) for a in log.get("artifacts") or []]).cast("array<string>") for log in logs]) if logs else F.array().cast("array<array<string>>")
    artifacts = F.flatten(F.transform("_rules", lambda i: F.element_at(arts, i + 1))).alias("artifacts")
    return df.join(chosen, POSITION).select(*[F.col(f"`{c}`") for c in df.columns], maps("params"), maps("metrics"), maps("tags"), artifacts)


def sequence_artifacts(df: DataFrame, id_column: str = "id", sequence: str = "sequence") -> DataFrame:
    """(id, name, content): a sequence.json for every row that has a sequence."""
    if sequence not in df.columns:
        return df.select(F.col(id_column).cast("string").alias("id"), F.lit("sequence.json").alias("name"), F.lit(None).cast("string").alias("content")).limit(0)
    return df.where(F.col(sequence).isNotNull()).select(F.col(id_column).cast("string").alias("id"), F.lit("sequence.json").alias("name"), annotation_json(F.col(id_column).cast("string"), sequence).alias("content"))


def rule_aggregates(df: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    """(metric, value) of a config {outputs: [rules], aggregates: [{field, ops}], aggregate_over: selected|all}."""
    over = df if config.get("aggregate_over") == "all" else union_rules(df, config.get("outputs") or [])
    return aggregates(over, [(a["field"], a.get("ops") or []) for a in config.get("aggregates") or []])


LOG_TABLES = {"params": "id string, key string, value string", "metrics": "id string, key string, value double", "tags": "id string, key string, value string", "artifacts": "id string, name string, kind string, content string"}


def load_outputs(source: Mapping[str, Any] | str) -> dict[str, Any]:
    """A config {outputs: [rules], aggregates: [...], aggregate_over} from a mapping or a YAML file; a wrong form raises ValueError."""
    config = dict(source) if isinstance(source, Mapping) else read_yaml(source)
    if not isinstance(config.get("outputs", []), list) or not all(isinstance(r, Mapping) for r in config.get("outputs", [])):
        raise ValueError("outputs must be a list of rules")
    if not isinstance(config.get("aggregates", []), list):
        raise ValueError("aggregates must be a list")
    if config.get("aggregate_over", "selected") not in ("selected", "all"):
        raise ValueError("aggregate_over must be 'selected' or 'all'")
    return config


def log_entries(df: DataFrame, rules: Sequence[Mapping[str, Any]], id_column: str = "id") -> DataFrame:
    """(id, what, key, value, kind) of all that the rules log of their selected rows: params, metrics, tags and artifacts.

    Values in '${{ }}' are evaluated over the row; one that can't be is left out. Of a key that several
    rules give, the last rule's stays. Artifacts of type ``seqparse`` (from ``content``, or ``entries`` of
    {sequence, id}) become JSON records, several of them a list; ``json`` keeps texts and writes objects as
    JSON; ``pdb``, ``text`` and any other type are texts. An artifact without content raises ValueError.
    """
    for rule in rules:
        for a in (rule.get("log") or {}).get("artifacts") or []:
            if not a.get("content") and not (a.get("type") == "seqparse" and "entries" in a):
                raise ValueError(f"artifact {a.get('name', 'artifact')!r} must have content")
    df = with_position(df)
    marked = None
    for i, rule in enumerate(rules):
        if rule.get("log"):
            one = select_rows(df, rule).select(POSITION, F.lit(i).alias("_rule"))
            marked = one if marked is None else marked.unionByName(one)
    empty = "id string, what string, key string, value string, kind string"
    if marked is None:
        return df.sparkSession.createDataFrame([], empty)
    chosen = marked.groupBy(POSITION).agg(F.array_sort(F.collect_set("_rule")).alias("_rules"))  # at most one entry per rule
    fields = [c for c in df.columns if c != POSITION]
    src = df.join(chosen, POSITION).select(F.col(f"`{id_column}`").cast("string").alias("id"), "_rules", F.to_json(F.struct(*[F.col(f"`{c}`") for c in fields]), {"ignoreNullFields": "false"}).alias("row"))
    logs = [dict(r.get("log") or {}) for r in rules]

    def given(value: Any, row: dict[str, Any]) -> Any:
        try:
            return evaluate_tree(value, row)
        except (KeyError, ValueError):
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for rid, mine, text in zip(pdf["id"], pdf["_rules"], pdf["row"]):
                row, seen = json.loads(text), {}
                for i in mine:
                    for what in ("params", "metrics", "tags"):
                        for k, v in (logs[i].get(what) or {}).items():
                            if (v := given(v, row)) is not None:
                                seen[what, str(k)] = (v if isinstance(v, str) else json.dumps(v), None)
                    for a in logs[i].get("artifacts") or []:
                        kind = a.get("type", "text")
                        if kind == "seqparse":
                            entries = a["entries"] if "entries" in a else [{"sequence": a["content"], "id": row.get("id") or row.get("sequence_id")}]
                            made = [{"id": given(e.get("id"), row), "sequence": given(e.get("sequence"), row)} for e in entries]
                            made = [{k: None if x is None else str(x) for k, x in e.items()} for e in made if e["sequence"]]
                            v = json.dumps(made) if made else None
                        else:
                            v = given(a["content"], row)
                            v = json.dumps(v, indent=2) if kind == "json" and isinstance(v, dict) else None if v is None else str(v)
                        if v is not None:
                            seen["artifacts", a.get("name", "artifact")] = (v, kind)
                out += [(rid, what, k, v, kind) for (what, k), (v, kind) in seen.items()]
            yield pd.DataFrame(out, columns=["id", "what", "key", "value", "kind"])

    got = src.mapInPandas(run, empty)
    entries = F.transform(F.from_json("value", "array<struct<id:string,sequence:string>>"), lambda e: annotation_json(e["id"], e["sequence"]))
    records = F.when(F.size(entries) == 1, entries[0]).otherwise(F.concat(F.lit("["), F.array_join(entries, ","), F.lit("]")))
    return got.withColumn("value", F.when(F.col("kind") == "seqparse", records).otherwise(F.col("value")))


def write_log(df: DataFrame, config: Mapping[str, Any] | str, path: str, id_column: str = "id") -> None:
    """Appends what a config's rules log to the tables params, metrics, tags and artifacts under ``path``, and its aggregates to ``aggregates``."""
    config = load_outputs(config)
    e = staged(log_entries(df, config.get("outputs") or [], id_column), "log")
    for what, schema in LOG_TABLES.items():
        part = e.where(F.col("what") == what)
        if what == "artifacts":
            rows = part.select("id", F.col("key").alias("name"), "kind", F.col("value").alias("content"))
        else:
            rows = part.select("id", "key", F.col("value").try_cast("double").alias("value") if what == "metrics" else F.col("value"))
        rows.write.mode("append").parquet(f"{path}/{what}")
    if config.get("aggregates"):
        rule_aggregates(df, config).write.mode("append").parquet(f"{path}/aggregates")
