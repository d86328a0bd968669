"""Declarative protocols (YAML): validated, compiled to a pipeline, run, and their outputs selected."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extract import Extraction, parse_mapping
from ..scoring import Scorer
from ..sources.readers import read_yaml
from ..store import Store
from .expressions import evaluate_tree, names, template
from .outputs import POSITION, select_rows, union_rules
from .pipeline import Pipeline, Predict

ACTIONS = ("predict", "encode", "generate", "score", "search", "lookup")
# What a locally run task may not use.
UNSUPPORTED = ("class", "app", "method", "gather", "foreach", "subtasks", "skip_if", "skip_if_empty")


@dataclass
class Validation:
    """Errors and warnings as (message, path); valid if there are no errors."""

    errors: list[tuple[str, str]] = field(default_factory=list)
    warnings: list[tuple[str, str]] = field(default_factory=list)
    statistics: dict[str, Any] = field(default_factory=dict)

    @property
    def is_valid(self) -> bool:
        return not self.errors


def load(source: Mapping[str, Any] | str | Path) -> dict[str, Any]:
    return dict(source) if isinstance(source, Mapping) else read_yaml(source)


def validate(source: Mapping[str, Any] | str | Path) -> Validation:
    """Checks form, references between tasks, circles, and templates."""
    v = Validation()
    try:
        p = load(source)
    except Exception as e:
        v.errors.append((f"can't be read: {e}", ""))
        return v
    tasks = p.get("tasks")
    if not p.get("name"):
        v.errors.append(("a name is missing", "name"))
    if not isinstance(tasks, list) or not tasks:
        v.errors.append(("tasks must be a list that isn't empty", "tasks"))
        tasks = []
    ids: set[str] = set()
    for i, t in enumerate(tasks):
        at = f"tasks[{i}]"
        if not isinstance(t, Mapping):
            v.errors.append(("a task must be a mapping", at))
            continue
        if not t.get("id"):
            v.errors.append(("a task needs an id", at))
        elif t["id"] in ids:
            v.errors.append((f"task id {t['id']!r} occurs twice", f"{at}.id"))
        ids.add(t.get("id"))
        if t.get("action") is not None and t["action"] not in ACTIONS:
            v.errors.append((f"unknown action {t['action']!r}", f"{at}.action"))
    inputs = p.get("inputs") or {}
    known = ids | (set(inputs) if isinstance(inputs, Mapping) else {x.get("name") for x in inputs})
    graph: dict[str, list[str]] = {}
    for i, t in enumerate(t for t in tasks if isinstance(t, Mapping)):
        deps = t.get("depends_on") or []
        for j, d in enumerate(deps):
            if d not in ids:
                v.errors.append((f"unknown task {d!r}", f"tasks[{i}].depends_on[{j}]"))
        if isinstance(t.get("from"), str) and t["from"] not in known:
            v.errors.append((f"unknown task or input {t['from']!r}", f"tasks[{i}].from"))
        if isinstance(t.get("foreach"), str) and template(t["foreach"]) is None and t["foreach"] not in known:
            v.errors.append((f"unknown task {t['foreach']!r}", f"tasks[{i}].foreach"))
        graph[t.get("id")] = [d for d in deps if d in ids]
    left = dict(graph)
    while free := [t for t, d in left.items() if not set(d) & set(left)]:
        for t in free:
            del left[t]
    if left:
        v.errors.append(("tasks depend on each other in a circle: " + ", ".join(map(str, left)), "tasks"))
    _templates(p, "", v)
    v.statistics = {"input_count": len(inputs), "task_count": len(tasks), "output_count": len(p.get("outputs") or [])}
    return v


def _templates(x: Any, path: str, v: Validation) -> None:
    if isinstance(x, Mapping):
        for k, y in x.items():
            _templates(y, f"{path}.{k}" if path else str(k), v)
    elif isinstance(x, list):
        for i, y in enumerate(x):
            _templates(y, f"{path}[{i}]", v)
    elif isinstance(x, str):
        inner = template(x)
        if inner is None:
            if "${{" in x or "}}" in x:
                v.errors.append(("a template must be the whole value", path))
        elif not inner:
            v.errors.append(("empty template", path))
        else:
            depth = 0
            for c in inner:
                depth += (c == "{") - (c == "}")
                if depth < 0:
                    break
            if depth:
                v.errors.append(("braces don't match in a template", path))


def check_supported(p: Mapping[str, Any]) -> None:
    """ValueError for what needs the hosted runner: loops, gathering, classes, conditions, references to other tasks' results."""
    for t in p.get("tasks") or []:
        if bad := [k for k in UNSUPPORTED if t.get(k) is not None]:
            raise ValueError(f"task {t.get('id')!r} uses {bad}, which local runs don't support")
        if not t.get("slug") or not t.get("action"):
            raise ValueError(f"task {t.get('id')!r} needs a slug and an action")

        def look(x: Any, t: Mapping[str, Any] = t) -> None:
            if isinstance(x, Mapping):
                for y in x.values():
                    look(y)
            elif isinstance(x, list):
                for y in x:
                    look(y)
            elif (e := template(x)) is not None and "tasks." in e:
                raise ValueError(f"task {t.get('id')!r} refers to other tasks' results, which local runs don't support")

        look(t.get("request_body"))


def resolve_sequences(p: Mapping[str, Any], inputs: Mapping[str, Any]) -> list[str]:
    """The primary sequences: the first list_of_str input given, else 'sequences' or 'sequence', else the only text input."""
    specs = p.get("inputs") or {}
    pairs = list(specs.items()) if isinstance(specs, Mapping) else [(s.get("name"), s) for s in specs if isinstance(s, Mapping)]
    kinds = [(n, s.get("type")) for n, s in pairs if isinstance(s, Mapping)]
    texts = [n for n, k in kinds if k == "text"]
    order = [n for n, k in kinds if k == "list_of_str"] + ["sequences", "sequence"] + (texts if len(texts) == 1 else [])
    for n in order:
        if n in inputs:
            x = inputs[n]
            out = [x] if isinstance(x, str) else [y if isinstance(y, str) else str(y["sequence"]) for y in x]
            if not out:
                raise ValueError(f"input {n!r} is empty")
            return out
    raise ValueError("no input gives sequences")


def compile_protocol(spark: SparkSession, p: Mapping[str, Any], inputs: Mapping[str, Any], scorers: Mapping[str, Scorer], path: str, run_id: str = "") -> tuple[Pipeline, list[str]]:
    """(pipeline, sequences) of a protocol with its inputs; each task becomes one prediction stage."""
    check_supported(p)
    specs = p.get("inputs") or {}
    defaults = {n: s["initial"] for n, s in specs.items() if isinstance(s, Mapping) and "initial" in s} if isinstance(specs, Mapping) else {}
    context = {**defaults, **inputs}
    pipe = Pipeline(spark, Store(spark, path), run_id=run_id, kind="protocol")
    for t in p.get("tasks") or []:
        if t["slug"] not in scorers:
            raise KeyError(f"no scorer for {t['slug']!r}")
        params = evaluate_tree((t.get("request_body") or {}).get("params") or {}, context)
        mapping = parse_mapping(t.get("response_mapping") or {})
        options: dict[str, Any] = {}
        found = [Extraction(key, column) for column, key, kind in mapping if kind == "scalar" and t["action"] != "encode"]
        for _, key, kind in mapping:
            if kind == "structure":
                options["structure_key"] = key
            elif kind == "embedding" or t["action"] == "encode":
                options["embedding_key"] = key
        if not mapping:
            if t["action"] != "encode":
                raise ValueError(f"task {t['id']!r} needs a response_mapping")
            options["embedding_key"] = "mean_representations"
        if "structure_key" in options:
            options["plddt_key"] = next((e.key for e in found if e.key in ("mean_plddt", "plddt")), None)
        pipe.add(Predict(t["id"], scorers[t["slug"]], found or None, action=t["action"], params=params, depends_on=list(t.get("depends_on") or []), **options))
    return pipe, resolve_sequences(p, inputs)


@dataclass
class ProtocolRun:
    """All result rows, those each output rule selected, and their union."""

    records: DataFrame
    selections: list[DataFrame]
    selected: DataFrame
    pipeline: Pipeline


def run_protocol(spark: SparkSession, source: Mapping[str, Any] | str | Path, inputs: Mapping[str, Any], scorers: Mapping[str, Scorer], path: str, run_id: str = "") -> ProtocolRun:
    """Validates, compiles and runs a protocol; without output rules nothing is selected."""
    p = load(source)
    v = validate(p)
    if not v.is_valid:
        raise ValueError("; ".join(f"{at}: {m}" if at else m for m, at in v.errors))
    pipe, sequences = compile_protocol(spark, p, inputs, scorers, path, run_id)
    wide = pipe.run(sequences)
    records = wide.withColumn(POSITION, F.col("sequence_id"))
    rules: Sequence[Mapping[str, Any]] = p.get("outputs") or []
    return ProtocolRun(wide, [select_rows(records, r).drop(POSITION) for r in rules], union_rules(records, rules), pipe)


def template_variables(p: Mapping[str, Any]) -> set[str]:
    """The variables that a protocol's request templates name."""
    out: set[str] = set()

    def look(x: Any) -> None:
        if isinstance(x, Mapping):
            for y in x.values():
                look(y)
        elif isinstance(x, list):
            for y in x:
                look(y)
        elif e := template(x):
            out.update(names(e))

    for t in p.get("tasks") or []:
        look(t.get("request_body"))
    return out
