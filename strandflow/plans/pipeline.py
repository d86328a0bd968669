"""Stages in a directed graph, run over a store with caching, resume and streaming into filters."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract
from ..operators import cluster, generate
from ..operators import relational as R
from ..operators.checks import check_name
from ..operators.filters import FUNCTIONS, Filter, filter_from_spec
from ..scoring import Scorer, score
from ..session import staged
from ..sources import readers
from ..store import Store


@dataclass
class StageResult:
    """Counts of one stage's run."""

    name: str
    n_in: int
    n_out: int
    cached: int = 0
    computed: int = 0
    resumed: bool = False


class Stage:
    """A named step from an id set to an id set. ``mode`` says how parallel stages of one level are merged."""

    mode = "intersect"
    columns: Sequence[str] = ()

    def __init__(self, name: str, depends_on: Sequence[str] | None = None):
        self.name, self.depends_on = check_name(name), list(depends_on) if depends_on is not None else None

    def run(self, ids: DataFrame, store: Store, run_id: str) -> tuple[DataFrame, StageResult]:
        raise NotImplementedError

    def reload(self, ids: DataFrame, store: Store, run_id: str) -> DataFrame:
        """The stage's output of an earlier run, from the store."""
        return ids

    def spec(self) -> dict[str, Any]:
        return {"type": type(self).__name__, "name": self.name, "depends_on": self.depends_on}


class Predict(Stage):
    """Scores what the store lacks and keeps the ids that have every column."""

    mode = "union"

    def __init__(self, name: str, scorer: Scorer, extractions: Any = None, columns: Any = None, action: str = "predict", params: dict | None = None, embedding_key: str | Callable[[Any], Sequence[float] | None] | None = None, layer: int | None = None, reduction: str | None = None, structure_key: str | None = None, plddt_key: str | None = None, skip_on_error: bool = False, item_columns: Sequence[str] = ("sequence",), depends_on: Sequence[str] | None = None, batch_size: int = 32):
        super().__init__(name, depends_on)
        self.scorer, self.action, self.params = scorer, action, params or {}
        self.extractions = extract.resolve(extractions, columns) if extractions is not None else []
        if not self.extractions and embedding_key is None and structure_key is None:
            raise ValueError("a prediction needs something to extract")
        self.embedding_key, self.layer, self.reduction = embedding_key, layer, reduction
        self.structure_key, self.plddt_key = structure_key, plddt_key
        self.skip_on_error, self.item_columns, self.batch_size = skip_on_error, list(item_columns), batch_size
        self.columns = [check_name(e.column) for e in self.extractions]

    def missing(self, ids: DataFrame, store: Store) -> DataFrame:
        need = [R.uncached(ids, store.log("predictions"), c, self.scorer.name) for c in self.columns]
        if self.embedding_key:
            need.append(ids.join(store.log("embeddings").where(F.col("model_name") == self.scorer.name).select("sequence_id"), "sequence_id", "left_anti"))
        if self.structure_key:
            need.append(ids.join(store.log("structures").where(F.col("model_name") == self.scorer.name).select("sequence_id"), "sequence_id", "left_anti"))
        return R.ids_union(*need)

    def score_rows(self, rows: DataFrame) -> DataFrame:
        return score(rows, self.scorer, self.action, self.item_columns, params=self.params, batch_size=self.batch_size, skip_on_error=self.skip_on_error)

    def wide(self, responses: DataFrame) -> DataFrame:
        """(sequence_id, one column per extraction, error)."""
        return responses.select("sequence_id", *[extract.scalar("response", e.key, e.reduction).alias(e.column) for e in self.extractions], "error")

    def save(self, responses: DataFrame, store: Store) -> None:
        """Values, vectors and structures of staged responses; failures as null with status failed."""
        model = F.lit(self.scorer.name).alias("model_name")
        if self.extractions:
            status = F.when(F.col("error").isNotNull(), F.to_json(F.struct(F.lit("failed").alias("status"), F.col("error"))))
            parts = [responses.select("sequence_id", F.lit(e.column).alias("prediction_type"), model, extract.scalar("response", e.key, e.reduction).alias("value"), status.alias("metadata")) for e in self.extractions]
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            store.add_predictions(rows)
        if self.embedding_key:
            v = extract.embedding_by(self.embedding_key, "response") if callable(self.embedding_key) else extract.embedding("response", self.embedding_key, self.layer, self.reduction)
            store.add_embeddings(responses.select("sequence_id", model, F.lit(self.layer).cast("int").alias("layer"), v.cast("array<float>").alias("values")).where("values is not null"))
        if self.structure_key:
            s = extract.structure("response", self.structure_key, 0, self.plddt_key)
            store.add_structures(responses.select("sequence_id", model, s.alias("s")).where("s is not null").select("sequence_id", "model_name", "s.*"))

    def run(self, ids: DataFrame, store: Store, run_id: str) -> tuple[DataFrame, StageResult]:
        todo = staged(self.missing(ids, store), "todo")
        n_in, n_todo = ids.count(), todo.count()
        if n_todo:
            rows = R.semi_lookup(store.table("sequences"), todo, "sequence_id")
            self.save(staged(self.score_rows(rows), "responses"), store)
        out = self.complete(ids, store)
        return out, StageResult(self.name, n_in, out.count(), n_in - n_todo, n_todo)

    def complete(self, ids: DataFrame, store: Store) -> DataFrame:
        out = ids
        for c in self.columns:
            out = R.with_prediction(out, store.log("predictions"), c, self.scorer.name)
        if self.embedding_key:
            out = R.semi_lookup(out, store.log("embeddings").where(F.col("model_name") == self.scorer.name), "sequence_id")
        return staged(out, "ids")

    def reload(self, ids: DataFrame, store: Store, run_id: str) -> DataFrame:
        return self.complete(ids, store)

    def spec(self) -> dict[str, Any]:
        if callable(self.embedding_key):
            raise ValueError("a prediction with a function for its embedding has no spec")
        return {**super().spec(), "model": self.scorer.name, "action": self.action, "params": self.params, "extractions": [[e.key, e.column, e.reduction] for e in self.extractions], "embedding_key": self.embedding_key, "layer": self.layer, "reduction": self.reduction, "structure_key": self.structure_key, "plddt_key": self.plddt_key, "skip_on_error": self.skip_on_error, "item_columns": self.item_columns}


class Cofold(Predict):
    """A prediction whose item is the sequence together with static entities."""

    def __init__(self, name: str, scorer: Scorer, entities: Sequence[dict], **options: Any):
        super().__init__(name, scorer, **options)
        self.entities = list(entities)

    def score_rows(self, rows: DataFrame) -> DataFrame:
        items = generate.cofold_items(rows, self.entities)
        return score(items, self.scorer, self.action, ["item"], params=self.params, batch_size=self.batch_size, skip_on_error=self.skip_on_error)

    def spec(self) -> dict[str, Any]:
        return {**super().spec(), "entities": self.entities}


class FilterStage(Stage):
    """Keeps the ids whose wide rows pass a filter."""

    def __init__(self, name: str, filter: Filter, depends_on: Sequence[str] | None = None):
        super().__init__(name, depends_on)
        self.filter = filter

    def run(self, ids: DataFrame, store: Store, run_id: str) -> tuple[DataFrame, StageResult]:
        kept = self.filter.apply(store.working_frame(ids))
        if "sequence_id" not in kept.columns:
            raise ValueError("a filter must keep the column sequence_id")
        out = staged(R.id_set(kept), "ids")
        store.add_filter_results(run_id, self.name, out, ids)
        return out, StageResult(self.name, ids.count(), out.count())

    def reload(self, ids: DataFrame, store: Store, run_id: str) -> DataFrame:
        r = store.table("filter_results").where((F.col("run_id") == run_id) & (F.col("stage_name") == self.name) & F.col("passed"))
        return R.id_set(r)

    def spec(self) -> dict[str, Any]:
        return {**super().spec(), "filter": self.filter.spec()}


class ClusterStage(Stage):
    """Clusters the ids' embeddings; every id stays, its cluster becomes a score."""

    mode = "union"

    def __init__(self, name: str, model: str = "", method: str = "kmeans", depends_on: Sequence[str] | None = None, metric: str = "embedding", **options: Any):
        """``metric`` is ``embedding`` (the vectors of ``model``), ``embedding_rows`` or ``hamming`` (rows of all distances, for small sets)."""
        super().__init__(name, depends_on)
        self.model, self.method, self.metric, self.options = model, method, metric, options
        if method not in ("kmeans", "dbscan", "hierarchical"):
            raise ValueError(f"unknown method {method!r}")
        if metric not in ("embedding", "embedding_rows", "hamming"):
            raise ValueError(f"unknown metric {metric!r}")

    def vectors(self, ids: DataFrame, store: Store) -> DataFrame:
        if self.metric == "hamming":
            return cluster.hamming_rows(R.semi_lookup(store.table("sequences"), ids, "sequence_id")).toDF("sequence_id", "values")
        e = R.semi_lookup(store.table("embeddings").where(F.col("model_name") == self.model), ids, "sequence_id").select("sequence_id", "values")
        return cluster.distance_rows(e, "sequence_id", "values").toDF("sequence_id", "values") if self.metric == "embedding_rows" else e

    def run(self, ids: DataFrame, store: Store, run_id: str) -> tuple[DataFrame, StageResult]:
        e = staged(self.vectors(ids, store), "vectors")
        f = {"kmeans": cluster.kmeans, "dbscan": cluster.dbscan, "hierarchical": cluster.hierarchical}[self.method]
        c = staged(f(e, id_column="sequence_id", values="values", **self.options), "clusters")
        m = cluster.medoids(e.join(c.withColumnRenamed("id", "sequence_id"), "sequence_id"), "sequence_id", "values", "cluster")
        store.add_predictions(cluster.cluster_predictions(c, m, self.name).withColumn("model_name", F.lit(f"{self.method}:{self.model or self.metric}")))
        n = ids.count()
        return ids, StageResult(self.name, n, n)

    def spec(self) -> dict[str, Any]:
        return {**super().spec(), "model": self.model, "method": self.method, "metric": self.metric, "options": self.options}


Maker = Callable[[DataFrame], DataFrame]


class GenerateStage(Stage):
    """Adds sequences that one or several functions make from the store; runs before all other stages.

    A function gets the parents (with ``run``, 0 to ``runs`` - 1, and the columns of ``inputs``, such as
    stored structures) and gives ``sequence``. With ``skip_on_error`` a function that fails is left out with a
    warning, unless all fail. A saved definition has the functions' names (``filters.named``).
    """

    mode = "union"

    def __init__(self, name: str, make: Maker | Sequence[Maker], label: str | None = None, depends_on: Sequence[str] | None = None, runs: int = 1, skip_on_error: bool = False, inputs: Callable[[Store], DataFrame] | None = None):
        super().__init__(name, depends_on)
        self.makes = list(make) if isinstance(make, Sequence) else [make]
        self.label, self.runs, self.skip_on_error, self.inputs = label, runs, skip_on_error, inputs

    def parents(self, ids: DataFrame, store: Store) -> DataFrame:
        p = R.semi_lookup(store.table("sequences"), ids, "sequence_id")
        if self.inputs is not None:
            p = R.join_using(p, self.inputs(store), "sequence_id", "left")
        return p.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(self.runs - 1)))) if self.runs > 1 else p.withColumn("run", F.lit(0))

    def run(self, ids: DataFrame, store: Store, run_id: str) -> tuple[DataFrame, StageResult]:
        parents, made, failed = self.parents(ids, store), [], []
        for make in self.makes:
            try:
                made.append(staged(make(parents).withColumn("sequence", F.upper("sequence")), "made"))
            except Exception as e:
                if not self.skip_on_error:
                    raise
                failed.append(e)
                warnings.warn(f"stage {self.name}: a generator failed: {e}", RuntimeWarning, stacklevel=2)
        if not made:
            raise failed[-1]
        new = made[0]
        for m in made[1:]:
            new = new.unionByName(m, allowMissingColumns=True)
        placed = staged(store.add_sequences(new.where("sequence is not null and sequence <> ''").dropDuplicates(["sequence"])), "generated")
        cols = {"run_id": F.lit(run_id), "label": F.lit(self.label).cast("string"), "model_name": F.lit(self.name)}
        store.add_generation(placed.select("sequence_id", *[c for c in placed.columns if c in ("temperature", "metadata")]).withColumns(cols))
        out = R.id_set(placed)
        return out, StageResult(self.name, ids.count(), out.count())

    def reload(self, ids: DataFrame, store: Store, run_id: str) -> DataFrame:
        g = store.table("generation_metadata").where((F.col("run_id") == run_id) & (F.col("model_name") == self.name))
        return R.id_set(g)

    def spec(self) -> dict[str, Any]:
        if self.inputs is not None or not all(FUNCTIONS.get(m.__name__) is m for m in self.makes):
            raise ValueError("a generator has a spec only if its functions are named")
        return {**super().spec(), "make": [m.__name__ for m in self.makes], "label": self.label, "runs": self.runs, "skip_on_error": self.skip_on_error}


def stored_structures(store: Store) -> DataFrame:
    """(sequence_id, structure_str, format): generation input from the latest structure of each sequence."""
    return store.latest_structures().select("sequence_id", "structure_str", "format")


def structure_files(path: str, key: str = "id") -> Callable[[Store], DataFrame]:
    """Generation input (sequence_id, structure_str) from PDB or CIF files named by the sequence id."""

    def read(store: Store) -> DataFrame:
        f = store.spark.read.option("wholetext", True).text(path).select(F.col("value").alias("structure_str"), F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.", 1).try_cast("long").alias("sequence_id"))
        return f.where("sequence_id is not null").select("sequence_id", "structure_str")

    return read


class SourceStage(Stage):
    """Takes sequences that are there already, without any model: texts, a frame, files, or the store.

    From the store, a run that generated sequences gives those only, any other run all that the store has.
    """

    mode = "union"

    def __init__(self, name: str, rows: DataFrame | Sequence[str] | str | None = None, column: str = "sequence", depends_on: Sequence[str] | None = None):
        super().__init__(name, depends_on)
        self.rows, self.column = rows, column

    def run(self, ids: DataFrame, store: Store, run_id: str) -> tuple[DataFrame, StageResult]:
        spark, rows = store.spark, self.rows
        if rows is None:
            made = R.id_set(store.table("generation_metadata").where(F.col("run_id") == run_id))
            out = staged(R.id_set(store.table("sequences")) if made.isEmpty() else made, "ids")
        else:
            if isinstance(rows, str):
                rows = readers.read_csv_strings(spark, rows, self.column) if rows.endswith(".csv") else readers.read_sequences(spark, rows)
            elif not isinstance(rows, DataFrame):
                rows = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], f"_n long, {self.column} string").orderBy("_n")
            text = rows.select(F.col(self.column).alias("sequence")).where("sequence is not null and trim(sequence) <> ''")
            out = staged(R.id_set(store.add_sequences(text)), "ids")
        n = out.count()
        return out, StageResult(self.name, n, n)


def levels(stages: Sequence[Stage]) -> list[list[Stage]]:
    """Stages in levels, each after all it depends on. Unknown names and circles raise ValueError."""
    by = {s.name: s for s in stages}
    for s in stages:
        for d in s.depends_on or []:
            if d not in by:
                raise ValueError(f"stage {s.name!r} depends on unknown {d!r}")
    done: set[str] = set()
    out = []
    while len(done) < len(by):
        ready = [s for s in stages if s.name not in done and set(s.depends_on or []) <= done]
        if not ready:
            raise ValueError("stages depend on each other in a circle: " + ", ".join(sorted(set(by) - done)))
        out.append(ready)
        done |= {s.name for s in ready}
    return out


@dataclass
class Pipeline:
    """Stages over a store. ``resume`` skips stages that this run completed before and generation that it did."""

    spark: SparkSession
    store: Store
    run_id: str = ""
    resume: bool = False
    kind: str = "DataPipeline"
    stages: list[Stage] = field(default_factory=list)
    results: dict[str, StageResult] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.run_id = self.run_id or uuid.uuid4().hex[:8]

    # --- building ---

    def add(self, stage: Stage) -> Pipeline:
        """A stage after the last one, unless it names what it depends on. Names and columns must be new."""
        if any(s.name == stage.name for s in self.stages):
            raise ValueError(f"stage {stage.name!r} exists")
        taken = {c for s in self.stages for c in s.columns}
        if clash := taken & set(stage.columns):
            raise ValueError(f"columns of another stage: {sorted(clash)}")
        if stage.depends_on is None:
            stage.depends_on = [self.stages[-1].name] if self.stages else []
        self.stages.append(stage)
        return self

    def predict(self, name: str, scorer: Scorer, extractions: Any = "score", columns: Any = None, **options: Any) -> Pipeline:
        return self.add(Predict(name, scorer, extractions, columns, **options))

    def filter(self, name: str, f: Filter, **options: Any) -> Pipeline:
        return self.add(FilterStage(name, f, **options))

    def cluster(self, name: str, model: str = "", **options: Any) -> Pipeline:
        return self.add(ClusterStage(name, model, **options))

    def cofold(self, name: str, scorer: Scorer, entities: Sequence[dict], **options: Any) -> Pipeline:
        return self.add(Cofold(name, scorer, entities, **options))

    def generate(self, name: str, make: Maker | Sequence[Maker], **options: Any) -> Pipeline:
        self.kind = "GenerativePipeline"
        return self.add(GenerateStage(name, make, **options))

    def source(self, name: str, rows: DataFrame | Sequence[str] | str | None = None, **options: Any) -> Pipeline:
        self.kind = "GenerativePipeline"
        return self.add(SourceStage(name, rows, **options))

    # --- running ---

    def ingest(self, rows: DataFrame | Sequence[str] | None, columns: Sequence[str] | None = None) -> DataFrame:
        """Ids of the input, added to the store where it lacks them; without input, of all the store has."""
        if rows is None:
            return staged(R.id_set(self.store.table("sequences")), "ids")
        if not isinstance(rows, DataFrame):
            rows = self.spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "_pos long, sequence string")
            return staged(R.id_set(self.store.add_sequences(rows, columns, "_pos")), "ids")
        return staged(R.id_set(self.store.add_sequences(rows, columns)), "ids")

    def difference(self, rows: DataFrame | Sequence[str], column: str = "sequence") -> tuple[int, int]:
        """(texts that the store has, texts that are new) of an input, before it is added."""
        if not isinstance(rows, DataFrame):
            rows = self.spark.createDataFrame([(s,) for s in rows], f"{column} string")
        distinct = rows.select(column).distinct()
        known = self.store.count_matching(distinct, column)
        return known, distinct.count() - known

    def run(self, rows: DataFrame | Sequence[str] | None = None, columns: Sequence[str] | None = None, diff: bool = False) -> DataFrame:
        """The wide rows of the ids that the last level leaves. With ``diff``, ``results["input"]`` counts the input's texts and those skipped as known."""
        specs = []
        for s in self.stages:
            try:
                specs.append(s.spec())
            except ValueError:
                specs.append({"type": type(s).__name__, "name": s.name, "depends_on": s.depends_on})
        definition = self.store.save_definition(self.kind, specs, list(columns or []))
        self.store.set_run(self.run_id, "running", self.kind, definition_id=definition)
        if diff and rows is not None:
            known, new = self.difference(rows, columns[0] if columns else "sequence")
            self.results["input"] = StageResult("input", known + new, known + new, cached=known, computed=new)
        start = self.ingest(rows, columns)
        makers = [s for s in self.stages if isinstance(s, (GenerateStage, SourceStage))]
        made = [self._one(s, start) for s in makers]
        if made:
            start = staged(R.ids_union(*made), "ids")
        gone = {s.name for s in makers}
        rest = [s for s in self.stages if s.name not in gone]
        for s in rest:
            s.depends_on = [d for d in s.depends_on or [] if d not in gone]
        out: dict[str, DataFrame] = {}
        last = start
        for level in levels(rest):
            for s in level:
                deps = [out[d] for d in s.depends_on or []]
                out[s.name] = self._one(s, R.ids_intersect(*deps) if len(deps) > 1 else deps[0] if deps else start)
            last = self._merge(level, out)
        self.store.set_run(self.run_id, "completed", self.kind, definition_id=definition)
        self.ids = last
        return self.store.working_frame(last)

    @staticmethod
    def _merge(level: Sequence[Stage], out: dict[str, DataFrame]) -> DataFrame:
        if len({s.mode for s in level}) > 1:
            raise ValueError("stages of one level must all unite or all intersect: " + ", ".join(s.name for s in level))
        sets = [out[s.name] for s in level]
        if len(sets) == 1:
            return sets[0]
        return staged(R.ids_union(*sets) if level[0].mode == "union" else R.ids_intersect(*sets), "ids")

    def _one(self, s: Stage, ids: DataFrame) -> DataFrame:
        if self.resume and (done := self.store.stage_done(self.run_id, s.name)):
            got = s.reload(ids, self.store, self.run_id)
            n = got.count()
            if n != done[1]:
                warnings.warn(f"stage {s.name}: {n} ids reloaded, {done[1]} recorded", RuntimeWarning, stacklevel=2)
            self.results[s.name] = StageResult(s.name, done[0], n, resumed=True)
            return got
        if ids.isEmpty() and not isinstance(s, (GenerateStage, SourceStage)):
            self.results[s.name] = StageResult(s.name, 0, 0)
            return ids
        got, r = s.run(ids, self.store, self.run_id)
        self.results[s.name] = r
        self.store.complete_stage(self.run_id, s.name, r.n_in, r.n_out)
        return got

    # --- looking ---

    def query_results(self, sql_where: str | None = None, columns: Sequence[str] = ()) -> DataFrame:
        """Distinct sequences for which a predicate holds, with the latest values of some types; base columns are skipped."""
        from ..operators.checks import check_expression

        base = self.store.table("sequences").select("sequence_id", "sequence", "length")
        wide = R.attach_latest(base, self.store.table("predictions"), columns)
        return (wide.where(F.expr(check_expression(sql_where))) if sql_where else wide).distinct()

    def merged_results(self, texts: DataFrame, kinds: Sequence[str], column: str = "sequence") -> DataFrame:
        """The given texts' sequences with the latest value of each type, old and new alike."""
        from ..functions.bio import store_hash

        want = texts.select(store_hash(column).alias("hash")).distinct()
        return R.attach_latest(R.semi_lookup(self.store.table("sequences"), want, "hash"), self.store.table("predictions"), kinds)

    def explore(self) -> DataFrame:
        """(what, name, n): rows per table, scores per type, and completed stages of this run."""
        t = self.store.stats().select(F.lit("table").alias("what"), F.col("table_name").alias("name"), F.col("n_rows").alias("n"))
        p = self.store.table("predictions").groupBy("prediction_type").agg(F.count("*").alias("n")).select(F.lit("type").alias("what"), F.col("prediction_type").alias("name"), "n")
        s = self.store.table("stage_completions").where(F.col("run_id") == self.run_id).select(F.lit("stage").alias("what"), F.col("stage_name").alias("name"), F.col("output_count").alias("n"))
        return t.unionByName(p).unionByName(s)

    def funnel(self) -> DataFrame:
        """(stage_name, input_count, output_count) in order of completion."""
        s = self.store.table("stage_completions").where(F.col("run_id") == self.run_id)
        return s.orderBy("completed_at").select("stage_name", "input_count", "output_count")


def stage_from_spec(spec: dict[str, Any], scorers: dict[str, Scorer]) -> Stage:
    """A stage from its saved form; its scorer comes from ``scorers`` by name."""
    x = dict(spec)
    kind, name, deps = x.pop("type"), x.pop("name"), x.pop("depends_on")
    if kind == "FilterStage":
        return FilterStage(name, filter_from_spec(x["filter"]), deps)
    if kind == "ClusterStage":
        return ClusterStage(name, x["model"], x["method"], deps, x.get("metric", "embedding"), **x["options"])
    if kind in ("Predict", "Cofold"):
        if x["model"] not in scorers:
            raise KeyError(f"no scorer named {x['model']!r}")
        ex = [extract.Extraction(*e) for e in x.pop("extractions")] or None
        scorer = scorers[x.pop("model")]
        return (Cofold if kind == "Cofold" else Predict)(name, scorer, **({"entities": x.pop("entities")} if kind == "Cofold" else {}), extractions=ex, depends_on=deps, **x)
    if kind == "GenerateStage" and "make" in x:
        if lack := [m for m in x["make"] if m not in FUNCTIONS]:
            raise KeyError(f"no functions named {lack}")
        return GenerateStage(name, [FUNCTIONS[m] for m in x.pop("make")], depends_on=deps, **x)
    raise ValueError(f"a {kind} can't be made from its saved form")


def load_pipeline(spark: SparkSession, store: Store, definition_id: str, scorers: dict[str, Scorer], **options: Any) -> Pipeline:
    """A pipeline from a saved definition."""
    kind, stages = store.load_definition(definition_id)
    p = Pipeline(spark, store, kind=kind, **options)
    for s in stages:
        p.add(stage_from_spec(s, scorers))
    return p


def predict(spark: SparkSession, path: str, sequences: Sequence[str], scorer: Scorer, extractions: Any = "score", columns: Any = None, **options: Any) -> DataFrame:
    """Scores in one call."""
    return Pipeline(spark, Store(spark, path)).predict("predict", scorer, extractions, columns, **options).run(sequences)


def generate_sequences(spark: SparkSession, path: str, make: Maker | Sequence[Maker], sequences: Sequence[str] | None = None, **options: Any) -> DataFrame:
    """Generated sequences in one call."""
    return Pipeline(spark, Store(spark, path)).generate("generate", make, **options).run(sequences)


def single_step(spark: SparkSession, path: str, stage: Stage, sequences: Sequence[str] | None = None) -> DataFrame:
    """A pipeline of one stage."""
    return Pipeline(spark, Store(spark, path)).add(stage).run(sequences)


def embed(spark: SparkSession, path: str, sequences: Sequence[str], scorer: Scorer, key: str = "embedding", **options: Any) -> DataFrame:
    """Embeddings (sequence_id, sequence, values) in one call."""
    p = Pipeline(spark, Store(spark, path)).add(Predict("embed", scorer, embedding_key=key, action="encode", **options))
    wide = p.run(sequences)
    e = p.store.table("embeddings").where(F.col("model_name") == scorer.name).select("sequence_id", "values")
    return wide.select("sequence_id", "sequence").join(e, "sequence_id")
