"""Exact quantiles, roll-ups, enrichment, logging, generation sources, distance rows, named functions."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.frame import SequenceFrame
from strandflow.operators import cluster, filters, quantiles, sampling
from strandflow.operators import relational as R
from strandflow.operators.filters import Custom, filter_from_spec, named
from strandflow.plans.outputs import load_outputs, log_entries, union_rules, write_log
from strandflow.plans.pipeline import GenerateStage, Pipeline, Predict, SourceStage, generate_sequences, load_pipeline, single_step, structure_files
from strandflow.plans.protocols import check_supported
from strandflow.scoring import LocalScorer
from strandflow.store import Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


@pytest.mark.parametrize("most", [100_000, 5])
def test_exact_quantile(spark, most):
    rng = random.Random(1)
    for values in ([rng.gauss(0, 1) for _ in range(3000)], [float(rng.randint(0, 8)) for _ in range(2000)], [7.0], [1.0, 2.0], [5.0] * 50 + [6.0]):
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double")
        for p in (0.0, 0.1, 0.25, 0.5, 0.9, 1.0):
            got = quantiles.exact_quantile(df, F.col("x"), p, k=200, error=0.02, most=most)
            assert got == pytest.approx(np.quantile(values, p), abs=1e-12), (p, len(values))
    assert quantiles.exact_quantile(spark.createDataFrame([], "x double"), F.col("x"), 0.5) is None


def test_percentile_keeps_ties(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 2, 2, 3, None or 9])], "sequence_id long, x double")
    assert {r["x"] for r in sampling.percentile_keep(df, "x", 50).collect()} == {2.0, 3.0, 9.0}


def test_status_roll_up(spark):
    rows = [(1, "Done"), (1, "done "), (2, "done"), (2, None), (3, "done"), (3, "FAILED"), (4, None), (None, "done")]
    df = spark.createDataFrame(rows, "k long, s string")
    got = {r["k"]: r["status"] for r in R.status_roll_up(df, ["k"], "s", [("broken", ["failed"])], [("finished", ["done"])], "open").collect()}
    assert got == {1: "finished", 2: "open", 3: "broken", 4: "open", None: "finished"}


def test_types_that_differ_in_case_only_get_columns_of_their_own(spark):
    p = spark.createDataFrame([(1, 1, "m", "TM", 5.0), (2, 1, "m", "tm", 6.0)], "prediction_id long, sequence_id long, model_name string, prediction_type string, value double")
    r = R.export_wide(spark.createDataFrame([(1,)], "sequence_id long"), p).first()
    assert r.asDict() == {"sequence_id": 1, "TM": 5.0, "tm_2": 6.0}


def test_frame_enrichment(spark):
    f = SequenceFrame(spark.createDataFrame([("a", "MK"), ("b", "MKL"), ("c", "MKLV")], "id string, sequence string"))
    out = f.models.predict(LocalScorer("len-x", lambda x: {"log_prob": len(x["sequence"])})).df
    assert {r["id"]: r["len_x_predict"] for r in out.collect()} == {"a": "2", "b": "3", "c": "4"}
    out = f.models.embed(LocalScorer("e", lambda x: {"embedding": [1, len(x["sequence"])]}), column="v").df
    assert {r["id"]: r["v"] for r in out.collect()}["c"] == [1.0, 4.0]
    lab = SequenceFrame(spark.createDataFrame([("a", 1.5)], "id string, metric_y double"))
    assert {r["id"]: r["metric_y"] for r in f.lab.merge(lab).df.collect()} == {"a": 1.5, "b": None, "c": None}


RULES = [
    {"where": "${{ s > 1 }}", "order_by": [{"field": "s", "order": "desc"}], "limit": None, "log": {"params": {"p": "${{ s }}", "fix": "x"}, "tags": {"t": "one"}, "artifacts": [{"type": "seqparse", "name": "s.json", "content": "${{ sequence }}"}, {"type": "json", "name": "j", "content": "${{ sequence }}"}]}},
    {"where": "${{ s > 2 }}", "log": {"tags": {"t": "two"}, "metrics": {"m": "${{ s * 2 }}", "bad": "${{ nope }}"}, "artifacts": [{"type": "seqparse", "name": "two.json", "entries": [{"sequence": "${{ sequence }}", "id": "q"}, {"sequence": "MKL"}]}]}},
    {"where": "${{ s > 0 }}"},
]


def test_log_entries_and_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", "MKV", 1.0), ("b", "ACGT", 2.0), ("c", None, 3.0)], "id string, sequence string, s double")
    got = {(r["id"], r["what"], r["key"]): r["value"] for r in log_entries(df, RULES).collect()}
    assert {k for k in got if k[0] == "a"} == set()
    assert got["b", "params", "p"] == "2.0" and got["b", "tags", "t"] == "one" and got["c", "tags", "t"] == "two"
    assert got["c", "metrics", "m"] == "6.0" and ("c", "metrics", "bad") not in got
    assert json.loads(got["b", "artifacts", "s.json"])["seq"] == "ACGT" and got["b", "artifacts", "j"] == "ACGT" and ("c", "artifacts", "j") not in got
    assert json.loads(got["c", "artifacts", "two.json"])["seq"] == "MKL"
    out = str(tmp_path / "log")
    write_log(df, {"outputs": RULES, "aggregates": [{"field": "s", "ops": ["mean"]}]}, out)
    assert [r["value"] for r in spark.read.parquet(f"{out}/metrics").collect()] == [6.0]
    assert spark.read.parquet(f"{out}/artifacts").count() == 3 and spark.read.parquet(f"{out}/aggregates").count() == 1
    with pytest.raises(ValueError):
        log_entries(df, [{"log": {"artifacts": [{"type": "pdb", "name": "x"}]}}])
    assert log_entries(df, [{"where": "${{ s > 0 }}"}]).count() == 0
    for bad in ({"outputs": {}}, {"outputs": [1]}, {"aggregates": {}}, {"aggregate_over": "some"}):
        with pytest.raises(ValueError):
            load_outputs(bad)
    assert [r["id"] for r in union_rules(df, RULES[:1]).collect()] == ["c", "b"]


def test_conditions_that_would_be_ignored_are_refused():
    task = {"id": "t", "slug": "m", "action": "predict", "request_body": {"items": []}, "skip_if_empty": "x"}
    with pytest.raises(ValueError):
        check_supported({"name": "p", "tasks": [task]})


@named
def doubled(x):
    return x.select(F.concat("sequence", "sequence").alias("sequence"))


@named
def only_long(x):
    return x.where("length > 3")


def failing(x):
    raise RuntimeError("no such model")


def test_generation_sources_runs_and_failures(spark, store, tmp_path):
    runs = lambda x: x.select(F.concat("sequence", F.col("run").cast("string")).alias("sequence"))
    with pytest.warns(RuntimeWarning):
        p = Pipeline(spark, store, run_id="r1").add(GenerateStage("g", [failing, runs], runs=2, skip_on_error=True))
        assert {r["sequence"] for r in p.run(["mk", "AC"]).collect()} == {"MK0", "MK1", "AC0", "AC1"}
    with pytest.raises(RuntimeError):
        Pipeline(spark, store).add(GenerateStage("g", [failing], skip_on_error=False)).run(["MK"])
    back = Pipeline(spark, store, run_id="r1").add(SourceStage("s")).run([])
    assert {r["sequence"] for r in back.collect()} == {"MK0", "MK1", "AC0", "AC1"}  # those that the run made
    assert Pipeline(spark, store, run_id="r2").add(SourceStage("s")).run([]).count() == 7
    (tmp_path / "x.fasta").write_text(">a\nMKV\n>b\nMKL\n")
    assert {r["sequence"] for r in Pipeline(spark, store).source("f", str(tmp_path / "x.fasta")).run([]).collect()} == {"MKV", "MKL"}
    ids = {r["sequence"]: r["sequence_id"] for r in store.table("sequences").collect()}
    (tmp_path / f"{ids['AC']}.pdb").write_text("ATOM\n")
    make = lambda x: x.where("structure_str is not null").select(F.concat(F.trim(F.regexp_replace("structure_str", "\\s", "")), "sequence").alias("sequence"))
    p = Pipeline(spark, store).add(GenerateStage("g", make, inputs=structure_files(str(tmp_path / "*.pdb"))))
    assert [r["sequence"] for r in p.run(["mk", "AC"]).collect()] == ["ATOMAC"]
    assert {r["sequence"] for r in generate_sequences(spark, str(tmp_path / "s2"), doubled, ["AC"]).collect()} == {"ACAC"}
    assert single_step(spark, str(tmp_path / "s3"), SourceStage("s", ["AB", "AB", None, " "])).count() == 1


def test_named_functions_come_back_from_a_definition(spark, store):
    p = Pipeline(spark, store).generate("g", doubled).filter("f", Custom(only_long, name="only_long"))
    assert {r["sequence"] for r in p.run(["A", "AC"]).collect()} == {"ACAC"}
    key = store.table("pipeline_definitions").first()["definition_id"]
    again = load_pipeline(spark, store, key, {})
    assert {r["sequence"] for r in again.run(["A", "AC"]).collect()} == {"ACAC"}
    with pytest.raises(KeyError):
        filter_from_spec({"type": "Custom", "name": "unknown", "all_rows": False, "must_have": None})
    with pytest.raises(ValueError):
        Custom(failing).spec()
    assert filters.FUNCTIONS["only_long"] is only_long


def test_diff_and_embedding_functions(spark, store):
    p = Pipeline(spark, store).predict("s", LocalScorer("m"))
    p.run(["A", "C"])
    p = Pipeline(spark, store).predict("s", LocalScorer("m"))
    p.run(["C", "D", "D"], diff=True)
    assert (p.results["input"].n_in, p.results["input"].cached, p.results["input"].computed) == (2, 1, 1)
    scorer = LocalScorer("v", lambda x: {"deep": {"x": [len(x["sequence"]), 2]}})
    Pipeline(spark, store).add(Predict("e", scorer, action="encode", embedding_key=lambda r: r["deep"]["x"])).run(["ACG"])
    assert store.table("embeddings").first()["values"] == [3.0, 2.0]


def test_distance_rows(spark, store):
    e = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (5, [0.0, 1.0]), (6, None)], "vec_id long, embedding array<double>")
    rows = {r["id"]: r["v"] for r in cluster.distance_rows(e).collect()}
    assert rows[1] == [0.0, 5.0, 1.0] and set(rows) == {1, 2, 5}
    with pytest.raises(ValueError):
        cluster.distance_rows(e, limit=2)
    s = spark.createDataFrame([(1, "AAAA"), (2, "AAAC"), (3, "AA"), (4, None)], "sequence_id long, sequence string")
    h = {r["id"]: r["v"] for r in cluster.hamming_rows(s).collect()}
    assert h == {1: [0.0, 0.25, 0.5], 2: [0.25, 0.0, 0.5], 3: [0.5, 0.5, 0.0]}
    assert cluster.hamming_rows(s.limit(0)).count() == 0
    with pytest.warns(ResourceWarning):
        cluster.hamming_rows(s, slow=2)
    with pytest.raises(ValueError):
        cluster.hamming_rows(s, refused=2)
    p = Pipeline(spark, store).cluster("c", metric="hamming", k=2)
    p.run(["AAAA", "AAAC", "GGGG", "GGGC"])
    assert store.table("predictions").where("prediction_type = 'c'").select("value").distinct().count() == 2


def test_compact_rewrites_the_log(spark, store):
    store.put("k", "1")
    store.put("k", "2")
    assert store.log("pipeline_metadata").count() == 2
    store.compact("pipeline_metadata")
    assert store.log("pipeline_metadata").count() == 1 and store.get("k") == "2"
