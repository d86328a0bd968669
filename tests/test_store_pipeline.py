import pytest
from pyspark.sql import functions as F

from strandflow.operators import filters as flt
from strandflow.operators import relational as R
from strandflow.plans import expressions as X
from strandflow.plans.outputs import combine_rules, rule_aggregates, select_rows, sequence_artifacts, union_rules
from strandflow.plans.pipeline import ClusterStage, GenerateStage, Pipeline, Predict, Stage, embed, levels, load_pipeline, predict
from strandflow.plans.protocols import check_supported, resolve_sequences, run_protocol, template_variables, validate
from strandflow.scoring import FatalScorerError, LocalScorer, RateLimit, ScorerError, run_batch
from strandflow.store import Store
from strandflow.streaming.runner import check_streamable, filter_stream, latest_stream, read_stream, score_stream


def seqs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "_pos long, sequence string")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_dedup_insert(spark, store):
    a = store.add_sequences(seqs(spark, "S1", "S2", "S3", "S1"), position="_pos")
    ids = {r["_pos"]: r["sequence_id"] for r in a.collect()}
    assert ids == {0: 1, 1: 2, 2: 3, 3: 1}
    b = {r["_pos"]: r["sequence_id"] for r in store.add_sequences(seqs(spark, "S2", "S3", "S4", "S5"), position="_pos").collect()}
    assert b == {0: 2, 1: 3, 2: 4, 3: 5} and store.table("sequences").count() == 5
    assert store.count_matching(seqs(spark, "S1", "S1", "S9")) == 2
    assert store.find("S4").first()["sequence_id"] == 4
    with pytest.raises(ValueError):
        store.add_sequences(seqs(spark, "A", None), position="_pos")


def test_diff_batches(spark, store):
    store.add_sequences(seqs(spark, *[f"A{i}" for i in range(500)]), position="_pos")
    store.add_sequences(seqs(spark, *[f"A{i}" for i in range(250, 750)]), position="_pos")
    t = store.table("sequences")
    assert t.count() == 750 and t.select("sequence_id").distinct().count() == 750 and store.next_id("sequences") == 751


def test_multi_column_records(spark, store):
    rows = spark.createDataFrame([(0, "H", "L1"), (1, "H", "L2"), (2, "H", "L1")], "_pos long, heavy string, light string")
    got = {r["_pos"]: r["sequence_id"] for r in store.add_sequences(rows, ["heavy", "light"], "_pos").collect()}
    assert got == {0: 1, 1: 2, 2: 1} and "light" in store.table("sequences").columns


def test_predictions_upsert(spark, store):
    schema = "sequence_id long, prediction_type string, model_name string, value double"
    store.add_predictions(spark.createDataFrame([(1, "tm", "m", 50.0), (2, "tm", "m", float("nan"))], schema))
    store.add_predictions(spark.createDataFrame([(1, "tm", "m", None), (2, "tm", "m", 60.0), (3, "tm", "m", 70.0)], schema))
    assert {r["sequence_id"]: r["value"] for r in store.table("predictions").collect()} == {1: 50.0, 2: 60.0, 3: 70.0}
    store.compact("predictions")
    assert store.log("predictions").count() == 3
    ids = spark.createDataFrame([(1,), (2,), (9,)], "sequence_id long")
    assert [r[0] for r in store.uncached(ids, "tm", "m").collect()] == [9]
    assert {r[0] for r in store.with_prediction(ids, "tm").collect()} == {1, 2}


def test_uncached_counts_failures_as_cached(spark):
    p = spark.createDataFrame([(1, "tm", "m", None, '{"status": "failed"}'), (2, "tm", "m", None, None), (3, "tm", "m", 1.0, None)], "sequence_id long, prediction_type string, model_name string, value double, metadata string")
    assert {r[0] for r in R.uncached(spark.range(1, 5).toDF("sequence_id"), p, "tm", "m").collect()} == {2, 4}


def test_other_tables(spark, store):
    store.put("k", "1")
    store.put("k", "2")
    assert store.get("k") == "2" and store.get("none") is None
    store.put_context("r", "k", {"a": [1]})
    assert store.get_context("r", "k") == {"a": [1]}
    store.complete_stage("r", "s", 5, 3)
    store.complete_stage("r", "s", 9, 9)
    assert store.stage_done("r", "s") == (5, 3)
    store.set_attributes(spark.createDataFrame([(1, "a", "x")], "sequence_id long, attr_name string, attr_value string"))
    store.set_attributes(spark.createDataFrame([(1, "a", "y")], "sequence_id long, attr_name string, attr_value string"))
    assert store.table("sequence_attributes").first()["attr_value"] == "y"
    e = "sequence_id long, model_name string, layer int, values array<float>"
    store.add_embeddings(spark.createDataFrame([(1, "m", None, [1.0])], e))
    store.add_embeddings(spark.createDataFrame([(1, "m", None, [2.0]), (1, "n", None, [3.0])], e))
    assert store.table("embeddings").count() == 2
    assert store.embeddings_concat(["m", "n"]).first()["values"] == [2.0, 3.0]
    big = "x" * 6000
    d = store.save_definition("k", [{"a": big, "b": [1, {"c": "d"}]}])
    assert store.load_definition(d) == ("k", [{"a": big, "b": [1, {"c": "d"}]}])
    assert {r["table_name"]: r["n_rows"] for r in store.stats().collect()}["embeddings"] == 2
    assert store.query("select count(*) as n from embeddings").first()["n"] == 2
    with pytest.raises(ValueError):
        store.query("drop table x")


def half():
    return LocalScorer("half", lambda x: {"score": len(x["sequence"]) / 2})


def test_pipeline_with_filter_cache_and_resume(spark, store):
    def make(resume=False):
        p = Pipeline(spark, store, run_id="r1", resume=resume)
        return p.predict("score", half()).filter("long", flt.Threshold("score", min=2)).filter("best", flt.Ranking("score", n=2))

    p = make()
    out = p.run(["AA", "AAAA", "AAAAAA", "AAAAAAAA", "AA"])
    assert sorted(r["score"] for r in out.collect()) == [3.0, 4.0]
    assert (p.results["score"].n_in, p.results["score"].computed) == (4, 4)
    q = make(resume=True)
    assert sorted(r["score"] for r in q.run(["AA", "AAAA", "AAAAAA", "AAAAAAAA"]).collect()) == [3.0, 4.0]
    assert all(r.resumed for r in q.results.values())
    fresh = Pipeline(spark, store).predict("score", half())
    fresh.run(["AA", "CCCC"])
    assert (fresh.results["score"].cached, fresh.results["score"].computed) == (1, 1)
    assert [r["stage_name"] for r in p.funnel().collect()] == ["score", "long", "best"]
    assert p.query_results("length > 5", ["score", "sequence"]).count() == 2
    assert fresh.merged_results(seqs(spark, "CCCC"), ["score"]).first()["score"] == 2.0
    assert p.explore().where("what = 'type'").first()["n"] == 5


def test_pipeline_merges_levels(spark, store):
    p = Pipeline(spark, store)
    p.predict("score", half())
    p.filter("a", flt.Threshold("score", min=2), depends_on=["score"]).filter("b", flt.Threshold("score", max=3), depends_on=["score"])
    assert sorted(r["score"] for r in p.run(["AA", "AAAA", "AAAAAA", "AAAAAAAA"]).collect()) == [2.0, 3.0]
    with pytest.raises(ValueError):
        Pipeline(spark, store).predict("x", half()).predict("x", half())
    with pytest.raises(ValueError):
        Pipeline(spark, store).predict("x", half()).predict("y", half())
    with pytest.raises(ValueError):
        levels([Stage("a", ["b"]), Stage("b", ["a"])])
    with pytest.raises(ValueError):
        levels([Stage("a", ["zzz"])])


def test_failures(spark, store):
    def picky(x):
        return {"error": "no", "status_code": 400} if "X" in x["sequence"] else {"score": 1.0}

    p = Pipeline(spark, store).predict("s", LocalScorer("picky", picky), skip_on_error=True)
    assert p.run(["AAA", "AXA", "nan"]).count() == 1
    assert store.uncached(store.table("sequences").select("sequence_id"), "score", "picky").count() == 0
    with pytest.raises(ScorerError):
        run_batch(LocalScorer("picky", picky), [{"sequence": "X"}], "predict", {}, False)

    class Short(LocalScorer):
        def score_batch(self, items, action, params):
            return []

    assert run_batch(Short(), [{"a": 1}], "predict", {}, True)[0] == [None]
    fatal = LocalScorer("f", lambda x: {"error": "pay", "status_code": 402})
    with pytest.raises(FatalScorerError):
        run_batch(fatal, [{"sequence": "A"}], "predict", {}, True)


def test_rate_limit():
    now, slept = [0.0], []

    def sleep(t):
        slept.append(t)
        now[0] += t

    r = RateLimit(2, 10.0, lambda: now[0], sleep)
    for _ in range(3):
        r.wait()
    assert slept == [10.0]


def test_generation_and_clusters(spark, store):
    p = Pipeline(spark, store)
    p.generate("make", lambda df: df.selectExpr("sequence || 'w' as sequence"), label="new").predict("score", half())
    out = p.run(["AAA", "CCC"])
    assert {r["sequence"] for r in out.collect()} == {"AAAW", "CCCW"} and {r["source_label"] for r in out.collect()} == {"new"}
    q = Pipeline(spark, store).add(Predict("e", LocalScorer("enc"), embedding_key="embedding", action="encode"))
    q.add(ClusterStage("groups", "enc", "kmeans", k=2))
    assert q.run(["AAA", "CCC", "GGG"]).count() == 3
    assert {r[0] for r in store.table("predictions").select("prediction_type").distinct().collect()} >= {"groups", "groups_centroid"}


def test_saved_definition_runs_again(spark, store):
    p = Pipeline(spark, store, run_id="a").predict("score", half()).filter("f", flt.Threshold("score", min=2))
    p.run(["AA", "AAAA"])
    d = store.table("pipeline_runs").where("run_id = 'a'").first()["definition_id"]
    again = load_pipeline(spark, store, d, {"half": half()}, run_id="b")
    assert again.run(["AA", "AAAA", "AAAAAA"]).count() == 2
    with pytest.raises(KeyError):
        load_pipeline(spark, store, d, {})
    with pytest.raises(ValueError):
        from strandflow.plans.pipeline import stage_from_spec

        stage_from_spec(GenerateStage("g", lambda d: d).spec(), {})


def test_one_liners(spark, tmp_path):
    assert predict(spark, str(tmp_path / "a"), ["AAAA"], half()).first()["score"] == 2.0
    assert len(embed(spark, str(tmp_path / "b"), ["AAAA"], LocalScorer("enc")).first()["values"]) == 8


# --- Expressions, outputs, protocols ---


def test_where(spark):
    df = spark.createDataFrame([(1, 80.0, "a"), (2, None, "b"), (3, 60.0, ""), (4, 90.0, None)], "i int, x double, s string")
    w = lambda e: [r["i"] for r in X.where(df, e).orderBy("i").collect()]
    assert w("${{ x > 70 }}") == [1, 4]
    assert w("x > 70 and i < 3") == [1]
    assert w("i < 3 or x > 70") == [1, 2, 4]
    assert w("x > 70 or i < 3") == [1, 4]  # a missing value on the left fails the whole
    assert w("not x > 70") == [3] and w("50 < x <= 80") == [1, 3]
    assert w("s") == [1, 2] and w("s in ['a', 'b']") == [1, 2] and w("x is None") == [2]
    assert w("nothing > 1") == [] and w("x >") == [] and w("__import__('os')") == []
    assert w("x / (i - 1) > 0") == [3, 4] and w("len(s) == 1 and abs(-i) > 1") == [2]
    assert X.evaluate("max(a, 2) * 10 if a else 0", {"a": 3}) == 30
    for bad in ("a.__class__", "open('x')", "(lambda: 1)()", "[x for x in a]"):
        with pytest.raises((ValueError, KeyError)):
            X.evaluate(bad, {"a": [1]})


def test_rules(spark):
    df = spark.createDataFrame([(0, 0.9, 1), (1, 0.8, 2), (2, 0.3, 3), (3, 0.9, 1)], "_position long, score double, id int")
    rules = [{"where": "score > 0.5", "limit": 2, "log": {"tags": {"a": "1"}}}, {"where": "${{ score < 0.85 }}", "order_by": [{"field": "score", "order": "desc"}], "log": {"tags": {"a": "2", "b": "x"}, "artifacts": [{"k": 1}]}}]
    assert [r["id"] for r in union_rules(df, rules).collect()] == [1, 2, 3]
    assert select_rows(df, {"limit": "${{ id + 1 }}"}).count() == 2
    assert select_rows(spark.range(300).toDF("id"), {}).count() == 200 and select_rows(spark.range(300).toDF("id"), {"limit": None}).count() == 300
    c = {r["_position"]: r for r in combine_rules(df, rules).collect()}
    assert c[0]["tags"] == {"a": "1"} and c[1]["tags"] == {"a": "2", "b": "x"} and c[1]["artifacts"] == ['{"k": 1}'] and 3 not in c
    agg = {r["metric"]: r["value"] for r in rule_aggregates(df, {"aggregate_over": "all", "aggregates": [{"field": "score", "ops": ["mean", "max", "std", "p50"]}, {"field": "__rows__", "ops": ["count"]}, {"field": "zzz", "ops": ["mean"]}]}).collect()}
    assert agg["__rows__.count"] == 4 and round(agg["score.mean"], 4) == 0.725 and round(agg["score.p50"], 3) == 0.85 and "zzz.mean" not in agg
    one = {r["metric"]: r["value"] for r in rule_aggregates(df.limit(1), {"aggregate_over": "all", "aggregates": [{"field": "score", "ops": ["std"]}]}).collect()}
    assert one["score.std"] == 0.0
    assert sequence_artifacts(spark.createDataFrame([("a", "MK"), ("b", None)], "id string, sequence string")).count() == 1


FOLD = {"name": "fold", "inputs": {"sequences": {"type": "list_of_str", "required": True}}, "tasks": [{"id": "fold", "slug": "fold", "action": "predict", "request_body": {"items": "${{ sequences }}", "params": {"n": "${{ 1 + 1 }}"}}, "response_mapping": {"mean_plddt": "mean_plddt", "pdb": "results[*].pdb"}}], "outputs": [{"where": "${{ mean_plddt > 70 }}", "order_by": [{"field": "mean_plddt", "order": "desc"}], "limit": 2}]}


def test_protocol(spark, tmp_path):
    values = {"A": 65.0, "C": 88.0, "D": 92.0, "E": 71.0}
    scorer = LocalScorer("fold", lambda x: {"mean_plddt": values[x["sequence"]], "pdb": "ATOM " + x["sequence"]})
    run = run_protocol(spark, FOLD, {"sequences": list(values)}, {"fold": scorer}, str(tmp_path / "p"))
    assert [r["mean_plddt"] for r in run.selected.collect()] == [92.0, 88.0]
    assert run.records.count() == 4 and run.pipeline.store.latest_structures().count() == 4
    (tmp_path / "p.yaml").write_text("name: x\ninputs: {}\ntasks:\n  - id: a\n    depends_on: [b]\n  - id: b\n    depends_on: [a]\n  - id: b\n    depends_on: [zz]\n    x: '${{ }}'\n")
    v = validate(str(tmp_path / "p.yaml"))
    text = " ".join(m for m, _ in v.errors)
    assert not v.is_valid and "twice" in text and "zz" in text and "empty template" in text
    assert "circle" in " ".join(m for m, _ in validate({"name": "x", "tasks": [{"id": "a", "depends_on": ["b"]}, {"id": "b", "depends_on": ["a"]}]}).errors)
    assert validate(FOLD).is_valid and template_variables(FOLD) == {"sequences"}
    for extra in ({"foreach": "sequences"}, {"gather": True}, {"slug": None}):
        with pytest.raises(ValueError):
            check_supported({"tasks": [{**FOLD["tasks"][0], **extra}]})
    assert resolve_sequences({"inputs": {"x": {"type": "text"}}}, {"x": "MK"}) == ["MK"]
    assert resolve_sequences({"inputs": {"l": {"type": "list_of_str"}}}, {"sequences": ["A"], "l": [{"sequence": "B"}]}) == ["B"]
    with pytest.raises(ValueError):
        resolve_sequences({}, {"other": 1})


# --- Streams ---


def test_streams(spark, tmp_path, store):
    rows = spark.createDataFrame([(i, "A" * i) for i in range(1, 41)], "sequence_id long, sequence string")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stage = Predict("s", half(), "score")
    seen = []

    def go():
        q = score_stream(read_stream(spark, str(tmp_path / "in"), "sequence_id long, sequence string", 2), stage, [flt.Threshold("score", min=10)], str(tmp_path / "out"), str(tmp_path / "cp"), lambda df, n: seen.append(df.count()), store)
        q.awaitTermination()

    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 21 and sum(seen) == 21 and len(seen) == 2
    go()  # nothing new: the checkpoint knows what was read
    assert len(seen) == 2
    rows.where("sequence_id > 38").withColumn("sequence_id", F.col("sequence_id") + 100).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 23
    with pytest.raises(ValueError):
        check_streamable([flt.Ranking("score", n=1)])
    filter_stream(read_stream(spark, str(tmp_path / "in"), "sequence_id long, sequence string"), [flt.LengthRange(max=5)], str(tmp_path / "f"), str(tmp_path / "fc")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "f")).count() == 5
    latest_stream(read_stream(spark, str(tmp_path / "in"), "sequence_id long, sequence string"), ["sequence"], "sequence_id", "late", str(tmp_path / "lc")).awaitTermination()
    assert spark.sql("select max(sequence_id) m from late").first()["m"] == 140
