import pytest
from pyspark.sql import functions as F

from strandflow.operators import filters as flt
from strandflow.operators import sampling

ROWS = [(1, "MKTAYIAKQRQ", 65.0, 85.0, 0.5), (2, "MKLAVIDSAQ", 55.0, 75.0, 1.0), (3, "MKTAYIDSAQ", 70.0, 90.0, 1.0), (4, "MKTAY", 45.0, 70.0, 1.5), (5, "MKTAYIAKQRQGHQAMAEIKQGHQAMAEIKQ", 60.0, 80.0, 0.5), (6, None, None, float("nan"), None)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "sequence_id long, sequence string, tm double, plddt double, temperature double")


def ids(d):
    return sorted(r["sequence_id"] for r in d.collect())


def test_threshold(df):
    assert ids(flt.Threshold("tm", min=60).apply(df)) == [1, 3, 5]
    assert ids(flt.Threshold("tm", min=60, max=65).apply(df)) == [1, 5]
    assert ids(flt.Threshold("tm", max=50, keep_na=True).apply(df)) == [4, 6]
    assert ids(flt.Threshold("plddt").apply(df)) == [1, 2, 3, 4, 5]
    assert ids(flt.Threshold("plddt", min=85, keep_na=True).apply(df)) == [1, 3, 6]


def test_other_filters(df):
    assert ids(flt.LengthRange(5, 10).apply(df)) == [2, 3, 4]
    assert ids(flt.LengthRange().apply(df)) == [1, 2, 3, 4, 5, 6]
    assert ids(flt.Conserved({0: ["M"], 7: ["S", "K"]}).apply(df)) == [1, 2, 3, 5]
    assert ids(flt.Conserved({0: ["M"]}, reference_length=5).apply(df)) == [4]
    assert ids(flt.Alphabet("MKTAYI").apply(df)) == [4]
    h = flt.HammingRange("MKTAYIAKQRQ", max=6).apply(df)
    assert {r["sequence_id"]: r["hamming_distance"] for r in h.collect()} == {1: 0, 3: 5, 4: 6}


def test_ranking(spark, df):
    assert ids(flt.Ranking("tm", n=2).apply(df)) == [1, 3]
    assert ids(flt.Ranking("tm", n=2, method="bottom").apply(df)) == [2, 4]
    hundred = spark.createDataFrame([(i, float(i)) for i in range(100)], "sequence_id long, tm double")
    assert flt.Ranking("tm", percentile=10).apply(hundred).count() == 10
    assert flt.Ranking("tm", percentile=90).apply(hundred).count() == 90
    ties = spark.createDataFrame([(i, 1.0) for i in range(9, -1, -1)], "sequence_id long, tm double")
    assert ids(flt.Ranking("tm", n=3).apply(ties)) == [0, 1, 2]
    assert flt.Ranking("tm", percentile=10).apply(ties).count() == 10
    with pytest.raises(ValueError):
        flt.Ranking("tm").apply(df)
    assert flt.Ranking("tm", percentile=10).apply(df.limit(0)).count() == 0


def test_sampling(spark, df):
    hundred = spark.createDataFrame([(i, float(i)) for i in range(100)], "sequence_id long, tm double").repartition(7)
    assert ids(flt.Sample(5, "spread", "tm").apply(hundred)) == [0, 24, 49, 74, 99]
    assert ids(flt.Sample(3, "top", "tm").apply(hundred)) == [97, 98, 99]
    a = ids(flt.Sample(10).apply(hundred))
    assert a == ids(flt.Sample(10).apply(hundred.repartition(3))) and len(a) == 10
    assert flt.Sample(200).apply(hundred).count() == 100
    kept = ids(flt.Sample(10).keep_earlier(hundred, hundred.where("sequence_id < 4")))
    assert set(range(4)) <= set(kept) and len(kept) == 10
    assert flt.Sample(1, "spread", "tm").apply(hundred).count() == 1


def test_ranked_is_dense_and_ordered(spark):
    d = spark.createDataFrame([(i * 7919 % 1009,) for i in range(1009)], "v long").repartition(5)
    assert all(r["rank0"] == r["v"] for r in sampling.ranked(d, [F.col("v")]).collect())


def test_composite_and_specs(df):
    f = flt.combine(flt.Threshold("tm", min=50), flt.LengthRange(max=11), flt.Conserved({0: ["M"]}), flt.Ranking("tm", n=2))
    assert ids(f.apply(df)) == [1, 3] and f.needs_all
    again = flt.filter_from_spec(f.spec())
    assert ids(again.apply(df)) == [1, 3] and again.spec() == f.spec()
    assert not flt.combine(flt.Threshold("tm")).needs_all
    with pytest.raises(ValueError):
        flt.Custom(lambda d: d).spec()
    with pytest.raises(ValueError):
        flt.filter_from_spec({"type": "Nope"})
    with pytest.raises(ValueError):
        flt.Custom(lambda d: d.drop("sequence_id"), must_have="sequence_id").apply(df)


def test_store_thresholds(spark):
    s = spark.createDataFrame([(1,), (2,), (3,), (3,)], "sequence_id long")
    p = spark.createDataFrame([(1, "m", "tm", 50.0), (2, "m", "tm", None), (2, "n", "tm", 70.0), (1, "m", "x", 99.0)], "sequence_id long, model_name string, prediction_type string, value double")
    assert ids(flt.Threshold("tm", min=60).in_store(s, p)) == [2]
    assert ids(flt.Threshold("tm", min=60).in_store(s, p, "m")) == []
    assert ids(flt.Threshold("tm", min=60, keep_na=True).in_store(s, p)) == [2, 3]
