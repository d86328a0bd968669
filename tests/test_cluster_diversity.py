import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.operators import cluster, diversity, generate


def points(spark, groups, dims=4, seed=1):
    rng = random.Random(seed)
    rows, i = [], 0
    for g, (centre, n) in enumerate(groups):
        for _ in range(n):
            rows.append((i, [centre + rng.gauss(0, 0.1) for _ in range(dims)], g))
            i += 1
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long"), rows


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_dbscan(spark):
    df, rows = points(spark, [(0, 12), (10, 9), (50, 1)])
    got = {r["id"]: r["cluster"] for r in cluster.dbscan(df, 2.0, 3).collect()}
    assert [got[r[0]] for r in rows] == [0] * 12 + [1] * 9 + [-1]
    assert {r["cluster"] for r in cluster.dbscan(df, 0.0001, 3).collect()} == {-1}
    assert cluster.dbscan(df.limit(0)).count() == 0


def test_neighbors_within_is_exact(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(150, 3))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    d = cluster.distances_between(v, v)
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if d[i, j] <= 0.7}
    assert {tuple(r) for r in cluster.neighbors_within(df, 0.7).collect()} == want


def test_kmeans_and_hierarchical(spark):
    df, rows = points(spark, [(0, 10), (5, 10), (10, 10)])
    truth = [r[2] for r in rows]
    for f in (cluster.kmeans, cluster.hierarchical):
        got = {r["id"]: r["cluster"] for r in f(df, 3).collect()}
        assert same_partition([got[r[0]] for r in rows], truth)
    with pytest.raises(ValueError):
        cluster.hierarchical(df, 2, limit=5)


def test_average_linkage_matches_a_naive_one():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(25, 3))
    sets = [[i] for i in range(25)]
    d = cluster.distances_between(v, v)
    while len(sets) > 4:
        i, j = min(((i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))), key=lambda p: d[np.ix_(sets[p[0]], sets[p[1]])].mean())
        sets[i] += sets.pop(j)
    want = [next(k for k, s in enumerate(sets) if i in s) for i in range(25)]
    assert same_partition(want, cluster.average_linkage(v, 4).tolist())


def test_medoid_and_silhouette_in_many_blocks(spark):
    df, rows = points(spark, [(0, 30), (5, 20)])
    v = np.array([r[1] for r in rows], np.float32).astype(float)
    lab = np.array([r[2] for r in rows])
    d = cluster.distances_between(v, v)
    want = {int(c): int(np.flatnonzero(lab == c)[d[np.ix_(lab == c, lab == c)].sum(1).argmin()]) for c in (0, 1)}
    p = cluster._points(df, "vec_id", "embedding", F.col("label").alias("cluster"))
    sums = {r["id"]: r["total"] for r in cluster.distance_sums(p, block=7).collect()}
    assert all(math.isclose(sums[i], d[i, lab == lab[i]].sum()) for i in range(50))
    assert {r["cluster"]: r["medoid_id"] for r in cluster.medoids(df).collect()} == want
    s = []
    for i in range(50):
        a = d[i, lab == lab[i]].sum() / ((lab == lab[i]).sum() - 1)
        b = d[i, lab != lab[i]].mean()
        s.append((b - a) / max(a, b))
    assert math.isclose(cluster.silhouette(df, block=8).first()[0], float(np.mean(s)))
    assert cluster.silhouette(df, limit=10).first()[0] is None
    assert cluster.silhouette(df.where("label = 0")).first()[0] is None


def test_query_distances(spark):
    df, _ = points(spark, [(0, 5), (1, 5)])
    got = cluster.query_distances(df.where("vec_id = 0"), df).collect()
    assert len(got) == 9 and {r["query_id"] for r in got} == {0}


def test_pca(spark):
    df, _ = points(spark, [(0, 20), (5, 20)])
    pc, explained = cluster.pca(df)
    assert pc.count() == 40 and explained[0] > 0.9


SEQS = ["MKTAYIAKQRQ", "MKTAYIAKQRR", "MKLAVIDSAQR"]


def test_diversity(spark):
    df = spark.createDataFrame([(s,) for s in SEQS], "sequence string")
    m = diversity.diversity_metrics(df).first()
    assert m["n_sequences"] == 3 and m["n_unique"] == 3
    h = []
    for col in zip(*SEQS):
        p = [col.count(c) / 3 for c in set(col)]
        h.append(-sum(x * math.log2(x + 1e-10) for x in p))
    assert math.isclose(m["shannon_entropy"], np.mean(h) / math.log2(20))
    same = spark.createDataFrame([("MKTAY",)] * 3, "sequence string")
    assert abs(diversity.shannon_entropy(same).first()[0]) < 1e-9
    assert diversity.shannon_entropy(same.limit(0)).first()[0] == 0.0
    motif = diversity.motif_diversity(df, 3).first()
    assert motif["total_kmers"] == 27 and motif["most_common"][0]["n"] == 2
    assert tuple(diversity.motif_diversity(df, 99).first())[:3] == (0, 0, 0.0)


def test_histogram_and_summary(spark):
    df = spark.createDataFrame([(float(i), "a" if i % 2 else None) for i in range(11)] + [(float("nan"), "b"), (None, "c")], "v double, s string")
    h = {r["bin"]: r["n"] for r in diversity.histogram(df, "v", 5).collect()}
    assert h == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    assert diversity.histogram(spark.createDataFrame([(1.0,)] * 4, "v double"), "v").first()["n"] == 4
    s = {r["column_name"]: r for r in diversity.summarize(df).collect()}
    assert s["s"]["nulls"] == 6 and s["s"]["n_unique"] == 3 and s["v"]["non_null"] == 12


def test_saturation(spark):
    df = spark.createDataFrame([(1, "MKTAYIAKQRQ")], "sequence_id long, sequence string")
    m = generate.saturation_mutants(df)
    assert m.count() == 209 and generate.saturation_mutants(df, positions=[0, 99]).count() == 19
    top = generate.saturation(df, lambda x: x.withColumn("score", F.when(F.col("sat_mut_aa") == "C", 1.0).otherwise(F.when(F.col("sat_position") == 0, None).otherwise(0.0))), top=12).collect()
    assert [r["score"] for r in top] == [1.0] * 11 + [0.0] and top[0]["mutant"] == "CKTAYIAKQRQ"


def test_fills_and_masks(spark):
    df = spark.createDataFrame([(1, "AC", [[9.0, 0.0], [0.0, 5.0], [3.0, 1.0], [9.0, 0.0]])], "sequence_id long, sequence string, logits array<array<double>>")
    got = [(r["position"], r["aa"], r["mutant"]) for r in generate.single_fills(df, "logits", "AC").collect()]
    assert got == [(0, "C", "CC"), (1, "A", "AA")]
    p = lambda **k: df.select(generate.mask_positions(F.lit("ABCDEFGHIJ"), **k).alias("p")).first()[0]
    assert len(set(p(fraction=0.35))) == 3 and len(p(fraction=0.01)) == 1
    assert set(p(fraction=0.9, conserved=range(8))) == {8, 9} and p(conserved=range(10)) == []
    assert p(explicit=[2, 50]) == [2] and p(strategy="low_confidence", fraction=0.2, confidences=F.array(*[F.lit(float(-i)) for i in range(10)])) == [9, 8]
    assert len(set(p(strategy="blocks", fraction=0.5))) == 5 and p(seed=1, fraction=0.5) == p(seed=1, fraction=0.5)


def fill(x):
    draw = lambda i: F.substring(F.lit("ACDEFGHIKLMNPQRSTVWY"), (F.pmod(F.xxhash64(F.col("variant"), F.col("_attempt"), i), F.lit(20)) + 1).cast("int"), F.lit(1))
    chars = F.filter(F.split("variant", ""), lambda c: c != "")
    return x.withColumn("variant", F.array_join(F.transform(chars, lambda c, i: F.when(F.array_contains("positions", i), draw(i)).otherwise(c)), ""))


def test_variants_and_refinement(spark):
    df = spark.createDataFrame([(1, "MKTAYIAKQRQ"), (2, "A")], "sequence_id long, sequence string")
    v = generate.variants(df, fill, 4, fraction=0.3).collect()
    one = [r["variant"] for r in v if r["sequence_id"] == 1]
    assert len(one) == len(set(one)) == 4 and "MKTAYIAKQRQ" not in one
    assert all(r["num_mutations"] > 0 for r in v)
    start = df.where("sequence_id = 1")
    count_w = lambda x: x.withColumn("fitness", (F.length("sequence") - F.length(F.replace("sequence", F.lit("W"), F.lit("")))).cast("double"))
    out = generate.refine(start, fill, count_w, rounds=2, population=6, keep=2, fraction=0.4).collect()
    assert len(out) == 2 and out[0]["fitness"] >= 0
    with pytest.raises(ValueError):
        generate.refine(start, fill, count_w, population=3, keep=3)
