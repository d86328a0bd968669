"""Clustering of vectors, medoids and silhouettes, with distances computed in blocks."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .components import connected_components

BLOCK = 1000
PAIRWISE_LIMIT = 10_000  # rows beyond which quadratic measures are refused


def _points(df: DataFrame, id_column: str, values: str, *more: str) -> DataFrame:
    return df.where(F.col(values).isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(values).cast("array<double>").alias("v"), *more)


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, 0))


def distances_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of two matrices, from differences (exact 0 for equal rows)."""
    out = np.empty((len(a), len(b)))
    for i in range(0, len(a), 64):
        out[i : i + 64] = np.sqrt(((a[i : i + 64, None, :] - b[None, :, :]) ** 2).sum(-1))
    return out


def query_distances(queries: DataFrame, points: DataFrame, id_column: str = "vec_id", values: str = "embedding") -> DataFrame:
    """(query_id, id, distance) of a stated set of queries against all other points.

    Queries are cut into blocks of at most ``BLOCK``; each block is sent to all partitions of the points in
    turn. Vectors of another length than the query's are left out.
    """
    q = _points(queries, id_column, values)
    n = q.count()
    blocks = max(1, -(-n // BLOCK))
    q = staged(q.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(blocks))), "queries")
    p = _points(points, id_column, values)
    spark, out = points.sparkSession, None
    for b in range(blocks):
        rows = q.where(F.col("blk") == b).select("id", "v").toPandas()
        sent = spark.sparkContext.broadcast((rows["id"].to_numpy(), list(rows["v"])))

        def run(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, vecs = sent.value
            by_len: dict[int, list[int]] = {}
            for i, v in enumerate(vecs):
                by_len.setdefault(len(v), []).append(i)
            for pdf in frames:
                size = pdf["v"].map(len)
                for width, own in by_len.items():
                    part = pdf[size == width]
                    if not len(part) or not width:
                        continue
                    d = distances_between(np.array([vecs[i] for i in own], float), _matrix(part["v"]))
                    qi, pi = np.repeat(ids[own], len(part)), np.tile(part["id"].to_numpy(), len(own))
                    keep = qi != pi
                    yield pd.DataFrame({"query_id": qi[keep], "id": pi[keep], "distance": d.reshape(-1)[keep]})

        found = p.mapInPandas(run, "query_id long, id long, distance double")
        out = found if out is None else out.unionByName(found)
    return out


def _blocks(points: DataFrame, by: list[str], block: int) -> DataFrame:
    """Points gathered into blocks of at most ``block`` rows per group: (by..., blk, ids, vs, labels)."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by, "part").orderBy("id")
    sizes = points.groupBy(*by).agg(F.count("*").alias("n")) if by else None
    x = points.join(sizes, by) if by else points.withColumn("n", F.lit(points.count()))
    # A group's rows are first dealt to parts by hash, so that no window sees more than about half a block.
    x = x.withColumn("part", F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("n") / (block // 2))))).withColumn("blk", F.concat_ws("-", "part", F.floor((F.row_number().over(w) - 1) / block)))
    return x.groupBy(*by, "blk").agg(F.collect_list(F.struct(*[c for c in points.columns])).alias("rows"))


def distance_sums(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, cluster, total): each point's summed distance to the members of its own cluster, from (id, v, cluster).

    Clusters are cut into blocks, and blocks of one cluster meet pairwise: the work is quadratic in a
    cluster but spread over tasks, pairs never become rows, and no task holds more than two blocks.
    """
    b = staged(_blocks(points, ["cluster"], block), "blocks")
    pairs = b.alias("x").join(b.alias("y"), "cluster").select("cluster", F.col("x.rows").alias("x"), F.col("y.rows").alias("y"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for c, x, y in zip(pdf["cluster"], pdf["x"], pdf["y"]):
                a, z = np.array([r["v"] for r in x], float), np.array([r["v"] for r in y], float)
                yield pd.DataFrame({"id": [r["id"] for r in x], "cluster": c, "total": distances_between(a, z).sum(1)})

    return pairs.mapInPandas(run, "id long, cluster long, total double").groupBy("id", "cluster").agg(F.sum("total").alias("total"))


def medoids(df: DataFrame, id_column: str = "vec_id", values: str = "embedding", cluster: str = "label") -> DataFrame:
    """(cluster, medoid_id): the member with the least summed distance to the others, of ties the smallest id; noise (-1) has none."""
    p = _points(df, id_column, values, F.col(cluster).cast("long").alias("cluster")).where("cluster <> -1")
    s = distance_sums(p)
    return s.groupBy("cluster").agg(F.min(F.struct(F.round("total", 9).alias("total"), "id")).alias("b")).select("cluster", F.col("b.id").alias("medoid_id"))


def cluster_sizes(df: DataFrame, cluster: str = "label") -> DataFrame:
    return df.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))


def silhouette(df: DataFrame, id_column: str = "vec_id", values: str = "embedding", cluster: str = "label", limit: int = PAIRWISE_LIMIT, block: int = BLOCK) -> DataFrame:
    """(silhouette): mean silhouette of all points; null with fewer than two clusters or ``limit`` points or more.

    All distances are needed, so the measure is only for small sets; blocks of points meet pairwise. A point
    alone in its cluster counts 0.
    """
    p = staged(_points(df, id_column, values, F.col(cluster).cast("long").alias("cluster")), "points")
    n = p.count()
    none = df.sparkSession.createDataFrame([(None,)], "silhouette double")
    if n >= limit or p.select("cluster").distinct().count() < 2:
        return none
    b = _blocks(p, [], block).select("blk", "rows")
    names = [r[0] for r in b.select("blk").collect()]
    left = b.select(F.col("rows").alias("x"), F.explode(F.array(*[F.lit(x) for x in names])).alias("other"))
    pairs = left.join(b.withColumnRenamed("blk", "other").withColumnRenamed("rows", "y"), "other").select("x", "y")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for x, y in zip(pdf["x"], pdf["y"]):
                d = distances_between(np.array([r["v"] for r in x], float), np.array([r["v"] for r in y], float))
                labels = np.array([r["cluster"] for r in y])
                for c in np.unique(labels):
                    yield pd.DataFrame({"id": [r["id"] for r in x], "own": [r["cluster"] for r in x], "cluster": int(c), "total": d[:, labels == c].sum(1), "n": int((labels == c).sum())})

    s = pairs.mapInPandas(run, "id long, own long, cluster long, total double, n long").groupBy("id", "own", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    a = F.max(F.when(F.col("own") == F.col("cluster"), F.when(F.col("n") > 1, F.col("total") / (F.col("n") - 1))))
    o = F.min(F.when(F.col("own") != F.col("cluster"), F.col("total") / F.col("n")))
    per = s.groupBy("id").agg(a.alias("a"), o.alias("b"))
    value = F.when(F.col("a").isNull(), 0.0).when(F.greatest("a", "b") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.agg(F.avg(value).alias("silhouette"))


def neighbors_within(df: DataFrame, eps: float, id_column: str = "vec_id", values: str = "embedding", pivots: int = 3) -> DataFrame:
    """(a, b) with a < b: all pairs of points within ``eps`` of each other, exactly.

    By the triangle inequality, points within eps lie in the same or a neighbouring ring of width eps around
    any pivot. The rings around a few pivots make a cell; each point looks into the 3 ** pivots cells around
    its own, by an equi-join, and only those pairs are measured.
    """
    p = _points(df, id_column, values)
    some = p.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    if not some:
        return df.sparkSession.createDataFrame([], "a long, b long")
    from ..functions.vectors import euclidean

    rings = [F.floor(euclidean("v", F.array(*[F.lit(float(x)) for x in r["v"]])) / eps).cast("long") for r in some]
    cells = staged(p.select("id", "v", F.array(*rings).alias("cell")), "cells")
    around = F.array(F.array().cast("array<long>"))
    for _ in some:
        around = F.flatten(F.transform(around, lambda pre: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.concat(pre, F.array(d.cast("long"))))))
    look = cells.select(F.col("id").alias("a"), F.col("v").alias("va"), F.explode(F.transform(around, lambda o: F.zip_with("cell", o, lambda x, y: x + y))).alias("cell"))
    hit = look.join(cells.select(F.col("id").alias("b"), F.col("v").alias("vb"), "cell"), "cell").where(F.col("a") < F.col("b"))
    return hit.where(euclidean("va", "vb") <= eps).select("a", "b")


SLOW, REFUSED = 10_000, 50_000  # sequences above which all Hamming distances are warned of, and refused


def _rows_of(pairs: DataFrame) -> DataFrame:
    """(id, v): the distances (a, b, distance) of each id to all ids, in their order."""
    both = pairs.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", "distance"))).alias("r"))
    return both.select(F.col("a").alias("id"), F.transform("r", lambda x: x["distance"].cast("double")).alias("v"))


def distance_rows(df: DataFrame, id_column: str = "vec_id", values: str = "embedding", limit: int = PAIRWISE_LIMIT) -> DataFrame:
    """(id, v): each point's distances to all points (itself 0), in order of id: what k-means over a distance matrix takes.

    The rows are as long as the table, so more than ``limit`` points raise ValueError.
    """
    p = _points(df, id_column, values)
    if (n := p.count()) > limit:
        raise ValueError(f"{n} points; rows of all distances are for at most {limit}")
    d = query_distances(p, p, "id", "v").toDF("a", "b", "distance")
    return _rows_of(d.unionByName(p.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("distance"))))


def hamming_rows(df: DataFrame, id_column: str = "sequence_id", column: str = "sequence", slow: int = SLOW, refused: int = REFUSED) -> DataFrame:
    """(id, v): each text's normalized Hamming distances to all texts, in order of id. Warns above ``slow`` texts, raises ValueError above ``refused``."""
    from ..functions import bio

    p = df.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("t")).where("id is not null and t is not null")
    n = p.count()
    if n > refused:
        raise ValueError(f"{n} texts need {n * n:,} comparisons; cluster their embeddings, or at most {refused} texts")
    if n > slow:
        warnings.warn(f"all Hamming distances of {n} texts are quadratic; consider embeddings", ResourceWarning, stacklevel=2)
    b = staged(_blocks(p, [], BLOCK).select("blk", "rows"), "blocks")
    names = [r[0] for r in b.select("blk").collect()]
    if not names:
        return p.select("id", F.array().cast("array<double>").alias("v"))
    left = b.select("rows", F.explode(F.array(*[F.lit(x) for x in names])).alias("other"))
    pairs = left.join(b.withColumnRenamed("blk", "other").withColumnRenamed("rows", "y"), "other").select(F.explode("rows").alias("x"), "y").select("x", F.explode("y").alias("y"))
    return _rows_of(pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), bio.hamming_normalized(F.col("x.t"), F.col("y.t")).alias("distance")))


def dbscan(df: DataFrame, eps: float = 0.5, min_samples: int = 5, id_column: str = "vec_id", values: str = "embedding") -> DataFrame:
    """(id, cluster): density clusters numbered by their smallest core id in order, noise -1.

    Core points have ``min_samples`` points within eps, themselves included; core points within eps are
    together; a border point goes to the cluster with the lowest number among its core neighbours.
    """
    pairs = staged(neighbors_within(df, eps, id_column, values), "eps")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ids = _points(df, id_column, values).select("id").distinct()
    degree = both.groupBy("a").agg(F.count("*").alias("n"))
    core = staged(ids.join(degree.withColumnRenamed("a", "id"), "id", "left").where(F.coalesce("n", F.lit(0)) + 1 >= min_samples).select("id"), "core")
    c = F.col
    links = pairs.join(core.select(c("id").alias("a")), "a", "left_semi").join(core.select(c("id").alias("b")), "b", "left_semi")
    comp = connected_components(links, "a", "b")
    label = staged(core.join(comp.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("root")), "label")
    border = both.join(core.select(c("id").alias("a")), "a", "left_anti").join(label.select(c("id").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("root")).select(c("a").alias("id"), "root")
    found = label.unionByName(border)
    from .relational import number_rows

    numbers = number_rows(found.select("root").distinct(), 0, [c("root")], "cluster")
    return ids.join(found.join(numbers, "root"), "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))


def kmeans(df: DataFrame, k: int, id_column: str = "vec_id", values: str = "embedding", seed: int = 42, max_iter: int = 50) -> DataFrame:
    """(id, cluster): k-means of the vectors themselves, distributed (k-means|| starts)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    p = _points(df, id_column, values).select("id", array_to_vector("v").alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="cluster").fit(p)
    return model.transform(p).select("id", F.col("cluster").cast("long").alias("cluster"))


def pca(df: DataFrame, k: int = 2, id_column: str = "vec_id", values: str = "embedding") -> tuple[DataFrame, list[float]]:
    """((id, pc), explained variance) of the first k principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    p = _points(df, id_column, values).select("id", array_to_vector("v").alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(p)
    return model.transform(p).select("id", vector_to_array("pc").alias("pc")), [float(x) for x in model.explainedVariance]


def average_linkage(v: np.ndarray, k: int) -> np.ndarray:
    """Labels 0.. of the k clusters left when nearest clusters by average distance are merged (Lance-Williams).

    Labels follow each cluster's first row; ties fall to the smaller rows.
    """
    n = len(v)
    d = distances_between(v, v)
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    near = d.argmin(1) if n > 1 else np.zeros(n, int)
    for _ in range(max(0, n - k)):
        own = np.where(alive, d[np.arange(n), near], np.inf)
        i = int(own.argmin())
        j = int(near[i])
        i, j = min(i, j), max(i, j)
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
        stale = np.flatnonzero(alive & ((near == i) | (near == j) | (d[:, i] < d[np.arange(n), near])))
        near[stale] = d[stale].argmin(1)
        near[i] = d[i].argmin()
    return np.unique(label, return_inverse=True)[1]


def hierarchical(df: DataFrame, k: int, id_column: str = "vec_id", values: str = "embedding", limit: int = PAIRWISE_LIMIT) -> DataFrame:
    """(id, cluster): average-linkage clusters. The merge order is serial, so more than ``limit`` points raise ValueError."""
    p = _points(df, id_column, values)
    if (n := p.count()) > limit:
        raise ValueError(f"{n} points; hierarchical clustering is for at most {limit}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame({"id": pdf["id"].to_numpy(), "cluster": average_linkage(_matrix(pdf["v"]), k).astype("int64")})

    return p.groupBy(F.lit(0).alias("all")).applyInPandas(run, "id long, cluster long")


def cluster_predictions(clusters: DataFrame, centroids: DataFrame, stage: str) -> DataFrame:
    """Rows (sequence_id, prediction_type, value) of a clustering stage: the cluster, and whether a row is its medoid."""
    a = clusters.select(F.col("id").alias("sequence_id"), F.lit(stage).alias("prediction_type"), F.col("cluster").cast("double").alias("value"))
    m = centroids.select(F.col("medoid_id").alias("id"), F.lit(1.0).alias("is"))
    b = clusters.join(m, "id", "left").select(F.col("id").alias("sequence_id"), F.lit(f"{stage}_centroid").alias("prediction_type"), F.coalesce("is", F.lit(0.0)).alias("value"))
    return a.unionByName(b)
