"""Queries over generators, diversity, vectors, files, pipelines, protocols and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..frame import SequenceFrame
from ..functions import bio, extract, vectors
from ..operators import cluster, diversity, generate
from ..operators import filters as flt
from ..operators import relational as R
from ..scoring import LocalScorer, scored_udf
from ..session import read_table, shared_dir, staged
from ..sources import readers, structures, writers
from ..store import Store
from ..streaming.runner import filter_stream, read_stream, score_stream
from .catalogue import _LATEST, P, _pred
from .outputs import log_entries
from .pipeline import FilterStage, Pipeline, Predict
from .protocols import run_protocol
from .queries import query


def _folder(spark: SparkSession, what: str) -> str:
    """A new folder in the shared place for files that a query writes and reads back."""
    return f"{shared_dir(spark).removeprefix('file://').rstrip('/')}/{what}-{uuid.uuid4().hex}"


# --- Generators ---------------------------------------------------------------------------------


def _parts(spark, d) -> DataFrame:
    return read_table(spark, d, "part").select(F.col("p_partkey").alias("sequence_id"), F.upper(F.regexp_replace("p_name", "[^A-Za-z]", "")).alias("sequence"))


_PARTS = "parts as (select p_partkey as sequence_id, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) as sequence from part)"
_SAT = f"{_PARTS}, sat as (select sequence_id, i - 1 as sat_position, substr(sequence, i, 1) as sat_wt_aa, a as sat_mut_aa, left(sequence, i - 1) || a || substr(sequence, i + 1) as mutant from parts, unnest(range(1, length(sequence) + 1)) r(i), unnest(string_split('{bio.AMINO_ACIDS}', '')) x(a) where a <> substr(sequence, i, 1))"


@query(f"with {_SAT} select sequence_id, count(*) as n, min(mutant) as least, max(mutant) as most, cast(sum(sat_position) as bigint) as positions, cast(sum(cast('0x' || substr(md5(concat_ws(':', sat_position, sat_wt_aa, sat_mut_aa, mutant)), 1, 8) as bigint)) as bigint) as checksum from sat group by 1")
def saturation_mutants(spark, d):
    m = generate.saturation_mutants(_parts(spark, d))
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("sat_position").cast("string"), "sat_wt_aa", "sat_mut_aa", "mutant")), 1, 8), 16, 10).cast("long")
    return m.groupBy("sequence_id").agg(F.count("*").alias("n"), F.min("mutant").alias("least"), F.max("mutant").alias("most"), F.sum("sat_position").alias("positions"), F.sum(digest).alias("checksum"))


@query(f"with {_SAT} select sequence_id, sat_position, sat_wt_aa, sat_mut_aa, mutant, round(length(replace(mutant, 'A', '')) * 1.0 + sat_position / 100.0, 6) as score from sat order by length(replace(mutant, 'A', '')) + sat_position / 100.0 desc, sat_position, sat_mut_aa, sequence_id limit 50")
def saturation_top(spark, d):
    scored = lambda m: m.withColumn("score", F.length(F.regexp_replace("mutant", "A", "")) + F.col("sat_position") / 100)
    return generate.saturation(_parts(spark, d), scored, 50).withColumn("score", F.round("score", 6))


@query("select p_partkey, cast(p as bigint) as p, q from part, unnest([0, 2]) a(p), unnest(range(0, length(p_name))) b(q) where p <> q")
def two_point_positions(spark, d):
    n = read_table(spark, d, "part").select("p_partkey", F.explode(generate.position_pairs(F.length("p_name"), [0, 2])).alias("x"))
    return n.select("p_partkey", F.col("x.p").cast("long").alias("p"), F.col("x.q").cast("long").alias("q"))


@query("""with x as (select p_partkey, p_name, p, q from part, unnest([0, 1]) a(p), unnest(range(0, length(p_name))) b(q) where p <> q),
f as (select *, list_transform(range(0, length(p_name)), lambda i: case when i = p then 'A' when i = q then 'C' else substr(p_name, i + 1, 1) end) l from x)
select p_partkey, array_to_string(l, '') as mutant, cast(min((p, q))[1] as bigint) as p, cast(min((p, q))[2] as bigint) as q from f group by 1, 2""")
def two_point_mutants(spark, d):
    n = read_table(spark, d, "part").select("p_partkey", F.col("p_name").alias("sequence"))
    m = generate.two_point_mutants(n, [0, 1], lambda x: x.withColumn("aa1", F.lit("A")).withColumn("aa2", F.lit("C")), "p_partkey")
    return m.select("p_partkey", "mutant", F.col("p").cast("long").alias("p"), F.col("q").cast("long").alias("q"))


@query(f"with {_PARTS} select sequence_id, greatest(1, cast(floor(length(sequence) * 0.3) as bigint)) as n from parts where length(sequence) > 2")
def mask_counts(spark, d):
    p = _parts(spark, d).where("length(sequence) > 2")
    return p.select("sequence_id", F.size(F.array_distinct(generate.mask_positions("sequence", "random", 0.3, seed=7))).cast("long").alias("n"))


@query(f"""with {_PARTS}, p as (select *, greatest(1, cast(floor(length(sequence) * 0.3) as bigint)) k from parts where sequence <> ''),
low as (select sequence_id, (list(i order by (i + 1) * 7 % 5, i))[1:any_value(k)] l from (select *, unnest(range(0, length(sequence))) i from p) group by 1)
select p.sequence_id, array_to_string(l, ',') as low, k as n_blocked, true as in_blocks, array_to_string(list_filter([0, 2, 999], lambda x: x < length(sequence)), ',') as explicit from p join low using (sequence_id)""")
def mask_strategies(spark, d):
    p = _parts(spark, d).where("sequence <> ''")
    conf = F.transform(F.sequence(F.lit(1), F.length("sequence")), lambda i: F.pmod(i * 7, F.lit(5)).cast("double"))
    blocks = generate.mask_positions("sequence", "blocks", 0.3, block=3)
    m = p.select("sequence_id", generate.mask_positions("sequence", "low_confidence", 0.3, confidences=conf).alias("low"), blocks.alias("b"), generate.mask_positions("sequence", explicit=[0, 2, 999]).alias("explicit"), F.length("sequence").alias("size"))
    # Whole runs of three, but for those at the ends and the last one taken: so at most a third of the positions, and two more, begin a run.
    runs = F.size(F.filter("b", lambda i: ~F.array_contains("b", i - 1)))
    fine = (runs <= F.ceil(F.size("b") / 3) + 2) & (F.size(F.array_distinct("b")) == F.size("b")) & F.forall("b", lambda i: (i >= 0) & (i < F.col("size")))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return m.select("sequence_id", text("low").alias("low"), F.size("b").cast("long").alias("n_blocked"), fine.alias("in_blocks"), text("explicit").alias("explicit"))


@query(f"with {_PARTS} select sequence_id, t as temperature from parts, unnest([0.5, 1.0, 1.5]) x(t)".replace("[0.5, 1.0, 1.5]", "[0.5::double, 1.0::double, 1.5::double]"))
def temperature_scan(spark, d):
    return generate.temperature_scan(_parts(spark, d), [0.5, 1.0, 1.5]).select("sequence_id", "temperature")


@query(f"with {_PARTS} select sequence, max(length(sequence)::double) as log_prob from (select sequence from parts where sequence <> '' union all select sequence || ':' || sequence from parts where sequence <> '') group by 1".replace("max(length(sequence)::double)", "max(case when contains(sequence, ':') then null else length(sequence)::double end)"))
def generated_flatten(spark, d):
    p = _parts(spark, d).where("sequence <> ''")
    one = F.struct(F.lower("sequence").alias("sequence"), F.length("sequence").cast("double").alias("log_prob"))
    a = p.select(F.to_json(F.array(F.array(one))).alias("r"))
    pair = F.struct(F.array(F.struct(F.col("sequence").alias("heavy"), F.col("sequence").alias("light"))).alias("sequences"))
    b = p.select(F.to_json(pair).alias("r"))
    return generate.generated_rows(a.unionByName(b), extract.flatten_generated("r")).select("sequence", "log_prob")


@query(f"""with {_PARTS} select sequence_id, '{{"molecules":[{{"id":"A","type":"protein","sequence":"' || sequence || '"}},{{"id":"B","type":"ligand","sequence":"CCO"}}]}}' as item from parts where sequence <> ''""")
def cofold_items(spark, d):
    return generate.cofold_items(_parts(spark, d).where("sequence <> ''"), [{"type": "ligand", "smiles": "CCO"}])


# --- Diversity and summaries --------------------------------------------------------------------

_KMER = f"{_PARTS}, k as (select substr(sequence, i, 3) kmer from parts, unnest(range(1, length(sequence) - 1)) r(i))"


@query(f"with {_KMER} select kmer, count(*) as n from k group by 1")
def kmer_count(spark, d):
    return diversity.kmer_counts(_parts(spark, d), 3)


@query(f"with {_KMER}, c as (select kmer, count(*) n from k group by 1) select count(*) as unique_kmers, cast(sum(n) as bigint) as total_kmers, count(*) / sum(n) as diversity_ratio, (select string_agg(kmer || ':' || n, ',' order by n desc, kmer) from (select * from c order by n desc, kmer limit 5)) as most_common from c")
def motif_diversity(spark, d):
    m = diversity.motif_diversity(_parts(spark, d), 3)
    return m.withColumn("most_common", F.array_join(F.transform("most_common", lambda x: F.concat(x["kmer"], F.lit(":"), x["n"].cast("string"))), ","))


_ENTROPY = f"{_PARTS}, s as (select i p, substr(sequence, i, 1) c from parts, unnest(range(1, length(sequence) + 1)) r(i)), n as (select p, c, count(*) n from s where c <> '-' group by 1, 2), h as (select p, -sum(n / t * log2(n / t + 1e-10)) h from (select *, sum(n) over (partition by p) t from n) group by 1)"


@query(f"with {_ENTROPY} select round(avg(h) / log2(20), 9) as shannon_entropy from h")
def shannon_entropy(spark, d):
    return diversity.shannon_entropy(_parts(spark, d)).select(F.round("shannon_entropy", 9).alias("shannon_entropy"))


@query(f"""with {_ENTROPY}, k3 as (select substr(sequence, i, 3) k, count(*) n from parts, unnest(range(1, length(sequence) - 1)) r(i) group by 1), k5 as (select substr(sequence, i, 5) k, count(*) n from parts, unnest(range(1, length(sequence) - 3)) r(i) group by 1)
select (select count(*) from parts) as n_sequences, (select count(distinct sequence) from parts) as n_unique, round((select count(distinct sequence) / count(*) from parts), 9) as uniqueness_ratio, round((select avg(h) from h) / log2(20), 9) as shannon_entropy,
(select count(*) from k3) as unique_3mers, (select cast(sum(n) as bigint) from k3) as total_3mers, (select round(count(*) / sum(n), 9) from k3) as diversity_ratio_3mer,
(select count(*) from k5) as unique_5mers, (select cast(sum(n) as bigint) from k5) as total_5mers, (select round(count(*) / sum(n), 9) from k5) as diversity_ratio_5mer""")
def diversity_metrics(spark, d):
    m = diversity.diversity_metrics(_parts(spark, d))
    return m.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c).cast("long").alias(c) for c, t in m.dtypes])


@query("with l as (select min(o_totalprice) a, (max(o_totalprice) - min(o_totalprice)) / 50 w from orders) select bin, round(min(a + bin * w), 6) as lo, count(*) as n from (select a, w, cast(least(floor((o_totalprice - a) / w), 49) as bigint) bin from orders, l) group by bin")
def histogram(spark, d):
    return diversity.histogram(read_table(spark, d, "orders"), "o_totalprice").withColumn("lo", F.round("lo", 6))


@query("select 'l_quantity' as a, 'l_extendedprice' as b, round(corr(l_quantity, l_extendedprice), 9) as corr from lineitem union all select 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 9) from lineitem union all select 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 9) from lineitem")
def correlation(spark, d):
    return diversity.correlation_pairs(read_table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("corr", F.round("corr", 9))


@query("select o_orderpriority, count(o_totalprice) n, min(o_totalprice) least, round(quantile_cont(o_totalprice, 0.25), 6) q1, round(quantile_cont(o_totalprice, 0.5), 6) median, round(quantile_cont(o_totalprice, 0.75), 6) q3, max(o_totalprice) most, round(avg(o_totalprice), 6) mean from orders group by 1")
def group_quartiles(spark, d):
    g = diversity.group_quartiles(read_table(spark, d, "orders"), "o_orderpriority", "o_totalprice")
    return g.select("o_orderpriority", "n", "least", F.round("q1", 6).alias("q1"), F.round("median", 6).alias("median"), F.round("q3", 6).alias("q3"), "most", F.round("mean", 6).alias("mean"))


@query(" union all ".join(f"select '{c}' as column_name, count({c}) as non_null, count(*) - count({c}) as nulls, count(distinct {c}) as n_unique, {'round(avg(' + c + '), 6)' if num else 'cast(null as double)'} as mean, {'round(stddev_samp(' + c + '), 6)' if num else 'cast(null as double)'} as std from documents" for c, num in (("doc_id", True), ("n_chars", True), ("lang", False), ("source", False), ("doc_kind", False))))
def summarize(spark, d):
    s = diversity.summarize(read_table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source", "doc_kind"))
    return s.select("column_name", "non_null", "nulls", "n_unique", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("with s as (select length(sequence) n from sequences where sequence is not null), l as (select min(n)::double a, (max(n) - min(n)) / 20.0 w from s) select cast(least(floor((n - a) / w), 19) as bigint) as bin, count(*) as n from s, l group by 1")
def length_distribution(spark, d):
    s = read_table(spark, d, "sequences").where("sequence is not null").select(F.length("sequence").alias("len"))
    return diversity.histogram(s, "len", 20).select("bin", "n")


_TOP_RUN = "(select run_id from stage_completions where run_id is not null group by 1 order by count(*) desc, run_id limit 1)"


def _top_run(spark, d) -> str:
    c = read_table(spark, d, "stage_completions").where("run_id is not null").groupBy("run_id").count()
    return c.orderBy(F.desc("count"), "run_id").first()["run_id"]


@query(f"select stage_name, input_count, output_count from (select distinct stage_id, stage_name, input_count, output_count from stage_completions where run_id = {_TOP_RUN})")
def stage_funnel(spark, d):
    store = Store(spark, _folder(spark, "store"))
    store.append("stage_completions", read_table(spark, d, "stage_completions").distinct())
    return Pipeline(spark, store, run_id=_top_run(spark, d)).funnel()


@query(f"""with {P}, l as (select distinct sequence_id, prediction_type, model_name from p)
select 'table' as what, 'sequences' as name, count(*) as n from sequences union all select 'table', 'predictions', count(*) from l union all select 'table', x, 0 from unnest(['embeddings', 'structures', 'generation_metadata']) t(x)
union all select 'type', prediction_type, count(*) from l group by 2 union all select 'stage', stage_name, output_count from (select distinct stage_id, stage_name, output_count from stage_completions where run_id = {_TOP_RUN})""")
def explore_counts(spark, d):
    store = Store(spark, _folder(spark, "store"))
    for t in ("sequences", "predictions", "stage_completions"):
        store.append(t, read_table(spark, d, t).drop("molecule_type", "source_file").distinct())
    return Pipeline(spark, store, run_id=_top_run(spark, d)).explore()


@query("select max(sequence_id) + 1 as next_id from sequences")
def next_id(spark, d):
    store = Store(spark, _folder(spark, "store"))
    store.append("sequences", read_table(spark, d, "sequences").select("sequence_id", "sequence"))
    return spark.createDataFrame([(store.next_id("sequences"),)], "next_id long")


@query("""select run_id, case when bool_or(lower(trim(status)) = 'failed') then 'failed' when bool_or(lower(trim(status)) = 'skipped') then 'skipped' when bool_and(coalesce(lower(trim(status)) = 'completed', false)) then 'completed' else 'running' end as status from stage_completions where run_id is not null group by 1""")
def status_roll_up(spark, d):
    c = read_table(spark, d, "stage_completions").where("run_id is not null")
    return R.status_roll_up(c, ["run_id"], "status", [("failed", ["FAILED"]), ("skipped", ["SKIPPED"])], [("completed", ["COMPLETED"])], "running")


# --- Vectors ------------------------------------------------------------------------------------

_D = "sqrt(list_aggregate(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::double - b.embedding[i]::double) ** 2), 'sum'))"


@query(f"select a.vec_id as query_id, b.vec_id as id, round({_D}, 6) as distance from embeddings a, embeddings b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id")
def pairwise_distance(spark, d):
    e = read_table(spark, d, "embeddings")
    return cluster.query_distances(e.where("vec_id % 50 = 0"), e).withColumn("distance", F.round("distance", 6))


@query(f"select label::bigint as cluster, min((t, id))[2] as medoid_id from (select a.label, a.vec_id id, round(sum({_D}), 9) t from embeddings a join embeddings b on a.label = b.label group by 1, 2) group by 1".replace("min((t, id))[2]", "min_by(id, (t, id))"))
def cluster_medoid(spark, d):
    return cluster.medoids(read_table(spark, d, "embeddings"))


@query("select label as cluster, count(*) as n from embeddings group by 1")
def cluster_sizes(spark, d):
    return cluster.cluster_sizes(read_table(spark, d, "embeddings"))


@query(f"""with p as (select a.vec_id id, a.label own, b.label other, {_D} d, a.vec_id = b.vec_id self from embeddings a, embeddings b),
g as (select id, own, other, sum(d) s, count(*) n from p group by 1, 2, 3),
v as (select id, max(case when own = other and n > 1 then s / (n - 1) end) a, min(case when own <> other then s / n end) b from g group by 1)
select round(avg(case when a is null then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from v""")
def silhouette(spark, d):
    return cluster.silhouette(read_table(spark, d, "embeddings")).select(F.round("silhouette", 6).alias("silhouette"))


EPS = 1.15  # about one pair in 350 of the test vectors is as near
_NEAR = f"near as (select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.vec_id < b.vec_id where {_D} <= {EPS})"


@query(f"with {_NEAR} select a, b from near")
def eps_neighbors(spark, d):
    return cluster.neighbors_within(read_table(spark, d, "embeddings"), EPS)


@query(f"""with recursive {_NEAR}, ways as (select a, b from near union all select b, a from near), core as (select a as id from ways group by 1 having count(*) >= 3),
inner_ways as (select a, b from ways where a in (select id from core) and b in (select id from core)),
reach as (select id, id as g from core union select w.b, r.g from reach r join inner_ways w on w.a = r.id),
label as (select id, min(g) as root from reach group by 1), border as (select w.a as id, min(root) as root from ways w join label on w.b = label.id where w.a not in (select id from core) group by 1),
found as (select * from label union all select * from border), number as (select root, row_number() over (order by root) - 1 as cluster from (select distinct root from label))
select vec_id as id, coalesce(cluster, -1) as cluster from embeddings left join found on vec_id = id left join number using (root)""")
def dbscan_clusters(spark, d):
    return cluster.dbscan(read_table(spark, d, "embeddings"), EPS, 4)


def _cluster_facts(e: DataFrame, found: DataFrame) -> DataFrame:
    """What must hold of any clustering: every point once, and points nearer to their cluster's mean than to the mean of all."""
    p = e.select(F.col("vec_id").alias("id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    p = p.join(found.withColumnRenamed("id", "fid"), F.col("id") == F.col("fid"))
    own, all_ = Window.partitionBy("cluster", "i"), Window.partitionBy("i")
    spread = p.select((F.col("x") - F.avg("x").over(own)).alias("a"), (F.col("x") - F.avg("x").over(all_)).alias("b")).agg((F.sum(F.col("a") ** 2) < F.sum(F.col("b") ** 2)).alias("tighter"))
    facts = found.agg(F.count("*").alias("n_points"), F.count_distinct("id").alias("n_ids"), F.count_distinct("cluster").alias("n_clusters"))
    return facts.crossJoin(spread)  # one row each


@query("select count(*) as n_points, count(*) as n_ids, 10 as n_clusters, true as tighter from embeddings")
def kmeans_clusters(spark, d):
    e = read_table(spark, d, "embeddings")
    return _cluster_facts(e, staged(cluster.kmeans(e, 10), "clusters"))


@query("select count(*) as n_points, count(*) as n_ids, 10 as n_clusters, true as tighter from embeddings")
def hierarchical_clusters(spark, d):
    e = read_table(spark, d, "embeddings")
    return _cluster_facts(e, staged(cluster.hierarchical(e, 10), "clusters"))


@query("""with x as (select vec_id, unnest(embedding)::double v, generate_subscripts(embedding, 1) i from embeddings), t as (select sum(s) total from (select var_samp(v) s from x group by i))
select round(total, 6) as total_variance, true as uncorrelated, true as ordered, true as explained from t""")
def pca_projection(spark, d):
    e = read_table(spark, d, "embeddings")
    pc, share = cluster.pca(e, 2)
    total = e.select(F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v")).groupBy("i").agg(F.var_samp("v").alias("s")).agg(F.sum("s").alias("t"))
    v = pc.select(F.col("pc")[0].alias("a"), F.col("pc")[1].alias("b")).agg(F.var_samp("a").alias("va"), F.var_samp("b").alias("vb"), F.corr("a", "b").alias("r"))
    told = F.greatest(*[F.abs(F.col(c) / F.col("t") - s) for c, s in zip(("va", "vb"), share)]) < 1e-6
    return total.crossJoin(v).select(F.round("t", 6).alias("total_variance"), (F.abs("r") < 1e-6).alias("uncorrelated"), (F.col("va") >= F.col("vb")).alias("ordered"), told.alias("explained"))


@query("select vec_id, list_transform(embedding[1:4], lambda x: round(x::double, 6)) as v from embeddings")
def embedding_layers(spark, d):
    lay = F.array(*[F.struct(F.lit(k).alias("layer"), F.slice(F.col("embedding").cast("array<double>"), 1 + 4 * k, 4).alias("embedding")) for k in (0, 1)])
    r = read_table(spark, d, "embeddings").select("vec_id", F.to_json(F.struct(lay.alias("embeddings"))).alias("r"))
    return r.select("vec_id", F.transform(extract.embedding("r", "embeddings", layer=0), lambda x: F.round(x, 6)).alias("v"))


@query("select vec_id, round((embedding[1]::double + embedding[3]::double) / 2, 6) as v1 from embeddings")
def embedding_token_mean(spark, d):
    m = F.array(F.slice(F.col("embedding").cast("array<double>"), 1, 2), F.slice(F.col("embedding").cast("array<double>"), 3, 2))
    r = read_table(spark, d, "embeddings").select("vec_id", F.to_json(F.struct(m.alias("embedding"))).alias("r"))
    return r.select("vec_id", F.round(extract.embedding("r", reduction="mean")[0], 6).alias("v1"))


@query("select vec_id, round(greatest(embedding[1]::double, embedding[2]::double), 6) as best from embeddings")
def top_k_probabilities(spark, d):
    p = vectors.top_probabilities(vectors.softmax(F.slice("embedding", 1, 2)), top_k=1)
    e = read_table(spark, d, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("v"), p.alias("p"))
    return e.select("vec_id", F.round(F.element_at("v", F.array_position("p", 1.0).cast("int")), 6).alias("best"))


# --- Files --------------------------------------------------------------------------------------


@query("select cast(sequence_id as varchar) as id, regexp_replace(sequence, '\\s', '', 'g') as sequence, source_file as metadata_1 from sequences where regexp_full_match(sequence, '[A-Z]+') and source_file is not null")
def fasta_round_trip(spark, d):
    out = _folder(spark, "fasta")
    s = read_table(spark, d, "sequences").where("sequence rlike '^[A-Z]+\\\\z' and source_file is not null").withColumn("id", F.col("sequence_id").cast("string"))
    writers.write_fasta(s, out, metadata=["source_file"], wrap=60)
    return readers.read_fasta(spark, out).select("id", "sequence", F.col("metadata")["metadata_1"].alias("metadata_1"))


@query("select cast(doc_id as varchar) as doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source from documents")
def csv_round_trip(spark, d):
    out = _folder(spark, "csv")
    writers.write_csv(read_table(spark, d, "documents").select("doc_id", "lang", "source"), out)
    return readers.read_csv_strings(spark, out, "source")


@query("select doc_id, text from documents where text is not null")
def json_round_trip(spark, d):
    out = _folder(spark, "rows") + ".jsonl"
    writers.write_json(read_table(spark, d, "documents").select("doc_id", "text").where("text is not null"), out)
    return readers.read_json_rows(spark, out).select("doc_id", "text")


@query("select vec_id, 1 as n_atoms, round(embedding[1]::double, 3) as x from embeddings")
def structure_round_trip(spark, d):
    e = read_table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"))
    line = F.format_string("ATOM      1  CA  MET A   1    %8.3f%8.3f%8.3f  1.00  0.00           C", "x", F.lit(0.0), F.lit(0.0))
    back = e.select("vec_id", structures.to_pdb(structures.to_cif(F.concat(line, F.lit("\nEND\n")))).alias("t"))
    return back.select("vec_id", F.size(F.regexp_extract_all("t", F.lit("(?m)^(ATOM)"), F.lit(1))).alias("n_atoms"), F.round(F.trim(F.substring("t", 31, 8)).cast("double"), 3).alias("x"))


@query("select p_partkey as sequence_id, p_name as sequence from part")
def frame_round_trip(spark, d):
    p = read_table(spark, d, "part").select(F.col("p_partkey").alias("sequence_id"), F.col("p_name").alias("sequence"))
    return SequenceFrame(p).write(_folder(spark, "frame")).df


@query("select 'e' || event_id as id, event_type as tag_kind, round(value, 6) as metric_value from events")
def lab_flatten(spark, d):
    e = read_table(spark, d, "events")
    rec = F.struct(F.struct(F.concat(F.lit("e"), "event_id").alias("entity_id"), F.lit("protein").alias("type")).alias("entity"), F.create_map(F.lit("kind"), "event_type").alias("tags"), F.create_map(F.lit("value"), "value").alias("metrics"))
    r = readers.lab_rows(e.select(F.to_json(F.array(rec)).alias("records")))
    return r.select("id", "tag_kind", F.round("metric_value", 6).alias("metric_value"))


# --- Store, pipeline, protocol, stream ----------------------------------------------------------


def _scorer() -> LocalScorer:
    return LocalScorer("half-length", lambda x: {"score": len(x["sequence"]) / 2})


@query("with t as (select sequence, min(sequence_id) f from sequences where sequence is not null and sequence <> '' group by 1), n as (select sequence, row_number() over (order by f) as sequence_id from t) select s.sequence_id as row_id, n.sequence_id from sequences s join n using (sequence)")
def store_insert(spark, d):
    s = read_table(spark, d, "sequences").where("sequence is not null and sequence <> ''").select("sequence", F.col("sequence_id").alias("_pos"))
    placed = Store(spark, _folder(spark, "store")).add_sequences(s, position="_pos")
    return placed.select(F.col("_pos").alias("row_id"), "sequence_id")


@query(f"with {P}, l as (select sequence_id, prediction_type, model_name, max_by(value, prediction_id) filter (value is not null) v from p where sequence_id is not null and model_name is not null and prediction_type is not null group by 1, 2, 3) select prediction_type, count(*) as n, round(sum(v), 4) as total from l group by 1")
def store_predictions(spark, d):
    store = Store(spark, _folder(spark, "store"))
    p = _pred(spark, d).where("sequence_id is not null and model_name is not null and prediction_type is not null")
    store.append("predictions", p)
    return store.table("predictions").groupBy("prediction_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("select sequence, length(sequence) / 2 as score from (select distinct sequence from sequences where sequence is not null) where lower(trim(sequence)) not in ('', 'nan', 'none') and length(sequence) / 2 >= 100")
def pipeline_run(spark, d):
    s = read_table(spark, d, "sequences").where("sequence is not null and sequence <> ''").select("sequence")
    p = Pipeline(spark, Store(spark, _folder(spark, "store")))
    p.predict("score", _scorer(), "score", skip_on_error=True).filter("long", flt.Threshold("score", min=100))
    return p.run(s).select("sequence", "score")


@query(f"with {_LATEST} select count(*) as n_in, count(*) as n_cached from (select distinct sequence from sequences where sequence is not null and sequence <> '')")
def pipeline_resume(spark, d):
    s = read_table(spark, d, "sequences").where("sequence is not null and sequence <> ''").select("sequence")
    store = Store(spark, _folder(spark, "store"))
    for _ in range(2):  # the second run finds every score in the store
        p = Pipeline(spark, store).predict("score", LocalScorer("digest"), "score", skip_on_error=True)
        p.run(s)
    r = p.results["score"]
    return spark.createDataFrame([(r.n_in, r.cached)], "n_in long, n_cached long")


@query("select n_name as sequence, length(n_name) / 2 as fitness from nation where length(n_name) / 2 > 3 order by fitness desc, n_nationkey limit 4")
def protocol_run(spark, d):
    names = [r[0] for r in read_table(spark, d, "nation").orderBy("n_nationkey").select("n_name").collect()]  # 25 rows, fixed
    protocol = {"name": "fit", "inputs": {"sequences": {"type": "list_of_str"}}, "tasks": [{"id": "score", "slug": "half", "action": "predict", "request_body": {"items": "${{ sequences }}"}, "response_mapping": {"fitness": "results[*].score"}}], "outputs": [{"where": "${{ fitness > 3 }}", "order_by": [{"field": "fitness", "order": "desc"}], "limit": 4}]}
    run = run_protocol(spark, protocol, {"sequences": names}, {"half": _scorer()}, _folder(spark, "store"))
    return run.selected.select("sequence", "fitness")


@query("select sequence_id, length(sequence) / 2 as score from sequences where length(sequence) / 2 >= 120 and lower(trim(sequence)) not in ('', 'nan', 'none')")
def stream_scores(spark, d):
    base = _folder(spark, "stream")
    read_table(spark, d, "sequences").select("sequence_id", "sequence").repartition(4).write.parquet(f"{base}/in")
    rows = read_stream(spark, f"{base}/in", "sequence_id long, sequence string", 2)
    score_stream(rows, Predict("score", _scorer(), "score", skip_on_error=True), [flt.Threshold("score", min=120)], f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("sequence_id", "score")


@query("select event_id, value from events where value >= 50")
def stream_filter(spark, d):
    base = _folder(spark, "stream")
    e = read_table(spark, d, "events").select("event_id", "value")
    e.write.parquet(f"{base}/in")
    filter_stream(read_stream(spark, f"{base}/in", "event_id long, value double"), [flt.Threshold("value", min=50)], f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema("event_id long, value double").parquet(f"{base}/out")


@query(f"""with {_PARTS}, p as (select distinct sequence from parts where sequence <> ''), u as (select sequence from p union select 'W' || substr(sequence, 2) from p)
select sequence, round(length(sequence) - length(replace(sequence, 'W', '')) + length(sequence) / 100, 6) as fitness from u order by length(sequence) - length(replace(sequence, 'W', '')) + length(sequence) / 100 desc, sequence limit 5""")
def refine_elite(spark, d):
    start = _parts(spark, d).where("sequence <> ''").select("sequence").distinct()
    fit = lambda x: x.withColumn("fitness", F.length("sequence") - F.length(F.regexp_replace("sequence", "W", "")) + F.length("sequence") / 100)
    fill = lambda x: x.withColumn("variant", F.regexp_replace("masked", "^<mask>", "W"))
    # Each parent has one child, with a W in front; children of the second round equal their parents and are dropped.
    return generate.refine(start, fill, fit, rounds=2, population=6, keep=5, explicit=[0]).withColumn("fitness", F.round("fitness", 6))


@query(f"with {_PARTS} select sequence_id, 5 as n_variants, true as distinct_ones, true as changed, true as within from parts where length(sequence) >= 10")
def remask_variants(spark, d):
    p = _parts(spark, d).where("length(sequence) >= 10")

    def fill(x: DataFrame) -> DataFrame:
        draw = lambda c, i: F.substring(F.lit(bio.AMINO_ACIDS), (F.pmod(F.xxhash64(F.col("variant"), F.col("_attempt"), i), F.lit(20)) + 1).cast("int"), F.lit(1))
        chars = F.filter(F.split("variant", ""), lambda c: c != "")
        return x.withColumn("variant", F.array_join(F.transform(chars, lambda c, i: F.when(F.array_contains("positions", i), draw(c, i)).otherwise(c)), ""))

    v = generate.variants(p, fill, 5, fraction=0.4)
    far = F.max("num_mutations") <= F.greatest(F.lit(1), F.floor(F.max(F.length("sequence")) * 0.4))
    same = F.bool_and(F.length("variant") == F.length("sequence")) & (F.min("num_mutations") > 0)
    return v.groupBy("sequence_id").agg(F.count("*").alias("n_variants"), (F.count_distinct("variant") == F.count("*")).alias("distinct_ones"), (F.bool_and(F.col("variant") != F.col("sequence")) & same).alias("changed"), far.alias("within"))


@query(f"""with k as (select * from (select *, row_number() over (partition by run_id, stage_name, sequence_id order by filter_id) rn from filter_results) where rn = 1)
select distinct sequence_id from k where passed and run_id = {_TOP_RUN} and stage_name = 'filter_tm' and sequence_id is not null""")
def reload_filter_stage(spark, d):
    store = Store(spark, _folder(spark, "store"))
    store.append("filter_results", read_table(spark, d, "filter_results"))
    stage = FilterStage("filter_tm", flt.Threshold("tm", min=50))
    return stage.reload(R.id_set(read_table(spark, d, "sequences")), store, _top_run(spark, d))


# --- Enrichment, joins of results, exports ------------------------------------------------------


def _named(spark, d) -> SequenceFrame:
    return SequenceFrame(read_table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("sequence")))


@query("select cast(p_partkey as varchar) as id, cast(length(p_name) / 2 as varchar) as half_length_predict from part")
def models_predict(spark, d):
    return _named(spark, d).models.predict(_scorer()).query.select("id", "half_length_predict").df


@query("select cast(p_partkey as varchar) as id, length(p_name)::double as first, 2 as size from part")
def models_embed(spark, d):
    scorer = LocalScorer("vec", lambda x: {"embeddings": [{"layer": 1, "embedding": [0.0]}, {"layer": 3, "embedding": [len(x["sequence"]), 1.5]}]})
    e = _named(spark, d).models.embed(scorer, layer=3).df
    return e.select("id", F.col("vec_embedding")[0].alias("first"), F.size("vec_embedding").alias("size"))


@query("select n_nationkey as id, n_name as sequence, case when length(n_name) / 2 > 3 then length(n_name) / 2 end as fitness from nation")
def protocol_join_back(spark, d):
    n = SequenceFrame(read_table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("sequence")))
    names = [r[0] for r in n.df.orderBy("id").select("sequence").collect()]  # 25 rows, fixed
    protocol = {"name": "fit", "inputs": {"sequences": {"type": "list_of_str"}}, "tasks": [{"id": "score", "slug": "half", "action": "predict", "request_body": {"items": "${{ sequences }}"}, "response_mapping": {"fitness": "results[*].score"}}], "outputs": [{"where": "${{ fitness > 3 }}", "limit": None}]}
    return n.protocols.run(protocol, {"sequences": names}, {"half": _scorer()}, _folder(spark, "store"), join_on="sequence").df.select("id", "sequence", "fitness")


@query("select cast(p_partkey as varchar) as id, p_name as sequence, case when p_partkey % 3 = 0 then p_size / 2 end as metric_value from part")
def lab_merge(spark, d):
    p = read_table(spark, d, "part").where("p_partkey % 3 = 0")
    rec = F.struct(F.struct(F.col("p_partkey").cast("string").alias("entity_id"), F.lit("protein").alias("type")).alias("entity"), F.create_map(F.lit("value"), F.col("p_size") / 2).alias("metrics"))
    lab = SequenceFrame.from_lab(p.select(F.to_json(F.array(rec)).alias("records")))
    return _named(spark, d).lab.merge(SequenceFrame(lab.df.select("id", "metric_value"))).df.select("id", "sequence", "metric_value")


@query("select p_partkey as sequence_id, length(p_name) / 4 as fitness from part")
def fitness_function(spark, d):
    p = read_table(spark, d, "part").select(F.col("p_partkey").alias("sequence_id"), "p_name")
    return scored_udf(p, lambda s: s.str.len() / 4, "p_name", "fitness").select("sequence_id", "fitness")


@query("""select p_partkey as sequence_id, '{"items":[{"sequence":"' || p_name || '"}],"params":{"n": 2}}' as body from part""")
def request_payload(spark, d):
    return read_table(spark, d, "part").select(F.col("p_partkey").alias("sequence_id"), extract.payload({"sequence": "p_name"}, {"n": 2}).alias("body"))


@query(f"with {P}, l as (select distinct sequence_id, prediction_type, model_name from p) select prediction_type, count(*) as n from l group by 1")
def export_parquet(spark, d):
    store, out = Store(spark, _folder(spark, "store")), _folder(spark, "export")
    store.append("predictions", _pred(spark, d))
    store.export_parquet("predictions", out)
    return spark.read.parquet(out).groupBy("prediction_type").agg(F.count("*").alias("n"))


@query(f"with {_LATEST} select cast(s.sequence_id as varchar) as sequence_id, cast(round(max(case when prediction_type = 'tm' then value end), 3) as double) as tm from sequences s left join (select * from ranked where rn = 1) using (sequence_id) group by 1")
def export_csv(spark, d):
    store, out = Store(spark, _folder(spark, "store")), _folder(spark, "export")
    store.append("sequences", read_table(spark, d, "sequences").select("sequence_id"))
    # One value per sequence and type, as the store would have merged them.
    store.append("predictions", R.latest(_pred(spark, d).where("sequence_id is not null and prediction_type = lower(trim(prediction_type))"), ["sequence_id", "prediction_type"], ["prediction_id"]))
    store.export_csv(out)
    return spark.read.option("header", True).csv(out).select("sequence_id", F.round(F.col("tm").cast("double"), 3).alias("tm"))


@query("select count(*) as n_lines from part")
def pdb_export(spark, d):
    out = _folder(spark, "pdb")
    writers.write_pdb(read_table(spark, d, "part").select(F.concat(F.lit("ATOM "), "p_name").alias("pdb")), out)
    return spark.read.text(out).where("value like 'ATOM %'").agg(F.count("*").alias("n_lines"))


@query("select cast(sequence_id as varchar) as id, sequence, length(sequence) as length from sequences where regexp_full_match(sequence, '[A-Z]+')")
def frame_from_files(spark, d):
    s = read_table(spark, d, "sequences").where("sequence rlike '^[A-Z]+\\\\z'").select(F.col("sequence_id").cast("string").alias("id"), "sequence")
    fasta, csv, rows = _folder(spark, "f"), _folder(spark, "c"), _folder(spark, "j") + ".jsonl"
    a, b = s.where("cast(id as long) % 3 = 0"), s.where("cast(id as long) % 3 = 1")
    c = s.where("cast(id as long) % 3 = 2")  # a third of the rows through each format
    writers.write_fasta(a, fasta)
    writers.write_csv(b, csv)
    writers.write_json(c, rows)
    frames = [SequenceFrame.from_fasta(spark, fasta), SequenceFrame.from_csv(spark, csv), SequenceFrame.from_json(spark, rows)]
    x, y, z = (f.df.select("id", "sequence", F.col("length").cast("long").alias("length")) for f in frames)
    return x.unionByName(y).unionByName(z)


@query("select sequence_id, attr_name, min(attr_value) as attr_value from (select distinct sequence_id, attr_name, attr_value from sequence_attributes where attr_value is not null) group by 1, 2 having count(*) = 1")
def attributes_single(spark, d):
    a = read_table(spark, d, "sequence_attributes").where("attr_value is not null").distinct()
    return a.groupBy("sequence_id", "attr_name").agg(F.min("attr_value").alias("attr_value"), F.count("*").alias("n")).where("n = 1").drop("n")


# --- Logging, differences, sources --------------------------------------------------------------


@query("""select cast(p_partkey as varchar) as id, 'params' as what, 'brand' as key, p_brand as value from part where p_size > 40
union all select cast(p_partkey as varchar), 'metrics', 'size', cast(p_size as varchar) from part where p_size > 40
union all select cast(p_partkey as varchar), 'tags', 'rule', case when p_size > 45 then 'second' else 'first' end from part where p_size > 40
union all select cast(p_partkey as varchar), 'artifacts', 'note', p_name from part where p_size > 45""")
def output_log(spark, d):
    p = read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_size")
    first = {"where": "${{ p_size > 40 }}", "limit": None, "log": {"params": {"brand": "${{ p_brand }}", "none": "${{ absent }}"}, "metrics": {"size": "${{ p_size }}"}, "tags": {"rule": "first"}}}
    second = {"where": "${{ p_size > 45 }}", "limit": None, "log": {"tags": {"rule": "second"}, "artifacts": [{"type": "text", "name": "note", "content": "${{ p_name }}"}]}}
    return log_entries(p, [first, second]).select("id", "what", "key", "value")


@query("""with s as (select distinct sequence, min(created_at) over (partition by sequence) < timestamp '2025-10-01' as old from sequences where sequence is not null and created_at < timestamp '2025-12-01')
select count(*) as n_texts, count(*) filter (old) as n_known, count(*) filter (not old) as n_new from s""")
def run_difference(spark, d):
    s = read_table(spark, d, "sequences").where("sequence is not null and created_at < timestamp_ntz'2025-12-01 00:00:00'")
    store = Store(spark, _folder(spark, "store"))
    old = s.where("created_at < timestamp_ntz'2025-10-01 00:00:00'")
    store.append("sequences", old.select("sequence_id", "sequence", bio.store_hash("sequence").alias("hash")))
    known, new = Pipeline(spark, store).difference(s)
    return spark.createDataFrame([(known + new, known, new)], "n_texts long, n_known long, n_new long")


@query("""with h as (select a.n_nationkey as id, (select count(*) from unnest(range(1, greatest(length(a.n_name), length(b.n_name)) + 1)) r(i) where substr(a.n_name, i, 1) <> substr(b.n_name, i, 1)) / greatest(length(a.n_name), length(b.n_name)) as d from nation a, nation b)
select id, count(*) as n, round(sum(d), 6) as total from h group by 1""")
def hamming_distance_rows(spark, d):
    h = cluster.hamming_rows(read_table(spark, d, "nation"), "n_nationkey", "n_name")
    return h.select("id", F.size("v").cast("long").alias("n"), F.round(vectors.vec_sum("v"), 6).alias("total"))


@query(f"""with {_PARTS}, p as (select distinct sequence from parts where sequence <> '')
select sequence from (select reverse(sequence) || cast(run as varchar) as sequence from p, unnest([0, 1]) r(run) union select sequence || 'W' from p)""")
def generate_runs(spark, d):
    def backwards(x: DataFrame) -> DataFrame:
        return x.select(F.concat(F.reverse("sequence"), F.col("run").cast("string")).alias("sequence"))

    def longer(x: DataFrame) -> DataFrame:
        return x.select(F.concat("sequence", F.lit("W")).alias("sequence"))

    p = Pipeline(spark, Store(spark, _folder(spark, "store"))).generate("made", [backwards, longer], runs=2)
    return p.run(_parts(spark, d).where("sequence <> ''").select("sequence").distinct()).select("sequence")


@query("select distinct sequence from sequences where sequence is not null and trim(sequence) <> ''")
def source_stage(spark, d):
    p = Pipeline(spark, Store(spark, _folder(spark, "store"))).source("given", read_table(spark, d, "sequences"))
    return p.run([]).select("sequence")
