"""Queries over the relational, filter, set and scalar operators, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import SequenceFrame, infer_molecule, normalize
from ..functions import bio, extract, vectors
from ..operators import filters as flt
from ..operators import relational as R
from ..operators import sampling
from ..session import read_table, scratch_path
from ..store import Store
from .outputs import combine_rules, rule_aggregates, select_rows, union_rules
from .pipeline import Pipeline, Stage
from .queries import query

REFERENCE = "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQAPILSRVGDGTQDNLSGAEKAVQVKVKALPDAQFEVV"


def _pred(spark: SparkSession, d: str) -> DataFrame:
    """Scores with NaN as null. Rows delivered twice stay, as most operators give the same with them."""
    return read_table(spark, d, "predictions").withColumn("value", flt.clean_number(F.col("value")))


P = "p as (select distinct prediction_id, sequence_id, model_name, prediction_type, case when isnan(value) then null else value end as value, metadata, created_at from predictions)"

# --- Frame verbs --------------------------------------------------------------------------------


@query("select sequence_id, length, source_file from sequences where length > 100 and molecule_type = 'protein'")
def frame_filter_select(spark, d):
    return SequenceFrame(read_table(spark, d, "sequences")).query.filter("length > 100 and molecule_type = 'protein'").query.select("sequence_id, length, source_file").df


@query("select sequence_id, length from sequences order by length desc nulls last, sequence_id desc limit 100")
def frame_sort_limit(spark, d):
    return SequenceFrame(read_table(spark, d, "sequences")).query.sort("length", "sequence_id", ascending=False).query.limit(100).query.select("sequence_id", "length").df


@query("select o_orderkey, round(o_totalprice * 0.1, 4) as tax from orders")
def frame_add_column(spark, d):
    return SequenceFrame(read_table(spark, d, "orders")).add_column("tax", "round(o_totalprice * 0.1, 4)").query.select("o_orderkey", "tax").df


@query("select count(*) as n_rows, 7 as n_columns from sequences")
def frame_count(spark, d):
    rows, columns = SequenceFrame(read_table(spark, d, "sequences")).shape()
    return spark.createDataFrame([(rows, columns)], "n_rows long, n_columns int")


def _run_sides(spark, d):
    left = read_table(spark, d, "stage_completions").where("run_id is not null").groupBy("run_id").agg(F.count_distinct("stage_id").alias("n_stages"))
    right = read_table(spark, d, "pipeline_runs").select("run_id", "pipeline_type")
    return left, right


_SIDES = "l as (select run_id, count(distinct stage_id) n_stages from stage_completions where run_id is not null group by 1), r as (select run_id, pipeline_type from pipeline_runs)"


def _frame_join(how: str):
    def run(spark, d):
        left, right = _run_sides(spark, d)
        return SequenceFrame(left).query.join(SequenceFrame(right), on="run_id", how=how).df

    run.__name__ = f"frame_join_{how}"
    return query(f"with {_SIDES} select run_id, n_stages, pipeline_type from l {how} join r using (run_id)")(run)


for _how in ("inner", "left", "right", "full"):
    _frame_join(_how)


@query("select l_returnflag, l_linestatus, count(*) n, round(sum(l_quantity), 2) sum_qty, round(avg(l_extendedprice), 2) avg_price from lineitem group by 1, 2")
def frame_group_by(spark, d):
    return SequenceFrame(read_table(spark, d, "lineitem")).query.group_by("l_returnflag", "l_linestatus", agg={"n": "count(*)", "sum_qty": "round(sum(l_quantity), 2)", "avg_price": "round(avg(l_extendedprice), 2)"}).df


@query(f"with {P}, x as (select sequence_id, max(prediction_id) length from p where sequence_id is not null group by 1) select s.sequence_id, s.length, x.length as length_enriched from sequences s left join x using (sequence_id)")
def frame_merge_columns(spark, d):
    x = _pred(spark, d).where("sequence_id is not null").groupBy("sequence_id").agg(F.max("prediction_id").alias("length"))
    return SequenceFrame(read_table(spark, d, "sequences").select("sequence_id", "length")).merge_columns(x, on="sequence_id").df


@query("select cast(p_partkey as varchar) as id, p_name as sequence, substr(sha256(upper(p_name)), 1, 16) as sequence_hash, length(p_name) as length, p_brand from part")
def frame_normalize(spark, d):
    return normalize(read_table(spark, d, "part").select(F.col("p_partkey").alias("sequence_id"), F.col("p_name").alias("sequence"), "p_brand"))


# --- Filters over the wide frame and the store --------------------------------------------------


@query(f"with {P} select distinct s.sequence_id from sequences s join p using (sequence_id) where prediction_type = 'tm' and value >= 60")
def threshold_inner(spark, d):
    return flt.Threshold("tm", min=60).in_store(read_table(spark, d, "sequences"), _pred(spark, d))


@query(f"with {P}, t as (select * from p where prediction_type = 'tm') select distinct s.sequence_id from sequences s left join t using (sequence_id) where t.sequence_id is null or t.value is null or t.value between 40 and 60")
def threshold_keep_na(spark, d):
    return flt.Threshold("tm", min=40, max=60, keep_na=True).in_store(read_table(spark, d, "sequences"), _pred(spark, d))


@query("select distinct sequence_id from sequences")
def threshold_no_bounds(spark, d):
    return flt.Threshold("tm", keep_na=True).in_store(read_table(spark, d, "sequences"), _pred(spark, d))


@query("select prediction_id, value from (select distinct prediction_id, value, prediction_type from predictions) where prediction_type = 'plddt' and not isnan(value) and value between 70 and 90")
def threshold_frame(spark, d):
    p = _pred(spark, d).where("prediction_type = 'plddt'")
    return flt.Threshold("value", min=70, max=90).apply(p).select("prediction_id", "value").distinct()


@query("select sequence_id from sequences where length(sequence) between 100 and 200")
def length_filter(spark, d):
    return flt.LengthRange(100, 200).apply(read_table(spark, d, "sequences")).select("sequence_id")


@query("select sequence_id from sequences where regexp_full_match(sequence, '[ACDEFGHIKLMNPQRSTVWY]+')")
def alphabet_filter(spark, d):
    return flt.Alphabet().apply(read_table(spark, d, "sequences")).select("sequence_id")


@query("select sequence_id from sequences where substr(sequence, 1, 1) in ('M') and substr(sequence, 11, 1) in ('A', 'G', 'L', 'K')")
def conserved_residue(spark, d):
    return flt.Conserved({0: ["M"], 10: ["A", "G", "L", "K"]}).apply(read_table(spark, d, "sequences")).select("sequence_id")


_HAM = f"(select count(*) from range(1, least(length(sequence), {len(REFERENCE)}) + 1) r(i) where substr(sequence, i, 1) <> substr('{REFERENCE}', i, 1)) + abs(length(sequence) - {len(REFERENCE)})"


@query(f"select sequence_id, hamming_distance from (select sequence_id, cast({_HAM} as bigint) hamming_distance from sequences where sequence is not null) where hamming_distance <= 100")
def hamming_filter(spark, d):
    return flt.HammingRange(REFERENCE, max=100).apply(read_table(spark, d, "sequences")).select("sequence_id", "hamming_distance")


@query(f"select sequence_id, round(cast({_HAM} as double) / greatest(length(sequence), {len(REFERENCE)}), 9) hamming_distance_normalized from sequences where sequence is not null")
def hamming_normalized(spark, d):
    out = flt.HammingRange(REFERENCE, normalize=True).apply(read_table(spark, d, "sequences").where("sequence is not null"))
    return out.select("sequence_id", F.round("hamming_distance_normalized", 9).alias("hamming_distance_normalized"))


@query(f"select sequence_id, round(case when least(length(sequence), {len(REFERENCE)}) = 0 then 0 else (select count(*) from range(1, least(length(sequence), {len(REFERENCE)}) + 1) r(i) where substr(sequence, i, 1) = substr('{REFERENCE}', i, 1)) / least(length(sequence), {len(REFERENCE)}) end, 9) as identity from sequences where sequence is not null")
def sequence_identity(spark, d):
    return read_table(spark, d, "sequences").where("sequence is not null").select("sequence_id", F.round(bio.identity("sequence", F.lit(REFERENCE)), 9).alias("identity"))


@query("select sequence_id from sequences where length(sequence) >= 100 and regexp_full_match(sequence, '[ACGT]+')")
def composite_filter(spark, d):
    return flt.combine(flt.LengthRange(min=100), flt.Alphabet("ACGT")).apply(read_table(spark, d, "sequences")).select("sequence_id")


@query("select sequence_id from sequences where source_file is null")
def custom_filter(spark, d):
    return flt.Custom(lambda df: df.where("source_file is null"), must_have="sequence_id").apply(read_table(spark, d, "sequences")).select("sequence_id")


def _tm(spark, d):
    return _pred(spark, d).where("prediction_type = 'tm' and value is not null").select("prediction_id", "sequence_id", "value").distinct()


_TM = f"with {P}, t as (select prediction_id, sequence_id, value from p where prediction_type = 'tm' and value is not null)"


@query(f"{_TM} select prediction_id, value from t order by value desc, prediction_id limit 50")
def rank_top(spark, d):
    return flt.Ranking("value", n=50, id_column="prediction_id").apply(_tm(spark, d)).select("prediction_id", "value")


@query(f"{_TM} select prediction_id, value from t order by value, prediction_id limit 50")
def rank_bottom(spark, d):
    return flt.Ranking("value", n=50, method="bottom", id_column="prediction_id").apply(_tm(spark, d)).select("prediction_id", "value")


@query(f"{_TM} select prediction_id from t where value >= (select quantile_cont(value, 0.9) from t)")
def rank_percentile_top(spark, d):
    return flt.Ranking("value", percentile=10).apply(_tm(spark, d)).select("prediction_id")


@query(f"{_TM} select prediction_id from t where value <= (select quantile_cont(value, 0.25) from t)")
def rank_percentile_bottom(spark, d):
    return flt.Ranking("value", percentile=25, ascending=True).apply(_tm(spark, d)).select("prediction_id")


@query(f"{_TM} select prediction_id from t order by value desc, prediction_id limit 25")
def sample_top(spark, d):
    return flt.Sample(25, "top", "value", id_column="prediction_id").apply(_tm(spark, d)).select("prediction_id")


@query(f"{_TM}, r as (select prediction_id, row_number() over (order by value, prediction_id) - 1 rk, count(*) over () n from t) select prediction_id from r where rk in (select floor(k * (n - 1) / 19.0) from range(20) x(k))")
def sample_spread(spark, d):
    return flt.Sample(20, "spread", "value", id_column="prediction_id").apply(_tm(spark, d)).select("prediction_id")


@query(f"{_TM} select prediction_id from t order by md5(prediction_id::varchar || ':42'), prediction_id limit 50")
def sample_random(spark, d):
    return flt.Sample(50, "random", id_column="prediction_id").apply(_tm(spark, d)).select("prediction_id")


@query(f"{_TM}, e as (select prediction_id from t order by value desc, prediction_id limit 20) select prediction_id from e union all (select prediction_id from t where prediction_id not in (select prediction_id from e) order by md5(prediction_id::varchar || ':42'), prediction_id limit 30)")
def sample_top_up(spark, d):
    t = _tm(spark, d)
    return flt.Sample(50, "random", id_column="prediction_id").keep_earlier(t, sampling.top_n(t, "value", 20, "prediction_id")).select("prediction_id")


# --- Hashes, deduplication and lookups ----------------------------------------------------------


@query("select substr(sha256(sequence), 1, 32) as hash, min(sequence_id) as sequence_id, count(*) as n from sequences where sequence is not null group by 1")
def hash_dedup(spark, d):
    return read_table(spark, d, "sequences").where("sequence is not null").groupBy(bio.store_hash("sequence").alias("hash")).agg(F.min("sequence_id").alias("sequence_id"), F.count("*").alias("n"))


@query("""with s as (select sequence_id, created_at, substr(sha256(sequence), 1, 32) h from sequences where sequence is not null)
select min(sequence_id) as sequence_id, h as hash from s where created_at >= timestamp '2025-10-01' and h not in (select h from s where created_at < timestamp '2025-10-01') group by h""")
def dedup_anti_join(spark, d):
    s = read_table(spark, d, "sequences").where("sequence is not null").drop("hash")
    late = F.col("created_at") >= F.lit("2025-10-01").cast("timestamp_ntz")
    return R.dedup_new(s.where(~late).select(bio.store_hash("sequence").alias("hash")), s.where(late), bio.store_hash("sequence"), "sequence_id").select("sequence_id", "hash")


@query("""with s as (select sequence_id, created_at, substr(sha256(sequence), 1, 32) h from sequences where sequence is not null)
select count(*) as n_matching from s where created_at >= timestamp '2025-10-01' and h in (select h from s where created_at < timestamp '2025-10-01')""")
def count_matching(spark, d):
    s = read_table(spark, d, "sequences").where("sequence is not null").drop("hash")
    late = F.col("created_at") >= F.lit("2025-10-01").cast("timestamp_ntz")
    return R.count_matching(s.where(~late).select(bio.store_hash("sequence").alias("hash")), s.where(late))


@query("select n_nationkey, substr(sha256(n_name || chr(0) || cast(n_regionkey as varchar)), 1, 32) as hash from nation")
def multi_column_hash(spark, d):
    return read_table(spark, d, "nation").select("n_nationkey", bio.row_hash(["n_regionkey", "n_name"]).alias("hash"))


@query("select p_partkey, substr(sha256(upper(p_name)), 1, 16) as sequence_hash, substr(sha256(p_name), 1, 32) as hash from part")
def seq_hashes(spark, d):
    return read_table(spark, d, "part").select("p_partkey", bio.sequence_hash("p_name").alias("sequence_hash"), bio.store_hash("p_name").alias("hash"))


@query("select * from (select distinct filter_id, sequence_id from filter_results) where sequence_id in (select sequence_id from sequences where molecule_type = 'rna')")
def semi_lookup(spark, d):
    rna = read_table(spark, d, "sequences").where("molecule_type = 'rna'")
    return R.semi_lookup(read_table(spark, d, "filter_results").select("filter_id", "sequence_id").distinct(), rna, "sequence_id")


@query("select sequence_id from sequences where sequence = (select sequence from sequences where sequence_id = (select min(sequence_id) from sequences where sequence is not null))")
def lookup_by_hash(spark, d):
    s = read_table(spark, d, "sequences").where("sequence is not null")
    one = s.agg(F.min_by("sequence", "sequence_id")).first()[0]  # the text to look for
    store = Store(spark, scratch_path(spark, "store"))
    store.append("sequences", s.select("sequence_id", "sequence", "length", bio.store_hash("sequence").alias("hash")))
    return store.find(one).select("sequence_id")


@query("select sequence_id, sequence from (select *, row_number() over (partition by sequence order by sequence_id) rn from sequences where sequence is not null) where rn = 1")
def drop_duplicates_first(spark, d):
    return sampling.ordered_first(read_table(spark, d, "sequences").where("sequence is not null"), ["sequence"], [F.col("sequence_id")]).select("sequence_id", "sequence")


@query("select upper(p_name) as sequence, min(p_partkey) as p_partkey from part group by 1")
def generated_dedup(spark, d):
    p = read_table(spark, d, "part").withColumn("sequence", F.upper("p_name"))
    return sampling.ordered_first(p, ["sequence"], [F.col("p_partkey")]).select("sequence", "p_partkey")


# --- Latest rows and pivots ---------------------------------------------------------------------

_KINDS = ["tm", "plddt", "ptm", "solubility"]
_LATEST = f"{P}, ranked as (select *, row_number() over (partition by sequence_id, prediction_type order by prediction_id desc) rn from p where sequence_id is not null)"
_CASES = ", ".join(f"max(case when prediction_type = '{k}' then value end) as {k}" for k in _KINDS)


@query(f"with {_LATEST} select sequence_id, value as tm from ranked where prediction_type = 'tm' and rn = 1")
def latest_prediction(spark, d):
    return R.latest_value(_pred(spark, d).where("sequence_id is not null"), "tm")


@query(f"with {_LATEST} select sequence_id, prediction_id, prediction_type from ranked where rn = 1")
def latest_rows(spark, d):
    return R.latest(_pred(spark, d).where("sequence_id is not null"), ["sequence_id", "prediction_type"], ["prediction_id"]).select("sequence_id", "prediction_id", "prediction_type")


@query(f"with {_LATEST}, w as (select sequence_id, {_CASES} from ranked where rn = 1 group by 1) select s.sequence_id, {', '.join(_KINDS)} from sequences s left join w using (sequence_id)")
def prediction_pivot(spark, d):
    return R.export_wide(read_table(spark, d, "sequences").select("sequence_id"), _pred(spark, d), _KINDS)


@query(f"""with {_LATEST}, ids as (select distinct sequence_id from filter_results where passed and stage_name = 'filter_tm'),
w as (select sequence_id, {_CASES} from ranked where rn = 1 group by 1), g as (select sequence_id, max_by(stage_name, filter_id) source_label from filter_results where sequence_id is not null group by 1)
select s.sequence_id, s.length, s.hash, {', '.join(_KINDS)}, source_label from sequences s semi join ids using (sequence_id) left join w using (sequence_id) left join g using (sequence_id)""")
def working_set_materialize(spark, d):
    f = read_table(spark, d, "filter_results")
    made = f.where("sequence_id is not null").select("sequence_id", F.col("filter_id").alias("metadata_id"), F.col("stage_name").alias("label"))
    ids = R.id_set(f.where("passed and stage_name = 'filter_tm'"))
    return R.working_frame(ids, read_table(spark, d, "sequences").select("sequence_id", "length", "hash"), _pred(spark, d), _KINDS, made)


@query(f"with {_LATEST}, w as (select sequence_id, {_CASES} from ranked where rn = 1 group by 1) select sequence_id, tm, plddt from w where tm >= 50 order by tm desc, sequence_id limit 100")
def pipeline_flagship(spark, d):
    wide = R.pivot_latest(_pred(spark, d), _KINDS)
    return flt.Ranking("tm", n=100).apply(flt.Threshold("tm", min=50).apply(wide)).select("sequence_id", "tm", "plddt")


@query(f"with {P} select distinct sequence_id from sequences s where not exists (select 1 from p where p.sequence_id = s.sequence_id and prediction_type = 'tm' and model_name = 'thermadyne-2' and (value is not null or json_extract_string(metadata, '$.status') = 'failed'))")
def uncached_ids(spark, d):
    return R.uncached(read_table(spark, d, "sequences"), _pred(spark, d), "tm", "thermadyne-2")


@query(f"with {P} select distinct sequence_id from sequences where sequence_id in (select sequence_id from p where prediction_type = 'tm' and value is not null)")
def ids_with_prediction(spark, d):
    return R.with_prediction(read_table(spark, d, "sequences"), _pred(spark, d), "tm")


# --- Id sets and upserts ------------------------------------------------------------------------


def _ids(spark, d, kind):
    return R.id_set(read_table(spark, d, "predictions").where(F.col("prediction_type") == kind))


_IDS = "a as (select distinct sequence_id from predictions where prediction_type = 'tm' and sequence_id is not null), b as (select distinct sequence_id from predictions where prediction_type = 'plddt' and sequence_id is not null)"


@query(f"with {_IDS} select * from a intersect select * from b")
def ws_intersect(spark, d):
    return R.ids_intersect(_ids(spark, d, "tm"), _ids(spark, d, "plddt"))


@query(f"with {_IDS} select * from a union select * from b")
def ws_union(spark, d):
    return R.ids_union(_ids(spark, d, "tm"), _ids(spark, d, "plddt"))


@query(f"with {_IDS} select * from a except select * from b")
def ws_difference(spark, d):
    return R.ids_difference(_ids(spark, d, "tm"), _ids(spark, d, "plddt"))


@query(f"with {_IDS}, c as (select distinct sequence_id from predictions where prediction_type = 'ptm' and sequence_id is not null) (select * from a union select * from b) intersect select * from c")
def parallel_merge(spark, d):
    tm, plddt, ptm, either = (Stage(n) for n in ("tm", "plddt", "ptm", "either"))
    tm.mode = plddt.mode = "union"
    out = {n: _ids(spark, d, n) for n in ("tm", "plddt", "ptm")}
    out["either"] = Pipeline._merge([tm, plddt], out)
    return Pipeline._merge([either, ptm], out)


@query(f"with {P} select sequence_id, model_name, prediction_type, min(prediction_id) prediction_id, max_by(value, prediction_id) filter (value is not null) as value from p group by 1, 2, 3")
def upsert_non_null(spark, d):
    return R.upsert_non_null(_pred(spark, d), ["sequence_id", "model_name", "prediction_type"])


@query(f"with {P} select sequence_id, model_name, prediction_id, value from (select *, row_number() over (partition by sequence_id, model_name order by prediction_id desc) rn from p) where rn = 1")
def upsert_replace(spark, d):
    return R.upsert_replace(_pred(spark, d), ["sequence_id", "model_name"], ["prediction_id"]).select("sequence_id", "model_name", "prediction_id", "value")


@query("""with s as (select distinct stage_id, run_id, stage_name from stage_completions where completed_at < timestamp '2025-07-01'),
n as (select stage_id, run_id, stage_name from (select *, row_number() over (partition by stage_id order by run_id nulls last, stage_name) rn from (select distinct stage_id, run_id, stage_name from stage_completions where completed_at >= timestamp '2025-03-01')) where rn = 1)
select * from s union all select * from n where stage_id not in (select stage_id from s)""")
def insert_if_absent(spark, d):
    c = read_table(spark, d, "stage_completions")
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    cols = ["stage_id", "run_id", "stage_name"]
    old = c.where(F.col("completed_at") < at("2025-07-01")).select(*cols).distinct()
    return R.insert_if_absent(old, c.where(F.col("completed_at") >= at("2025-03-01")).select(*cols).distinct(), ["stage_id"], ["run_id", "stage_name"])


# --- Output rules -------------------------------------------------------------------------------

_RULES = [
    {"where": "${{ tm > 70 }}", "order_by": [{"field": "tm", "order": "desc"}], "limit": 20, "log": {"tags": {"kind": "hot"}, "metrics": {"m": "tm"}, "artifacts": [{"type": "json"}]}},
    {"where": "plddt >= 80 and tm > 50", "order_by": [{"field": "plddt", "order": "desc"}], "log": {"tags": {"kind": "sure", "extra": "1"}, "params": {"p": "plddt"}}},
]


def _wide(spark, d):
    return R.pivot_latest(_pred(spark, d), ["tm", "plddt"]).withColumn("_position", F.col("sequence_id"))


_WIDE = f"with {_LATEST}, w as (select sequence_id, max(case when prediction_type = 'tm' then value end) tm, max(case when prediction_type = 'plddt' then value end) plddt from ranked where rn = 1 and prediction_type in ('tm', 'plddt') group by 1), r1 as (select * from w where tm > 70 order by tm desc, sequence_id limit 20), r2 as (select * from w where plddt >= 80 and tm > 50 order by plddt desc, sequence_id limit 200)"


@query(f"{_WIDE} select * from r1")
def rule_where_order_limit(spark, d):
    return select_rows(_wide(spark, d), _RULES[0]).drop("_position")


@query(f"{_WIDE} select * from w order by sequence_id limit 200")
def rule_default_limit(spark, d):
    return select_rows(_wide(spark, d), {}).drop("_position")


@query(f"{_WIDE} select * from w where false")
def rule_missing_field(spark, d):
    return select_rows(_wide(spark, d), {"where": "nothing > 1"}).drop("_position")


@query(f"{_WIDE} select * from r1 union select * from r2")
def rule_union(spark, d):
    return union_rules(_wide(spark, d), _RULES)


@query(f"""{_WIDE}, u as (select * from r1 union select * from r2),
a as (select count(*)::double n, count(tm)::double c, avg(tm) m, sum(tm) s, min(tm) lo, max(tm) hi, stddev_samp(tm) sd, quantile_cont(tm, 0.5) p50, quantile_cont(tm, 0.9) p90, quantile_cont(tm, 0.95) p95, quantile_cont(tm, 0.99) p99 from u)
select metric, round(value, 6) as value from (select unnest(['__rows__.count', 'tm.count', 'tm.mean', 'tm.sum', 'tm.min', 'tm.max', 'tm.std', 'tm.p50', 'tm.p90', 'tm.p95', 'tm.p99']) metric, unnest([n, c, m, s, lo, hi, sd, p50, p90, p95, p99]) value from a)""")
def rule_aggregates_query(spark, d):
    config = {"outputs": _RULES, "aggregates": [{"field": "__rows__", "ops": ["count"]}, {"field": "tm", "ops": ["count", "mean", "sum", "min", "max", "std", "p50", "p90", "p95", "p99"]}]}
    return rule_aggregates(_wide(spark, d), config).select("metric", F.round("value", 6).alias("value"))


@query(f"""{_WIDE}, u as (select sequence_id, bool_or(r = 1) a, bool_or(r = 2) b from (select sequence_id, 1 r from r1 union all select sequence_id, 2 from r2) group by 1)
select sequence_id, case when b then 'sure' else 'hot' end kind, case when b then '1' end extra, case when b then 'plddt' end p, case when a then 'tm' end m, case when a then 1 else 0 end n_artifacts from u""")
def rule_combine(spark, d):
    c = combine_rules(_wide(spark, d), _RULES)
    return c.select("sequence_id", F.col("tags")["kind"].alias("kind"), F.col("tags")["extra"].alias("extra"), F.col("params")["p"].alias("p"), F.col("metrics")["m"].alias("m"), F.size("artifacts").alias("n_artifacts"))


# --- Scalar functions ---------------------------------------------------------------------------

_S = "(select sequence_id, sequence from sequences where sequence is not null)"


def _seq(spark, d):
    return read_table(spark, d, "sequences").where("sequence is not null").select("sequence_id", "sequence")


@query(f"select sequence_id, length(sequence) as n from {_S}")
def seq_length(spark, d):
    return _seq(spark, d).select("sequence_id", bio.sequence_length("sequence").alias("n"))


_TYPE = "case when regexp_full_match(u, '[ATCGN]*') then 'dna' when regexp_full_match(u, '[AUCGN]*') then 'rna' when regexp_full_match(u, '[ACDEFGHIKLMNPQRSTVWY*]*') then 'protein' else 'unknown' end"


@query(f"select sequence_id, {_TYPE} as kind from (select sequence_id, replace(upper(sequence), ':', '') u from {_S})")
def detect_type(spark, d):
    return _seq(spark, d).select("sequence_id", bio.detect_type("sequence").alias("kind"))


@query(f"select case when count(distinct k) = 1 then min(k) else 'unknown' end as molecule_type from (select {_TYPE} k from (select replace(upper(sequence), ':', '') u from {_S})) where k <> 'unknown'")
def infer_molecule_type(spark, d):
    return spark.createDataFrame([(infer_molecule(_seq(spark, d)),)], "molecule_type string")


@query(f"select sequence_id, reverse(translate(upper(sequence), 'ATCG', 'TAGC')) as rc from {_S} where regexp_full_match(sequence, '[ACGTUNacgtun]+')")
def reverse_complement(spark, d):
    return _seq(spark, d).where("sequence rlike '^[ACGTUNacgtun]+\\\\z'").select("sequence_id", bio.reverse_complement("sequence").alias("rc"))


_AT = lambda i: f"strpos('TCAG', substr(s, 3 * k + {i}, 1))"


@query(f"select sequence_id, coalesce(array_to_string(list_transform(range(0, length(s) // 3), lambda k: case when {_AT(1)} * {_AT(2)} * {_AT(3)} > 0 then substr('{bio.CODON_RESIDUES}', 16 * ({_AT(1)} - 1) + 4 * ({_AT(2)} - 1) + {_AT(3)}, 1) else 'X' end), ''), '') as protein from (select sequence_id, translate(upper(sequence), 'U', 'T') s from {_S} where regexp_full_match(sequence, '[ACGTUNacgtun]+'))")
def codon_translate(spark, d):
    return _seq(spark, d).where("sequence rlike '^[ACGTUNacgtun]+\\\\z'").select("sequence_id", bio.translate_codons("sequence").alias("protein"))


@query(f"select sequence_id, case when n < 50 then '<50' when n < 150 then '50-150' when n < 300 then '150-300' else '>300' end as bin from (select sequence_id, length(sequence) n from {_S})")
def length_bins(spark, d):
    return _seq(spark, d).select("sequence_id", bio.length_bin("sequence", [50, 150, 300]).alias("bin"))


@query(f"""select sequence_id, regexp_full_match(sequence, '[ACDEFGHIKLMNPQRSTVWY]+') aa, regexp_full_match(sequence, '[ACDEFGHIKLMNPQRSTVWYBXZUO]+') aa_extended, regexp_full_match(sequence, '[ACGT]*') dna_or_empty,
regexp_full_match(replace(sequence, ':', ''), '[ACDEFGHIKLMNPQRSTVWYBXZUO]*') aa_plus, regexp_full_match(upper(sequence), '[ACDEFGHIKLMNPQRSTVWY]*') valid, length(sequence) - length(replace(sequence, 'K', '')) as n_k,
length(sequence) - length(replace(sequence, 'W', '')) = 1 as one_w, contains(sequence, 'W') or contains(sequence, 'C') as some, contains(sequence, 'ATOM') atoms from {_S}""")
def validators(spark, d):
    s = "sequence"
    return _seq(spark, d).select("sequence_id", bio.matches_alphabet(s).alias("aa"), bio.matches_alphabet(s, bio.EXTENDED_AMINO_ACIDS).alias("aa_extended"), bio.matches_alphabet(s, "ACGT", empty=True).alias("dna_or_empty"), bio.extended_with(s, [":"]).alias("aa_plus"), bio.validate_sequence(s).alias("valid"), bio.occurrences(s, "K").alias("n_k"), bio.single_occurrence(s, "W").alias("one_w"), bio.any_occurrence(s, ["W", "C"]).alias("some"), bio.has_atoms(s).alias("atoms"))


@query(f"select sequence_id, regexp_replace(sequence, '[^A-Za-z]', '', 'g') as cleaned from {_S}")
def regex_clean(spark, d):
    return _seq(spark, d).select("sequence_id", F.regexp_replace("sequence", "[^A-Za-z]", "").alias("cleaned"))


@query("select sequence_id, coalesce(lower(trim(sequence)) not in ('', 'nan', 'none'), false) as usable from sequences")
def usable_inputs(spark, d):
    return read_table(spark, d, "sequences").select("sequence_id", bio.usable_text("sequence").alias("usable"))


@query(f"select sequence_id, left(sequence, 2) || 'W' || substr(sequence, 4) as mutant from {_S} where length(sequence) > 10")
def point_mutation(spark, d):
    return _seq(spark, d).where("length(sequence) > 10").select("sequence_id", bio.mutate_at("sequence", 2, "W").alias("mutant"))


@query("select p_partkey, array_to_string(list_transform(range(1, length(p_name) + 1), lambda i: case when i in (1, 4) then '<mask>' else substr(p_name, i, 1) end), '') as masked from part")
def apply_mask(spark, d):
    return read_table(spark, d, "part").select("p_partkey", bio.apply_mask("p_name", F.array(F.lit(0), F.lit(3))).alias("masked"))


@query(f"select sequence_id, (select count(*) from range(1, least(length(sequence), {len(REFERENCE)}) + 1) r(i) where substr(sequence, i, 1) <> substr('{REFERENCE}', i, 1)) as n_mutations from {_S}")
def mutation_count(spark, d):
    return _seq(spark, d).select("sequence_id", bio.mutation_count("sequence", F.lit(REFERENCE)).alias("n_mutations"))


@query(f"with {P} select prediction_id, json_extract_string(metadata, '$.status') as status, cast(json_extract_string(metadata, '$.ms') as double) as ms from p where metadata is not null")
def json_extract(spark, d):
    return _pred(spark, d).where("metadata is not null").select("prediction_id", extract.at_path("metadata", "status").alias("status"), extract.scalar("metadata", "ms").alias("ms")).distinct()


@query("select event_id, cast(json_extract_string(props, '$.k') as double) as k from events")
def response_scalar(spark, d):
    return read_table(spark, d, "events").select("event_id", extract.scalar("props", "k").alias("k"))


@query("select vec_id, round(list_aggregate(embedding::double[], 'avg'), 9) as mean, round(list_aggregate(embedding::double[], 'sum'), 6) as total, round(list_max(embedding)::double, 9) as most, round(list_min(embedding)::double, 9) as least from embeddings")
def response_reduction(spark, d):
    r = read_table(spark, d, "embeddings").select("vec_id", F.to_json(F.struct(F.array(F.col("embedding").cast("array<double>")).alias("plddt"))).alias("r"))
    return r.select("vec_id", F.round(extract.scalar("r", "plddt", "mean"), 9).alias("mean"), F.round(extract.scalar("r", "plddt", "sum"), 6).alias("total"), F.round(extract.scalar("r", "plddt", "max"), 9).alias("most"), F.round(extract.scalar("r", "plddt", "min"), 9).alias("least"))


@query("select vec_id, round(list_aggregate(embedding::double[], 'avg'), 9) as mean from embeddings")
def embedding_mean_pool(spark, d):
    return read_table(spark, d, "embeddings").select("vec_id", F.round(vectors.vec_mean("embedding"), 9).alias("mean"))


@query("""with m as (select vec_id // 2 as sequence_id, case when vec_id % 2 = 0 then 'a' else 'b' end as model_name, embedding from embeddings)
select x.sequence_id, round(list_aggregate(list_concat(x.embedding, y.embedding)::double[], 'sum'), 6) as total, len(list_concat(x.embedding, y.embedding)) as n from m x join m y using (sequence_id) where x.model_name = 'a' and y.model_name = 'b'""")
def embedding_concat(spark, d):
    e = read_table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 2).cast("long").alias("sequence_id"), F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b").alias("model_name"), F.col("embedding").alias("values"))
    c = R.embeddings_concat(e, ["a", "b"])
    return c.select("sequence_id", F.round(vectors.vec_sum("values"), 6).alias("total"), F.size("values").cast("long").alias("n"))


@query("select vec_id, (select prediction_type from (select unnest(['A', 'C', 'D', 'E']) prediction_type, unnest(embedding[1:4]) v, unnest([1, 2, 3, 4]) o) order by v desc, o limit 1) as best from embeddings")
def argmax_logits(spark, d):
    return read_table(spark, d, "embeddings").select("vec_id", vectors.argmax_symbol(F.slice("embedding", 1, 4), "ACDE").alias("best"))


@query("select vec_id, round(exp(embedding[1]::double) / (exp(embedding[1]::double) + exp(embedding[2]::double) + exp(embedding[3]::double)), 9) as p1 from embeddings")
def softmax_probabilities(spark, d):
    return read_table(spark, d, "embeddings").select("vec_id", F.round(vectors.softmax(F.slice("embedding", 1, 3))[0], 9).alias("p1"))


@query("select vec_id, 'm' || substr('AC', i, 1) || i || substr('DEF', j, 1) as prediction_type, embedding[(i - 1) * 3 + j]::double as value from embeddings, range(1, 3) a(i), range(1, 4) b(j)")
def matrix_unpivot(spark, d):
    e = read_table(spark, d, "embeddings").select("vec_id", F.array(F.slice("embedding", 1, 3), F.slice("embedding", 4, 3)).alias("m"), F.array(F.lit("A"), F.lit("C")).alias("r"), F.array(F.lit("D"), F.lit("E"), F.lit("F")).alias("c"))
    return extract.unpivot_matrix(e, ["vec_id"], "m", "r", "c", "m")
