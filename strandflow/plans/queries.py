"""The catalogue of queries over the core operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import orphans, wide
from ..session import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if it has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- References to records that do not exist ---------------------------------------------------


def _references(spark: SparkSession, d: str) -> list[orphans.Reference]:
    return orphans.store_references({t: read_table(spark, d, t) for t in ("sequences", "pipeline_runs", "tombstones", "predictions", "filter_results", "stage_completions")})


_ORPHANS = """
refs as (
 select 'predictions' t, 'sequence_id' f, prediction_id::varchar id, sequence_id::varchar k, created_at ts from predictions
 union all select 'filter_results', 'sequence_id', filter_id::varchar, sequence_id::varchar, created_at from filter_results
 union all select 'filter_results', 'run_id', filter_id::varchar, nullif(lower(trim(run_id)), ''), created_at from filter_results
 union all select 'stage_completions', 'run_id', stage_id, nullif(lower(trim(run_id)), ''), completed_at from stage_completions),
parents as (select 'sequence_id' f, sequence_id::varchar k, created_at p from sequences union all select 'run_id', lower(trim(run_id)), created_at from pipeline_runs),
dead as (select distinct case entity when 'sequences' then 'sequence_id' else 'run_id' end f, lower(trim(entity_key)) k from tombstones),
judged as (select t, refs.f, id, ts, case when parents.k is null then case when dead.k is null then 'missing' else 'deleted' end when p > ts then 'late' end reason
 from refs left join parents on refs.f = parents.f and refs.k = parents.k left join dead on refs.f = dead.f and refs.k = dead.k where refs.k is not null)"""


@query(f"with {_ORPHANS} select distinct t ref_table, f ref_field, id row_id, coalesce(strftime(ts, '%Y-%m'), 'unknown') period, reason from judged where reason is not null")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    a, *rest = [orphans.orphan_rows(r) for r in _references(spark, d)]
    for b in rest:
        a = a.unionByName(b)
    return a


@query(f"with {_ORPHANS} select t ref_table, f ref_field, coalesce(strftime(ts, '%Y-%m'), 'unknown') period, reason, count(*) n_rows from judged where reason is not null group by all")
def p3_report(spark: SparkSession, d: str) -> DataFrame:
    a, *rest = [orphans.orphan_counts(r) for r in _references(spark, d)]
    for b in rest:
        a = a.unionByName(b)
    return a


# --- Attribute-value rows into wide tables -----------------------------------------------------


@query("""select sequence_id, lower(trim(model_name)) model_name, lower(trim(prediction_type)) prediction_type, max(prediction_id) prediction_id from predictions
where value is not null and not isnan(value) and model_name is not null and prediction_type is not null and sequence_id is not null group by all""")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    table, attributes = wide.wide_table(read_table(spark, d, "predictions"), with_ids=True)
    return wide.unpivot_ids(table, attributes)


_CELLS = """
rows as (select sequence_id, lower(trim(model_name)) m, lower(trim(prediction_type)) t, prediction_id, value from predictions
 where value is not null and not isnan(value) and model_name is not null and prediction_type is not null and sequence_id is not null and prediction_id is not null),
cell as (select sequence_id, m, t, max((prediction_id, value))[2] as value from rows group by all),
kinds as (select m, t, case when bool_and(value in (0, 1)) then 'boolean' when bool_and(value = floor(value) and abs(value) < 9007199254740992) then 'bigint' else 'double' end as column_type from cell group by all)"""


@query(f"""with {_CELLS} select sequence_id, trim(regexp_replace(m, '[^A-Za-z0-9_]+', '_', 'g'), '_') || '__' || trim(regexp_replace(t, '[^A-Za-z0-9_]+', '_', 'g'), '_') as column_name, column_type, round(value, 9) as value from cell join kinds using (m, t)""")
def p6_wide(spark: SparkSession, d: str) -> DataFrame:
    """The wide table read back: one row per filled cell, with the name and type of its column."""
    table, attributes = wide.wide_table(read_table(spark, d, "predictions"))
    if not attributes:
        return table.select("sequence_id", F.lit(None).cast("string").alias("column_name"), F.lit(None).cast("string").alias("column_type"), F.lit(None).cast("double").alias("value"))
    kinds = dict(table.dtypes)
    number = lambda a: F.col(a.name).cast("int").cast("double") if a.kind == "boolean" else F.col(a.name).cast("double")
    cells = F.array(*[F.struct(F.lit(a.name).alias("column_name"), F.lit(kinds[a.name]).alias("column_type"), F.round(number(a), 9).alias("value")) for a in attributes])
    return table.select("sequence_id", F.inline(F.filter(cells, lambda c: c["value"].isNotNull())))
