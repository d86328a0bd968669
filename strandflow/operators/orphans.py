"""References to records that are missing, deleted, or arrived later."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

HEAVY_SHARE = 0.001  # a key with this share of a table's references is heavy, so there are at most 1,000
OUT = ["ref_table", "ref_field", "row_id", "period", "reason"]


@dataclass(frozen=True)
class Reference:
    """Field ``field`` of ``rows`` names keys of ``parent``; ``name``, ``row_id`` and ``time`` label the report."""

    rows: DataFrame
    name: str
    field: str
    row_id: str
    time: str
    parent: DataFrame
    parent_key: str
    parent_time: str
    deleted: DataFrame  # (key)
    text_key: bool = False  # compare trimmed and lower-cased, blank is no reference
    state: DataFrame | None = None  # ``parent_state``, if references share it

    def key(self, c: Column) -> Column:
        if not self.text_key:
            return c.cast("long")
        t = F.lower(F.trim(c))
        return F.when(t != "", t)


def period_of(time: Column) -> Column:
    """yyyy-MM, or 'unknown' if null."""
    return F.coalesce(F.date_format(time, "yyyy-MM"), F.lit("unknown"))


def _rows(r: Reference) -> DataFrame:
    """(key, at, period, row_id) of the rows that make a reference, read once for each use with these columns only."""
    at = F.col(r.time).cast("timestamp_ntz")
    return r.rows.select(r.key(F.col(r.field)).alias("key"), at.alias("at"), period_of(at).alias("period"), F.col(r.row_id).cast("string").alias("row_id")).where("key is not null")


def parent_state(r: Reference) -> DataFrame:
    """(key, parent_at, here, dead): every key that the parent table or the deleted keys hold, once; staged for all references to it."""
    parent = r.parent.select(r.key(F.col(r.parent_key)).alias("key"), F.col(r.parent_time).cast("timestamp_ntz").alias("parent_at"), F.lit(1).alias("here"), F.lit(0).alias("dead"))
    dead = r.deleted.select(r.key(F.col("key")).alias("key"), F.lit(None).cast("timestamp_ntz").alias("parent_at"), F.lit(0).alias("here"), F.lit(1).alias("dead"))
    both = parent.unionByName(dead).where("key is not null")
    return staged(both.groupBy("key").agg(F.min("parent_at").alias("parent_at"), F.max("here").alias("here"), F.max("dead").alias("dead")), "parents")


def _judged(r: Reference, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heavy, light): (key, gone, parent_at) of all heavy keys, and of those others that are absent or late for some row.

    ``totals`` (key, n, first_at) is pre-aggregated by key, so however often a key is named it meets its
    parent once. There are at most 1 / HEAVY_SHARE heavy keys: they are sent to where the parents are, and
    what they find is as small; the other keys meet the parents by shuffle. gone is 'deleted' or 'missing'
    for absent parents, else null.
    """
    state = r.state if r.state is not None else parent_state(r)
    least = max(1000.0, (totals.agg(F.sum("n")).first()[0] or 0) * HEAVY_SHARE)
    heavy, light = totals.where(F.col("n") >= least), totals.where(F.col("n") < least)
    of_heavy = state.join(F.broadcast(heavy.select("key")), "key", "left_semi")
    gone = F.when(F.coalesce("here", F.lit(0)) == 0, F.when(F.col("dead") == 1, "deleted").otherwise("missing"))
    judged = lambda t: t.select("key", gone.alias("gone"), "parent_at", "first_at")
    hot = judged(heavy.join(F.broadcast(of_heavy), "key", "left")).drop("first_at")
    cold = judged(light.join(state, "key", "left")).where("gone is not null or parent_at > first_at").drop("first_at")
    return staged(hot, "heavy"), staged(cold, "suspects")


def _met(rows: DataFrame, hot: DataFrame, cold: DataFrame, hit: Column) -> DataFrame:
    """Rows with what ``hot`` or ``cold`` say of their key and ``hit`` holds for, in one scan of the rows.

    Rows of heavy keys find them in a broadcast; those without a hit end there. The rest meet ``cold`` by a
    shuffle in which the rows of heavy keys that are left are spread by a salt and pass.
    """
    cols = [c for c in hot.columns if c != "key"]
    r = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "key", "left").where(F.col("_hot").isNull() | hit)
    salt = F.when(F.col("_hot"), 1 + F.pmod(F.xxhash64("row_id", "at"), F.lit(1023))).otherwise(F.lit(0)).cast("int")
    r = r.withColumn("_salt", salt).withColumnsRenamed({c: f"_{c}" for c in cols})
    r = r.join(cold.withColumn("_salt", F.lit(0)).withColumn("_cold", F.lit(True)), ["key", "_salt"], "left").where("_hot or _cold")
    picked = [F.when(F.col("_hot"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in cols]
    return r.select(*rows.columns, *picked).where(hit)


def orphan_rows(r: Reference) -> DataFrame:
    """(ref_table, ref_field, row_id, period, reason), all text: every row whose reference has no parent.

    reason is ``late`` if the parent exists but its time is after the row's, ``deleted`` if it is absent
    and among the deleted keys, else ``missing``. Rows delivered twice come out once.

    References are pre-aggregated by key (map-side). Heavy keys are checked by broadcast, the others by a
    shuffle join, and so are the rows in a second scan, so that no key's rows meet in one task.

    Null keys (and blank ones, of text keys) are no reference; a row without a time has period
    ``unknown`` and is never late; a parent key that occurs twice counts with its first time, one without
    any time is never late; empty tables give no rows.
    """
    rows = _rows(r)
    totals = staged(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("at").alias("first_at")), "refs")
    reason = F.coalesce("gone", F.when(F.col("parent_at") > F.col("at"), "late"))
    hit = _met(rows, *_judged(r, totals), reason.isNotNull())
    return hit.select(F.lit(r.name).alias("ref_table"), F.lit(r.field).alias("ref_field"), "row_id", "period", reason.alias("reason")).distinct()


def orphan_counts(r: Reference) -> DataFrame:
    """(ref_table, ref_field, period, reason, n_rows): orphan references per period, a row counting as often as it was delivered.

    References are pre-aggregated per key and period with their first and last time. Heavy keys are
    checked against a bounded broadcast, the others by a shuffle join, and both counts are united; rows
    are read again only for keys whose parent arrived within a period, heavy ones by broadcast once more.
    Nulls are handled as in ``orphan_rows``.
    """
    rows = _rows(r)
    pre = staged(rows.groupBy("key", "period").agg(F.count("*").alias("n"), F.count("at").alias("n_at"), F.min("at").alias("first_at"), F.max("at").alias("last_at")), "refs")
    hot, cold = _judged(r, pre.groupBy("key").agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at")))
    checked = pre.join(F.broadcast(hot), "key").unionByName(pre.join(F.broadcast(hot.select("key")), "key", "left_anti").join(cold, "key"))
    reason = F.coalesce("gone", F.when(F.col("parent_at") > F.col("last_at"), "late"), F.when(F.col("parent_at") > F.col("first_at"), "part"))
    whole = checked.select("key", "period", "parent_at", reason.alias("reason"), F.when(F.col("gone").isNotNull(), F.col("n")).otherwise(F.col("n_at")).alias("n")).where("reason is not null")
    part = staged(whole.where("reason = 'part'").groupBy("key", "parent_at").agg(F.collect_set("period").alias("periods")), "part")
    is_hot = F.broadcast(hot.select("key"))
    # Heavy keys without such a period are told too, so that their rows end at the broadcast.
    hot_part = hot.select("key").join(F.broadcast(part.join(is_hot, "key", "left_semi")), "key", "left")
    late = _met(rows, hot_part, part.join(is_hot, "key", "left_anti"), F.array_contains("periods", F.col("period")) & (F.col("parent_at") > F.col("at")))
    late = late.groupBy("period").agg(F.count("*").alias("n")).select("period", F.lit("late").alias("reason"), "n")
    both = whole.where("reason <> 'part'").select("period", "reason", "n").unionByName(late)
    return both.groupBy("period", "reason").agg(F.sum("n").alias("n_rows")).select(F.lit(r.name).alias("ref_table"), F.lit(r.field).alias("ref_field"), "period", "reason", "n_rows")


def store_references(tables: dict[str, DataFrame]) -> list[Reference]:
    """The references between the tables of a sequence store."""
    dead = tables["tombstones"]
    gone = {e: dead.where(F.col("entity") == e).select(F.col("entity_key").alias("key")) for e in ("sequences", "pipeline_runs")}
    seq = {"parent": tables["sequences"], "parent_key": "sequence_id", "parent_time": "created_at", "deleted": gone["sequences"]}
    run = {"parent": tables["pipeline_runs"], "parent_key": "run_id", "parent_time": "created_at", "deleted": gone["pipeline_runs"], "text_key": True}
    refs = [
        Reference(tables["predictions"], "predictions", "sequence_id", "prediction_id", "created_at", **seq),
        Reference(tables["filter_results"], "filter_results", "sequence_id", "filter_id", "created_at", **seq),
        Reference(tables["filter_results"], "filter_results", "run_id", "filter_id", "created_at", **run),
        Reference(tables["stage_completions"], "stage_completions", "run_id", "stage_id", "completed_at", **run),
    ]
    states = {k: parent_state(next(r for r in refs if r.parent_key == k)) for k in ("sequence_id", "run_id")}
    return [replace(r, state=states[r.parent_key]) for r in refs]
