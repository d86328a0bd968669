"""Queries over the training-data operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import read_table, staged
from .arrivals import repeats_since
from .cutoff import keep_fraction
from .formatting import format_copies, records
from .leakage import leaks
from .near import near_groups
from .packing import CAPACITY, pack_texts
from .splitting import split_texts

Query = Callable[[SparkSession, str], DataFrame]
SINCE = "2025-10-01"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats_since(read_table(spark, d, "sequences"), SINCE).select(F.col("id").alias("sequence_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return format_copies(read_table(spark, d, "sequences")).where("keep_id <> member_id").select("keep_id", F.col("member_id").alias("copy_id"))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return records(read_table(spark, d, "sequences"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return keep_fraction(read_table(spark, d, "predictions"))[1].select(F.col("id").alias("prediction_id")).distinct()


def p4_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return keep_fraction(read_table(spark, d, "predictions"))[0]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_groups(read_table(spark, d, "sequences")).where("group_id <> member_id").select("group_id", F.col("member_id").alias("sequence_id"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_groups(read_table(spark, d, "sequences")).groupBy("group_id").agg(F.count("*").alias("n_members"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_texts(read_table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"), slots="same")
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p8_templates(spark: SparkSession, d: str) -> DataFrame:
    found = leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "exact_windows", "template_windows", "consistent", "item_share", "kind")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return split_texts(read_table(spark, d, "documents")).select(F.col("id").alias("doc_id")).distinct()


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_texts(read_table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row: what must hold of the containers."""
    c = read_table(spark, d, "documents")
    box = staged(pack_texts(c), "boxes")
    fill = box.where("container is not null").groupBy("container").agg(F.sum("tokens").alias("fill"), F.count("*").alias("items"))
    boxes = fill.agg(F.max("fill").alias("most"), F.count("*").alias("n"), F.sum("fill").alias("all"))
    # A text in several parts is above the capacity, and all its parts but the last fill a container alone.
    parts = box.groupBy("id", "copy").agg(F.count("*").alias("parts"), F.sum("tokens").alias("n"))
    whole = parts.agg(F.bool_and(F.col("parts") == F.greatest(F.lit(1), F.ceil(F.col("n") / CAPACITY))).alias("undivided"), F.count("*").alias("n_texts"), F.sum("n").alias("n_tokens"))
    bound = F.ceil(F.col("all") / CAPACITY)
    return whole.crossJoin(boxes).select("n_texts", "n_tokens", "undivided", (F.col("most") <= CAPACITY).alias("within"), (F.col("n") <= bound * 1.02 + 2).alias("tight"))  # one row each


def p8_windows(spark: SparkSession, d: str) -> DataFrame:
    found = leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items")).where("kind = 'exact'")
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "exact_windows")


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, n_tokens, within, overlapping, restored): what must hold of the pieces of each text."""
    docs = read_table(spark, d, "documents")
    p = split_texts(docs)
    w = Window.partitionBy("id").orderBy("piece")
    before = F.lag(F.col("first_token") + F.col("n_tokens")).over(w)
    p = p.withColumn("shared", before - F.col("first_token")).withColumn("done", F.coalesce(F.lag("end").over(w), F.lit(0)))
    p = p.withColumn("own", F.substring("text", (F.col("done") - F.col("start") + 1).cast("int"), F.length("text")))
    per = p.groupBy("id").agg(F.max(F.col("first_token") + F.col("n_tokens")).alias("n_tokens"), (F.max("n_tokens") <= 1024).alias("within"), (F.coalesce(F.min("shared"), F.lit(64)) == 64).alias("a"), (F.coalesce(F.max("shared"), F.lit(64)) == 64).alias("b"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "own"))), lambda x: x["own"]), "").alias("back"))
    per = per.join(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("source_text")), "id")
    return per.select(F.col("id").alias("doc_id"), "n_tokens", "within", (F.col("a") & F.col("b")).alias("overlapping"), (F.col("back") == F.col("source_text")).alias("restored"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p2_found, p2_records, p4_found, p4_cutoffs, p5_found, p5_groups, p7_containers, p8_found, p8_templates, p8_items, p9_found, p9_pieces, p7_checks, p8_windows, p9_checks)}

_WINDOWS = """
letters as (select sequence_id, created_at, regexp_replace(upper(sequence), '[^A-Z]', '', 'g') s from sequences),
texts as (select s, min(sequence_id) id, min_by(sequence_id, (created_at, sequence_id)) first_id, min(created_at) first_at from letters where length(s) >= 8 group by s),
win as (select distinct id, s[i:i + 7] w from (select id, s, unnest(range(1, length(s) - 6)) i from texts)),
size as (select id, count(*) n from win group by id),
common as (select x.id a, y.id b, count(*) c from win x join win y on x.w = y.w and x.id < y.id group by all),
links as (select a, b from common join size p on p.id = a join size q on q.id = b where c >= 0.5 * (p.n + q.n - c))"""

ORACLE: dict[str, str] = {
    "p1_found": f"""with {_WINDOWS},
late as (select t2.first_id sequence_id from links l join texts t1 on t1.id = l.a join texts t2 on t2.id = l.b where (t1.first_at, t1.first_id) < (t2.first_at, t2.first_id) and t2.first_at >= timestamp '{SINCE}'
 union select t1.first_id from links l join texts t1 on t1.id = l.a join texts t2 on t2.id = l.b where (t2.first_at, t2.first_id) < (t1.first_at, t1.first_id) and t1.first_at >= timestamp '{SINCE}'
 union select sequence_id from letters l join texts t on l.s = t.s where l.sequence_id <> t.first_id and l.created_at >= timestamp '{SINCE}')
select sequence_id from late""",
    "p5_found": f"""with recursive {_WINDOWS},
both_ways as (select a, b from links union all select b, a from links),
reach as (select id, id as g from texts union select b, r.g from reach r join both_ways on a = r.id),
label as (select id, min(g) g from reach group by id)
select g as group_id, sequence_id from letters l join texts t on l.s = t.s join label on label.id = t.id where sequence_id <> g""",
}

_CANON = """
canon as (select sequence_id, list_sort(list_filter(string_split_regex(regexp_replace(upper(sequence), '[^A-Z:/|;]', '', 'g'), '[:/|;]+'), lambda c: c <> '')) c,
 length(regexp_replace(upper(sequence), '[^A-Z]', '', 'g')) n from sequences),
recs as (select c, min(sequence_id) keep_id, count(*) n_copies from canon where n >= 8 group by c)"""
ORACLE["p2_found"] = f"with {_CANON} select keep_id, sequence_id copy_id from canon join recs using (c) where n >= 8 and sequence_id <> keep_id"
ORACLE["p2_records"] = f"with {_CANON} select keep_id, n_copies from recs"

_SCORES = """
rows as (select distinct prediction_id, lower(trim(model_name)) model_name, lower(trim(prediction_type)) prediction_type, value from predictions
 where value is not null and not isnan(value) and model_name is not null and prediction_type is not null),
ranked as (select *, rank() over (partition by model_name, prediction_type order by value desc) r, count(*) over (partition by model_name, prediction_type) n from rows)"""
ORACLE["p4_found"] = f"with {_SCORES} select distinct prediction_id from ranked where 5 * (r - 1) < n"
ORACLE["p4_cutoffs"] = f"""with {_SCORES}, kept as (select model_name, prediction_type, max(n) n_rows, min(value) cutoff, count(*) n_kept from ranked where 5 * (r - 1) < n group by all)
select k.*, (select count(*) from rows r where r.model_name = k.model_name and r.prediction_type = k.prediction_type and r.value = k.cutoff) n_ties from kept k"""

ORACLE["p5_groups"] = ORACLE["p5_found"].replace("select g as group_id, sequence_id from", "select g as group_id, count(*) as n_members from").replace("where sequence_id <> g", "where g in (select g from letters l join texts t on l.s = t.s join label on label.id = t.id where sequence_id <> g) group by g")

_SPANS = """
dw as (select doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') w from documents where text is not null),
iw as (select item_id, regexp_extract_all(item_text, '[\\p{L}\\p{N}]+') w from eval_items where item_text is not null),
ds as (select distinct doc_id, lower(array_to_string(w[i:i + 12], ' ')) s from (select doc_id, w, unnest(range(1, length(w) - 11)) i from dw)),
js as (select distinct item_id, lower(array_to_string(w[i:i + 12], ' ')) s from (select item_id, w, unnest(range(1, length(w) - 11)) i from iw)),
hit as (select distinct doc_id, item_id from ds join js using (s))"""
ORACLE["p8_found"] = f"with {_SPANS} select doc_id, item_id from hit"
ORACLE["p8_items"] = f"with {_SPANS} select item_id, count(*) n_docs from hit group by item_id"
# Word characters and blanks in the sense of the tokenizer, which RE2 knows for ASCII only.
_TOKEN = "[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s\\v\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+"
ORACLE["p9_found"] = f"select distinct doc_id from documents where length(regexp_extract_all(text, '{_TOKEN}')) > 1024"
_N = f"length(regexp_extract_all(text, '{_TOKEN}'))"
ORACLE["p7_checks"] = f"select count(*) as n_texts, cast(sum(coalesce({_N}, 0)) as bigint) as n_tokens, true as undivided, true as within, true as tight from documents"
ORACLE["p9_checks"] = f"select doc_id, {_N} as n_tokens, true as within, true as overlapping, true as restored from documents where {_N} > 1024"
_AT = _SPANS.replace("select distinct doc_id, lower", "select doc_id, i, lower")
ORACLE["p8_windows"] = f"with {_AT} select doc_id, item_id, count(distinct i) as exact_windows from ds join js using (s) group by all"
