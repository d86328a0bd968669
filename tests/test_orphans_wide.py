"""Orphan references and wide tables: skew, nulls, ties, repeats, empty tables, clashing names."""

import random
from datetime import datetime, timedelta

import pytest

from strandflow.operators import orphans, wide
from strandflow.operators.orphans import Reference

REF = "row_id long, key_field string, at timestamp_ntz, key string, n int, heavy string, reason string"
PAR = "run_id string, created timestamp_ntz, key string, parent_at string"


def reference(spark, rows, parents, dead, text=True):
    return Reference(
        spark.createDataFrame([(*r, "k", 1, "h", "r") for r in rows], REF), "t", "key_field", "row_id", "at",
        spark.createDataFrame([(*p, "k", "p") for p in parents], PAR), "run_id", "created",
        spark.createDataFrame([(d,) for d in dead], "key string"), text,
    )


def judge(rows, parents, dead):
    norm = lambda k: (k or "").strip(" ").lower() or None
    first = {}
    for k, t in parents:
        if norm(k):
            first.setdefault(norm(k), []).append(t)
    gone = {norm(d) for d in dead}
    out = []
    for i, k, at in rows:
        k = norm(k)
        if k is None:
            continue
        times = [t for t in first.get(k, []) if t]
        reason = ("deleted" if k in gone else "missing") if k not in first else "late" if at and times and min(times) > at else None
        if reason:
            out.append(("t", "key_field", str(i), at.strftime("%Y-%m") if at else "unknown", reason))
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(2)
    day = datetime(2025, 3, 1)
    keys = [f"run-{i}" for i in range(60)]
    parents = [(k.upper() if i % 3 else f" {k}", day + timedelta(days=i)) for i, k in enumerate(keys[:40])] + [("run-0", day + timedelta(days=90)), (None, day), ("run-39b", None)]
    rows = []
    for i in range(6000):
        k = "run-3" if i % 3 == 0 else "gone" if i % 3 == 1 and i % 2 else rng.choice([*keys, "", "  ", None, "run-39b"])
        rows.append((i, k, None if i % 11 == 0 else day + timedelta(hours=rng.randrange(0, 24 * 80))))
    rows += rows[:50]
    return rows, parents, ["run-45", "RUN-46 ", "run-3", "run-46", None]


def test_orphan_rows(spark, case):
    got = [tuple(r) for r in orphans.orphan_rows(reference(spark, *case)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == set(judge(*case))


def test_orphan_counts(spark, case):
    want = {}
    for _, _, _, period, reason in judge(*case):
        want[period, reason] = want.get((period, reason), 0) + 1
    got = {(r["period"], r["reason"]): r["n_rows"] for r in orphans.orphan_counts(reference(spark, *case)).collect()}
    assert got == want


def test_a_heavy_key_whose_parent_came_within_a_period(spark):
    day = datetime(2025, 3, 1)
    rows = [(i, "Hot " if i % 3 else "sound", None if i % 50 == 0 else day + timedelta(minutes=i * 9)) for i in range(6000)] + [(9000 + i, f"k{i % 700}", day) for i in range(3000)]
    parents = [("hot", day + timedelta(days=12)), ("sound", day - timedelta(days=1)), *[(f"k{i}", day + timedelta(hours=i - 5)) for i in range(300)]]
    case = (rows, parents, ["k500"])
    got = {tuple(r) for r in orphans.orphan_rows(reference(spark, *case)).collect()}
    assert got == set(judge(*case)) and any(r[4] == "late" for r in got)
    want = {}
    for _, _, _, period, reason in judge(*case):
        want[period, reason] = want.get((period, reason), 0) + 1
    assert {(r["period"], r["reason"]): r["n_rows"] for r in orphans.orphan_counts(reference(spark, *case)).collect()} == want


def test_orphans_of_empty_tables(spark, case):
    assert orphans.orphan_rows(reference(spark, [], case[1], [])).count() == 0
    assert orphans.orphan_counts(reference(spark, [], [], [])).count() == 0
    some = [(1, "a", None)]
    assert [r["reason"] for r in orphans.orphan_rows(reference(spark, some, [], [])).collect()] == ["missing"]


EAV = "sequence_id long, model_name string, prediction_type string, value double, prediction_id long, entity string, no int, cell_id string, k0 string"


def test_wide_table(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        t = rng.choice(["is_ok", "N_hits", " score ", "score", None])
        v = {"is_ok": float(rng.randint(0, 1)), "N_hits": float(rng.randint(0, 9))}.get(t, rng.random())
        rows.append((1 if i % 3 == 0 else rng.randrange(40), rng.choice(["A", "a ", "b", None]), t, rng.choice([v, v, v, None, float("nan")]), i))
    rows += rows[:100] + [(None, "a", "score", 1.0, 9000), (5, "a", "score", 1.0, None)]
    df = spark.createDataFrame([(*r, "e", 1, "c", "k") for r in rows], EAV)
    want = {}
    for s, m, t, v, p in rows:
        if None not in (s, m, t, v, p) and v == v:
            k = (s, m.strip(" ").lower(), t.strip(" ").lower())
            want[k] = max(want.get(k, (-1, 0)), (p, v))
    table, attributes = wide.wide_table(df, with_ids=True)
    assert {a.name: a.kind for a in attributes} == {f"{m}__{t}": kind for m in "ab" for t, kind in (("is_ok", "boolean"), ("n_hits", "bigint"), ("score", "double"))}
    assert dict(table.dtypes)["a__is_ok"] == "boolean" and dict(table.dtypes)["a__n_hits"] == "bigint"
    got = {}
    for r in table.collect():
        for a in attributes:
            if r[a.name] is not None:
                got[r["sequence_id"], *a.key] = (r[f"{a.name}__id"], float(r[a.name]))
    assert got == want
    long = {tuple(r) for r in wide.unpivot_ids(table, attributes).collect()}
    assert long == {(*k, p) for k, (p, _) in want.items()}


def test_wide_table_of_nothing(spark):
    table, attributes = wide.wide_table(spark.createDataFrame([], EAV), with_ids=True)
    assert attributes == [] and table.count() == 0
    assert wide.unpivot_ids(table, attributes).count() == 0


def test_wide_names_never_clash(spark):
    rows = [(1, m, "x", 1.0, i) for i, m in enumerate(["a-b", "a b", "a_b", "日本", "!"])]
    table, attributes = wide.wide_table(spark.createDataFrame([(*r, "", 0, "", "") for r in rows], EAV))
    assert len({a.name.lower() for a in attributes}) == 5 and len(table.columns) == 6


def test_too_many_attributes_are_refused(spark):
    rows = [(1, f"m{i}", "x", 1.0, i, "", 0, "", "") for i in range(20)]
    with pytest.raises(ValueError):
        wide.wide_table(spark.createDataFrame(rows, EAV), max_attributes=10)


def test_tied_cells_take_the_largest_value_in_any_order(spark):
    for values in ([2.0, 9.0, 4.0], [9.0, 4.0, 2.0], [4.0, 2.0, 9.0]):
        rows = [(1, "m", "score_x", v / 7, 5, "", 0, "", "") for v in values]
        table, _ = wide.wide_table(spark.createDataFrame(rows, EAV).repartition(1))
        assert table.first()["m__score_x"] == 9 / 7
