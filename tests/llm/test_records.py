"""Near duplicates, arrivals and format copies against brute force."""

import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow import session
from strandflow.llm import arrivals, bloom, near
from strandflow.llm import letters as L
from strandflow.llm.arrivals import SegmentIndex, repeats_since
from strandflow.llm.formatting import format_copies, records
from strandflow.llm.near import chunk_keys, near_groups, signatures
from strandflow.llm.pairs import FEW, pair_runs

AA = "ACDEFGHIKLMNPQRSTVWY"
SCHEMA = "sequence_id long, sequence string, created_at timestamp_ntz, id string, letters int, key string, kind string"


def text(rng, n, alphabet=AA):
    return "".join(rng.choice(alphabet) for _ in range(n))


def edited(rng, s):
    s = list(s)
    for _ in range(rng.randint(1, 3)):
        i = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[i] = rng.choice(AA)
        elif kind == 1:
            s.insert(i, rng.choice(AA))
        else:
            del s[i]
    s = "".join(s)
    if rng.random() < 0.3:  # a stretch moves to the end
        i = rng.randrange(len(s) // 2)
        s = s[:i] + s[i + 20 :] + s[i : i + 20]
    return s


def windows(s):
    s = re.sub("[^A-Z]", "", (s or "").upper())
    return {s[i : i + 8] for i in range(len(s) - 7)}


def sim(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    at = datetime(2025, 9, 1)
    out = []
    roots = [text(rng, rng.randint(60, 300)) for _ in range(25)] + [text(rng, 200, "ACGT") for _ in range(10)]
    for i in range(300):
        r = rng.choice(roots) if rng.random() < 0.6 else text(rng, rng.randint(5, 200), rng.choice([AA, "ACGT"]))
        s = edited(rng, r) if len(r) > 50 and rng.random() < 0.6 else r
        if rng.random() < 0.2:
            s = " ".join(s[k : k + 10] for k in range(0, len(s), 10)).lower()
        out.append((i * 3 + 1, s, at + timedelta(hours=rng.randrange(0, 24 * 60))))
    hot = text(rng, 120)
    out += [(2000 + i, hot if i % 2 else hot.lower(), at + timedelta(hours=i % 7)) for i in range(120)]  # many copies, tied times
    out += [(3000 + i, edited(rng, hot), at + timedelta(days=40)) for i in range(40)]  # a crowd of near copies
    out += [(4000, None, at), (4001, "", at), (4002, "ACD EFG", at), (4003, "nan", at), (4004, text(rng, 60000), at), (4005, "!!!---123", at), (None, hot, at), (4006, hot, None)]
    out += [out[0], out[1]]  # delivered twice
    return [(*r, "x", 1, None, "y") for r in out]


def groups_of(rows, at_least=0.5):
    items = {r[0]: windows(r[1]) for r in rows if r[0] is not None and len(re.sub("[^A-Z]", "", (r[1] or "").upper())) >= 8}
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(items)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sim(items[a], items[b]) >= at_least:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(find(i), i) for i in ids if find(i) != i}


@pytest.mark.parametrize(("leaders", "rare"), [(64, False), (2, False), (2, True)])
def test_near_groups_are_those_of_brute_force(spark, rows, leaders, rare, monkeypatch):
    if rare:
        monkeypatch.setattr(near, "few_pairs", lambda *_: False)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in near_groups(df, leaders=leaders).where("group_id <> member_id").collect()}
    assert got == groups_of(rows)


def test_a_frequent_window_in_many_prefixes_makes_few_pairs(spark, monkeypatch):
    """Short texts that are mostly one shared stretch: their rare windows are few, so the frequent ones decide."""
    rng = random.Random(31)
    stretch = text(rng, 30)
    rows = [(i, text(rng, rng.randint(0, 4)) + stretch + text(rng, rng.randint(0, 60))) for i in range(400)]
    rows = [(*r, datetime(2025, 1, 1), "", 1, "", "") for r in rows]
    seen = []
    monkeypatch.setattr(near, "few_pairs", lambda *_: False)
    check = near.verified
    monkeypatch.setattr(near, "verified", lambda pairs, *rest: seen.append(pairs.count()) or check(pairs, *rest))
    got = {tuple(r) for r in near_groups(spark.createDataFrame(rows, SCHEMA), leaders=16).where("group_id <> member_id").collect()}
    assert got == groups_of(rows)
    assert sum(seen) < 400 * 399 / 4


def test_unrelated_nucleotide_texts_rarely_share_a_key(spark):
    rng = random.Random(5)
    texts = spark.createDataFrame([(i, text(rng, 400, "ACGT")) for i in range(3000)], "id long, letters string")
    runs = pair_runs(near.signature_keys(texts), 64)
    assert runs.select("kind", "a", "b").distinct().count() < 100  # of 4.5 million; two slots a key gave about 1,000


def test_similar_texts_have_a_kind_of_key_in_common():
    rng = random.Random(6)
    pairs = []
    while len(pairs) < 1500:
        n = rng.choice([12, 30, 60, 71, 72, 90, 150])
        cut, mixed = rng.randint(0, n), rng.random() < 0.7
        a = text(rng, cut, "ACGT") + text(rng, n - cut, AA if mixed else "ACGT")
        i, j = sorted((rng.randint(0, n), rng.randint(0, n)))
        b = rng.choice([a[i:j], a[i:] + text(rng, i, AA), text(rng, n - j) + a[:j], edited(rng, a + "ACGT")])
        if len(b) >= 8 and len(windows(a) & windows(b)) >= 0.5 * len(windows(a) | windows(b)):
            pairs += [a, b]
    data, off = np.frombuffer("".join(pairs).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in pairs])])
    general, plain = near.key_kinds(data, off, 0.5)
    assert (general | plain).all() and not general.all() and plain.any()
    assert ((general[0::2] & general[1::2]) | (plain[0::2] & plain[1::2])).all()


def test_near_groups_of_nucleotides_and_mixed_texts(spark):
    rng = random.Random(7)
    rows = []
    for g in range(60):
        n = rng.choice([45, 80, 200, 400])
        first = text(rng, n, "ACGT") if g % 3 else text(rng, n // 2, "ACGU") + text(rng, n - n // 2)
        rows += [(len(rows) + i + 1, t) for i, t in enumerate([first, edited(rng, first), edited(rng, first)])]
    got = {tuple(r) for r in near_groups(spark.createDataFrame(rows, "sequence_id long, sequence string")).collect()}
    w = {i: windows(t) for i, t in rows}
    low = {i: i for i in w}
    for i in w:
        for j in w:
            if i < j and len(w[i] & w[j]) >= 0.5 * len(w[i] | w[j]):
                a, b = sorted((low[i], low[j]))
                low = {k: a if v == b else v for k, v in low.items()}
    size = {g: list(low.values()).count(g) for g in low.values()}
    assert got == {(g, i) for i, g in low.items() if size[g] > 1}


def test_near_groups_include_their_first_member_once(spark, rows):
    g = near_groups(spark.createDataFrame(rows, SCHEMA))
    assert g.count() == g.distinct().count()
    firsts = {r[0] for r in g.select("group_id").distinct().collect()}
    assert firsts <= {r[0] for r in g.where("group_id = member_id").select("member_id").collect()}


@pytest.mark.parametrize("n", [0, 1])
def test_near_groups_of_nothing(spark, n):
    df = spark.createDataFrame([(1, "ACDEFGHIKLM", datetime(2025, 1, 1), "", 1, "", "")] * n, SCHEMA)
    assert near_groups(df).count() == 0
    assert repeats_since(df, "2025-10-01").count() == 0
    assert format_copies(df).count() == n


def test_chunk_keys_keep_the_pigeonhole_promise():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**32, (200, 24), dtype=np.uint64)
    for wrong in range(16):
        b = a.copy()
        for row in b:
            row[rng.choice(24, wrong, replace=False)] += np.uint64(1)
        assert (chunk_keys(a) == chunk_keys(b)).any(1).all()


def test_signature_distance_follows_similarity():
    rng = random.Random(2)
    s = text(rng, 300)
    t = s[:250] + text(rng, 50)
    data = np.frombuffer((s + t).encode(), np.uint8)
    x, y = signatures(data, np.array([0, 300, 600]), slots=300)
    assert abs((x == y).mean() - sim(windows(s), windows(t))) < 0.1


def brute_repeats(rows, since):
    items = [(r[2], r[0], windows(r[1])) for r in rows if r[0] is not None and r[2] is not None and len(re.sub("[^A-Z]", "", (r[1] or "").upper())) >= 8]
    return {i for t, i, w in items if t >= since and any((u, j) < (t, i) and sim(w, v) >= 0.5 for u, j, v in items)}


@pytest.mark.parametrize(("leaders", "rare"), [(64, False), (2, False), (2, True)])
def test_repeats_are_those_of_brute_force(spark, rows, leaders, rare, monkeypatch):
    if rare:
        monkeypatch.setattr(arrivals, "few_pairs", lambda *_: False)
    got = {r[0] for r in repeats_since(spark.createDataFrame(rows, SCHEMA), "2025-10-01", leaders=leaders).collect()}
    assert got == brute_repeats(rows, datetime(2025, 10, 1))


@pytest.mark.parametrize("batch", [10000, 7])
def test_long_keys_leave_no_stored_text_out(spark, batch):
    stored = spark.createDataFrame([(1, i) for i in range(60)] + [(2, i) for i in range(16)], "key long, id long").selectExpr("key", "id", f"{50 << 42}L place")
    probes = spark.createDataFrame([(k, i) for k in (1, 2) for i in (100, 101)], "key long, id long").selectExpr("key", "id", f"{50 << 42}L place")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)  # 7: the key becomes long in its third batch
    try:
        rows = [(r["kind"], r["key"], r["a"], r["b"]) for r in arrivals.candidates(stored, probes, leaders=16).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((a, b) for kind, key, a, b in rows if (kind, key) == (0, 1)) == [(a, b) for a in (100, 101) for b in range(FEW)]
    assert sorted(b for kind, key, _, b in rows if (kind, key) == (2, 1)) == list(range(FEW, 60))
    assert sorted((a, b) for kind, key, a, b in rows if key == 2) == [(a, b) for a in (100, 101) for b in range(16)]


def test_a_repeat_of_a_leader_of_long_keys_is_found(spark, tmp_path):
    rng = random.Random(2)
    at, new = datetime(2025, 9, 1), datetime(2025, 10, 2)
    x, y = text(rng, 60), text(rng, 60)
    # 60 texts hold x and 60 hold y in the same places; the one that holds both comes thirteenth in all keys it shares.
    popular = [(i, x + text(rng, 60) if i % 2 else text(rng, 60) + y) for i in range(1, 121)]
    history = [(i if i <= 24 else i + 1, s, at) for i, s in popular] + [(25, x + y, at)]
    rows = [(*r, "x", 1, None, "y") for r in [*history, (500, y + x, new)]]
    assert brute_repeats(rows, datetime(2025, 10, 1)) == {500}
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r[0] for r in repeats_since(df, "2025-10-01", leaders=16).collect()} == {500}
    index = SegmentIndex(spark, str(tmp_path / "index"), leaders=16)
    index.append(df.where("sequence_id < 500"))
    assert {r[0] for r in index.check(df.where("sequence_id = 500")).collect()} == {500}


def test_segments_within_the_edit_bound_always_meet():
    """Every text within ``edit_bound`` edits of a stored one has a key in common with it, and the bound proves the similarity."""
    rng = random.Random(21)
    for alphabet in (AA, "ACGT"):
        for _ in range(150):
            s = text(rng, rng.randint(24, 400), alphabet)
            bound = int(arrivals.edit_bound(len(windows(s)), 0, 0.5))
            t = list(s)
            for _ in range(rng.randint(1, max(1, bound))):
                i = rng.randrange(len(t))
                t[i : i + rng.randint(0, 1)] = rng.choice(["", rng.choice(alphabet)]) if len(t) > 20 else "A"
            t = "".join(t)
            of = lambda x: (np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)]))
            stored, probes = set(arrivals.stored_segments(*of(s))[1].tolist()), set(arrivals.probe_substrings(*of(t))[1].tolist())
            if bound:
                assert stored & probes, (s, t)
                assert sim(windows(s), windows(t)) >= 0.5


def test_positions_are_those_of_the_substrings():
    rng = random.Random(22)
    s = "".join(text(rng, 200) for _ in range(3))
    off = np.array([0, 200, 230, 600])
    data = np.frombuffer(s.encode(), np.uint8)
    h, starts = arrivals.substring_hashes(data, off)
    for cut in (arrivals.stored_segments, arrivals.probe_substrings):
        t, key, pos = cut(data, off)
        assert (h[starts[t] + pos] == key).all()


@pytest.mark.parametrize("n", [16, 17, 25, 31, 33])
def test_short_nucleotide_texts_that_differ_at_an_end_are_found(spark, n):
    rng = random.Random(n)
    s = text(rng, n, "ACGT")
    at, new = datetime(2025, 9, 1), datetime(2025, 10, 2)
    rows = [(1, s, at), (2, s[:-1] + ("A" if s[-1] != "A" else "C"), new), (3, s[1:], new), (4, s + "ACGT", new)]
    got = {r[0] for r in repeats_since(spark.createDataFrame([(*r, "x", 1, None, "y") for r in rows], SCHEMA), "2025-10-01").collect()}
    assert got == brute_repeats([(*r, 0) for r in rows], datetime(2025, 10, 1))


@pytest.mark.parametrize("lot", ["week", "month"])
def test_lots_of_any_size_give_the_same(spark, rows, lot):
    got = {r[0] for r in repeats_since(spark.createDataFrame(rows, SCHEMA), "2025-10-01", lot=lot).collect()}
    assert got == brute_repeats(rows, datetime(2025, 10, 1))


def test_a_batch_moves_no_history(spark, tmp_path, monkeypatch):
    """What a small batch stages, and what it shuffles for its candidates, does not follow the size of the history."""
    rng = random.Random(23)
    at = datetime(2025, 9, 1)
    size, seen, moved, cols = {}, [], [], "sequence_id long, sequence string, created_at timestamp_ntz"
    batch = [(10**6 + i, text(rng, 80), at + timedelta(days=40)) for i in range(20)]
    monkeypatch.setattr(arrivals, "staged", lambda df, what: seen.append(out := session.staged(df, what)) or out)
    scan = arrivals.candidates
    monkeypatch.setattr(arrivals, "candidates", lambda stored, *rest: moved.append(stored.count()) or scan(stored, *rest))
    monkeypatch.setattr(session, "_delete", lambda *_: None)
    for n in (300, 3000):
        index = SegmentIndex(spark, str(tmp_path / f"index{n}"))
        index.append(spark.createDataFrame([(i, text(rng, 80), at) for i in range(n)] + [(9999, batch[0][1][:-1] + "A", at)], cols))
        seen, moved = [], []
        assert {r[0] for r in index.check(spark.createDataFrame(batch, cols)).collect()} == {10**6}
        size[n] = (sum(t.count() for t in seen), moved)
    assert size[3000] == size[300]


def test_daily_batches_over_an_index_give_the_same(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA).where("created_at is not null and sequence_id is not null")
    cut = F.lit("2025-10-01").cast("timestamp_ntz")
    index = SegmentIndex(spark, str(tmp_path / "index"))
    index.append(df.where(F.col("created_at") < cut))
    got = set()
    days = [r[0] for r in df.where(F.col("created_at") >= cut).select(F.to_date("created_at").alias("d")).distinct().orderBy("d").collect()]
    for at in range(0, len(days), 8):  # in lots of several days, to keep the test short
        lot = df.where(F.to_date("created_at").isin(days[at : at + 8]))
        got |= {r[0] for r in index.check(lot).collect()}
        index.append(lot)
    assert got == brute_repeats(rows, datetime(2025, 10, 1))


def test_long_runs_give_leader_pairs_and_members(spark):
    keyed = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 7), (2, 9), (3, 1)], "key long, id long")
    r = pair_runs(keyed, leaders=10).collect()
    pairs = {(x["a"], x["b"]) for x in r if x["kind"] == 0}
    assert (7, 9) in pairs
    assert {(a, b) for a in range(FEW) for b in range(500) if a < b} <= pairs
    assert len(pairs) <= 10 * 9 / 2 + FEW * 490 + 1
    assert {x["a"] for x in r if x["kind"] == 1 and x["key"] == 1} == set(range(500))


def canon(s):
    return ":".join(sorted(c for c in (re.sub("[^A-Z]", "", c) for c in re.split("[:/|;]+", s.upper())) if c))


def test_format_copies_are_those_of_brute_force(spark):
    rng = random.Random(3)
    base = [text(rng, 30) + ":" + text(rng, 20) for _ in range(40)]
    rows = []
    for i in range(400):
        a, b = rng.choice(base).split(":")
        if rng.random() < 0.4:
            a = text(rng, 12)
        s = rng.choice([f"{a}:{b}", f"{b}|{a}", f" {a.lower()} // {b}", f"{a[:5]}-{a[5:]};;{b};", f"{b}/1{a}2"])
        rows.append((i, s, None, "c", 1, "h", "k"))
    rows += [(900, None, None, "", 0, "", ""), (901, "AC:DE", None, "", 0, "", ""), (902, ":::", None, "", 0, "", ""), (None, base[0], None, "", 0, "", ""), rows[0]]
    rows += [(1000 + i, base[0], None, "", 0, "", "") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for i, s, *_ in rows:
        if i is not None and s and len(re.sub("[^A-Z]", "", s.upper())) >= 8:
            want.setdefault(canon(s), set()).add(i)
    pairs = {(min(v), i) for v in want.values() for i in v}
    for per_row in (8, 1000):  # one range, and several
        got = format_copies(df, max_bits=1 << 16, per_row=per_row)
        assert {(r["keep_id"], r["member_id"]) for r in got.collect()} == pairs
    assert {(r[0], r[1]) for r in records(df).collect()} == {(min(v), len(v)) for v in want.values()}


def test_a_full_filter_loses_no_copy(spark):
    rng = random.Random(9)
    rows = [(i, text(rng, 12), None, "", 0, "", "") for i in range(500)]
    rows += [(1000 + i, r[1].lower(), *r[2:]) for i, r in enumerate(rows[:20])]
    full = bloom.merged_filter(spark.range(3).selectExpr("id as k"), lambda b: b.column(0).to_numpy().view(np.uint64), 1 << 16, twice=False)
    assert sum(bin(x).count("1") for x in full) == 3 * bloom.HASHES
    got = format_copies(spark.createDataFrame(rows, SCHEMA), per_row=0)  # 65,536 bits for any number of rows
    assert {(r["keep_id"], r["member_id"]) for r in got.where("n_copies > 1 and keep_id <> member_id").collect()} == {(i, 1000 + i) for i in range(20)}


@pytest.mark.parametrize("n", [3_000, 300_000])
def test_filters_pass_few_singletons_at_any_size(spark, n):
    keys = spark.range(n).selectExpr("xxhash64(id) as k")
    of = lambda b: b.column(0).to_numpy().view(np.uint64)
    bits = bloom.size_for(n, 8, 1 << 29)
    mask = np.frombuffer(bytes(bloom.merged_filter(keys, of, bits, twice=True)), np.uint8)
    at = bloom.places(np.array([r[0] for r in keys.collect()], np.int64).view(np.uint64), bits)
    assert bloom.all_set(mask, at).mean() < 0.01


def test_slices_come_back_as_they_were():
    rng = np.random.default_rng(3)
    for share in (0.0, 0.001, 0.06, 0.5, 1.0):
        part = np.packbits((rng.random(bloom.SLICE * 8) < share).astype(np.uint8), bitorder="little")
        assert len(bloom.encoded(part)) <= bloom.SLICE and (bloom.decoded(bloom.encoded(part)) == part).all()


def test_letters_keep_only_a_to_z(spark):
    df = spark.createDataFrame([("ab-c 1ß",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(L.letters(F.col("s"))).collect()] == ["ABCSS", None, ""]
