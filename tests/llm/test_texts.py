"""Cutoffs, packing, leakage and splitting against brute force."""

import random
import re
from math import ceil

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandflow.llm.cutoff import cutoffs, keep_fraction, source_rows
from strandflow.llm.leakage import leaks, learn_typing
from strandflow.llm.packing import best_fit, fillings, pack, pack_texts
from strandflow.llm.splitting import cut, split_texts
from strandflow.llm.tokens import TOKEN, count_tokens, words

SCORES = "prediction_id long, model_name string, prediction_type string, value double, id long, n string, cutoff double"


def brute_cutoffs(rows, keep=0.2):
    src = {}
    for i, m, t, v in {r[:4] for r in rows}:
        if i is not None and m is not None and t is not None and v is not None and v == v:
            src.setdefault((m.strip(" ").lower(), t.strip(" ").lower()), []).append((v, i))
    cuts, kept = {}, set()
    for k, vs in src.items():
        need = max(1, ceil(len(vs) * keep - 1e-9))
        c = sorted((v for v, _ in vs), reverse=True)[need - 1]
        cuts[k] = (len(vs), c, sum(v >= c for v, _ in vs), sum(v == c for v, _ in vs))
        kept |= {i for v, i in vs if v >= c}
    return cuts, kept


@pytest.fixture(scope="module")
def scores():
    rng = random.Random(1)
    rows = []
    for i in range(4000):
        m = rng.choice(["a", "A ", " a", "b", "c", None])
        t = rng.choice(["x", "X", "y"])
        v = rng.choice([None, float("nan"), float("inf"), -1.0, 0.0]) if rng.random() < 0.05 else round(rng.gauss(0, 3), rng.choice([0, 1, 6]))
        rows.append((i, m, t, v))
    rows += [(5000 + i, "ties", "t", 1.0) for i in range(300)] + [(6000, "one", "t", 5.0)] + [(6100 + i, "two", "t", float(i)) for i in range(2)]
    rows += rows[:100] + [(None, "a", "x", 99.0)]
    return [(*r, 1, "n", 0.0) for r in rows]


@pytest.mark.parametrize("bracket", [200_000, 3])
def test_cutoffs_are_exact(spark, scores, bracket):
    df = spark.createDataFrame(scores, SCORES)
    got = {(r["model_name"], r["prediction_type"]): (r["n_rows"], r["cutoff"], r["n_kept"], r["n_ties"]) for r in cutoffs(source_rows(df), max_bracket=bracket).collect()}
    assert got == brute_cutoffs(scores)[0]


def test_cutoffs_survive_a_poor_sketch(spark, scores):
    df = spark.createDataFrame(scores, SCORES)
    got = {(r["model_name"], r["prediction_type"]): r["cutoff"] for r in cutoffs(source_rows(df), k=8, error=0.0).collect()}
    assert got == {k: v[1] for k, v in brute_cutoffs(scores)[0].items()}


def test_kept_rows(spark, scores):
    _, kept = keep_fraction(spark.createDataFrame(scores, SCORES))
    assert {r["id"] for r in kept.collect()} == brute_cutoffs(scores)[1]


def test_cutoffs_of_nothing(spark):
    cuts, kept = keep_fraction(spark.createDataFrame([], SCORES))
    assert cuts.count() == 0 and kept.count() == 0


# --- Packing ---


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_pack_places_every_item_once_within_capacity(sizes):
    bins = pack(sizes, 100, nodes=200)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= len(best_fit(sizes, 100))


def fewest(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(i, room):
        if len(room) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(room)
            return
        for k in sorted({r for r in room}, reverse=True):
            if k >= sizes[i]:
                j = room.index(k)
                room[j] -= sizes[i]
                go(i + 1, room)
                room[j] += sizes[i]
        room.append(capacity - sizes[i])
        go(i + 1, room)
        room.pop()

    go(0, [])
    return best[0] if sizes else 0


def test_pack_finds_the_fewest_bins_of_small_cases():
    rng = random.Random(4)
    close = 0
    for _ in range(60):
        sizes = [rng.randint(10, 70) for _ in range(10)]
        got, want = len(pack(sizes, 100)), fewest(sizes, 100)
        assert got <= want + 1
        close += got == want
    assert close >= 57


def test_pack_without_a_node_limit_finds_the_fewest_bins():
    rng = random.Random(11)
    for _ in range(40):
        sizes = [rng.randint(15, 60) for _ in range(11)]
        assert len(pack(sizes, 100, nodes=None)) == fewest(sizes, 100)


def test_fillings_are_undominated():
    sizes = [2, 3, 5, 9]
    options, whole = fillings(10, sizes, dict.fromkeys(sizes, 1), width=50)
    assert whole and options
    for f in options:
        left = 10 - sum(f)
        rest = [s for s in sizes if s not in f]
        assert all(s > left for s in rest)
        assert not any(x < y <= x + left for x in f for y in rest)


def test_pack_texts(spark):
    rng = random.Random(6)
    rows = [(i, "w " * n) for i in range(400) for n in [min(6000, int(rng.paretovariate(1.0) * 60))]]
    rows += [(900, None), (901, "  "), (902, "w " * 2048), (903, "w " * 4097), (904, "w " * 2047)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "doc_id long, text string, tokens string, container int")
    out = pack_texts(df, per_shard=50).collect()
    fill, parts = {}, {}
    for r in out:
        parts.setdefault(r["id"], []).append(r["tokens"])
        if r["container"] is not None:
            fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
    assert max(fill.values()) <= 2048
    want = {i: count_tokens(t) for i, t in rows}
    assert {i: sum(p) for i, p in parts.items()} == want
    assert all(len(p) == max(1, ceil(want[i] / 2048)) for i, p in parts.items())
    assert len(fill) <= 1.05 * sum(want.values()) / 2048 + 2


def test_every_row_is_an_item(spark):
    rows = [(None, "a b c"), (None, "d e f"), (7, "a b c"), (7, "a b c"), (8, "w " * 4100), (8, "v " * 4100), (None, None), (None, "")]
    out = pack_texts(spark.createDataFrame(rows, "doc_id long, text string"), capacity=2048).collect()
    assert sorted(r["tokens"] for r in out) == [0, 0, 3, 3, 3, 3, 4, 4, 2048, 2048, 2048, 2048]
    assert len({(r["id"], r["copy"], r["part"], r["tokens"]) for r in out}) == len(out)
    fill = {}
    for r in out:
        if r["container"]:
            fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
    assert sorted(fill.values()) == [20, 2048, 2048, 2048, 2048]


def test_pack_texts_of_nothing(spark):
    assert pack_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- Splitting ---

PIECES = st.lists(st.sampled_from(["word", "x", "Wort. ", " ", "\n", "\n\n", "! ", ", ", "§§", "é", "12", "　", "_"]), max_size=400).map("".join)


@settings(max_examples=120, deadline=None)
@given(PIECES, st.integers(5, 40), st.integers(0, 4))
def test_cut_round_trip(text, limit, overlap):
    n = count_tokens(text)
    pieces = cut(text, limit, overlap)
    if n <= limit:
        assert pieces == []
        return
    starts = [m.start() for m in TOKEN.finditer(text)]
    assert pieces[0][0] == 0 and pieces[-1][0] + pieces[-1][1] == n
    back = ""
    for k, (first, size, begin, end) in enumerate(pieces):
        assert 0 < size <= limit
        if k:
            before = pieces[k - 1]
            assert first == before[0] + before[1] - overlap
            back += text[before[3] : end]
        else:
            back += text[begin:end]
        assert begin == (starts[first] if first else 0)
    assert back == text


def test_cut_prefers_better_boundaries():
    text = ("one two three. " * 3 + "\n\n") + "four five six seven. " * 10
    pieces = cut(text, 20, 2)
    assert text[: pieces[0][3]].endswith("\n\n")
    assert cut("a b c d e f g h i j k l " * 3, 10, 2)[0][1] == 10


def test_a_boundary_early_in_a_piece_comes_before_a_hard_cut():
    text = "one two three, " + ".a" * 60  # the only boundaries stand in the first tokens
    assert cut(text, 40, 2)[0][1] == 4 and text[: cut(text, 40, 2)[0][3]] == "one two three, "
    assert cut(text, 40, 4)[0][1] == 40  # a piece must go beyond its overlap


def test_hard_cut_without_boundaries():
    text = ".a" * 3000
    assert [p[1] for p in cut(text, 1024, 64)][:2] == [1024, 1024]


def test_split_texts(spark):
    rows = [(1, "w " * 3000), (2, None), (3, ""), (4, "w " * 1024), (5, "w " * 1025), (6, "a" * 200_000), (None, "w " * 1100)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, id string")
    got = split_texts(df).collect()
    assert {r["id"] for r in got} == {1, 5, None}
    assert max(r["n_tokens"] for r in got) <= 1024
    assert split_texts(df.limit(0)).count() == 0


# --- Leakage ---


def brute_leaks(docs, items, span=13):
    grams = lambda t: {tuple(w[i : i + span]) for w in [words(t)] for i in range(len(w) - span + 1)}
    return {(d, i) for d, t in docs for i, u in items if grams(t) & grams(u)}


def test_exact_leaks_are_those_of_brute_force(spark):
    rng = random.Random(8)
    vocab = ["the", "loop", "of", "zeldapin", "was", "12", "kda", "held", "F389D", "Ärger", "and", "percent", "rebuilt"]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(f"i{k}", line(rng.randint(5, 60))) for k in range(30)] + [("none", None), ("empty", ""), ("twin", None)]
    items[-1] = ("twin", items[0][1])
    docs = []
    for k in range(120):
        body = line(rng.randint(0, 200))
        if k % 3 == 0:
            w = (rng.choice(items[:30])[1]).split()
            a = rng.randrange(max(1, len(w) - 14))
            body += ".  " + ", ".join(w[a : a + rng.randint(12, 20)]).upper() + " " + line(10)
        docs.append((k, body))
    docs += [(500, None), (501, ""), (502, items[3][1] * 500)]
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, item string")
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id string, item_text string, id int")
    for most in (100_000, 0):  # items by broadcast, and by shuffle
        got = {(r["id"], r["item"]) for r in leaks(d, i, slots="same", broadcast_windows=most).collect()}
        assert got == brute_leaks(docs, items)
    assert {(r["id"], r["item"]) for r in leaks(d, i).where("kind = 'exact'").collect()} == got
    assert leaks(d.limit(0), i).count() == 0 and leaks(d, i.limit(0)).count() == 0


QUESTION = "given {a} copies of {n} per cell and a loss of {b} percent per hour how many hours until fewer than {c} copies of {n} remain in the dish"


def filler(n=300):
    return [(i, " ".join(sorted(QUESTION.split(), reverse=True)) + f" {i % 7} percent {i} copies") for i in range(n)]  # makes the plain words common


def test_reparameterised_questions_are_told_from_inconsistent_ones(spark):
    item = QUESTION.format(a=314, n="rulxixin", b=62, c=617)
    other = QUESTION.format(a=9, n="Kovacs", b=5, c=88)
    mixed = other[::-1].replace("Kovacs"[::-1], "Paderborn"[::-1], 1)[::-1]
    docs = [*filler(), (901, "x " + other), (902, mixed), (903, item), (904, "nothing of the kind " * 20), (905, None), (None, other)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([("q", item), ("none", None), (None, item)], "item_id string, item_text string")
    for most in (100_000, 0):
        got = {r["id"]: r for r in leaks(d, i, broadcast_windows=most).collect()}
        assert set(got) == {901, 902, 903, None}
        n = len(words(item)) - 12
        assert {k: r["kind"] for k, r in got.items()} == {901: "reworked", 902: "frame", 903: "exact", None: "reworked"}
        assert got[901]["exact_windows"] == 0 and got[901]["template_windows"] == n and got[901]["consistent"] and got[901]["item_share"] == 1
        assert got[902]["template_windows"] == n and not got[902]["consistent"]
        assert got[903]["exact_windows"] == n and got[903]["template_windows"] == 0


def test_words_are_typed_by_their_counts(spark):
    rng = random.Random(7)
    names = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(400)]
    texts = [(f"again we train the customer to begin with {names[k]} and {rng.randint(1, 99)} kelps of salt as Berta said; again the income of Berta grew by {k % 50} kelps",) for k in range(400)]
    items = [(f"again we say that the old and known {w} is held by {names[k]} until the sum will grow again to {k} kelps",) for k, w in enumerate(("customer", "income", "train"))]
    t = learn_typing(spark.createDataFrame(texts, "text string"), spark.createDataFrame(items, "text string"))
    assert all(t.kind(w) is None for w in ("again", "begin", "with", "the", "salt"))
    assert {t.kind(w) for w in names} == {3} and t.kind("berta") == 3 and t.kind("paris") == 3
    assert [t.kind(w) for w in ("kelps", "12", "f389d", "x2")] == [2, 0, 1, 1]
    assert {t.kind(w) for w in ("customer", "income", "train")} == {3}  # common, but fillers of one place of several items


def test_planted_reworked_items_are_found(spark):
    """Recall and precision of ``reworked`` on items planted with new numbers and names among plain documents."""
    rng = random.Random(12)
    plain = [f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    vocab = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(150)] + [w[4:] * 3 for w in plain]
    name = lambda: "".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(5))

    def frame():
        ws = [rng.choice(vocab) for _ in range(30)]
        for at in (4, 15, 24):
            ws[at] = "{n}"
        for at in (9, 20):
            ws[at] = "{a}"
        return " ".join(ws)

    frames = [frame() for _ in range(40)]
    fill = lambda f: f.format(n=name(), a=rng.randint(1, 999))
    items = [(f"i{k}", fill(f)) for k, f in enumerate(frames)]
    docs = [(k, " ".join(rng.choice(vocab) for _ in range(120))) for k in range(600)]
    planted = set()
    for k in range(100):
        f = rng.randrange(40)
        planted.add((k, f"i{f}"))
        docs[k] = (k, docs[k][1] + " " + fill(frames[f]) + " " + docs[k][1][:200])
    for k in range(100, 160):  # a third of an item only
        docs[k] = (k, docs[k][1] + " " + " ".join(fill(frames[k % 40]).split()[:16]))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, item_text string")
    found = {(r["id"], r["item"]) for r in leaks(d, i).where("kind = 'reworked'").collect()}
    assert len(found & planted) >= 0.95 * len(planted) and len(found & planted) >= 0.95 * len(found)


def test_exact_windows_rich_in_slots_take_nothing_from_the_templates(spark):
    rich = " ".join(f"{k} zeldapin {k + 50} percent" for k in range(4))  # 4 windows of 13 words, none with a literal
    q = " the loop of {n} between {a} and {b} was rebuilt by hand before the model scored it with care"
    item, doc = rich + q.format(n="zeldapin", a=4, b=9), rich + " but" + q.format(n="korgelin", a=5, b=8)
    plain = [(100 + k, "but the loop of a between was and rebuilt by hand before the model scored it with care") for k in range(300)]
    d = spark.createDataFrame([(1, doc), *plain], "doc_id long, text string")
    i = spark.createDataFrame([("q", item)], "item_id string, item_text string")
    (r,) = leaks(d, i).collect()
    n = len(words(q.format(n="korgelin", a=5, b=8)))
    assert (r["exact_windows"], r["template_windows"]) == (4, n - 12)


def test_tokens_are_those_of_the_pattern():
    assert re.findall(r"\w+|[^\w\s]+", "Größe: 3.5 µM…ok") == [m.group() for m in TOKEN.finditer("Größe: 3.5 µM…ok")]
    assert count_tokens(None) == 0 and words("Ab_c Ä1") == ["ab", "c", "ä1"]
