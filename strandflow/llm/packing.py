"""Items packed into containers of fixed capacity by bin completion."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .tokens import token_count

CAPACITY = 2048
SHARD_ITEMS = 400
SHARDS_A_TASK = 8
NODES = 2000  # search nodes of a shard; None searches until the packing is proven best
WIDTH = 4  # fillings of a node that the first round branches over; each further round has 8 times as many
STEPS = 100  # steps to find each of them


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins of item numbers."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            left, b = capacity - sizes[i], len(bins) - 1
        else:
            left, b = room.pop(at)
            bins[b].append(i)
            left -= sizes[i]
        room.insert(bisect_left(room, (left, b)), (left, b))
    return bins


def fillings(room: int, sizes: list[int], counts: dict[int, int], width: int = WIDTH) -> tuple[list[list[int]], bool]:
    """Undominated fillings of ``room``, of items of the ascending distinct ``sizes`` with ``counts``, least waste first.

    A filling is dominated if an item left out still fits, or could take the place of a smaller one. The
    walk takes larger sizes first and ends after ``width * STEPS`` steps, or when ``width`` fillings leave no
    room; the second value says whether the list is complete.
    """
    found: list[tuple[int, list[int]]] = []
    left = width * STEPS
    exact = 0

    def walk(room: int, top: int, chosen: list[int]) -> None:
        nonlocal left, exact
        k = min(top, bisect_left(sizes, room + 1) - 1)
        any_fits = False
        while k >= 0 and left > 0 and exact < width:
            s = sizes[k]
            if counts[s] > 0:
                any_fits = True
                left -= 1
                counts[s] -= 1
                chosen.append(s)
                walk(room - s, k, chosen)
                chosen.pop()
                counts[s] += 1
            k -= 1
        if not any_fits and not dominated(room, chosen):
            found.append((room, chosen.copy()))
            exact += room == 0

    def dominated(room: int, chosen: list[int]) -> bool:
        for k in range(bisect_left(sizes, room + 1)):
            if counts[sizes[k]] > 0:
                return True
        for s in set(chosen):
            k = bisect_left(sizes, s + room + 1) - 1
            while k >= 0 and sizes[k] > s:
                if counts[sizes[k]] > 0:
                    return True
                k -= 1
        return False

    walk(room, len(sizes) - 1, [])
    found.sort(key=lambda f: f[0])
    return [f for _, f in found[:width]], left > 0 and exact < width and len(found) <= width


def pack(sizes: list[int], capacity: int = CAPACITY, nodes: int | None = NODES) -> list[list[int]]:
    """Bins of item numbers, each within capacity, by bin completion branch and bound.

    Each node takes the largest item left and branches over undominated fillings around it. The waste of
    the bins so far may not exceed what one bin fewer than the incumbent allows, or the branch is cut. The
    incumbent starts as best-fit decreasing and is then what the search found. Rounds branch over ever more
    fillings, until one had all of them at every node, and so has proven its packing best, or it meets the
    lower bound. ``nodes`` ends the search early with the best incumbent; it is the only limit, and None
    sets none. Sizes must be 1 to capacity.
    """
    if not sizes:
        return []
    bound = max(ceil(sum(sizes) / capacity), sum(2 * s > capacity for s in sizes))
    best = best_fit(sizes, capacity)
    width, left = WIDTH, nodes
    while len(best) > bound and (left is None or left > 0):
        best, left, whole = _search(sizes, capacity, best, bound, left, width)
        if whole:
            break
        width *= 8
    return best


def _search(sizes: list[int], capacity: int, best: list[list[int]], bound: int, left: int | None, width: int) -> tuple[list[list[int]], int | None, bool]:
    """(best packing, nodes left, was every undominated filling considered) of one round."""
    total = sum(sizes)
    by_size: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        by_size.setdefault(s, []).append(i)
    counts = {s: len(v) for s, v in by_size.items()}
    order = sorted(counts)
    best_sets: list[list[int]] | None = None
    limit, whole, waste = len(best), True, 0
    # An explicit stack: (options left, waste before); ``path`` has the option in use of each node but the last.
    path: list[list[int]] = []
    stack: list[tuple[Iterator[list[int]], int]] = []

    def open_node() -> Iterator[list[int]]:
        nonlocal whole
        big = next(s for s in reversed(order) if counts[s] > 0)
        counts[big] -= 1
        options, all_ = fillings(capacity - big, order, counts, width)
        whole &= all_
        counts[big] += 1
        return iter([[big, *f] for f in options])

    stack.append((open_node(), 0))
    while stack and limit > bound and left != 0:
        options, before = stack[-1]
        take = next(options, None)
        if len(path) == len(stack):  # undo the option in use
            for s in path.pop():
                counts[s] += 1
        if take is None:
            stack.pop()
            continue
        left = None if left is None else left - 1
        waste = before + capacity - sum(take)
        if waste > (limit - 1) * capacity - total:
            continue
        for s in take:
            counts[s] -= 1
        path.append(take)
        if not any(counts.values()):
            limit = len(path)
            best_sets = [p.copy() for p in path]
            continue
        stack.append((open_node(), waste))
    if best_sets is not None:
        pool = {s: v.copy() for s, v in by_size.items()}
        best = [[pool[s].pop() for s in p] for p in best_sets]
    return best, left, whole and not stack


def _packed(items: DataFrame, capacity: int, per_shard: int, tag: str, nodes: int | None) -> DataFrame:
    """items (id, copy, part, tokens) with the container of each and its fill, packed shard by shard."""
    shards = max(1, ceil(items.count() / per_shard))
    keyed = items.withColumn("shard", F.pmod(F.xxhash64("id", "copy", "part", F.lit(tag)), F.lit(shards)))
    id_type = items.schema["id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["tokens"].tolist()
        box, fill = [0] * len(sizes), [0] * len(sizes)
        for n, members in enumerate(pack(sizes, capacity, nodes)):
            used = sum(sizes[i] for i in members)
            for i in members:
                box[i], fill[i] = n, used
        shard = int(pdf["shard"].iloc[0])
        return pd.DataFrame({"id": pdf["id"], "copy": pdf["copy"], "part": pdf["part"], "tokens": pdf["tokens"], "container": [f"{tag}-{shard}-{n}" for n in box], "fill": fill})

    # A set number of partitions, as the adaptive planner would merge these few bytes into one slow task.
    keyed = keyed.repartition(max(1, ceil(shards / SHARDS_A_TASK)), "shard")
    return keyed.groupBy("shard").applyInPandas(run, f"id {id_type}, copy long, part long, tokens long, container string, fill long")


def pack_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, per_shard: int = SHARD_ITEMS, loose: float = 0.95, nodes: int | None = NODES) -> DataFrame:
    """(id, copy, part, tokens, container) for every row of texts: which container it goes to.

    Texts are measured where they are read and only their sizes move. A text above the capacity gives
    full containers (parts 0, 1, ...) and a rest that is packed like any other item; no other text is
    divided. Items are dealt by hash to shards of about ``per_shard``, each packed by bin completion in one
    task; containers filled under ``loose`` are then emptied and their items packed again together, so
    that shards leave no ragged ends.

    Every row is an item of its own: rows with the same id (or none) and equally many tokens are told
    apart by ``copy`` (0, 1, ...), and it doesn't matter which of them has which number. A text without
    tokens (null, blank) takes no room and gets container null. An empty table gives no rows.
    """
    sized = df.select(F.col(id_col).alias("id"), token_count(F.col(text_col)).alias("n")).groupBy("id", "n").agg(F.count("*").alias("copies"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    sized = staged(sized.select("id", copies, "n"), "sizes")
    full = sized.where(F.col("n") >= capacity).select("id", "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / capacity) - 1)).alias("part"), F.lit(capacity).cast("long").alias("tokens"), "n")
    full = full.select("id", "copy", "part", "tokens", F.concat_ws("-", F.lit("full"), F.coalesce(F.col("id").cast("string"), F.lit("null")), "n", "copy", "part").alias("container"))
    items = sized.select("id", "copy", F.floor(F.col("n") / capacity).cast("long").alias("part"), (F.col("n") % capacity).alias("tokens")).where("tokens > 0")
    one = staged(_packed(items, capacity, per_shard, "a", nodes), "packed")
    tight = F.col("fill") >= int(capacity * loose)
    cols = ["id", "copy", "part", "tokens", "container"]
    two = _packed(one.where(~tight).select(*cols[:-1]), capacity, 2 * per_shard, "b", nodes)
    empty = sized.where("n = 0").select("id", "copy", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("tokens"), F.lit(None).cast("string").alias("container"))
    return full.unionByName(one.where(tight).select(*cols)).unionByName(two.select(*cols)).unionByName(empty)
