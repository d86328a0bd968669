"""Table-generating operators: mutant libraries, masks, and evolution by repeated masking."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bio, vectors
from ..session import staged
from .sampling import top_n


def saturation_mutants(df: DataFrame, id_column: str = "sequence_id", column: str = "sequence", alphabet: str = bio.AMINO_ACIDS, positions: Sequence[int] | None = None) -> DataFrame:
    """(id, sat_position, sat_wt_aa, sat_mut_aa, mutant): every single substitution at every (or the given) 0-based position."""
    c = F.col(column)
    places = F.transform(F.sequence(F.lit(0), F.length(c) - 1), lambda i: i)
    if positions is not None:
        places = F.filter(places, lambda i: i.isin(*[int(p) for p in positions]))
    at = df.where(F.length(c) > 0).select(F.col(id_column), c.alias("_s"), F.explode(places).alias("sat_position"))
    aa = F.explode(F.array(*[F.lit(a) for a in alphabet])).alias("sat_mut_aa")
    x = at.select(id_column, "_s", "sat_position", F.substring("_s", F.col("sat_position") + 1, F.lit(1)).alias("sat_wt_aa"), aa).where("sat_mut_aa <> sat_wt_aa")
    return x.select(id_column, F.col("sat_position").cast("long").alias("sat_position"), "sat_wt_aa", "sat_mut_aa", bio.mutate_at(F.col("_s"), F.col("sat_position"), F.col("sat_mut_aa")).alias("mutant"))


def saturation(df: DataFrame, scored: Callable[[DataFrame], DataFrame], top: int | None = 50, **options) -> DataFrame:
    """``saturation_mutants`` with ``score`` from ``scored``; null scores go, the best ``top`` (or all) stay, ties by position, residue and id."""
    s = scored(saturation_mutants(df, **options)).where("score is not null and not isnan(score)")
    order = [F.col("score").desc(), F.col("sat_position"), F.col("sat_mut_aa"), F.col(options.get("id_column", "sequence_id"))]
    return s.orderBy(*order).limit(top) if top is not None else s


def position_pairs(length: Column | int, targets: Sequence[int]) -> Column:
    """array<struct(p, q)>: each target position with each other position, 0-based."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.flatten(F.transform(F.array(*[F.lit(int(t)) for t in targets]), lambda p: F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda q: q != p), lambda q: F.struct(p.alias("p"), q.alias("q")))))


def two_point_mutants(singles: DataFrame, pairs_of: Sequence[int], second: Callable[[DataFrame], DataFrame], id_column: str = "sequence_id", column: str = "sequence") -> DataFrame:
    """(id, p, q, mutant): each target position with every other, both filled by ``second``; of equal mutants the first by (p, q).

    ``second`` gets rows (id, masked, p, q) and adds ``aa1`` and ``aa2``; a second residue equal to the wild type is kept.
    """
    x = singles.select(id_column, F.col(column).alias("_s"), F.explode(position_pairs(F.length(column), pairs_of)).alias("x")).select(id_column, "_s", "x.p", "x.q")
    x = second(x.withColumn("masked", bio.apply_mask("_s", F.array("p", "q"))))
    m = x.withColumn("mutant", bio.mutate_at(bio.mutate_at(F.col("_s"), F.col("p"), F.col("aa1")), F.col("q"), F.col("aa2")))
    return m.groupBy(id_column, "mutant").agg(F.min(F.struct("p", "q")).alias("o")).select(id_column, F.col("o.p").alias("p"), F.col("o.q").alias("q"), "mutant")


def single_fills(df: DataFrame, logits: str, alphabet: str, id_column: str = "sequence_id", column: str = "sequence", keep_synonymous: bool = False) -> DataFrame:
    """(id, position, wt, aa, mutant): each position filled by the symbol of the largest logit, of ties the first.

    ``logits`` is an array per position. If it has two rows more than the text, the first and last (marks of
    beginning and end) are left out.
    """
    c = F.col(column)
    rows = F.col(logits).cast("array<array<double>>")
    inner = F.when(F.size(rows) == F.length(c) + 2, F.slice(rows, 2, F.length(c))).otherwise(rows)
    x = df.select(id_column, c.alias("_s"), F.posexplode(inner).alias("position", "_l")).where(F.col("position") < F.length("_s"))
    x = x.select(id_column, "_s", F.col("position").cast("long").alias("position"), F.substring("_s", F.col("position") + 1, F.lit(1)).alias("wt"), vectors.argmax_symbol("_l", alphabet).alias("aa"))
    if not keep_synonymous:
        x = x.where("aa <> wt")
    return x.select(id_column, "position", "wt", "aa", bio.mutate_at(F.col("_s"), F.col("position").cast("int"), F.col("aa")).alias("mutant"))


def mask_positions(column: Column | str, strategy: str = "random", fraction: float = 0.15, conserved: Sequence[int] = (), explicit: Sequence[int] | None = None, confidences: Column | None = None, block: int = 3, seed: Column | int = 0) -> Column:
    """array<int> of 0-based positions to mask.

    explicit: the given ones within the text. Else max(1, int(length * fraction)) of those not conserved:
    random (in the order of a seeded hash), low_confidence (the least confident, ties by position; random
    without confidences), or blocks (runs of ``block`` from seeded starts). All conserved: empty.
    """
    s = F.col(column) if isinstance(column, str) else column
    n = F.length(s)
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    if explicit is not None:
        return F.filter(F.array(*[F.lit(int(p)) for p in explicit]).cast("array<int>"), lambda p: (p >= 0) & (p < n))
    free = F.filter(every, lambda p: ~p.isin(*[int(c) for c in conserved])) if conserved else every
    k = F.least(F.size(free), F.greatest(F.lit(1), F.floor(n * F.lit(fraction)).cast("int")))
    draw = F.lit(seed) if isinstance(seed, int) else seed

    def by(key: Callable[[Column], Column]) -> Column:
        return F.transform(F.array_sort(F.transform(free, lambda p: F.struct(key(p).alias("k"), p.alias("p")))), lambda x: x["p"])

    if strategy == "random" or (strategy == "low_confidence" and confidences is None):
        order = by(lambda p: F.xxhash64(s, p, draw))
    elif strategy == "low_confidence":
        order = by(lambda p: F.coalesce(F.get(confidences, p).cast("double"), F.lit(float("inf"))))
    elif strategy == "blocks":
        # Positions ordered by their block's start, the starts in a random order.
        order = F.transform(F.array_sort(F.transform(free, lambda p: F.struct(F.xxhash64(s, F.floor((p + F.pmod(F.xxhash64(s, draw), F.lit(block))) / block), draw).alias("k"), p.alias("p")))), lambda x: x["p"])
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return F.slice(order, 1, k)


Fill = Callable[[DataFrame], DataFrame]


def remask(df: DataFrame, fill: Fill, rounds: int = 1, column: str = "sequence", **mask) -> DataFrame:
    """Adds ``variant``, ``num_mutations`` and ``mutation_rate``: ``rounds`` times some positions are masked and filled.

    ``fill`` gets the columns ``variant``, ``masked`` and ``positions`` and gives ``variant`` anew. Each round
    is staged, so a scorer behind ``fill`` runs once.
    """
    x = df.withColumn("variant", F.col(column))
    for r in range(rounds):
        seed = F.xxhash64(F.lit(r), *[F.col(c) for c in ("_attempt",) if c in x.columns])
        x = x.withColumn("positions", mask_positions("variant", seed=seed, **mask))
        x = staged(fill(x.withColumn("masked", bio.apply_mask("variant", F.col("positions")))).drop("masked", "positions"), "remask")
    n = bio.mutation_count(column, "variant")
    return x.withColumn("num_mutations", n).withColumn("mutation_rate", F.when(F.length(column) > 0, n / F.length(column)).otherwise(0.0))


def variants(parents: DataFrame, fill: Fill, n: int, id_column: str = "sequence_id", column: str = "sequence", deduplicate: bool = True, rounds: int = 1, **mask) -> DataFrame:
    """(id, sequence, variant, num_mutations, mutation_rate): up to ``n`` distinct variants of each parent, none its equal.

    Attempts go on, only for parents that lack variants, until 3 * n per parent were made.
    """
    p = parents.select(id_column, column)
    have, made = None, 0
    while made < 3 * n:
        if have is None:
            lack = p.withColumn("_need", F.lit(n))
        else:
            got = have.groupBy(id_column).agg(F.count("*").alias("_n"))
            lack = p.join(got, id_column, "left").withColumn("_need", F.lit(n) - F.coalesce("_n", F.lit(0))).where("_need > 0").drop("_n")
            if lack.isEmpty():
                break
        tries = lack.withColumn("_attempt", F.explode(F.sequence(F.lit(made), F.lit(made) + F.col("_need") - 1))).drop("_need")
        new = remask(tries, fill, rounds, column, **mask)
        made += n
        if deduplicate:
            new = new.where(F.col("variant") != F.col(column))
            if have is not None:
                new = new.join(have.select(id_column, "variant"), [id_column, "variant"], "left_anti")
            from .sampling import ordered_first

            new = ordered_first(new, [id_column, "variant"], [F.col("_attempt")])
        cols = [id_column, column, "variant", "num_mutations", "mutation_rate", "_attempt"]
        new = new.select(*cols)
        have = staged(new if have is None else have.unionByName(new), "variants")
    from pyspark.sql.window import Window

    w = Window.partitionBy(id_column).orderBy("_attempt", "variant")
    return have.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn", "_attempt")


def refine(start: DataFrame, fill: Fill, fitness: Callable[[DataFrame], DataFrame], rounds: int = 10, population: int = 20, keep: int = 5, column: str = "sequence", **mask) -> DataFrame:
    """(sequence, fitness): evolution; each round gives every survivor population // survivors children and keeps the best ``keep`` of all.

    ``fitness`` adds a column ``fitness``. Each generation is staged, which cuts the lineage. Ties by text.
    """
    if keep >= population:
        raise ValueError("keep must be under population")
    pop = staged(fitness(start.select(column)).select(column, "fitness"), "population")
    for r in range(rounds):
        size = max(1, pop.count())
        parents = pop.select(F.xxhash64(column, F.lit(r)).alias("sequence_id"), column)
        kids = variants(parents, fill, max(1, population // size), column=column, **mask).select(F.col("variant").alias(column))
        both = pop.unionByName(fitness(kids).select(column, "fitness"))
        pop = staged(both.where("fitness is not null").orderBy(F.desc("fitness"), column).limit(keep), "population")
    return pop


def temperature_scan(df: DataFrame, temperatures: Sequence[float]) -> DataFrame:
    """Every row once per temperature."""
    return df.withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in temperatures])))


def generated_rows(df: DataFrame, samples: Column, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., sequence, log_prob): generated samples upper-cased, each text once (the first by best log_prob)."""
    x = df.select(*keep, F.explode(samples).alias("x")).select(*keep, F.upper("x.sequence").alias("sequence"), "x.log_prob")
    cols = [c for c in keep]
    return x.groupBy("sequence").agg(F.max(F.struct("log_prob", *cols)).alias("b")).select("sequence", "b.log_prob", *[f"b.{c}" for c in cols])


def cofold_items(df: DataFrame, entities: Sequence[dict], id_column: str = "sequence_id", column: str = "sequence") -> DataFrame:
    """(id, item): a JSON request of the sequence as chain A with the static entities after it."""
    first = F.struct(F.lit("A").alias("id"), F.lit("protein").alias("type"), F.col(column).alias("sequence"))
    rest = [F.struct(F.lit(e.get("id", chr(66 + i))).alias("id"), F.lit(e.get("type", "protein")).alias("type"), F.lit(e.get("sequence") or e.get("smiles") or e.get("ccd")).alias("sequence")) for i, e in enumerate(entities)]
    return df.select(id_column, F.to_json(F.struct(F.array(first, *rest).alias("molecules"))).alias("item"))


__all__ = ["cofold_items", "generated_rows", "mask_positions", "position_pairs", "refine", "remask", "saturation", "saturation_mutants", "single_fills", "temperature_scan", "top_n", "two_point_mutants", "variants"]
