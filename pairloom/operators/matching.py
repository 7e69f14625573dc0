"""Choosing pairs: budgets, hash draws, one-use matching, random far pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.core import hash_order, haversine_m
from pairloom.operators.lineage import cut
from pairloom.operators.order import first_by_hash

#: Pairs of each tier, and what its seed adds.
SIZES = {"micro": 1_000, "mini": 3_000, "small": 10_000, "medium": 50_000}
SEED_STEP = {"micro": 0, "mini": 1, "small": 2, "medium": 3}


def budgets(n_pairs: int, hard: float = 0.4, brand: float = 0.5) -> dict[str, int]:
    """Pairs of each class; halves round to even, near and easy ones take what is left."""
    negatives = n_pairs - n_pairs // 2
    n_hard = round(negatives * hard)
    n_brand = round(n_hard * brand)
    return {"match": n_pairs // 2, "geo": n_hard - n_brand, "brand": n_brand, "easy": negatives - n_hard}


def budget_columns(n_pairs: Column, hard: float = 0.4, brand: float = 0.5) -> dict[str, Column]:
    """budgets() of a column of pair numbers."""
    negatives = n_pairs - F.floor(n_pairs / 2)
    n_hard = F.bround(negatives * F.lit(hard)).cast("long")
    n_brand = F.bround(n_hard * F.lit(brand)).cast("long")
    return {"match": F.floor(n_pairs / 2), "geo": n_hard - n_brand, "brand": n_brand, "easy": negatives - n_hard}


class Shortfall(ValueError):
    """Fewer pairs than asked for."""


def require(df: DataFrame, k: int, what: str, hint: str) -> DataFrame:
    n = df.count()
    if n < k:
        raise Shortfall(f"only {n} of {k} {what}; {hint}")
    return df


def match_draw(closest: DataFrame, k: int, seed: int | str) -> DataFrame:
    """k places of the verified ones in hash order."""
    return closest.orderBy(hash_order(seed, F.col("id")), "id").limit(k)


def without_used(pairs: DataFrame, used: DataFrame) -> DataFrame:
    """Pairs neither place of which is in used(id)."""
    for side in ("id_a", "id_b"):
        pairs = pairs.join(used.select(F.col("id").alias(side)), side, "left_anti")
    return pairs


def places_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()


#: Candidates looked at first for each pair wanted.
AHEAD = 8


def greedy_matching(candidates: DataFrame, k: int | None, seed: int | str) -> DataFrame:
    """The pairs that a walk over candidates in order (preferred first, then hash) accepts when each place is used once; the
    first k of them.

    What the walk accepts depends on earlier candidates only, so the first AHEAD * k are walked first, and all of them only
    where those fall short of k."""
    key = F.struct((~F.col("preferred")).alias("p"), hash_order(seed, F.col("rid_a"), F.col("rid_b")).alias("h"), F.col("rid_a").alias("a"), F.col("rid_b").alias("b"))
    keyed = candidates.withColumn("__key", key)
    if k is None:
        return _walked(cut(keyed)).drop("__key")
    first = cut(keyed.orderBy("__key").limit(AHEAD * k))
    won = _walked(first)
    if won.count() < k and first.count() == AHEAD * k:
        won = _walked(cut(keyed))
    return won.orderBy("__key").limit(k).drop("__key")


def _walked(left: DataFrame) -> DataFrame:
    """All pairs that the walk accepts. Per round a pair wins if it comes first at both its places; winners go out, pairs at
    their places are dropped. The union is exactly the sequential walk's result, and rounds grow with the logarithm of the
    pairs."""
    won: DataFrame | None = None
    while not left.isEmpty():
        ends = left.select(F.explode(F.array("id_a", "id_b")).alias("id"), "__key").groupBy("id").agg(F.min("__key").alias("first"))
        best = left
        for side in ("id_a", "id_b"):
            best = best.join(ends.select(F.col("id").alias(side), F.col("first").alias(f"__{side}")), side)
        winners = cut(best.filter((F.col("__key") == F.col("__id_a")) & (F.col("__key") == F.col("__id_b"))).select(left.columns))
        won = winners if won is None else won.unionByName(winners)
        left = cut(without_used(left, places_of(winners)))
    return left if won is None else won


def random_row(places: DataFrame, seed: int | str, k: int = 1) -> DataFrame:
    """The first k rows of each place in hash order, with their rank."""
    order = Window.partitionBy("id").orderBy(hash_order(seed, F.col("rid")), "rid")
    return places.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def paired(ids: DataFrame, n: int, seed: int | str) -> DataFrame:
    """n ids in hash order, paired as neighbours: (pair, id_a, id_b)."""
    ranked = first_by_hash(ids, hash_order(seed, F.col("id")), "id", n)
    return ranked.groupBy(F.floor(F.col("at") / 2).cast("long").alias("pair")).agg(
        F.min_by("id", "at").alias("id_a"), F.max_by("id", "at").alias("id_b"), F.count("*").alias("n")).filter("n = 2").drop("n")


def far_round(places: DataFrame, unused: DataFrame, n: int, min_m: float, seed: int | str) -> DataFrame:
    """One round of easy negatives: n unused places paired at random, a random row each; those at least min_m apart, preferred
    where categories differ (null and null do not). (rid_a, rid_b, id_a, id_b, distance_m, preferred)"""
    pairs = paired(unused, n, seed)
    rows = random_row(places.join(pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")), "id", "left_semi"), seed)
    for s in ("a", "b"):
        pairs = pairs.join(rows.select(F.col("id").alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("rid", "lon", "lat", "category")]), f"id_{s}")
    far = pairs.withColumn("distance_m", haversine_m(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b"))).filter(F.col("distance_m") >= min_m)
    return far.select("rid_a", "rid_b", "id_a", "id_b", "distance_m", (~F.col("category_a").eqNullSafe(F.col("category_b"))).alias("preferred"))


def easy_negatives(places: DataFrame, used: DataFrame, k: int, min_m: float = 1_000.0, seed: int | str = 42, rounds: int = 20) -> DataFrame:
    """k far pairs of places used once: up to `rounds` rounds with different categories, then as many by distance only."""
    ids = places.select("id").distinct().join(used.select("id"), "id", "left_anti")
    taken: DataFrame | None = None
    have = 0
    for r in range(2 * rounds):
        unused = ids if taken is None else ids.join(places_of(taken), "id", "left_anti")
        got = far_round(places, unused, 8 * (k - have), min_m, f"{seed}/{r}")
        if r < rounds:
            got = got.filter("preferred")
        got = cut(got.orderBy(hash_order(seed, F.col("rid_a"), F.col("rid_b")), "rid_a").limit(k - have))
        n = got.count()
        if n:
            taken = got if taken is None else taken.unionByName(got)
        have += n
        if have >= k or (n == 0 and r >= rounds):
            break
    if have < k:
        raise Shortfall(f"only {have} of {k} easy negatives; lower min_m or ask for fewer pairs")
    return taken if taken is not None else far_round(places, ids, 0, min_m, seed)
