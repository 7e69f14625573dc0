"""Pair tables: naive and location-aware assembly, widening, invariants, statistics."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.core import coin, hash_order
from pairloom.operators import candidates as C
from pairloom.operators import matching as M
from pairloom.operators.lineage import cut
from pairloom.operators.order import first_by_hash, numbered_from_zero


@dataclass
class Settings:
    """Distances in metres, shares of negatives, caps of the candidate pools, seeds of pools and of draws.

    A pool has all cells and names, and cells all their rows, unless a caller caps them (geo_pool, brand_pool, cell_rows)."""

    match_m: float = 5.0
    geo_m: float = 10.0
    easy_m: float = 1_000.0
    brand_min_m: float = 200.0
    brand_max_m: float | None = 50_000.0
    hard: float = 0.4
    brand: float = 0.5
    geo_pool: int | None = None
    brand_pool: int | None = None
    cell_rows: int | None = None
    cell_pairs: int = 5
    group_rows: int | None = 500
    group_pairs: int = 5
    pool_seed: int = 0
    draw_seed: int = 42


@dataclass
class Pools:
    places: DataFrame
    match: DataFrame
    geo: DataFrame
    brand: DataFrame
    settings: Settings = field(default_factory=Settings)


def numbered(pairs: DataFrame, seed: int | str) -> DataFrame:
    """pair_id from 0 in hash order, sides swapped by a coin."""
    flip = coin(f"{seed}/side", F.col("rid_a"), F.col("rid_b"))
    left, right = F.when(flip, F.col("rid_b")).otherwise(F.col("rid_a")), F.when(flip, F.col("rid_a")).otherwise(F.col("rid_b"))
    rest = [c for c in pairs.columns if c not in ("rid_a", "rid_b", "id_a", "id_b")]
    placed = numbered_from_zero(pairs, [hash_order(f"{seed}/order", F.col("rid_a"), F.col("rid_b")), "rid_a", "rid_b"], "pair_id")
    return placed.select("pair_id", *rest, left.alias("left_rid"), right.alias("right_rid"))


def naive_pairs(places: DataFrame, n: int, seed: int | str = 42) -> DataFrame:
    """n pairs by id alone: n // 2 matches (two random rows of a place), the rest random rows of two places; every place once,
    places drawn uniformly. (pair_id, label byte, left_rid, right_rid)"""
    n_match, n_neg = n // 2, n - n // 2
    ids = places.select("id").groupBy("id").count()
    if ids.filter("count < 2").limit(1).count():
        raise ValueError("a place has a single row; every place needs two or more")
    wanted = n_match + 2 * n_neg
    ranked = M.require(first_by_hash(ids.select("id"), hash_order(seed, F.col("id")), "id", wanted), wanted, "places", "ask for fewer pairs")
    rows = M.random_row(places.select("id", "rid").join(ranked, "id"), seed, 2)
    matches = rows.filter(F.col("at") < n_match).groupBy("id").agg(F.min_by("rid", "rank").alias("rid_a"), F.max_by("rid", "rank").alias("rid_b")).select(F.lit(1).cast("byte").alias("label"), "rid_a", "rid_b")
    slot = F.floor((F.col("at") - n_match) / 2)
    others = rows.filter((F.col("at") >= n_match) & (F.col("rank") == 1)).groupBy(slot.alias("slot")).agg(F.min_by("rid", "at").alias("rid_a"), F.max_by("rid", "at").alias("rid_b")).select(F.lit(0).cast("byte").alias("label"), "rid_a", "rid_b")
    return numbered(matches.unionByName(others), seed)


def widen(pairs: DataFrame, source: DataFrame, rid: str = "rid") -> DataFrame:
    """left_<c>, right_<c> of every source column, next to each other in source order, after the pair's own columns. The
    source is read once: the rows that pairs name are kept, and both sides join them."""
    wanted = pairs.select(F.explode(F.array("left_rid", "right_rid")).alias("__w")).distinct()
    rows = cut(source.join(wanted, source[rid] == wanted["__w"], "left_semi"))
    out = pairs
    for side in ("left", "right"):
        out = out.join(rows.select(F.col(rid).alias(f"{side}_rid"), *[F.col(c).alias(f"{side}_{c}") for c in source.columns if c != rid]), f"{side}_rid")
    own = [c for c in pairs.columns if c not in ("left_rid", "right_rid")]
    return out.select(*own, *[f"{side}_{c}" for c in source.columns for side in ("left", "right")])


def build_pools(places: DataFrame, s: Settings | None = None) -> Pools:
    """Candidate pools, computed once and shared by draws of all sizes."""
    s = s or Settings()
    match = C.closest_pairs(places, s.match_m)
    near = C.near_capped(places, s.cell_pairs, s.geo_m, s.cell_rows, s.pool_seed, s.pool_seed)
    geo = near if s.geo_pool is None else C.densest_first(near, C.with_cell(places, s.geo_m), ["band", "cx"], s.geo_pool)
    named = C.same_key_capped(places, s.group_pairs, s.brand_min_m, s.brand_max_m, s.group_rows, s.pool_seed, s.pool_seed)
    brand = named if s.brand_pool is None else C.densest_first(named, places.filter("name_key <> ''"), ["name_key"], s.brand_pool)
    keep = ("rid_a", "rid_b", "id_a", "id_b", "distance_m", "preferred")
    return Pools(places, cut(match), cut(geo.select(*keep)), cut(brand.select(*keep)), s)


def geo_pairs(pools: Pools, n: int, seed: int | str | None = None) -> DataFrame:
    """n location-aware pairs, every place used once: matches, then near ones, same-name ones and far ones.
    (pair_id, label, pair_type, hard_neg_source, distance_m, preferred, left_rid, right_rid)"""
    s = pools.settings
    seed = s.draw_seed if seed is None else seed
    want = M.budgets(n, s.hard, s.brand)
    match = M.require(cut(M.match_draw(pools.match, want["match"], seed)), want["match"], "matches", "raise match_m or ask for fewer pairs")
    used = match.select("id")
    parts = [match.select(F.lit(1).alias("label"), F.lit("match").alias("pair_type"), F.lit("").alias("hard_neg_source"), "distance_m", F.lit(True).alias("preferred"), "rid_a", "rid_b")]
    for name, pool, cap in (("geo", pools.geo, "cell_pairs"), ("brand", pools.brand, "group_pairs")):
        got = cut(M.greedy_matching(M.without_used(pool, used), want[name], f"{seed}/{name}"))
        M.require(got, want[name], f"{name} negatives", f"raise {cap} or {name}_pool, or ask for fewer pairs")
        used = cut(used.union(M.places_of(got)))
        parts.append(got.select(F.lit(0).alias("label"), F.lit("hard_negative").alias("pair_type"), F.lit(name).alias("hard_neg_source"), "distance_m", "preferred", "rid_a", "rid_b"))
    easy = M.easy_negatives(pools.places, used, want["easy"], s.easy_m, f"{seed}/easy")
    parts.append(easy.select(F.lit(0).alias("label"), F.lit("easy_negative").alias("pair_type"), F.lit("").alias("hard_neg_source"), "distance_m", "preferred", "rid_a", "rid_b"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return numbered(out.withColumn("label", F.col("label").cast("byte")), seed)


def all_sizes(pools: Pools, sizes: dict[str, int] = M.SIZES) -> dict[str, DataFrame]:
    """Independent draws of every size over the same pools."""
    return {k: geo_pairs(pools, n, pools.settings.draw_seed + M.SEED_STEP.get(k, 0)) for k, n in sizes.items()}


def invariants(pairs: DataFrame, places: DataFrame, n: int, s: Settings | None = None) -> DataFrame:
    """One row of violation counts, all of them 0 for a right table."""
    s = s or Settings()
    want = M.budgets(n, s.hard, s.brand)
    ids = places.select("rid", "id")
    wide = pairs.join(ids.select(F.col("rid").alias("left_rid"), F.col("id").alias("left_id")), "left_rid").join(ids.select(F.col("rid").alias("right_rid"), F.col("id").alias("right_id")), "right_rid")
    of = lambda name: F.col("pair_type") == name
    bad = {
        "wrong_count": F.abs(F.count("*") - n), "wrong_matches": F.abs(F.count_if(of("match")) - want["match"]),
        "wrong_geo": F.abs(F.count_if(F.col("hard_neg_source") == "geo") - want["geo"]), "wrong_brand": F.abs(F.count_if(F.col("hard_neg_source") == "brand") - want["brand"]),
        "wrong_easy": F.abs(F.count_if(of("easy_negative")) - want["easy"]), "match_of_two_ids": F.count_if(of("match") & (F.col("left_id") != F.col("right_id"))),
        "negative_of_one_id": F.count_if((F.col("label") == 0) & (F.col("left_id") == F.col("right_id"))), "label_against_type": F.count_if((F.col("label") == 1) != of("match")),
        "source_against_type": F.count_if((F.col("hard_neg_source") != "") != of("hard_negative")), "match_too_far": F.count_if(of("match") & (F.col("distance_m") >= s.match_m)),
        "geo_too_far": F.count_if((F.col("hard_neg_source") == "geo") & (F.col("distance_m") >= s.geo_m)), "brand_too_near": F.count_if((F.col("hard_neg_source") == "brand") & (F.col("distance_m") < s.brand_min_m)),
        "brand_too_far": F.count_if((F.col("hard_neg_source") == "brand") & (F.col("distance_m") > F.lit(s.brand_max_m if s.brand_max_m is not None else 1e12))), "easy_too_near": F.count_if(of("easy_negative") & (F.col("distance_m") < s.easy_m)),
        "same_row_twice": F.count_if(F.col("left_rid") == F.col("right_rid")), "pair_id_gaps": F.abs(F.max("pair_id") - F.min("pair_id") + 1 - F.count_distinct("pair_id")),
    }
    rows = pairs.select(F.explode(F.array("left_rid", "right_rid")).alias("r")).agg((F.count("*") - F.count_distinct("r")).alias("rows_used_twice"))
    checked = wide.agg(*[v.cast("long").alias(k) for k, v in bad.items()])
    return checked.withColumn("k", F.lit(1)).join(rows.withColumn("k", F.lit(1)), "k").drop("k")


def stats(pairs: DataFrame, s: Settings | None = None) -> DataFrame:
    """One row of counts and parameters of a pair table."""
    s = s or Settings()
    hard = lambda k: F.count_if(F.col("hard_neg_source") == k)
    return pairs.agg(
        F.count("*").alias("pairs"), F.count_if(F.col("label") == 1).alias("matches"), F.count_if(F.col("label") == 0).alias("non_matches"),
        hard("geo").alias("hard_geo"), F.count_if((F.col("hard_neg_source") == "geo") & F.col("preferred")).alias("hard_geo_same_category"),
        hard("brand").alias("hard_brand"), F.count_if((F.col("hard_neg_source") == "brand") & F.col("preferred")).alias("hard_brand_same_locality"),
        F.count_if(F.col("pair_type") == "easy_negative").alias("easy"), (F.count("*") * 2).alias("rows_used"),
        F.lit(s.match_m).alias("match_m"), F.lit(s.geo_m).alias("geo_m"), F.lit(s.easy_m).alias("easy_m"), F.lit(s.brand_min_m).alias("brand_min_m"),
        F.lit(s.brand_max_m).cast("double").alias("brand_max_m"), F.lit(s.hard).alias("hard_fraction"), F.lit(s.brand).alias("brand_fraction"), F.lit(s.draw_seed).alias("seed"))


def naive_invariants(pairs: DataFrame, places: DataFrame, n: int) -> DataFrame:
    """One row of violation counts of a naive table, all of them 0 for a right one."""
    ids = places.select("rid", "id")
    wide = pairs.join(ids.select(F.col("rid").alias("left_rid"), F.col("id").alias("left_id")), "left_rid").join(ids.select(F.col("rid").alias("right_rid"), F.col("id").alias("right_id")), "right_rid")
    places_of_pairs = wide.select(F.explode(F.when(F.col("label") == 1, F.array("left_id")).otherwise(F.array("left_id", "right_id"))).alias("p")).agg((F.count("*") - F.count_distinct("p")).alias("places_used_twice"))
    rows = pairs.select(F.explode(F.array("left_rid", "right_rid")).alias("r")).agg((F.count("*") - F.count_distinct("r")).alias("rows_used_twice"))
    checked = wide.agg(F.abs(F.count("*") - n).alias("wrong_count"), F.abs(F.count_if(F.col("label") == 1) - n // 2).alias("wrong_matches"),
                       F.count_if((F.col("label") == 1) != (F.col("left_id") == F.col("right_id"))).alias("label_against_ids"))
    return checked.crossJoin(rows).crossJoin(places_of_pairs)


def write_naive(pairs: DataFrame, places: DataFrame, path: str, n: int) -> dict:
    """Check, widen and write a naive pair table and its statistics; returns them. Raises if an invariant does not hold."""
    began = time.time()
    pairs = cut(pairs)
    broken = {k: v for k, v in naive_invariants(pairs, places, n).first().asDict().items() if v}
    if broken:
        raise AssertionError(f"pair table breaks {broken}")
    widen(pairs, places).orderBy("pair_id").write.mode("overwrite").parquet(f"{path}/pairs")
    out = pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col("label") == 1).alias("matches"), F.count_if(F.col("label") == 0).alias("non_matches"), (F.count("*") * 2).alias("rows_used")).first().asDict()
    out["seconds"] = round(time.time() - began, 1)
    pairs.sparkSession.createDataFrame([(json.dumps(out),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/stats")
    return out


def write_pairs(pairs: DataFrame, places: DataFrame, path: str, n: int, s: Settings | None = None, source: DataFrame | None = None) -> dict:
    """Check, widen and write a pair table and its statistics; returns them. Raises if an invariant does not hold. The table
    has the columns of source(rid, ...), or of places unless given."""
    began = time.time()
    pairs = cut(pairs)
    broken = {k: v for k, v in invariants(pairs, places, n, s).first().asDict().items() if v}
    if broken:
        raise AssertionError(f"pair table breaks {broken}")
    widen(pairs.drop("preferred"), places if source is None else source).orderBy("pair_id").write.mode("overwrite").parquet(f"{path}/pairs")
    out = stats(pairs, s).first().asDict() | {"seconds": round(time.time() - began, 1)}
    spark: SparkSession = pairs.sparkSession
    spark.createDataFrame([(json.dumps(out),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/stats")
    return out


def review(pairs: DataFrame, pair_type: str | None = None, source: str | None = None) -> DataFrame:
    """Pairs of a type, of a source of hard negatives (which implies that type), or both."""
    if source is not None and pair_type is None:
        pair_type = "hard_negative"
    if pair_type is not None:
        pairs = pairs.filter(F.col("pair_type") == pair_type)
    return pairs if source is None else pairs.filter(F.col("hard_neg_source") == source)
