import math
import random

from pyspark.sql import functions as F

from pairloom.operators import candidates as C
from pairloom.operators import matching as M
from pairloom.operators import pairs as P

SCHEMA = "rid long, id long, lon double, lat double, category string, locality string, name_key string"


def distance(a, b):
    h = math.sin(math.radians(b[3] - a[3]) / 2) ** 2 + math.cos(math.radians(a[3])) * math.cos(math.radians(b[3])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6_371_008.8 * math.asin(min(1, math.sqrt(h)))


def scattered(seed=3, n=60):
    r = random.Random(seed)
    rows = []
    for lon, lat in [(-122.4, 37.77), (-149.9, 61.2), (180.0, 10.0), (2.35, 48.85), (10.0, 89.9999), (-70.0, -89.9999)]:
        for _ in range(n):
            x = lon + r.uniform(-3e-4, 3e-4) / max(math.cos(math.radians(lat)), 1e-3)
            rows.append((len(rows), len(rows) // 2, (x + 180) % 360 - 180, max(-90.0, min(90.0, lat + r.uniform(-2e-4, 2e-4))), r.choice(["a", "b", None]), r.choice(["x", ""]), r.choice(["k", "l", ""])))
    return rows


def test_near_pairs_equal_brute_force(spark):
    rows = scattered()
    got = [(r.rid_a, r.rid_b) for r in C.near_pairs(spark.createDataFrame(rows, SCHEMA), 10.0).collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and distance(a, b) < 10}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_unknown_categories_are_never_equal(spark):
    rows = [(1, 1, 0.0, 0.0, None, "", "k"), (2, 2, 0.0, 0.0, None, "", "k")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.preferred for r in C.near_pairs(df).collect()] == [False]
    assert [r.preferred for r in C.same_key_pairs(df, min_m=0.0).collect()] == [False]


def test_closest_pair_ties_go_to_lower_rows(spark):
    rows = [(3, 1, 0.0, 0.0, "", "", ""), (1, 1, 0.0, 0.0, "", "", ""), (2, 1, 0.0, 0.0, "", "", ""), (9, 2, 0.0, 0.0, "", "", "")]
    assert [(r.id, r.rid_a, r.rid_b) for r in C.closest_pairs(spark.createDataFrame(rows, SCHEMA)).collect()] == [(1, 1, 2)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.near_pairs(df).count() == C.same_key_pairs(df).count() == C.closest_pairs(df).count() == 0
    assert M.greedy_matching(C.near_pairs(df), 3, 1).count() == 0


def test_greedy_matching_equals_the_walk(spark):
    import hashlib

    r = random.Random(5)
    edges = {tuple(sorted(r.sample(range(25), 2))) for _ in range(90)} | {(100, k) for k in range(101, 110)}
    rows = [(a, b, a, b, 1.0, r.random() < 0.4) for a, b in sorted(edges)]
    df = spark.createDataFrame(rows, "rid_a long, rid_b long, id_a long, id_b long, distance_m double, preferred boolean")
    order = sorted(rows, key=lambda x: (not x[5], hashlib.md5(f"s|{x[0]}|{x[1]}".encode()).hexdigest(), x[0], x[1]))
    used, walk = set(), []
    for x in order:
        if x[2] not in used and x[3] not in used:
            used |= {x[2], x[3]}
            walk.append((x[0], x[1]))
    assert {(x.rid_a, x.rid_b) for x in M.greedy_matching(df, None, "s").collect()} == set(walk)
    assert {(x.rid_a, x.rid_b) for x in M.greedy_matching(df, 4, "s").collect()} == set(walk[:4])


def test_budgets_round_halves_to_even():
    assert M.budgets(1_000) == {"match": 500, "geo": 100, "brand": 100, "easy": 300}
    assert M.budgets(5) == {"match": 2, "geo": 1, "brand": 0, "easy": 2}
    assert sum(M.budgets(1_005).values()) == 1_005


def test_densest_first_stops_before_a_unit(spark):
    df = spark.createDataFrame([(u, i) for u, n in (("a", 3), ("b", 2), ("c", 2)) for i in range(n)], "u string, i int")
    assert {r.u for r in C.densest_first(df, df, ["u"], 4).collect()} == {"a", "b"}


def test_naive_pairs(spark):
    df = spark.createDataFrame([(10 * i + k, i) for i in range(40) for k in range(2)], "rid long, id long")
    got = P.widen(P.naive_pairs(df, 11), df).orderBy("pair_id").collect()
    assert [r.pair_id for r in got] == list(range(11)) and sum(r.label for r in got) == 5
    assert all((r.left_id == r.right_id) == (r.label == 1) and r.left_rid != r.right_rid for r in got)


def test_easy_negatives_raise_when_short(spark):
    import pytest

    rows = [(i, i, 0.0, 0.0, "c", "", "") for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(M.Shortfall, match="lower min_m"):
        M.easy_negatives(df, df.select("id").limit(0), 2, rounds=1)


def test_greedy_matching_goes_beyond_the_first_candidates(spark):
    """A hub takes the first candidates: the pairs wanted are found among all of them."""
    rows = [(1, k, 1, k, 1.0, True) for k in range(2, 60)] + [(k, k + 1, k, k + 1, 1.0, False) for k in range(100, 120, 2)]
    df = spark.createDataFrame(rows, "rid_a long, rid_b long, id_a long, id_b long, distance_m double, preferred boolean")
    assert M.greedy_matching(df, 3, "s").count() == 3 and M.greedy_matching(df, 20, "s").count() == 11


def test_dense_cells_equal_brute_force(spark):
    """Cells far beyond a leaf: spread rows, rows at one spot, at the date line and near a pole."""
    rows = scattered(seed=4, n=90) + [(10_000 + k, 10_000 + k % 40, -122.4, 37.77, "a", "", "") for k in range(70)]
    r = random.Random(9)
    rows += [(20_000 + k, 20_000 + k, (180 + r.uniform(-4e-5, 4e-5) + 180) % 360 - 180, 10 + r.uniform(-4e-5, 4e-5), "b", "", "") for k in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and distance(a, b) < 10}
    for leaf in (3, 20, 2_000):
        got = [(x.rid_a, x.rid_b) for x in C.near_pairs(df, 10.0, leaf=leaf).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    cell = lambda leaf: sorted(map(tuple, C.near_pairs(df, 10.0, leaf=leaf).select("rid_a", "rid_b", "preferred", "band", "cx").collect()))
    assert cell(5) == cell(2_000)


def test_a_dense_cell_is_no_single_task(spark):
    """20,000 rows of one cell, joined on 64 partitions: no task sees much more of them than others."""
    df = spark.range(20_000).select(F.col("id").alias("rid"), "id", (F.col("id") % 141 * 7e-7 + 2.0).alias("lon"), (F.floor(F.col("id") / 141) * 7e-7 + 48.0).alias("lat"), F.lit("c").alias("category"))
    leaf = 500
    at = C.with_cell(df, 10.0)
    assert at.groupBy("band", "cx").count().agg(F.max("count")).first()[0] > 10 * leaf
    height = C.band_height(10.0)
    at = at.withColumns({"__u": C._across(F.col("lon"), C.cells_in_band(F.col("band"), height)), "__v": F.col("lat") / F.lit(height)})
    split, _, key = C._leaves(at, at.withColumn("__ks", F.array(F.floor("__u").cast("long"))), leaf)
    assert key[:4] == ["band", "cx", "sx", "sy"] and split.groupBy(*key).count().agg(F.max("count")).first()[0] <= 2 * leaf


def test_hot_names_equal_the_plain_join(spark):
    r = random.Random(6)
    rows = [(k, k % 170, r.uniform(-1, 1) * 0.4, r.uniform(-1, 1) * 0.4, None, r.choice(["x", "y", ""]), r.choice(["hot", "hot", "hot", "k", "l", ""])) for k in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = lambda t: sorted(map(repr, t.collect()))
    whole = C.same_key_pairs(df, row_cap=None, block=10**9)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and a[6] == b[6] != "" and 200 <= distance(a, b) <= 50_000}
    assert {(x.rid_a, x.rid_b) for x in whole.collect()} == want
    for block in (7, 50):
        assert plain(C.same_key_pairs(df, row_cap=None, block=block)) == plain(whole)
        assert plain(C.same_key_capped(df, 5, row_cap=None, pair_seed="p", block=block)) == plain(C.cap_pairs(whole, ["name_key"], 5, "p"))
    assert plain(C.same_key_capped(df, 3, row_cap=60, seed="s", pair_seed="p", block=16)) == plain(C.cap_pairs(C.same_key_pairs(df, row_cap=60, seed="s"), ["name_key"], 3, "p"))


def test_names_with_too_few_pairs_below_the_bound_are_ranked_whole(spark, monkeypatch):
    """Hashes that all lie above any bound: the counts tell, and nothing is lost."""
    r = random.Random(8)
    rows = [(k, k, r.uniform(-1, 1) * 0.2, r.uniform(-1, 1) * 0.2, None, r.choice(["x", "y"]), r.choice(["hot", "k"])) for k in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    high = lambda seed, *keys: F.concat(F.lit("ffffffff"), F.md5(F.concat_ws("|", *[k.cast("string") for k in keys]).cast("binary")))
    monkeypatch.setattr(C, "hash_order", high)
    want = C.cap_pairs(C.same_key_pairs(df, row_cap=None), ["name_key"], 5)
    assert sorted(map(repr, C.same_key_capped(df, 5, row_cap=None).select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_densest_first_over_many_units(spark):
    r = random.Random(7)
    units = [(f"u{k}", r.choice([1, 2, 2, 2, 3])) for k in range(400)]
    df = spark.createDataFrame([(u, i) for u, n in units for i in range(n)], "u string, i int").repartition(5)
    taken, found = set(), 0
    for u, n in sorted(units, key=lambda x: (-x[1], x[0])):
        if found >= 333:
            break
        taken.add(u)
        found += n
    assert {x.u for x in C.densest_first(df, df, ["u"], 333).collect()} == taken


def test_first_pairs_of_cells_equal_the_ranking_of_all(spark, monkeypatch):
    """Cells with many, few and no preferred pairs; bundles of several rows, spots of several bundles."""
    r = random.Random(11)
    rows = scattered(seed=12, n=80) + [(10_000 + k, 10_000 + k % 50, -122.4, 37.77, r.choice(["a", "b", None]), "", "") for k in range(90)]
    rows += [(20_000 + k, 20_000 + k, 2.0 + k % 5 * 1e-5, 48.0, f"c{k}", "", "") for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = lambda t: sorted(map(repr, t.collect()))
    monkeypatch.setattr(C, "BUNDLE", 16)
    monkeypatch.setattr(C, "FULL", 20)
    whole = C.near_pairs(df, leaf=10)
    assert {(x.rid_a, x.rid_b) for x in whole.collect()} == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and distance(a, b) < 10}
    want = plain(C.cap_pairs(whole, ["band", "cx"], 5, "p"))
    assert plain(C.near_capped(df, 5, pair_seed="p")) == want
    high = lambda seed, *keys: F.concat(F.lit("ffffffff"), F.md5(F.concat_ws("|", *[k.cast("string") for k in keys]).cast("binary")))
    monkeypatch.setattr(C, "hash_order", high)
    assert plain(C.near_capped(df, 5)) == plain(C.cap_pairs(whole, ["band", "cx"], 5))


def test_copies_of_a_row_do_not_grow_with_its_cell(spark):
    """12,000 rows in a cell, leaves of 8: a row is sent to its own few leaves, not to thousands."""
    df = spark.range(12_000).select(F.col("id").alias("rid"), "id", (F.col("id") % 7 * 1e-5 + 2.0).alias("lon"), (F.floor(F.col("id") / 7) % 7 * 1e-5 + 48.0).alias("lat"), F.lit("c").alias("category"))
    at, probe, _ = C._probed(C._bundled(df, 10.0, None, 0), 10.0, 8)
    size = lambda t: t.agg(F.sum("n")).first()[0]
    assert size(at) == 12_000 and size(probe) <= 12_000 * 49 * C.PARTS and at.count() <= 12_000 / 245 * 2


def test_rows_of_a_hot_name_travel_a_bounded_number_of_times(spark):
    df = spark.range(2_000).select(F.col("id").alias("rid"), "id", (F.col("id") * 1e-4).alias("lon"), F.lit(0.0).alias("lat"), F.lit("c").alias("category"), F.lit("x").alias("locality"), F.lit("k").alias("name_key"))
    pairs = C._blocked(df, 8)
    assert pairs.select("__i", "__j").distinct().count() <= C.BLOCKS * (C.BLOCKS + 1) / 2 and pairs.count() == 2_000 * 1_999 / 2


def test_first_pairs_of_packed_bundles_equal_the_ranking_of_all(spark, monkeypatch):
    """Hashes of pairs of bundles, whose row numbers have 1 to 19 digits, are looked at without a row for each pair."""
    monkeypatch.setattr(C, "SLACK", 1)
    monkeypatch.setattr(C, "PACKED", 0)
    r = random.Random(15)
    rids = sorted({r.randrange(10 ** r.randint(1, 18)) for _ in range(500)} | {9_223_372_036_854_775_807, -5})
    rows = [(k, i % 170, -122.4 + i % 3 * 1e-5, 37.77 + r.choice([0.0, 0.1]), r.choice(["a", "b", None]), r.choice(["x", "y", "", None]), r.choice(["hot", "hot", "k"])) for i, k in enumerate(rids)]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = []
    below = C.hashed.below
    monkeypatch.setattr(C.hashed, "below", lambda *a: asked.append(1) or below(*a))
    plain = lambda t: sorted(map(repr, t.collect()))
    assert plain(C.near_capped(df, 2, pair_seed="p")) == plain(C.cap_pairs(C.near_pairs(df), ["band", "cx"], 2, "p")) and asked
    asked.clear()
    named = C.same_key_pairs(df, row_cap=None)
    assert plain(C.same_key_capped(df, 2, row_cap=None, pair_seed="p", block=32)) == plain(C.cap_pairs(named, ["name_key"], 2, "p")) and asked


def test_hashes_of_pairs_equal_md5():
    import hashlib

    import numpy as np
    import pyarrow as pa
    from pairloom.operators import hashed

    r = random.Random(2)
    values = [r.randrange(10 ** r.randint(1, 18)) for _ in range(400)] + [-7, 0, 2**63 - 1]
    texts = hashed._Texts(pa.array(values, pa.int64()))
    work = np.empty((6, hashed.CHUNK), np.uint32)
    for seed in ("0", "cell", "a longer seed"):
        for size in texts.sizes:
            first = np.flatnonzero(texts.size == size)
            second = np.array([r.randrange(len(values)) for _ in first])
            got = hashed._hashes(seed.encode(), texts, size, first, second, work)
            want = [int(hashlib.md5(f"{seed}|{values[a]}|{values[b]}".encode()).hexdigest()[:8], 16) for a, b in zip(first, second)]
            fits = len(seed) + size + 2 + texts.sizes[-1] <= 55
            assert got.tolist() == (want if fits else [0] * len(want)) and fits


def test_rows_of_a_hot_name_travel_in_bundles(spark):
    """9,000 rows of a name go to 8 blocks as some hundred rows, not as 81,000."""
    df = spark.range(9_000).select(F.col("id").alias("rid"), "id", (F.col("id") * 1e-4).alias("lon"), F.lit(0.0).alias("lat"), F.lit("c").alias("category"), F.lit("x").alias("locality"), F.lit("k").alias("name_key"))
    bundles = C._name_bundles(df, 512)
    assert bundles.count() <= 100 and bundles.agg(F.sum("n")).first()[0] == 9_000 and bundles.agg(F.max("n")).first()[0] <= 2 * C.BUNDLE
