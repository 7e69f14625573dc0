import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from pairloom.operators import candidates as C
from pairloom.operators import pairs as P
from pairloom.sources.places import normalise_places

PLACE = "rid long, id long, lon double, lat double, category string, name_key string, locality string"


@pytest.fixture(scope="module")
def places(spark):
    rows = []
    for k in range(100):
        for row in range(2):
            rows.append((10 * k + row, k, (k // 2) * 0.02 + (k % 2) * 4e-5, row * 1e-5, f"c{k % 3}" if k % 5 else None, f"n{k // 4}", "town" if k % 2 else ""))
    return spark.createDataFrame(rows, PLACE)


def test_geo_table_keeps_its_invariants(spark, places, tmp_path):
    s = P.Settings()
    pools = P.build_pools(places, s)
    table = P.geo_pairs(pools, 20)
    found = P.invariants(table, places, 20, s).first().asDict()
    assert not any(found.values()), found
    again = P.geo_pairs(pools, 20)
    key = lambda t: sorted((r.pair_id, r.left_rid, r.right_rid, r.pair_type) for r in t.collect())
    assert key(table) == key(again)
    got = P.write_pairs(table, places, str(tmp_path / "out"), 20, s)
    assert (got["pairs"], got["matches"], got["hard_geo"], got["hard_brand"], got["easy"], got["rows_used"]) == (20, 10, 2, 2, 6, 40)
    wide = spark.read.parquet(str(tmp_path / "out/pairs"))
    assert wide.columns[:5] == ["pair_id", "label", "pair_type", "hard_neg_source", "distance_m"] and wide.columns[5:9] == ["left_rid", "right_rid", "left_id", "right_id"]
    assert json.loads(spark.read.text(str(tmp_path / "out/stats")).first()[0])["pairs"] == 20
    assert P.review(table, source="geo").count() == 2 and P.review(table, "match").count() == 10 and P.review(table, "match", "geo").count() == 0
    assert set(P.all_sizes(pools, {"tiny": 4})) == {"tiny"}


def test_broken_tables_are_not_written(places, tmp_path):
    table = P.geo_pairs(P.build_pools(places), 20)
    with pytest.raises(AssertionError, match="wrong_count"):
        P.write_pairs(table.filter("pair_id > 0"), places, str(tmp_path / "out"), 20)


def test_shortfalls_name_what_is_missing(places):
    with pytest.raises(ValueError, match="of 150 matches"):
        P.geo_pairs(P.build_pools(places), 300)


def test_pools_take_all_rows_of_a_cell(spark):
    """4,050 rows at one spot; the only row of another place comes last by hash, so a cap on the cell's rows would lose it."""
    last = max(range(4_050), key=lambda k: hashlib.md5(f"0|{k}".encode()).hexdigest())
    rows = spark.range(4_050).select(F.col("id").alias("rid"), F.when(F.col("id") == last, 2).otherwise(1).cast("long").alias("id"), F.lit(2.0).alias("lon"), F.lit(48.0).alias("lat"),
                                     F.lit("c").alias("category"), F.lit("").alias("name_key"), F.lit("").alias("locality"))
    got = P.build_pools(rows).geo.collect()
    assert len(got) == 5 and all(last in (r.rid_a, r.rid_b) for r in got)


def test_pools_take_all_cells_and_names(spark):
    """60,200 cells of four places each, and as many names of four: five pairs of every one."""
    n, at = 60_200, F.floor(F.col("id") / 4)
    rows = spark.range(4 * n).select(F.col("id").alias("rid"), "id", (at % 200 * 0.003).alias("lon"), (F.floor(at / 200) * 0.003).alias("lat"), F.lit("c").alias("category"),
                                     F.concat_ws("/", F.floor(at / 4), F.col("id") % 4).alias("name_key"), F.lit("town").alias("locality"))
    pools = P.build_pools(rows)
    assert (pools.geo.count(), pools.brand.count()) == (5 * n, 5 * n)
    few = P.build_pools(rows.filter("rid < 160"), P.Settings(geo_pool=50, brand_pool=50))
    assert (few.geo.count(), few.brand.count()) == (50, 50)


def test_nested_sources_are_normalised(spark):
    schema = ("rid long, id string, geometry binary, basic_category string, names struct<primary:string>, brand struct<names:struct<primary:string>>, "
              "addresses array<struct<freeform:string,locality:string>>, phones string")
    point = bytearray(struct.pack("<BIdd", 1, 1, 1.5, -2.5))
    rows = [(1, "a", point, "cafe", ("Foo ",), None, [("x", " Rome")], "1"), (2, "a", point, None, ("Foo",), ((" ACME",),), [], None), (3, "b", None, None, None, None, None, None)]
    got = [tuple(r) for r in normalise_places(spark.createDataFrame(rows, schema)).orderBy("rid").select("rid", "id", "lon", "lat", "category", "name_key", "locality", "phones").collect()]
    assert got == [(1, "a", 1.5, -2.5, "cafe", "foo", "rome", "1"), (2, "a", 1.5, -2.5, None, "acme", "", None), (3, "b", None, None, None, "", "", None)]


def test_nested_brands_without_a_name_leave_the_key_to_the_place(spark):
    """A struct of nulls is no brand: places of different names share no key."""
    schema = "rid long, id string, lon double, lat double, names struct<primary:string,common:string>, brand struct<names:struct<primary:string>,wikidata:string>"
    rows = [(1, "a", 0.0, 0.0, ("Foo", None), ((None,), None)), (2, "b", 0.01, 0.0, ("Bar", None), ((None,), None)), (3, "c", 0.02, 0.0, ("Bar", "x"), (None, "Q1")),
            (4, "d", 0.03, 0.0, (None, "y"), None), (5, "e", 0.04, 0.0, (None, "y"), None), (6, "f", 0.05, 0.0, ("Baz", None), ((" ACME",), None)), (7, "g", 0.06, 0.0, ("acme", None), (("  ",), "Q2"))]
    places = normalise_places(spark.createDataFrame(rows, schema))
    assert dict(places.select("rid", "name_key").collect()) == {1: "foo", 2: "bar", 3: "bar", 4: "", 5: "", 6: "acme", 7: "acme"}
    assert sorted((r.rid_a, r.rid_b) for r in C.same_key_pairs(places, row_cap=None).collect()) == [(2, 3), (6, 7)]
    flat = normalise_places(spark.createDataFrame([(1, "a", 0.0, 0.0, "Foo", None), (2, "b", 0.0, 0.0, "Foo", "Acme ")], "rid long, id string, lon double, lat double, names string, brand string"))
    assert dict(flat.select("rid", "name_key").collect()) == {1: "foo", 2: "acme"}


def test_missing_columns_say_nothing(spark):
    got = normalise_places(spark.createDataFrame([(1, 2, 0.0, 0.0)], "rid long, id long, lon double, lat double")).first()
    assert (got.category, got.name_key, got.locality) == (None, "", "")


def test_a_place_with_one_row_stops_the_naive_builder(spark):
    with pytest.raises(ValueError, match="single row"):
        P.naive_pairs(spark.createDataFrame([(1, 1)], "rid long, id long"), 1)
