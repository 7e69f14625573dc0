import math
import struct

import pytest
from pyspark.sql import functions as F

from pairloom.functions import core


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {t}" for n, t in zip(names, ["string"] * len(names)))).select(column).first()[0]


@pytest.mark.parametrize("raw, want", [
    ("MATCH", "MATCH"), ("match.", "MATCH"), ('"NO_MATCH"', "NO_MATCH"), ("Answer: no match", "NO_MATCH"), ("`NO-MATCH`", "NO_MATCH"), ("Probably MATCH", "INVALID"),
    ("MATCH or NO_MATCH", "INVALID"), ('{"prediction":"MATCH"}', "INVALID"), ("YES", "INVALID"), ("", "INVALID"), (None, "INVALID"), ("NOMATCH", "NO_MATCH"), ("NO  MATCH", "INVALID"),
    ("NO MATCH", "NO_MATCH"), ("MATCH!.", "INVALID")])
def test_parse_label(spark, raw, want):
    assert one(spark, core.parse_label(F.col("x")), x=raw) == want


def test_parse_label_compat(spark):
    assert one(spark, core.parse_label(F.col("x"), True), x="NOMATCH") == "MATCH"


def test_wkb_points(spark):
    points = [(-0.0, 5e-324), (180.0, -180.0), (89.999, -89.999), (1.5, math.pi), (-122.4194155, 37.7749295)]
    rows = [(bytearray(struct.pack("<BIdd", 1, 1, *p)),) for p in points] + [(None,)]
    lon, lat = core.wkb_point(F.col("g"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "g binary").select(lon, lat).collect()]
    assert got == [*points, (None, None)]
    assert math.copysign(1, got[0][0]) == -1


@pytest.mark.parametrize("bad", [struct.pack(">BIdd", 0, 1, 1, 2), struct.pack("<BI", 1, 2) + bytes(16), b"\x01"])
def test_wkb_other_geometry_raises(spark, bad):
    with pytest.raises(Exception, match="WKB"):
        spark.createDataFrame([(bytearray(bad),)], "g binary").select(core.wkb_point(F.col("g"))[0]).collect()


def test_keys(spark):
    key = core.brand_or_name_key(F.col("b"), F.col("n"))
    for b, n, want in [(None, " Foo ", "foo"), ("  ", "Bar", "bar"), ("  ", None, ""), (" ACME", "x", "acme")]:
        assert one(spark, key, b=b, n=n) == want
    assert one(spark, core.row_name(F.col("x").cast("long")), x="7") == "row_000007"
    assert one(spark, core.row_name(F.col("x").cast("long")), x="12345678") == "row_12345678"
    assert one(spark, core.shortened(F.col("x")), x="a" * 71) == "a" * 69 + "…"


def test_locality_of_lists(spark):
    df = spark.createDataFrame([(1, []), (2, None), (3, [("A ",)]), (4, [(None,)])], "i int, a array<struct<locality:string>>")
    got = dict(df.select("i", core.text_key(core.first_item_field(F.col("a"), "locality"))).collect())
    assert got == {1: "", 2: "", 3: "a", 4: ""}
