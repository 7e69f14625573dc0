"""Place observations: one row per observation, several per place id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.functions.core import brand_or_name_key, first_item_field, nested_text, text_key, wkb_point

COLUMNS = ("rid", "id", "lon", "lat", "category", "name_key", "locality")


def normalise_places(df: DataFrame, rid: str = "rid", payload: bool = True) -> DataFrame:
    """Any place table as (rid, id, lon, lat, category, name_key, locality [, every other column]).

    Geometry is a WKB point unless lon and lat exist; category, brand, name and locality may be nested, flat or missing.
    A missing one says nothing about a row: null category, empty keys. A nested brand without a primary name is none, so the
    row's name is its key."""
    have = set(df.columns)
    if {"lon", "lat"} <= have:
        lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
    else:
        lon, lat = wkb_point(F.col("geometry"))
    pick = lambda *paths: F.coalesce(*[nested_text(df.schema, p) for p in paths])
    if "addresses" in have and not isinstance(df.schema["addresses"].dataType.jsonValue(), str):
        locality = first_item_field(F.col("addresses"), "locality")
    else:
        locality = pick("locality")
    new = {"rid": F.col(rid), "id": F.col("id"), "lon": lon, "lat": lat, "category": pick("basic_category", "category"),
           "name_key": brand_or_name_key(pick("brand.names.primary"), pick("names.primary", "name")), "locality": text_key(locality)}
    kept = [c for c in df.columns if c not in new] if payload else []
    return df.select(*[v.alias(k) for k, v in new.items()], *kept)


def read_tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def surrogate_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place observations made from order lines: 2 to 5 rows of each part.

    Lines of a part that agree in order, supplier and number give the same rows in any order, so price and date, which SQL orders
    by last, do not travel; no part has more than 5 rows, which Spark keeps of each part before it deals lines out."""
    line, part, supplier, nation = read_tables(spark, sf_dir, "lineitem", "part", "supplier", "nation")
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_suppkey", "l_linenumber")
    kept = (line.select("l_partkey", "l_orderkey", "l_suppkey", "l_linenumber")
            .withColumn("k", F.row_number().over(order)).filter((F.col("k") <= 5) & (F.col("k") <= 2 + F.col("l_partkey") % 4)))
    d = lambda c: F.col(c).cast("double")
    lon = F.lit(-122.0) + (F.col("l_partkey") % 500).cast("double") * F.lit(0.0001) + (F.col("l_orderkey") % 7).cast("double") * F.lit(0.00001)
    lat = F.lit(37.0) + (F.col("l_partkey") % 40).cast("double") * F.lit(0.0001) + d("l_linenumber") * F.lit(0.00001)
    wide = (kept.join(part.select("p_partkey", "p_name", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
            .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(nation.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey")))
    return wide.select((F.col("l_partkey") * 10 + F.col("k")).alias("rid"), F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("provider"), F.col("p_name").alias("name"),
                       F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("n_name").alias("locality"), lon.alias("lon"), lat.alias("lat"))

