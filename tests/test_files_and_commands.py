"""Fetching rows of files, hashing large ones, cards of pairs, commands."""

import hashlib
import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from pairloom.__main__ import main
from pairloom.functions import core
from pairloom.operators import matching as M
from pairloom.operators import review
from pairloom.sources import files


def scan_metrics(df):
    """Rows that the file scans of an executed plan gave out, and files they read."""
    df.collect()
    text = []

    def walk(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            return walk(node.plan())
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            m = node.metrics()
            text.append((m.apply("numOutputRows").value(), m.apply("numFiles").value()))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return text


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("fetch") / "t")
    df = spark.range(40_000).select(F.col("id").alias("key"), F.md5(F.col("id").cast("string").cast("binary")).alias("text"))
    df.repartitionByRange(4, "key").sortWithinPartitions("key").write.option("parquet.block.size", 64 << 10).option("parquet.page.size", 4 << 10).parquet(at)
    return at


def test_fetch_reads_what_may_be_wanted(spark, table):
    wanted = spark.createDataFrame([(k,) for k in (5, 6, 7, 20_001, 20_003, 39_999, 77_777)], "key long")
    got = files.fetch(spark, table, wanted, "key")
    assert sorted(r.key for r in got.collect()) == [5, 6, 7, 20_001, 20_003, 39_999] and got.columns == ["key", "text"]
    read = max(rows for rows, _ in scan_metrics(got))
    assert read < 20_000
    every = spark.read.parquet(table).join(wanted, "key", "left_semi")
    assert max(rows for rows, _ in scan_metrics(every)) == 40_000
    assert files.fetch(spark, table, wanted.limit(0), "key").count() == 0


def test_numbering_and_alignment_move_no_file_to_one_task(spark, table):
    """Without automatic broadcasts too, no row goes to the task of its file to be numbered."""
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = files.with_row_index(spark, table)
        assert "SortMergeJoin" not in index._jdf.queryExecution().executedPlan().toString()
        assert files.alignment(index, table, ["key"], 20).filter("same and key = key_again").count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)


def test_fetch_rows_reads_their_files_only(spark, table):
    index = files.with_row_index(spark, table)
    wanted = spark.createDataFrame([(k,) for k in (3, 9_000, 9_001, 3, 50_000)], "row_index long")
    got = files.fetch_rows(spark, table, wanted)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, index.filter(F.col("row_index").isin(3, 9_000, 9_001)).collect()))
    assert max(n for _, n in scan_metrics(got)) == 1
    assert files.fetch_rows(spark, table, wanted.limit(0)).count() == 0


def test_large_files_are_hashed_in_pieces(spark, tmp_path):
    (tmp_path / "small").write_bytes(b"abc")
    with open(tmp_path / "large", "wb") as f:  # sparse: over what an array can hold
        f.truncate((2 << 30) + 12_345)
    want = hashlib.sha256()
    for _ in range(2 << 5):
        want.update(bytes(32 << 20))
    want.update(bytes(12_345))
    got = {r.path.rpartition("/")[2]: (r.length, r.sha256) for r in files.file_hashes(spark, str(tmp_path)).collect()}
    assert got == {"small": (3, hashlib.sha256(b"abc").hexdigest()), "large": ((2 << 30) + 12_345, want.hexdigest())}
    few = {r.path.rpartition("/")[2]: r.sha256 for r in files.file_hashes(spark, str(tmp_path / "small"), whole=1).collect()}
    assert few == {"small": hashlib.sha256(b"abc").hexdigest()}


def test_points_are_written_as_they_are_read(spark):
    values = [0.0, 1.5, -2.5, 180.0, -122.4194155, 1e-300, -5e-324, 2.0**-1022, 1.7976931348623157e308, 0.1, 1 / 3, math.pi, 1023.9999999999999, 2.0**52 + 1]
    df = spark.createDataFrame([(x, y) for x in values for y in values[:4]], "x double, y double")
    lon, lat = core.wkb_point(core.point_wkb(F.col("x"), F.col("y")))
    for r in df.select("x", "y", core.point_wkb(F.col("x"), F.col("y")).alias("w"), lon.alias("lon"), lat.alias("lat")).collect():
        assert bytes(r.w) == struct.pack("<BIdd", 1, 1, r.x, r.y) and (r.lon, r.lat) == (r.x, r.y)


def test_budget_columns_are_budgets(spark):
    df = spark.range(1, 2_000).withColumnRenamed("id", "n")
    got = df.select("n", *[v.alias(k) for k, v in M.budget_columns(F.col("n")).items()]).collect()
    assert all(M.budgets(r.n) == {k: r[k] for k in ("match", "geo", "brand", "easy")} for r in got)


def test_cards(spark):
    wide = spark.createDataFrame([(0, 1, "match", "", 1.25, ("Foo",), ("Bar",), None, "x" * 90), (1, 0, "hard_negative", "geo", 7.0, ("A",), None, "t", "u")],
                                 "pair_id long, label int, pair_type string, hard_neg_source string, distance_m double, left_names struct<primary:string>, right_names struct<primary:string>, left_town string, right_town string")
    first = review.cards(wide, 1).first().card.split("\n")
    assert first[0] == "pair 0  label 1  pair_type match  hard_neg_source -  distance_m 1.2 m" or first[0].endswith("1.3 m")
    assert first[1].split() == ["names", "Foo", "|", "Bar"] and first[2].split()[:3] == ["town", "-", "|"] and first[2].endswith("…")
    plain = wide.select("pair_id", "label", "left_town", "right_town")  # naive tables have no types
    assert "label 0" in review.shown(plain, 5) and review.shown(plain, 5, columns=["nothing"]).endswith("  1: 1")
    assert {r.pair_id for r in review.cards(wide, 2, seed=3).collect()} == {0, 1} and review.cards(wide.limit(0)).count() == 0


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("places") / "source")
    rows = [(k, f"p{k}", (k // 2) * 0.02 + (k % 2) * 4e-5, row * 1e-5, f"c{k % 3}", (f"n{k // 4}",)) for k in range(2_400) for row in range(2)]
    spark.createDataFrame(rows, "n long, id string, lon double, lat double, basic_category string, names struct<primary:string>").repartition(3, "n").write.parquet(at)
    return at


def test_commands_build_and_show(spark, source, tmp_path, capsys):
    out = str(tmp_path / "naive")
    main(["naive", "--source", source, "--out", out], spark)
    table = spark.read.parquet(f"{out}/micro/pairs")
    assert table.count() == 1_000 and {"left_names", "right_names", "label"} <= set(table.columns)
    assert json.loads(spark.read.text(f"{out}/micro/stats").first()[0])["matches"] == 500
    out = str(tmp_path / "geo")
    main(["geo", "--source", source, "--out", out, "--seed", "7"], spark)
    table = spark.read.parquet(f"{out}/micro/pairs")
    assert table.groupBy("pair_type").count().count() == 3 and "left_basic_category" in table.columns
    capsys.readouterr()
    main(["view", "--file", f"{out}/micro/pairs", "-n", "2", "--neg-source", "geo", "--columns", "names"], spark)
    said = capsys.readouterr().out
    assert said.count("hard_neg_source geo") == 2 and "names" in said and "hard_negative: 100" in said
    main(["preview", "--source", source, "--kind", "brand", "-n", "3"], spark)
    assert capsys.readouterr().out.count("pair_type hard_negative") == 3
    with pytest.raises(SystemExit):
        main(["geo", "--source", source], spark)
