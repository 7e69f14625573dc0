"""Running totals, numbers and quantiles against plain ones."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import matching as M
from pairloom.operators import metrics, order
from pairloom.operators import pairs as P


def test_running_totals_in_any_partitioning(spark):
    r = random.Random(1)
    rows = [(k, r.choice([None, 0, 1, 5, 7])) for k in r.sample(range(10_000), 3_000)]
    want, total = {}, 0
    for k, v in sorted(rows, reverse=True):
        want[k] = total
        total += v or 0
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "k long, v int").repartition(parts)
        assert {x.k: x.before for x in order.running_before(df, [F.desc("k")], "v").collect()} == want
        assert [x.at for x in order.numbered_from_zero(df, ["k"]).orderBy("k").collect()] == list(range(len(rows)))
    assert order.running_before(df.limit(0), ["k"], "v").count() == 0


def test_no_window_over_all_rows(spark):
    df = spark.range(5_000, numPartitions=5).withColumnRenamed("id", "k")
    plan = order.numbered_from_zero(df, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 2 and "__range" in plan and all("__range" in x for x in plan.splitlines() if "Window" in x)


def test_first_by_hash(spark):
    ids = [f"id{k}" for k in range(4_000)]
    want = sorted(ids, key=lambda i: hashlib.md5(f"s|{i}".encode()).hexdigest())
    df = spark.createDataFrame([(i,) for i in ids], "id string").repartition(6)
    for n in (0, 1, 300, 4_000, 9_999):
        got = order.first_by_hash(df, F.md5(F.concat(F.lit("s|"), "id").cast("binary")), "id", n).orderBy("at").collect()
        assert [(x.id, x.at) for x in got] == [(i, k) for k, i in enumerate(want[:n])]
    same = F.lit("f" * 32)  # a hash whose first rows lie beyond any prefix
    assert [x.id for x in order.first_by_hash(df, same, "id", 5).orderBy("at").collect()] == sorted(ids)[:5]


def interpolated(values, p):
    at = (len(values) - 1) * p
    low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
    return low if low == high else (int(at) + 1 - at) * low + (at - int(at)) * high


@pytest.mark.parametrize("few", [1, 10, 50_000])
@pytest.mark.parametrize("kind", ["even", "ties", "powers", "extreme", "one"])
def test_quantiles(spark, monkeypatch, few, kind):
    monkeypatch.setattr(order, "FEW", few)
    monkeypatch.setattr(order, "BINS", 16)
    r = random.Random(2)
    values = {"even": [r.uniform(-5, 5) for _ in range(501)], "ties": [r.choice([0.0, 1.0, 1.5]) for _ in range(400)], "powers": [10.0 ** r.randint(-9, 9) for _ in range(300)],
              "extreme": [-1.7e308, 1.7e308, 5e-324, 0.0, -5e-324, 1.0, 2.0, math.inf, -math.inf, -math.inf], "one": [3.25]}[kind]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5, "x double").repartition(3)
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = order.quantiles(df, "x", shares)
    assert [repr(g) for g in got] == [repr(interpolated(sorted(values), p)) for p in shares]
    if kind == "extreme":
        assert math.isnan(order.quantiles(df.union(spark.createDataFrame([(math.nan,)], "x double")), "x", [1.0])[0])


def test_quantiles_of_nothing_and_latencies(spark):
    df = spark.createDataFrame([], "latency_seconds double")
    assert order.quantiles(df, "latency_seconds", [0.5]) == [None]
    assert tuple(metrics.latencies(df).first()) == (None, None, None)
    df = spark.createDataFrame([(x / 10,) for x in range(11)], "latency_seconds double")
    assert tuple(metrics.latencies(df).first()) == (0.5, 0.5, pytest.approx(0.95))
    assert metrics.latencies(df).columns == ["average_latency_seconds", "median_latency_seconds", "p95_latency_seconds"]


def test_pairs_have_the_same_numbers_in_any_partitioning(spark):
    df = spark.createDataFrame([(10 * i + k, i) for i in range(300) for k in range(2)], "rid long, id long")
    tables = [P.naive_pairs(df.repartition(n), 101).collect() for n in (1, 5)]
    assert sorted(map(tuple, tables[0])) == sorted(map(tuple, tables[1])) and sorted(x.pair_id for x in tables[0]) == list(range(101))
    order_ = sorted(range(300), key=lambda i: (hashlib.md5(f"s|{i}".encode()).hexdigest(), i))[:21]
    got = M.paired(df.select("id").distinct(), 21, "s").orderBy("pair").collect()
    assert [(x.pair, x.id_a, x.id_b) for x in got] == [(k, order_[2 * k], order_[2 * k + 1]) for k in range(10)]


def test_a_million_pairs(spark):
    df = spark.range(1_000_000, numPartitions=4).select((F.col("id") * 2).alias("rid_a"), (F.col("id") * 2 + 1).alias("rid_b"), F.col("id").alias("id_a"), F.col("id").alias("id_b"))
    got = P.numbered(df, 1).agg(F.count_distinct("pair_id"), F.min("pair_id"), F.max("pair_id")).first()
    assert tuple(got) == (1_000_000, 0, 999_999)
