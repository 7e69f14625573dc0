"""Minimum-cost flow against all whole-number plans, and layouts on disk."""

import itertools
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pairloom.llm import resharding as R


def fewest(sizes, capacities):
    """The fewest units that must move, by trying every plan."""
    best = [sum(sizes.values())]

    def go(left, room, moved):
        if moved >= best[0]:
            return
        if not left:
            best[0] = moved
            return
        (s, n), rest = left[0], left[1:]
        for plan in itertools.product(*(range(min(n, r) + 1) for r in room)):
            if sum(plan) == n:
                go(rest, [r - p for r, p in zip(room, plan)], moved + n - (plan[s] if s < len(room) else 0))

    go(sorted(sizes.items()), list(capacities), 0)
    return best[0]


def test_transfers_move_the_fewest_bytes():
    r = random.Random(3)
    for _ in range(60):
        sizes = {s: r.randrange(6) for s in r.sample(range(5), r.randint(1, 4))}
        n, total = r.randint(1, 4), sum(sizes.values())
        cut = sorted(r.randint(0, total) for _ in range(n - 1))
        capacities = [b - a for a, b in zip([0, *cut], [*cut, total])]
        got = R.transfers(sizes, capacities)
        assert {s: sum(k for a, _, k in got if a == s) for s in sizes} == sizes
        assert [sum(k for _, b, k in got if b == j) for j in range(n)] == capacities
        assert sum(k for a, b, k in got if a != b) == fewest(sizes, capacities)
        assert len(got) <= 2 * (len(sizes) + n)
    with pytest.raises(ValueError, match="capacities"):
        R.transfers({0: 3}, [1, 1])


def test_flow_takes_cheaper_paths_back():
    """The second path has to undo a part of the first."""
    net = R.Network(4)
    for a, b, room, cost in ((0, 1, 2, 1), (0, 2, 1, 2), (1, 2, 1, 0), (1, 3, 1, 3), (2, 3, 2, 1)):
        net.edge(a, b, room, cost)
    assert net.cheapest(0, 3) == 3
    assert sum(net.flow(2 * i) * c for i, c in enumerate((1, 2, 0, 3, 1))) == 2 + 2 + 0 + 3 + 2


def rows_of(seed, n=900):
    r = random.Random(seed)
    rows = [(i, "x" * r.randrange(400)) for i in range(n)]
    rows += [(n + i, "copy of one text") for i in range(n // 2)]  # a third of all rows
    return rows + [(None, "no id"), (None, None), (5, None), (5, None), (7, "é" * 10), (8, "")]


def test_reshard(spark):
    rows = rows_of(1)
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, shard string, slot int").repartition(5)
    got = R.reshard(df).collect()
    raw = lambda t: (t or "").encode()
    assert sorted(map(repr, ((r.doc_id, r.size, r.text_crc32) for r in got))) == sorted(map(repr, ((i, len(raw(t)) + 1, zlib.crc32(raw(t))) for i, t in rows)))
    shards = {s: [r for r in got if r.shard == s] for s in range(8)}
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in shards.values())
    bytes_ = [sum(r.size for r in x) for x in shards.values()]
    assert max(bytes_) - min(bytes_) <= 2 * 401
    assert {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)
    old = {s: sum(r.size for r in got if r.old_shard == s) for s in range(6)}
    moved = sum(r.size for r in got if r.old_shard != r.shard)
    least = sum(k for a, b, k in R.transfers(old, R.even(sum(old.values()), 8)) if a != b)
    assert abs(moved - least) <= 16 * 401
    again = R.reshard(df.repartition(2)).collect()
    key = lambda r: repr((r.doc_id, r.text_crc32, r.shard, r.slot))
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert R.reshard(df.limit(0)).count() == 0


def test_layout_rewrites_affected_files_only(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, "y" * r.randrange(300), k) for k, n in enumerate((50, 50, 170, 10)) for i in range(1000 * k, 1000 * k + n)] + [(4000, None, 1), (2, "twice", 2), (2, "twice", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").withColumn("old", F.lit("kept"))
    at = R.Layout(spark, f"file://{tmp_path}/t")
    at.write(df, [0, 1, 2, 3])
    before = at.folders()
    sizes = {k: sum(len(t or "") + 1 for _, t, s in rows if s == k) for k in range(4)}
    capacities = [sizes[0], sizes[1], sizes[2] - sizes[2] // 3, sizes[3] + sizes[2] // 3]
    stamp = {f: os.path.getmtime(f) for k in (0, 1) for f in [f"{tmp_path}/t/{before[k]}"]}
    moves = at.reshard(4, capacities)
    after = at.folders()
    assert [m for m in moves if m[0] != m[1]] == [(2, 3, sizes[2] // 3)]
    assert after[0] == before[0] and after[1] == before[1] and after[2] != before[2] and after[3] != before[3]
    assert all(os.path.getmtime(f) == t for f, t in stamp.items())
    back = at.read()
    assert sorted(back.columns) == sorted(df.columns)
    assert sorted(map(repr, ((x.doc_id, x.text, x.old) for x in back.collect()))) == sorted(map(repr, ((i, t, "kept") for i, t, _ in rows)))
    got = {k: sum(len(x.text or "") + 1 for x in at.read([k]).collect()) for k in range(4)}
    assert all(abs(got[k] - c) <= 301 for k, c in enumerate(capacities))
    at.reshard(6)
    assert sorted(at.folders()) == list(range(6)) and at.read().count() == len(rows)
    at.reshard(2)
    assert sorted(at.folders()) == [0, 1] and at.read().count() == len(rows)
    with pytest.raises(ValueError, match="no shards"):
        R.Layout(spark, f"file://{tmp_path}/none").read()
