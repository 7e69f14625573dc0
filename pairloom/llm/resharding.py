"""Resharding by minimum-cost flow.

Old shards have sizes, new shards have capacities. A flow network says what each old shard may send: to the new shard of
its number at no cost, to any other at one for each byte. The cheapest flow moves the fewest bytes. It is cut into
transfers (old shard, new shard, bytes), at most as many as there are shards of both kinds. The rows of an old shard lie in
an order (large rows first, equal texts together, those that stay before those that leave), and every transfer takes a
stretch of it, by a prefix sum of sizes over cells of rows. Only the files of shards that a transfer enters or leaves are
written again.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm.common import materialize

#: Shards of the layout before and after, in op13.
OLD, NEW = 6, 8


class Network:
    """A flow network of whole numbers."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int) -> int:
        for at, end, free, price in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[at].append(len(self.to))
            self.to.append(end)
            self.room.append(free)
            self.cost.append(price)
        return len(self.to) - 2

    def flow(self, e: int) -> int:
        return self.room[e ^ 1]

    def cheapest(self, source: int, sink: int) -> int:
        """Send as much as can be sent from source to sink at the least cost, and return how much. Edge costs are 0 or more;
        every round sends along a cheapest path by reduced costs."""
        height, sent = [0] * len(self.out), 0
        while True:
            cost, via, todo = {source: 0}, {}, [(0, source)]
            while todo:
                d, a = heapq.heappop(todo)
                if d > cost[a]:
                    continue
                for e in self.out[a]:
                    b = self.to[e]
                    now = d + self.cost[e] + height[a] - height[b]
                    if self.room[e] and now < cost.get(b, now + 1):
                        cost[b], via[b] = now, e
                        heapq.heappush(todo, (now, b))
            if sink not in cost:
                return sent
            far = max(cost.values())
            height = [h + cost.get(i, far) for i, h in enumerate(height)]
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = self.to[via[at] ^ 1]
            most = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= most
                self.room[e ^ 1] += most
            sent += most


def transfers(sizes: dict[int, int], capacities: Sequence[int]) -> list[tuple[int, int, int]]:
    """(old shard, new shard, bytes) that fill the capacities and move the fewest bytes, in order of the old shard, what
    stays first. sizes: bytes by old shard, by its number; a shard keeps its number if there is a new one of it."""
    if sum(capacities) != sum(sizes.values()):
        raise ValueError(f"capacities hold {sum(capacities)} bytes, the shards {sum(sizes.values())}")
    old = sorted(sizes)
    n = len(old)
    net = Network(n + len(capacities) + 3)
    source, sink, hub = range(n + len(capacities), n + len(capacities) + 3)
    stay, leave, enter = {}, {}, {}
    for i, s in enumerate(old):
        net.edge(source, i, sizes[s], 0)
        if 0 <= s < len(capacities):
            stay[s] = net.edge(i, n + s, sizes[s], 0)
        leave[s] = net.edge(i, hub, sizes[s], 1)
    for j, c in enumerate(capacities):
        enter[j] = net.edge(hub, n + j, c, 0)
        net.edge(n + j, sink, c, 0)
    net.cheapest(source, sink)
    out = [(s, s, net.flow(e)) for s, e in stay.items()]
    wanted = [[j, net.flow(e)] for j, e in enter.items()]
    for s in old:  # what passes the hub may go to any shard that takes from it
        left = net.flow(leave[s])
        while left:
            j, room = wanted[0]
            most = min(left, room)
            if most:
                out.append((s, j, most))
            left -= most
            wanted[0][1] -= most
            if not wanted[0][1]:
                wanted.pop(0)
    return sorted((t for t in out if t[2]), key=lambda t: (t[0], t[1] != t[0], t[1]))


def even(total: int, shards: int) -> list[int]:
    """Capacities that differ by one at most."""
    return [total * (j + 1) // shards - total * j // shards for j in range(shards)]


def _cells(rows: DataFrame, mark: Column) -> DataFrame:
    """rows(old, size, ...) with the cell of a row: size class (1/8 octave, large ones first), text, id."""
    exponent = F.length(F.bin("size")) - 1
    size_class = F.when(F.col("size") < 16, F.col("size").cast("int")).otherwise(exponent * 8 + F.expr("cast(shiftright(size, length(bin(size)) - 4) & 7 as int)"))
    digits = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return rows.withColumns({"__class": -size_class, "__text": F.pmod(mark, F.lit(16)), "__hash": digits, "__id": F.pmod(F.xxhash64("doc_id"), F.lit(64)), "__mark": mark})


_CELL = ("old", "__class", "__text", "__id")


def place(rows: DataFrame, shards: int, mark: Column, capacities: Sequence[int] | None = None) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """rows(doc_id, size, old, ...) with shard and slot added, and the transfers that they follow.

    old: the shard that a row lies in; size: its bytes, not below 0. capacities: bytes that each new shard takes, even ones
    unless given. mark: a whole number, equal for equal texts, which so lie next to each other. A row goes where the middle
    of its stretch goes, so a shard misses its capacity by half a row at each of its transfers at most. slot numbers the rows
    of a shard without gaps. Cells, not shards, are the groups that rows are ordered in, so no shard is ever one task's."""
    rows = _cells(rows, mark)
    cells = materialize(rows.groupBy(*_CELL).agg(F.sum("size").alias("bytes")))
    sizes = {r["old"]: int(r["b"]) for r in cells.groupBy("old").agg(F.sum("bytes").alias("b")).collect()}
    moves = transfers(sizes, even(sum(sizes.values()), shards) if capacities is None else capacities)
    spark = rows.sparkSession
    cuts, at = [], {}
    for old, new, n in moves:
        cuts.append((old, at.get(old, 0), at.get(old, 0) + n, new))
        at[old] = at.get(old, 0) + n
    last = {old: i for i, (old, *_) in enumerate(cuts)}
    cuts = [(old, lo, None if last[old] == i else hi, new) for i, (old, lo, hi, new) in enumerate(cuts)]
    cuts += [(old, 0, None, min(max(old, 0), shards - 1)) for old in sizes if old not in last]  # rows without bytes only
    ranges = F.broadcast(spark.createDataFrame(cuts, "old int, lo long, hi long, shard int"))  # two for each shard at most

    before = Window.partitionBy("old").orderBy(*_CELL[1:]).rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(*_CELL, F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("__start"))
    inner = Window.partitionBy(*_CELL).orderBy(F.desc("size"), "__mark", "__hash", "doc_id")
    middle = F.col("__start") + F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    placed = rows.join(starts, [*_CELL]).withColumn("__at", middle).join(ranges, "old")
    placed = placed.filter((F.col("__at") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("__at") < F.col("hi")))).drop("lo", "hi", "__start")
    placed = materialize(placed)
    counts = placed.groupBy("shard", *_CELL).agg(F.count("*").alias("__n"))
    upto = Window.partitionBy("shard").orderBy(*_CELL).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", *_CELL, F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__first"))
    rank = F.row_number().over(Window.partitionBy("shard", *_CELL).orderBy("__at", "__hash", "doc_id"))
    slot = (F.col("__first") + rank - 1).cast("long").alias("slot")
    own = [c for c in placed.columns if not c.startswith("__") and c != "shard"]
    return placed.join(firsts, ["shard", *_CELL]).select(*own, "shard", slot), moves


def reshard(docs: DataFrame, shards: int = NEW, old: int = OLD) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard), by the law `bytes`: shards
    of near equal bytes.

    size is the text's UTF-8 bytes and one more (null text: 1). The layout before has `old` shards, by the text's checksum,
    so equal texts lie in one; the cheapest flow makes `shards` even ones of it, in which equal texts are neighbours unless
    a shard ends between them. Null doc_ids and repeated rows are rows like others; other columns are ignored; an empty
    table gives an empty one. Rows that agree in id and text may change places."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    narrow = materialize(narrow.withColumn("old", F.pmod(F.xxhash64("text_crc32"), F.lit(old)).cast("int")))
    placed, _ = place(narrow, shards, F.col("text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))


class Layout:
    """Sharded Parquet files at `path`, on any file system that Spark writes to: `layout` names the folder of every shard.

    A change writes the shards it affects to new folders, then puts the new `layout` in place by a rename; a reader sees
    the old or the new one, and a broken-off change leaves only folders that no layout names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path

    def _fs(self):
        return self._at(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def folders(self) -> dict[int, str]:
        """Folder of each shard, below path; the newest layout counts."""
        found = [int(f.getPath().getName().partition("-")[2]) for f in self._fs().globStatus(self._at(f"{self.path}/layout-*"))] if self._fs().exists(self._at(self.path)) else []
        if not found:
            return {}
        return {int(k): v for k, v in json.loads(self.spark.read.text(f"{self.path}/layout-{max(found):08d}").first()[0]).items()}

    def read(self, shards: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some shards, with their shard in `shard`."""
        parts = [self.spark.read.parquet(f"{self.path}/{f}").withColumn("shard", F.lit(s)) for s, f in sorted(self.folders().items()) if shards is None or s in shards]
        if not parts:
            raise ValueError(f"no shards at {self.path}")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def write(self, rows: DataFrame, shards: Sequence[int], keep: dict[int, str] | None = None) -> None:
        """rows(shard, ...) as new files of the named shards; other shards keep the folders given, or go."""
        name = f"data/{uuid.uuid4().hex}"
        rows.repartition(max(len(shards), 1), "shard", F.pmod(F.xxhash64("doc_id"), F.lit(4))).write.partitionBy("shard").parquet(f"{self.path}/{name}")
        there = {int(f.getPath().getName().partition("=")[2]) for f in self._fs().globStatus(self._at(f"{self.path}/{name}/shard=*"))}
        folders = {s: f for s, f in (keep or {}).items() if s not in shards} | {s: f"{name}/shard={s}" for s in shards if s in there}
        new = f"{self.path}/new-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps(folders),)], "value string").coalesce(1).write.text(new)
        number = 1 + max((int(f.getPath().getName().partition("-")[2]) for f in self._fs().globStatus(self._at(f"{self.path}/layout-*"))), default=-1)
        if not self._fs().rename(self._at(new), self._at(f"{self.path}/layout-{number:08d}")):
            raise RuntimeError("the layout changed meanwhile")

    def reshard(self, shards: int, capacities: Sequence[int] | None = None) -> list[tuple[int, int, int]]:
        """Move rows so that the shards fill even (or given) capacities by bytes of text and one a row, and write again only
        the files of shards that rows leave or enter. Returns the transfers. Rows need doc_id and text; null text has no
        bytes; other columns go along."""
        before = self.folders()
        rows = self.read().withColumn("__key", F.xxhash64("doc_id", "text"))
        text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
        narrow = rows.select("doc_id", "__key", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.col("shard").alias("old"))
        placed, moves = place(materialize(narrow.withColumnRenamed("__key", "key")), shards, F.col("crc"), capacities)
        if placed.filter(F.col("old") != F.col("shard")).isEmpty() and all(s < shards for s in before):
            return moves
        touched = sorted({s for a, b, _ in moves if a != b for s in (a, b)})
        # rows that agree in shard, id and text are told apart by their number only
        goes = placed.filter(F.col("old").isin(touched)).groupBy("old", "doc_id", "key", "shard").agg(F.count("*").alias("n"))
        upto = Window.partitionBy("old", "doc_id", "key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
        goes = goes.withColumn("hi", F.sum("n").over(upto)).withColumn("lo", F.col("hi") - F.col("n"))
        own = rows.filter(F.col("shard").isin(touched)).withColumnRenamed("shard", "__old").withColumn("__i", F.row_number().over(Window.partitionBy("__old", "doc_id", "__key").orderBy("text")))
        same = F.col("g.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("g.old") == F.col("r.__old")) & (F.col("g.key") == F.col("r.__key"))
        moved = own.alias("r").join(goes.alias("g"), same & (F.col("__i") > F.col("lo")) & (F.col("__i") <= F.col("hi")))
        named = [F.col(f"r.{c}") for c in own.columns if c not in ("__old", "__key", "__i")]
        self.write(moved.select(*named, F.col("g.shard").alias("shard")), touched, {s: f for s, f in before.items() if s not in touched})
        return moves
