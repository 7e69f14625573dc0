"""Embedding near-duplicates by NN-descent.

Equal vectors are one node with a multiplicity. A forest of random projections starts a neighbour graph: per tree the
nodes are sorted by their side of random hyperplanes, and each takes the best of a window around it. Then every node
joins its neighbours with each other (neighbours of neighbours), and lists take what is nearer, until little changes. An
audit compares a bounded sample with all nodes; while it finds too few of the true links of nodes with one, a few or many
links, more trees are added, and where that does not suffice every node is compared with all. Links are
the list entries at the threshold. A node whose list is full of links is saturated: what it links with, in its component
or another, is found by exact comparison with all nodes, which returns counts and links of components, never pairs.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import discard, materialize, partitions
from pairloom.llm.components import components

log = logging.getLogger(__name__)
#: List length, trees of one planting, window of a tree, bits of a code, rounds, nodes in the audit, nodes in a block,
#: bytes of saturated nodes' vectors in a pass.
K, TREES, WINDOW, CODE, ROUNDS, AUDIT, BLOCK, PASS = 10, 8, 64, 48, 3, 2048, 256, 16 << 20
RECALL, PLANTINGS = 0.995, 16
#: Numbers of links that the audit judges apart: from each up to below the next.
SIZES = (1, 2, 4, K)
_EDGE = "a long, b long, sim double"


def _packed(x: np.ndarray) -> bytes:
    """A vector as bytes: singles as they are, doubles with one byte more, so that the length tells them apart."""
    return (x + x.dtype.type(0)).tobytes() + b"\0" * (x.dtype == np.float64)  # a negative zero becomes zero


def _matrix(col) -> np.ndarray:
    """Unit rows, in doubles, of packed vectors of one length."""
    raw = col.to_pylist() if isinstance(col, (pa.Array, pa.ChunkedArray)) else col
    x = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
    x = np.ascontiguousarray(x[:, :-1]).view(np.float64) if x.shape[1] % 2 else x.view(np.float32).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(vectors: DataFrame) -> Column:
    """Whether a row can link at all."""
    e = F.col("embedding").cast("array<double>")
    fine = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False))


def _nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, vec_id) of all rows; (row, node) of usable ones; and (node, grp, v, many, low): the classes of equal vectors, with
    how many rows and the smallest vec_id of each. Rows and nodes have numbers of their own, as one vec_id may have several
    vectors."""

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            v = [_packed(x.values.to_numpy()) if x.is_valid else None for x in b.column("e")]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), b.column("grp"), pa.array(v, pa.binary())], ["row", "vec_id", "grp", "v"])

    grp = F.concat_ws("/", F.col("label").cast("string"), F.size("embedding"))
    single = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType())  # travels in half the bytes
    e = F.when(_usable(vectors), F.col("embedding").cast("array<float>" if single else "array<double>"))
    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), grp.alias("grp"), e.alias("e"))
    rows = materialize(numbered.mapInArrow(pack, "row long, vec_id long, grp string, v binary"))
    usable = rows.filter("v is not null")
    same = usable.groupBy("grp", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("many"))
    nodes = materialize(same.withColumn("node", F.monotonically_increasing_id()))
    members = usable.join(nodes.select("grp", "v", "node"), ["grp", "v"]).select("row", "node")
    return rows.select("row", "vec_id"), members, nodes.select("node", "grp", "v", "many", "low")


def _best(edges: DataFrame, k: int = K) -> DataFrame:
    """The k nearest of each list."""
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return edges.groupBy("a", "b").agg(F.max("sim").alias("sim")).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("n")


def _planted(nodes: DataFrame, first: int, parts: int) -> DataFrame:
    """Neighbours from windows of TREES random-projection orders."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[int, list[int]] = {}
            for i, v in enumerate(b.column("v").to_pylist()):
                by.setdefault(len(v), []).append(i)
            for at in by.values():
                some = b.take(pa.array(at))
                x = _matrix(some.column("v"))
                for t in range(first, first + TREES):
                    planes = np.random.default_rng(t).standard_normal((x.shape[1], CODE))
                    bits = (x @ planes > 0) @ (1 << np.arange(CODE - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([some.column("grp"), pa.array(np.full(len(x), t, np.int32)), pa.array(bits), some.column("node"), some.column("v")], ["grp", "tree", "code", "node", "v"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size >= 4096:
                t = pa.Table.from_batches(held)
                yield near(t)
                held = t.slice(len(t) - WINDOW).combine_chunks().to_batches()  # the next windows begin in this one
                size = sum(map(len, held))
        if size:
            yield near(pa.Table.from_batches(held))

    def near(t: pa.Table) -> pa.RecordBatch:
        node, v = t.column("node").to_numpy(), t.column("v").to_pylist()
        key = [f"{g}|{k}" for g, k in zip(t.column("grp").to_pylist(), t.column("tree").to_pylist())]
        out = []
        s = 0
        while s < len(key):
            e = s
            while e < len(key) and key[e] == key[s]:
                e += 1
            x = _matrix(v[s:e])
            for w in range(0, max(e - s - WINDOW // 2, 1), WINDOW // 2):
                i = np.arange(w, min(w + WINDOW, e - s))
                sim = x[i] @ x[i].T
                np.fill_diagonal(sim, -2)
                top = np.argsort(-sim, axis=1)[:, :K]
                out.append((np.repeat(node[s + i], top.shape[1]), node[s + i[top]].ravel(), np.take_along_axis(sim, top, 1).ravel()))
            s = e
        return _edges(*(np.concatenate(c) for c in zip(*out)))

    coded = nodes.mapInArrow(code, "grp string, tree int, code long, node long, v binary")
    dealt = coded.repartitionByRange(parts, "grp", "tree", "code").sortWithinPartitions("grp", "tree", "code", "node")
    return dealt.mapInArrow(windows, _EDGE)


def _edges(a, b, sim) -> pa.RecordBatch:
    ok = (a != b) & (sim > -1.5)
    return pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(sim[ok])], ["a", "b", "sim"])


def _joined(nodes: DataFrame, lists: DataFrame, fresh: DataFrame, parts: int) -> DataFrame:
    """Pairs of neighbours of a node, one of them new in its list, where they improve a list."""
    worst = lists.groupBy("a").agg(F.when(F.count("*") >= K, F.min("sim")).otherwise(F.lit(-1.0)).alias("worst")).withColumnRenamed("a", "node")
    new = fresh.select("a", "b", "sim", F.lit(True).alias("new")).unionByName(lists.select("a", "b", "sim", F.lit(False).alias("new")))
    both = new.union(new.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", "new")).groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("new").alias("new"))
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    around = both.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= 2 * K)
    rows = around.join(nodes.select("node", "v"), F.col("b") == F.col("node")).join(worst, "node").select("a", "node", "v", "new", "worst")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def pairs(t: pa.Table) -> pa.RecordBatch:
            a, node, new, worst = (t.column(c).to_numpy() for c in ("a", "node", "new", "worst"))
            v = t.column("v").to_pylist()
            cut = [0, *(np.flatnonzero(np.diff(a)) + 1).tolist(), len(a)]
            out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
            for s, e in zip(cut[:-1], cut[1:]):
                if e - s < 2 or not new[s:e].any():
                    continue
                x = _matrix(v[s:e])
                sim = x @ x.T
                use = (new[s:e, None] | new[None, s:e]) & (sim > worst[s:e, None])
                np.fill_diagonal(use, False)
                i, j = np.nonzero(use)
                out.append((node[s + i], node[s + j], sim[i, j]))
            return _edges(*(np.concatenate(c) for c in zip(*out)))

        for b in batches:
            held.append(b)
            size += len(b)
            if size >= 8192:
                t = pa.Table.from_batches(held)
                last = t.column("a").to_numpy()
                cut = int(np.searchsorted(last, last[-1]))
                if cut:
                    yield pairs(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
                size = len(t) - cut
        if size:
            yield pairs(pa.Table.from_batches(held))

    return rows.repartition(parts, "a").sortWithinPartitions("a").mapInArrow(join, _EDGE)


def _audit(nodes: DataFrame, links: DataFrame, threshold: float) -> float:
    """The least share of a sample's true links that the lists hold, over classes of nodes by their number of links. Half
    of the sample are any nodes, half such as the lists give links. nodes and links are those apart from saturated nodes,
    whose links are all found exactly later."""
    order = F.xxhash64("node"), F.col("node")
    some = nodes.select("node", "grp", "v")
    linked = some.join(links.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    sample = some.orderBy(*order).limit(AUDIT).union(linked.orderBy(*order).limit(AUDIT)).distinct().collect()
    by: dict[str, list] = {}
    for r in sample:
        by.setdefault(r["grp"], []).append((r["node"], bytes(r["v"])))
    held = {g: (np.array([n for n, _ in rs]), _matrix([v for _, v in rs])) for g, rs in by.items()}

    def true(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, some in _by_group(b):
                if g in held:
                    ids, x = held[g]
                    sim = x @ _matrix(some.column("v")).T
                    i, j = np.nonzero(sim >= threshold)
                    yield _edges(ids[i], some.column("node").to_numpy()[j], sim[i, j])

    want = nodes.select("node", "grp", "v").mapInArrow(true, _EDGE).select("a", "b")
    got = links.select("a", "b", F.lit(1).alias("got"))
    each = want.join(got, ["a", "b"], "left").groupBy("a").agg(F.count("*").alias("w"), F.count("got").alias("g"))
    size = sum((F.col("w") >= k).cast("int") for k in SIZES)
    shares = each.groupBy(size.alias("size")).agg((F.sum("g") / F.sum("w")).alias("share")).collect()
    return min((r["share"] for r in shares), default=1.0)


def _by_group(b: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    at: dict[str, list[int]] = {}
    for i, g in enumerate(b.column("grp").to_pylist()):
        at.setdefault(g, []).append(i)
    for g, some in at.items():
        yield g, b.take(pa.array(some))


def _full(links: DataFrame) -> DataFrame:
    """The saturated nodes."""
    return links.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= K).select(F.col("a").alias("node"))


def _blocks(rows: list, threshold: float) -> dict[str, tuple]:
    """Saturated nodes by group: vectors, nodes, multiplicities, components, where blocks begin and end, their centres,
    and the least cosine to a centre that a vector linked with one of its block can have."""
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r["grp"], []).append(r)
    out = {}
    for g, rs in by.items():
        x = _matrix([bytes(r["v"]) for r in rs])
        node, many, component = (np.array([r[c] for r in rs], np.int64) for c in ("node", "many", "component"))
        code = (x @ np.random.default_rng(0).standard_normal((x.shape[1], CODE)) > 0) @ (1 << np.arange(CODE, dtype=np.int64))
        order = np.lexsort((node, code, component))
        x, node, many, component = x[order], node[order], many[order], component[order]
        starts = [0, *(np.flatnonzero(np.diff(component)) + 1).tolist(), len(node)]
        cuts = [k for s, e in zip(starts[:-1], starts[1:]) for k in range(s, e, BLOCK)] + [len(node)]
        centres, least = [], []
        for s, e in zip(cuts[:-1], cuts[1:]):
            c = x[s:e].mean(0)
            c = c / np.linalg.norm(c) if np.linalg.norm(c) > 1e-9 else x[s]
            angle = np.arccos(np.clip((x[s:e] @ c).min(), -1, 1)) + np.arccos(np.clip(threshold, -1, 1)) + 1e-6
            centres.append(c)
            least.append(np.cos(angle) if angle < np.pi else -2.0)
        out[g] = (x, node, many.astype(np.float64), component, cuts, np.array(centres), np.array(least))
    return out


def _enlarged(placed: DataFrame, threshold: float) -> DataFrame:
    """placed(node, grp, v, many, component, full) -> (a, b, n): for n not null, the multiplicities of what node a links
    with, of all nodes where a is full and of the full ones else (to be summed); for n null, components a and b that link.

    Full nodes are compared exactly with all nodes of their group, in passes over the nodes with at most about PASS bytes
    of full ones; a block of them is left out for a vector that is too far from its centre to link with any."""
    full = placed.filter("full")
    spark = placed.sparkSession
    size = full.agg(F.sum(F.length("v")).alias("n")).first()["n"] or 0
    passes = -(-size // PASS)
    parts = full.groupBy("component").agg(F.ceil(4 * F.sum(F.length("v")) / PASS).alias("parts"))
    keyed = full.join(parts, "component").withColumn("pass", F.pmod(F.xxhash64("component", F.pmod(F.xxhash64("node"), "parts")), F.lit(passes or 1)))
    schema = "a long, b long, n long"
    out = spark.createDataFrame([], schema)
    for k in range(passes):
        rows = keyed.filter(F.col("pass") == k).select("node", "grp", "v", "many", "component").collect()
        shared = spark.sparkContext.broadcast(_blocks(rows, threshold))

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = shared.value
            sums = {g: np.zeros(len(h[1])) for g, h in held.items()}
            joins: set[tuple[int, int]] = set()
            for b in batches:
                for g, some in ((g, part.slice(i, 256)) for g, part in _by_group(b) if g in held for i in range(0, len(part), 256)):
                    xs, nodes, many_s, component_s, cuts, centres, least = held[g]
                    x = _matrix(some.column("v"))
                    node, many, component = (some.column(c).to_numpy() for c in ("node", "many", "component"))
                    n = np.zeros(len(x))
                    near = x @ centres.T >= least
                    for i in np.flatnonzero(near.any(0)).tolist():
                        q, s, e = np.flatnonzero(near[:, i]), cuts[i], cuts[i + 1]
                        linked = (x[q] @ xs[s:e].T >= threshold) & (node[q][:, None] != nodes[s:e])
                        n[q] += linked @ many_s[s:e]
                        sums[g][s:e] += many[q].astype(np.float64) @ linked
                        joins.update((int(c), int(component_s[s])) for c in np.unique(component[q[linked.any(1)]]) if c != component_s[s])
                    use = ~np.array(some.column("full").to_pylist(), bool) & (n > 0)
                    yield _counted(node[use], n[use])
            for g, n in sums.items():
                yield _counted(held[g][1][n > 0], n[n > 0])
            pairs = np.array(sorted(joins), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64())], ["a", "b", "n"])

        out = out.union(materialize(placed.mapInArrow(compare, schema)))
        shared.unpersist()
    return out


def _counted(node: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(n.astype(np.int64))], ["a", "b", "n"])


def _apart(links: DataFrame, full: DataFrame) -> DataFrame:
    """Links between nodes that are not full."""
    return links.join(full.withColumnRenamed("node", "a"), "a", "left_anti").join(full.withColumnRenamed("node", "b"), "b", "left_anti")


def _search(nodes: DataFrame, threshold: float, parts: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) and nodes (node) to compare with all: the saturated ones, and every node where PLANTINGS do not
    bring the audit to RECALL."""
    count = nodes.count()
    lists = None
    for planting in range(PLANTINGS):
        found = _planted(nodes, planting * TREES, parts)
        if lists is not None:
            found = found.unionByName(lists)
        new = materialize(_best(found))
        if lists is not None:
            for old in (lists, fresh, links, full):
                discard(old)
        fresh, lists = new, new
        for _ in range(ROUNDS):
            more = materialize(_best(_joined(nodes, lists, fresh, parts).unionByName(lists)))
            fresh = materialize(more.join(lists, ["a", "b"], "left_anti"))
            discard(lists)
            lists = more
            if fresh.count() <= 0.002 * K * count:
                break
        links = lists.filter(F.col("sim") >= threshold)
        links = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        full = materialize(_full(links))
        recall = _audit(nodes.join(full, "node", "left_anti"), _apart(links, full), threshold)
        log.info("planting %d of %d trees: recall %.4f", planting + 1, TREES, recall)
        if recall >= RECALL:
            return links, full
    log.warning("recall %.4f after %d plantings: all nodes are compared exactly", recall, PLANTINGS)
    return links, nodes.select("node")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vectors(vec_id, embedding, label) -> (vec_id long, n_links long, component_id long, kept boolean).

    Vectors of one label and length link at cosine >= threshold (double precision). Vectors that are null, zero or hold
    null or non-finite numbers, and those with a null label or vec_id, link with nothing: no links, their own
    component, kept. Rows of equal vec_id are vectors each and returned each. component_id is the smallest vec_id that
    links reach. Other columns are ignored. An empty table gives an empty one."""
    parts = partitions(vectors.sparkSession)
    rows, members, nodes = _nodes(vectors)
    links, full = _search(nodes, threshold, parts)
    rest = _apart(links, full)
    where = components(links)
    placed = materialize(nodes.join(where, "node", "left").join(full.withColumn("full", F.lit(True)), "node", "left").select(
        "node", "grp", "v", "many", "low", F.coalesce("component", "node").alias("component"), F.coalesce("full", F.lit(False)).alias("full")))
    exact = _enlarged(placed, threshold)
    merged = components(exact.filter("n is null").select("a", "b")).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    through = exact.filter("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    many = nodes.select(F.col("node").alias("b"), "many")
    plain = rest.join(many, "b").groupBy(F.col("a").alias("node")).agg(F.sum("many").alias("plain"))
    whole = placed.join(merged, "component", "left").withColumn("whole", F.coalesce("whole", "component"))
    least = whole.groupBy("whole").agg(F.min("low").alias("least"))
    per_node = (whole.join(least, "whole").join(through, "node", "left").join(plain, "node", "left")
                .select("node", (F.coalesce("n", F.lit(0)) + F.coalesce("plain", F.lit(0)) + F.col("many") - 1).alias("n"), F.col("least").alias("component")))
    by_row = members.join(per_node, "node").select("row", "n", "component")
    return rows.join(by_row, "row", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
