"""SimHash near-duplicates with pigeonring candidates.

A fingerprint of 64 bits is a ring of eight 8-bit segments. If two fingerprints differ in at most `t` bits, some
start on the ring has every chain prefix of k segments within floor(k*t/8) differing bits (the strong form of the
pigeonring principle). For t = 3 the prefixes allow 0, 0, 1, 1, 1, 2, 2, 3 bits: the first two segments are equal, and
of the next three at least two are. So each start gives three 32-bit keys, and a pair within 3 bits shares one.
Equal fingerprints are one node; a bucket of equal keys yields links of a spanning forest, never all its pairs.

Near copies at a Jaccard similarity s of shingle sets differ in about 15 % of the bits at s = 0.8, too many for keys of
equal segments. `near_groups` takes its candidates from shingles: sets at s or more share one of their first
n - ceil(s * n) + 1 shingles in any common order (here by hash, those common in a sample last). Candidates have
fingerprints of WIDE bits, pass the ring's chains under its budget, then the full count of differing bits. What passes is
decided by the full shingle sets, counted exactly: links that span a group's candidates are checked, and where one does not
hold, all that such links join is gone through again with the full sets at hand.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import discard, materialize, partitions, releasing
from pairloom.llm.components import components
from pairloom.llm.suffix_dedup import _marked as marked

SEGMENTS, BITS = 8, 3
#: Which of the five leading segments a key holds.
VARIANTS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4))
#: A bucket up to this size is searched whole; a larger one is first split by a further equal segment.
DIRECT = 4096


#: Bits and segments of the wide fingerprint, and how many standard deviations beyond the expected distance are still checked.
WIDE, WIDE_SEGMENTS, MARGIN = 256, 16, 3.3
#: Smallest shingles of a set that candidates bring along: all of a smaller set; of larger ones an estimate of the similarity,
#: which may fall short by SHORT standard deviations and still be checked.
LOW, SHORT = 64, 3.3
#: Sets of a group that one task compares, and bytes of full ones; a larger group is dealt to blocks, each pair of which is a
#: group of its own.
GROUP, HOLD = 8_192, 32 << 20
#: Documents (by hash of doc_id) that show which shingles are common, from how many on; shingles that one flush holds.
SAMPLE, COMMON, FLUSH = 20_000, 16, 1_000_000


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of the word shingles in order, repeats included; fewer words are one shingle, none give none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[width - 1:].tolist())], np.uint64)


def _majority(h: np.ndarray) -> np.ndarray:
    """64 bits: whether a bit is 1 in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i:i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of the word shingles, repeats included; 0 without words."""
    return int(_majority(shingle_hashes(text, width))[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs(doc_id, text) -> (doc_id long, fp long: the fingerprint's 64 bits as a signed number)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(releasing(run), "doc_id long, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def _rotated(fp: np.ndarray, start: int) -> np.ndarray:
    """Segment `start` first, as the lowest byte."""
    s = np.uint64(8 * start)
    return fp if not start else (fp >> s) | (fp << (np.uint64(64) - s))


def _chained(x: np.ndarray) -> np.ndarray:
    """Whether rotated differences keep within every prefix budget, the last of which is the full distance."""
    ok = np.ones(len(x), bool)
    for k in range(2, SEGMENTS + 1):
        at = np.flatnonzero(ok)
        mask = np.uint64((1 << (8 * k)) - 1)
        ok[at] = _popcount(x[at] & mask) <= k * BITS // SEGMENTS
    return ok


def bucket_links(fp: np.ndarray, start: int, fixed: tuple[int, ...]) -> list[tuple[int, int]]:
    """Index pairs that span the components of a bucket's distinct fingerprints."""
    links: list[tuple[int, int]] = []

    def walk(idx: np.ndarray, free: np.ndarray) -> None:
        if len(idx) > DIRECT and len(free) > BITS:
            for unit in np.array_split(free, BITS + 1):  # one of these parts holds none of the differing bits
                seg = np.zeros(len(idx), np.uint64)
                for bit in unit:
                    seg = (seg << np.uint64(1)) | ((rot[idx] >> np.uint64(bit)) & np.uint64(1))
                order = np.argsort(seg, kind="stable")
                for part in np.split(idx[order], np.flatnonzero(np.diff(seg[order])) + 1):
                    if len(part) > 1:
                        walk(part, np.setdiff1d(free, unit))
            return
        left = idx
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                at = queue.pop()
                near = _chained(rot[left] ^ rot[at])
                hit = left[near]
                links.extend((int(at), int(j)) for j in hit)
                queue.extend(hit)
                left = left[~near]

    rot = _rotated(fp, start)
    walk(np.arange(len(fp)), np.array([8 * k + i for k in range(SEGMENTS) if k not in fixed for i in range(8)]))
    return links


def _keys() -> F.Column:
    seg = [F.shiftright("fp", 8 * i).bitwiseAND(F.lit(255)) for i in range(SEGMENTS)]
    out = []
    for start in range(SEGMENTS):
        for v, chosen in enumerate(VARIANTS):
            key = F.lit(start * len(VARIANTS) + v).cast("long")
            for k in chosen:
                key = F.shiftleft(key, 8).bitwiseOR(seg[(start + k) % SEGMENTS])
            out.append(key)
    return F.array(*out)


def links(nodes: DataFrame) -> DataFrame:
    """nodes(node long, fp long, fp distinct) -> (a, b): links within 3 bits that connect what all such links do."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3

        def out(key, node, fp):
            cut = np.flatnonzero(np.diff(key)) + 1
            lo, hi = np.append(0, cut), np.append(cut, len(key))
            found = []
            for s, e in zip(lo[hi - lo > 1], hi[hi - lo > 1]):
                start, variant = divmod(int(key[s]) >> 32, len(VARIANTS))
                found += [(node[s + i], node[s + j]) for i, j in bucket_links(fp[s:e], start, VARIANTS[variant])]
            a = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

        for b in parts:
            key, node, fp = (np.concatenate([h, b.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("key", "node", "fp")))
            if not len(key):
                continue
            last = np.searchsorted(key, key[-1])  # the last key may go on in the next batch
            held = [key[last:], node[last:], fp[last:]]
            yield out(key[:last], node[:last], fp[:last].view(np.uint64))
        yield out(held[0], held[1], held[2].view(np.uint64))

    keyed = nodes.select("node", "fp", F.explode(_keys()).alias("key"))
    dealt = keyed.repartition(partitions(nodes.sparkSession), "key").sortWithinPartitions("key")
    return dealt.select("key", "node", "fp").mapInArrow(releasing(run), "a long, b long").distinct()


def simhash_groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs(doc_id, text) -> (doc_id long, fingerprint string of 16 hex digits, component_id long).

    Words are lower-cased (A-Z) runs without ASCII white space; shingles of `width` words with repeats. Fingerprints
    at up to 3 differing bits link; component_id is the smallest doc_id reached. Null text counts as empty; empty texts
    have fingerprint 0 and link like others. Rows with null doc_id are dropped, rows of equal doc_id are returned each.
    Other columns are ignored. An empty table gives an empty one."""
    fps = materialize(fingerprints(docs, width).filter("doc_id is not null"))
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(nodes))
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def bit_budget(similarity: float) -> int:
    """Differing bits of WIDE that sets at this Jaccard similarity have, and MARGIN standard deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(WIDE * p + MARGIN * math.sqrt(WIDE * p * (1 - p)))


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """WIDE bits of a set of shingles, as 64-bit numbers: each 64 from the hashes mixed anew."""
    out = []
    for k in range(WIDE // 64):
        h = shingles + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(_majority(h ^ (h >> np.uint64(31))))
    return np.concatenate(out)


def ring_near(fp: np.ndarray, to: np.ndarray, budget: int) -> np.ndarray:
    """Which wide fingerprints differ from another in at most `budget` bits. First some start on the ring of segments must
    keep every chain of k segments within k * budget / WIDE_SEGMENTS differing bits; then the full count decides."""
    apart = np.bitwise_count((fp ^ to).view(np.uint16)).astype(np.int64).reshape(len(fp), WIDE_SEGMENTS)
    alive = np.ones((len(fp), WIDE_SEGMENTS), bool)
    chain = np.zeros_like(apart)
    rows = np.arange(len(fp))
    for k in range(1, WIDE_SEGMENTS + 1):
        chain[rows] += np.roll(apart[rows], 1 - k, axis=1)
        alive[rows] &= chain[rows] <= k * budget // WIDE_SEGMENTS
        rows = rows[alive[rows].any(1)]
    out = np.zeros(len(fp), bool)
    out[rows] = apart[rows].sum(1) <= budget
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets' LOW smallest members (in order): the similarity of small sets, an estimate of that of larger ones."""
    every = np.union1d(a, b)
    if max(len(a), len(b)) == LOW:
        every = every[:LOW]
    both = np.isin(every, a, assume_unique=True) & np.isin(every, b, assume_unique=True)
    return float(both.mean())


def ring_links(fp: np.ndarray, n: np.ndarray, similarity: float, alike, held: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index pairs that span the components of sets whose sizes allow the similarity, whose fingerprints are within the budget,
    and which alike(at, those) finds so. held: a number for each set, equal (and not negative) for sets known to be of one
    component, which are not compared."""
    links, left, budget = [], np.arange(len(fp)), bit_budget(similarity)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            ok = np.minimum(n[left], n[at]) >= similarity * np.maximum(n[left], n[at]) - 1e-9
            if held is not None and held[at] >= 0:
                ok &= held[left] != held[at]
            ok[ok] = ring_near(fp[left[ok]], fp[at], budget)
            if ok.any():
                ok[ok] = alike(at, left[ok])
            links.extend((int(at), int(j)) for j in left[ok])
            queue.extend(left[ok])
            left = left[~ok]
    return links


def estimated(n: np.ndarray, low: list[np.ndarray], similarity: float):
    """Whether sets may have the similarity by their smallest shingles: SHORT deviations of slack, none for small sets."""
    short = SHORT * math.sqrt(similarity * (1 - similarity) / LOW)
    return lambda at, those: [jaccard(low[at], low[j]) >= similarity - (short if max(n[at], n[j]) >= LOW else 1e-9) for j in those.tolist()]


def counted(n: np.ndarray, sets: list[np.ndarray], similarity: float):
    """Whether sets have the similarity: shingles of the group are numbered once, then counted by a mark for each."""
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(n) - n
    marks = np.zeros(int(number.max(initial=0)) + 1, np.int64)

    def alike(at: int, those: np.ndarray) -> np.ndarray:
        own = number[start[at]:start[at] + n[at]]
        marks[own] = 1
        both = np.array([marks[number[start[j]:start[j] + n[j]]].sum() for j in those.tolist()])
        marks[own] = 0
        return both >= similarity * (n[at] + n[those] - both) - 1e-9

    return alike


def _sketches(ids: DataFrame, width: int, similarity: float) -> DataFrame:
    """(doc_id, key: digest of the shingle set, node: 64 bits of it, n: its size, fp: wide fingerprint, first: shingles that
    a set of this similarity must share one of, low: the LOW smallest)."""

    def shown(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            sets = [np.unique(shingle_hashes(t.as_py(), width)) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64())], ["h"])

    every = max(ids.count() // SAMPLE, 1)
    sample = ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).mapInArrow(releasing(shown), "h long")
    common = np.sort(sample.groupBy("h").count().filter(F.col("count") >= COMMON).toArrow().column("h").to_numpy().view(np.uint64))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = []
            for t in b.column("text"):
                h = np.unique(shingle_hashes(t.as_py(), width))
                key = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
                at = np.minimum(np.searchsorted(common, h), max(len(common) - 1, 0))
                often = common[at] == h if len(common) else np.zeros(len(h), bool)
                first = np.concatenate([h[~often], h[often]])[:len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]
                rows.append((key, int.from_bytes(key[:8], "little", signed=True), len(h), wide_fingerprint(h).tobytes(), first.tobytes(), h[:LOW].tobytes()))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "key", "node", "n", "fp", "first", "low"])

    return ids.mapInArrow(releasing(run), "doc_id long, key binary, node long, n long, fp binary, first binary, low binary")


def _sharing(sketches: DataFrame, buckets: int) -> DataFrame:
    """(grp, node): the groups of nodes that share one of their first shingles, each distinct group once."""

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            h, node = (np.concatenate(x) for x in zip(*held))
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            o = np.lexsort((node, h, bucket))
            h, node, bucket = h[o], node[o], bucket[o]
            new = np.append(True, (h[1:] != h[:-1]) | (node[1:] != node[:-1]))  # copies of a set give the same rows
            h, node, bucket = h[new], node[new], bucket[new]
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(cut[1:], len(h))
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int32()), *(pa.array([x[s:e].tobytes() for s, e in zip(cut, ends)], pa.binary()) for x in (h, node))], ["bucket", "h", "node"])

        for b in parts:
            for first, node in zip(b.column("first").to_pylist(), b.column("node").to_pylist()):
                h = np.frombuffer(first, np.uint64)
                if len(h):
                    held.append((h, np.full(len(h), node)))
                    size += len(h)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def groups(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.frombuffer(h, np.uint64), np.frombuffer(n, np.int64)) for b in parts for h, n in zip(b.column("h").to_pylist(), b.column("node").to_pylist())]
        if not held:
            return
        h, node = (np.concatenate(x) for x in zip(*held))
        o = np.lexsort((node, h))
        h, node = h[o], node[o]
        new = np.append(True, (h[1:] != h[:-1]) | (node[1:] != node[:-1]))
        h, node = h[new], node[new]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(start, len(h)))
        u = node.view(np.uint64)
        mixed = (u ^ (u >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        name = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), start)
        _, one = np.unique(name, return_index=True)
        one = one[size[one] > 1]
        for k in one[size[one] > GROUP].tolist():
            blocks = np.array_split(node[start[k]:start[k] + size[k]], -(-2 * size[k] // GROUP))
            for i, j in itertools.combinations(range(len(blocks)), 2):
                both = np.concatenate([blocks[i], blocks[j]])
                own = np.int64(xxhash.xxh64_intdigest(f"{name[k]}|{i}|{j}") >> 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(both), own)), pa.array(both)], ["grp", "node"])
        one = one[size[one] <= GROUP]
        for s in range(0, len(one), 4096):
            some = one[s:s + 4096]
            at = np.concatenate([np.arange(start[k], start[k] + size[k]) for k in some])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name[some], size[some]).view(np.int64)), pa.array(node[at])], ["grp", "node"])

    packed = sketches.select("node", "first").mapInArrow(releasing(pack), "bucket int, h binary, node binary")
    return packed.repartitionById(buckets, F.col("bucket")).mapInArrow(releasing(groups), "grp long, node long").distinct()


def _linked(rows: DataFrame, similarity: float, exact: bool) -> DataFrame:
    """rows(grp, node, rep, n, fp, held, shown), sorted by grp in their partitions -> (grp, a, b, rep_a, rep_b): links that span
    what the sets in `shown` make links, all of a set's shingles if exact, else the LOW smallest."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: pa.Table) -> pa.RecordBatch:
            grp, node, rep, n, held = (t.column(c).to_numpy() for c in ("grp", "node", "rep", "n", "held"))
            fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(-1, WIDE // 64)
            shown = [np.frombuffer(x, np.uint64) for x in t.column("shown").to_pylist()]
            cut = [*np.flatnonzero(np.diff(grp, prepend=grp[0] - 1)).tolist(), len(grp)]
            found = []
            for s, e in zip(cut[:-1], cut[1:]):
                if e - s > 1:
                    alike = (counted if exact else estimated)(n[s:e], shown[s:e], similarity)
                    found += [(grp[s], node[s + i], node[s + j], rep[s + i], rep[s + j]) for i, j in ring_links(fp[s:e], n[s:e], similarity, alike, held[s:e])]
            a = np.array(found, np.int64).reshape(-1, 5)
            return pa.RecordBatch.from_arrays([pa.array(a[:, k]) for k in range(5)], ["grp", "a", "b", "rep_a", "rep_b"])

        waiting: list[pa.RecordBatch] = []
        size = 0
        for b in parts:
            waiting.append(b)
            size += b.nbytes
            if size >= HOLD:  # whole groups only; the last one may go on
                t = pa.Table.from_batches(waiting)
                grp = t.column("grp").to_numpy()
                at = int(np.searchsorted(grp, grp[-1]))
                if at:
                    yield out(t.slice(0, at))
                waiting = t.slice(at).combine_chunks().to_batches()
                size = sum(x.nbytes for x in waiting)
        if size:
            yield out(pa.Table.from_batches(waiting))

    return rows.select("grp", "node", "rep", "n", "fp", "held", "shown").mapInArrow(releasing(run), "grp long, a long, b long, rep_a long, rep_b long")


def _sets(nodes: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """nodes(node, rep, key) -> (node, set): all shingles, read from the text once more."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            sets = [np.unique(shingle_hashes(t.as_py(), width)).tobytes() for t in b.column("text")]
            own = [hashlib.blake2b(x, digest_size=16).digest() == k for x, k in zip(sets, b.column("key").to_pylist())]  # an id may have other texts
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], ["node", "set"]).filter(pa.array(own, pa.bool_()))

    some = marked(ids, nodes.select(F.col("rep").alias("doc_id"))).filter("__has").select("doc_id", "text")  # other texts stay where they are
    texts = some.join(nodes, F.col("doc_id") == F.col("rep")).select("node", "key", "text")
    return materialize(texts.mapInArrow(releasing(read), "node long, set binary").dropDuplicates(["node"]))


def _checked(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """links(grp, a, b, rep_a, rep_b) with holds: whether their full sets have the similarity."""

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            holds = []
            for x, y in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                holds.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(holds, pa.bool_())], ["a", "b", "holds"])

    side = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}"))
    met = links.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
    return materialize(links.join(met.mapInArrow(releasing(compare), "a long, b long, holds boolean"), ["a", "b"]))


def near_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs(doc_id, text) -> (doc_id long, component_id long), component_id the smallest doc_id of its group.

    Documents whose sets of shingles have at least this Jaccard similarity link; all without words have one set. Candidates
    share one of the shingles that sets of this similarity must share, and are within the ring's budget. Links that span a
    group by an estimate are counted on the full sets; where one does not hold, all sets that such links join are gone through
    again with the full ones, leaving out what the links that hold have joined. Rows with null doc_id are dropped, rows of equal doc_id are
    returned each. Null text counts as empty. Other columns are ignored. An empty table gives an empty one. A group of more
    than GROUP sets, or HOLD bytes of them, goes to several tasks."""
    buckets = partitions(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    sketches = materialize(_sketches(ids, width, similarity))
    nodes = materialize(sketches.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("node").alias("node"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("low").alias("low")))
    groups = materialize(_sharing(sketches, buckets))
    dealt = lambda rows: rows.repartition(buckets, "grp").sortWithinPartitions("grp")

    rows = groups.join(nodes.select("node", "rep", "n", "fp", F.col("low").alias("shown")), "node").withColumn("held", F.lit(-1).cast("long"))
    first = materialize(_linked(dealt(rows), similarity, False))
    named = nodes.select("node", "rep", "key")
    ends = first.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    checked = _checked(first, sets := _sets(named.join(ends, "node"), ids, width), similarity)
    links = checked.filter("holds").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    bad = checked.filter("not holds")
    if not bad.isEmpty():
        # whatever is similar is joined by the first links: each set they join stands in one group now
        joined = components(first.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))).withColumnsRenamed({"node": "rep", "component": "grp"})
        again = joined.join(bad.select(F.col("rep_a").alias("rep")).join(joined, "rep").select("grp").distinct(), "grp", "left_semi")
        known = components(links).withColumnsRenamed({"node": "rep", "component": "held"})
        rows = again.join(nodes.select("node", "rep", "n", "fp"), "rep").join(known, "rep", "left").withColumn("held", F.coalesce("held", F.lit(-1)))
        rows = materialize(rows)
        blocks = rows.groupBy("grp").agg(F.ceil(F.sum("n") * 16 / HOLD).cast("int").alias("blocks"))
        rows = rows.join(blocks, "grp").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("blocks = 1 or own <> other")
        rows = rows.withColumn("grp", F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other"))).select("grp", "node", "rep", "n", "fp", "held")
        exact = materialize(_linked(dealt(rows.join(sets.withColumnRenamed("set", "shown"), "node")), similarity, True))
        links = links.unionByName(exact.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    found = components(links)
    named = nodes.drop("node").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    out = materialize(sketches.select("doc_id", "key").join(named.select("key", F.coalesce("component", "rep").alias("component_id")), "key").select("doc_id", "component_id"))
    for t in (sketches, nodes, groups, first, sets):
        discard(t)
    return out


def keep_first(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents whose doc_id is the smallest of its near_groups(), with all their columns.

    Rows with null doc_id stay; rows that share a doc_id stay or go together; null and empty texts are one group; an empty
    table stays empty. A column of any name is kept as it is."""
    drop = near_groups(docs, width, similarity).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)
