"""Exact removal of repeated passages by hashed anchors, which stand for a suffix sort.

Every string of `SPAN` bytes has one anchor: the leftmost least of the hashes of its 32-byte strings. Equal strings
have equal anchors at equal offsets, so anchors (about 3 in 100 positions) decide all repeats and no suffix is sorted
by its text. Sampled splitters range-partition anchors by their leading token (8 bytes, ties by the hash of 32). A
bucket orders them by that hash; only tied runs are ordered by the hash of what surrounds them, then by place.
Splitters never cut between equal leading strings, so no run crosses a boundary. An anchor's *context* is the text of
all its windows. Contexts of equal hashes (128 bits with the anchor's) count as equal, and all but the first occurrence
go. Where anchors agree but contexts differ (the ends of repeated passages, near copies), one copy of each context is
fetched, its windows are ordered by hash, and windows of one hash are compared byte for byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import discard, materialize, partitions, releasing

SPAN, GRAM = 100, 32
WIDTH = SPAN - GRAM + 1
#: Window starts in one piece of a document, bytes in one numpy block, anchors that one flush holds.
PIECE, BLOCK, FLUSH = 1 << 20, 1 << 18, 400_000
#: Where the next text of one doc_id starts.
TEXT = 1 << 40
#: Leading tokens the driver may see, how often a hot anchor is among them, windows in a slice of a hot context, and bits
#: of the filter of documents that have marks.
SAMPLE, HOT, SLICE, FILTER_BITS = 20_000, 16, 8, 1 << 25
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LOW = np.uint64((1 << 24) - 1)


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _words(buf: np.ndarray) -> np.ndarray:
    """The little-endian 8-byte number at every position."""
    n = len(buf) - 7
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        k = (n - o + 7) // 8
        out[o::8] = np.frombuffer(buf, np.uint64, k, o)
    return out


def _grams(w: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes at every position."""
    h = (w ^ (w >> np.uint64(32))) * _C[0]
    h = (h[:-8] * _C[1]) ^ _turn(h[8:], 31)
    h = (h ^ (h >> np.uint64(29))) * _C[2]
    h = (h[:-16] * _C[3]) ^ _turn(h[16:], 27)
    h = (h ^ (h >> np.uint64(32))) * _C[0]
    return h ^ (h >> np.uint64(29))


def anchors(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the pieces that fill buf up to `ends`: per anchor its position, first and last window, gram hash, context
    hash, and leading token as a number that sorts like its bytes."""
    w = _words(buf)
    h = _grams(w)
    m = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    for k in (1, 2, 4, 8, 16, 32):
        m = np.minimum(m[:-k], m[k:])
    m = np.minimum(m[: len(h) - WIDTH + 1], m[WIDTH - 64:])
    at = (m & _LOW).astype(np.int64)
    starts = np.append(0, ends[:-1])
    edge = np.zeros(len(at) + 1, np.int32)
    has = ends - starts >= SPAN
    np.add.at(edge, starts[has], 1)
    np.add.at(edge, np.minimum(ends[has] - SPAN + 1, len(at)), -1)
    valid = np.cumsum(edge)[:-1] > 0
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    lo = np.flatnonzero(new)
    piece = np.searchsorted(ends, lo, "right")
    hi = np.minimum(np.append(lo[1:], len(at)) - 1, ends[piece] - SPAN)
    a = at[lo]
    stop = hi + SPAN
    ctx = h[stop - GRAM] ^ ((a - lo).astype(np.uint64) << np.uint64(8)) ^ (hi - lo).astype(np.uint64)
    for j in range(0, SPAN + WIDTH, GRAM):
        p = lo + j
        use = p + GRAM <= stop
        ctx = np.where(use, _turn(ctx, 23) * _C[2] ^ h[np.where(use, p, 0)], ctx)
    return a, lo, hi, h[a], ctx * _C[1], w[a].byteswap(), piece


def _blocks(batch: pa.RecordBatch):
    """(buffer, ends, doc ids, offsets) of pieces, about BLOCK bytes at a time."""
    parts: list[bytes] = []
    doc: list[int] = []
    off: list[int] = []
    size = 0

    def full():
        buf = np.frombuffer(b"".join(parts), np.uint8)
        return buf, np.cumsum([len(x) for x in parts]), np.array(doc, np.int64), np.array(off, np.int64)

    for d, t, k in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("__k").to_pylist()):
        raw = t.as_buffer() if t.is_valid else None
        if d is None or raw is None or raw.size < SPAN:
            continue
        raw = raw.to_pybytes()
        for s in range(0, len(raw) - SPAN + 1, PIECE):
            parts.append(raw[s:s + PIECE + SPAN - 1])
            doc.append(d)
            off.append(k * TEXT + s)
            size += len(parts[-1])
            if size >= BLOCK:
                yield full()
                parts, doc, off, size = [], [], [], 0
    if parts:
        yield full()


def _tied(*keys: np.ndarray) -> np.ndarray:
    """For sorted keys: whether each row equals the row before it in all of them."""
    same = np.zeros(len(keys[0]), bool)
    if len(same):
        same[1:] = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
    return same


def multikey_order(first: np.ndarray, *rest: np.ndarray) -> np.ndarray:
    """The order by first, then rest: only runs that tie in the first key are sorted by the others."""
    order = np.argsort(first, kind="stable")
    tie = _tied(first[order])
    run = tie.copy()
    run[:-1] |= tie[1:]
    at = np.flatnonzero(run)
    sub = order[at]
    order[at] = sub[np.lexsort((*[k[sub] for k in reversed(rest)], first[sub]))]
    return order


def _deal(lead: np.ndarray, h: np.ndarray, ctx: np.ndarray, splits: tuple[np.ndarray, ...]) -> np.ndarray:
    """The bucket of each suffix: how many splitters (token, hash) are not above it; a hot anchor goes to all buckets by its
    context."""
    out = np.searchsorted(splits[0], lead, "left")
    right = np.searchsorted(splits[0], lead, "right")
    for v in np.unique(lead[out < right]):
        s, e = np.searchsorted(splits[0], v, "left"), np.searchsorted(splits[0], v, "right")
        i = np.flatnonzero(lead == v)
        out[i] = s + np.searchsorted(splits[1][s:e], h[i], "right")
    hot = np.isin(h, splits[2])
    out[hot] = (ctx[hot] % np.uint64(len(splits[0]) + 1)).astype(np.int64)
    return out


FIELDS = (("h", np.uint64), ("ctx", np.uint64), ("doc", np.int64), ("lo", np.int64), ("la", np.uint8), ("n", np.uint8))
_DEALT = "bucket int, " + ", ".join(f"{f} binary" for f, _ in FIELDS)
_MARKS = "doc_id long, h long, lo long, n int, la int"


def _repeats(r: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Rows in suffix order; which repeat an earlier equal context; which are the first of their context."""
    o = multikey_order(r["h"], r["ctx"], r["doc"], r["lo"])
    r = {k: v[o] for k, v in r.items()}
    again = _tied(r["h"], r["ctx"])
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(o)))) if len(o) else np.empty(0, int)
    moved = again & ((r["doc"] != r["doc"][first]) | (r["lo"] != r["lo"][first]))  # a repeated row is no repeat
    return r, moved, ~again


def _splitters(docs: DataFrame, buckets: int) -> tuple[np.ndarray, ...]:
    """Leading tokens and hashes that cut the order of suffixes into buckets, and the hashes of hot anchors."""
    n = docs.count()

    def some(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for buf, ends, *_ in _blocks(b):
                _, _, _, h, _, lead, _ = anchors(buf, ends)
                yield pa.RecordBatch.from_arrays([pa.array(lead[::16].view(np.int64)), pa.array(h[::16].view(np.int64))], ["lead", "h"])

    took = docs.sample(min(1.0, 4000 / max(n, 1)), seed=7).mapInArrow(releasing(some), "lead long, h long")
    rows = took.orderBy(F.xxhash64("lead", "h")).limit(SAMPLE).collect()
    both = np.array([(r["lead"], r["h"]) for r in rows], np.int64).reshape(-1, 2).view(np.uint64)
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    cut = both[(np.arange(1, buckets) * len(both)) // buckets] if len(both) else both
    seen, often = np.unique(both[:, 1], return_counts=True)
    return cut[:, 0].copy(), cut[:, 1].copy(), seen[often >= HOT]


def _dealt(docs: DataFrame, splits) -> DataFrame:
    """Anchors by bucket as packed arrays; each flush has collapsed equal contexts to the first and says which go
    (bucket -1 - b)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        count = 0

        def flush():
            r = {f: np.concatenate([x[f] for x in held]) for f in held[0]}
            r, moved, first = _repeats(r)
            rows = []
            gone = {f: r[f][moved] for f, _ in FIELDS}
            if moved.any():
                rows.append((-1 - int(gone["doc"][0] % (len(splits[0]) + 1)), gone))
            kept = {f: r[f][first] for f in r}
            bucket = _deal(kept["lead"], kept["h"], kept["ctx"], splits)
            o = np.lexsort((kept["lo"], kept["doc"], bucket))
            cuts = np.flatnonzero(np.diff(bucket[o])) + 1
            for part in np.split(o, cuts):
                rows.append((int(bucket[part[0]]), {f: kept[f][part] for f, _ in FIELDS}))
            return pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in rows], pa.int32())} | {
                f: pa.array([x[f].astype(t).tobytes() for _, x in rows], pa.binary()) for f, t in FIELDS})

        for b in parts:
            for buf, ends, doc, off in _blocks(b):
                a, lo, hi, h, ctx, lead, piece = anchors(buf, ends)
                start = np.append(0, ends[:-1])[piece]
                held.append({"h": h, "ctx": ctx, "lead": lead, "doc": doc[piece], "lo": lo - start + off[piece], "la": (a - lo).astype(np.uint8), "n": (hi - lo).astype(np.uint8)})
                count += len(a)
                if count >= FLUSH:
                    yield flush()
                    held, count = [], 0
        if count:
            yield flush()

    return docs.mapInArrow(releasing(run), _DEALT)


def _marks(dealt: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Per bucket: windows that go (h null), and one copy of each context of an anchor that has several or is hot (h set)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {f: [] for f, _ in FIELDS}
        for b in parts:
            for i, bucket in enumerate(b.column("bucket").to_pylist()):
                got = {f: np.frombuffer(b.column(f)[i].as_py(), t) for f, t in FIELDS}
                if bucket < 0:
                    yield rows(got, np.ones(len(got["h"]), bool), False)
                else:
                    for f, v in got.items():
                        held[f].append(v)
        if held["h"]:
            r, moved, first = _repeats({f: np.concatenate(v) for f, v in held.items()})
            yield rows(r, moved, False)
            r = {f: v[first] for f, v in r.items()}
            tie = _tied(r["h"])
            tie[:-1] |= tie[1:]
            yield rows(r, tie | np.isin(r["h"], hot), True)

    def rows(r, which, open_):
        h = pa.array(r["h"][which].view(np.int64)) if open_ else pa.nulls(int(which.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(r["doc"][which]), h, pa.array(r["lo"][which]), pa.array(r["n"][which].astype(np.int32)), pa.array(r["la"][which].astype(np.int32))], ["doc_id", "h", "lo", "n", "la"])

    to = F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))
    return dealt.repartitionById(buckets, to.cast("int")).mapInArrow(releasing(run), _MARKS)


def _window_hashes(count: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """A hash of each window of each context, contexts in turn: prefix sums brought to one power, so that equal windows
    at different places agree."""
    odd = 0x5851F42D4C957F2D
    size = max(map(len, texts))
    power = np.cumprod(np.full(size, np.uint64(odd)))
    back = np.cumprod(np.full(size, np.uint64(pow(odd, -1, 1 << 64))))
    out = []
    for s in range(0, len(texts), 2048):
        some = texts[s:s + 2048]
        grid = np.zeros((len(some), size + 1), np.uint64)
        for i, x in enumerate(some):
            grid[i, 1:len(x) + 1] = np.frombuffer(x, np.uint8)
        np.cumsum((grid[:, 1:] + np.uint64(1)) * power, axis=1, out=grid[:, 1:])
        last = size - SPAN + 1
        every = (grid[:, SPAN:SPAN + last] - grid[:, :last]) * back[:last]
        out.append(every[np.arange(last) < count[s:s + 2048, None]])
    return np.concatenate(out)


def window_repeats(h, doc, lo, n, la, texts: list[bytes], most: int = 500_000) -> tuple[np.ndarray, ...]:
    """Of contexts grouped by anchor: the windows (doc, start) that repeat one at an earlier place in their group.
    Windows that lie differently around their anchor are never equal, so many are sorted apart by that offset."""
    count = n.astype(np.int64) + 1
    got = _window_hashes(count, texts) if len(texts) else np.empty(0, np.uint64)
    rep = np.repeat(np.arange(len(n), dtype=np.int32), count)
    i = (np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint8)
    left = la.astype(np.int16)[rep] - i
    slices = [np.arange(len(rep))] if len(rep) <= most else (np.flatnonzero(left == v) for v in range(WIDTH))
    docs, starts = [], []
    for s in slices:
        r, at = rep[s], lo[rep[s]] + i[s]
        d, hr = doc[r], h[r]
        o = multikey_order(got[s] ^ (hr.view(np.uint64) * _C[0]), left[s], d, at)
        same = _tied(got[s][o], hr[o], left[s][o])
        first = o[np.maximum.accumulate(np.where(same, 0, np.arange(len(o))))] if len(o) else o
        for x in np.flatnonzero(same).tolist():  # two different windows may have one hash: each is judged by its own bytes
            window = lambda k: texts[r[k]][i[s[k]]:i[s[k]] + SPAN]  # noqa: E731, B023
            if window(o[x]) != window(first[x]):
                run = x - 1
                while same[run] and window(o[run]) != window(o[x]):
                    run -= 1
                first[x] = first[run] if window(o[run]) == window(o[x]) else o[x]
        gone = same & ((d[o] != d[first]) | (at[o] != at[first]))
        docs.append(d[o][gone])
        starts.append(at[o][gone])
    return np.concatenate(docs), np.concatenate(starts)


def slices(h: int, lo: int, n: int, la: int, raw: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """A hot anchor's context in slices of windows, by their offset from the anchor. All windows of a slice share its core,
    so equal ones are in slices of equal cores, and a hash of the core deals them out as a key of their own."""
    first = 0
    while first <= n:
        part = (la - first) // SLICE
        last = min(n, la - part * SLICE)
        core = raw[lo + la - part * SLICE:lo + la - (part + 1) * SLICE + 1 + SPAN]
        key = int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=part.to_bytes(2, "little"), key=(h & (1 << 64) - 1).to_bytes(8, "little")).digest(), "little", signed=True)
        yield key, lo + first, last - first, la - first, raw[lo + first:lo + last + SPAN]
        first = last + 1


def _open_windows(docs: DataFrame, marks: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """The windows of several-context anchors that repeat earlier ones: (doc_id, lo, n)."""
    split = set(hot.view(np.int64).tolist())
    want = marks.filter("h is not null").groupBy("doc_id").agg(F.collect_list(F.struct("h", "lo", "n", "la")).alias("want"))

    def fetch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for t, d, k, want in zip(b.column("text"), b.column("doc_id").to_pylist(), b.column("__k").to_pylist(), b.column("want")):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                rows = []
                for h, lo, n, la in zip(*(want.values.field(c).to_pylist() for c in ("h", "lo", "n", "la"))):
                    if lo // TEXT == k:
                        at = lo - k * TEXT
                        rows += [(x, y + k * TEXT, *z) for x, y, *z in (slices(h, at, n, la, raw) if h in split else [(h, at, n, la, raw[at:at + n + SPAN])])]
                if not rows:
                    continue
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), d)), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", "h", "lo", "n", "la", "bytes"])

    def settle(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def out(t: pa.Table):
            col = lambda c: t.column(c).to_numpy()
            d, at = window_repeats(col("h"), col("doc_id"), col("lo"), col("n"), col("la"), t.column("bytes").to_pylist())
            o = np.lexsort((at, d))
            d, at = d[o], at[o]
            new = np.append(True, (d[1:] != d[:-1]) | (at[1:] > at[:-1] + 1)) if len(d) else np.empty(0, bool)
            s = np.flatnonzero(new)
            e = np.append(s[1:], len(d))[:len(s)] - 1
            return pa.RecordBatch.from_arrays([pa.array(d[s]), pa.array(at[s]), pa.array((at[e] - at[s]).astype(np.int32))], ["doc_id", "lo", "n"])

        for b in parts:
            held.append(b)
            count += len(b)
            if count >= 10_000:  # whole anchors only; the last one may go on
                t = pa.Table.from_batches(held)
                h = t.column("h").to_numpy()
                cut = int(np.searchsorted(h, h[-1]))
                if cut:
                    yield out(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                count = len(t) - cut
        if count:
            yield out(pa.Table.from_batches(held))

    got = docs.select("doc_id", "text", "__k").join(want, "doc_id").mapInArrow(releasing(fetch), "doc_id long, h long, lo long, n int, la int, bytes binary")
    return got.repartition(buckets, "h").sortWithinPartitions("h").mapInArrow(releasing(settle), "doc_id long, lo long, n int")


def _marked(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """docs with __has: true for every doc_id in marks, and for few others. marks become a bitmap of FILTER_BITS over hashes of
    doc_id, 64 bits a row, so what is broadcast has at most FILTER_BITS / 64 rows."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("__x")
    bits = marks.select(bit).groupBy(F.shiftright("__x", 6).alias("__w")).agg(F.expr("bit_or(shiftleft(1L, cast(__x & 63 as int)))").alias("__m"))
    found = docs.withColumn("__x", bit).join(F.broadcast(bits), F.shiftright("__x", 6) == F.col("__w"), "left")
    return found.withColumn("__has", F.expr("coalesce(shiftright(__m, cast(__x & 63 as int)) & 1 = 1, false)")).drop("__x", "__w", "__m")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, __k) -> (doc_id, spans array<struct<lo long, n int>>): byte windows lo..lo+n of 100 bytes each
    that occur at an earlier place. Documents without any are left out."""
    spark = docs.sparkSession
    buckets = partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "__k")
    splits = _splitters(docs, buckets)
    marks = materialize(_marks(_dealt(docs, splits), buckets, splits[2]))
    open_ = marks.filter("h is not null")
    more = materialize(_open_windows(_marked(docs, open_).filter("__has"), marks, buckets, splits[2]))
    spans = marks.filter("h is null").select("doc_id", "lo", "n").union(more)
    out = materialize(spans.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n")).alias("spans")))
    discard(marks)
    discard(more)
    return out


def keep_mask(size: int, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which of `size` bytes no span covers."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, lo, 1)
    np.add.at(edge, lo + n + SPAN, -1)
    return np.cumsum(edge)[:-1] == 0


def _with_spans(docs: DataFrame) -> DataFrame:
    """docs with columns __k and __spans; only documents that may have spans are shuffled."""
    docs = _numbered(docs)
    spans = repeated_spans(docs).withColumnRenamed("spans", "__spans")
    docs = _marked(docs, spans)
    none = F.lit(None).cast(spans.schema["__spans"].dataType).alias("__spans")
    key = spans.withColumnRenamed("doc_id", "__id")
    some = docs.filter("__has").join(key, F.col("doc_id") == F.col("__id"), "left").drop("__id")
    return some.unionByName(docs.filter("not __has").select("*", none)).drop("__has")


def _cut(t, spans, k: int) -> tuple[bytes, np.ndarray | None]:
    raw = t.as_buffer().to_pybytes() if t.is_valid else b""
    if not spans.is_valid:
        return raw, None
    lo, n = spans.values.field("lo").to_numpy(), spans.values.field("n").to_numpy().astype(np.int64)
    mine = lo // TEXT == k
    return raw, keep_mask(len(raw), lo[mine] - k * TEXT, n[mine])


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with __k, the number of a row's text among the different texts of its doc_id in their order: 0 but where an id
    has several. Equal ids are one document of several parts, whose k-th part starts at k * TEXT."""
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    twice = materialize(ids.filter("a <> b").select(F.col("doc_id").alias("__twice")))
    if twice.isEmpty():
        return docs.withColumn("__k", F.lit(0).cast("long"))
    marked = docs.join(twice, F.col("doc_id") == F.col("__twice"), "left")
    order = Window.partitionBy("__twice").orderBy(F.coalesce("text", F.lit("")))
    several = marked.filter("__twice is not null").withColumn("__k", (F.dense_rank().over(order) - 1).cast("long"))
    return several.unionByName(marked.filter("__twice is null").withColumn("__k", F.lit(0).cast("long"))).drop("__twice")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string).

    A byte goes if a 100-byte string over it also starts earlier: in a smaller doc_id, or earlier in the same text.
    Null text counts as empty. Rows of equal id are each returned; equal texts of one id are one text, and different ones
    follow each other in their order as parts of one document, across which nothing matches. Rows with a null id match
    nothing and keep all. Texts under 100 bytes keep all. Other columns are
    ignored. An empty table gives an empty one."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = []
            for t, spans, k in zip(b.column("text"), b.column("__spans"), b.column("__k").to_pylist()):
                raw, keep = _cut(t, spans, k)
                runs = gone = 0
                if keep is not None:
                    gone = len(keep) - int(keep.sum())
                    runs = int((~keep[:1]).sum() + (keep[:-1] & ~keep[1:]).sum())
                left = raw if not gone else np.frombuffer(raw, np.uint8)[keep].tobytes()
                rows.append((len(raw), gone, runs, hashlib.sha256(left).hexdigest()))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _with_spans(docs).mapInArrow(releasing(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated bytes cut from text (all columns kept). What a cut leaves of a multi-byte character goes
    with it; n_chars, where there is such a column, is counted anew (null for a null text).

    Null texts stay null; rows with a null doc_id stay whole; rows of equal doc_id are as in suffix_dedup(); an empty table
    stays empty."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts = []
            for t, spans, k in zip(b.column("text"), b.column("__spans"), b.column("__k").to_pylist()):
                raw, keep = _cut(t, spans, k)
                texts.append(t.as_py() if keep is None or keep.all() else np.frombuffer(raw, np.uint8)[keep].tobytes().decode("utf-8", "ignore"))
            names = [c for c in b.schema.names if c not in ("__spans", "__k")]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names], names)

    out = _with_spans(docs).mapInArrow(releasing(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
