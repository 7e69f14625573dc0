"""Language-model scores by online logistic context mixing over the bits of words.

A text is its lower-cased words and one end. The first bit of a token says whether the training text knows the word;
training words that occur once tell how often it does not. A known word is then told from all other known words by the
bits of its bytes at which they part (a bit that all known words of one beginning share costs nothing). Such a bit is
predicted from three hashed contexts: its beginning, its beginning after the class of what came before, and the last
four bytes. The class is the last of the CLASSES - 1 commonest words that the text has had, so it reaches over any
number of words. An unknown word is spelled, bit by bit, from its last one to five bytes and the class. The predictions of a
bit are mixed in the logistic domain by weights that a gate (how often its contexts were seen) selects, and an adaptive
table refines the sum. Last, the words that a text has had so far adapt the chance of a word to have it again.

Each kind of bit depends on few numbers, so the work is done per distinct (beginning, class) and not per token. Chunks
of documents (about CHUNK bytes) keep their distinct entries (word, class); a bucket (a range of the order of words, cut
at beginnings only) sums the counts of all chunks and sends counts and scores back to them. Beginnings above the cuts are
few and their totals are summed over buckets. So every count covers all training text and grows with it, however it is
partitioned. The mixers learn online from a bounded grid of exact sums: how often each bit followed each state of its
inputs, the bit's own occurrence left out. Sums of whole numbers are exact, so weights and scores do not depend on
partitions either.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from bisect import bisect_right as bisect
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import Shared, fold, materialize, partitions, releasing

CHUNK = 10 << 20
#: Classes of what came before; beginnings that may be opened for the cuts of the order of words, their longest in bytes (both
#: only even out buckets), bytes by which beginnings are made longer, and distinct words that a task counts before it sends them on.
CLASSES, OPEN, LONGEST, DEEPER, HELD = 16, 256, 32, 4, 500_000
#: Spelling: slots of each order's table (its size is bounded), bytes of context, entries of a step, of a step that counts,
#: slots in a row of partial tables, and such rows that one task sums.
SLOT_BITS, ORDERS, STEP, COUNTED, ROW, SUMMED = 20, (1, 2, 3, 4, 5), 4_096, 1 << 14, 1 << 15, 64
SLOTS = 1 << SLOT_BITS
#: Orders whose contexts hold the class too, and the order that also predicts the bits of known words.
CLASSED, SHARED = 2, 4
#: Distinct entries that one task takes; the most that a text's own words weigh.
TASK_ENTRIES, REPEAT = 1_000_000, 0.1
_END, _STOP = b"\t", 0x20
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Grid:
    """States of a mixer's inputs: each log odds in steps, and a gate. Cells of the grid are numbered."""

    def __init__(self, gates: int, steps: tuple[float, ...], most: tuple[float, ...]):
        self.gates, self.steps, self.most = gates, np.array(steps), np.array(most)
        self.half = np.rint(self.most / self.steps).astype(np.int64)
        self.cells = gates * int(np.prod(2 * self.half + 1))

    def cell(self, inputs: np.ndarray, gate: np.ndarray) -> np.ndarray:
        at = gate.astype(np.int64)
        for x, step, half in zip(inputs, self.steps, self.half):
            at = at * (2 * half + 1) + np.clip(np.rint(x / step), -half, half).astype(np.int64) + half
        return at

    def state(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs at the middle of cells, and gates."""
        out = []
        for step, half in zip(self.steps[::-1], self.half[::-1]):
            at, k = np.divmod(at, 2 * half + 1)
            out.append((k - half) * step)
        return np.array(out[::-1]), at


#: Known words: log odds of the beginning, of beginning and class, of the last four bytes. Spelling: those of each order.
KNOWN = Grid(24, (0.5, 0.5, 1.0), (9.5, 9.5, 6.0))
SPELLED = Grid(12, (1.5,) * len(ORDERS), (6.0,) * len(ORDERS))


class Mixer:
    """Weights of a grid's inputs (and of 1) by gate, and a table that refines their sum."""

    LEVELS = 32

    def __init__(self, grid: Grid):
        self.grid = grid
        self.weights = np.full((grid.gates, len(grid.steps) + 1), 1 / len(grid.steps))
        self.weights[:, -1] = 0
        self.refined = np.zeros((grid.gates, self.LEVELS))

    @classmethod
    def learned(cls, grid: Grid, cells: np.ndarray, n0: np.ndarray, n1: np.ndarray, passes: int = 4, batch: int = 2048) -> Mixer:
        """Online: batches of cells (in a fixed random order) each move the weights of their gates by the curvature seen so
        far; the weights of the shortest code of all passes stay."""
        out = cls(grid)
        if not len(cells):
            return out
        o = np.argsort((cells.astype(np.uint64) * _K[0]) ^ (cells.astype(np.uint64) >> np.uint64(7)), kind="stable")
        x, gate = grid.state(cells[o])
        x = np.vstack([x, np.ones(len(o))])
        n0, n1 = n0[o], n1[o]
        size, best = len(x), (np.inf, out.weights.copy())
        w = out.weights
        for k in range(passes + 1):
            p = _sigmoid(out.mixed(x, gate))
            cost = -float(n1 @ np.log(p) + n0 @ np.log1p(-p))
            if cost < best[0]:
                best = (cost, w.copy())
            if k == passes:
                break
            bend = np.tile(np.eye(size) * 4, (grid.gates, 1, 1))
            for s in range(0, len(o), batch):
                xs, g, a0, a1 = x[:, s:s + batch], gate[s:s + batch], n0[s:s + batch], n1[s:s + batch]
                p = _sigmoid(out.mixed(xs, g))
                miss, curve = a1 * (1 - p) - a0 * p, (a0 + a1) * np.maximum(p * (1 - p), 0.01)
                slope = np.stack([np.bincount(g, miss * i, grid.gates) for i in xs], 1)
                for i in range(size):
                    for j in range(i, size):
                        b = np.bincount(g, curve * xs[i] * xs[j], grid.gates)
                        bend[:, i, j] += b
                        if i != j:
                            bend[:, j, i] += b
                w += np.clip(np.linalg.solve(bend, slope[..., None])[..., 0], -0.3, 0.3)
        out.weights = best[1]
        v = out.mixed(x, gate)
        p = _sigmoid(v)
        at = gate * cls.LEVELS + out._level(v)
        sums = [np.bincount(at, y, grid.gates * cls.LEVELS) + 8 for y in (n1, n0, (n0 + n1) * p, (n0 + n1) * (1 - p))]
        out.refined = (np.log(sums[0] / sums[1]) - np.log(sums[2] / sums[3])).reshape(grid.gates, -1)
        return out

    @classmethod
    def _level(cls, v: np.ndarray) -> np.ndarray:
        return np.clip((v + 12) * (cls.LEVELS / 24), 0, cls.LEVELS - 1).astype(np.int64)

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        v = self.weights[gate, -1]
        for k in range(len(self.grid.steps)):
            v = v + self.weights[gate, k] * x[k]
        return np.clip(v, -12, 12)

    def log10(self, x: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the probabilities of bit 0 and bit 1."""
        v = self.mixed(x, gate)
        v = v + self.refined[gate, self._level(v)]
        return -np.logaddexp(0, v) / np.log(10), -np.logaddexp(0, -v) / np.log(10)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-v))


def _odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.4) / (n0 + 0.4))


def ended(word: bytes) -> bytes:
    """A word with its terminator; no such word begins another."""
    return word if word == _END else word + b" "


def encode(texts: list[str | None], train: np.ndarray, common: dict[bytes, int]) -> dict:
    """Tokens of texts as places among their distinct entries (word, class), which are in order; counts of entries in
    training texts."""
    vocab: defaultdict = defaultdict()
    vocab.default_factory = vocab.__len__
    words = [(t or "").encode().lower().split() for t in texts]
    n = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    get = vocab.__getitem__
    ids = np.empty(int(n.sum()), np.int64)
    at = 0
    for w in words:
        ids[at:at + len(w)] = np.fromiter(map(get, w), np.int64, len(w))
        at += len(w) + 1
        ids[at - 1] = get(_END)
    del words
    names = [ended(w) for w in vocab]
    order = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    kind = np.fromiter((common.get(w, 0) for w in vocab), np.int64, len(names))[ids]
    last = np.append(-1, np.maximum.accumulate(np.where(kind > 0, np.arange(len(ids)), -1)))[:-1]
    start = np.repeat(np.cumsum(n) - n, n)
    key = rank[ids] * CLASSES + np.where(last >= start, kind[last], 0)
    used = np.zeros(len(names) * CLASSES, bool)
    used[key] = True
    token = (np.cumsum(used) - 1)[key]
    entries = np.flatnonzero(used)
    return {"names": [names[i] for i in order.tolist()], "word": entries // CLASSES, "cls": (entries % CLASSES).astype(np.uint8), "token": token, "n": n,
            "taught": np.bincount(token[np.repeat(train, n)], minlength=len(entries))}


def split(e: dict, splits: list[bytes]) -> list[tuple]:
    """Per bucket: its number, its first entry, words, entries of each word, classes, counts."""
    names, word = e["names"], e["word"]
    owner = np.fromiter((bisect(splits, w) for w in names), np.int64, len(names))
    per = np.bincount(word, minlength=len(names)).astype(np.uint8)
    cuts = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(names))
    first = np.searchsorted(word, cuts)
    return [(int(owner[s]), int(a), b"\n".join(names[s:t]), per[s:t].tobytes(), e["cls"][a:b].tobytes(), e["taught"][a:b].astype(np.uint32).tobytes())
            for s, t, a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), first[:-1].tolist(), first[1:].tolist())]


def opened(words: list[bytes], buckets: int) -> set[bytes]:
    """Beginnings to look behind, so that each beginning that is none of them has few words; _seen_words finds the same by
    counting."""
    out: set[bytes] = set()
    heap = [(-len(words), b"", words)]
    while heap and len(out) < OPEN:
        n, begin, some = heapq.heappop(heap)
        if -n * 4 * buckets <= len(words) and out:
            break
        by: defaultdict = defaultdict(list)
        for w in some:
            if len(w) > len(begin):
                by[w[:len(begin) + 1]].append(w)
        out.add(begin)
        for k, ws in by.items():
            heapq.heappush(heap, (-len(ws), k, ws))
    return out


def group_of(word: bytes, open_: set[bytes]) -> bytes:
    """The shortest beginning of a word that is not opened."""
    k = 0
    while k < len(word) and word[:k] in open_:
        k += 1
    return word[:k]


def grouped(words: list[bytes], open_: set[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Of words in order: their distinct beginnings that are not opened, and the first word of each."""
    tops, starts, i = [], [], 0
    while i < len(words):
        tops.append(group_of(words[i], open_))
        starts.append(i)
        size = len(tops[-1])
        i = bisect(words, tops[-1], i, key=lambda w: w[:size])  # noqa: B023
    return tops, np.array(starts, np.int64)


def _counted(docs: DataFrame) -> DataFrame:
    """(w binary, n long): how often each word occurs in all texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in parts:
            for t in b.column("text"):
                c.update((t.as_py() or "").encode().lower().split())
                if len(c) >= HELD:
                    yield _sent(c)
                    c.clear()
        yield _sent(c)

    return docs.select("text").mapInArrow(releasing(run), "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _sent(c: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["w", "n"])


def _begun(words: DataFrame, size: int) -> DataFrame:
    """(w binary, n long): how many words have each beginning of that many bytes (shorter words: each whole)."""
    return words.groupBy(F.substring("w", 1, size).alias("w")).agg(F.count("*").alias("n"))


def _often(words: DataFrame, least: float) -> list[bytes]:
    """The OPEN - 1 most frequent beginnings of up to LONGEST bytes that more than `least` words have. A beginning has no more
    words than what it begins with, so longer ones are counted, DEEPER bytes at a time, among words of frequent ones only."""
    found, some, k = [], words, 0
    while k < LONGEST:
        to = min(k + DEEPER, LONGEST)
        each = _begun(some, to).select(F.explode(F.array(*(F.when(F.length("w") >= j, F.substring("w", 1, j)) for j in range(k + 1, to + 1)))).alias("w"), "n")
        often = each.filter("w is not null").groupBy("w").agg(F.sum("n").alias("n")).filter(F.col("n") > least).orderBy(F.desc("n"), "w").limit(OPEN - 1).collect()
        found += [(-r["n"], bytes(r["w"])) for r in often]
        heads = [bytes(r["w"]) for r in often if len(r["w"]) == to]
        if not heads:
            break
        some = some.filter(F.substring("w", 1, to).isin(heads))
        k = to
    return [w for _, w in sorted(found)[:OPEN - 1]]


def _seen_words(docs: DataFrame, buckets: int) -> tuple[dict[bytes, int], list[bytes], set[bytes]]:
    """Of all training text: the commonest words, beginnings that cut the order of words into buckets, and the beginnings
    opened for that, those that more than their share of distinct words have. Words are counted by tasks; the driver gets the
    commonest ones and the counts of beginnings."""
    counts = materialize(_counted(docs.filter(~F.col("held"))))
    common = {bytes(r["w"]): k + 1 for k, r in enumerate(counts.orderBy(F.desc("n"), "w").limit(CLASSES - 1).collect())}
    total = counts.count()
    if not total:
        return common, [], set()
    words = counts.select(F.concat("w", F.lit(b" ")).alias("w"))  # as ended() has them
    open_ = {b"", *_often(words, total / (4 * buckets))}

    def group(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in parts:
            for w, n in zip(b.column("w").to_pylist(), b.column("n").to_pylist()):
                c[group_of(w, open_)] += n
        yield _sent(c)

    found = _begun(words, max(map(len, open_)) + 1).mapInArrow(releasing(group), "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    groups = sorted((bytes(r["w"]), r["n"]) for r in found.collect())
    upto = np.cumsum([n for _, n in groups])
    return common, sorted({groups[int(np.searchsorted(upto, total * k // buckets, "right"))][0] for k in range(1, buckets)}), open_


_CHUNKS = "chunk string, ids array<long>, held array<boolean>, n binary, planes array<binary>, buckets array<struct<bucket:int,start:int,words:binary,per:binary,cls:binary,taught:binary>>"


def _chunks(docs: DataFrame, common: dict[bytes, int], splits: list[bytes]) -> DataFrame:
    """Rows of about CHUNK bytes of documents: token planes and distinct entries by bucket."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, texts, size = [], [], [], 0

        def row():
            e = encode(texts, np.array([h is False for h in held]), common)
            planes = [((e["token"] >> s) & 255).astype(np.uint8).tobytes() for s in (0, 8, 16, 24)]
            name = hashlib.md5(repr((ids, e["n"].tolist())).encode()).hexdigest() + f"-{zlib.crc32(planes[0]):08x}"
            rows = [dict(zip(("bucket", "start", "words", "per", "cls", "taught"), r)) for r in split(e, splits)]
            return pa.RecordBatch.from_pylist([{"chunk": name, "ids": ids, "held": held, "n": e["n"].tobytes(), "planes": planes, "buckets": rows}], schema)

        for b in parts:
            for i, t, h in zip(*(b.column(c) for c in ("doc_id", "text", "held"))):
                t = t.as_py()
                ids.append(i.as_py())
                held.append(h.as_py())
                texts.append(t)
                size += len(t or "") + 64
                if size >= CHUNK:
                    yield row()
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield row()

    bucket = pa.struct([("bucket", pa.int32()), ("start", pa.int32()), *((c, pa.binary()) for c in ("words", "per", "cls", "taught"))])
    schema = pa.schema([("chunk", pa.string()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n", pa.binary()), ("planes", pa.list_(pa.binary())), ("buckets", pa.list_(bucket))])
    return docs.mapInArrow(releasing(run), _CHUNKS)


_WORDS = "words binary, per binary, cls binary, taught binary, refs array<struct<chunk:string,start:int,idx:binary>>, n long, v long, entries long, by_class binary, lone binary, groups array<struct<name:binary,n:binary,m:binary>>"


def _vocabulary(chunks: DataFrame, buckets: int, open_: set[bytes]) -> DataFrame:
    """A row per bucket: its distinct words and entries with training counts, where each chunk's entries are among them,
    totals by class (all, and of words that occur once), and totals of its beginnings by class (all, and of other words)."""
    ref = pa.struct([("chunk", pa.string()), ("start", pa.int32()), ("idx", pa.binary())])
    total_ = pa.struct([("name", pa.binary()), ("n", pa.binary()), ("m", pa.binary())])
    schema = pa.schema([*((c, pa.binary()) for c in ("words", "per", "cls", "taught")), ("refs", pa.list_(ref)), *((c, pa.int64()) for c in ("n", "v", "entries")),
                        ("by_class", pa.binary()), ("lone", pa.binary()), ("groups", pa.list_(total_))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: defaultdict = defaultdict()
        index.default_factory = index.__len__
        total = np.zeros(0, np.int64)
        refs = []
        for b in parts:
            for r in b.to_pylist():
                words = r["words"].split(b"\n")
                w = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                key = np.repeat(w, np.frombuffer(r["per"], np.uint8)) * CLASSES + np.frombuffer(r["cls"], np.uint8)
                if CLASSES * len(index) > len(total):
                    total = np.concatenate([total, np.full(CLASSES * len(index) + len(total) // 2 - len(total), -1)])
                total[key] = np.maximum(total[key], 0) + np.frombuffer(r["taught"], np.uint32)  # a row holds an entry once
                refs.append((r["chunk"], r["start"], key))
        if not refs:
            return
        names = list(index)
        order = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
        names = [names[i] for i in order.tolist()]
        total = total[:CLASSES * len(names)].reshape(-1, CLASSES)[order]
        used = total >= 0
        place = np.empty((len(names), CLASSES), np.int64)
        place[order] = (np.cumsum(used.ravel()) - 1).reshape(-1, CLASSES)
        place = place.ravel()
        total = np.maximum(total, 0)
        known = total.sum(1)
        at = np.flatnonzero(known)
        tops, starts = grouped([names[i] for i in at.tolist()], open_)
        starts = at[starts]
        sums = np.add.reduceat(total, starts) if len(starts) else total[:0]
        more = np.add.reduceat(np.where(known[:, None] > 1, total, 0), starts) if len(starts) else total[:0]
        yield pa.RecordBatch.from_pylist([{
            "words": b"\n".join(names), "per": used.sum(1).astype(np.uint8).tobytes(), "cls": (np.flatnonzero(used) % CLASSES).astype(np.uint8).tobytes(),
            "taught": total[used].astype(np.uint64).tobytes(), "refs": [{"chunk": c, "start": s, "idx": place[k].astype(np.uint32).tobytes()} for c, s, k in refs],
            "n": int(known.sum()), "v": int((known > 0).sum()), "entries": int(used.sum()), "by_class": total.sum(0).astype(np.int64).tobytes(),
            "lone": total[known == 1].sum(0).astype(np.int64).tobytes(),
            "groups": [{"name": g, "n": a.astype(np.int64).tobytes(), "m": b.astype(np.int64).tobytes()} for g, a, b in zip(tops, sums, more)]}], schema)

    flat = chunks.select("chunk", F.explode("buckets").alias("b")).select("chunk", "b.*")
    return flat.repartitionById(buckets, F.col("bucket")).mapInArrow(releasing(run), _WORDS)


def _before(sym: np.ndarray, at: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The byte k before sym[at], which is byte `place` of its word."""
    return np.where(place >= k, sym[np.maximum(at - k, 0)], np.uint8(_STOP))


def _hashes(before: Callable[[int], np.ndarray], cls: np.ndarray, orders=ORDERS) -> dict[int, np.ndarray]:
    """Per order the hash of the bytes before, as before(k) gives them, and perhaps of the class."""
    h = np.zeros(len(cls), np.uint64)
    mark = (cls.astype(np.uint64) + np.uint64(1)) * _K[2]
    out = {}
    for k in range(1, max(orders) + 1):
        h = (h ^ before(k).astype(np.uint64)) * _K[0]
        h ^= h >> np.uint64(31)
        if k in orders:
            out[k] = (h + np.uint64(k) + (mark if k <= CLASSED else np.uint64(0))) * _K[1]
    return out


def _slots(h: np.ndarray, node: np.ndarray) -> np.ndarray:
    return (((h ^ (node.astype(np.uint64) * _K[2])) * _K[0]) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _bits(words: list[bytes], cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Per bit of words with terminators, laid out in turn: its word, its value, its slot in each order's table."""
    sym = np.frombuffer(b"".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(sym)) - np.repeat(np.cumsum(size) - size, size)
    at = np.arange(len(sym))
    hashes = _hashes(lambda k: _before(sym, at, place, k), cls[owner])
    j = np.arange(8)
    node = (1 << j) | (sym[:, None].astype(np.int64) >> (8 - j))
    bit = ((sym[:, None] >> (7 - j).astype(np.uint8)) & 1).astype(np.int64).ravel()
    return np.repeat(owner, 8), bit, [_slots(hashes[k][:, None], node).ravel() for k in ORDERS]


def _count_bits(words: list[bytes], cls: np.ndarray, tables: list[np.ndarray]) -> None:
    """Add the bits of words with terminators to each order's table, as _bits places them. Equal bytes after equal contexts
    are counted first: sorted keys (byte, class where it counts, bytes before) begin with those of shorter orders."""
    sym = np.frombuffer(b"".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    place, at = np.arange(len(sym)) - np.repeat(np.cumsum(size) - size, size), np.arange(len(sym))
    classes = np.repeat(cls, size).astype(np.uint64)
    byte = lambda key, k: (key >> np.uint64(8 * k)) & np.uint64(255)
    for orders, lead in (([k for k in ORDERS if k <= CLASSED], [sym, classes]), ([k for k in ORDERS if k > CLASSED], [sym])):
        key = np.zeros(len(sym), np.uint64)
        for x in [*lead, *(_before(sym, at, place, k) for k in range(1, max(orders) + 1))]:
            key = (key << np.uint64(8)) | x
        key.sort()
        n, held = np.ones(len(key)), max(orders)
        for k in sorted(orders, reverse=True):
            key, held = key >> np.uint64(8 * (held - k)), k
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
            key, n = key[new], np.add.reduceat(n, new) if len(new) else n
            h = _hashes(lambda j: byte(key, k - j), byte(key, k) if len(lead) > 1 else np.zeros(len(key)), (k,))[k]  # noqa: B023
            last = byte(key, k + len(lead) - 1).astype(np.int64)
            for j in range(8):
                np.add.at(tables[ORDERS.index(k)], 2 * _slots(h, (1 << j) | (last >> (8 - j))) + ((last >> (7 - j)) & 1), n)


def _spelled(tables: np.ndarray, slots: list[np.ndarray], bit: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and gates of spelled bits; own: occurrences of the bit itself to leave out."""
    x = np.empty((len(ORDERS), len(bit)))
    seen = []
    for k, (t, s) in enumerate(zip(tables, slots)):
        n0, n1 = t[2 * s].astype(np.float64), t[2 * s + 1].astype(np.float64)
        if own:
            n0, n1 = np.maximum(n0 - own * (1 - bit), 0), np.maximum(n1 - own * bit, 0)
        x[k] = _odds(n0, n1)
        seen.append(n0 + n1)
    return np.clip(x, -8, 8), np.searchsorted([1, 2, 4], seen[-1], "right") * 3 + np.searchsorted([1, 8], seen[ORDERS.index(SHARED)], "right")


class Bucket:
    """A row of the vocabulary: words, and entries (word, class) with training counts."""

    def __init__(self, row: dict):
        self.names = row["words"].split(b"\n")
        self.word = np.repeat(np.arange(len(self.names)), np.frombuffer(row["per"], np.uint8))
        self.cls = np.frombuffer(row["cls"], np.uint8).astype(np.int64)
        self.taught = np.frombuffer(row["taught"], np.uint64).astype(np.float64)
        self.known = np.bincount(self.word, self.taught, len(self.names))

    def steps(self, which: np.ndarray, step: int = 0) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
        """Runs of some entries, of about `step` (else STEP) at most: their numbers, words and classes."""
        start, at, step = 0, np.flatnonzero(which), step or STEP
        upto = np.cumsum(np.fromiter(map(len, self.names), np.int64, len(self.names))[self.word[at]])
        while start < len(at):
            stop = min(start + step, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + 10 * step)) + 1, len(at))
            part = at[start:stop]
            yield part, [self.names[i] for i in self.word[part].tolist()], self.cls[part]
            start = stop


def shared_bits(words: list[bytes], short: int = 24) -> np.ndarray:
    """The number of leading bits that each word shares with the word before it; -1 for the first."""
    out = np.full(len(words), -1, np.int64)
    if len(words) < 2:
        return out
    grid = np.array(words, f"S{short}").view(np.uint8).reshape(len(words), short)
    size = np.fromiter(map(len, words), np.int64, len(words))
    differ = grid[1:] != grid[:-1]
    first = differ.argmax(1)
    bits = np.bitwise_xor(grid[1:], grid[:-1])[np.arange(len(first)), first]
    out[1:] = 8 * first + 7 - np.frexp(bits.astype(np.float64))[1] + 1
    for i in np.flatnonzero(~differ.any(1) | (first >= np.minimum(size[1:], size[:-1]))).tolist():  # beyond the grid
        a, b = words[i], words[i + 1]
        k = next(k for k, (x, y) in enumerate(zip(a, b)) if x != y)
        out[i + 1] = 8 * k + 8 - (a[k] ^ b[k]).bit_length()
    return out


class Tree:
    """The bits at which words in order part. Node i parts word i - 1 from word i at bit lcp[i]; a negative lcp parts trees."""

    def __init__(self, lcp: np.ndarray):
        n = len(lcp)
        bits = [*lcp.tolist(), -1]
        low, high = [0] * (n + 1), [n] * (n + 1)
        stack: list[int] = []
        base = 0
        for j in range(n + 1):
            v = bits[j]
            while stack and bits[stack[-1]] > v:
                high[stack.pop()] = j
            if v < 0:
                base = j
            else:
                low[j] = stack[-1] if stack else base
                stack.append(j)
        self.low, self.high = np.array(low)[:n], np.array(high)[:n]
        bits = np.array(bits)
        self.inner = bits[:n] >= 0
        left, right = bits[self.low], bits[self.high]
        # the parent is the later of the two nodes at the ends of the range
        self.up = np.where(np.maximum(left, right) < 0, -1, np.where(left > right, self.low, self.high))
        self.side = left > right
        self.up[~self.inner] = -1
        leaf = np.arange(n)
        left, right = bits[leaf], bits[leaf + 1]
        self.leaf_up = np.where(np.maximum(left, right) < 0, -1, np.where(left > right, leaf, leaf + 1))
        self.leaf_side = left > right
        self.depth = self.inner.astype(np.int64)
        at = self.up.copy()
        while (live := np.flatnonzero(at >= 0)).size:
            self.depth[live] += self.depth[at[live]]
            at[live] = at[at[live]]

    def levels(self, leaf: np.ndarray, cls: np.ndarray, n: np.ndarray, m: np.ndarray) -> list[tuple]:
        """From the leaves up, of entries (leaf, class) with counts n and m: per depth the distinct (node, class), where the
        children of the last depth and the entries that hang there are among them, their bits, and sums of n and m by bit."""
        node, out = self.leaf_up[leaf], []
        depth = np.where(node >= 0, self.depth[node], 0)
        order = np.argsort(-depth, kind="stable")
        ends = np.searchsorted(-depth[order], -np.arange(int(depth.max(initial=0)), -1, -1), "right")
        carry = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0), np.empty(0)]
        start = 0
        for end in ends[:-1].tolist():
            e = order[start:end]
            start = end
            at, c, bit, ns, ms = (np.concatenate(x) for x in zip(carry, (node[e], cls[e], self.leaf_side[leaf[e]], n[e], m[e])))
            key, where = np.unique(at * CLASSES + c, return_inverse=True)
            sums = [np.bincount(where, x, len(key)) for x in (ns * ~bit, ns * bit, ms * ~bit, ms * bit)]
            out.append((key, where, bit, len(carry[0]), e, *sums))
            at, c = key // CLASSES, key % CLASSES
            carry = [self.up[at], c, self.side[at], sums[0] + sums[1], sums[2] + sums[3]]
        return out


class Beginnings:
    """Known words (or beginnings of them) as a tree, with what predicts its bits."""

    def __init__(self, words: list[bytes], total: np.ndarray, tables: np.ndarray, apart: np.ndarray | None = None):
        lcp = shared_bits(words)
        if apart is not None:
            lcp[apart] = -1
        self.tree = t = Tree(lcp)
        before = np.append(0, np.cumsum(total))
        at = np.arange(len(words))
        self.n0, self.n1 = before[at] - before[t.low], before[t.high] - before[at]
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = np.frombuffer(b"".join(words), np.uint8)
        byte = np.maximum(lcp, 0) >> 3
        spot = np.cumsum(size) - size + byte
        k = np.maximum(lcp, 0) & 7
        node = (1 << k) | (sym[np.minimum(spot, max(len(sym) - 1, 0))].astype(np.int64) >> (8 - k)) if len(sym) else k
        slot = _slots(_hashes(lambda j: _before(sym, spot, byte, j), np.zeros(len(words)), (SHARED,))[SHARED], node) if len(sym) else k
        table = tables[ORDERS.index(SHARED)]
        self.last = np.clip(_odds(table[2 * slot].astype(np.float64), table[2 * slot + 1].astype(np.float64)), -8, 8)

    def inputs(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, own0: int = 0, own1: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Inputs and gates of (node, class) pairs; own0, own1: an occurrence of the bit itself to leave out."""
        node = key // CLASSES
        a0, a1 = self.n0[node] - own0, self.n1[node] - own1
        n0, n1 = np.maximum(n0 - own0, 0), np.maximum(n1 - own1, 0)
        gate = np.minimum(np.log2(n0 + n1 + 1), 7).astype(np.int64) * 3 + np.searchsorted([8, 256], a0 + a1, "right")
        return np.array([np.clip(_odds(np.maximum(a0, 0), np.maximum(a1, 0)), -20, 20), np.clip(_odds(n0, n1), -20, 20), self.last[node]]), gate

    def count(self, levels: list[tuple], into: np.ndarray) -> None:
        """Add to the grid how often each bit followed each state."""
        for key, _, _, _, _, n0, n1, m0, m1 in levels:
            for bit, m in ((0, m0), (1, m1)):
                use = m > 0
                x, gate = self.inputs(key[use], n0[use], n1[use], 1 - bit, bit)
                into[bit] += np.bincount(KNOWN.cell(x, gate), m[use], KNOWN.cells)

    def scores(self, levels: list[tuple], mixer: Mixer, entries: int) -> np.ndarray:
        """log10 probabilities of entries among all words of their tree."""
        out = np.zeros(entries)
        above = None
        for key, where, bit, carried, e, n0, n1, _, _ in reversed(levels):
            p0, p1 = mixer.log10(*self.inputs(key, n0, n1))
            v = np.where(bit, p1[where], p0[where])
            if above is not None:
                v += above[where]
            out[e] = v[carried:]
            above = v[:carried]
        return out


class Model:
    """All that tasks share: the spelling tables, both mixers, chances of an unknown word and of beginnings by class."""

    def __init__(self, tables: np.ndarray, open_: set[bytes], groups: list[tuple[bytes, np.ndarray, np.ndarray]], by_class: np.ndarray, lone: np.ndarray):
        self.tables, self.open = tables, open_
        self.known, self.spelled = Mixer(KNOWN), Mixer(SPELLED)
        some = (lone.sum() + 0.5) / (by_class.sum() + 0.5)
        self.unknown = np.minimum((lone + 20 * some) / (by_class + 20), 1 - 1e-9) if by_class.sum() else np.ones(CLASSES)
        self.names = [g for g, _, _ in groups]
        self._n = np.array([n for _, n, _ in groups], np.float64).reshape(-1, CLASSES)
        self._m = np.array([m for _, _, m in groups], np.float64).reshape(-1, CLASSES)
        self.top = np.zeros_like(self._n)

    def _top(self) -> tuple[Beginnings, list[tuple]]:
        b = Beginnings(self.names, self._n.sum(1), self.tables)
        leaf, cls = np.divmod(np.arange(self._n.size), CLASSES)
        return b, b.tree.levels(leaf, cls, self._n.ravel(), self._m.ravel())

    def learn(self, known: np.ndarray, spelled: np.ndarray) -> None:
        """From the grids' counts, to which those of the beginnings above the buckets are added."""
        if self.names:
            top, levels = self._top()
            top.count(levels, known)
        for name, grid, n in (("known", KNOWN, known), ("spelled", SPELLED, spelled)):
            at = np.flatnonzero(n.any(0))
            setattr(self, name, Mixer.learned(grid, at, n[0][at], n[1][at]))
        if self.names:
            self.top = top.scores(levels, self.known, self._n.size).reshape(-1, CLASSES)
        del self._n, self._m

    def _words(self, b: Bucket) -> tuple[Beginnings, np.ndarray, np.ndarray, np.ndarray]:
        """The known words of a bucket, their entries, the word of each, and the beginning that each word is under."""
        at = np.flatnonzero(b.known > 0)
        words = [b.names[i] for i in at.tolist()]
        tops, apart = grouped(words, self.open)
        under = np.repeat(np.array([bisect(self.names, begin) - 1 for begin in tops], np.int64), np.diff(apart, append=len(words)))
        e = np.flatnonzero(b.known[b.word] > 0)
        return Beginnings(words, b.known[at], self.tables, apart), e, np.searchsorted(at, b.word[e]), under

    def count(self, b: Bucket, known: np.ndarray, spelled: np.ndarray) -> None:
        """Add a bucket's bits to the grids: those of known words but for words that occur once, which count as spelled."""
        if not (b.known > 0).any():
            return
        words, e, leaf, _ = self._words(b)
        taught = b.taught[e]
        words.count(words.tree.levels(leaf, b.cls[e], taught, np.where(b.known[b.word[e]] > 1, taught, 0)), known)
        for _, names, cls in b.steps((b.known[b.word] == 1) & (b.taught > 0)):
            _, bit, slots = _bits(names, cls)
            cell = SPELLED.cell(*_spelled(self.tables, slots, bit, 1))
            for k in (0, 1):
                np.add.at(spelled[k], cell[bit == k], 1.0)  # with a whole number numpy takes many times as long

    def scores(self, b: Bucket) -> np.ndarray:
        """log10 probabilities of a bucket's entries."""
        out = np.zeros(len(b.word))
        if (b.known > 0).any():
            words, e, leaf, under = self._words(b)
            levels = words.tree.levels(leaf, b.cls[e], b.taught[e], np.zeros(len(e)))
            out[e] = words.scores(levels, self.known, len(e)) + self.top[under[leaf], b.cls[e]] + np.log10(1 - self.unknown[b.cls[e]])
        for part, names, cls in b.steps(b.known[b.word] == 0):
            owner, bit, slots = _bits(names, cls)
            p0, p1 = self.spelled.log10(*_spelled(self.tables, slots, bit, 0))
            out[part] = np.bincount(owner, np.where(bit == 1, p1, p0), len(names)) + np.log10(self.unknown[cls])
        return out


def _tables(vocabulary: DataFrame, tasks: int) -> np.ndarray:
    """Counts of bits 0 and 1 in every slot of every order, over all entries of training text, each once."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 * SLOTS) for _ in ORDERS]
        for b in parts:
            for row in b.to_pylist():
                some = Bucket(row)
                for _, names, cls in some.steps(some.taught > 0, COUNTED):
                    _count_bits(names, cls, tables)
        for k, t in enumerate(tables):
            got = t.astype(np.float32).reshape(-1, ROW)
            use = np.flatnonzero(got.any(1))
            yield pa.RecordBatch.from_pydict({"at": pa.array(use + k * len(got), pa.int32()), "v": pa.array([got[i].tobytes() for i in use], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        v = np.sum([np.frombuffer(x, np.float32) for x in t.column("v").to_pylist()], 0, np.float64)
        return pa.table({"at": t.column("at").slice(0, 1), "v": pa.array([v.astype(np.float32).tobytes()], pa.binary())})

    parts = vocabulary.select("words", "per", "cls", "taught").repartition(tasks).mapInArrow(releasing(count), "at int, v binary")
    if tasks > SUMMED:  # else one group would hold the rows of all tasks
        parts = parts.withColumn("part", F.spark_partition_id() % SUMMED).groupBy("at", "part").applyInArrow(add, "at int, v binary")
    out = np.zeros((len(ORDERS) * 2 * SLOTS // ROW, ROW), np.float32)
    got = parts.groupBy("at").applyInArrow(add, "at int, v binary").toArrow()
    for at, v in zip(got.column("at").to_pylist(), got.column("v").to_pylist()):
        out[at] = np.frombuffer(v, np.float32)
    return out.reshape(len(ORDERS), 2 * SLOTS)


def _grids(vocabulary: DataFrame, shared, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each bit followed each state of the mixers' inputs, over all training text."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, spelled = np.zeros((2, KNOWN.cells)), np.zeros((2, SPELLED.cells))
        for b in parts:
            for row in b.to_pylist():
                shared.value.count(Bucket(row), known, spelled)
        n = np.concatenate([known, spelled], 1)
        at = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0][at]), pa.array(n[1][at])], ["at", "n0", "n1"])

    rows = vocabulary.select("words", "per", "cls", "taught").repartition(tasks).mapInArrow(releasing(count), "at long, n0 double, n1 double")
    got = rows.groupBy("at").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    out = np.zeros((2, KNOWN.cells + SPELLED.cells))
    at = got.column("at").to_numpy()
    out[0][at], out[1][at] = got.column("n0").to_numpy(), got.column("n1").to_numpy()
    return out[:, :KNOWN.cells].copy(), out[:, KNOWN.cells:].copy()


def repeated(word: np.ndarray, n: np.ndarray, score: np.ndarray) -> np.ndarray:
    """log10 probabilities of the tokens of texts (n tokens each) when what a text has had so far predicts too: the model's
    chance, and with a weight that grows to REPEAT the share of the word among the tokens before."""
    size = len(word)
    start = np.cumsum(n) - n
    pos = np.arange(size) - np.repeat(start, n)
    key = np.repeat(np.arange(len(n)), n) * (int(word.max(initial=0)) + 1) + word
    o = np.argsort(key, kind="stable")
    new = np.append(True, np.diff(key[o]) != 0)[:size]
    had = np.empty(size, np.int64)
    had[o] = np.arange(size) - np.maximum.accumulate(np.where(new, np.arange(size), 0))
    weight = REPEAT * pos / (pos + 20)
    out = score + np.log10(1 - weight)
    at = np.flatnonzero(had)
    out[at] = np.logaddexp(out[at] * np.log(10), np.log(weight[at] * had[at] / pos[at])) / np.log(10)
    return out


def lm_scores(docs: DataFrame, folds: int = 5, held_out: int = 1) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, held_out, n_tokens, n_known, train_tokens long, base_score, score,
    bits_per_byte double).

    Trains on documents whose crc32(doc_id) mod folds is another than held_out; a null doc_id trains nothing, has held_out
    null, and is scored. Null text is empty: one token, its end. Rows of equal doc_id count and are scored each.
    Without training text base_score is 0 for every token and all words are spelled. bits_per_byte counts the bytes of words,
    terminators and the end. Other columns are ignored. An empty table gives an empty one."""
    buckets = partitions(docs.sparkSession)
    held = (fold("doc_id", folds) == held_out).alias("held")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held)
    common, splits, open_ = _seen_words(docs, buckets)
    chunks = materialize(_chunks(docs, common, splits))
    vocabulary = materialize(_vocabulary(chunks, buckets, open_))
    n, v, entries = (x or 0 for x in vocabulary.agg(F.sum("n"), F.sum("v"), F.sum("entries")).first())
    tasks = -(-entries // TASK_ENTRIES) or 1
    counts = lambda x: np.frombuffer(x, np.int64)
    totals = [(counts(r["by_class"]), counts(r["lone"])) for r in vocabulary.select("by_class", "lone").toLocalIterator()]
    groups = sorted((bytes(r["name"]), counts(r["n"]), counts(r["m"])) for r in vocabulary.select(F.explode("groups").alias("g")).select("g.*").toLocalIterator())
    model = Model(_tables(vocabulary, tasks), open_, groups, *(sum((t[k] for t in totals), np.zeros(CLASSES, np.int64)) for k in (0, 1)))
    taught = Shared(docs.sparkSession, model)
    model.learn(*_grids(vocabulary, taught, tasks))
    taught.free()
    shared = Shared(docs.sparkSession, model)

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for row in b.to_pylist():
                some = Bucket(row)
                s = shared.value.scores(some)
                size = np.fromiter(map(len, some.names), np.uint32, len(some.names))[some.word]
                c = some.known[some.word].astype(np.uint64)
                idx = [np.frombuffer(r["idx"], np.uint32) for r in row["refs"]]
                for start in range(0, len(idx), 16):
                    part = slice(start, start + 16)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([r["chunk"] for r in row["refs"][part]]), pa.array([r["start"] for r in row["refs"][part]], pa.int32()),
                        *(pa.array([x[i].tobytes() for i in idx[part]], pa.binary()) for x in (c, s, size))], ["chunk", "start", "c", "s", "size"])

    def settle(a: pa.Table, b: pa.Table) -> pa.Table:
        o = np.argsort(b.column("start").to_numpy())
        c, s, size = (np.frombuffer(b"".join(np.array(b.column(x).to_pylist(), object)[o].tolist()), t) for x, t in (("c", np.uint64), ("s", np.float64), ("size", np.uint32)))
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        rows = []
        for r in a.to_pylist():
            count = np.frombuffer(r["n"], np.int64)
            token = sum(np.frombuffer(p, np.uint8).astype(np.int64) << (8 * k) for k, p in enumerate(r["planes"]))
            at = np.cumsum(count) - count
            total = lambda x: np.add.reduceat(x, at)  # noqa: E731, B023
            per = np.frombuffer(b"".join(r["per"]), np.uint8)
            sc = total(repeated(np.repeat(np.arange(len(per)), per)[token], count, s[token]))
            rows.append(pa.table({"doc_id": pa.array(r["ids"], pa.int64()), "held_out": pa.array(r["held"], pa.bool_()), "n_tokens": pa.array(count), "n_known": pa.array(total((c > 0).astype(np.int64)[token])),
                                  "train_tokens": pa.array(np.full(len(count), n)), "base_score": pa.array(total(base[token])), "score": pa.array(sc),
                                  "bits_per_byte": pa.array(-sc / np.log10(2) / total(size.astype(np.float64)[token]))}))
        return pa.concat_tables(rows)

    found = vocabulary.select("words", "per", "cls", "taught", "refs").mapInArrow(releasing(score), "chunk string, start int, c binary, s binary, size binary")
    return chunks.select("chunk", "ids", "held", "n", "planes", F.col("buckets.per").alias("per")).groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(
        settle, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
