"""Phrase collocations: candidates from sketch bounds, counted exactly by automata.

Phrases of k words are hashed to 2^40 cells; the sum of a cell bounds the counts of its phrases from above, so a phrase
seen `least` times lies in a heavy cell. Phrases of k words are put into the sketch only where the two phrases of k - 1
words in them lie in heavy cells, which a Bloom filter of bounded size tells (it lets more through, never less). Every task
goes through its shard of the texts: the phrases of heavy cells that a stretch of it holds are compiled into automata of
" word word " with a blank at either end (a break between pieces is a word of its own that no phrase holds), and the stretch
is scanned with them for overlapping matches. Counts are exact wherever a phrase occurs, so their sums over all shards are,
and all thresholds apply to these only. No task, nor the driver, ever holds the phrases of all texts.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import Shared, discard, materialize, partitions, releasing

#: Bytes that end a piece; blank and tab end a word.
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Bits of a cell, of those that name its range, and of all Bloom segments of a level together at most (16 MB).
CELL, RANGE, FILTER = 40, 9, 27
#: Bytes of text that are read at a time, cells that a task holds before it sums them, phrases or bytes that end a stretch of
#: texts, bits of the table of phrases listed, phrases whose counts a task holds, and parts that counts are summed in.
WINDOW, FLUSH, STRETCH, STRETCH_BYTES, SEEN, TALLY, PARTS = 1 << 18, 1_000_000, 400_000, 32 << 20, 22, 500_000, 512
#: Bytes of a word that automata hold as it is.
LONG = 256

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b" \t")] = 1
_CLASS[list(BREAKS)] = 2
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64)
#: Lower case, tabs as blanks, breaks as line ends.
_PLAIN = bytes(10 if c in BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for the places of a window; made where they are used, as tasks carry what
    modules hold."""
    return tuple(np.cumprod(np.full(WINDOW, b, np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def _long_word(values: np.ndarray, powers: np.ndarray, inverse: np.ndarray) -> np.uint64:
    """The hash of a word of any length, the same as _words() gives it."""
    total, shift = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for i in range(0, len(values), WINDOW):
        part = _LOWER[values[i:i + WINDOW]] + np.uint64(1)
        total += shift * (part * powers[:len(part)]).sum(keepdims=True, dtype=np.uint64)
        shift *= powers[-1:]
    return (total * inverse[:1])[0]


def _words(values: np.ndarray, starts: np.ndarray, powers: np.ndarray, inverse: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Words of texts that lie one after another, the texts beginning at `starts`, some at a time: (hash, start, end, run),
    in order; consecutive words of one run are neighbours within a piece."""
    s, base = 0, 0
    while s < len(values):
        e = min(s + WINDOW, len(values))
        kind = _CLASS[values[s:e]]
        at = starts[np.searchsorted(starts, s):np.searchsorted(starts, e)] - s
        if e < len(values) and e not in starts[np.searchsorted(starts, e):np.searchsorted(starts, e) + 1]:
            cut = max(np.flatnonzero(kind)[-1] + 1 if kind.any() else 0, at[-1] if len(at) else 0)
            if not cut:  # a word longer than the window
                base += len(at)
                stop = starts[np.searchsorted(starts, e):][:1].tolist()
                while e < len(values) and e not in stop and not _CLASS[values[e]]:
                    more = _CLASS[values[e:min([e + WINDOW, len(values), *stop])]]
                    e += int(more.argmax()) if more.any() else len(more)
                yield np.array([_long_word(values[s:e], powers, inverse)]), np.array([s]), np.array([e]), np.array([base])
                s = e
                continue
            e, kind, at = s + cut, kind[:cut], at[at < cut]
        word = kind == 0
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        first[at] |= word[at]
        last[at[at > 0] - 1] |= word[at[at > 0] - 1]
        run = (kind == 2).astype(np.int64)
        np.add.at(run, at, 1)
        run = np.cumsum(run) + base
        base = int(run[-1])
        a, z = np.flatnonzero(first), np.flatnonzero(last)
        total = np.append(np.uint64(0), np.cumsum((_LOWER[values[s:e]] + np.uint64(1)) * powers[:e - s], dtype=np.uint64))
        yield (total[z + 1] - total[a]) * inverse[a], a + s, z + 1 + s, run[a]
        s = e


def _batches(parts: Iterator[pa.RecordBatch], longest: int):
    """(lang of each text, the texts, these one after another, words) of every batch, words as (hash seeded by language, start, end,
    run, text, fresh); the `longest` - 1 words before come along, fresh is the first new one."""
    tables = _tables()
    for b in parts:
        text, langs = b.column("text").cast(pa.large_binary()), b.column("lang").to_pylist()
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        if not len(text) or ends[-1] == ends[0]:
            continue
        values = np.frombuffer(text.buffers()[2], np.uint8)[ends[0]:ends[-1]]
        starts = ends[:-1] - ends[0]
        seed = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in langs], np.uint64)

        def found():
            held = [np.empty(0, k) for k in (np.uint64, np.int64, np.int64, np.int64, np.int64)]
            for h, a, z, run in _words(values, starts, *tables):
                doc = np.searchsorted(starts, a, "right") - 1
                fresh = len(held[0])
                held = [np.concatenate(x) for x in zip(held, (_mix(h ^ seed[doc]), a, z, run, doc))]
                yield (*held, fresh)
                held = [x[len(x) - min(len(x), longest - 1):] for x in held]

        yield langs, [x.as_py() for x in text], values, found()


def _grams(h: np.ndarray, run: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1 to `longest` words: the hashes of all phrases, and whether their words are of one run."""
    out, at, same = [(h, np.ones(len(h), bool))], h, np.ones(len(h), bool)
    for k in range(1, longest):
        n = max(len(h) - k, 0)
        at = _mix(at[:n] * np.uint64(_BASE) + h[k:])
        same = same[:n] & (run[:n] == run[k:])
        out.append((at, same))
    return out


class Filter:
    """A Bloom filter of cells: a segment of bits for each range of cells."""

    def __init__(self, segments: np.ndarray):
        self.segments = segments

    @staticmethod
    def places(cells: np.ndarray, bits: int) -> list[np.ndarray]:
        """Three bits of a segment of 2^bits."""
        mixed = _mix(cells)
        return [mixed >> np.uint64(20 * k) & np.uint64((1 << bits) - 1) for k in range(3)]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        cells = hashes >> np.uint64(64 - CELL)
        part, ok = (cells >> np.uint64(CELL - RANGE)).astype(np.int64), np.ones(len(cells), bool)
        for at in self.places(cells, int(self.segments.shape[1] * 8).bit_length() - 1):
            ok &= (self.segments[part, (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
        return ok


def _plausible(grams: list[tuple[np.ndarray, np.ndarray]], below: Filter | None) -> np.ndarray:
    """Which phrases of the longest length are of one run and hold no phrase of one word less outside heavy cells."""
    ok = grams[-1][1]
    if below is None:
        return ok
    often = below.has(grams[-2][0])
    return ok & often[:len(ok)] & often[1:len(ok) + 1]


def heavy_cells(texts: DataFrame, k: int, least: int, below: Shared | None) -> DataFrame:
    """(part, cell): by range, packed, the cells of phrases of k words whose sum reaches `least`. below: the filter of k - 1
    words."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            cells, n = np.unique(np.concatenate(held), return_counts=True)
            part = (cells >> np.uint64(CELL - RANGE)).astype(np.int32)
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            own = (cells & np.uint64((1 << CELL - RANGE) - 1)).astype(np.uint32)
            ends = np.append(cut[1:], len(cells))
            packed = [pa.array([x[s:e].tobytes() for s, e in zip(cut, ends)], pa.binary()) for x in (own, n.astype(np.uint32))]
            return pa.RecordBatch.from_arrays([pa.array(part[cut]), *packed], ["part", "cell", "n"])

        for _, _, _, found in _batches(parts, k):
            for h, _, _, run_, _, fresh in found:
                grams = _grams(h, run_, k)
                ok = _plausible(grams, below and below.value)
                ok[:max(fresh - k + 1, 0)] = False  # counted before
                held.append(grams[-1][0][ok] >> np.uint64(64 - CELL))
                size += len(held[-1])
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def total(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: int, held: list) -> pa.RecordBatch:
            cells, n = (np.concatenate(x) for x in zip(*held))
            each, at = np.unique(cells, return_inverse=True)
            heavy = each[np.bincount(at, n) >= least]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([heavy.tobytes()], pa.binary())], ["part", "cell"])

        now, held = None, []
        for b in parts:
            for part, cells, n in zip(*(b.column(c).to_pylist() for c in ("part", "cell", "n"))):
                if part != now and held:
                    yield out(now, held)
                    held = []
                now = part
                held.append((np.frombuffer(cells, np.uint32), np.frombuffer(n, np.uint32)))
        if held:
            yield out(now, held)

    packed = texts.mapInArrow(releasing(run), "part int, cell binary, n binary")
    dealt = packed.repartition(partitions(texts.sparkSession), "part").sortWithinPartitions("part")
    return materialize(dealt.mapInArrow(releasing(total), "part int, cell binary"))


def _filter(heavy: DataFrame, most: int = FILTER) -> Filter:
    """The filter of heavy cells: 32 bits a cell, 2^most bits in all at most."""
    cells = heavy.agg(F.sum(F.octet_length("cell") / 4)).first()[0] or 1
    bits = max(min(math.ceil(math.log2(32 * cells)), most) - RANGE, 3)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for part, cell in zip(*(b.column(c).to_pylist() for c in ("part", "cell"))):
                own = np.frombuffer(cell, np.uint32).astype(np.uint64) | np.uint64(part << CELL - RANGE)
                marks = np.zeros(1 << bits, np.uint8)
                for x in Filter.places(own, bits):
                    marks[x.astype(np.int64)] = 1
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

    got = heavy.mapInArrow(releasing(run), "part int, bits binary").toArrow()
    segments = np.zeros((1 << RANGE, 1 << bits - 3), np.uint8)
    for part, x in zip(got.column("part").to_pylist(), got.column("bits").to_pylist()):
        segments[part] = np.frombuffer(x, np.uint8)
    return Filter(segments)


class Stretch:
    """Texts of a shard and the phrases of heavy cells that they hold."""

    def __init__(self, longest: int):
        self.longest = longest
        self.clear()

    def clear(self) -> None:
        self.texts: list[tuple[list[str], list[bytes]]] = []
        self.phrases: dict[str, list[bytes]] = {}
        self.seen = np.zeros(1 << SEEN, np.uint64)  # hashes by their last bits: what one displaces may be listed again
        self.listed = self.size = 0

    @property
    def full(self) -> bool:
        return self.listed >= STRETCH or self.size >= STRETCH_BYTES

    def read(self, langs: list[str], raws: list[bytes], values: np.ndarray, found, filters: dict[int, Filter]) -> None:
        """Take a batch: its texts, and each phrase that may be heavy, about once."""
        plain = values.tobytes().translate(_PLAIN)
        self.texts.append((langs, raws))
        self.size += len(values)
        for h, a, z, run, doc, fresh in found:
            often = np.ones(len(h) + 1, bool)
            new, where, words = [], [], []
            for k, (at, ok) in enumerate(_grams(h, run, self.longest), 1):
                some = np.flatnonzero(ok & often[:len(ok)] & often[1:len(ok) + 1])
                some = some[filters[k].has(at[some])]
                often = np.zeros(len(ok), bool)
                often[some] = True
                some = some[some >= fresh - k + 1]
                some = some[self.seen[(at[some] & np.uint64(len(self.seen) - 1)).astype(np.int64)] != at[some]]
                new.append(at[some])
                where.append(some)
                words.append(np.full(len(some), k))
            new, where, words = (np.concatenate(x) for x in (new, where, words))
            new, one = np.unique(new, return_index=True)
            self.seen[(new & np.uint64(len(self.seen) - 1)).astype(np.int64)] = new
            self.listed += len(new)
            where, words = where[one], words[one]
            for d, i, j in zip(doc[where].tolist(), a[where].tolist(), z[where + words - 1].tolist()):
                self.phrases.setdefault(langs[d], []).append(b" ".join(plain[i:j].split()))

    def counts(self) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        """By language the phrases, and how often the texts of that language hold them, overlaps included; of a phrase that is
        listed twice, all count for the last."""
        second = itemgetter(1)
        for lang, phrases in self.phrases.items():
            found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, p in enumerate(phrases):
                found.add_word(f" {p.decode()} " if len(p) <= LONG else blanked(p.split(b" ")), i)
            found.make_automaton()
            n = np.zeros(len(phrases), np.int64)
            for langs, raws in self.texts:
                for x, raw in zip(langs, raws):
                    for part in guarded(raw) if x == lang else ():
                        np.add.at(n, np.fromiter(map(second, found.iter(part)), np.int64), 1)
            yield lang, phrases, n


def blanked(words: list[bytes]) -> str:
    """Words as " word word ". One of over LONG bytes is its digest behind a line end, as no word is: automata are as deep as
    their keys are long, and are taken down by recursion."""
    if max(map(len, words), default=0) > LONG:
        words = [w if len(w) <= LONG else b"\n" + hashlib.sha256(w).hexdigest().encode() for w in words]
    return b" ".join([b"", *words, b""]).decode()


def guarded(raw: bytes) -> Iterator[str]:
    """A text as " word word ", pieces apart by a line end that stands as a word; a long text in parts of whole pieces."""
    plain = raw.translate(_PLAIN)
    at = 0
    while at < len(plain):
        end = plain.find(b"\n", at + WINDOW)
        end = len(plain) if end < 0 else end
        yield blanked(list(filter(None, plain[at:end].replace(b"\n", b" \n ").split(b" "))))
        at = end


def phrase_counts(texts: DataFrame, longest: int, least: int) -> DataFrame:
    """texts(lang, text binary) -> (lang, phrase, f): every phrase of 1 to `longest` words with f >= least."""
    spark = texts.sparkSession
    filters: dict[int, Shared] = {}
    for k in range(1, longest + 1):
        heavy = heavy_cells(texts, k, least, filters.get(k - 1))
        filters[k] = Shared(spark, _filter(heavy))
        discard(heavy)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, dict[bytes, int]] = {}
        stretch, known = Stretch(longest), {k: f.value for k, f in filters.items()}

        def scan() -> None:
            for lang, phrases, n in stretch.counts():
                own = tally.setdefault(lang, {})
                for p, x in zip(phrases, n.tolist()):
                    own[p] = own.get(p, 0) + x
            stretch.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in tally.items():
                phrases, n = list(own), np.fromiter(own.values(), np.int64, len(own))
                part = np.fromiter(map(zlib.crc32, phrases), np.int64, len(phrases)) % PARTS
                o = np.argsort(part, kind="stable")
                cut = np.flatnonzero(np.diff(part[o], prepend=-1))
                at = pa.array(np.append(cut, len(o)), pa.int32())
                listed = pa.ListArray.from_arrays(at, pa.array([phrases[i] for i in o.tolist()], pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(part[o][cut], pa.int32()), pa.array([lang] * len(cut), pa.string()), listed, pa.ListArray.from_arrays(at, pa.array(n[o]))], ["part", "lang", "phrases", "n"])
            tally.clear()

        for langs, raws, values, found in _batches(parts, longest):
            stretch.read(langs, raws, values, found, known)
            if stretch.full:
                scan()
            if sum(map(len, tally.values())) >= TALLY:
                yield from flush()
        scan()
        yield from flush()

    def total(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(sums: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
            for lang, own in sums.items():
                kept = [(p.decode(), n) for p, n in own.items() if n >= least]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kept), pa.string()), pa.array([p for p, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["lang", "phrase", "f"])

        now, sums = None, {}
        for b in parts:
            for part, lang, phrases, n in zip(*(b.column(c) for c in ("part", "lang", "phrases", "n"))):
                if part.as_py() != now:
                    yield from out(sums)
                    now, sums = part.as_py(), {}
                own = sums.setdefault(lang.as_py(), Counter())
                for p, x in zip(phrases.as_py(), n.as_py()):
                    own[p] += x
        yield from out(sums)

    packed = texts.mapInArrow(releasing(run), "part int, lang string, phrases array<binary>, n array<long>")
    dealt = packed.repartition(partitions(spark), "part").sortWithinPartitions("part")
    out = materialize(dealt.mapInArrow(releasing(total), "lang string, phrase string, f long"))
    for x in filters.values():
        x.free()
    return out


def _first(df: DataFrame, unit: str, order: list[Column], n: int, rank: str) -> DataFrame:
    """The first n rows of each unit with their rank. A tree of three steps: rows of a unit are first cut in 256 parts, these
    in 16, so no task ranks more than 16 n of a unit's rows at the end."""
    salted = df.withColumn("__part", F.pmod(F.xxhash64(*df.columns), F.lit(256)))
    for parts in (256, 16, 1):
        by = Window.partitionBy(unit, "__part").orderBy(*order)
        salted = salted.withColumn("__part", F.col("__part") % parts).withColumn(rank, F.row_number().over(by).cast("long")).filter(F.col(rank) <= n)
    return salted.drop("__part")


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, top: int = 2000, cover: int = 80) -> DataFrame:
    """docs(text, lang) -> (lang, rank, phrase, a, l, r, n, score), all numbers long.

    Texts are lower-cased (A-Z) and split at .,;:!? and line ends into pieces, these at blanks and tabs into words. Per
    language: n is the number of words; a phrase of 2 to `longest` words inside a piece with a = f >= `least` is a
    candidate; its score is the lowest floor(2000000 a / (l + r)) of its cuts into a first and a last part, ties to the
    shortest first part. Candidates inside a longer one with 100 f(longer) >= `cover` a are dropped. The first `top` of each
    language by score, a (both descending) and phrase are returned. Null text counts as empty, null lang as "und";
    repeated rows count each; other columns are ignored; an empty table gives an empty one."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    f = phrase_counts(texts, longest, least).withColumn("words", F.split("phrase", " "))
    found = f.filter(F.size("words") > 1).withColumnRenamed("f", "a")

    cut = found.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"), "words")
    cut = cut.withColumns({"first": F.expr("array_join(slice(words, 1, k), ' ')"), "rest": F.expr("array_join(slice(words, k + 1, size(words) - k), ' ')")}).drop("words")
    for part, n in (("first", "l"), ("rest", "r")):
        cut = cut.join(f.select("lang", F.col("phrase").alias(part), F.col("f").alias(n)), ["lang", part])
    score = F.expr("cast(2000000 as decimal(10,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m"))

    inside = found.filter(F.size("words") > 2).select("lang", F.col("a").alias("longer"), F.explode(F.expr(
        "array_distinct(flatten(transform(sequence(2, size(words) - 1), n -> transform(sequence(1, size(words) - n + 1), i -> array_join(slice(words, i, n), ' ')))))")).alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    kept = scored.join(most, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (big("longer") * 100 < big("a") * cover))
    kept = kept.select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    ranked = _first(kept, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "rank")
    said = F.regexp_count("text", F.lit(r"[^\x20\x09.,;:!?\x0A-\x0D]+")).cast("long")
    n = texts.withColumn("text", F.col("text").cast("string")).groupBy("lang").agg(F.sum(said).alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
u AS (SELECT lang, piece, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
v AS (SELECT lang, word AS w1, lead(word, 1) OVER q AS w2, lead(word, 2) OVER q AS w3, lead(word, 3) OVER q AS w4 FROM u WINDOW q AS (PARTITION BY piece ORDER BY i)),
g AS (SELECT lang, 1 AS k, w1 AS phrase FROM v UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM v WHERE w2 IS NOT NULL
      UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM v WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM v WHERE w4 IS NOT NULL),
f AS (SELECT lang, k, phrase, CAST(count(*) AS BIGINT) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, x.k AS cut, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * c.a // (l.f::HUGEINT + r.f) AS BIGINT) AS score
      FROM c JOIN (VALUES (1), (2), (3)) x(k) ON x.k < c.k
      JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.w, 1, x.k), ' ')
      JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.w, x.k + 1, c.k), ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS longer
      FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM c, (VALUES (2), (3)) y(m) WHERE m < k) GROUP BY ALL),
k AS (SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * b.a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""
