"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon (words, and stems of 4 to 6 letters) is learned from the labelled training rows by log-odds of document
frequency. A training row's features come from a lexicon of the other parts of the training rows, so the trees see them
as they will be on new rows. Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import discard, fold, materialize, releasing

#: At most so many labelled rows fit the model (the smallest hashes of doc_id), and so many terms make the lexicon.
TRAIN_ROWS, LEXICON = 24_000, 4_000
STEMS = (4, 5, 6)
#: Training parts (by text): a row's features, and the score that calibrates, come from the other parts.
PARTS = 5
#: Second-person words of the four languages.
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine euch euer ihr tú ti usted ustedes vosotros vuestro".split())
#: Characters written for letters.
LEET = str.maketrans("013457@$!", "oieastasi")
_EDGE = ".,;:!?\"'()[]{}<>*_-|~`…"
_MIXED = re.compile(r"[A-Za-z][0-9@$!*#]+[A-Za-z]")
FEATURES = ("best", "mass", "hits", "density", "stem_density", "near_second_person", "second_person", "capitals", "shouting", "punctuation", "obfuscated", "log_words")


def terms(word: str) -> list[str]:
    """The lexicon entries that a word may match: itself (with a dot) and its stems."""
    return [word + ".", *(word[:k] for k in STEMS if len(word) > k)]


def weight(t: float, c: float, toxic: float, clean: float) -> float:
    """Log-odds of a term's document frequency; 0 for one that is rare or does not mark label 1."""
    if t < 3:
        return 0.0
    w = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
    return w if w > 1.5 else 0.0


@dataclass
class Lexicon:
    """counts: term -> rows with it, of label 1 and of label 0, by training part; rows: the same of all rows."""

    counts: dict[str, tuple[list[int], list[int]]]
    rows: tuple[list[int], list[int]]

    def __post_init__(self):
        self.starts = {k[:4] for k in self.counts}
        self.parts = [self._weights(k) for k in range(PARTS)]
        self.weights = self._weights(None)

    def _weights(self, part: int | None) -> dict[str, float]:
        """Weights without what one part of the training rows has counted."""
        rest = lambda x: sum(x) - (x[part] if part is not None else 0)
        all_ = [rest(x) for x in self.rows]
        return {k: w for k, (t, c) in self.counts.items() if (w := weight(rest(t), rest(c), *all_))}


def features(text: str | None, lex: Lexicon, part: int | None = None) -> list[float]:
    """FEATURES of a whole text; for a training row, as if its part had not been counted. Null is empty: all zero."""
    weights = lex.weights if part is None else lex.parts[part]
    text = text or ""
    raw = text.encode()
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.lower().split()
    n = len(words)
    mixed = _MIXED.findall(text) if kinds[48:58].sum() or kinds[[64, 36, 33, 42, 35]].sum() else []
    spots, best, mass, stems, seen = [], 0.0, 0.0, 0, set()
    starts = lex.starts
    for i in [i for i, w in enumerate(words) if w[:4] in starts or w[:1] in _EDGE or len(w) < 6]:
        w = words[i].strip(_EDGE)
        if w[:4] not in starts and (w + ".")[:4] not in starts:
            continue
        found = [(weights.get(k, 0.0), k) for k in terms(w)]
        top, term = max(found)
        if top > 0:
            spots.append(i)
            seen.add(term)
            best = max(best, top)
            mass += top
            stems += not term.endswith(".")
    if mixed:
        for i, w in enumerate(words):
            if any(x in w for x in "013457@$!"):
                plain = w.strip(_EDGE).translate(LEET)
                if (top := weights.get(plain + ".", 0.0)) > 0 and plain != w:
                    spots.append(i)
                    best = max(best, top)
                    mass += top
    you = [i for i, w in enumerate(words) if w in SECOND] if spots else []
    near = 0.0
    if spots and you:
        y = np.array(you)
        at = np.searchsorted(y, spots)
        gap = np.minimum(np.abs(y[np.minimum(at, len(y) - 1)] - spots), np.abs(y[np.maximum(at - 1, 0)] - spots))
        near = float(np.exp(-gap.min() / 10))
    capitals, letters = int(kinds[65:91].sum()), int(kinds[65:91].sum() + kinds[97:123].sum())
    marks = int(kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum())
    per = 1 / max(n, 1)
    return [best, math.log1p(mass), float(len(seen)), 100 * len(spots) * per, 100 * stems * per, near, 100 * len(you) * per,
            capitals / max(letters, 1), 100 * int(kinds[33]) * per, marks / max(len(raw), 1), 100 * len(mixed) * per, math.log1p(n)]


class Trees:
    """Boosted trees of fixed depth on binned features, logistic loss."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = math.log(mean / (1 - mean))
        self.trees = []
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            split = []
            for level in range(self.depth):
                for k in range(1 << level):
                    mine = node == k
                    best = (1e-6, 0, np.inf, 0)
                    gs, hs = g[mine].sum(), h[mine].sum()
                    for j, c in enumerate(cuts):
                        if not len(c) or not mine.any():
                            continue
                        gl = np.cumsum(np.bincount(binned[mine, j], g[mine], len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[mine, j], h[mine], len(c) + 1))[:-1]
                        gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                        gain[(hl < 0.5) | (hs - hl < 0.5)] = 0
                        i = int(gain.argmax())
                        if gain[i] > best[0]:
                            best = (gain[i], j, c[i], i + 1)
                    split.append(best[1:3])
                right = np.zeros(len(y), bool)
                for k in range(1 << level):
                    j, cut = split[(1 << level) - 1 + k]
                    right |= (node == k) & (x[:, j] > cut)
                node = node * 2 + right
            gl, hl = np.bincount(node, g, 1 << self.depth), np.bincount(node, h, 1 << self.depth)
            leaf = -self.rate * gl / (hl + self.ridge)
            score += leaf[node]
            self.trees.append((np.array([j for j, _ in split]), np.array([c for _, c in split]), leaf))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for j, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = node * 2 + (x[rows, j[at]] > cut[at])
            score += leaf[node]
        return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and means of the blocks. Rows of equal score are one block from the start."""
    at, where = np.unique(score, return_inverse=True)
    n = np.bincount(where, minlength=len(at)).astype(float)
    blocks: list[list[float]] = []
    for row in zip(at * n, np.bincount(where, y, len(at)), n):
        blocks.append([float(x) for x in row])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    sums = np.array(blocks)
    return sums[:, 0] / sums[:, 2], (sums[:, 1] + 0.02) / (sums[:, 2] + 0.04)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.knots[1][0])
        raw = self.trees.raw(x)
        # a small share of the raw score keeps apart what one block joins
        return 0.98 * np.interp(raw, *self.knots) + 0.02 / (1 + np.exp(-raw))


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """At most `rows` labelled documents of the training folds."""
    known = (labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", 3) != 1))
             .groupBy("doc_id").agg(F.max("toxic").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    sample = materialize(_sample(docs, labels, rows).select("doc_id", "text", F.col("y").cast("int").alias("y"), F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int").alias("part")))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [[Counter() for _ in range(PARTS)] for _ in range(2)]
        for b in parts:
            for text, y, part in zip(*(b.column(c).to_pylist() for c in ("text", "y", "part"))):
                seen[y][part].update({k for w in {w.strip(_EDGE) for w in (text or "").lower().split()} if 1 < len(w) < 40 for k in terms(w)})
        for part in range(PARTS):
            c, t = seen[0][part], seen[1][part]
            keys = list(c.keys() | t.keys())
            yield pa.RecordBatch.from_pydict({"term": pa.array(keys, pa.string()), "part": pa.array([part] * len(keys), pa.int32()), "t": pa.array([t[k] for k in keys], pa.int64()), "c": pa.array([c[k] for k in keys], pa.int64())})

    rows_of = {(r["y"], r["part"]): r["count"] for r in sample.groupBy("y", "part").count().collect()}
    clean_rows, toxic_rows = ([rows_of.get((y, k), 0) for k in range(PARTS)] for y in (0, 1))
    toxic, clean = sum(toxic_rows), sum(clean_rows)
    by_part = [F.sum(F.when(F.col("part") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for c in "tc" for k in range(PARTS)]
    counts = sample.mapInArrow(releasing(count), "term string, part int, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), *by_part)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    chosen = counts.filter("t >= 3").withColumn("odds", odds).filter("odds > 1.5").orderBy(F.desc(F.col("odds") * F.log("t")), "term").limit(LEXICON).collect()
    lex = Lexicon({r["term"]: tuple([r[f"{c}{k}"] for k in range(PARTS)] for c in "tc") for r in chosen}, (toxic_rows, clean_rows))

    def describe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            x = [features(t, lex, k) for t, k in zip(b.column("text").to_pylist(), b.column("part").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("y"), b.column("part")], ["x", "y", "part"])

    rows_ = sorted(sample.mapInArrow(releasing(describe), "x array<double>, y int, part int").collect(), key=lambda r: (r["x"], r["y"], r["part"]))
    discard(sample)
    y = np.array([r["y"] for r in rows_], float)
    if not toxic or not clean:
        return Model(lex, None, (np.zeros(1), np.array([0.0 if not toxic else 1.0])))
    x = np.array([r["x"] for r in rows_])
    part = np.array([r["part"] for r in rows_])
    apart = np.zeros(len(y))
    for k in np.unique(part):
        apart[part == k] = Trees().fit(x[part != k], y[part != k]).raw(x[part == k])
    return Model(lex, Trees().fit(x, y), isotonic(apart, y))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, rows: int = TRAIN_ROWS) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, toxic) -> (doc_id, held_out boolean, score double, predicted int).

    Learns from at most `rows` labelled rows outside fold 1 of 3 (crc32 of the id's digits). Rows whose label is null
    or neither 0 nor 1 teach nothing; of several labels of one id the larger holds. Null text counts as empty. Without both
    labels among the training rows the score is 0 (1 if all are 1). Rows with a null doc_id are scored; held_out is then
    null. Rows of equal doc_id are scored each. Other columns are ignored. An empty table gives an empty one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(docs, labels, rows)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            x = np.array([features(t.as_py(), model.lexicon) for t in b.column("text")], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    out = docs.mapInArrow(releasing(run), "doc_id long, score double")
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, rows: int = TRAIN_ROWS) -> DataFrame:
    """docs without the rows that score `threshold` or more, columns as they were.

    Null texts are scored as empty ones, rows of null or equal doc_id each; labels as toxicity() takes them, ties at the
    limit of training rows by a hash of doc_id; an empty table stays empty."""
    model = fit(docs, labels, rows)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            x = np.array([features(t.as_py(), model.lexicon) for t in b.column("text")], float).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) < threshold))

    return docs.mapInArrow(releasing(run), docs.schema)
