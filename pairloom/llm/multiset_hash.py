"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (lines with their line end). Every paragraph is hashed to a wide vector; the
fingerprint is the sum of the vectors: 4 lanes modulo 2^64 of uniform numbers, which tell equal multisets. So that texts of
few paragraphs can be alike too, it also sums, over the clauses of the text, 128 lanes modulo 2^32 of signs, whose
differences tell how many clauses differ, and the number of clauses modulo 2^32. Order does not matter, and paragraphs are
inserted and deleted by adding and subtracting.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import partitions

LANES, SIGNS = 4, 128
_PARAGRAPH = re.compile(rb"[^\n]*\n|[^\n]+")
_PART = re.compile(rb"[^\n.!?,;:]+[\n.!?,;:]*|[\n.!?,;:]+")
#: Ids the driver may see to split their order.
SAMPLE = 20_000
_LAST = (1 << 63) - 1


class Fingerprint:
    """A vector of lanes; + and - are insertion and deletion of all parts of the other."""

    __slots__ = ("lanes", "signs", "parts")

    def __init__(self, lanes: np.ndarray, signs: np.ndarray, parts: int):
        self.lanes, self.signs, self.parts = lanes, signs, parts & 0xFFFFFFFF

    @classmethod
    def of_digests(cls, whole: list[bytes], digests: list[bytes]) -> Fingerprint:
        """From the digests of paragraphs and of clauses."""
        lanes = np.frombuffer(b"".join(whole), np.uint64).reshape(-1, LANES).sum(0, dtype=np.uint64)
        d = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, SIGNS // 8)
        ones = np.zeros(SIGNS, np.int64)
        for i in range(0, len(d), 1 << 14):
            ones += np.unpackbits(d[i:i + (1 << 14)], axis=1).sum(0, dtype=np.int64)
        return cls(lanes, (2 * ones - len(d)).astype(np.uint32), len(d))

    @classmethod
    def of(cls, raw: bytes) -> Fingerprint:
        return cls.of_digests(digests(paragraphs(raw), 8 * LANES), digests(parts(raw), SIGNS // 8))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.lanes + other.lanes, self.signs + other.signs, self.parts + other.parts)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.lanes - other.lanes, self.signs - other.signs, self.parts - other.parts)

    def __str__(self) -> str:
        return self.lanes.astype(">u8").tobytes().hex() + f"{self.parts:08x}" + self.signs.astype(">u4").tobytes().hex()

    def likeness(self, other: Fingerprint) -> float:
        """1 less the estimated share of clauses that only one of the two has; 1 for equal ones and for no others."""
        if (self.lanes == other.lanes).all() and (self.signs == other.signs).all():
            return 1.0
        apart = float(np.square((self.signs - other.signs).view(np.int32).astype(np.float64)).mean())
        every = max(self.parts + other.parts, 1)
        return min(max(1 - apart / every, 0.0), 1 - 1 / (2 * every))


def paragraphs(raw: bytes) -> list[bytes]:
    return _PARAGRAPH.findall(raw)


def parts(raw: bytes) -> list[bytes]:
    return _PART.findall(raw)


def digests(found: list[bytes], size: int) -> list[bytes]:
    new = hashlib.blake2b
    return [new(p, digest_size=size).digest() for p in found]


class Sketch:
    """A text, the digests of its paragraphs and clauses, and its fingerprint."""

    def __init__(self, text: str | None):
        self.text = text or ""
        raw = self.text.encode()
        self.cuts = [(np.cumsum(np.fromiter(map(len, found), np.int64, len(found))), digests(found, size))
                     for found, size in ((paragraphs(raw), 8 * LANES), (parts(raw), SIGNS // 8))]
        self.mark = Fingerprint.of_digests(*(d for _, d in self.cuts))

    def edited(self, after: Sketch) -> tuple[str, Fingerprint]:
        """The text whose last quarter is replaced by the beginning of another, and its fingerprint: the paragraphs and
        clauses from the cut on are deleted, those of the new end inserted."""
        k = len(self.text) // 4
        kept = self.text[:len(self.text) - k]
        text = kept + after.text[:k]
        raw, cut = text.encode(), len(kept.encode())
        gone, new = [], []
        for (ends, held), find, size in zip(self.cuts, (paragraphs, parts), (8 * LANES, SIGNS // 8)):
            safe = int(np.searchsorted(ends, cut, "left"))  # parts that end before the cut stay as they are
            gone.append(held[safe:])
            new.append(digests(find(raw[int(ends[safe - 1]) if safe else 0:]), size))
        return text, self.mark - Fingerprint.of_digests(*gone) + Fingerprint.of_digests(*new)


def _buckets(docs: DataFrame, count: int):
    """A column of the buckets a row goes to: its own, by ranges of doc_id, and -1 - b where it comes next after the
    last row of another bucket b."""
    key = F.coalesce(F.col("doc_id"), F.lit(_LAST))
    ids = docs.select(key.alias("k"))
    thin = ids.sample(min(1.0, 2 * SAMPLE / max(ids.count(), 1)), seed=7)  # so that no task sends many
    some = sorted(r["k"] for r in thin.orderBy(F.xxhash64("k"), "k").limit(SAMPLE).collect())
    splits = np.array([some[len(some) * i // count] for i in range(1, count)] if some else [], np.int64)

    @F.pandas_udf("int")
    def own(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splits, k.to_numpy(np.int64), "right").astype(np.int32))

    firsts = sorted((r["b"], r["k"]) for r in ids.withColumn("b", own("k")).groupBy("b").agg(F.min("k").alias("k")).collect())
    before = {k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def to(k: pd.Series) -> pd.Series:
        b = np.searchsorted(splits, k.to_numpy(np.int64), "right")
        return pd.Series([[x, -1 - before[v]] if v in before else [x] for x, v in zip(b.tolist(), k.tolist())])

    return to(key)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id long, n_chars long, edited_sha256, fingerprint, edited_fingerprint string,
    near_edited, near_next double).

    The next document is that of the next larger doc_id (null is largest; equal ids go by text; after the last comes the
    first, which for a single row is itself). Null text counts as empty. Rows are fingerprinted each. Documents are
    dealt by ranges of doc_id; the first of each range is also sent to the range before. Other columns are ignored. An
    empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def row(d, a: Sketch, b: Sketch):
            text, mark = a.edited(b)
            return d, len(a.text), hashlib.sha256(text.encode()).hexdigest(), str(a.mark), str(mark), a.mark.likeness(mark), a.mark.likeness(b.mark)

        for b in batches:
            rows = []
            for d, t, guest in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("guest").to_pylist()):
                if guest and held is None:
                    continue
                now = Sketch(t.as_py())
                if held is not None:
                    rows.append(row(*held, now))
                held = None if guest else (d, now)
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    count = partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = docs.withColumn("to", F.explode(_buckets(docs, count))).withColumn("guest", F.col("to") < 0)
    sent = sent.withColumn("to", F.when(F.col("guest"), -1 - F.col("to")).otherwise(F.col("to")))
    dealt = sent.repartitionById(count, F.col("to")).sortWithinPartitions("guest", F.coalesce(F.col("doc_id"), F.lit(_LAST)), "text")
    return dealt.select("doc_id", "text", "guest").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
