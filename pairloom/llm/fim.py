"""Fill-in-the-middle by ropes.

A text is a balanced tree whose leaves hold whole units (a word with the white space before it; white space at the end is
one of its own) and whose nodes cache their numbers of units and code points. The tree is split at two ranks of units, and
its subtrees are joined in another order with sentinels between them. The inverse reads the output into a tree, splits it
at the code points where its sentinels lie, and joins prefix, middle and suffix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import releasing

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a leaf, unless a single unit is longer.
LEAF = 4096

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True


def unit_ends(raw: np.ndarray) -> np.ndarray:
    """Where the units of UTF-8 bytes end: after each run of other characters than white space, and at the end."""
    space = _SPACE[raw]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(raw)) if len(raw) else ends


def code_points(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf (raw) or the concatenation of two ropes; None is the empty rope."""

    units: int
    chars: int
    raw: bytes | None = None
    left: Rope | None = None
    right: Rope | None = None

    def leaves(self) -> Iterator[bytes]:
        todo = [self]
        while todo:
            at = todo.pop()
            if at.raw is None:
                todo += [at.right, at.left]
            else:
                yield at.raw


def leaf(raw: bytes) -> Rope | None:
    b = np.frombuffer(raw, np.uint8)
    return Rope(len(unit_ends(b)), code_points(b), raw) if raw else None


def join(*ropes: Rope | None) -> Rope | None:
    """The ropes one after another, each split in halves: the depth grows with the logarithm of their number."""
    some = [r for r in ropes if r is not None]
    if len(some) < 2:
        return some[0] if some else None
    half = len(some) // 2
    a, b = join(*some[:half]), join(*some[half:])
    return Rope(a.units + b.units, a.chars + b.chars, None, a, b)


def rope(raw: bytes) -> Rope | None:
    """The balanced rope of a text."""
    b = np.frombuffer(raw, np.uint8)
    ends = unit_ends(b)
    if not len(ends):
        return None
    last = np.unique(np.append(np.searchsorted(ends, np.arange(LEAF, len(b), LEAF), "right") - 1, len(ends) - 1))
    last = last[last >= 0]
    cut = np.append(0, ends[last])
    points = np.add.reduceat(((b & 0xC0) != 0x80).astype(np.int64), cut[:-1])
    units = np.diff(last, prepend=-1)
    return join(*(Rope(u, c, raw[s:e]) for u, c, s, e in zip(units.tolist(), points.tolist(), cut[:-1].tolist(), cut[1:].tolist())))


def split(at: Rope | None, rank: int, by: str) -> tuple[Rope | None, Rope | None]:
    """The rope before and from the rank on, counted in "units" or "chars"."""
    before: list[Rope | None] = []
    after: list[Rope | None] = []
    while at is not None:
        if rank <= 0:
            after.append(at)
            break
        if rank >= getattr(at, by):
            before.append(at)
            break
        if at.raw is None:
            n = getattr(at.left, by)
            if rank < n:
                after.append(at.right)
                at = at.left
            else:
                before.append(at.left)
                at, rank = at.right, rank - n
        else:
            b = np.frombuffer(at.raw, np.uint8)
            cut = int(unit_ends(b)[rank - 1] if by == "units" else np.flatnonzero((b & 0xC0) != 0x80)[rank])
            before.append(leaf(at.raw[:cut]))
            after.append(leaf(at.raw[cut:]))
            break
    return join(*before), join(*reversed(after))


def raw_of(*ropes: Rope | None) -> bytes:
    return b"".join(x for r in ropes if r is not None for x in r.leaves())


def draws(doc_id, seed: int) -> list[int]:
    """Four numbers of 32 bits of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]


def rearranged(raw: bytes, doc_id, rate: int, spm: int, seed: int, marks: tuple[bytes, bytes, bytes]) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and middle, output) of a text."""
    tree = rope(raw)
    n = tree.units if tree is not None else 0
    h = draws(doc_id, seed)
    if tree is None or h[2] % 100 >= rate or any(m in raw for m in marks):
        return n, "plain", None, None, raw
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, rest = split(tree, first, "units")
    middle, suffix = split(rest, second - first, "units")
    form = "spm" if h[3] % 100 < spm else "psm"
    p, s, m = (leaf(x) for x in marks)
    out = join(s, suffix, p, prefix, m, middle) if form == "spm" else join(p, prefix, s, suffix, m, middle)
    return n, form, prefix.chars if prefix else 0, middle.chars if middle else 0, raw_of(out)


def restored(raw: bytes, form: str | None, marks: tuple[bytes, bytes, bytes]) -> bytes:
    """The text of an output; raises where a sentinel of its form is missing."""
    if form not in ("psm", "spm"):
        return raw
    p, s, m = marks
    order = (s, p, m) if form == "spm" else (p, s, m)
    found, b = [raw.find(x) for x in order], np.frombuffer(raw, np.uint8)
    if found[0] != 0 or not found[0] < found[1] < found[2]:
        raise ValueError(f"an output of form {form} needs its sentinels in order")
    parts, tree, gone = {}, rope(raw), 0
    for mark, end in zip(order, [*found[1:], len(raw)]):
        _, tree = split(tree, len(mark.decode()), "chars")
        upto = code_points(b[:end])
        gone += len(mark.decode())
        parts[mark], tree = split(tree, upto - gone, "chars")
        gone = upto
    return raw_of(parts[p], parts[m], parts[s])


def _marks(sentinels: tuple[str, str, str]) -> tuple[bytes, bytes, bytes]:
    marks = tuple(x.encode() for x in sentinels)
    if any(a in b for i, a in enumerate(marks) for j, b in enumerate(marks) if i != j) or any(x[:k] == y[-k:] for x in marks for y in marks for k in range(1, len(x))):
        raise ValueError("a sentinel must not hold or overlap another")
    return marks


def transform(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """docs(doc_id, text, ...) with n (units), form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and
    output added; columns of these names are replaced, all others stay.

    `rate` of 100 documents are rearranged, `spm` of 100 of these with the suffix first; a document's draws depend on seed
    and doc_id only. Null text is an empty one, empty texts and texts that hold a sentinel stay plain. A null doc_id draws
    as an empty one; equal ids draw alike; rows are transformed each. An empty table gives an empty one."""
    marks = _marks(sentinels)
    new = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    kept = [f for f in docs.schema.fields if f.name not in {x.name for x in new}]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = [rearranged((t.as_py() or "").encode(), d, rate, spm, seed, marks) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text"))]
            cols = list(zip(*rows)) if rows else [[]] * 5
            made = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *made], [f.name for f in [*kept, *new]])

    return docs.select([f.name for f in kept]).mapInArrow(releasing(run), T.StructType([*kept, *new]))


def restore(rows: DataFrame, to: str = "restored", sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """rows(form, output, ...) with the original text in the column `to`, which is replaced if there. A form other than psm
    and spm leaves the output as it is; null output is an empty text."""
    marks = _marks(sentinels)
    kept = [f for f in rows.schema.fields if f.name != to]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts = [restored((o.as_py() or "").encode(), f, marks) for o, f in zip(b.column("output"), b.column("form").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(texts, pa.binary()).cast(pa.string())], [*(f.name for f in kept), to])

    return rows.select([f.name for f in kept]).mapInArrow(releasing(run), T.StructType([*kept, T.StructField(to, T.StringType())]))


def fim_digests(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    made = transform(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    back = restore(made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output"))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
             regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
e AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
        CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(list_slice(u, 1, least(a, b)), '') AS p, array_to_string(list_slice(u, least(a, b) + 1, greatest(a, b)), '') AS m, array_to_string(list_slice(u, greatest(a, b) + 1, n), '') AS s FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f
"""
