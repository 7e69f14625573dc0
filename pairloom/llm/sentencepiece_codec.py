"""SentencePiece encoding and decoding by a batched numpy Viterbi pass.

The model is a BPE one, so the best path is not the one of largest score sum but the one whose neighbouring pieces all
*stay apart*: merging their joined characters by score gives the two back. Every prefix of a word has exactly one last piece
that stays apart from the last piece of what is before it, so a left-to-right pass with backpointers finds what the
merges would give, whole. Words of equal length advance together; substring hashes probe the sorted hashes of the
pieces; a maximum over lengths stores the backpointer. Pairs of pieces are judged once and remembered.

Text is cut where no piece reaches across: before each run of spaces, around line ends, and between a letter and those
marks that follow a letter in no piece. Characters without a piece become
byte pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import Shared, batches_of, releasing

#: Words and pairs of pieces (2^n) that a worker remembers, and words of one length that advance together.
WORDS, PAIRS, TOGETHER = 30_000, 20, 20_000
#: Characters of text that are cut into words at a time.
TEXT = 1_000_000
_SPACE = "▁"
_BASE = 0x9E3779B97F4A7C15


class Pieces:
    """The vocabulary of a model file, as plain data that travels to the workers."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.vocab_size())
        self.names = [model.id_to_piece(i) for i in ids]
        self.special = [i for i in ids if model.is_control(i) or model.is_unknown(i)]
        self.bytes = {int(self.names[i][1:-1], 16): i for i in ids if model.is_byte(i)}
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {self.names[i]: model.get_score(i) for i in plain}
        self.id = {self.names[i]: i for i in plain}
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.id), default=1)
        after_letter = {b for x in self.id for a, b in zip(x, x[1:]) if a.isalpha()}
        stops = "".join(c for c in string.punctuation if c not in after_letter)
        self.cut = rf"\n|▁*+[^\W\d_]++(?=[{re.escape(stops)}])|▁*[^▁\n]+|▁+" if stops else r"\n|▁*[^▁\n]+|▁+"

    def codec(self) -> Codec:
        """One per worker process is enough (Shared.made): what it remembers serves all tasks there."""
        return Codec(self)


def merged(text: str, score: dict[str, float]) -> list[str]:
    """BPE as defined: the adjacent pair of best score merges, leftmost first, until none can."""
    parts: list[str | None] = list(text)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list[tuple[float, int, str]] = []

    def ask(i: int) -> None:
        j = after[i]
        if i >= 0 and j < len(parts) and (s := score.get(both := parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (-s, i, both))

    for i in range(len(parts) - 1):
        ask(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != both:
            continue  # one of the two has merged meanwhile
        parts[i], parts[j] = both, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        ask(i)
        if before[i] >= 0:
            ask(before[i])
    return [x for x in parts if x is not None]


def edges(piece: str, score: dict[str, float], right: bool) -> list[tuple[str, float, float]]:
    """The symbols at one end of a piece while its characters merge, each with the times (falling score) it begins and
    ends."""
    parts, clock, out = list(piece), -np.inf, []
    since = clock
    while len(parts) > 1:
        found = [score.get(x + y, -np.inf) for x, y in zip(parts, parts[1:])]
        at = int(np.argmax(found))
        clock = max(clock, -found[at])
        edge = parts[-1 if right else 0]
        if at == (len(parts) - 2 if right else 0):
            out.append((edge, since, clock))
            since = clock
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [*out, (piece, since, np.inf)]


class Codec:
    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.size = len(pieces.names)
        self.cut = re.compile(pieces.cut)
        names = list(pieces.id)
        power = np.cumprod(np.full(pieces.longest + 1, np.uint64(_BASE)))
        self.power = np.append(np.uint64(1), power)
        key = np.empty(len(names), np.uint64)
        for n in range(1, pieces.longest + 1):
            at = [i for i, x in enumerate(names) if len(x) == n]
            if at:
                key[at] = self._hash(self._grid([names[i] for i in at]))[:, -1]
        order = np.argsort(key)
        self.keys, self.ids = key[order], np.array([pieces.id[x] for x in names], np.int32)[order]
        self.maybe = np.zeros(1 << 20, bool)  # of a key's first bits, whether any piece has them
        self.maybe[self.keys >> np.uint64(44)] = True
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.seen = np.full(1 << PAIRS, -1, np.int64)
        self.judged = np.zeros(1 << PAIRS, bool)
        self.right: dict[int, list] = {}
        self.left: dict[int, list] = {}
        space = _SPACE.encode()
        self.raw = [b"" if i in set(pieces.special) else x.encode().replace(space, b" ") for i, x in enumerate(pieces.names)]
        for b, i in pieces.bytes.items():
            self.raw[i] = bytes([b])

    @staticmethod
    def _grid(words: list[str]) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)

    @staticmethod
    def _hash(grid: np.ndarray) -> np.ndarray:
        """Polynomial hashes of all beginnings, the empty one first."""
        out = np.zeros((len(grid), grid.shape[1] + 1), np.uint64)
        for j in range(grid.shape[1]):
            out[:, j + 1] = out[:, j] * np.uint64(_BASE) + grid[:, j] + np.uint64(1)
        return out

    def _apart(self, a: int, b: int) -> bool:
        """Whether no symbol at the end of a ever merges with one at the beginning of b, both alive at its time."""
        if a == self.size or b == self.size:
            return True
        names, score = self.p.names, self.p.score
        if a not in self.right:
            self.right[a] = edges(names[a], score, True)
        if b not in self.left:
            self.left[b] = edges(names[b], score, False)
        for x, x0, x1 in self.right[a]:
            for y, y0, y1 in self.left[b]:
                s = score.get(x + y)
                if s is not None and (t := max(-s, x0, y0)) < x1 and t <= y1:  # of equal scores the left one merges first
                    return False
        return True

    def _stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces next to each other stay what they are; a character without a piece always does."""
        key = a.astype(np.int64) * (self.size + 1) + b
        slot = ((key.view(np.uint64) * np.uint64(_BASE)) >> np.uint64(64 - PAIRS)).astype(np.int64)
        out = self.judged[slot]
        new = np.flatnonzero(self.seen[slot] != key)
        if len(new):
            ask, where = np.unique(key[new], return_inverse=True)
            out[new] = got = np.array([self._apart(*divmod(k, self.size + 1)) for k in ask.tolist()])[where]
            self.seen[slot[new]] = key[new]
            # of keys that share a slot the last one written stays, and its own judgement with it
            kept = self.seen[slot[new]] == key[new]
            self.judged[slot[new][kept]] = got[kept]
        return out

    def _viterbi(self, words: list[str]) -> list[bytes]:
        """Piece ids (as 32-bit numbers) of words of one length."""
        grid = self._grid(words)
        n, size = grid.shape
        h = self._hash(grid)
        reach = min(size, self.p.longest)
        piece = np.full((reach + 1, size + 1, n), -1, np.int32)  # by length and end
        for m in range(1, reach + 1):
            found = h[:, m:] - h[:, :-m] * self.power[m]
            i, j = np.nonzero(self.maybe[found >> np.uint64(44)])
            some = found[i, j]
            at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
            piece[m, m + j, i] = np.where(self.keys[at] == some, self.ids[at], -1)
        piece[1, 1:][piece[1, 1:] < 0] = self.size
        last = np.zeros((size + 1, n), np.int32)
        back = np.zeros((size + 1, n), np.int32)
        for j in range(1, size + 1):
            m, w = np.nonzero(piece[1:min(reach, j) + 1, j] >= 0)
            m += 1
            here = piece[m, j, w]
            ok = m == j
            ask = np.flatnonzero(~ok)
            ok[ask] = self._stay_apart(last[j - m[ask], w[ask]], here[ask])
            back[j, w[ok]] = m[ok]  # lengths ascend: the longest that may end here stays
            last[j, w[ok]] = here[ok]
        out = []
        back, last = back.T.tolist(), last.T.tolist()
        for w, b, t in zip(words, back, last):
            ids: list[int] = []
            j = size
            while j:
                if t[j] == self.size:
                    ids.extend(reversed([self.p.bytes.get(x, self.p.unknown) for x in w[j - 1].encode()]))
                else:
                    ids.append(t[j])
                j -= b[j]
            out.append(array("i", reversed(ids)).tobytes())
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Remember the ids of words. When there are too many, those not asked for since the last time go."""
        if len(self.words) > WORDS:
            self.old, self.words = self.words, {}
        by: dict[int, list[str]] = {}
        for w in words:
            if w in self.words:
                continue
            if w in self.old:
                self.words[w] = self.old[w]
            elif w.startswith(_SPACE * 2):  # runs of spaces have pieces of one score, whose order of merging counts
                ids = [i for x in merged(w, self.p.score) for i in ([self.p.id[x]] if x in self.p.id else [self.p.bytes.get(c, self.p.unknown) for c in x.encode()])]
                self.words[w] = array("i", ids).tobytes()
            else:
                by.setdefault(len(w), []).append(w)
        for size, group in by.items():
            step = max(1, min(TOGETHER, 4_000_000 // (size * min(size, self.p.longest))))
            for i in range(0, len(group), step):
                self.words.update(zip(group[i:i + step], self._viterbi(group[i:i + step])))

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for _, some in batches_of(texts, [len(t or "") for t in texts], TEXT):
            one: dict[str, str] = {}  # of equal words one is kept
            cut = [list(map(one.setdefault, found, found)) if (found := self.cut.findall(_SPACE + t.replace(" ", _SPACE)) if t else []) else [] for t in some]
            self.learn(one)
            get = self.words.__getitem__
            for c in cut:
                yield np.frombuffer(b"".join(map(get, c)), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space that encoding puts first goes, bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(" ")


def encode_texts(docs: DataFrame, model_file: str) -> DataFrame:
    """docs(doc_id, text) -> (doc_id long, ids array<int>). The model is read on the driver. Null and empty texts have no
    ids; rows of equal or null doc_id are encoded each; other columns are ignored; an empty table gives an empty one."""
    pieces = Shared(docs.sparkSession, Pieces(model_file))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pieces.made(Pieces.codec)
        for b in parts:
            ids = list(codec.encode(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(ids)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(releasing(run), "doc_id long, ids array<int>")


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))


def decode_ids(encoded: DataFrame, model_file: str) -> DataFrame:
    """encoded(doc_id, ids) -> (doc_id, text); null ids give an empty text."""
    pieces = Shared(encoded.sparkSession, Pieces(model_file))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pieces.made(Pieces.codec)
        for b in parts:
            texts = [codec.decode(np.array(x.as_py() or [], np.int32)) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(releasing(run), "doc_id long, text string")


def token_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """docs(doc_id, text) -> (doc_id long, n_tokens long, n_byte_tokens long, ids_sha256 string (of the ids as little-endian
    32-bit numbers), round_trip boolean (decoding gives the text back)).

    Only a text with U+2581, which stands for a space in pieces, does not come back. Null counts as empty."""
    pieces = Shared(docs.sparkSession, Pieces(model_file))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pieces.made(Pieces.codec)
        fallback = np.zeros(codec.size, bool)
        fallback[list(pieces.value.bytes.values())] = True
        for b in parts:
            texts = b.column("text").to_pylist()
            rows = [(len(x), int(fallback[x].sum()), hashlib.sha256(x.astype("<i4").tobytes()).hexdigest(), codec.decode(x) == (t or "")) for x, t in zip(codec.encode(texts), texts)]
            cols = list(zip(*rows)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        releasing(run), "doc_id long, n_tokens long, n_byte_tokens long, ids_sha256 string, round_trip boolean")
