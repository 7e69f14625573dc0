"""Fill-in-the-middle against a version without trees."""

import hashlib
import random
import re

import pytest

from pairloom.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n, h = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i:i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def some_texts(seed, n=300):
    r = random.Random(seed)
    bits = ["a", "word", "ü", "漢字", "😀", " ", "  ", "\t", "\n", "\x0b", "\x1c", " ", "<", "<P", "P>", "<S", "M>", "é́"]
    out = [None, "", " ", "\n\n", "x", "<P>", "a <S> b", "<<M>>", "<P", "w" * 20_000, " " * 9_000, "a b " * 30_000, ("é" * 5000 + " ") * 8]
    return out + ["".join(r.choice(bits) for _ in range(r.randrange(200))) for _ in range(n)]


@pytest.mark.parametrize("leaf", [1, 7, 4096])
def test_ropes_split_and_join_as_strings_do(monkeypatch, leaf):
    monkeypatch.setattr(fim, "LEAF", leaf)
    r = random.Random(leaf)
    for t in some_texts(3, 60):
        raw, units = (t or "").encode()[:3000].decode(errors="ignore"), None
        units = UNIT.findall(raw)
        tree = fim.rope(raw.encode())
        assert (tree.units if tree else 0) == len(units) and (tree.chars if tree else 0) == len(raw) and fim.raw_of(tree).decode() == raw
        for _ in range(6):
            k = r.randint(0, len(units))
            a, b = fim.split(tree, k, "units")
            assert fim.raw_of(a).decode() == "".join(units[:k]) and fim.raw_of(b).decode() == "".join(units[k:])
            assert (a.chars if a else 0) == len("".join(units[:k])) and (b.units if b else 0) == len(units) - k
            k = r.randint(0, len(raw))
            a, b = fim.split(tree, k, "chars")
            assert fim.raw_of(a).decode() == raw[:k] and fim.raw_of(b).decode() == raw[k:]


def test_depth_grows_with_the_logarithm():
    depth = lambda t: 0 if t.raw is not None else 1 + max(depth(t.left), depth(t.right))
    assert depth(fim.rope(b"ab " * 2_000_000)) <= 12


def test_transform_and_restore(spark):
    rows = list(enumerate(some_texts(4))) + [(3, "again " * 9), (3, "again " * 9), (None, "no id here at all"), (-5, "minus five")]
    df = spark.createDataFrame([(i, t, "old", 7) for i, t in rows], "doc_id long, text string, output string, n int").repartition(3)
    made = fim.transform(df)
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = fim.restore(made, to="back").collect()
    assert all(r.back == (r.text or "") for r in got)
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got) == sorted(repr((i, *plain_version(i, t))) for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(df.limit(0)).count() == 0 and fim.fim_digests(df.limit(0)).count() == 0
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, *plain_version(i, t)[:4], sha(plain_version(i, t)[4]), sha(t or "")) for i, t in rows]
    assert sorted(map(repr, map(tuple, fim.fim_digests(df).collect()))) == sorted(map(repr, want))


def test_broken_outputs_and_sentinels_are_told(spark):
    with pytest.raises(ValueError, match="sentinels"):
        fim.restored(b"<P>a<M>b", "psm", fim._marks(("<P>", "<S>", "<M>")))
    with pytest.raises(ValueError, match="overlap"):
        fim._marks(("<P>", "<P>x", "<M>"))
    assert fim.restored(b"as it is", "plain", fim._marks(("<P>", "<S>", "<M>"))) == b"as it is"
