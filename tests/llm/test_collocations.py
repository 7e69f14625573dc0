"""Phrase collocations against brute force."""

import collections
import random
import re

import numpy as np
import pytest

from pairloom.llm import collocations as C

PIECES = re.compile(r"[.,;:!?\x0A-\x0D]")
WORDS = re.compile(r"[^\x20\x09]+")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows, longest=4, least=30, top=2000, cover=80):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in PIECES.split(lowered(text or "")):
            w = WORDS.findall(piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    most = collections.Counter()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                most[lang, w[i:i + k]] = max(most[lang, w[i:i + k]], a)
    out = collections.defaultdict(list)
    for (lang, w), a in cand.items():
        if 100 * most[lang, w] >= cover * a:
            continue
        cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        phrase = " ".join(w)
        out[lang].append(((-score, -a, phrase.encode()), phrase, a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    return sorted((lang, i + 1, *r[1:]) for lang, found in out.items() for i, r in enumerate(sorted(found)[:top]))


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, x, "x") for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, f string").repartition(parts)


def texts(seed, n=400):
    r = random.Random(seed)
    words = ["a", "B", "the", "of", "É", "naïve", "x\x1cy", " ", "New", "york", "new", "City", "<P>", "zz"]
    ends = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "!", " \t "]
    return [(r.choice(["en", "en", "en", "de", None, ""]), "".join(r.choice(words) + r.choice(ends) for _ in range(r.randrange(60)))) for _ in range(n)]


def test_equals_brute_force(spark):
    rows = texts(1, 2500) + [(None, None), ("en", ""), ("en", " \t"), ("en", "...")] + [("de", "same text again, and again!")] * 40
    got = sorted(map(tuple, C.collocations(table(spark, rows), top=50).collect()))
    assert got == brute(rows, top=50) and {"en", "de", "und", ""} == {r[0] for r in got}


def test_stretches_filters_and_flushes_change_nothing(spark, monkeypatch):
    rows = texts(2, 300)
    want = brute(rows)
    monkeypatch.setattr(C, "STRETCH", 50)  # tasks carry these numbers with them
    monkeypatch.setattr(C, "TALLY", 70)
    monkeypatch.setattr(C, "FLUSH", 100)
    monkeypatch.setattr(C, "WINDOW", 256)
    monkeypatch.setattr(C, "SEEN", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(tuple, C.collocations(table(spark, rows)).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    made = C._filter
    monkeypatch.setattr(C, "_filter", lambda heavy: made(heavy, C.RANGE + 3))  # filters that let much through
    assert sorted(map(tuple, C.collocations(table(spark, rows, 1)).collect())) == want


def test_empty_table_and_exact_arithmetic(spark):
    assert C.collocations(table(spark, [("en", "a b")] * 2).limit(0)).count() == 0
    assert C.collocations(table(spark, [("en", "a b")] * 29)).count() == 0
    got = C.collocations(table(spark, [("en", "a b")] * 30 + [("en", "a")] * 7)).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", 30, 37, 30, 67, 2000000 * 30 // 67)]


def test_long_texts_and_words(spark):
    long = "w" * (C.WINDOW + 100_000)
    rows = [("en", f"{long} tail ")] * 35 + [("en", f"tail {long}"), ("en", "one two " * 200_000)]
    got = sorted(map(tuple, C.collocations(table(spark, rows, 2)).collect()))
    assert got == brute(rows)


def test_words_of_a_batch_are_hashed_alike_wherever_they_lie(monkeypatch):
    r = random.Random(5)
    docs = ["".join(r.choice("aB \t.") for _ in range(r.randrange(30))) + "q" * r.choice([0, 0, 50]) for _ in range(300)]
    raw = b"".join(d.encode() for d in docs)
    starts = np.cumsum([0, *map(len, docs[:-1])])
    want = [(lowered(w.group()), i, len(PIECES.findall(d[:w.start()]))) for i, d in enumerate(docs) for w in re.finditer(r"[^ \t.]+", d)]
    of = {}
    for window in (16, 64, 1 << 12):
        monkeypatch.setattr(C, "WINDOW", window)
        got = [x for part in C._words(np.frombuffer(raw, np.uint8), starts, *C._tables()) for x in zip(*(c.tolist() for c in part))]
        assert [lowered(raw[a:z].decode()) for _, a, z, _ in got] == [w for w, _, _ in want]
        for (h, _, _, run), (w, doc, piece) in zip(got, want):
            assert of.setdefault(w, h) == h
        runs = [g[3] for g in got]
        assert [runs[i] == runs[i + 1] for i in range(len(runs) - 1)] == [want[i][1:] == want[i + 1][1:] for i in range(len(want) - 1)]
    assert len(set(of.values())) == len(of)
