"""The pipeline and its classifier against versions without Spark, and on rows that are null, empty, long or repeated."""

import glob
import hashlib
import math
import os
import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline as P
from pairloom.llm import mixing, toxicity
from pairloom.llm.common import materialize, table

MODEL = P.MODEL


def words(r, n):
    return " ".join("".join(r.choice("abcdeghilmnorstu") for _ in range(r.randint(2, 8))) for _ in range(n))


def some_documents(seed=5):
    """Prose with near copies at 0.7 to 1, a shared passage, hot copies, nulls, and texts that are empty, short or long."""
    r = random.Random(seed)
    texts = []
    passage = words(r, 70)
    for n in (12, 60, 150, 400):
        for _ in range(5):
            w = words(r, n).split()
            texts.append(" ".join(w))
            for share in (0.02, 0.12, 0.21, 0.27):
                texts.append(" ".join(w[int(n * share):]))
        texts += [words(r, n) + " " + passage + " " + words(r, 5) for _ in range(3)]
    texts += ["the very same text stands here many times over"] * 40 + [None, None, "", " ", "\n", "one", "One", "two words", "ﬁ 漢字 😀 é", "x" * 30_000, words(r, 12_000)]
    r.shuffle(texts)
    ids = r.sample(range(10_000), len(texts))
    rows = [(i, t, r.choice(["en", "fr", None]), r.choice(["hot", "hot", "hot", "b", "c", None]), len(t or "")) for i, t in zip(ids, texts)]
    return rows + [rows[3], rows[3], (ids[7], "another text of an id that has one", "en", "b", 34), (None, "no id", "en", "b", 5), (None, None, None, None, 0)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
#: Columns that stages use under the same names.
CLASH = "size int, copies string, component_id long, target string, form string, text_crc32 int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("docs"))
    rows = [(*r, 1, "c", 2, "t", "f", 3) for r in some_documents()]
    spark.createDataFrame(rows, f"{SCHEMA}, {CLASH}").repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(r[0], 0, k % 2) for k, r in enumerate(rows[:30])] + [(None, 1, 1), (4, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def top(up, i):
    while up[i] != i:
        i = up[i]
    return i


def near_kept(rows):
    """Rows that near-dedup keeps: five-word sets, exact similarity of all pairs, the smallest id of each group."""
    sets = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset())
    with_id = [i for i, r in enumerate(rows) if r["doc_id"] is not None]
    up = list(range(len(rows)))
    for i in with_id:
        for j in with_id:
            if j < i and (sets[i] == sets[j] or rows[i]["doc_id"] == rows[j]["doc_id"] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9):
                a, b = top(up, i), top(up, j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i in with_id:
        least[top(up, i)] = min(least.get(top(up, i), math.inf), rows[i]["doc_id"])
    return [r for i, r in enumerate(rows) if r["doc_id"] is None or r["doc_id"] == least[top(up, i)]]


def without_repeats(rows):
    """Texts without the bytes of 100-byte strings that start earlier, by a dictionary of all of them."""
    first, out = {}, {}
    by_id = sorted({(r["doc_id"], r["text"] or "") for r in rows if r["doc_id"] is not None})
    for d, t in by_id:
        raw = t.encode()
        keep = np.ones(len(raw), bool)
        for s in range(len(raw) - 99):
            if first.setdefault(raw[s:s + 100], (d, t, s)) != (d, t, s):
                keep[s:s + 100] = False
        out[d, t] = bytes(np.frombuffer(raw, np.uint8)[keep]).decode("utf-8", "ignore")
    return [{**r, "text": out[r["doc_id"], r["text"] or ""] if r["doc_id"] is not None and r["text"] is not None else r["text"]} for r in rows]


def key(rows):
    return sorted(repr((r["doc_id"], r["text"], r["lang"], r["source"], r["size"], r["copies"])) for r in rows)


def test_every_stage_equals_plain_python(spark, folder):
    stages = dict(P.STAGES)
    docs = table(spark, folder, "documents")
    columns = docs.columns
    clean = materialize(stages["toxicity"](spark, docs, folder))
    rejected = {repr((r.doc_id, r.score)) for r in toxicity.toxicity(docs, table(spark, folder, "labels")).collect() if r.predicted}
    assert clean.count() == docs.count() - sum(1 for r in toxicity.toxicity(docs, table(spark, folder, "labels")).collect() if repr((r.doc_id, r.score)) in rejected)
    # the other stages on all rows, so that none of the cases is lost to the labels of this table
    rows = [r.asDict() for r in docs.collect()]
    single = materialize(stages["simhash_dedup"](spark, docs, folder))
    want = near_kept(rows)
    assert key(r.asDict() for r in single.collect()) == key(want) and len(want) < len(rows) - 60
    cut = materialize(stages["suffix_dedup"](spark, single, folder))
    want = without_repeats(want)
    got = [r.asDict() for r in cut.collect()]
    assert key(got) == key(want) and all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)
    mixed = materialize(stages["mixing"](spark, cut, folder))
    files = glob.glob(cut.inputFiles()[0].removeprefix("file:").rpartition("/")[0] + "/*.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from read_parquet({files})")
    copies = sorted(repr(d) for d, n in c.sql(f"select doc_id, copies from ({mixing.ORACLE})").fetchall() for _ in range(n))
    assert sorted(repr(r.doc_id) for r in mixed.collect()) == copies
    for d in (clean, single, cut, mixed):
        assert d.columns == columns
    out = stages["sentencepiece"](spark, mixed, folder).collect()
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)
    digest = lambda t: hashlib.sha256(np.array(sp.encode(t or ""), "<i4").tobytes()).hexdigest()
    if sp.encode("a b") and all(r.round_trip for r in out):
        assert sorted(repr((r.doc_id, r.ids_sha256)) for r in out) == sorted(repr((r.doc_id, digest(r.text))) for r in mixed.collect())


def test_run_on_odd_and_empty_tables(spark, folder, tmp_path):
    got = P.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "round_trip"] and got.count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def grown(x, y, cuts, rounds, depth, rate, ridge):
    """Boosted trees by plain search: at every node the first split of greatest gain among all features and cuts."""
    mean = min(max(sum(y) / len(y), 1e-3), 1 - 1e-3)
    base = math.log(mean / (1 - mean))
    score, trees = [base] * len(y), []
    for _ in range(rounds):
        g = [1 / (1 + math.exp(-s)) - t for s, t in zip(score, y)]
        h = [(a + t) * (1 - a - t) for a, t in zip(g, y)]

        def grow(rows, left):
            gs, hs = sum(g[i] for i in rows), sum(h[i] for i in rows)
            if left:
                best = (1e-6, None, None)
                for j, cs in enumerate(cuts):
                    for c in cs:
                        low = [i for i in rows if x[i][j] <= c]
                        gl, hl = sum(g[i] for i in low), sum(h[i] for i in low)
                        if hl < 0.5 or hs - hl < 0.5:
                            continue
                        gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                        if gain > best[0] + 1e-12:
                            best = (gain, j, c)
                if best[1] is not None:
                    _, j, c = best
                    return j, c, grow([i for i in rows if x[i][j] <= c], left - 1), grow([i for i in rows if x[i][j] > c], left - 1)
                return grow(rows, 0)
            return -rate * gs / (hs + ridge)

        tree = grow(list(range(len(y))), depth)
        trees.append(tree)
        score = [s + value(tree, v) for s, v in zip(score, x)]
    return lambda v: base + sum(value(t, v) for t in trees)


def value(tree, v):
    while isinstance(tree, tuple):
        tree = tree[2] if v[tree[0]] <= tree[1] else tree[3]
    return tree


def test_trees_equal_plain_search():
    r = np.random.default_rng(3)
    x = r.normal(size=(90, 4)).round(2)
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] < -0.5)).astype(float)
    y[::9] = 1 - y[::9]
    model = toxicity.Trees(rounds=4, depth=2, rate=0.3, bins=12)
    model.fit(x, y)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 13)[1:-1])).tolist() for j in range(4)]
    plain = grown(x.tolist(), y.tolist(), cuts, 4, 2, 0.3, 1.0)
    new = np.concatenate([x, r.normal(size=(50, 4))])
    assert np.allclose(model.raw(new), [plain(v) for v in new.tolist()], atol=1e-9)


def test_isotonic_means_equal_the_minimum_of_maxima():
    r = np.random.default_rng(4)
    score = r.normal(size=120).round(1)
    y = (r.random(120) < 1 / (1 + np.exp(-score))).astype(float)
    at = np.unique(score)
    n = np.array([(score == s).sum() for s in at])
    ones = np.array([y[score == s].sum() for s in at])
    mean = lambda i, j: ones[i:j + 1].sum() / n[i:j + 1].sum()
    fitted = np.array([min(max(mean(i, j) for i in range(k + 1)) for j in range(k, len(at))) for k in range(len(at))])
    centres, values = toxicity.isotonic(score, y)
    blocks = [np.flatnonzero(np.isclose(fitted, f)) for f in np.unique(fitted.round(12))]
    assert len(blocks) == len(centres)
    for b, c, v in zip(blocks, centres, values):
        k = n[b].sum()
        assert np.isclose(c, (at[b] * n[b]).sum() / k) and np.isclose(v, (ones[b].sum() + 0.02) / (k + 0.04))


def test_ties_at_the_training_limit_are_cut_alike(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(60)] + [(3, "text of an id again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2 + [(5, 1)], "doc_id long, toxic int")
    some = [sorted(map(tuple, toxicity._sample(docs.repartition(n), labels.repartition(n), 20).collect())) for n in (1, 7)]
    assert some[0] == some[1] and len({r[0] for r in some[0]}) == 20
    assert dict((r[0], r[2]) for r in some[0]).get(5, 1) == 1
