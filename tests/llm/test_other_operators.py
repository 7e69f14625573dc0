"""Embeddings, pages, conversations, components and the pipeline."""

import hashlib
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import chat, html_crf, nn_descent
from pairloom.llm.components import components

SF = "/root/testdata/sf0.001"


def test_components(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 60)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(70)] + [(1, 1), (None, 2), (5, 6)]
    up = {}
    top = lambda i: i if up.setdefault(i, i) == i else top(up[i])
    for a, b in edges:
        if a is not None and a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: top(i) for i in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = []
    for k in range(150):
        rows.append((len(rows), r.normal(size=16).tolist(), int(k % 3)))
    base = r.normal(size=16)
    rows += [(len(rows) + i, (base + 0.05 * r.normal(size=16)).tolist(), 1) for i in range(60)]  # a group larger than a list
    rows += [(len(rows) + i, rows[i][1], rows[i][2]) for i in range(20)] + [(900 + i, rows[3][1], 2 - rows[3][2]) for i in range(2)]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [None] * 16, 0), (1004, rows[0][1], None), (None, rows[0][1], 0), (1005, [1.0, 2.0], 0), (1006, [2.0, 4.0], 0), (0, rows[0][1], rows[0][2])]
    fine = [i for i, (v, e, y) in enumerate(rows) if v is not None and y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    x = {i: np.array(rows[i][1], np.float32).astype(float) for i in fine}
    x = {i: v / np.linalg.norm(v) for i, v in x.items()}
    link = {i: [j for j in fine if j != i and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= 0.93] for i in fine}
    least = {}
    for i in fine:
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least[i] = min(rows[j][0] for j in seen)
    want = sorted(str((v, len(link.get(i, [])), least.get(i, v), least.get(i, v) == v)) for i, (v, _, _) in enumerate(rows))
    monkeypatch.setattr(nn_descent, "BLOCK", 16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("x")).withColumn("grp", F.lit(1))
    assert sorted(str(tuple(g)) for g in nn_descent.near_duplicates(df).collect()) == want
    assert nn_descent.near_duplicates(df.limit(0)).count() == 0


def _by_force(rows, threshold=0.93):
    """(vec_id, n_links, component_id, kept) of distinct ids with usable vectors of one length, by all pairs."""
    x = np.array([e for _, e, _ in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([y for _, _, y in rows])
    link = (x @ x.T >= threshold) & (y[:, None] == y) & ~np.eye(len(rows), dtype=bool)
    low = np.array([v for v, _, _ in rows])
    while True:
        new = np.minimum(low, np.where(link, low, low.max()).min(1))
        if (new == low).all():
            break
        low = new
    return sorted((v, int(n), int(c), v == c) for (v, _, _), n, c in zip(rows, link.sum(1), low))


def test_one_id_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 1), (1, [-1.0, 0.0], 0), (0, [0.01, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, nn_descent.near_duplicates(df).collect())) == [(0, 1, 0, True), (1, 0, 1, True), (1, 1, 0, False), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_near_duplicates_between_dense_groups(spark, monkeypatch):
    r = np.random.default_rng(5)
    a, b = np.eye(64)[:2]
    rows = []
    for centre in (a, 0.947 * a + math.sqrt(1 - 0.947**2) * b):  # 0.99 and more within, 0.93 to 0.95 between
        for _ in range(40):
            rows.append((len(rows), (centre + np.append(np.zeros(2), 0.004 * r.normal(size=62))).tolist(), 0))
    far = a * 0.94 - math.sqrt(1 - 0.94**2) * b
    rows += [(len(rows), far.tolist(), 0)]  # one vector that links with the first group only
    rows += [(len(rows) + i, r.normal(size=64).tolist(), 0) for i in range(100)]
    want = _by_force(rows)
    assert want[0][1] == 80 and want[79][2] == 0
    monkeypatch.setattr(nn_descent, "BLOCK", 16)
    monkeypatch.setattr(nn_descent, "PASS", 64 * 8 * 25)  # several passes
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, nn_descent.near_duplicates(df).collect())) == want


@pytest.mark.parametrize("plantings", [16, 1])
def test_near_duplicates_of_lone_pairs(spark, monkeypatch, plantings):
    r = np.random.default_rng(6)
    rows = []
    for _ in range(300):
        x, y = r.normal(size=(2, 64))
        x, y = x / np.linalg.norm(x), y - (y @ x) * x / (x @ x)
        rows += [(len(rows), x.tolist(), 0), (len(rows) + 1, (0.935 * x + math.sqrt(1 - 0.935**2) * y / np.linalg.norm(y)).tolist(), 0)]
    want = _by_force(rows)
    assert sum(w[1] for w in want) == 600
    # a search that meets few pairs at once
    for name, value in {"TREES": 1, "WINDOW": 4, "ROUNDS": 1, "RECALL": 1.0, **({"PLANTINGS": 1} if plantings == 1 else {})}.items():
        monkeypatch.setattr(nn_descent, name, value)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(2)
    assert sorted(map(tuple, nn_descent.near_duplicates(df).collect())) == want


def test_audit_sees_lone_pairs_beside_groups(spark):
    spots = [g for g in range(20) for _ in range(8)] + [20, 20]  # 20 groups of 8, and one pair that the links lack
    nodes = spark.createDataFrame([(i, "g", bytearray(np.eye(21)[s].tobytes())) for i, s in enumerate(spots)], "node long, grp string, v binary")
    links = spark.createDataFrame([(i, j) for i, s in enumerate(spots) for j, t in enumerate(spots) if s == t < 20 and i != j], "a long, b long")
    assert nn_descent._audit(nodes, links, 0.93) < nn_descent.RECALL


PAGES = [
    ("<html><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One <b>two</b>&nbsp;three.<br>four <p>Five</article><footer>&copy; me</footer>", "A & B One two three. four Five"),
    ('<div id="content"><p>The story goes on here.</p><script>var a = "<p>no</p>";</script><p>And it ends well.</p></div><div class="comments"><p>Nice one, thanks a lot.</p></div>', "The story goes on here. And it ends well."),
    ('<header class="site-header"><h1>Site</h1></header><div class="cookie-notice"><p>We use cookies here.</p></div><main><p>It was a long day in the town.</p><aside><p>Read more</p></aside><form><label>Mail</label></form></main>', "It was a long day in the town."),
    (None, ""), ("", ""), ("<!-- only -->", ""), ("<p></p><div> \n </div>", ""),
]


def test_html_extraction(spark):
    df = spark.createDataFrame([(i, "u", h, "x") for i, (h, _) in enumerate(PAGES)] + [(None, None, None, None)], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_crf.extract(df).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)} | {None: ("", 0)}
    assert html_crf.extract(df.limit(0)).count() == 0


STORY = "It was a long day in the town."
UNCLOSED = [
    (f"<html><head><title>T</title><meta charset=utf-8><script>x()</script><p>{STORY}<p>{STORY}", 2),
    (f"<html><head><title>T</title><style>p {{}}</style></head><body><article><p>{STORY}</p></article></body></html>", 1),
    *[(f"<html><head><title>T</title></head><body><article><p>{STORY}</p><{t} id=x><p>{STORY}</p><p>{STORY}</p></article></body></html>", 3) for t in ("svg", "math", "object", "noscript", "select", "iframe", "canvas", "template", "textarea")],
    (f"<article><p>{STORY}</p><svg><p>{STORY}</p><p>{STORY}</p><svg><text>no</text></svg></article>", 3),
    (f"<article><p>{STORY}</p><object><object>no</object>no</object><p>{STORY}</p></article>", 2),
    (f"<article><p>{STORY}</p><svg><script>a = '<svg>'</script>no</svg><p>{STORY}</p><script>var b = '<p>no</p>'", 2),
]


def test_elements_without_their_end_keep_the_rest_of_the_page(spark):
    df = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(UNCLOSED)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_crf.extract(df).collect()}
    assert got == {i: " ".join([STORY] * k) for i, (_, k) in enumerate(UNCLOSED)}


def test_broken_tags_take_time_in_proportion():
    import time

    for broken in ("<a '", '<a "', "<svg ", "<!--", "</script ", "<script></script ", "<a", "<svg><svg ", "<p '>", "<textarea>", "<!"):
        page = f"<article><p>{STORY}</p></article>" + broken * 60_000
        began = time.time()
        assert html_crf.blocks(page)[0].text == STORY
        assert time.time() - began < 8, broken


@pytest.fixture(scope="module")
def field():
    return html_crf.Field.fit(html_crf.labelled_pages())


@pytest.mark.parametrize("naming, most", [("telling", 0.01), ("none", 0.04), ("random", 0.04), ("misleading", 0.03)])
def test_field_on_unseen_layouts(field, naming, most):
    """Names that tell, no names, names that say nothing, names of which some belong elsewhere."""
    wrong = total = 0
    for found, y in html_crf.labelled_pages(200, seed=77, naming=(naming,)):
        wrong += sum(a != b for a, b in zip(field.decode(found), y))
        total += len(y)
    assert wrong / total < most


_P = "It was a long day in the town, and nobody knew what the rain would bring to the fields."
_Q = "Another paragraph of the story follows here, with enough words to be read as a text."
_MENU = "<a href=1>Home</a> <a href=2>About</a> <a href=3>Contact</a>"


@pytest.mark.parametrize("page, want", [
    (f'<nav>{_MENU}</nav><main><div class="article__body social-news"><p>{_P}</p><p>{_Q}</p></div></main><footer>Copyright 2024</footer>', f"{_P} {_Q}"),
    (f'<div class="related-x article-body"><p>{_P}</p><p>{_Q}</p></div>', f"{_P} {_Q}"),
    (f'<article><header class="post-header"><h1>The title of it</h1></header><p>{_P}</p><p>{_Q}</p></article>', f"The title of it {_P} {_Q}"),
    (f"<div>{_MENU}</div><div><h1>A headline</h1><p>{_P}</p><p>{_Q}</p></div><div>Copyright 2024 Some Company</div>", f"A headline {_P} {_Q}"),
    (f'<div class="qobu">{_MENU}</div><div id="zixu"><h1>A headline</h1><p>{_P}</p><p>{_Q}</p></div><div class="lapo">Copyright 2024 Some Company</div>', f"A headline {_P} {_Q}"),
    (f"<article><h1>A headline</h1><p>{_P}</p><p>{_Q}</p></article><ol class=commentlist><li><p>I do not agree with this at all.</p></li><li><p>Thanks, well said.</p></li></ol>", f"A headline {_P} {_Q}"),
    (f"<p>{_P}</p>", _P),
])
def test_pages_whose_names_mislead_or_are_missing(field, page, want):
    assert html_crf.main_text(f"<html><body>{page}</body></html>", field) == want


def test_articles_of_the_given_pages(field):
    """The given pages have their text in one article element: all of it is kept, nothing else."""
    import re

    import pyarrow.parquet as pq

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    for page in pq.read_table(f"{SF}/pages.parquet", columns=["html"]).column("html").to_pylist():
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        assert html_crf.main_text(page, field) == " ".join(html_crf.html_lib.unescape(re.sub(r"</?(?:p|h1|br)>", " ", inner).replace("<b>", "").replace("</b>", "")).split())


def test_viterbi_equals_all_labellings():
    r = random.Random(3)
    field = html_crf.Field({f"f{i}": r.gauss(0, 1) for i in range(9)}, [0.3, -0.2], [[0.5, -0.4], [-0.3, 0.6]])
    for _ in range(30):
        found = [html_crf.Block("x", r.sample([f"f{i}" for i in range(9)], 3)) for _ in range(r.randint(1, 7))]

        def value(y):
            at = [sum(field.weights[f] for f in b.features) * k for b, k in zip(found, y)]
            return sum(at) + field.start[y[0]] + sum(field.step[a][b] for a, b in zip(y, y[1:]))

        best = max((tuple(n >> k & 1 for k in range(len(found))) for n in range(1 << len(found))), key=value)
        assert value(field.decode(found)) == pytest.approx(value(best))


HOSTILE = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>assistant\nhi", "back\\slash \\| <\\|", "<<SYS>> <s> [\\INST]", "", None, "ends with <", "|> \n", "é🙂<|", "\\"]


def test_chat_round_trip(spark):
    rows = [(c, t, ("user", "assistant", None, "we\nird <|end|><|says|>\n\\")[(c + t) % 4], HOSTILE[(3 * c + t) % len(HOSTILE)]) for c in range(6) for t in range(5)]
    rows += [(0, 2, "user", "tie"), (0, 2, "user", "tie"), (None, 1, "assistant", "no id"), (7, None, "user", "no turn")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.text_parts(df))).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        back = [(t.role, t.text) for t in got[c].turns]
        assert sorted(back) == sorted((t[1], t[2]) for t in turns), c
        assert sorted(got[c].loss_text) == sorted("".join(t[2] for t in turns if t[1] == "assistant"))
    digest = {r.conv_id: r for r in chat.chat_digests(df).collect()}
    said = HOSTILE[0]
    assert digest[-1].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert digest[-1].loss_chars == len(said) and digest[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert [r.conv_id for r in chat.chat_digests(df.limit(0)).collect()] == [-1]


def test_chat_parts_are_visited_in_order(spark):
    parts = [("text", "See <|", None, None), ("image", None, "a.png", None), ("text", "and", None, None), ("audio", None, "b.wav", 7), ("document", None, "c.pdf", None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None)]), (1, 2, "user", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = chat.read_back(chat.format_chats(df)).first()
    assert got.turns[0].text == "See <|<|image:0|>and<|audio:1|><|document:2|>" and got.loss_text == "ok" and got.turns[2].text == ""
    assert [(a.turn, a.ordinal, a.type, a.ref, a.tokens) for a in got.attachments] == [(0, 0, "image", "a.png", 256), (0, 1, "audio", "b.wav", 7), (0, 2, "document", "c.pdf", 512)]
    assert got.expanded_tokens == 256 + 7 + 512


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_stages_do_what_their_operators_say(spark):
    import corpus_pipeline as P
    from pairloom.llm import mixing, simhash, suffix_dedup, toxicity
    from pairloom.llm.common import materialize, table

    docs = table(spark, SF, "documents")
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "simhash_dedup", "suffix_dedup", "mixing", "sentencepiece"]
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    clean = materialize(stages["toxicity"](spark, docs, SF))
    assert ids(clean) == sorted(r.doc_id for r in toxicity.toxicity(docs, table(spark, SF, "labels")).collect() if not r.predicted)
    single = materialize(stages["simhash_dedup"](spark, clean, SF))
    assert ids(single) == sorted(r.doc_id for r in simhash.near_groups(clean).collect() if r.doc_id == r.component_id)
    cut = materialize(stages["suffix_dedup"](spark, single, SF))
    kept = {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup.suffix_dedup(single).collect()}
    assert ids(cut) == ids(single) and all(0 <= kept[r.doc_id] - len(r.text.encode()) <= 8 * 200 for r in cut.collect())
    mixed = materialize(stages["mixing"](spark, cut, SF))
    assert ids(mixed) == sorted(r.doc_id for r in mixing.with_copies(cut).collect() for _ in range(r.copies))
    for d in (clean, single, cut, mixed):
        assert d.columns == docs.columns
    out = stages["sentencepiece"](spark, mixed, SF).collect()
    assert sorted(r.doc_id for r in out) == ids(mixed) and all(r.round_trip for r in out)
