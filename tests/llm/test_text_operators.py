"""Operators on documents against brute force, and their edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pairloom.llm import context_mixing, mixing, multiset_hash, sentencepiece_codec, simhash, suffix_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n, words=60):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    texts = [prose(r, r.randint(1, 90)) for _ in range(60)]
    shared = prose(r, 40)
    texts += [texts[0], texts[1], texts[2] + " x", texts[3][:200] + shared, shared, "q " + shared + prose(r, 5), "é" * 150 + texts[4], "ab" * 300, "ab" * 130, "x" * 99]
    texts += [None, "", "  \n ", "One", "One", "one two", "Z. " * 400, "y" * 5000]
    out = [(i + 1, t, "en", f"s{i % 3}" if i % 7 else None, 0) for i, t in enumerate(texts)]
    return out + [out[0], (None, texts[0], "en", "s1", 0), (None, "ab" * 200, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names clash with what the operators add."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, DOCS).select("*", *[F.lit(1).alias(c) for c in ("fp", "size", "copies", "target", "spans", "score", "guest", "component_id", "held")]).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def union(n, links):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        up[top(a)] = top(b)
    return [top(i) for i in range(n)]


def test_simhash_groups(spark, docs, rows):
    known = [r for r in rows if r[0] is not None]
    fp = [simhash.fingerprint(r[1]) for r in known]
    group = union(len(known), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3])
    least = {}
    for g, r in zip(group, known):
        least[g] = min(least.get(g, r[0]), r[0])
    got = sorted(map(tuple, simhash.simhash_groups(docs).select("doc_id", "fingerprint", "component_id").collect()))
    assert got == sorted((r[0], f"{f:016x}", least[g]) for r, f, g in zip(known, fp, group))
    assert simhash.simhash_groups(empty(spark)).count() == 0
    assert simhash.fingerprint(None) == simhash.fingerprint(" \t") == 0


def test_simhash_bits():
    import xxhash

    h = [xxhash.xxh64_intdigest(b"a b c", 42), xxhash.xxh64_intdigest(b"b c d", 42)]
    assert simhash.fingerprint("A  b\nC d") == h[0] & h[1] and simhash.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)


def shingle_sets(texts, width=5):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i:i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set())
    return out


def test_near_groups_follow_the_similarity_of_all_pairs(spark, docs, rows):
    r = random.Random(21)
    texts = [None, "", " \n", "One", "one", "one two", "One Two three four five six", "y" * 5000, "Z. " * 400, "z. " * 90]
    line = prose(r, 30)
    for n in (40, 90, 300, 900):
        for _ in range(4):
            w = prose(r, n).split()
            texts.append(" ".join(w))
            for share in (0.015, 0.18, 0.2, 0.22, 0.26, 0.35):  # on both sides of the similarity, close to it too
                texts += [" ".join(["x"] * (n < 50 and share < 0.1) + w[max(int(n * share), n < 50):]) for _ in range(2)]
        texts += [prose(r, n) + " " + line for _ in range(5)]  # others that share a passage
    ids = r.sample(range(10 * len(texts)), len(texts))
    sets = shingle_sets(texts)
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    group = union(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])])
    near = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a | b]
    assert all(sum(lo <= x < hi for x in near) > 20 for lo, hi in ((0.2, 0.7), (0.7, 0.8), (0.8, 0.84), (0.84, 1)))
    least = {}
    for g, i in zip(group, ids):
        least[g] = min(least.get(g, i), i)
    df = spark.createDataFrame([(i, t) for i, t in zip(ids, texts)] + [(None, texts[0])], "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, simhash.near_groups(df).collect())) == sorted((i, least[g]) for i, g in zip(ids, group))
    kept = simhash.keep_first(docs.drop("fp"))
    assert kept.columns == docs.drop("fp").columns and simhash.keep_first(empty(spark)).count() == 0


def test_near_groups_link_what_its_first_links_miss(spark):
    """Texts that look alike by every estimate: most first links fail, the right ones are found in later rounds."""
    r = random.Random(33)
    base = prose(r, 700).split()
    texts = []
    for k in range(24):  # windows over one text: neighbours at 0.8 and more link, those further apart do not
        texts.append(" ".join(base[8 * k:8 * k + 420]))
        w = base[8 * k:8 * k + 420]
        texts.append(" ".join(w[:47 * (k % 2) + 330] + prose(r, 60).split()))
    r.shuffle(texts)
    sets = shingle_sets(texts)
    group = union(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    least = {}
    for i, g in enumerate(group):
        least.setdefault(g, i)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, simhash.near_groups(df).collect())) == sorted((i, least[g]) for i, g in enumerate(group))
    assert 1 < len(set(group)) < len(texts)


def test_ring_links_leave_out_what_is_known():
    r = np.random.default_rng(6)
    one = np.unique(r.integers(0, 1 << 62, 50).astype(np.uint64))
    fp, n, sets = np.array([simhash.wide_fingerprint(one)] * 6), np.full(6, len(one)), [one] * 6
    for alike in (simhash.estimated(n, sets, 0.8), simhash.counted(n, sets, 0.8)):
        got = simhash.ring_links(fp, n, 0.8, alike)
        assert len(got) == 5 and len(set(union(6, got))) == 1
        held = np.array([0, 0, 0, 1, 1, -1])
        got = simhash.ring_links(fp, n, 0.8, alike, held)
        assert got and all(held[i] != held[j] or held[i] < 0 for i, j in got)


def test_counted_is_the_similarity_of_sets():
    r = np.random.default_rng(8)
    sets = [np.unique(r.choice(400, r.integers(1, 300)).astype(np.uint64)) for _ in range(30)]
    n = np.array([len(x) for x in sets])
    alike = simhash.counted(n, sets, 0.5)
    for i in range(30):
        want = [len(np.intersect1d(sets[i], x)) >= 0.5 * len(np.union1d(sets[i], x)) for x in sets]
        assert alike(i, np.arange(30)).tolist() == want


def test_large_groups_are_dealt_to_blocks(spark, monkeypatch):
    """Groups beyond a task's sets and bytes give the same components."""
    r = random.Random(12)
    base = prose(r, 300).split()
    texts = [" ".join(base[k:260 + k % 40] + prose(r, 3 * (k % 30)).split()) for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = sorted(map(tuple, simhash.near_groups(df).collect()))
    monkeypatch.setattr(simhash, "GROUP", 8)
    monkeypatch.setattr(simhash, "HOLD", 20_000)
    assert sorted(map(tuple, simhash.near_groups(df).collect())) == want
    sets = shingle_sets(texts)
    group = union(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    least = {}
    for i, g in enumerate(group):
        least.setdefault(g, i)
    assert want == [(i, least[g]) for i, g in enumerate(group)]


def test_chains_on_the_ring_lose_no_pair_within_the_budget():
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, simhash.WIDE // 64).astype(np.uint64)
    fps, budget = [], simhash.bit_budget(0.8)
    for k in range(0, 90):
        for where in (r.permutation(simhash.WIDE)[:k], (np.arange(k) + int(r.integers(256))) % simhash.WIDE):
            bits = np.zeros(simhash.WIDE, np.uint8)
            bits[where] = 1
            fps.append(base ^ np.packbits(bits).view(np.uint64))
    fps = np.array(fps)
    apart = np.bitwise_count(fps ^ base).sum(1)
    assert (simhash.ring_near(fps, base, budget) == (apart <= budget)).all()


@pytest.mark.parametrize("direct", [4, 4096])
def test_buckets_link_as_all_pairs_do(monkeypatch, direct):
    monkeypatch.setattr(simhash, "DIRECT", direct)
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(20)]
    fp = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(15)})
    links = []
    for start in range(8):
        for chosen in simhash.VARIANTS:
            by = {}
            for i, f in enumerate(fp):
                by.setdefault(tuple(f >> 8 * ((start + k) % 8) & 255 for k in chosen), []).append(i)
            for b in by.values():
                links += [(b[x], b[y]) for x, y in simhash.bucket_links(np.array([fp[i] for i in b], np.uint64), start, chosen)]
    every = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3]
    same = lambda g: {frozenset(i for i, x in enumerate(g) if x == k) for k in set(g)}
    assert same(union(len(fp), links)) == same(union(len(fp), every)) and all((fp[a] ^ fp[b]).bit_count() <= 3 for a, b in links)


def repeats(rows):
    seen, out = {}, {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if seen.setdefault(b[i:i + 100], (d, i)) != (d, i):
                gone[i:i + 100] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[d] = (len(b), len(b) - len(left), runs, hashlib.sha256(left).hexdigest())
    return out


def test_suffix_dedup(spark, docs, rows):
    want = repeats({(r[0], r[1]) for r in rows if r[0] is not None})
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert len(got) == len(rows)
    for g in got:
        if g.doc_id is None:
            assert g.n_removed == 0
        else:
            assert tuple(g)[1:] == want[g.doc_id], g.doc_id
    assert sum(g.n_removed for g in got) > 1000
    assert suffix_dedup.suffix_dedup(empty(spark)).count() == 0


def test_different_texts_of_one_id_and_equal_hashes(spark, monkeypatch):
    r = random.Random(13)
    base = prose(r, 80)
    texts = [(1, "a " + base), (1, "b " + base[:300]), (1, "b " + base[:300]), (0, base[40:260]), (1, None), (2, base[10:] + base[:150]), (1, "")]
    seen, want = {}, {}
    for k, (d, t) in enumerate(sorted({(d, t or "") for d, t in texts})):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if seen.setdefault(b[i:i + 100], (k, i)) != (k, i):
                gone[i:i + 100] = True
        want[d, len(b)] = (int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for mask in (None, 7):
        if mask:  # nearly all windows share a hash
            real = suffix_dedup._window_hashes
            monkeypatch.setattr(suffix_dedup, "_window_hashes", lambda n, t: real(n, t) & np.uint64(7))
        got = suffix_dedup.suffix_dedup(df).collect()
        assert len(got) == len(texts)
        for g in got:
            assert (g.n_removed, g.kept_sha256) == want[g.doc_id, g.n_bytes]


def test_shared_strings_under_the_length_stay(spark):
    r = random.Random(7)
    common = prose(r, 30)[:80]
    docs = spark.createDataFrame([(i, prose(r, 30) + common + prose(r, 30)) for i in range(4)], "doc_id long, text string")
    assert {g.n_removed for g in suffix_dedup.suffix_dedup(docs).collect()} == {0}


def test_hot_contexts_are_sliced_alike():
    r = random.Random(9)
    common = bytes(r.randrange(97, 123) for _ in range(150))
    texts = [bytes(r.randrange(97, 123) for _ in range(40)) + common + bytes(r.randrange(97, 123) for _ in range(40)) for _ in range(3)]
    keys = []
    for raw in texts:  # the same anchor at byte 90, all its windows
        got = list(suffix_dedup.slices(5, 22, 68, 68, raw))
        assert [(lo, n) for _, lo, n, _, _ in got][0][0] == 22 and sum(n + 1 for _, _, n, _, _ in got) == 69
        assert all(len(b) == n + 100 and raw[lo:lo + n + 100] == b and la == 90 - lo for _, lo, n, la, b in got)
        keys.append({(lo + i, raw[lo + i:lo + i + 100]): k for k, lo, n, _, _ in got for i in range(n + 1)})
    for a in keys:
        for b in keys:
            assert all(a[w] == b[w] for w in a.keys() & b.keys())
    assert keys[0].keys() & keys[1].keys()


def test_suffix_dedup_splits_long_texts(monkeypatch):
    r = random.Random(4)
    text = prose(r, 400)
    raw = (text + text[500:900]).encode()
    whole = suffix_dedup.anchors(np.frombuffer(raw, np.uint8), np.array([len(raw)]))
    assert (np.diff(whole[1]) > 0).all() and whole[1][0] == 0 and whole[2][-1] == len(raw) - 100
    assert ((whole[0] - whole[1]) <= 68).all() and (whole[2] <= whole[0]).all()


def test_window_repeats_in_slices():
    r = random.Random(5)
    common = bytes(r.randrange(97, 123) for _ in range(168))
    texts = [bytes(r.randrange(97, 100) for _ in range(k)) + common[k:] for k in (0, 10, 20, 0, 30)]
    n, la = np.array([68] * 5), np.array([68] * 5)
    args = (np.array([7] * 5), np.arange(5), np.zeros(5, np.int64), n, la, texts)
    one, many = (sorted(zip(*(x.tolist() for x in suffix_dedup.window_repeats(*args, most=m)))) for m in (10**6, 10))
    seen, want = set(), []
    for d, t in enumerate(texts):
        for i in range(69):
            w = (i, t[i:i + 100])
            if w in seen:
                want.append((d, i))
            seen.add(w)
    assert one == many == sorted(want)


def test_remove_repeats_keeps_columns_and_whole_characters(spark, docs, rows):
    got = suffix_dedup.remove_repeats(docs)
    assert got.columns == docs.columns
    for r in got.collect():
        assert r.n_chars is None or r.text is None or r.n_chars == len(r.text)


def test_mixing(spark, docs, rows):
    got = mixing.mix_report(docs).collect()
    size = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    total = 1.5 * sum(sizes.values())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free = {}, set(order)
    while True:  # share, stop at the cap, share the rest again
        left = total - sum(target.values())
        over = [s for s in free if left * weight[s] / sum(weight[f] for f in free) > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            free.discard(s)
    left = total - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
    by = {r[0]: r for r in rows}
    taken = Counter()
    for g in got:
        assert 0 <= g.taken <= 2 * g.size and (g.size == 0 or g.taken % g.size == 0)
        if g.doc_id is not None:
            s = by[g.doc_id][3]
            assert g.size == size(by[g.doc_id][1]) and g.source_size == sizes[s] and math.isclose(g.target, target[s], rel_tol=1e-9)
            taken[s] += g.taken
    for s in (x for x in order if x is not None):
        assert abs(taken[s] - target[s]) <= 0.05 * target[s] + max(size(r[1]) for r in rows if r[3] == s)  # one whole document
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_report(docs.repartition(7)).collect()))
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(empty(spark)).count() == mixing.mix_report(empty(spark)).count() == 0


def test_multiset_hash(spark, docs, rows):
    F = multiset_hash.Fingerprint
    a, b = "One. Two, three.\nTwo,\n", " Four! \n"
    assert str(F.of(a.encode()) + F.of(b.encode())) == str(F.of((a + b).encode())) and str(F.of((a + b).encode()) - F.of(b.encode())) == str(F.of(a.encode()))
    assert str(F.of(b"x\ny\nz\n")) != str(F.of(b"x\ny\n")) and str(F.of(b"x\ny\n")) == str(F.of(b"y\nx\n"))
    assert str(F.of(b"one,two,")) != str(F.of(b"two,one,")) and F.of(b"one,two,").likeness(F.of(b"two,one,")) < 1
    many, others = F.of(b"a." * 65536), F.of(b"b." * 65536)
    assert many.likeness(F.of(b"")) == 0 and many.likeness(others) < 0.1 and many.likeness(F.of(b"a." * 65536)) == 1
    want = sorted(((r[0] if r[0] is not None else 1 << 63, r[1] or "") for r in rows), key=lambda x: x)
    expect = Counter()
    for i, (d, t) in enumerate(want):
        n = want[(i + 1) % len(want)][1]
        k = len(t) // 4
        e = t[:len(t) - k] + n[:k]
        expect[(d if d < 1 << 63 else None, len(t), hashlib.sha256(e.encode()).hexdigest(), str(F.of(t.encode())), str(F.of(e.encode())))] += 1
    got = multiset_hash.fingerprint_edits(docs).collect()
    assert Counter(tuple(g)[:5] for g in got) == expect and all(0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1 for g in got)
    assert multiset_hash.fingerprint_edits(empty(spark)).count() == 0 and multiset_hash.fingerprint_edits(spark.createDataFrame(rows[:1], DOCS)).count() == 1


def test_likeness_follows_what_is_shared():
    r = random.Random(6)
    words = [f"{prose(r, 4)}." for _ in range(400)]
    base = multiset_hash.Fingerprint.of(" ".join(words).encode())
    near = [base.likeness(multiset_hash.Fingerprint.of(" ".join(words[:k] + [f"{prose(r, 5)}!" for _ in range(400 - k)]).encode())) for k in (400, 300, 200, 0)]
    assert near[0] == 1 and near[1] == pytest.approx(0.75, abs=0.12) and near[2] == pytest.approx(0.5, abs=0.2) and near[3] < 0.3


def test_context_mixing(spark, docs, rows):
    got = context_mixing.lm_scores(docs).collect()
    assert len(got) == len(rows)
    tokens = lambda t: (t or "").encode().lower().split() + [b"\t"]
    c = Counter()
    for d, t, *_ in rows:
        if d is not None and zlib.crc32(str(d).encode()) % 5 != 1:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    by = {r[0]: r[1] for r in rows if r[0] is not None}
    for g in got:
        assert g.train_tokens == n and g.score < 0
        if g.doc_id is not None:
            w = tokens(by[g.doc_id])
            assert (g.n_tokens, g.n_known, g.held_out) == (len(w), sum(x in c for x in w), zlib.crc32(str(g.doc_id).encode()) % 5 == 1)
            assert g.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
    assert context_mixing.lm_scores(empty(spark)).count() == 0
    was = spark.conf.get("spark.sql.shuffle.partitions")
    first = {g.doc_id: g.score for g in got if g.doc_id is not None}
    for parts, buckets in ((1, 1), (5, 64)):
        spark.conf.set("spark.sql.shuffle.partitions", buckets)
        again = {g.doc_id: g.score for g in context_mixing.lm_scores(docs.repartition(parts)).collect() if g.doc_id is not None}
        assert first == pytest.approx(again, rel=1e-9)
    spark.conf.set("spark.sql.shuffle.partitions", was)


def _taught(words, counts, parts):
    """A model of words whose counts by class are given, counted in as many buckets; and the words' scores in each class."""
    C = context_mixing.CLASSES
    open_ = context_mixing.opened(words, parts)
    groups = {}
    for w, n in zip(words, counts):
        g = groups.setdefault(context_mixing.group_of(w, open_), [np.zeros(C), np.zeros(C)])
        g[0] += n
        g[1] += n * (n.sum() > 1)
    names = sorted(groups)
    edges = [names[len(names) * k // parts] for k in range(1, parts)]
    rows = []
    for k in range(parts):
        mine = [(w, n) for w, n in zip(words, counts) if sum(w >= e for e in edges) == k]
        if mine:
            rows.append({"words": b"\n".join(w for w, _ in mine), "per": bytes([C] * len(mine)), "cls": bytes(list(range(C)) * len(mine)), "taught": np.concatenate([n for _, n in mine]).astype(np.uint64).tobytes()})
    tables = [np.zeros(2 * context_mixing.SLOTS) for _ in context_mixing.ORDERS]
    buckets = [context_mixing.Bucket(r) for r in rows]
    for b in buckets:
        for _, some, cls in b.steps(b.taught > 0):
            _, bit, slots = context_mixing._bits(some, cls)
            for t, s in zip(tables, slots):
                np.add.at(t, 2 * s + bit, 1)
    total = np.array(counts)
    model = context_mixing.Model(np.array(tables, np.float32), open_, [(g, *groups[g]) for g in names], total.sum(0), total[total.sum(1) == 1].sum(0))
    known, spelled = np.zeros((2, context_mixing.KNOWN.cells)), np.zeros((2, context_mixing.SPELLED.cells))
    for b in buckets:
        model.count(b, known, spelled)
    model.learn(known, spelled)
    return model, np.concatenate([model.scores(b) for b in buckets]).reshape(len(words), C)


def test_words_make_a_distribution_in_any_number_of_buckets(monkeypatch):
    r = random.Random(11)
    words = sorted({context_mixing.ended(prose(r, 1).encode() + r.choice([b"", b".", "é".encode(), b"x" * 40, b"\x01", b"\xff"])) for _ in range(900)} | {context_mixing._END})
    counts = [np.array([r.choice([0, 0, 1, 2, 50]) for _ in range(context_mixing.CLASSES)]) for _ in words]
    counts = [c if c.any() else np.eye(1, context_mixing.CLASSES, dtype=int)[0] for c in counts]
    model, one = _taught(words, counts, 1)
    assert (10**one).sum(0) + model.unknown == pytest.approx(np.ones(context_mixing.CLASSES), rel=1e-9)
    monkeypatch.setattr(context_mixing, "STEP", 7)
    for parts in (3, 8):
        assert _taught(words, counts, parts)[1] == pytest.approx(one, rel=1e-9)
    # a word that is not known: 256 ways to go on after any beginning, which use up the beginning's chance
    grid = np.array([p for p in model.spelled.log10(np.zeros((5, 12)), np.arange(12))])
    assert (10**grid).sum(0) == pytest.approx(np.ones(12))
    words2 = [b"zz" + bytes([k]) for k in range(256)]
    owner, bit, slots = context_mixing._bits(words2, np.zeros(256, np.int64))
    p0, p1 = model.spelled.log10(*context_mixing._spelled(model.tables, slots, bit, 0))
    third = np.tile(np.arange(24) >= 16, 256)
    assert (10 ** np.bincount(owner[third], np.where(bit == 1, p1, p0)[third])).sum() == pytest.approx(1)


def test_words_of_a_text_predict_its_next_words():
    word, n, score = np.array([4, 7, 4, 4, 4, 9, 4]), np.array([4, 3]), np.full(7, -2.0)
    got = context_mixing.repeated(word, n, score)
    for i, (pos, had) in enumerate([(0, 0), (1, 0), (2, 1), (3, 2), (0, 0), (1, 0), (2, 1)]):
        weight = context_mixing.REPEAT * pos / (pos + 20)
        assert 10 ** got[i] == pytest.approx((1 - weight) * 0.01 + weight * had / max(pos, 1))
    assert len(context_mixing.repeated(word[:0], n[:0], score[:0])) == 0


def test_trees_part_words_as_their_bits_do():
    r = random.Random(12)
    words = sorted({bytes(r.choice(b"ab\xff\x01") for _ in range(r.randint(0, 30))) + b" " for _ in range(300)})
    bits = ["".join(f"{x:08b}" for x in w) for w in words]
    shared = context_mixing.shared_bits(words)
    for i in range(1, len(words)):
        assert shared[i] == next(k for k, (x, y) in enumerate(zip(bits[i - 1], bits[i])) if x != y)
    tree = context_mixing.Tree(shared)
    for j in range(1, len(words)):
        begin = bits[j][:shared[j]]
        under = [i for i, b in enumerate(bits) if b.startswith(begin)]
        assert (tree.low[j], tree.high[j]) == (under[0], under[-1] + 1)


def test_model_beats_unigrams_on_held_out_text(spark):
    import os

    sf = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(sf):
        pytest.skip("no test tables")
    got = [g for g in context_mixing.lm_scores(spark.read.parquet(sf)).collect() if g.held_out]
    assert sum(g.score for g in got) > sum(g.base_score for g in got)


def test_toxicity(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        t = prose(r, 40) + (" you zorgling fool " + prose(r, 5) if bad else "")
        rows.append((i, t, "en", "s", 0))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None, None, None, None), (1001, "", "", "", 0), (None, "zorgling", "", "", 0), (0, rows[0][1], "en", "s", 0)]
    labels += [(5, 1, None), (7, 0, 9), (None, 1, 1), (0, 1, 1)]
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, lab).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.7) for g in got)
    truth = {i: y for i, _, y in labels[:600]}
    for g in got:
        if g.doc_id is not None:
            assert g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 3 == 1)
    held = [g for g in got if g.held_out and g.doc_id in truth]
    assert sum(g.predicted == truth[g.doc_id] for g in held) / len(held) > 0.97
    kept = toxicity.drop_toxic(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(not g.predicted for g in got)
    none = toxicity.toxicity(docs, lab.limit(0)).collect()
    assert {g.score for g in none} == {0.0} and toxicity.toxicity(empty(spark), lab).count() == 0


def test_toxicity_features():
    lex = toxicity.Lexicon({"idiot.": ([9, 9, 9, 9, 9], [0] * 5)}, ([50] * 5, [500] * 5))
    near = toxicity.FEATURES.index("near_second_person")
    for word in ("idiot", "1d10t"):
        assert toxicity.features("so " * 200 + f"you are a {word}", lex)[near] == pytest.approx(math.exp(-0.3))
        assert toxicity.features(f"you {'so ' * 300}{word}", lex)[near] < 1e-9
    assert toxicity.features(None, lex) == toxicity.features("", lex) == [0.0] * len(toxicity.FEATURES)


def test_isotonic_blocks_rise():
    for y in ([0, 0, 1, 1], [1, 1, 0, 0], [1, 0, 1, 0]):  # of equal scores the order does not count
        x, m = toxicity.isotonic(np.ones(4), np.array(y, float))
        assert (x, m) == (pytest.approx([1]), pytest.approx([0.5]))
    r = np.random.default_rng(1)
    s = r.normal(size=300)
    x, y = toxicity.isotonic(s, (r.random(300) < 1 / (1 + np.exp(-3 * s))).astype(float))
    assert (np.diff(x) > 0).all() and (np.diff(y) > -1e-2).all()


MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def codec():
    import os

    if not os.path.exists(MODEL):
        pytest.skip("no vocabulary file")
    return sentencepiece_codec.Pieces(MODEL).codec()


def test_sentencepiece_equals_the_library(codec, rows):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(3)
    texts = [x[1] or "" for x in rows] + ["".join(r.choice("ab the  \n\té你好ﬁＡ.,1234  —🙂$$%%") for _ in range(r.randint(0, 60))) for _ in range(500)]
    got = list(codec.encode(texts))
    assert [g.tolist() for g in got] == lib.encode(texts)
    assert [codec.decode(g) for g in got] == texts and [codec.decode(g) for g in got] == lib.decode([g.tolist() for g in got])


def test_long_runs_of_spaces(codec):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [" " * n + x for n in (1, 2, 3, 15, 16, 17, 33, 100, 1001, 100_000) for x in ("", "a", " b  c")]
    assert [g.tolist() for g in codec.encode(texts)] == lib.encode(texts)


def test_pairs_of_pieces_are_judged_as_merging_does(codec):
    p = codec.p
    ids = random.Random(4).choices(list(p.id.values()), k=4000)
    for a, b in zip(ids[::2], ids[1::2]):
        assert codec._apart(a, b) == (sentencepiece_codec.merged(p.names[a] + p.names[b], p.score) == [p.names[a], p.names[b]])


def test_token_digests(spark, docs, rows, codec):
    got = sentencepiece_codec.token_digests(docs, MODEL).collect()
    assert len(got) == len(rows) and all(g.round_trip for g in got)
    back = sentencepiece_codec.decode_ids(sentencepiece_codec.encode_texts(docs, MODEL), MODEL).collect()
    assert Counter((b.doc_id, b.text) for b in back) == Counter((r[0], r[1] or "") for r in rows)
    assert sentencepiece_codec.token_digests(empty(spark), MODEL).count() == 0


def test_a_codec_goes_with_its_broadcast(spark, codec):
    """A worker that drops the broadcast frees the codec at once; as a circle it stayed beside the next stage's memory."""
    import gc
    import weakref

    from pairloom.llm.common import Shared

    shared = Shared(spark, codec.p)
    made = shared.made(sentencepiece_codec.Pieces.codec)
    assert made is shared.made(sentencepiece_codec.Pieces.codec) and len(list(made.encode(["a b", "b a"]))) == 2
    seen = weakref.ref(made)
    gc.disable()
    try:
        shared.held.__dict__.clear()
        del made
        assert seen() is None
    finally:
        gc.enable()


def test_equal_words_of_a_batch_are_one_string(codec, monkeypatch):
    asked = []
    monkeypatch.setattr(codec, "learn", lambda words, learn=codec.learn: (asked.append(list(words)), learn(words)))
    assert len({g.tobytes() for g in codec.encode(["ab cd ab", "ab cd ab", "", None])}) == 2
    assert len(asked) == 1 and sorted(asked[0]) == sorted(set(asked[0]))


def test_workers_send_large_batches_in_slices(spark):
    import pyarrow as pa

    from pairloom.llm import common

    rows = pa.RecordBatch.from_pydict({"i": list(range(5000)), "x": [bytes([i % 251]) * 2000 for i in range(5000)]})
    long, none = pa.RecordBatch.from_pydict({"i": [1], "x": [b"y" * (3 * common.SENT)]}), rows.slice(0, 0)
    got = list(common.releasing(lambda parts: parts)(iter([rows, long, none])))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([rows, long, none]))
    assert all(b.num_rows == 1 or b.nbytes <= 1.1 * common.SENT for b in got) and len(got) >= rows.nbytes // common.SENT


def test_common_words_are_those_of_all_training_text(spark):
    """A word that is common in one long training text counts, and held-out text does not; more texts than any sample took."""
    from pairloom.llm import context_mixing as cm

    rows = [(k, "few words here", False) for k in range(8_003)] + [(9_000, "Rare " * 50_000, False), (9_001, "hidden " * 90_000, True), (9_002, None, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean").coalesce(4)
    common, splits, open_ = cm._seen_words(docs, 4)
    assert common == {b"rare": 1, b"few": 2, b"here": 3, b"words": 4} and open_ == cm.opened([b"few ", b"here ", b"rare ", b"words "], 4)
    assert splits == sorted(splits) and all(any(w.startswith(s) for w in (b"few ", b"here ", b"rare ", b"words ")) for s in splits)
    assert cm._seen_words(docs.limit(0), 4) == ({}, [], set())


def test_bits_are_counted_as_placed_and_cost_no_more_than_placing_them():
    """Adding a whole number at places of a table of doubles took numpy many times as long as finding the places."""
    import time

    from pairloom.llm import context_mixing as cm

    r = random.Random(14)
    words = sorted({cm.ended(prose(r, 1).encode() + r.choice([b"", b".", "é".encode(), b"x" * 40, b"\x00\x01", b"\xff"]) + str(r.randint(0, 999)).encode()) for _ in range(20_000)} | {cm._END})
    words = [w for w in words for _ in range(r.choice([1, 1, 3]))]
    cls = np.array([r.randrange(cm.CLASSES) for _ in words])
    began = time.process_time()
    _, bit, slots = cm._bits(words, cls)
    placed = time.process_time() - began
    want = [np.bincount(2 * s + bit, minlength=2 * cm.SLOTS) for s in slots]
    got = [np.zeros(2 * cm.SLOTS) for _ in cm.ORDERS]
    began = time.process_time()
    cm._count_bits(words, cls, got)
    assert time.process_time() - began < 4 * placed
    assert all((g == w).all() for g, w in zip(got, want))
    cm._count_bits([], cls[:0], got)
    assert all((g == w).all() for g, w in zip(got, want))


def test_frequent_beginnings_are_those_of_all_words(spark, monkeypatch):
    from pairloom.llm import context_mixing as cm

    r = random.Random(15)
    words = sorted({bytes(r.choice(b"aab\x00\xc3\xff'") for _ in range(r.randint(0, 40))) + b" " for _ in range(3_000)} | {b"a" * k + bytes([c]) + b" " for k in range(40) for c in range(98, 110)})
    df = cm.materialize(spark.createDataFrame([(w,) for w in words], "w binary"))
    n = Counter(w[:k] for w in words for k in range(1, min(len(w), cm.LONGEST) + 1))
    for most in (256, 40):
        monkeypatch.setattr(cm, "OPEN", most)
        for least in (0.9, 2, 7.5, 100, 10_000):
            got = cm._often(df, least)
            assert got == sorted((w for w in n if n[w] > least), key=lambda w: (-n[w], w))[:most - 1]
    open_ = cm.opened(words, 20)
    tops, starts = cm.grouped(words, open_)
    assert [cm.group_of(w, open_) for w in words] == [t for t, k in zip(tops, np.diff(starts, append=len(words))) for _ in range(k)]
    assert cm.grouped([], open_)[0] == []
