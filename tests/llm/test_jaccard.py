import random

import numpy as np
import pytest

from kinloom.llm import jaccard_join as j
from kinloom.llm.components import components
from kinloom.llm.scratch import Scratch
from tests.llm.common import ODD, docs, words


def shingles(text, k):
    ws = (text or "").encode().lower().split()
    n = min(k, len(ws))
    return frozenset(tuple(ws[i : i + k]) for i in range(len(ws) - n + 1)) if ws else frozenset()


def slow(ids, texts, k, num, den):
    sets = [shingles(t, k) for t in texts]
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(ids[a]), root(ids[b])))
                up[y] = x
    return sorted((i, len(s), root(i)) for i, s in zip(ids, sets))


def families(seed, n, size, edits):
    r = random.Random(seed)
    out = []
    for f in range(n):
        base = words(r.choice([3, 8, 20, 60, 200]), seed * 100 + f)
        for _ in range(r.randint(1, size)):
            own = list(base)
            for _ in range(r.randint(0, edits)):
                own[r.randrange(len(own))] = r.choice("pqrstuvw")
            out.append(" ".join(own))
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("k", "num", "den", "chunk", "hot", "often"), [(4, 85, 100, 1024, 1 << 19, 3), (5, 4, 5, 1024, 0, 3), (2, 1, 2, 4, 9, 2), (1, 9, 10, 3, 1 << 19, 1)])
def test_against_all_pairs(spark, monkeypatch, k, num, den, chunk, hot, often):
    for name, value in (("CHUNK", chunk), ("HOT", hot), ("OFTEN", often)):
        monkeypatch.setattr(j, name, value)
    texts = [*ODD, *families(k, 25, 12, 8)]
    ids = [3 * i + 7 for i in range(len(texts))]
    found = j.jaccard_components(spark, docs(spark, texts, extra=True, ids=ids), k, num, den)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == slow(ids, texts, k, num, den)


def test_shared_passage_is_no_link(spark):
    passage = " ".join(words(60, 1))
    texts = [passage + " " + " ".join(words(90, 10 + i)) for i in range(50)]
    assert all(r.doc_id == r.component_id for r in j.jaccard_components(spark, docs(spark, texts), 4, 85, 100).collect())


def test_null_and_repeated_ids(spark):
    texts = ["a b c d e f", "a b c d e f", "x y z u v w", "x y z u v w", "q q q q q"]
    rows = sorted(((r.doc_id, r.component_id) for r in j.jaccard_components(spark, docs(spark, texts, ids=[5, None, 5, 9, 2]), 4, 85, 100).collect()), key=str)
    assert rows == sorted([(5, 5), (None, None), (5, 5), (9, 5), (2, 2)], key=str) or rows == sorted([(5, None), (None, None), (5, None), (9, 9), (2, 2)], key=str)
    assert j.jaccard_components(spark, docs(spark, [])).count() == 0
    assert j.jaccard_components(spark, docs(spark, [None, "", " "])).count() == 3


def test_linked_sets_share_a_token_and_pass_the_bound():
    g = np.random.default_rng(0)
    for _ in range(1500):
        a = np.unique(g.integers(0, 1 << 62, int(g.integers(1, 150))).astype(np.uint64))
        b = np.unique(np.concatenate([a[g.permutation(len(a))[int(g.integers(0, 9)) :]], g.integers(0, 1 << 62, int(g.integers(0, 9))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        some = np.unique(np.concatenate([a, b]))[:: int(g.integers(1, 4))]
        hot = j.Hot(some, g.integers(1, 5000, len(some)))
        for t in (j.Threshold(85, 100), j.Threshold(4, 5), j.Threshold(1, 2), j.Threshold(1, 1)):
            if len(b) and t.den * common >= t.num * (len(a) + len(b) - common):
                ta, tb = (j.tokens(x, np.array([len(x)]), t, hot)[0] for x in (a, b))
                assert len(np.intersect1d(ta, tb))
                assert np.minimum(*j.folded([j.point(a), j.point(b)])).sum() >= t.least_common(np.int64(len(a) + len(b)))


def test_leaders_lead_what_the_bound_allows():
    g = np.random.default_rng(5)
    points = g.poisson(2, (300, 64))
    points[100:] = np.maximum(points[g.integers(0, 100, 200)] + g.integers(-1, 2, (200, 64)) * (g.random((200, 64)) < 0.05), 0)
    sizes, doc, t = points.sum(axis=1), g.permutation(300) * 3, j.Threshold(4, 5)
    led, last = j.leaders(doc, sizes, points, t)
    at = {d: i for i, d in enumerate(doc.tolist())}
    heads = set(led.tolist())
    assert all(led[at[h]] == h for h in heads) and len(heads) < 200
    may = lambda a, b: np.minimum(points[a], points[b]).sum() >= t.least_common(sizes[a] + sizes[b])
    assert all(d == h or h < d and may(at[h], at[d]) for d, h in zip(doc.tolist(), led.tolist()))
    assert all(d == h and e == d or h <= e < d and may(at[e], at[d]) and led[at[e]] == e for d, h, e in zip(doc.tolist(), led.tolist(), last.tolist()))
    near = lambda a, b: may(a, b) and t.num * max(sizes[a], sizes[b]) <= t.den * min(sizes[a], sizes[b])
    assert not any(a < b and near(at[a], at[b]) for a in heads for b in heads)


def test_tree_finds_what_the_bound_allows():
    g = np.random.default_rng(3)
    points = g.poisson(3, (300, 64))
    points[150:] = np.maximum(points[:150] + g.integers(-1, 2, (150, 64)) * (g.random((150, 64)) < 0.1), 0)
    sizes, t = points.sum(axis=1), j.Threshold(4, 5)
    q, p = j.CountTree(points, sizes).search(points[::7], sizes[::7], t)
    got = set(zip((q * 7).tolist(), p.tolist()))
    assert len(got) == len(q)
    for i in range(0, 300, 7):
        bound = np.minimum(points, points[i]).sum(axis=1)
        allowed = set(np.flatnonzero(bound >= t.least_common(sizes + sizes[i])).tolist())
        needed = {x for x in allowed if t.num * sizes[x] <= t.den * sizes[i] and t.num * sizes[i] <= t.den * sizes[x]}
        assert needed <= {x for y, x in got if y == i} <= allowed


def test_components_of_chains_and_stars(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(300, 201), (201, 299), (5, 5)] + [(r.randrange(400, 500), r.randrange(400, 500)) for _ in range(60)]
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    found = components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "c")
    assert {(x.node, x.component) for x in found.collect()} == {(x, root(x)) for x in up}
    assert components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long"), "c").count() == 0


def test_doubled_table_against_all_pairs(spark):
    # two documents of a family link, but both most often meet a third one, which doesn't link; families are unrelated and alike in size
    texts = []
    for f in range(12):
        core, two, a, b, c = ([f"{kind}{f}x{i}" for i in range(n)] for kind, n in (("core", 130), ("two", 8), ("a", 8), ("b", 12), ("c", 12)))
        texts += [" ".join(core + a + b[:6] + c[:6]), " ".join(core + two + b), " ".join(core + two + c)]
    ids, texts = [*range(len(texts))] * 2, texts * 2
    expected = slow(ids, texts, 1, 85, 100)
    assert sum(i != c for i, _, c in expected) == 24
    found = j.jaccard_components(spark, docs(spark, texts, ids=ids), 1, 85, 100)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == expected
