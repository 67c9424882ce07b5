import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.llm import topk_search as t


def slow(rows, k, asks):
    x = {}
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            own = tuple(math.floor(256 * c) for c in np.array(v, np.float32).astype(float))
            x.setdefault((i, len(v)), []).append(own)
    x = {key: max(vs) for key, vs in x.items()}
    out = set()
    for (i, d), v in x.items():
        if asks(i):
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for (j, e), w in x.items() if e == d and j != i)[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(t, "BLOCK_ROWS", 100)
    g = np.random.default_rng(1)
    rows = [(i, [float(x) for x in g.normal(size=8) * 0.3]) for i in range(400)]
    rows += [(400 + i, rows[i % 3][1]) for i in range(60)]  # ties
    rows += [(600, None), (602, [1.0, None] * 4), (604, [math.nan] * 8), (606, [math.inf] * 8), (None, [0.1] * 8), (608, [0.0] * 8), (610, [0.5, 0.5]), (612, [0.25, -0.5]), (614, []), (10, rows[7][1]), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("id", "d", "block", "score", "rank", "label")})
    found = t.topk_search(spark, df, F.col("vec_id") % 20 == 0).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found} == slow(rows, 5, lambda i: i % 20 == 0)


@pytest.mark.parametrize("scale", [1, 1 << 12, 1 << 24])
def test_search_is_exact_at_any_size(scale):
    g = np.random.default_rng(2)
    x = np.floor(g.normal(size=(500, 16)) * scale * 3).astype(np.int64)
    block = t.ImpactBlock(np.arange(500), x)
    q, v, s = block.search(x[:40], np.arange(40), 5, few=6)
    exact = x[:40].astype(object) @ x.T.astype(object)
    for i in range(40):
        best = sorted((-exact[i, j], j) for j in range(500) if j != i)[:5]
        assert [(int(a), int(b)) for a, b in zip(-s[q == i], v[q == i])] == [(int(a), b) for a, b in best]


def test_stops_early_on_proof(monkeypatch):
    seen = []
    x = np.zeros((200, 8), np.int64)
    x[np.arange(200), np.arange(200) % 8] = 100 + np.arange(200)
    x[:, 7] += 1
    block = t.ImpactBlock(np.arange(200), x)
    original = block.segments
    block.segments = type("S", (list,), {"__iter__": lambda self: (seen.append(1) or s for s in list.__iter__(self))})(original)
    block.search(x[:5], np.arange(5), 3)
    assert len(seen) < len(original)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert t.topk_search(spark, df, F.col("vec_id") % 50 == 0).count() == 0
    assert t.topk_search(spark, spark.createDataFrame([(1, [1.0])], df.schema), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("size", [1e7, 1e12])
def test_large_components(spark, size):
    g = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(g.normal(size=6) * size)]) for i in range(80)]
    found = t.topk_search(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()
    assert {(r.query_id, r["rank"], r.vec_id, int(r.score)) for r in found} == slow(rows, 5, lambda i: i % 20 == 0)


@pytest.mark.parametrize("size", [1e30, -1e30, 3e14, -3e14])
def test_too_large_components_are_refused(spark, size):
    with pytest.raises(ValueError, match="components beyond"):
        t.topk_search(spark, spark.createDataFrame([(1, [0.5, size])], "vec_id long, embedding array<float>"), F.lit(True))
