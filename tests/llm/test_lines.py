from collections import Counter

import numpy as np
import pytest

from kinloom.llm import line_dedup as m
from tests.llm.common import EXTRA, ODD, docs, words

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def slow(texts, min_docs, min_chars):
    lines = [(t or "").split("\n") for t in texts]
    counts = Counter(k for ls in lines for k in {key(x) for x in ls} if len(k) >= min_chars)
    out = []
    for ls in lines:
        kept = [x for x in ls if not (len(key(x)) >= min_chars and counts[key(x)] >= min_docs)]
        out.append((len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


TEXTS = [*ODD, *("\n".join([f"Common {k % 3}", " ".join(words(5, k)), "  common 1\t", "É", "end"][k % 2 :]) for k in range(40))]


@pytest.mark.parametrize(("hot", "min_docs", "min_chars"), [(4096, 5, 1), (0, 5, 1), (2, 5, 4), (4096, 1, 1), (1, 10, 2)])
def test_against_counts(spark, monkeypatch, hot, min_docs, min_chars):
    monkeypatch.setattr(m, "SHARD_DIGESTS", 40)
    df = docs(spark, TEXTS, extra=True)
    found = {r.doc_id: r for r in m.dedup_lines(spark, df, min_docs, min_chars, hot, keep=("source", "key")).collect()}
    expected = slow(TEXTS, min_docs, min_chars)
    assert [(found[i].n_lines, found[i].n_dropped, found[i].text) for i in range(len(TEXTS))] == expected
    assert all(r.source == "s" and r.key == "x" for r in found.values()) and EXTRA


def test_rows_without_ids_and_repeated(spark):
    texts = ["a\nb"] * 6 + ["a\nc"] * 2
    rows = m.dedup_lines(spark, docs(spark, texts, ids=[None, None, 1, 1, 2, 3, None, 4]), 6, 1, 0).collect()
    assert sorted((r.text, r.n_dropped) for r in rows) == [("", 2)] * 6 + [("c", 1)] * 2
    assert m.dedup_lines(spark, docs(spark, [])).count() == 0


def test_many_rows_without_ids(spark):
    texts = [f"shared\nown {k}" for k in range(300)]
    rows = m.dedup_lines(spark, docs(spark, texts, ids=[None] * 300), 10, 1, 0).collect()
    assert sorted(r.text for r in rows) == sorted(f"own {k}" for k in range(300))


def test_shards_count_all_lines(spark):
    counts = m.line_counts(docs(spark, ["a\nb", "a\nc", "a"]), 1)
    arrays = m.build_shards(counts, 3).filter("copy = 0").collect()
    assert sorted(n for r in arrays for n in m.LineShard.loads(r.sizes, r.bits, r.prints, r.counts).counts.tolist()) == [1, 1, 3]


@pytest.mark.parametrize("n", [0, 1, 5, 1000, 20000])
def test_perfect_hash(n):
    g = np.random.default_rng(n)
    h = g.integers(0, 1 << 63, (n, 2)).astype(np.uint64)
    if n > 5:
        h[: n // 2, 0] = h[0, 0]  # only the second half tells these apart
    index = m.PerfectHash.build(h)
    assert sorted(index.slots(h).tolist()) == list(range(n))
    shard = m.LineShard.loads(*m.LineShard.build(h, np.arange(1, n + 1)).dumps())
    assert shard.count(h).tolist() == list(range(1, n + 1))
    assert not shard.count(g.integers(0, 1 << 63, (2000, 2)).astype(np.uint64)).any()
