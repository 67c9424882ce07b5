import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.llm.quality_classifier import BITS, dual_coordinate_descent, fit, held_out, indicators, learn_quality, log_count_ratios, logistic_curve, score_quality, shape_hashes, word_hashes
from tests.llm.common import ODD, docs

DATA = "/root/testdata/sf0.1"


def test_dual_coordinate_descent_reaches_the_optimum():
    r = random.Random(0)
    rows = [np.array(sorted({r.randrange(6), r.randrange(6), 6 + (k % 2)}), np.int32) for k in range(40)]
    labels = np.array([int((k % 2 == 0) ^ (r.random() < 0.2)) for k in range(40)])
    w, bias = dual_coordinate_descent(rows, labels, np.ones(1 << 18), epochs=3000, tolerance=1e-9)
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.array([(labels == y).sum() for y in (0, 1)])
    costs = 20 / share[labels]
    x = np.zeros((40, 9))
    for k, own in enumerate(rows):
        x[k, own] = 1 / np.sqrt(len(own))
        x[k, 8] = 1

    def objective(v):
        return v @ v / 2 + (costs * np.maximum(0, 1 - sign * (x @ v))).sum()

    best = np.append(w[:8], bias)
    at = objective(best)
    generator = np.random.default_rng(0)
    for scale in (1e-1, 1e-2, 1e-3):
        for _ in range(300):
            assert objective(best + scale * generator.normal(size=9)) >= at - 1e-5


def test_ratios_and_curve():
    rows = [np.array([1, 2], np.int32)] * 6 + [np.array([2, 3], np.int32)] * 6 + [np.array([9], np.int32)]
    ratios = log_count_ratios(rows, np.array([1] * 6 + [0] * 6 + [1]))
    assert ratios[1] > 0 > ratios[3] and abs(ratios[2]) < 0.3 and ratios[9] == 0
    slope, shift = logistic_curve(np.array([-2.0, -1, 1, 2] * 20), np.array([0, 0, 1, 1] * 20))
    assert slope > 0 and abs(shift) < 0.2


@pytest.mark.parametrize("labels", [[], [(0, 1, 0)], [(0, 1, 0), (None, 0, 0), (3, None, 0)]])
def test_few_labels_give_one_score(spark, labels):
    df = docs(spark, ODD, extra=True)
    model = learn_quality(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True))
    assert len({round(r.score, 9) for r in score_quality(spark, df, model, "doc_id").collect()}) == 1


def test_held_out_accuracy(spark):
    read = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet")
    model = learn_quality(read("documents"), read("labels"), ~held_out(F.col("doc_id")))
    rows = score_quality(spark, read("documents"), model, "doc_id").join(read("labels"), "doc_id").filter(held_out(F.col("doc_id"))).select("score", "quality").collect()
    good, bad = (np.array([r.score for r in rows if r.quality == q]) for q in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.995
    assert (good >= 0.7).mean() > 0.99 and (bad < 0.7).mean() > 0.97


def test_scores_depend_on_the_text_alone(spark):
    rows = ["good clean words here"] * 8 + ["BAD!! WORDS!! HERE!!"] * 8
    model = fit(indicators(rows), np.array([1] * 8 + [0] * 8))
    df = docs(spark, [*ODD, *rows, *ODD], extra=True)
    found = {r.doc_id: r.score for r in score_quality(spark, df, model, "doc_id").collect()}
    n = len(ODD)
    assert all(0 <= s <= 1 for s in found.values()) and all(found[i] == found[i + n + 16] for i in range(n))
    assert found[n] > found[n + 8] and found[0] == found[1] == found[2]


def test_words_and_shapes():
    texts = ["The the THE", "", "  a\u00a0b ", "Ab12!!x Qrs345!z Äöß\u3000É", "x" * 700 + " y"]
    w = word_hashes(texts)
    s, counts = shape_hashes(texts)
    assert counts.tolist() == [len(t.split()) for t in texts] and len(w) == len(s) == counts.sum()
    assert w[0] == w[1] == w[2] and s[0] != s[1] != s[2] and w[3] != w[4] and s[3] == s[4]
    assert s[5] == s[6] and s[7] == s[0] and s[8] == s[2] and len(indicators([texts[4]])[0]) > 3


def test_scores_against_brute_force(spark):
    """Margins by sums over sets made of the words' hashes one by one."""
    texts = [*ODD, *(" ".join(f"w{(i * j) % 7}{'X' * (j % 3)}" for j in range(i)) for i in range(1, 40))] * 2
    labels = np.array([i % 2 for i in range(len(texts))])
    model = fit(indicators(texts), labels)
    m = (1 << 64) - 1
    a, b, c, d = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0x94D049BB133111EB

    def slow(text):
        ws = (text or "").split()
        w = [int(word_hashes([x])[0]) for x in ws]
        s = [int(shape_hashes([x])[0][0]) for x in ws]
        raw = [x * a for x in w] + [x * b for x in s] + [w[i] * b + w[i + 1] * c for i in range(len(w) - 1)] + [s[i] * c + s[i + 1] * d for i in range(len(w) - 1)]
        raw += [s[i] * a + s[i + 1] * d + s[i + 2] * c for i in range(len(w) - 2)]
        same = [int(x == y) for x, y in zip(w, w[1:])]
        raw += [(sum(same[i + k] << k for k in range(4)) + 77) * d for i in range(len(same) - 3)]
        own = {(((x & m) ^ (x & m) >> 31) * a & m) >> (64 - BITS) for x in raw}
        r = np.array([model.ratios[i] for i in own])
        margin = model.bias + (sum(model.weights[i] for i in own) / np.sqrt(r @ r) if len(own) and r.any() else 0)
        return 1 / (1 + np.exp(-(model.slope * margin + model.shift)))

    df = docs(spark, texts, ids=[None, *range(len(texts) - 2), 3])
    found = score_quality(spark, df, model, "doc_id", "text").collect()
    assert len(found) == len(texts) and all(abs(r.score - slow(r.text)) < 1e-4 for r in found)
    assert score_quality(spark, docs(spark, []), model, "doc_id").count() == 0
