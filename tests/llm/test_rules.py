import math
import random

import numpy as np
from pyspark.sql import functions as F

from kinloom.llm import quality_rules as q
from tests.llm.common import ODD, docs, words


def slow_statistics(text):
    blanks = " \t\n\x0b\x0c\r"
    ws = [w for w in __import__("re").split(f"[{blanks}]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(blanks)]
    seen, twice = {}, set()
    for i in range(len(ws) - 4):
        seen.setdefault(tuple(ws[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            twice.update(i + k for i in at for k in range(5))
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice)


def fast_mcd(vectors, starts=300, seed=0):
    """Squared distances by the usual search: concentration steps from random subsets, the least determinant, then a step over all near rows."""
    x, g = np.array(vectors, dtype=float), np.random.default_rng(seed)
    floors, h = np.diag([(f * q.GRID) ** 2 for f in q.FLOORS]), math.ceil(q.SUBSET * len(x))

    def fitted(own, widen):
        return own.mean(axis=0), np.cov(own.T, bias=True) * widen + floors

    def away(mean, cov):
        return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)

    best = None
    for _ in range(starts):
        mean, cov = fitted(x[g.choice(len(x), q.DIMS + 1, replace=False)], 1.0)
        before = math.inf
        while True:
            mean, cov = fitted(x[np.argsort(away(mean, cov), kind="stable")[:h]], q.WIDEN_SUBSET)
            det = np.linalg.slogdet(cov)[1]
            if det >= before - 1e-9:
                break
            before = det
        if best is None or det < best[0]:
            best = det, mean, cov
    mean, cov = fitted(x[away(*best[1:]) < q.NEAR], q.WIDEN_NEAR)
    return away(mean, cov)


def test_statistics(spark):
    texts = [*ODD, "a b c d e a b c d e", "x x x x x x x", "one two three four five six\none two three four five\n\none two three four five", " ".join(words(300, 1)) + " " + " ".join(words(300, 1)), "| # $ % & < > *\n|"]
    found = {r.doc_id: r for r in q.statistics(docs(spark, texts, extra=True)).collect()}
    for i, t in enumerate(texts):
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_statistics(t), t


def test_outliers_by_group(spark):
    r = random.Random(5)
    texts, groups = [], []
    for k in range(151):
        texts.append(" ".join(w + "***$$#" * (k % 15 == 0 and k < 146 or k == 150) for w in words(r.randint(20, 200), k)))
        groups.append(("en", "a") if k < 100 else ("fr", "b") if k < 145 else (None, None))
    rows = [(k, t, *g, len(t)) for k, (t, g) in enumerate(zip(texts, groups))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {x.doc_id: x for x in q.quality_rules(spark, df).collect()}
    for group in {("en", "a"), ("fr", "b")}:
        ids = [k for k in range(151) if groups[k] == group and not found[k].base_failed]
        vectors = []
        for k in ids:
            n, chars, symbols, dup, rep = slow_statistics(texts[k])
            lines = len([x for x in texts[k].split("\n") if x.strip()])
            values = (math.log(1 + n), math.log(chars / n), math.log(1 + 100 * symbols / chars), dup / lines, rep / n)
            vectors.append([math.floor(q.GRID * v + 0.5) for v in values])
        judge(vectors, [found[k].kept for k in ids])
    # no source or language of those five has enough rows, so all rows judge them
    assert not found[150].kept and found[150].n_words >= 10 and not found[150].base_failed and found[146].kept


def judge(vectors, kept):
    d = fast_mcd(vectors)
    clear = np.abs(d / q.CUTOFF - 1) > 0.15
    assert clear.mean() > 0.9 and (np.array(kept) == (d <= q.CUTOFF))[clear].all()
    assert not all(kept) and sum(kept) > 0.8 * len(kept)


def test_outliers_that_lie_together(spark):
    """A fifth of the rows in one dense place, which a mean and covariance of all rows would take for normal ones."""
    r = random.Random(8)
    texts = [" ".join(words(r.randint(60, 200), k)) for k in range(160)] + [" ".join("qwertyuiopasdfg" + "|" * 9 for _ in range(12)) + f" {k}" for k in range(40)]
    df = spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    found = {x.doc_id: x for x in q.quality_rules(spark, df).collect()}
    fine = [k for k in range(160) if not found[k].base_failed]
    assert sum(found[k].kept for k in fine) >= len(fine) - 3
    assert not any(found[k].kept for k in range(160, 200))


def test_odd_rows(spark):
    rows = {r.doc_id: r for r in q.quality_rules(spark, docs(spark, [*ODD, *ODD], extra=True)).collect()}
    n = len(ODD)
    assert len(rows) == 2 * n and all(rows[i].kept == rows[i + n].kept for i in range(n))
    assert rows[0].base_failed and not rows[0].kept and rows[0].n_words == 0
    assert q.quality_rules(spark, docs(spark, [])).count() == 0


def test_constants():
    # regularised gamma function for whole and half arguments, by its series
    def below(df, x):
        a, s, t, n = df / 2, 0.0, 1 / (df / 2), 0
        while t > 1e-17:
            s, n = s + t, n + 1
            t *= (x / 2) / (a + n)
        return s * math.exp(-x / 2 + a * math.log(x / 2) - math.lgamma(a))

    assert abs(below(5, q.NEAR) - 0.975) < 1e-3 and abs(below(5, q.CUTOFF) - 0.99999) < 2e-6
    assert abs(q.WIDEN_NEAR - 0.975 / below(7, q.NEAR)) < 1e-3
    x75 = next(x / 1000 for x in range(1, 20000) if below(5, x / 1000) >= 0.75)
    assert abs(q.WIDEN_SUBSET - 0.75 / below(7, x75)) < 1e-3
