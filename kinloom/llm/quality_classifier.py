"""Quality classifier: naive Bayes support vectors over n-gram indicators.

A text has an indicator for each hashed n-gram that it holds: words and pairs of words; shapes of words (runs of capitals, small
letters and digits, other characters as they are), one to three in a row; and which of five words in a row equal the word before
them.  Indicators are scaled by the log ratio of their smoothed shares in both classes, and vectors to length 1.  A linear
hinge-loss model is fitted to them by dual coordinate descent and drawn towards its mean weight.  Margins of folds that a model hasn't seen
give the logistic curve that turns margins into scores.

The model is fitted on the driver, on at most ``max_rows`` labelled rows; the shares of indicators are those of the same rows.
Its size is fixed, 2 ** ``BITS`` weights, so it is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinloom.llm.workers import release, sliced

BITS = 18
MAX_ROWS = 6000
#: Indicators of fewer training rows are left out.
LEAST_ROWS = 4
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0x94D049BB133111EB))


def _random(n: int) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=np.uint64) * _A
    x = (x ^ (x >> np.uint64(32))) * _C
    return (x ^ (x >> np.uint64(29))) * _D | np.uint64(1)


#: What multiplies a character by its place in a word.
_PLACE = _random(256)
_BLANK = np.zeros(0x110000, bool)
_BLANK[[c for c in range(0x3001) if chr(c).isspace()]] = True
#: Capitals, small letters and digits in one class each; other characters are their own.
_CLASS = np.arange(0x110000, dtype=np.uint32)
for _first, _last, _sign in (("A", "Z", "A"), ("À", "Ö", "A"), ("Ø", "Þ", "A"), ("a", "z", "a"), ("ß", "ö", "a"), ("ø", "ÿ", "a"), ("0", "9", "0")):
    _CLASS[ord(_first) : ord(_last) + 1] = ord(_sign)


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of words end to end, the place where each word starts there, and how many words each text has."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    cuts = np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))
    inner = ~_BLANK[chars]
    fresh = np.append(True, ~inner[:-1])[: len(inner)]
    fresh[cuts[cuts < len(inner)]] = True
    first = np.flatnonzero(inner & fresh)
    return chars[inner], np.cumsum(inner)[first] - 1, np.diff(np.searchsorted(first, cuts))


def _hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64 bits for each run of values."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = np.diff(np.append(starts, len(values)))
    place = np.arange(len(values)) - np.repeat(starts, sizes)
    by = _PLACE[place & 255]
    if int(sizes.max()) > 256:
        by = by * (2 * (place >> 8) + 1).astype(np.uint64)
    x = np.add.reduceat((values + np.uint32(1)).astype(np.uint64) * by, starts) + sizes.astype(np.uint64) * _B
    x = (x ^ (x >> np.uint64(32))) * _C
    return x ^ (x >> np.uint64(29))


def word_hashes(texts: list[str]) -> np.ndarray:
    """Of words in small letters, end to end."""
    chars, starts, _ = _words([t.lower() for t in texts])
    return _hashes(chars, starts)


def shape_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of the shapes of words, end to end, and how many words each text has."""
    chars, starts, counts = _words(texts)
    signs = _CLASS[chars]
    kept = np.append(True, signs[1:] != signs[:-1])[: len(signs)]
    kept[starts] = True
    return _hashes(signs[kept], np.cumsum(kept)[starts] - 1 if len(starts) else starts), counts


def indicators(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct hashed indicators of each text; nothing is kept from one call to the next."""
    texts = [t or "" for t in texts]
    words = word_hashes(texts)
    shapes, counts = shape_hashes(texts)
    ends = np.cumsum(counts).tolist()
    return [_of(words[a:b], shapes[a:b]) for a, b in zip([0, *ends], ends)]


def _of(w: np.ndarray, s: np.ndarray) -> np.ndarray:
    parts = [w * _A, s * _B]
    if len(w) > 1:
        parts += [w[:-1] * _B + w[1:] * _C, s[:-1] * _C + s[1:] * _D]
    if len(w) > 2:
        parts.append(s[:-2] * _A + s[1:-1] * _D + s[2:] * _C)
    if len(w) > 4:
        same = (w[1:] == w[:-1]).astype(np.uint64)
        parts.append((same[:-3] + same[1:-2] * np.uint64(2) + same[2:-1] * np.uint64(4) + same[3:] * np.uint64(8) + np.uint64(77)) * _D)
    x = np.concatenate(parts)
    x = ((x ^ (x >> np.uint64(31))) * _A >> np.uint64(64 - BITS)).astype(np.int32)
    if len(x) < 1 << (BITS - 4):
        return np.unique(x)
    seen = np.zeros(1 << BITS, bool)
    seen[x] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray  # of indicators, ratios already multiplied in
    ratios: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, indicators: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(indicators))
        for k, own in enumerate(indicators):
            r = self.ratios[own]
            norm = math.sqrt(float(r @ r))
            out[k] = self.bias + (float(self.weights[own].sum()) / norm if norm else 0.0)
        return out

    def scores(self, indicators: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(indicators) + self.shift, -60, 60)))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Of each indicator; 0 for those of too few rows."""
    n = 1 << BITS
    good, bad = (np.bincount(np.concatenate([r for r, y in zip(rows, labels) if y == k] or [np.zeros(0, np.int32)]), minlength=n).astype(float) for k in (1, 0))
    p, q = good + smooth, bad + smooth
    ratio = np.log((p / (labels.sum() + 2 * smooth)) / (q / ((1 - labels).sum() + 2 * smooth)))
    return np.where(good + bad >= LEAST_ROWS, ratio, 0.0)


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = 1.0, epochs: int = 20, tolerance: float = 1e-3, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model: one dual variable at a time, in random order, between 0 and its cost.

    The costs of both classes weigh the same in sum.
    """
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.array([max(1, (labels == y).sum()) for y in (0, 1)])
    costs = cost * len(rows) / 2 / share[labels]
    values = []
    for own in rows:
        r = ratios[own]
        norm = math.sqrt(float(r @ r))
        values.append(r / norm if norm else r)
    square = np.array([float(v @ v) + 1.0 for v in values])
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)):
            own, v = rows[i], values[i]
            gradient = sign[i] * (float(w[own] @ v) + bias) - 1
            old = alpha[i]
            new = min(max(old - gradient / square[i], 0.0), costs[i])
            if new != old:
                step = (new - old) * sign[i]
                w[own] += step * v
                bias += step
                alpha[i] = new
                most = max(most, abs(new - old))
        if most < tolerance:
            break
    return w, bias


def fit_part(rows: list[np.ndarray], labels: np.ndarray, blend: float) -> Model:
    ratios = log_count_ratios(rows, labels)
    w, bias = dual_coordinate_descent(rows, labels, ratios)
    used = ratios != 0
    mean = np.abs(w[used]).mean() if used.any() else 0.0
    w = (1 - blend) * mean + blend * w
    return Model((w * ratios).astype(np.float32), ratios.astype(np.float32), bias)


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, with targets drawn in a little so that the slope stays finite."""
    good, bad = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, shift = 1.0, math.log((good + 1) / (bad + 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -60, 60)))
        g = np.array([((p - target) * margins).sum() + 1e-6 * slope, (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margins * margins).sum() + 1e-6, (v * margins).sum()], [(v * margins).sum(), v.sum()]])
        step = np.clip(np.linalg.solve(h, g), -5, 5)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(slope), float(shift)


def fit(rows: list[np.ndarray], labels: np.ndarray, blend: float = 0.5, folds: int = 4) -> Model:
    """The model of all rows, with the curve of margins that models of the other folds give to each fold."""
    if len(set(labels.tolist())) < 2:  # nothing to tell apart: the share of label 1, drawn towards one half
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 0.0, 1.0, math.log(share / (1 - share)))
    fold = np.arange(len(rows)) % folds
    margins = np.zeros(len(rows))
    for f in range(folds):
        seen = np.flatnonzero(fold != f)
        if len(set(labels[seen].tolist())) == 2:
            margins[fold == f] = fit_part([rows[i] for i in seen], labels[seen], blend).margins([rows[i] for i in np.flatnonzero(fold == f)])
    model = fit_part(rows, labels, blend)
    model.slope, model.shift = logistic_curve(margins, labels)
    return model


def indicators_of(docs: DataFrame, *kept: str) -> DataFrame:
    """The ``kept`` columns of docs, and ``found``: the indicators of text, 32 bits each."""
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in sliced(batches, n):
            yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array([x.astype("<i4").tobytes() for x in indicators(part.column(n).to_pylist())], pa.binary())], names=[*kept, "found"])

    types = dict(docs.dtypes)
    return docs.select(*kept, "text").mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in kept), "found binary"]))


def learn_quality(docs: DataFrame, labels: DataFrame, may_learn: Column, max_rows: int = MAX_ROWS) -> Model:
    """Fits on at most ``max_rows`` labelled rows: those of the least hashes of doc_id, of the rows of ``labels`` with ``may_learn``.

    Rows with a null id or label are left out.  Without labels of both classes every text has the same score.
    """
    known = labels.filter(may_learn & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    # at most max_rows rows are broadcast, and as many come to the driver
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = indicators_of(sample, "doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "found").limit(max_rows).collect()
    return fit([np.frombuffer(r["found"], "<i4") for r in rows], np.array([r["quality"] for r in rows], dtype=np.int64))


def score_quality(spark: SparkSession, docs: DataFrame, model: Model, *kept: str) -> DataFrame:
    """The ``kept`` columns of ``docs`` and ``score`` (0 to 1, higher: label 1 likelier), from the text alone.

    Null and empty texts have no indicators and get the score of the bias.  Equal texts have equal scores.  Other columns are not
    read.
    """
    shared = spark.sparkContext.broadcast(model)
    n = len(kept)
    at = kept.index("text") if "text" in kept else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model = shared.value
        for part in sliced(batches, at):
            yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(model.scores(indicators(part.column(at).to_pylist())))], names=[*kept, "score"])

    types = dict(docs.dtypes)
    read = docs.select(*kept) if at < n else docs.select(*kept, F.col("text").alias("scored_text"))
    return read.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in kept), "score double"]))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text has remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
