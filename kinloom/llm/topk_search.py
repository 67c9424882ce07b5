"""Exact top-k search by integer inner product over an impact-ordered index, a segment of scores at a time.

Vectors are dealt to blocks.  A block's postings (dimension, vector, impact) are cut into segments by the quantised size of the
impact, largest first, with what the later segments can still add: the norm of each vector's other components.  A query takes
the segments in this order and adds each to the running scores.  After a segment, a vector's score lies within the running score
plus or minus the product of the rest norms (Cauchy-Schwarz).  The query stops when at most ``few`` vectors can be among its k
best, which is a proof for all others; these few are then scored exactly.  If that never comes, the last segment leaves
nothing open.

The stated queries meet all blocks, in groups of ``QUERY_ROWS``; each meeting gives k rows for a query at most, and a window with a
group limit merges them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from kinloom.llm.scratch import Scratch, shuffle_partitions

BLOCK_ROWS = 8192
QUERY_ROWS = 512
#: Least impacts of the segments, as parts of the block's largest.
CUTS = (0.35, 0.2, 0.1, 0.05)
FEW = 64
#: Scaled components beyond this are refused; scores of components up to it have at most 38 digits.
LARGEST = 1 << 56


def usable(vector: Column) -> Column:
    """Whether a vector takes part: neither null nor with null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


class ImpactBlock:
    """Impact-ordered postings of some vectors of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        # by id, then by the first components first; the last row of an id stands for it
        order = np.lexsort((*vectors.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids, kind="stable")
        order = order[np.append(np.diff(ids[order]) != 0, True)[: len(order)]]
        self.ids, self.vectors = ids[order], vectors[order]
        size = np.abs(self.vectors)
        top = int(size.max(initial=0))
        self.top = top
        levels = sorted({max(1, int(c * top)) for c in CUTS} | {1}, reverse=True)
        self.segments, rest, above = [], (self.vectors.astype(np.float64) ** 2).sum(axis=1), None
        for level in levels:
            own = size >= level if above is None else (size >= level) & (size < above)
            dims, rows = np.nonzero(own.T)  # postings by dimension, then vector
            impacts = self.vectors[rows, dims]
            rest = np.maximum(rest - np.where(own, self.vectors.astype(np.float64) ** 2, 0).sum(axis=1), 0)
            # a little more than the norm, for the rounding of the square root
            self.segments.append((dims, rows, impacts, np.ceil(np.sqrt(rest))))
            above = level

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, few: int = FEW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, vector id and score of the k best vectors of each query; a query's own id is left out."""
        n, (m, d) = len(self.ids), queries.shape
        bound = d * self.top * int(np.abs(queries).max(initial=0))
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object
        out_q, out_i, out_s = [], [], []
        left, score = np.arange(m), np.zeros((m, n), kind)
        norm = np.ceil(np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)))
        itself = np.searchsorted(self.ids, own)
        here = (itself < n) & (self.ids[np.minimum(itself, n - 1)] == own) if n else np.zeros(m, bool)
        for at, (dims, rows, impacts, rest) in enumerate(self.segments):
            plane = np.zeros((d, n), kind)
            plane[dims, rows] = impacts
            score += queries[left].astype(kind) @ plane
            last = at + 1 == len(self.segments)
            slack = (norm[left][:, None] * rest[None, :]).astype(np.float64)
            high, low = score + slack, score - slack
            for r in np.flatnonzero(here[left]):
                high[r, itself[left[r]]] = low[r, itself[left[r]]] = -math.inf
            if n > k:
                least = np.partition(low.astype(np.float64), n - k, axis=1)[:, n - k]
                may = high >= least[:, None]
            else:
                may = np.ones(high.shape, bool)
            may &= high > -math.inf
            open_ = may.sum(axis=1)
            done = np.ones(len(left), bool) if last else open_ <= max(few, k)
            for r in np.flatnonzero(done):
                rows_ = np.flatnonzero(may[r])
                exact = self.vectors[rows_].astype(object if kind is object else np.int64) @ queries[left[r]].astype(object if kind is object else np.int64)
                best = np.lexsort((self.ids[rows_], -exact))[:k]
                out_q.append(np.full(len(best), left[r])), out_i.append(self.ids[rows_[best]]), out_s.append(exact[best])
            left, score = left[~done], score[~done]
            if not len(left):
                break
        if not out_q:
            return (np.zeros(0, np.int64),) * 3
        return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s)


def topk_search(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best rows of ``vectors`` for each of its rows with ``is_query``.

    Components become floor(``scale`` * x); scores are integer inner products.  A row for each: query_id, rank (from 1), vec_id, score.
    Ties go to the smaller id; a query's own id is no answer.  Of rows that repeat an id, the one whose vector is largest by order
    of components stands for it, as query and as candidate.  Rows with a null id, and vectors that are null or hold null or non-finite components, take no part; vectors meet
    only those of equal length.  Scores are long; where the largest scaled component lets them grow beyond that, they are all decimal(38, 0).  Components
    beyond 2 ** 56 after scaling are an error, raised before the index is built.  An empty table, or one without queries, gives an empty one.  Other columns are not read.
    """
    scratch = Scratch(spark, "topk")
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), whole(F.col(vector_col), scale).alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = scratch.save(rows.withColumn("d", F.size("x")), "vectors")
    largest = F.array_max(F.transform("x", lambda x: F.greatest(x, F.bitwise_not(x))))
    count, top, most = rows.agg(F.count("*"), F.max(largest), F.max("d")).first()
    if (top or 0) >= LARGEST:
        raise ValueError(f"{vector_col} has components beyond {LARGEST} after scaling")
    wide = (most or 0) * ((top or 0) + 1) ** 2 >= 1 << 63
    kind, score_type = ("decimal(38,0)", pa.decimal128(38, 0)) if wide else ("long", pa.int64())
    parts = shuffle_partitions(spark)
    blocks = max(1, math.ceil(count / BLOCK_ROWS), min(parts, count // 1024))
    groups = max(1, math.ceil(rows.filter("asks").count() / QUERY_ROWS))

    def binary(key, table):
        return pa.table({"d": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "ids": pa.array([table["id"].to_numpy().astype("<i8").tobytes()], pa.binary()), "xs": pa.array([table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary())})

    packed = "d int, block int, ids binary, xs binary"
    stored = rows.select("d", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "x").groupBy("d", "block").applyInArrow(binary, packed)
    asked = rows.filter("asks").groupBy("id").agg(F.max_by(F.struct("d", "x"), "x").alias("v")).select("v.d", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("block"), "id", "v.x").groupBy("d", "block").applyInArrow(binary, packed)
    sent = asked.select("d", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("turn"), "ids", "xs")
    # a block's vectors come first, then the query groups; the task holds one of each at a time
    both = scratch.save(stored.select("d", "block", F.lit(0).alias("turn"), "ids", "xs").unionAll(sent), "blocks")
    dealt = both.repartition(parts, "d", "block").sortWithinPartitions("d", "block", "turn")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                d, b, turn, ids, xs = (c[i].as_py() for c in batch.columns)
                ids = np.frombuffer(ids, "<i8").astype(np.int64)
                xs = np.frombuffer(xs, "<i8").astype(np.int64).reshape(len(ids), d)
                if turn == 0:
                    at, block = (d, b), ImpactBlock(ids, xs)
                elif at == (d, b):
                    q, v, s = block.search(xs, ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(v.astype(np.int64)), pa.array([Decimal(x) for x in s.tolist()] if wide else s.astype(np.int64), score_type)], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(answer, f"query_id long, vec_id long, score {kind}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
