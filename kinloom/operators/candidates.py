"""Candidate pairs of several channels put together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def tagged(lists: dict[str, DataFrame]) -> DataFrame:
    """All channels' lists in one table: channel, s1, p, score, rank."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(c).alias("channel"), "s1", "p", "score", "rank") for c, df in lists.items()])


def assemble(candidates: DataFrame, ks: dict[str, int], kept: DataFrame | None = None) -> DataFrame:
    """A row for each pair that any channel lists among its first ``ks[channel]``: score_<c> and rank_<c> of each channel.

    One aggregation instead of a chain of outer joins.  A channel that doesn't list a pair gives score 0 and rank k.  Pairs that only
    the reverse joint channel lists have its score as their joint score.  ``kept`` (s1): the only queries wanted.
    """
    within = reduce(lambda a, b: a | b, [(F.col("channel") == c) & (F.col("rank") < k) for c, k in ks.items()])
    df = candidates.filter(within)
    if kept is not None:
        df = df.join(kept.select("s1"), "s1", "left_semi")
    own = lambda c, col: F.max(F.when(F.col("channel") == c, F.col(col)))
    out = df.groupBy("s1", "p").agg(*[x for c, k in ks.items() for x in (F.coalesce(own(c, "score"), F.lit(0.0)).alias(f"score_{c}"), F.coalesce(own(c, "rank"), F.lit(k)).alias(f"rank_{c}"))])
    if {"joint", "joint_rev"} <= set(ks):
        out = out.withColumn("score_joint", F.when(F.col("score_joint") == 0, F.col("score_joint_rev")).otherwise(F.col("score_joint")))
    return out


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds label: whether a pair is among the true ones (s1, p)."""
    return pairs.join(truth.select("s1", "p").distinct().withColumn("label", F.lit(True)), ["s1", "p"], "left").fillna(False, ["label"])


def hash_bucket(key: Column, buckets: int = 10_000, salt: int = 0) -> Column:
    """A bucket that depends on the key alone, and so stays under repartitioning."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(buckets))


def sampled(records: DataFrame, fraction: float, key: str = "entity_id") -> DataFrame:
    """Source-1 records in the first ``fraction`` of buckets."""
    return records.filter((F.col("source") == 1) & (hash_bucket(F.col(key)) < int(fraction * 10_000)))


def worlds(records: DataFrame, key: str = "entity_id") -> DataFrame:
    """Adds world to records: A 10 % (pruner), B 30 % (matcher), R about 19 % (taken out), C half of the rest; other source-1 rows "rest", the pool "pool"."""
    b = hash_bucket(F.col(key))
    part = F.when(b < 1000, "A").when(b < 4000, "B").when(b < 5880, "R").when(b < 7940, "C").otherwise("rest")
    return records.withColumn("world", F.when(F.col("source") == 1, part).otherwise("pool"))
