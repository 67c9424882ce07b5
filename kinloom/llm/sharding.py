"""Extendible hashing into shards of bounded size, with DataFrame functions only.

A row's hash has 60 bits, from the md5 of its key.  The histogram of bytes by hash prefix is the directory's base; it is summed up a
bit at a time, until all buckets are over the limit.  A bucket within it whose parent is over it is a shard: only buckets over the
limit are split on another bit.  Buckets still too large at the base's depth go through a second, full-depth round.  Shards are ranges
of hashes, so the directory is a row for each shard, with the least hash: rows and directory are sorted together, by groups of
hashes, and a row's shard is the last one before it.  This is the only time that texts are shuffled.  Rows of one single hash that
are too large together (one key that holds a large part of all rows) are split on by the bits of a row number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from kinloom.llm.scratch import Scratch

BITS = 60
#: Bits of the directory's base beyond what shards of equal size would need.
SPARE = 6


def key_hash(key: Column) -> Column:
    """The first 60 bits of the key's md5; a null key is an empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _shards(scratch: Scratch, rows: DataFrame, depth_from: int, base: int, limit: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Shards (least, depth, shard_bytes, single) of rows (h, n_bytes), and the open buckets of ``base`` bits, if any."""

    def summed(by: DataFrame, depth: int) -> DataFrame:
        own = by.groupBy("bucket").agg(F.sum("n_bytes").alias("n_bytes"), F.min("least").alias("least"), F.max("most").alias("most"))
        # one single hash has no other bit to split on
        return scratch.save(own.withColumn("open", (F.col("n_bytes") > limit) & (F.col("least") != F.col("most"))), f"{name}-{depth}")

    levels = {base: summed(rows.select(F.shiftright("h", BITS - base).alias("bucket"), "n_bytes", F.col("h").alias("least"), F.col("h").alias("most")), base)}
    depth = base
    while depth > depth_from and not levels[depth].filter(~F.col("open")).isEmpty():
        depth -= 1
        levels[depth] = summed(levels[depth + 1].withColumn("bucket", F.shiftright("bucket", 1)), depth)
    found = None
    for k in range(depth, base + 1):
        own = levels[k].filter(~F.col("open"))
        if k > depth:
            parents = levels[k - 1].filter("open").select(F.col("bucket").alias("parent"))
            own = own.withColumn("parent", F.shiftright("bucket", 1)).join(parents, "parent", "left_semi")
        own = own.select(F.shiftleft("bucket", BITS - k).alias("least"), F.lit(k).alias("depth"), F.col("n_bytes").alias("shard_bytes"), (F.col("least") == F.col("most")).alias("single"))
        found = own if found is None else found.unionAll(own)
    return scratch.save(found, f"{name}-shards"), levels[base].filter("open").select("bucket")


def _bits(h: Column, depth: Column) -> Column:
    return F.substring(F.lpad(F.bin(h), BITS, "0"), F.lit(1), depth)


def extendible_shards(spark: SparkSession, docs: DataFrame, limit_bytes: int, key: str = "doc_id") -> DataFrame:
    """Deals ``docs`` (``key``, doc_id, text) to shards of at most ``limit_bytes`` bytes of text.

    A row for each row: doc_id, text, shard (the hash bits of its bucket as 0s and 1s; after "+" those of a row number, where rows of one
    hash are over the limit), depth (bits in all), n_bytes, shard_bytes.  Null keys share a hash; null and empty texts have 0 bytes.
    A single row over the limit has a shard to itself.  An empty table gives an empty one.  Other columns are not read.  All rows
    of a shard lie in one partition, and ``write_shards`` makes files of them.
    """
    if limit_bytes < 1:
        raise ValueError("limit_bytes must be positive")
    scratch = Scratch(spark, "shards")
    rows = docs.select("doc_id", "text", key_hash(F.col(key)).alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    sizes = scratch.save(rows.groupBy("h").agg(F.sum("n_bytes").alias("n_bytes")), "sizes")
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    even = max(0, math.ceil(math.log2(max(total, 1) / limit_bytes)))
    base = min(BITS, even + SPARE)
    shards, left = _shards(scratch, sizes, 0, base, limit_bytes, "a")
    if base < BITS and not left.isEmpty():
        deeper = sizes.withColumn("bucket", F.shiftright("h", BITS - base)).join(left, "bucket", "left_semi").select("h", "n_bytes")
        shards = shards.unionAll(_shards(scratch, deeper, base, BITS, limit_bytes, "b")[0])
    # a group of hashes holds about a few shards; shallower shards, if there are any, are in the directory of each of their groups
    least = shards.agg(F.min("depth")).first()[0] or 0
    width = max(least, even - 3)
    group = lambda h: F.shiftright(h, BITS - width)
    directory = shards.withColumn("group", F.explode(F.sequence(group("least"), group(F.col("least") + F.expr(f"shiftleft(1L, {BITS} - depth)") - 1))))
    none = lambda kind: F.lit(None).cast(kind)
    directory = directory.select("group", F.col("least").alias("h"), F.lit(0).alias("turn"), none("long").alias("doc_id"), none("string").alias("text"), none("long").alias("n_bytes"), F.struct("least", "depth", "shard_bytes", "single").alias("own"))
    both = directory.unionAll(rows.select(group("h"), "h", F.lit(1), "doc_id", "text", "n_bytes", none("struct<least: long, depth: int, shard_bytes: long, single: boolean>")))
    before = Window.partitionBy("group").orderBy("h", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("own", F.last("own", ignorenulls=True).over(before)).filter("turn = 1")
    found = found.select("doc_id", "text", _bits(F.col("own.least"), F.col("own.depth")).alias("shard"), "own.depth", "n_bytes", "own.shard_bytes", (F.col("own.single") & (F.col("own.shard_bytes") > limit_bytes)).alias("large"), "h")
    columns = ("doc_id", "text", "shard", "depth", "n_bytes", "shard_bytes")
    if shards.filter(F.col("single") & (F.col("shard_bytes") > limit_bytes)).isEmpty():
        found = found.select(*columns)
        return found if least >= width else found.repartition("shard")
    # rows of one hash: the bits go on with those of a row number, which is written once, so later reads agree on it
    own = scratch.save(found.filter("large").withColumn("h2", F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - BITS)), "single")
    active = own.select("h", "h2", "n_bytes")
    places = None
    for more in range(1, BITS + 1):
        at = F.shiftright("h2", BITS - more).alias("bucket")
        sums = active.groupBy("h", at).agg(F.sum("n_bytes").alias("shard_bytes"), (F.min("h2") == F.max("h2")).alias("single"))
        split = scratch.save(active.withColumn("bucket", at).join(sums, ["h", "bucket"]).withColumn("fits", (F.col("shard_bytes") <= limit_bytes) | F.col("single")), f"single-{more}")
        done = split.filter("fits").select("h", "h2", F.lit(more).alias("more"), "shard_bytes").distinct()
        places = done if places is None else places.unionAll(done)
        active = split.filter(~F.col("fits")).select("h", "h2", "n_bytes")
        if active.isEmpty():
            break
    split = own.drop("shard_bytes").join(places, ["h", "h2"]).withColumn("shard", F.concat("shard", F.lit("+"), _bits(F.col("h2"), F.col("more")))).withColumn("depth", F.col("depth") + F.col("more"))
    rest = found.filter(~F.col("large")).select(*columns)
    return (rest if least >= width else rest.repartition("shard")).unionAll(split.select(*columns).repartition("shard"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes the rows of ``extendible_shards`` to ``path``, a folder with one Parquet file for each shard: ``file=s`` and the shard's label."""
    sharded.withColumn("file", F.concat(F.lit("s"), "shard")).write.partitionBy("file").parquet(path)
