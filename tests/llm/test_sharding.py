from collections import defaultdict
from hashlib import md5

from pyspark.sql import functions as F

from kinloom.llm.sharding import extendible_shards
from tests.llm.common import ODD, docs, words


def slow(ids, sizes, limit):
    """Splits lists of rows bit by bit."""
    bits = ["" .join(f"{int(c, 16):04b}" for c in md5(str(i).encode()).hexdigest()[:15]) for i in ids]

    def place(rows, depth):
        if sum(sizes[r] for r in rows) <= limit or len({bits[r] for r in rows}) == 1:
            return {r: bits[r][:depth] for r in rows}
        out = {}
        for b in "01":
            own = [r for r in rows if bits[r][depth] == b]
            out |= place(own, depth + 1) if own else {}
        return out

    return place(list(range(len(ids))), 0)


def test_only_large_buckets_split(spark):
    texts = [" ".join(words(1 + 13 * (k % 40), k)) for k in range(300)] + ODD
    found = {r.doc_id: r for r in extendible_shards(spark, docs(spark, texts, extra=True), 2500).collect()}
    sizes = [len((t or "").encode()) for t in texts]
    expected = slow(range(len(texts)), sizes, 2500)
    assert {i: r.shard.split("+")[0] for i, r in found.items()} == expected
    total = defaultdict(int)
    for i, r in found.items():
        assert r.n_bytes == sizes[i] and r.depth == len(r.shard.replace("+", ""))
        total[r.shard] += r.n_bytes
    assert all(total[r.shard] == r.shard_bytes for r in found.values())
    alone = {r.shard for r in found.values() if r.n_bytes > 2500}
    assert all(b <= 2500 or s in alone for s, b in total.items())


def test_rows_of_one_key_are_split(spark):
    df = docs(spark, ["twelve bytes"] * 400 + ["other"] * 20, extra=True).withColumn("source", F.when(F.col("doc_id") < 400, F.lit("hot")).otherwise(F.concat(F.lit("s"), "doc_id")))
    rows = extendible_shards(spark, df, 600, key="source").collect()
    total = defaultdict(int)
    for r in rows:
        total[r.shard] += r.n_bytes
    assert len(rows) == 420 and all(b <= 600 for b in total.values()) and all(total[r.shard] == r.shard_bytes for r in rows)
    assert sum("+" in r.shard for r in rows) == 400


def test_small_and_empty(spark):
    assert extendible_shards(spark, docs(spark, []), 10).count() == 0
    assert {(r.shard, r.depth) for r in extendible_shards(spark, docs(spark, ["a", None, ""], ids=[1, None, 1]), 10).collect()} == {("", 0)}


def test_files_hold_the_rows_of_their_shards(spark, tmp_path):
    import pathlib

    from kinloom.llm.sharding import write_shards

    texts = ["twelve bytes"] * 100 + [" ".join(words(20, k)) for k in range(60)] + [None, ""]
    ids = [7] * 100 + [*range(100, 160)] + [None, 3]
    write_shards(extendible_shards(spark, docs(spark, texts, extra=True, ids=ids), 600), f"{tmp_path}/shards")
    rows = []
    for d in pathlib.Path(f"{tmp_path}/shards").glob("file=*"):
        assert len(list(d.glob("*.parquet"))) == 1
        own = spark.read.parquet(str(d)).collect()
        assert {f"file=s{r.shard}" for r in own} == {d.name} and sum(len((r.text or "").encode()) for r in own) <= 600
        rows += own
    assert len(rows) == len(texts)
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(zip(ids, texts), key=repr)
