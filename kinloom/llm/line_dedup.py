"""Removal of lines that many documents hold, by a sharded minimal perfect hash.

1. Documents give the 128-bit digests of their distinct lines; Spark sums them up, map-side first.
2. All distinct digests are dealt to shards by their high bits, as many as keep a shard at about ``SHARD_DIGESTS``.  A shard is a
   minimal perfect hash (cascaded bit arrays with ranks) that indexes two compact arrays: a 64-bit fingerprint and a 32-bit count for
   each digest.  A digest that isn't in the shard meets another fingerprint, so no line text is ever compared or joined.
3. The most frequent lines, at most ``hot_lines`` of them, make up one more shard that is broadcast: its size is bounded by that
   parameter.  So no line that a large part of all documents hold is ever dealt to one task.
4. Documents send the digests that the hot shard doesn't know to the shards, in packets.  A task streams one shard's arrays and
   then the packets for it, and gives the digests whose counts suffice.
5. A join by document id, which Spark broadcasts or shuffles as the sizes ask for, brings them back to the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinloom.llm.scratch import Scratch, shuffle_partitions
from kinloom.llm.workers import SLICE_BYTES, give_back, release, sliced

BLANK = b" \t\n\x0b\x0c\r"
HOT_LINES = 4096
#: Digests of a shard, about: some 12 bytes each.
SHARD_DIGESTS = 500_000
#: Copies of each shard, each for a part of the packets.
COPIES = 4
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def line_keys(text: bytes) -> list[bytes]:
    """Of each line: stripped of blanks at both ends, A-Z in lower case."""
    return [line.strip(BLANK).lower() for line in text.split(b"\n")]


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def digests(keys: list[bytes]) -> np.ndarray:
    """128 bits for each key, as two unsigned 64-bit columns."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype=">u8").astype(np.uint64).reshape(-1, 2)


def spread(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h[:, 0] + h[:, 1] * _M3 * np.uint64(2 * level + 1)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct digests: at each level a digest that has its bit for itself stays, the others go on.

    The slot of a digest is the number of bits set before its own.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits  # bits: packed to bytes, levels one after the other
        words = np.frombuffer(bits.tobytes(), dtype="<u8")
        self.words = words
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, h: np.ndarray, gamma: float = 1.5) -> PerfectHash:
        sizes, levels = [], []
        while len(h):
            size = -(-max(64, int(gamma * len(h))) // 64) * 64
            at = (spread(h, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little"))
            h = h[~alone[at]]
        return cls(np.array(sizes, dtype=np.int64), np.concatenate(levels) if levels else np.zeros(0, np.uint8))

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 if it has none.  One that wasn't in the set may get any."""
        out = np.full(len(h), -1, dtype=np.int64)
        left, base = np.arange(len(h)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = (spread(h[left], level) % np.uint64(size)).astype(np.int64) + base
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.ranks[at[hit] >> 6] + np.bitwise_count(below)
            left, base = left[~hit], base + size
        return out


class LineShard:
    """Fingerprints and counts of digests, indexed by a minimal perfect hash."""

    def __init__(self, index: PerfectHash, prints: np.ndarray, counts: np.ndarray):
        self.index, self.prints, self.counts = index, prints, counts

    @classmethod
    def build(cls, h: np.ndarray, counts: np.ndarray) -> LineShard:
        index = PerfectHash.build(h)
        at = index.slots(h)
        prints, own = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint32)
        prints[at], own[at] = h[:, 1], np.minimum(counts, 0xFFFFFFFF)
        return cls(index, prints, own)

    def count(self, h: np.ndarray) -> np.ndarray:
        """In how many documents each digest is, 0 if it isn't in the shard."""
        out = np.zeros(len(h), np.int64)
        if len(self.prints) and len(h):
            at = self.index.slots(h)
            ok = (at >= 0) & (self.prints[at] == h[:, 1])
            out[ok] = self.counts[at[ok]]
        return out

    def dumps(self) -> list[bytes]:
        return [self.index.sizes.astype("<i8").tobytes(), self.index.bits.tobytes(), self.prints.astype("<u8").tobytes(), self.counts.astype("<u4").tobytes()]

    @classmethod
    def loads(cls, sizes: bytes, bits: bytes, prints: bytes, counts: bytes) -> LineShard:
        return cls(PerfectHash(np.frombuffer(sizes, "<i8"), np.frombuffer(bits, np.uint8)), np.frombuffer(prints, "<u8"), np.frombuffer(counts, "<u4"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts as bytes; a null text is an empty one."""
    release()
    for part in sliced(batches, 1, most=4 * SLICE_BYTES):
        yield part.column(0).to_pylist(), [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]


def _key() -> Column:
    """A document's id; for a null one a hash of the text.  Documents that share a key share what is found, which holds for all."""
    return F.coalesce("doc_id", F.xxhash64("text"))


def line_counts(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2 (digest of a line), n (documents that hold it), for each distinct line."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _slices(batches):
            keys = [k for t in texts for k in {*line_keys(t)} if long_enough(k, min_chars)]
            h, n = np.unique(digests(keys), axis=0, return_counts=True) if keys else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].astype(np.int64)), pa.array(h[:, 1].astype(np.int64)), pa.array(n.astype(np.int64))], names=["h1", "h2", "n"])

    rows = docs.select(F.lit(0), "text").mapInArrow(count, "h1 long, h2 long, n long")
    return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return ((h1 >> np.uint64(33)) % np.uint64(shards)).astype(np.int32)


def build_shards(counts: DataFrame, shards: int) -> DataFrame:
    """A row for each shard and copy: shard, copy, sizes, bits, prints, counts."""

    def build(key, rows):
        h = np.stack([rows["h1"].to_numpy().astype(np.uint64), rows["h2"].to_numpy().astype(np.uint64)], axis=1)
        made = LineShard.build(h, rows["n"].to_numpy()).dumps()
        return pa.table({"shard": pa.array([key[0].as_py()] * COPIES, pa.int32()), "copy": pa.array(range(COPIES), pa.int32())} | {k: pa.array([v] * COPIES, pa.binary()) for k, v in zip(("sizes", "bits", "prints", "counts"), made)})

    dealt = counts.withColumn("shard", F.pmod(F.shiftrightunsigned("h1", 33), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(build, "shard int, copy int, sizes binary, bits binary, prints binary, counts binary")


def probe(docs: DataFrame, arrays: DataFrame, hot: LineShard, shards: int, min_docs: int, min_chars: int) -> DataFrame:
    """key (document), found (digests of its lines whose counts in a shard suffice, 16 bytes each)."""

    def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for ids, texts in _slices(batches):
            keys, owner = [], []
            for d, t in zip(ids, texts):
                own = [k for k in {*line_keys(t)} if long_enough(k, min_chars)]
                keys += own
                owner += [d] * len(own)
            if not keys:
                continue
            h, owner = digests(keys), np.array(owner, dtype=np.int64)
            rest = hot.count(h) == 0
            h, owner = h[rest], owner[rest]
            to = shard_of(h[:, 0], shards)
            order = np.argsort(to, kind="stable")
            h, owner, to = h[order], owner[order], to[order]
            cuts = np.flatnonzero(np.diff(to, prepend=-1, append=-1)) if len(to) else np.zeros(0, np.int64)
            turn += 1
            first, last = cuts[:-1], cuts[1:]
            yield pa.RecordBatch.from_arrays([pa.array(to[first], pa.int32()), pa.array(((to[first] + turn) % COPIES).astype(np.int32)), pa.array([h[a:b].astype("<u8").tobytes() for a, b in zip(first, last)], pa.binary()), pa.array([owner[a:b].astype("<i8").tobytes() for a, b in zip(first, last)], pa.binary())], names=["shard", "copy", "h", "owner"])

    sent = docs.select(_key().alias("key"), "text").mapInArrow(packets, "shard int, copy int, h binary, owner binary")
    none = F.lit(None).cast("binary")
    # a shard's arrays come first, then the packets for it; the task holds one of each at a time
    both = arrays.select("shard", "copy", F.lit(0).alias("turn"), "sizes", "bits", "prints", "counts", none.alias("h"), none.alias("owner")).unionByName(sent.select("shard", "copy", F.lit(1).alias("turn"), none.alias("sizes"), none.alias("bits"), none.alias("prints"), none.alias("counts"), "h", "owner"))
    dealt = both.repartition(shuffle_partitions(docs.sparkSession), "shard", "copy").sortWithinPartitions("shard", "copy", "turn")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = [c[i].as_py() for c in batch.columns]
                if row[2] == 0:
                    at, shard = (row[0], row[1]), LineShard.loads(*row[3:7])
                elif at == (row[0], row[1]):
                    h, owner = np.frombuffer(row[7], "<u8").reshape(-1, 2), np.frombuffer(row[8], "<i8")
                    hit = shard.count(h.astype(np.uint64)) >= min_docs
                    if hit.any():
                        yield pa.RecordBatch.from_arrays([pa.array(owner[hit]), pa.array([x.tobytes() for x in h[hit]], pa.binary())], names=["key", "found"])
        give_back()

    return dealt.mapInArrow(answer, "key long, found binary").groupBy("key").agg(F.collect_set("found").alias("found"))


def dedup_lines(spark: SparkSession, docs: DataFrame, min_docs: int = 10, min_chars: int = 1, hot_lines: int = HOT_LINES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drops all lines of ``docs`` (doc_id, text) whose key at least ``min_docs`` documents hold.

    A key is a line without blanks at both ends and with A-Z in lower case; keys of under ``min_chars`` code points stay.  A row
    for each document: doc_id, n_lines (before), n_dropped, text (the other lines, joined by line ends).  A null or empty text
    is one empty line.  Each row counts as a document, repeated and null ids too.  An empty table gives an empty one.  Of other columns, those
    of ``keep`` go along and the others are not read.
    """
    scratch = Scratch(spark, "lines")
    counts = scratch.save(line_counts(docs, min_chars), "counts")
    shards = max(1, -(-counts.count() // SHARD_DIGESTS))
    # at most hot_lines rows come to the driver
    rows = counts.orderBy(F.desc("n"), "h1", "h2").limit(hot_lines).collect()
    h = np.array([[r["h1"] % (1 << 64), r["h2"] % (1 << 64)] for r in rows], dtype=np.uint64).reshape(-1, 2)
    hot = LineShard.build(h, np.array([r["n"] for r in rows], dtype=np.int64))
    shared = hot.dumps()
    arrays = scratch.save(build_shards(counts, shards), "arrays")
    scratch.drop("counts")
    found = scratch.save(probe(docs, arrays, hot, shards, min_docs, min_chars), "found")
    scratch.drop("arrays")

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = LineShard.loads(*shared)
        for part in sliced(batches, 1):
            texts, known = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()], part.column(2).to_pylist()
            keys = [line_keys(t) for t in texts]
            flat = [k for ks in keys for k in ks]
            h = digests(flat)
            gone = (hot.count(h) >= min_docs).tolist()
            raw = h.astype("<u8").tobytes()
            out, lines, dropped, i = [], [], [], 0
            for t, ks, f in zip(texts, keys, known):
                more, n = set(f) if f else (), len(ks)
                off = [(g or (f is not None and raw[16 * j : 16 * j + 16] in more)) and long_enough(k, min_chars) for j, (g, k) in enumerate(zip(gone[i : i + n], ks), i)]
                i += n
                lines.append(n), dropped.append(sum(off))
                out.append(b"\n".join([x for x, o in zip(t.split(b"\n"), off) if not o]) if dropped[-1] else t)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(out, pa.binary()).cast(pa.string()), *part.columns[3:]], names=["doc_id", "n_lines", "n_dropped", "text", *keep])

    types = dict(docs.dtypes)
    found = found.withColumnsRenamed({"key": "_key", "found": "_found"})
    joined = docs.select("doc_id", "text", _key().alias("_key"), *keep).join(found, "_key", "left")
    return joined.select("doc_id", "text", "_found", *keep).mapInArrow(thin, ", ".join(["doc_id long, n_lines long, n_dropped long, text string", *(f"{c} {types[c]}" for c in keep)]))
