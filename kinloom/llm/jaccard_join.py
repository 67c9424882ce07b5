"""Exact Jaccard join of texts by their word shingles, and its connected components.

Equal sets are classes, and one document stands for each.  A class's shingles are hashed into groups, and the group counts are
its point; the overlap of two sets is at most the sum of the lesser counts.  Points of unrelated texts don't cluster, so one tree
over all of them would prune nothing; points that may be near each other first meet at tokens.  Shingles are put in one order for
all sets: those that many documents hold last, as far as a bounded list tells, then by hash.  A set has to hold a share of any
partner's shingles, so of two sets that link, both have a common shingle among the first of theirs that this share leaves over;
documents meet at these.  Meetings of the same documents are held once.

1. An R-tree over the points of a meeting, bulk-loaded, gives for its documents in turn those whose bound on the overlap suffices.
   Each is led by the first such one, and by the last; it is compared with the leaders that it has most often, which ties groups
   together that have documents in common, and links are contracted to components.
   Large meetings are dealt to chunks, whose leaders meet once more.  This leaves one component of a group of near copies, however large.
2. Where a meeting still holds several components, the trees give the pairs of different components whose bound suffices.  Documents
   of its largest component meet the others alone, chunk by chunk.  In large meetings each document first keeps the pair of the largest bound, and
   links contract the components once more; then all pairs count that still lie in different ones.
3. The pairs are verified on the sets, and the links contract the components for the last time.

No link is lost: a pair that isn't compared lies in one component already.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from kinloom.llm.components import components
from kinloom.llm.scratch import Scratch, shuffle_partitions
from kinloom.llm.workers import give_back, release, sliced

NO_ID = -(1 << 63)
#: Coordinates of points: this many, or else a quarter of the set's size, rounded up to a power of two.
GROUPS = 256
#: How many of the most frequent shingles are put last, at most; shingles that are found ``OFTEN`` times among ``COUNTED`` of a task are counted for that.
HOT, OFTEN, COUNTED = 1 << 19, 3, 2_000_000
#: Documents in a chunk of a large meeting, and in a leaf of the tree.
CHUNK, LEAF = 1024, 32
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    x = (x ^ (x >> np.uint64(29))) * _D
    return x ^ (x >> np.uint64(32))


def _scalar(k: int, by: np.uint64) -> np.uint64:
    return np.uint64(k * int(by) & (1 << 64) - 1)


def _random(n: int, salt: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * _A + _scalar(salt, _B)) | np.uint64(1)


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Random values of bytes, alike for A-Z and a-z, and multipliers of the places in a word and of words in a shingle.
_BYTE = _random(256, 1)
_BYTE[65:91] = _BYTE[97:123]
_PLACE, _TURN = _random(256, 2), _random(64, 3)


def spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For segments laid end to end: the segment of each element, and its place there."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts laid end to end, and how many words each text has."""
    inner = ~_BLANK[data]
    joined = inner[1:] & inner[:-1]  # with the byte before in one word
    cuts = offsets[1:-1]
    joined[cuts[(cuts > 0) & (cuts < len(data))] - 1] = False
    first = np.flatnonzero(inner & ~np.append(False, joined)[: len(data)])
    counts = np.diff(np.searchsorted(first, offsets))
    if not len(first):
        return np.zeros(0, np.uint64), counts
    letters = data[inner]
    starts = np.cumsum(inner)[first] - 1
    lengths = np.diff(np.append(starts, len(letters)))
    place = np.arange(len(letters)) - np.repeat(starts, lengths)
    by = _PLACE[place & 255]
    if int(lengths.max()) > 256:
        by = by * (2 * (place >> 8) + 1).astype(np.uint64)
    return mixed(np.add.reduceat(_BYTE[letters] * by, starts) + lengths.astype(np.uint64) * _A), counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text, end to end, and the sizes of the sets.

    Words are parted by blanks; A-Z count as a-z.  A text of fewer words has all of them as one shingle.
    """
    h, counts = word_hashes(data, offsets)

    def mix(window: np.ndarray, k: int) -> np.ndarray:
        x = np.zeros(len(window) - k + 1, np.uint64)
        for j in range(k):
            x += window[j : len(window) - k + 1 + j] * _TURN[j % 64] + _scalar(j // 64, _C)
        return mixed(x + np.uint64(k))

    _, place = spans(counts)
    whole = place + words <= np.repeat(counts, counts)
    values = np.zeros(len(h), np.uint64)
    if len(h) >= words:
        values[: len(h) - words + 1] = mix(h, words)
    sizes = np.maximum(counts - words + 1, 0)
    bounds = np.cumsum(counts) - counts
    for i in np.flatnonzero((counts > 0) & (counts < words)):
        values[bounds[i]] = mix(h[bounds[i] : bounds[i] + counts[i]], int(counts[i]))[0]
        whole[bounds[i]], sizes[i] = True, 1
    values = values[whole]
    ends = np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        values[a:b].sort()
    owner, place = spans(sizes)
    new = np.append(True, values[1:] != values[:-1])[: len(values)] | (place == 0)
    return values[new], np.bincount(owner[new], minlength=len(sizes))


@dataclass(frozen=True)
class Threshold:
    """Sets link when den * intersection >= num * union."""

    num: int
    den: int

    def least_common(self, sizes: np.ndarray) -> np.ndarray:
        """The least intersection of two sets that link and have so many elements together."""
        return -(-self.num * sizes // (self.den + self.num))

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """How many shingles of a set of ``n`` hold one of each partner's first, if both are in one order."""
        return n - -(-self.num * n // self.den) + 1


class Hot:
    """Frequent shingles in order, and about how many documents hold them."""

    def __init__(self, shingles: np.ndarray, times: np.ndarray):
        order = np.argsort(shingles)
        self.shingles, self.times = shingles[order], times[order]

    def of(self, values: np.ndarray) -> np.ndarray:
        """What is known of the times of each value, 0 if nothing is."""
        if not len(self.shingles):
            return np.zeros(len(values), np.int64)
        at = np.minimum(np.searchsorted(self.shingles, values), len(self.shingles) - 1)
        return np.where(self.shingles[at] == values, self.times[at], 0)


def tokens(values: np.ndarray, sizes: np.ndarray, threshold: Threshold, hot: Hot) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first shingles of sets laid end to end, the numbers of their sets, and what is known of the times of each."""
    owner, place = spans(sizes)
    times = hot.of(values)
    # within a set by times, then by hash as they are
    level = np.ceil(np.log2(times + 1)).astype(np.int64)
    order = np.argsort(owner * 64 + level, kind="stable")
    kept = order[place < threshold.prefix(sizes)[owner]]
    return values[kept], owner[kept], times[kept]


class Frequent:
    """Counts shingles of a task's sets, so many at a time."""

    def __init__(self):
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.held.append(values)
        self.n += len(values)
        if self.n >= COUNTED:
            yield self.counted()

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        found, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.held]), return_counts=True)
        self.held, self.n = [], 0
        often = times >= OFTEN
        return found[often], times[often]


def point(own: np.ndarray) -> bytes:
    """Counts of a set's groups, a byte each; where one is too large for that, there are more groups."""
    groups = max(1 << (len(own) // 4).bit_length(), GROUPS)
    while True:
        counts = np.bincount((own >> np.uint64(40)).astype(np.int64) & (groups - 1), minlength=groups)
        if counts.max() < 256:
            return counts.astype(np.uint8).tobytes()
        groups *= 2


def folded(points: list[bytes]) -> np.ndarray:
    """Points with as many coordinates as the shortest: groups that fall together are added up."""
    least = min(map(len, points))
    return np.stack([np.frombuffer(p, np.uint8).reshape(-1, least).sum(axis=0, dtype=np.int32) for p in points])


class CountTree:
    """R-tree over points, bulk-loaded by halves of the widest coordinate; a node has the largest counts and the least size below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.nodes: list[tuple[np.ndarray, int, int, tuple[int, int] | np.ndarray]] = []
        self.root = self.load(np.arange(len(sizes)))

    def load(self, at: np.ndarray) -> int:
        below: tuple[int, int] | np.ndarray = at
        if len(at) > LEAF:
            own = np.column_stack([self.points[at], self.sizes[at]])
            order = np.argsort(own[:, (own.max(axis=0) - own.min(axis=0)).argmax()], kind="stable")
            below = self.load(at[order[: len(at) // 2]]), self.load(at[order[len(at) // 2 :]])
        self.nodes.append((self.points[at].max(axis=0), int(self.sizes[at].min()), int(self.sizes[at].max()), below))
        return len(self.nodes) - 1

    def search(self, points: np.ndarray, sizes: np.ndarray, threshold: Threshold) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) numbers of all pairs whose bound on the overlap suffices for a link.  The queries go down the tree together."""
        asked, found, todo = [], [], [(self.root, np.arange(len(sizes)))]
        while todo:
            at, own = todo.pop()
            most, least, largest, below = self.nodes[at]
            own = own[(least * threshold.num <= sizes[own] * threshold.den) & (sizes[own] * threshold.num <= largest * threshold.den)]
            own = own[np.minimum(points[own], most).sum(axis=1) >= threshold.least_common(sizes[own] + least)]
            if not len(own):
                continue
            if isinstance(below, tuple):
                todo += [(x, own) for x in below]
                continue
            for part in np.array_split(own, -(-len(own) // 128)):
                bound = np.minimum(points[part][:, None, :], self.points[below][None, :, :]).sum(axis=2)
                q, p = np.nonzero(bound >= threshold.least_common(sizes[part][:, None] + self.sizes[below][None, :]))
                asked.append(part[q]), found.append(below[p])
        return (np.concatenate(asked), np.concatenate(found)) if asked else (np.zeros(0, np.int64),) * 2


def leaders(doc: np.ndarray, size: np.ndarray, points: np.ndarray, threshold: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """The first document in turn that leads each and the last: those whose tree search finds it, or itself."""
    tree, leader = CountTree(points, size), np.full(len(doc), -1)
    last = np.arange(len(doc))
    left, step = np.argsort(doc, kind="stable"), 8
    while len(left):
        asked = left[:step]
        q, p = tree.search(points[asked], size[asked], threshold)
        order = np.argsort(q, kind="stable")
        cuts = np.searchsorted(q[order], np.arange(len(asked) + 1))
        for k, at in enumerate(asked.tolist()):
            if leader[at] < 0:
                found = p[order[cuts[k] : cuts[k + 1]]]
                leader[found[leader[found] < 0]] = at
                leader[at] = last[found] = at
        left, step = left[leader[left] < 0], min(2 * step, 256)
    return doc[leader], doc[last]


def meeting_pairs(doc: np.ndarray, comp: np.ndarray, size: np.ndarray, points: np.ndarray, half: np.ndarray, across: bool, threshold: Threshold, best: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of documents of different components that may link; ``across``: only those of both halves of two chunks; ``best``: of each document the one of the largest bound."""
    first = np.flatnonzero(half == 0) if across else np.arange(len(doc))
    second = np.flatnonzero(half == 1) if across else first
    if not len(first) or not len(second):
        return doc[:0], doc[:0]
    q, p = CountTree(points[first], size[first]).search(points[second], size[second], threshold)
    q, p = second[q], first[p]
    keep = (comp[q] != comp[p]) & ((doc[p] < doc[q]) | across)
    q, p = q[keep], p[keep]
    if best and len(q):
        bound = np.concatenate([np.minimum(points[x], points[y]).sum(axis=1) for x, y in zip(np.array_split(q, -(-len(q) // 4096)), np.array_split(p, -(-len(q) // 4096)))])
        share = bound / (size[q] + size[p] - bound)
        chosen = np.zeros(len(q), bool)
        for side in (q, p):
            order = np.lexsort((np.arange(len(q)), -share, side))
            chosen[order[np.append(True, np.diff(side[order]) != 0)]] = True
        q, p = q[chosen], p[chosen]
    return doc[p], doc[q]


def by_key(batches: Iterator[pa.RecordBatch], keys: int, numbers: int) -> Iterator[tuple[list[np.ndarray], list[bytes]]]:
    """The rows of each key (the first ``keys`` columns, in order): ``numbers`` columns of integers, and the points in the next one."""
    held: list[np.ndarray] | None = None
    held_points: list[bytes] = []
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(numbers)]
        points = batch.column(numbers).to_pylist()
        if held is not None:
            cols, points = [np.concatenate(x) for x in zip(held, cols)], held_points + points
        new, at = np.zeros(max(0, len(points) - 1), bool), 0
        for c in cols[:keys]:
            new |= np.diff(c) != 0
        for end in (np.flatnonzero(new) + 1).tolist():
            yield [c[at:end] for c in cols], points[at:end]
            at = end
        held, held_points = [c[at:] for c in cols], points[at:]
    if held is not None and len(held_points):
        yield held, held_points
    give_back()


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, and the sets of their texts (second column) end to end with their sizes."""
    release()
    for part in sliced(batches, 1):
        text = pa.concat_arrays([part.column(1).cast(pa.large_binary()).fill_null(b"")])
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        buffer = text.buffers()[2]
        data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        yield part, *shingle_sets(data, offsets - offsets[0], words)


def _each(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1]) if len(sizes) else []


def jaccard_components(spark: SparkSession, docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Links texts of ``docs`` (doc_id, text) whose sets of ``words``-word shingles have den * intersection >= num * union.

    A row for each row: doc_id, n_shingles, component_id (the least doc_id reachable by links, its own included).  A text of fewer
    words has all of them as one shingle.  Null and empty texts, and those of blanks, have none and link with nothing.  Rows that
    repeat an id are one document, with the largest of their sets (then by digest).  A null id counts as the least one and is given as null.
    An empty table gives an empty one.  Other columns are not read.
    """
    if words < 1 or not 0 < num <= den:
        raise ValueError("words must be positive, and num / den over 0 and at most 1")
    threshold = Threshold(num, den)
    scratch = Scratch(spark, "jaccard")
    keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text", F.xxhash64("text").alias("mark"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "mark", "n", "h1", "h2", "point", "shingle", "times"]
        counter = Frequent()

        def counts(found: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            none = [pa.nulls(len(found), pa.int64())] * 5
            return pa.RecordBatch.from_arrays([*none, pa.nulls(len(found), pa.binary()), pa.array(found.astype(np.int64)), pa.array(times.astype(np.int64))], names=names)

        for part, values, sizes in _sets(batches, words):
            sets = _each(values, sizes)
            h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(s.tobytes()) for s in sets]), ">i8").astype(np.int64).reshape(-1, 2)
            none = [pa.nulls(len(sets), pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sizes.astype(np.int64)), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([point(s) for s in sets], pa.binary()), *none], names=names)
            for found in counter.add(values):
                yield counts(*found)
        yield counts(*counter.counted())

    told = scratch.save(keyed.mapInArrow(describe, "doc long, mark long, n long, h1 long, h2 long, point binary, shingle long, times long"), "described")
    described = told.filter("doc IS NOT NULL").select("doc", "mark", "n", "h1", "h2", "point")
    # one set for each document
    own = described.groupBy("doc").agg(F.max(F.struct("n", "h1", "h2", "mark")).alias("o")).select("doc", "o.*")
    own = scratch.save(own, "own")
    classes = scratch.save(own.filter("n > 0").groupBy("h1", "h2").agg(F.min("doc").alias("rep"), F.max("n").alias("n")), "classes")
    members = scratch.save(own.join(classes.select("h1", "h2", "rep"), ["h1", "h2"], "left").select("doc", "mark", F.when(F.col("n") > 0, F.col("rep")).alias("rep")), "members")
    # rows that stand for no class needn't be read again
    stands = members.filter(F.col("doc") == F.col("rep")).select("doc", "mark")
    others = scratch.save(described.select("doc", "mark").distinct().join(stands, ["doc", "mark"], "left_anti"), "others")
    standing = keyed.join(others, ["doc", "mark"], "left_anti").select("doc", "text")
    # at most HOT rows come to the driver and are broadcast
    frequent = told.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "shingle").limit(HOT).toArrow()
    shared = spark.sparkContext.broadcast(Hot(frequent["shingle"].to_numpy().astype(np.uint64), frequent["times"].to_numpy()))

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for part, values, sizes in _sets(batches, words):
            found, owner, times = tokens(values, sizes, threshold, hot)
            docs = part.column(0).to_numpy().astype(np.int64)[owner]
            salts = -(-times // CHUNK) + (times == 0)
            salt = (mixed(docs.astype(np.uint64)) % salts.astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(salt), pa.array(salts > 1), pa.array(docs)], names=["token", "salt", "large", "doc"])

    # a token of many documents is dealt to salts, and a salt with one document in it still counts
    same = Window.partitionBy("token", "salt")
    sent = standing.mapInArrow(divide, "token long, salt int, large boolean, doc long").repartition(shuffle_partitions(spark), "token", "salt")
    met = sent.withColumns({"least": F.min("doc").over(same), "last": F.max("doc").over(same)}).filter("large OR least != last").select("token", "salt", "large", "doc")
    met = scratch.save(met.distinct(), "all-met")
    # of meetings of the same documents one is held
    guests = met.groupBy("token").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("doc")).alias("x1"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("x2"))
    held = scratch.save(guests.filter("size > 1").groupBy("size", "x1", "x2").agg(F.min("token").alias("token")).select("token"), "held")
    met = scratch.save(met.join(held, "token", "left_semi"), "met")
    scratch.drop("all-met")

    ids = scratch.save(met.select("doc").distinct(), "ids")
    # documents that meet stand for classes; by both keys, points and texts are shuffled once at most
    points = described.join(ids.join(stands, "doc"), ["doc", "mark"], "left_semi").dropDuplicates(["doc", "mark"]).select("doc", "n", "point")
    points = scratch.save(points, "points")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, sizes in _sets(batches, words):
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc", "shingles"])

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that link, found on their sets; only texts of these pairs are read."""
        ends = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct().join(stands, "doc"), f"{name}-ends")
        texts = keyed.join(ends, ["doc", "mark"], "left_semi").select("doc", "text")
        sets = scratch.save(texts.mapInArrow(gather, "doc long, shingles array<long>"), f"{name}-sets")
        a, b = (sets.select(F.col("doc").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
        common, both = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
        return scratch.save(pairs.join(b, "b").join(a, "a").filter(den * common >= num * (both - common)).select("a", "b").distinct(), f"{name}-links")

    # first round: leaders, in the chunks of a meeting and then among the leaders of its chunks
    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, points in by_key(batches, 2, 4):
            first, last = leaders(t[2], t[3], folded(points), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(t[0]), pa.array(first), pa.array(last), pa.array(t[2])], names=["token", "a", "last", "b"])

    def led(guests: DataFrame, name: str) -> DataFrame:
        seats = guests.join(points, "doc").select("token", "salt", "doc", "n", "point").repartition(shuffle_partitions(spark), "token", "salt")
        return scratch.save(seats.sortWithinPartitions("token", "salt", "doc").mapInArrow(lead, "token long, a long, last long, b long"), name)

    first = led(met.select("token", "salt", "doc"), "led")
    large = met.filter("large").select("token").distinct()
    again = led(first.filter("a = b").join(large, "token", "left_semi").select("token", F.lit(0).alias("salt"), F.col("a").alias("doc")), "led-again")
    both = first.unionAll(again)

    def often(leader: str) -> DataFrame:
        times = both.filter(F.col(leader) != F.col("b")).groupBy("b", F.col(leader).alias("a")).agg(F.count("*").alias("times"))
        return times.groupBy("b").agg(F.max_by("a", F.struct("times", -F.col("a"))).alias("a")).select("a", "b")

    pairs = scratch.save(often("a").unionAll(often("last")).distinct(), "first")
    one = components(scratch, linked(pairs, "first"), "one")

    # second round: meetings of several components; chunks of the largest one meet the others, which all meet each other
    def meet(where: DataFrame, best: bool, name: str) -> DataFrame:
        """Pairs (a, b) of documents in different components of ``where`` (doc, component) that may link."""
        placed = scratch.save(met.select("token", "doc").join(where, "doc"), f"{name}-placed")
        sizes = placed.groupBy("token", "component").agg(F.count("*").alias("size"))
        sums = sizes.groupBy("token").agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("main"), F.max("size").alias("most"), F.sum("size").alias("size")).filter("size > most")
        if best:  # only the pairs of large meetings are so many that they had better contract first
            sums = sums.filter(F.col("size") > LEAF)
        chunks = lambda size: F.ceil(size / F.lit(CHUNK)).cast("int")
        open_ = scratch.save(sums.select("token", "main", chunks(F.col("size") - F.col("most")).alias("others"), chunks(F.col("most")).alias("mains")), f"{name}-open")
        salt = F.xxhash64("doc")
        seated = placed.join(open_, "token").withColumn("chunk", F.when(F.col("component") == F.col("main"), F.col("others") + F.pmod(salt, F.col("mains"))).otherwise(F.pmod(salt, F.col("others"))).cast("int"))
        last = F.when(F.col("chunk") < F.col("others"), F.col("others") + F.col("mains")).otherwise(F.col("others")) - 1
        dealt = seated.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
        seats = dealt.select("token", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "doc", "component")
        seats = seats.join(points, "doc").select("token", "low", "high", "chunk", "doc", "component", "n", "point")

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, points in by_key(batches, 3, 7):
                a, b = meeting_pairs(t[4], t[5], t[6], folded(points), (t[3] != t[1]).astype(np.int8), bool(t[1][0] != t[2][0]), threshold, best)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        found = seats.repartition(shuffle_partitions(spark), "token", "low", "high").sortWithinPartitions("token", "low", "high").mapInArrow(search, "a long, b long")
        found = scratch.save(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
        scratch.drop(f"{name}-placed")
        return found

    where = scratch.save(ids.join(one.select(F.col("node").alias("doc"), "component"), "doc", "left").select("doc", F.coalesce("component", "doc").alias("component")), "one-where")
    for best, name in ((True, "best"), (False, "near")):
        a, b = (where.select(F.col("doc").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
        links = linked(meet(where, best, name), name).join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        joined = components(scratch, links, f"{name}-components").select(F.col("node").alias("component"), F.col("component").alias("now"))
        where = scratch.save(where.join(joined, "component", "left").select("doc", F.coalesce("now", "component").alias("component")), f"{name}-where")
    for name in ("met", "points", "led", "led-again", "first-sets", "best-sets", "near-sets"):
        scratch.drop(name)

    found = members.select("doc", F.coalesce("rep", "doc").alias("rep")).join(where.withColumnRenamed("doc", "rep"), "rep", "left").select("doc", F.coalesce("component", "rep").alias("component"))
    found = described.select("doc", "n").join(found, "doc")
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(shown("doc").alias("doc_id"), F.col("n").alias("n_shingles"), shown("component").alias("component_id"))
