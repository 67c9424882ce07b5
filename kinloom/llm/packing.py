"""Best-fit decreasing packing of documents into sequences of bounded length.

Best-fit decreasing looks at lengths only.  So the plan is made on the histogram of lengths, which has at most
``max_tokens`` entries however large the corpus is, and bins that hold the same lengths are kept as one run of
consecutive bin numbers.  A segment tree over remaining capacities finds the tightest open bin in logarithmic time.
The plan says for the r-th piece of each length which bin and offset it gets; the pieces find their places by binary
search in it.  The result is that of best-fit decreasing run over all pieces at once, one by one.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from kinloom.llm.scratch import Scratch, shuffle_partitions
from kinloom.llm.workers import SLICE_BYTES, held, sliced

MAX_TOKENS = 4096
END_ID = 1
#: Words whose ids a worker keeps; when full it starts anew, so memory is bounded.
CACHE_WORDS = 1_000_000
CACHE_CHARS = 64
_ODD_SPACE = r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def as_bytes(ids: list[int]) -> bytes:
    own = array("I", ids)
    if sys.byteorder == "big":
        own.byteswap()
    return own.tobytes()


class WordTokenizer:
    """Ids of whole texts by the ``tokenizers`` file at ``path``, as little-endian unsigned 32-bit bytes.

    Only for tokenizers that split at white space and drop it, so that a text's ids are those of its
    white-space-delimited words, one after the other.  Words are kept with their ids.  A new word of plain letters and
    punctuation goes to the file's model in these two pieces, if the file cuts it so; any other goes through the whole tokenizer.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.cache_words = cache_words
        self.pieces: dict[str, bytes] = {"": b""}
        self.odd = regex.compile(_ODD_SPACE)
        self.plain = regex.compile("[ \t\n\r]+")
        #: letters that have one code point however they are composed, then punctuation without apostrophes
        self.simple = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
        self.bytes = {b: chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else None for b in range(256)}
        for n, b in enumerate([b for b, c in self.bytes.items() if c is None]):
            self.bytes[b] = chr(256 + n)
        self.cuts_simply = all(self.split(w) == self.whole([w])[0] for w in ("Abcé,", "ß).", "naïve", "A.-", "tion", "ÀÉÅÿ"))

    def words(self, text: str) -> list[str]:
        """The text cut at blanks, tabs and line ends; rarer white space is left to the tokenizer."""
        if self.odd.search(text):
            return [w for w in self.plain.split(text) if w]
        return text.split()

    def whole(self, words: list[str]) -> list[bytes]:
        return [as_bytes(x.ids) for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def piece(self, piece: str) -> bytes:
        own = self.pieces.get(piece)
        if own is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.bytes)
            own = as_bytes([x.id for x in self.model.tokenize(shown)])
            if len(piece) <= CACHE_CHARS:
                self.pieces[piece] = own
        return own

    def split(self, word: str) -> bytes | None:
        if (m := self.simple(word)) is None:
            return None
        letters, marks = m.groups()
        return self.piece(letters.lower()) + self.piece(marks)

    def learn(self, words: list[str]) -> None:
        known, rest = self.known, words
        if self.cuts_simply:
            rest = []
            for word in words:
                if (own := self.split(word)) is None:
                    rest.append(word)
                else:
                    known[word] = own
        for at in range(0, len(rest), 20_000):
            known.update(zip(rest[at : at + 20_000], self.whole(rest[at : at + 20_000])))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.words(t) for t in texts]
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > self.cache_words:
            self.known.clear()
            self.pieces = {"": b""}
            new = set().union(*cut)
        self.learn(list(new))
        out = [b"".join(map(self.known.__getitem__, ws)) for ws in cut]
        for word in new:
            if len(word) > CACHE_CHARS:
                del self.known[word]
        return out


def word_tokenizer(path: str, cache_words: int = CACHE_WORDS) -> WordTokenizer:
    """One per worker process, with the words it knows."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return held(("words", path, cache_words), lambda: WordTokenizer(path, cache_words))


def token_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, cache_words: int = CACHE_WORDS) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids (as ``as_bytes`` gives them).  A null text is an empty one, which has the end id alone."""
    end = np.asarray([end_id], dtype="<u4").tobytes()
    width = 4 * max_tokens

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(tokenizer_path, cache_words)
        for part in sliced(batches, 1, most=4 * SLICE_BYTES):
            ids, texts = part.column(0), [t or "" for t in part.column(1).to_pylist()]
            doc, piece, start, length, owns = [], [], [], [], []
            for d, data in zip(ids.to_pylist(), tok.encode(texts)):
                data += end
                for p, b in enumerate(range(0, len(data), width)):
                    own = data[b : b + width]
                    doc.append(d), piece.append(p), start.append(b // 4), length.append(len(own) // 4), owns.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(owns, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


class CapacityTree:
    """Segment tree over remaining capacities 0..n; a leaf is on if some open bin has that much room."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.on = bytearray(2 * self.size)

    def set(self, capacity: int, on: bool) -> None:
        i = capacity + self.size
        self.on[i] = on
        i >>= 1
        while i:
            self.on[i] = self.on[2 * i] | self.on[2 * i + 1]
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity of at least ``need`` that is on, or -1."""
        i = need + self.size
        if self.on[i]:
            return need
        while i > 1:
            if not i & 1 and self.on[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.on[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def plan_bins(histogram: dict[int, int], max_tokens: int = MAX_TOKENS) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over ``{length: pieces}``.

    Gives runs (length, first rank, first bin, offset, pieces), sorted by length and rank, and the number of bins: the piece
    of rank r of a run lies in bin ``first bin + r - first rank`` at ``offset``.  Bins of equal remaining capacity are filled in
    the order in which they got it.
    """
    tree = CapacityTree(max_tokens)
    open_: list[list[tuple[int, int]]] = [[] for _ in range(max_tokens + 1)]  # runs (first bin, bins) by capacity
    runs, bins = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = int(histogram[length]), 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                # pieces of one length that meet no open bin fill new ones, as many of them in each as fit
                per = max_tokens // length
                full, rest = divmod(left, per)
                for count, each in ((full, per), (1, rest)):
                    if count and each:
                        for k in range(each):
                            runs.append((length, rank, bins, k * length, count))
                            rank += count
                        if (gap := max_tokens - each * length) > 0:
                            open_[gap].append((bins, count))
                            tree.set(gap, True)
                        bins += count
                break
            first, count = open_[room].pop(0)
            used = min(count, left)
            if used < count:
                open_[room].insert(0, (first + used, count - used))
            if not open_[room]:
                tree.set(room, False)
            runs.append((length, rank, first, max_tokens - room, used))
            rank, left = rank + used, left - used
            if room > length:
                open_[room - length].append((first, used))
                tree.set(room - length, True)
    out = np.array(runs, dtype=np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))], bins


def ranked_by_length(pieces: DataFrame, chunks: int) -> DataFrame:
    """``rank`` of each piece among those of its length, from 0.

    Counts by (chunk, length) give each chunk its first rank; within a chunk a window numbers the pieces.  A length that
    a third of all pieces have is so spread over all chunks.
    """
    dealt = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)).cast("int"))
    counts = dealt.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    first = counts.select("length", "chunk", (F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).alias("first"))
    own = F.row_number().over(Window.partitionBy("chunk", "length").orderBy("doc_id", "piece", "start", F.crc32("ids"), "ids")) - 1
    return dealt.withColumn("own", own).join(first, ["length", "chunk"]).withColumn("rank", F.col("first") + F.col("own"))


def best_fit_pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Packs every document of ``docs`` (doc_id, text) into sequences of at most ``max_tokens`` ids.

    A row for each piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), ids_crc32, sequence_id, offset; the pieces
    of a sequence_id, by offset, end to end are its ids.  Null and empty texts have the end id
    alone.  Rows that repeat a doc_id are packed each for itself.  An empty table gives an empty one.  Other columns of
    ``docs`` are not read.  ``cache_words``: how many words' ids a worker keeps.
    """
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(token_pieces(docs, tokenizer_path, max_tokens, end_id, cache_words), "pieces")
    # at most max_tokens rows come to the driver, whatever the size of the corpus
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan_bins(histogram, max_tokens)
    # the plan has the size of the histogram, not of the corpus
    shared = spark.sparkContext.broadcast(runs)

    # only lengths and ranks go to Python; ids wait in the JVM, where they may spill
    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        plan = shared.value
        key = plan[:, 0] * (1 << 48) + plan[:, 1]
        lengths, ranks = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (length, rank))
        at = np.searchsorted(key, lengths * (1 << 48) + ranks, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(plan[at, 2] + ranks - plan[at, 1]), pa.array(plan[at, 3])], names=["sequence_id", "offset"])

    ranked = ranked_by_length(pieces, 2 * shuffle_partitions(spark)).withColumn("place", place("length", "rank"))
    return ranked.select("doc_id", "piece", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "place.sequence_id", "place.offset")
