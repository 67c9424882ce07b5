"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Encoding keeps an agenda of neighbouring symbols that make up a piece, best score first, then leftmost.  A candidate taken
from it is skipped if a hash keyed by the seed, the document, the word's number in it, the word, the place and the piece falls
under the dropout rate; a merge beside it may put its symbols on the agenda again, as part of other candidates.  Symbols that
are no piece become byte pieces.

A word is a run of blanks with the characters after it; no piece has a blank after another character, so words merge for
themselves.  Workers keep words with the candidates that the agenda takes without dropout, and their ids.  An occurrence of
which none of these candidates is skipped has those ids; each other one goes through its agenda for itself.

The blank sign U+2581 of a text is written as its three bytes, so decoding restores every text.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain, repeat
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kinloom.llm.sentencepieces import SPACE, Pieces
from kinloom.llm.workers import held, sliced

#: Words, and ids and candidates of words, that a worker keeps; when there are more it starts anew.
CACHE_WORDS, CACHE_ITEMS = 150_000, 2_000_000
#: The candidates of longer words aren't kept: some would be skipped at nearly every occurrence.
PATH_CHARS = 48
#: Up to this length a list does for the agenda of a word.
SHORT = 24
_MASK = (1 << 64) - 1
_WORD = re.compile(" *[^ ]+| +")
_GONE = float("-inf")


class Ragged:
    """Rows of values, laid end to end."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        self.values, self.sizes = values, sizes
        self.starts = np.cumsum(sizes) - sizes

    @classmethod
    def dealt(cls, parts: list[tuple], n: int, kind: type) -> Ragged:
        """``n`` rows, of which each part has the ones of its numbers."""
        if not parts:
            return cls(np.zeros(0, kind), np.zeros(n, np.int64))
        numbers = np.concatenate([np.asarray(k) for k, _ in parts])
        where = np.empty(n, np.int64)
        where[numbers] = np.arange(n)
        return cls(np.concatenate([x.values for _, x in parts]), np.concatenate([x.sizes for _, x in parts])).taken(where)

    def joined(self, other: Ragged) -> Ragged:
        return Ragged(np.append(self.values, other.values), np.append(self.sizes, other.sizes))

    def taken(self, at: np.ndarray) -> Ragged:
        """The rows of these numbers."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return Ragged(self.values[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], sizes)

    def grouped(self, counts: np.ndarray) -> Ragged:
        """So many rows each become one."""
        ends = np.append(0, np.cumsum(self.sizes))
        rows = np.append(0, np.cumsum(counts))
        return Ragged(self.values, np.diff(ends[rows]))


class MergeEncoder:
    def __init__(self, vocabulary: Pieces, dropout: float, seed: int):
        # a blank is a plain " " here; the sign itself stays out of words and so becomes bytes
        self.score = {p.replace(SPACE, " "): s for p, (_, s) in vocabulary.normal.items()}
        self.ids = {p.replace(SPACE, " "): i for p, (i, _) in vocabulary.normal.items()}
        self.byte_ids = vocabulary.byte_ids
        self.limit = int(dropout * (1 << 64))
        self.seed = seed & _MASK
        self.forget()
        # for many words at once: the piece of a character, and the piece of two neighbours by a table with open addressing
        self.of_char = np.full(0x110000, -1, np.int32)
        for c, i in self.ids.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        # characters of one byte that are no piece; no pair has a byte piece
        for b in range(128):
            if self.of_char[b] < 0:
                self.of_char[b] = self.byte_ids[b]
        self.scores = np.full(max(self.ids.values()) + 1, _GONE)
        for c, i in self.ids.items():
            self.scores[i] = self.score[c]
        pairs = {(self.ids[c[:k]] << 20 | self.ids[c[k:]]): i for c, i in self.ids.items() for k in range(1, len(c)) if c[:k] in self.ids and c[k:] in self.ids}
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.slots, self.merged = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        left = np.array(list(pairs), dtype=np.int64)
        values, step = np.array(list(pairs.values()), dtype=np.int64), 0
        while len(left):
            at = self.slot(left, step)
            free = self.slots[at] < 0
            self.slots[at[free]], self.merged[at[free]] = left[free], values[free]
            rest = self.slots[at] != left
            left, values, step = left[rest], values[rest], step + 1
        self.probes = step

    def slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)
        return (x.astype(np.int64) + step) & ((1 << self.bits) - 1)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each a and b make up, or -1."""
        keys = a << 20 | b
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for step in range(self.probes):
            at = self.slot(keys[left], step)
            there = self.slots[at]
            hit = there == keys[left]
            out[left[hit]] = self.merged[at[hit]]
            left = left[~hit & (there >= 0)]
            if not len(left):
                break
        return out

    def skipped(self, base: int, left: int, piece: int) -> bool:
        x = (base ^ (left << 32 | piece) * 0x9E3779B97F4A7C15) & _MASK
        return (x ^ x >> 31) * 0xD6E8FEB86659FD93 & _MASK < min(self.limit, _MASK)

    def key(self, word: str) -> int:
        return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"), self.seed)

    def base(self, word: str, turn: int) -> int:
        """What keys the hashes of a word's candidates at an occurrence."""
        return (self.key(word) + turn * 0x9E3779B97F4A7C15) & _MASK

    def symbols(self, word: str, base: int | None, path: list[int]) -> list[str]:
        """The word cut into symbols after all merges; without a base nothing is skipped.  ``path`` gets the candidates taken."""
        return self.short(word, base, path) if len(word) <= SHORT else self.long(word, base, path)

    def short(self, word: str, base: int | None, path: list[int]) -> list[str]:
        """The agenda is the list of each symbol's score with the next one, searched for its first maximum."""
        get, ids, limit = self.score.get, self.ids, self.limit and base is not None
        symbol, place = list(word), list(range(len(word)))
        score = list(map(get, map(add, word, word[1:]), repeat(_GONE)))
        while score:
            best = max(score)
            if best == _GONE:
                break
            i = score.index(best)
            merged = symbol[i] + symbol[i + 1]
            path.append(place[i] << 32 | ids[merged])
            if limit and self.skipped(base, place[i], ids[merged]):
                score[i] = _GONE
                continue
            symbol[i] = merged
            del symbol[i + 1], place[i + 1], score[i]
            if i < len(score):
                score[i] = get(merged + symbol[i + 1], _GONE)
            if i:
                score[i - 1] = get(symbol[i - 1] + merged, _GONE)
        return symbol

    def long(self, word: str, base: int | None, path: list[int]) -> list[str]:
        """The agenda is a heap; entries whose symbols have merged meanwhile are passed over."""
        get, ids, limit = self.score.get, self.ids, self.limit and base is not None
        symbol, n = list(word), len(word)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, str]] = []

        def consider(i: int) -> None:
            if (j := after[i]) < n and (found := get(both := symbol[i] + symbol[j])) is not None:
                heapq.heappush(agenda, (-found, i, both))

        for i in range(n - 1):
            consider(i)
        while agenda:
            _, i, both = heapq.heappop(agenda)
            j = after[i]
            if not symbol[i] or j >= n or len(symbol[i]) + len(symbol[j]) != len(both) or symbol[i] + symbol[j] != both:
                continue  # one of the two has merged meanwhile
            path.append(i << 32 | ids[both])
            if limit and self.skipped(base, i, ids[both]):
                continue
            symbol[i], symbol[j] = both, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            consider(i)
            if before[i] >= 0:
                consider(before[i])
        return [s for s in symbol if s]

    def word(self, word: str, base: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and candidates of one word."""
        path: list[int] = []
        symbols, ids = self.symbols(word, base, path), self.ids
        found = [i for s in symbols for i in ([ids[s]] if s in ids else [self.byte_ids[b] for b in s.encode("utf-8", "surrogatepass")])]
        return np.array(found, np.uint32), np.array(path, np.uint64)

    def words(self, words: list[str], bases: np.ndarray | None) -> tuple[Ragged, Ragged]:
        """Ids and candidates of words.  Short words of known characters go through the merges all at once, by length, the others one by one."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        short = int(np.searchsorted(size[order], SHORT, side="right"))
        ids, paths, rest = [], [], [order[short:]]
        for at in range(0, short, 8192):
            part = order[at : min(at + 8192, short)]
            own, path, good = self.many([words[k] for k in part.tolist()], None if bases is None else bases[part])
            ids.append((part[good], own)), paths.append((part[good], path)), rest.append(part[~good])
        for k in np.concatenate(rest).tolist():
            own, path = self.word(words[k], None if bases is None else int(bases[k]))
            ids.append(([k], Ragged(own, np.array([len(own)])))), paths.append(([k], Ragged(path, np.array([len(path)]))))
        return Ragged.dealt(ids, len(words), np.uint32), Ragged.dealt(paths, len(words), np.uint64)

    def many(self, words: list[str], bases: np.ndarray | None) -> tuple[Ragged, Ragged, np.ndarray]:
        """Ids and candidates of words of at most SHORT characters, and which words have none but characters that the tables know."""
        width = max(2, max(map(len, words)))
        chars = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(-1, width).astype(np.int64)
        symbol = self.of_char[chars].astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        places = np.arange(width, dtype=np.int32)
        there = places < size[:, None]
        good = ((symbol >= 0) & (chars > 0) | ~there).all(axis=1)
        after, before = np.tile(places + 1, (len(words), 1)), np.tile(places - 1, (len(words), 1))
        pair, score = np.full(symbol.shape, -1, np.int64), np.full(symbol.shape, _GONE, np.float32)
        r, i = np.nonzero(there[:, 1:] & good[:, None])
        pair[r, i] = both = self.joined(symbol[r, i], symbol[r, i + 1])
        score[r, i] = np.where(both >= 0, self.scores[both], _GONE)
        rows = np.arange(len(words))
        whose, taken = [rows[:0]], [rows[:0].astype(np.uint64)]
        while len(rows):
            own = score[rows]
            i = own.argmax(axis=1)  # the first of the best
            live = own[np.arange(len(rows)), i] > _GONE
            rows, i = rows[live], i[live]
            r, key = rows, i.astype(np.uint64) << np.uint64(32) | pair[rows, i].astype(np.uint64)
            if bases is None:
                whose.append(rows), taken.append(key)
            else:
                off = self.hits(bases[rows], key)
                score[rows[off], i[off]] = _GONE
                r, i = rows[~off], i[~off]
            j = after[r, i]
            symbol[r, i] = pair[r, i]
            there[r, j], score[r, j], score[r, i] = False, _GONE, _GONE
            k = after[r, j]
            after[r, i] = k
            more, less = k < size[r], before[r, i] >= 0
            before[r[more], k[more]] = i[more]
            # the candidates that the new symbol makes up with the next and with the one before
            row, first = np.concatenate([r[more], r[less]]), np.concatenate([i[more], before[r[less], i[less]]])
            second = np.concatenate([k[more], i[less]])
            pair[row, first] = both = self.joined(symbol[row, first], symbol[row, second])
            score[row, first] = np.where(both >= 0, self.scores[both], _GONE)
        there &= good[:, None]
        whose, taken = np.concatenate(whose), np.concatenate(taken)
        order = np.argsort(whose, kind="stable")
        return Ragged(symbol[there].astype(np.uint32), there.sum(axis=1)[good]), Ragged(taken[order], np.bincount(whose, minlength=len(words))[good]), good

    def hits(self, bases: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """``skipped`` for many candidates, place and piece in one number."""
        x = bases ^ (keys * np.uint64(0x9E3779B97F4A7C15))
        return (x ^ x >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93) < np.uint64(min(self.limit, _MASK))

    def cut(self, text: str) -> list[str]:
        """The words of a text without their first blank; one is put before the text."""
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return [w[1:] for w in _WORD.findall(" " + text)]
        return text.split(" ")

    def turns(self, n: int, key: int) -> np.ndarray:
        x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key ^ self.seed * 0xC2B2AE3D27D4EB4F) & _MASK)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.keys = np.zeros(0, np.uint64)
        self.ids_of, self.path_of = Ragged(np.zeros(0, np.uint32), np.zeros(0, np.int64)), Ragged(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.plain = np.zeros(0, bool)

    def learn(self, new: list[str]) -> None:
        """Keeps words (without the blank in front) with what becomes of them if nothing is skipped."""
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        new = [" " + w for w in new]
        ids, path = self.words(new, None)
        plain = np.fromiter((len(w) <= PATH_CHARS for w in new), bool, len(new))
        self.ids_of, self.path_of = self.ids_of.joined(ids), self.path_of.joined(path)
        self.keys = np.append(self.keys, np.fromiter(map(self.key, new), np.uint64, len(new)))
        self.plain = np.append(self.plain, plain)

    def texts(self, texts: list[str | None], keys: list[int]) -> Ragged:
        """Ids of texts whose documents have these 64-bit keys; a null text has none."""
        cut = [self.cut(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        if len(self.known) > CACHE_WORDS or len(self.ids_of.values) + len(self.path_of.values) > CACHE_ITEMS:
            self.forget()
        new = set().union(*cut).difference(self.known)
        if new:
            self.learn(list(new))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        if not self.limit:
            return self.ids_of.taken(at).grouped(counts)
        turns = np.concatenate([self.turns(n, k & _MASK) for n, k in zip(counts.tolist(), keys)]) if len(cut) else np.zeros(0, np.uint64)
        bases = self.keys[at] + turns * np.uint64(0x9E3779B97F4A7C15)
        # the occurrences of which no candidate is skipped
        off = ~self.plain[at]
        steps, first = np.where(off, 0, self.path_of.sizes[at]), self.path_of.starts[at]
        for step in range(int(steps.max(initial=0))):
            left = np.flatnonzero((steps > step) & ~off)
            off[left] = self.hits(bases[left], self.path_of.values[first[left] + step])
        again = np.flatnonzero(off)
        if len(again):
            names = list(self.known)
            own, _ = self.words([" " + names[k] for k in at[again].tolist()], bases[again])
            at[again] = len(names) + np.arange(len(again))
            return self.ids_of.joined(own).taken(at).grouped(counts)
        return self.ids_of.taken(at).grouped(counts)


class Decoder:
    """Texts of ids: what each piece shows, end to end."""

    def __init__(self, vocabulary: Pieces):
        shown = {i: p.replace(SPACE, " ").encode() for p, (i, _) in vocabulary.normal.items()} | {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}
        parts = [shown.get(i, b"") for i in range(max(shown) + 1)]
        self.parts = Ragged(np.frombuffer(b"".join(parts), np.uint8), np.fromiter(map(len, parts), np.int64, len(parts)))

    def texts(self, ids: Ragged, nulls: np.ndarray) -> pa.Array:
        """The blank put in front goes."""
        if len(ids.values) and (int(ids.values.max()) >= len(self.parts.sizes) or not self.parts.sizes[ids.values].all()):
            raise ValueError("some ids are no piece of the vocabulary")
        shown = self.parts.taken(ids.values.astype(np.int64)).grouped(ids.sizes)
        some = shown.sizes > 0
        inner = np.ones(len(shown.values), bool)
        inner[shown.starts[some]] = False
        return as_array(Ragged(shown.values[inner], shown.sizes - some), nulls).cast(pa.string())


def as_array(rows: Ragged, nulls: np.ndarray) -> pa.Array:
    """Binary values, each the little-endian bytes of a row."""
    width = rows.values.dtype.itemsize
    offsets = np.append(0, np.cumsum(rows.sizes * width)).astype(np.int64)
    valid = pa.py_buffer(np.packbits(~nulls, bitorder="little").tobytes()) if nulls.any() else None
    values = rows.values.astype(rows.values.dtype.newbyteorder("<"))
    return pa.Array.from_buffers(pa.large_binary(), len(rows.sizes), [valid, pa.py_buffer(offsets), pa.py_buffer(values)]).cast(pa.binary())


def encode(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 0, restored: bool = False) -> DataFrame:
    """Adds ``ids`` (binary: unsigned 32-bit, little-endian) to doc_id and text of ``docs``, and with ``restored`` also
    ``decoded``, which ``decode`` would make of them.

    At dropout 0 the ids are those of SentencePiece itself, but for U+2581.  A null text has null ids, an empty one none.
    The same seed, document id and text always give the same ids, so rows that repeat have the same; a null id counts as one more
    id.  An empty table gives an empty one.  Other columns are not read.
    """
    if not 0 <= dropout <= 1:
        raise ValueError("dropout must be from 0 to 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = held(("merges", model_path, dropout, seed), lambda: (MergeEncoder(own := Pieces(model_path), dropout, seed), Decoder(own)))
        for part in sliced(batches, 1):
            nulls = part.column(1).is_null().to_numpy(zero_copy_only=False)
            ids = enc.texts(part.column(1).to_pylist(), part.column(2).to_pylist())
            made = [as_array(ids, nulls), *([dec.texts(ids, nulls)] if restored else [])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["doc_id", "text", "ids", "decoded"][: 2 + len(made)])

    return docs.select("doc_id", "text", F.xxhash64("doc_id").alias("key")).mapInArrow(run, "doc_id long, text string, ids binary" + ", decoded string" * restored)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``, to all columns of ``encoded``.  Null ids give null, ids of no piece an error."""
    names = encoded.columns
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = held(("decoder", model_path), lambda: Decoder(Pieces(model_path)))
        for part in sliced(batches, at):
            own = part.column(at).to_pylist()
            ids = Ragged(np.frombuffer(b"".join([x or b"" for x in own]), "<u4"), np.fromiter((len(x or b"") // 4 for x in own), np.int64, len(own)))
            yield pa.RecordBatch.from_arrays([*part.columns, dec.texts(ids, np.fromiter((x is None for x in own), bool, len(own)))], names=[*names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))
