"""Counts of unigram pieces without making the pieces.

An Aho-Corasick automaton of the vocabulary gives all pieces that end at each character.  Dynamic programming carries the best
score and the number of ids on its path, and nothing else.  Of paths with equal scores the one whose last piece starts first
stays, as in the ``tokenizers`` library's Unigram model; a character that is no piece has the lowest score of the vocabulary
less 10 and counts as its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from kinloom.llm.sentencepieces import SPACE, pieces
from kinloom.llm.workers import held, sliced

CACHE_WORDS = 1_000_000
CACHE_CHARS = 64
UNKNOWN_PENALTY = 10.0


def unigram_vocabulary(model_path: str) -> list[tuple[str, float]]:
    """(piece, score) of a SentencePiece file: the unknown piece first, then normal and byte pieces in the order of their ids."""
    own = pieces(model_path)
    byte = [(i, f"<0x{b:02X}>", 0.0) for b, i in enumerate(own.byte_ids)]
    return [("<unk>", 0.0), *((p, s) for _, p, s in sorted([*byte, *((i, p, s) for p, (i, s) in own.normal.items())]))]


class CountingViterbi:
    """Counts ids of chunks that start a word (blank sign in front) or don't."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        # a line end that no piece holds parts a chunk; sums of whole numbers don't depend on where they start
        self.parts = not any("\n" in p for p, _ in vocabulary) and all(float(s).is_integer() for _, s in vocabulary)
        self.known: dict[str, int] = {}

    def chunk(self, chunk: str) -> int:
        if self.parts and "\n" in chunk:
            lines = chunk.split("\n")
            return sum(map(self.chunk, lines)) + len(lines) - 1
        n = len(chunk)
        ends: list[list[tuple[int, float]] | None] = [None] * n
        alone = [False] * n
        for end, found in self.automaton.iter(chunk):
            if ends[end] is None:
                ends[end] = []
            ends[end].append(found)
            if found[0] == 1:
                alone[end] = True
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(n):
            best, start = None, -1
            for length, own in ends[end] or ():
                at = end + 1 - length
                s = own + score[at]
                if best is None or s > best or s == best and at < start:
                    best, start = s, at
            if not alone[end]:
                s = self.unknown + score[end]
                if best is None or s > best:
                    score[end + 1], count[end + 1] = s, count[end] + len(chunk[end].encode("utf-8", "surrogatepass"))
                    continue
            score[end + 1], count[end + 1] = best, count[start] + 1
        return count[n]

    def text(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if words[0] == "" and len(words) > 1:
            words = words[1:]  # the text starts with a blank, so none is put in front
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = self.chunk(SPACE + w)
        out = sum(map(known.__getitem__, words))
        for w in new:
            if len(w) > CACHE_CHARS:
                del known[w]
        return out


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens: how many ids each text of ``docs`` has.

    A null text has null, an empty one 0.  A row for each row, repeated ones too.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(("unigram", model_path), lambda: CountingViterbi(unigram_vocabulary(model_path)))
        for part in sliced(batches, 1):
            counts = [None if t is None else counter.text(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")
