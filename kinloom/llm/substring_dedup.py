"""Removal of repeated passages across documents, by hashes of lines, paragraphs or pieces of lines, with the offsets of what goes.

Units tile a text.  They are normalised (runs of blanks become one, A-Z in lower case) and hashed to 128 bits.  Digests are
grouped, and of each the earliest place stays, by document id, then text, then place in the text; every unit with such a digest
at another place is a repeated one.  Repeated units that follow each other are a run, and runs of enough words go.  So a
passage that begins or ends inside a line is found by its inner pieces, and a short line that many texts have stays.

A task gives only the earliest place of each digest that it has met to the grouping; its other places are repeated in any case.
So a unit that a third of all documents hold reaches the grouping about once a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from kinloom.llm.scratch import Scratch
from kinloom.llm.workers import release, sliced

NO_ID = -(1 << 63)
#: What ends a unit, and belongs to it: a line end; lines of blanks; a line end, or a mark and the blanks after it.
CUTS = {"line": re.compile(rb"\n"), "paragraph": re.compile(rb"\n(?:[ \t\r\x0b\x0c]*\n)+"), "piece": re.compile(rb"\n|[.!?,;:][ \t\r\x0b\x0c]+")}
#: A mark with fewer words since the mark before doesn't end a piece.  This looks at one clause only, so equal passages are cut alike.
CLAUSE_WORDS = 4
#: Least words of a run.  A passage of 50 words whose both ends lie inside pieces still has about this many in whole ones.
RUN_WORDS = 30
#: Units that a task holds before it gives their earliest places.
HELD_UNITS = 250_000


def units(text: bytes, unit: str) -> list[tuple[int, int, list[bytes]]]:
    """Start and end in bytes, and words, of each unit that has words; the others belong to none."""
    out, start, at, words = [], 0, 0, []
    for end in [*(m.end() for m in CUTS[unit].finditer(text)), len(text)]:
        own = text[at:end].split()
        words += own
        at = end
        if unit == "piece" and len(own) < CLAUSE_WORDS and text[end - 1 : end] != b"\n" and end < len(text):
            continue
        if words:
            out.append((start, end, words))
            words = []
        start = end
    return out


class Places:
    """Units of documents, held until there are enough of them."""

    def __init__(self):
        self.rows: list[tuple[int, int, int, int]] = []
        self.digests: list[bytes] = []

    def add(self, key: int, mark: int, own: list[tuple[int, int, list[bytes]]]) -> None:
        self.rows += [(key, mark, i, len(words)) for i, (_, _, words) in enumerate(own)]
        self.digests += [xxhash.xxh3_128_digest(b" ".join(words).lower()) for _, _, words in own]

    def flush(self) -> pa.RecordBatch:
        """h1, h2, key, mark, place, words, again: whether an earlier place of the digest was held beside it."""
        h = np.frombuffer(b"".join(self.digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
        rows = np.array(self.rows, np.int64).reshape(-1, 4)
        self.__init__()
        order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0], h[:, 1], h[:, 0]))
        h, rows = h[order], rows[order]
        fresh = np.append(True, (h[1:] != h[:-1]).any(axis=1))[: len(h)]
        first = rows[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(h) else rows
        again = (rows[:, :3] != first[:, :3]).any(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32)), pa.array(rows[:, 3].astype(np.int32)), pa.array(again)], names=["h1", "h2", "key", "mark", "place", "words", "again"])


def without(text: bytes, unit: str, runs: list[tuple[int, int]]) -> tuple[int, int, list[dict[str, int]], bytes]:
    """How many units there are and go, the spans of ``runs`` (first and last unit) in code points, and the text without them."""
    own = units(text, unit)
    spans, out, chars, done = [], [], 0, 0
    for a, b in sorted(runs):
        start, end = own[a][0], own[b][1]
        out.append(text[done:start])
        chars += len(out[-1].decode())
        n = len(text[start:end].decode())
        spans.append({"start": chars, "end": chars + n})
        chars, done = chars + n, end
    return len(own), sum(b - a + 1 for a, b in runs), spans, b"".join([*out, text[done:]])


def dedup_units(spark: SparkSession, docs: DataFrame, unit: str = "piece", run_words: int = RUN_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Keeps the earliest occurrence of each unit of ``docs`` (doc_id, text), and removes runs of repeated units of ``run_words`` words or more.

    ``unit`` is "line", "paragraph" (parted by lines of blanks) or "piece" (a line's parts between marks).  Words are parted by blanks.  What parts a unit from
    the next belongs to it; units without words are none, neither end a run nor count, and go if they lie inside one.  A row for
    each row: doc_id, n_units, n_removed, spans (start and end of each removed run, in code points of the original text), text (the
    original without the spans).  A null text is an empty one.  Equal rows, id and text, count as one document and keep the same
    units; a null id counts as the least.  An empty table gives an empty one.  Of other columns, those of ``keep`` go along and the others are not read.
    """
    if unit not in CUTS or run_words < 1:
        raise ValueError("unit must be line, paragraph or piece, and run_words positive")
    scratch = Scratch(spark, "units")
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("_key"), F.xxhash64("text").alias("_mark"), *keep)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held = Places()
        for part in sliced(batches, 2):
            for k, m, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist()):
                if t:
                    held.add(k, m, units(t, unit))
            if len(held.rows) >= HELD_UNITS:
                yield held.flush()
        yield held.flush()

    found = rows.select("_key", "_mark", "text").mapInArrow(digest, "h1 long, h2 long, key long, mark long, place int, words int, again boolean")
    # places that are repeated in any case needn't meet at their digest
    lone = F.xxhash64("key", "place")
    dealt = found.withColumns({"h1": F.when(F.col("again"), lone).otherwise(F.col("h1")), "h2": F.when(F.col("again"), F.lit(0)).otherwise(F.col("h2"))})
    here = F.struct("key", "mark", "place")
    first = F.min(here).over(Window.partitionBy("h1", "h2", "again"))
    gone = dealt.withColumn("first", first).filter(F.col("again") | (F.col("first") != here)).select("key", "mark", "place", "words")
    # runs: units whose places follow each other
    island = F.col("place") - F.row_number().over(Window.partitionBy("key", "mark").orderBy("place"))
    runs = gone.dropDuplicates(["key", "mark", "place"]).withColumn("island", island).groupBy("key", "mark", "island").agg(F.sum("words").alias("words"), F.min("place").alias("first"), F.max("place").alias("last"))
    runs = runs.filter(F.col("words") >= run_words).groupBy("key", "mark").agg(F.collect_list(F.struct("first", "last")).alias("_runs"))
    runs = scratch.save(runs.withColumnsRenamed({"key": "_key", "mark": "_mark"}), "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in sliced(batches, 1):
            made = [without(t or b"", unit, [(r["first"], r["last"]) for r in own or ()]) for t, own in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist())]
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            count, removed, spans, text = ([m[i] for m in made] for i in range(4))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(text, pa.binary()).cast(pa.string()), *part.columns[3:]], names=["doc_id", "n_units", "n_removed", "spans", "text", *keep])

    # runs grow with the corpus, so they are never broadcast
    joined = rows.join(runs.hint("merge"), ["_key", "_mark"], "left").select("doc_id", "text", "_runs", *keep)
    types = dict(docs.dtypes)
    return joined.mapInArrow(cut, ", ".join(["doc_id long, n_units long, n_removed long, spans array<struct<start: long, end: long>>, text string", *(f"{c} {types[c]}" for c in keep)]))
