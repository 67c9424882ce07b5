import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from kinloom.llm.packing import CapacityTree, best_fit_pack, plan_bins
from tests.llm.common import ODD, docs, words

PATH = public_tokenizers.path("word_bpe_49k.json")


def slow_best_fit(lengths, room):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [(free, i) for i, free in enumerate(bins) if free >= n]
        if fits:
            bins[min(fits)[1]] -= n
        else:
            bins.append(room - n)
    return len(bins)


@settings(max_examples=200, deadline=None)
@given(st.integers(3, 60), st.data())
def test_plan_is_best_fit_decreasing(room, data):
    lengths = data.draw(st.lists(st.integers(1, room), max_size=80))
    runs, bins = plan_bins(Counter(lengths), room)
    assert bins == slow_best_fit(lengths, room)
    filled = {}
    for length, _, first, offset, count in runs.tolist():
        for k in range(count):
            filled.setdefault(first + k, []).append((offset, length))
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= room
    assert Counter(n for p in filled.values() for _, n in p) == Counter(lengths)


def test_capacity_tree():
    tree, on, r = CapacityTree(100), set(), random.Random(1)
    for _ in range(2000):
        c = r.randint(0, 100)
        on.symmetric_difference_update({c})
        tree.set(c, c in on)
        need = r.randint(0, 100)
        assert tree.tightest(need) == min((x for x in on if x >= need), default=-1)


def test_whole_documents_in_sequences(spark):
    texts = [*ODD, *(" ".join(words(n, n)) for n in (3, 50, 700, 3000)), "same " * 40, "same " * 40]
    tok = Tokenizer.from_file(PATH)
    found = best_fit_pack(spark, docs(spark, texts, extra=True), PATH, max_tokens=64).collect()
    ids = [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found} == {(d, s // 64, s, len(x[s : s + 64]), zlib.crc32(np.array(x[s : s + 64], "<u4").tobytes())) for d, x in enumerate(ids) for s in range(0, len(x), 64)}
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert len(sequences) == slow_best_fit([r.length for r in found], 64)


def test_empty_table_and_repeated_rows(spark):
    assert best_fit_pack(spark, docs(spark, []), PATH).count() == 0
    df = docs(spark, ["a b c"] * 300, ids=[5] * 300)
    rows = best_fit_pack(spark, df, PATH, max_tokens=16).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 300 and len({r.sequence_id for r in rows}) == 75


def test_sequences_hold_the_ids_of_their_documents(spark):
    texts = [*ODD, *(" ".join(words(n, n)) for n in (3, 50, 700)), "same " * 40, "same " * 40]
    tok = Tokenizer.from_file(PATH)
    found = best_fit_pack(spark, docs(spark, texts, extra=True), PATH, max_tokens=64).collect()
    packed, whole = {}, {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == len(packed.setdefault(r.sequence_id, []))
        packed[r.sequence_id] += np.frombuffer(r.ids, "<u4").tolist()
    for r in sorted(found, key=lambda r: (r.doc_id, r.piece)):
        whole.setdefault(r.doc_id, []).extend(packed[r.sequence_id][r.offset : r.offset + r.length])
    assert whole == {d: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for d, t in enumerate(texts)}
