import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from kinloom.llm.sentencepieces import pieces
from kinloom.llm.sp_codec import MergeEncoder, decode, encode
from tests.llm.common import ODD, docs, words

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [*ODD, "  two  blanks ", " ", "the " * 500, " ".join(words(400, 4, "etaoinshrdlu")), "a" * 40 + " b"]


def test_no_dropout_is_sentencepiece():
    model, enc = SentencePieceProcessor(model_file=PATH), MergeEncoder(pieces(PATH), 0.0, 3)
    for t in TEXTS:
        if t is not None and "▁" not in t:
            assert enc.texts([t], [1]).values.tolist() == model.encode(t), t


def test_lossless_and_seeded(spark):
    texts = [*TEXTS, *TEXTS]
    df = docs(spark, texts, extra=True, ids=[*range(len(TEXTS) - 1), None] * 2)
    rows = decode(encode(df, PATH, 0.3, 7), PATH).collect()
    assert len(rows) == len(texts) and all(r.decoded == r.text for r in rows)
    ids = {(r.doc_id, r.text): r.ids for r in rows}
    assert len(ids) == len(TEXTS) and all(ids[r.doc_id, r.text] == r.ids for r in rows)
    again = encode(df.repartition(3), PATH, 0.3, 7, restored=True).collect()
    assert all(ids[r.doc_id, r.text] == r.ids and r.decoded == r.text for r in again)
    assert any(ids[r.doc_id, r.text] != r.ids for r in encode(df, PATH, 0.3, 8).collect())


def test_occurrences_vary():
    enc = MergeEncoder(pieces(PATH), 0.3, 1)
    own = enc.texts(["international"] * 64, list(range(64)))
    assert len({own.values[a : a + n].tobytes() for a, n in zip(own.starts, own.sizes)}) > 8


def test_all_dropped_are_characters():
    enc = MergeEncoder(pieces(PATH), 1.0, 1)
    assert len(enc.texts(["abc de"], [1]).values) == 7


def brute(enc, word, base):
    """Ids by the plainest agenda: again and again the best candidate that isn't off, leftmost first."""
    cut, off = [(i, c) for i, c in enumerate(word)], set()
    while True:
        open_ = [(-enc.score[a + b], i, k) for k, ((i, a), (_, b)) in enumerate(zip(cut, cut[1:])) if a + b in enc.score and (i, a + b) not in off]
        if not open_:
            break
        _, i, k = min(open_)
        both = cut[k][1] + cut[k + 1][1]
        x = (base ^ (i << 32 | enc.ids[both]) * 0x9E3779B97F4A7C15) & (1 << 64) - 1
        if (x ^ x >> 31) * 0xD6E8FEB86659FD93 & (1 << 64) - 1 < enc.limit:
            off.add((i, both))
            continue
        # candidates that are new, as one of their two symbols is, are considered again
        near = {cut[k - 1][0] if k else -1, i}
        off = {o for o in off if o[0] not in near}
        cut[k : k + 2] = [(i, both)]
    return [x for _, s in cut for x in ([enc.ids[s]] if s in enc.ids else [enc.byte_ids[b] for b in s.encode()])]


@pytest.mark.parametrize("rate", [0.0, 0.2, 0.9])
def test_agendas_against_brute_force(rate):
    enc, r = MergeEncoder(pieces(PATH), rate, 5), random.Random(2)
    ws = [" " + "".join(r.choices("thenringatoé\nß中\0", k=r.randint(0, 30))) for _ in range(400)]
    bases = np.array([enc.base(w, r.randint(0, 5)) for w in ws], np.uint64)
    many, _ = enc.words(ws, bases)
    for w, base, a, n in zip(ws, bases.tolist(), many.starts, many.sizes):
        assert enc.short(w, base, []) == enc.long(w, base, [])
        assert many.values[a : a + n].tolist() == brute(enc, w, base), w


def test_texts_against_brute_force(monkeypatch):
    monkeypatch.setattr("kinloom.llm.sp_codec.CACHE_WORDS", 40)
    enc, r = MergeEncoder(pieces(PATH), 0.2, 9), random.Random(4)
    for k in range(6):
        texts = [" ".join(words(60, 100 * k + i, "theringa") + ["x" * 60, "中文"]) for i in range(4)]
        own = enc.texts(texts, [7, 8, 9, 10])
        for t, key, a, n in zip(texts, [7, 8, 9, 10], own.starts, own.sizes):
            ws = enc.cut(t)
            expected = [i for w, turn in zip(ws, enc.turns(len(ws), key).tolist()) for i in brute(enc, " " + w, enc.base(" " + w, turn))]
            assert own.values[a : a + n].tolist() == expected


def test_empty_table(spark):
    assert decode(encode(docs(spark, []), PATH), PATH).count() == 0


def test_query_keys_each_occurrence_apart(spark, tmp_path):
    from kinloom.llm.queries import op2_sentencepiece_dropout
    from tests.llm.common import docs

    docs(spark, ["internationalization"] * 200).write.parquet(f"{tmp_path}/documents.parquet")
    rows = op2_sentencepiece_dropout(spark, str(tmp_path)).collect()
    assert all(r.lossless for r in rows) and len({r.ids_crc32 for r in rows}) > 4
