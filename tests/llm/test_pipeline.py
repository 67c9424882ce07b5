"""The pipeline against its stages done by hand on a small corpus."""

import random
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from kinloom.llm.quality_classifier import held_out, learn_quality, score_quality
from tests.llm.common import DOCS, words
from tests.llm.test_jaccard import slow as slow_links
from tests.llm.test_lines import slow as slow_lines
from tests.llm.test_packing import slow_best_fit
from tests.llm.test_substrings import slow as slow_units


def corpus():
    r, rows = random.Random(9), []
    passage = " ".join(words(55, 999))
    for k in range(120):
        if k % 6 == 5:
            text = " ".join(w.upper() + "!!" for w in words(40, k))
        else:
            text = "\n".join(" ".join(words(r.randint(12, 30), 50 * k + i)) for i in range(r.randint(2, 6)))
            if k % 5 == 0:
                text += "\n" + passage
            if k % 2 == 0:
                text = "shared header\n" + text
        rows.append([k, text])
    for k in range(120, 140):
        rows.append([k, rows[k - 120][1].replace("a", "a", 1) + " x"])
    rows += [[140, None], [141, ""]]
    return [(k, t, "en" if k % 3 else None, f"s{k % 2}", None if t is None else len(t)) for k, t in rows]


def test_stages(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], int("!!" not in (r[1] or "")), 0) for r in rows if r[0] < 120]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = learn_quality(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), ~held_out(F.col("doc_id")))
    good = {r.doc_id for r in score_quality(spark, df, model, "doc_id").filter("score >= 0.7").collect()}
    assert {r[0] for r in rows if r[1] and "!!" in r[1]} & good == set() and len(good) >= 118
    left = [(r[0], r[1]) for r in rows if r[0] in good]
    left = [(d, x[2]) for (d, _), x in zip(left, slow_lines([t for _, t in left], 10, 1))]
    links = {d: c for d, _, c in slow_links([d for d, _ in left], [t for _, t in left], 5, 4, 5)}
    left = [(d, t) for d, t in left if links[d] == d]
    units = slow_units([d for d, _ in left], [t for _, t in left], "piece", 30)
    texts = {d: units[d][3] for d, _ in left}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {d: len(tok.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts.items()}
    found = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.length for r in found} == lengths
    assert len({r.sequence_id for r in found}) == slow_best_fit(lengths.values(), 4096)
    assert Counter(r.doc_id for r in found).most_common(1)[0][1] == 1


def test_stages_return_documents(spark, tmp_path):
    df = spark.createDataFrame(corpus(), DOCS)
    spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality", "lines", "near_copies", "passages", "packing"]
    for _, stage in cp.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.dtypes == [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
