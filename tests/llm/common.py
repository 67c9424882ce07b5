"""Small inputs with the cases that every operator has to bear."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns that clash with names operators make.
EXTRA = "key string, n string, score string, h1 string, length string, rank string, found string, chunk string, part string, doc string, node string, component string, shard string, place string"


def docs(spark, texts, extra=False, **lists):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows = [(lists.get("ids", range(len(rows)))[i], *r[1:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit("x").alias(c.split()[0]) for c in EXTRA.split(", ")))
    return df


def words(n, seed, letters="abcdefgh"):
    r = random.Random(seed)
    return ["".join(r.choices(letters, k=r.randint(1, 6))) for _ in range(n)]


ODD = [None, "", "   ", "\n", "\n\n", "a", "A b\tc", "x" * 5000, "wörd çedilla ßtraße é́ 中文 👩‍👧", "tab\there\r\nand\x0bthere", "<|endoftext|> <s> ▁ \x00 \x1c", "same line\nsame line\nsame line"]
