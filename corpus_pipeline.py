"""The corpus pipeline: quality, repeated lines, near copies, repeated passages, then packing.

Each stage takes all that the one before it kept, and its decisions take effect: texts of low quality go, lines that many documents
hold go from the texts, one document of each group of near copies stays, repeated passages stay where they are first found, and the
texts that are left are packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinloom.llm.jaccard_join import jaccard_components
from kinloom.llm.line_dedup import dedup_lines
from kinloom.llm.packing import best_fit_pack
from kinloom.llm.quality_classifier import held_out, learn_quality, score_quality
from kinloom.llm.scratch import Scratch
from kinloom.llm.substring_dedup import dedup_units

#: SQL has no form for the classifier.
ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that score at least LEAST_SCORE; the model learns from ``labels``, but for the held-out rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn_quality(docs, labels, ~held_out(F.col("doc_id")))
    return score_quality(spark, docs, model, *COLUMNS).filter(F.col("score") >= LEAST_SCORE).drop("score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that ten documents or more hold."""
    kept = dedup_lines(spark, docs, min_docs=10, min_chars=1, keep=("lang", "source"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles, the one of the least id stays."""
    found = jaccard_components(spark, docs, words=5, num=4, den=5)
    gone = Scratch(spark, "copies").save(found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id"), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 30 words or more, in whole pieces of lines, stay where they are first found."""
    kept = dedup_units(spark, docs, unit="piece", run_words=30, keep=("lang", "source"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of 4096 ids.  Workers that have run the other stages have room for fewer words."""
    import public_tokenizers

    return best_fit_pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"), cache_words=200_000)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("passages", passages), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages one after the other to ``documents``; what each kept is written, and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
