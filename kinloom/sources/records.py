"""Readers and writers of records, ground truth, result lists, configurations and experiment logs."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from kinloom.sources.scratch import Scratch

RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A headered UTF-8 file with tabs and without quoting; all columns are strings, and empty is a value."""
    df = spark.read.csv(path, schema=schema, sep="\t", header=True, quote="", enforceSchema=False, encoding="UTF-8")
    return df.fillna("")


def union_sources(scratch: Scratch, sources: list[DataFrame]) -> DataFrame:
    """records (rid, entity_id, name, address, country, source): the sources one after the other, numbered from 1.

    rid goes by source, then by place in the files; it is written once, so later reads agree on it.  A repeated id is an error.
    """
    tagged = [df.select("entity_id", F.col("business_name").alias("name"), F.col("business_address").alias("address"), "country", F.lit(n).cast("byte").alias("source")) for n, df in enumerate(sources, 1)]
    out = scratch.save(reduce(DataFrame.unionByName, tagged).withColumn("rid", F.monotonically_increasing_id()), "records")
    twice = out.groupBy("entity_id").count().filter("count > 1").select("entity_id").take(3)
    if twice:
        raise ValueError(f"ids occur more than once: {[r[0] for r in twice]}")
    return out


def truth_pairs(truth: DataFrame, records: DataFrame) -> DataFrame:
    """(s1, p) by rid, of comma lists of ids; blanks and empty items are left out, an unknown id is an error."""
    listed = truth.select("source1_entity_id", F.explode(F.split(F.coalesce("matched_entity_ids", F.lit("")), ",")).alias("m"))
    listed = listed.select("source1_entity_id", F.trim("m").alias("m")).filter("m <> ''")
    ids = records.select("entity_id", "rid")
    a, b = ids.withColumnsRenamed({"entity_id": "source1_entity_id", "rid": "s1"}), ids.withColumnsRenamed({"entity_id": "m", "rid": "p"})
    unknown = listed.select(F.col("m").alias("entity_id")).unionAll(listed.select("source1_entity_id")).join(ids, "entity_id", "left_anti").take(3)
    if unknown:
        raise ValueError(f"ids of no record: {[r[0] for r in unknown]}")
    return listed.join(a, "source1_entity_id").join(b, "m").select("s1", "p")


def document_records(documents: DataFrame) -> DataFrame:
    """Documents as records of three sources: the first line is the name, the last of several lines the address, the language the country."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    source = F.pmod("doc_id", F.lit(3)) + 1
    return documents.select(
        F.col("doc_id").alias("rid"), F.concat(F.lit("S"), source.cast("string"), F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("entity_id"),
        F.element_at(lines, 1).alias("name"), F.when(F.size(lines) > 1, F.element_at(lines, -1)).otherwise("").alias("address"),
        F.col("lang").alias("country"), source.cast("byte").alias("source"),
    )


def equal_text_truth(documents: DataFrame) -> DataFrame:
    """(s1, p): for each pool document the least source-1 document of its language with the same text, blanks aside."""
    own = documents.select("doc_id", "lang", (F.pmod("doc_id", F.lit(3)) + 1).alias("source"), F.sha2(F.trim(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " ")), 256).alias("t"))
    first = own.filter("source = 1").groupBy("lang", "t").agg(F.min("doc_id").alias("s1"))
    return own.filter("source > 1").join(first, ["lang", "t"]).select("s1", F.col("doc_id").alias("p"))


def write_lists(lists: DataFrame, path: str) -> None:
    """Id lists as tab-separated files with a header and without quoting; empty lists stay empty."""
    lists.orderBy("source1_entity_id").write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="", encoding="UTF-8")


def append_log(spark: SparkSession, entry: dict, path: str) -> None:
    """One more JSON line in an experiment log."""
    spark.createDataFrame([(json.dumps(entry, default=str),)], "value string").coalesce(1).write.mode("append").text(path)


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON configuration, from any store that Spark reads."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
