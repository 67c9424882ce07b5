"""Normalisation of records as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kinloom.functions.text import normalized
from kinloom.sources.records import RAW


def record_stream(spark: SparkSession, folder: str, source: int, files_per_batch: int = 16) -> DataFrame:
    """New tab-separated files of a folder as records of one source."""
    raw = spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).csv(folder, sep="\t", header=True, quote="")
    return raw.fillna("").selectExpr("entity_id", "business_name AS name", "business_address AS address", "country", f"CAST({source} AS TINYINT) AS source")


def normalize_stream(records: DataFrame, out: str, state: str) -> StreamingQuery:
    """Appends normalised records to Parquet, each once, until all files there are read."""
    return normalized(records).writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out)
