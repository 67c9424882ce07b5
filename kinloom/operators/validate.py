"""Checks of result files: a row for each rule with the number of cases and a few of them."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EXAMPLES = 5
#: Rules that only warn.
WARNINGS = ("match_not_candidate",)


def found(df: DataFrame, rule: str, example: Column) -> DataFrame:
    """One row: rule, n, examples (the first few in order)."""
    case = df.select(example.cast("string").alias("x"))
    few = case.groupBy().agg(F.count("*").alias("n"))
    first = case.orderBy("x").limit(EXAMPLES).groupBy().agg(F.sort_array(F.collect_list("x")).alias("examples"))
    # two tables of one row each
    return few.join(F.broadcast(first)).select(F.lit(rule).alias("rule"), "n", "examples")


def check_header(spark: SparkSession, path: str, expected: list[str]) -> list[str]:
    """What keeps a file from being read: it is missing, empty or not UTF-8, or its first line has commas for tabs or other columns."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return ["missing_file"]
    first = lines.limit(1).collect()
    if not first:
        return ["empty_file"]
    if lines.filter(~F.is_valid_utf8("value")).limit(1).count():
        return ["not_utf8"]
    cells = [c.strip().lower() for c in first[0][0].split("\t")]
    if cells == [c.lower() for c in expected]:
        return []
    return ["comma_separated" if len(cells) == 1 and "," in cells[0] else "wrong_header"]


def read_lists(spark: SparkSession, path: str, header: str) -> tuple[DataFrame, DataFrame]:
    """Well-formed rows (source1_entity_id, ids), and lines without a tab; blank lines and the header are left out."""
    lines = spark.read.text(path).filter((F.trim("value") != "") & (F.lower(F.trim("value")) != header.lower()))
    good = lines.filter(F.col("value").contains("\t"))
    ids = F.filter(F.transform(F.split(F.split("value", "\t", 2)[1], ","), lambda i: F.trim(i)), lambda i: i != "")
    return good.select(F.trim(F.split("value", "\t")[0]).alias("source1_entity_id"), ids.alias("ids")), lines.filter(~F.col("value").contains("\t"))


def list_issues(lists: DataFrame, required: DataFrame, known: DataFrame | None = None, malformed: DataFrame | None = None) -> DataFrame:
    """rule, n, examples for lists (source1_entity_id, ids); required (entity_id): the rows there must be; known (entity_id): ids that may be listed."""
    key = F.col("source1_entity_id")
    items = lists.select("source1_entity_id", F.explode("ids").alias("id"))
    parts = [
        found(lists.groupBy("source1_entity_id").count().filter("count > 1"), "duplicate_row", key),
        found(lists.filter(F.size("ids") != F.size(F.array_distinct("ids"))), "duplicate_in_list", key),
        found(items.filter(F.col("id").startswith("S1-")), "source1_in_list", F.col("id")),
        found(items.filter(~F.col("id").rlike("^S[123]-")), "wrong_prefix", F.col("id")),
        found(required.join(lists.select(key.alias("entity_id")), "entity_id", "left_anti"), "missing_row", F.col("entity_id")),
        found(lists.select(key.alias("entity_id")).join(required, "entity_id", "left_anti"), "unexpected_row", F.col("entity_id")),
    ]
    if known is not None:
        parts.append(found(items.join(known.select(F.col("entity_id").alias("id")), "id", "left_anti"), "unknown_id", F.col("id")))
    if malformed is not None:
        parts.append(found(malformed, "malformed_row", F.col("value")))
    return reduce(DataFrame.unionByName, parts)


def match_issues(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Warns of matches that are no candidates."""
    c = candidates.select("source1_entity_id", F.col("ids").alias("candidates"))
    odd = matches.join(c, "source1_entity_id", "left").filter(F.size(F.array_except("ids", F.coalesce("candidates", F.array().cast("array<string>")))) > 0)
    return found(odd, "match_not_candidate", F.col("source1_entity_id"))


def passed(issues: DataFrame) -> bool:
    return issues.filter((F.col("n") > 0) & ~F.col("rule").isin(*WARNINGS)).isEmpty()
