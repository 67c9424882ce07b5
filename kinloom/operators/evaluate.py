"""Exact entity-level metrics, blocking reports and error diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F


def per_entity_f05(entities: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """s1, n_pred, n_true, tp, f05 for every row of ``entities`` (s1); no prediction where nothing is true scores 1."""
    both = predicted.select("s1", "p", F.lit(1).alias("x"), F.lit(0).alias("y")).unionAll(truth.select("s1", "p", F.lit(0), F.lit(1)))
    pairs = both.groupBy("s1", "p").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    counts = pairs.groupBy("s1").agg(F.sum("x").alias("n_pred"), F.sum("y").alias("n_true"), F.sum(F.col("x") * F.col("y")).alias("tp"))
    out = entities.select("s1").join(counts, "s1", "left").fillna(0, ["n_pred", "n_true", "tp"])
    below = 0.25 * F.col("n_true") + F.col("n_pred")
    return out.withColumn("f05", F.when(below > 0, 1.25 * F.col("tp") / below).otherwise(1.0))


SUMMARY = {
    "macro_f05": "round(avg(f05), 6)", "f05_matched_entities": "round(avg(CASE WHEN n_true > 0 THEN f05 END), 6)",
    "f05_singletons": "round(avg(CASE WHEN n_true = 0 THEN f05 END), 6)", "pair_precision": "round(CAST(sum(tp) AS DOUBLE) / nullif(sum(n_pred), 0), 6)",
    "pair_recall": "round(CAST(sum(tp) AS DOUBLE) / nullif(sum(n_true), 0), 6)", "n_entities": "count(*)", "n_pred_pairs": "CAST(sum(n_pred) AS BIGINT)",
}


def summary(per_entity: DataFrame, *by: str) -> DataFrame:
    """The metrics over all entities, or for each value of ``by``; null where there is nothing to average."""
    out = [F.expr(x).alias(k) for k, x in SUMMARY.items()]
    return per_entity.groupBy(*by).agg(*out) if by else per_entity.agg(*out)


def decision_grid(spark: SparkSession, entities: DataFrame, scored: DataFrame, truth: DataFrame, thresholds: list[float], prob: str = "prob") -> DataFrame:
    """The summary for each threshold: pairs meet a table of thresholds, then one aggregation does for all of them."""
    grid = spark.createDataFrame([(t,) for t in thresholds], "t double")
    kept = scored.join(F.broadcast(grid), F.col(prob) >= F.col("t")).select("t", "s1", "p")
    hits = kept.join(truth.select("s1", "p", F.lit(1).alias("hit")), ["s1", "p"], "left")
    counts = hits.groupBy("t", "s1").agg(F.count("*").alias("n_pred"), F.count("hit").alias("tp"))
    # each entity meets each threshold, a fixed handful
    every = entities.join(truth.groupBy("s1").agg(F.count("*").alias("n_true")), "s1", "left").fillna(0, ["n_true"]).select("s1", "n_true", F.explode(F.array(*map(F.lit, thresholds))).alias("t"))
    out = every.join(counts, ["t", "s1"], "left").fillna(0, ["n_pred", "tp"])
    below = 0.25 * F.col("n_true") + F.col("n_pred")
    return summary(out.withColumn("f05", F.when(below > 0, 1.25 * F.col("tp") / below).otherwise(1.0)), "t")


def recall_at(spark: SparkSession, candidates: DataFrame, truth: DataFrame, n_entities: int, ks: list[int]) -> DataFrame:
    """channel, k, pair_recall, cands_per_s1: for each channel and for all together ("all"), within the first k."""
    grid = F.broadcast(spark.createDataFrame([(k,) for k in ks], "k int"))
    own = candidates.select("channel", "s1", "p", "rank")
    within = own.unionAll(own.withColumn("channel", F.lit("all"))).join(grid, F.col("rank") < F.col("k")).select("channel", "k", "s1", "p").distinct()
    hits = within.join(truth.select("s1", "p", F.lit(1).alias("hit")), ["s1", "p"], "left")
    total = truth.agg(F.count("*").alias("total"))  # one row
    counted = hits.groupBy("channel", "k").agg(F.count("*").alias("n"), F.count("hit").alias("tp"))
    return counted.join(F.broadcast(total)).select("channel", "k", F.round(F.col("tp") / F.col("total"), 6).alias("pair_recall"), F.round(F.col("n") / n_entities, 6).alias("cands_per_s1"))


def blocking_report(entities: DataFrame, candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """pair_recall, cands_per_s1, entities_full_recall, oracle_macro_f05: what a perfect choice among the candidates would reach."""
    pairs = candidates.select("s1", "p").distinct()
    hits = truth.select("s1", "p").join(pairs.withColumn("hit", F.lit(1)), ["s1", "p"], "left").groupBy("s1").agg(F.count("*").alias("n_true"), F.count("hit").alias("tp"))
    cands = pairs.groupBy("s1").agg(F.count("*").alias("n"))
    every = entities.select("s1").join(hits, "s1", "left").join(cands, "s1", "left").fillna(0, ["n_true", "tp", "n"])
    below = 0.25 * F.col("n_true") + F.col("tp")
    f = F.when(below > 0, 1.25 * F.col("tp") / below).otherwise(1.0)
    return every.agg(F.round(F.sum("tp") / F.sum("n_true"), 6).alias("pair_recall"), F.round(F.avg("n"), 6).alias("cands_per_s1"), F.round(F.avg((F.col("tp") == F.col("n_true")).cast("int")), 6).alias("entities_full_recall"), F.round(F.avg(f), 6).alias("oracle_macro_f05"))


def recall_by(truth: DataFrame, candidates: DataFrame, records: DataFrame) -> DataFrame:
    """country, src, recall: by country of the s1 and source of the p."""
    found = truth.select("s1", "p").join(candidates.select("s1", "p", F.lit(1).alias("hit")).distinct(), ["s1", "p"], "left")
    a = records.select(F.col("rid").alias("s1"), "country")
    b = records.select(F.col("rid").alias("p"), F.col("source").alias("src"))
    return found.join(a, "s1").join(b, "p").groupBy("country", "src").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


def true_match_bucket(n_true: str = "n_true"):
    return F.when(F.col(n_true) >= 5, "5+").otherwise(F.col(n_true).cast("string"))


def false_positives(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """s1, p, type of each wrong prediction: of a record without matches, of a pool record that another owns, or else a distractor."""
    wrong = predicted.select("s1", "p").join(truth, ["s1", "p"], "left_anti")
    has = truth.select("s1").distinct().withColumn("has", F.lit(True))
    owned = truth.select("p").distinct().withColumn("owned", F.lit(True))
    kind = F.when(F.col("has").isNull(), "into_singleton").when(F.col("owned"), "owned_elsewhere").otherwise("distractor")
    return wrong.join(has, "s1", "left").join(owned, "p", "left").select("s1", "p", kind.alias("type"))


def false_negatives(truth: DataFrame, predicted: DataFrame, candidates: DataFrame, exclusive: DataFrame) -> DataFrame:
    """s1, p, type of each true pair not predicted: never a candidate, lost to another claim, or below the threshold."""
    missed = truth.select("s1", "p").join(predicted, ["s1", "p"], "left_anti")
    c = candidates.select("s1", "p", F.lit(True).alias("in_c")).distinct()
    d = exclusive.select("s1", "p", F.lit(True).alias("in_d")).distinct()
    kind = F.when(F.col("in_c").isNull(), "blocking_miss").when(F.col("in_d").isNull(), "lost_exclusive").otherwise("below_threshold")
    return missed.join(c, ["s1", "p"], "left").join(d, ["s1", "p"], "left").select("s1", "p", kind.alias("type"))


def shift_stats(a: DataFrame, b: DataFrame, columns: list[str], most: int = 14) -> DataFrame:
    """feature, median_a, median_b, std_shift: features whose means differ most between two sets, in standard deviations of both together."""
    long = lambda df, side: df.select(F.lit(side).alias("side"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))).alias("v")).select("side", "v.*")
    both = long(a, "a").unionAll(long(b, "b")).filter(F.col("x").isNotNull())
    own = lambda s: F.when(F.col("side") == s, F.col("x"))
    stats = both.groupBy("feature").agg(F.round(F.median(own("a")), 6).alias("median_a"), F.round(F.median(own("b")), 6).alias("median_b"), F.round((F.avg(own("b")) - F.avg(own("a"))) / (F.stddev_pop("x") + 1e-9), 6).alias("std_shift"))
    return stats.orderBy(F.desc(F.abs("std_shift")), "feature").limit(most)


def pseudo_labels(scored: DataFrame, prob: str = "prob") -> DataFrame:
    """Adds pseudo: 1 for sure and uncontested pairs, 0 for unlikely ones and those that a strong claim beats, else -1."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("p").orderBy(F.desc(prob), "s1")
    ranked = scored.withColumn("_r", F.row_number().over(order))
    two = ranked.filter("_r <= 2").groupBy("p").agg(F.max(prob).alias("_best"), F.coalesce(F.max(F.when(F.col("_r") == 2, F.col(prob))), F.lit(0.0)).alias("_second"))
    own = F.col(prob)
    sure = (own >= 0.995) & (own >= F.col("_best")) & (F.col("_second") < 0.5)
    bad = (own <= 0.05) | ((own < F.col("_best")) & (F.col("_best") >= 0.9))
    return ranked.join(two, "p").withColumn("pseudo", F.when(sure, 1).when(bad, 0).otherwise(-1)).drop("_r", "_best", "_second")


def change_histogram(changes: DataFrame, column: str) -> DataFrame:
    """bin, n: how many values lie in each of seven fixed bins from -1 to 1; values outside are left out."""
    edges = [-1, -0.5, -0.2, -0.05, 0.05, 0.2, 0.5, 1]
    x = F.col(column)
    place = reduce(lambda acc, i: acc.when((x >= edges[i]) & ((x < edges[i + 1]) if i < 6 else (x <= 1)), i), range(7), F.when(F.lit(False), -1))
    return changes.select(place.alias("bin")).filter("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
