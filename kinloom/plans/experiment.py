"""Experiments from JSON configurations: features, a baseline or boosted score, stacking, decision grids and a log."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinloom.operators import candidates as cand, context as ctx, decide, evaluate as ev, models
from kinloom.plans.cascade import cheap_features, feature_columns, full_features, retrieve_all
from kinloom.sources.records import append_log, write_report
from kinloom.sources.scratch import Scratch

THRESHOLDS = [round(0.2 + 0.05 * k, 2) for k in range(16)]


def run_experiment(spark: SparkSession, config: dict, records: DataFrame, truth: DataFrame, out: str | None = None) -> DataFrame:
    """The decision grid of one configuration, best first.

    Keys: blocking (k by channel), sample (share of source-1 records), features, drop_features, baseline_score (a column that is the
    probability), model (parameters), folds, stack, thresholds.  ``out``: a folder for the log and the reports.
    """
    began, scratch = time.time(), Scratch(spark, "experiment")
    entities = scratch.save(cand.sampled(records, config.get("sample", 1.0)).select(F.col("rid").alias("s1")), "entities")
    own_truth = scratch.save(truth.join(entities, "s1", "left_semi"), "truth")
    lists = retrieve_all(scratch, records, config["blocking"], config.get("cap", 5000))
    pairs = cand.labelled(cand.assemble(lists, config["blocking"], entities), own_truth)
    df = scratch.save(full_features(cheap_features(pairs, records, lists, config["blocking"]), records), "features")
    columns = [c for c in feature_columns(df) if c in config.get("features", df.columns) and c not in config.get("drop_features", [])]
    stage1 = None
    if base := config.get("baseline_score"):
        scored = df.withColumn("prob", F.coalesce(F.col(base).cast("double"), F.lit(0.0)))
    else:
        scored = scratch.save(models.out_of_fold(df, columns, config.get("folds", 4), **config.get("model", {})).drop("fold"), "scored")
        if config.get("stack"):
            stage1 = ev.decision_grid(spark, entities, decide.exclusive(scored), own_truth, [0.6, 0.65, 0.7, 0.75]).orderBy(F.desc("macro_f05")).first()
            siblings = ctx.sibling_context(scored).withColumnRenamed("prob", "st_prob")
            scored = scratch.save(models.out_of_fold(siblings, [c for c in siblings.columns if c.startswith("st_")], config.get("folds", 4), **config.get("stack_model", {})).drop("fold"), "stacked")
    parts = []
    for exclusive in (False, True):
        chosen = decide.exclusive(scored) if exclusive else scored
        grid = ev.decision_grid(spark, entities, chosen, own_truth, config.get("thresholds", THRESHOLDS))
        parts.append(grid.select(F.lit("threshold").alias("rule"), F.lit(exclusive).alias("exclusive"), *grid.columns))
        expected = ev.summary(ev.per_entity_f05(entities, decide.by_expected_f(chosen), own_truth))
        parts.append(expected.select(F.lit("expected_f").alias("rule"), F.lit(exclusive).alias("exclusive"), F.lit(None).cast("double").alias("t"), *expected.columns))
    grid = parts[0]
    for p in parts[1:]:
        grid = grid.unionByName(p)
    grid = scratch.save(grid, "grid").orderBy(F.desc("macro_f05"))
    if out:
        ceiling = ev.blocking_report(entities, df, own_truth).first().oracle_macro_f05
        append_log(spark, {"name": config.get("name"), "time_s": round(time.time() - began), "n_pairs": df.count(), "blocking_ceiling_f05": ceiling, "best": grid.first().asDict(), "stage1_best": stage1 and stage1.asDict(), "config": config}, f"{out}/results")
        write_report(grid, f"{out}/{config.get('name', 'run')}_decisions")
    return grid


def self_trained(scored: DataFrame, features: DataFrame, labelled: DataFrame, columns: list[str], country: str, **params) -> DataFrame:
    """(s1, p, prob): probabilities of one country made anew by a model that also learns its sure pseudo-labels; the others stay.

    ``scored`` has all pairs with country and prob, ``features`` those of the country with ``columns``, ``labelled`` true ones with label.
    """
    pseudo = ev.pseudo_labels(scored).filter((F.col("country") == country) & (F.col("pseudo") >= 0)).select("s1", "p", (F.col("pseudo") == 1).alias("label"))
    learned = labelled.select(*columns, "label").unionByName(features.join(pseudo, ["s1", "p"]).select(*columns, "label"))
    again = models.predict(models.fit(learned, columns, **params), features, columns).select("s1", "p", "prob")
    return scored.filter(F.col("country") != country).select("s1", "p", "prob").unionByName(again)
