"""Commands on files: prepare, block, blocking-eval, train, score, holdout, experiment, finalize, validate."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F


def _records(spark: SparkSession, work: str) -> DataFrame:
    return spark.read.parquet(f"{work}/records")


def prepare(spark: SparkSession, a: argparse.Namespace) -> int:
    from kinloom.functions.text import normalized
    from kinloom.sources.records import RAW, TRUTH, read_tsv, truth_pairs, union_sources
    from kinloom.sources.scratch import Scratch

    records = union_sources(Scratch(spark, "prepare"), [read_tsv(spark, p, RAW) for p in a.sources])
    normalized(records).write.mode("overwrite").parquet(f"{a.work}/records")
    if a.truth:
        truth_pairs(read_tsv(spark, a.truth, TRUTH), records).write.mode("overwrite").parquet(f"{a.work}/truth")
    return 0


def block(spark: SparkSession, a: argparse.Namespace) -> int:
    from kinloom.operators.candidates import hash_bucket
    from kinloom.operators.retrieve import cosine_topk
    from kinloom.operators.terms import CHANNELS
    from kinloom.sources.scratch import Scratch

    asked = hash_bucket(F.col("entity_id")) < int(a.sample * 10_000)
    for c in a.channels:
        found = cosine_topk(Scratch(spark, "block"), _records(spark, a.work), CHANNELS[c.removesuffix("_rev")], a.K, a.cap, reverse=c.endswith("_rev"), asked=asked if a.sample < 1 else None)
        found.withColumn("channel", F.lit(c)).write.mode("overwrite").parquet(f"{_lists(a)}/channel={c}")
    return 0


def _lists(a: argparse.Namespace) -> str:
    """The folder of candidate lists; lists of a sample have one of their own."""
    return f"{a.work}/candidates" + (f"-{a.sample:g}" if a.sample < 1 else "")


def blocking_eval(spark: SparkSession, a: argparse.Namespace) -> int:
    from kinloom.operators import evaluate as ev
    from kinloom.operators.candidates import sampled

    entities = sampled(_records(spark, a.work), a.sample).select(F.col("rid").alias("s1"))
    truth = spark.read.parquet(f"{a.work}/truth").join(entities, "s1", "left_semi")
    lists = spark.read.parquet(_lists(a)).select("channel", "s1", "p", "score", "rank")
    ev.recall_at(spark, lists, truth, entities.count(), [int(k) for k in a.Ks.split(",")]).orderBy("channel", "k").show(100, False)
    return 0


def _ks(a: argparse.Namespace) -> dict[str, int]:
    return {k: int(v) for k, v in (x.split("=") for x in a.ks)}


def train(spark: SparkSession, a: argparse.Namespace) -> int:
    """Fits the cascade on the first ``--share`` of source-1 records by hash, and writes its models."""
    from kinloom.operators.candidates import sampled
    from kinloom.plans.cascade import learn_cascade
    from kinloom.sources.scratch import Scratch

    records = _records(spark, a.work)
    entities = sampled(records, a.share).select(F.col("rid").alias("s1")) if a.share < 1 else None
    found = learn_cascade(Scratch(spark, "train"), records, spark.read.parquet(f"{a.work}/truth"), _ks(a), a.models, entities, a.cap, **json.loads(a.sizes))
    found.write.mode("overwrite").parquet(f"{a.work}/train-scores")
    return 0


def score(spark: SparkSession, a: argparse.Namespace) -> int:
    """Scores all records by the models in ``--models``, or by out-of-fold ones fitted for this where none are given."""
    from kinloom.plans.cascade import apply_cascade, run_cascade
    from kinloom.sources.scratch import Scratch

    scratch, records = Scratch(spark, "score"), _records(spark, a.work)
    found = apply_cascade(scratch, records, a.models) if a.models else run_cascade(scratch, records, spark.read.parquet(f"{a.work}/truth"), _ks(a), a.cap)
    found.write.mode("overwrite").parquet(f"{a.work}/scores")
    return 0


def holdout(spark: SparkSession, a: argparse.Namespace) -> int:
    """Metrics of the scores over source-1 records that ``train`` with this ``--share`` left out, by country and over all."""
    from kinloom.operators import decide, evaluate as ev
    from kinloom.operators.candidates import sampled

    records = _records(spark, a.work)
    learned = sampled(records, a.share).select("rid")
    held = records.filter("source = 1").join(learned, "rid", "left_anti").select(F.col("rid").alias("s1"), "country")
    truth = spark.read.parquet(f"{a.work}/truth").join(held, "s1", "left_semi")
    kept = decide.by_country_cutoff(spark.read.parquet(f"{a.work}/scores"), records).join(held, "s1", "left_semi")
    each = ev.per_entity_f05(held, kept, truth).join(held, "s1")
    by, whole = ev.summary(each, "country"), ev.summary(each)
    by.unionByName(whole.select(F.lit("all").alias("country"), *whole.columns)).coalesce(1).write.mode("overwrite").json(f"{a.work}/holdout")
    spark.read.json(f"{a.work}/holdout").show(100, False)
    return 0


def experiment(spark: SparkSession, a: argparse.Namespace) -> int:
    from kinloom.plans.experiment import run_experiment
    from kinloom.sources.records import read_config

    grid = run_experiment(spark, read_config(spark, a.config), _records(spark, a.work), spark.read.parquet(f"{a.work}/truth"), f"{a.work}/experiments")
    print(json.dumps(grid.first().asDict()))
    return 0


def finalize(spark: SparkSession, a: argparse.Namespace) -> int:
    from kinloom.operators import decide
    from kinloom.sources.records import write_lists

    records, scores = _records(spark, a.work), spark.read.parquet(f"{a.work}/scores")
    kept = decide.by_country_cutoff(decide.exclusive(scores), records)
    write_lists(decide.match_lists(kept, records), f"{a.out}/matching_results")
    write_lists(decide.match_lists(scores, records, "candidate_entity_ids"), f"{a.out}/candidate_pairs")
    return 0


def validate(spark: SparkSession, a: argparse.Namespace) -> int:
    from kinloom.operators import validate as v
    from kinloom.sources.records import RAW, read_tsv

    sources = [read_tsv(spark, p, RAW).select("entity_id") for p in a.sources]
    known = sources[0]
    for s in sources[1:]:
        known = known.unionAll(s)
    ok, lists = True, {}
    for path, column in ((a.matches, "matched_entity_ids"), (a.candidates, "candidate_entity_ids")):
        if path is None:
            continue
        header = ["source1_entity_id", column]
        if faults := v.check_header(spark, path, header):
            print(f"{path}: {', '.join(faults)}")
            ok = False
            continue
        lists[column], bad = v.read_lists(spark, path, "\t".join(header))
        issues = v.list_issues(lists[column], sources[0], known if a.check_ids else None, bad)
        issues.filter("n > 0").show(100, False)
        ok &= v.passed(issues)
    if len(lists) == 2:
        v.match_issues(*lists.values()).filter("n > 0").show(10, False)
    print("PASS" if ok else "FAIL")
    return 0 if ok else 1


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="kinloom")
    sub = top.add_subparsers(required=True)

    def command(f, *args: tuple) -> None:
        p = sub.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        for names, options in args:
            p.add_argument(*names, **options)
        p.set_defaults(run=f)

    work = (["--work"], {"required": True})
    command(prepare, work, (["sources"], {"nargs": "+"}), (["--truth"], {}))
    command(block, work, (["channels"], {"nargs": "+"}), (["--K"], {"type": int, "default": 50}), (["--cap"], {"type": int, "default": 5000}), (["--sample"], {"type": float, "default": 1.0}))
    command(blocking_eval, work, (["--Ks"], {"default": "5,10,20,50"}), (["--sample"], {"type": float, "default": 1.0}))
    lists = (["--ks"], {"nargs": "+", "default": ["joint=30", "addr=20", "name=10", "cgram=10", "name_noaddr=10", "native=10", "cgram_noaddr=10", "joint_rev=2"]}), (["--cap"], {"type": int, "default": 5000})
    share = ["--share"], {"type": float, "default": 1.0}
    command(train, work, (["--models"], {"required": True}), share, (["--sizes"], {"default": "{}", "help": "JSON of pruner, matcher and stacker"}), *lists)
    command(score, work, (["--models"], {}), *lists)
    command(holdout, work, share)
    command(experiment, work, (["config"], {}))
    command(finalize, work, (["--out"], {"required": True}))
    command(validate, (["-m", "--matches"], {}), (["-c", "--candidates"], {}), (["-s", "--sources"], {"nargs": "+", "required": True}), (["--check-ids"], {"action": "store_true"}))
    a = top.parse_args(argv)
    return a.run(SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
