"""One query for each record-linkage operator over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinloom.functions import lexicon as lex
from kinloom.functions.fold import fold
from kinloom.functions.similarity import house_number_stats, pair_features, similarities, token_set_stats, with_both_sides
from kinloom.functions.text import address_numbers, folded_address, normalized, skeleton, street, words
from kinloom.operators import candidates as cand, context as ctx, decide, evaluate as ev, stats, validate
from kinloom.operators.retrieve import cosine_topk
from kinloom.operators.terms import CHANNELS
from kinloom.sources.records import document_records, equal_text_truth
from kinloom.sources.scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]

CAP, MIN_TERMS, M_MULT = 5000, 2, 4
CHANNEL_KS = {c: x.k for c, x in CHANNELS.items()} | {"joint_rev": 2}
#: Cap and list length of ``er_retrieve_capped``; the cap binds on the test tables too, so that skipped terms and shortlists take part.
SMALL_CAP, SMALL_K = 100, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- shared inputs


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_records(table(spark, sf_dir, "documents"))


def norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(records(spark, sf_dir))


class Linkage:
    """Normalised records, candidates and truth of one query, each written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.scratch = Scratch(spark, "linkage")
        self.records = self.scratch.save(norms(spark, sf_dir), "norms")
        self.documents = table(spark, sf_dir, "documents")

    def retrieve(self, channel: str, k: int | None = None, cap: int | None = CAP) -> DataFrame:
        base = channel.removesuffix("_rev")
        return cosine_topk(self.scratch, self.records, CHANNELS[base], k or CHANNEL_KS[channel], cap, MIN_TERMS, M_MULT, channel.endswith("_rev"), name=f"w-{channel}")

    def candidates(self, *channels: str) -> DataFrame:
        return self.scratch.save(cand.tagged({c: self.retrieve(c) for c in channels}), "candidates")

    def scored(self) -> DataFrame:
        """The joint cosine as probability: the decision path without a model."""
        return self.scratch.save(self.retrieve("joint").select("s1", "p", F.col("score").alias("prob")), "scored")

    def truth(self) -> DataFrame:
        return self.scratch.save(equal_text_truth(self.documents), "truth")

    def entities(self) -> DataFrame:
        return self.records.filter("source = 1").select(F.col("rid").alias("s1"))


# ---------------------------------------------------------------- queries


def er_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval, exclusivity, threshold and list: the whole path that needs no model."""
    x = Linkage(spark, sf_dir)
    return decide.match_lists(decide.by_threshold(decide.exclusive(x.scored()), 0.6), x.records)


def _retrieve(channel: str) -> Query:
    return lambda spark, sf_dir: Linkage(spark, sf_dir).retrieve(channel)


def _retrieve_whole(channel: str) -> Query:
    """Lists over all pairs that share a term, however frequent it is."""
    return lambda spark, sf_dir: Linkage(spark, sf_dir).retrieve(channel, cap=None)


def er_retrieve_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Linkage(spark, sf_dir).retrieve("joint", SMALL_K, SMALL_CAP)


def er_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).withColumn("source", F.col("source").cast("int"))


def er_truth_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equal_text_truth(table(spark, sf_dir, "documents"))


def er_name_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norms(spark, sf_dir).select("rid", "nn", "nc", "nk", "sk")


def er_address_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norms(spark, sf_dir).select("rid", "an", "num")


def er_party_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "customer").select(F.lit("c").alias("side"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).unionAll(table(spark, sf_dir, "supplier").select(F.lit("s"), "s_suppkey", "s_name"))
    return normalized(both.withColumn("address", F.col("name"))).select("side", "id", "nn", "nc", "nk", "sk", "an", "num")


def er_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("name"))
    docs = records(spark, sf_dir).select(F.lit("doc").alias("kind"), F.col("rid").alias("id"), "name")
    return normalized(pages.unionAll(docs).withColumn("address", F.lit(""))).select("kind", "id", "web", "native", (F.length("nk") >= 8).alias("long"))


def er_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(fold(F.col("text")), 256).alias("folded"))


def er_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skeletons of all distinct small-letter words of all texts."""
    found = table(spark, sf_dir, "documents").select(F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda t: t != "")).alias("word")).distinct()
    return found.select("word", skeleton(F.col("word")).alias("sk"))


def er_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and streets of whole texts read as addresses."""
    docs = table(spark, sf_dir, "documents").select("doc_id", folded_address(F.col("text")).alias("f"))
    return docs.select("doc_id", F.array_join(address_numbers(F.col("f")), " ").alias("num"), street(F.array_join(F.filter(F.split("f", "[^a-z0-9]+"), lambda t: t != ""), " ")).alias("street"))


def er_candidates_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cand.assemble(Linkage(spark, sf_dir).candidates(*CHANNEL_KS), CHANNEL_KS)


def er_labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    return cand.labelled(x.scored(), x.truth())


def er_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    return ev.recall_at(spark, x.candidates("joint", "addr", "name"), x.truth(), x.entities().count(), [1, 2, 5])


def er_blocking_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    return ev.blocking_report(x.entities(), x.scored(), x.truth())


def er_recall_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    return ev.recall_by(x.truth(), x.scored(), x.records).withColumn("src", F.col("src").cast("int"))


def er_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.world_rates(Linkage(spark, sf_dir).records)
    return out.select("rid", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


def er_part_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("country"), F.col("p_name").alias("nc"), (F.col("p_partkey") % 3 + 1).alias("source"))
    return stats.rarity_counts(parts, "nc")


def er_pool_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    c = x.scratch.save(stats.pool_competition(x.retrieve("joint")), "competition")
    rel = stats.relative_lists(c, x.records, CHANNEL_KS["joint"])
    return c.join(rel.select("p", F.round("nrel", 6).alias("nrel")), "p")


def er_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    c = x.scratch.save(x.retrieve("joint"), "joint")
    out = stats.with_margins(c.select("s1", "p", F.col("score").alias("score_joint")), stats.pool_competition(c), "joint")
    return out.select("s1", "p", F.round("joint_margin_p", 6).alias("margin"), F.round("joint_n_p", 6).alias("lists"))


def er_group_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ctx.ranks(ctx.gaps(Linkage(spark, sf_dir).scored(), ("prob",)), ("prob",)).withColumn("n_cands", F.count("*").over(ctx.by_s1()))
    return out.select("s1", "p", F.round("prob_gap", 6).alias("gap"), F.col("prob_rk").alias("rk"), "n_cands")


def er_sibling_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    src = x.records.select(F.col("rid").alias("p"), F.col("source").cast("int").alias("src_b"))
    out = ctx.sibling_context(x.scored().join(src, "p"))
    return out.select("s1", "p", *(F.round(c, 6).alias(c) for c in ("st_sum_other", "st_max_other", "st_src_sum_other")), "st_rank", "st_src_rank", "st_nhi_other", "st_src_nhi_other")


def er_token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    df = with_both_sides(x.scored(), x.records)
    s = token_set_stats(words(F.col("nc_a")), words(F.col("nc_b")))
    return df.select("s1", "p", F.round(s["jac"], 6).alias("jac"), s["first"].alias("first"), s["shared"].alias("shared"))


def er_house_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of each whole page against those of the page before it on its host."""
    from pyspark.sql.window import Window

    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), address_numbers(F.lower("html")).alias("n"))
    order = Window.partitionBy("host").orderBy("page_id")
    pairs = pages.withColumn("before", F.lag("n").over(order)).filter("before IS NOT NULL")
    s = house_number_stats(F.col("n"), F.col("before"))
    return pairs.select("page_id", *((F.round(v, 6) if k in ("hn_logdiff", "hn_reldiff", "num_min_logdiff", "num_a_in_b", "num_b_in_a") else v).alias(k) for k, v in s.items()))


def er_jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    df = with_both_sides(x.scored(), x.records).filter("nk_a <> '' OR nk_b <> ''")
    return df.withColumn("s", similarities({"jw": ("jw", F.col("nk_a"), F.col("nk_b"))})).select("s1", "p", F.round("s.jw", 6).alias("jw"))


def er_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.exclusive(Linkage(spark, sf_dir).scored())


def er_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.pruned(Linkage(spark, sf_dir).scored(), 0.05, 3, "prob")


def er_expected_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.by_expected_f(Linkage(spark, sf_dir).scored()).select("s1", "p")


def er_country_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    pairs = decide.by_country_cutoff(decide.exclusive(x.scored()), x.records, {"en": 0.5, "fr": 0.7}, 0.4)
    return decide.match_lists(pairs, x.records)


def er_candidate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    return decide.match_lists(x.scored(), x.records, "candidate_entity_ids")


def _judged(spark: SparkSession, sf_dir: str) -> tuple[Linkage, DataFrame, DataFrame, DataFrame]:
    x = Linkage(spark, sf_dir)
    scored = x.scored()
    best = x.scratch.save(decide.exclusive(scored), "best")
    return x, scored, best, x.truth()


def er_entity_f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, _, best, truth = _judged(spark, sf_dir)
    return ev.per_entity_f05(x.entities(), decide.by_threshold(best, 0.6), truth).withColumn("f05", F.round("f05", 6))


def er_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, _, best, truth = _judged(spark, sf_dir)
    return ev.summary(ev.per_entity_f05(x.entities(), decide.by_threshold(best, 0.6), truth))


def er_summary_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, _, best, truth = _judged(spark, sf_dir)
    pe = ev.per_entity_f05(x.entities(), decide.by_threshold(best, 0.6), truth).join(x.records.select(F.col("rid").alias("s1"), "country"), "s1")
    return ev.summary(pe.withColumn("bucket", ev.true_match_bucket()), "country", "bucket")


def er_decision_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, _, best, truth = _judged(spark, sf_dir)
    return ev.decision_grid(spark, x.entities(), best, truth, [0.2, 0.4, 0.6, 0.8])


def er_error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scored, best, truth = _judged(spark, sf_dir)
    pred = decide.by_threshold(best, 0.6)
    both = ev.false_positives(pred, truth).withColumn("error", F.lit("fp")).unionAll(ev.false_negatives(truth, pred, scored, best).withColumn("error", F.lit("fn")))
    return both.groupBy("error", "type").agg(F.count("*").alias("n"))


def er_pseudo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.pseudo_labels(Linkage(spark, sf_dir).scored()).select("s1", "p", "pseudo")


def er_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return ev.shift_stats(items.filter("l_returnflag = 'R'"), items.filter("l_returnflag = 'A'"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"])


def er_change_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    both = x.retrieve("joint").join(x.retrieve("name").select("s1", "p", F.col("score").alias("other")), ["s1", "p"])
    return ev.change_histogram(both.withColumn("change", F.round(F.col("score") - F.col("other"), 6)), "change")


def er_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate lists with their faults put in by rule: every list checked against all records."""
    x = Linkage(spark, sf_dir)
    lists = decide.match_lists(x.scored(), x.records, "ids").select("source1_entity_id", F.filter(F.split("ids", ","), lambda i: i != "").alias("ids"))
    odd = F.col("source1_entity_id").endswith("7")
    lists = lists.withColumn("ids", F.when(odd, F.concat("ids", F.slice("ids", 1, 1), F.array("source1_entity_id", F.lit("X9-1")))).otherwise(F.col("ids")))
    ids = x.records.select("entity_id", "source")
    return validate.list_issues(lists, ids.filter("source = 1").select("entity_id"), ids.select("entity_id")).select("rule", "n", F.array_join("examples", ",").alias("examples"))


def er_pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    return pair_features(x.retrieve("joint"), x.records)


def er_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinloom.plans.cascade import KS, run_cascade

    x = Linkage(spark, sf_dir)
    return run_cascade(x.scratch, x.records, x.truth(), KS)


def queries() -> dict[str, Query]:
    found = {k: f for k, f in globals().items() if k.startswith("er_")}
    return found | {f"er_retrieve_{c}": _retrieve(c) for c in ("joint", "addr", "name", "cgram", "name_noaddr", "native", "joint_rev")} | {"er_retrieve_cgram_noaddr": _retrieve_whole("cgram_noaddr")}
