import math
import random

import pytest
from pyspark.sql import functions as F

from kinloom.operators import candidates as cand, context as ctx, decide, evaluate as ev, stats, validate
from kinloom.operators.retrieve import cosine_topk
from kinloom.operators.terms import CHANNELS
from kinloom.sources import records as src
from kinloom.sources.scratch import Scratch


def scored(spark, rows):
    return spark.createDataFrame(rows, "s1 long, p long, prob double")


def pairs_of(df):
    return sorted((r.s1, r.p) for r in df.collect())


def test_exclusive_ties_go_to_the_lower(spark):
    assert pairs_of(decide.exclusive(scored(spark, [(1, 9, 0.8), (2, 9, 0.8), (3, 9, 0.7), (1, 8, 0.4)]))) == [(1, 8), (1, 9)]


def test_expected_f(spark):
    df = scored(spark, [(1, 1, 1.0), (1, 2, 0.9), (1, 3, 0.1), (2, 4, 0.2), (3, 5, 1.0), (3, 6, 1.0)])
    assert pairs_of(decide.by_expected_f(df)) == [(1, 1), (1, 2), (3, 5), (3, 6)]


@pytest.mark.parametrize(("pred", "true", "hits", "f"), [(3, 2, 2, 2.5 / 3.5), (0, 0, 0, 1.0), (1, 0, 0, 0.0), (0, 2, 0, 0.0), (2, 2, 2, 1.0)])
def test_metric(spark, pred, true, hits, f):
    e = spark.createDataFrame([(1,)], "s1 long")
    p = spark.createDataFrame([(1, i) for i in range(pred)], "s1 long, p long")
    t = spark.createDataFrame([(1, i if i < hits else 100 + i) for i in range(true)], "s1 long, p long")
    row = ev.per_entity_f05(e, p, t).first()
    assert (row.n_pred, row.n_true, row.tp) == (pred, true, hits) and math.isclose(row.f05, f)


def test_retrieval_is_brute_force_cosine(spark):
    random.seed(3)
    rows = [(i, f"r{i}", " ".join(random.choices("abcdefgh", k=random.randint(0, 6))), random.choice(["x", "y"]), 1 + i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "rid long, entity_id string, nc string, country string, source int").withColumns({"sk": F.lit(""), "nk": F.col("nc"), "an": F.lit(""), "web": F.lit(False), "native": F.lit(False)})
    for cap, mult in ((10**9, 1000), (3, 1000)):
        found = {(r.s1, r.p): (r.score, r.rank) for r in cosine_topk(Scratch(spark, "t"), df, CHANNELS["name"], 4, cap, 2, mult, name=f"w{cap}").collect()}
        expected = {}
        for c in "xy":
            own = [(r[0], {"n" + t for t in r[2].split()}, r[4]) for r in rows if r[3] == c]
            idf = {t: math.log1p(len(own) / sum(t in s for _, s, _ in own)) for _, s, _ in own for t in s}
            norm = {i: math.sqrt(sum(idf[t] ** 2 for t in s)) for i, s, _ in own}
            df_pool = {t: sum(t in s for _, s, k in own if k > 1) for t in idf}
            for i, s, k in own:
                if k > 1:
                    continue
                order = sorted((df_pool[t], t) for t in s if df_pool[t])
                used = {t for n, (d, t) in enumerate(order) if d <= cap or n < 2}
                near = sorted(((-round(sum(idf[t] ** 2 for t in s & o) / norm[i] / norm[j], 6), j) for j, o, m in own if m > 1 and used & o))[:4]
                expected |= {(i, j): (-d, n) for n, (d, j) in enumerate(near)}
        assert found == expected


def test_assemble_fills_and_reverse_completes(spark):
    lists = {"joint": spark.createDataFrame([(1, 2, 0.5, 0)], "s1 long, p long, score double, rank int"), "joint_rev": spark.createDataFrame([(1, 3, 0.4, 1), (1, 4, 0.1, 2)], "s1 long, p long, score double, rank int")}
    rows = {(r.s1, r.p): r for r in cand.assemble(cand.tagged(lists), {"joint": 5, "joint_rev": 2}).collect()}
    assert set(rows) == {(1, 2), (1, 3)}
    assert rows[1, 3].score_joint == 0.4 and rows[1, 3].rank_joint == 5 and rows[1, 2].score_joint_rev == 0 and rows[1, 2].rank_joint_rev == 2


def test_margin_is_against_others(spark):
    c = spark.createDataFrame([(1, 9, 0.8), (2, 9, 0.6), (3, 8, 0.5)], "s1 long, p long, score double")
    pairs = spark.createDataFrame([(1, 9, 0.8), (2, 9, 0.6), (4, 9, 0.9), (3, 8, 0.5)], "s1 long, p long, score_joint double")
    rows = {(r.s1, r.p): round(r.joint_margin_p, 6) for r in stats.with_margins(pairs, stats.pool_competition(c), "joint").collect()}
    assert rows == {(1, 9): 0.2, (2, 9): -0.2, (4, 9): 0.1, (3, 8): 0.5}


def test_nulls_rank_last_and_stay_null(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, None), (1, 3, 0.5), (1, 4, 0.1)], "s1 long, p long, x double")
    rows = {r.p: (r.x_rk, r.x_gap) for r in ctx.ranks(ctx.gaps(df, ("x",)), ("x",)).collect()}
    assert rows == {1: (1, 0.0), 3: (1, 0.0), 4: (3, -0.4), 2: (None, None)}


def test_pseudo_labels(spark):
    rows = [(1, 1, 0.999), (2, 1, 0.6), (1, 2, 0.999), (2, 2, 0.1), (3, 3, 0.01), (4, 4, 0.5), (5, 5, 0.95), (6, 5, 0.5)]
    found = {(r.s1, r.p): r.pseudo for r in ev.pseudo_labels(scored(spark, rows)).collect()}
    assert found == {(1, 1): -1, (2, 1): 0, (1, 2): 1, (2, 2): 0, (3, 3): 0, (4, 4): -1, (5, 5): -1, (6, 5): 0}


def test_tsv_truth_and_lists(spark, tmp_path):
    for n, rows in enumerate((["S1-1\tA \"half\tx, y\tUS", "S1-2\tB\t\tUS"], ["S2-1\tC\tz\tUS"], ["S3-1\tD\tw\tIndia"]), 1):
        (tmp_path / f"s{n}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "\n".join(rows) + "\n", encoding="utf-8")
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS3-1, S2-1,\nS1-2\t\n")
    recs = src.union_sources(Scratch(spark, "t"), [src.read_tsv(spark, f"{tmp_path}/s{n}.tsv", src.RAW) for n in (1, 2, 3)])
    got = {r.entity_id: (r.name, r.address) for r in recs.collect()}
    assert got["S1-1"] == ('A "half', "x, y") and got["S1-2"] == ("B", "")
    truth = src.truth_pairs(src.read_tsv(spark, f"{tmp_path}/t.tsv", src.TRUTH), recs)
    lists = {r[0]: r[1] for r in decide.match_lists(truth, recs).collect()}
    assert lists == {"S1-1": "S2-1,S3-1", "S1-2": ""}
    src.write_lists(decide.match_lists(truth, recs), f"{tmp_path}/out")
    text = "".join(sorted(p.read_text() for p in (tmp_path / "out").glob("part-*")))
    assert "S1-2\t\n" in text and '"' not in text
    with pytest.raises(ValueError, match="S9-9"):
        src.truth_pairs(spark.createDataFrame([("S1-1", "S9-9")], src.TRUTH), recs)
    with pytest.raises(ValueError, match="more than once"):
        src.union_sources(Scratch(spark, "u"), [src.read_tsv(spark, f"{tmp_path}/s1.tsv", src.RAW)] * 2)


def test_validation(spark, tmp_path):
    ids = spark.createDataFrame([("S1-1",), ("S1-2",), ("S2-1",)], "entity_id string")
    lists = spark.createDataFrame([("S1-1", ["S2-1", "S2-1"]), ("S1-1", ["S1-2"]), ("S1-3", ["X9-1"])], "source1_entity_id string, ids array<string>")
    rows = {r.rule: (r.n, r.examples) for r in validate.list_issues(lists, ids.filter("entity_id LIKE 'S1%'"), ids).collect()}
    assert {k: v[0] for k, v in rows.items()} == {"duplicate_row": 1, "duplicate_in_list": 1, "source1_in_list": 1, "wrong_prefix": 1, "missing_row": 1, "unexpected_row": 1, "unknown_id": 1}
    assert rows["missing_row"][1] == ["S1-2"]
    (tmp_path / "m.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\n\nbroken\nS1-2\t\n")
    good, bad = validate.read_lists(spark, f"{tmp_path}/m.tsv", "source1_entity_id\tmatched_entity_ids")
    assert good.count() == 2 and bad.count() == 1
    assert validate.check_header(spark, f"{tmp_path}/m.tsv", ["source1_entity_id", "matched_entity_ids"]) == []
    (tmp_path / "c.tsv").write_text("source1_entity_id,matched_entity_ids\n")
    assert validate.check_header(spark, f"{tmp_path}/c.tsv", ["source1_entity_id", "matched_entity_ids"]) == ["comma_separated"]
    (tmp_path / "u.tsv").write_bytes(b"source1_entity_id\tmatched_entity_ids\nS1-1\tS2-\xff\n")
    assert validate.check_header(spark, f"{tmp_path}/u.tsv", ["source1_entity_id", "matched_entity_ids"]) == ["not_utf8"]
    assert validate.check_header(spark, f"{tmp_path}/none.tsv", ["source1_entity_id", "matched_entity_ids"]) == ["missing_file"]
    odd = validate.match_issues(good, spark.createDataFrame([("S1-1", ["S3-1"])], "source1_entity_id string, ids array<string>")).first()
    assert odd.n == 1 and validate.passed(spark.createDataFrame([odd]))


def test_worlds_are_disjoint_and_stable(spark):
    recs = spark.range(20000).select(F.concat(F.lit("S1-"), "id").alias("entity_id"), F.lit(1).alias("source"))
    shares = {r.world: r["count"] / 20000 for r in cand.worlds(recs).groupBy("world").count().collect()}
    assert abs(shares["A"] - 0.1) < 0.02 and abs(shares["B"] - 0.3) < 0.02 and abs(shares["R"] - 0.188) < 0.02
    again = cand.worlds(recs.repartition(7))
    assert cand.worlds(recs).exceptAll(again).isEmpty()


def test_similarity_functions_on_pairs(spark):
    from kinloom.functions.similarity import pair_features
    from kinloom.functions.text import normalized

    recs = spark.createDataFrame([(1, "Acme Foods Ltd", "97 Liberty Street", 1), (2, "Acme Food Limited", "97 Liberty St", 2), (3, "Zed", "", 3)], "rid long, name string, address string, source int").withColumn("country", F.lit("US"))
    rows = {r.p: r for r in pair_features(spark.createDataFrame([(1, 2), (1, 3)], "s1 long, p long"), normalized(recs)).collect()}
    assert rows[2].an_ratio == 1 and rows[2].street_eq and rows[2].hn_eq and rows[2].nc_ratio > 0.9
    assert rows[3].an_ratio is None and rows[3].addr_empty_b and rows[3].num_jac is None and rows[3].nc_tset is not None
