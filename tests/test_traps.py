"""One small literal frame per semantic trap of the survey (T-rows)."""

import math

import pytest
from pyspark.sql import functions as F

from setsift.functions.vectors import cosine
from setsift.operators.calibrate import calibrate, qca_ready
from setsift.operators.columns import parse_threshold_grid
from setsift.operators.explain import prototype_lookup
from setsift.operators import chart_data as G
from setsift.operators import explain as X
from setsift.operators import thresholds as TH
from setsift.operators.checks import crisp_domain_report, require_crisp
from setsift.operators.tfidf import distinct_texts, tfidf_prototype_scores
from setsift.operators.thresholds import exact_mean4
from setsift.operators.truth_table import configuration_members, truth_table


def test_t1_nan_score_stays_missing(spark):
    df = spark.createDataFrame([(1, float("nan"), 1), (2, 0.5, 0)], "case_id long, a_score double, outcome int")
    rows = {r.case_id: r for r in calibrate(df, "crisp", threshold=0.3).collect()}
    assert rows[1].a is None and rows[2].a == 1
    rows = {r.case_id: r for r in calibrate(df, "fuzzy").collect()}
    assert rows[1].a is None and rows[2].a == 1.0


def test_t3_missing_outcome_counts_in_n_not_positives(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 1, 1)], "case_id long, a int, outcome int")
    r = truth_table(df, ["a"]).first()
    assert (r.n_cases, r.outcome_positive_cases, r.consistency) == (2, 1, 0.5)


def test_t5_half_even_rounding(spark):
    df = spark.createDataFrame([(i, 1 if i < 1 else 0, 1 if i < 1 else 0) for i in range(160)], "case_id long, a int, outcome int")
    # 1 positive of 1 case and 0 of 159: consistency 1.0 and 0.0; coverage 1.0
    assert {r.a: r.consistency for r in truth_table(df, ["a"]).collect()} == {1: 1.0, 0: 0.0}
    v = spark.range(1).select(F.bround(F.lit(1.0) / F.lit(160.0), 4).alias("x")).first().x
    assert v == 0.0062


def test_t12_name_collision_raises(spark):
    df = spark.createDataFrame([(1, 0.5, 1)], "case_id long, outcome_score double, outcome int")
    with pytest.raises(ValueError, match="collides"):
        calibrate(df, "crisp")


def test_t13_duplicate_prototype_keeps_last(spark):
    p = spark.createDataFrame([("a", "first text", "condition"), ("a", "second text", "condition")],
                              "condition_name string, prototype string, type string").coalesce(1)
    rows = prototype_lookup(p).collect()
    assert len(rows) == 1 and rows[0]._ptext == "second text"


def _scores(spark, rows, protos, names):
    texts = spark.createDataFrame(rows, "case_id long, text string")
    p = spark.createDataFrame(protos, "condition_name string, prototype string, type string").coalesce(1)
    return tfidf_prototype_scores(texts, p, names).collect()


def test_t13_lexical_scores_use_the_last_prototype(spark):
    rows = [(1, "water and bread"), (2, "stone and wood"), (3, "bread")]
    last = [("a", "stone wood", "condition"), ("a", "bread water", "condition"), ("b", "wood", "condition")]
    twice, once = _scores(spark, rows, last, ["a", "b"]), _scores(spark, rows, last[1:], ["a", "b"])
    assert sorted(twice) == sorted(once)


def test_scores_do_not_depend_on_ids(spark):
    texts = ["water and bread", "stone and wood", "bread", "water and bread", None, "面包和水"]
    protos = [("a", "bread and water", "condition"), ("b", "面包", "condition")]
    plain = {r.text: (r.a_score, r.b_score) for r in _scores(spark, list(enumerate(texts)), protos, ["a", "b"])}
    for ids in ([1] * 6, [None] * 6, [1, 1, None, 2, None, 2]):
        got = _scores(spark, list(zip(ids, texts)), protos, ["a", "b"])
        assert len(got) == 6 and all(plain[r.text] == pytest.approx((r.a_score, r.b_score)) for r in got)
    assert plain[None] == (0.0, 0.0) and plain["面包和水"][1] > 0.5


def test_no_term_is_left_out_of_lexical_scores(spark):
    """More distinct terms than the cap of the supervised mode, and a word that every text has."""
    rows = [(i, f"every {chr(0x4E00 + 2 * i)}{chr(0x4E01 + 2 * i)}") for i in range(4000)]
    got = {r.case_id: r for r in _scores(spark, rows, [("last", rows[3999][1], "condition"), ("all", "every", "condition")], ["last", "all"])}
    assert got[3999].last_score == pytest.approx(1.0) and got[0].last_score < 0.9 and got[0].all_score > 0.1


def test_text_partitions_follow_the_input(spark):
    texts = spark.range(5000).select(F.col("id").alias("case_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).repartition(50)
    docs, n = distinct_texts(texts, "text")
    assert n == 5000 and docs.select(F.spark_partition_id().alias("p")).distinct().count() >= 45


def test_names_with_dots_and_blanks(spark):
    df = spark.createDataFrame([(i, (i % 10) / 10, 0.4, i % 2) for i in range(20)], "case_id long, `v1.2_score` double, `a b_score` double, outcome int")
    names = ["v1.2", "a b"]
    fuzzy, crisp = calibrate(df, "fuzzy"), calibrate(df, "crisp", threshold=0.3)
    assert [c for c in fuzzy.columns if c in names] == names
    ready = qca_ready(crisp)
    tt = truth_table(ready, with_cases=True)
    assert sum(r.n_cases for r in tt.collect()) == 20 and "v1.2 * a b" in {r.configuration for r in tt.collect()}
    assert configuration_members(ready, names, tt=tt).count() == 20
    assert TH.threshold_sensitivity(df, [0.3, 0.5])["stability"].count() > 0
    assert TH.suggest_thresholds(df).count() == 3 and G.score_box(df).count() == 2 and G.score_long(df).count() == 40
    assert G.membership_matrix(crisp, names).count() == 20 and G.membership_bins(fuzzy, names).count() > 0
    assert X.with_confidence(df).count() == 20 and X.top_two(df).first().top_condition in names
    assert crisp_domain_report(crisp, names).count() == 2
    with pytest.raises(ValueError, match="0.4"):
        require_crisp(df, ["a b_score"])
    p = spark.createDataFrame([("v1.2", "bread", "condition")], "condition_name string, prototype string, type string")
    t = spark.createDataFrame([(1, "bread"), (2, "stone")], "case_id long, text string")
    assert tfidf_prototype_scores(t, p, ["v1.2"]).columns == ["case_id", "text", "v1.2_score"]


def test_listed_cases_are_bounded(spark):
    df = spark.createDataFrame([(i, 1, 0) for i in range(10, 0, -1)] + [(11, 0, 0)], "case_id long, a int, outcome int")
    rows = {r.a: r.cases for r in truth_table(df, ["a"], with_cases=True, max_cases=3).collect()}
    assert rows == {1: "1, 2, 3, ...", 0: "11"}


def test_t15_zero_vector_cosine_is_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert df.select(cosine("a", "b").alias("c")).first().c == 0.0


def test_t22_anchor_order_raises_eagerly(spark, demo_scores):
    with pytest.raises(ValueError, match="anchors"):
        calibrate(demo_scores, "fuzzy", full_out=0.5, crossover=0.3, full_in=0.6)


def test_t27_exact_mean(spark):
    df = spark.createDataFrame([(x,) for x in [1.0, 0.5, 0.6667, 0.75, 1.0, 1.0]], "x double")
    assert df.agg(exact_mean4(F.col("x")).alias("m")).first().m == 0.8194


def test_p9_threshold_grid():
    assert parse_threshold_grid("0.3, 0.25,0.3,") == [0.25, 0.3]
    for bad in ["", "1.5", "a"]:
        with pytest.raises(ValueError):
            parse_threshold_grid(bad)


def test_qca_ready_requires_outcome(demo_scores):
    with pytest.raises(ValueError, match="outcome"):
        qca_ready(calibrate(demo_scores.drop("outcome"), "crisp"))
