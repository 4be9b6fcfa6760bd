from pyspark.sql import functions as F

from fixtures import DEMO_PROTOTYPES
from setsift.functions.text import char_wb_ngrams, explanation_terms, han_ngrams, latin_words, normalize_text, word_count
from setsift.operators.explain import rich_explanations, top_two, with_confidence

TOP = {
    1: ("dissatisfaction", 0.352, "coproduction_request", 0.3444, 0.0076, "low"),
    2: ("policy_demand", 0.4057, "dissatisfaction", 0.2845, 0.1212, "medium"),
    3: ("coproduction_request", 0.4697, "policy_demand", 0.2965, 0.1733, "medium"),
    4: ("policy_demand", 0.4681, "coproduction_request", 0.3564, 0.1117, "medium"),
    5: ("dissatisfaction", 0.3371, "policy_demand", 0.0766, 0.2605, "low"),
    6: ("policy_demand", 0.6788, "coproduction_request", 0.3009, 0.378, "high"),
    7: ("coproduction_request", 0.748, "policy_demand", 0.3665, 0.3815, "high"),
    8: ("dissatisfaction", 0.2313, "coproduction_request", 0.1616, 0.0697, "very low"),
    9: ("dissatisfaction", 0.4108, "policy_demand", 0.1292, 0.2815, "medium"),
    10: ("policy_demand", 0.4054, "coproduction_request", 0.2279, 0.1775, "medium"),
}


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def test_term_fixtures(spark):
    assert _one(spark, lambda c: han_ngrams(normalize_text(c)), "收费标准") == ["收费", "费标", "标准", "收费标", "费标准", "收费标准"]
    assert _one(spark, lambda c: latin_words(normalize_text(c)), "foo-bar xy abc_d") == ["foo-bar", "abc_d"]
    assert _one(spark, char_wb_ngrams, "Ab c") == [" ", "a", "b", " ", " a", "ab", "b ", " ", "c", " ", " c", "c "]
    assert _one(spark, normalize_text, "a　 B") == "a b"
    assert _one(spark, lambda c: han_ngrams(normalize_text(c)), "x收y") == []
    assert _one(spark, word_count, "a　b  c") == 3


def test_stopwords_removed(spark):
    got = _one(spark, explanation_terms, "The policy and 公民收费")
    assert "the" not in got and "and" not in got and "公民" not in got
    assert "policy" in got and "收费" in got


def test_top_two_golden(demo_scores):
    rows = with_confidence(demo_scores).collect()
    for r in rows:
        assert (r.top_condition, r.top_score, r.second_condition, r.second_score, r.score_gap, r.confidence) == TOP[r.case_id]
    assert top_two(demo_scores).columns == [
        "case_id", "text", "top_condition", "top_score", "second_condition", "second_score", "score_gap", "outcome"]


def test_rich_explanations(spark, demo_scores):
    protos = spark.createDataFrame(DEMO_PROTOTYPES, "condition_name string, prototype string, type string")
    rows = {r.case_id: r for r in rich_explanations(demo_scores, protos).collect()}
    r5 = rows[5]
    assert r5.top_condition == "dissatisfaction"
    assert "收费" in r5.matched_terms.split(", ")
    assert r5.interpretation_note.startswith(
        "'dissatisfaction' fits best (score 0.3371, confidence low). It leads 'policy_demand' by 0.2605. Terms in common")
    assert r5.top_prototype.startswith("The citizen complains")
    # longest first, then alphabetical
    terms = r5.matched_terms.split(", ")
    assert terms == sorted(terms, key=lambda x: (-len(x), x))


def test_single_condition_and_missing(spark):
    df = spark.createDataFrame([(1, "x", 0.6, 1), (2, "y", None, 0)], "case_id long, text string, a_score double, outcome int")
    rows = {r.case_id: r for r in with_confidence(df).collect()}
    assert rows[1].second_condition is None and rows[1].confidence == "high"
    assert rows[2].top_condition is None and rows[2].confidence == "unknown"
