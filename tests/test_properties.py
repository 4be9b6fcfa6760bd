"""Properties over random small inputs (few examples each: every example runs Spark jobs)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from setsift.operators.calibrate import calibrate, qca_ready
from setsift.operators.thresholds import sensitivity_detail
from setsift.operators.truth_table import truth_table

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
score = st.floats(min_value=-1.0, max_value=1.0, allow_nan=False)
rows_st = st.lists(st.tuples(score, score, st.integers(0, 1)), min_size=1, max_size=40)


def _df(spark, rows):
    return spark.createDataFrame(
        [(i, a, b, o) for i, (a, b, o) in enumerate(rows)], "case_id long, a_score double, b_score double, outcome int"
    )


@SETTINGS
@given(rows=rows_st)
def test_fuzzy_monotone_and_crossover(spark, rows):
    got = sorted((r.a_score, r.a) for r in calibrate(_df(spark, rows), "fuzzy", 0.1, 0.3, 0.6).collect())
    for (s1, m1), (s2, m2) in zip(got, got[1:]):
        assert m1 <= m2 + 1e-15
    for s, m in got:
        assert 0.0 <= m <= 1.0
        assert (m >= 0.5) == (s >= 0.3)


@SETTINGS
@given(rows=rows_st)
def test_truth_table_sums(spark, rows):
    tt = truth_table(qca_ready(calibrate(_df(spark, rows), "crisp", threshold=0.2)), ["a", "b"]).collect()
    assert sum(r.n_cases for r in tt) == len(rows)
    pos = sum(o for _, _, o in rows)
    assert sum(r.outcome_positive_cases for r in tt) == pos
    if pos:
        assert abs(sum(r.outcome_positive_cases / pos for r in tt) - 1.0) < 1e-12


@SETTINGS
@given(rows=rows_st)
def test_crisp_count_falls_with_threshold(spark, rows):
    d = sensitivity_detail(_df(spark, rows), [0.0, 0.2, 0.4, 0.6])
    ones = d.groupBy("threshold").agg(F.sum(F.col("a") * F.col("n_cases")).alias("k")).orderBy("threshold").collect()
    ks = [r.k for r in ones]
    assert ks == sorted(ks, reverse=True)
