import pytest
from pyspark.sql import functions as F

from fixtures import CONDITIONS, GOLDEN_FUZZY, GOLDEN_SOLUTION_SENTENCES, GOLDEN_TRUTH_TABLE
from setsift.operators.calibrate import calibrate, qca_ready
from setsift.operators.truth_table import configuration_members, solutions, truth_table


def _golden_tt(demo_scores, **kw):
    crisp = calibrate(demo_scores, method="crisp", threshold=0.30)
    ready = qca_ready(crisp)
    return truth_table(ready, CONDITIONS, with_cases=True, **kw)


def test_golden_truth_table_in_order(demo_scores):
    rows = [tuple(r) for r in _golden_tt(demo_scores).collect()]
    assert rows == GOLDEN_TRUTH_TABLE


def test_golden_solutions(demo_scores):
    sol = solutions(_golden_tt(demo_scores)).collect()
    assert [r.solution_id for r in sol] == [1, 2, 3]
    assert [r.raw_coverage for r in sol] == [0.3333, 0.3333, 0.1667]
    assert [r.interpretation for r in sol] == GOLDEN_SOLUTION_SENTENCES
    assert [r.cases for r in sol] == ["4, 6", "1, 7", "3"]


def test_golden_fuzzy(demo_scores):
    fz = calibrate(demo_scores, method="fuzzy", full_out=0.15, crossover=0.35, full_in=0.45)
    got = {r.case_id: (r.dissatisfaction, r.policy_demand, r.coproduction_request) for r in fz.collect()}
    for cid, exp in GOLDEN_FUZZY.items():
        for a, b in zip(got[cid], exp):
            assert abs(a - b) < 1e-7


def test_qca_ready_projection(demo_scores):
    ready = qca_ready(calibrate(demo_scores, method="crisp", threshold=0.30))
    assert ready.columns == ["case_id"] + CONDITIONS + ["outcome"]
    assert dict(ready.dtypes)["dissatisfaction"] == "int"


def test_non_crisp_raises(demo_scores):
    fz = qca_ready(calibrate(demo_scores, method="fuzzy"))
    with pytest.raises(Exception, match="must be 0 or 1"):
        truth_table(fz, CONDITIONS).collect()


def test_missing_condition(spark):
    df = spark.createDataFrame([(1, 1, 1), (2, None, 0), (3, 0, 1)], "case_id long, a int, outcome int")
    with pytest.raises(Exception, match="missing"):
        truth_table(df, ["a"]).collect()
    rows = truth_table(df, ["a"], validate=False).collect()
    assert sum(r.n_cases for r in rows) == 2
    # the grand total still counts every row
    assert sorted(r.raw_coverage for r in rows) == [0.5, 0.5]


def test_no_positives_gives_null_coverage(spark):
    df = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "case_id long, a int, outcome int")
    assert all(r.raw_coverage is None for r in truth_table(df, ["a"]).collect())


def test_properties(demo_scores):
    tt = _golden_tt(demo_scores)
    assert tt.agg(F.sum("n_cases")).first()[0] == 10
    a = truth_table(qca_ready(calibrate(demo_scores.repartition(1), method="crisp", threshold=0.3)), CONDITIONS)
    b = truth_table(qca_ready(calibrate(demo_scores.repartition(7), method="crisp", threshold=0.3)), CONDITIONS)
    assert a.collect() == b.collect()


def test_members(demo_scores):
    ready = qca_ready(calibrate(demo_scores, method="crisp", threshold=0.30))
    tt = truth_table(ready, CONDITIONS)
    m = configuration_members(ready, CONDITIONS, tt=tt).filter("case_id = 7").first()
    assert m.configuration == "dissatisfaction * policy_demand * coproduction_request"
    assert m.status == "sufficient"
