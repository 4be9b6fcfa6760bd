import pytest

from fixtures import CONDITIONS
from setsift.operators.calibrate import calibrate
from setsift.operators.chart_data import coverage_points, membership_bins, membership_matrix, score_long
from setsift.operators.thresholds import score_summary


def test_membership_matrix_and_bins(demo_scores):
    fz = calibrate(demo_scores, "fuzzy", 0.15, 0.35, 0.45)
    m = membership_matrix(fz, CONDITIONS)
    assert m.columns == ["case_id"] + CONDITIONS and dict(m.dtypes)["case_id"] == "string"
    with pytest.raises(ValueError):
        membership_matrix(fz, [])
    bins = membership_bins(fz, CONDITIONS).collect()
    assert sum(r.n_cases for r in bins) == 30
    assert all(0 <= r.bin <= 9 for r in bins)


def test_score_long_names(demo_scores):
    rows = score_long(demo_scores).collect()
    assert len(rows) == 30 and {r.condition for r in rows} == set(CONDITIONS)


def test_coverage_points_requires_columns(demo_scores):
    with pytest.raises(ValueError):
        coverage_points(demo_scores)


def test_approx_quantiles_close(demo_scores):
    exact = {r.statistic: r.value for r in score_summary(demo_scores).collect()}
    approx = {r.statistic: r.value for r in score_summary(demo_scores, approx=True).collect()}
    assert approx["minimum"] == exact["minimum"] and approx["maximum"] == exact["maximum"]
    assert abs(approx["median"] - exact["median"]) < 0.05
