from setsift.operators.thresholds import (
    configuration_stability,
    score_summary,
    sensitivity_detail,
    sensitivity_summary,
    suggest_thresholds,
    threshold_sensitivity,
)
from setsift.operators.calibrate import calibrate, qca_ready
from setsift.operators.truth_table import truth_table
from setsift.operators.quantiles import exact_quantiles
from fixtures import CONDITIONS

SUMMARY = [
    (0.25, 5, 2, 0, 3, 0.55, 1.0, 0.2, 0.5, 10),
    (0.30, 6, 3, 1, 2, 0.5833, 1.0, 0.1667, 0.3333, 10),
    (0.35, 5, 2, 1, 2, 0.6333, 1.0, 0.2, 0.3333, 10),
    (0.40, 4, 1, 0, 3, 0.5208, 1.0, 0.25, 0.5, 10),
    (0.45, 3, 2, 0, 1, 0.7778, 1.0, 0.3333, 0.3333, 10),
    (0.50, 3, 2, 1, 0, 0.8333, 1.0, 0.3334, 0.6667, 10),
]

STABILITY = [
    ("~dissatisfaction * ~policy_demand * coproduction_request", 5, "0.3, 0.35, 0.4, 0.45, 0.5", "", "", 1.0, 0.2333, 1.4),
    ("~dissatisfaction * policy_demand * coproduction_request", 3, "0.25, 0.3, 0.35", "", "", 1.0, 0.3333, 2.0),
    ("~dissatisfaction * policy_demand * ~coproduction_request", 6, "0.25, 0.45, 0.5", "0.3", "0.35, 0.4", 0.8194, 0.2778, 2.1667),
    ("dissatisfaction * policy_demand * coproduction_request", 2, "0.3", "", "0.25", 0.875, 0.4166, 3.0),
    ("~dissatisfaction * ~policy_demand * ~coproduction_request", 6, "", "0.5", "0.25, 0.3, 0.35, 0.4, 0.45", 0.1944, 0.1944, 3.5),
    ("dissatisfaction * ~policy_demand * ~coproduction_request", 4, "", "0.35", "0.25, 0.3, 0.4", 0.125, 0.0417, 1.75),
]


def test_summary_golden(demo_scores):
    got = [tuple(r) for r in threshold_sensitivity(demo_scores)["summary"].collect()]
    assert got == SUMMARY


def test_stability_golden(demo_scores):
    got = [
        (r.configuration, r.n_thresholds_observed, r.sufficient_thresholds, r.contradictory_thresholds,
         r.weak_thresholds, r.mean_consistency, r.mean_raw_coverage, r.mean_n_cases)
        for r in threshold_sensitivity(demo_scores)["stability"].collect()
    ]
    assert got == STABILITY


def test_grid_equals_single_tables(demo_scores):
    """The grid in one pass gives what a truth table at each threshold gives."""
    got = sensitivity_detail(demo_scores).collect()
    for t in {r.threshold for r in got}:
        tt = truth_table(qca_ready(calibrate(demo_scores, method="crisp", threshold=t)), CONDITIONS).collect()
        assert [tuple(r)[1:] for r in got if r.threshold == t] == [tuple(r) for r in tt]


def test_single_threshold_equals_truth_table(demo_scores):
    d = sensitivity_detail(demo_scores, [0.3]).drop("threshold").collect()
    tt = truth_table(qca_ready(calibrate(demo_scores, method="crisp", threshold=0.3)), CONDITIONS).collect()
    assert d == tt


def test_solutions_restart(demo_scores):
    sol = threshold_sensitivity(demo_scores)["solutions"].collect()
    by_t = {}
    for r in sol:
        by_t.setdefault(r.threshold, []).append(r.solution_id)
    assert all(ids == list(range(1, len(ids) + 1)) for ids in by_t.values())
    assert len(by_t[0.3]) == 3


def test_quantiles_golden(demo_scores):
    s = {r.statistic: r.value for r in score_summary(demo_scores).collect()}
    assert s == {"minimum": 0.0197, "25th percentile": 0.1782, "median": 0.2987,
                 "60th percentile": 0.3249, "75th percentile": 0.364, "maximum": 0.748}
    t = {r.rule: r.suggested_threshold for r in suggest_thresholds(demo_scores).collect()}
    assert t == {"conservative": 0.364, "balanced": 0.3249, "inclusive": 0.2987}


def test_histogram_select_matches_sort(spark):
    import random
    rnd = random.Random(3)
    vals = [rnd.random() ** 3 for _ in range(5000)] + [0.5] * 2000
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.6, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, "v", probs, bins=16)
    import numpy as np
    exp = np.quantile(np.array(vals), probs)
    for p, e in zip(probs, exp):
        assert abs(got[p] - e) < 1e-12


def test_grouped_select_matches_numpy(spark):
    import random

    import numpy as np

    from setsift.operators.quantiles import grouped_quantiles

    rnd = random.Random(5)
    data = {g: [rnd.gauss(g, 1) ** 2 for _ in range(800 * (g + 1))] + [float(g)] * 300 for g in range(3)}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g int, v double")
    probs = [0.0, 0.25, 0.5, 0.6, 0.75, 1.0]
    got = grouped_quantiles(df, "g", "v", probs, bins=8)
    for g, vs in data.items():
        exp = np.quantile(np.array(vs), probs)
        assert got[g]["n"] == len(vs)
        for p, e in zip(probs, exp):
            assert abs(got[g][p] - e) < 1e-12


def test_quantiles_end_on_infinities_and_heavy_tails(spark):
    import numpy as np

    from setsift.operators.quantiles import exact_quantiles

    inf = float("inf")
    cases = [
        [0.1 * i for i in range(50)] + [inf],
        [-inf, -inf, 1.0, 2.0, inf],
        [10.0**k for k in range(-300, 300, 7)] + [0.0] * 20,
        [0.0, 5e-324, 1e-323, 1.5e-323] * 3,
        [-1.7e308, 1.7e308, 0.0, 1.0],
        [0.25] * 1000 + [0.5],
        [inf] * 3,
    ]
    probs = [0.0, 0.25, 0.5, 0.6, 0.75, 1.0]
    for values in cases:
        got = exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", probs)
        x = sorted(values)
        for p in probs:
            h = (len(x) - 1) * p
            a, b = x[int(np.floor(h))], x[min(int(np.floor(h)) + 1, len(x) - 1)]
            want = a if a == b or h == int(h) else a + (b - a) * (h - int(h))
            assert got[p] == want or abs(got[p] - want) <= max(1e-12 * max(abs(a), abs(b)), 5e-324)


def test_one_selection_gives_all_three_tables(spark, demo_scores):
    from setsift.operators import chart_data as G
    from setsift.operators import thresholds as TH

    found = TH.score_quantiles(demo_scores)
    assert TH.suggest_thresholds(demo_scores, found=found).collect() == TH.suggest_thresholds(demo_scores).collect()
    assert TH.score_summary(demo_scores, found=found).collect() == TH.score_summary(demo_scores).collect()
    assert G.score_box(demo_scores, found).collect() == G.score_box(demo_scores).collect()


def test_quantiles_read_the_input_twice_on_any_distribution(spark, monkeypatch):
    """Clustered, extreme and tied values: every rank stands between its pivots, so no pass over the input follows."""
    import random

    from setsift.operators import quantiles as QN

    calls, own = [], QN._selected
    monkeypatch.setattr(QN, "_selected", lambda rows, pending, bins: calls.append(len(pending)) or own(rows, pending, bins))
    rng = random.Random(5)
    cases = {
        "clusters": [0.5 + rng.random() * 1e-12 for _ in range(9000)] + [rng.random() * 1e9 for _ in range(1000)],
        "extreme": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(9000)] + [float("inf")] * 40 + [float("-inf")] * 40,
        "ties": [rng.randrange(3) / 10 for _ in range(9000)],
    }
    probs = [0.25, 0.5, 0.6, 0.75]
    df = spark.createDataFrame([(g, v) for g, vs in cases.items() for v in vs], "g string, v double")
    got = QN.grouped_quantiles(df, "g", "v", probs)
    assert len(calls) == 1
    for g, vs in cases.items():
        x = sorted(vs)
        for p in probs:
            h = (len(x) - 1) * p
            assert got[g][p] == QN.lerp(x[int(h)], x[min(int(h) + 1, len(x) - 1)], h - int(h))


def test_ranks_that_the_sketch_missed_are_found(spark, monkeypatch):
    from setsift.operators import quantiles as QN

    monkeypatch.setattr(QN, "SLACK", -0.2)  # pivots on the wrong sides
    values = [float(x * x) for x in range(999)]
    got = QN.exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", [0.25, 0.5])
    assert got[0.5] == values[499] and got[0.25] == QN.lerp(values[249], values[250], 0.5)
