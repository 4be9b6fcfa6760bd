import tempfile

import pytest

from fixtures import CONDITIONS, DEMO_PROTOTYPES, DEMO_TEXTS, LABELED_DEMO
from setsift.plans.pipeline import RunSettings, calibration_stage, chart_stage, qca_stage, run_prototype, run_supervised, score_stage
from setsift.sources import io
from setsift.operators import checks as C
from setsift.operators.checks import prototype_issues
from setsift.session import stored


def _texts(spark):
    return spark.createDataFrame(DEMO_TEXTS, "case_id long, text string, outcome int")


def _protos(spark):
    return spark.createDataFrame(DEMO_PROTOTYPES, "condition_name string, prototype string, type string")


def test_prototype_run(spark):
    out = run_prototype(_texts(spark), _protos(spark))
    assert out["score_table"].columns[-3:] == [f"{c}_score" for c in CONDITIONS]
    tt = out["truth_table"].collect()
    assert sum(r.n_cases for r in tt) == 10
    assert out["rich_text_prototype_explanations"].count() == 10
    assert out["threshold_sensitivity_summary"].count() == 6
    assert [r.severity for r in out["prototype_quality"].collect()] == ["info"]
    d = tempfile.mkdtemp(prefix="setsift-test-")
    written = io.write_bundle({k: out[k] for k in ("truth_table", "score_table", "analysis_settings")}, d, "csv")
    back = io.read_table(spark, written["truth_table"], "csv", schema=out["truth_table"].schema)
    assert sorted(back.collect()) == sorted(tt)


def test_supervised_run(spark):
    labeled = spark.createDataFrame(LABELED_DEMO, "case_id string, text string, " + ", ".join(f"{c} int" for c in CONDITIONS))
    out = run_supervised(labeled, _texts(spark), CONDITIONS)
    assert [r.condition for r in out["supervised_training_report"].collect()] == CONDITIONS
    assert out["truth_table"].count() >= 1


def test_stage_roundtrip(spark, demo_scores):
    d = tempfile.mkdtemp(prefix="setsift-test-")
    io.write_table(demo_scores, f"{d}/scores", "csv")
    calibration_stage(spark, f"{d}/scores", d, RunSettings(), "csv")
    # CSV needs the schema again: read the QCA-ready table with explicit types
    ready = io.read_table(spark, f"{d}/qca_ready_dataset", "csv",
                          "case_id long, dissatisfaction int, policy_demand int, coproduction_request int, outcome int")
    io.write_table(ready, f"{d}/ready", "parquet")
    qca_stage(spark, f"{d}/ready", d, RunSettings(), "parquet")
    tt = io.read_table(spark, f"{d}/truth_table").collect()
    assert len(tt) == 6


def test_run_has_members_boxes_matrices_and_scores_without_outcome(spark):
    out = run_prototype(_texts(spark).drop("outcome"), _protos(spark), include_outcome_prototype=True)
    assert [c for c in out["score_table"].columns if c.endswith("_score")] == [f"{p[0]}_score" for p in DEMO_PROTOTYPES]
    assert "text" not in out["score_table"].columns
    members = out["configuration_members"].collect()
    assert sorted(r.case_id for r in members) == sorted(t[0] for t in DEMO_TEXTS) and all(r.status for r in members)
    assert out["score_box"].count() == len(DEMO_PROTOTYPES)
    assert out["membership_matrix_crisp"].count() == out["membership_matrix_fuzzy"].count() == 10
    assert {r.outcome_positive_cases for r in out["truth_table"].collect()} == {0}
    assert out["top_condition_explanation"].filter("text is null").count() == 0


def test_score_and_chart_stages_with_other_roles(spark):
    d = tempfile.mkdtemp(prefix="setsift-test-")
    texts = _texts(spark).toDF("nr", "body", "result")
    io.write_table(texts, f"{d}/texts")
    io.write_table(_protos(spark), f"{d}/protos")
    score_stage(spark, f"{d}/texts", f"{d}/protos", f"{d}/scores", text="body", case_id="nr")
    scores = io.read_scores(spark, f"{d}/scores")
    assert scores.columns[:3] == ["nr", "body", "result"] and set(scores.columns[3:]) == {f"{c}_score" for c in CONDITIONS}
    calibration_stage(spark, f"{d}/scores", d, text="body", case_id="nr", outcome="result")
    assert qca_stage(spark, f"{d}/qca_ready_dataset", d, case_id="nr", outcome="result").keys() >= {"truth_table", "configuration_members"}
    made = chart_stage(spark, f"{d}/scores", f"{d}/truth_table", d, case_id="nr", outcome="result")
    assert io.read_table(spark, made["score_long"]).count() == 30 and io.read_table(spark, made["score_box"]).count() == 3


def test_csv_ids_are_numbers_when_all_are(spark):
    d = tempfile.mkdtemp(prefix="setsift-test-")
    io.write_table(_texts(spark), f"{d}/a", "csv")
    assert dict(io.read_texts(spark, f"{d}/a", "csv").dtypes)["case_id"] == "bigint"
    io.write_table(spark.createDataFrame([("01", "x", 1), ("2", "y", 0)], "case_id string, text string, outcome int"), f"{d}/b", "csv")
    assert sorted(r.case_id for r in io.read_texts(spark, f"{d}/b", "csv").collect()) == ["01", "2"]


def test_labeled_csv(spark):
    d = tempfile.mkdtemp(prefix="setsift-test-")
    labeled = spark.createDataFrame(LABELED_DEMO, "case_id string, text string, " + ", ".join(f"{c} int" for c in CONDITIONS))
    io.write_table(labeled, f"{d}/labeled", "csv")
    back = io.read_labeled(spark, f"{d}/labeled", "csv", labeled.schema)
    assert sorted(back.collect()) == sorted(labeled.collect())


def test_prototype_issues(spark):
    rows = prototype_issues(_protos(spark)).collect()
    assert [(r.check, r.severity) for r in rows] == [("outcome_prototype_notice", "info")]
    bad = spark.createDataFrame(
        [("a", "short text", "condition"), ("a", "", "weird"), ("b", " ".join(["w"] * 90), "outcome")],
        "condition_name string, prototype string, type string")
    checks = [(r.check, r.severity, r.item) for r in prototype_issues(bad).collect()]
    assert checks == [("empty_value", "error", "a"), ("duplicate_condition_name", "error", "a"), ("invalid_type", "error", "weird"),
                      ("short_prototype", "warning", "a"), ("short_prototype", "warning", "a"), ("long_prototype", "warning", "b"),
                      ("outcome_prototype_notice", "info", None)]
    assert [r.check for r in prototype_issues(bad.limit(0)).collect()] == ["no_condition_prototype"]
    fine = spark.createDataFrame([("a", "one two three four five six", "condition")], "condition_name string, prototype string, type string")
    assert [(r.check, r.severity) for r in prototype_issues(fine).collect()] == [("prototype_quality", "pass")]
    missing = prototype_issues(bad.drop("type")).collect()
    assert missing[0].check == "required_column"


def _counted(spark, df):
    """``df`` and the accumulator of the rows that have been read from it."""
    rows = spark.sparkContext.accumulator(0)

    def read(batches):
        for b in batches:
            rows.add(len(b))
            yield b

    return df.mapInPandas(read, df.schema), rows


def _labeled(spark):
    return spark.createDataFrame(LABELED_DEMO, "case_id string, text string, " + ", ".join(f"{c} int" for c in CONDITIONS))


def test_runs_read_labels_and_prototypes_once(spark):
    labeled, rows = _counted(spark, _labeled(spark))
    out = run_supervised(labeled, _texts(spark), CONDITIONS)
    for name in ("supervised_validation_report", "supervised_training_report", "truth_table"):
        out[name].collect()
    assert rows.value == len(LABELED_DEMO)
    protos, rows = _counted(spark, _protos(spark))
    out = run_prototype(_texts(spark), protos)
    for name in ("prototype_quality", "truth_table", "rich_text_prototype_explanations"):
        out[name].collect()
    assert rows.value == len(DEMO_PROTOTYPES)


def test_observed_reports_are_the_reports(spark):
    tables = [
        _labeled(spark),
        _labeled(spark).limit(0),
        spark.createDataFrame([("a", 1, 2, "1", True), ("", 1, 0, "x", None), (None, None, 7, None, False)] * 3, "text string, x int, y int, z string, flag boolean"),
    ]
    for df in tables:
        conds = [c for c in df.columns if c not in ("case_id", "text")]
        seen, report, training = C.observe_labels(df, "text", [*conds, "absent"])
        stored(seen, "observed")
        assert report().collect() == C.label_report(df, "text", [*conds, "absent"]).collect()
        assert training().collect() == C.training_report(df, conds).collect()
        numbers = [c for c, t in df.dtypes if t == "int"]
        seen, domain = C.observe_crisp(df, numbers)
        stored(seen, "observed")
        assert domain().collect() == C.crisp_domain_report(df, numbers).collect()


def test_supervised_run_refuses_bad_labels(spark):
    bad = _labeled(spark)
    for df, conditions in ((bad.drop("text"), CONDITIONS), (bad, [*CONDITIONS, "absent"]), (bad, []), (bad.limit(0), CONDITIONS)):
        with pytest.raises(ValueError, match="labeled training data"):
            run_supervised(df, _texts(spark), conditions)


def test_calibration_stage_reports_the_domain(spark, demo_scores):
    d = tempfile.mkdtemp(prefix="setsift-test-")
    io.write_table(demo_scores, f"{d}/scores")
    paths = calibration_stage(spark, f"{d}/scores", d)
    rows = io.read_table(spark, paths["crisp_domain_report"]).collect()
    assert {r.column for r in rows} == {*CONDITIONS, "outcome"} and {(r.n_rows, r.severity) for r in rows} == {(10, "pass")}
