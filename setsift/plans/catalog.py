"""Registered queries: each takes (spark, sf_dir) and returns a lazy DataFrame.

Every query reads the driver's tables (or data Spark derives from them) in full;
float outputs that are compared with the SQL cross-check are rounded half-even to 6
places in the query wrapper only, never inside the library operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import relations as R
from . import sqlgen as Q
from ..operators.calibrate import calibrate, qca_ready
from ..operators.score import prototype_cosine_long
from ..operators.members import configuration_overlaps, member_bitmaps, numbered
from ..operators.sweep import every_threshold
from ..operators.truth_table import configuration_members, configuration_positions, solutions, truth_table
from ..operators import thresholds as TH
from .. import constants as K
from ..functions.text import explanation_terms
from ..operators import chart_data as G
from ..operators import checks as C
from ..operators import explain as X
from ..operators import tfidf as T
from ..operators.partitioning import spread
from ..session import stored

LI_THRESHOLD = 0.5
LI_SOLUTION_CUTOFF = 0.333
EM_THRESHOLD = 0.30
EM_ANCHORS = (0.15, 0.30, 0.45)


def _round6(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.bround(F.col(c), 6) for c in cols})


def q_truth_table(spark: SparkSession, sf: str) -> DataFrame:
    ready = qca_ready(calibrate(R.li_scores(spark, sf), method="crisp", threshold=LI_THRESHOLD), case_id="_none")
    return truth_table(ready, R.LI_CONDITIONS)


def q_solutions(spark: SparkSession, sf: str) -> DataFrame:
    ready = qca_ready(calibrate(R.li_scores(spark, sf), method="crisp", threshold=LI_THRESHOLD), case_id="_none")
    tt = truth_table(ready, R.LI_CONDITIONS, consistency_cutoff=LI_SOLUTION_CUTOFF)
    return solutions(tt, consistency_cutoff=LI_SOLUTION_CUTOFF)


def q_prototype_cosine_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = R.em_scores(spark, sf)
    return _round6(s, [f"{c}_score" for c in R.EM_CONDITIONS])


def q_fuzzy_membership(spark: SparkSession, sf: str) -> DataFrame:
    out, cross, inn = EM_ANCHORS
    fz = calibrate(R.em_scores(spark, sf), method="fuzzy", full_out=out, crossover=cross, full_in=inn)
    return _round6(fz, [f"{c}_score" for c in R.EM_CONDITIONS] + R.EM_CONDITIONS)


def q_crisp_membership(spark: SparkSession, sf: str) -> DataFrame:
    cr = calibrate(R.em_scores(spark, sf), method="crisp", threshold=EM_THRESHOLD, keep_score_columns=False)
    return cr


def q_qca_ready(spark: SparkSession, sf: str) -> DataFrame:
    return qca_ready(calibrate(R.em_scores(spark, sf), method="crisp", threshold=EM_THRESHOLD))


def q_configuration_members(spark: SparkSession, sf: str) -> DataFrame:
    ready = qca_ready(calibrate(R.em_scores(spark, sf), method="crisp", threshold=EM_THRESHOLD))
    ready = stored(ready, "qca-ready")  # scored once; the table and its members read this
    tt = truth_table(ready, R.EM_CONDITIONS, sort=False)
    return configuration_members(ready, R.EM_CONDITIONS, tt=tt)


def _li_detail(spark: SparkSession, sf: str, sort: bool = False) -> DataFrame:
    return TH.sensitivity_detail(R.li_scores(spark, sf), K.DEFAULT_THRESHOLD_GRID, consistency_cutoff=LI_SOLUTION_CUTOFF, sort=sort)


def q_sensitivity_detail(spark: SparkSession, sf: str) -> DataFrame:
    return _li_detail(spark, sf, sort=True)


def q_sensitivity_summary(spark: SparkSession, sf: str) -> DataFrame:
    return TH.sensitivity_summary(_li_detail(spark, sf))


def q_sensitivity_solutions(spark: SparkSession, sf: str) -> DataFrame:
    return TH.sensitivity_solutions(_li_detail(spark, sf), R.LI_CONDITIONS, LI_SOLUTION_CUTOFF)


def q_configuration_stability(spark: SparkSession, sf: str) -> DataFrame:
    return TH.configuration_stability(_li_detail(spark, sf))


def q_threshold_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    return TH.suggest_thresholds(R.li_scores(spark, sf))


def q_score_summary(spark: SparkSession, sf: str) -> DataFrame:
    return TH.score_summary(R.li_scores(spark, sf))


def q_every_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """The truth table at every distinct score as threshold."""
    return every_threshold(R.li_scores(spark, sf), consistency_cutoff=LI_SOLUTION_CUTOFF, sort=False)


def q_configuration_positions(spark: SparkSession, sf: str) -> DataFrame:
    ready = qca_ready(calibrate(R.em_scores(spark, sf), method="crisp", threshold=EM_THRESHOLD))
    return configuration_positions(ready, R.EM_CONDITIONS)


def q_configuration_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Cases that go from one configuration to another between a threshold and the next, from bitmaps of members."""
    bitmaps = member_bitmaps(numbered(R.em_scores(spark, sf)), K.DEFAULT_THRESHOLD_GRID)
    return configuration_overlaps(bitmaps, K.DEFAULT_THRESHOLD_GRID)


def q_top_two_all_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Top two of a prototype for every label, in long form."""
    long = prototype_cosine_long(R.em_vectors(spark, sf), R.all_label_prototypes(spark, sf))
    return X.top_two_long(long)


def q_score_whiskers(spark: SparkSession, sf: str) -> DataFrame:
    return _round6(G.score_whiskers(R.em_scores(spark, sf)), ["q1", "median", "q3", "lower_fence", "upper_fence", "whisker_low", "whisker_high"])


def q_score_points(spark: SparkSession, sf: str) -> DataFrame:
    """The points that the box plot of the cosine scores shows, 200 a condition."""
    return _round6(G.score_points(R.em_scores(spark, sf), 200), ["similarity_score"])


def q_crisp_domain_report(spark: SparkSession, sf: str) -> DataFrame:
    out, cross, inn = EM_ANCHORS
    fz = qca_ready(calibrate(R.li_scores(spark, sf), method="fuzzy", full_out=out, crossover=cross, full_in=inn), case_id="_none")
    return C.crisp_domain_report(fz, R.LI_CONDITIONS + ["outcome"])


def q_top_two_conditions(spark: SparkSession, sf: str) -> DataFrame:
    return X.top_two(R.em_scores(spark, sf))


def q_confidence_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = X.with_confidence(R.em_scores(spark, sf))
    return c.groupBy("confidence").agg(F.count(F.lit(1)).alias("n_cases"))


def q_explanation_terms(spark: SparkSession, sf: str) -> DataFrame:
    d = spread(R.table(spark, sf, "documents"), "doc_id").select("doc_id", explanation_terms(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_terms"), F.array_join("t", " ").alias("terms"))


def _rich(spark: SparkSession, sf: str) -> DataFrame:
    return X.rich_explanations(_dl_scores(spark, sf), R.dl_prototypes(spark))


def q_shared_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms that each document shares with the prototype of its top condition."""
    n = F.when(F.col("matched_terms") == "", 0).otherwise(F.size(F.split("matched_terms", ", ")))
    return _rich(spark, sf).select(F.col("case_id").alias("doc_id"), "top_condition", n.alias("n_shared"), "matched_terms")


def q_tfidf_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return T.vocabulary(R.table(spark, sf, "documents")).select("term", "tf", "df")


def q_tfidf_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _round6(T.tfidf_vectors(R.table(spark, sf, "documents"), "doc_id"), ["weight"])


def _dl_scores(spark: SparkSession, sf: str) -> DataFrame:
    return T.tfidf_prototype_scores(R.dl_texts(spark, sf), R.dl_prototypes(spark), R.DL_CONDITIONS)


def q_tfidf_prototype_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = _dl_scores(spark, sf).select("case_id", "outcome", *[f"{c}_score" for c in R.DL_CONDITIONS])
    return _round6(s, [f"{c}_score" for c in R.DL_CONDITIONS])


def _repeated_ids(spark: SparkSession, sf: str) -> DataFrame:
    """All documents under ids that repeat (about three rows an id) or are missing, and every fifth text once more."""
    d = R.table(spark, sf, "documents")
    n = F.floor(F.col("doc_id") / 3)
    rows = d.select(F.when(F.col("doc_id") % 7 != 0, n).alias("case_id"), "text", F.col("doc_id").alias("row"))
    return rows.unionByName(d.filter("doc_id % 5 = 0").select(n.alias("case_id"), "text", (-F.col("doc_id") - 1).alias("row")))


def q_tfidf_scores_repeated_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of rows with repeated and missing ids and repeated texts: each row is scored by its own text."""
    names = [f"{c}_score" for c in R.DL_CONDITIONS]
    s = T.tfidf_prototype_scores(_repeated_ids(spark, sf), R.dl_prototypes(spark), R.DL_CONDITIONS)
    return _round6(s.select("row", "case_id", *names), names)


def q_rich_explanations(spark: SparkSession, sf: str) -> DataFrame:
    return _rich(spark, sf).drop("text")


def q_score_long(spark: SparkSession, sf: str) -> DataFrame:
    return _round6(G.score_long(R.em_scores(spark, sf)), ["similarity_score"])


def q_score_box(spark: SparkSession, sf: str) -> DataFrame:
    return _round6(G.score_box(R.em_scores(spark, sf)), ["min", "q1", "median", "q3", "max"])


def q_membership_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return G.membership_matrix(q_crisp_membership(spark, sf), R.EM_CONDITIONS)


def q_membership_bins(spark: SparkSession, sf: str) -> DataFrame:
    out, cross, inn = EM_ANCHORS
    fz = calibrate(R.em_scores(spark, sf), method="fuzzy", full_out=out, crossover=cross, full_in=inn)
    return G.membership_bins(fz, R.EM_CONDITIONS)


def q_coverage_points(spark: SparkSession, sf: str) -> DataFrame:
    return G.coverage_points(q_truth_table(spark, sf))


def q_label_report(spark: SparkSession, sf: str) -> DataFrame:
    return C.label_report(R.dl_labeled(spark, sf), conditions=["quality", "toxic"])


def q_training_report(spark: SparkSession, sf: str) -> DataFrame:
    return C.training_report(R.dl_labeled(spark, sf), ["quality", "toxic"])


def q_binary_label_columns(spark: SparkSession, sf: str) -> DataFrame:
    return C.binary_label_columns_report(R.dl_labeled(spark, sf))


def q_prototype_quality(spark: SparkSession, sf: str) -> DataFrame:
    return C.prototype_issues(R.benchmark_prototypes(spark, sf))


def q_supervised_scores(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.classify import fit_classifiers

    clf = fit_classifiers(R.dl_labeled(spark, sf), ["quality", "toxic"])
    docs = R.table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), "text")
    return _round6(clf.predict_scores(docs).drop("text"), ["quality_score", "toxic_score"])


def q_logistic_gradient(spark: SparkSession, sf: str) -> DataFrame:
    """The solver's first gradient, per condition and term."""
    from ..operators.classify import gradient_at_zero

    return gradient_at_zero(R.dl_labeled(spark, sf), ["quality", "toxic"]).withColumn("gradient", F.bround("gradient", 9))


def q_label_report_issues(spark: SparkSession, sf: str) -> DataFrame:
    """The report over labels that are wrong on purpose: other numbers, one class only, booleans, a missing column."""
    bad = R.dl_labeled(spark, sf).select(
        F.when(F.col("case_id") % 10 != 0, F.col("text")).alias("text"),
        (F.col("case_id") % 3).alias("thirds"),
        F.lit(0).alias("never"),
        (F.col("toxic") == 1).alias("flag"),
    )
    return C.label_report(bad, conditions=["thirds", "never", "flag", "absent"])


DL_THRESHOLD = 0.30


def q_pipeline_truth_table(spark: SparkSession, sf: str) -> DataFrame:
    """The whole prototype-mode run (checks, TF-IDF scoring, checkpoint, calibration, truth table) over all
    documents, the outcome missing where there is no label; its truth table is returned."""
    from .pipeline import RunSettings, run_prototype

    out = run_prototype(R.dl_texts(spark, sf), R.dl_prototypes(spark),
                        RunSettings(crisp_threshold=DL_THRESHOLD, run_threshold_sensitivity=False))
    return out["truth_table"]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "truth_table": q_truth_table,
    "solutions": q_solutions,
    "prototype_cosine_scores": q_prototype_cosine_scores,
    "fuzzy_membership": q_fuzzy_membership,
    "crisp_membership": q_crisp_membership,
    "qca_ready": q_qca_ready,
    "configuration_members": q_configuration_members,
    "sensitivity_detail": q_sensitivity_detail,
    "sensitivity_summary": q_sensitivity_summary,
    "sensitivity_solutions": q_sensitivity_solutions,
    "configuration_stability": q_configuration_stability,
    "threshold_suggestions": q_threshold_suggestions,
    "score_summary": q_score_summary,
    "crisp_domain_report": q_crisp_domain_report,
    "top_two_conditions": q_top_two_conditions,
    "confidence_counts": q_confidence_counts,
    "explanation_terms": q_explanation_terms,
    "shared_terms": q_shared_terms,
    "tfidf_vocabulary": q_tfidf_vocabulary,
    "tfidf_vectors": q_tfidf_vectors,
    "tfidf_prototype_scores": q_tfidf_prototype_scores,
    "tfidf_scores_repeated_ids": q_tfidf_scores_repeated_ids,
    "rich_explanations": q_rich_explanations,
    "score_long": q_score_long,
    "score_box": q_score_box,
    "membership_bins": q_membership_bins,
    "coverage_points": q_coverage_points,
    "label_report": q_label_report,
    "label_report_issues": q_label_report_issues,
    "training_report": q_training_report,
    "binary_label_columns": q_binary_label_columns,
    "prototype_quality": q_prototype_quality,
    "logistic_gradient": q_logistic_gradient,
    "supervised_scores": q_supervised_scores,
    "membership_matrix": q_membership_matrix,
    "pipeline_truth_table": q_pipeline_truth_table,
    "every_threshold": q_every_threshold,
    "configuration_positions": q_configuration_positions,
    "configuration_overlaps": q_configuration_overlaps,
    "top_two_all_labels": q_top_two_all_labels,
    "score_whiskers": q_score_whiskers,
    "score_points": q_score_points,
}


def _em_cols(prefix_sql: str = "") -> str:
    return ", ".join(f"{c}_score" for c in R.EM_CONDITIONS)


def oracle() -> dict[str, str]:
    li_tt = Q.truth_table_sql(Q.LI_SCORES_SQL, R.LI_CONDITIONS, LI_THRESHOLD)
    li_tt_cut = Q.truth_table_sql(Q.LI_SCORES_SQL, R.LI_CONDITIONS, LI_THRESHOLD, cutoff=LI_SOLUTION_CUTOFF)
    em = Q.em_scores_sql()
    em_r6 = ", ".join(f"round_even({c}_score, 6) AS {c}_score" for c in R.EM_CONDITIONS)
    out, cross, inn = EM_ANCHORS
    fz = ", ".join(f"round_even({Q.fuzzy_expr(c + '_score', out, cross, inn)}, 6) AS {c}" for c in R.EM_CONDITIONS)
    crisp = Q.crisp_cols(R.EM_CONDITIONS, EM_THRESHOLD)
    em_conds = ", ".join(R.EM_CONDITIONS)
    em_tt = Q.truth_table_sql(em, R.EM_CONDITIONS, EM_THRESHOLD)
    li_detail = Q.sensitivity_detail_sql(Q.LI_SCORES_SQL, R.LI_CONDITIONS, K.DEFAULT_THRESHOLD_GRID, LI_SOLUTION_CUTOFF)
    extra = _oracle_more(em, li_tt)
    return extra | {
        "sensitivity_detail": li_detail,
        "sensitivity_summary": Q.sensitivity_summary_sql(li_detail),
        "sensitivity_solutions": Q.sensitivity_solutions_sql(li_detail, R.LI_CONDITIONS, LI_SOLUTION_CUTOFF),
        "configuration_stability": Q.stability_sql(li_detail),
        "threshold_suggestions": Q.quantile_rows_sql(
            Q.LI_SCORES_SQL, R.LI_CONDITIONS, K.THRESHOLD_RULES, "suggested_threshold", "rule", "interpretation"
        ),
        "score_summary": Q.quantile_rows_sql(Q.LI_SCORES_SQL, R.LI_CONDITIONS, K.SUMMARY_STATISTICS, "value", "statistic"),
        "truth_table": li_tt,
        "solutions": Q.solutions_sql(li_tt_cut, R.LI_CONDITIONS, LI_SOLUTION_CUTOFF),
        "prototype_cosine_scores": f"SELECT case_id, outcome, {em_r6} FROM ({em})",
        "fuzzy_membership": f"SELECT case_id, outcome, {em_r6}, {fz} FROM ({em})",
        "crisp_membership": f"SELECT case_id, outcome, {crisp} FROM ({em})",
        "qca_ready": f"SELECT case_id, {crisp}, outcome FROM ({em})",
        "configuration_members": f"""
WITH r AS (SELECT case_id, {crisp}, outcome FROM ({em})),
tt AS ({em_tt})
SELECT r.case_id, {', '.join('r.' + c for c in R.EM_CONDITIONS)}, {Q.label_sql(R.EM_CONDITIONS, 'r.')} AS configuration,
       r.outcome, tt.status
FROM r LEFT JOIN tt ON tt.configuration = {Q.label_sql(R.EM_CONDITIONS, 'r.')}""",
    }


def _oracle_more(em: str, li_tt: str) -> dict[str, str]:
    out, cross, inn = EM_ANCHORS
    li_f = ", ".join(f"{Q.fuzzy_expr(c + '_score', out, cross, inn)} AS {c}" for c in R.LI_CONDITIONS)
    dom_cols = R.LI_CONDITIONS + ["outcome"]
    dom_aggs = ", ".join(
        f"CAST(count_if({c} IS NULL) AS BIGINT) AS {c}__missing, "
        f"CAST(count_if({c} IS NOT NULL AND CAST({c} AS DOUBLE) NOT IN (0.0, 1.0)) AS BIGINT) AS {c}__invalid, "
        f"MIN(CASE WHEN {c} IS NOT NULL AND CAST({c} AS DOUBLE) NOT IN (0.0, 1.0) THEN CAST({c} AS DOUBLE) END) AS {c}__min, "
        f"MAX(CASE WHEN {c} IS NOT NULL AND CAST({c} AS DOUBLE) NOT IN (0.0, 1.0) THEN CAST({c} AS DOUBLE) END) AS {c}__max"
        for c in dom_cols
    )
    dom_rows = "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", __rows AS n_rows, {c}__missing AS n_missing, {c}__invalid AS n_invalid, "
        f"{c}__min AS min_invalid, {c}__max AS max_invalid, "
        f"CASE WHEN {c}__invalid > 0 THEN 'error' ELSE 'pass' END AS severity FROM a"
        for c in dom_cols
    )
    em_keep = ["case_id", "outcome"]
    tt2 = Q.top_two_ctes(em, R.EM_CONDITIONS, em_keep)
    em_long = "\nUNION ALL ".join(
        f"SELECT case_id, outcome, '{c}' AS condition, round_even({c}_score, 6) AS similarity_score FROM ({em})"
        for c in R.EM_CONDITIONS
    )
    em_fz_long = "\nUNION ALL ".join(
        f"SELECT '{c}' AS condition, {Q.fuzzy_expr(c + '_score', out, cross, inn)} AS v FROM ({em})" for c in R.EM_CONDITIONS
    )
    box = "\nUNION ALL ".join(
        f"SELECT '{c}' AS condition, COUNT(v) AS n, round_even(MIN(v), 6) AS min, round_even(quantile_cont(v, 0.25), 6) AS q1, "
        f"round_even(quantile_cont(v, 0.5), 6) AS median, round_even(quantile_cont(v, 0.75), 6) AS q3, round_even(MAX(v), 6) AS max "
        f"FROM (SELECT {c}_score AS v FROM ({em}))"
        for c in R.EM_CONDITIONS
    )
    protos_terms = ", ".join(
        f"({Q.sql_str(n)}, {Q.sql_str(p)})" for n, p, _ in R.DL_PROTOTYPES
    )
    dl_scores = Q.tfidf_scores_sql(Q.DL_SQL, R.DL_PROTOTYPES, "t.case_id, t.outcome, t.text")
    dl_tt2 = Q.top_two_ctes(dl_scores, R.DL_CONDITIONS, ["case_id", "outcome", "text"])
    rich = f"""{dl_tt2},
pr AS (SELECT cond, ptext, {Q.explanation_terms_sql('ptext')} AS pt FROM (VALUES {protos_terms}) v(cond, ptext)),
x AS (SELECT tt2.*, {Q.confidence_sql('t1', 't2')} AS confidence, pr.ptext,
             {Q.shared_terms_sql(Q.explanation_terms_sql('tt2.text'), "coalesce(pr.pt, [])")} AS m
      FROM tt2 LEFT JOIN pr ON pr.cond = tt2.n1)"""
    repeated = """
SELECT doc_id AS case_id, CASE WHEN doc_id % 7 <> 0 THEN doc_id // 3 END AS id, text FROM documents
UNION ALL SELECT -doc_id - 1, doc_id // 3, text FROM documents WHERE doc_id % 5 = 0"""
    whiskers = "\nUNION ALL ".join(
        f"""SELECT '{c}' AS condition, count(v) AS n, any_value(q1) AS q1, any_value(q2) AS median, any_value(q3) AS q3,
       any_value(q1 - 1.5 * (q3 - q1)) AS lower_fence, any_value(q3 + 1.5 * (q3 - q1)) AS upper_fence,
       min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
       count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1)) AS n_below, count(*) FILTER (WHERE v > q3 + 1.5 * (q3 - q1)) AS n_above
FROM (SELECT {c}_score AS v FROM em), (SELECT quantile_cont({c}_score, 0.25) AS q1, quantile_cont({c}_score, 0.5) AS q2, quantile_cont({c}_score, 0.75) AS q3 FROM em)"""
        for c in R.EM_CONDITIONS
    )
    points = "\nUNION ALL ".join(f"SELECT '{c}' AS condition, case_id, {c}_score AS v FROM em" for c in R.EM_CONDITIONS)
    rounded = ", ".join(f"round_even({c}, 6) AS {c}" for c in ("q1", "median", "q3", "lower_fence", "upper_fence", "whisker_low", "whisker_high"))
    li_at = ", ".join(f"CAST({c}_score >= threshold AS INTEGER) AS {c}" for c in R.LI_CONDITIONS)
    li = ", ".join(R.LI_CONDITIONS)
    return {
        "score_whiskers": f"WITH em AS ({em}), w AS ({whiskers}) SELECT condition, n, {rounded}, n_below, n_above FROM w",
        "score_points": f"""
WITH em AS ({em}), w AS ({whiskers}), p AS ({points})
SELECT condition, case_id, round_even(v, 6) AS similarity_score, v < lower_fence OR v > upper_fence AS outlier
FROM p JOIN w USING (condition) QUALIFY row_number() OVER (PARTITION BY condition ORDER BY md5(condition || ':' || case_id), v) <= 200""",
        "configuration_positions": f"""
SELECT {Q.label_sql(R.EM_CONDITIONS)} AS configuration, row_number() OVER (PARTITION BY {', '.join(R.EM_CONDITIONS)} ORDER BY case_id) AS position, case_id
FROM (SELECT case_id, {Q.crisp_cols(R.EM_CONDITIONS, EM_THRESHOLD)} FROM ({em}))""",
        "configuration_overlaps": Q.overlaps_sql(em, R.EM_CONDITIONS, K.DEFAULT_THRESHOLD_GRID),
        "top_two_all_labels": f"""
WITH p AS (SELECT label, arg_min(embedding, vec_id) AS pv FROM embeddings GROUP BY label),
s AS (SELECT e.vec_id AS case_id, 'label' || p.label AS name, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(p.pv AS DOUBLE[])) AS score,
             row_number() OVER (PARTITION BY e.vec_id ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(p.pv AS DOUBLE[])) DESC, p.label) AS k
      FROM embeddings e, p),
t AS (SELECT case_id, max(name) FILTER (WHERE k = 1) AS n1, max(score) FILTER (WHERE k = 1) AS t1, max(name) FILTER (WHERE k = 2) AS n2, max(score) FILTER (WHERE k = 2) AS t2 FROM s GROUP BY case_id)
SELECT case_id, n1 AS top_condition, round_even(t1, 4) AS top_score, n2 AS second_condition, round_even(t2, 4) AS second_score, round_even(t1 - t2, 4) AS score_gap,
       {Q.confidence_sql('t1', 't2')} AS confidence FROM t""",
        "every_threshold": f"""
WITH s AS ({Q.LI_SCORES_SQL}),
v AS ({" UNION ".join(f"SELECT {c}_score AS threshold FROM s" for c in R.LI_CONDITIONS)}),
k AS (SELECT {", ".join(f"{c}_score" for c in R.LI_CONDITIONS)}, count(*) AS n, sum(outcome) AS p FROM s GROUP BY ALL),
g AS (SELECT threshold, {li_at}, CAST(sum(n) AS BIGINT) AS n_cases, CAST(coalesce(sum(p), 0) AS BIGINT) AS outcome_positive_cases FROM k, v GROUP BY ALL),
t AS (SELECT *, CAST(outcome_positive_cases AS DOUBLE) / n_cases AS cons, CAST(outcome_positive_cases AS DOUBLE) / NULLIF(SUM(outcome_positive_cases) OVER (PARTITION BY threshold), 0) AS cov FROM g)
SELECT threshold, {li}, {Q.label_sql(R.LI_CONDITIONS)} AS configuration, n_cases, outcome_positive_cases, round_even(cons, 4) AS consistency, round_even(cov, 4) AS raw_coverage,
       {Q.status_sql('cons', 'n_cases', LI_SOLUTION_CUTOFF, 1)} AS status FROM t""",
        "crisp_domain_report": f"""
WITH f AS (SELECT {li_f}, outcome FROM ({Q.LI_SCORES_SQL})),
a AS (SELECT COUNT(*) AS __rows, {dom_aggs} FROM f)
{dom_rows}""",
        "top_two_conditions": f"""
WITH {tt2}
SELECT case_id, CAST(NULL AS VARCHAR) AS text, n1 AS top_condition, round_even(t1, 4) AS top_score,
       n2 AS second_condition, round_even(t2, 4) AS second_score, round_even(t1 - t2, 4) AS score_gap, outcome
FROM tt2""",
        "confidence_counts": f"""
WITH {tt2}
SELECT {Q.confidence_sql('t1', 't2')} AS confidence, COUNT(*) AS n_cases FROM tt2 GROUP BY 1""",
        "explanation_terms": f"""
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_terms, array_to_string(t, ' ') AS terms
FROM (SELECT doc_id, {Q.explanation_terms_sql('text')} AS t FROM documents)""",
        "shared_terms": f"""
WITH {rich}
SELECT case_id AS doc_id, n1 AS top_condition, CAST(len(m) AS INTEGER) AS n_shared, array_to_string(m, ', ') AS matched_terms FROM x""",
        "tfidf_vocabulary": f"""
WITH {Q.vocab_ctes('SELECT doc_id AS id, text FROM documents')}
SELECT term, CAST(tf AS BIGINT) AS tf, CAST(df AS BIGINT) AS df FROM vocab""",
        "tfidf_prototype_scores": "SELECT case_id, outcome, "
        + ", ".join(f"round_even({c}_score, 6) AS {c}_score" for c in R.DL_CONDITIONS)
        + f" FROM ({Q.tfidf_scores_sql(Q.DL_SQL, R.DL_PROTOTYPES, 't.case_id, t.outcome')})",
        "rich_explanations": f"""
WITH {rich}
SELECT case_id, n1 AS top_condition, round_even(t1, 4) AS top_score, n2 AS second_condition,
       round_even(t2, 4) AS second_score, round_even(t1 - t2, 4) AS score_gap, confidence,
       array_to_string(m, ', ') AS matched_terms, coalesce(ptext, '') AS top_prototype,
       printf({Q.sql_str(K.NOTE_HEAD)}, n1, t1, confidence)
       || CASE WHEN t2 IS NULL THEN {Q.sql_str(K.NOTE_NO_SECOND)} ELSE printf({Q.sql_str(K.NOTE_GAP)}, n2, t1 - t2) END
       || ' '
       || CASE WHEN len(m) > 0 THEN printf({Q.sql_str(K.NOTE_MATCHED)}, array_to_string(m, ', ')) ELSE {Q.sql_str(K.NOTE_NO_MATCH)} END
         AS interpretation_note,
       outcome
FROM x""",
        "tfidf_vectors": "SELECT id AS doc_id, term, round_even(weight, 6) AS weight FROM ("
        + Q.tfidf_vectors_sql("SELECT doc_id AS id, text FROM documents") + ")",
        "tfidf_scores_repeated_ids": "SELECT case_id AS row, id AS case_id, "
        + ", ".join(f"round_even({c}_score, 6) AS {c}_score" for c in R.DL_CONDITIONS)
        + f" FROM ({Q.tfidf_scores_sql(repeated, R.DL_PROTOTYPES, 't.case_id, t.id')})",
        "logistic_gradient": Q.gradient_sql(Q.LABELED_SQL, ["quality", "toxic"]),
        "membership_matrix": f"SELECT CAST(case_id AS VARCHAR) AS case_id, {Q.crisp_cols(R.EM_CONDITIONS, EM_THRESHOLD)} FROM ({em})",
        "label_report_issues": _label_issues_sql(),
        "score_long": em_long,
        "score_box": box,
        "membership_bins": f"""
WITH l AS ({em_fz_long}),
b AS (SELECT condition, CAST(least(greatest(floor(v * 10), 0), 9) AS INTEGER) AS bin FROM l WHERE v IS NOT NULL)
SELECT condition, bin, CAST(bin AS DOUBLE) / 10 AS bin_low, CAST(bin + 1 AS DOUBLE) / 10 AS bin_high, COUNT(*) AS n_cases
FROM b GROUP BY condition, bin""",
        "coverage_points": f"SELECT configuration, consistency, raw_coverage, n_cases, status FROM ({li_tt})",
        "label_report": _label_report_sql(["quality", "toxic"]),
        "training_report": "\nUNION ALL ".join(
            f"SELECT '{c}' AS condition, COUNT(*) AS n_training_cases, CAST(SUM(COALESCE({c}, 0)) AS BIGINT) AS n_positive, "
            f"CAST(COUNT(*) - SUM(COALESCE({c}, 0)) AS BIGINT) AS n_negative, "
            f"round_even(SUM(COALESCE({c}, 0)) / COUNT(*), 4) AS positive_rate FROM ({Q.LABELED_SQL})"
            for c in ["quality", "toxic"]
        ),
        "binary_label_columns": "\nUNION ALL ".join(
            f"SELECT '{c}' AS column_name, COALESCE(bool_and({c} IS NULL OR CAST({c} AS DOUBLE) IN (0.0, 1.0)), true) AS is_binary "
            f"FROM ({Q.LABELED_SQL})"
            for c in ["quality", "toxic"]
        ),
        "prototype_quality": _prototype_issues_sql(),
        "pipeline_truth_table": Q.truth_table_sql(
            Q.tfidf_scores_sql(Q.DL_SQL, R.DL_PROTOTYPES, "t.case_id, t.outcome"), R.DL_CONDITIONS, DL_THRESHOLD
        ),
    }


def _label_issues_sql() -> str:
    few = "printf('''flag'' has %d rows labelled 1 and %d labelled 0: too few for steady predictions.', pos, n - pos)"
    return f"""
WITH d AS ({Q.LABELED_SQL}),
a AS (SELECT count_if(case_id % 10 = 0 OR trim(regexp_replace(text, '\\s+', ' ', 'g')) IN ('', 'nan', 'None')) AS blank, count(*) AS n,
             CAST(sum(toxic) AS BIGINT) AS pos, CAST(max(case_id % 3) AS VARCHAR) AS worst FROM d)
SELECT 'binary_labels' AS "check", 'thirds' AS "column", 'error' AS severity, 'Labels of ''thirds'' are neither 0 nor 1: ' || worst || '.' AS message FROM a
UNION ALL SELECT 'positives', 'never', 'error', 'No row is labelled 1 for ''never'', so nothing can be learnt.'
UNION ALL SELECT 'few_examples', 'flag', 'warning', {few} FROM a WHERE (pos > 0 AND pos < 3) OR (n - pos > 0 AND n - pos < 3)
UNION ALL SELECT 'positives', 'flag', 'error', 'No row is labelled 1 for ''flag'', so nothing can be learnt.' FROM a WHERE pos = 0
UNION ALL SELECT 'label_column', 'absent', 'error', 'There is no label column ''absent''.'
UNION ALL SELECT 'empty_text', 'text', 'warning', printf('%d rows have no text.', blank) FROM a WHERE blank > 0"""


def _label_report_sql(conds: list[str]) -> str:
    aggs = ", ".join(
        f"COALESCE(bool_and({c} IS NULL OR CAST({c} AS DOUBLE) IN (0.0, 1.0)), true) AS ok_{c}, "
        f"CAST(SUM(COALESCE({c}, 0)) AS BIGINT) AS pos_{c}"
        for c in conds
    )
    rows = []
    for i, c in enumerate(conds):
        neg = f"(n - pos_{c})"
        rows += [
            (f"NOT ok_{c}", "binary_labels", c, "error", f"'Labels of ''{c}'' are neither 0 nor 1.'"),
            (f"ok_{c} AND pos_{c} = 0", "positives", c, "error",
             f"'No row is labelled 1 for ''{c}'', so nothing can be learnt.'"),
            (f"ok_{c} AND {neg} = 0", "negatives", c, "error",
             f"'No row is labelled 0 for ''{c}'', so nothing can be learnt.'"),
            (f"ok_{c} AND ((pos_{c} > 0 AND pos_{c} < 3) OR ({neg} > 0 AND {neg} < 3))", "few_examples", c, "warning",
             f"printf('''{c}'' has %d rows labelled 1 and %d labelled 0: too few for steady predictions.', pos_{c}, {neg})"),
        ]
    rows.append(("blank > 0", "empty_text", "text", "warning", "printf('%d rows have no text.', blank)"))
    sel = "\n  UNION ALL ".join(
        f"SELECT {i} AS o, '{chk}' AS \"check\", '{col}' AS \"column\", '{sev}' AS severity, {msg} AS message FROM a WHERE {cond}"
        for i, (cond, chk, col, sev, msg) in enumerate(rows)
    )
    return f"""
WITH a AS (SELECT COUNT(*) AS n,
                  count_if(text IS NULL OR trim(regexp_replace(text, '\\s+', ' ', 'g')) IN ('', 'nan', 'None')) AS blank,
                  {aggs}
           FROM ({Q.LABELED_SQL})),
i AS ({sel})
SELECT "check", "column", severity, message FROM i
UNION ALL
SELECT 'labeled_data', NULL, 'pass', 'Nothing to object to.' WHERE (SELECT COUNT(*) FROM i) = 0"""


def _prototype_issues_sql() -> str:
    words = "len(list_filter(regexp_split_to_array(prototype, '\\s+'), lambda w: w <> ''))"
    blank = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g')) IN ('', 'nan', 'None')"
    return f"""
WITH p AS (SELECT 'topic' || CAST(item_id % 16 AS VARCHAR) AS condition_name,
                  COALESCE(text, 'nan') AS prototype,
                  CASE WHEN item_id % 4 = 3 THEN 'outcome' ELSE 'condition' END AS type
           FROM benchmark),
c AS (SELECT count_if(type = 'condition') AS nc, count_if(type = 'outcome') AS no FROM p)
SELECT 'empty_value' AS "check", 'condition_name' AS "column", 'error' AS severity, condition_name AS item,
       '''condition_name'' is empty.' AS message FROM p WHERE {blank('condition_name')}
UNION ALL SELECT 'empty_value', 'prototype', 'error', condition_name, '''prototype'' is empty.'
  FROM p WHERE {blank('prototype')}
UNION ALL SELECT 'empty_value', 'type', 'error', condition_name, '''type'' is empty.'
  FROM p WHERE {blank('type')}
UNION ALL SELECT 'duplicate_condition_name', 'condition_name', 'error', condition_name,
       printf('''%s'' names %d rows; only the last would be used.', condition_name, COUNT(*))
  FROM p GROUP BY condition_name HAVING COUNT(*) > 1
UNION ALL SELECT DISTINCT 'invalid_type', 'type', 'error', type,
       printf('''%s'' is no type; a row is of type ''condition'' or ''outcome''.', type)
  FROM p WHERE type NOT IN ('condition', 'outcome')
UNION ALL SELECT 'no_condition_prototype', 'type', 'error', NULL,
       'No row is of type ''condition'', so nothing can be scored.' FROM c WHERE nc = 0
UNION ALL SELECT 'short_prototype', 'prototype', 'warning', condition_name,
       printf('The prototype of ''%s'' has only %d words; scores may be unsteady.', condition_name, {words})
  FROM p WHERE {words} < 5
UNION ALL SELECT 'long_prototype', 'prototype', 'warning', condition_name,
       printf('The prototype of ''%s'' has %d words; it may mix several concepts.', condition_name, {words})
  FROM p WHERE {words} > 80
UNION ALL SELECT 'outcome_prototype_notice', 'type', 'info', NULL,
       printf('%d rows are of type ''outcome''; they are not scored unless asked for.', no) FROM c WHERE no > 0"""
