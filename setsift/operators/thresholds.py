"""Threshold suggestions, score summaries and threshold-sensitivity analysis.

Sensitivity over a grid of T crisp thresholds is computed in one scan. Each score is
mapped to its *level* (how many grid thresholds lie at or below it); membership at the
j-th threshold is then ``level > j``. Rows are aggregated once by the levels (at most
(T+1)^m groups, partial aggregation in every task), and only those aggregated groups
are expanded over the grid and re-aggregated per (threshold, configuration).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import col
from .. import constants as K
from ..functions.calibration import threshold_level
from ..session import stored
from .columns import condition_name, require_columns, score_columns
from .quantiles import approx_quantiles, grouped_quantiles
from .truth_table import finish_truth_table, solutions

BOX_PROBS = [0.0, 0.25, 0.5, 0.75, 1.0]


def _long(scores: DataFrame, pooled: bool, single: bool) -> DataFrame:
    """(condition, value) of all scores: under their condition, under null for all conditions together, or both."""
    cols = score_columns(scores)
    items = []
    for c in cols:
        names = ([F.lit(condition_name(c))] if single else []) + ([F.lit("")] if pooled else [])
        items += [F.struct(n.alias("condition"), col(c).cast("double").alias("value")) for n in names]
    return scores.select(F.explode(F.array(*items)).alias("_p")).select("_p.condition", "_p.value")


def score_quantiles(scores: DataFrame, pooled: bool = True, single: bool = True) -> dict:
    """{condition: {prob: value, "n": n}} for the box numbers of each condition and, under the empty name, for the
    suggestions and the summary over all conditions: one selection, from which all three tables can be made."""
    probs = (BOX_PROBS if single else []) + ([p for _, p, _ in K.THRESHOLD_RULES] + [p for _, p in K.SUMMARY_STATISTICS] if pooled else [])
    return grouped_quantiles(_long(scores, pooled, single), "condition", "value", sorted(set(probs)))


def _pooled(scores: DataFrame, approx: bool, probs: list[float], found: dict | None) -> dict:
    if approx:
        return approx_quantiles(_long(scores, True, False), "value", probs)
    q = (found or score_quantiles(scores, single=False)).get("")
    if q is None:
        raise ValueError("there is no score that is neither null nor NaN")
    return q


def suggest_thresholds(scores: DataFrame, approx: bool = False, found: dict | None = None) -> DataFrame:
    """Three candidate crisp thresholds from quantiles .75 / .60 / .50 of pooled scores (``found``: from
    :func:`score_quantiles`)."""
    q = _pooled(scores, approx, [p for _, p, _ in K.THRESHOLD_RULES], found)
    rows = [(rule, float(q[p]), text) for rule, p, text in K.THRESHOLD_RULES]
    df = scores.sparkSession.createDataFrame(rows, "rule string, suggested_threshold double, interpretation string")
    return df.withColumn("suggested_threshold", F.bround("suggested_threshold", 4))


def score_summary(scores: DataFrame, approx: bool = False, found: dict | None = None) -> DataFrame:
    """Minimum, quartile, median, 60th and 75th percentile and maximum of pooled scores."""
    q = _pooled(scores, approx, [p for _, p in K.SUMMARY_STATISTICS], found)
    rows = [(name, float(q[p])) for name, p in K.SUMMARY_STATISTICS]
    return scores.sparkSession.createDataFrame(rows, "statistic string, value double").withColumn("value", F.bround("value", 4))


def _grouped_over_grid(scores: DataFrame, score_cols: list[str], conditions: list[str], grid: list[float], outcome: str) -> DataFrame:
    o = col(outcome)
    lv = scores.select(*[threshold_level(x, grid).alias(c) for x, c in zip(score_cols, conditions)], o.alias("_outcome"))
    o = F.col("_outcome")
    lv = lv.groupBy(*[col(c) for c in conditions]).agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.coalesce(F.sum(o.cast("long")), F.lit(0).cast("long")).alias("outcome_positive_cases"),
        F.max(o.isNotNull() & ~o.isin(0, 1)).alias("_bad_outcome"),
    )
    steps = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(t)).alias("t")) for j, t in enumerate(grid)]))
    expanded = lv.select(steps.alias("_g"), *[col(c) for c in conditions], "n_cases", "outcome_positive_cases", "_bad_outcome").select(
        F.col("_g.t").alias("threshold"),
        *[F.when(col(c).isNull(), F.lit(None).cast("int")).otherwise((col(c) > F.col("_g.j")).cast("int")).alias(c) for c in conditions],
        "n_cases",
        "outcome_positive_cases",
        "_bad_outcome",
    )
    return expanded.groupBy("threshold", *[col(c) for c in conditions]).agg(
        F.sum("n_cases").alias("n_cases"),
        F.sum("outcome_positive_cases").alias("outcome_positive_cases"),
        F.max("_bad_outcome").alias("_bad_outcome"),
    )


def sensitivity_detail(
    scores: DataFrame,
    thresholds: list[float] | None = None,
    outcome: str = "outcome",
    consistency_cutoff: float = K.DEFAULT_CONSISTENCY_CUTOFF,
    min_cases: int = K.DEFAULT_MIN_CASES,
    contradiction_lower: float = K.DEFAULT_CONTRADICTION_LOWER,
    contradiction_upper: float = K.DEFAULT_CONTRADICTION_UPPER,
    validate: bool = True,
    sort: bool = True,
) -> DataFrame:
    """Truth table at every threshold of the grid, ``threshold`` first (one scan)."""
    grid = sorted(set(float(t) for t in (thresholds or K.DEFAULT_THRESHOLD_GRID)))
    score_cols = score_columns(scores)
    conditions = [condition_name(c) for c in score_cols]
    grouped = _grouped_over_grid(scores, score_cols, conditions, grid, outcome)
    return finish_truth_table(
        grouped,
        conditions,
        by=["threshold"],
        consistency_cutoff=consistency_cutoff,
        min_cases=min_cases,
        contradiction_lower=contradiction_lower,
        contradiction_upper=contradiction_upper,
        validate=validate,
        sort=sort,
    )


def exact_mean4(x: Column) -> Column:
    """Mean of values with at most 4 decimals, rounded half-even to 4 places, exactly.

    The sum is taken over integers (x * 10^4), so the result does not depend on the
    order in which rows arrive.
    """
    scaled = F.bround(x * F.lit(10000.0), 0).cast("long")
    return F.bround(F.sum(scaled) / F.count(x), 0) / F.lit(10000.0)


def _count_status(s: str) -> Column:
    return F.count_if(F.col("status") == F.lit(s)).cast("int")


def sensitivity_summary(detail: DataFrame) -> DataFrame:
    """One row per threshold: configuration counts by status and consistency/coverage stats."""
    return (
        detail.groupBy("threshold")
        .agg(
            F.count(F.lit(1)).cast("int").alias("n_configurations"),
            _count_status(K.STATUS_SUFFICIENT).alias("n_sufficient"),
            _count_status(K.STATUS_CONTRADICTORY).alias("n_contradictory"),
            _count_status(K.STATUS_WEAK).alias("n_weak"),
            exact_mean4(F.col("consistency")).alias("mean_consistency"),
            F.max("consistency").alias("max_consistency"),
            exact_mean4(F.col("raw_coverage")).alias("mean_raw_coverage"),
            F.max("raw_coverage").alias("max_raw_coverage"),
            F.sum("n_cases").alias("total_cases_in_truth_table"),
        )
        .orderBy("threshold")
    )


def sensitivity_solutions(
    detail: DataFrame, conditions: list[str], consistency_cutoff: float = K.DEFAULT_CONSISTENCY_CUTOFF,
    min_cases: int = K.DEFAULT_MIN_CASES,
) -> DataFrame:
    """Solutions per threshold, numbered from 1 within each threshold."""
    return solutions(detail, consistency_cutoff, min_cases, conditions=conditions, partition_by=["threshold"])


def _thresholds_where(cond: Column | None) -> Column:
    t = F.col("threshold") if cond is None else F.when(cond, F.col("threshold"))
    return F.sort_array(F.collect_set(t))


def configuration_stability(detail: DataFrame) -> DataFrame:
    """Per configuration: at which thresholds it is observed / sufficient / contradictory / weak.

    Groups hold at most one row per threshold, so the threshold lists are bounded by
    the grid size.
    """
    require_columns(detail, ["threshold", "configuration", "status", "consistency", "raw_coverage", "n_cases"], "detail of the thresholds")
    st = F.col("status")
    g = detail.groupBy("configuration").agg(
        _thresholds_where(None).alias("_obs"),
        _thresholds_where(st == F.lit(K.STATUS_SUFFICIENT)).alias("_suf"),
        _thresholds_where(st == F.lit(K.STATUS_CONTRADICTORY)).alias("_con"),
        _thresholds_where(st == F.lit(K.STATUS_WEAK)).alias("_weak"),
        exact_mean4(F.col("consistency")).alias("mean_consistency"),
        exact_mean4(F.col("raw_coverage")).alias("mean_raw_coverage"),
        exact_mean4(F.col("n_cases")).alias("mean_n_cases"),
    )

    def joined(c: str) -> Column:
        return F.array_join(F.transform(col(c), lambda x: x.cast("string")), ", ")

    return g.select(
        "configuration",
        F.size("_obs").alias("n_thresholds_observed"),
        F.size("_suf").alias("n_thresholds_sufficient"),
        F.size("_con").alias("n_thresholds_contradictory"),
        F.size("_weak").alias("n_thresholds_weak"),
        joined("_obs").alias("thresholds_observed"),
        joined("_suf").alias("sufficient_thresholds"),
        joined("_con").alias("contradictory_thresholds"),
        joined("_weak").alias("weak_thresholds"),
        "mean_consistency",
        "mean_raw_coverage",
        "mean_n_cases",
    ).orderBy(
        F.col("n_thresholds_sufficient").desc(),
        F.col("mean_consistency").desc(),
        F.col("mean_raw_coverage").desc(),
        F.col("configuration").asc(),
    )


def threshold_sensitivity(
    scores: DataFrame,
    thresholds: list[float] | None = None,
    outcome: str = "outcome",
    consistency_cutoff: float = K.DEFAULT_CONSISTENCY_CUTOFF,
    min_cases: int = K.DEFAULT_MIN_CASES,
    contradiction_lower: float = K.DEFAULT_CONTRADICTION_LOWER,
    contradiction_upper: float = K.DEFAULT_CONTRADICTION_UPPER,
) -> dict[str, DataFrame]:
    """summary, detail, solutions and stability over the threshold grid .

    The detail has at most T * 2^m rows; it is written to the shared folder, so that the tables built from it read the
    scores once between them and nothing stays cached.
    """
    detail = sensitivity_detail(scores, thresholds, outcome, consistency_cutoff, min_cases, contradiction_lower, contradiction_upper)
    detail = stored(detail.coalesce(1), "sensitivity-detail")
    conditions = [condition_name(c) for c in score_columns(scores)]
    return {
        "summary": sensitivity_summary(detail),
        "detail": detail,
        "solutions": sensitivity_solutions(detail, conditions, consistency_cutoff, min_cases),
        "stability": configuration_stability(detail),
    }
