"""Tables a chart can read directly (figure rendering itself is not part of the library).

- score_long: one row per (case, condition) score, for a distribution plot;
- score_box: per condition the five numbers of a box plot (exact quantiles);
- score_whiskers, score_points: its fences, whiskers and exact outlier counts, and a repeatable sample of its points;
- membership_matrix / membership_bins: the heat-map data, and its scalable summary;
- coverage_points: consistency against coverage per configuration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calibration import clean_score
from ..functions.names import col
from .columns import condition_name, require_columns, score_columns
from .thresholds import score_quantiles


def score_long(scores: DataFrame, id_cols: tuple[str, ...] = ("case_id", "outcome")) -> DataFrame:
    """id columns present, ``condition`` and ``similarity_score`` (narrow unpivot)."""
    ids = [c for c in id_cols if c in scores.columns]
    cols = score_columns(scores)
    pairs = F.explode(
        F.array(*[F.struct(F.lit(condition_name(c)).alias("condition"), col(c).cast("double").alias("similarity_score")) for c in cols])
    )
    return scores.select(*ids, pairs.alias("_p")).select(*ids, "_p.condition", "_p.similarity_score")


def score_box(scores: DataFrame, found: dict | None = None) -> DataFrame:
    """condition, n, min, q1, median, q3, max of the non-missing scores of each condition (``found``: from
    :func:`.thresholds.score_quantiles`)."""
    names = [condition_name(c) for c in score_columns(scores)]
    q = found or score_quantiles(scores, pooled=False)
    rows = []
    for name in names:
        if name not in q:
            rows.append((name, 0, None, None, None, None, None))
        else:
            r = q[name]
            rows.append((name, r["n"], r[0.0], r[0.25], r[0.5], r[0.75], r[1.0]))
    return scores.sparkSession.createDataFrame(
        rows, "condition string, n long, min double, q1 double, median double, q3 double, max double"
    )


def score_whiskers(scores: DataFrame, found: dict | None = None, reach: float = 1.5) -> DataFrame:
    """condition, n, q1, median, q3, lower_fence, upper_fence (``reach`` times the box beyond it), whisker_low,
    whisker_high (the outermost scores inside the fences), n_below, n_above (scores outside): one aggregate over the scores
    once the quartiles are known. A condition without scores has n = 0 and nulls."""
    cols = score_columns(scores)
    box = score_box(scores, found).withColumn("_reach", reach * (F.col("q3") - F.col("q1")))
    fences = box.select("condition", "n", "q1", "median", "q3", (F.col("q1") - F.col("_reach")).alias("lower_fence"), (F.col("q3") + F.col("_reach")).alias("upper_fence"))
    known = {r["condition"]: (r["lower_fence"], r["upper_fence"]) for r in fences.collect()}  # a row a condition
    aggs = []
    for j, c in enumerate(cols):
        low, high = (F.lit(x).cast("double") for x in known[condition_name(c)])
        s = clean_score(c)
        aggs += [F.min(F.when(s >= low, s)).alias(f"a{j}"), F.max(F.when(s <= high, s)).alias(f"b{j}"), F.count_if(s < low).alias(f"c{j}"), F.count_if(s > high).alias(f"d{j}")]
    per = [F.struct(F.lit(condition_name(c)).alias("condition"), F.col(f"a{j}").alias("whisker_low"), F.col(f"b{j}").alias("whisker_high"), F.col(f"c{j}").alias("n_below"), F.col(f"d{j}").alias("n_above")) for j, c in enumerate(cols)]
    ends = scores.agg(*aggs).select(F.explode(F.array(*per)).alias("x")).select("x.*")
    return fences.join(ends, "condition")


def score_points(scores: DataFrame, points: int = 1000, case_id: str = "case_id", found: dict | None = None) -> DataFrame:
    """condition, case id, similarity_score, outlier: the points that a box plot shows. Of each condition the ``points``
    cases with the least hash of condition and id, the same in every run; a sample is the feature here, the exact numbers
    of outliers are in :func:`score_whiskers`. Every task passes on at most ``points`` rows of a condition."""
    fences = score_whiskers(scores, found).select("condition", "lower_fence", "upper_fence")
    long = score_long(scores, (case_id,)).withColumn("similarity_score", clean_score("similarity_score")).filter(F.col("similarity_score").isNotNull())
    h = F.md5(F.concat_ws(":", F.col("condition"), col(case_id).cast("string")))
    first = Window.partitionBy("condition").orderBy("_h", "similarity_score")
    few = long.withColumn("_h", h).withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= points)
    outside = ~F.col("similarity_score").between(F.col("lower_fence"), F.col("upper_fence"))
    return few.join(F.broadcast(fences), "condition").select("condition", col(case_id), "similarity_score", outside.alias("outlier"))


def membership_matrix(membership: DataFrame, conditions: list[str], case_id: str = "case_id") -> DataFrame:
    """Case id (as text) and the membership columns; raise when no condition is given."""
    if not conditions:
        raise ValueError("a membership matrix needs at least one condition")
    require_columns(membership, conditions, "membership table")
    cid = col(case_id).cast("string") if case_id in membership.columns else F.monotonically_increasing_id().cast("string")
    return membership.select(cid.alias(case_id), *[col(c) for c in conditions])


def membership_bins(membership: DataFrame, conditions: list[str], bins: int = 10) -> DataFrame:
    """Counts of membership values per condition in ``bins`` equal bins over [0, 1].

    This is what a heat map of millions of cases can show; one partial aggregate.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), col(c).cast("double").alias("v")) for c in conditions]))
    long = membership.select(pairs.alias("p")).select("p.condition", "p.v").filter(F.col("v").isNotNull())
    b = F.least(F.greatest(F.floor(F.col("v") * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return (
        long.groupBy("condition", b.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n_cases"))
        .select("condition", "bin", (F.col("bin") / bins).alias("bin_low"), ((F.col("bin") + 1) / bins).alias("bin_high"), "n_cases")
        .orderBy("condition", "bin")
    )


def coverage_points(tt: DataFrame) -> DataFrame:
    """configuration, consistency, raw_coverage, n_cases, status of a truth table."""
    cols = ["configuration", "consistency", "raw_coverage", "n_cases", "status"]
    require_columns(tt, cols, "truth table")
    return tt.select(*cols)
