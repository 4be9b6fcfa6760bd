"""Column expressions that turn raw scores into set membership.

Every function here returns a ``Column``; nothing triggers a job. A missing
score (NULL or NaN) stays missing: Spark treats ``NaN >= t`` as true, so NaN is
mapped to NULL before any comparison.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import col

def clean_score(score: Column | str) -> Column:
    """Cast to double and turn NaN into NULL."""
    s = col(score) if isinstance(score, str) else score
    s = s.cast("double")
    return F.when(F.isnan(s), F.lit(None).cast("double")).otherwise(s)


def check_anchors(full_out: float, crossover: float, full_in: float) -> None:
    """Anchors must be strictly increasing; checked on the driver at plan time."""
    if not (full_out < crossover < full_in):
        raise ValueError(f"anchors must ascend: {full_out}, {crossover}, {full_in}")


def fuzzy_membership(score: Column | str, full_out: float, crossover: float, full_in: float) -> Column:
    """Three-anchor piecewise linear membership in [0, 1].

    score <= full_out -> 0, score >= full_in -> 1, below the crossover the line
    runs from 0 to 0.5, above it from 0.5 to 1.
    """
    check_anchors(full_out, crossover, full_in)
    s = clean_score(score)
    low = F.lit(0.5) * (s - F.lit(full_out)) / F.lit(crossover - full_out)
    high = F.lit(0.5) + F.lit(0.5) * (s - F.lit(crossover)) / F.lit(full_in - crossover)
    return (
        F.when(s.isNull(), F.lit(None).cast("double"))
        .when(s <= F.lit(full_out), F.lit(0.0))
        .when(s >= F.lit(full_in), F.lit(1.0))
        .when(s < F.lit(crossover), low)
        .otherwise(high)
    )


def crisp_membership(score: Column | str, threshold: float | Column) -> Column:
    """1 when score >= threshold, 0 below it, NULL when the score is missing."""
    s = clean_score(score)
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(s.isNull(), F.lit(None).cast("int")).otherwise((s >= t).cast("int"))


def threshold_level(score: Column | str, thresholds: list[float]) -> Column:
    """Number of (sorted) thresholds at or below the score; NULL when missing.

    With sorted thresholds t_0 < ... < t_{k-1}, ``score >= t_j`` exactly when
    ``level > j``: one small integer per row carries the crisp value for every
    threshold of a grid.
    """
    s = clean_score(score)
    level = sum((s >= F.lit(float(t))).cast("int") for t in thresholds)
    return F.when(s.isNull(), F.lit(None).cast("int")).otherwise(level)
