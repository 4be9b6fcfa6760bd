"""Calibration of score tables (one projection) and the QCA-ready projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import col
from .. import constants as K
from ..functions.calibration import check_anchors, crisp_membership, fuzzy_membership
from .columns import check_new_names, condition_name, score_columns


def calibrate(
    scores: DataFrame,
    method: str = "fuzzy",
    full_out: float = K.DEFAULT_FULL_OUT,
    crossover: float = K.DEFAULT_CROSSOVER,
    full_in: float = K.DEFAULT_FULL_IN,
    threshold: float = K.DEFAULT_CRISP_THRESHOLD,
    keep_score_columns: bool = True,
    protected: tuple[str, ...] = ("case_id", "text", "outcome"),
) -> DataFrame:
    """Add one membership column ``<condition>`` per ``<condition>_score`` column.

    ``fuzzy`` gives doubles in [0, 1], ``crisp`` gives ints 0/1; a missing score stays
    missing. All columns are added in a single projection (narrow, no shuffle).
    """
    if method not in ("fuzzy", "crisp"):
        raise ValueError(f"unknown calibration '{method}': it is 'fuzzy' or 'crisp'")
    if method == "fuzzy":
        check_anchors(full_out, crossover, full_in)
    cols = score_columns(scores)
    names = [condition_name(c) for c in cols]
    check_new_names(scores, names, [p for p in protected if p in scores.columns] + cols)
    if method == "fuzzy":
        new = {n: fuzzy_membership(c, full_out, crossover, full_in) for n, c in zip(names, cols)}
    else:
        new = {n: crisp_membership(c, threshold) for n, c in zip(names, cols)}
    out = scores.withColumns(new)
    if not keep_score_columns:
        out = out.drop(*cols)
    return out


def qca_ready(
    calibrated: DataFrame,
    conditions: list[str] | None = None,
    outcome: str = "outcome",
    case_id: str = "case_id",
) -> DataFrame:
    """id (when present), the condition columns in order, then the outcome.

    Conditions default to the names derived from the ``_score`` columns; any other
    extra column is dropped rather than treated as a condition.
    """
    if outcome not in calibrated.columns:
        raise ValueError(f"no outcome column '{outcome}'")
    if conditions is None:
        conditions = [condition_name(c) for c in score_columns(calibrated)]
    missing = [c for c in conditions if c not in calibrated.columns]
    if missing:
        raise ValueError(f"Condition columns not found: {missing}")
    cols = ([case_id] if case_id in calibrated.columns else []) + list(conditions) + [outcome]
    return calibrated.select(*[col(c) for c in cols])
