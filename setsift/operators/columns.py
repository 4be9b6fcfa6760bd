"""Column roles, detection and driver-side checks (metadata only, no Spark job)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

SCORE_SUFFIX = "_score"


def require_columns(df: DataFrame, columns: list[str], what: str = "input") -> None:
    """Raise naming the first missing column."""
    have = set(df.columns)
    for c in columns:
        if c not in have:
            raise ValueError(f"Missing required column in {what}: {c}")


def score_columns(df: DataFrame) -> list[str]:
    """Columns ending in ``_score``, in table order; raise when there is none."""
    cols = [c for c in df.columns if c.endswith(SCORE_SUFFIX)]
    if not cols:
        raise ValueError("no column ends with '_score'")
    return cols


def condition_name(score_column: str) -> str:
    """Condition name of a score column: every occurrence of ``_score`` is removed."""
    return score_column.replace(SCORE_SUFFIX, "")


def condition_columns(df: DataFrame, case_id: str = "case_id", outcome: str = "outcome") -> list[str]:
    """All columns but the id and the outcome; raise when none is left."""
    cols = [c for c in df.columns if c not in (case_id, outcome)]
    if not cols:
        raise ValueError("no column is left to be a condition")
    return cols


def check_new_names(df: DataFrame, names: list[str], protected: list[str]) -> None:
    """Refuse to silently overwrite an id/text/outcome column with a condition."""
    clash = [n for n in names if n in protected]
    if clash:
        raise ValueError(f"Condition name collides with a protected column: {clash}")
    if len(set(names)) != len(names):
        raise ValueError(f"Duplicate condition names: {names}")


def parse_threshold_grid(text: str) -> list[float]:
    """``"0.3, 0.25,0.3"`` -> ``[0.25, 0.3]``: the distinct numbers of a comma list, ascending; all from 0 to 1."""
    grid: set[float] = set()
    for item in filter(None, map(str.strip, str(text).split(","))):
        number = float(item) if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", item) else -1.0
        if not 0 <= number <= 1:
            raise ValueError(f"'{item}' is no crisp threshold: give numbers from 0 to 1, separated by commas")
        grid.add(number)
    if not grid:
        raise ValueError("the list of crisp thresholds holds no number")
    return sorted(grid)
