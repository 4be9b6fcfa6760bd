"""Column expressions for configuration labels, statuses and generated sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import col
from .. import constants as K


def configuration_label(conditions: list[str]) -> Column:
    """``a * ~b * c``: the condition name when its value is 1, ``~name`` otherwise."""
    parts = [
        F.when(col(c) == 1, F.lit(c)).otherwise(F.lit("~" + c)) for c in conditions
    ]
    return F.concat_ws(" * ", *parts)


def status(
    consistency: Column,
    n_cases: Column,
    cutoff: float,
    min_cases: int,
    lower: float,
    upper: float,
) -> Column:
    """sufficient, then the contradictory band, else weak (on the unrounded consistency)."""
    return (
        F.when((consistency >= F.lit(cutoff)) & (n_cases >= F.lit(min_cases)), F.lit(K.STATUS_SUFFICIENT))
        .when(consistency.between(F.lit(lower), F.lit(upper)), F.lit(K.STATUS_CONTRADICTORY))
        .otherwise(F.lit(K.STATUS_WEAK))
    )


def solution_sentence(configuration: Column, positives: Column, n_cases: Column) -> Column:
    return F.format_string(K.SOLUTION_SENTENCE, configuration, positives, n_cases)
