"""Streaming use of the row-wise operators.

The method itself has no streaming part (no windows, watermarks or state). Its
row-wise operators -- calibration, top-two ranking, confidence, term extraction,
prototype cosine against a broadcast prototype row -- contain no aggregate and no
action, so they apply unchanged to a streaming DataFrame. Aggregating operators
(truth tables, quantiles, TF-IDF vocabularies) are batch operators: run them on the
tables a stream writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.calibrate import calibrate
from ..operators.explain import with_confidence


def membership_stream(scores: DataFrame, method: str = "crisp", **calibration) -> DataFrame:
    """Calibrated membership plus the top-two / confidence columns, row by row."""
    if not scores.isStreaming:
        raise ValueError("expected a streaming DataFrame (spark.readStream...)")
    return with_confidence(calibrate(scores, method=method, **calibration))
