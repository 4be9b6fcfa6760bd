"""Truth tables at every distinct score, by an event sweep.

A case changes its configuration only at its own scores: at a threshold up to a score the condition holds, above it no
longer. So a case is one event per distinct score (it leaves a configuration and enters another) and one at the start,
whatever the number of thresholds. Events of one score and configuration add up in every task; running sums over the
scores give the cases of each configuration between two of its events, and only there rows are made for the thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.calibration import clean_score
from ..functions.names import col
from ..session import stored
from .columns import condition_name, score_columns
from .running import running
from .truth_table import finish_truth_table

#: Thresholds that one generated array holds.
BLOCK = 10_000


def _events(scores: DataFrame, score_cols: list[str], conditions: list[str], outcome: str) -> DataFrame:
    """(_v, conditions, n_cases, outcome_positive_cases): what changes above the threshold _v (null: at the start)."""
    o = col(outcome)
    known = F.when(o.isNotNull() & ~o.isin(0, 1), F.raise_error(F.lit("the outcome must be 0 or 1 (or missing), but holds another value."))).otherwise(F.coalesce(o, F.lit(0)))
    rows = scores.select(*[clean_score(c).alias(f"_s{j}") for j, c in enumerate(score_cols)], known.cast("long").alias("_o"))
    s = [F.col(f"_s{j}") for j in range(len(score_cols))]

    def event(v, sign: int, held) -> Column:
        return F.struct(v.alias("v"), F.lit(sign).alias("sign"), *[F.when(x.isNotNull(), held(x).cast("int")).alias(f"c{j}") for j, x in enumerate(s)])

    made = [event(F.lit(None).cast("double"), 1, lambda x: F.lit(1))]
    for j, v in enumerate(s):
        fresh = v.isNotNull()
        for earlier in s[:j]:
            fresh &= ~earlier.eqNullSafe(v)
        for sign, held in ((-1, lambda x, v=v: x >= v), (1, lambda x, v=v: x > v)):
            made.append(F.when(fresh, event(v, sign, held)))
    each = rows.select("_o", F.explode(F.array(*made)).alias("e")).filter(F.col("e").isNotNull())
    keyed = each.select(F.col("e.v").alias("_v"), *[F.col(f"e.c{j}").alias(c) for j, c in enumerate(conditions)], F.col("e.sign").cast("long").alias("_n"), (F.col("e.sign") * F.col("_o")).alias("_p"))
    sums = keyed.groupBy("_v", *[col(c) for c in conditions]).agg(F.sum("_n").alias("n_cases"), F.sum("_p").alias("outcome_positive_cases"))
    return sums.filter((F.col("n_cases") != 0) | (F.col("outcome_positive_cases") != 0))


def every_threshold(
    scores: DataFrame,
    outcome: str = "outcome",
    consistency_cutoff: float = K.DEFAULT_CONSISTENCY_CUTOFF,
    min_cases: int = K.DEFAULT_MIN_CASES,
    contradiction_lower: float = K.DEFAULT_CONTRADICTION_LOWER,
    contradiction_upper: float = K.DEFAULT_CONTRADICTION_UPPER,
    validate: bool = True,
    sort: bool = True,
) -> DataFrame:
    """Truth table at every distinct score as threshold, ``threshold`` first: the rows of
    :func:`.thresholds.sensitivity_detail` over that grid.

    Missing scores raise with ``validate``, else rows that have one count in the grand total only. No scores, no rows.
    """
    score_cols = score_columns(scores)
    conditions = [condition_name(c) for c in score_cols]
    events = stored(_events(scores, score_cols, conditions, outcome), "sweep-events")
    grid = events.filter(F.col("_v").isNotNull()).select("_v").distinct().withColumn("_i", F.lit(1).cast("long"))
    grid = stored(running(stored(grid, "sweep-values"), [], "_v", ["_i"], "sweep-sorted").select("_v", "_i"), "sweep-grid")
    n = grid.count()
    numbered = events.join(grid, "_v", "left").withColumn("_i", F.coalesce("_i", F.lit(0).cast("long"))).drop("_v")
    states = running(stored(numbered, "sweep-numbered"), conditions, "_i", ["n_cases", "outcome_positive_cases"], "sweep-ordered")
    # above its event a state holds up to the threshold of the next one
    spans = states.filter("n_cases > 0").withColumn("_lo", F.col("_i") + 1).withColumn("_hi", F.coalesce("_next", F.lit(n).cast("long"))).filter("_lo <= _hi").drop("_i", "_next")
    blocks = spans.withColumn("_lo", F.explode(F.sequence("_lo", "_hi", F.lit(BLOCK).cast("long"))))
    held = blocks.withColumn("_i", F.explode(F.sequence("_lo", F.least(F.col("_hi"), F.col("_lo") + (BLOCK - 1))))).drop("_lo", "_hi")
    grouped = held.join(grid, "_i").withColumnRenamed("_v", "threshold").drop("_i").withColumn("_bad_outcome", F.lit(False))
    return finish_truth_table(
        grouped, conditions, by=["threshold"], consistency_cutoff=consistency_cutoff, min_cases=min_cases,
        contradiction_lower=contradiction_lower, contradiction_upper=contradiction_upper, validate=validate, sort=sort,
    )
