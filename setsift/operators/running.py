"""Distributed running sums: no group is ordered or summed in one task.

The rows are dealt to ranges of (group, order) and written. What a range has of each group is one row of totals, and a
window over these (a group has at most one for each range) gives every range its start; inside a range a window runs over
that range's rows only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import col
from ..session import stored

#: Rows of one range.
ROWS = 1_000_000


def running(rows: DataFrame, group: list[str], order: str, sums: list[str], name: str) -> DataFrame:
    """``rows`` with each column of ``sums`` replaced by its sum over the group's rows up to this one (by ``order``), and
    ``_next``: the ``order`` of the group's next row, null for its last. Rows of one group with equal ``order`` are taken
    in any order. Missing group values are a group."""
    parts = max(1, math.ceil(rows.count() / ROWS))
    keys = [col(c).asc_nulls_first() for c in [*group, order]]
    dealt = stored(rows.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), name)
    totals = dealt.groupBy(*[col(c) for c in group], "_part").agg(F.min(col(order)).alias("_first"), *[F.sum(col(c)).alias(f"_t{k}") for k, c in enumerate(sums)])
    ranges = Window.partitionBy(*[col(c) for c in group]).orderBy("_part")
    starts = totals.select(
        *[col(c).alias(f"_g{j}") for j, c in enumerate(group)],
        F.col("_part").alias("_p"),
        F.lead("_first").over(ranges).alias("_follow"),
        *[(F.sum(f"_t{k}").over(ranges) - F.col(f"_t{k}")).alias(f"_b{k}") for k in range(len(sums))],
    )
    same = F.col("_part") == F.col("_p")
    for j, c in enumerate(group):
        same &= col(c).eqNullSafe(F.col(f"_g{j}"))
    own = Window.partitionBy(*[col(c) for c in group], "_part").orderBy(col(order).asc_nulls_first())
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    changed = {c: F.col(f"_b{k}") + F.sum(col(c)).over(upto) for k, c in enumerate(sums)}
    out = dealt.join(starts, same)
    return out.select(*[(changed[c] if c in changed else col(c)).alias(c) for c in rows.columns], F.coalesce(F.lead(col(order)).over(own), F.col("_follow")).alias("_next"))
