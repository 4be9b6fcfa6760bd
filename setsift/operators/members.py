"""Members of configurations as compressed sets.

Cases are numbered from 0 in the order of their id. A configuration's members at a threshold are bits: one bitmap of 4 KiB
for each 32,768 numbers that hold a member. Bitmaps are aggregated in every task before the shuffle (numbers that follow
each other lie in the same tasks), so a case costs a bit for each threshold, not a row, and sets of any thresholds can be
compared without the cases: no task holds a whole configuration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calibration import threshold_level
from ..functions.labels import configuration_label
from ..functions.names import col
from ..session import stored
from .columns import condition_name, require_columns, score_columns
from .running import running


def numbered(cases: DataFrame, order_col: str = "case_id") -> DataFrame:
    """``cases`` with ``number``: 0, 1, ... in the order of ``order_col`` (missing first, equal ones in any order)."""
    require_columns(cases, [order_col])
    rows = stored(cases.withColumn("number", F.lit(1).cast("long")), "unnumbered")
    return running(rows, [], order_col, ["number"], "numbered").withColumn("number", F.col("number") - 1).drop("_next")


def member_bitmaps(scores: DataFrame, grid: list[float], number: str = "number") -> DataFrame:
    """(threshold, configuration, bucket, members): the cases of every configuration at every threshold of the sorted
    ``grid`` as bitmaps over the distinct non-negative numbers of column ``number``. Cases with a missing score are left
    out, as in the truth table; an empty table gives no rows."""
    names = [c for c in score_columns(scores)]
    conditions = [condition_name(c) for c in names]
    levels = scores.select(*[threshold_level(x, grid).alias(c) for x, c in zip(names, conditions)], col(number).cast("long").alias("_number")).dropna()
    steps = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(t)).alias("t")) for j, t in enumerate(grid)]))
    # the function counts positions from 1
    at = levels.select(steps.alias("_g"), *[col(c) for c in conditions], (F.col("_number") + 1).alias("_number"))
    at = at.select(F.col("_g.t").alias("threshold"), *[(col(c) > F.col("_g.j")).cast("int").alias(c) for c in conditions], "_number")
    bits = at.groupBy("threshold", *[col(c) for c in conditions], F.bitmap_bucket_number("_number").alias("bucket"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_number")).alias("members"))
    return bits.select("threshold", configuration_label(conditions).alias("configuration"), "bucket", "members")


def configuration_sizes(bitmaps: DataFrame) -> DataFrame:
    """(threshold, configuration, n_cases) of :func:`member_bitmaps`; the bits are counted before the shuffle."""
    return bitmaps.groupBy("threshold", "configuration").agg(F.sum(F.bitmap_count("members")).alias("n_cases"))


def configuration_overlaps(bitmaps: DataFrame, grid: list[float]) -> DataFrame:
    """(threshold, configuration, next_threshold, next_configuration, n_cases, next_n_cases, n_both): for every threshold of
    the sorted ``grid`` and the one after it, how many cases go from which configuration to which; pairs without a common
    case have no row. The bitmaps are written once; those of one bucket meet by (threshold, bucket), a key with at most
    one row for each configuration, and their intersection is made bucket by bucket."""
    bitmaps = stored(bitmaps, "members")
    step = F.create_map(*[F.lit(float(x)) for pair in zip(grid[1:], grid[:-1]) for x in pair]) if len(grid) > 1 else F.lit(None).cast("map<double,double>")
    after = bitmaps.select(F.try_element_at(step, F.col("threshold")).alias("threshold"), "bucket", F.col("threshold").alias("next_threshold"), F.col("configuration").alias("next_configuration"), F.col("members").alias("_after"))
    met = bitmaps.join(after.filter(F.col("threshold").isNotNull()), ["threshold", "bucket"])
    key = ["threshold", "configuration", "next_threshold", "next_configuration"]
    both = met.select(*key, "bucket", F.explode(F.array("members", "_after")).alias("_m")).groupBy(*key, "bucket").agg(F.bitmap_and_agg("_m").alias("_m"))
    common = both.groupBy(*key).agg(F.sum(F.bitmap_count("_m")).alias("n_both")).filter("n_both > 0")
    sizes = stored(configuration_sizes(bitmaps), "sizes")
    return (
        common.join(sizes, ["threshold", "configuration"])
        .join(sizes.toDF("next_threshold", "next_configuration", "next_n_cases"), ["next_threshold", "next_configuration"])
        .select(*key, "n_cases", "next_n_cases", "n_both")
    )
