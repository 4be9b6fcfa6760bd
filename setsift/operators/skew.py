"""Keys that hold a large part of all rows, and joins that do not deal them to one task.

Of n rows, at most SHARE * parts keys can have more than n / (SHARE * parts) rows each; those are few enough to be
broadcast, and no other key fills a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 8
#: Fewer rows than this of one key are never many.
LEAST = 1000


def many(n: int, parts: int) -> int:
    """Rows that one key may have before it counts as heavy."""
    return max(LEAST, n // (SHARE * parts))


def heavy_keys(rows: DataFrame, keys: list[str], bound: int) -> DataFrame | None:
    """The keys with more than ``bound`` rows, None if there is none; counted with partial sums in every task."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > bound).select(*keys)
    have = found.collect()
    return rows.sparkSession.createDataFrame(have, found.schema) if have else None


def heavy_join(left: DataFrame, right: DataFrame, keys: list[str], heavy: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (one row a key): the few rows ``heavy`` of ``right`` are broadcast and what they
    match never leaves its task; all other rows meet by a shuffle, where no key is heavy any more."""
    few = F.broadcast(heavy)
    return left.join(few, keys, "inner").unionByName(left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(right, keys, how))
