"""Partitioning helpers for per-document work.

Text operators do heavy per-row work (tokenising, n-grams, term sets). A scan yields one task per file split, so a table
stored as a few large row groups gives fewer tasks than the cluster has cores; ``spread`` deals such a table out once
and leaves others untouched. Texts that are grouped go to at least as many partitions as the input has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_and_partitions(df: DataFrame) -> tuple[int, int]:
    """(rows, partitions up to the last that has rows) of ``df``; reads no column of a table."""
    n, last = df.select(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)), F.max("p")).first()
    return n, (last or 0) + 1


def text_partitions(df: DataFrame, input_partitions: int) -> int:
    """Partitions for grouping the rows of ``df``: never fewer than the input has, nor than shuffles or cores."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism, input_partitions)


def spread(table: DataFrame, key: str | Column) -> DataFrame:
    """A scanned table, repartitioned by ``key`` only when it has fewer splits than the cluster has cores."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores, key)
