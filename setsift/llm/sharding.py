"""Sharding by vector bin packing: bytes, words and rows are balanced jointly, equal texts stay together.

What is placed are units: each group of equal texts that holds more than 1/UNITS of all bytes or rows is a unit of its
own (there are fewer than 2 * UNITS of these, whatever the input), the other groups share UNITS bundles by a hash of the
text. Units go in falling order of their largest share to the shard where the dot product of their vector with what the
shard still lacks is highest. A group larger than a quarter of a shard cannot be placed whole and balanced; it is dealt
to pieces of at most that size by a hash of the id.

The rows of a unit are numbered in parts of about PART_ROWS rows, as many as its rows ask for, so that no task orders
more than a part whatever the size of the table. Only the sums of the parts reach the driver: one row for each million
rows of the table, beside those of the units.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setsift.llm._common import written
from setsift.llm.mixing import size_of

UNITS = 4096
#: Rows that one task numbers.
PART_ROWS = 1 << 20


def _group(text: Column) -> list[Column]:
    """What equal texts share: 64-bit hash, crc32 and size (UTF-8 bytes plus 1); null counts as the empty text."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("g_hash"), F.crc32(t.cast("binary")).alias("g_crc"), (F.octet_length(t) + 1).cast("long").alias("g_size")]


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unit. ``vectors``: one row per unit, one column per dimension; ties go to the lower number."""
    total = np.maximum(vectors.sum(0), 1)
    v = vectors / total
    lack = np.full((shards, v.shape[1]), 1.0 / shards)
    out = np.zeros(len(v), np.int64)
    for k in np.lexsort((np.arange(len(v)), -v.max(1))):
        out[k] = int(np.argmax(lack @ v[k]))
        lack[out[k]] -= v[k]
    return out


def _plan(spark: SparkSession, thin: DataFrame, shards: int) -> tuple[DataFrame, int, DataFrame]:
    """(large groups with first unit, pieces and parts; parts of a bundle; units with part, shard and the first slot of
    the part).

    The large groups are fewer than 2 * UNITS, the parts fewer than 9 * UNITS and two for each PART_ROWS rows, so both
    may be broadcast.
    """
    groups = thin.groupBy("g_hash", "g_crc", "g_size").agg(F.count(F.lit(1)).alias("rows"))
    total = thin.agg(F.coalesce(F.sum("g_size"), F.lit(0)), F.count(F.lit(1))).first()
    large = groups.filter((F.col("g_size") * F.col("rows") * UNITS > total[0]) | (F.col("rows") * UNITS > total[1])).collect()
    table, unit = [], UNITS
    bundle_parts = max(1, math.ceil(total[1] / UNITS / PART_ROWS))
    part_rows = min(PART_ROWS, 4 * total[1] / UNITS)
    for g in sorted(large):
        share = max(g["g_size"] * g["rows"] / total[0], g["rows"] / total[1])
        pieces = max(1, math.ceil(share * shards * 4)) if share * shards * 4 > 1 and g["rows"] > 1 else 1
        table.append((g["g_hash"], g["g_crc"], g["g_size"], unit, pieces, max(1, math.ceil(g["rows"] / pieces / part_rows))))
        unit += pieces
    large_df = spark.createDataFrame(table, "l_hash long, l_crc long, l_size long, l_unit int, pieces int, parts int")
    sums = _units(thin, large_df, bundle_parts).groupBy("unit", "part").agg(F.sum("g_size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).collect()
    sums = sorted(sums)
    names = sorted({r["unit"] for r in sums})
    at = {u: k for k, u in enumerate(names)}
    vectors = np.zeros((len(names), 3))
    for r in sums:
        vectors[at[r["unit"]]] += (r["bytes"], r["tokens"], r["rows"])
    shard = pack(vectors, shards)
    base, rows = [0] * shards, []
    for r in sums:
        s = int(shard[at[r["unit"]]])
        rows.append((r["unit"], r["part"], s, base[s]))
        base[s] += r["rows"]
    return large_df, bundle_parts, spark.createDataFrame(rows, "u_unit int, u_part int, u_shard int, u_base long")


def _units(rows: DataFrame, large: DataFrame, bundle_parts: int) -> DataFrame:
    """Adds unit and part. ``rows`` has g_hash, g_crc, g_size and g_id (a hash of the id). The part goes by id and text,
    so rows that share an id, null ones too, spread over the parts of a bundle."""
    own = (F.col("g_hash") == F.col("l_hash")) & (F.col("g_crc") == F.col("l_crc")) & (F.col("g_size") == F.col("l_size"))
    unit = F.when(F.col("l_unit").isNull(), F.pmod("g_hash", F.lit(UNITS))).otherwise(F.col("l_unit") + F.pmod("g_id", F.coalesce("pieces", F.lit(1))))
    part = F.pmod(F.shiftright(F.xxhash64("g_id", "g_hash"), 20), F.coalesce("parts", F.lit(bundle_parts)))
    return rows.join(F.broadcast(large), own, "left").withColumn("unit", unit.cast("int")).withColumn("part", part.cast("int")).drop(*large.columns)


def _thin(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return docs.select(i.cast("long").alias("doc_id"), *_group(t), size_of(t).alias("tokens"), F.xxhash64(i).alias("g_id"))


def shard_table(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, law ("bytes"), shard, slot (0, 1, ... inside the shard),
    grown_shard (null), tokens of every row.

    Equal texts share a shard unless their group is larger than a quarter of one. Null and empty texts are one group of
    size 1 a row. Repeated rows and ties get slots of their own; an empty table gives an empty result; other columns
    are ignored. Slots are numbered inside a unit's part and start at the sum of the parts before it, so no task orders
    a whole shard.
    """
    thin = written(_thin(docs, id_col, text_col), "shard-thin")
    large, bundle_parts, units = _plan(docs.sparkSession, thin, shards)
    placed = _units(thin, large, bundle_parts)
    placed = placed.join(F.broadcast(units), (F.col("unit") == F.col("u_unit")) & (F.col("part") == F.col("u_part")))
    order = Window.partitionBy("unit", "part").orderBy("doc_id", "g_hash", "g_crc", "g_size")
    return placed.select(
        "doc_id",
        F.col("g_size").alias("size"),
        F.col("g_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("u_shard").alias("shard"),
        (F.col("u_base") + F.row_number().over(order) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``docs`` with a column ``shard`` (replacing one of that name): the same placement; the texts are not shuffled."""
    large, bundle_parts, units = _plan(docs.sparkSession, written(_thin(docs, "doc_id", "text"), "shard-thin"), shards)
    rows = _units(docs.select(F.struct("*").alias("row"), *_group(F.col("text")), F.xxhash64("doc_id").alias("g_id")), large, bundle_parts)
    rows = rows.join(F.broadcast(units), (F.col("unit") == F.col("u_unit")) & (F.col("part") == F.col("u_part")))
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns if c != "shard"], F.col("u_shard").alias("shard"))
