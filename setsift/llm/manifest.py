"""Merkle manifest of a data set: leaf digests, roots by source and of all, and a proof for every row.

The nodes of a group have ranks; digit k of a rank in base FAN says which child of its parent a node's ancestor is. A
block of FAN ** DIGITS consecutive ranks is grouped by its digit columns, the lowest first: each grouping takes one digit
away and nests the structs of up to FAN children into their parent, so a block ends as one nested row of bounded size. A
block's top is a node of the tier above, which is rolled up the same way until every group has one node. From the top down
a block's row is then exploded again: a transform over the children gives each of them the digests of its siblings. Rows
are never joined to nodes; only block rows (one for FAN ** DIGITS leaves) meet what their top's proof says, and both
sides of that join have one row a key.

Ranks come from range partitions: the sorted rows are written once, and a row's rank is its place in its partition plus the
prefix sum of its group's rows in the partitions before. No group is sorted or numbered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setsift.llm._common import written

FAN, DIGITS = 3, 6
#: Rows of digests that one range partition holds.
ROWS = 200_000
STEPS = "array<struct<l: string, r: string>>"


def digest(values: list[Column]) -> Column:
    """H of a row: each value as `-` if null, else its UTF-8 byte count, a colon and the value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in text)), 256)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0, inside its group, ascending by ``order``) and ``n`` (rows of the group)."""
    parts = max(1, math.ceil(rows.count() / ROWS))
    keys = [F.col(group), *(F.col(c).asc_nulls_first() for c in order)]
    rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    rows = written(rows, "manifest-sorted").withColumn("part", F.shiftright("at", 33))
    counts = written(rows.groupBy(group, "part").agg(F.count(F.lit(1)).alias("own"), F.min("at").alias("first")), "manifest-counts")
    whole = Window.partitionBy(group)  # a group has a row for each partition that it reaches into
    counts = counts.withColumn("before", F.sum("own").over(whole.orderBy("part")) - F.col("own")).withColumn("n", F.sum("own").over(whole))
    rows = rows.join(counts.select(group, "part", "first", "before", "n"), [group, "part"])
    return rows.withColumn("rank", F.col("before") + F.col("at") - F.col("first")).drop("at", "part", "first", "before")


def rolled(nodes: DataFrame, payload: list[str], fan: int, digits: int) -> DataFrame:
    """(grp, block, n, node) of nodes (grp, rank, n, h and the payload): one nested row a block. A level that has one node
    in its whole group passes it on as it is."""
    digit = [F.expr(f"cast(rank div {fan**k} % {fan} as int)").alias(f"d{k}") for k in range(digits)]
    rows = nodes.select("grp", "n", F.expr(f"rank div {fan**digits}").alias("block"), *digit, F.struct("h", *payload).alias("node"))
    rows = rows.repartition("grp", "block")  # every grouping below keeps these two keys and needs no other exchange
    for k in range(digits):
        left = ["grp", "block", "n", *(f"d{i}" for i in range(k + 1, digits))]
        rows = rows.groupBy(*left).agg(F.sort_array(F.collect_list(F.struct(F.col(f"d{k}").alias("d"), "node"))).alias("kids"))
        h = F.when(F.col("n") <= fan**k, F.col("kids")[0]["node"]["h"]).otherwise(F.sha2(F.array_join(F.col("kids.node.h"), ""), 256))
        rows = rows.select(*left, F.struct(h.alias("h"), "kids").alias("node"))
    return rows


def unrolled(blocks: DataFrame, carry: list[str], fan: int, digits: int) -> DataFrame:
    """The nodes that ``rolled`` took, as (grp, rank, n, node, steps, and ``carry``); ``steps`` of a block's row are those from
    its top on, each the digests to the left and to the right."""
    rows, hashes = blocks.withColumn("rank", F.col("block")), F.col("node.kids.node.h")

    def child(x: Column, i: Column) -> Column:
        step = F.struct(F.array_join(F.slice(hashes, F.lit(1), i), "").alias("l"), F.array_join(F.slice(hashes, i + 2, F.lit(fan)), "").alias("r"))
        steps = F.when(F.col("lone"), F.col("steps")).otherwise(F.concat(F.array(step), F.col("steps")))
        return F.struct(x["node"].alias("node"), x["d"].alias("d"), steps.alias("steps"))

    for k in reversed(range(digits)):
        rows = rows.withColumn("lone", F.col("n") <= fan**k)
        rows = rows.select("grp", "n", "rank", *carry, F.explode(F.transform("node.kids", child)).alias("x"))
        rows = rows.select("grp", "n", (F.col("rank") * fan + F.col("x.d")).alias("rank"), *carry, "x.node", "x.steps")
    return rows


def _tiers(nodes: DataFrame, payload: list[str], fan: int, digits: int) -> list[DataFrame]:
    """Block rows of every tier, the last with one block a group."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    out = []
    while not out or most > 1:
        out.append(written(rolled(nodes, payload if len(out) == 0 else [], fan, digits), "manifest-blocks"))
        most = -(-most // fan**digits)
        nodes = out[-1].select("grp", F.col("block").alias("rank"), F.expr(f"cast(ceil(n / {fan**digits}) as long)").alias("n"), F.col("node.h").alias("h"))
    return out


def _down(tiers: list[DataFrame], top: DataFrame, carry: list[str], fan: int, digits: int) -> DataFrame:
    """The nodes of the lowest tier with their steps; ``top``: steps and ``carry`` of each group's last node."""
    rows = tiers[-1].join(top, "grp")
    for tier in reversed(tiers[:-1]):
        above = written(unrolled(rows, carry, fan, digits).select("grp", F.col("rank").alias("block"), "steps", *carry), "manifest-steps")
        rows = tier.join(above, ["grp", "block"])
    return unrolled(rows, carry, fan, digits)


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "source", found: dict[str, Column] | None = None, fan: int = FAN, digits: int = DIGITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, steps, found.

    ``leaf`` is the digest of ``fields``; leaves of a group ascend by id (null first; of equal ids by digest), every ``fan``
    consecutive nodes become the digest of theirs until one remains, the group's ``subroot`` (a lone leaf itself); subroots,
    by group (null first, UTF-8 bytewise), give ``root`` in the same way. ``steps``: the siblings on the way from the leaf to
    the root, as an array of (l, r), the digests to the left and to the right; ``folded`` climbs it. ``found`` is the
    digest of the fields as they are met later, with the columns given in ``found`` in place of the stored ones. Null and
    empty values are values; rows that are equal have equal leaves and proofs of their own; other columns are ignored; an
    empty table gives an empty result.
    """
    values = {c: F.col(f"`{c}`") for c in fields}
    group = F.col(f"`{group_col}`").cast("string")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("-"), group), F.lit("")).alias("grp"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        digest(list(values.values())).alias("h"),
        (digest(list((values | found).values())) if found else F.lit(None).cast("string")).alias("found"),
        F.monotonically_increasing_id().alias("tie"),  # equal rows may be many; any order of theirs gives the same tree
    )
    leaves = written(leaves, "manifest-leaves")
    leaf_tiers = _tiers(ranked(leaves, "grp", ["id", "h", "tie"]), ["id", "found"], fan, digits)
    tops = leaf_tiers[-1].select(F.lit("").alias("grp"), F.col("grp").alias("own"), F.col("node.h").alias("h"))
    group_tiers = _tiers(ranked(written(tops, "manifest-subroots"), "grp", ["own"]), ["own"], fan, digits)
    top = group_tiers[-1].select("grp", F.col("node.h").alias("root"), F.array().cast(STEPS).alias("steps"))
    subroots = _down(group_tiers, top, ["root"], fan, digits).select(F.col("node.own").alias("grp"), F.col("node.h").alias("subroot"), "root", "steps")
    rows = _down(leaf_tiers, written(subroots, "manifest-steps"), ["root", "subroot"], fan, digits)
    return rows.select(F.col("node.id").alias("doc_id"), F.col("node.h").alias("leaf"), "subroot", "root", "steps", F.coalesce("node.found", "node.h").alias("found"))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def proof_digest(steps: Column) -> Column:
    """H of all sibling digests of a proof, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["l"], s["r"])), ""), 256)
