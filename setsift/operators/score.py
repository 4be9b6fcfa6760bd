"""Prototype similarity scores (dense embeddings and lexical TF-IDF) into a wide table.

Texts x prototypes is an all-pairs product by definition, but the prototype side is a
handful of concept descriptions (m vectors). They are gathered into one row by a
global aggregate (always exactly one row), read on the driver (bounded: m x dimension
numbers) and handed to the tasks as one broadcast row, so scoring is a projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import col
from ..functions.vectors import cosine, sq_norm
from ..session import stored
from .columns import require_columns
from .running import running


def select_prototypes(prototypes: DataFrame, include_outcome: bool = False) -> DataFrame:
    """Condition prototypes, or those of outcomes as well."""
    require_columns(prototypes, ["condition_name", "prototype", "type"], "prototypes")
    p = prototypes if include_outcome else prototypes.filter(F.col("type") == F.lit("condition"))
    return p


def prototype_names(prototypes: DataFrame, include_outcome: bool = False, order_col: str | None = None) -> list[str]:
    """Distinct condition names in prototype order (m rows to the driver, never texts)."""
    p = select_prototypes(prototypes, include_outcome)
    order = col(order_col) if order_col else F.monotonically_increasing_id()
    first = p.select(col("condition_name").cast("string").alias("name"), order.alias("_o")).groupBy("name").agg(F.min("_o").alias("_o"))
    names = [str(r["name"]) for r in sorted(first.collect(), key=lambda r: r["_o"])]
    if not names:
        raise ValueError("the prototype table has no row of type 'condition'")
    return names


def prototype_cosine_wide(
    texts: DataFrame,
    prototype_row: DataFrame,
    conditions: list[str],
    vector_col: str = "embedding",
) -> DataFrame:
    """Add ``<condition>_score`` = cosine(text vector, ``<condition>_vec``) per condition.

    ``prototype_row`` has exactly one row with ``<condition>_vec`` array columns (as a global aggregate builds it). It
    is read on the driver, m vectors, and handed to the tasks as one broadcast row, so each text row is scored by a
    projection; the length of its vector is computed once.
    """
    row = prototype_row.select(*[col(f"{c}_vec").cast("array<double>") for c in conditions]).collect()
    if len(row) != 1:
        raise ValueError(f"the prototypes must come as one row, not {len(row)}")
    missing = [c for c, v in zip(conditions, row[0]) if v is None]
    if missing:
        raise ValueError(f"conditions without a prototype vector: {missing}")
    schema = ", ".join(f"_v{j} array<double>" for j in range(len(conditions)))
    one = texts.sparkSession.createDataFrame([tuple(row[0])], schema)
    joined = texts.crossJoin(F.broadcast(one)).withColumn("_norm", F.sqrt(sq_norm(col(vector_col))))
    scored = joined.withColumns({f"{c}_score": cosine(col(vector_col), F.col(f"_v{j}"), F.col("_norm")) for j, c in enumerate(conditions)})
    return scored.drop("_norm", *[f"_v{j}" for j in range(len(conditions))])


def prototype_cosine_long(
    texts: DataFrame,
    prototypes: DataFrame,
    vector_col: str = "embedding",
    prototype_vector_col: str = "embedding",
    name_col: str = "condition_name",
    order_col: str = "proto_no",
    block: int = 64,
) -> DataFrame:
    """(columns of ``texts`` but the vector, condition, position, score): a row for every text and prototype, however many
    prototypes there are; none of them becomes a column. Positions follow ``order_col``, from 0; a name that repeats keeps
    its last vector, at the place of that row. Prototypes travel in blocks of ``block`` vectors: a text row is repeated
    once a block, and the blocks are broadcast by Spark only where they are below its threshold.
    """
    name = col(name_col).cast("string")
    last = prototypes.filter(name.isNotNull()).groupBy(name.alias("_name")).agg(F.max(col(order_col)).alias("_o"), F.max_by(col(prototype_vector_col), col(order_col)).alias("_pv"))
    ranked = stored(last.withColumn("_pos", F.lit(1).cast("long")), "prototype-vectors")
    ranked = running(ranked, [], "_o", ["_pos"], "prototype-order").withColumn("_pos", F.col("_pos") - 1)
    one = F.struct(F.col("_pos").alias("p"), F.col("_name").alias("n"), F.col("_pv").cast("array<double>").alias("v"))
    blocks = stored(ranked.groupBy(F.floor(F.col("_pos") / block).alias("_block")).agg(F.sort_array(F.collect_list(one)).alias("_protos")), "prototype-blocks")
    count = blocks.count()
    own = [c for c in texts.columns if c != vector_col]
    dealt = texts.select(*[col(c) for c in own], col(vector_col).alias("_tv"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("_block")) if count else texts.select(*[col(c) for c in own], col(vector_col).alias("_tv"), F.lit(0).cast("long").alias("_block")).limit(0)
    dealt = dealt.withColumn("_norm", F.sqrt(sq_norm(F.col("_tv")))).join(blocks, "_block")
    each = F.transform("_protos", lambda p: F.struct(p["n"].alias("condition"), p["p"].alias("position"), cosine(F.col("_tv"), p["v"], F.col("_norm")).alias("score")))
    return dealt.select(*[col(c) for c in own], F.explode(each).alias("_x")).select(*[col(c) for c in own], "_x.condition", "_x.position", "_x.score")


def prototype_cosine(
    texts: DataFrame,
    prototypes: DataFrame,
    vector_col: str = "embedding",
    prototype_vector_col: str = "embedding",
    include_outcome: bool = False,
    order_col: str | None = None,
) -> DataFrame:
    """Wide cosine scores from a prototype table carrying its own vectors.

    Prototype names are read on the driver (m rows); the vectors themselves stay in
    Spark: a global aggregate picks, per condition, the vector of its last row.
    """
    names = prototype_names(prototypes, include_outcome, order_col)
    p = select_prototypes(prototypes, include_outcome).withColumn(
        "_o", col(order_col) if order_col else F.monotonically_increasing_id()
    )
    row = p.agg(
        *[
            F.max_by(col(prototype_vector_col), F.when(F.col("condition_name") == F.lit(c), F.col("_o"))).alias(f"{c}_vec")
            for c in names
        ]
    )
    return prototype_cosine_wide(texts, row, names, vector_col)
