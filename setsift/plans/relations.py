"""Standard score relations built from the driver's tables.

Each function reads parquet lazily and returns a DataFrame in the shape the library
expects (score columns named ``<condition>_score``, an ``outcome`` column, and a case
id where the table has one). Column pruning and filters reach the parquet scan.

- LI  (``lineitem``): three scores from discount, tax and quantity; outcome = flag R.
- EM  (``embeddings``): cosine of every vector to four prototype vectors (the lowest
  ``vec_id`` of labels 0..3); outcome = label parity.
- DL  (``documents``, with ``labels`` where there are any): text, outcome = quality, labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LI_CONDITIONS = ["disc", "tax", "qty"]
EM_CONDITIONS = ["topic0", "topic1", "topic2", "topic3"]
EM_LABELS = [0, 1, 2, 3]

# Three short concept descriptions scored against the documents (character n-grams
# separate the four languages of the corpus).
DL_PROTOTYPES = [
    ("english", "the people of this town and the work that they share with their friends", "condition"),
    ("french", "les gens de la ville et le travail qui est pour eux dans une maison", "condition"),
    ("german", "die leute der stadt und das werk mit einer arbeit nicht auf dem land", "condition"),
]
DL_CONDITIONS = [p[0] for p in DL_PROTOTYPES]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def li_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_discount") * 10).alias("disc_score"),
        (F.col("l_tax") * 10).alias("tax_score"),
        (F.col("l_quantity") / 50).alias("qty_score"),
        (F.col("l_returnflag") == F.lit("R")).cast("int").alias("outcome"),
    )


def em_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the prototype vector of every condition (``<condition>_vec``).

    A global aggregate without grouping always yields exactly one row, so the side is
    safe to broadcast whatever the size of ``embeddings``.
    """
    emb = table(spark, sf_dir, "embeddings")
    aggs = [
        F.min_by(F.col("embedding"), F.when(F.col("label") == F.lit(k), F.col("vec_id"))).alias(f"{c}_vec")
        for c, k in zip(EM_CONDITIONS, EM_LABELS)
    ]
    return emb.filter(F.col("label").isin(*EM_LABELS)).agg(*aggs)


def em_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").alias("case_id"),
        F.col("embedding"),
        (F.col("label") % 2).cast("int").alias("outcome"),
    )


def em_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.score import prototype_cosine_wide

    return prototype_cosine_wide(
        em_vectors(spark, sf_dir), em_prototypes(spark, sf_dir), EM_CONDITIONS, vector_col="embedding"
    ).drop("embedding")


def all_label_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prototype for every label of ``embeddings``: the vector with the lowest ``vec_id``; in the order of labels."""
    emb = table(spark, sf_dir, "embeddings").filter(F.col("label").isNotNull())
    rows = emb.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return rows.select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("condition_name"), "embedding", F.col("label").cast("long").alias("proto_no"))


def _dl(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", how).select(
        F.col("doc_id").alias("case_id"),
        F.col("text"),
        F.col("quality").cast("int").alias("outcome"),
        F.col("quality").cast("int").alias("quality"),
        F.col("toxic").cast("int").alias("toxic"),
    )


def dl_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the outcome is missing where a document has no label."""
    return _dl(spark, sf_dir, "left").drop("quality", "toxic")


def dl_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents, for training and its checks."""
    return _dl(spark, sf_dir, "inner")


def dl_prototypes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DL_PROTOTYPES, "condition_name string, prototype string, type string")


def benchmark_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A concept table derived from ``benchmark``: names repeat every 16 items, every
    fourth item is an outcome prototype (exercises every prototype check)."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.concat(F.lit("topic"), (F.col("item_id") % 16).cast("string")).alias("condition_name"),
        F.col("text").alias("prototype"),
        F.when(F.col("item_id") % 4 == 3, F.lit("outcome")).otherwise(F.lit("condition")).alias("type"),
    )
