"""Character n-gram TF-IDF on Spark: vocabulary, vectors and prototype similarity.

Every score depends on a text alone, so the unit of work is the *distinct text*, named by two 64-bit hashes: repeated
texts are counted once with their multiplicity, and neither repeated nor missing ids matter. Copies of a text that many
rows hold add up before the shuffle. The texts are shuffled once, by these hashes; n-grams are exploded and counted per
(text, term) inside each partition, which the partitioning already satisfies. For prototype scores these counts are
written once; document frequencies and dot products both read them, and only partial sums are shuffled. The most
frequent terms (HEAVY of them) are broadcast to the counts, the others meet them by a shuffle, in which no term can have
more than one in HEAVY of all rows. Scores join back to the rows by hash, without the text unless the caller selects
it; texts that many rows hold join without a shuffle.

Prototype similarity uses every term of the texts. The cap of the vocabulary (``max_features``) and the bound on
document frequency (``max_df``) belong to the supervised mode.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.names import col
from ..functions.text import words
from ..session import ship, stored
from .grams import dot_products, lowered
from .partitioning import rows_and_partitions, text_partitions
from .skew import heavy_join, heavy_keys, many

#: Two hashes that name a text; other columns that this module adds for a while begin with an underscore as well.
KEY = ["_h1", "_h2"]
#: Rows of the term table that may be broadcast.
HEAVY = 20_000


def text_key(text: Column) -> list[Column]:
    """Missing text counts as empty text."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(t).alias("_h1"), F.xxhash64(F.lit("second"), t).alias("_h2")]


def distinct_texts(texts: DataFrame, text: str) -> tuple[DataFrame, int]:
    """((_h1, _h2, _text, _copies), number of rows): the texts, shuffled once and partitioned by their hashes."""
    n, parts = rows_and_partitions(texts)
    parts = text_partitions(texts, parts)
    one = F.lit(1).cast("long").alias("_copies")
    rows = texts.select(*text_key(col(text)), F.coalesce(col(text).cast("string"), F.lit("")).alias("_text"), one)
    heavy = heavy_keys(texts.select(*text_key(col(text))), KEY, many(n, parts))
    if heavy is not None:  # their copies add up in every task before the shuffle
        copies = rows.join(F.broadcast(heavy), KEY, "left_semi").groupBy(*KEY, "_text").agg(F.sum("_copies").alias("_copies"))
        rows = rows.join(F.broadcast(heavy), KEY, "left_anti").unionByName(copies)
    return rows.repartition(parts, *KEY).groupBy(*KEY).agg(F.first("_text").alias("_text"), F.sum("_copies").alias("_copies")), n


def term_counts(docs: DataFrame, keys: list[str], text: str, n_min: int = K.NGRAM_MIN, n_max: int = K.NGRAM_MAX) -> DataFrame:
    """(keys, term, c): how often each character n-gram occurs in each text.

    Words and n-gram positions are exploded by code-generated generators; ``substring`` only ever runs on one short
    padded word, never on a whole text, where positional access would be quadratic.
    """
    w = docs.select(*keys, F.explode(words(F.lower(F.coalesce(F.col(text), F.lit(""))))).alias("_w"))
    p = w.select(*keys, F.concat(F.lit(" "), F.col("_w"), F.lit(" ")).alias("_p"))
    pos = p.select(*keys, "_p", F.explode(F.sequence(F.lit(1), F.length("_p"))).alias("_i"))
    grams = [F.when(F.col("_i") + F.lit(n - 1) <= F.length("_p"), F.substring("_p", F.col("_i"), F.lit(n))) for n in range(n_min, n_max + 1)]
    terms = pos.select(*keys, F.explode(F.array(*grams)).alias("term")).filter(F.col("term").isNotNull())
    return terms.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("c"))


def _stats(docs: DataFrame, n_min: int, n_max: int) -> DataFrame:
    """(term, tf, df) over all rows that the distinct texts stand for."""
    return _frequencies(term_counts(docs, [*KEY, "_copies"], "_text", n_min, n_max))


def _frequencies(counts: DataFrame) -> DataFrame:
    """(term, tf, df, texts): occurrences, rows and distinct texts of each term."""
    return counts.groupBy("term").agg(F.sum(F.col("c") * F.col("_copies")).alias("tf"), F.sum("_copies").alias("df"), F.count(F.lit(1)).alias("texts"))


def _idf(n_docs: int) -> Column:
    return F.log((F.lit(1.0) + F.lit(float(n_docs))) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)


def vocabulary(
    texts: DataFrame,
    text: str = "text",
    max_features: int | None = K.MAX_FEATURES,
    min_df: float = K.MIN_DF,
    max_df: float = K.MAX_DF,
    n_min: int = K.NGRAM_MIN,
    n_max: int = K.NGRAM_MAX,
) -> DataFrame:
    """(term, tf, df, n_docs) of the kept vocabulary, most frequent first (ties by term); a bounded top-k."""
    docs, n = distinct_texts(texts, text)
    terms = _stats(docs, n_min, n_max).drop("texts").withColumn("n_docs", F.lit(n))
    hi = F.col("df") <= F.lit(float(max_df) * n if isinstance(max_df, float) else max_df)
    lo = F.col("df") >= F.lit(float(min_df) * n if isinstance(min_df, float) else min_df)
    kept = terms.filter(hi & lo).orderBy(F.col("tf").desc(), F.col("term").asc())
    return kept.limit(max_features) if max_features else kept


@dataclass
class TfidfModel:
    """A fitted vocabulary (alphabetical, at most the cap) with idf weights."""

    terms: list[str]
    idf: list[float]
    n_docs: int
    text: str = "text"
    n_min: int = K.NGRAM_MIN
    n_max: int = K.NGRAM_MAX

    def term_table(self, spark) -> DataFrame:
        return spark.createDataFrame(list(zip(self.terms, range(len(self.terms)), self.idf)), "term string, idx int, idf double")

    def vectors(self, texts: DataFrame, text: str | None = None) -> DataFrame:
        """(_h1, _h2, term, idx, weight): the non-zeros of the L2-normalised TF-IDF vector of every distinct text."""
        docs, _ = distinct_texts(texts, text or self.text)
        counts = term_counts(docs, KEY, "_text", self.n_min, self.n_max)
        x = counts.join(self.term_table(texts.sparkSession), "term").withColumn("_x", F.col("c") * F.col("idf"))
        rows = x.groupBy(*KEY).agg(F.collect_list(F.struct("term", "idx", "_x")).alias("_v"), F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("_n"))
        # a text's list holds each of its distinct terms once: at most the vocabulary
        e = rows.select(*KEY, "_n", F.explode("_v").alias("_e"))
        return e.select(*KEY, "_e.term", "_e.idx", (F.col("_e._x") / F.col("_n")).alias("weight"))


def fit_tfidf(
    texts: DataFrame,
    text: str = "text",
    max_features: int = K.MAX_FEATURES,
    min_df: float = K.MIN_DF,
    max_df: float = K.MAX_DF,
) -> TfidfModel:
    """Fit the capped vocabulary of the supervised mode (at most ``max_features`` rows to the driver)."""
    rows = vocabulary(texts, text, max_features, min_df, max_df).select("term", "df", "n_docs").collect()
    if not rows:
        raise ValueError("the texts hold no word, so there is no vocabulary")
    rows = sorted(rows, key=lambda r: r["term"])
    n = rows[0]["n_docs"]
    return TfidfModel([r["term"] for r in rows], [math.log((1.0 + n) / (1.0 + r["df"])) + 1.0 for r in rows], n, text)


def tfidf_vectors(texts: DataFrame, key: str, text: str = "text", model: TfidfModel | None = None) -> DataFrame:
    """(key, term, weight) of every row's TF-IDF vector; a row whose text has no known term has no line."""
    model = model or fit_tfidf(texts, text)
    rows = texts.select(col(key), *text_key(col(text)))
    return rows.join(model.vectors(texts, text), KEY).select(col(key), "term", "weight")


def with_terms(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored ``counts`` with the weights of their terms; ``terms`` (stored) has ``texts``, the counts that each term has."""
    if terms.count() <= HEAVY:
        return counts.join(F.broadcast(terms.drop("texts")), "term")
    frequent = stored(terms.orderBy(F.col("texts").desc(), "term").limit(HEAVY), "frequent-terms")
    return heavy_join(counts, terms.drop("texts"), ["term"], frequent.drop("texts"))


def _dot_columns(joined: DataFrame, n: int) -> DataFrame:
    """(_h1, _h2, _copies, _s0 ...): dot product of each text's normalised vector with each weight column ``_w<j>``."""
    x = F.col("c") * F.col("idf")
    sums = joined.groupBy(*KEY, "_copies").agg(F.sum(x * x).alias("_n2"), *[F.sum(x * F.col(f"_w{j}")).alias(f"_d{j}") for j in range(n)])
    return sums.select(*KEY, "_copies", *[(F.col(f"_d{j}") / F.sqrt("_n2")).alias(f"_s{j}") for j in range(n)])


def _joined_back(texts: DataFrame, text: str, dots: DataFrame, names: list[str]) -> DataFrame:
    """``texts`` with one more column per name; 0 where a text has no known term."""
    own = [c for c in texts.columns if c not in names]
    keyed = texts.select(*[col(c) for c in own], *text_key(col(text)))
    n, parts = rows_and_partitions(texts)
    dots = stored(dots, "text-scores")
    heavy = dots.filter(F.col("_copies") > many(n, text_partitions(texts, parts)))
    scored = heavy_join(keyed, dots, KEY, heavy, "left") if heavy.head(1) else keyed.join(dots, KEY, "left")
    return scored.select(*[col(c) for c in own], *[F.coalesce(F.col(f"_s{j}"), F.lit(0.0)).alias(c) for j, c in enumerate(names)])


def normalized_dot_scores(texts: DataFrame, model: TfidfModel, weights: dict[str, list[float]], text: str = "text") -> DataFrame:
    """Adds a column per name of ``weights``: the dot product of its weights (one per vocabulary term) with the
    normalised TF-IDF vector of the row's text. Texts are scored where they are read; only hashes and scores are shuffled."""
    ship(texts.sparkSession)
    _, parts = rows_and_partitions(texts)
    rows = texts.select(*text_key(col(text)), lowered(col(text)).alias("_low"))
    cores = texts.sparkSession.sparkContext.defaultParallelism
    rows = rows if parts >= cores else rows.repartition(cores, *KEY)
    names = [f"_s{j}" for j in range(len(weights))]
    run = dot_products(model.terms, model.idf, [[float(w) for w in ws] for ws in weights.values()], KEY)
    dots = rows.mapInArrow(run, ", ".join(["_h1 long, _h2 long", *(f"{s} double" for s in names)]))
    dots = dots.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_copies"), *[F.max(s).alias(s) for s in names])
    return _joined_back(texts, text, dots, list(weights))


def last_prototypes(prototypes: DataFrame, order_col: str | None = None) -> DataFrame:
    """(_cond, _ptext): the text of the last row of every name."""
    p = prototypes.withColumn("_o", col(order_col) if order_col else F.monotonically_increasing_id())
    return p.groupBy(F.col("condition_name").cast("string").alias("_cond")).agg(F.max_by(F.col("prototype").cast("string"), "_o").alias("_ptext"))


def tfidf_prototype_scores(
    texts: DataFrame,
    prototypes: DataFrame,
    conditions: list[str],
    text: str = "text",
    n_min: int = K.NGRAM_MIN,
    n_max: int = K.NGRAM_MAX,
    order_col: str | None = None,
) -> DataFrame:
    """``texts`` with ``<condition>_score``: cosine of the TF-IDF vectors of its text and of the condition's prototype.

    Document frequencies are those of all rows of ``texts``; no term is left out. A name that repeats keeps its last
    prototype. Any ids, repeated or missing, and any further columns pass through.
    """
    docs, n_docs = distinct_texts(texts, text)
    counts = stored(term_counts(docs, [*KEY, "_copies"], "_text", n_min, n_max), "term-counts")
    idf = _frequencies(counts).select("term", "texts", _idf(n_docs).alias("idf"))
    chosen = last_prototypes(prototypes, order_col).filter(F.col("_cond").isin(conditions))
    missing = set(conditions) - {r["_cond"] for r in chosen.filter(F.col("_ptext").isNotNull()).select("_cond").collect()}
    if missing:
        raise ValueError(f"conditions without a prototype text: {sorted(missing)}")
    own = term_counts(chosen, ["_cond"], "_ptext", n_min, n_max).join(idf, "term").withColumn("_x", F.col("c") * F.col("idf"))
    norms = own.groupBy("_cond").agg(F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("_n"))
    unit = own.join(norms, "_cond").withColumn("_w", F.col("_x") / F.col("_n"))
    wide = unit.groupBy("term").agg(*[F.sum(F.when(F.col("_cond") == F.lit(c), F.col("_w")).otherwise(0.0)).alias(f"_w{j}") for j, c in enumerate(conditions)])
    filled = idf.join(wide, "term", "left").select("term", "texts", "idf", *[F.coalesce(f"_w{j}", F.lit(0.0)).alias(f"_w{j}") for j in range(len(conditions))])
    terms = stored(filled, "tfidf-terms")
    return _joined_back(texts, text, _dot_columns(with_terms(counts, terms), len(conditions)), [f"{c}_score" for c in conditions])
