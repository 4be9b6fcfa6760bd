"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame functions only.

Test items are short and documents long, so similarity of whole sets says nothing; what counts is containment, the
share of an item's shingles (five words) that a document holds. Items are partitioned by size (powers of two of their
shingle counts). The sketch of an item is its k least shingle hashes, k following from the largest size of its
partition: an item with n shingles may miss n - ceil(0.8 n) of them, so of its k > n - ceil(0.8 n) least hashes a
document that contains it holds at least the difference. A document that holds that many is a candidate, and no other
document can contain the item; candidates are then verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setsift.llm._common import written

WORDS, PERCENT = 5, 80
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, after A-Z is lower-cased: ASCII other than digits and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def _runs(words: Column, n: int, shingle) -> Column:
    """``shingle(i)`` for each start i of n words; no element where there are fewer words."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), shingle)).otherwise(F.array())


def _hashes(hashes: Column, n: int) -> Column:
    """64-bit hashes of all runs of n words, from the words' hashes."""
    return _runs(hashes, n, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)])).cast("array<long>")


def _strings(words: Column, n: int) -> Column:
    return _runs(words, n, lambda i: F.concat_ws(" ", F.slice(words, i + 1, F.lit(n)))).cast("array<string>")


def item_sketches(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(items: item, item_id, n, length, shingles, least; sketches: hash, item) of the rows that have words.

    ``item`` names the row by a hash of id and text. Fewer than five words are one shingle of that ``length``.
    ``least`` is the number of sketch hashes that a document must hold.
    """
    rows = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text")).distinct()
    rows = rows.withColumn("words", words_of(F.col("text"))).filter(F.size("words") > 0)
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("length", F.least(F.size("words"), F.lit(WORDS)))

    def by_length(make) -> Column:
        out = make(WORDS)
        for n in range(WORDS - 1, 0, -1):
            out = F.when(F.col("length") == n, make(n)).otherwise(out)
        return F.array_distinct(out)

    rows = rows.select(
        F.xxhash64("item_id", "text").alias("item"),
        "item_id",
        "length",
        by_length(lambda n: _strings(F.col("words"), n)).alias("shingles"),
        F.array_sort(by_length(lambda n: _hashes(F.col("hashes"), n))).alias("hashes"),
    ).withColumn("n", F.size("shingles"))
    # the partition's largest size decides how many of the least hashes are kept
    most = F.pow(F.lit(2), F.ceil(F.log2(F.col("n")))).cast("int")
    missing = F.col("n") - F.ceil(F.col("n") * PERCENT / 100).cast("int")
    kept = F.least(F.col("n"), most - F.ceil(most * PERCENT / 100).cast("int") + 1)
    rows = written(rows.withColumn("sketch", F.slice("hashes", 1, kept)).withColumn("least", kept - missing), "bench-items")
    return rows.select("item", "item_id", "n", "length", "shingles", "least"), rows.select(F.explode("sketch").alias("hash"), "item")


def contained_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_shared, containment, doc_key for every pair with 100 * n_shared >=
    80 * n_shingles.

    Words are compared with A-Z lower-cased and ASCII marks as borders. Repeated rows of a table count once; rows that
    repeat an id with another text, and rows without an id, are judged on their own (``doc_key`` is a hash of id and
    text). Null and empty texts contain nothing and are contained in nothing; other columns are ignored; an empty table
    on either side gives an empty result.
    """
    items, sketches = item_sketches(benchmark)
    lengths = sorted({WORDS, *(r[0] for r in items.select("length").distinct().collect())})  # 1 to 5
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.withColumn("doc_key", F.xxhash64("doc_id", "text"))
    hashed = rows.withColumn("hashes", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)))
    shingles = hashed.select("doc_id", "doc_key", F.explode(F.array_distinct(F.flatten(F.array(*[_hashes(F.col("hashes"), n) for n in lengths])))).alias("hash"))
    held = shingles.join(written(sketches.distinct(), "bench-sketches"), "hash")
    counted = held.groupBy("doc_id", "doc_key", "item").agg(F.count_distinct("hash").alias("held"))
    found = written(counted.join(items.select("item", "least"), "item").filter(F.col("held") >= F.col("least")).select(F.col("doc_id").alias("d_id"), F.col("doc_key").alias("d_key"), F.col("item").alias("d_item")), "bench-candidates")
    both = rows.join(found, (F.col("doc_key") == F.col("d_key")) & F.col("doc_id").eqNullSafe(F.col("d_id"))).select("doc_id", "doc_key", words_of(F.col("text")).alias("words"), "d_item")
    exact = both.join(items, both["d_item"] == items["item"]).dropDuplicates(["doc_id", "doc_key", "item"])
    strings = F.col("shingles")
    shared = F.lit(0)
    for n in lengths:
        shared = F.when(F.col("length") == n, F.size(F.array_intersect(strings, _strings(F.col("words"), n)))).otherwise(shared)
    exact = exact.withColumn("n_shared", shared).filter(F.col("n_shared") * 100 >= F.col("n") * PERCENT)
    return exact.select("doc_id", "item_id", F.col("n").cast("long").alias("n_shingles"), F.col("n_shared").cast("long").alias("n_shared"), (F.col("n_shared") / F.col("n")).alias("containment"), "doc_key")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no test item, all columns as they are. The texts are shuffled only where the
    keys of the contaminated documents are too many to be broadcast by Spark's own threshold."""
    leaks = written(contained_items(docs, benchmark).select(F.col("doc_id").alias("leak_id"), F.col("doc_key").alias("leak_key")).distinct(), "bench-leaks")
    return docs.join(leaks, (F.xxhash64(docs["doc_id"].cast("long"), docs["text"]) == leaks["leak_key"]) & docs["doc_id"].cast("long").eqNullSafe(leaks["leak_id"]), "left_anti")
