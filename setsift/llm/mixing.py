"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key ``-ln(u) / w``, u from a hash of its id and text, w a weight of its quality;
the documents of a source in ascending order of their keys are a weighted sample without replacement. A source whose
target is a times its size is taken floor(a) times as a whole, and the rest is the first documents of that order until
the words left are reached. The order is never made for a whole source: sums over 1024 ranges of keys, then over 1024
ranges inside the one that the target falls into, leave one narrow range to be sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setsift.llm._common import written
from setsift.operators.running import running

WORDS = r"[^\x20\x09-\x0D]+"
#: Characters that count against a text's quality: ASCII marks and digits other than plain punctuation.
MARKS = "!#$%&*+/<=>@[]^_`{|}~0123456789\\"
RANGES = 1024
#: Weights between the least and the greatest whose keys the ranges are spread for.
SPREAD = (0.1, 0.2, 0.5, 1.0)


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def weight_of(text: Column) -> Column:
    """0.1 to 1: the share of characters that are no marks or digits; an empty text has 1."""
    t = F.coalesce(text, F.lit(""))
    return F.lit(0.1) + F.lit(0.9) * F.length(F.translate(t, MARKS, "")) / F.greatest(F.length(t), F.lit(1)) + F.when(F.length(t) == 0, F.lit(0.9)).otherwise(F.lit(0.0))


def key_of(doc_id: Column, text: Column) -> Column:
    """The exponential key; the same in each run, equal for rows that repeat id and text."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / weight_of(text)


def place_of(key: Column) -> Column:
    """Number of the key's range among RANGES ** 2, in the order of keys.

    Keys of weight w lie above k with probability exp(-w k); the ranges are even for a mix of the weights SPREAD, so
    that of documents of any one weight no range has much more than len(SPREAD) times its share.
    """
    above = sum((F.exp(key * -w) for w in SPREAD[1:]), F.exp(key * -SPREAD[0]))
    return F.least(F.floor((F.lit(1.0) - above / len(SPREAD)) * RANGES**2), F.lit(RANGES**2 - 1)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size) to targets: weights in turn by code point (null last), all words shared by weight, no
    target above ``most`` times its size, what is over going to the others by weight. One row per source.

    Sources may be as many as hosts: their numbers and the sums in the order of size to weight are running sums over
    ranges of sources. Only the totals and the level that ends the re-sharing are read on the driver.
    """
    sizes = written(sizes, "mix-sizes")
    by_name = F.struct(F.col("source").isNull().alias("none"), "source")
    ranked = running(sizes.select("*", by_name.alias("name"), F.lit(1).cast("long").alias("number")), [], "name", ["number"], "mix-named").drop("_next")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    # sums of caps and weights up to each source by ratio; its own are taken out again for those before it
    summed = ranked.select("source", "source_size", "cap", "weight", "ratio", F.struct("ratio", "name").alias("by"), F.lit(1).cast("long").alias("rank"), F.col("cap").alias("caps"), F.col("weight").alias("weighed"))
    summed = written(running(summed, [], "by", ["rank", "caps", "weighed"], "mix-ratios").drop("_next", "by"), "mix-summed")
    total = summed.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(total[0]) - F.col("caps") + F.col("cap")) / (F.lit(total[1]) - F.col("weighed") + F.col("weight"))
    stop = summed.withColumn("level", level).filter(F.col("level") <= F.col("ratio")).agg(F.min(F.struct("rank", "level")).alias("stop")).first()["stop"]
    if stop is None:  # no source at all
        return summed.select("source", "source_size", F.lit(0.0).alias("target"))
    shared = F.least(F.col("cap").cast("double"), F.lit(stop["level"]) * F.col("weight"))
    return summed.select("source", "source_size", F.when(F.col("rank") < stop["rank"], F.col("cap").cast("double")).otherwise(shared).alias("target"))


def _crossing(rows: DataFrame, by: str, rest: DataFrame) -> DataFrame:
    """Per source, the first range whose words reach past ``rest``, and what is left for inside it."""
    sums = rows.groupBy("source", by).agg(F.sum("size").alias("words"))
    up = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy(by)))
    at = up.join(rest, up["source"].eqNullSafe(rest["s"])).filter(F.col("upto") > F.col("rest"))
    first = at.groupBy("s").agg(F.min(F.struct(by, (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"))).alias("x"))
    return first.select("s", f"x.{by}", "x.rest")


def quotas(thin: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Per source (``quota_source``): quota_size, quota_target, quota_epochs, and where its partial epoch ends
    (``quota_place``, ``quota_key``).

    ``thin`` has source, size, key of every document. A document is in the partial epoch when its key's range lies
    before quota_place, or in it with a key up to quota_key. The document at the border is taken when more than half
    of it fits, so a source ends within half a document of its target.
    """
    thin = thin.withColumn("place", place_of(F.col("key"))).withColumn("coarse", F.floor(F.col("place") / RANGES))
    goal = written(targets(thin.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-targets")
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    coarse = _crossing(thin, "coarse", goal.select(F.col("source").alias("s"), F.col("left").alias("rest")))
    inside = thin.join(coarse.withColumnRenamed("coarse", "c"), thin["source"].eqNullSafe(F.col("s")) & (thin["coarse"] == F.col("c"))).select(thin["source"], "size", "key", "place", "doc_id")
    inside = written(inside, "mix-range")
    fine = _crossing(inside, "place", coarse.select("s", "rest"))
    fine = written(fine, "mix-place")
    last = inside.join(fine.withColumnRenamed("place", "p"), inside["source"].eqNullSafe(F.col("s")) & (inside["place"] == F.col("p"))).select(inside["source"], "size", "key", "doc_id", "rest")
    run = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("upto", F.sum("size").over(run)).filter(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    ends = fine.join(last.groupBy(F.col("source").alias("t")).agg(F.max("key").alias("last_key")), F.col("s").eqNullSafe(F.col("t")), "left").select("s", "place", "last_key")
    out = goal.join(ends, goal["source"].eqNullSafe(ends["s"]), "left")
    return written(out.select(goal["source"].alias("quota_source"), F.col("source_size").alias("quota_size"), F.col("target").alias("quota_target"), F.col("epochs").alias("quota_epochs"), F.coalesce("place", F.lit(0)).alias("quota_place"), F.coalesce("last_key", F.lit(-1.0)).alias("quota_key")), "mix-quotas")


def thin_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return docs.select(i.cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), size_of(t).alias("size"), key_of(i, t).alias("key"))


def times_of(key: Column) -> Column:
    """How often the mix holds a document, by its key and its source's quota."""
    place = place_of(key)
    return F.col("quota_epochs") + ((place < F.col("quota_place")) | ((place == F.col("quota_place")) & (key <= F.col("quota_key")))).cast("long")


def mix_table(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, epochs (whole passes over its source) of every row.

    Ties: rows that repeat id and text share a key and are taken together. Null texts and empty texts have size 0 and
    take nothing; null sources are a source of their own; an empty table gives an empty result.
    """
    thin = written(thin_rows(docs), "mix-thin")
    q = quotas(thin)
    both = thin.join(q, thin["source"].eqNullSafe(q["quota_source"]))
    return both.select("doc_id", "size", F.col("quota_size").alias("source_size"), F.col("quota_target").alias("target"), (F.col("size") * times_of(F.col("key"))).alias("taken"), F.col("quota_epochs").alias("epochs"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix with the columns of ``docs``, whatever their names: each as many times as its epochs say,
    none dropped in between. Sources' quotas are joined by source; the texts are not shuffled for it.

    Null sources are a source of their own; null and empty texts have no words and are in the mix as often as any other
    document of their source with their key; rows that repeat id and text share a key and are taken together; an empty
    table gives an empty result.
    """
    q = quotas(written(thin_rows(docs), "mix-thin"))
    # the key is worked out once a row, below the join; the row's own columns travel inside a struct, where no name clashes
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("own_source"), key_of(F.col("doc_id"), F.col("text")).alias("own_key"))
    both = rows.join(q, rows["own_source"].eqNullSafe(q["quota_source"])).withColumn("times", times_of(F.col("own_key")).cast("int"))
    return both.filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
