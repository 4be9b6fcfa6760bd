"""Event sweep, running sums, heavy keys, long-form top two, positions, whiskers, whole bundles."""

import random
import tempfile
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from setsift.operators import chart_data as G
from setsift.operators import running as RUN
from setsift.operators import skew, sweep, tfidf
from setsift.operators.explain import top_two, top_two_long
from setsift.operators.running import running
from setsift.operators.score import prototype_cosine_long
from setsift.operators.sweep import every_threshold
from setsift.operators.thresholds import sensitivity_detail
from setsift.operators.truth_table import configuration_positions
from setsift.sources import io


def test_running_sums_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(RUN, "ROWS", 40)
    rng = random.Random(1)
    data = [(rng.choice(["a", "a", "a", "b", None]), k, rng.randrange(-5, 9)) for k in range(400)]
    df = spark.createDataFrame(rng.sample(data, len(data)), "g string, o long, x long")
    got = running(df, ["g"], "o", ["x"], "test")
    assert got.select(F.lit(1)).count() == 400
    by = defaultdict(list)
    for r in got.collect():
        by[r.g].append(r)
    for g, rows in by.items():
        own = sorted(x for x in data if x[0] == g)if g is not None else sorted((x for x in data if x[0] is None), key=lambda x: x[1])
        rows.sort(key=lambda r: r.o)
        total = 0
        for k, (r, x) in enumerate(zip(rows, own, strict=True)):
            total += x[2]
            assert (r.o, r.x, r._next) == (x[1], total, own[k + 1][1] if k + 1 < len(own) else None)


SCHEMA = "case_id long, a_score double, b_score double, c_score double, outcome int"


def test_sweep_is_the_detail_of_all_thresholds(spark, monkeypatch):
    monkeypatch.setattr(RUN, "ROWS", 25)
    monkeypatch.setattr(sweep, "BLOCK", 3)
    rng = random.Random(2)
    rows = [(k, *(rng.choice([0.0, 0.1, 0.25, 0.25, 0.5, 1.0, rng.random()]) for _ in range(3)), rng.choice([0, 1, None])) for k in range(120)]
    scores = spark.createDataFrame(rows, SCHEMA)
    grid = sorted({x for r in rows for x in r[1:4]})
    want = sensitivity_detail(scores, grid, consistency_cutoff=0.5).collect()
    got = every_threshold(scores, consistency_cutoff=0.5).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and len(got) > 100


def test_sweep_with_missing_scores_and_outcomes(spark):
    rows = [(1, 0.3, None, 0.5, 1), (2, 0.3, 0.3, 0.3, 1), (3, float("nan"), 0.2, 0.1, 0), (4, 0.9, 0.3, 0.2, None)]
    scores = spark.createDataFrame(rows, SCHEMA)
    grid = [0.1, 0.2, 0.3, 0.5, 0.9]
    assert [tuple(r) for r in every_threshold(scores, validate=False).collect()] == [tuple(r) for r in sensitivity_detail(scores, grid, validate=False).collect()]
    with pytest.raises(Exception, match="missing in some"):
        every_threshold(scores).collect()
    with pytest.raises(Exception, match="the outcome must be 0 or 1"):
        every_threshold(spark.createDataFrame([(1, 0.1, 0.2, 0.3, 7)], SCHEMA)).collect()
    assert every_threshold(scores.limit(0)).collect() == []


def test_heavy_texts_and_terms_score_as_others(spark, monkeypatch):
    """Half of the rows empty, a fifth one boilerplate: copies add up before the shuffle, scores stay the same."""
    rng = random.Random(3)
    texts = ["" if k % 2 else "the same boilerplate everywhere" if k % 5 == 0 else " ".join(rng.choice(["tax", "town", "work", "zeta", "xi"]) + str(rng.randrange(50)) for _ in range(6)) for k in range(600)]
    docs = spark.createDataFrame([(k, t, k % 2) for k, t in enumerate(texts)], "case_id long, text string, outcome int")
    protos = spark.createDataFrame([("x", "tax town 1 2", "condition"), ("y", "work boilerplate", "condition")], "condition_name string, prototype string, type string")
    run = lambda: {r.case_id: (r.text, round(r.x_score, 9), round(r.y_score, 9)) for r in tfidf.tfidf_prototype_scores(docs, protos, ["x", "y"]).collect()}
    plain = run()
    monkeypatch.setattr(skew, "LEAST", 20)
    monkeypatch.setattr(tfidf, "HEAVY", 30)
    found, n = tfidf.distinct_texts(docs, "text")
    copies = {r._text: r._copies for r in found.collect()}
    assert n == 600 and copies == Counter(texts)
    # the empty text reaches the exchange once a task, not once a row
    assert run() == plain and len(plain) == 600
    counts = tfidf.stored(tfidf.term_counts(found, [*tfidf.KEY, "_copies"], "_text"), "test-counts")
    terms = tfidf.stored(tfidf._frequencies(counts).select("term", "texts", F.lit(1.0).alias("idf")), "test-terms")
    assert terms.count() > 30
    plan = tfidf.with_terms(counts, terms)._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan
    assert Counter((r.term, r.c) for r in tfidf.with_terms(counts, terms).collect()) == Counter((r.term, r.c) for r in counts.collect())


def test_heavy_keys_are_bounded(spark):
    rows = spark.range(10_000).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    bound = skew.many(10_000, 8)
    assert bound == 1000 and [r.k for r in skew.heavy_keys(rows, ["k"], bound).collect()] == [-1]
    assert skew.heavy_keys(spark.range(5000).toDF("k"), ["k"], bound) is None


def test_long_top_two_is_the_wide_one(spark):
    rng = random.Random(4)
    rows = [(k, *(rng.choice([0.1, 0.2, 0.5, None, float("nan")]) for _ in range(3)), 1) for k in range(200)]
    wide = spark.createDataFrame(rows, SCHEMA)
    long = G.score_long(wide, ("case_id",)).withColumn("position", F.when(F.col("condition") == "a", 0).when(F.col("condition") == "b", 1).otherwise(2))
    names = ["case_id", "top_condition", "top_score", "second_condition", "second_score", "score_gap"]
    got = top_two_long(long, score="similarity_score").select(names).collect()
    assert sorted(map(str, got)) == sorted(map(str, top_two(wide).select(names).collect()))
    (one,) = top_two_long(long.filter("case_id = 0 and condition = 'a'"), score="similarity_score").collect()
    assert one.second_condition is None and one.second_score is None


def test_many_prototypes_without_columns(spark):
    rng = random.Random(5)
    vec = lambda: [rng.random() - 0.5 for _ in range(4)]
    protos = [(f"p{k % 250}", vec(), k) for k in range(300)]  # names repeat: the last counts
    texts = [(k, vec() if k else [0.0] * 4) for k in range(5)]
    got = prototype_cosine_long(
        spark.createDataFrame(texts, "case_id long, embedding array<double>"), spark.createDataFrame(protos, "condition_name string, embedding array<double>, proto_no long"), block=7
    )
    rows = got.collect()
    last = {}
    for name, v, k in protos:
        last[name] = (k, v)
    order = sorted(last, key=lambda n: last[n][0])
    assert len(rows) == 5 * 250 and {(r.condition, r.position) for r in rows} == {(n, i) for i, n in enumerate(order)}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    for r in rows:
        v, p = dict(texts)[r.case_id], last[r.condition][1]
        want = 0.0 if norm(v) == 0 else sum(x * y for x, y in zip(v, p, strict=True)) / norm(v) / norm(p)
        assert abs(r.score - want) < 1e-12


def test_positions_of_a_hot_configuration(spark, monkeypatch):
    monkeypatch.setattr(RUN, "ROWS", 30)
    df = spark.range(300).select(F.col("id").alias("case_id"), F.when(F.col("id") == 7, None).otherwise((F.col("id") % 10 > 0).cast("int")).alias("a"), F.lit(1).alias("outcome"))
    got = defaultdict(list)
    for r in configuration_positions(df, ["a"]).collect():
        got[r.configuration].append((r.position, r.case_id))
    assert sorted(got["~a"]) == [(k + 1, 10 * k) for k in range(30)]
    assert sorted(got["a"]) == list(enumerate([k for k in range(300) if k % 10 and k != 7], 1))


def test_whiskers_and_points(spark):
    rows = [(k, float(k), None, 0.5, 1) for k in range(1, 12)] + [(99, 100.0, None, 0.5, 0), (98, -100.0, None, float("nan"), 0)]
    scores = spark.createDataFrame(rows, SCHEMA)
    w = {r.condition: r for r in G.score_whiskers(scores).collect()}
    a = w["a"]
    assert (a.n, a.whisker_low, a.whisker_high, a.n_below, a.n_above) == (13, 1.0, 11.0, 1, 1)
    assert w["b"].n == 0 and w["b"].whisker_low is None and w["b"].n_below == 0
    assert (w["c"].whisker_low, w["c"].whisker_high, w["c"].n) == (0.5, 0.5, 12)
    points = G.score_points(scores, 50).collect()
    assert {r.case_id for r in points if r.outlier} == {98, 99} and sum(r.condition == "a" for r in points) == 13
    few = G.score_points(scores, 4)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, G.score_points(scores.repartition(5), 4).collect())) and few.filter("condition = 'a'").count() == 4


def test_a_broken_run_leaves_the_bundle_before(spark):
    d = tempfile.mkdtemp(prefix="setsift-test-")
    one, two = spark.range(3).toDF("x"), spark.range(5).toDF("y")
    assert io.bundle_manifest(spark, d) is None
    first = io.publish_bundle(spark, {"one": one, "two": two, "none": None}, d, {"cutoff": 0.8, "note": None})
    assert first["version"] == 1 and first["tables"] == {"one": 3, "two": 5} and first["settings"] == {"cutoff": "0.8", "note": None}
    broken = spark.range(4).select(F.raise_error(F.lit("lost")).cast("long").alias("y"))
    with pytest.raises(Exception, match="lost"):
        io.publish_bundle(spark, {"one": spark.range(9).toDF("x"), "two": broken}, d)
    assert io.bundle_manifest(spark, d) == first and io.read_bundle(spark, d, "one").count() == 3
    second = io.publish_bundle(spark, {"one": spark.range(9).toDF("x")}, d, fmt="csv")
    assert second["version"] == 2 and io.read_bundle(spark, d, "one", "x long").count() == 9
    with pytest.raises(ValueError, match="no whole bundle"):
        io.read_bundle(spark, d, "two")
