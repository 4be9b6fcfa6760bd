"""N-grams counted in Arrow batches, the solver's sums over packed rows, and how often a fit reads its labels."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import CONDITIONS, LABELED_DEMO
from setsift import constants as K
from setsift.functions.text import WS, is_blank
from setsift.operators import grams, logistic, tfidf
from setsift.operators.classify import fit_classifiers


def _labeled(spark):
    return spark.createDataFrame(LABELED_DEMO, "case_id string, text string, " + ", ".join(f"{c} int" for c in CONDITIONS))


def _counts(text, n_min, n_max):
    out = Counter()
    for w in filter(None, re.split("[" + "".join(re.escape(chr(b)) for b in grams.BLANKS) + "]+", text)):
        p = f" {w} "
        out.update(p[i : i + n] for n in range(n_min, n_max + 1) for i in range(len(p) - n + 1))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_counts_against_brute_force(monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(grams, "PIECE", rng.choice([1, 3, 1 << 20]))
    monkeypatch.setattr(grams, "DENSE", rng.choice([0, 1 << 24]))
    texts = ["".join(rng.choice("ab c 　 é😀x\n") for _ in range(rng.randint(0, 30))) for _ in range(8)]
    n_min = rng.randint(1, 2)
    n_max = rng.randint(n_min, 4)
    own = [_counts(t, n_min, n_max) for t in texts]
    terms = sorted(t for t in set().union(*own) if rng.random() < 0.7)
    assert grams.Terms(terms).counts(texts).tolist() == [[c[t] for t in terms] for c in own]


def test_blanks_are_those_of_the_pattern(spark):
    chars = spark.range(0x3100).filter(F.col("id") > 0).select(F.col("id"), F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    assert sorted(r.id for r in chars.filter(F.col("c").rlike(WS)).collect()) == sorted(grams.BLANKS)


def test_blank_texts(spark):
    texts = [None, "", " ", "　nan\n", "None", "nan nan", "x nan", "\n", "None\n\n", "no text", "a\nnan", "nan\nb"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", is_blank("t").alias("b")).collect()
    assert [r.b for r in got] == [r.t is None or r.t.strip() in K.EMPTY_MARKERS for r in got]


def test_sums_over_packed_rows(spark, monkeypatch):
    monkeypatch.setattr(logistic, "BLOCK", 3)
    rng = np.random.default_rng(0)
    x = rng.random((20, 6)) * (rng.random((20, 6)) < 0.4)
    x[4] = 0
    y, w = (rng.random(20) < 0.5).astype(float), rng.random(20)
    rows = [([int(i) for i in np.flatnonzero(r)], [float(v) for v in r[r != 0]], float(a), float(b)) for r, a, b in zip(x, y, w, strict=True)]
    data = spark.createDataFrame(rows, "idx array<int>, val array<double>, _y0 double, _w0 double").repartition(3)
    b, b0 = rng.normal(size=6), 0.3
    blocks = data.mapInArrow(logistic.packed(1), "row binary, idx binary, val binary, y binary, w binary, s array<double>")
    ((loss, g, g0),) = logistic.evaluate(blocks, 1, [(0, b, b0)])
    z = x @ b + b0
    r = w * (1 / (1 + np.exp(-z)) - y)
    assert loss == pytest.approx((w * (np.logaddexp(0, z) - y * z)).sum()) and g0 == pytest.approx(r.sum()) and np.allclose(g, x.T @ r)


def test_names_of_labels_with_dots(spark):
    df = _labeled(spark).withColumnRenamed(CONDITIONS[0], "v1.2")
    a, b = fit_classifiers(df, ["v1.2"]), fit_classifiers(_labeled(spark), CONDITIONS[:1])
    assert np.allclose(a.models["v1.2"][0], b.models[CONDITIONS[0]][0], atol=1e-6)


def test_a_fit_reads_its_labels_once(spark):
    """The report, the sample, the vocabulary and the features came from a read (and a join) each."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = _labeled(spark)
    fit_classifiers(df.mapInArrow(count, df.schema), CONDITIONS)
    assert seen.value == len(LABELED_DEMO)


def test_texts_are_scored_where_they_are_read(spark, monkeypatch):
    """No row per n-gram, and no text in an exchange: only hashes and scores are shuffled."""
    plans = []
    monkeypatch.setattr(tfidf, "stored", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), df)[1])
    texts = spark.createDataFrame([(k, f"some text {k % 3}") for k in range(50)], "case_id long, text string").repartition(32)
    model = tfidf.TfidfModel(["a", "m", "so"], [1.0, 1.5, 2.0], 50)
    scored = tfidf.normalized_dot_scores(texts, model, {"s": [1.0, 0.5, 2.0]}).collect()
    assert len(scored) == 50 and all(r.s == pytest.approx((0.5 * 1.5 + 4.0) / np.sqrt(1.5**2 + 4)) for r in scored)
    (plan,) = plans
    assert "Generate" not in plan and "MapInArrow" in plan and "_text" not in plan.split("MapInArrow")[0]
