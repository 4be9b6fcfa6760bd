import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from fixtures import CONDITIONS, LABELED_DEMO
from setsift.operators.checks import label_report, training_report
from setsift.operators.classify import fit_classifiers, fit_predict_scores, gradient_at_zero, training_rows
from setsift.operators.tfidf import tfidf_vectors
from setsift.plans.relations import dl_labeled


def _newton(X, y, w, reg=1.0, iters=100):
    """Minimise 1/2 ||b||^2 + sum w_i logloss_i (intercept unpenalised)."""
    n, d = X.shape
    Xa = np.hstack([X, np.ones((n, 1))])
    b = np.zeros(d + 1)
    P = np.eye(d + 1) * reg
    P[-1, -1] = 0.0
    for _ in range(iters):
        p = 1 / (1 + np.exp(-Xa @ b))
        g = Xa.T @ (w * (p - y)) + P @ b
        H = (Xa * (w * p * (1 - p))[:, None]).T @ Xa + P
        step = np.linalg.solve(H, g)
        b -= step
        if np.abs(step).max() < 1e-12:
            break
    return 1 / (1 + np.exp(-Xa @ b))


def _matrix(df, clf, ids):
    """The TF-IDF vectors as a dense matrix, row by id."""
    at = {t: j for j, t in enumerate(clf.tfidf.terms)}
    X = np.zeros((len(ids), len(at)))
    for r in tfidf_vectors(df, "case_id", model=clf.tfidf).collect():
        X[ids.index(r.case_id), at[r.term]] = r.weight
    return X


def _demo(spark):
    return spark.createDataFrame(LABELED_DEMO, "case_id string, text string, " + ", ".join(f"{c} int" for c in CONDITIONS))


def _weights(y):
    n, pos = len(y), y.sum()
    return np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))


def test_supervised_matches_newton(spark):
    df = _demo(spark)
    clf = fit_classifiers(df, CONDITIONS, tol=1e-9)
    scored = {r.case_id: r for r in clf.predict_scores(df).collect()}
    ids = [v[0] for v in LABELED_DEMO]
    X = _matrix(df, clf, ids)
    assert np.allclose((X**2).sum(1), 1)
    for j, c in enumerate(CONDITIONS):
        y = np.array([float(v[2 + j]) for v in LABELED_DEMO])
        got = np.array([getattr(scored[i], f"{c}_score") for i in ids])
        assert np.abs(got - _newton(X, y, _weights(y))).max() < 1e-4


def test_library_solver_stays_far_from_the_optimum(spark):
    """Why the solver is our own: Spark ML's, on the same objective, ends well above the optimum's loss."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    df = dl_labeled(spark, SF001)
    rows = df.select("case_id", "quality").collect()
    ids = [r.case_id for r in rows]
    clf = fit_classifiers(df, ["quality"], tol=1e-9)
    X = _matrix(df, clf, ids)
    y = np.array([float(r.quality) for r in rows])
    w = _weights(y)

    def loss(b, b0):
        z = X @ b + b0
        return (w * (np.logaddexp(0, z) - y * z)).sum() / w.sum() + 0.5 / w.sum() * (b @ b)

    rows = [(Vectors.dense(x), float(t), float(v)) for x, t, v in zip(X, y, w)]
    data = spark.createDataFrame(rows, ["features", "label", "weight"]).coalesce(1).cache()
    m = LogisticRegression(weightCol="weight", regParam=1 / len(y), standardization=False, tol=1e-9, maxIter=100).fit(data)
    own = loss(*clf.models["quality"][:2])
    assert loss(m.coefficients.toArray(), m.intercept) > 1.05 * own


def test_repeated_and_missing_ids_and_the_bound_on_rows(spark):
    df = _demo(spark)
    same = df.withColumn("case_id", F.lit(None).cast("string"))
    a, b = fit_classifiers(df, CONDITIONS, tol=1e-8), fit_classifiers(same, CONDITIONS, tol=1e-8)
    assert all(np.allclose(a.models[c][0], b.models[c][0], atol=1e-5) for c in CONDITIONS)
    few = training_rows(df, CONDITIONS, "text", 10).collect()
    assert 3 <= len(few) <= 20 and sorted(few) == sorted(training_rows(df, CONDITIONS, "text", 10).collect())


N_MANY = 220_000


def _many(spark):
    """(N_MANY labelled rows of the words a and b, each with blanks of its own so that no two hash alike; the rows of
    (word, label) as two arrays)."""
    i = F.col("id")
    blanks = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x2003, 0x3000)))
    text = F.concat(F.when(i % 3 == 0, "a").otherwise("b"), F.translate(F.conv(i.cast("string"), 10, 8), "01234567", blanks))
    k = np.arange(N_MANY)
    return spark.range(N_MANY).select(text.alias("text"), (i * i % 11 < 4).cast("int").alias("y")), k % 3 == 0, (k * k % 11 < 4).astype(float)


def test_the_gradient_is_of_all_labelled_rows(spark):
    """Of over 200,000 it was of a sample by text hash."""
    df, a, y = _many(spark)
    got = {r.term: r.gradient for r in gradient_at_zero(df, ["y"]).collect()}
    r = _weights(y) * (0.5 - y) / N_MANY
    own = {"a": r[a].sum() / 3**0.5, "b": r[~a].sum() / 3**0.5}
    assert got == {None: pytest.approx(0, abs=1e-12)} | {t.format(c): pytest.approx(own[c], rel=1e-9) for c in own for t in (" {}", "{}", "{} ")}


def test_the_models_are_of_all_labelled_rows(spark):
    """Of over 200,000 they were of a sample by text hash."""
    df, a, y = _many(spark)
    clf = fit_classifiers(df, ["y"], tol=1e-9)
    assert clf.tfidf.n_docs == N_MANY
    texts = spark.createDataFrame([("a",), ("b",)], "text string")
    got = [r.y_score for r in clf.predict_scores(texts).orderBy("text").collect()]
    kinds = [(w, v) for w in (True, False) for v in (0.0, 1.0)]  # the rows are of four kinds: their sums of weights suffice
    X = np.array([[w] * 3 + [not w] * 3 for w, _ in kinds], float) / 3**0.5
    sums = np.array([_weights(y)[(a == w) & (y == v)].sum() for w, v in kinds])
    assert np.allclose(got, _newton(X, np.array([v for _, v in kinds]), sums)[::2], atol=1e-6)


def test_fit_predict(spark):
    texts = spark.createDataFrame([(1, LABELED_DEMO[0][1]), (1, LABELED_DEMO[1][1]), (None, "")], "case_id long, text string")
    out = fit_predict_scores(_demo(spark), texts, CONDITIONS)
    assert out.columns == ["case_id", "text", *[f"{c}_score" for c in CONDITIONS]] and out.count() == 3
    with pytest.raises(ValueError):
        fit_classifiers(_demo(spark), CONDITIONS).predict_scores(texts.drop("text"))


def test_boolean_labels_count_as_numbers(spark):
    df = _demo(spark)
    flags = df.withColumns({c: F.col(c) == 1 for c in CONDITIONS})
    assert training_report(flags, CONDITIONS).collect() == training_report(df, CONDITIONS).collect()
    assert [r.severity for r in label_report(flags, conditions=CONDITIONS).collect()] == ["pass"]


def test_reports(spark):
    df = spark.createDataFrame(LABELED_DEMO, "case_id string, text string, " + ", ".join(f"{c} int" for c in CONDITIONS))
    rep = label_report(df).collect()
    assert [r.severity for r in rep] == ["pass"]
    tr = training_report(df, CONDITIONS).collect()
    assert [(r.condition, r.n_training_cases, r.n_positive, r.n_negative) for r in tr] == [
        ("dissatisfaction", 30, 11, 19), ("policy_demand", 30, 12, 18), ("coproduction_request", 30, 12, 18)]
    bad = spark.createDataFrame([("a", 1, 2), ("b", 1, 0), ("", 1, 1)], "text string, x int, y int")
    rep = {(r.check, r.column): r.severity for r in label_report(bad, conditions=["x", "y", "z"]).collect()}
    assert rep[("negatives", "x")] == "error"
    assert rep[("binary_labels", "y")] == "error"
    assert rep[("label_column", "z")] == "error"
    assert rep[("empty_text", "text")] == "warning"
    assert "2" in next(r.message for r in label_report(bad, conditions=["x", "y", "z"]).collect() if r.check == "binary_labels")
