"""Supervised scoring: TF-IDF features and one logistic regression per condition.

Each condition gets an L2-penalised logistic regression (C = 1) with balanced class weights w = n / (2 n_class), fitted
by :mod:`.logistic` over the persisted non-zeros of the labelled rows. A row's non-zeros are made of its own text and
stay beside its labels. The labelled rows and those to be fitted are written once. All labelled rows are fitted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .. import constants as K
from ..functions.names import col
from ..session import ship, stored
from .checks import _label_value, label_report, observe_labels, raise_on_error
from .grams import lowered, sparse_rows
from .logistic import fit_logistic, sigmoid
from .partitioning import text_partitions
from .tfidf import KEY, TfidfModel, fit_tfidf, normalized_dot_scores, text_key


@dataclass
class ConditionClassifier:
    """Fitted vectoriser and, per condition, coefficients, intercept and number of steps."""

    tfidf: TfidfModel
    models: dict[str, tuple[np.ndarray, float, int]] = field(default_factory=dict)
    text: str = "text"

    def predict_scores(self, texts: DataFrame) -> DataFrame:
        """Adds ``<condition>_score`` = P(label = 1) for every fitted condition; ids do not matter.

        The margin x.b of the normalised TF-IDF vector is counted where the text is read."""
        if not self.models:
            raise RuntimeError("fit the classifiers before predicting")
        if self.text not in texts.columns:
            raise ValueError(f"the texts to be scored have no column '{self.text}'")
        names = {c: f"{c}_score" for c in self.models}
        margins = normalized_dot_scores(texts, self.tfidf, {names[c]: list(m[0]) for c, m in self.models.items()}, self.text)
        return margins.withColumns({names[c]: sigmoid(col(names[c]) + F.lit(float(m[1]))) for c, m in self.models.items()})


def training_rows(labeled: DataFrame, conditions: list[str], text: str, max_rows: int | None = None) -> DataFrame:
    """(_h1, _h2, text, conditions as 0/1 doubles) of all labelled rows. Only a caller who names ``max_rows`` gets fewer: the
    rows whose text hash lies below a fraction of its range, about ``max_rows`` that every run draws alike."""
    base = labeled.select(
        *text_key(col(text)),
        F.coalesce(col(text).cast("string"), F.lit("")).alias(text),
        *[_label_value(labeled, c).cast("double").alias(c) for c in conditions],
    )
    if max_rows is None or (n := labeled.count()) <= max_rows:
        return base
    return base.filter(F.pmod("_h1", F.lit(1 << 30)) < F.lit(int((1 << 30) * max_rows / n)))


def features(base: DataFrame, model: TfidfModel, text: str) -> DataFrame:
    """``base`` without its text, with its rows' non-zero features as arrays ``idx`` and ``val`` (empty without a known term)."""
    ship(base.sparkSession)
    names = [c for c in base.columns if c not in (text, *KEY)]
    own = {f"_c{j}": c for j, c in enumerate(names)}
    rows = base.select(*[col(c).alias(k) for k, c in own.items()], lowered(col(text)).alias("_low"))
    schema = StructType([*rows.drop("_low").schema, StructField("idx", ArrayType(IntegerType())), StructField("val", ArrayType(DoubleType()))])
    return rows.mapInArrow(sparse_rows(model.terms, model.idf, [*own]), schema).withColumnsRenamed(own)


def checked(labeled: DataFrame, conditions: list[str], text: str) -> DataFrame:
    """The labelled rows, written once, if their report has no error; its counts are metrics of that write."""
    if text not in labeled.columns or not conditions:
        raise_on_error(label_report(labeled, text, conditions), "labeled data")
    used = dict.fromkeys(c for c in (text, *conditions) if c in labeled.columns)
    rows, report, _ = observe_labels(labeled.select(*map(col, used)), text, conditions)
    rows = stored(rows, "labeled")
    raise_on_error(report(), "labeled data")
    return rows


def dealt(base: DataFrame) -> DataFrame:
    """The rows to be fitted, written once and dealt to all cores, copies of a text as well; every step of the fit reads these."""
    return stored(base.repartition(text_partitions(base, 1)), "training-rows")


def weighted(base: DataFrame, conditions: list[str]) -> DataFrame:
    """``base`` with the balanced weight ``<condition>__w`` of each row for each condition."""
    counts = base.agg(F.count(F.lit(1)), *[F.sum(col(c)) for c in conditions]).first()
    n = counts[0]
    weights = {}
    for j, c in enumerate(conditions):
        pos = counts[j + 1] or 0.0
        if pos == 0 or pos == n:
            raise ValueError(f"condition '{c}': labels of both kinds are needed")
        weights[f"{c}__w"] = F.when(col(c) == 1, F.lit(n / (2.0 * pos))).otherwise(F.lit(n / (2.0 * (n - pos))))
    return base.withColumns(weights)


def fit_classifiers(
    labeled: DataFrame,
    conditions: list[str],
    text: str = "text",
    max_iter: int = K.MAX_ITER,
    tol: float = 1e-4,
    validate: bool = True,
    max_rows: int | None = None,
) -> ConditionClassifier:
    """Validate, fit the vocabulary on the labelled texts, then one model per condition, over all labelled rows unless
    ``max_rows`` is named."""
    if validate:
        labeled = checked(labeled, conditions, text)
    base = dealt(training_rows(labeled, conditions, text, max_rows))
    model = fit_tfidf(base, text)
    data = features(weighted(base, conditions), model, text)
    fitted = fit_logistic(data, conditions, len(model.terms), max_iter=max_iter, tol=tol)
    return ConditionClassifier(model, {c: fitted[c] for c in conditions}, text)


def fit_predict_scores(labeled: DataFrame, texts: DataFrame, conditions: list[str], text: str = "text") -> DataFrame:
    return fit_classifiers(labeled, conditions, text).predict_scores(texts)


def gradient_at_zero(labeled: DataFrame, conditions: list[str], text: str = "text") -> DataFrame:
    """(condition, term, gradient): the class-weighted gradient of the mean log loss at zero coefficients, per term;
    the intercept's has the term null. What the solver sees of the data in its first step, in long form."""
    base = dealt(training_rows(labeled, conditions, text))
    model = fit_tfidf(base, text)
    rows = weighted(base, conditions)
    residual = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), (col(f"{c}__w") * (F.lit(0.5) - col(c))).alias("r"), col(f"{c}__w").alias("w")) for c in conditions]))
    long = rows.select(*KEY, residual.alias("x")).select(*KEY, "x.*")
    own = long.groupBy("condition").agg(F.sum("r").alias("g"), F.sum("w").alias("w"))
    per_text = long.groupBy(*KEY, "condition").agg(F.sum("r").alias("r"))
    terms = per_text.join(model.vectors(base, text), KEY).groupBy("condition", "term").agg(F.sum(F.col("r") * F.col("weight")).alias("g"))
    both = terms.unionByName(own.select("condition", F.lit(None).cast("string").alias("term"), "g"))
    return both.join(own.select("condition", "w"), "condition").select("condition", "term", (F.col("g") / F.col("w")).alias("gradient"))
