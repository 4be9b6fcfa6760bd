"""L2-penalised logistic regression with the data term computed by Spark.

Objective per condition (balanced class weights w_i, S = sum w_i = n):

    f(b, b0) = (1/S) * sum_i w_i * logloss(y_i, x_i.b + b0) + 1/(2 C S) * ||b||^2

Spark ML's own ``LogisticRegression`` optimises in internally standardised coordinates; with ``standardization=False``
the L2 penalty then weighs every feature by 1/std^2, which for sparse TF-IDF features makes the problem so
ill-conditioned that 1000 of its steps end far from the optimum (``tests/test_classify.py`` shows the gap). Here the
optimiser (L-BFGS, memory 10, stopping when max|gradient| <= tol or the relative decrease is below 64 eps, at most
``max_iter`` steps) runs on the driver over a vector of the vocabulary's size (at most its cap). Every evaluation of f
and its gradient, for all conditions together, is one Spark job over rows that are packed once, BLOCK at a time: margins
and partial sums of a task come from its blocks' non-zeros as whole arrays, then a grouped sum per feature, so that a
task sends at most one partial sum per feature and no task merges whole vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import col
from ..session import ship

FTOL = 64 * np.finfo(float).eps
#: Rows of a block.
BLOCK = 1024


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def packed(n_labels: int):
    """For ``mapInArrow``: BLOCK rows become one, their non-zeros and, per label, values ``_y<j>`` and weights ``_w<j>`` as
    bytes, and sums of weights."""
    schema = pa.schema([*((c, pa.binary()) for c in ("row", "idx", "val", "y", "w")), ("s", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                b = batch.slice(a, BLOCK)
                idx, val = b.column("idx"), b.column("val")
                row = np.repeat(np.arange(b.num_rows, dtype=np.int32), np.diff(idx.offsets.to_numpy()))
                y, w = (np.stack([b.column(f"{c}{j}").to_numpy(zero_copy_only=False) for j in range(n_labels)]) for c in ("_y", "_w"))
                parts = [row, idx.flatten().to_numpy().astype(np.int32), val.flatten().to_numpy().astype(float), y.astype(float), w.astype(float)]
                yield pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in parts), pa.array([w.sum(1)], schema.field("s").type)], schema=schema)

    return run


def partial_sums(points: list[tuple[int, np.ndarray, float]], n_labels: int):
    """For ``mapInArrow`` over packed rows: a task's sum of weighted losses and of their gradient, a line per feature and
    one, of feature -1, for loss and intercept."""
    k = len(points)
    names = ["i", *(f"g{j}" for j in range(k)), *(f"l{j}" for j in range(k))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(points[0][1])
        grad, own, loss = np.zeros((k, d)), np.zeros(k), np.zeros(k)
        for batch in batches:
            for line in batch.to_pylist():
                row, idx = (np.frombuffer(line[c], np.int32) for c in ("row", "idx"))
                val, y, w = (np.frombuffer(line[c], float) for c in ("val", "y", "w"))
                y, w = y.reshape(n_labels, -1), w.reshape(n_labels, -1)
                for j, (label, b, b0) in enumerate(points):
                    z = b0 + np.bincount(row, val * b[idx], minlength=y.shape[1])
                    e = np.exp(-np.abs(z))
                    r = w[label] * (np.where(z >= 0, 1.0, e) / (1.0 + e) - y[label])
                    loss[j] += (w[label] * (np.maximum(z, 0.0) + np.log1p(e) - y[label] * z)).sum()
                    own[j] += r.sum()
                    grad[j] += np.bincount(idx, val * r[row], minlength=d)
        at = np.flatnonzero(grad.any(0))
        i = np.concatenate([[-1], at])
        g = np.concatenate([own[:, None], grad[:, at]], 1)
        pad = np.concatenate([loss[:, None], np.zeros((k, len(at)))], 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), *map(pa.array, g), *map(pa.array, pad)], names)

    return run


def evaluate(blocks: DataFrame, n_labels: int, points: list[tuple[int, np.ndarray, float]]):
    """Per (number of the label, coefficients, intercept): the sum of weighted losses, its gradient, and that of the
    intercept, in one job over the packed rows."""
    k, d = len(points), len(points[0][1])
    names = [*(f"g{j}" for j in range(k)), *(f"l{j}" for j in range(k))]
    lines = blocks.drop("s").mapInArrow(partial_sums(points, n_labels), ", ".join(["i int", *(f"{c} double" for c in names)]))
    got = {r["i"]: r for r in lines.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect()}
    out = []
    for j in range(k):
        g = np.zeros(d)
        for i, r in got.items():
            if i >= 0:
                g[i] = r[f"g{j}"]
        out.append((got[-1][f"l{j}"] if -1 in got else 0.0, g, got[-1][f"g{j}"] if -1 in got else 0.0))
    return out


def _lbfgs(d: int, s_sum: float, reg: float, max_iter: int, tol: float, memory: int = 10):
    """Generator: yields trial points (b, b0), receives (loss_sum, grad_sum, grad0_sum)."""
    x = np.zeros(d + 1)

    def value(raw):
        loss, g, g0 = raw
        f = loss / s_sum + 0.5 * reg * float(x_trial[:-1] @ x_trial[:-1])
        grad = np.concatenate([g / s_sum + reg * x_trial[:-1], [g0 / s_sum]])
        return f, grad

    x_trial = x
    f, grad = value((yield (x[:-1], x[-1])))
    s_hist: list[np.ndarray] = []
    y_hist: list[np.ndarray] = []
    it = 0
    while it < max_iter and np.abs(grad).max() > tol:
        q = grad.copy()
        alphas = []
        for s, y in zip(reversed(s_hist), reversed(y_hist)):
            a = (s @ q) / (y @ s)
            alphas.append(a)
            q -= a * y
        if y_hist:
            q *= (s_hist[-1] @ y_hist[-1]) / (y_hist[-1] @ y_hist[-1])
        for (s, y), a in zip(zip(s_hist, y_hist), reversed(alphas)):
            q += s * (a - (y @ q) / (y @ s))
        direction = -q
        slope = float(grad @ direction)
        if slope >= 0:  # not a descent direction: restart from steepest descent
            s_hist.clear(), y_hist.clear()
            direction, slope = -grad, -float(grad @ grad)
        step = 1.0 if y_hist else min(1.0, 1.0 / max(np.abs(grad).sum(), 1e-12))
        while True:
            x_trial = x + step * direction
            f_new, g_new = value((yield (x_trial[:-1], x_trial[-1])))
            if f_new <= f + 1e-4 * step * slope or step < 1e-20:
                break
            # safeguarded quadratic interpolation of the step
            denom = 2.0 * (f_new - f - slope * step)
            step = max(0.1 * step, min(0.5 * step, -slope * step * step / denom if denom > 0 else 0.5 * step))
        s, y = x_trial - x, g_new - grad
        if s @ y > 1e-10 * (y @ y):
            s_hist.append(s), y_hist.append(y)
            if len(s_hist) > memory:
                s_hist.pop(0), y_hist.pop(0)
        done = (f - f_new) / max(abs(f), abs(f_new), 1.0) <= FTOL
        x, f, grad = x_trial, f_new, g_new
        it += 1
        if done:
            break
    return x[:-1], x[-1], it


def fit_logistic(
    data: DataFrame,
    labels: list[str],
    n_features: int,
    c: float = 1.0,
    max_iter: int = 1000,
    tol: float = 1e-4,
) -> dict[str, tuple[np.ndarray, float, int]]:
    """``data`` has a row's non-zero features as ``idx`` (array<int>) and ``val`` (array<double>), and per label column
    ``<label>`` (0/1 double) and ``<label>__w`` (sample weight). Returns, per label, (coefficients, intercept,
    iterations). The rows are packed and persisted for the time of the fit."""
    ship(data.sparkSession)
    pairs = [x for j, lab in enumerate(labels) for x in (col(lab).alias(f"_y{j}"), col(f"{lab}__w").alias(f"_w{j}"))]
    blocks = data.select("idx", "val", *pairs).mapInArrow(packed(len(labels)), "row binary, idx binary, val binary, y binary, w binary, s array<double>").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stats = blocks.agg(*[F.sum(F.col("s")[j]) for j in range(len(labels))]).first()
        gens, points, result = {}, {}, {}
        for j, lab in enumerate(labels):
            s_sum = float(stats[j])
            gens[lab] = _lbfgs(n_features, s_sum, 1.0 / (c * s_sum), max_iter, tol)
            points[lab] = next(gens[lab])
        while points:
            active = list(points)
            raw = evaluate(blocks, len(labels), [(labels.index(a), *points[a]) for a in active])
            for lab, r in zip(active, raw):
                try:
                    points[lab] = gens[lab].send(r)
                except StopIteration as stop:
                    result[lab] = stop.value
                    del points[lab]
    finally:
        blocks.unpersist()
    return result
