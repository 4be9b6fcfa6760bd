"""Exact, linearly interpolated quantiles with bounded memory per task.

Spark's exact ``percentile`` keeps every distinct value of a group in one buffer, which does not survive billions of
distinct scores. Here the input is read twice. The first scan makes a mergeable KLL sketch of each group, whose
quantiles a little below and above every wanted rank are pivots. The second counts the values between two pivots, one row
for each distinct value, and those outside only in total: the exact count of values below a pivot says which ranks stand
between. The few percent of rows that are left are written, and the ranks found in them by a distributed selection: each
pass is a grouped count over at most ``bins`` equal-width bins of the interval that still holds a rank, and the next
interval runs from the least to the greatest value found in that rank's bin, until these are equal. An interval's ends
always fall into different bins, so it shrinks in every pass; infinite values are counted apart and never part of an
interval. Should the sketch have missed a rank, its selection runs over the input. Only counts and sketches reach the
driver.
"""

from __future__ import annotations

import math
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

BINS = 4096
#: Size of the sketches (ranks within about 0.001 of the number of values), and distance of the pivots from a rank.
SKETCH, SLACK = 4096, 0.005
INF = float("inf")


def lerp(a: float, b: float, t: float) -> float:
    """Linear interpolation in the numerically symmetric form used by numpy; equal ends are exact, infinite ones too."""
    if a == b or t == 0.0:
        return a
    d = b - a
    return b - d * (1.0 - t) if t >= 0.5 else a + d * t


def exact_quantiles(values: DataFrame, column: str, probs: list[float], bins: int = BINS) -> dict:
    """Linear-interpolation quantiles of the non-null, non-NaN values of ``column`` (keyed by probability; the key
    ``"n"`` holds the number of values)."""
    out = grouped_quantiles(values.select(F.lit(0).alias("_g"), F.col(column).cast("double").alias("_v")), "_g", "_v", probs, bins)
    if 0 not in out:
        raise ValueError("there is no score that is neither null nor NaN")
    return out[0]


def grouped_quantiles(values: DataFrame, group: str, column: str, probs: list[float], bins: int = BINS) -> dict:
    """{group: {prob: value, "n": n}}, exact."""
    v = F.col(column).cast("double")
    clean = values.select(F.col(group).alias("_g"), v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    finite = F.when(F.abs("_v") < F.lit(INF), F.col("_v"))
    capped = F.greatest(F.least(F.col("_v"), F.lit(sys.float_info.max)), F.lit(-sys.float_info.max))
    wanted = sorted(set(probs))
    near = F.array(*[F.lit(float(min(max(p + d, 0.0), 1.0))) for p in wanted for d in (-SLACK, SLACK)])
    stats = clean.groupBy("_g").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_v") == -INF).alias("low"), F.count_if(F.col("_v") == INF).alias("high"),
        F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.kll_sketch_agg_double(capped, SKETCH).alias("sketch"),
    )
    stats = stats.withColumn("pivots", F.kll_sketch_get_quantile_double("sketch", near)).drop("sketch")
    size, low, found, open_ranks, pivots = {}, {}, {}, {}, {}
    for r in stats.collect():
        g, n = r["_g"], r["n"]
        size[g], low[g] = n, r["low"]
        for k, p in enumerate(wanted):
            at = int(math.floor((n - 1) * p))
            for rank in (at, min(at + 1, n - 1)):
                if rank < r["low"] or rank >= n - r["high"]:
                    found[g, rank] = -INF if rank < r["low"] else INF
                elif rank == r["low"] or rank == n - r["high"] - 1:
                    found[g, rank] = r["lo"] if rank == r["low"] else r["hi"]
                else:
                    open_ranks.setdefault(g, set()).add(rank)
                    pivots.setdefault(g, set()).add((r["pivots"][2 * k], r["pivots"][2 * k + 1]))
    if open_ranks:
        between, segments = _between(clean.filter(F.abs("_v") < F.lit(INF)), {g: _merged(x) for g, x in pivots.items()})
        inside, missed = {}, {}
        for g, ranks in open_ranks.items():
            before = low[g]
            for s, c, lo, hi in segments[g]:
                for rank in ranks:
                    if before <= rank < before + c:
                        (inside if s % 2 else missed)[g, rank] = (lo, hi, before)
                before += c
        found |= _selected(between, inside, bins)
        if missed:
            found |= _selected(clean.withColumn("_c", F.lit(1).cast("long")), missed, bins)
    out: dict = {}
    for g, n in size.items():
        out[g] = {"n": n}
        for p in probs:
            h = (n - 1) * p
            at = int(math.floor(h))
            out[g][p] = lerp(found[g, at], found[g, min(at + 1, n - 1)], h - at)
    return out


def _merged(spans: set[tuple]) -> list[tuple]:
    """Disjoint closed intervals in ascending order that cover ``spans``."""
    out: list[tuple] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _between(finite: DataFrame, spans: dict) -> tuple[DataFrame, dict]:
    """(the distinct values in the spans with counts: _g, _v, _c; {group: [(segment, count, least, greatest value)]} in
    order). Segment 2k + 1 is a group's k-th span, even ones are the gaps. One scan."""
    place = F.lit(None).cast("int")
    for g, own in spans.items():
        segment = F.lit(2 * len(own))
        for k in reversed(range(len(own))):
            segment = F.when(F.col("_v") < F.lit(own[k][0]), 2 * k).when(F.col("_v") <= F.lit(own[k][1]), 2 * k + 1).otherwise(segment)
        place = F.when(F.col("_g") == F.lit(g), segment).otherwise(place)
    rows = finite.withColumn("_s", place).filter(F.col("_s").isNotNull())
    counts = rows.groupBy("_g", "_s", F.when(F.col("_s") % 2 == 1, F.col("_v")).alias("_w")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    counts = stored(counts, "between-pivots")
    out: dict = {}
    for r in sorted(counts.groupBy("_g", "_s").agg(F.sum("_c").alias("c"), F.min("_lo").alias("lo"), F.max("_hi").alias("hi")).collect(), key=lambda r: r["_s"]):
        out.setdefault(r["_g"], []).append((r["_s"], r["c"], r["lo"], r["hi"]))
    return counts.filter(F.col("_w").isNotNull()).select("_g", F.col("_w").alias("_v"), "_c"), out


def _selected(rows: DataFrame, pending: dict, bins: int) -> dict:
    """{(group, rank): value} for ``pending`` {(group, rank): (least, greatest value, count of values before)}."""
    found = {}
    while pending:
        intervals: dict = {}
        for (g, rank), (lo, hi, before) in pending.items():
            if lo == hi:
                found[g, rank] = lo
            else:
                intervals.setdefault((g, lo, hi, before), []).append(rank)
        pending = {}
        if not intervals:
            break
        for k, hist in _counts(rows, list(intervals), bins).items():
            (g, _, _, before), ranks = list(intervals.items())[k]
            for rank in ranks:
                at = before
                for _, c, lo, hi in hist:
                    if rank < at + c:
                        pending[g, rank] = (lo, hi, at)
                        break
                    at += c
    return found


def _counts(values: DataFrame, intervals: list[tuple], bins: int) -> dict[int, list[tuple]]:
    """Per interval (of one group, disjoint or equal within it): (bin, count, least, greatest value) in order; one job."""
    which, lo_of, width_of, scale_of = None, [], [], []
    for k, (g, lo, hi, _) in enumerate(intervals):
        inside = (F.col("_g") == F.lit(g)) & (F.col("_v") >= F.lit(lo)) & (F.col("_v") <= F.lit(hi))
        which = F.when(inside, F.lit(k)) if which is None else which.when(inside, F.lit(k))
        scale = 0.25 if max(abs(lo), abs(hi)) > 1e300 else 1.0  # the width of an interval of huge values must not overflow
        lo_of.append(F.lit(float(lo * scale)))
        width_of.append(F.lit(max((hi * scale - lo * scale) / bins, 5e-324)))  # nor that of a tiny one vanish
        scale_of.append(F.lit(scale))
    rows = values.select(which.alias("_k"), "_v", "_c").filter(F.col("_k").isNotNull())
    of = lambda xs: F.element_at(F.array(*xs), F.col("_k") + 1)
    step = (F.col("_v") * of(scale_of) - of(lo_of)) / of(width_of)
    b = F.least(F.greatest(F.floor(step), F.lit(0)), F.lit(bins - 1)).cast("int")
    hist = rows.groupBy("_k", b.alias("b")).agg(F.sum("_c").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect()
    out: dict = {}
    for r in sorted(hist, key=lambda r: r["b"]):
        out.setdefault(r["_k"], []).append((r["b"], r["c"], r["lo"], r["hi"]))
    return out


def approx_quantiles(values: DataFrame, column: str, probs: list[float], accuracy: int = 100_000) -> dict[float, float]:
    """One bounded aggregate; ranks are within n/accuracy, values are not interpolated."""
    v = F.col(column).cast("double")
    row = values.filter(v.isNotNull() & ~F.isnan(v)).agg(F.percentile_approx(v, probs, accuracy).alias("q")).first()
    if row["q"] is None:
        raise ValueError("there is no score that is neither null nor NaN")
    return dict(zip(probs, row["q"]))
