"""Truth table, configuration members and solution configurations (crisp-set QCA).

Plan shape of :func:`truth_table`: one hash aggregate grouped by the condition
columns (partial aggregate in every map task, so at most 2^m rows per task cross the
shuffle), then a window over the <= 2^m aggregated rows for the grand total of
positives (no second scan of the input), then a sort of those few rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import col
from .. import constants as K
from ..functions.labels import configuration_label, solution_sentence, status
from ..session import stored
from .columns import condition_columns
from .running import running

TT_MEASURES = ["configuration", "n_cases", "outcome_positive_cases", "consistency", "raw_coverage"]


def _crisp_guard(conditions: list[str], outcome_flag: Column, validate: bool) -> Column:
    """Row filter on aggregated groups that raises on non-crisp or missing values.

    Invalid condition values show up as group keys, an invalid outcome as a per-group
    flag, so the check costs nothing beyond the aggregate itself and stays lazy.
    """
    checks = []
    for c in conditions:
        bad = col(c).isNotNull() & ~col(c).isin(0, 1)
        msg = F.concat(
            F.lit(f"'{c}' must be 0 or 1 to be analysed, but holds "),
            col(c).cast("string"),
            F.lit("; calibrate it to crisp membership first."),
        )
        checks.append((bad, msg))
        if validate:
            checks.append(
                (col(c).isNull(), F.lit(f"'{c}' must be 0 or 1 in every row, but is missing in some."))
            )
    checks.append((outcome_flag, F.lit("the outcome must be 0 or 1 (or missing), but holds another value.")))
    expr = F.lit(True)
    for bad, msg in reversed(checks):
        expr = F.when(bad, F.raise_error(msg)).otherwise(expr)
    return expr


def all_present(columns: list[str]) -> Column:
    expr = F.lit(True)
    for c in columns:
        expr = expr & col(c).isNotNull()
    return expr


def truth_table(
    qca: DataFrame,
    conditions: list[str] | None = None,
    outcome: str = "outcome",
    case_id: str = "case_id",
    consistency_cutoff: float = K.DEFAULT_CONSISTENCY_CUTOFF,
    min_cases: int = K.DEFAULT_MIN_CASES,
    contradiction_lower: float = K.DEFAULT_CONTRADICTION_LOWER,
    contradiction_upper: float = K.DEFAULT_CONTRADICTION_UPPER,
    with_cases: bool = False,
    max_cases: int = K.MAX_LISTED_CASES,
    order_col: str | None = None,
    validate: bool = True,
    sort: bool = True,
) -> DataFrame:
    """One row per observed configuration of 0/1 conditions.

    Columns: conditions (int), ``configuration``, ``n_cases``, ``outcome_positive_cases``,
    ``consistency`` and ``raw_coverage`` (half-even, 4 places), optional ``cases``, ``status``.

    ``with_cases`` adds the first ``max_cases`` ids of each configuration as ``"1, 7"`` (with ``", ..."`` when there
    are more); :func:`configuration_members` has them all.
    ``validate`` raises (lazily, inside the job) on non-crisp values or missing
    conditions; with ``validate=False`` rows with a missing condition are dropped after
    the grand total is taken.
    """
    if conditions is None:
        conditions = condition_columns(qca, case_id=case_id, outcome=outcome)
    o = col(outcome)
    aggs = [
        F.count(F.lit(1)).alias("n_cases"),
        F.coalesce(F.sum(o.cast("long")), F.lit(0).cast("long")).alias("outcome_positive_cases"),
        F.max(o.isNotNull() & ~o.isin(0, 1)).alias("_bad_outcome"),
    ]
    grouped = qca.groupBy(*[col(c) for c in conditions]).agg(*aggs)
    if with_cases:
        listed = listed_cases(qca, conditions, case_id, order_col or case_id, max_cases)
        same = [col(c).eqNullSafe(F.col(f"_k{j}")) for j, c in enumerate(conditions)]
        grouped = grouped.join(listed, reduce(and_, same), "left").drop(*[f"_k{j}" for j in range(len(conditions))])
    return finish_truth_table(
        grouped,
        conditions,
        consistency_cutoff=consistency_cutoff,
        min_cases=min_cases,
        contradiction_lower=contradiction_lower,
        contradiction_upper=contradiction_upper,
        validate=validate,
        sort=sort,
    )


def listed_cases(qca: DataFrame, conditions: list[str], case_id: str, order_col: str, max_cases: int) -> DataFrame:
    """(_k0 ..., _members): the first ids of each configuration. The bound on the row number is applied in every task
    before the shuffle, so no task gathers a configuration."""
    if case_id not in qca.columns:
        raise ValueError(f"no case id column '{case_id}', which the list of cases needs")
    keys = [col(c).alias(f"_k{j}") for j, c in enumerate(conditions)]
    rows = qca.select(*keys, col(order_col).alias("_o"), col(case_id).cast("string").alias("_id"))
    first = Window.partitionBy(*[f"_k{j}" for j in range(len(conditions))]).orderBy("_o", "_id")
    rows = rows.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= max_cases + 1)
    rows = rows.withColumn("_id", F.when(F.col("_rn") <= max_cases, F.col("_id")).otherwise(F.lit("...")))
    members = F.sort_array(F.collect_list(F.struct(F.col("_rn").alias("k"), F.col("_id").alias("id"))))
    return rows.groupBy(*[f"_k{j}" for j in range(len(conditions))]).agg(members.alias("_members"))


def finish_truth_table(
    grouped: DataFrame,
    conditions: list[str],
    by: list[str] | None = None,
    consistency_cutoff: float = K.DEFAULT_CONSISTENCY_CUTOFF,
    min_cases: int = K.DEFAULT_MIN_CASES,
    contradiction_lower: float = K.DEFAULT_CONTRADICTION_LOWER,
    contradiction_upper: float = K.DEFAULT_CONTRADICTION_UPPER,
    validate: bool = True,
    sort: bool = True,
) -> DataFrame:
    """Measures, label and status from aggregated groups.

    ``grouped`` has the ``by`` columns, the conditions, ``n_cases``,
    ``outcome_positive_cases``, ``_bad_outcome`` and optionally ``_members``. The grand
    total of positives (per ``by`` group) is a window over the aggregated rows -- at
    most 2^m per ``by`` value, whatever the number of cases. A separate global sum
    joined back would read the input a second time (column pruning makes the two
    aggregates differ, so Spark cannot reuse the exchange).
    """
    by = by or []
    total = F.sum("outcome_positive_cases").over(Window.partitionBy(*[col(b) for b in by]))
    cons = F.col("outcome_positive_cases") / F.col("n_cases")
    cov = F.try_divide(F.col("outcome_positive_cases").cast("double"), total.cast("double"))
    # the guard stays below the window: a wrong column (an id, a raw score) fails before its groups meet in one task
    guarded = grouped.filter(_crisp_guard(conditions, F.col("_bad_outcome"), validate))
    out = guarded.withColumn("_cons", cons).withColumn("_cov", cov)
    if not validate:
        out = out.filter(all_present(conditions))
    cols = [col(b) for b in by] + [col(c).cast("int").alias(c) for c in conditions] + [
        configuration_label(conditions).alias("configuration"),
        F.col("n_cases"),
        F.col("outcome_positive_cases"),
        F.bround("_cons", 4).alias("consistency"),
        F.bround("_cov", 4).alias("raw_coverage"),
    ]
    if "_members" in grouped.columns:
        cols.append(F.array_join(F.transform("_members", lambda m: m["id"]), ", ").alias("cases"))
    cols.append(
        status(F.col("_cons"), F.col("n_cases"), consistency_cutoff, min_cases, contradiction_lower, contradiction_upper).alias(
            "status"
        )
    )
    out = out.select(*cols)
    if sort:
        out = out.orderBy(*[col(b) for b in by], *truth_table_order(conditions))
    return out


def truth_table_order(conditions: list[str]) -> list[Column]:
    """status asc, consistency desc, n_cases desc, then condition values (stable tie order)."""
    return [F.col("status").asc(), F.col("consistency").desc(), F.col("n_cases").desc()] + [
        col(c).asc() for c in conditions
    ]


def conditions_of(tt: DataFrame) -> list[str]:
    """Condition columns of a truth table: everything before ``configuration``."""
    cols = tt.columns
    return cols[: cols.index("configuration")]


def solutions(
    tt: DataFrame,
    consistency_cutoff: float = K.DEFAULT_CONSISTENCY_CUTOFF,
    min_cases: int = K.DEFAULT_MIN_CASES,
    conditions: list[str] | None = None,
    partition_by: list[str] | None = None,
) -> DataFrame:
    """Sufficient configurations numbered 1..k in truth-table order.

    The filter re-tests the *rounded* consistency, as the published outputs do.
    ``partition_by`` restarts the numbering per group (e.g. per threshold).
    """
    if conditions is None:
        conditions = conditions_of(tt)
    part = partition_by or []
    w = Window.partitionBy(*part).orderBy(*truth_table_order(conditions))
    sol = tt.filter(
        (F.col("consistency") >= F.lit(consistency_cutoff))
        & (F.col("n_cases") >= F.lit(min_cases))
        & (F.col("status") == F.lit(K.STATUS_SUFFICIENT))
    ).withColumn("solution_id", F.row_number().over(w))
    keep = part + ["solution_id"] + TT_MEASURES
    if "cases" in tt.columns:
        keep.append("cases")
    sol = sol.withColumn(
        "interpretation",
        solution_sentence(F.col("configuration"), F.col("outcome_positive_cases"), F.col("n_cases")),
    )
    return sol.select(*keep, "interpretation").orderBy(*[F.col(p) for p in part], "solution_id")


def configuration_members(
    qca: DataFrame,
    conditions: list[str],
    case_id: str = "case_id",
    outcome: str = "outcome",
    tt: DataFrame | None = None,
) -> DataFrame:
    """Long form of the case lists: one row per case with its configuration label.

    Narrow (a projection). When a truth table is given, its status is attached; the (at most 2^m) statuses are written
    first, so that Spark broadcasts them when they are below its threshold.
    """
    members = qca.select(
        col(case_id),
        *[col(c).cast("int").alias(c) for c in conditions],
        configuration_label(conditions).alias("configuration"),
        col(outcome),
    ).filter(all_present(conditions))
    if tt is not None:
        members = members.join(stored(tt.select("configuration", "status"), "statuses"), "configuration", "left")
    return members


def configuration_positions(qca: DataFrame, conditions: list[str], case_id: str = "case_id", order_col: str | None = None) -> DataFrame:
    """(configuration, position, case id) of all cases: the whole list of cases of every configuration, positions from 1 in
    the order of ``order_col`` (default: the id). Rows with a missing condition are left out. Configurations are numbered
    through ranges of rows and running sums, so one that holds most cases is spread over all tasks."""
    order = order_col or case_id
    rows = qca.filter(all_present(conditions)).select(configuration_label(conditions).alias("configuration"), col(case_id), col(order).alias("_order"), F.lit(1).cast("long").alias("position"))
    return running(stored(rows, "cases"), ["configuration"], "_order", ["position"], "cases-ordered").select("configuration", "position", col(case_id))
