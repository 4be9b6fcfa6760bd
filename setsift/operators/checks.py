"""Input checks as lazy report DataFrames, and a gate that raises on errors.

Each report is built from one global aggregate over the checked table (a single row,
whatever the table size) that is then unfolded into issue rows; nothing proportional
to the data reaches the driver. The prototype report has a line per affected row, from one
pass over the table.

Where a run writes the checked table anyway, ``observe_labels`` and ``observe_crisp`` have the same aggregates collected
as metrics of that write, so the reports need no job over the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.names import col
from .. import constants as K
from ..functions.text import is_blank, word_count
from ..session import stored

#: Values, of those that a check objects to, that its message names.
FOUND_VALUES = 5
ISSUE_SCHEMA = "check string, column string, severity string, message string"


def _issue(check: str, column: Column | str | None, severity: str, message: Column | str) -> Column:
    col = column if isinstance(column, Column) else F.lit(column).cast("string")
    msg = message if isinstance(message, Column) else F.lit(message)
    return F.struct(
        F.lit(check).alias("check"), col.alias("column"), F.lit(severity).alias("severity"), msg.alias("message")
    )


def _unfold(one_row: DataFrame, candidates: list[tuple[Column, Column]]) -> DataFrame:
    """(condition, issue struct) pairs over a one-row frame -> issue rows in order."""
    items = [F.when(cond, F.struct(F.lit(i).alias("_ord"), issue.alias("i"))) for i, (cond, issue) in enumerate(candidates)]
    exploded = one_row.select(F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("x"))
    return exploded.select("x._ord", "x.i.*")


def _with_pass(issues: DataFrame, check: str, message: str) -> DataFrame:
    """The issues in order; a single pass row when there is none."""
    none = F.array(F.struct(F.lit(10_000).alias("_ord"), F.lit(check).alias("check"), F.lit(None).cast("string").alias("column"), F.lit("pass").alias("severity"), F.lit(message).alias("message")))
    return _or_pass(issues, none).orderBy("_ord").drop("_ord")


def _static(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ISSUE_SCHEMA)


# ------------------------------------------------------------------ crisp domain (QCA input)
def _crisp_counts(columns: list[str]) -> list[Column]:
    aggs = []
    for i, c in enumerate(columns):
        v = col(c).cast("double")
        bad = v.isNotNull() & ~v.isin(0.0, 1.0)
        aggs += [
            F.count_if(col(c).isNull()).alias(f"missing{i}"),
            F.count_if(bad).alias(f"invalid{i}"),
            F.min(F.when(bad, v)).alias(f"min{i}"),
            F.max(F.when(bad, v)).alias(f"max{i}"),
        ]
    return [*aggs, F.count(F.lit(1)).alias("__rows")]


def _crisp_rows(one: DataFrame, columns: list[str]) -> DataFrame:
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("_ord"),
                    F.lit(c).alias("column"),
                    F.col("__rows").alias("n_rows"),
                    F.col(f"missing{i}").alias("n_missing"),
                    F.col(f"invalid{i}").alias("n_invalid"),
                    F.col(f"min{i}").alias("min_invalid"),
                    F.col(f"max{i}").alias("max_invalid"),
                )
                for i, c in enumerate(columns)
            ]
        )
    )
    out = one.select(rows.alias("r")).select("r.*")
    return out.withColumn(
        "severity", F.when(F.col("n_invalid") > 0, F.lit("error")).otherwise(F.lit("pass"))
    ).orderBy("_ord").drop("_ord")


def crisp_domain_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: missing count, non-0/1 count, smallest and largest invalid value."""
    return _crisp_rows(df.agg(*_crisp_counts(columns)), columns)


def _observed(df: DataFrame, name: str, aggs: list[Column]) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """(``df`` whose first action collects ``aggs``, the function that gives them as a one-row table after it).

    The first action should write ``df`` or count it, with nothing between that repeats or drops rows: metrics are
    those of the rows that pass."""
    schema = df.limit(0).agg(*aggs).schema  # types only, no job
    seen = Observation(name)

    def one_row() -> DataFrame:
        values = seen.get
        return df.sparkSession.createDataFrame([tuple(values[f.name] for f in schema)], schema)

    return df.observe(seen, *aggs), one_row


def observe_crisp(df: DataFrame, columns: list[str]) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """(``df`` to be written, function giving its ``crisp_domain_report`` once it has been written)."""
    out, one = _observed(df, "crisp_domain", _crisp_counts(columns))
    return out, lambda: _crisp_rows(one(), columns)


def require_crisp(df: DataFrame, columns: list[str]) -> None:
    """Raise naming the first column with a value outside {0, 1} (missing values pass)."""
    bad = crisp_domain_report(df, columns).filter(F.col("severity") == "error").limit(1).collect()
    if bad:
        name = bad[0]["column"]
        v = col(name).cast("double")
        found = [r[0] for r in df.filter(v.isNotNull() & ~v.isin(0.0, 1.0)).groupBy(v.alias("v")).count().orderBy("v").limit(FOUND_VALUES).select("v").collect()]
        raise ValueError(f"'{name}' must be 0 or 1 to be analysed, but holds {', '.join(map(str, found))}; calibrate it to crisp membership first.")


# ------------------------------------------------------------------ labeled data
def _binary_ok(df: DataFrame, c: str) -> Column:
    dt = dict(df.dtypes)[c]
    v = col(c)
    if dt == "string":
        ok = v.isin("0", "1")
    elif dt == "boolean":
        ok = F.lit(True)
    else:
        ok = v.cast("double").isin(0.0, 1.0)
    return F.coalesce(F.bool_and(v.isNull() | ok), F.lit(True))


def binary_label_columns_report(df: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """(column_name, is_binary) for every candidate column, in table order (one aggregate)."""
    ex = set(K.LABEL_EXCLUDE_COLUMNS if exclude is None else exclude)
    cands = [c for c in df.columns if c not in ex]
    if not cands:
        return df.sparkSession.createDataFrame([], "column_name string, is_binary boolean")
    one = df.agg(*[_binary_ok(df, c).alias(f"b{i}") for i, c in enumerate(cands)])
    rows = F.explode(
        F.array(*[F.struct(F.lit(i).alias("_ord"), F.lit(c).alias("column_name"), F.col(f"b{i}").alias("is_binary")) for i, c in enumerate(cands)])
    )
    return one.select(rows.alias("r")).select("r.*").orderBy("_ord").drop("_ord")


def binary_label_columns(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    """Names of the 0/1 label columns (runs one small aggregate)."""
    return [r["column_name"] for r in binary_label_columns_report(df, exclude).collect() if r["is_binary"]]


def _label_value(df: DataFrame, c: str) -> Column:
    """0/1 label with missing (or unparsable) as 0."""
    if dict(df.dtypes)[c] == "boolean":
        return F.coalesce(col(c), F.lit(False)).cast("int")
    return F.coalesce(col(c).cast("string").try_cast("double"), F.lit(0.0)).cast("int")


def _objectionable(df: DataFrame, c: str) -> Column:
    """The least and the greatest value of a label column that are neither 0 nor 1, as text; at most two, whatever the
    column holds."""
    v = col(c).cast("string")
    kind = dict(df.dtypes)[c]
    good = F.lit(True) if kind == "boolean" else v.isin("0", "1") if kind == "string" else F.coalesce(col(c).cast("double").isin(0.0, 1.0), F.lit(False))
    bad = F.when(col(c).isNotNull() & ~good, v)
    return F.array_join(F.array_distinct(F.array_compact(F.array(F.min(bad), F.max(bad)))), ", ")


def _label_counts(df: DataFrame, text: str, conditions: list[str]) -> list[Column]:
    aggs = [F.count(F.lit(1)).alias("__n"), F.count_if(is_blank(col(text))).alias("__blank")]
    for i, c in enumerate(c for c in conditions if c in df.columns):
        aggs += [_binary_ok(df, c).alias(f"ok{i}"), F.sum(_label_value(df, c)).alias(f"pos{i}"), _objectionable(df, c).alias(f"bad{i}")]
    return aggs


def _label_issues(one: DataFrame, columns: list[str], text: str, conditions: list[str]) -> DataFrame:
    """The report from the one row of ``_label_counts``; ``columns`` are those of the checked table."""
    present = [c for c in conditions if c in columns]
    cands: list[tuple[Column, Column]] = []
    for c in conditions:
        if c not in columns:
            cands.append((F.lit(True), _issue("label_column", c, "error", f"There is no label column '{c}'.")))
            continue
        i = present.index(c)
        ok, pos = F.col(f"ok{i}"), F.coalesce(F.col(f"pos{i}"), F.lit(0)).cast("long")
        neg = F.col("__n") - pos
        cands += [
            (~ok, _issue("binary_labels", c, "error", F.concat(F.lit(f"Labels of '{c}' are neither 0 nor 1: "), F.col(f"bad{i}"), F.lit(".")))),
            (ok & (pos == 0), _issue("positives", c, "error",
                                     f"No row is labelled 1 for '{c}', so nothing can be learnt.")),
            (ok & (neg == 0), _issue("negatives", c, "error",
                                     f"No row is labelled 0 for '{c}', so nothing can be learnt.")),
            (
                ok & (((pos > 0) & (pos < K.FEW_EXAMPLES)) | ((neg > 0) & (neg < K.FEW_EXAMPLES))),
                _issue("few_examples", c, "warning", F.format_string(
                    f"'{c}' has %d rows labelled 1 and %d labelled 0: too few for steady predictions.", pos, neg)),
            ),
        ]
    cands.append(
        (F.col("__blank") > 0, _issue("empty_text", text, "warning", F.format_string("%d rows have no text.", F.col("__blank"))))
    )
    return _with_pass(_unfold(one, cands), "labeled_data", "Nothing to object to.")


def label_report(df: DataFrame, text: str = "text", conditions: list[str] | None = None) -> DataFrame:
    """Checks of a labeled training table (severity error / warning / pass)."""
    spark = df.sparkSession
    if text not in df.columns:
        return _static(spark, [("text_column", text, "error", f"There is no text column '{text}'.")])
    if conditions is None:
        conditions = binary_label_columns(df, [c if c != "text" else text for c in K.LABEL_EXCLUDE_COLUMNS])
    if not conditions:
        return _static(
            spark,
            [("label_columns", None, "error",
              "There is no column of 0/1 labels to learn a condition from.")],
        )
    return _label_issues(df.agg(*_label_counts(df, text, conditions)), df.columns, text, conditions)


def observe_labels(df: DataFrame, text: str, conditions: list[str]) -> tuple[DataFrame, Callable[[], DataFrame], Callable[[], DataFrame]]:
    """(``df`` to be written, functions giving its ``label_report`` and its ``training_report`` once it has been written).

    The text column must be there; conditions may be missing, which the report says (the training report leaves them
    out)."""
    out, one = _observed(df, "labels", _label_counts(df, text, conditions))
    present = [c for c in conditions if c in df.columns]
    training = lambda: _training_rows(one().withColumnsRenamed({f"pos{i}": f"p{i}" for i in range(len(present))}), present)
    return out, lambda: _label_issues(one(), df.columns, text, conditions), training


def training_report(df: DataFrame, conditions: list[str]) -> DataFrame:
    """condition, n_training_cases, n_positive, n_negative, positive_rate (4 places)."""
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.sum(_label_value(df, c)).cast("long").alias(f"p{i}") for i, c in enumerate(conditions)])
    return _training_rows(one, conditions)


def _training_rows(one: DataFrame, conditions: list[str]) -> DataFrame:
    rows = F.explode(
        F.array(*[F.struct(F.lit(i).alias("_ord"), F.lit(c).alias("condition"), F.coalesce(F.col(f"p{i}"), F.lit(0).cast("long")).alias("pos")) for i, c in enumerate(conditions)])
    )
    r = one.select("__n", rows.alias("r"))
    return r.select(
        "r._ord",
        "r.condition",
        F.col("__n").alias("n_training_cases"),
        F.col("r.pos").alias("n_positive"),
        (F.col("__n") - F.col("r.pos")).alias("n_negative"),
        F.bround(F.try_divide(F.col("r.pos").cast("double"), F.col("__n").cast("double")), 4).alias("positive_rate"),
    ).orderBy("_ord").drop("_ord")


# ------------------------------------------------------------------ prototypes
def raise_on_error(report: DataFrame, what: str = "input") -> None:
    """Stop the run when a report holds any error row (one tiny job)."""
    bad = report.filter(F.col("severity") == F.lit("error")).limit(1).collect()
    if bad:
        raise ValueError(f"{what}: {bad[0]['message']}")


def prototype_issues(prototypes: DataFrame) -> DataFrame:
    """Checks of a prototype table: ``check, column, severity, item, message``, one row per affected item.

    A missing column (nothing else is checked then), empty values, repeated names, unknown types, no condition at all
    (errors), very short or long prototypes (warnings), outcome rows (info); a single pass row when nothing is found.
    The table is read once: each row tells all that concerns it alone, and names, types and the table as a whole are
    three more lines a row of one grouped count, which adds up in every task before it is shuffled.
    """
    spark = prototypes.sparkSession
    missing = [c for c in K.PROTOTYPE_COLUMNS if c not in prototypes.columns]
    if missing:
        return spark.createDataFrame([("required_column", c, "error", c, f"There is no column '{c}'.") for c in missing], "check string, column string, severity string, item string, message string")
    p = prototypes.select(*[F.coalesce(col(c).cast("string"), F.lit("nan")).alias(c) for c in K.PROTOTYPE_COLUMNS])
    name, typ = F.col("condition_name"), F.col("type")
    n_words = word_count(F.col("prototype"))

    def line(order: int, key: Column, cond: Column | None = None, words: Column | None = None) -> Column:
        entry = F.struct(F.lit(order).alias("o"), key.cast("string").alias("item"), (words if words is not None else F.lit(None).cast("int")).alias("w"), typ.alias("t"))
        return entry if cond is None else F.when(cond, entry)

    lines = [line(i, name, is_blank(col(c))) for i, c in enumerate(K.PROTOTYPE_COLUMNS)]
    lines += [
        line(3, name),
        line(4, typ, ~typ.isin(*K.PROTOTYPE_TYPES)),
        line(6, name, n_words < K.SHORT_PROTOTYPE_WORDS, n_words),
        line(7, name, n_words > K.LONG_PROTOTYPE_WORDS, n_words),
        line(9, F.lit(None)),
    ]
    per_row = p.select(F.explode(F.array_compact(F.array(*lines))).alias("x")).select("x.*")
    always = spark.range(1).select(F.lit(9).alias("o"), F.lit(None).cast("string").alias("item"), F.lit(None).cast("int").alias("w"), F.lit(None).cast("string").alias("t"))
    per_row = per_row.unionByName(always)  # an empty table has its say as well
    # row numbers 0-2, 6, 7 keep a line per affected row; 3, 4 and 9 are judged by their counts
    counted = per_row.groupBy("o", "item", "w").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("t") == "condition").alias("nc"), F.count_if(F.col("t") == "outcome").alias("no"))
    o, k, item = F.col("o"), F.col("k"), F.col("item")

    def issue(order: int, check: str, column: str | None, severity: str, message: Column | str, times: Column | None = None) -> Column:
        return F.struct(
            F.lit(order).alias("_ord"), F.lit(check).alias("check"), F.lit(column).cast("string").alias("column"), F.lit(severity).alias("severity"),
            (message if isinstance(message, Column) else F.lit(message)).alias("message"), (F.lit(1).cast("long") if times is None else times).alias("_times"),
        )

    found = [(o == i, issue(i, "empty_value", c, "error", f"'{c}' is empty.", k)) for i, c in enumerate(K.PROTOTYPE_COLUMNS)]
    found += [
        ((o == 3) & (k > 1), issue(3, "duplicate_condition_name", "condition_name", "error", F.format_string("'%s' names %d rows; only the last would be used.", item, k))),
        (o == 4, issue(4, "invalid_type", "type", "error", F.format_string("'%s' is no type; a row is of type 'condition' or 'outcome'.", item))),
        ((o == 9) & (F.col("nc") == 0), issue(5, "no_condition_prototype", "type", "error", "No row is of type 'condition', so nothing can be scored.")),
        (o == 6, issue(6, "short_prototype", "prototype", "warning", F.format_string("The prototype of '%s' has only %d words; scores may be unsteady.", item, F.col("w")), k)),
        (o == 7, issue(7, "long_prototype", "prototype", "warning", F.format_string("The prototype of '%s' has %d words; it may mix several concepts.", item, F.col("w")), k)),
        ((o == 9) & (F.col("no") > 0), issue(8, "outcome_prototype_notice", "type", "info", F.format_string("%d rows are of type 'outcome'; they are not scored unless asked for.", F.col("no")))),
    ]
    issues = counted.select("item", F.explode(F.array_compact(F.array(*[F.when(c, x) for c, x in found]))).alias("x")).select("item", "x.*")
    issues = issues.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))).alias("_n")).drop("_n", "_times")
    none = F.array(F.struct(F.lit(99).alias("_ord"), F.lit("prototype_quality").alias("check"), F.lit(None).cast("string").alias("column"), F.lit("pass").alias("severity"), F.lit(None).cast("string").alias("item"), F.lit("Nothing to object to.").alias("message")))
    return _or_pass(issues.select("_ord", "check", "column", "severity", "item", "message"), none).orderBy("_ord", "item").drop("_ord")


def _or_pass(issues: DataFrame, none: Column) -> DataFrame:
    """``issues``, or the one row of ``none`` when there is no issue; known issues are written once, not made twice."""
    rows = stored(issues, "issues")
    return rows if rows.head(1) else issues.sparkSession.range(1).select(F.explode(none).alias("x")).select("x.*")
