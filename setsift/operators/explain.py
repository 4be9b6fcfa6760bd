"""Per-case explanations: strongest and second condition, confidence, shared terms.

The ranking is across the m score columns of one row, so it is a narrow projection
(``sort_array`` over an array of m structs); no window and no shuffle. The rich table
adds the top condition's prototype by a join with the table of m prototypes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import col
from .. import constants as K
from ..functions.calibration import clean_score
from ..functions.text import explanation_terms, shared_terms
from ..session import stored
from .columns import condition_name, score_columns
from .score import select_prototypes
from .tfidf import last_prototypes


def ranked_conditions(score_cols: list[str]) -> Column:
    """Array of (missing, -score, position, name, score) structs, best first.

    Missing scores sort last; equal scores keep column order.
    """
    items = []
    for pos, c in enumerate(score_cols):
        s = clean_score(c)
        items.append(
            F.struct(
                s.isNull().alias("missing"),
                (-s).alias("neg"),
                F.lit(pos).alias("pos"),
                F.lit(condition_name(c)).alias("name"),
                s.alias("score"),
            )
        )
    return F.sort_array(F.array(*items))


def confidence(top: Column, second: Column) -> Column:
    """high / medium / low / very low from the unrounded top score and gap; unknown if no top."""
    gap = top - second
    expr = F.when(top.isNull(), F.lit(K.CONFIDENCE_UNKNOWN))
    for label, min_top, min_gap in K.CONFIDENCE_BANDS:
        cond = top >= F.lit(min_top)
        if min_gap is not None:
            cond = cond & (gap.isNull() | (gap >= F.lit(min_gap)))
        expr = expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(K.CONFIDENCE_FLOOR))


def _with_top_two(scores: DataFrame) -> DataFrame:
    cols = score_columns(scores)
    r = ranked_conditions(cols)
    one = len(cols) == 1
    return scores.withColumn("_r", r).withColumns(
        {
            "_top": F.col("_r")[0]["score"],
            "_top_name": F.when(F.col("_r")[0]["missing"], F.lit(None).cast("string")).otherwise(F.col("_r")[0]["name"]),
            "_second": F.lit(None).cast("double") if one else F.col("_r")[1]["score"],
            "_second_name": F.lit(None).cast("string") if one else F.col("_r")[1]["name"],
        }
    )


def _top_columns() -> list[Column]:
    return [
        F.col("_top_name").alias("top_condition"),
        F.bround("_top", 4).alias("top_score"),
        F.col("_second_name").alias("second_condition"),
        F.bround("_second", 4).alias("second_score"),
        F.bround(F.col("_top") - F.col("_second"), 4).alias("score_gap"),
    ]


def top_two(
    scores: DataFrame, case_id: str = "case_id", text: str = "text", outcome: str = "outcome"
) -> DataFrame:
    """case id, text, top and second condition with scores (4 places) and their gap."""
    t = _with_top_two(scores)
    cols = [
        (col(case_id) if case_id in scores.columns else F.lit(None)).alias(case_id),
        (col(text) if text in scores.columns else F.lit(None).cast("string")).alias(text),
    ] + _top_columns()
    if outcome in scores.columns:
        cols.append(col(outcome))
    return t.select(*cols)


def top_two_long(rows: DataFrame, case_id: str = "case_id", condition: str = "condition", position: str = "position", score: str = "score") -> DataFrame:
    """The columns of :func:`top_two` and the confidence label from one row per (case, condition), however many conditions
    there are. Missing scores come last, equal ones by position, equal positions by name. Every task passes on at most two
    rows of a case (the bound on the row number is applied before the shuffle)."""
    s = clean_score(score)
    base = rows.select(col(case_id), col(condition).cast("string").alias("_name"), col(position).alias("_pos"), s.alias("_s"))
    order = Window.partitionBy(col(case_id)).orderBy(F.col("_s").desc_nulls_last(), "_pos", "_name")
    best = base.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= 2)
    at = lambda k, c: F.max(F.when(F.col("_rn") == k, F.col(c)))
    found = best.groupBy(col(case_id)).agg(
        at(1, "_s").alias("_top"), F.max(F.when((F.col("_rn") == 1) & F.col("_s").isNotNull(), F.col("_name"))).alias("_top_name"), at(2, "_s").alias("_second"), at(2, "_name").alias("_second_name")
    )
    return found.select(col(case_id), *_top_columns(), confidence(F.col("_top"), F.col("_second")).alias("confidence"))


def with_confidence(scores: DataFrame) -> DataFrame:
    """Top-two columns plus the confidence label (for counts and filters)."""
    t = _with_top_two(scores)
    keep = [c for c in scores.columns if not c.endswith("_score")]
    return t.select(*keep, *_top_columns(), confidence(F.col("_top"), F.col("_second")).alias("confidence"))


def interpretation_note(top_name: Column, top: Column, second_name: Column, second: Column,
                        conf: Column, matched: Column) -> Column:
    gap_text = F.when(second.isNull(), F.lit(K.NOTE_NO_SECOND)).otherwise(
        F.format_string(K.NOTE_GAP, second_name, top - second)
    )
    matched_text = F.when(F.size(matched) > 0, F.format_string(K.NOTE_MATCHED, F.array_join(matched, ", "))).otherwise(
        F.lit(K.NOTE_NO_MATCH)
    )
    return F.concat(F.format_string(K.NOTE_HEAD, top_name, top, conf), gap_text, F.lit(" "), matched_text)


def prototype_lookup(prototypes: DataFrame, order_col: str | None = None, include_outcome: bool = False) -> DataFrame:
    """condition_name -> prototype text and its terms; a repeated name keeps its last row."""
    p = last_prototypes(select_prototypes(prototypes, include_outcome), order_col)
    return p.select(F.col("_cond").alias("_pname"), "_ptext", explanation_terms(F.col("_ptext")).alias("_pterms"))


def rich_explanations(
    scores: DataFrame,
    prototypes: DataFrame,
    text: str = "text",
    case_id: str = "case_id",
    outcome: str = "outcome",
    max_terms: int = K.MAX_MATCHED_TERMS,
    include_outcome: bool = False,
) -> DataFrame:
    """Top-two, confidence, shared lexical cues with the top prototype, and a note."""
    t = _with_top_two(scores)
    # written first: the planner knows its size and broadcasts it below its own threshold
    lookup = stored(prototype_lookup(prototypes, include_outcome=include_outcome), "prototype-terms")
    j = t.join(lookup, t["_top_name"] == lookup["_pname"], "left")
    txt = col(text) if text in scores.columns else F.lit("")
    matched = shared_terms(explanation_terms(txt), F.coalesce(F.col("_pterms"), F.array().cast("array<string>")), max_terms)
    conf = confidence(F.col("_top"), F.col("_second"))
    j = j.withColumns({"_matched": matched, "_conf": conf})
    cols = [
        (col(case_id) if case_id in scores.columns else F.lit(None)).alias(case_id),
        txt.alias(text),
        *_top_columns(),
        F.col("_conf").alias("confidence"),
        F.array_join("_matched", ", ").alias("matched_terms"),
        F.coalesce(F.col("_ptext"), F.lit("")).alias("top_prototype"),
        interpretation_note(
            F.col("_top_name"), F.col("_top"), F.col("_second_name"), F.col("_second"), F.col("_conf"), F.col("_matched")
        ).alias("interpretation_note"),
    ]
    if outcome in scores.columns:
        cols.append(col(outcome))
    return j.select(*cols)
