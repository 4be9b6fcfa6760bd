"""End-to-end runs: prototype mode, supervised mode, and stage-wise runs from files.

A run returns a mapping of lazy DataFrames keyed by result-table name; tables whose
construction needs a job (quantiles, some checks) are only built when asked for. The score table
feeds every later table, so it is materialised once with a reliable checkpoint (in
``spark.checkpoint.dir``), which also cuts its lineage: a lost executor recomputes
from the checkpoint, not from the raw texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import asdict, dataclass, field
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.names import col
from ..operators import chart_data as G
from ..operators import checks as C
from ..operators import explain as X
from ..operators import thresholds as TH
from ..operators.calibrate import calibrate, qca_ready
from ..operators.classify import fit_classifiers
from ..operators.columns import condition_name, parse_threshold_grid, score_columns
from ..operators.score import prototype_cosine, prototype_names, select_prototypes
from ..operators.tfidf import tfidf_prototype_scores
from ..operators.truth_table import conditions_of, configuration_members, solutions, truth_table
from ..session import cut_lineage, stored
from ..sources import io


class LazyTables(Mapping):
    """Result tables by name, each built on first access.

    Building some tables runs jobs (quantile selection, checks); a caller asking for
    one table does not pay for the others.
    """

    def __init__(self) -> None:
        self._make: dict[str, Callable[[], DataFrame]] = {}
        self._built: dict[str, DataFrame] = {}

    def add(self, name: str, make: Callable[[], DataFrame]) -> None:
        self._make[name] = make

    def put(self, name: str, df: DataFrame) -> None:
        self._make[name] = lambda: df

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._make[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._make)

    def __len__(self) -> int:
        return len(self._make)


@dataclass
class RunSettings:
    scoring_method: str = "Prototype similarity"
    calibration_method: str = "crisp"
    crisp_threshold: float = K.DEFAULT_CRISP_THRESHOLD
    full_out: float = K.DEFAULT_FULL_OUT
    crossover: float = K.DEFAULT_CROSSOVER
    full_in: float = K.DEFAULT_FULL_IN
    consistency_cutoff: float = K.DEFAULT_CONSISTENCY_CUTOFF
    min_cases: int = K.DEFAULT_MIN_CASES
    run_threshold_sensitivity: bool = True
    threshold_grid_text: str = ", ".join(str(t) for t in K.DEFAULT_THRESHOLD_GRID)
    extra: dict = field(default_factory=dict)


def _downstream(out: LazyTables, scores: DataFrame, full: DataFrame, s: RunSettings, case_id: str, outcome: str, text: str) -> LazyTables:
    conditions = [condition_name(c) for c in score_columns(scores)]
    protected = (case_id, text, outcome)
    fuzzy = calibrate(scores, "fuzzy", s.full_out, s.crossover, s.full_in, protected=protected)
    crisp = calibrate(scores, "crisp", threshold=s.crisp_threshold, protected=protected)
    # the truth table is built from crisp membership whichever calibration is shown
    ready = qca_ready(crisp, conditions, outcome=outcome, case_id=case_id)
    tt = truth_table(ready, conditions, outcome=outcome, case_id=case_id,
                     consistency_cutoff=s.consistency_cutoff, min_cases=s.min_cases)
    out.put("score_table", scores)
    out.add("top_condition_explanation", lambda: X.top_two(full, case_id=case_id, text=text, outcome=outcome))
    quantiles = cache(lambda: TH.score_quantiles(scores))  # one selection for three tables
    out.add("threshold_suggestions", lambda: TH.suggest_thresholds(scores, found=quantiles()))
    out.add("score_distribution_summary", lambda: TH.score_summary(scores, found=quantiles()))
    out.add("score_box", lambda: G.score_box(scores, quantiles()))
    out.put("calibrated_membership_table_fuzzy", fuzzy)
    out.put("calibrated_membership_table_crisp", crisp)
    out.put("qca_ready_dataset", ready)
    out.put("truth_table", tt)
    out.add("solution_configurations", lambda: solutions(tt, s.consistency_cutoff, s.min_cases, conditions=conditions))
    out.add("configuration_members", lambda: configuration_members(ready, conditions, case_id, outcome, tt))
    out.add("membership_matrix_fuzzy", lambda: G.membership_matrix(fuzzy, conditions, case_id))
    out.add("membership_matrix_crisp", lambda: G.membership_matrix(crisp, conditions, case_id))
    out.add("score_long", lambda: G.score_long(scores, (case_id, outcome)))
    out.add("membership_bins_fuzzy", lambda: G.membership_bins(fuzzy, conditions))
    out.add("membership_bins_crisp", lambda: G.membership_bins(crisp, conditions))
    out.add("coverage_points", lambda: G.coverage_points(tt))
    if s.run_threshold_sensitivity:
        grid = parse_threshold_grid(s.threshold_grid_text)
        sens = cache(lambda: TH.threshold_sensitivity(scores, grid, outcome, s.consistency_cutoff, s.min_cases))
        out.add("threshold_sensitivity_summary", lambda: sens()["summary"])
        out.add("threshold_sensitivity_details", lambda: sens()["detail"])
        out.add("threshold_sensitivity_solutions", lambda: sens()["solutions"])
        out.add("configuration_stability_table", lambda: sens()["stability"])
    settings = {k: v for k, v in asdict(s).items() if k != "extra"} | s.extra
    out.add("analysis_settings", lambda: io.settings_table(scores.sparkSession, settings))
    return out


def run_prototype(
    texts: DataFrame,
    prototypes: DataFrame,
    settings: RunSettings | None = None,
    text: str = "text",
    case_id: str = "case_id",
    outcome: str = "outcome",
    vector_col: str | None = None,
    prototype_vector_col: str | None = None,
    checkpoint: bool = True,
    include_outcome_prototype: bool = False,
) -> LazyTables:
    """Prototype mode: cosine to prototype vectors when vector columns are given,
    otherwise lexical TF-IDF similarity of the texts to the prototype texts.

    The texts need an id and a text; without an outcome column every outcome is missing. The checkpoint holds ids,
    outcomes and scores; tables that show texts (the explanations) read them again. The prototypes are read once: what
    the run takes of them is written first, and checks, names and scores read that."""
    s = settings or RunSettings()
    used = [c for c in (*K.PROTOTYPE_COLUMNS, prototype_vector_col or vector_col) if c in prototypes.columns]
    # with their places, which order the scores: files need not come back in order
    prototypes = stored(prototypes.select(*[col(c) for c in dict.fromkeys(used)], F.monotonically_increasing_id().alias("_place")), "prototypes")
    report = C.prototype_issues(prototypes)
    C.raise_on_error(report, "prototype table")
    if outcome not in texts.columns:
        texts = texts.withColumn(outcome, F.lit(None).cast("int"))
    base = texts.select(*[col(c) for c in (case_id, text, outcome, *([vector_col] if vector_col else []))])
    chosen = select_prototypes(prototypes, include_outcome_prototype)
    if vector_col:
        full = prototype_cosine(base, prototypes, vector_col, prototype_vector_col or vector_col, include_outcome_prototype, "_place").drop(vector_col)
    else:
        full = tfidf_prototype_scores(base, chosen, prototype_names(prototypes, include_outcome_prototype, "_place"), text)
    scores = full.drop(text)
    if checkpoint:
        scores = cut_lineage(scores)
    out = LazyTables()
    out.put("prototype_quality", report)
    _downstream(out, scores, full, s, case_id, outcome, text)
    out.add("rich_text_prototype_explanations", lambda: X.rich_explanations(full, prototypes, text, case_id, outcome, include_outcome=include_outcome_prototype))
    return out


def run_supervised(
    labeled: DataFrame,
    texts: DataFrame,
    conditions: list[str] | None = None,
    settings: RunSettings | None = None,
    text: str = "text",
    case_id: str = "case_id",
    outcome: str = "outcome",
    checkpoint: bool = True,
) -> LazyTables:
    """Supervised mode: validate the labeled table, fit one classifier per condition,
    score the texts, then the same tables as prototype mode (without explanations).

    The labeled table is read once: text and labels are written, the counts of both reports are metrics of that write,
    and the fit reads what was written."""
    s = settings or RunSettings(scoring_method="Supervised classifier")
    if conditions is None:
        conditions = [c for c in labeled.columns if c not in (case_id, text, outcome, "label", "target_label")]
    if text not in labeled.columns or not conditions:
        C.raise_on_error(C.label_report(labeled, text, conditions), "labeled training data")
    used = dict.fromkeys(c for c in (text, *conditions) if c in labeled.columns)
    labeled, report_of, training_of = C.observe_labels(labeled.select(*map(col, used)), text, conditions)
    labeled = stored(labeled, "labeled")
    report = report_of()
    C.raise_on_error(report, "labeled training data")
    clf = fit_classifiers(labeled, conditions, text, validate=False)
    if outcome not in texts.columns:
        texts = texts.withColumn(outcome, F.lit(None).cast("int"))
    full = clf.predict_scores(texts.select(*[col(c) for c in (case_id, text, outcome)]))
    scores = full.drop(text)
    if checkpoint:
        scores = cut_lineage(scores)
    out = LazyTables()
    out.put("supervised_validation_report", report)
    out.add("supervised_training_report", training_of)
    return _downstream(out, scores, full, s, case_id, outcome, text)


# ---------------------------------------------------------------- stage-wise runs (files in, files out)
def score_stage(spark, texts_path: str, prototypes_path: str, out_path: str, fmt: str = "parquet", text: str = "text",
                case_id: str = "case_id", include_outcome_prototype: bool = False) -> str:
    texts = io.read_texts(spark, texts_path, fmt, text=text, case_id=case_id)
    protos = io.read_prototypes(spark, prototypes_path, "csv" if prototypes_path.endswith(".csv") else "parquet")
    names = prototype_names(protos, include_outcome_prototype)
    scores = tfidf_prototype_scores(texts, select_prototypes(protos, include_outcome_prototype), names, text)
    return io.write_table(scores, out_path, fmt)


def calibration_stage(spark, scores_path: str, out_dir: str, settings: RunSettings | None = None, fmt: str = "parquet",
                      text: str = "text", case_id: str = "case_id", outcome: str = "outcome") -> dict:
    s = settings or RunSettings()
    scores = io.read_scores(spark, scores_path, fmt)
    roles = (case_id, text, outcome)
    fuzzy = calibrate(scores, "fuzzy", s.full_out, s.crossover, s.full_in, protected=roles)
    crisp = calibrate(scores, "crisp", threshold=s.crisp_threshold, protected=roles)
    ready = qca_ready(crisp, outcome=outcome, case_id=case_id)
    ready, domain = C.observe_crisp(ready, [c for c in ready.columns if c != case_id])
    paths = io.write_bundle({"calibrated_membership_table_fuzzy": fuzzy, "calibrated_membership_table_crisp": crisp, "qca_ready_dataset": ready}, out_dir, fmt)
    return paths | io.write_bundle({"crisp_domain_report": domain()}, out_dir, fmt)  # counted while the dataset was written


def qca_stage(spark, ready_path: str, out_dir: str, settings: RunSettings | None = None, fmt: str = "parquet",
              case_id: str = "case_id", outcome: str = "outcome") -> dict:
    s = settings or RunSettings()
    ready = io.read_qca_ready(spark, ready_path, fmt, outcome)
    tt = truth_table(ready, outcome=outcome, case_id=case_id, consistency_cutoff=s.consistency_cutoff, min_cases=s.min_cases)
    tables = {"truth_table": tt, "solution_configurations": solutions(tt, s.consistency_cutoff, s.min_cases)}
    if case_id in ready.columns:
        tables["configuration_members"] = configuration_members(ready, conditions_of(tt), case_id, outcome, tt)
    return io.write_bundle(tables, out_dir, fmt)


def chart_stage(spark, scores_path: str, truth_table_path: str, out_dir: str, fmt: str = "parquet", case_id: str = "case_id",
                outcome: str = "outcome") -> dict:
    scores = io.read_scores(spark, scores_path, fmt)
    tt = io.read_table(spark, truth_table_path, fmt)
    return io.write_bundle({"score_long": G.score_long(scores, (case_id, outcome)), "score_box": G.score_box(scores),
                            "coverage_points": G.coverage_points(tt)}, out_dir, fmt)
