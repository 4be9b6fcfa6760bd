"""Plain SQL text for the DuckDB cross-check of every registered query.

These strings are the independent statement of what each query must return; they
are run by DuckDB over the same parquet tables (views named after the tables).
Nothing here is executed by Spark.
"""

from __future__ import annotations

from .relations import DL_PROTOTYPES, EM_CONDITIONS, EM_LABELS, LI_CONDITIONS

LI_SCORES_SQL = """
SELECT l_discount * 10 AS disc_score, l_tax * 10 AS tax_score, l_quantity / 50 AS qty_score,
       CAST(l_returnflag = 'R' AS INTEGER) AS outcome
FROM lineitem"""


def em_scores_sql() -> str:
    pv = ",\n       ".join(
        f"arg_min(embedding, vec_id) FILTER (WHERE label = {k}) AS {c}_vec" for c, k in zip(EM_CONDITIONS, EM_LABELS)
    )
    sc = ",\n       ".join(
        f"list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(p.{c}_vec AS DOUBLE[])) AS {c}_score"
        for c in EM_CONDITIONS
    )
    labels = ", ".join(str(k) for k in EM_LABELS)
    return f"""
SELECT e.vec_id AS case_id, CAST(e.label % 2 AS INTEGER) AS outcome,
       {sc}
FROM embeddings e,
     (SELECT {pv} FROM embeddings WHERE label IN ({labels})) p"""


def crisp_cols(conditions: list[str], threshold: float, src: str = "") -> str:
    return ", ".join(
        f"CASE WHEN {src}{c}_score IS NULL OR isnan({src}{c}_score) THEN NULL "
        f"ELSE CAST({src}{c}_score >= {threshold!r} AS INTEGER) END AS {c}"
        for c in conditions
    )


def fuzzy_expr(s: str, full_out: float, cross: float, full_in: float) -> str:
    return (
        f"CASE WHEN {s} IS NULL OR isnan({s}) THEN NULL WHEN {s} <= {full_out!r} THEN 0.0 "
        f"WHEN {s} >= {full_in!r} THEN 1.0 "
        f"WHEN {s} < {cross!r} THEN 0.5 * ({s} - {full_out!r}) / {cross - full_out!r} "
        f"ELSE 0.5 + 0.5 * ({s} - {cross!r}) / {full_in - cross!r} END"
    )


def label_sql(conditions: list[str], src: str = "") -> str:
    parts = ", ".join(f"CASE WHEN {src}{c} = 1 THEN '{c}' ELSE '~{c}' END" for c in conditions)
    return f"concat_ws(' * ', {parts})"


def status_sql(cons: str, n: str, cutoff: float, min_cases: int, lower: float = 0.4, upper: float = 0.6) -> str:
    return (
        f"CASE WHEN {cons} >= {cutoff!r} AND {n} >= {min_cases} THEN 'sufficient' "
        f"WHEN {cons} BETWEEN {lower!r} AND {upper!r} THEN 'contradictory' ELSE 'weak' END"
    )


def truth_table_sql(
    scores_sql: str,
    conditions: list[str],
    threshold: float,
    cutoff: float = 0.8,
    min_cases: int = 1,
) -> str:
    conds = ", ".join(conditions)
    return f"""
WITH s AS ({scores_sql}),
c AS (SELECT {crisp_cols(conditions, threshold)}, outcome FROM s),
g AS (SELECT {conds}, COUNT(*) AS n_cases,
             CAST(COALESCE(SUM(outcome), 0) AS BIGINT) AS outcome_positive_cases
      FROM c GROUP BY {conds}),
t AS (SELECT *, CAST(outcome_positive_cases AS DOUBLE) / n_cases AS cons,
             CAST(outcome_positive_cases AS DOUBLE) / NULLIF(SUM(outcome_positive_cases) OVER (), 0) AS cov
      FROM g)
SELECT {conds}, {label_sql(conditions)} AS configuration, n_cases, outcome_positive_cases,
       round_even(cons, 4) AS consistency, round_even(cov, 4) AS raw_coverage,
       {status_sql('cons', 'n_cases', cutoff, min_cases)} AS status
FROM t"""


def solutions_sql(tt_sql: str, conditions: list[str], cutoff: float, min_cases: int = 1) -> str:
    order = ", ".join(f"{c} ASC" for c in conditions)
    return f"""
WITH tt AS ({tt_sql})
SELECT CAST(row_number() OVER (ORDER BY status ASC, consistency DESC, n_cases DESC, {order}) AS INTEGER) AS solution_id,
       configuration, n_cases, outcome_positive_cases, consistency, raw_coverage,
       printf('When the configuration [%s] is present, the outcome occurs in %d out of %d observed case(s).',
              configuration, outcome_positive_cases, n_cases) AS interpretation
FROM tt
WHERE consistency >= {cutoff!r} AND n_cases >= {min_cases} AND status = 'sufficient'"""


LI = LI_CONDITIONS
EM = EM_CONDITIONS
DL_NAMES = [p[0] for p in DL_PROTOTYPES]


def sensitivity_detail_sql(scores_sql: str, conditions: list[str], grid: list[float], cutoff: float = 0.8,
                           min_cases: int = 1) -> str:
    conds = ", ".join(conditions)
    crisp = ", ".join(
        f"CASE WHEN {c}_score IS NULL OR isnan({c}_score) THEN NULL "
        f"ELSE CAST({c}_score >= threshold AS INTEGER) END AS {c}"
        for c in conditions
    )
    g = ", ".join(repr(float(t)) for t in grid)
    return f"""
WITH s AS ({scores_sql}),
c AS (SELECT threshold, {crisp}, outcome FROM s, (SELECT unnest([{g}]::DOUBLE[]) AS threshold) grid),
g AS (SELECT threshold, {conds}, COUNT(*) AS n_cases,
             CAST(COALESCE(SUM(outcome), 0) AS BIGINT) AS outcome_positive_cases
      FROM c GROUP BY threshold, {conds}),
t AS (SELECT *, CAST(outcome_positive_cases AS DOUBLE) / n_cases AS cons,
             CAST(outcome_positive_cases AS DOUBLE)
               / NULLIF(SUM(outcome_positive_cases) OVER (PARTITION BY threshold), 0) AS cov
      FROM g)
SELECT threshold, {conds}, {label_sql(conditions)} AS configuration, n_cases, outcome_positive_cases,
       round_even(cons, 4) AS consistency, round_even(cov, 4) AS raw_coverage,
       {status_sql('cons', 'n_cases', cutoff, min_cases)} AS status
FROM t"""


def mean4_sql(x: str) -> str:
    return f"round_even(SUM(CAST(round_even({x} * 10000.0, 0) AS BIGINT)) / COUNT({x}), 0) / 10000.0"


def sensitivity_summary_sql(detail_sql: str) -> str:
    return f"""
WITH d AS ({detail_sql})
SELECT threshold, CAST(COUNT(*) AS INTEGER) AS n_configurations,
       CAST(count_if(status = 'sufficient') AS INTEGER) AS n_sufficient,
       CAST(count_if(status = 'contradictory') AS INTEGER) AS n_contradictory,
       CAST(count_if(status = 'weak') AS INTEGER) AS n_weak,
       {mean4_sql('consistency')} AS mean_consistency, MAX(consistency) AS max_consistency,
       {mean4_sql('raw_coverage')} AS mean_raw_coverage, MAX(raw_coverage) AS max_raw_coverage,
       CAST(SUM(n_cases) AS BIGINT) AS total_cases_in_truth_table
FROM d GROUP BY threshold"""


def sensitivity_solutions_sql(detail_sql: str, conditions: list[str], cutoff: float, min_cases: int = 1) -> str:
    order = ", ".join(f"{c} ASC" for c in conditions)
    return f"""
WITH d AS ({detail_sql})
SELECT threshold,
       CAST(row_number() OVER (PARTITION BY threshold
            ORDER BY status ASC, consistency DESC, n_cases DESC, {order}) AS INTEGER) AS solution_id,
       configuration, n_cases, outcome_positive_cases, consistency, raw_coverage,
       printf('When the configuration [%s] is present, the outcome occurs in %d out of %d observed case(s).',
              configuration, outcome_positive_cases, n_cases) AS interpretation
FROM d
WHERE consistency >= {cutoff!r} AND n_cases >= {min_cases} AND status = 'sufficient'"""


def stability_sql(detail_sql: str) -> str:
    def lst(cond: str | None) -> str:
        f = f" FILTER (WHERE {cond})" if cond else ""
        return f"COALESCE(string_agg(CAST(threshold AS VARCHAR), ', ' ORDER BY threshold){f}, '')"

    def cnt(cond: str | None) -> str:
        f = f" FILTER (WHERE {cond})" if cond else ""
        return f"CAST(COUNT(DISTINCT threshold){f} AS INTEGER)"

    suf, con, weak = "status = 'sufficient'", "status = 'contradictory'", "status = 'weak'"
    return f"""
WITH d AS ({detail_sql})
SELECT configuration,
       {cnt(None)} AS n_thresholds_observed, {cnt(suf)} AS n_thresholds_sufficient,
       {cnt(con)} AS n_thresholds_contradictory, {cnt(weak)} AS n_thresholds_weak,
       {lst(None)} AS thresholds_observed, {lst(suf)} AS sufficient_thresholds,
       {lst(con)} AS contradictory_thresholds, {lst(weak)} AS weak_thresholds,
       {mean4_sql('consistency')} AS mean_consistency, {mean4_sql('raw_coverage')} AS mean_raw_coverage,
       {mean4_sql('n_cases')} AS mean_n_cases
FROM d GROUP BY configuration"""


def overlaps_sql(scores_sql: str, conditions: list[str], grid: list[float]) -> str:
    known = " AND ".join(f"{c} IS NOT NULL" for c in conditions)
    steps = " UNION ALL ".join(
        f"SELECT {j} AS j, CAST({t!r} AS DOUBLE) AS threshold, case_id, {label_sql(conditions)} AS configuration "
        f"FROM (SELECT case_id, {crisp_cols(conditions, t)} FROM s) WHERE {known}"
        for j, t in enumerate(grid)
    )
    return f"""
WITH s AS MATERIALIZED ({scores_sql}), m AS MATERIALIZED ({steps}),
n AS (SELECT j, configuration, count(*) AS n FROM m GROUP BY j, configuration)
SELECT a.threshold, a.configuration, b.threshold AS next_threshold, b.configuration AS next_configuration,
       any_value(x.n) AS n_cases, any_value(y.n) AS next_n_cases, count(*) AS n_both
FROM m a JOIN m b ON b.j = a.j + 1 AND b.case_id = a.case_id
JOIN n x ON x.j = a.j AND x.configuration = a.configuration JOIN n y ON y.j = b.j AND y.configuration = b.configuration
GROUP BY a.threshold, a.configuration, b.threshold, b.configuration"""


def pooled_sql(scores_sql: str, conditions: list[str]) -> str:
    cols = ", ".join(f"CAST({c}_score AS DOUBLE)" for c in conditions)
    return f"SELECT unnest([{cols}]) AS value FROM ({scores_sql})"


def quantile_rows_sql(scores_sql: str, conditions: list[str], rows: list[tuple], value_name: str,
                      label_name: str, extra: str | None = None) -> str:
    """rows: (label, prob[, text]) -> one SELECT per row over the pooled quantiles."""
    pooled = pooled_sql(scores_sql, conditions)
    parts = []
    for r in rows:
        label, p = r[0], r[1]
        if p == 0.0:
            q = "MIN(value)"
        elif p == 1.0:
            q = "MAX(value)"
        else:
            q = f"quantile_cont(value, {p!r})"
        ex = f", '{r[2]}' AS {extra}" if extra else ""
        parts.append(f"SELECT '{label}' AS {label_name}, round_even({q}, 4) AS {value_name}{ex} FROM p")
    return f"WITH p AS (SELECT value FROM ({pooled}) WHERE value IS NOT NULL AND NOT isnan(value))\n" + "\nUNION ALL ".join(parts)


# ---------------------------------------------------------------- text, TF-IDF, explanations
LABELED_SQL = """
SELECT d.doc_id AS case_id, d.text, CAST(l.quality AS INTEGER) AS outcome,
       CAST(l.quality AS INTEGER) AS quality, CAST(l.toxic AS INTEGER) AS toxic
FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""
DL_SQL = """
SELECT d.doc_id AS case_id, d.text, CAST(l.quality AS INTEGER) AS outcome
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm_text_sql(t: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({t}, '')), '\\s+', ' ', 'g'))"


def explanation_terms_sql(t: str) -> str:
    from ..constants import STOPWORDS

    stop = "[" + ", ".join(sql_str(w) for w in STOPWORDS) + "]"
    n = norm_text_sql(t)
    latin = f"regexp_extract_all(lower({n}), '[a-zA-Z][a-zA-Z_\\-]{{2,}}')"
    han = (
        f"flatten(list_transform(regexp_extract_all({n}, '[\\x{{4e00}}-\\x{{9fff}}]+'), "
        "lambda r: flatten([[substr(r, i, n) for i in range(1, length(r) - n + 2)] for n in [2, 3, 4]])))"
    )
    return f"list_filter(list_concat({latin}, {han}), lambda x: length(trim(x)) >= 2 AND NOT list_contains({stop}, x))"


def shared_terms_sql(a: str, b: str, limit: int = 12) -> str:
    inter = f"list_intersect(list_distinct({a}), list_distinct({b}))"
    return (
        f"list_transform(list_sort(list_transform({inter}, lambda x: {{'k': -length(x), 't': x}})), lambda s: s.t)[1:{limit}]"
    )


def grams_sql(src: str) -> str:
    """(id, term) character 1-2-grams of padded lower-cased words of (id, text) rows."""
    return f"""
  (WITH w AS (SELECT id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '\\s+')) AS w FROM {src}),
        p AS (SELECT id, ' ' || w || ' ' AS p FROM w WHERE w <> '')
   SELECT id, substr(p, i, 1) AS term FROM (SELECT id, p, unnest(range(1, length(p) + 1)) AS i FROM p)
   UNION ALL
   SELECT id, substr(p, i, 2) AS term FROM (SELECT id, p, unnest(range(1, length(p))) AS i FROM p))"""


def vocab_ctes(docs_sql: str, max_features: int | None = 5000, max_df: float = 0.95) -> str:
    """CTEs docs(id, text), dt(id, term, c), nd(n), vocab(term, tf, df, n); all terms without ``max_features``."""
    capped = f"WHERE df <= {max_df!r} * n AND df >= 1 ORDER BY tf DESC, term ASC LIMIT {max_features}" if max_features else ""
    return f"""docs AS ({docs_sql}),
dt AS (SELECT id, term, COUNT(*) AS c FROM {grams_sql('docs')} GROUP BY id, term),
nd AS (SELECT COUNT(*) AS n FROM docs),
st AS (SELECT term, SUM(c) AS tf, COUNT(*) AS df FROM dt GROUP BY term),
vocab AS (SELECT term, tf, df, n FROM st, nd {capped})"""


def tfidf_vectors_sql(docs_sql: str) -> str:
    """(id, term, weight): L2-normalised TF-IDF vectors over the capped vocabulary."""
    return f"""
WITH {vocab_ctes(docs_sql)},
idf AS (SELECT term, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM vocab),
dw AS (SELECT dt.id, dt.term, dt.c * idf.idf AS x FROM dt JOIN idf ON idf.term = dt.term),
dn AS (SELECT id, sqrt(SUM(x * x)) AS nrm FROM dw GROUP BY id)
SELECT dw.id, dw.term, dw.x / dn.nrm AS weight FROM dw JOIN dn ON dn.id = dw.id"""


def gradient_sql(labeled_sql: str, labels: list[str]) -> str:
    """(condition, term, gradient) of the class-weighted mean log loss at zero coefficients."""
    each = "\n  UNION ALL ".join(
        f"SELECT case_id AS id, '{c}' AS condition, CASE WHEN {c} = 1 THEN n / (2.0 * p) ELSE n / (2.0 * (n - p)) END AS w, {c} AS y "
        f"FROM l, (SELECT count(*)::DOUBLE AS n, sum({c})::DOUBLE AS p FROM l)"
        for c in labels
    )
    return f"""
WITH l AS ({labeled_sql}),
v AS ({tfidf_vectors_sql('SELECT case_id AS id, text FROM l')}),
r AS ({each}),
s AS (SELECT condition, sum(w) AS w, sum(w * (0.5 - y)) AS g FROM r GROUP BY condition)
SELECT r.condition, v.term, round_even(sum(r.w * (0.5 - r.y) * v.weight) / any_value(s.w), 9) AS gradient
FROM r JOIN v ON v.id = r.id JOIN s ON s.condition = r.condition GROUP BY r.condition, v.term
UNION ALL SELECT condition, NULL, round_even(g / w, 9) FROM s"""


def tfidf_scores_sql(texts_sql: str, prototypes: list[tuple], keep: str) -> str:
    """Wide cosine scores of TF-IDF vectors (document frequencies of the texts, all terms)."""
    vals = ", ".join(f"({sql_str(n)}, {sql_str(p)})" for n, p, _ in prototypes)
    piv = ", ".join(
        f"COALESCE(MAX(pair.s) FILTER (WHERE pair.cond = {sql_str(n)}), 0.0) AS {n}_score" for n, _, _ in prototypes
    )
    return f"""
WITH t AS ({texts_sql}),
{vocab_ctes('SELECT case_id AS id, text FROM t', None)},
idf AS (SELECT term, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM vocab),
dw AS (SELECT dt.id, dt.term, dt.c * idf.idf AS x FROM dt JOIN idf ON idf.term = dt.term),
dn AS (SELECT id, sqrt(SUM(x * x)) AS nrm FROM dw GROUP BY id),
pr AS (SELECT * FROM (VALUES {vals}) v(cond, text)),
pdt AS (SELECT id AS cond, term, COUNT(*) AS c FROM {grams_sql('(SELECT cond AS id, text FROM pr)')} GROUP BY id, term),
pw AS (SELECT pdt.cond, pdt.term, pdt.c * idf.idf AS x FROM pdt JOIN idf ON idf.term = pdt.term),
pn AS (SELECT cond, sqrt(SUM(x * x)) AS nrm FROM pw GROUP BY cond),
pair AS (SELECT dw.id, pw.cond, SUM((dw.x / dn.nrm) * (pw.x / pn.nrm)) AS s
         FROM dw JOIN dn ON dn.id = dw.id JOIN pw ON pw.term = dw.term JOIN pn ON pn.cond = pw.cond
         GROUP BY dw.id, pw.cond)
SELECT {keep}, {piv}
FROM t LEFT JOIN pair ON pair.id = t.case_id
GROUP BY {keep}"""


def top_two_ctes(scores_sql: str, conditions: list[str], keep: list[str]) -> str:
    """CTE tt2(keep..., t1, n1, t2, n2) with the best and second score per case."""
    k = ", ".join(keep)
    longs = "\n  UNION ALL ".join(
        f"SELECT {k}, {i} AS pos, '{c}' AS name, CASE WHEN isnan({c}_score) THEN NULL ELSE {c}_score END AS v FROM s"
        for i, c in enumerate(conditions)
    )
    return f"""s AS ({scores_sql}),
l AS ({longs}),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY v IS NULL, v DESC, pos) AS rn FROM l),
tt2 AS (SELECT {', '.join('a.' + x for x in keep)},
               CASE WHEN a.v IS NULL THEN NULL ELSE a.name END AS n1, a.v AS t1, b.name AS n2, b.v AS t2
        FROM r a LEFT JOIN r b ON b.case_id = a.case_id AND b.rn = 2 WHERE a.rn = 1)"""


def confidence_sql(t1: str, t2: str) -> str:
    gap = f"({t1} - {t2})"
    return (
        f"CASE WHEN {t1} IS NULL THEN 'unknown' "
        f"WHEN {t1} >= 0.5 AND ({gap} IS NULL OR {gap} >= 0.1) THEN 'high' "
        f"WHEN {t1} >= 0.35 AND ({gap} IS NULL OR {gap} >= 0.05) THEN 'medium' "
        f"WHEN {t1} >= 0.25 THEN 'low' ELSE 'very low' END"
    )
