"""The registered queries of the document operators, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setsift.llm._common import table
from setsift.llm.decontam import contained_items
from setsift.llm.fingerprints import fingerprint_table
from setsift.llm.language import languages
from setsift.llm.licenses import license_scan
from setsift.llm.manifest import folded, manifest, proof_digest
from setsift.llm.mixing import MARKS, mix_table
from setsift.llm.near_dedup import near_duplicates
from setsift.llm.periodic import periodic_runs
from setsift.llm.quality import quality_table
from setsift.llm.sharding import shard_table
from setsift.llm.substring import substring_dedup
from setsift.llm.suffix_dedup import repeated_strings_removed
from setsift.llm.token_files import token_table

#: Tokenizer file, by its public name, and the id that ends a document.
TOKENIZER, END_ID = "byte_bpe_50k.json", 2


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_table(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_table(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), texts=False).drop("kept")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2).drop("doc_key")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings_removed(table(spark, sf_dir, "documents"), texts=False).drop("kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("doc_key")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_table(table(spark, sf_dir, "documents"))


def with_periods(docs: DataFrame) -> DataFrame:
    """``documents`` for op 11: where crc32(doc_id) is divisible by ten, the words from a place on repeat the first p of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    own = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"))
    own = own.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    own = own.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    edited = F.expr("concat(slice(words, 1, int(a)), slice(flatten(array_repeat(slice(words, int(a) + 1, int(p)), int(ceil((n - a) / p)))), 1, int(n - a)))")
    return own.select("doc_id", F.when(F.col("n") > 0, F.array_join(edited, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    # unequal ratios of whole numbers below 2**26 are unequal doubles
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"] / r["period"]).alias("e"), r["start"], r["period"], r["length"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    out = found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return out


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], found={"text": cut})
    rows = rows.withColumn("folded_root", folded(F.col("found"), F.col("steps")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_token_files,
        op3_quality,
        op4_mixing,
        op5_substring_dedup,
        op6_near_duplicates,
        op7_suffix_dedup,
        op8_decontamination,
        op9_sharding,
        op10_fingerprints,
        op11_periodic_runs,
        op12_merkle_manifest,
        op13_language_id,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Templates as patterns over the words, one blank before and after each word.
_PATTERNS = {
    "mit-notice": r" released under the mit license ",
    "apache-2.0-notice": r" licensed under the apache license version 2 0 ",
    "gpl-3.0-notice": r" licensed under the gnu general public license version 3 ",
    "cc-by-4.0-notice": r" licensed under (a )?cc by 4 0 ",
    "cc-by-nc-4.0-notice": r" licensed under (a )?cc by nc 4 0 ",
    "copyright-notice": r" copyright (c )?([^ ]+ ){1,8}?all rights reserved ",
}

_OP1 = (
    rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS words FROM documents),
p AS (
  SELECT *, ' ' || array_to_string(words, ' ') || ' ' AS line,
    list_filter(range(len(words)), lambda i: words[i+1] = 'cc' AND words[i+2] = 'by') AS cc,
    list_filter(range(len(words)), lambda i: words[i+1] = 'general' AND words[i+2] = 'public' AND words[i+3] = 'license') AS gpl,
    list_filter(range(len(words)), lambda i: words[i+1] = 'all' AND words[i+2] = 'rights' AND words[i+3] = 'reserved') AS res
  FROM w),
q AS (
  SELECT doc_id, len(words) AS n_words, list_concat(list_concat(cc, gpl), res) AS places,
    list_filter([CASE WHEN len(cc) > 0 THEN 'cc-by' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(res) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL) AS base,
    list_filter(["""
    + ", ".join(f"CASE WHEN regexp_matches(line, '{p}') THEN '{k}' END" for k, p in _PATTERNS.items())
    + """], lambda x: x IS NOT NULL) AS own,
    """
    + " + ".join(f"len(regexp_extract_all(line, '{p}'))" for p in _PATTERNS.values())
    + """ AS n_matches
  FROM p)
SELECT doc_id, n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
    array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_concat(base, own)), ',') AS labels,
    CASE WHEN len(own) > 0 THEN 1.0::DOUBLE ELSE 1 - power(0.5::DOUBLE, len(base)) END AS score, CAST(n_matches AS BIGINT) AS n_matches
FROM q
"""
)

_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

_MARKS = MARKS.replace("'", "''")

_OP4 = f"""
WITH thin AS (
  SELECT doc_id, source, {_SIZE} AS size,
    -ln((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
      / (0.1::DOUBLE + 0.9::DOUBLE * CASE WHEN length(coalesce(text, '')) = 0 THEN 1 ELSE length(translate(text, '{_MARKS}', ''))::DOUBLE / length(text) END) AS key
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM thin GROUP BY source),
ranked AS (SELECT *, 3 * source_size AS cap, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sizes),
levels AS (
  SELECT *, cap::DOUBLE / weight AS ratio, row_number() OVER o AS rank,
    CAST((sum(source_size) OVER ()) - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / CAST(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM ranked WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
stop AS (SELECT min(rank) AS r, arg_min(level, rank) AS l FROM levels WHERE level <= ratio),
goal AS (
  SELECT source, source_size, CASE WHEN rank < r THEN cap::DOUBLE ELSE least(cap::DOUBLE, l * weight) END AS target FROM levels, stop),
ep AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS epochs FROM goal),
run AS (
  SELECT t.doc_id, t.size, e.source_size, e.target, e.epochs,
    sum(t.size) OVER (PARTITION BY t.source ORDER BY t.key, t.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM thin t JOIN ep e ON t.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN upto - size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken, epochs
FROM run
"""

_OP5 = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
wins AS (SELECT r, doc_id, i, md5(array_to_string(words[i:i+49], ' ')) AS h FROM w, unnest(range(1, len(words) - 48)) AS t(i)),
least_ AS (SELECT h, min(doc_id) AS m FROM wins GROUP BY h),
gone AS (SELECT r, i FROM wins JOIN least_ USING (h) WHERE m < doc_id),
pos AS (SELECT r, i, words[i] AS word FROM w, unnest(range(1, len(words) + 1)) AS t(i)),
cover AS (
  SELECT p.r, p.i, p.word, max(CASE WHEN g.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS out_
  FROM pos p LEFT JOIN gone g ON p.r = g.r AND p.i = g.i),
agg AS (SELECT r, CAST(sum(out_) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE out_ = 0), '') AS kept FROM cover GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN agg USING (r)
"""

_OP6 = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sh AS (
  SELECT DISTINCT r, doc_id, s FROM (
    SELECT r, doc_id, words[i] || ' ' || words[i+1] AS s FROM w, unnest(range(1, len(words))) AS t(i)
    UNION ALL SELECT r, doc_id, words[1] FROM w WHERE len(words) = 1)),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r),
links AS (SELECT x, y FROM pairs JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT r AS x, r AS y FROM w UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least_ AS (SELECT x, min(doc_id) AS component_id FROM reach JOIN w ON w.r = reach.y GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM w JOIN least_ ON x = w.r LEFT JOIN n ON n.r = w.r
"""

_WORDS = f"regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

_OP8 = f"""
WITH d AS (SELECT DISTINCT doc_id, text, {_WORDS} AS words FROM documents),
b AS (SELECT DISTINCT item_id, text, {_WORDS} AS words, least(5, len({_WORDS})) AS k FROM benchmark),
items AS (SELECT DISTINCT item_id, k, array_to_string(words[i:i+k-1], ' ') AS s FROM b, unnest(range(1, len(words) - k + 2)) AS t(i) WHERE k > 0),
sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id),
held AS (SELECT DISTINCT doc_id, l.k AS k, array_to_string(words[i:i+l.k-1], ' ') AS s FROM d, (SELECT DISTINCT k FROM b WHERE k > 0) l, unnest(range(1, len(words) - l.k + 2)) AS t(i)),
shared AS (SELECT doc_id, item_id, count(*) AS c FROM held JOIN items USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS n_shingles, c AS n_shared, c / n::DOUBLE AS containment FROM shared JOIN sizes USING (item_id) WHERE 100 * c >= 80 * n
"""

#: Unsigned crc32 of the decimal doc_id, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)), 4294967295::BIGINT)"""

# A run of period q and 4 * q words or more holds two consecutive multiples of q whose words recur q later: these choose the
# (document, period) pairs that are looked at word by word.
_OP11 = rf"""
WITH w0 AS (SELECT row_number() OVER () AS r, doc_id, {_CRC} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w1 AS (SELECT *, len(ws) AS n, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM w0),
w2 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM w1),
pos AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY word) AS code FROM (SELECT r, i, ws[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM w2, unnest(range(n)) AS t(i))),
marks AS (
  SELECT k.r, k.q, x.code, lead(x.code) OVER o AS one, lead(x.code, 2) OVER o AS two
  FROM (SELECT r, q, unnest(range(0, n, q)) AS j FROM (SELECT r, n, unnest(range(1, n // 4 + 1)) AS q FROM w2)) k JOIN pos x ON x.r = k.r AND x.i = k.j
  WINDOW o AS (PARTITION BY k.r, k.q ORDER BY k.j)),
pairs AS (SELECT DISTINCT r, q FROM marks WHERE code = one AND one = two),
eq AS (SELECT k.r, k.q, x.i, x.i - row_number() OVER (PARTITION BY k.r, k.q ORDER BY x.i) AS island FROM pairs k JOIN pos x ON x.r = k.r JOIN pos y ON y.r = k.r AND y.i = x.i + k.q AND y.code = x.code),
stretches AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM eq GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT r, s, l, min(q) AS q FROM stretches GROUP BY r, s, l),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY l::DOUBLE / q DESC, s, q) = 1),
said AS (SELECT r, count(*) AS n, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS line FROM pos WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.r = pos.r AND pos.i >= runs.s + runs.q AND pos.i < runs.s + runs.l) GROUP BY r)
SELECT doc_id, coalesce(said.n, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(line, '')) AS collapsed_sha256
FROM w0 LEFT JOIN said USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""


def _climb(levels: int, prefix: str, start: str, nodes: str) -> str:
    """CTEs for the levels of a Merkle tree of threes: nodes (g, p, h) of each level, and for each climber (id, g, p, proof,
    cur) what it has met so far. ``start`` and ``nodes`` are the climbers and the nodes of the lowest level."""
    parts = [f"{prefix}t0 AS MATERIALIZED ({nodes})", f"{prefix}c0 AS MATERIALIZED ({start})"]
    for k in range(levels):
        t, c = f"{prefix}t{k}", f"{prefix}c{k}"
        parts.append(f"{prefix}s{k} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {t})")
        parts.append(f"{prefix}t{k + 1} AS MATERIALIZED (SELECT g, p // 3 AS p, CASE WHEN max(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h FROM {prefix}s{k} GROUP BY g, p // 3)")
        parts.append(
            f"""{prefix}c{k + 1} AS MATERIALIZED (
  SELECT c.id, c.g, c.p // 3 AS p, any_value(proof) || coalesce(string_agg(s.h, '' ORDER BY s.p) FILTER (WHERE s.p <> c.p), '') AS proof,
    CASE WHEN max(s.n) = 1 THEN any_value(cur) ELSE sha256(string_agg(CASE WHEN s.p = c.p THEN cur ELSE s.h END, '' ORDER BY s.p)) END AS cur
  FROM {c} c JOIN {prefix}s{k} s ON s.g IS NOT DISTINCT FROM c.g AND s.p // 3 = c.p // 3 GROUP BY c.id, c.g, c.p)"""
        )
    return ",\n".join(parts)


_H = lambda *fields: "sha256(" + " || ".join(f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || {x} END" for x in fields) + ")"

_OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS id, *, CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut FROM documents),
l AS MATERIALIZED (SELECT id, doc_id, source AS g, {_H("doc_id", "source", "lang", "n_chars", "text")} AS h, {_H("doc_id", "source", "lang", "n_chars", "cut")} AS found FROM d),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h, id) - 1 AS p FROM l),
{_climb(14, "a", "SELECT id, g, p, '' AS proof, found AS cur FROM r", "SELECT g, p, h FROM r")},
o AS MATERIALIZED (SELECT g AS own, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS p FROM at14),
{_climb(12, "b", "SELECT id, 0 AS g, o.p, proof, cur FROM ac14 c JOIN o ON o.own IS NOT DISTINCT FROM c.g", "SELECT 0 AS g, p, h FROM o")}
SELECT r.doc_id, r.h AS leaf, o.h AS subroot, bt12.h AS root, sha256(c.proof) AS proof_sha256, c.cur AS folded_root, c.cur = bt12.h AS verified
FROM r JOIN o ON o.own IS NOT DISTINCT FROM r.g JOIN bc12 c ON c.id = r.id CROSS JOIN bt12
"""

ORACLE: dict[str, str] = {"op6_near_duplicates": _OP6, "op8_decontamination": _OP8, "op11_periodic_runs": _OP11, "op12_merkle_manifest": _OP12, "op1_license_scan": _OP1, "op4_mixing": _OP4, "op5_substring_dedup": _OP5}
