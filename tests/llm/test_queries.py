"""The registered document queries against their SQL, and the pipeline against plain versions of its stages."""

import re
from collections import Counter

import duckdb
import pytest
from llm_fixtures import SF01, empty, odd  # noqa: F401

import corpus_pipeline
from setsift.llm import queries

SF001 = "/root/testdata/sf0.001"


def _key(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF01)
    res = con.execute(queries.ORACLE[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in res.fetchall()), key=_key)
    assert sorted(map(tuple, df.collect()), key=_key) == want and len(want)


def test_queries_without_sql_are_those_tested_by_brute_force():
    assert set(queries.QUERIES) - set(queries.ORACLE) == {"op2_token_files", "op3_quality", "op7_suffix_dedup", "op9_sharding", "op10_fingerprints", "op13_language_id"}
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 14))


def _shingles(text, n, word):
    w = re.findall(word, (text or "").encode().lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    columns, seen = docs.columns, {}
    path = corpus_pipeline.written
    for name, stage in corpus_pipeline.STAGES:
        out = path(stage(spark, docs, SF01), f"test-{name}")
        assert out.columns == columns + ["shard"] * (name == "sharding")
        seen[name] = (docs.collect(), out.collect())
        docs = out
    before, after = seen["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    right = [(r.doc_id in kept) == (labels[r.doc_id] == 1) for r in before if r.doc_id in labels]
    assert sum(right) / len(right) > 0.9
    before, after = seen["near_duplicates"]
    assert len({r.doc_id for r in after}) == len(after) < len(before)
    texts = {r.doc_id: _shingles(r.text, 2, rb"[^\x20\x09-\x0D]+") for r in before}
    kept = {r.doc_id for r in after}
    for r in before:  # whoever went has a partner, and no two that stay are near
        near = [d for d, s in texts.items() if d != r.doc_id and s and 100 * len(s & texts[r.doc_id]) >= 80 * len(s | texts[r.doc_id])]
        assert near if r.doc_id not in kept else not kept.intersection(near)
    before, after = seen["decontamination"]
    items = [_shingles(r.text, 5, rb"[0-9a-z\x80-\xff]+") for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in after}
    for r in before:
        own = _shingles(r.text, 5, rb"[0-9a-z\x80-\xff]+")
        assert (r.doc_id in kept) != any(100 * len(i & own) >= 80 * len(i) for i in items)
    before, after = seen["mixing"]
    assert set(Counter(r.doc_id for r in after).values()) <= {1, 2, 3} and {r.doc_id for r in after} <= {r.doc_id for r in before}
    before, after = seen["sharding"]
    assert Counter(r[:-1] for r in after) == Counter(tuple(r) for r in before) and {r.shard for r in after} == set(range(16))
    shards = {}
    for r in after:
        assert shards.setdefault(r.text, r.shard) == r.shard


def test_pipeline_run_is_its_stages(spark):
    assert corpus_pipeline.run(spark, SF001).count() > 50


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, odd, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, odd, SF001)
    assert got.columns[: len(odd.columns)] == odd.columns and got.count() >= 1
    assert stage(spark, empty, SF001).count() == 0
