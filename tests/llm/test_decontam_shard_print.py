"""Benchmark decontamination, sharding, fingerprints."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_fixtures import SF01, empty, odd  # noqa: F401
from pyspark.sql import functions as F

from setsift.llm import decontam, fingerprints, sharding

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _shingles(text, k):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def _contained(docs, items):
    out = set()
    for item, text in set(items):
        n = len(WORD.findall((text or "").encode().lower()))
        k = min(5, n)
        own = _shingles(text, k) if n else set()
        for doc, t in set(docs):
            common = len(own & _shingles(t, k)) if own else 0
            if own and 100 * common >= 80 * len(own):
                out.add((doc, item, len(own), common, hashlib.md5((t or "").encode()).hexdigest()))
    return len(out), sorted((x[:4] for x in out), key=repr)


def test_containment_against_brute_force(spark):
    items = spark.read.parquet(f"{SF01}/benchmark.parquet").collect()
    texts = [r["text"] for r in items]
    rows = [(k, f"Before all, {t.upper().replace(' ', ' - ')}; and after") for k, t in enumerate(texts[:10])]
    for k, t in enumerate(texts[:20]):  # some words lost: around the border of 80 %
        w = t.split()
        for cut in range(0, len(w), 3):
            rows.append((100 + k, " ".join(w[:cut] + ["other"] + w[cut + 1 :])))
            rows.append((200 + k, " ".join(w[cut // 2 : len(w) - cut // 4])))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(r["item_id"], r["text"]) for r in items], "item_id long, text string")
    got = decontam.contained_items(docs, bench).drop("doc_key", "containment").collect()
    n, want = _contained(rows, [(r["item_id"], r["text"]) for r in items])
    assert sorted(map(tuple, got), key=repr) == want and n > 100


def test_containment_of_odd_rows(spark, odd, empty):
    items = [(1, "ONE"), (1, "ONE"), (2, "same text without an id the same"), (3, None), (4, ""), (None, "cc by the gnu"), (5, "word word word word word word"), (6, "no such item anywhere"), (1, "end")]
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, hash int")
    got = decontam.contained_items(odd, bench).drop("doc_key", "containment").collect()
    assert sorted(map(tuple, got), key=repr) == _contained([(r[0], r[1]) for r in odd.select("doc_id", "text").collect()], items)[1]
    assert decontam.contained_items(empty, bench).count() == 0
    assert decontam.contained_items(odd, bench.limit(0)).count() == 0
    clean = decontam.clean_documents(odd, bench)
    assert clean.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in clean.select("doc_id").collect()) == [(False, 2), (False, 3), (False, 4), (False, 8), (False, 11), (True, 0)]


def test_decontamination_runs_no_python(spark):
    docs, bench = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "benchmark"))
    assert not re.search("Python|Arrow|Pandas", decontam.contained_items(docs, bench)._jdf.queryExecution().toString())


def _shard_laws(rows, docs, shards=16):
    """What must hold of the shard table."""
    slots, group = defaultdict(list), defaultdict(set)
    size = [0] * shards
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
        group[r["text_crc32"], r["size"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == want
    return size, group, {s: len(x) for s, x in slots.items()}


def test_shards_are_balanced(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = sharding.shard_table(docs).collect()
    size, group, count = _shard_laws(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert max(size) / min(size) < 1.02 and max(count.values()) / min(count.values()) < 1.1
    assert all(len(s) == 1 for s in group.values())


def test_a_hot_group_is_split(spark):
    rows = [(i, "hot text") for i in range(3000)] + [(i, f"text {i}") for i in range(3000, 6000)]
    got = sharding.shard_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size, group, _ = _shard_laws(got, rows)
    assert max(size) / min(size) < 1.1 and sum(len(s) > 1 for s in group.values()) == 1


def test_packing_is_the_plain_greedy():
    rng = np.random.default_rng(5)
    v = np.ceil(rng.pareto(1.2, (400, 3)) * 10)
    v[50:60] = v[50]  # ties
    total, lack, want = v.sum(0), [[1 / 7] * 3 for _ in range(7)], {}
    for k in sorted(range(len(v)), key=lambda k: (-max(v[k] / total), k)):
        fit = [sum(a * b for a, b in zip(left, v[k] / total, strict=True)) for left in lack]
        want[k] = max(range(7), key=lambda s: (fit[s], -s))
        lack[want[k]] = [a - b for a, b in zip(lack[want[k]], v[k] / total, strict=True)]
    got = sharding.pack(v, 7)
    assert [want[k] for k in range(len(v))] == list(got)
    load = np.array([(v[got == s] / total).sum(0) for s in range(7)])
    assert load.max() < 1 / 7 + (v / total).max()


def test_long_units_are_numbered_in_parts(spark, monkeypatch):
    """Bundles and pieces larger than PART_ROWS; half of the rows share the null id, a third one text."""
    monkeypatch.setattr(sharding, "UNITS", 64)
    monkeypatch.setattr(sharding, "PART_ROWS", 20)
    rows = [(i if i % 2 else None, "hot text" if i % 3 == 0 else f"text {i}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, bundle_parts, units = sharding._plan(spark, sharding._thin(docs, "doc_id", "text"), 16)
    assert bundle_parts == 5 and units.groupBy("u_unit").count().agg({"count": "max"}).first()[0] >= 5
    size, *_ = _shard_laws(sharding.shard_table(docs).collect(), rows)
    assert sum(size) == sum(len(t) + 1 for _, t in rows)


def test_shards_of_odd_rows(odd, empty):
    _shard_laws(sharding.shard_table(odd).collect(), [(r[0], r[1]) for r in odd.select("doc_id", "text").collect()])
    assert sharding.shard_table(empty).count() == 0
    both = sharding.sharded(odd)
    assert both.columns == [*odd.columns, "shard"] and both.count() == odd.count()
    assert sharding.sharded(both).columns == both.columns


def _next_rows(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return [(i, t or "", rows[(k + 1) % len(rows)][1] or "") for k, (i, t) in enumerate(rows)]


def _edited(t, u):
    q = len(t) // 4
    return t[: len(t) - q] + u[:q]


def _sets(t):
    b = t.encode()
    return {b[k : k + 8] for k in range(len(b) - 7)} or ({b} if b else set())


def test_fingerprints_against_exact_sets(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_table(docs).collect()}
    assert len(got) == len(rows)
    errors, prints = [], {}
    for i, t, u in _next_rows(rows):
        r, e = got[i], _edited(t, u)
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        a, b, c = _sets(t), _sets(e), _sets(u)
        errors += [r["near_edited"] - len(a & b) / len(a | b), r["near_next"] - len(a & c) / len(a | c)]
    # standard deviation of 256 bins of 4 bits: at most about 0.035, more for short texts, whose bins share values
    assert np.sqrt(np.mean(np.square(errors))) < 0.04 and abs(np.mean(errors)) < 0.01


@pytest.mark.parametrize("slice_bytes", [1 << 20, 50])
def test_fingerprints_of_odd_rows(spark, odd, empty, monkeypatch, slice_bytes):
    got = fingerprints.fingerprint_table(odd).collect()
    assert len(got) == odd.count()
    assert {r["n_chars"] for r in got if r["fingerprint"] == ""} == {0}
    assert len({r["fingerprint"] for r in got if r["n_chars"] == 3}) == 1
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[2]["near_next"] == 1.0 and by_id[1]["near_next"] == 0.0
    assert by_id[11]["edited_sha256"] != "" and fingerprints.fingerprint_table(empty).count() == 0
    one = fingerprints.fingerprint_table(odd.filter("doc_id = 1")).collect()[0]
    t = odd.filter("doc_id = 1").first()["text"]
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(_edited(t, t).encode()).hexdigest()


def test_fingerprints_of_one_id_on_half_of_the_rows(spark, monkeypatch):
    """Rows of one id, the null one too, meet in the order of a hash of their texts, and spread over ranges."""
    monkeypatch.setattr(fingerprints, "RANGE", 2000)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text of row {i} " * (1 + i % 4)) for i in range(900)] + [(7, "copy " * 9)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = docs.selectExpr("doc_id", "text", "xxhash64(text) h").collect()
    order = sorted(hashed, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    want = sorted((r[0] or -1, len(r[1]), hashlib.sha256(_edited(r[1], order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, r in enumerate(order))
    got = fingerprints.fingerprint_table(docs)
    assert sorted((r["doc_id"] or -1, r["n_chars"], r["edited_sha256"]) for r in got.collect()) == want
    sizes = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]  # a range is a task
    assert max(sizes) < 300 // 4 + 50


def test_order_of_pairs_as_bytes():
    edge = [-(2**63), -(2**63) + 1, -256, -1, 0, 1, 255, 256, 2**63 - 1]
    pairs = [(a, b) for a in edge for b in edge]
    got = fingerprints.order_bytes(*np.array(pairs, np.int64).T)
    assert pairs == sorted(pairs) and list(got) == sorted(got) and len(set(got)) == len(pairs)


def test_densification_keeps_small_sets_comparable():
    low = fingerprints.sketches([b"abcdefghijkl", b"abcdefghijkl", b"zyxwvutsrqpo", b"", b"ab"])
    has = np.array([True, True, True, False, True])
    assert (low[0] == low[1]).all() and (low[0] != low[2]).any() and not low[3].any()
    assert list(fingerprints.likeness(low[[0, 0, 3, 3]], low[[1, 3, 0, 3]], has[[0, 0, 3, 3]], has[[1, 3, 0, 3]])) == [1.0, 0.0, 0.0, 1.0]
