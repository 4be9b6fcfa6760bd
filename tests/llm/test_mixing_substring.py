"""Mixing to target weights, substring removal."""

import hashlib
from collections import Counter, defaultdict

import pytest
from llm_fixtures import SF01, empty, odd  # noqa: F401
from pyspark.sql import functions as F

from setsift.llm import mixing
from setsift.operators import running
from setsift.llm.substring import substring_dedup


def _fill(sizes, most=3):
    """Targets by plain re-sharing: whoever is above its cap is fixed there, the others share anew."""
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 5, "c": 70}, {"a": 0, "b": 3}, {"z": 7}, {f"s{i}": (i * 37) % 101 for i in range(30)}])
def test_targets_are_those_of_resharing(spark, sizes):
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = _fill(sizes)
    assert {r["source"]: round(r["target"], 6) for r in rows} == {k: round(v, 6) for k, v in want.items()}


def test_targets_of_many_sources_by_ranges(spark, monkeypatch):
    """Sources numbered and summed in ranges of a few; ties of the ratio and a null source among them."""
    monkeypatch.setattr(running, "ROWS", 40)
    sizes = {f"host {i:04}": (i * i * 37) % 401 * (1000 if i % 50 == 0 else 1) for i in range(500)} | {None: 12, "": 90}
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = _fill(sizes)
    assert len(rows) == len(sizes) and all(abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) for r in rows)
    assert abs(sum(r["target"] for r in rows) - sum(sizes.values())) < 1e-3


def test_taken_words_come_near_the_targets(spark):
    rows = mixing.mix_table(spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text", "source", "lang")).collect()
    taken, goal, most = Counter(), {}, Counter()
    for r in rows:
        s = r["source_size"], r["target"]
        taken[s] += r["taken"]
        goal[s] = r["target"]
        most[s] = max(most[s], r["size"])
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - goal[s]) <= most[s] / 2 + 1 for s in goal)
    assert len(rows) == 1000


@pytest.mark.parametrize("weight", [0.1, 0.14, 0.3, 0.7, 1.0])
def test_ranges_take_even_shares_of_keys_of_any_weight(spark, weight):
    n = 20 * mixing.RANGES
    key = -F.log((F.col("id") + 0.5) / n) / weight
    places = [r[0] for r in spark.range(n).orderBy(key).select(mixing.place_of(key)).collect()]
    assert places == sorted(places) and 0 <= places[0] and places[-1] < mixing.RANGES**2
    coarse = Counter(p // mixing.RANGES for p in places)
    assert max(coarse.values()) <= 6 * n / mixing.RANGES


def test_mix_of_odd_rows(odd, empty):
    rows = mixing.mix_table(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix_table(odd).collect()), key=repr)
    assert mixing.mix_table(empty).count() == 0


def test_mixed_repeats_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_table(docs).collect() if r["size"]}
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    assert Counter(r["doc_id"] for r in got.select("doc_id").collect()) == {k: v for k, v in want.items() if v}


def _brute(rows, n):
    first = defaultdict(lambda: float("inf"))
    key = lambda i: float("inf") if i is None else i
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - n + 1):
            first[tuple(w[k : k + n])] = min(first[tuple(w[k : k + n])], key(i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < key(i):
                gone.update(range(k, k + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_substring_against_brute_force(spark, n):
    import random

    rng = random.Random(n)
    rows = [(rng.choice([None, *range(40)]), " ".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) or None) for _ in range(60)]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), n).collect()
    assert sorted(map(tuple, got), key=repr) == _brute(rows, n)


def test_substring_of_odd_rows(odd, empty):
    got = substring_dedup(odd).collect()
    assert sorted(map(tuple, got), key=repr) == _brute([(r[0], r[1]) for r in odd.select("doc_id", "text").collect()], 50)
    assert substring_dedup(empty).count() == 0


def test_windows_of_regular_words_are_told_apart(spark):
    """Words and windows that a polynomial modulo a power of two takes for one another."""
    tm = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = ("".join("ab"[x ^ flip] for x in tm) for flip in (0, 1))
    rest = " ".join(f"w{i}" for i in range(49))
    words = [" ".join(("left", "right")[x ^ flip] for x in tm[:1024]) for flip in (0, 1)]
    docs = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} {rest}"), (4, words[0]), (5, words[1])], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup(docs).collect() if r.doc_id < 4} == {1: 0, 2: 0, 3: 50}
    assert {r.n_removed for r in substring_dedup(docs.filter("doc_id > 3"), window=1024).collect()} == {0}


def test_rolling_hashes_are_the_polynomials():
    import numpy as np

    from setsift.llm._common import PRIME, ROLLING_BASE, rolling_hashes

    v = np.random.default_rng(1).integers(0, 2**63, 300).astype(np.uint64) * np.uint64(2)
    for w in (1, 2, 3, 50, 64, 300, 301):
        want = [sum(int(x) % PRIME * pow(ROLLING_BASE, w - 1 - j, PRIME) for j, x in enumerate(v[i : i + w])) % PRIME for i in range(len(v) - w + 1)]
        assert rolling_hashes(v, w).tolist() == want
