"""Ops 11 to 13: periodic runs, Merkle manifest, language identification."""

import hashlib
import random
from collections import Counter, defaultdict
from math import log2
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import SF01, empty, odd  # noqa: F401
from pyspark.sql import functions as F

from setsift.llm import language, queries
from setsift.llm.language import FOLD, UNIT, Model, Settings, Tree, grown, languages
from setsift.llm.manifest import folded, manifest, proof_digest, ranked
from setsift.llm.periodic import periodic_runs, runs_of


def plain_runs(w, least, power):
    """{(start, end): smallest period} by comparing the words at every distance."""
    out = {}
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, power * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return out


@pytest.mark.parametrize("least,power", [(6, 4), (2, 2), (1, 3)])
def test_runs_equal_brute_force(least, power):
    rng = random.Random(least)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(0, 4)):
            n, k = rng.randint(0, 60), rng.randint(1, 4)
            d = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 3))
                d = [d[a + (i - a) % p] if i >= a else x for i, x in enumerate(d)]
            docs.append(d)
        off = np.cumsum([0, *map(len, docs)])
        got = list(zip(*(x.tolist() for x in runs_of(np.array(sum(docs, []), np.int64), off, least, power)), strict=True))
        want = [(s + int(o), e + int(o), q) for d, o in zip(docs, off, strict=False) for (s, e), q in plain_runs(d, least, power).items()]
        assert got == sorted(want, key=lambda x: (x[0], x[2]))


def test_runs_of_thue_morse_words():
    """Words whose power-of-two polynomial hashes collide are told apart: an overlap-free sequence has no run."""
    w = [bin(i).count("1") % 2 for i in range(4096)]
    assert [len(x) for x in runs_of(np.array(w, np.int64), np.array([0, 4096]), 3, 3)] == [0, 0, 0]


def test_runs_of_odd_and_empty_tables(spark, odd, empty):
    got = periodic_runs(odd)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    rows = got.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert all(not r.n_words and not r.runs and r.collapsed == "" for k in (2, 3, 4) for r in by[k])
    assert [tuple(x) for x in by[9][0].runs] == [(0, 30_000, 1)] and by[9][0].collapsed == "word"
    assert by[10][0].collapsed == "word end" and by[10][0].n_words == 30_001
    assert [tuple(x) for x in by[7][0].runs] == [(0, 180, 6)] and by[7][0].collapsed == "the same text without an id"
    assert periodic_runs(empty).collect() == []
    with pytest.raises(ValueError):
        periodic_runs(empty, power=1)


def test_very_long_text_is_one_text(spark):
    unit = " ".join(f"w{i}" for i in range(5_000))
    text = "start " + " ".join([unit] * 30) + " end"
    (r,) = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(x) for x in r.runs] == [(1, 150_000, 5_000)] and r.collapsed == f"start {unit} end"


def test_periods_are_put_in_as_told(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i % 40))) for i in range(300)], "doc_id long, text string")
    for r in queries.with_periods(docs).collect():
        h = crc32(str(r.doc_id).encode())
        w = [f"w{k}" for k in range(r.doc_id % 40)]
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
        assert r.text.split() == w


H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain_tree(nodes, fan=3):
    """(root, for each node the (left, right) siblings of every level) of a list of digests."""
    steps = [[] for _ in nodes]
    own = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + fan, len(nodes))) for i in range(0, len(nodes), fan)]
        for run in runs:
            for k in run:
                for leaf in own[k]:
                    steps[leaf].append(("".join(nodes[j] for j in run if j < k), "".join(nodes[j] for j in run if j > k)))
        nodes, own = [H("".join(nodes[k] for k in run)) for run in runs], [sum((own[k] for k in run), []) for run in runs]
    return nodes[0], steps


def plain_manifest(rows, fields):
    """Counter of (doc_id, leaf, subroot, root, steps)."""
    groups = defaultdict(list)
    for r in rows:
        leaf = H("".join("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in fields))
        groups[r["source"]].append((r["doc_id"], leaf))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = plain_tree([h for _, h in groups[s]])
    root, up = plain_tree([trees[s][0] for s in names])
    return Counter((i, h, trees[s][0], root, tuple(a + b)) for s, b in zip(names, up, strict=True) for (i, h), a in zip(groups[s], trees[s][1], strict=True))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@pytest.mark.parametrize("digits", [1, 2, 6])
def test_manifest_equals_a_plain_tree(spark, digits):
    """Group sizes around the borders of runs and blocks, a hot group, null and empty group names, null ids."""
    sizes = {None: 5, "": 1, "a": 3, "b": 4, "ä": 9, "Z": 10, "hot": 130, "z": 28}
    rows = [(None if k % 7 == 6 else k, f"t{k}\n{s}" if k % 5 else None, "en" if k % 3 else None, s, k) for s, n in sizes.items() for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = manifest(docs, FIELDS, digits=digits)
    want = plain_manifest([r.asDict() for r in docs.collect()], FIELDS)
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple(map(tuple, r.steps))) for r in got.collect()) == want


def test_manifest_of_odd_and_empty_tables(spark, odd, empty):
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple(map(tuple, r.steps))) for r in manifest(odd, FIELDS).collect()) == plain_manifest([r.asDict() for r in odd.collect()], FIELDS)
    assert manifest(empty, FIELDS).collect() == []


def test_proofs_show_what_was_changed(spark):
    docs = spark.createDataFrame([(k, f"text {k}", "s" + str(k % 3)) for k in range(100)], "doc_id long, text string, source string")
    got = manifest(docs, ["doc_id", "text"], found={"text": F.when(F.col("doc_id") == 7, F.lit("changed")).otherwise(F.col("text"))})
    rows = got.select("doc_id", "root", folded(F.col("found"), F.col("steps")).alias("now"), proof_digest(F.col("steps")).alias("p"), "steps").collect()
    assert [r.doc_id for r in rows if r.now != r.root] == [7]
    assert all(r.p == H("".join(s.l + s.r for s in r.steps)) for r in rows)


def test_ranks_do_not_need_a_group_in_one_task(spark, monkeypatch):
    monkeypatch.setattr("setsift.llm.manifest.ROWS", 50)
    rows = spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.lit("b")).alias("grp"), (F.col("id") * 7919 % 1009).alias("v"))
    got = ranked(rows, "grp", ["v"]).collect()
    for g in ("hot", "b"):
        own = sorted((r for r in got if r.grp == g), key=lambda r: r.v)
        assert [r["rank"] for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}


def fold(text):
    x = [int(FOLD[c]) for c in text.encode()]
    return [32] * 4 + [c for k, c in enumerate(x) if c != 32 or (k and x[k - 1] != 32)] + [32]


def plain_bits(train, text):
    """PPM with escape method C and exclusion, byte by byte."""
    seen = [defaultdict(Counter) for _ in range(5)]
    for t in train:
        x = fold(t)
        for i in range(4, len(x)):
            for k in range(5):
                seen[k][tuple(x[i - k : i])][x[i]] += 1
    x, total = fold(text), 0
    for i in range(4, len(x)):
        out, bits = set(), 0.0
        for k in range(4, -1, -1):
            here = {s: n for s, n in seen[k][tuple(x[i - k : i])].items() if s not in out}
            if not here:
                continue
            n, d = sum(here.values()), len(here)
            if x[i] in here:
                bits -= log2(here[x[i]] / (n + d))
                break
            bits -= log2(d / (n + d))
            out |= set(here)
        else:
            bits += log2(256 - len(out))
        total += round(bits * UNIT)
    return total


def test_code_lengths_equal_plain_ppm():
    rng = random.Random(5)
    for _ in range(30):
        train = ["".join(rng.choice("abAé .1") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 5))]
        texts = ["".join(rng.choice("abcAé .1z") for _ in range(rng.randint(0, 40))) for _ in range(4)]
        got = Model(["x"], [Tree(*grown(iter(train)))]).lengths(pa.array(texts, pa.string()))[:, 0]
        for g, t in zip(got, texts, strict=True):
            assert abs(int(g) - plain_bits(train, t)) <= len(t) + 2  # each byte's length is rounded


def test_a_tree_is_a_probability():
    tree = Tree(*grown(iter(["abracadabra", "banana band"])))
    context = np.int64(int.from_bytes(b"aban", "big"))
    assert abs(np.exp2(-tree.bits((context << 8) | np.arange(256)) / UNIT).sum() - 1) < 1e-3


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op13_language_id"](spark, SF01).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang").collect()}
    assert got.keys() == truth.keys() and all(r.held_out == (crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 for k, r in got.items())
    held = [k for k, r in got.items() if r.held_out]
    assert len(held) > 200 and sum(got[k].lang_pred == truth[k] for k in held) / len(held) > 0.97


def test_predictions_do_not_use_the_columns(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    held = language.held_out()
    other = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert sorted(map(tuple, languages(docs).collect())) == sorted(map(tuple, languages(other).collect()))


def test_languages_of_odd_and_empty_tables(spark, odd, empty):
    rows = languages(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 4)} == {"und"} and {r.lang_pred for r in rows if r.doc_id in (5, 7, 9)} == {"en"}
    digits = spark.createDataFrame([(1, "12 34 ²", "en"), (2, "a", None), (3, "b", "en"), (5, "c c c", "de")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in languages(digits).collect()}[1] == "und"
    assert languages(empty).collect() == []
    assert {r.lang_pred for r in languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_sample_bounds(spark):
    docs = spark.createDataFrame([(k, "x" * 10, "en" if k % 2 else "de") for k in range(200)], "doc_id long, text string, lang string")
    rows = language.training_rows(docs, Settings(max_rows=30, max_bytes=10_000), "doc_id", "text", "lang").collect()
    assert Counter(r.lang for r in rows) == {"en": 30, "de": 30}
    rows = language.training_rows(docs, Settings(max_rows=30, max_bytes=95), "doc_id", "text", "lang").collect()
    assert Counter(r.lang for r in rows) == {"en": 10, "de": 10}
    assert len(language.training_rows(docs, Settings(max_rows=3, max_langs=1), "doc_id", "text", "lang").collect()) == 3
