"""Near-duplicates, repeated byte strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import empty, odd  # noqa: F401

from setsift.llm import near_dedup, suffix_dedup


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {(a, b) for a, b in zip(words, words[1:], strict=False)} if len(words) != 1 else {(words[0],)}


def _components(rows):
    sets = [_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and 100 * common >= 80 * (len(a) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return sorted(((i, len(sets[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows)), key=repr)


def _copies(rng, n):
    """Texts with chains of small edits, copies and unrelated ones."""
    words = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.6:
            text = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randint(0, 6)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(words)
        else:
            text = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 30, 60, 120]))]
        rows.append((k * 7 % n, " ".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    rows = _copies(random.Random(seed), 150)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).drop("doc_key").collect()
    assert sorted(map(tuple, got), key=repr) == _components(rows)


def test_chains_beside_a_large_component(spark, monkeypatch):
    """Copies that are linked with other copies only, and blocks smaller than the group."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    base = [rng.choice(words) for _ in range(60)]
    rows = []
    for k in range(150):
        text = (base if rng.random() < 0.6 or not rows else rng.choice(rows)[1].split())[:]
        for _ in range(rng.randint(1, 5)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((k, " ".join(text)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).drop("doc_key").collect()
    want = _components(rows)
    assert 3 < len({c for _, _, c, _ in want}) < 100
    assert sorted(map(tuple, got), key=repr) == want


def test_a_pair_is_compared_at_one_key_only(monkeypatch):
    """Sets near the bound share many keys: blocks of all keys compare each once and still join what is linked."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 120)
    sets = []
    for _ in range(40):
        own = base.copy()
        own[rng.choice(120, rng.integers(6, 20), replace=False)] = rng.integers(0, 2**63, 1)
        sets.append(np.unique(own))
    n = len(sets)
    cut = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    sketches = [r.tobytes() for r in near_dedup.registers(near_dedup.minima(np.concatenate(sets).astype(np.uint64), cut))]
    (keys,) = near_dedup._bands([pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(sketches, pa.binary())], names=["cls", "sketch"])])
    by_key = {}
    for band, cls in zip(*(c.to_pylist() for c in keys.columns), strict=True):
        by_key.setdefault(band, []).append(cls)
    compared, estimate = Counter(), near_dedup.estimate

    def counted(a, b, na, nb):
        compared.update(zip((x.tobytes() for x in a), (x.tobytes() for x in b), strict=True))
        return estimate(a, b, na, nb)

    monkeypatch.setattr(near_dedup, "estimate", counted)
    found = []
    for band, members in by_key.items():
        rows = [{"band": band, "left": left, "cls": c, "root": c, "sketch": sketches[c], "elements": sets[c].tolist()} for left in (True, False) for c in members]
        found += zip(*(c.to_pylist() for c in near_dedup._block_links(pa.Table.from_pylist(rows)).columns), strict=True)
    assert len(compared) > n and max(compared.values()) == 1
    linked = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    whole = [set(x.tolist()) for x in sets]
    assert all(linked(whole[a], whole[b]) for a, b in found)

    def joined(links):
        root = list(range(n))
        for a, b in links:
            root = [root[a] if r == root[b] else r for r in root]
        return {frozenset(k for k in range(n) if root[k] == r) for r in root}

    pairs = {(a, b) for members in by_key.values() for a in members for b in members if a < b}
    want = joined([(a, b) for a, b in pairs if linked(whole[a], whole[b])])
    assert joined(found) == want and 1 < len(want) < n


def test_near_duplicates_of_odd_rows(odd, empty):
    got = near_dedup.near_duplicates(odd, words=2).drop("doc_key").collect()
    assert sorted(map(tuple, got), key=repr) == _components([(r[0], r[1]) for r in odd.select("doc_id", "text").collect()])
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.deduplicated(empty).count() == 0


def test_one_document_of_each_group_stays(odd):
    got = near_dedup.deduplicated(odd, words=2)
    assert got.columns == odd.columns
    rows = got.select("doc_id", "text").collect()
    # words without a link: 1, 8; empty texts: 2, 3, 4 and the one without an id; groups: 5 5 6, 7 and its copy
    assert Counter(r["doc_id"] for r in rows) == Counter([1, 2, 3, 4, None, 5, 7, 8, 9, 10, 11])


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (5, 5)]
    got = dict(map(tuple, near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {k: v for k, v in got.items() if k < 100} == {i: 0 for i in range(61) if i in got}
    assert got[101] == got[102] == 100


def test_registers_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.sort(x[:2000]), np.sort(x[500:2500])
    regs = near_dedup.registers(near_dedup.minima(np.concatenate([a, b]), np.array([0, 2000, 4000])))
    assert abs((regs[0] == regs[1]).mean() - 0.6) < 0.12
    assert abs(near_dedup.estimate(regs[:1], regs[1:], np.array([2000.0]), np.array([2000.0]))[0] - 0.6) < 0.12
    both = near_dedup.registers(near_dedup.minima(np.unique(x[:2500]), np.array([0, 2500])))
    assert (np.maximum(regs[0], regs[1]) == both[0]).all()  # sketches merge


def _repeats(rows, n=400):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[k : k + n] for _, t in texts for k in range(len(t) - n + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - n + 1):
            if count[t[k : k + n]] > 1:
                gone[k] += 1
                gone[k + n if k + n < len(t) else len(t)] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_repeated_strings_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 8)))
    pool = ["".join(word() for _ in range(200)) for _ in range(4)]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) - 1)
            cut = p[a : a + rng.choice([100, 300, 380, 399, 400, 401, 450, 900])]
            if rng.random() < 0.3:
                at = rng.randrange(len(cut) or 1)
                cut = cut[:at] + "#" + cut[at + 1 :]
            parts += [cut, word()]
        rows.append((k % 50, "".join(parts) or None))
    rows += [(90, "ab" * 700), (91, "x" * 399), (92, "x" * 399), (93, "y" * 400), (94, "z" * 401)]
    got = suffix_dedup.repeated_strings_removed(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == _repeats(rows)


def test_repeated_strings_of_odd_rows(odd, empty):
    small = odd.filter("doc_id is null or doc_id not in (9, 10)")
    got = suffix_dedup.repeated_strings_removed(small).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == _repeats([(r[0], r[1]) for r in small.select("doc_id", "text").collect()])
    long = {r["doc_id"]: r for r in suffix_dedup.repeated_strings_removed(odd).collect()}
    assert long[9]["n_removed"] == 150_000 and bytes(long[10]["kept"]) == b"end"
    assert suffix_dedup.repeated_strings_removed(empty).count() == 0


def test_loser_tree_merges_with_known_prefixes():
    rng = random.Random(3)
    runs = []
    for _ in range(5):
        own = sorted({bytes(rng.choice(b"ab") for _ in range(6)) + b"q" * (suffix_dedup.CORE - 6) for _ in range(rng.randint(0, 30))})
        shared = bytes(0 if not k else next(i for i in range(suffix_dedup.CORE) if own[k][i] != own[k - 1][i]) for k in range(len(own)))
        tails = b"".join(x[s:] for x, s in zip(own, shared, strict=True))
        assert suffix_dedup.decoded(shared, tails) == own
        runs.append((own, shared))
    out = [(runs[r][0][k], known) for r, k, known in suffix_dedup.merged(runs)]
    assert [x for x, _ in out] == sorted(x for own, _ in runs for x in own)
    for (x, _), (y, known) in zip(out, out[1:], strict=False):
        assert known == next((i for i in range(len(x)) if x[i] != y[i]), len(x))


def test_regular_words_are_told_apart(spark):
    """Two words that a polynomial modulo a power of two takes for one another share no shingle."""
    tm = [bin(i).count("1") % 2 for i in range(2048)]
    rows = [(k, "".join("ab"[x ^ k] for x in tm)) for k in (0, 1)]
    assert [r.kept for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()] == [True, True]


@pytest.mark.parametrize("words", [1, 3, 5])
def test_shingles_of_any_number_of_words(spark, words):
    """Links by shingles of so many words against plain sets; fewer words are one shingle."""
    rng = random.Random(words)
    base = [[rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 4, 5, 30, 60]))] for _ in range(12)]
    texts = [" ".join(b) for b in base] + [" ".join(b[:-1] + ["x"]) for b in base] + [" ".join(b) for b in base[:4]]
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w)} if len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)})
    root = list(range(len(texts)))
    for _ in texts:
        for i in root:
            for j in range(len(texts)):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    for _ in texts:
        root = [root[r] for r in root]
        for i in range(len(texts)):
            for j in range(len(texts)):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {k: (len(sets[k]), root[k]) for k in range(len(texts))}


def test_columns_of_any_name_stay_as_they_are(spark):
    from setsift.llm.mixing import mixed

    names = ["quota_source", "quota_copy", "quota_key", "own_source", "own_key", "own_id", "row", "times", "near_row_key", "kept_key", "kept_id", "cls", "source.x"]
    rows = [(k, f"text number {k} " + "with more words " * (k % 3), "s" + str(k % 2), *(f"{n}{k}" for n in names)) for k in range(20)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    for out in (mixed(docs), near_dedup.deduplicated(docs)):
        assert out.columns == docs.columns and out.count() > 1
        assert set(map(tuple, out.collect())) <= set(map(tuple, rows))
