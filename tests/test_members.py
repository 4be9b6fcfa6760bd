"""Bitmaps of configuration members against plain sets."""

import random
from collections import defaultdict

import pytest

from setsift.operators import running as RUN
from setsift.operators.members import configuration_overlaps, configuration_sizes, member_bitmaps, numbered

GRID = [0.2, 0.5, 0.7]


def plain(rows):
    sets = defaultdict(set)
    for k, (_, a, b) in enumerate(rows):
        if a is not None and b is not None:
            for t in GRID:
                sets[t, f"{'' if a >= t else '~'}a * {'' if b >= t else '~'}b"].add(k)
    return sets


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(3)
    value = lambda: rng.choice([None, *[k / 10 for k in range(11)] * 3])
    # one configuration holds most cases
    return [(f"c{k:06}", *((0.9, 0.9) if k % 10 else (value(), value()))) for k in range(70_000)]


def test_sizes_and_overlaps_against_sets(spark, cases, monkeypatch):
    monkeypatch.setattr(RUN, "ROWS", 9000)
    df = spark.createDataFrame(cases, "case_id string, a_score double, b_score double").repartition(5)
    bitmaps = member_bitmaps(numbered(df), GRID)
    want = plain(cases)
    assert {(r.threshold, r.configuration): r.n_cases for r in configuration_sizes(bitmaps).collect()} == {k: len(v) for k, v in want.items()}
    assert bitmaps.agg({"bucket": "max"}).first()[0] == 3  # 70,000 numbers
    got = {(r.threshold, r.configuration, r.next_threshold, r.next_configuration): (r.n_cases, r.next_n_cases, r.n_both) for r in configuration_overlaps(bitmaps, GRID).collect()}
    pairs = [(x, y) for x in want for y in want if GRID.index(y[0]) == GRID.index(x[0]) + 1 and want[x] & want[y]]
    assert got == {(*x, *y): (len(want[x]), len(want[y]), len(want[x] & want[y])) for x, y in pairs}


def test_numbers_follow_the_order_of_ids(spark, cases):
    df = spark.createDataFrame(cases[:500], "case_id string, a_score double, b_score double").repartition(7)
    got = {r.case_id: r.number for r in numbered(df).collect()}
    assert got == {c[0]: k for k, c in enumerate(cases[:500])}


def test_no_cases_and_a_single_threshold(spark):
    df = spark.createDataFrame([], "case_id string, a_score double")
    bitmaps = member_bitmaps(numbered(df), GRID)
    assert bitmaps.count() == 0 and configuration_overlaps(bitmaps, GRID).count() == 0
    one = member_bitmaps(numbered(spark.createDataFrame([("x", 0.5)], "case_id string, a_score double")), [0.5])
    assert [tuple(r) for r in configuration_sizes(one).collect()] == [(0.5, "a", 1)] and configuration_overlaps(one, [0.5]).count() == 0
