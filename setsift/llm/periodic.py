"""Maximal periodic runs of words, by branching tandem repeats on an enhanced suffix array.

A task takes its documents a megabyte at a time and builds one enhanced suffix array over their words (prefix doubling;
suffixes of different documents never share anything). Every LCP interval of depth d is a set of suffixes that agree in
exactly d words or more. Suffix i of a child other than the largest is tested against places i + d and i - d: if the
inverse suffix array puts the partner into the same interval and the next words differ, a square of period d ends there
and cannot be moved on. Rotating that square to the left as far as the words agree gives the maximal run; intervals are
pairs of bounds in the array, no tree is built. Each level of the prefix doubling keeps the class of every string of 2**k
words, so common prefixes and rotations are found by halving steps and are exact: no hash takes part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from setsift.llm._common import slim, utf8

#: Bytes of text in one suffix array; a longer text has one of its own.
SLICE = 1 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def classes(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """levels[k][i]: class of the 2**k words from place i, cut off at the document's end. Classes are numbered by the
    first place that their suffixes take in the suffix array; those of the last level are that array's inverse."""
    n = len(words)
    key = begin * (int(words.max()) + 1) + words if n else words
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int32)
    new = np.r_[True, np.diff(key[order]) != 0]
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, width = [rank], 1
    shared = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(shared):
        after = shared + width
        follow = np.where(after < end[shared], rank[np.minimum(after, n - 1)], -1).astype(np.int64)
        key = rank[shared].astype(np.int64) * (n + 1) + follow + 1
        order = np.argsort(key, kind="stable")
        s, key, old = shared[order], key[order], rank[shared[order]]
        at = np.arange(len(s))
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
        part = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], at, 0))
        rank = rank.copy()
        rank[s] = old + (part - group)
        levels.append(rank)
        alone = np.r_[key[1:] != key[:-1], True] & (part == at)
        shared, width = np.sort(s[~alone]), 2 * width
    return levels


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words that the suffixes a and b share, pair by pair."""
    out = np.zeros(len(a), np.int64)
    some = np.flatnonzero(levels[0][a] == levels[0][b])
    x, y = a[some], b[some]
    stop_x, stop_y = end[x], end[y]
    for k in range(len(levels) - 1, -1, -1):
        inside = (x < stop_x) & (y < stop_y)
        level = levels[k]
        step = (inside & (level[np.minimum(x, len(end) - 1)] == level[np.minimum(y, len(end) - 1)])).astype(np.int64) << k
        x, y = x + step, y + step
    out[some] = x - a[some]
    return out


def smaller_before(lcp: np.ndarray) -> np.ndarray:
    """For each place with a value above 0 the nearest one before it with a smaller value, by pointer jumping; place 0
    holds the least value."""
    to = np.maximum(np.arange(len(lcp)) - 1, 0)
    todo = np.flatnonzero((lcp > 0) & (lcp[to] >= lcp))
    while len(todo):
        to[todo] = to[to[todo]]
        todo = todo[lcp[to[todo]] >= lcp[todo]]
    return to


def squares(levels: list[np.ndarray], begin: np.ndarray, end: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all squares that cannot be moved to the right, of periods that fit ``power`` times into their
    document; each once."""
    n, isa = len(begin), levels[-1]
    sa = np.empty(n, np.int64)
    sa[isa] = np.arange(n)
    lcp = np.full(n + 1, -1, np.int64)
    lcp[1:n] = common_prefix(levels, sa[:-1], sa[1:], end)
    left = smaller_before(lcp)
    right = n - smaller_before(lcp[::-1])[::-1]
    split = np.flatnonzero(lcp[:n] > 0)
    split = split[lcp[split] * power <= (end - begin)[sa[split]]]
    if not len(split):
        return split, split
    # children of an interval: from its left bound to its first split, between its splits, from the last to its right bound
    split = split[np.lexsort((split, right[split], left[split]))]
    first = np.r_[True, (np.diff(left[split]) != 0) | (np.diff(right[split]) != 0)]
    last = np.r_[first[1:], True]
    number = np.cumsum(first) - 1
    lo, hi, depth = left[split[first]], right[split[first]], lcp[split[first]]
    a = np.r_[np.where(first, left[split], np.r_[0, split[:-1]]), split[last]]
    b = np.r_[split, hi]
    owner = np.r_[number, np.arange(len(lo))]
    order = np.lexsort((a - b, owner))  # the largest child of each interval first
    a, b, owner = a[order], b[order], owner[order]
    small = np.r_[False, owner[1:] == owner[:-1]]
    a, b, owner = a[small], b[small], owner[small]
    size = b - a
    place = np.arange(size.sum()) + np.repeat(a - np.r_[0, np.cumsum(size)[:-1]], size)
    owner = np.repeat(owner, size)
    i, d = sa[place], depth[owner]
    found = []
    for x in (i, i - d):  # square of the suffix with the one d later; of the one d before with it
        y = x + d
        ok = (x >= begin[i]) & (y < end[i])
        x, y, own = x[ok], y[ok], owner[ok]
        other = isa[np.where(y == i[ok], x, y)]
        ok = (other >= lo[own]) & (other < hi[own])
        x, y, own = x[ok], y[ok], own[ok]
        z = y + depth[own]
        differ = (z >= end[x]) | (levels[0][np.minimum(z, n - 1)] != levels[0][y])
        found.append((x[differ], depth[own][differ]))
    start, period = (np.concatenate(x) for x in zip(*found, strict=True))
    _, once = np.unique(start * (n + 1) + period, return_index=True)
    return start[once], period[once]


def runs_of(words: np.ndarray, off: np.ndarray, min_length: int, power: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of the documents words[off[k]:off[k + 1]], by start, then period."""
    size = np.diff(off)
    if not len(words):
        return (np.zeros(0, np.int64),) * 3
    begin, end = np.repeat(off[:-1], size), np.repeat(off[1:], size)
    levels = classes(words, begin, end)
    at, period = squares(levels, begin, end, power)
    stop, start = at + 2 * period, at.copy()
    for k in range(len(levels) - 1, -1, -1):  # rotate to the left
        to = start - (1 << k)
        ok = to >= begin[at]
        to = np.maximum(to, 0)
        start = np.where(ok & (levels[k][to] == levels[k][to + period]), to, start)
    keep = stop - start >= np.maximum(min_length, power * period)
    start, stop, period = start[keep], stop[keep], period[keep]
    order = np.lexsort((period, stop, start))  # the same stretch with a multiple of its period is no other run
    start, stop, period = start[order], stop[order], period[order]
    least = np.r_[True, (np.diff(start) != 0) | (np.diff(stop) != 0)][: len(start)]
    start, stop, period = start[least], stop[least], period[least]
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


def _scan(batches: Iterator[pa.RecordBatch], min_length: int, power: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = utf8(b.column(1))
        at = 0
        while at < len(off) - 1:
            to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE, "right")) - 1)
            raw = data[off[at] : off[to]].tobytes()
            cut = off[at : to + 1] - off[at]
            lists = [raw[cut[k] : cut[k + 1]].split() for k in range(to - at)]
            number: dict[bytes, int] = {}
            words = np.array([number.setdefault(w, len(number)) for w in chain.from_iterable(lists)], np.int64)
            doc = np.cumsum([0, *map(len, lists)])
            start, stop, period = runs_of(words, doc, min_length, power)
            drop = np.zeros(len(words) + 1, np.int32)
            np.add.at(drop, start + period, 1)
            np.add.at(drop, stop, -1)
            keep = np.cumsum(drop[:-1]) == 0
            bounds = np.searchsorted(start, doc)
            kept = [b" ".join(w if x == y else compress(w, keep[doc[k] : doc[k + 1]])) for k, (w, x, y) in enumerate(zip(lists, bounds, bounds[1:], strict=False))] if texts else [None] * len(lists)
            inside = start - doc[np.searchsorted(doc, start, "right") - 1]
            runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in (inside, stop - start, period)], fields=list(RUN)))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), pa.array(np.diff(doc)), runs, pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])
            at = to


def periodic_runs(docs: DataFrame, min_length: int = 6, power: int = 4, texts: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A run is a maximal stretch whose words ``period`` apart are equal, period
    being its smallest one, of at least ``min_length`` words and ``power`` periods (2 or more). ``collapsed`` is the text,
    words joined by one blank, without those that any run holds after its first period (null unless ``texts``). Null and
    empty texts have no words, no runs and an empty collapsed text; repeated rows and null ids are rows like others; other
    columns are ignored. No shuffle: a task holds one slice of SLICE bytes, or one longer text with 4 bytes a word for each
    doubling of its longest repeated stretch.
    """
    if power < 2:
        raise ValueError("a run holds its period at least twice")
    rows = slim(docs, id_col, text_col)
    return rows.mapInArrow(lambda batches: _scan(batches, min_length, power, texts), SCHEMA)
