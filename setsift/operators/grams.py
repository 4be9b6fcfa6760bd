"""Character n-grams of a known vocabulary, counted in Arrow batches.

Exploding every n-gram of every text costs a row and a hash lookup for each character. Where the vocabulary is known, a
task instead walks all places of its texts at once through the tree of the vocabulary's terms, a step for each
character of the longest term, and counts what it meets per text. Each text is taken alone and whole, so nothing is
shuffled; long texts are walked in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Counters (texts x terms) and code points that a task holds at once; tables of the tree up to this size are dense.
CELLS, PIECE, DENSE = 1 << 20, 1 << 20, 1 << 24
#: The white space that separates words: that of the pattern ``functions.text.WS``.
BLANKS = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def lowered(text: Column) -> Column:
    """What :class:`Terms` takes: missing text is empty."""
    return F.lower(F.coalesce(text.cast("string"), F.lit("")))


class Terms:
    """The vocabulary as a tree: node 0 is none, node 1 the root; ``number`` is a node's term, -1 without one."""

    def __init__(self, terms: list[str]) -> None:
        self.size, self.depth = len(terms), max(map(len, terms), default=0)
        chars = sorted({c for t in terms for c in t} | {" "})
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.code[BLANKS] = self.code[32]
        self.width = len(chars) + 1
        node = {"": 1}
        for p in sorted({t[:k] for t in terms for k in range(1, len(t) + 1)}, key=lambda p: (len(p), p)):
            node[p] = len(node) + 1
        self.number = np.full(len(node) + 1, -1, np.int64)
        self.number[[node[t] for t in terms]] = np.arange(len(terms))
        edges = sorted((node[p[:-1]] * self.width + int(self.code[ord(p[-1])]), n) for p, n in node.items() if p)
        self.keys, self.child = np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int32)
        self.dense = None
        if (len(node) + 1) * self.width <= DENSE:
            self.dense = np.zeros((len(node) + 1) * self.width, np.int32)
            self.dense[self.keys] = self.child

    def _step(self, node: np.ndarray | int, code: np.ndarray) -> np.ndarray:
        key = node * np.int64(self.width) + code
        if self.dense is not None:
            return self.dense[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.child[at], 0)

    def padded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(codes of all texts' words, each with a blank on either side; the text of each code).

        Two blanks meet wherever a word ends, and no term has two, so none reaches beyond its word or text."""
        codes = self.code[np.frombuffer(" ".join(texts).encode("utf-32-le"), np.uint32)]
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1  # with the blank after it
        owner = np.repeat(np.arange(len(texts)), size)[: len(codes)]
        blank = codes == self.code[32]
        word = ~blank
        begins = word.copy()
        begins[1:] &= blank[:-1]
        ends = word.copy()
        ends[:-1] &= blank[1:]
        copies = word.astype(np.int64) + begins + ends
        place = np.cumsum(copies) - ends  # past the character itself
        out = np.full(int(copies.sum()), self.code[32], np.int32)
        out[place[word] - 1] = codes[word]
        return out, np.repeat(owner, copies)

    def counts(self, texts: list[str]) -> np.ndarray:
        """(texts x terms) How often each text has each term."""
        total = np.zeros(len(texts) * self.size, np.int64)
        codes, owner = self.padded(texts)
        if self.size:
            for a in range(0, len(codes), PIECE):
                part, own = codes[a : a + PIECE + self.depth - 1], owner[a : a + PIECE] * self.size
                node = self._step(1, part[:PIECE])
                for k in range(1, self.depth + 1):
                    found = self.number[node]
                    hit = np.flatnonzero(found >= 0)
                    total += np.bincount(own[hit] + found[hit], minlength=len(total))
                    if k < self.depth:
                        n = min(len(node), len(part) - k)
                        node = self._step(node[:n], part[k : k + n])
        return total.reshape(len(texts), self.size)

    def weighted(self, column: pa.Array, idf: np.ndarray) -> Iterator[np.ndarray]:
        """(texts x terms) L2-normalised weights of the texts of ``column``, as many texts at once as CELLS allows."""
        step = max(1, CELLS // max(self.size, 1))
        for a in range(0, len(column), step):
            x = self.counts(column.slice(a, step).to_pylist()) * idf
            norm = np.sqrt((x * x).sum(1))
            yield x / np.where(norm > 0, norm, 1.0)[:, None]


def dot_products(terms: list[str], idf: list[float], weights: list[list[float]], keep: list[str]):
    """For ``mapInArrow``: the columns ``keep`` and ``_s<j>``, the dot product of ``_low``'s weights with ``weights[j]``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, scale, columns = Terms(terms), np.array(idf), [np.array(w) for w in weights]
        for b in batches:
            if b.num_rows:
                got = np.concatenate([np.stack([(x * w).sum(1) for w in columns]) for x in tree.weighted(b.column("_low"), scale)], 1)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *map(pa.array, got)], [*keep, *(f"_s{j}" for j in range(len(columns)))])

    return run


def sparse_rows(terms: list[str], idf: list[float], keep: list[str]):
    """For ``mapInArrow``: the columns ``keep``, and the non-zeros of ``_low``'s weights as arrays ``idx`` and ``val``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, scale = Terms(terms), np.array(idf)
        for b in batches:
            at = 0
            for x in tree.weighted(b.column("_low"), scale):
                own = b.slice(at, len(x))
                at += len(x)
                row, idx = np.nonzero(x)
                off = pa.array(np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(v)) for v in (idx.astype(np.int32), x[row, idx])]
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in keep), *lists], [*keep, "idx", "val"])

    return run
