"""Substring removal by Rabin-Karp hashes of every fixed-length window of words.

Documents are dealt to chunks of a few megabytes by a hash. A chunk hashes each window of ``window`` consecutive words
from the hashes of its parts of 1, 2, 4 .. words, keeps each hash once with its smallest doc_id, and sends
it to a bucket of hashes. A bucket finds the hashes that several chunks hold and tells each chunk which of its hashes
start in a document with a smaller id elsewhere; what repeats inside a chunk the chunk knows itself. So a passage that
a third of all documents share is one entry per chunk. The chunk then merges the windows to be removed into maximal
intervals. Words are hashed to 64 bits and windows modulo the prime 2**61 - 1, so regular texts collide no more often than
others: two different windows meet with a probability below (window + 1) * 2**-61.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setsift.llm._common import chunk_count, chunked, mix, rolling_hashes, slim, utf8, word_hashes, words_of

#: Bytes of text in a chunk, and of text whose windows meet in one bucket of hashes.
CHUNK, BUCKET = 4 << 20, 12 << 20
LAST = np.iinfo(np.int64).max
BLOB = "bucket int, chunk int, hashes binary, ids binary"


def window_hashes(data: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each window, number of its first word, its document), and the documents' offsets in the words."""
    start, end, doc = words_of(data, off)
    rolled = rolling_hashes(word_hashes(data, start, end), window)
    whose = np.repeat(np.arange(len(off) - 1), np.diff(doc))
    n = max(0, len(start) - window + 1)
    first = np.flatnonzero(whose[:n] == whose[window - 1 :]) if n else np.zeros(0, np.int64)
    return mix(rolled[first]), first, whose[first], doc


def in_order(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The documents of a chunk by ascending id, and the ids (null: last)."""
    ids = np.array(t.column("doc_id").fill_null(LAST).to_numpy(), np.int64)
    order = np.argsort(ids, kind="stable")
    return t.take(pa.array(order)), ids[order]


def once(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the first occurrence of each value in order of values, for each place that first place)."""
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    first = order[new]
    origin = np.empty(len(s), np.int64)
    origin[order] = first[np.cumsum(new) - 1]
    return first, origin


def blobs(chunk: int, hashes: np.ndarray, ids: np.ndarray, buckets: int) -> pa.Table:
    """A row per bucket; the low bits choose it."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    have = np.flatnonzero(np.diff(cut))
    rows = [order[cut[b] : cut[b + 1]] for b in have]
    return pa.table({"bucket": pa.array(have, pa.int32()), "chunk": pa.array([chunk] * len(have), pa.int32()), "hashes": pa.array([hashes[r].tobytes() for r in rows], pa.binary()), "ids": pa.array([ids[r].tobytes() for r in rows], pa.binary())})


def hash_windows(window: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        t, ids = in_order(t)
        hashes, _, doc, _ = window_hashes(*utf8(t.column("text")), window)
        first = np.sort(once(hashes)[0])  # in the order of documents, which keeps equal ids together
        return blobs(t.column("chunk")[0].as_py(), hashes[first], ids[doc[first]], buckets)

    return run


def repeated(t: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk, its hashes that another chunk has with a smaller document id."""
    hashes = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in t.column("hashes")])
    ids = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in t.column("ids")])
    sizes = np.array([len(x.as_py()) // 8 for x in t.column("hashes")])
    chunk = np.repeat(np.array(t.column("chunk").to_numpy()), sizes)
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = order[ids[order] > least]
    hit = hit[np.argsort(chunk[hit], kind="stable")]
    names, cut = np.unique(chunk[hit], return_index=True)
    return pa.table({"chunk": pa.array(names, pa.int32()), "hits": pa.array([x.tobytes() for x in np.split(hashes[hit], cut[1:])] if len(names) else [], pa.binary())})


def removal(window: int, texts: bool = True) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(t: pa.Table, hits: pa.Table) -> pa.Table:
        if not t.num_rows:
            return out([], [], [], [], [])
        t, ids = in_order(t)
        data, off = utf8(t.column("text"))
        hashes, first, doc, words = window_hashes(data, off, window)
        _, origin = once(hashes)
        known = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in hits.column("hits")])) if hits.num_rows else np.zeros(0, np.uint64)
        gone = ids[doc] > ids[doc[origin]]
        if len(known):
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            gone |= known[at] == hashes
        cover = np.zeros(words[-1] + 1, np.int32)
        np.add.at(cover, first[gone], 1)
        np.add.at(cover, first[gone] + window, -1)
        keep = np.cumsum(cover[:-1]) == 0
        sums = np.concatenate([[0], np.cumsum(keep)])
        kept, raw = [], data.tobytes()
        for k in range(t.num_rows):
            own = raw[off[k] : off[k + 1]].split()
            if sums[words[k + 1]] - sums[words[k]] < len(own):
                own = itertools.compress(own, keep[words[k] : words[k + 1]])
            kept.append(b" ".join(own))
        n = np.diff(words)
        return out(t.column("doc_id"), n, n - np.diff(sums[words]), [hashlib.sha256(x).hexdigest() for x in kept], kept if texts else [None] * len(kept))

    def out(ids, n, removed, digest, kept) -> pa.Table:
        return pa.table({"doc_id": pa.chunked_array(ids.chunks, pa.int64()) if isinstance(ids, pa.ChunkedArray) else pa.array(ids, pa.int64()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return run


def substring_dedup(docs: DataFrame, window: int = 50, texts: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, one blank
    between; null unless ``texts``).

    A word goes when a window of ``window`` words that covers it also starts in a document with a smaller id; rows of
    one id do not remove each other, null ids come after all others. Texts shorter than a window, empty and null texts
    keep all they have. Other columns are ignored.
    """
    docs = slim(docs, id_col, text_col)
    chunks, size = chunk_count(docs, CHUNK)
    buckets = max(math.ceil(size / BUCKET), 2 * docs.sparkSession.sparkContext.defaultParallelism)
    dealt = chunked(docs, chunks)
    found = dealt.groupBy("chunk").applyInArrow(hash_windows(window, buckets), BLOB).groupBy("bucket").applyInArrow(repeated, "chunk int, hits binary")
    return dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(removal(window, texts), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
