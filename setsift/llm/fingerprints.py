"""Document fingerprints by one-permutation MinHash.

Every 8-byte shingle of a text is hashed once; the high bits choose one of BINS bins, and a bin keeps its least hash.
Empty bins are filled by optimal densification: bin b asks the bins h(b, 1), h(b, 2), ... in turn and copies the first
that is not empty, with a sequence of its own and the same for all texts. A fingerprint stores the low BITS bits of each
bin, packed, as hexadecimal digits. Two unequal bins agree in these bits with a probability of 2**-BITS, which the
estimate takes out again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setsift.llm._common import GOLDEN, U64, golden, mix, slim

BINS, BITS, SHINGLE = 256, 4, 8
NONE = np.iinfo(np.uint64).max
#: Bytes of text in a range of documents, and bytes of text that are hashed at a time.
RANGE, SLICE = 16 << 20, 1 << 20
FIRST = -(2**63)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _probes() -> Iterator[np.ndarray]:
    """For each attempt, the bin that each bin asks."""
    attempt = 0
    while True:
        attempt += 1
        yield (mix(np.arange(BINS, dtype=np.uint64) + golden(attempt)) >> U64(64 - 8)).astype(np.int64) % BINS


def sketches(texts: list[bytes]) -> np.ndarray:
    """Low bits of the densified bins, one row a text; a text without bytes has only zeros."""
    size = np.array([len(t) for t in texts], np.int64)
    # each text followed by zeros: a shorter text than a shingle is one shingle with its zeros
    data = np.frombuffer(b"".join(t + bytes(SHINGLE) for t in texts) + bytes(SHINGLE), np.uint8)
    begin = np.concatenate([[0], np.cumsum(size + SHINGLE)[:-1]]).astype(np.int64) if len(size) else size
    n = np.where(size == 0, 0, np.maximum(size - SHINGLE + 1, 1))
    at = np.arange(n.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) if len(n) else n
    eights = np.ndarray(len(data) - SHINGLE, "<u8", data, strides=(1,))
    h = mix(eights[at] + GOLDEN)
    least = np.full(len(texts) * BINS, NONE, np.uint64)
    np.minimum.at(least, np.repeat(np.arange(len(texts)) * BINS, n) + (h >> U64(64 - 8)).astype(np.int64), h)
    least = least.reshape(len(texts), BINS)
    filled = least != NONE
    out = least.copy()
    row, col = np.nonzero(~filled & filled.any(1)[:, None])
    for ask in _probes():
        if not len(row):
            break
        hit = filled[row, ask[col]]
        out[row[hit], col[hit]] = least[row[hit], ask[col[hit]]]
        row, col = row[~hit], col[~hit]
    low = (mix(out) & U64((1 << BITS) - 1)).astype(np.uint8)
    low[~filled.any(1)] = 0
    return low


def likeness(a: np.ndarray, b: np.ndarray, has_a: np.ndarray, has_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity, 0 to 1; two empty texts are alike, an empty and another one are not."""
    chance = 2.0**-BITS
    return np.where(has_a & has_b, np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1), (has_a == has_b).astype(float))


def packed_hex(low: np.ndarray, has: np.ndarray) -> list[str]:
    pairs = (low[:, 0::2] << BITS) | low[:, 1::2]
    return [r.tobytes().hex() if h else "" for r, h in zip(pairs, has, strict=True)]


def order_bytes(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Sixteen bytes a pair that compare as the pairs do: both numbers big-endian with the sign bit turned."""
    pairs = np.stack([ids.astype(np.int64), hashes.astype(np.int64)], 1).view(np.uint64) ^ U64(1 << 63)
    return np.ascontiguousarray(pairs.astype(">u8")).view("S16").ravel()


def _rows(ids: list, texts: list[str]) -> pa.RecordBatch:
    """``texts`` holds one text more than ``ids``: that after the last."""
    edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(texts, texts[1:], strict=False)]
    raw, new = [t.encode() for t in texts], [t.encode() for t in edited]
    own, alt = sketches(raw), sketches(new)
    has, has_alt = np.array([bool(t) for t in raw]), np.array([bool(t) for t in new])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in new]),
            pa.array(packed_hex(own[:-1], has[:-1])),
            pa.array(packed_hex(alt, has_alt)),
            pa.array(likeness(own[:-1], alt, has[:-1], has_alt)),
            pa.array(likeness(own[:-1], own[1:], has[:-1], has[1:])),
        ],
        names=[c.split()[0] for c in SCHEMA.split(", ")],
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, ids ascending, the first document of the next range last: each meets its successor. A range
    starts with all rows of its first (id, hash), so of those sent ahead the first stands for all."""
    ids, texts, size, part = [], [], 0, None
    for b in batches:
        for p, ahead, i, t in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            t = t or ""
            if p != part:
                part, ids, texts, size, ended = p, [], [], 0, False
            if ended:
                continue  # a further row that shares id and hash with the first of the next range
            texts.append(t)
            size += len(t)
            if ahead:
                ended = True
                if ids:
                    yield _rows(ids, texts)
            elif size > SLICE and ids:
                yield _rows(ids, texts)
                ids, texts, size = [i], [t], len(t)
            else:
                ids.append(i)


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that with the next greater id (after the last: the first); null ids stand before all others,
    rows that repeat an id follow each other in the order of a hash of their texts. Null texts are empty; an empty text
    has an empty fingerprint. An empty table gives an empty result; other columns are ignored.

    One shuffle of the texts. A pass over ids and hashes finds the first (id, hash) of each range; the documents with
    these are sent to the range before theirs as well, so that every task has the successor of its last document. An id
    that many rows share, the null one too, spreads over ranges by the hash; only rows alike in both stay together.
    """
    spark = docs.sparkSession
    rows = slim(docs, id_col, text_col).select("*", F.coalesce("doc_id", F.lit(FIRST)).alias("ord"), F.xxhash64("text").alias("hash"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(math.ceil(total / RANGE), 2 * spark.sparkContext.defaultParallelism)
    heads = rows.select("ord", "hash").repartitionByRange(ranges, "ord", "hash").groupBy(F.spark_partition_id()).agg(F.min(F.struct("ord", "hash")).alias("first"))
    heads = sorted(tuple(r["first"]) for r in heads.collect())
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    first = order_bytes(*np.array(heads, np.int64).T)

    @F.pandas_udf("int")
    def place(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        """Twice the number of the row's range, plus 1 for the first (id, hash) of the range."""
        at = order_bytes(ids.to_numpy(), hashes.to_numpy())
        k = np.searchsorted(first, at, "right") - 1
        return pd.Series((2 * k + (first[k] == at)).astype(np.int32))

    rows = rows.withColumn("place", place("ord", "hash")).withColumn("part", F.shiftright("place", 1))
    own = F.struct(F.col("part"), F.lit(False).alias("ahead"))
    before = F.struct(F.pmod(F.col("part") - 1, F.lit(len(first))).alias("part"), F.lit(True).alias("ahead"))
    rows = rows.withColumn("to", F.explode(F.when(F.col("place") % 2 == 1, F.array(own, before)).otherwise(F.array(own))))
    rows = rows.select(F.col("to.part").alias("part"), F.col("to.ahead").alias("ahead"), "doc_id", "text", "ord", "hash")
    rows = rows.repartitionById(len(first), "part").sortWithinPartitions("part", "ahead", "ord", "hash")
    return rows.select("part", "ahead", "doc_id", "text").mapInArrow(_walk, SCHEMA)
