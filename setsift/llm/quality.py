"""Supervised subword embeddings: a quality classifier in the manner of fastText, trained by numpy SGD.

A text is the average of the hashed vectors of its words, word pairs, immediate repetitions and character n-grams (inside
words, with their borders); a softmax layer over that average gives the class. Training draws a bounded sample of labelled rows to the
driver. Scoring folds the learned matrices into one number per bucket (the difference of the two logits), which is all
that the workers need: 8 bytes times ``buckets``, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setsift.llm._common import slim, utf8, word_hashes, words_of

#: Bytes of text that are turned into features at a time.
SLICE = 1 << 20
#: The feature of a word that repeats the one before it, whichever it is.
AGAIN = 0x5BD1E995
#: Multipliers of the byte places of a character n-gram.
PLACES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)


@dataclass(frozen=True)
class Settings:
    """``max_rows`` labelled rows (those of the documents there are with the smallest hash of the id) are learnt from, whole."""

    bits: int = 18
    dim: int = 12
    chars: tuple[int, ...] = (3, 4)
    epochs: int = 8
    rate: float = 0.5
    max_rows: int = 4000
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """``gain``: per bucket, what one occurrence adds to the logit of class 1 before averaging; ``bias``: the rest."""

    gain: np.ndarray
    bias: float
    settings: Settings


def _slices(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE bytes; a longer text stands alone."""
    at = 0
    while at < len(off) - 1:
        to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE, "right")) - 1)
        yield at, to
        at = to


def features(data: np.ndarray, off: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (bucket of each feature, offsets of the texts in them): words, word pairs, repeated words, then each n-gram
    length."""
    shift = np.uint64(64 - s.bits)
    start, end, doc = words_of(data, off)
    word = word_hashes(data, start, end)
    yield (word >> shift).astype(np.int64), doc
    first = np.zeros(len(word) + 1, bool)
    first[doc] = True
    pair = np.flatnonzero(~first[1:-1]) if len(word) else np.zeros(0, np.int64)
    mixed = (word[pair] * np.uint64(0x9E3779B97F4A7C15) ^ word[pair + 1]) * np.uint64(0xC2B2AE3D27D4EB4F) if len(pair) else np.zeros(0, np.uint64)
    yield (mixed >> shift).astype(np.int64), np.searchsorted(pair, doc)
    again = pair[word[pair] == word[pair + 1]] if len(pair) else pair
    yield np.full(len(again), AGAIN % (1 << s.bits)), np.searchsorted(again, doc)
    # words with one blank between: n-grams may begin or end with a blank, but hold none inside
    sizes = end - start
    at = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int64)
    text = np.full(at[-1] + 1, 32, np.uint8)
    text[np.arange(sizes.sum()) + np.repeat(np.arange(1, len(sizes) + 1), sizes)] = data[np.arange(sizes.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)] if len(sizes) else 0
    blanks = np.concatenate([[0], np.cumsum(text == 32, dtype=np.int32)])
    wide = text.astype(np.uint32)
    for n in s.chars:
        m = len(text) - n + 1
        if m <= 0:
            yield np.zeros(0, np.int64), np.zeros(len(off), np.int64)
            continue
        keep = np.flatnonzero(blanks[n - 1 : m + n - 1] == blanks[1 : m + 1])
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h += wide[k : m + k] * PLACES[k]
        h = h[keep]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0x297A2D39)
        yield (h >> np.uint32(32 - s.bits)).astype(np.int64), np.searchsorted(keep, at[doc])


def bag(text: str | None, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text's features, and the share that each has in them."""
    found = np.concatenate([b for b, _ in features(*utf8(pa.array([text], pa.string())), s)])
    bucket, n = np.unique(found, return_counts=True)
    return bucket.astype(np.int32), (n / max(1, len(found))).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], s: Settings) -> Model:
    """Plain SGD over single texts, learning rate falling to 0; classes are 0 and 1. Without rows: even odds."""
    rng = np.random.default_rng(s.seed)
    size = 1 << s.bits
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (size, s.dim)).astype(np.float32)
    out = np.zeros((2, s.dim), np.float32)
    bias = np.zeros(2, np.float32)
    total, step = max(1, s.epochs * len(bags)), 0
    for _ in range(s.epochs):
        for k in rng.permutation(len(bags)):
            rate = np.float32(s.rate * (1 - step / total))
            step += 1
            at, share = bags[k]
            own = vectors[at]
            hidden = share @ own
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = p @ out
            out -= rate * np.outer(p, hidden)
            bias -= rate * p
            # the sum over the text's occurrences, as if each had been updated in turn
            vectors[at] = own - rate * share[:, None] * back * np.float32(min(len(at), 200))
    w = (out[1] - out[0]).astype(np.float64)
    return Model((vectors @ w.astype(np.float32)).astype(np.float64), float(bias[1] - bias[0]), s)


def score_texts(column, model: Model) -> np.ndarray:
    """Probability of class 1 of each text; an empty text gets that of the bias alone."""
    data, off = utf8(column)
    out = np.full(len(off) - 1, 0.0)
    for a, b in _slices(off):
        part = off[a : b + 1] - off[a]
        total, count = np.zeros(b - a), np.zeros(b - a)
        for bucket, doc in features(data[off[a] : off[b]], part, model.settings):
            n = np.diff(doc)
            total += np.bincount(np.repeat(np.arange(b - a), n), model.gain[bucket[doc[0] : doc[-1]]], b - a)
            count += n
        out[a:b] = total / np.maximum(count, 1)
    return 1 / (1 + np.exp(-np.clip(out + model.bias, -700, 700)))


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """At most ``max_rows`` rows (id, text, label) outside the held-out fold; labels without a document take no place. Rows
    without id or label are left out."""
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label"))
        .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1))
        .filter(~held_out("id"))
    )
    own = slim(docs)
    chosen = marked.join(own.select("doc_id"), F.col("id") == F.col("doc_id"), "left_semi").orderBy(F.xxhash64("id"), "id", "label").limit(s.max_rows)
    # the limit bounds the broadcast side; the second limit bounds what repeated ids could add
    rows = own.join(F.broadcast(chosen), own["doc_id"] == chosen["id"]).withColumn("h", F.xxhash64("text"))
    first = rows.select("id", "label", "h").orderBy(F.xxhash64("id"), "id", "label", "h").limit(s.max_rows)
    return rows.join(F.broadcast(first.distinct()), ["id", "label", "h"], "left_semi").dropDuplicates(["id", "label", "h"]).select("id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """The features are made where the texts are; the driver gets 8 bytes for each distinct feature of a row."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                made = [bag(t.as_py(), settings) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array([x[k].tobytes() for x in made], pa.binary()) for k in (0, 1))], names=["id", "label", "buckets", "shares"])

    rows = training_rows(docs, labels, settings).mapInArrow(bags, "id long, label int, buckets binary, shares binary").toArrow().sort_by([("id", "ascending"), ("label", "ascending"), ("buckets", "ascending")])
    got = [(np.frombuffer(x.as_buffer(), np.int32), np.frombuffer(y.as_buffer(), np.float32)) for x, y in zip(rows["buckets"], rows["shares"], strict=True)]
    return train(got, rows["label"].to_pylist(), settings)


def quality_score(text: Column, model: Model) -> Column:
    """Column function: probability of label 1 of a text; null counts as the empty text."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(pa.array(texts, pa.string(), from_pandas=True), model))

    return score(text)


def quality_table(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.5 on) of every row, repeated and null ids as well; no shuffle of
    the documents. Null and empty texts get the score of the bias. Extra columns are ignored; without labelled rows
    every score is 0.5."""
    model = fit(docs, labels, settings)
    scored = slim(docs).select("doc_id", held_out().alias("held_out"), quality_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
