"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order tree of byte contexts: for every context of up to ORDER bytes of its training texts the
bytes that followed it, with their counts. The statistics are frozen after training. The code length of a byte is exact
PPM with escape method C and exclusion: the longest known context either codes the byte, at count / (total + distinct),
or escapes, at distinct / (total + distinct), to the next shorter one, where the bytes already excluded no longer count;
below the empty context all bytes not yet excluded are equally likely. A text's language is the one whose tree gives the
shortest code.

A byte's code length depends on itself and the ORDER bytes before it only, so a task works out each distinct string of
ORDER + 1 bytes of a batch once for all languages and sums them up by text. Lengths are whole numbers of 2**-20 bits: sums
do not depend on batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setsift.llm._common import ship, utf8

#: Bytes of context; ORDER + 1 bytes fit a 64-bit number.
ORDER = 4
#: Bytes of text that are scored at a time.
SLICE = 4 << 20
UNIT = 1 << 20
#: What every byte stands for: letters of ASCII in lower case, bytes above ASCII themselves, all others a blank.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


@dataclass(frozen=True)
class Settings:
    """What is learnt from, for each language: the ``max_rows`` rows with the least hash of id and text, of these as many as
    begin within the first ``max_bytes`` bytes. ``max_langs``: how many languages may be learnt (the most frequent)."""

    max_rows: int = 4000
    max_bytes: int = 6 << 20
    max_langs: int = 64


def folded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded texts, runs of blanks as one, each text after ORDER blanks and with one at its end; their offsets."""
    x = FOLD[data]
    blank = x == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    starts = off[:-1][off[:-1] < off[1:]]
    keep[starts] = ~blank[starts]
    size = np.concatenate([[0], np.cumsum(keep)])[off]
    n = np.diff(size)
    cut = np.concatenate([[0], np.cumsum(n + ORDER + 1)])
    out = np.full(cut[-1], 32, np.uint8)
    out[np.arange(n.sum()) + np.repeat(np.arange(len(n)) * (ORDER + 1) + ORDER, n)] = x[keep]
    return out, cut


def strings(x: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the ORDER + 1 bytes that end at each byte to be coded, and the texts' offsets in them."""
    wide = x.astype(np.int64)
    code = np.zeros(max(0, len(x) - ORDER), np.int64)
    for k in range(ORDER + 1):
        code = (code << 8) | wide[k : len(x) - ORDER + k]
    inside = np.ones(len(code), bool)
    for k in range(1, ORDER + 1):  # not those that reach into the text before
        edge = cut[1:-1] - k
        inside[edge[edge < len(code)]] = False
    return code[inside], cut - np.arange(len(cut)) * ORDER


def grown(texts: Iterator[str]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct strings of ORDER + 1 bytes ascending, their counts) of training texts."""
    code, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for t in texts:
        new, n = np.unique(strings(*folded(*utf8(pa.array([t], pa.string()))))[0], return_counts=True)
        both = np.concatenate([code, new])
        code, inverse = np.unique(both, return_inverse=True)
        count = np.bincount(inverse, np.concatenate([count, n]), len(code)).astype(np.int64)
    return code, count


class Tree:
    """Per order: the contexts (ascending) with their totals and numbers of distinct bytes, and (context, byte) with counts;
    ``gone``: per context of an order, the total that its bytes have in the next shorter context, excluded there."""

    def __init__(self, code: np.ndarray, count: np.ndarray) -> None:
        self.context, self.total, self.distinct, self.symbol, self.count, self.gone = [], [], [], [], [], []
        for k in range(ORDER + 1):
            symbol, inverse = np.unique(code & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.bincount(inverse, count, len(symbol)).astype(np.int64)
            context, inverse = np.unique(symbol >> 8, return_inverse=True)
            self.context.append(context)
            self.total.append(np.bincount(inverse, n, len(context)).astype(np.int64))
            self.distinct.append(np.bincount(inverse, minlength=len(context)))
            self.symbol.append(symbol)
            self.count.append(n)
            if k:
                below = symbol & ((1 << 8 * k) - 1)
                self.gone.append(np.bincount(inverse, self.count[k - 1][np.searchsorted(self.symbol[k - 1], below)], len(context)).astype(np.int64))
            else:
                self.gone.append(np.zeros(len(context), np.int64))

    def bits(self, code: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each string after the ORDER bytes before it, in units."""
        out = np.zeros(len(code))
        gone, fewer = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        todo = np.arange(len(code))
        for k in range(ORDER, -1, -1):
            if not len(todo) or not len(self.context[k]):
                continue
            symbol = code[todo] & ((1 << 8 * (k + 1)) - 1)
            context = symbol >> 8
            at = np.minimum(np.searchsorted(self.context[k], context), len(self.context[k]) - 1)
            known = self.context[k][at] == context
            own, at, symbol = todo[known], at[known], symbol[known]
            total, distinct = self.total[k][at] - gone[own], self.distinct[k][at] - fewer[own]
            place = np.minimum(np.searchsorted(self.symbol[k], symbol), len(self.symbol[k]) - 1)
            hit = self.symbol[k][place] == symbol
            some = distinct > 0  # where all bytes of a context are excluded, it is passed at no cost
            part = np.where(hit, self.count[k][place], np.maximum(distinct, 1)) / np.maximum(total + distinct, 1)
            out[own[some]] -= np.log2(part[some])
            gone[own], fewer[own] = self.gone[k][at], self.distinct[k][at]
            left = np.ones(len(code), bool)
            left[own[hit]] = False
            todo = todo[left[todo]]
        out[todo] += np.log2(np.maximum(256 - fewer[todo], 1))
        return np.rint(out * UNIT).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """The languages in ascending order and their trees."""

    langs: list[str]
    trees: list[Tree]

    def lengths(self, texts) -> np.ndarray:
        """Code length of each text (rows) in each language (columns), in units."""
        data, off = utf8(texts)
        out = np.zeros((len(off) - 1, len(self.langs)), np.int64)
        at = 0
        while at < len(off) - 1:
            to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE, "right")) - 1)
            code, cut = strings(*folded(data[off[at] : off[to]], off[at : to + 1] - off[at]))
            distinct, inverse = np.unique(code, return_inverse=True)
            for k, tree in enumerate(self.trees):
                out[at:to, k] = np.add.reduceat(tree.bits(distinct)[inverse], cut[:-1])
            at = to
        return out


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, s: Settings, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, text) of the bounded sample outside the held-out fold; rows without text or language are left out."""
    own = docs.filter(~held_out(id_col) & F.col(f"`{text_col}`").isNotNull() & F.col(f"`{lang_col}`").isNotNull())
    own = own.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"), F.xxhash64(f"`{id_col}`", f"`{text_col}`").alias("h"))
    thin = own.select("lang", "h", F.octet_length("text").alias("size"))
    langs = thin.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(s.max_langs)
    # of n rows those of the least hashes, twice as many as are wanted, leave their tasks; equal rows do so once a task
    low = thin.join(F.broadcast(langs), "lang").filter((F.col("h") / 2.0**64 + 0.5) * F.col("n") <= 2 * s.max_rows + 100)
    order = Window.partitionBy("lang").orderBy("h")
    first = low.groupBy("lang", "h").agg(F.min("size").alias("size")).withColumn("at", F.row_number().over(order)).filter(F.col("at") <= s.max_rows)
    first = first.withColumn("before", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    chosen = first.filter(F.col("before") < s.max_bytes).select("lang", "h")
    return own.join(F.broadcast(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text")


def fit(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts by language, in one task a language over its bounded sample; the driver gets the counts."""
    ship(docs.sparkSession)

    def count(t: pa.Table) -> pa.Table:
        code, n = grown(x.as_py() for x in t.column("text"))
        return pa.table({"lang": pa.array([t.column("lang")[0].as_py()]), "code": pa.array([code.tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary())})

    rows = training_rows(docs, settings, id_col, text_col, lang_col).groupBy("lang").applyInArrow(count, "lang string, code binary, n binary").collect()
    rows.sort(key=lambda r: r["lang"].encode())
    return Model([r["lang"] for r in rows], [Tree(np.frombuffer(r["code"], np.int64), np.frombuffer(r["n"], np.int64)) for r in rows])


def languages(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, bits (the shortest code, in bits).

    ``lang_pred`` is the learnt language of the shortest code (ties: the least name); ``und`` where the text is null or holds
    no letter, and where nothing was learnt; score is then 0, else the share of 2 ** -length that the language has among
    all, from 0 to 1. Null ids are not held out; repeated rows are rows like others; extra columns are ignored. No shuffle
    of the documents; the model is broadcast: at most max_langs trees from max_bytes and one text each.
    """
    model = fit(docs, settings, id_col, text_col, lang_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = sent.value
            length = m.lengths(b.column(2)) if m.langs else np.zeros((b.num_rows, 1), np.int64)
            best = length.argmin(1)
            least = length.min(1, initial=np.iinfo(np.int64).max)
            share = 1 / np.exp2(-np.minimum((length - least[:, None]) / UNIT, 1000)).sum(1)
            letter = np.array(b.column(3).to_numpy(zero_copy_only=False), bool) & bool(m.langs)
            pred = [m.langs[k] if ok else "und" for k, ok in zip(best, letter, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(np.where(letter, share, 0.0)), pa.array(np.where(letter, least / UNIT, 0.0))], names=["doc_id", "held_out", "lang_pred", "score", "bits"])

    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, bits double")
