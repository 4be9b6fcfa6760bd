"""Helpers shared by the document operators: shared storage, chunks of documents, UTF-8 buffers, hashes."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setsift.session import ship

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)
#: Odd base of the polynomial hashes and its inverse modulo 2**64.
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 2**64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only where it is unset on a local master."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if sc.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="setsift-shared-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the lineage, and the planner knows its size."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slim(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; whatever else the table holds stays out of the shuffles."""
    ship(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def chunk_count(docs: DataFrame, chunk_bytes: int) -> tuple[int, int]:
    """(number of chunks of about ``chunk_bytes`` of text, bytes of text); at least four chunks a core."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(math.ceil(total / chunk_bytes), 4 * docs.sparkSession.sparkContext.defaultParallelism), total


def chunked(docs: DataFrame, chunks: int) -> DataFrame:
    """Documents dealt to ``chunks`` by a hash of id and text: copies of one text spread over all chunks."""
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another and the n + 1 offsets of the texts; null is the empty text."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], a.type)
    if a.null_count:
        a = a.fill_null("")
    a = a.cast(pa.large_string()).cast(pa.large_binary())
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit with probability one half."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def golden(k: int) -> np.uint64:
    """The k-th step of a sequence that spreads over all 64-bit numbers."""
    return U64(k * int(GOLDEN) % 2**64)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64; kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        x = np.full(1 << max(10, (max(n, 1) - 1).bit_length()), base, np.uint64)
        x[0] = 1
        have = _POWERS[base] = np.cumprod(x, dtype=np.uint64)
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of values[i] * BASE ** i; see ``span_hash``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(BASE, len(values)), dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial (Rabin-Karp) hash of values[start:end], equal for equal sequences wherever they stand."""
    return (prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word ``[^\\x20\\x09-\\x0D]+``, and the n + 1 offsets of the documents in the words."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    change = inside[1:] & ~inside[:-1]
    starts_at = off[:-1][off[:-1] < off[1:]]
    change[starts_at] |= inside[1:][starts_at]
    start = np.flatnonzero(change[:-1])
    last = inside[1:-1] & ~inside[2:]
    ends_at = off[1:][off[:-1] < off[1:]] - 1
    last[ends_at] |= inside[1:-1][ends_at]
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all else unchanged."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes: the sum of its blocks of eight bytes, each mixed with its place in the word.

    No block's share is a multiple of another's, so regular words (such as those that a polynomial modulo a power of two
    takes for one another) meet no more often than others.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    blocks = (size + 7) >> 3
    first = np.cumsum(blocks) - blocks
    number = np.arange(blocks.sum()) - np.repeat(first, blocks)
    at = np.repeat(start, blocks) + 8 * number
    whole = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    block = whole[at].reshape(-1).view("<u8").astype(np.uint64)
    rest = np.minimum(np.repeat(end, blocks) - at, 8).astype(np.uint64)  # bytes of the block that belong to the word
    block &= U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - U64(8) * rest)
    share = mix(mix(block ^ U64(0xA0761D6478BD642F)) + number.astype(np.uint64) * GOLDEN)
    return mix(np.add.reduceat(share, first) + size.astype(np.uint64) * U64(0xE7037ED1A0B428DB))


#: Modulus of the rolling hashes of words, a prime, and their base, drawn at random once.
PRIME, ROLLING_BASE = (1 << 61) - 1, 0x0D4F5A2C97B1E863


def times(x: np.ndarray, y: int) -> np.ndarray:
    """x * y modulo PRIME, of numbers below it."""
    low, high = x & U64(0xFFFFFFFF), x >> U64(32)
    y_low, y_high = U64(y & 0xFFFFFFFF), U64(y >> 32)
    middle = low * y_high + high * y_low
    product = low * y_low
    out = (product & U64(PRIME)) + (product >> U64(61)) + ((high * y_high) << U64(3)) + (middle >> U64(29)) + ((middle & U64((1 << 29) - 1)) << U64(32))
    out = (out & U64(PRIME)) + (out >> U64(61))
    return np.where(out >= U64(PRIME), out - U64(PRIME), out)


def rolling_hashes(values: np.ndarray, window: int) -> np.ndarray:
    """Rabin-Karp hash modulo PRIME of every ``window`` consecutive values: the polynomial of a window is put together from
    those of its parts of 2**k values. Two different windows meet with a probability below window / 2**61 for a base that
    does not depend on them, however regular they are."""
    if len(values) < window:
        return np.zeros(0, np.uint64)
    part, size, out, done = values % U64(PRIME), 1, None, 0
    while True:
        if window & size:  # the next ``size`` values of each window
            n = len(values) - done - size + 1
            out = part if out is None else join(out[:n], part[done : done + n], size)
            done += size
        if done == window:
            return out
        n = len(part) - size
        part = join(part[:n], part[size : size + n], size)
        size *= 2


def join(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """Hashes of left strings followed by right ones of ``size`` values."""
    out = times(left, pow(ROLLING_BASE, size, PRIME)) + right
    return np.where(out >= U64(PRIME), out - U64(PRIME), out)
