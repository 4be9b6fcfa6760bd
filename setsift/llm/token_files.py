"""Token-ID files: flat unsigned integers with 64-bit document offsets, read through memory maps.

A data set is one folder. Part ``p`` has ``p.ids`` (the ids of its documents one after another, little-endian unsigned
integers, two bytes each when the vocabulary allows it, else four) and ``p.idx`` (an int64 array: number of documents,
their ids, one null flag each, and the n + 1 offsets of the documents in ``p.ids``). Parts hold ranges of ascending
doc_id, so the global place of a document is its part's base plus its offset; the bases are prefix sums over the token
counts of the parts. Files appear under their name by one rename, so a task that runs twice leaves the same files. The
folder must be mounted on driver and executors (memory maps need a file system path).
"""

from __future__ import annotations

import itertools
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setsift.llm._common import new_path, slim

PART_SCHEMA = "first_id long, part string, n_docs long, n_tokens long"
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: A white space character other than blank and line feed, or the mark that pieces are cut at.
OTHER_SPACE = re.compile(r"[^\S \n]|\x00")
#: Marks at the end of a piece; after a letter or digit they are a token run of their own.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A piece of Latin letters (the same in all versions of Unicode), which the byte-level pre-tokeniser leaves whole.
LETTERS = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)")
#: What OTHER_SPACE finds in ASCII texts.
ASCII_SPACE = "\x00\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
#: Pieces whose ids a worker remembers, and the longest such piece in characters.
CACHE_PIECES, CACHE_CHARS = 800_000, 40
#: Characters of text that are cut and encoded at a time.
SLICE = 8 << 20


def byte_characters() -> dict[int, str]:
    """Byte -> the character that stands for it in a byte-level vocabulary: itself where it is printable, else the next
    one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def mounted(path: str) -> str:
    """The file system path of a folder that the nodes have mounted."""
    u = urlparse(path)
    if u.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted folder, not {u.scheme}:")
    return u.path


class Encoder:
    """The ids of whole texts by a tokenizers file, as little-endian bytes.

    Byte-level BPE never merges across the pre-tokeniser's borders. Before a single blank and around a single line feed
    between other characters there always is such a border, so texts whose white space is only that are cut there and
    pieces are encoded once and remembered. Pieces of letters go to the file's BPE model without the pre-tokeniser, which
    leaves them whole. Any text with other white space or added tokens is encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = next(c for c in "HIL" if array(c).itemsize == self.dtype.itemsize)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.direct = type(self.model.pre_tokenizer).__name__ == "ByteLevel" and self.model.normalizer is None and not any(LETTERS.fullmatch(t) for t in self.added)
        self.bytes = byte_characters()
        self.known: dict[str, bytes] = {"": b""}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_letters(self, pieces: list[str]) -> list[bytes]:
        """The same of pieces of letters, by the model alone."""
        one = self.model.model.tokenize
        shown = "\n".join(pieces).encode().decode("latin-1").translate(self.bytes).split(self.bytes[10]) if pieces else []
        return [array(self.code, [t.id for t in one(p)]).tobytes() for p in shown]

    def can_be_cut(self, text: str) -> bool:
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1].isspace() or text[-1:].isspace():
            return False
        if any(t in text for t in self.added):
            return False
        return not any(c in text for c in ASCII_SPACE) if text.isascii() else not OTHER_SPACE.search(text)

    def _learn(self, pieces: list[str]) -> list[str]:
        """Makes all pieces known; returns those that are not to be remembered."""
        known = self.known
        new = [p for p in pieces if p not in known]
        if len(known) + len(new) > CACHE_PIECES:
            for p in list(itertools.islice(known, 1, 1 + CACHE_PIECES // 2)):  # the oldest half, but not the empty piece
                del known[p]
            new = [p for p in pieces if p not in known]
        ends = {p: p.rstrip(MARKS) for p in new if p[-1:] in MARKS}
        cut = {p: (b, p[len(b) :]) for p, b in ends.items() if b[-1:].isalnum()}
        whole = dict.fromkeys(p for p in new if p not in cut)
        whole |= dict.fromkeys(p for p in chain.from_iterable(cut.values()) if p not in known)
        letters = list(filter(LETTERS.fullmatch, whole)) if self.direct else []
        known.update(zip(letters, self._encode_letters(letters), strict=True))
        rest = [p for p in whole if p not in known]
        for i in range(0, len(rest), 4096):
            known.update(zip(rest[i : i + 4096], self._encode(rest[i : i + 4096]), strict=True))
        known.update({p: known[b] + known[m] for p, (b, m) in cut.items()})
        return list({p for p in chain(new, whole) if len(p) > CACHE_CHARS})

    def _cut(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of texts that can be cut: cut, numbered and put together by Arrow's kernels."""
        marked = "\x00".join(texts).replace(" ", "\x00 ").replace("\n", "\x00\n\x00")
        pieces = pc.list_flatten(pc.split_pattern(pa.array([marked], pa.large_string()), "\x00")).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        long = self._learn(distinct)
        raw = [self.known[p] for p in distinct]
        for p in long:
            del self.known[p]
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // self.dtype.itemsize
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]), pa.array(np.frombuffer(b"".join(raw), self.dtype)))
        at = pieces.indices.to_numpy()
        ids = lists.take(pieces.indices).flatten().to_numpy().astype(self.dtype, copy=False)
        ends = np.concatenate([[0], np.cumsum(size[at])])
        count = np.cumsum([0] + [1 + t.count(" ") + 2 * t.count("\n") for t in texts])
        for a, b in zip(ends[count], ends[count[1:]], strict=False):
            yield ids[a:b].tobytes()

    def texts(self, texts: list[str], end: int) -> Iterator[bytes]:
        tail = np.array([end], self.dtype).tobytes()
        free = [self.can_be_cut(t) for t in texts]
        cut = self._cut([t for t, ok in zip(texts, free, strict=True) if ok]) if any(free) else iter(())
        uncut = iter(self._encode([t for t, ok in zip(texts, free, strict=True) if not ok]))
        for ok in free:
            yield (next(cut) if ok else next(uncut)) + tail


@cache
def encoder(path: str) -> Encoder:
    """One a worker process, for all its tasks."""
    return Encoder(path)


def _put(path: str, data: list[bytes]) -> None:
    with open(tmp := f"{path}.{uuid.uuid4().hex}", "wb") as f:
        f.writelines(data)
    os.replace(tmp, path)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Encode every whole text (null: empty), append ``end_id``, write the parts; returns (part, base, tokens) in order.

    One shuffle: rows go to ranges of doc_id (nulls first; repeated ids by text). What reaches the driver is a row per
    part. An empty table writes nothing.
    """
    folder = mounted(path)
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ids, sizes, name = None, [], [0], uuid.uuid4().hex
        tmp = f"{folder}/{name}.tmp"
        with open(tmp, "wb") as out:
            for b in batches:
                enc = enc or encoder(tokenizer)
                size = np.cumsum(pc.fill_null(pc.utf8_length(b.column(1)), 0).to_numpy(zero_copy_only=False)) if b.num_rows else np.zeros(0)
                at = 0
                while at < b.num_rows:
                    to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right")))
                    part, at = b.slice(at, to - at), to
                    ids += part.column(0).to_pylist()
                    for raw in enc.texts([t or "" for t in part.column(1).to_pylist()], end_id):
                        out.write(raw)
                        sizes.append(len(raw) // enc.dtype.itemsize)
        if not ids:
            os.remove(tmp)
            return
        offsets = np.cumsum(np.array(sizes, np.int64))
        null = np.array([x is None for x in ids], np.int64)
        key = np.array([0 if x is None else x for x in ids], np.int64)
        # the name follows from the content, so a second run of the task replaces its files by equal ones
        part = f"{enc.dtype.itemsize}-{zlib.crc32(key.tobytes() + offsets.tobytes()):08x}-{len(ids)}-{key[0]}-{int(null[0])}-{offsets[-1]}"
        os.replace(tmp, f"{folder}/{part}.ids")
        _put(f"{folder}/{part}.idx", [np.array([len(ids)], "<i8").tobytes(), key.astype("<i8").tobytes(), null.astype("<i8").tobytes(), offsets.astype("<i8").tobytes()])
        yield pa.RecordBatch.from_pylist([{"first_id": None if null[0] else int(key[0]), "part": part, "n_docs": len(ids), "n_tokens": int(offsets[-1])}], schema=pa.schema([("first_id", pa.int64()), ("part", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = slim(docs, id_col, text_col)
    order = [F.col("doc_id").asc_nulls_first(), F.col("crc").asc_nulls_first()]
    rows = rows.withColumn("crc", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    # parts come in the order of the range partitions, which is that of the ids
    parts = rows.select("doc_id", "text").mapInArrow(run, PART_SCHEMA).collect()
    out, base = [], 0
    for p in parts:
        out.append((p["part"], base, p["n_tokens"]))
        base += p["n_tokens"]
    return out


def read_token_files(spark: SparkSession, path: str, parts: list[tuple[str, int, int]]) -> DataFrame:
    """Per document, from the files: doc_id, start (tokens before it), n_tokens, ids_crc32 of its ids as unsigned
    32-bit little-endian integers. Each task maps its parts; only the pages it reads are in memory."""
    folder = mounted(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                head = np.memmap(f"{folder}/{part}.idx", "<i8", "r")
                n = int(head[0])
                key, null, off = head[1 : n + 1], head[n + 1 : 2 * n + 1], head[2 * n + 1 :]
                ids = np.memmap(f"{folder}/{part}.ids", f"<u{part[0]}", "r")
                for at in range(0, n, 4096):
                    to = min(n, at + 4096)
                    crc = [zlib.crc32(ids[off[k] : off[k + 1]].astype("<u4").tobytes()) for k in range(at, to)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(key[at:to]), mask=np.array(null[at:to], bool)), pa.array(np.array(off[at:to]) + base), pa.array(np.diff(off[at : to + 1])), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    if not parts:
        return spark.createDataFrame([], READ_SCHEMA)
    rows = spark.createDataFrame([(p, b) for p, b, _ in parts], "part string, base long").repartition(len(parts))
    return rows.mapInArrow(run, READ_SCHEMA)


def token_table(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to a new folder below ``spark.checkpoint.dir`` and read them back."""
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    return read_token_files(spark, path, write_token_files(docs, path, tokenizer, end_id, id_col, text_col))
