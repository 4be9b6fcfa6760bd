"""Repeated byte strings by a distributed merge sort of suffixes that re-uses known common prefixes.

Sorting all suffixes of a corpus would move hundreds of bytes for each of its bytes. Two things make it bearable:

- Only anchors are sorted. An anchor is the place with the least hash of GRAM bytes among the REACH places that a string
  of LENGTH bytes begins with; equal strings have equal anchors, and at least CORE bytes follow the anchor inside them.
- Prefix doubling: a suffix takes part only if the hash of its CORE bytes occurs twice (hashes go to buckets first).

The other steps per chunk of documents: the suffixes (CORE bytes each, equal ones once) are sorted into runs, which are
front-coded (length of the prefix shared with the one before, and the rest) and sent to buckets; a bucket merges its
runs with a loser tree that compares two heads by the prefixes they are known to share with the last output and looks at
bytes only beyond these. Neighbours that share all CORE bytes are one group. If all places of a group also agree in
everything that a string around the anchor can cover, all these strings are repeated ("closed"); else ("open") their
places are decided by an exact check that follows: every string of LENGTH bytes that starts up to REACH before an
anchor of an open group is counted by its 64-bit hash. A chunk sends each group and each hash once, however
many documents share it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from setsift.llm._common import GOLDEN, INVERSE, U64, chunk_count, chunked, mix, powers, prefix_hash, slim, span_hash, utf8
from setsift.llm.substring import once

LENGTH, GRAM, REACH = 400, 32, 200
CORE = LENGTH - REACH + 1
#: Bytes of text in a chunk, and of text whose hashes meet in one bucket.
CHUNK, BUCKET = 2 << 20, 16 << 20
HASHES = "bucket int, chunk int, hashes binary, closed binary, open binary"
RUNS = "bucket int, chunk int, shared binary, tails binary, hashes binary, around binary, flags binary"
NOTES = "chunk int, closed binary, open binary, hits binary"
EMPTY = np.zeros(0, np.uint64)


class Chunk:
    """The texts of a chunk, their anchors, and the hashes of the bytes that follow these."""

    def __init__(self, t: pa.Table) -> None:
        self.data, self.off = utf8(t.column("text"))
        size = np.diff(self.off)
        n = len(self.data)
        self.begin, self.end = np.repeat(self.off[:-1], size), np.repeat(self.off[1:], size)
        self.prefix = prefix_hash(self.data.astype(np.uint64) + U64(1))
        self.at = self._anchors(n) if n >= LENGTH else np.zeros(0, np.int64)
        self.core = mix(span_hash(self.prefix, self.at, self.at + CORE))

    def _anchors(self, n: int) -> np.ndarray:
        grams = n - GRAM + 1
        v = mix((self.prefix[GRAM:] - self.prefix[:-GRAM]) * powers(INVERSE, n + 1)[:grams])
        v = (v & U64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)  # ties: the first place
        block = np.full(-(-grams // REACH) * REACH, np.iinfo(np.uint64).max)
        block[:grams] = v
        block = block.reshape(-1, REACH)
        up = np.minimum.accumulate(block, 1).reshape(-1)
        down = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].reshape(-1)
        starts = np.flatnonzero(np.arange(n) + LENGTH <= self.end)
        return np.unique(np.minimum(down[starts], up[starts + REACH - 1]) & U64(0xFFFFFFFF)).astype(np.int64)

    def around(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Borders of all that strings around the anchors can cover."""
        return np.maximum(self.begin[at], at - REACH + 1), np.minimum(self.end[at], at + LENGTH)

    def around_hash(self, at: np.ndarray) -> np.ndarray:
        a, b = self.around(at)
        return mix(span_hash(self.prefix, a, b)) ^ mix(((at - a) * 1024 + (b - at)).astype(np.uint64) + GOLDEN)

    def strings(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts of the strings around the anchors, their hashes)."""
        mark = np.zeros(len(self.data) + 1, np.int32)
        a, b = self.around(at)
        np.add.at(mark, a, 1)
        np.add.at(mark, np.minimum(at, b - LENGTH) + 1, -1)
        starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        return starts, mix(span_hash(self.prefix, starts, starts + LENGTH))


def _has(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are among the ascending ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _all(column) -> np.ndarray:
    """All 64-bit numbers of a column of binaries, ascending."""
    return np.unique(np.concatenate([EMPTY, *(np.frombuffer(x.as_py(), np.uint64) for x in column if x.as_py())]))


def _dealt(chunk: int, values: np.ndarray, buckets: int) -> list[dict]:
    bucket = (values % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [{"bucket": int(b), "chunk": chunk, "rows": order[cut[b] : cut[b + 1]]} for b in np.flatnonzero(np.diff(cut))]


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def _hash_rows(chunk: int, hashes: np.ndarray, buckets: int) -> list[dict]:
    hashes = np.unique(hashes)
    return [{"bucket": r["bucket"], "chunk": chunk, "hashes": hashes[r["rows"]].tobytes()} for r in _dealt(chunk, hashes, buckets)]


def core_hashes(buckets: int):
    def run(t: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(_hash_rows(t.column("chunk")[0].as_py(), Chunk(t).core, buckets), _arrow(HASHES))

    return run


def met_twice(t: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk, its hashes that another chunk has as well; what is passed through goes on."""
    raw = [x.as_py() or b"" for x in t.column("hashes")]
    hashes = np.concatenate([np.frombuffer(x, np.uint64) for x in raw])
    chunk = np.repeat(np.array(t.column("chunk").to_numpy()), [len(x) // 8 for x in raw])
    values, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(count[inverse] > 1)
    hit = hit[np.argsort(chunk[hit], kind="stable")]
    names, cut = np.unique(chunk[hit], return_index=True)
    rows = [{"chunk": int(c), "hits": x.tobytes()} for c, x in zip(names, np.split(hashes[hit], cut[1:]), strict=False)]
    for c, closed, open_ in zip(*(t.column(k).to_pylist() for k in ("chunk", "closed", "open")), strict=True):
        if closed is not None:
            rows.append({"chunk": c, "closed": closed, "open": open_})
    return pa.Table.from_pylist(rows, _arrow(NOTES))


def sorted_runs(buckets: int):
    """Per chunk: a front-coded sorted run for each bucket, of the suffixes that may be repeated."""

    def run(t: pa.Table, hits: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.Table.from_pylist([], _arrow(RUNS))
        c = Chunk(t)
        _, inverse, count = np.unique(c.core, return_inverse=True, return_counts=True)
        at = c.at[_has(_all(hits.column("hits")), c.core) | (count[inverse] > 1)]
        core = mix(span_hash(c.prefix, at, at + CORE))
        first, origin = once(core)
        around = c.around_hash(at)
        many = np.zeros(len(at), bool)
        many[origin[np.flatnonzero(origin != np.arange(len(at)))]] = True
        mixed = np.zeros(len(at), bool)
        mixed[origin[around != around[origin]]] = True
        rows = []
        for r in _dealt(t.column("chunk")[0].as_py(), core[first], buckets):
            own = first[r.pop("rows")]
            text = c.data[at[own][:, None] + np.arange(CORE)]
            order = np.array(sorted(range(len(own)), key=[x.tobytes() for x in text].__getitem__))
            text, own = text[order], own[order]
            shared = np.zeros(len(own), np.int64)
            differ = text[1:] != text[:-1]
            shared[1:] = np.where(differ.any(1), differ.argmax(1), CORE)
            tails = text[np.arange(CORE) >= shared[:, None]]
            flags = many[own].astype(np.uint8) | (mixed[own].astype(np.uint8) << 1)
            rows.append(r | {"shared": shared.astype(np.uint8).tobytes(), "tails": tails.tobytes(), "hashes": core[own].tobytes(), "around": around[own].tobytes(), "flags": flags.tobytes()})
        return pa.Table.from_pylist(rows, _arrow(RUNS))

    return run


def decoded(shared: bytes, tails: bytes) -> list[bytes]:
    """The strings of a front-coded run."""
    out, last, at = [], b"", 0
    for s in shared:
        to = at + CORE - s
        last = last[:s] + tails[at:to]
        out.append(last)
        at = to
    return out


def merged(runs: list[tuple[list[bytes], bytes]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in the run, bytes shared with the output before) of all strings in ascending order.

    ``known[r]`` is what the head of run r shares with the string that last beat it, -1 for a run that is used up. Of
    two heads beaten by the same string the one that shares more with it is the lesser; only heads that share equally
    much are compared, and from that byte on.
    """
    size = 1 << max(1, (len(runs) - 1).bit_length())
    head = [r[0][0] if r[0] else None for r in runs] + [None] * (size - len(runs))
    known = [-1 if x is None else 0 for x in head]
    place = [0] * size

    def beats(a: int, b: int) -> bool:
        """Whether a's head goes before b's; notes what the loser shares with the winner."""
        ka, kb = known[a], known[b]
        if ka != kb:
            return ka > kb
        if ka < 0:
            return True
        x, y, k = head[a], head[b], ka
        if x[k:] == y[k:]:
            known[b] = CORE
            return True
        while x[k] == y[k]:
            k += 1
        if x[k] < y[k]:
            known[b] = k
            return True
        known[a] = k
        return False

    loser = [0] * size
    level = list(range(size))
    nodes = size
    while len(level) > 1:
        nodes //= 2
        nxt = []
        for i in range(0, len(level), 2):
            a, b = level[i], level[i + 1]
            if not beats(a, b):
                a, b = b, a
            loser[nodes + i // 2] = b
            nxt.append(a)
        level = nxt
    top = level[0]
    while known[top] >= 0:
        yield top, place[top], known[top]
        place[top] += 1
        strings, shared = runs[top]
        if place[top] < len(strings):
            head[top], known[top] = strings[place[top]], shared[place[top]]
        else:
            known[top] = -1
        node = (top + size) // 2
        while node:
            if not beats(top, loser[node]):
                top, loser[node] = loser[node], top
            node //= 2


def groups(t: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk, the hashes of its suffixes in closed and in open groups."""
    rows = t.to_pylist()
    runs = [(decoded(r["shared"], r["tails"]), r["shared"]) for r in rows]
    hashes, around = ([np.frombuffer(r[k], np.uint64) for r in rows] for k in ("hashes", "around"))
    closed: list[list[int]] = [[] for _ in rows]
    open_: list[list[int]] = [[] for _ in rows]

    def settle(group: list[tuple[int, int]]) -> None:
        if len(group) == 1 and not rows[group[0][0]]["flags"][group[0][1]]:
            return
        same = len({int(around[r][k]) for r, k in group}) == 1 and not any(rows[r]["flags"][k] & 2 for r, k in group)
        for r, k in group:
            (closed if same else open_)[r].append(k)

    group: list[tuple[int, int]] = []
    for r, k, shared in merged(runs):
        if group and shared < CORE:
            settle(group)
            group = []
        group.append((r, k))
    if group:
        settle(group)
    out = [{"chunk": r["chunk"], "closed": h[c].tobytes(), "open": h[o].tobytes()} for r, h, c, o in zip(rows, hashes, closed, open_, strict=True) if c or o]
    return pa.Table.from_pylist(out, _arrow(NOTES))


def open_strings(buckets: int):
    """Per chunk: the hashes of the strings around open anchors; the notes themselves pass through one bucket."""

    def run(t: pa.Table, notes: pa.Table) -> pa.Table:
        if not t.num_rows or not notes.num_rows:
            return pa.Table.from_pylist([], _arrow(HASHES))
        c, chunk = Chunk(t), t.column("chunk")[0].as_py()
        closed, open_ = _all(notes.column("closed")), _all(notes.column("open"))
        rows = _hash_rows(chunk, c.strings(c.at[_has(open_, c.core)])[1], buckets)
        return pa.Table.from_pylist([*rows, {"bucket": chunk % buckets, "chunk": chunk, "closed": closed.tobytes(), "open": open_.tobytes()}], _arrow(HASHES))

    return run


def removal(texts: bool):
    schema = _arrow("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

    def run(t: pa.Table, notes: pa.Table) -> pa.Table:
        if not t.num_rows:
            return schema.empty_table()
        c = Chunk(t)
        n = len(c.data)
        cover = np.zeros(n + 1, np.int32)
        if notes.num_rows:
            a, b = c.around(c.at[_has(_all(notes.column("closed")), c.core)])
            np.add.at(cover, a, 1)
            np.add.at(cover, b, -1)
            starts, hashes = c.strings(c.at[_has(_all(notes.column("open")), c.core)])
            _, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
            starts = starts[_has(_all(notes.column("hits")), hashes) | (count[inverse] > 1)]
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + LENGTH, -1)
        gone = np.cumsum(cover[:-1]) > 0
        fresh = gone.copy()  # first byte of each removed run
        fresh[1:] &= ~gone[:-1] | (c.begin[1:] != c.begin[:-1])
        removed, spans = (np.concatenate([[0], np.cumsum(x)])[c.off] for x in (gone, fresh))
        kept = [c.data[a:b][~gone[a:b]].tobytes() for a, b in zip(c.off, c.off[1:], strict=False)]
        return pa.table([t.column("doc_id").combine_chunks(), pa.array(np.diff(c.off)), pa.array(np.diff(removed)), pa.array(np.diff(spans)), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(kept if texts else [None] * len(kept), pa.binary())], schema=schema)

    return run


def repeated_strings_removed(docs: DataFrame, texts: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (the
    bytes that stay; null unless ``texts``).

    A byte goes when a string of 400 bytes that covers it also starts anywhere else, in the same text or another one;
    all places of a repeated string go, the first as well. Matches never cross documents; shorter, empty and null texts
    keep all. Rows that repeat an id are texts of their own. Other columns are ignored; an empty table gives an empty
    result. A chunk is dealt by a hash of id and text, and the texts are shuffled once: the four passes read the same
    exchange.
    """
    docs = slim(docs, id_col, text_col)
    chunks, size = chunk_count(docs, CHUNK)
    buckets = max(math.ceil(size / BUCKET), 2 * docs.sparkSession.sparkContext.defaultParallelism)
    dealt = chunked(docs, chunks)
    by_chunk = dealt.groupBy("chunk")
    hits = by_chunk.applyInArrow(core_hashes(buckets), HASHES).groupBy("bucket").applyInArrow(met_twice, NOTES)
    runs = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(sorted_runs(buckets), RUNS)
    notes = runs.groupBy("bucket").applyInArrow(groups, NOTES)
    strings = by_chunk.cogroup(notes.groupBy("chunk")).applyInArrow(open_strings(buckets), HASHES)
    hits = strings.groupBy("bucket").applyInArrow(met_twice, NOTES)
    return by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(removal(texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
