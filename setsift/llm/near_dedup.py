"""Near-duplicate documents by SetSketch registers.

A document is its set of distinct shingles of a few words. Each register of its sketch keeps the least of exponentially
distributed hashes of the shingles, truncated to an integer exponent of base B: sketches of parts merge by maximum, and
two registers agree with a probability near the Jaccard similarity. BANDS groups of ROWS registers are the search keys:
documents of similarity 0.8 share none of them with a probability of (1 - 0.8**5)**36, under one in a million. Pairs
that share one get a joint maximum-likelihood estimate of their similarity; those that are not far below the bound are
verified on the full shingle sets. Sets that are equal are one class from the start, so copies are never compared.

A band key shared by many classes is not expanded into pairs: each class is first compared with the key's most connected
class (an original rather than one of its copies). The links found give components. Where a key's other classes still
belong to several components, those outside its largest one are compared with all of them, in blocks of BLOCK times BLOCK
classes inside a task that returns links only; of keys with the same classes one is taken, and a pair is tested at the
least key it shares only. So every pair that shares a key and could join two components is tested, once, and no pair
without a shared key is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setsift.llm._common import GOLDEN, U64, golden, lower_ascii, mix, slim, utf8, word_hashes, words_of, written

PERCENT = 80
BANDS, ROWS = 36, 5
M = BANDS * ROWS
#: SetSketch parameters: base, rate; registers are unsigned 16-bit.
B, RATE = 1.001, 20.0
#: Estimates this far below the bound (six standard deviations) are not verified.
MARGIN = 6 * math.sqrt(0.8 * 0.2 / M)
SLICE = 1 << 20
#: Classes on each side of a block of comparisons, and sets verified at once against one.
BLOCK, STEP = 256, 32


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct 64-bit hashes of the shingles of ``size`` words, ascending in each document; the documents' offsets in
    them). Fewer words are one shingle."""
    data = lower_ascii(data)
    start, end, doc = words_of(data, off)
    words = word_hashes(data, start, end)
    count = np.diff(doc)
    whose = np.repeat(np.arange(len(count)), count)
    first = np.flatnonzero(whose[size - 1 :] == whose[: max(0, len(whose) - size + 1)]) if len(whose) >= size else np.zeros(0, np.int64)
    h = words[first]
    for k in range(1, size):
        h = mix(h * GOLDEN + words[first + k])
    short = np.flatnonzero((count > 0) & (count < size))
    whole = words[doc[short]]
    for k in range(1, size - 1):
        more = count[short] > k
        whole[more] = mix(whole[more] * GOLDEN + words[doc[short[more]] + k])
    h = np.concatenate([h, mix(whole ^ GOLDEN)])
    whose = np.concatenate([whose[first], short])
    order = np.lexsort((h, whose))
    h, whose = h[order], whose[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (whose[1:] != whose[:-1])
    h, whose = h[new], whose[new]
    return h, np.searchsorted(whose, np.arange(len(count) + 1))


def minima(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Per document and register the least of the elements' exponential hashes (rate 1), exactly.

    Each element is a Poisson process of rate M whose points fall on registers at random; a document's points are made
    in ascending order and only up to a bound below which all its registers are likely to be met. Documents where one
    is not go on with twice the bound.
    """
    n = np.diff(cut)
    out = np.full(len(n) * M, np.inf)
    bound = (math.log(M) + 6) / np.maximum(n, 1)
    todo = np.flatnonzero(n > 0)
    while len(todo):
        size = n[todo]
        at = np.arange(size.sum()) + np.repeat(cut[todo] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        own, whose, x, step = h[at], np.repeat(todo, size), np.zeros(len(at)), 0
        while len(own):
            step += 1
            r = mix(own + golden(step))
            x = x - np.log(((r >> U64(16)).astype(np.float64) + 0.5) * 2.0**-48) / M
            keep = x < bound[whose]
            own, whose, x, r = own[keep], whose[keep], x[keep], r[keep]
            np.minimum.at(out, whose * M + (((r & U64(0xFFFF)) * U64(M)) >> U64(16)).astype(np.int64), x)
        bound[todo] *= 2
        todo = todo[np.isinf(out.reshape(-1, M)[todo]).any(1)]
    return out.reshape(-1, M)


def registers(least: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(1 - np.log(least / RATE) / math.log(B)), 0, 65535).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood Jaccard similarity of pairs of sketches with known set sizes, to 0.01."""
    up, down = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / math.log(B)

    greater, less = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
    fit = up * np.log(greater) + down * np.log(less) + (M - up - down) * np.log(np.maximum(1 - greater - less, 1e-12))
    return j[np.arange(len(j)), fit.argmax(1)]


def _parts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, off = utf8(texts)
    at = 0
    while at < len(off) - 1:
        to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE, "right")) - 1)
        yield at, to, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def _class_of(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """64-bit hash of each set."""
    n = np.diff(cut)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ U64(0xA0761D6478BD642F)), dtype=np.uint64, out=sums[1:])
    return mix((sums[cut[1:]] - sums[cut[:-1]]) + n.astype(np.uint64) * GOLDEN).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, to, data, off in _parts(b.column(2)):
            h, cut = shingle_sets(data, off, words)
            n = np.diff(cut)
            regs = registers(np.where(n[:, None] > 0, minima(h, cut), 1.0))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(at, to - at), b.column(1).slice(at, to - at), pa.array(n.astype(np.int64)), pa.array(_class_of(h, cut), mask=n == 0), pa.array([r.tobytes() for r in regs], pa.binary())],
                names=["doc_id", "doc_key", "n_shingles", "cls", "sketch"],
            )


def _keys(regs: np.ndarray) -> np.ndarray:
    """The BANDS search keys of each sketch."""
    regs = regs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN, regs.shape[:2])
    for k in range(ROWS):
        key = mix(key + regs[:, :, k])
    return key.view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            part = b.slice(at, 4096)
            keys = _keys(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], names=["band", "cls"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            part = b.slice(at, 4096)
            x, y = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint16).reshape(-1, M) for k in (2, 4))
            near = estimate(x, y, part.column(3).to_numpy().astype(float), part.column(5).to_numpy().astype(float)) >= PERCENT / 100 - MARGIN
            yield pa.RecordBatch.from_arrays([part.column(k).filter(pa.array(near)) for k in (0, 1)], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, _, data, off in _parts(b.column(0)):
            h, cut = shingle_sets(data, off, words)
            yield pa.RecordBatch.from_arrays([pa.array(_class_of(h, cut)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(h.view(np.int64)))], names=["cls", "elements"])


def _block_links(t: pa.Table) -> pa.Table:
    """Links between the rows with ``left`` and the others, of different components, whose least shared key is the band.

    A pair whose components are joined by a link of the same block is left out: it would join nothing.
    """
    left = np.array(t.column("left").to_numpy(zero_copy_only=False), bool)
    band, cls, root = t.column("band")[0].as_py(), t.column("cls").to_numpy(), np.array(t.column("root").to_numpy())
    regs = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(-1, M)
    keys = _keys(regs)
    sets = [np.sort(np.array(x.values.to_numpy(), np.int64)) for x in t.column("elements")]
    size = np.array([len(x) for x in sets], np.int64)
    right = np.flatnonzero(~left)
    found = []
    for i in np.flatnonzero(left):
        near = right[root[right] != root[i]]
        near = near[np.minimum(size[near], size[i]) * 100 >= np.maximum(size[near], size[i]) * PERCENT]
        near = near[np.where(keys[near] == keys[i], keys[near], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max) == band]
        if not len(near):
            continue
        like = estimate(np.broadcast_to(regs[i], (len(near), M)), regs[near], np.full(len(near), float(size[i])), size[near].astype(float))
        order = np.argsort(-like, kind="stable")
        near = near[order[like[order] >= PERCENT / 100 - MARGIN]]
        for at in range(0, len(near), STEP):
            some = near[at : at + STEP]
            some = some[root[some] != root[i]]
            if not len(some):
                continue
            elements = np.concatenate([sets[j] for j in some])
            met = sets[i][np.minimum(np.searchsorted(sets[i], elements), size[i] - 1)] == elements
            common = np.add.reduceat(met.astype(np.int64), np.cumsum(size[some]) - size[some])
            for j in some[common * 100 >= (size[i] + size[some] - common) * PERCENT]:
                if root[i] != root[j]:
                    found.append((int(cls[i]), int(cls[j])))
                    root[root == root[j]] = root[i]
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})


def _links_between(labelled: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the components (``root``) of each band of ``labelled`` (band, cls, root): the classes outside
    the band's largest component against all of the band, block by block."""
    per_root = labelled.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"))
    bands = per_root.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    # bands of the same classes would be compared in the same way; the least is the one where their pairs are tested
    bands = bands.filter(F.col("all") > F.col("most")).groupBy("all", "x", "y").agg(F.min(F.struct("band", "main", "most")).alias("b"))
    bands = written(bands.select("b.band", "b.main", "b.most", "all"), "near-open")
    rows = labelled.join(bands, "band").withColumn("stray", F.col("root") != F.col("main"))
    rows = rows.withColumn("lefts", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int")).withColumn("rights", F.ceil(F.col("all") / BLOCK).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    as_right = F.transform(every("lefts"), lambda i: F.struct(i.alias("i"), at("rights").alias("j"), F.lit(False).alias("left")))
    as_left = F.transform(every("rights"), lambda j: F.struct(at("lefts").alias("i"), j.alias("j"), F.lit(True).alias("left")))
    copies = rows.select("band", "cls", "root", F.explode(F.concat(as_right, F.when(F.col("stray"), as_left).otherwise(F.array()))).alias("x"))
    full = copies.select("band", "x.i", "x.j", "x.left", "cls", "root").join(classes.select("cls", "sketch"), "cls").join(sets, "cls")
    return full.groupBy("band", "i", "j").applyInArrow(_block_links, "a long, b long")


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of classes, those with 100 * intersection >= 80 * union."""
    sketch = classes.select("cls", "sketch", "n")
    x = sketch.toDF("a", "sketch_a", "n_a")
    y = sketch.toDF("b", "sketch_b", "n_b")
    likely = pairs.join(x, "a").join(y, "b").select("a", "b", "sketch_a", "n_a", "sketch_b", "n_b").mapInArrow(_likely, "a long, b long")
    both = likely.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.withColumn("common", common).filter(F.col("common") * 100 >= (F.size("set_a") + F.size("set_b") - F.col("common")) * PERCENT).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b) but the roots themselves, root being the component's least node.

    Large-star and small-star steps in turn until all components are stars; each is a minimum by key and a join, and each
    round is written to the shared folder. Nothing is gathered: what the driver sees of a round is one number.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = written(small.select("u", F.col("m").alias("v")).union(small.filter("v <> m").select("v", "m")).distinct(), "links")
        # an edge leads to a lesser node: components are stars when no node has two such edges, or one and is led to
        ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        if not ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up > 0 and down > 0").agg(F.count(F.lit(1))).first()[0]:
            return edges.toDF("node", "root")


def _members(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, doc_key, n_shingles, cls; component: cls, component, component_id) of slim documents."""
    docs = docs.withColumn("doc_key", F.xxhash64("doc_id", "text")).select("doc_id", "doc_key", "text")
    rows = written(docs.mapInArrow(lambda batches: _sketch(batches, words), "doc_id long, doc_key long, n_shingles long, cls long, sketch binary"), "near-sketches")
    known = rows.filter(F.col("cls").isNotNull())
    classes = written(known.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("doc_key").alias("rep_key"), F.first("sketch").alias("sketch")), "near-classes")
    bands = classes.select("cls", "sketch").mapInArrow(_bands, "band long, cls long")
    keys = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(bands.join(keys, "band"), "near-bands")
    # a key's center is its class that shares most keys with others: an original rather than one of its copies
    popular = shared.groupBy("cls").agg(F.sum("n").alias("p"))
    centers = shared.select("band", "cls").join(popular, "cls").groupBy("band").agg(F.max_by("cls", F.struct("p", "cls")).alias("center"))
    others = written(shared.select("band", "cls").join(centers, "band").filter("cls <> center"), "near-others")
    stars = written(others.select(F.col("center").alias("a"), F.col("cls").alias("b")).distinct(), "near-stars")
    involved = shared.select("cls").distinct().join(classes.select("cls", "rep_key"), "cls").select("rep_key")
    sets = docs.join(involved, docs["doc_key"] == involved["rep_key"]).select("text").mapInArrow(lambda batches: _sets(batches, words), "cls long, elements array<long>")
    sets = written(sets.dropDuplicates(["cls"]), "near-sets")
    links = written(_verified(stars, classes, sets), "near-links")
    joined = components(links)
    # the center of a key has met all its classes; the others have not met each other
    labelled = others.select("band", "cls").join(joined.toDF("cls", "root"), "cls", "left").select("band", "cls", F.coalesce("root", "cls").alias("root"))
    more = written(_links_between(written(labelled, "near-labelled"), classes, sets), "near-links")
    if more.head(1):
        joined = components(joined.toDF("a", "b").union(more))
    roots = classes.select("cls", "rep").join(joined.toDF("cls", "root"), "cls", "left").select("cls", "rep", F.coalesce("root", "cls").alias("component"))
    least = roots.groupBy("component").agg(F.min("rep").alias("component_id"))
    return rows.drop("sketch"), written(roots.join(least, "component").select("cls", "component", "component_id"), "near-components")


def near_duplicates(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, doc_key (hash of id and text) of every row, by shingles of ``words`` words.

    Texts with A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``. A text of fewer words is one shingle. Rows without words
    are linked with nothing: their component_id is their doc_id. component_id is the smallest id of the component, null
    ids aside (null where all are); kept is component_id = doc_id (both null: true), so rows that repeat that id are all
    kept here. Other columns are ignored; an empty table gives an empty result.
    """
    rows, found = _members(slim(docs, id_col, text_col), words)
    out = rows.join(found, "cls", "left")
    own = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), "doc_key")


def deduplicated(docs: DataFrame, words: int = 5) -> DataFrame:
    """One row of each component, with all columns of ``docs``, whatever their names: that with the smallest id (of several, the one with the
    smallest hash of id and text). Rows that repeat id and text are one document. Texts without words stay."""
    rows, found = _members(slim(docs), words)
    out = rows.join(found, "cls", "left")
    empty = out.filter(F.col("cls").isNull()).select("doc_key", "doc_id").distinct()
    linked = out.filter(F.col("cls").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min(F.struct("doc_key", "doc_id")).alias("x")).select("x.doc_key", "x.doc_id")
    keep = written(empty.union(linked).toDF("kept_key", "kept_id"), "near-kept")
    i = F.col("doc_id").cast("long")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(i, F.col("text").cast("string")).alias("own_key"), i.alias("own_id"))
    kept = keyed.join(keep, (keyed["own_key"] == keep["kept_key"]) & keyed["own_id"].eqNullSafe(keep["kept_id"]), "left_semi")
    return kept.dropDuplicates(["own_key", "own_id"]).select("row.*")
