"""Near duplicates by fast similarity sketches, banding and exact verification.

A sketch has a fixed number of coordinates. In each of the first rounds every shingle of a set is hashed to one
coordinate, and a coordinate keeps the least hash of the first round that reaches it; later rounds give each
coordinate left over to all shingles, so every one fills. Equal coordinates of two sketches then estimate the
similarity with the concentration of independent samples. Bands of coordinates propose candidates: sets that share a band's key are in one cell, and so on over
further keys. The full sets of a cell are compared, and only those similar enough are linked.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import connected_components
from .lineage import settle
from .words import NOT_SPACE, Words, join, mix, slices, windows

SHINGLE = 4
PERCENT = 80
#: 60 bands of 8 miss a pair of similarity 0.8 with a probability of 2e-5, before links through other documents.
BANDS, ROWS = 60, 8
#: Sets and shingles of one block of a cell; blocks are compared two by two.
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 20
#: Shingles compared at a time in a task.
COLUMNS = 4096


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, flat, and where each document's begin. A document of fewer words has
    one shingle, the whole sequence; one without words has none."""
    read = Words(texts, NOT_SPACE, lower=True)
    hashes, counts = read.hashes(), read.counts()
    whole = windows(hashes, size)
    starts = np.flatnonzero(read.left()[:len(whole)] >= size)
    found, doc = [whole[starts]], [read.doc()[starts]]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        found.append(mix(windows(hashes, n)[read.first[short]] + np.uint64(n)) if len(short) else hashes[:0])
        doc.append(short)
    flat, doc = np.concatenate(found), np.concatenate(doc)
    order = np.lexsort((flat, doc))
    flat, doc = flat[order], doc[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
    flat, doc = flat[new], doc[new]
    return flat, np.searchsorted(doc, np.arange(len(texts) + 1))


def sketch(flat: np.ndarray, first: np.ndarray, coordinates: int) -> np.ndarray:
    """Sketches of sets given flat; a row of an empty set is not filled."""
    docs = len(first) - 1
    doc = np.repeat(np.arange(docs), np.diff(first))
    none = np.uint64(2**64 - 1)
    out = np.full(docs * coordinates, none, np.uint64)
    t = np.uint64(coordinates)
    for turn in range(2 * coordinates):
        if not len(flat):
            break
        value = mix(flat + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64))
        value[value == none] = 0
        cell = doc * coordinates + ((value % t).astype(np.int64) if turn < coordinates else turn - coordinates)
        open_ = out[cell] == none
        best = np.full(0, none) if not open_.any() else value[open_]
        if len(best):
            np.minimum.at(out, cell[open_], best)
            full = ~(out.reshape(docs, coordinates) == none).any(1)
            if full[doc[0]] or turn % 4 == 3 or turn < 2:
                left = ~full[doc]
                flat, doc = flat[left], doc[left]
    return out.reshape(docs, coordinates)


def band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    """A key per document and band."""
    keys = []
    for band in range(sketches.shape[1] // rows):
        key = np.full(len(sketches), np.uint64(band))
        for k in range(rows):
            key = join(key, sketches[:, band * rows + k])
        keys.append(key)
    return np.stack(keys, 1)


def sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, node (hash of the set; null if it is empty), keys (one per band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                flat, first = shingle_sets(part.column("text"), size)
                n = np.diff(first)
                keys = band_keys(sketch(flat, first, bands * rows), rows).view(np.int64)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(n, pa.int64()), nodes(flat, first), keys],
                                                 ["doc_id", "text_hash", "n_shingles", "node", "keys"])

    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, node long, keys array<long>")


def nodes(flat: np.ndarray, first: np.ndarray) -> pa.Array:
    """A 64-bit hash of each whole set; null for empty sets."""
    n = np.diff(first)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(flat), dtype=np.uint64)])
    hashed = mix((total[first[1:]] - total[first[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64))
    return pa.array(hashed.view(np.int64), mask=n == 0)


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                flat, first = shingle_sets(part.column("text"), size)
                yield pa.RecordBatch.from_arrays([nodes(flat, first), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat.view(np.int64)))], ["node", "shingles"])

    return docs.select("text").mapInArrow(run, "node long, shingles array<long>").where(F.col("node").isNotNull())


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links among some sets, as a forest: pairs (i, j) that connect all sets which links connect. left, right: which
    sets are compared with which."""
    sizes = np.array([len(x) for x in sets])
    values, inverse, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(often > 1) - 1
    owner, shared = np.repeat(np.arange(len(sets)), sizes), often[inverse] > 1
    owner, place = owner[shared], column[inverse[shared]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        part = slice(np.searchsorted(place, at), np.searchsorted(place, at + COLUMNS))
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[part], place[part] - at] = 1
        both += has[left] @ has[right].T
    both = np.rint(both).astype(np.int64)
    linked = 100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both)
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    forest = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = find(int(left[i])), find(int(right[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            forest.append((int(left[i]), int(right[j])))
    return forest


def compare(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within cells. sets: cell, node, shingles. A cell is dealt into blocks of bounded size, and each pair of
    blocks is one group of rows, so no task holds more than two blocks."""
    sizes = sets.groupBy("cell").agg(F.count("*").alias("sets"), F.sum(F.size("shingles")).alias("total"))
    blocks = sizes.select("cell", F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = sets.join(blocks, "cell").withColumn("own", F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks")).cast("int"))
    paired = (dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "shingles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            shingles = batch.column("shingles")
            flat, edges = shingles.values.to_numpy(), shingles.offsets.to_numpy()
            for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cell", "i", "j", "own", "node")), strict=True)):
                if row[:3] != key:
                    yield from links(key, held)
                    key, held = row[:3], []
                held.append((row[4], row[3], flat[edges[k]:edges[k + 1]]))
        yield from links(key, held)

    def links(key: tuple | None, held: list) -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        own = np.array([h[1] for h in held])
        left, right = np.flatnonzero(own == key[1]), np.flatnonzero(own == key[2])
        if not len(left) or not len(right):
            return
        found = similar([h[2] for h in held], left, right, percent)
        found = [(held[i][0], held[j][0]) for i, j in found if i != j]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return paired.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "node").mapInArrow(run, "a long, b long")


def link(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included),
    kept (doc_id is that), text_hash. docs: doc_id (an integer) and text, over other columns that are ignored.

    Two documents are linked if their sets of distinct word shingles (A-Z lower-cased) have a similarity of at least
    `percent`. Equal sets are one node. A bucket of nodes with one band's key gives a star of edges, not all its
    pairs; nodes that these connect are a cell. All sets of a cell are compared, block by block, and a task returns
    only as many links as connect what its blocks hold.

    Null and empty texts have no shingles and are linked with nothing. Rows that repeat an id come out each, in the
    component of their text; with a null id, component_id is that of the other rows of the component, or null.
    No rows in, no rows out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = settle(sketches(docs, size, bands, rows))
    classes = settle(own.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("rep")))
    keyed = own.join(classes.where(F.col("rep").isNotNull()).select(F.col("rep").alias("doc_id"), "node"), ["doc_id", "node"])
    members = keyed.select("node", F.explode("keys").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("b"), F.max("node").alias("last")).where(F.col("b") < F.col("last"))
    stars = members.join(shared, "bucket").where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b").distinct()
    cells = settle(connected_components(settle(stars), "a", "b").select(F.col("id").alias("node"), F.col("component").alias("cell")))
    candidates = classes.join(cells, "node").select(F.col("rep").alias("doc_id")).distinct()
    # a node's text may come from several rows of its first id
    texts = docs.join(candidates, "doc_id", "left_semi")
    sets = settle(full_sets(texts, size).join(cells, "node").dropDuplicates(["node"]))
    found = settle(compare(sets, percent))
    joined = connected_components(found, "a", "b").select(F.col("id").alias("node"), "component")
    named = classes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = settle(named.join(least, "component").select("node", "component_id"))
    return (own.drop("keys").join(named, "node", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash")
            .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, with their columns, that link keeps: one document of each component. Of rows with the same id and
    text one stays; rows without words or with a null id all stay."""
    names = docs.columns
    kept = link(docs, **options).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.lit(True).alias("__kept")).distinct()
    keyed = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    known = keyed.where(F.col("__id").isNotNull()).join(kept, ["__id", "__hash"]).dropDuplicates(["__id", "__hash"])
    return known.select(*names).unionByName(docs.where(F.col("doc_id").isNull()))
