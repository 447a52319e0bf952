"""Nearest neighbours by multi-index hashing of learned binary codes.

A rotation learned on a bounded sample (principal directions, then alternating sign codes and an orthogonal fit)
turns a vector into a code of bits. A code is split into substrings, each with an index of its own. Two codes
within Hamming radius r agree on some of m substrings within r // m bits, so probing every index within that
radius retrieves every code within r; their vectors are then compared in double precision.
"""

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settle

#: Bounds: rows that the rotation and the radius are learned from, queries sent to all executors at once.
SAMPLE_ROWS = 10_000
QUERIES_AT_ONCE = 10_000
SUBSTRING_BITS = 16
ROUNDS = 25
#: Rows of one local index; a task holds one at a time.
INDEX_ROWS = 20_000


class Rotation:
    """Codes of up to 64 bits. For vectors of fewer dimensions, a bit a dimension."""

    def __init__(self, rows: np.ndarray) -> None:
        self.mean = rows.mean(0)
        centred = rows - self.mean
        bits = min(64, rows.shape[1])
        _, _, directions = np.linalg.svd(centred.T @ centred)
        main = directions[:bits].T
        turn = np.linalg.qr(np.random.default_rng(0).normal(size=(bits, bits)))[0]
        flat = centred @ main
        for _ in range(ROUNDS):
            left, _, right = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (left @ right).T
        self.turn, self.bits = main @ turn, bits
        self.substrings = -(-bits // SUBSTRING_BITS)

    def codes(self, rows: np.ndarray) -> np.ndarray:
        signs = np.zeros((len(rows), 64), bool)
        signs[:, :self.bits] = (rows - self.mean) @ self.turn > 0
        return np.packbits(signs, axis=1, bitorder="little").view("<u8").ravel()

    def parts(self, codes: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64((1 << SUBSTRING_BITS) - 1)
        return [(codes >> np.uint64(SUBSTRING_BITS * i)) & mask for i in range(self.substrings)]

    def radius(self, rows: np.ndarray, k: int, share: float, queries: int = 500) -> int:
        """A radius that holds `share` of the k true neighbours of some rows among these rows. Among more rows the
        neighbours are nearer, so it then holds more."""
        codes = self.codes(rows)
        far = []
        for i in range(min(queries, len(rows))):
            distance = ((rows - rows[i]) ** 2).sum(1)
            distance[i] = np.inf
            near = np.argsort(distance, kind="stable")[:min(k, len(rows) - 1)]
            far.append(np.bitwise_count(codes[near] ^ codes[i]))
        return int(np.quantile(np.concatenate(far), share, method="higher")) if far and len(rows) > 1 else self.bits


@functools.cache
def probes(radius: int) -> np.ndarray:
    """Every choice of at most `radius` bits of a substring, fewest first."""
    masks = np.arange(1 << SUBSTRING_BITS)
    bits = np.bitwise_count(masks)
    return masks[np.argsort(bits, kind="stable")][:int((bits <= radius).sum())]


class Index:
    """Substring indexes over some vectors."""

    def __init__(self, rotation: Rotation, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows, self.rotation = ids[order], rows[order], rotation
        self.codes = rotation.codes(self.rows)
        self.tables = []
        for part in rotation.parts(self.codes):
            # rows sorted by the value of a substring, and where each of its values begins
            begin = np.append(0, np.cumsum(np.bincount(part.astype(np.int64), minlength=1 << SUBSTRING_BITS)))
            self.tables.append((begin, np.argsort(part, kind="stable")))

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Positions of all codes within the radius: of each substring the buckets that flipping up to radius // m of its bits
        names, then the whole code."""
        hit = np.zeros(len(self.codes), bool)
        flips = probes(radius // self.rotation.substrings)
        for part, (begin, by) in zip(self.rotation.parts(np.array([code])), self.tables, strict=True):
            bucket = flips ^ int(part[0])
            first, size = begin[bucket], begin[bucket + 1] - begin[bucket]
            filled = size > 0
            first, size = first[filled], size[filled]
            # the rows of all these buckets, one stretch after the other
            hit[by[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]] = True
        found = np.flatnonzero(hit)
        return found[np.bitwise_count(self.codes[found] ^ code) <= radius]

    def nearest(self, query_id: int, query: np.ndarray, code: np.uint64, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest ids within the radius and their distances; rows with the query's own id take no part, an id
        that repeats counts once, ties go to the smaller id."""
        found = self.within(code, radius)
        found = found[self.ids[found] != query_id]
        distance = np.sqrt(((self.rows[found] - query) ** 2).sum(1))
        order = np.lexsort((self.ids[found], distance))
        ids = self.ids[found][order]
        _, first = np.unique(ids, return_index=True)
        first = np.sort(first)[:k]
        return ids[first], distance[order][first]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """`id` and `v` of vectors that take part: an id, no null or non-finite component, not all zero."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), bad.alias("bad")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.col("bad") & F.exists("v", lambda x: x != 0)).select("id", "v")


def search(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS,
           share: float = 0.99, radius: int | None = None) -> DataFrame:
    """For each row that `is_query` (a function of the id column) holds for, its k nearest other rows: `query_id`,
    `rank` from 1, `vec_id`, `score` (Euclidean distance), nearest first, ties to the smaller id.

    The rotation and the radius are learned from `sample_rows` rows (smallest hash of the id); every row is indexed.
    Queries go out in blocks of bounded size, each matched with local indexes of all rows; each local index returns
    at most k rows a query, and those are ranked. Queries that find fewer than k rows within the radius are
    searched again without one, which is exact. Vectors that are null, empty, zero, or hold null or non-finite
    components take no part, nor do rows whose number of components is not that of the row with the smallest id;
    null ids take no part; rows that repeat an id count once, and a query id that repeats asks with its smallest vector; other columns are ignored. Fewer than k other rows: all of them; no rows: none.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = usable(vectors, id_col, vector_col)
    first = every.agg(F.min_by(F.size("v"), "id").alias("n")).first()["n"]
    if first is None:
        return empty
    every = every.where(F.size("v") == first)
    # bounded: sample_rows vectors
    learned = np.array([r["v"] for r in every.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(sample_rows).collect()])
    rotation = Rotation(learned)
    near = rotation.radius(learned, k, share) if radius is None else radius
    queries = every.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
    blocks = -(-queries.count() // QUERIES_AT_ONCE)
    found = [empty]
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)) == block)
        rows = part.orderBy("id").collect()
        if not rows:
            continue
        asked = (np.array([r["id"] for r in rows], np.int64), np.array([r["v"] for r in rows]))
        got = settle(probe(every, rotation, asked, near, k))  # read twice below
        short = [r["query_id"] for r in got.groupBy("query_id").count().where(F.col("count") >= k).select("query_id").collect()]
        rest = ~np.isin(asked[0], short)  # at most a block of ids
        if rest.any():
            got = got.where(~F.col("query_id").isin(asked[0][rest].tolist())) if rest.sum() <= 1000 else got.join(
                F.broadcast(spark.createDataFrame([(int(i),) for i in asked[0][rest]], "query_id long")), "query_id", "left_anti")
            got = got.unionByName(probe(every, rotation, (asked[0][rest], asked[1][rest]), 64, k))
        found.append(got)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def probe(every: DataFrame, rotation: Rotation, asked: tuple[np.ndarray, np.ndarray], radius: int, k: int) -> DataFrame:
    sent = every.sparkSession.sparkContext.broadcast((rotation, *asked, rotation.codes(asked[1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation, ids, queries, codes = sent.value
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, INDEX_ROWS):
                held.append(batch.slice(at, INDEX_ROWS))
                if sum(b.num_rows for b in held) >= INDEX_ROWS:
                    yield answer(held, rotation, ids, queries, codes)
                    held = []
        if held:
            yield answer(held, rotation, ids, queries, codes)

    def answer(held: list[pa.RecordBatch], rotation: Rotation, ids: np.ndarray, queries: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        own = np.concatenate([b.column("id").to_numpy() for b in held])
        rows = np.concatenate([b.column("v").flatten().to_numpy() for b in held]).reshape(len(own), -1)
        index = Index(rotation, own, rows)
        near = [index.nearest(i, q, c, radius, k) for i, q, c in zip(ids, queries, codes, strict=True)]
        counts = [len(n[0]) for n in near]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), pa.array(np.concatenate([n[0] for n in near])), pa.array(np.concatenate([n[1] for n in near]))],
                                          ["query_id", "vec_id", "score"])

    best = every.mapInArrow(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
