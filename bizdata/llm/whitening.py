"""Whitening of embeddings on the principal components of their distinct rounded vectors.

Vectors are rounded to whole numbers, each distinct one is kept once, and count, sums and covariance of those are summed
over tasks. The covariance is as wide as a vector, not as the table: its eigenvectors come from spectral divide and
conquer on the driver (see spectral.py), and a mean and a few directions go out to every task.
"""

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settle
from .spectral import eigen

STEPS, ZERO = 64, 1_000_000
#: Entries of |STEPS * c| from here on have no whole number to be rounded to.
LIMIT = 2.0**62
#: Numbers of a matrix that a task works on at once.
CELLS = 1 << 21
WIDTHS = (np.int8, np.int16, np.int32, np.int64)
EMPTY = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def rounded(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and `floor(64 c)` of the vectors that take part, one matrix for each number of components."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        for at in range(0, len(rows), max(1, CELLS // size)):
            some = rows[at:at + max(1, CELLS // size)]
            flat = vectors.take(pa.array(some)).flatten().cast(pa.float64())
            c = flat.to_numpy(zero_copy_only=False).reshape(len(some), size)  # a null entry reads as NaN
            with np.errstate(invalid="ignore", over="ignore"):
                steps = np.floor(c * STEPS)
                good = (np.abs(steps) < LIMIT).all(1)
            yield some[good], steps[good].astype(np.int64)


def packed(steps: np.ndarray) -> list[bytes]:
    """Each row in the narrowest whole numbers that hold it, after a byte that names their width."""
    out = [b""] * len(steps)
    span = np.maximum(steps.max(1), -1 - steps.min(1))
    code = np.searchsorted([2**7, 2**15, 2**31], span, side="right")
    for k, width in enumerate(WIDTHS):
        rows = np.flatnonzero(code == k)
        size = steps.shape[1] * np.dtype(width).itemsize
        data = steps[rows].astype(width).tobytes()
        for i, row in enumerate(rows.tolist()):
            out[row] = bytes([k]) + data[i * size:(i + 1) * size]
    return out


def unpacked(batch: pa.RecordBatch, dim: int) -> Iterator[np.ndarray]:
    """The rows of a batch of packed vectors as matrices of whole numbers."""
    raw = batch.column("packed")
    sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False)
    for k, width in enumerate(WIDTHS):
        size = dim * np.dtype(width).itemsize + 1
        rows = np.flatnonzero(sizes == size)
        for at in range(0, len(rows), max(1, CELLS // dim)):
            some = raw.take(pa.array(rows[at:at + max(1, CELLS // dim)]))
            start, stop = some.buffers()[1], len(some) * size
            offset = int(np.frombuffer(start, np.int32)[some.offset])
            data = np.frombuffer(some.buffers()[2], np.uint8, stop, offset).reshape(len(some), size)
            yield np.ascontiguousarray(data[:, 1:]).view(width).astype(np.int64)


def distinct_vectors(vectors: DataFrame, vector_col: str) -> DataFrame:
    """`dim` and `packed` of each distinct rounded vector. Equal ones are dropped before the shuffle, so many copies of
    one vector are one row a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, steps in rounded(batch.column("v")):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(steps), steps.shape[1], np.int32)), pa.array(packed(steps), pa.binary())],
                                                 ["dim", "packed"])

    return vectors.select(F.col(vector_col).alias("v")).mapInArrow(run, "dim int, packed binary").distinct()


def summed(fit: DataFrame, dim: int, make, finish) -> DataFrame:
    """One pass over the distinct vectors: `make` folds a matrix of whole numbers into a state, `finish` gives the rows of
    a task as a record batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for steps in unpacked(batch, dim):
                state = make(state, steps)
        if state is not None:
            yield finish(state)

    return fit.select("packed").mapInArrow(run, finish(None))


def sums(fit: DataFrame, dim: int) -> list[int]:
    """The exact sum of every component; the two halves of each number are added apart, so neither overflows."""
    def make(state, steps: np.ndarray):
        high, low = (steps >> 32).sum(0), (steps & 0xFFFFFFFF).sum(0)
        return (high, low) if state is None else (state[0] + high, state[1] + low)

    def finish(state):
        if state is None:
            return "j int, high long, low long"
        return pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(state[0]), pa.array(state[1])], ["j", "high", "low"])

    wide = "decimal(38,0)"
    rows = summed(fit, dim, make, finish).groupBy("j").agg(
        F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low")).orderBy("j").collect()  # `dim` rows
    return [int(r["high"]) * 2**32 + int(r["low"]) for r in rows]


def centred(steps: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n x - S, exact: in 64 bits where that holds every value, else in Python numbers."""
    most = int(max(steps.max(), -steps.min())) if steps.size else 0
    if n * most + max(map(abs, total)) < 2**62:
        return steps * n - np.array(total, np.int64)
    return steps.astype(object) * n - np.array(total, object)


def moments(fit: DataFrame, n: int, total: list[int], turn: np.ndarray | None = None) -> np.ndarray:
    """The covariance (divisor n) of the distinct vectors, or of what `turn` makes of them, centred before multiplying.

    Vectors are centred with their exact mean. What `turn` makes of them has a mean of rounding size; each task centres on
    its own mean and gives it too. The products of a task are summed by entry, so nothing is gathered but the matrix.
    """
    dim = len(total)
    k = dim if turn is None else turn.shape[1]

    def make(state, steps: np.ndarray):
        x = (centred(steps, n, total) / n).astype(np.float64)
        if turn is not None:
            x = x @ turn
        m, mean = len(x), x.mean(0) if turn is not None else np.zeros(k)
        product = (x - mean).T @ (x - mean)
        if state is None:
            return m, mean, product
        all_, old = m + state[0], state[1]
        gap = mean - old
        return all_, old + gap * (m / all_), state[2] + product + np.outer(gap, gap) * (m * state[0] / all_)

    def finish(state):
        if state is None:
            return "i int, j int, product double, part double, rows long"
        m, mean, product = state
        i, j = np.triu_indices(k)
        first = i == 0
        return pa.RecordBatch.from_arrays([
            pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array((product + m * np.outer(mean, mean))[i, j]),
            pa.array(np.where(first, m * mean[j], 0.0)), pa.array(np.full(len(i), m))], ["i", "j", "product", "part", "rows"])

    entries = summed(fit, dim, make, finish).groupBy("i", "j").agg(F.sum("product").alias("product"), F.sum("part").alias("part")).toArrow()
    i, j = entries.column("i").to_numpy(), entries.column("j").to_numpy()
    out, mean = np.zeros((k, k)), np.zeros(k)
    out[i, j] = out[j, i] = entries.column("product").to_numpy() / n
    mean[j[i == 0]] = entries.column("part").to_numpy()[i == 0] / n
    return out - np.outer(mean, mean)


def squares(d: np.ndarray) -> pa.Array:
    """The exact sum of squares of each row."""
    wide = pa.decimal128(38, 0)
    if d.dtype != object:
        most = float(np.abs(d).max()) if d.size else 0.0
        if most * most * d.shape[1] < 2**62:
            return pa.array((d * d).sum(1)).cast(wide)
        if most < 2**50 and d.shape[1] <= 4096:
            high, low = d >> 25, d & (2**25 - 1)
            parts = [(p.sum(1)).tolist() for p in (high * high, high * low, low * low)]
            return pa.array([fitting(a * 2**50 + b * 2**26 + c) for a, b, c in zip(*parts, strict=True)], wide)
        d = d.astype(object)
    return pa.array([fitting(int(s)) for s in (d * d).sum(1)], wide)


def fitting(value: int) -> Decimal | None:
    return Decimal(value) if value < 10**38 else None


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and principal component up to `components`: the id, `component` from 1 by falling
    eigenvalue, `n` (distinct rounded vectors), `deviation` (the exact sum of (n x - S)^2 over the entries x of the
    rounded vector, S their sums over the n; null from 10^38 on), `whitened` (x - S/n on the component over the root of its eigenvalue),
    `explained` (share of the trace), `identity_error` (largest entry of the covariance of `whitened` over the n less the
    identity, one value).

    x = floor(64 c) + 1000000 for an entry c. Vectors that are null or empty, or hold null or non-finite entries, or ones too
    large for a whole number of 64 bits, give no rows, nor do those whose number of entries is not that of most distinct
    vectors (ties: the larger). Repeated rows and null ids come out each. A component without variance (its eigenvalue is
    rounding of the largest: equal vectors, fewer vectors than entries) has `whitened` null; it is left out of `identity_error`.
    Other columns are ignored. No usable vector: no rows.

    The distinct vectors are shuffled once, packed to a byte an entry where that holds them, written and passed over three
    times. To tasks go the mean and `components` directions, to the driver the covariance: sizes of a vector, whatever the rows.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    fit = settle(distinct_vectors(vectors, vector_col))
    best = fit.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if best is None:
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, {EMPTY}")
    dim, n = best["dim"], best["count"]
    fit = fit.where(F.col("dim") == dim)
    total = sums(fit, dim)
    covariance = moments(fit, n, total)
    values, axes = eigen(covariance)
    k = min(components, dim)
    trace = float(np.trace(covariance))
    explained = values[:k] / trace if trace > 0 else np.zeros(k)
    real = values[:k] > dim * np.finfo(float).eps * max(values[0], np.finfo(float).tiny)
    turn = axes[:, :k] / np.sqrt(np.where(real, values[:k], 1.0))
    seen = turn[:, real]
    error = float(np.abs(moments(fit, n, total, seen) - np.eye(seen.shape[1])).max()) if real.any() else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, steps in rounded(batch.column("v")):
                if steps.shape[1] != dim:
                    continue
                d = centred(steps, n, total)
                w = (d / n).astype(np.float64) @ turn
                flat = np.repeat(np.arange(len(rows)), k)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(flat), n, np.int64)), squares(d).take(pa.array(flat)),
                    pa.array(w.ravel(), mask=np.tile(~real, len(rows))), pa.array(np.tile(explained, len(rows))),
                    pa.array(np.full(len(flat), error))], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    chosen = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    return chosen.mapInArrow(run, f"id {kind}, {EMPTY}").withColumnRenamed("id", id_col)
