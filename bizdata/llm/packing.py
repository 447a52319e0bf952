"""Packing of token sequences into windows of equal size by multiway differencing (Karmarkar and Karp)."""

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tokens import Encoder
from .words import slices

#: Bytes of text encoded at once, or one text if that is longer.
AT_ONCE = 16 << 20
WINDOWS_PER_GROUP = 128
IDS = 1 << 32


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Items dealt to `windows` windows of nearly equal sums.

    Each item begins as a partial partition of its own. The two partitions with the largest spread are merged
    again and again, the fullest window of one with the emptiest of the other, until one partition is left.
    Only windows that hold something are kept, so early merges are cheap. Ties go to the earlier item.
    """
    heap = [(-size, i, [(size, (i, None))]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, left = heapq.heappop(heap)  # windows fullest first
        _, _, right = heapq.heappop(heap)
        room = windows - len(left)
        free = right[:max(0, room)]  # its fullest windows meet empty ones
        rest = right[len(free):]
        merged = left[:len(left) - len(rest)] + free
        merged += [(a + b, (x, y)) for (a, x), (b, y) in zip(left[len(left) - len(rest):], reversed(rest), strict=True)] if rest else []
        merged.sort(key=lambda w: -w[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, made, merged))
        made += 1
    out: list[list[int]] = []
    for _, tree in heap[0][2] if heap else []:
        items, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += [y for y in x if y is not None]
            else:
                items.append(x)
        out.append(sorted(items))
    return out


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Fewest windows that differencing fills without passing `capacity`: the count starts at total / capacity and
    rises by one while a window is too full. Sizes are between 1 and `capacity`."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = difference(sizes, windows)
        if all(sum(sizes[i] for i in w) <= capacity for w in dealt):
            return dealt
        windows += 1


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each document's ids, `capacity` long but for the last, with the CRC of their ids: `start`, `length`,
    `ids_crc32`, `doc_tokens`. Every document has its end id, so an empty or null text is one piece of one id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(path), np.array([end_id], "<u4").tobytes()
        for batch in (part for whole in batches for part in slices(whole, limit=AT_ONCE)):
            at, starts, lengths, sums, totals = [], [], [], [], []
            for i, ids in enumerate(encoder.texts(batch.column("text"))):
                raw = b"".join([*ids, end])
                n = len(raw) >> 2
                for start in range(0, n, capacity):
                    part = raw[4 * start:4 * (start + capacity)]
                    at.append(i)
                    starts.append(start)
                    lengths.append(len(part) >> 2)
                    sums.append(zlib.crc32(part))
                    totals.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))],
                ["id", "start", "length", "ids_crc32", "doc_tokens"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long").withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
                   windows_per_group: int = WINDOWS_PER_GROUP) -> DataFrame:
    """Documents packed into sequences of at most `capacity` tokens; one row per piece of a document.

    A document is its ids and then `end_id`. It is cut into full pieces, each a sequence of its own, and a last
    piece. Last pieces are dealt at random (a hash of id, start and row number, written before it is read, so a retried task agrees and equal rows part) into groups of about
    `windows_per_group` windows, and each group is packed by differencing: near-equal windows, one more of them
    whenever one would pass the capacity, so about one part in `windows_per_group` is padding. A group holds a
    bounded number of last pieces however skewed ids and texts are.

    Columns: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset (gapless from 0 in a sequence), padded
    (tokens of the sequence as stored: a power of two as it is, any other length filled to `capacity`).
    Null and empty texts are one end id; null ids and repeated rows are kept as documents of their own; no rows in,
    no rows out; other columns are ignored, whatever their names.
    """
    cut = pieces(docs, path, capacity, end_id, id_col, text_col).withColumnRenamed(id_col, "doc")
    kept = cut_lineage(cut.withColumn("salt", F.xxhash64("doc", "start", "ids_crc32", F.monotonically_increasing_id())))
    total = kept.where(F.col("length") < capacity).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("t")).first()["t"]
    groups = max(1, round(total / (capacity * windows_per_group)))
    group = F.pmod(F.col("salt"), F.lit(groups)).cast("int")

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["salt", "start", "doc"], kind="stable").reset_index(drop=True)
        sizes = rows["length"].tolist()
        window, offset, padded = [0] * len(rows), [0] * len(rows), [0] * len(rows)
        for k, items in enumerate(pack(sizes, capacity)):
            used = sum(sizes[i] for i in items)
            at = 0
            for i in items:
                window[i], offset[i], padded[i] = int(key[0]) * IDS + k, at, used if used & (used - 1) == 0 else capacity
                at += sizes[i]
        return rows.drop(columns=["salt", "grp"]).assign(sequence_id=window, offset=offset, padded=padded)

    kind = kept.schema["doc"].dataType.simpleString()
    out = f"doc {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded long"
    last = kept.where(F.col("length") < capacity).withColumn("grp", group).groupBy("grp").applyInPandas(fill, out)
    whole = (kept.where(F.col("length") == capacity)
             .withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
             .withColumn("padded", F.lit(capacity).cast("long")).drop("salt"))
    return last.unionByName(whole).withColumnRenamed("doc", id_col)
