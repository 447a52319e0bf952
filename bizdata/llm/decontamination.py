"""Benchmark decontamination as a prefix-filtered set join of item windows with documents.

A window of an item occurs in a document only if all its shingles do. So it is enough to look for one of them, and
the rarest one is looked for: shingles are ordered by how often they occur in all documents, and each window is
posted under its first shingle in that order, with the offset it has there. A document word that starts a posted
shingle proposes one start per posting (positional bound); starts whose window would leave the document are
dropped (length bound); the others are compared word by word.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LETTER_OR_DIGIT, Words, join, slices

#: Item words in one block of the index; a larger benchmark is joined block by block.
BLOCK_WORDS = 1_000_000
_FLAGS = 1 << 20


class Flags:
    """Whether hashes are in a sorted array, with a table of flags before the search."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.flags = keys, np.zeros(_FLAGS, bool)
        self.flags[keys & np.uint64(_FLAGS - 1)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of hashes that are keys, and which keys they are."""
        at = np.flatnonzero(self.flags[(hashes & np.uint64(_FLAGS - 1)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[key] == hashes[at]
        return at[same], key[same]


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of each word with the next one; of the last word alone."""
    return np.append(join(words[:-1], words[1:]), words[-1:]) if len(words) else words


class Items:
    """Distinct windows of the items of a block: `words` (one row each, 0 beyond `size`), `owners` (their items)."""

    def __init__(self, ids: list, texts: list, window: int) -> None:
        read = Words(pa.array(texts, pa.large_string()), LETTER_OR_DIGIT, lower=True)
        hashes, rows, sizes, owners = read.hashes(), [], [], []
        for i in range(len(texts)):
            own = hashes[read.first[i]:read.first[i + 1]]
            if not len(own):
                continue
            size = min(window, len(own))
            seen = np.zeros((len(own) - size + 1, window), np.uint64)
            seen[:, :size] = np.lib.stride_tricks.sliding_window_view(own, size)
            rows.append(seen)
            sizes.append(np.full(len(seen), size))
            owners.append(np.full(len(seen), i))
        self.ids = ["null" if i is None else str(i) for i in ids]
        every = np.concatenate(rows) if rows else np.zeros((0, window), np.uint64)
        self.words, same = np.unique(every, axis=0, return_inverse=True)
        same = same.reshape(-1)
        self.size = np.zeros(len(self.words), np.int64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        if len(every):
            self.size[same] = np.concatenate(sizes)
        order = np.argsort(same, kind="stable")
        self.owners, self.owner_from = owner[order], np.searchsorted(same[order], np.arange(len(self.words) + 1))
        self.shingles = np.stack([self.shingle(k) for k in range(max(1, window - 1))], 1) if len(self.words) else np.zeros((0, 1), np.uint64)

    def shingle(self, k: int) -> np.ndarray:
        """The k-th shingle of every window. A window of one word has that word alone; one too short for a k-th shingle
        repeats its first."""
        if self.words.shape[1] == 1:
            return self.words[:, 0]
        two = join(self.words[:, k], self.words[:, k + 1])
        return np.where(self.size == 1, self.words[:, 0], np.where(k + 1 < self.size, two, join(self.words[:, 0], self.words[:, 1])))

    def post(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Post every window under its rarest shingle (ties: the earliest). counts: of `keys`, over all documents."""
        often = counts[np.searchsorted(keys, self.shingles)]
        rarest = np.argmin(often, 1) if len(self.words) else np.zeros(0, np.int64)
        key = self.shingles[np.arange(len(rarest)), rarest]
        order = np.argsort(key, kind="stable")
        self.posted, self.offset = order, np.where(rarest[order] + 1 < np.maximum(self.size[order], 2), rarest[order], 0)
        posted_keys, self.post_from = np.unique(key[order], return_index=True)
        self.post_from = np.append(self.post_from, len(order))
        self.look = Flags(posted_keys)

    def occurrences(self, read: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word positions in the slice) and windows of all occurrences."""
        at, key = self.look.find(shingle_hashes(hashes))
        alone, alone_key = self.look.find(hashes)  # windows of a single word
        at, key = np.append(at, alone), np.append(key, alone_key)
        many = self.post_from[key + 1] - self.post_from[key]
        post = np.repeat(self.post_from[key], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start, window = np.repeat(at, many) - self.offset[post], self.posted[post]
        ok = start >= 0
        start, window = start[ok], window[ok]
        ok = self.size[window] <= read.left()[start]
        start, window = start[ok], window[ok]
        for k in range(self.words.shape[1]):
            inside = k < self.size[window]
            ok = ~inside | (hashes[np.minimum(start + k, len(hashes) - 1)] == self.words[window, k])
            start, window = start[ok], window[ok]
        return start, window


def count_shingles(docs: DataFrame, keys: np.ndarray) -> np.ndarray:
    """How often each key occurs as a shingle in all documents; one small row per key and task is shuffled."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, total = Flags(sent.value), np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for part in slices(batch):
                hashes = Words(part.column("text"), LETTER_OR_DIGIT, lower=True).hashes()
                total += np.bincount(look.find(shingle_hashes(hashes))[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["key", "n"])

    found = docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(keys), np.int64)
    for row in found:  # at most one row per key of the block
        out[row["key"]] = row["n"]
    return out


def blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[Items]:
    """The index in blocks of bounded size: items, repeated ones once, are dealt by a hash, as many blocks as their words ask for."""
    words = F.size(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)))
    chosen = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), words.alias("n")).dropDuplicates(["id", "text"])
    total = chosen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    many = -(-total // block_words)
    for k in range(many):
        rows = chosen.where((F.pmod(F.xxhash64("id", "text"), F.lit(many)) == k) & (F.col("n") > 0)).select("id", "text").toArrow()
        if rows.num_rows:
            yield Items(rows["id"].to_pylist(), rows["text"].to_pylist(), window)


def find_items(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """One row per row of `docs`: its id, `n_words`, `hits` (runs of words inside an occurrence of any item window, from
    `start` to before `end`), `items` (ids, as strings, of items with an occurring window, sorted), and the columns
    of `docs` named in `keep`.

    Words are runs of digits, letters a-z after lower-casing A-Z, and characters outside ASCII. A window is
    `window` consecutive item words; an item of fewer words is one window. Null and empty texts have no words;
    items without words match nothing; a null item id is listed as "null"; an id that repeats in `items` is listed
    once; repeated document rows come out once each. Empty tables give no rows or no hits. Other columns are
    ignored, whatever their names. Documents are not shuffled. Only the index of one block of items, whose size
    `block_words` bounds, is sent to the executors at a time; a further block is a further pass.
    """
    spark = docs.sparkSession
    keep = keep or []
    names = [f"k{i}" for i in range(len(keep))]
    state = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)),
                        F.lit(0).cast("long").alias("n_words"),
                        F.array().cast("array<struct<start:long,end:long>>").alias("hits"), F.array().cast("array<string>").alias("items"))
    schema = state.schema

    def finder(sent):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value if sent is not None else None
            for batch in batches:
                for part in slices(batch):
                    yield mark(part, index)
        return find

    def mark(part: pa.RecordBatch, index: Items | None) -> pa.RecordBatch:
        read = Words(part.column("text"), LETTER_OR_DIGIT, lower=True)
        n_words, hits, listed = read.counts(), part.column("hits"), part.column("items")
        if index is not None and len(read):
            start, window = index.occurrences(read, read.hashes())
            if len(start):
                hits, listed = hits.to_pylist(), listed.to_pylist()
                doc = np.searchsorted(read.first, start, "right") - 1
                for d in np.unique(doc):
                    own = doc == d
                    ids = {index.ids[i] for w in np.unique(window[own]) for i in index.owners[index.owner_from[w]:index.owner_from[w + 1]]}
                    listed[d] = sorted({*listed[d], *ids})
                    base, n = int(read.first[d]), int(n_words[d])
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, start[own] - base, 1)
                    np.add.at(change, start[own] - base + index.size[window[own]], -1)
                    for run in hits[d]:
                        change[run["start"]] += 1
                        change[run["end"]] -= 1
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])))
                    hits[d] = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                hits = pa.array(hits, part.schema.field("hits").type)
                listed = pa.array(listed, part.schema.field("items").type)
        columns = {f.name: part.column(f.name) for f in part.schema} | {"n_words": pa.array(n_words, pa.int64()), "hits": hits, "items": listed}
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    any_block = False
    for index in blocks(items, item_id_col, item_text_col, window, block_words):
        keys = np.unique(index.shingles)
        index.post(keys, count_shingles(docs.select(F.col(text_col).alias("text")), keys))
        state = state.mapInArrow(finder(spark.sparkContext.broadcast(index)), schema)
        any_block = True
    if not any_block:
        state = state.mapInArrow(finder(None), schema)
    return state.select(F.col("id").alias(id_col), "n_words", "hits", "items", *(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)))


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs`, with their columns, in which no window of an item occurs; see find_items."""
    found = find_items(docs, items, id_col=id_col, keep=docs.columns, **options)
    numbered = found.toDF(*[f"c{i}" for i in range(len(found.columns))])  # names in `docs` may clash with the result's
    return numbered.where(F.size("c2") == 0).select(*(F.col(f"c{i + 4}").alias(c) for i, c in enumerate(docs.columns)))
