"""Removal of long passages that repeat across documents, with suffix automata of reference passages.

A window is so many consecutive words. The documents' text is not sent to every task: windows are routed by content
instead, so each task holds the automaton of one reference block at a time.

1. Each window has an anchor, the least hash of the short word runs in it. Anchors met in a single document cannot
   belong to a repeated window.
2. The other windows are cut out in blocks, with a fingerprint each; a fingerprint's owner is the block of the
   smallest document that has it. Blocks of owners are the reference shards.
3. The suffix automaton of a reference block is built where the blocks that point to it arrive; each of those is
   streamed through it for its matching statistics, and a window is repeated if the match that ends with it is at
   least a window long.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settle
from .words import NOT_SPACE, Words, slices, windows

WINDOW = 50
ANCHOR = 8
#: Windows of one block.
BLOCK = 512
_DOC, _START, _TEXT = 2**52, 2**20, 2**20 - 1


class Automaton:
    """The suffix automaton of a sequence of words."""

    def __init__(self, words: list) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for word in words:
            state = self.add(self.length[last] + 1, {})
            at = last
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = state
                at = self.link[at]
            if at < 0:
                self.link[state] = 0
            else:
                old = self.next[at][word]
                if self.length[old] == self.length[at] + 1:
                    self.link[state] = old
                else:
                    copy = self.add(self.length[at] + 1, dict(self.next[old]))
                    self.link[copy], self.link[old], self.link[state] = self.link[old], copy, copy
                    while at >= 0 and self.next[at].get(word) == old:
                        self.next[at][word] = copy
                        at = self.link[at]
            last = state

    def add(self, length: int, next_: dict) -> int:
        self.next.append(next_)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def statistics(self, words: list) -> list[int]:
        """For each word, the length of the longest run of words that ends with it and is in the sequence."""
        out, state, size = [], 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            out.append(size)
        return out


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    n = len(values) - size + 1
    width = 1
    while 2 * width <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[:n], values[size - width:size - width + n])


def scan(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """Per row: doc_id, h (hash of the text), n_words, whole (hash of all words; null if there are fewer than a window),
    anchors (value, lo, n): runs of n window starts from lo on with one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                read = Words(part.column("text"), NOT_SPACE)
                hashes, counts, docs_ = read.hashes(), read.counts(), len(read.first) - 1
                value, lo, n, edges = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(docs_ + 1, np.int64)
                if len(hashes) >= window:
                    least = sliding_least(windows(hashes, anchor), window - anchor + 1)
                    at = np.flatnonzero(read.left()[:len(least)] >= window)
                    doc, least = read.doc()[at], least[at]
                    new = np.ones(len(at), bool)
                    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
                    begin = np.flatnonzero(new)
                    value, n, lo = least[begin], np.diff(np.append(begin, len(at))), at[begin] - read.first[doc[begin]]
                    edges = np.searchsorted(doc[begin], np.arange(docs_ + 1))
                whole = [xxh(hashes[read.first[d]:read.first[d + 1]]) if counts[d] >= window else None for d in range(docs_)]
                runs = pa.StructArray.from_arrays([pa.array(value.view(np.int64)), pa.array(lo, pa.int64()), pa.array(n, pa.int64())], ["value", "lo", "n"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("h"), pa.array(counts, pa.int64()), pa.array(whole, pa.int64()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), runs)],
                    ["doc_id", "h", "n_words", "whole", "anchors"])

    return docs.mapInArrow(run, "doc_id long, h long, n_words long, whole long, anchors array<struct<value:long,lo:long,n:long>>")


def xxh(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes()) - 2**63


def blocks(texts: DataFrame, window: int) -> DataFrame:
    """Blocks of candidate windows: doc_id, h, start, words (one space between), prints (a fingerprint per window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                read = Words(part.column("text"), NOT_SPACE)
                prints = windows(read.hashes(), window).view(np.int64)
                out: list[list] = [[], [], [], [], []]
                for d, ranges in enumerate(part.column("ranges").to_pylist()):
                    words, base = read.text(d), int(read.first[d])
                    merged: list[list[int]] = []
                    for r in sorted(ranges, key=lambda r: r["lo"]):
                        if merged and merged[-1][1] >= r["lo"]:
                            merged[-1][1] = max(merged[-1][1], r["lo"] + r["n"])
                        else:
                            merged.append([r["lo"], r["lo"] + r["n"]])
                    for lo, hi in merged:
                        for start in [lo, *range(lo // BLOCK * BLOCK + BLOCK, hi, BLOCK)]:
                            stop = min(hi, start // BLOCK * BLOCK + BLOCK)
                            row = (part.column("doc_id")[d].as_py(), part.column("h")[d].as_py(), start, b" ".join(words[start:stop + window - 1]), prints[base + start:base + stop])
                            for column, x in zip(out, row, strict=True):
                                column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)],
                                                 ["doc_id", "h", "start", "words", "prints"])

    return texts.mapInArrow(run, "doc_id long, h long, start long, words binary, prints array<long>")


def matched(pointed: DataFrame, window: int) -> DataFrame:
    """Windows of blocks that the automaton of the block they point to confirms: doc_id, h, starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, automaton = None, None
        for batch in batches:
            starts = []
            for owner, words, other, start, ats in zip(*(batch.column(c).to_pylist() for c in ("owner", "words", "other", "start", "ats")), strict=True):
                if owner != name:  # rows come sorted by owner
                    name, automaton = owner, Automaton(other.split(b" "))
                reach = automaton.statistics(words.split(b" "))
                starts.append([start + i for i in sorted(ats) if reach[i + window - 1] >= window])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(starts, pa.list_(pa.int64()))], ["doc_id", "h", "starts"])

    return pointed.mapInArrow(run, "doc_id long, h long, starts array<long>")


def decimal(column, factor: int):
    return column.cast("decimal(38,0)") * F.lit(factor).cast("decimal(38,0)")


def document(place: str):
    """What places of one document have in common, in the order of doc_id."""
    whole = F.lit(_DOC).cast("decimal(38,0)")
    return F.col(place) - F.pmod(F.col(place), whole)


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """For each distinct (doc_id, h) of `docs` (doc_id, h, text): `copy` (all its words are those of a document with a smaller
    id) and `starts`, window starts whose words also begin in a document with a smaller id (null if there are none)."""
    seen = settle(scan(docs, window, anchor).dropDuplicates(["doc_id", "h"]))
    first = seen.where(F.col("whole").isNotNull()).groupBy("whole", "n_words").agg(F.min("doc_id").alias("rep"))
    placed = seen.drop("anchors").join(first, ["whole", "n_words"], "left").select("doc_id", "h", F.coalesce(F.col("rep") < F.col("doc_id"), F.lit(False)).alias("copy"))
    placed = settle(placed)
    runs = (seen.join(placed.where(~F.col("copy")).select("doc_id", "h"), ["doc_id", "h"])
            .select("doc_id", "h", F.explode("anchors").alias("a")).select("doc_id", "h", "a.*"))
    shared = runs.groupBy("value").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where(F.col("x") < F.col("y")).select("value")
    ranges = runs.join(shared, "value").groupBy("doc_id", "h").agg(F.collect_list(F.struct("lo", "n")).alias("ranges"))  # bounded by the document
    place = decimal(F.col("doc_id"), _DOC) + decimal(F.col("start"), _START) + F.col("h").bitwiseAND(_TEXT).cast("decimal(38,0)")
    cut = settle(blocks(docs.join(ranges, ["doc_id", "h"]), window)
                      .withColumn("place", place.cast("decimal(38,0)")))
    every = cut.select("place", F.posexplode("prints").alias("i", "print"))
    # written first: the join then deals both sides itself and can split a fingerprint that many documents share
    owners = settle(every.groupBy("print").agg(F.min("place").alias("owner"), F.max("place").alias("last"))
                    .where(document("owner") < document("last")).drop("last"))
    points = settle(every.join(owners, "print").where(document("owner") < document("place"))
                    .groupBy("place", "owner").agg(F.collect_list("i").alias("ats")))  # at most BLOCK entries
    other = cut.select(F.col("place").alias("owner"), F.col("words").alias("other")).dropDuplicates(["owner"])
    pointed = points.join(cut.drop("prints").dropDuplicates(["place"]), "place").join(other, "owner").sortWithinPartitions("owner")
    found = matched(pointed.select("doc_id", "h", "start", "words", "owner", "other", "ats"), window)
    starts = settle(found.groupBy("doc_id", "h").agg(F.flatten(F.collect_list("starts")).alias("starts")))  # bounded by the document
    return placed.join(starts, ["doc_id", "h"], "left")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The rows and columns of `docs` (doc_id, an integer, text and others), and `n_words`, `n_removed`, `kept_sha256` (of the words
    kept, one space between) and `kept_text`: the text without the bytes from each removed word up to the next word.

    A word is removed if it lies in a window of `window` consecutive words that also begins in a document with a
    smaller id; windows are judged on the text as it comes. Words are runs without ASCII white space, unchanged.
    Documents of fewer words than a window keep all. Repeats inside one document, and in rows that share an id, stay.
    Null and empty texts have no words; a row with a null id keeps all and is no reference. No rows in, no rows out.
    Columns called like the four are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_sha256", "kept_text")]
    keyed = docs.select(*names).withColumn("__h", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("__id", F.col("doc_id").cast("long"))
    plain = keyed.where(F.col("__id").isNotNull()).select(F.col("__id").alias("doc_id"), F.col("__h").alias("h"), "text")
    marked = repeats(plain, window, anchor).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("copy").alias("__copy"), F.col("starts").alias("__starts"))
    joined = keyed.join(marked, ["__id", "__h"], "left").drop("__id", "__h")
    fields = [f"c{i} {joined.schema[n].dataType.simpleString()}" for i, n in enumerate(names)]
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, sums, kept_texts = [], [], [], []
            for raw, copy, starts in zip(batch.column(text).cast(pa.binary()).to_pylist(), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                words = (raw or b"").split()
                keep = np.ones(len(words), bool)
                if copy:
                    keep[:] = False
                elif starts:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, starts, 1)
                    np.add.at(change, np.array(starts) + window, -1)
                    keep = np.cumsum(change[:-1]) == 0
                kept = words if keep.all() else [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                sums.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                kept_texts.append(raw if len(kept) == len(words) else without(raw, keep))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sums, pa.string()), pa.array(kept_texts, pa.binary()).cast(pa.string())],
                                             [*(f"c{i}" for i in range(len(names))), "n_words", "n_removed", "kept_sha256", "kept_text"])

    return joined.select(*names, "__copy", "__starts").mapInArrow(run, ", ".join([*fields, "n_words long, n_removed long, kept_sha256 string, kept_text string"])).toDF(*names, "n_words", "n_removed", "kept_sha256", "kept_text")


def without(raw: bytes, keep: np.ndarray) -> bytes:
    """The text without removed words and what follows each up to the next word."""
    read = Words(pa.array([raw], pa.binary()).view(pa.string()), NOT_SPACE)
    begin = np.append(read.starts, len(raw))
    parts = [raw[:begin[0]]] + [raw[a:b] for a, b in zip(begin[:-1][keep], begin[1:][keep], strict=True)]
    return b"".join(parts).rstrip(b" \t\n\v\f\r")
