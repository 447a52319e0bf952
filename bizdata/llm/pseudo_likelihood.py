"""Masked pseudo-likelihood of documents by a bidirectional window network.

Every word is predicted from the words on both sides of it: the embeddings of the words at each offset are added,
squashed, and a two-level softmax (class, then word in its class) gives the probability of a frequent word or of
a bucket of the others by ending. Each task trains a copy of the network on its own documents, and the copies are
averaged by how many words each has seen, for some rounds. A word of a bucket has the probability of its bucket
times that of the word in it, from counts over all documents of the word, alone and beside its two neighbours.
The vocabulary is so every word of the corpus. The sum of the conditional log probabilities scores a document.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .decontamination import Flags
from .words import NOT_SPACE, Words, mix, slices

CLASSES = 32
SIZE = CLASSES * CLASSES
FREQUENT = 768
EDGE = SIZE - 1  # stands beyond both ends of a document
BUCKETS = EDGE - FREQUENT
HIDDEN = 24
OFFSETS = (-2, -1, 1, 2)
#: The rounds share out the positions of every document, so each position is trained on once.
ROUNDS = 2
BATCH = 8192
RATE = 0.15
CHUNK = 2048
#: Share of an occurrence that every word of a bucket has beforehand, and the weight, in occurrences, of the
#: probability without a neighbour against the counts beside it.
SHARE = 0.5
WEIGHT = 10
#: Occurrences of words of buckets that are counted together, and bytes of text whose occurrences travel together.
OCCURRENCES = 1 << 18
#: So many words of buckets at most have their occurrences split over groups: those with more than OCCURRENCES, and more than this
#: part of all.
HEAVY_WORDS = 1 << 17
BLOCK_BYTES = 4 << 20


class Vocabulary:
    def __init__(self, frequent: np.ndarray, distinct: np.ndarray | None = None, heavy: np.ndarray | None = None, heavy_n: np.ndarray | None = None) -> None:
        """frequent: hashes of words, most frequent first; distinct: how many words each bucket has; heavy: sorted hashes of
        words of buckets that occur too often for one group, and how often they do."""
        order = np.argsort(frequent)
        self.look, self.rank = Flags(frequent[order]), order
        self.distinct = np.zeros(BUCKETS, np.int64) if distinct is None else distinct
        self.heavy = np.zeros(0, np.uint64) if heavy is None else heavy
        self.heavy_n = np.zeros(0, np.int64) if heavy_n is None else heavy_n

    def heavy_at(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of heavy words, and which of them each is."""
        at = np.minimum(np.searchsorted(self.heavy, hashes), max(len(self.heavy) - 1, 0))
        found = np.flatnonzero(self.heavy[at] == hashes) if len(self.heavy) else np.zeros(0, np.int64)
        return found, at[found]

    def ids(self, read: Words) -> np.ndarray:
        """Ids of the words of a slice; a word that is not frequent has the bucket of its last three bytes."""
        out = FREQUENT + buckets(read)
        at, key = self.look.find(read.hashes())
        out[at] = self.rank[key]
        return out


def buckets(read: Words) -> np.ndarray:
    tail = np.zeros(len(read), np.uint64)
    for back in (3, 2, 1):
        at = read.ends - back
        tail = tail * np.uint64(256) + np.where(at >= read.starts, read.raw[np.maximum(at, 0)], 0).astype(np.uint64)
    return (mix(tail) % np.uint64(BUCKETS)).astype(np.int64)


def contexts(read: Words, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ids at each offset of the positions; EDGE beyond the document."""
    doc = read.doc()[at]
    first, last = read.first[doc], read.first[doc + 1]
    out = np.empty((len(at), len(OFFSETS)), np.int64)
    for k, offset in enumerate(OFFSETS):
        other = at + offset
        inside = (other >= first) & (other < last)
        out[:, k] = np.where(inside, ids[np.clip(other, 0, max(0, len(ids) - 1))], EDGE)
    return out


class Network:
    SHAPES = {"put": (len(OFFSETS), SIZE, HIDDEN), "shift": (HIDDEN,), "classes": (HIDDEN, CLASSES), "class_shift": (CLASSES,),
              "words": (CLASSES, HIDDEN, CLASSES), "word_shift": (CLASSES, CLASSES)}

    def __init__(self, flat: np.ndarray | None = None) -> None:
        if flat is None:
            flat = (np.random.default_rng(0).normal(size=self.length()) * 0.05).astype(np.float32)
        at = 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at:at + n].reshape(shape).astype(np.float32))
            at += n

    @classmethod
    def length(cls) -> int:
        return sum(int(np.prod(s)) for s in cls.SHAPES.values())

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in self.SHAPES])

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = np.broadcast_to(self.shift, (len(context), HIDDEN)).copy()
        for k in range(len(OFFSETS)):
            total += self.put[k][context[:, k]]
        return np.tanh(total, out=total)

    @staticmethod
    def log_of(x: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The logarithm of the wanted entry of each row's softmax."""
        np.clip(x, -80, 80, out=x)  # a logit beyond would overflow; none comes near in training
        at = x[np.arange(len(x)), wanted]
        return at - np.log(np.exp(x, out=x).sum(1))

    @staticmethod
    def softmax(x: np.ndarray) -> np.ndarray:
        x = np.exp(np.clip(x, -80, 80, out=x), out=x)
        x /= x.sum(1, keepdims=True)
        return x

    @staticmethod
    def by_class(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows sorted by class, and where each class begins."""
        return np.argsort(group.astype(np.int16), kind="stable"), np.append(0, np.cumsum(np.bincount(group, minlength=CLASSES)))

    def log_probabilities(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        order, edges = self.by_class(word // CLASSES)
        hidden, word = self.hidden(context)[order], word[order]
        sorted_ = self.log_of(hidden @ self.classes + self.class_shift, word // CLASSES)
        for c in np.flatnonzero(np.diff(edges)):
            own = slice(edges[c], edges[c + 1])
            sorted_[own] += self.log_of(hidden[own] @ self.words[c] + self.word_shift[c], word[own] % CLASSES)
        out = np.empty_like(sorted_)
        out[order] = sorted_
        return out

    def train(self, context: np.ndarray, word: np.ndarray, memory: dict[str, np.ndarray]) -> None:
        """One step on a batch, with step sizes that shrink by each weight's past gradients."""
        order, edges = self.by_class(word // CLASSES)
        context, word = context[order], word[order]  # a class is a slice from here on
        n, hidden = len(word), self.hidden(context)
        off = self.softmax(hidden @ self.classes + self.class_shift)
        off[np.arange(n), word // CLASSES] -= 1
        back = off @ self.classes.T
        steps = [("classes", slice(None), hidden.T @ off), ("class_shift", slice(None), off.sum(0))]
        for c in np.flatnonzero(np.diff(edges)):
            own = slice(edges[c], edges[c + 1])
            miss = self.softmax(hidden[own] @ self.words[c] + self.word_shift[c])
            miss[np.arange(len(miss)), word[own] % CLASSES] -= 1
            back[own] += miss @ self.words[c].T
            steps += [("words", c, hidden[own].T @ miss), ("word_shift", c, miss.sum(0))]
        back *= 1 - hidden ** 2
        steps.append(("shift", slice(None), back.sum(0)))
        for k in range(len(OFFSETS)):
            by = np.argsort(context[:, k].astype(np.int16), kind="stable")
            ids = context[by, k]
            first = np.flatnonzero(np.diff(ids, prepend=-1))
            steps.append(("put", (k, ids[first]), np.add.reduceat(back[by], first, 0)))
        for name, at, slope in steps:
            slope /= np.float32(n)
            past = memory[name][at] + slope ** 2
            memory[name][at] = past
            getattr(self, name)[at] -= np.float32(RATE) * slope / np.sqrt(past + np.float32(1e-7))


def word_table(docs: DataFrame) -> DataFrame:
    """Every word (its hash) of all documents, its `bucket` and how often it occurs, `n`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, bucket, totals = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(bucket, pa.int32()), pa.array(totals)], ["word", "bucket", "n"])

        for batch in batches:
            for part in slices(batch, limit=4 << 20):
                read = Words(part.column("text"), NOT_SPACE)
                words, at, n = np.unique(read.hashes(), return_index=True, return_counts=True)
                bucket = np.concatenate([bucket, buckets(read)[at]])
                keys, at, same = np.unique(np.concatenate([keys, words]), return_index=True, return_inverse=True)
                bucket, totals = bucket[at], np.bincount(same, np.concatenate([totals, n]), len(keys)).astype(np.int64)
                if len(keys) > 500_000:
                    yield rows()
                    keys, bucket, totals = keys[:0], bucket[:0], totals[:0]
        yield rows()

    return docs.mapInArrow(count, "word long, bucket int, n long").groupBy("word").agg(F.min("bucket").alias("bucket"), F.sum("n").alias("n"))


def most_frequent(words: DataFrame) -> np.ndarray:
    """Hashes of the most frequent words of a word table (ties: smaller hash), most frequent first."""
    found = words.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    return np.array([r["word"] for r in found], np.int64).view(np.uint64)


def count_words(docs: DataFrame) -> np.ndarray:
    """Hashes of the most frequent words of all documents."""
    return most_frequent(word_table(docs))


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> tuple[Network, np.ndarray, DataFrame | None]:
    """The network, how often words of each bucket stand after each id ([0, bucket, id]) and before it ([1, bucket, id]), and the
    same of each heavy word (`heavy`, `beside` = side and id packed, `n`; a frame), which the first round counts as it reads the texts.

    Rounds of local training and averaging; a round takes the positions (word numbers in a document) that leave
    its number when divided by `rounds`, so every word of every document is a target once. Each task sends one copy of the weights, in chunks that are averaged
    apart; one averaged copy, of fixed size, comes back."""
    spark, net, shape = docs.sparkSession, Network(), (2, BUCKETS, SIZE)
    beside_counts, heavy_counts = np.zeros(shape, np.int64), None
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((vocabulary, net.flat(), turn))

        def learn(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            vocabulary, flat, turn = sent.value
            own, seen, total = Network(flat), 0, np.zeros(shape, np.int64)
            heavy = np.zeros(0, np.int64), np.zeros(0, np.int64)
            memory = {name: np.zeros(shape, np.float32) for name, shape in Network.SHAPES.items()}
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for batch in batches:
                for part in slices(batch):
                    read = Words(part.column("text"), NOT_SPACE)
                    ids = vocabulary.ids(read)
                    if turn == 0:
                        count_beside(total, read, ids)
                        heavy = count_heavy(heavy, vocabulary, read, ids)
                        if len(heavy[0]) > 500_000:
                            yield made(heavy=(heavy[0], len(heavy[0])), n=(heavy[1], len(heavy[0])))
                            heavy = heavy[0][:0], heavy[1][:0]
                    at = targets(read, turn, rounds)
                    held.append((contexts(read, ids, at), ids[at]))
                    if sum(len(h[1]) for h in held) >= 8 * BATCH:
                        seen += steps(own, held, memory)
                        held = []
            seen += steps(own, held, memory) if held else 0
            if seen:
                flat = own.flat() * np.float64(seen)
                chunks = [flat[a:a + CHUNK] for a in range(0, len(flat), CHUNK)]
                yield made(chunk=(range(len(chunks)), len(chunks)), seen=([seen] * len(chunks), len(chunks)), w=(chunks, len(chunks)))
            keys = np.flatnonzero(total)
            if len(keys):
                yield made(key=(keys, len(keys)), n=(total.ravel()[keys], len(keys)))
            if len(heavy[0]):
                yield made(heavy=(heavy[0], len(heavy[0])), n=(heavy[1], len(heavy[0])))

        def made(**columns) -> pa.RecordBatch:
            size = next(iter(columns.values()))[1]
            return pa.RecordBatch.from_arrays([pa.array(columns[c][0], t) if c in columns else pa.nulls(size, t) for c, t in kinds.items()], list(kinds))

        def average(rows: pd.DataFrame) -> pd.DataFrame:
            total = np.sum(np.stack(rows["w"].to_list()), 0) / rows["seen"].sum()
            return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "w": [total]})

        kinds = {"chunk": pa.int32(), "seen": pa.int64(), "w": pa.list_(pa.float64()), "key": pa.int32(), "n": pa.int64(), "heavy": pa.int64()}
        # a copy of the weights and at most 2 x BUCKETS x SIZE counts a task
        read = cut_lineage(docs.mapInArrow(learn, "chunk int, seen long, w array<double>, key int, n long, heavy long"))
        chunks = read.where(F.col("chunk").isNotNull()).select("chunk", "seen", "w").groupBy("chunk").applyInPandas(average, "chunk int, w array<double>").collect()
        if chunks:
            net = Network(np.concatenate([c["w"] for c in sorted(chunks, key=lambda c: c["chunk"])]).astype(np.float32))
        if turn == 0:
            found = read.where(F.col("key").isNotNull()).groupBy("key").agg(F.sum("n").alias("n")).toArrow()
            beside_counts.ravel()[found["key"].to_numpy()] = found["n"].to_numpy()
            if len(vocabulary.heavy):
                heavy_counts = read.where(F.col("heavy").isNotNull()).groupBy("heavy").agg(F.sum("n").alias("n")).select(
                    F.shiftright("heavy", 11).alias("heavy"), F.col("heavy").bitwiseAND(2047).cast("int").alias("beside"), "n")
    return net, beside_counts, heavy_counts


def count_heavy(held: tuple[np.ndarray, np.ndarray], vocabulary: Vocabulary, read: Words, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counts held so far (keys: heavy word, side and id beside it, packed) and those of a slice, by key."""
    at, which = vocabulary.heavy_at(read.hashes())
    if not len(at):
        return held
    beside = contexts(read, ids, at)[:, 1:3]
    keys = np.concatenate([which << 11 | side << 10 | beside[:, side] for side in (0, 1)])
    keys, same = np.unique(np.concatenate([held[0], keys]), return_inverse=True)
    return keys, np.bincount(same, np.concatenate([held[1], np.ones(2 * len(at), np.int64)]), len(keys)).astype(np.int64)


def count_beside(total: np.ndarray, read: Words, ids: np.ndarray) -> None:
    """Add the words of buckets of a slice to the counts by the ids beside them."""
    at = np.flatnonzero(ids >= FREQUENT)
    beside = contexts(read, ids, at)[:, 1:3]
    for side in (0, 1):
        keys, n = np.unique((ids[at] - FREQUENT) * SIZE + beside[:, side], return_counts=True)
        total[side].ravel()[keys] += n


def targets(read: Words, turn: int, rounds: int) -> np.ndarray:
    """The words of a slice that round `turn` trains on."""
    place = np.arange(len(read)) - np.repeat(read.first[:-1], read.counts())
    return np.flatnonzero(place % rounds == turn)


def steps(net: Network, held: list[tuple[np.ndarray, np.ndarray]], memory: dict[str, np.ndarray]) -> int:
    context, word = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    order = np.random.default_rng(len(word)).permutation(len(word))
    for at in range(0, len(word), BATCH):
        own = order[at:at + BATCH]
        net.train(context[own], word[own], memory)
    return len(word)


def network_sums(net: Network, read: Words, ids: np.ndarray) -> np.ndarray:
    """For each document of a slice the sum of the log probabilities of its words' ids."""
    each = np.zeros(len(ids))
    for at in range(0, len(ids), 1 << 16):
        own = np.arange(at, min(len(ids), at + (1 << 16)))
        each[own] = net.log_probabilities(contexts(read, ids, own), ids[own])
    return np.bincount(read.doc(), each, len(read.first) - 1)


def score(docs: DataFrame, vocabulary: Vocabulary, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The network's part of `score_words`: a word that is not frequent counts as its bucket only. Columns and rows
    as there. No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, net.flat()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat = sent.value
        net = Network(flat)
        for batch in batches:
            for part in slices(batch):
                read = Words(part.column("text"), NOT_SPACE)
                total = network_sums(net, read, vocabulary.ids(read))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(read.counts(), pa.int64()), pa.array(total, pa.float64())], ["id", "n_words", "log_prob"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return with_mean(chosen.mapInArrow(run, f"id {kind}, n_words long, log_prob double"), id_col)


def with_mean(scored: DataFrame, id_col: str) -> DataFrame:
    return scored.select(F.col("id").alias(id_col), "n_words", "log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("mean_log_prob"))


def in_bucket(word: np.ndarray, beside: np.ndarray, counts: np.ndarray, distinct: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """Log probability of each occurrence's word in its bucket, given both neighbours, from all other occurrences.

    word, beside: all occurrences of some words, and (bucket, id before, id after) of each, packed; with `known`, some occurrences
    of one word, whose counts after and before each id it holds ([0, id], [1, id]). The counts
    without the occurrence itself are mixed, as if WEIGHT more occurrences had come, from the word's share of the
    bucket to its share after the id before and then before the id after, so each step sums to one over the bucket.
    """
    bucket, before, after = beside >> 20, beside >> 10 & SIZE - 1, beside & SIZE - 1
    own, n = np.unique(word, return_inverse=True, return_counts=True)[1:] if known is None else (np.zeros(len(word), np.int64), known[0].sum(keepdims=True))
    out = (n[own] - 1 + SHARE) / (counts[0].sum(1)[bucket] - 1 + SHARE * distinct[bucket])
    for side, other in enumerate((before, after)):
        same, n = np.unique(own * SIZE + other, return_inverse=True, return_counts=True)[1:] if known is None else (other, known[side])
        out = (n[same] - 1 + WEIGHT * out) / (counts[side][bucket, other] - 1 + WEIGHT)
    return np.log(out)


def score_words(docs: DataFrame, vocabulary: Vocabulary, net: Network, counts: np.ndarray, heavy_counts: DataFrame | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs` its id, `n_words`, `log_prob` (sum over all words of the log probability of the word given
    both sides) and `mean_log_prob`. Null and empty texts: 0 words, log_prob 0, mean null. Every row comes out
    once, repeated rows and null ids too; other columns are ignored. `docs` are those that `fit` has read.

    Occurrences of words that are not frequent are dealt by word, in arrays of one block of documents each, to groups
    of about OCCURRENCES, where their words are counted; sums by document go back to the blocks. The occurrences of a heavy word
    are dealt over groups of their own by block, and each of these gets the word's counts, at most 2 x SIZE numbers that all tasks
    have added up before. So a group holds about OCCURRENCES, or one part in HEAVY_WORDS of all, whatever word they are of.
    """
    spark = docs.sparkSession
    parts = max(1, round(int(counts[0].sum()) / OCCURRENCES))
    shares = -(-vocabulary.heavy_n // OCCURRENCES)  # groups of each heavy word
    begin = parts + np.cumsum(shares) - shares
    sent = spark.sparkContext.broadcast((vocabulary, net.flat(), counts, shares, begin))
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    fields = f"block long, row int, id {kind}, n_words long, log_prob double, at array<int>"

    def lists(values: np.ndarray, edges: np.ndarray, of: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, of))

    def nulls(n: int, table: pa.Table | pa.RecordBatch, names: tuple[str, ...]) -> dict[str, pa.Array]:
        return {name: pa.nulls(n, table.schema.field(name).type) for name in names}

    def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat, _, shares, begin = sent.value
        net, block = Network(flat), TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in slices(batch, limit=BLOCK_BYTES):
                read = Words(some.column("text"), NOT_SPACE)
                ids, n = vocabulary.ids(read), some.num_rows
                rows = {"part": pa.array((np.arange(n) + block) % parts, pa.int32()), "block": pa.array([block] * n, pa.int64()), "row": pa.array(range(n), pa.int32()), "id": some.column("id"),
                        "n_words": pa.array(read.counts(), pa.int64()), "log_prob": pa.array(network_sums(net, read, ids), pa.float64()), "at": pa.nulls(n, pa.list_(pa.int32())),
                        "word": pa.nulls(n, pa.list_(pa.int64())), "beside": pa.nulls(n, pa.list_(pa.int32())), "known": pa.nulls(n, pa.list_(pa.int64()))}
                docs = pa.RecordBatch.from_pydict(rows)
                yield docs
                rare = np.flatnonzero(ids >= FREQUENT)
                word = read.hashes()[rare]
                part = (mix(word) % np.uint64(parts)).astype(np.int64)
                at, which = vocabulary.heavy_at(word)
                part[at] = begin[which] + block % shares[which]
                order = np.argsort(part, kind="stable")
                rare, word, part = rare[order], word[order], part[order]
                first = np.flatnonzero(np.diff(part, prepend=-1))
                edges, n = np.append(first, len(part)), len(first)
                beside = contexts(read, ids, rare)
                packed = (ids[rare] - FREQUENT) << 20 | beside[:, 1] << 10 | beside[:, 2]
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array(part[first], pa.int32()), "block": pa.array([block] * n, pa.int64()), **nulls(n, docs, ("row", "id", "n_words", "log_prob")),
                     "at": lists(read.doc()[rare], edges, pa.int32()), "word": lists(word.view(np.int64), edges, pa.int64()), "beside": lists(packed, edges, pa.int32()), "known": pa.nulls(n, pa.list_(pa.int64()))})
                block += 1

    def count(table: pa.Table) -> pa.Table:
        vocabulary, _, counts, *_ = sent.value
        docs = table.filter(table["row"].is_valid())
        some = table.filter(table["at"].is_valid()).combine_chunks()
        known = table["known"].drop_null().combine_chunks().flatten().to_numpy(zero_copy_only=False)
        flat = {name: some[name].combine_chunks().flatten().to_numpy(zero_copy_only=False) for name in ("at", "word", "beside")}
        sizes = some["at"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        each = in_bucket(flat["word"], flat["beside"].astype(np.int64), counts, vocabulary.distinct, known.reshape(2, SIZE) if len(known) else None)
        run = np.repeat(np.arange(len(sizes)), sizes)
        first = np.flatnonzero((np.diff(run, prepend=-1) != 0) | (np.diff(flat["at"], prepend=-1) != 0))
        edges = np.searchsorted(run[first], np.arange(len(sizes) + 1))
        sums = np.add.reduceat(each, first) if len(first) else each
        found = pa.table({"block": some["block"], **nulls(len(sizes), table, ("row", "id", "n_words", "log_prob")), "at": lists(flat["at"][first], edges, pa.int32()), "sums": lists(sums, edges, pa.float64())})
        docs = docs.select(["block", "row", "id", "n_words", "log_prob", "at"]).append_column("sums", pa.nulls(len(docs), pa.list_(pa.float64())))
        return pa.concat_tables([docs, found.cast(docs.schema)])

    def add(table: pa.Table) -> pa.Table:
        docs, some = table.filter(table["row"].is_valid()), table.filter(table["row"].is_null())
        at, sums = (some[name].combine_chunks().flatten().to_numpy(zero_copy_only=False) for name in ("at", "sums"))
        row = docs["row"].to_numpy()
        total = docs["log_prob"].to_numpy() + np.bincount(at, sums, len(docs))[row]
        return pa.table({"id": docs["id"], "n_words": docs["n_words"], "log_prob": pa.array(total, pa.float64())})

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *_, shares, begin = sent.value
        for batch in batches:
            for which, beside, n in zip(*(batch.column(c).to_pylist() for c in ("heavy", "beside", "n")), strict=True):
                known = np.zeros(2 * SIZE, np.int64)
                known[beside] = n
                groups = np.arange(shares[which]) + begin[which]
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), pa.array([known] * len(groups), pa.list_(pa.int64()))], ["part", "known"])

    dealt = chosen.mapInArrow(read_blocks, f"part int, {fields}, word array<long>, beside array<int>, known array<long>")
    if heavy_counts is not None:
        told = heavy_counts.groupBy("heavy").agg(F.collect_list("beside").alias("beside"), F.collect_list("n").alias("n"))  # at most 2 x SIZE a word
        dealt = dealt.unionByName(told.mapInArrow(tell, "part int, known array<long>"), allowMissingColumns=True)
    summed = dealt.groupBy("part").applyInArrow(count, f"{fields}, sums array<double>")
    return with_mean(summed.groupBy("block").applyInArrow(add, f"id {kind}, n_words long, log_prob double"), id_col)


def fit(docs: DataFrame, text_col: str = "text") -> tuple[Vocabulary, Network, np.ndarray, DataFrame | None]:
    """What score_words needs of all documents: vocabulary, network, counts beside words, and those of heavy words (null if there
    are none). A table without words gives an untrained network."""
    texts = docs.select(F.col(text_col).alias("text"))
    words = cut_lineage(word_table(texts))
    frequent = most_frequent(words)
    distinct = np.zeros(BUCKETS, np.int64)
    others = words.where(~F.col("word").isin(frequent.view(np.int64).tolist()))
    total = 0
    for r in others.groupBy("bucket").agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect():
        distinct[r["bucket"]] = r["words"]
        total += r["n"]
    # bounded: fewer than HEAVY_WORDS words have more than one part in so many of all occurrences
    found = sorted((np.int64(r["word"]).view(np.uint64), r["n"]) for r in others.where(F.col("n") > max(OCCURRENCES, total // HEAVY_WORDS)).select("word", "n").collect())
    vocabulary = Vocabulary(frequent, distinct, np.array([f[0] for f in found], np.uint64), np.array([f[1] for f in found], np.int64))
    return vocabulary, *train(texts, vocabulary)
