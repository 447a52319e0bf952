"""The trie of conversations that begin alike, from sorted matrices of turn ids.

Conversations are sorted by their sequences of turns over ranges. A task takes the sorted rows in chunks, numbers the
turns of a chunk, pads the sequences to a matrix, sorts its rows, and marks in each column where the row differs from
the one above in that column or an earlier one: there a node starts. Members, smallest ids, children and sums of
subtrees are then one reduction a column over the stretches between marks. As rows are sorted over the whole table, a
node that other chunks have rows of is a prefix of the first or the last row of its chunk. Such boundary nodes go on, as
two rows a chunk with what the chunk knows of them, and are folded by the same code, until one chunk holds all rows.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import settle

#: Entries of a chunk's matrix, and the rows a chunk has at least.
CELLS, LEAST_ROWS = 1 << 20, 8
KEY = 16
NONE = np.iinfo(np.int64).max
EMPTY = hashlib.sha256(b"").hexdigest()
SUMS = ("cnt", "low", "kids", "leaves", "saved")
NODE = {"ref": pa.binary(), "parent_ref": pa.binary(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(),
        "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string()}
EDGE = {"keys": pa.list_(pa.binary()), "words": pa.list_(pa.int64()), **{s: pa.list_(pa.int64()) for s in SUMS}}
ENDS = {"end_ref": pa.binary(), "first_id": pa.int64(), "ids": pa.string()}
SHAPE = ("ref binary, parent_ref binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string, keys array<binary>, words array<long>, cnt array<long>, low array<long>, kids array<long>, leaves array<long>, saved array<long>, "
         "end_ref binary, first_id long, ids string")
ALL = {**NODE, **EDGE, **ENDS}


def turn_key(role: Column, text: Column) -> Column:
    """128 bits of the SHA-256 of a turn. Turns are told apart by it; texts are not shuffled."""
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY))


def sequences(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`conv_id` and its turns in order as `held`, an array of (turn, key, words). Null turns come first, equal ones in the
    order of their keys; null roles and texts are empty; rows without a conversation take no part."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = messages.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), turn_key(role, text).alias("key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "words"))).alias("held"))


def branches(held: DataFrame, every: int = 20, longest: int = 3) -> DataFrame:
    """`conv_id`, `keys` and `words` of conversations rebuilt as branches of others: the first h turns of the conversation
    c - c % `every`, then those of c after its first h; h = crc32(c as text) % (`longest` + 1). An absent one gives no turns."""
    lent = held.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("held", 1, longest).alias("lent"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (longest + 1)).cast("int")
    joined = held.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(lent, "base", "left").withColumn("h", h)
    none = F.slice("held", 1, 0)
    turns = F.concat(F.slice(F.coalesce("lent", none), F.lit(1), F.col("h")), F.slice("held", F.col("h") + 1, F.greatest(F.size("held"), F.lit(1))))
    return joined.select("conv_id", turns.alias("turns")).select("conv_id", F.col("turns.key").alias("keys"), F.col("turns.words").alias("words"))


def flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def flat_keys(column: pa.Array) -> np.ndarray:
    data = b"".join(column.flatten().to_pylist())
    return np.frombuffer(data, f"S{KEY}") if data else np.zeros(0, f"S{KEY}")


def prefix_refs(keys: np.ndarray) -> list[bytes]:
    """What names each prefix of a sequence in every task, from the empty one on."""
    state = hashlib.sha256()
    out = [state.digest()[:KEY]]
    for i in range(len(keys)):
        state.update(keys[i:i + 1].tobytes())
        out.append(state.digest()[:KEY])
    return out


def stretches(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts)


class Chunk:
    """Some rows of the sorted table as a matrix. Rows are conversations, each its own member (level 0), or boundary rows of
    chunks with what is known of the nodes on them."""

    def __init__(self, batches: list[pa.RecordBatch], first_level: bool) -> None:
        table = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        self.base = first_level
        sizes = table.column("keys").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        n, width = len(sizes), int(sizes.max())
        keys = flat_keys(table.column("keys"))
        starts = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(n), sizes)
        column = np.arange(len(row)) - np.repeat(starts, sizes) + 1
        turns = np.full((n, width + 1), -1, np.int64)
        turns[:, 0] = 0
        turns[row, column] = np.unique(keys, return_inverse=True)[1]
        words = np.zeros((n, width + 1), np.int64)
        words[row, column] = flat(table.column("words"))
        conv = table.column("conv_id").to_numpy() if first_level else np.zeros(n, np.int64)
        order = np.lexsort((conv, *turns.T[:0:-1]))
        self.first, self.last = (int(np.flatnonzero(order == i)[0]) for i in (0, n - 1))
        self.turns, self.words, self.conv, self.sizes = turns[order], words[order], conv[order], sizes[order]
        self.keys, self.starts = keys, starts[order]
        self.n, self.width = n, width
        if not first_level:
            held_row, held_column = np.repeat(np.arange(n), sizes + 1), np.concatenate([np.arange(s + 1) for s in sizes])
            self.held = {}
            for name in SUMS:
                matrix = np.full((n, width + 1), NONE if name == "low" else 0, np.int64)
                matrix[held_row, held_column] = flat(table.column(name))
                self.held[name] = matrix[order]

    def sequence(self, row: int) -> np.ndarray:
        return self.keys[self.starts[row]:self.starts[row] + self.sizes[row]]

    def known(self, name: str, depth: int) -> np.ndarray:
        if not self.base:
            return self.held[name][:, depth]
        inside = self.turns[:, depth] >= 0
        return np.where(inside, self.conv, NONE) if name == "low" else inside.astype(np.int64) if name == "cnt" else np.zeros(self.n, np.int64)

    def fold(self, final: bool) -> Iterator[pa.RecordBatch]:
        """Nodes that no other chunk has rows of, the boundary rows, and the conversations that end at boundary nodes."""
        change = np.ones((self.n, self.width + 1), bool)
        change[1:] = self.turns[1:] != self.turns[:-1]
        starts_at = np.logical_or.accumulate(change, axis=1)
        del change
        marks = [np.flatnonzero(starts_at[:, d]) for d in range(self.width + 1)]
        real = [self.turns[m, d] >= 0 for d, m in enumerate(marks)]
        count = [stretches(self.known("cnt", d), m) for d, m in enumerate(marks)]
        low = [np.minimum.reduceat(self.known("low", d), m) for d, m in enumerate(marks)]
        edges = [] if final else list(dict.fromkeys([self.first, self.last]))
        paths = {p: prefix_refs(self.sequence(p)) for p in edges}
        #: For each depth, the stretches on the path of the first and the last row.
        open_at = [{int(np.searchsorted(m, p, "right")) - 1: p for p in reversed(edges) if self.sizes[p] >= d} for d, m in enumerate(marks)]
        ended, loose = self.ends([{int(m[k]): p for k, p in at.items()} for m, at in zip(marks, open_at, strict=True)], paths)
        refs = None if self.base else [prefix_refs(self.sequence(r)) for r in range(self.n)]
        boundary = {p: {name: [NONE if name == "low" else 0] * (int(self.sizes[p]) + 1) for name in SUMS} for p in edges}
        carried = {name: np.zeros(self.n, np.int64) for name in ("kids", "leaves", "saved")}
        for d in range(self.width, -1, -1):
            m = marks[d]
            sums = {name: stretches(carried[name] + self.known(name, d), m) for name in carried}
            closed = real[d].copy()
            closed[list(open_at[d])] = False
            for k, p in open_at[d].items():
                for name, value in (("cnt", count[d]), ("low", low[d]), *sums.items()):
                    boundary[p][name][d] = int(value[k])
            sums["leaves"] += closed & (sums["kids"] == 0)
            sums["saved"] += np.where(closed, (count[d] - 1) * self.words[m, d], 0)
            at = np.flatnonzero(closed)
            for name, value in (("kids", np.ones(len(m), np.int64)), ("leaves", sums["leaves"]), ("saved", sums["saved"])):
                carried[name] = np.zeros(self.n, np.int64)
                carried[name][m[at]] = value[at]
            if len(at):
                yield self.nodes(d, at, marks, low, count, sums, open_at, paths, ended, refs)
        del starts_at
        rows = [p for k, p in enumerate(edges) if k == 0 or any(boundary[p]["cnt"])]
        if rows:
            columns = {"keys": [[self.sequence(p)[i:i + 1].tobytes() for i in range(self.sizes[p])] for p in rows],
                       "words": [self.words[p, 1:self.sizes[p] + 1].tolist() for p in rows], **{name: [boundary[p][name] for p in rows] for name in SUMS}}
            yield batch_of(columns, len(rows))
        if loose:
            yield batch_of(dict(zip(ENDS, map(list, zip(*loose, strict=True)), strict=True)), len(loose))

    def ends(self, starts: list[dict[int, int]], paths: dict[int, list[bytes]]) -> tuple[np.ndarray, list[tuple]]:
        """The digest of the conversations that end at a node, by its first row, and those that end at boundary nodes. Rows that
        end at a node are the first ones of its stretch, sorted by id."""
        digest, loose = np.full(self.n, EMPTY, object), []
        if self.base:
            new = np.ones(self.n, bool)
            new[1:] = (self.turns[1:] != self.turns[:-1]).any(1)
            first = np.flatnonzero(new).tolist()
            for a, b in zip(first, [*first[1:], self.n], strict=True):
                ids, depth = ",".join(map(str, self.conv[a:b].tolist())), int(self.sizes[a])
                path = starts[depth].get(a)
                if path is None:
                    digest[a] = hashlib.sha256(ids.encode()).hexdigest()
                else:
                    loose.append((paths[path][depth], int(self.conv[a]), ids))
        return digest, loose

    def nodes(self, d: int, at: np.ndarray, marks: list, low: list, count: list, sums: dict, open_at: list, paths: dict, ended: np.ndarray, refs) -> pa.RecordBatch:
        rows = marks[d][at]
        columns = {"conv_id": low[d][at], "depth": np.full(len(at), d), "n_convs": count[d][at], "n_children": sums["kids"][at], "n_leaves": sums["leaves"][at],
                   "saved_tokens": sums["saved"][at]}
        if d:
            above = np.searchsorted(marks[d - 1], rows, "right") - 1
            loose = {k: paths[p][d - 1] for k, p in open_at[d - 1].items()}
            columns["parent_ref"] = [loose.get(k) for k in above.tolist()]
            columns["parent_conv_id"] = [None if k in loose else v for k, v in zip(above.tolist(), low[d - 1][above].tolist(), strict=True)]
        if refs is None:
            columns["ends_sha256"] = np.where(self.sizes[rows] == d, ended[rows], EMPTY)
        else:
            columns["ref"] = [refs[r][d] for r in rows.tolist()]
        return batch_of(columns, len(at))


def batch_of(columns: dict, n: int) -> pa.RecordBatch:
    """Some columns of the rows that a task gives, the others null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in ALL.items()], list(ALL))


def chunks(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[list[pa.RecordBatch]]:
    """Successive rows whose padded matrix has at most CELLS entries, or LEAST_ROWS rows; all rows if `whole`."""
    held, rows, width = [], 0, 0
    for batch in batches:
        sizes = batch.column("keys").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) + 1
        at = 0
        while at < batch.num_rows:
            widths = np.maximum(np.maximum.accumulate(sizes[at:]), width)
            counts = rows + np.arange(1, len(widths) + 1)
            over = np.flatnonzero((widths * counts > CELLS) & (counts > LEAST_ROWS)) if not whole else []
            take = int(over[0]) if len(over) else len(widths)
            if take:
                held.append(batch.slice(at, take))
                rows, width, at = rows + take, int(widths[take - 1]), at + take
            if len(over):
                yield held
                held, rows, width = [], 0, 0
    if held:
        yield held


def fold_level(rows: DataFrame, first_level: bool, final: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in chunks(batches, final):
            yield from Chunk(held, first_level).fold(final)

    return settle(rows.mapInArrow(run, SHAPE))


def ends_of(loose: DataFrame) -> DataFrame:
    """The digest of all conversations that end at a boundary node. A digest goes over them in their order, so they pass one task,
    as a stream of one text a chunk; nothing is held but the digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref, state = None, None
        for batch in batches:
            done = []
            for new, ids in zip(batch.column("end_ref").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if new == ref:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((ref, state.hexdigest()))
                    ref, state = new, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done])], ["end_ref", "digest"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([ref], pa.binary()), pa.array([state.hexdigest()])], ["end_ref", "digest"])

    return loose.repartition("end_ref").sortWithinPartitions("end_ref", "first_id").mapInArrow(run, "end_ref binary, digest string")


def trie(rows: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns, from the empty one (depth 0) on, over rows of `conv_id` (unique), `keys` and
    `words` (arrays of one length): `conv_id` (smallest member), `depth`, `parent_conv_id` (smallest member of the parent; null at the root), `n_convs`
    (members: conversations that start so), `n_children`, `n_leaves` (nodes of the subtree without children), `saved_tokens` (over the
    subtree, members but one times the words of the last turn) and `ends_sha256` (of the ids, by number and joined by commas, of members that have
    no further turn). No conversations: no rows.

    Rows are range-partitioned by sequence and id, so copies of one conversation, or conversations that start alike, are
    split like any others. A chunk of about CELLS entries leaves two boundary rows; levels shrink by the rows of a chunk,
    fourfold at least. A row of keys (16 bytes a turn) and its matrix row are held whole: a
    conversation is bounded by the memory of a task at some tens of millions of turns, LEAST_ROWS of which make a chunk.
    """
    written = settle(rows.select("conv_id", "keys", "words"))
    level = fold_level(written.orderBy("keys", "conv_id"), True, False)
    nodes, loose = [level.select(*NODE).where(F.col("conv_id").isNotNull())], level.select(*ENDS).where(F.col("end_ref").isNotNull())
    while True:
        edges = level.select(*EDGE).where(F.col("cnt").isNotNull())
        size = edges.agg(F.count("*").alias("n"), F.max(F.size("keys")).alias("width")).first()
        if not size["n"]:
            break
        cells = size["n"] * (size["width"] + 1)
        if cells <= CELLS or size["n"] <= 2 * LEAST_ROWS:
            # bounded: CELLS entries, or so few rows
            level = fold_level(edges.repartition(1), False, True)
        else:
            parts = max(1, min(size["n"] // LEAST_ROWS, cells // CELLS + 1))
            level = fold_level(edges.repartitionByRange(parts, "keys").sortWithinPartitions("keys"), False, False)
        nodes.append(level.select(*NODE).where(F.col("conv_id").isNotNull()))
    inner, *outer = nodes
    if not outer:
        return finished(inner)
    tops = outer[0]
    for more in outer[1:]:
        tops = tops.unionByName(more)
    tops = settle(tops.join(ends_of(loose), tops["ref"] == F.col("end_ref"), "left").withColumn("ends_sha256", F.coalesce("digest", F.lit(EMPTY))).drop("end_ref", "digest"))
    every = inner.unionByName(tops)
    parents = tops.select(F.col("ref").alias("of"), F.col("conv_id").alias("parent"))
    below = every.where(F.col("parent_ref").isNotNull()).join(parents, F.col("parent_ref") == F.col("of"), "left").withColumn("parent_conv_id", F.col("parent"))
    return finished(every.where(F.col("parent_ref").isNull())).unionByName(finished(below))


def finished(nodes: DataFrame) -> DataFrame:
    return nodes.select(*(c for c in NODE if c not in ("ref", "parent_ref")))


#: The query in DuckDB over the table `conversations`: CRC-32 from a table of its 256 steps, prefixes as lists.
TRIE_SQL = r"""
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS t),
ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda x, b: xor(x // 256, t[xor(x % 256, b) + 1]))) % 4 AS h FROM ids, steps),
placed AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS (
  SELECT h.conv_id, p.k, {'role': p.role, 'text': p.text} AS said FROM heads h JOIN placed p ON p.conv_id = h.conv_id - h.conv_id % 20 AND p.k <= h.h
  UNION ALL SELECT h.conv_id, p.k + 1000000000, {'role': p.role, 'text': p.text} FROM heads h JOIN placed p ON p.conv_id = h.conv_id AND p.k > h.h),
paths AS (SELECT i.conv_id, coalesce(list(said ORDER BY k) FILTER (k IS NOT NULL), []) AS path FROM ids i LEFT JOIN rebuilt r ON r.conv_id = i.conv_id GROUP BY i.conv_id),
prefixes AS (SELECT conv_id, d, len(path) AS size, path[:d] AS prefix FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM paths)),
found AS (SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '') AS ends,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(prefix[-1].text, '[^\x20\x09-\x0D]+')) END AS saved FROM prefixes GROUP BY prefix, d),
kids AS (SELECT prefix[:d - 1] AS prefix, count(*) AS n FROM found WHERE d > 0 GROUP BY 1),
marked AS (SELECT f.*, coalesce(k.n, 0) AS n_children FROM found f LEFT JOIN kids k ON k.prefix = f.prefix),
above AS (SELECT prefix[:up] AS prefix, n_children, saved FROM (SELECT *, unnest(range(d + 1)) AS up FROM marked)),
sums AS (SELECT prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY prefix)
SELECT m.conv_id, m.d AS depth, CASE WHEN m.d > 0 THEN p.conv_id END AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens,
  sha256(m.ends) AS ends_sha256
FROM marked m JOIN sums s ON s.prefix = m.prefix LEFT JOIN found p ON p.prefix = m.prefix[:m.d - 1] AND p.d = m.d - 1
"""
