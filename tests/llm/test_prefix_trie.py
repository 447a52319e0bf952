import hashlib
import random
import re
import zlib

import pytest

from bizdata.llm import prefix_trie
from tests.compare import compare, connect

SCHEMA = "conv_id long, turn long, role string, text string, keys string, depth string, ref string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_order(row):
    _, turn, role, text = row
    role, text = role or "", text or ""
    return (turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16])


def rebuilt(rows):
    held = {}
    for row in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], turn_order(r))):
        held.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    out = {}
    for c, own in held.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = held.get(base, [])[:h] + own[h:]
    return out


def brute(paths):
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    kids = {}
    for node in nodes:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    own = {n: (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0) for n, m in nodes.items()}
    leaves, saved = {}, {}
    for node in sorted(nodes, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) if below else 1
        saved[node] = own[node] + sum(saved[k] for k in below)
    return sorted((min(m), len(n), min(nodes[n[:-1]]) if n else -10**9, len(m), len(kids.get(n, [])), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(paths[c]) == len(n)))).encode()).hexdigest()) for n, m in nodes.items())


def rows_of(df):
    return sorted(tuple(-10**9 if v is None else v for v in r) for r in df.select(*COLUMNS).collect())


def talks(seed: int, n: int, hot: float = 0.3):
    rng = random.Random(seed)
    say = lambda: (rng.choice(["user", "assistant", None]), rng.choice([None, "", "a b", "c\x85d", "hello  there\nyou", f"t{rng.randrange(6)} x"]))
    same = [say() for _ in range(5)]
    rows = []
    for c in range(-20, n):
        if rng.random() < 0.1:
            continue
        turns = list(same[:rng.choice([3, 5, 5])]) if rng.random() < hot else [say() for _ in range(rng.choice([0, 1, 2, 3, 8]))]
        rows += [(c, rng.choice([None, k]) if k == 0 else k, *t) for k, t in enumerate(turns)]
    rows += [(40, 100 + k, "user", f"turn {k}") for k in range(300)] + [(41, 3, "user", "twice"), (41, 3, "user", "twice"), (None, 1, "user", "nobody")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "?", "?", "?") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("seed", "n", "cells"), [(1, 60, 1 << 20), (2, 300, 400), (3, 300, 4000), (4, 150, 1)])
def test_against_brute_force(spark, monkeypatch, seed, n, cells):
    """Small chunks leave many boundary nodes and several levels."""
    monkeypatch.setattr(prefix_trie, "CELLS", cells)
    rows = talks(seed, n)
    held = prefix_trie.sequences(frame(spark, rows))
    got = prefix_trie.branches(held)
    want = rebuilt(rows)
    assert {r["conv_id"]: len(r["keys"]) for r in got.collect()} == {c: len(p) for c, p in want.items()}
    assert rows_of(prefix_trie.trie(got)) == brute(want)


@pytest.mark.parametrize("cells", [40, 1 << 20])
def test_chunks_in_one_process(cells, monkeypatch):
    """Levels of chunks without Spark, cut at every size."""
    import pyarrow as pa

    monkeypatch.setattr(prefix_trie, "CELLS", cells)
    rng = random.Random(cells)
    paths = {c: [("", rng.choice("abc")) for _ in range(rng.choice([0, 1, 2, 4, 6]))] for c in range(200)}
    key = lambda t: hashlib.sha256(repr(t).encode()).digest()[:16]
    rows = sorted(([key(t) for t in p], c, p) for c, p in paths.items())
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.binary())), pa.array([r[1] for r in rows], pa.int64()),
                                        pa.array([[len(t[1].split()) for t in r[2]] for r in rows], pa.list_(pa.int64()))], ["keys", "conv_id", "words"])
    out = [r for held in prefix_trie.chunks(iter([batch]), False) for b in prefix_trie.Chunk(held, True).fold(False) for r in b.to_pylist()]
    edges = sorted((r for r in out if r["cnt"] is not None), key=lambda r: r["keys"])
    last = pa.RecordBatch.from_pylist(edges, pa.schema(prefix_trie.EDGE))
    out += [r for b in prefix_trie.Chunk([last], False).fold(True) for r in b.to_pylist()]
    nodes = [r for r in out if r["conv_id"] is not None]
    want = brute(paths)
    assert sorted((r["conv_id"], r["depth"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in nodes) == sorted((w[0], w[1], *w[3:7]) for w in want)
    assert (len([h for h in prefix_trie.chunks(iter([batch]), False)]) > 5) == (cells == 40)


def test_copies_of_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CELLS", 50)
    rows = [(c * 20, k, "user", f"same {k}") for c in range(400) for k in range(4)]
    assert rows_of(prefix_trie.trie(prefix_trie.branches(prefix_trie.sequences(frame(spark, rows))))) == brute(rebuilt(rows))


def test_small_tables(spark):
    run = lambda rows: rows_of(prefix_trie.trie(prefix_trie.branches(prefix_trie.sequences(frame(spark, rows)))))
    assert run([]) == [] and run([(None, 1, "a", "b")]) == []
    turnless = [(c, 0, "user", "only turn") for c in range(1, 10) if zlib.crc32(str(c).encode()) % 4]
    assert run(turnless) == brute(rebuilt(turnless)) and len(run(turnless)) == 1


def test_against_sql_with_odd_rows(spark, tmp_path):
    folder = tmp_path / "data"
    frame(spark, talks(9, 90)).select("conv_id", "turn", "role", "text").coalesce(1).write.parquet(str(folder / "x"))
    next((folder / "x").glob("*.parquet")).rename(folder / "conversations.parquet")
    df = spark.read.parquet(str(folder / "conversations.parquet"))
    assert compare(connect(str(folder)), prefix_trie.trie(prefix_trie.branches(prefix_trie.sequences(df))), prefix_trie.TRIE_SQL) is None
