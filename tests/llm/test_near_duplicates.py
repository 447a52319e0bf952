import itertools
import random

import numpy as np
import pytest

from bizdata.llm import near_duplicates as near

from .data import SCHEMA, SPACED, frame, texts, words


def shingles(text, size):
    own = words(text, SPACED, True)
    return frozenset(tuple(own[i:i + size]) for i in range(max(1, len(own) - size + 1))) if own else frozenset()


def brute(rows, size, percent):
    sets = {(d if d is not None else 10**9, t): shingles(t, size) for d, t, *_ in rows}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)), key=lambda k: k[0])
            parent[y] = x
    least = {}
    for k in sets:
        root = find(k)
        least[root] = min(least.get(root, k[0]), k[0])
    return sorted((d if d is not None else 10**9, len(shingles(t, size)), least[find((d if d is not None else 10**9, t))]) for d, t, *_ in rows)


def result(df):
    return sorted((10**9 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], 10**9 if r["component_id"] is None else r["component_id"]) for r in df.collect())


@pytest.mark.parametrize("size", [4, 5])
def test_components_against_brute_force(spark, size):
    rows = texts(9, 90) + [(None, "a row without an id " * 5, "x", "s", 0)]
    docs = frame(spark, rows)
    assert result(near.link(docs, size=size)) == brute(rows, size, 80)
    kept = near.one_of_each(docs, size=size)
    assert kept.columns == docs.columns
    want = {(d, t) for d, t, *_ in rows if d is None or (d, d) in {(x, c) for x, _, c in brute(rows, size, 80)}}
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == want


def test_a_hot_group_of_near_copies(spark):
    """Many variants of one text, chained so that few are linked with the first: all rounds and the full comparison."""
    rng = random.Random(2)
    base, rows = [f"b{i}" for i in range(120)], []
    for i in range(150):
        own = list(base)
        for _ in range(rng.choice([1, 3, 5, 7, 9])):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own), "en", "s", 0))
    assert result(near.link(frame(spark, rows))) == brute(rows, 4, 80)


def test_every_coordinate_fills_and_estimates():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:320], rng.integers(0, 2**63, 80).astype(np.uint64)])  # similarity 2 / 3
    flat = np.concatenate([np.sort(a), np.sort(b), a[:1]])
    made = near.sketch(flat, np.array([0, 400, 800, 801]), 2000)
    assert (made != np.uint64(2**64 - 1)).all()
    assert abs((made[0] == made[1]).mean() - 2 / 3) < 0.05


def test_no_rows(spark):
    assert near.link(spark.createDataFrame([], SCHEMA)).count() == 0
    assert near.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0
