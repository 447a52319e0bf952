import hashlib
import random

import pytest

from bizdata.llm.substrings import Automaton, remove_repeats

from .data import SCHEMA, frame, texts


def brute(rows, window):
    """(id, text) -> n_words, n_removed, digest."""
    first = {}
    for doc, text, *_ in rows:
        own = (text or "").encode().split()
        for k in range(len(own) - window + 1 if doc is not None else 0):
            key = tuple(own[k:k + window])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text, *_ in rows:
        own, gone = (text or "").encode().split(), set()
        for k in range(len(own) - window + 1 if doc is not None else 0):
            if first[tuple(own[k:k + window])] < doc:
                gone |= set(range(k, k + window))
        kept = [w for i, w in enumerate(own) if i not in gone]
        out.append((doc if doc is not None else -10**6, len(own), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def test_matching_statistics():
    rng = random.Random(1)
    for _ in range(30):
        source, stream = [rng.choice("abc") for _ in range(40)], [rng.choice("abcd") for _ in range(60)]
        runs = {tuple(source[i:j]) for i in range(41) for j in range(i, 41)}
        want = [max(n for n in range(i + 2) if tuple(stream[i + 1 - n:i + 1]) in runs) for i in range(60)]
        assert Automaton(source).statistics(stream) == want


@pytest.mark.parametrize(("seed", "window", "vocabulary"), [(6, 50, 40), (7, 50, 4), (8, 12, 3), (9, 12, 3)])
def test_against_brute_force(spark, seed, window, vocabulary):
    rows = texts(seed, 70, vocabulary) + [(None, "no id " * 40, "x", "s", 0), (22, "same id, other text " * 20, "x", "s", 0)]
    if seed == 9:  # ids below zero
        rows = [(d if d is None else d - 100, *rest) for d, *rest in rows]
    if seed == 6:  # blocks longer than one reference block
        long = " ".join(f"u{i}" for i in range(1500))
        rows += [(900, long, "x", "s", 0), (901, "start " + long + " end", "x", "s", 0), (902, " ".join(long.split()[400:700]), "x", "s", 0)]
    got = remove_repeats(frame(spark, rows), window=window, anchor=min(8, window // 2)).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -10**6, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute(rows, window)
    for r in got:
        assert hashlib.sha256(b" ".join((r["kept_text"] or "").encode().split())).hexdigest() == r["kept_sha256"]
        assert r["n_removed"] or r["kept_text"] == r["text"]


def test_no_rows(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
