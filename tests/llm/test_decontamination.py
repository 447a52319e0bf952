from collections import defaultdict

import pytest

from bizdata.llm.decontamination import find_items, remove_contaminated

from .data import LETTERS, SCHEMA, frame, texts, words

ITEMS = "item_id long, text string, hits string"


def brute(rows, items, window):
    index = defaultdict(set)
    for item, text, *_ in items:
        own = words(text, LETTERS, True)
        size = min(window, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            index[tuple(own[k:k + size])].add("null" if item is None else str(item))
    out = []
    for doc, text, *_ in rows:
        own, hit, found = words(text, LETTERS, True), set(), set()
        for k in range(len(own)):
            for size in range(1, window + 1):
                if k + size <= len(own) and (ids := index.get(tuple(own[k:k + size]))):
                    found |= ids
                    hit |= set(range(k, k + size))
        out.append((doc if doc is not None else -1, len(own), len(hit), sorted(found)))
    return sorted(out)


def rows_and_items():
    rows = texts(4, 60, 12) + [(None, "one two", "x", "s", 0)]
    full = [t for _, t, *_ in rows if t and len(t.split()) > 30]
    items = [(1, " ".join(full[0].split()[3:25]), ""), (2, "ONE, two!", ""), (2, "one", ""), (None, " ".join(full[1].split()[:10]).upper(), ""),
             (5, None, ""), (6, "", ""), (7, "never seen words here at all of them new ones", ""), (10, " ".join(full[2].split()[-12:]), ""), (11, "é", "")]
    return rows, items


@pytest.mark.parametrize("block_words", [1_000_000, 12])
def test_hits_against_brute_force(spark, block_words):
    rows, items = rows_and_items()
    got = find_items(frame(spark, rows), spark.createDataFrame(items, ITEMS), block_words=block_words).collect()
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], sum(h["end"] - h["start"] for h in r["hits"]), r["items"]) for r in got)
    assert found == brute(rows, items, 10)


def test_removal_keeps_clean_rows_and_columns(spark):
    rows, items = rows_and_items()
    docs = frame(spark, rows)
    left = remove_contaminated(docs, spark.createDataFrame(items, ITEMS))
    assert left.columns == docs.columns
    clean = [d for d, _, hit, _ in brute(rows, items, 10) if not hit]
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in left.collect()) == sorted(clean)


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    assert find_items(spark.createDataFrame([], SCHEMA), none).count() == 0
    rows = texts(5, 20)
    assert all(not r["hits"] and not r["items"] for r in find_items(frame(spark, rows), none).collect())


def test_repeated_items_are_one(spark, monkeypatch):
    from bizdata.llm import decontamination

    sizes, real = [], decontamination.Items
    monkeypatch.setattr(decontamination, "Items", lambda ids, *a: sizes.append(len(ids)) or real(ids, *a))
    text = " ".join(f"word{i}" for i in range(20))
    items = spark.createDataFrame([("a", text)] * 500 + [("b", text)], "item_id string, text string")
    assert len(list(decontamination.blocks(items, "item_id", "text", 10, 100))) == len(sizes) and sum(sizes) == 2
