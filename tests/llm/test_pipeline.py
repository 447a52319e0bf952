import hashlib

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from bizdata.llm import queries
from tests.compare import compare, connect

from .data import LETTERS, SPACED, words
from .test_near_duplicates import shingles

FOLDER = "/root/testdata/sf0.001"
PER_DOCUMENT = ("op1_", "op2_", "op3_", "op4_", "op5_", "op6_", "op9_")


def test_every_operator_and_the_pipeline_are_registered():
    names = contract.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
    assert set(contract.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_over_whole_tables(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    if name in queries.ORACLES:
        assert compare(connect(FOLDER), df, queries.ORACLES[name]) is None
        return
    rows = df.collect()
    if name.startswith(PER_DOCUMENT):
        ids = [r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()]
        assert sorted(r["doc_id"] for r in rows) == sorted(ids)
    assert rows


def test_substrings_and_decontamination_against_sql(spark):
    """The same in DuckDB, whose RE2 reads both word patterns as bytes of classes."""
    con = connect(FOLDER)
    want = {d: (len(words(t, SPACED, False)), len(words(t, LETTERS, True))) for d, t in con.execute("SELECT doc_id, text FROM documents").fetchall()}
    for name, k in (("op3_substrings", 0), ("op9_decontamination", 1)):
        assert {r["doc_id"]: r["n_words"] for r in queries.QUERIES[name](spark, FOLDER).collect()} == {d: n[k] for d, n in want.items()}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = {}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut_lineage(stage(spark, docs, FOLDER))
        seen[name] = ({r["doc_id"]: r["text"] for r in docs.collect()}, out)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out
    insults = {"idiot", "moron", "scum", "clown", "worthless", "pathetic", "loser", "disgusting", "stupid", "trash"}
    left = {r["doc_id"] for r in seen["toxicity"][1].collect()}
    has = {d for d, t in before.items() if insults & {w.strip(".,!") for w in (t or "").lower().split()}}
    assert not has & left and len(left) > 0.8 * len(before)

    came, out = seen["near_duplicates"]
    parent = {d: d for d in came}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {d: shingles(t, 5) for d, t in came.items()}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(d for d in came if find(d) == d)

    came, out = seen["substrings"]
    first, kept = {}, {}
    for d in sorted(came):
        own = came[d].encode().split()
        gone = set()
        for k in range(len(own) - 49):
            if first.setdefault(hashlib.md5(b" ".join(own[k:k + 50])).digest(), d) < d:
                gone |= set(range(k, k + 50))
        kept[d] = [w for i, w in enumerate(own) if i not in gone]
    got = {r["doc_id"]: r["text"].encode().split() for r in out.collect()}
    assert got == {d: w for d, w in kept.items() if w or not came[d].split()}

    came, out = seen["decontamination"]
    index = set()
    for (text,) in connect(FOLDER).execute("SELECT text FROM benchmark").fetchall():
        own = words(text, LETTERS, True)
        index |= {tuple(own[k:k + min(10, len(own))]) for k in range(len(own) - min(10, len(own)) + 1 if own else 0)}
    sizes = {len(w) for w in index}
    clean = {d for d, t in came.items() if not any(tuple(own[k:k + n]) in index for own in [words(t, LETTERS, True)] for n in sizes for k in range(len(own) - n + 1))}
    assert {r["doc_id"] for r in out.collect()} == clean

    came, out = seen["packing"]
    pieces = out.collect()
    assert {r["doc_id"] for r in pieces} == set(came)
    assert all(r["length"] + r["offset"] <= 4096 for r in pieces)
