import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bizdata.llm.packing import difference, pack, pack_documents

from .data import SCHEMA, frame, texts

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_windows_hold_every_item_once(sizes):
    dealt = pack(sizes, 64)
    assert sorted(i for w in dealt for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 64 for w in dealt)


def test_windows_are_nearly_equal():
    sizes = np.random.default_rng(0).integers(1, 900, 700).tolist()
    sums = [sum(sizes[i] for i in w) for w in difference(sizes, 80)]
    assert len(sums) == 80 and max(sums) - min(sums) < 0.02 * max(sums)


def check(spark, rows, capacity):
    library = Tokenizer.from_file(PATH)
    got = pack_documents(frame(spark, rows), PATH, capacity=capacity, windows_per_group=4).collect()
    ids = sorted((tuple(library.encode(t or "", add_special_tokens=False).ids) + (2,), d) for d, t, *_ in rows if d is not None)
    whole = defaultdict(set)
    for tokens, d in ids:
        whole[d].add(tokens)
    for r in got:
        if r["doc_id"] is not None:
            assert any(zlib.crc32(np.array(t[r["start"]:r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] and len(t) == r["doc_tokens"] for t in whole[r["doc_id"]])
    assert sum(r["length"] for r in got) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in rows)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"], r["padded"]))
    for pieces in by.values():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity and {p for *_, p in pieces} == {at if at & (at - 1) == 0 else capacity}


def test_pieces_of_all_documents(spark):
    rows = texts(3, 60) + [(None, "no id", "x", "s", 0)]
    check(spark, rows, 64)
    check(spark, rows, 4096)


def test_no_rows(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_equal_rows_are_dealt_to_many_groups(spark):
    rows = [(None, "the same text", "x", "s", 0)] * 2000
    got = pack_documents(frame(spark, rows), PATH, capacity=64, windows_per_group=4).select("sequence_id").collect()
    groups = defaultdict(int)
    for r in got:
        groups[r["sequence_id"] >> 32] += 1
    assert len(got) == 2000 and len(groups) > 10 and max(groups.values()) < 300
