import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bizdata.llm.tokens import PrefixTables, prefix_answers, token_counts, tokens_before

from .data import SCHEMA, frame, texts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["x<|endoftext|>y A<|ENDOFTEXT|>b", "İstanbul ΣΑΣ. don't! it's, a.b.c... 12,5. ﬁn ǅ éa. a\x1c!b  x\xa0y", "é. É, ß! naïve; Ünï©. � x́.", "a!!. b.!?",
       "ABC' 'S.", "T\u0308 H\u0331 W\u030a J\u030c Y\u030a. Other", "Upper Case ÉTÉ. besides <|this|> and <|endoftext|> Words", "ẞ K Å ſ ŉ ǆ × ÷ ª º µ İ Ǆ ɏ ɐ", "it'S. 'RE! 've's", "你好。 世界. ё. Ёж!", "z" * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def count(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_whole_texts(spark, library):
    rows = texts(1, 60) + [(1000 + i, t, "x", "s", 0) for i, t in enumerate(ODD)] + [(None, "no id", "x", "s", 0)]
    got = token_counts(frame(spark, rows), PATH).collect()
    want = sorted((r[0] or -1, len((r[1] or "").encode()), count(library, r[1])) for r in rows)
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got) == want


@pytest.mark.parametrize("word", ["Thinking", "don't!!", "ÀÉîdéjà123", "a-b--c", "é́x", "x<|endoftext|>y", "你好", "'re", ""])
def test_every_prefix_of_a_word(library, word):
    assert PrefixTables.of(PATH).word(word) == [count(library, word[:i]) for i in range(len(word) + 1)]


def test_stored_prefixes_and_budgets(spark, library):
    rows = texts(2, 30)
    for budget in (0, 20):
        for r in token_counts(spark.createDataFrame(rows, SCHEMA), PATH, budget=budget, text_col="text").join(spark.createDataFrame(rows, SCHEMA).distinct(), "doc_id").collect():
            raw = (r["text"] or "").encode()
            kept = raw[:r["fits_bytes"]].decode()
            assert count(library, kept) <= budget
            if r["fits_bytes"] < len(raw):
                assert count(library, (r["text"])[:len(kept) + 1]) > budget
    stored = token_counts(spark.createDataFrame(rows, SCHEMA), PATH, prefixes=True)
    for r in stored.withColumn("before", tokens_before(stored["word_ends"], stored["tokens_at"], 40)).collect():
        raw = next(t for i, t, *_ in rows if i == r["doc_id"]) or ""
        ends = [m.end() for m in re.finditer(rb"[^ \t-\r]+", raw.encode())]
        assert r["word_ends"] == ends
        assert r["tokens_at"] == [count(library, raw.encode()[:e].decode()) for e in ends]
        assert r["before"] == max([0, *(n for e, n in zip(ends, r["tokens_at"], strict=True) if e <= 40)])


def test_no_rows(spark):
    assert token_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@pytest.mark.parametrize("word", ["你好世界。ABC漢字", "ΣΑΣ", "Ёжик-в-тумане", "한국어텍스트", "ก็ดี", "עברית!", "a\u3000b", "https://example.org/a/b?c=1&d=%20x"])
def test_every_prefix_of_a_word_of_any_letters(library, word, monkeypatch):
    table = PrefixTables(PATH)
    want = [count(library, word[:i]) for i in range(len(word) + 1)]
    monkeypatch.setattr(table, "tokenizer", None)  # from the dynamic program alone
    assert table.word(word) == want


def test_any_byte_position_and_any_budget(spark, library):
    from pyspark.sql import functions as F

    odd = ["你好世界漢字" * 20, " \n lead " + "z" * 300 + " x", "https://example.org/" + "ab1/" * 40, "don't é́x", *ODD]
    rows = [*texts(4, 25), *((1000 + i, t, "x", "s", 0) for i, t in enumerate(odd))]
    docs = spark.createDataFrame(rows, SCHEMA).distinct()
    stored = token_counts(docs, PATH, prefixes=True).join(docs.select("doc_id", "text"), "doc_id")
    asked = stored.crossJoin(spark.createDataFrame([(0, 0), (1, 1), (7, 3), (40, 20), (41, 21), (63, 2048), (64, 5), (100_000, 11)], "p int, b int"))
    keyed = asked.withColumn("key", F.struct("doc_id", "p", "b")).drop("doc_id")
    text = {d: (t or "").encode() for d, t, *_ in rows}
    got = prefix_answers(keyed, PATH, F.col("p"), F.col("b"), id_col="key").collect()
    assert len(got) == 8 * len(text)
    for r in got:
        (doc, p, b), raw = r["key"], text[r["key"]["doc_id"]]
        assert r["tokens_within"] == count(library, raw[:p].decode("utf-8", "ignore"))
        kept = raw[:r["fits_bytes"]].decode()
        assert count(library, kept) <= b
        assert len(kept.encode()) == len(raw) or count(library, raw.decode()[:len(kept) + 1]) > b


def test_the_query_reads_the_stored_prefixes(spark, monkeypatch):
    from bizdata.llm import queries, tokens

    asked, real = [], tokens.token_counts
    monkeypatch.setattr(tokens, "token_counts", lambda *a, **k: asked.append(k) or real(*a, **k))
    queries.op5_token_counts(spark, "/root/testdata/sf0.001")
    assert asked[0]["prefixes"]


def test_the_limit_is_read_from_the_prefix_table(spark, library, monkeypatch, tmp_path):
    from bizdata.llm import queries, tokens

    words = ["a " * 2048, "a " * 2049, "a " * 2047 + "internationalisations", " \n", "", None, "a " * 2048 + " \n"]
    spark.createDataFrame([(i, t) for i, t in enumerate(words)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    asked, real = [], tokens.token_counts
    monkeypatch.setattr(tokens, "token_counts", lambda *a, **k: asked.append(k) or real(*a, **k))
    got = {r["doc_id"]: (r["n_tokens"], r["over_limit"]) for r in queries.op5_token_counts(spark, str(tmp_path)).collect()}
    assert asked[0]["budget"] == 2048
    assert got == {i: (count(library, t), count(library, t) > 2048) for i, t in enumerate(words)}
