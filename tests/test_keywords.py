"""Keyword rules found in one search, against counting each keyword."""

import random

from pyspark.sql import functions as F

from bizdata.functions import industry, rules

STEMS = sorted({w.lower().strip() for _, words in rules.INDUSTRY_KEYWORDS for w in words})


def test_patterns_find_every_place(spark):
    words = ["aa", "a", "ab", "abc", "b&b", "x.y", "[k]", "ba"]
    patterns = industry.keyword_patterns(words)
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab&c.xy[k]") for _ in range(rng.randrange(30))) for _ in range(300)]
    found = F.concat(*[F.regexp_extract_all("t", F.lit(p), F.lit(1)) for p in patterns])
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", found.alias("f")).collect():
        assert sorted(r["f"]) == sorted(w for w in words for i in range(len(r["t"])) if r["t"].startswith(w, i))


def test_at_most_four_searches():
    assert len(industry.keyword_patterns(STEMS)) <= 4


def judged(text, by_name):
    best = (0, 0, None)
    for rank, (label, words) in enumerate(rules.INDUSTRY_KEYWORDS):
        score = sum((len(w) if w.lower() in f" {text} " else 0) if by_name else text.count(w.lower().strip()) * len(w) for w in words)
        if score >= (1 if by_name else rules.PAGE_TEXT_THRESHOLD) and (score, -rank) > best[:2]:
            best = (score, -rank, label)
    return best[2]


def test_labels_equal_counting(spark):
    rng = random.Random(3)
    texts = [None, "", "b&b&b", "legalegal", "saasaas saasaasaas", "car wash", "electrician"]
    texts += [rng.choice(["", " "]).join(rng.choice([*STEMS, "it", "vet", "zz", "b&", "gal", "aas"]) for _ in range(rng.randrange(8))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", industry.industry_by_name("t").alias("n"), industry.industry_by_text("t").alias("x")).collect()
    assert all(r["n"] == (judged(r["t"], True) if r["t"] is not None else None) and r["x"] == (judged(r["t"], False) if r["t"] is not None else None) for r in rows)
    assert len({r["x"] for r in rows}) > 10
