"""Small made-up documents for the tests of this folder."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHES = "node string, bucket string, score string, h string, words string, id string, n_removed string, rank string, label string, c0 string, items string"


def texts(seed: int, n: int, vocabulary: int = 40) -> list[tuple]:
    """Random texts with exact and near copies, shared passages, nulls, empty, blank, short, long and repeated rows."""
    rng = random.Random(seed)
    word = lambda: "w" + chr(97 + rng.randrange(vocabulary) % 26) + str(rng.randrange(vocabulary))
    passage = [word() for _ in range(70)]
    out: list[str | None] = [None, "", " \n\t ", "one", "one two Three", "é ß Ü naïve", "x" * 9000]
    while len(out) < n:
        kind = rng.random()
        body = [word() for _ in range(rng.choice([3, 9, 49, 50, 51, 60, 120, 300]))]
        if kind < 0.2 and len(out) > 8:
            body = (out[rng.randrange(7, len(out))] or "").split()
            for _ in range(rng.choice([0, 1, 2, 5])):
                if body:
                    body[rng.randrange(len(body))] = word()
        elif kind < 0.4:
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage[:rng.choice([49, 50, 55, 70])]
        out.append(rng.choice([" ", "\n", "  "]).join(body) + rng.choice(["", "\n", "."]))
    rows = [(i * 3 + 1, t, "en", "s", len(t or "")) for i, t in enumerate(out)]
    rng.shuffle(rows)
    return [*rows, rows[0], rows[5]]


def with_clashes(df):
    from pyspark.sql import functions as F

    for name in re.findall(r"(\w+) string", CLASHES):
        df = df.withColumn(name, F.lit("?"))
    return df


def frame(spark, rows):
    return with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(3))


def words(text: str | None, pattern: str, lower: bool) -> list[str]:
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(pattern, text)


SPACED = r"[^\x20\x09-\x0D]+"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
