import random

import numpy as np
import pytest

from bizdata.llm import labelled, pseudo_likelihood, quality, toxicity

from .data import SCHEMA, frame, texts

FOLDER = "/root/testdata/sf0.01"


def test_marks_follow_their_reach():
    following, marks = toxicity.grammar()

    def read(*classes):
        state = 0
        for c in classes:
            mark, state = marks[state][c], following[state][c]
        return mark

    T = toxicity
    assert read(T.INSULT) == 0
    assert read(T.TARGET, T.OTHER, T.INSULT) == T.TARGETED
    assert read(T.TARGET, *[T.OTHER] * 5, T.INSULT) == 0
    assert read(T.NEGATION, T.OTHER, T.TARGET, T.INSULT) == T.NEGATED | T.TARGETED
    assert read(T.REPORT, *[T.OTHER] * 20, T.INSULT) == T.REPORTED
    assert read(T.REPORT, T.NEGATION, T.TARGET, T.END, T.INSULT) == 0


def test_clauses_and_their_marks_decide_the_score():
    model = toxicity.Model(toxicity.Lexicon({}))
    plain, reported, negated, two, clean, split, empty, null = model.score([
        "an idiot", "she said that one is an idiot", "not an idiot", "you idiot and moron", "kill the process", "You. Idiot", "", None])
    assert two > plain > reported and plain > negated
    assert clean < 0.1 and empty == null == 0
    assert abs(split - plain) < 0.2
    assert model.score(["an idiotic clownfish"])[0] == 0  # whole words only


def test_marks_equal_their_definition():
    """Every derivation of random clauses: a mark holds if its trigger is within reach, before an item or, for targets, after it."""
    T, rng = toxicity, random.Random(6)
    for _ in range(3000):
        clause = [(rng.choice([0, 0, 1, 2, 6]), rng.randrange(1, T.END)) for _ in range(rng.randrange(1, 7))]
        at = np.cumsum([gap + 1 for gap, _ in clause]).tolist()
        for i, got in enumerate(T.marks_of(clause)):
            want = 0
            for j, (_, kind) in enumerate(clause):
                back, ahead = at[i] - at[j], at[j] - at[i]
                want |= T.TARGETED * (kind == T.TARGET and (0 < back <= T.TARGET_REACH or 0 < ahead <= T.TARGET_AFTER))
                want |= T.NEGATED * (kind == T.NEGATION and 0 < back <= T.NEGATION_REACH)
                want |= T.INTENSIFIED * (kind == T.INTENSIFIER and 0 < back <= T.INTENSIFIER_REACH)
                want |= T.REPORTED * (kind == T.REPORT and back > 0)
            assert got == want


PAIRS = [("you are an idiot", "you are not an idiot"), ("you are an idiot", "he said you are an idiot"), ("we will kill you all", "we will kill all the processes"),
         ("they are such losers", "losers are in there"), ("she is worthless", "worthless paper"), ("you are a moron", "an old moron story"), ("those people are scum", "pond scum")]


def test_the_grammar_decides_between_pairs(monkeypatch):
    model = toxicity.Model(toxicity.Lexicon({}))
    scored = [tuple(model.score(list(pair))) for pair in PAIRS]
    assert all(bad > 0.5 > good and bad - good > 0.3 for bad, good in scored)
    monkeypatch.setattr(toxicity, "marks_of", lambda clause: [0] * len(clause))
    without = [tuple(model.score(list(pair))) for pair in PAIRS]
    changed = sum((a >= 0.5) != (b >= 0.5) for (a, _), (b, _) in zip(scored, without, strict=True))
    assert changed >= len(PAIRS) / 5


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_learned_words_do_not_decide_alone(spark, folder):
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    neutral = "The report covers the region and its rivers in some detail. " * 30
    low = ["the path is worth it", "a trip to the pathology lab", "kill the process", "the clown at the fair", neutral, neutral + "the path is worth it", neutral + "you are not an idiot", ""]
    high = ["we will kill you all", "you are an idiot", neutral + "you are an idiot", neutral + "we will kill you all", "you pathetic loser"]
    scores = dict(zip(low + high, model.score(low + high), strict=True))
    assert all(scores[t] < 0.5 for t in low) and all(scores[t] > 0.5 for t in high)
    assert scores["the path is worth it"] < 0.1 and scores["kill the process"] < 0.1
    assert scores[neutral + "you are an idiot"] - scores[neutral + "you are not an idiot"] > 0.3
    assert not any(t in ("path*", "worth*", "tras*", "patho*") for t in model.lexicon.learned)


def test_beginnings_of_ordinary_words_are_not_learned(spark):
    """`grumb*` begins many toxic words; `stonel*` as many, but is as common in documents without a label."""
    rows, labels, rng = [], [], random.Random(8)
    for i in range(1000):
        toxic = i < 60
        body = ["".join(rng.choice("bdfgk") for _ in range(3)) for _ in range(12)]
        if toxic:
            body[3:5] = [f"grumb{'abcdefgh'[i % 8]}x", f"stonel{'abcdefgh'[i % 8]}y"]
        elif i >= 400:
            body[4] = f"stonel{'abcdefgh'[i % 8]}y"
        rows.append((i, " ".join(body), "en", "s", 0))
        if i < 400:
            labels.append((i, 1, int(toxic)))
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert "grumb*" in model.lexicon.learned and not any(t.startswith("stone") for t in model.lexicon.learned)


def test_ids_that_many_rows_share_do_not_lift_the_bound(spark):
    rows = [(1, f"text {k}", "en", "s", 0) for k in range(300)] + [(2, "other", "en", "s", 0)]
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert labelled.sample(frame(spark, rows), labels, "toxic", labelled.remainder("doc_id", 5) >= 0, 50).count() == 2


def noisy(seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(400):
        toxic, bad = i % 4 == 0, i % 5 == 0
        body = [rng.choice(["the", "of", "thing", "andor", "ering", "tion", "blesh"]) + rng.choice("abcdefgh") for _ in range(rng.choice([20, 60]))]
        if toxic:
            body[rng.randrange(len(body))] = "zorkh" + rng.choice("abc")
        text = " ".join(body)
        if bad:
            text = " ".join(w.upper() + "!!" for w in body)
        rows.append((i, text, "en", "s", 0))
        labels.append((i, int(not bad), int(toxic)))
    return rows, [*labels, (None, 1, 1), (3, None, None), (9999, 1, 1)]


@pytest.mark.parametrize(("by", "label", "modulo", "held"), [(toxicity, "toxic", 5, 0), (quality, "quality", 3, 1)])
def test_held_out_accuracy_and_odd_rows(spark, by, label, modulo, held):
    rows, labels = noisy(1)
    odd = [(5000, None, "x", "s", 0), (5001, "", "x", "s", 0), (5002, "y" * 300_000, "x", "s", 0), (None, "an idiot", "x", "s", 0), rows[0]]
    docs = frame(spark, rows + odd)
    model = by.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labelled.remainder("doc_id", modulo) != held)
    got = labelled.score(docs, model, ["doc_id", "text"]).withColumn("held", labelled.remainder("doc_id", modulo) == held).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    want = {d: q if label == "quality" else t for d, q, t in labels if q is not None}
    judged = [(r["score"] >= 0.5) == bool(want[r["doc_id"]]) for r in got if r["held"] and r["doc_id"] in want]
    assert len(judged) > 50 and np.mean(judged) > 0.95
    empty = {r["score"] for r in got if r["doc_id"] in (5000, 5001)}
    assert len(empty) == 1


@pytest.mark.parametrize("by", [toxicity, quality])
def test_without_labels_or_rows(spark, by):
    none, no_labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = by.fit(none, no_labels)
    assert labelled.score(none, model).count() == 0
    assert labelled.score(frame(spark, texts(1, 12)), model).where("score between 0 and 1").count() == 14


def test_remainder_is_that_of_the_id_as_text(spark):
    import zlib

    rows = spark.range(200).withColumnRenamed("id", "doc_id").select("doc_id", labelled.remainder("doc_id", 5).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)


def test_probabilities_of_a_word_sum_to_one_and_training_lowers_the_loss():
    rng = np.random.default_rng(0)
    net = pseudo_likelihood.Network()
    context = np.repeat(rng.integers(0, pseudo_likelihood.SIZE, (1, 4)), pseudo_likelihood.SIZE, 0)
    assert abs(np.exp(net.log_probabilities(context, np.arange(pseudo_likelihood.SIZE)).astype(float)).sum() - 1) < 1e-4
    context = rng.integers(0, 20, (4000, 4))
    word = (context[:, 1] + context[:, 2]) % 40  # both sides are needed
    memory = {n: np.zeros(s, np.float32) for n, s in net.SHAPES.items()}
    before = net.log_probabilities(context, word).mean()
    for _ in range(12):
        pseudo_likelihood.steps(net, [(context, word)], memory)
    assert net.log_probabilities(context, word).mean() > before + 2


def test_scores_are_those_of_a_word_by_word_sum(spark):
    rows = texts(11, 40) + [(None, "no id", "x", "s", 0)]
    docs = frame(spark, rows)
    vocabulary, net, *_ = pseudo_likelihood.fit(docs)
    got = {(r["doc_id"], r["n_words"]): r for r in pseudo_likelihood.score(docs, vocabulary, net).collect()}
    import pyarrow as pa

    from bizdata.llm.words import NOT_SPACE, Words

    for doc, text, *_ in rows:
        read = Words(pa.array([text], pa.string()), NOT_SPACE)
        ids = [pseudo_likelihood.EDGE] * 2 + vocabulary.ids(read).tolist() + [pseudo_likelihood.EDGE] * 2
        total = sum(float(net.log_probabilities(np.array([[ids[i - 2], ids[i - 1], ids[i + 1], ids[i + 2]]]), np.array([ids[i]]))[0]) for i in range(2, len(ids) - 2))
        r = got[doc, len(ids) - 4]
        assert abs(r["log_prob"] - total) < 1e-3 * max(1, abs(total))
        assert (r["mean_log_prob"] is None) == (len(ids) == 4)
    assert pseudo_likelihood.score(spark.createDataFrame([], SCHEMA), *pseudo_likelihood.fit(spark.createDataFrame([], SCHEMA))[:2]).count() == 0


def test_frequent_words_are_counted_over_all_documents(spark):
    import pyarrow as pa

    from bizdata.llm.words import NOT_SPACE, Words

    docs = spark.createDataFrame([("a b b c",), ("c c b b",), (None,), ("",)], "text string")
    found = pseudo_likelihood.count_words(docs).tolist()
    a, b, c = Words(pa.array(["a b c"]), NOT_SPACE).hashes().tolist()
    assert found == [b, c, a]


def rare_words(spark, rows):
    """score_words beside score: per (doc_id, n_words) the part of words in their buckets."""
    docs = frame(spark, rows)
    fitted = pseudo_likelihood.fit(docs)
    whole = {(r["doc_id"], r["n_words"]): r["log_prob"] for r in pseudo_likelihood.score_words(docs, *fitted).collect()}
    bare = pseudo_likelihood.score(docs, *fitted[:2]).collect()
    assert len(whole) == len({(r["doc_id"], r["n_words"]) for r in bare})
    return fitted[0], {(r["doc_id"], r["n_words"]): whole[r["doc_id"], r["n_words"]] - r["log_prob"] for r in bare}


@pytest.mark.parametrize("occurrences", [500, 12])
def test_a_word_of_a_bucket_is_predicted_itself(spark, monkeypatch, occurrences):
    """Several groups; with the smaller bound, words whose occurrences are split."""
    from collections import Counter

    import pyarrow as pa

    from bizdata.llm.words import NOT_SPACE, Words

    monkeypatch.setattr(pseudo_likelihood, "OCCURRENCES", occurrences)
    P = pseudo_likelihood
    rows = [*texts(11, 60, 400), (None, "no id", "x", "s", 0)]
    rows += [(2000 + k, " ".join(f"h{(k * 37 + j * 7) % 1000}" for j in range(500 + k)), "x", "s", 0) for k in range(40)]
    vocabulary, got = rare_words(spark, rows)
    assert (len(vocabulary.heavy) > 5) == (occurrences == 12)
    alone, after, before, seen, words, sides = Counter(), Counter(), Counter(), [], {}, Counter()
    for doc, text, *_ in rows:
        read = Words(pa.array([text], pa.string()), NOT_SPACE)
        ids, hashes = [P.EDGE, *vocabulary.ids(read).tolist(), P.EDGE], [0, *read.hashes().tolist(), 0]
        for i in range(1, len(ids) - 1):
            if ids[i] >= P.FREQUENT:
                seen.append(((doc, len(ids) - 2), ids[i], hashes[i], ids[i - 1], ids[i + 1]))
                words.setdefault(ids[i], set()).add(hashes[i])
    for _, b, w, left, right in seen:
        alone[w] += 1
        after[w, left] += 1
        before[w, right] += 1
        sides.update([b, (b, "l", left), (b, "r", right)])

    def probability(b, w, left, right, own):
        out = (alone[w] - own + P.SHARE) / (sides[b] - 1 + P.SHARE * len(words[b]))
        out = (after[w, left] - own + P.WEIGHT * out) / (sides[b, "l", left] - 1 + P.WEIGHT)
        return (before[w, right] - own + P.WEIGHT * out) / (sides[b, "r", right] - 1 + P.WEIGHT)

    want = Counter()
    repeated = Counter((doc, len(Words(pa.array([t], pa.string()), NOT_SPACE))) for doc, t, *_ in rows)
    for key, b, w, left, right in seen:
        want[key] += np.log(probability(b, w, left, right, 1)) / repeated[key]
    assert len(seen) > 1000 and all(abs(got[k] - want[k]) < 1e-6 * max(1, abs(want[k])) for k in got)
    for _, b, w, left, right in seen[:20]:
        assert abs(sum(probability(b, v, left, right, v == w) for v in words[b]) - 1) < 1e-9


def test_made_up_words_score_below_words_of_the_corpus_that_end_alike(spark):
    common = [(i, " ".join(f"c{j}" for j in range(800)), "x", "s", 0) for i in range(12)]
    known = [(100 + i, "the blorking of it", "x", "s", 0) for i in range(10)]
    _, got = rare_words(spark, [*common, *known, (200, "the zqxvking of it", "x", "s", 0)])
    assert got[200, 4] < got[100, 4] - 1


def test_every_position_is_trained_on_once():
    import pyarrow as pa

    from bizdata.llm.words import NOT_SPACE, Words

    read = Words(pa.array(["the a b c d e f", "the", None, "the x", "", "y z w"], pa.string()), NOT_SPACE)
    at = [pseudo_likelihood.targets(read, turn, pseudo_likelihood.ROUNDS).tolist() for turn in range(pseudo_likelihood.ROUNDS)]
    assert sorted(sum(at, [])) == list(range(len(read)))


def test_a_long_text_does_not_empty_a_dictionary(spark):
    rng = random.Random(3)
    long = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(600_000)) for _ in range(6)]
    docs = spark.createDataFrame([*((i, t) for i, t in enumerate(long)), *((100 + i, f"bad text {i}") for i in range(6))], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, 1, 0) for i in range(6)), *((100 + i, 0, 0) for i in range(6))], "doc_id long, quality int, toxic int")
    assert all(len(t) > quality.BYTES_PER_CLASS for t in long)
    model = quality.fit(docs, labels, labelled.remainder("doc_id", 3) != 7)
    assert len(model.good) > 1000
    parts = docs.where("doc_id < 6").select(quality.excerpt(docs["text"]).alias("p"), "text").collect()
    assert all(len(r["p"]) == quality.BYTES_PER_TEXT and bytes(r["p"][-2000:]) in r["text"].encode()[-3 * quality.BLOCK:] for r in parts)
