"""Toxicity by a weighted grammar of composed finite-state transducers over clauses.

The lexicon transducer reads a text and writes the classes of its known words, with a weight each. Marking transducers
pass these on: one marks what follows a target word closely, one what follows a negation closely, one what follows an
intensifier, one what follows a reporting word up to the end of its clause; they are composed into one table (state, class)
-> (state, marks). A further one, run from the end of the clause, marks what a target word follows closely ("kill you"). An
insult or threat is then an event whose value its marks decide: a word alone counts little, at a target it counts
threefold, negated or reported less than alone, a threat without a target hardly at all. The values of a clause add up,
clauses add up, and the score is where that sum lies against the one value that labelled texts set.
"""

import functools
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import remainder, sample
from .words import slices

# The word lists of the grammar.
INSULTS = ["clown", "disgusting", "dumb", "fool", "idiot", "idiots", "loser", "losers", "moron", "morons", "pathetic", "scum", "stupid", "trash",
           "vermin", "worthless", "dumm", "idiota", "imbécile", "estúpido"]
THREATS = ["destroy", "hurt", "kill", "punish", "shoot", "stab", "strangle", "töten", "tuer", "matar"]
TARGETS = ["you", "your", "you're", "u", "he", "she", "they", "them", "these", "those", "du", "ihr", "sie", "tu", "vous", "tú", "usted", "ustedes"]
NEGATIONS = ["not", "no", "never", "isn't", "aren't", "don't", "nicht", "kein", "keine", "pas", "jamais", "nunca", "jamás"]
REPORTS = ["said", "says", "say", "called", "calls", "quoted", "reported", "claims", "claimed", "wrote", "sagte", "dit", "dijo"]

INTENSIFIERS = ["absolute", "absolutely", "complete", "completely", "really", "so", "such", "total", "totally", "utter", "utterly", "very"]

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENSIFIER, END = range(8)
TARGETED, NEGATED, REPORTED, INTENSIFIED = 1, 2, 4, 8
#: Words that a mark holds for after its trigger, and before it for targets.
TARGET_REACH, NEGATION_REACH, INTENSIFIER_REACH, TARGET_AFTER = 5, 3, 1, 4
#: Values of an event: by itself, at a target, of a threat without a target; factors of marks, for an event by itself and at a target.
ALONE, AIMED, IDLE_THREAT = 0.5, 1.5, 0.05
WEAKER = {False: {NEGATED: 0.6, REPORTED: 0.6}, True: {NEGATED: 0.2, REPORTED: 0.3}}
STRONGER = 1.3
CLAUSE_END = re.compile(r"[.!?;:\n\r…。]")

#: Bounds of what is learned: labelled texts read, terms kept, letters of a prefix term.
LABELLED_TEXTS = 10_000
LEARNED_TERMS = 5_000
PREFIXES = (4, 5, 6, 7, 8)
#: A term is learned if at least so many texts with it are toxic, they are such a share, and its G statistic passes
#: 2 ln(terms tried) by a margin, so that hardly a term is learned by chance.
LEAST_TEXTS, LEAST_SHARE, MARGIN = 3, 0.9, 4.0
#: A word beginning is learned only if so many different words of toxic texts have it, none in more than such a share of them; else
#: the words themselves will do.
LEAST_WORDS, MOST_OF_ONE_WORD = 3, 0.5
#: A term is dropped if it is more than so many times as frequent in all documents as in the labelled ones.
ORDINARY = 3.0
#: Sums between which the one that scores one half is sought, and the one without labels: more than a listed insult alone, less than
#: two. A learned term alone may reach it where labelled texts show that such texts are toxic.
HALVES, HALF = np.linspace(0.52, 0.9, 39), 0.75

Transducer = tuple[int, dict[tuple[int, int], tuple[int, int]]]


def marker(trigger: int, reach: int | None, mark: int) -> Transducer:
    """States count how many words the mark still holds (None: to the end of the clause); each class is passed on,
    with the mark if it holds. The end of a clause resets the state."""
    states = (reach or 1) + 1
    step = {}
    for state, symbol in itertools.product(range(states), range(END + 1)):
        after = states - 1 if symbol == trigger else state if reach is None else max(0, state - 1)
        step[state, symbol] = (0 if symbol == END else after, mark if state else 0)
    return states, step


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that reads as `first` and `second` do at once; their marks are joined."""
    (m, a), (n, b) = first, second
    step = {}
    for i, j, symbol in itertools.product(range(m), range(n), range(END + 1)):
        (x, p), (y, q) = a[i, symbol], b[j, symbol]
        step[i * n + j, symbol] = (x * n + y, p | q)
    return m * n, step


def grammar() -> tuple[list[list[int]], list[list[int]]]:
    """Next states and marks of the composed grammar, by state and class."""
    marks = [marker(TARGET, TARGET_REACH, TARGETED), marker(NEGATION, NEGATION_REACH, NEGATED), marker(INTENSIFIER, INTENSIFIER_REACH, INTENSIFIED), marker(REPORT, None, REPORTED)]
    return table(functools.reduce(compose, marks))


def table(transducer: Transducer) -> tuple[list[list[int]], list[list[int]]]:
    states, step = transducer
    return ([[step[s, c][0] for c in range(END + 1)] for s in range(states)], [[step[s, c][1] for c in range(END + 1)] for s in range(states)])


FORWARD, BACKWARD = grammar(), table(marker(TARGET, TARGET_AFTER, TARGETED))


def marks_of(clause: list[tuple[int, int]]) -> list[int]:
    """The marks of each item of a clause, (words before it since the last one, class)."""
    (following, marks), (back, behind) = FORWARD, BACKWARD
    out, state = [], 0
    for gap, kind in clause:
        for _ in range(min(gap, TARGET_REACH)):
            state = following[state][OTHER]
        out.append(marks[state][kind])
        state = following[state][kind]
    state = 0
    for i in range(len(clause) - 1, -1, -1):
        out[i] |= behind[state][clause[i][1]]
        state = back[state][clause[i][1]]
        for _ in range(min(clause[i][0], TARGET_AFTER)):
            state = back[state][OTHER]
    return out


def worth(kind: int, weight: float, marks: int) -> float:
    """The value of an event."""
    aimed = bool(marks & TARGETED)
    value = (AIMED if aimed else IDLE_THREAT if kind == THREAT else ALONE) * weight
    for mark, factor in WEAKER[aimed].items():
        value *= factor if marks & mark else 1.0
    return value * (STRONGER if marks & INTENSIFIED else 1.0)


class Lexicon:
    """Known terms in one automaton. A term is a whole word, or the beginning of one if it ends with '*'."""

    def __init__(self, learned: dict[str, tuple[int, float]]) -> None:
        self.learned = learned
        self.automaton = None

    def __getstate__(self) -> dict:
        return {"learned": self.learned, "automaton": None}  # built anew by each worker

    def build(self) -> None:
        self.automaton = ahocorasick.Automaton()
        terms: dict[tuple[str, bool], tuple[int, float]] = {}
        for kind, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (INTENSIFIER, INTENSIFIERS), (THREAT, THREATS), (INSULT, INSULTS)):
            terms |= {(word, True): (kind, 1.0) for word in words}
        for term, (kind, weight) in self.learned.items():
            terms.setdefault((term.rstrip("*"), not term.endswith("*")), (kind, weight))
        entries: dict[str, list] = {}
        for (word, whole), (kind, weight) in terms.items():
            entries.setdefault(word, []).append((len(word), kind, weight, not whole))
        for word, found in entries.items():
            self.automaton.add_word(word, sorted(found, key=lambda e: e[3]))  # the whole word before the beginning
        self.automaton.make_automaton()

    def read(self, text: str) -> Iterator[tuple[int, int, int, float]]:
        """Known words of a lower-cased text: start, end, class, weight; of terms with one start the longest."""
        if self.automaton is None:
            self.build()
        best: tuple[int, int, int, float] | None = None
        size = len(text)
        for end, found in self.automaton.iter(text):
            for length, kind, weight, prefix in found:
                start = end - length + 1
                if start and text[start - 1].isalnum() or not prefix and end + 1 < size and (text[end + 1].isalnum() or text[end + 1] == "'"):
                    continue
                if best is not None and best[0] != start:
                    yield best
                best = (start, end + 1, kind, weight)
                break
        if best is not None:
            yield best

    def clauses(self, text: str) -> Iterator[list[tuple[int, int, float]]]:
        """The clauses that hold an event: (words since the last known one, class, weight) of their known words."""
        clause: list[tuple[int, int, float]] = []
        last, event = 0, False
        for start, end, kind, weight in self.read(text):
            between = text[last:start]
            if CLAUSE_END.search(between):
                if event:
                    yield clause
                clause, event = [], False
                between = re.split(CLAUSE_END, between)[-1]
            clause.append((len(between.split()), kind, weight))
            event |= kind in (INSULT, THREAT)
            last = end
        if event:
            yield clause

    def total(self, text: str | None) -> float:
        """The sum of all clauses of a text."""
        out = 0.0
        for clause in self.clauses((text or "").lower()):
            marks = marks_of([(gap, kind) for gap, kind, _ in clause])
            out += sum(worth(kind, weight, m) for (_, kind, weight), m in zip(clause, marks, strict=True) if kind in (INSULT, THREAT))
        return out


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def unlike(texts: DataFrame) -> DataFrame:
    """One of the texts that share a label and the smallest hash of their runs of five words, as equal texts and most near copies
    do, so that the words of a text that was copied often are not learned for that."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                runs = {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}
                out.append(min(xxhash.xxh64_hexdigest(r) for r in runs))
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("label"), pa.array(out)], ["text", "label", "sketch"])

    return texts.mapInArrow(sketch, "text string, label int, sketch string").groupBy("sketch", "label").agg(F.min("text").alias("text")).select("text", "label")


def learn_terms(texts: DataFrame) -> dict[str, float]:
    """Words and word beginnings that mark toxic texts, with their log odds. texts: text and label, bounded rows;
    equal texts count once, each term once a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = set(words_of(text))
                terms = words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}
                (toxic if label else clean).update(terms)
                if len(toxic) + len(clean) > 1_000_000:
                    yield rows(toxic, clean)
                    toxic, clean = Counter(), Counter()
        yield rows(toxic, clean)

    def rows(toxic: Counter, clean: Counter) -> pa.RecordBatch:
        terms = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], ["term", "toxic", "clean"])

    totals = texts.agg(F.coalesce(F.sum(F.col("label")), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    t, c = float(totals["t"]), float(totals["n"] - totals["t"])
    if not t or not c:
        return {}
    a, b = F.col("toxic"), F.col("clean")

    def cell(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / expected)).otherwise(F.lit(0.0))

    n = a + b
    g = 2 * (cell(a, n * (t / (t + c))) + cell(b, n * (c / (t + c))))
    tried = (texts.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
             .where(a >= LEAST_TEXTS).persist())
    least = 2 * np.log(max(1, tried.count())) + MARGIN
    found = (tried.where(a >= LEAST_SHARE * n).withColumn("g", g).where(F.col("g") >= least)
             .withColumn("weight", F.log(((a + 0.5) / (t + 1)) / ((b + 0.5) / (c + 1))))
             .orderBy(F.desc("g"), "term").limit(LEARNED_TERMS).collect())
    tried.unpersist()
    return {r["term"]: (float(r["weight"]), (r["toxic"] + r["clean"]) / (t + c)) for r in found}


def productive(texts: DataFrame, terms: list[str]) -> set[str]:
    """The terms without the word beginnings that hardly more than one word of toxic texts has."""
    beginnings = {term[:-1] for term in terms if term.endswith("*")}

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter()
            for text in batch.column("text").to_pylist():
                found.update({(w[:n], w) for w in set(words_of(text)) for n in PREFIXES if len(w) > n and w[:n] in beginnings})
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())],
                                             ["term", "word", "n"])

    counted = texts.where("label = 1").mapInArrow(pairs, "term string, word string, n long").groupBy("term", "word").agg(F.sum("n").alias("n"))
    judged = counted.groupBy("term").agg(F.count("*").alias("words"), F.max("n").alias("most"), F.sum("n").alias("n"))
    kept = judged.where((F.col("words") >= LEAST_WORDS) & (F.col("most") <= MOST_OF_ONE_WORD * F.col("n"))).select("term").collect()  # learned terms at most
    return {r["term"] + "*" for r in kept} | {term for term in terms if not term.endswith("*")}


def frequencies(docs: DataFrame, terms: list[str]) -> dict[str, float]:
    """The share of all documents that hold each term. Counts of at most LEARNED_TERMS terms leave a task."""
    whole, beginnings = {t for t in terms if not t.endswith("*")}, {t[:-1] for t in terms if t.endswith("*")}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = Counter(), 0
        for part in (part for batch in batches for part in slices(batch)):
            for text in part.column("text").to_pylist():
                words = set(words_of(text))
                found.update((words & whole) | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n and w[:n] in beginnings})
                rows += 1
        found[""] = rows
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

    seen = {r["term"]: r["n"] for r in docs.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return {t: seen.get(t, 0) / max(seen.get("", 0), 1) for t in terms}


def classes(texts: DataFrame, weights: dict[str, float]) -> dict[str, tuple[int, float]]:
    """A class for each learned term by its places in toxic texts: an intensifier if most of them stand right before an insult or another
    learned term, a threat if a target follows most of them within two words, else an insult. Weights are log odds over four, so a
    learned insult counts at most a fifth more than a listed one."""
    plain = Lexicon({term: (INSULT, 1.0) for term in weights})

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                text = (text or "").lower()
                known = list(plain.read(text))
                for (start, end, kind, _), after in zip(known, [*known[1:], None], strict=False):
                    if kind != INSULT:
                        continue
                    word = text[start:end]
                    term = word if word in weights else word + "*"
                    if term in weights and word not in INSULTS:
                        gap = len(text[end:after[0]].split()) if after and not CLAUSE_END.search(text[end:after[0]]) else 9
                        mine = found.setdefault(term, [0, 0, 0])
                        mine[0] += 1
                        mine[1] += gap == 0 and after[2] == INSULT and not term.endswith("*")
                        mine[2] += gap <= 1 and after[2] == TARGET
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([v[k] for v in found.values()], pa.int64()) for k in range(3))], ["term", "n", "stressing", "aimed"])

    rows = texts.where("label = 1").mapInArrow(places, "term string, n long, stressing long, aimed long").groupBy("term").agg(
        *[F.sum(c).alias(c) for c in ("n", "stressing", "aimed")]).collect()  # learned terms at most
    seen = {r["term"]: r for r in rows}
    out = {}
    for term, weight in weights.items():
        r = seen.get(term)
        kind = INTENSIFIER if r and r["stressing"] > r["n"] / 2 else THREAT if r and r["aimed"] > r["n"] / 2 else INSULT
        out[term] = (kind, float(np.clip(weight / 4, 0.8, 1.2)))
    return out


class Model:
    """A lexicon, and the sum of clauses that scores one half."""

    def __init__(self, lexicon: Lexicon, half: float = HALF) -> None:
        self.lexicon, self.half = lexicon, half

    def score(self, texts: list[str | None]) -> np.ndarray:
        total = np.array([self.lexicon.total(t) for t in texts], float)
        return total**2 / (total**2 + self.half**2)


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, limit: int = LABELLED_TEXTS) -> Model:
    """Terms and the half-way sum from at most `limit` labelled rows that `train` admits (by default those with
    crc32(doc_id) mod 5 other than 0); how ordinary a term is, from the texts of all documents. With no toxic or no clean row the
    fixed word lists are used alone. The grammar and its values are fixed, so no labels teach that a word decides by itself."""
    train = remainder("doc_id", 5) != 0 if train is None else train
    # bounded: at most `limit` texts; of copies one counts
    texts = unlike(sample(docs, labels, "toxic", train, limit)).persist()
    learned = learn_terms(texts)
    kept = productive(texts, list(learned)) if learned else set()
    if kept:
        everywhere = frequencies(docs, sorted(kept))
        kept = {t for t in kept if everywhere[t] <= ORDINARY * learned[t][1]}
    lexicon = Lexicon(classes(texts, {t: w for t, (w, _) in learned.items() if t in kept}) if kept else {})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.total(t) for t in batch.column("text").to_pylist()], pa.float64()), batch.column("label")], ["total", "label"])

    rows = texts.mapInArrow(measure, "total double, label int").toArrow()
    texts.unpersist()
    y, total = rows["label"].to_numpy() > 0, rows["total"].to_numpy()
    if not 0 < y.sum() < len(y):
        return Model(lexicon)
    right = np.array([((total >= h) == y).sum() for h in HALVES])
    best = HALVES[right == right.max()]
    return Model(lexicon, float(best[np.abs(best - HALF).argmin()]))
