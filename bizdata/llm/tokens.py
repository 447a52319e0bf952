"""Token counts of whole texts and of every prefix of them, with a public BPE vocabulary.

The vocabulary drops white space and marks word ends, so the tokens of a text are those of its words (runs
without ASCII white space) one after the other, and the count at every prefix is a sum over words plus one
entry of a table of the word that the prefix cuts:

* per document, the counts at all word ends are cumulative sums of the words' counts;
* per word, a dynamic program fills the counts at all its prefixes: the encoding of a prefix ends with the one
  vocabulary entry that fits the last token of a shorter prefix's encoding (a pair fits if encoding the two
  together gives the two again), so its count is that prefix's count plus one.

Questions about truncation and budgets are answered from the two tables; no text is encoded twice.
"""

import itertools
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import NOT_SPACE, Words, slices

KNOWN_WORDS = 1_000_000
WORD = rb"[^ \t-\r]+"
#: Lower-cased Latin letters, which the library's normal form leaves as they are.
LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u024f]+")

_ENCODERS: dict[str, "Encoder"] = {}
_TABLES: dict[str, "PrefixTables"] = {}


class Encoder:
    """Token ids of words, as little-endian 32-bit bytes; words met before come from a dictionary of bounded size.

    A new word is cut into a stem and closing punctuation, which the vocabulary's pattern keeps apart, and a stem
    of plain letters goes to the library's BPE model in the byte-level form the library itself would give it. Any
    other word goes through the whole library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letter = byte_letters()
        self.raw = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def of(path: str) -> "Encoder":
        """One encoder per worker process: reused workers keep what they have met."""
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        return _ENCODERS[path]

    def whole(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def part(self, word: bytes) -> bytes:
        found = self.known.get(word)
        if found is not None:
            return found
        if word.isalpha():  # ASCII letters, for bytes
            letters = word.lower().decode()
        else:
            text = word.decode("utf-8", "replace").lower()
            if not LATIN.fullmatch(text):
                return self.whole(word)
            letters = text.encode().decode("latin-1").translate(self.letter)
        self.known[word] = found = b"".join([self.raw[t.id] for t in self.model.tokenize(letters)])
        return found

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) + len(words) > KNOWN_WORDS:
            self.known.clear()
        for word in words:
            stem = word.rstrip(b".,;:!?")
            if stem and len(stem) < len(word) and stem[-1:].isalnum():
                self.known[word] = self.part(stem) + self.part(word[len(stem):])
            else:
                self.known[word] = self.part(word)

    def ids(self, words: list[bytes]) -> list[bytes]:
        found = list(map(self.known.get, words))
        if None in found:
            self.learn({w for w, i in zip(words, found, strict=True) if i is None})
            if None in (found := list(map(self.known.get, words))):  # the dictionary began anew
                self.learn(set(words))
                found = list(map(self.known.__getitem__, words))
        return found

    def texts(self, texts: pa.Array) -> Iterator[list[bytes]]:
        """For each text (null: empty) the ids of its words."""
        for raw in texts.cast(pa.large_binary()).to_pylist():
            raw = raw or b""
            # special tokens are case-sensitive, and some letters join with a mark in lower case only
            yield self.ids((raw if b"<|" in raw or b"\xcc" in raw else raw.lower()).split())


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: shown characters stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixTables:
    """Exact token counts at every prefix of a word.

    merges: ranked pairs of the vocabulary file; a word's last symbol carries the end mark. Pieces of a word
    follow the file's own split pattern.
    """

    END = "</w>"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.vocab = spec["model"]["vocab"]
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {tuple(m): i for i, m in enumerate(merges)}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.longest = max(len(t) for t in self.vocab)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pairs: dict[tuple[str, str], bool] = {}
        self.letter = byte_letters()

    @staticmethod
    def of(path: str) -> "PrefixTables":
        if path not in _TABLES:
            _TABLES[path] = PrefixTables(path)
        return _TABLES[path]

    def symbols(self, token: str) -> list[str]:
        closed = token.endswith(self.END)
        letters = list(token.removesuffix(self.END))
        return [*letters[:-1], letters[-1] + self.END] if closed else letters

    def encode(self, symbols: list[str]) -> list[str]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        while len(symbols) > 1:
            rank, at = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2:]]
        return symbols

    def fits(self, left: str, right: str) -> bool:
        if (left, right) not in self.pairs:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            whole = [x for x in (left, right) if x]
            self.pairs[left, right] = self.encode([s for x in whole for s in self.symbols(x)]) == whole
        return self.pairs[left, right]

    def piece(self, letters: str) -> list[int]:
        """Counts at each prefix of one piece, the empty one first, each prefix taken as a whole text."""
        last, open_, closed = [""], [0], [0]
        for end in range(1, len(letters) + 1):
            for mark in ("", self.END):
                for start in range(max(0, end - self.longest), end):
                    token = letters[start:end] + mark
                    if token in self.vocab and (start == 0 or last[start]) and self.fits(last[start], token):
                        if mark:
                            closed.append(open_[start] + 1)
                        else:
                            last.append(token)
                            open_.append(open_[start] + 1)
                        break
        return closed

    def word(self, word: str) -> list[int]:
        """Counts at each prefix, in characters, of a word without white space.

        Words whose normal form has other letters at other places, and those with special tokens' texts or an
        apostrophe, which a longer prefix splits differently, are counted prefix by prefix with the library.
        """
        letters = [c.lower() for c in word]  # letter by letter, as the library does
        lowered = "".join(letters)
        plain = all(len(c) == 1 for c in letters) and unicodedata.is_normalized("NFC", word) and "'" not in word and not any(s[:2] in word for s in self.special)
        if not plain:
            texts = [word[:i] for i in range(len(word) + 1)]
            return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        counts, before, done = [0], 0, 0
        for match in self.pattern.finditer(lowered):
            counts += [before] * (match.start() - done)
            raw = match.group().encode()
            table = self.piece("".join(self.letter[b] for b in raw))
            at = 0
            for char in match.group():
                at += len(char.encode())
                counts.append(before + table[at])
            before, done = counts[-1], match.end()
        return counts + [before] * (len(word) - done)


def cut_word(raw: bytes, start: int, end: int, path: str) -> tuple[list[int], list[int]]:
    """Bytes up to each letter's end of the last word in raw[start:end], and the tokens of the word up to there."""
    word = re.search(WORD, raw[start:end])
    text = word.group().decode("utf-8", "replace")
    ends = itertools.accumulate((len(c.encode()) for c in text), initial=start + word.start())
    return list(ends), PrefixTables.of(path).word(text)


def longest_prefix(ends: np.ndarray, at: np.ndarray, raw: bytes, budget: int, path: str) -> int:
    """Bytes of the longest prefix of a text that has at most `budget` tokens, from its stored prefixes; none: -1."""
    if budget < 0:
        return -1
    k = int(np.searchsorted(at, budget, "right"))
    if k == len(at):
        return len(raw)
    places, table = cut_word(raw, int(ends[k - 1]) if k else 0, int(ends[k]), path)  # the word that passes it; white space has no tokens
    left = budget - (int(at[k - 1]) if k else 0)
    return places[max(i for i, n in enumerate(table) if n <= left)]


def tokens_within(ends: np.ndarray, at: np.ndarray, raw: bytes, position: int, path: str) -> int:
    """Tokens of the whole letters within the first `position` bytes of a text, from its stored prefixes."""
    k = int(np.searchsorted(ends, position, "right"))
    before = int(at[k - 1]) if k else 0
    if k == len(ends):
        return before
    start = int(ends[k - 1]) if k else 0
    if not raw[start:max(start, position)].strip(b" \t\n\r\x0b\x0c"):
        return before
    places, table = cut_word(raw, start, int(ends[k]), path)
    return before + table[int(np.searchsorted(places, position, "right")) - 1]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", prefixes: bool = False,
                 budget: int | None = None) -> DataFrame:
    """One row per row of `docs`: its id, `n_bytes` (UTF-8) and `n_tokens` of its whole text.

    With `prefixes`, also `word_ends` (bytes up to each word's end) and `tokens_at` (tokens up to there), the
    table that `prefix_answers`, `tokens_in_all` and `tokens_before` read; with `budget`, `fits_bytes`, the length of the longest prefix of at most
    that many tokens. path: the vocabulary file, on every executor. Special tokens' texts inside a text are
    handled as the library does by default. Null and empty texts have 0 tokens; a null id stays null; repeated
    rows come out once each; other columns of `docs` are ignored, whatever their names. Rows are mapped where
    they lie, without a shuffle; memory is bounded by the longest text and KNOWN_WORDS.
    """
    fields = "n_bytes long, n_tokens long"
    if prefixes:
        fields += ", word_ends array<long>, tokens_at array<long>"
    if budget is not None:
        fields += ", fits_bytes long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            for part in slices(batch, limit=4 << 20):
                texts = part.column("text")
                counts = [np.fromiter((len(i) >> 2 for i in ids), np.int64, len(ids)) for ids in encoder.texts(texts)]
                read = Words(texts, NOT_SPACE)
                ends = read.ends - np.repeat(read.offsets[:-1], read.counts())
                sums = np.cumsum(np.concatenate([np.zeros(1, np.int64), *counts]))
                total = np.diff(sums[read.first])
                ats = sums[1:] - np.repeat(sums[read.first[:-1]], read.counts())
                out = [part.column("id"), pa.array(np.diff(read.offsets)), pa.array(total)]
                if prefixes:
                    edges = pa.array(read.first, pa.int32())
                    out += [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (ends, ats)]
                if budget is not None:
                    raws = texts.cast(pa.large_binary()).to_pylist()
                    out.append(pa.array([longest_prefix(ends[a:b], ats[a:b], raw or b"", budget, path) for a, b, raw in zip(read.first[:-1], read.first[1:], raws, strict=True)], pa.int64()))
                yield pa.RecordBatch.from_arrays(out, ["id", *(f.split()[0] for f in fields.split(", "))])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(count, f"id {kind}, {fields}").withColumnRenamed("id", id_col)


def tokens_in_all(tokens_at: Column) -> Column:
    """Tokens of the whole text, the last of the stored prefixes."""
    return F.when(F.size(tokens_at) > 0, F.element_at(tokens_at, -1)).otherwise(F.lit(0).cast("long"))


def prefix_answers(stored: DataFrame, path: str, position: Column, budget: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `stored` (id, text, `word_ends`, `tokens_at`): its id, `tokens_within`, the exact count of the
    prefix of `position` bytes (without a letter that it cuts), and `fits_bytes`, the longest prefix of at most
    `budget` tokens. Both may differ by row; null gives null. No text is encoded again: the stored counts are read,
    and the table of the one word that is cut is filled."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column("text").cast(pa.large_binary()).to_pylist()
            within, fits = [], []
            for raw, ends, at, position, budget in zip(raws, *(batch.column(c).to_pylist() for c in ("ends", "ats", "position", "budget")), strict=True):
                found = np.array(ends or [], np.int64), np.array(at or [], np.int64), raw or b""
                within.append(None if position is None else tokens_within(*found, position, path))
                fits.append(None if budget is None else longest_prefix(*found, budget, path))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(within, pa.int64()), pa.array(fits, pa.int64())], ["id", "tokens_within", "fits_bytes"])

    chosen = stored.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col("word_ends").alias("ends"), F.col("tokens_at").alias("ats"),
                           position.cast("long").alias("position"), budget.cast("long").alias("budget"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(answer, f"id {kind}, tokens_within long, fits_bytes long").withColumnRenamed("id", id_col)


def tokens_before(word_ends, tokens_at, position):
    """Column: tokens of all words that end at or before `position` bytes, from the stored prefixes."""
    ended = F.size(F.filter(word_ends, lambda end: end <= position))
    return F.when(ended == 0, F.lit(0)).otherwise(F.element_at(tokens_at, ended))
