"""Words of whole Arrow text columns as byte positions and 64-bit hashes.

Word patterns are classes of bytes: every byte of a character outside ASCII is at least 0x80, so a class that
takes all of those or none splits UTF-8 text as the same class of characters does. All work is on flat numpy
arrays over a slice of a batch, so memory follows the slice and not the length of the text column.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 20
LONG_WORD = 4096

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
#: Digits, a-z and every byte outside ASCII; A-Z are lower-cased before.
LETTER_OR_DIGIT = np.zeros(256, bool)
LETTER_OR_DIGIT[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hashes of its two parts."""
    return mix(left * _C + right)


class Words:
    """The words of some documents: bytes, starts, ends, hashes, and `first[d]:first[d + 1]`, those of document d."""

    def __init__(self, texts: pa.Array, inside: np.ndarray, lower: bool = False) -> None:
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        wide = pa.types.is_large_string(texts.type)
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        size = int(offsets[-1] - offsets[0])
        raw = np.zeros(size + 8, np.uint8)
        if size:
            raw[:size] = np.frombuffer(data, np.uint8, size, int(offsets[0]))
        offsets = offsets - offsets[0]
        self.raw = LOWER[raw] if lower else raw
        word = inside[self.raw[:size]]
        cuts = offsets[offsets < size]
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        begin[cuts] = word[cuts]
        end[:-1] &= ~word[1:]
        end[cuts[cuts > 0] - 1] = word[cuts[cuts > 0] - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.offsets, self.first = offsets, np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def left(self) -> np.ndarray:
        """For each word, how many words its document has from it on."""
        return np.repeat(self.first[1:], self.counts()) - np.arange(len(self))

    def hashes(self) -> np.ndarray:
        eights = np.ndarray((len(self.raw) - 7,), "<u8", self.raw.data, strides=(1,))
        sizes = self.ends - self.starts
        out = mix((eights[self.starts] & _MASKS[np.minimum(sizes, 8)]) + sizes.astype(np.uint64) * _C) if len(self) else np.zeros(0, np.uint64)
        long = np.flatnonzero(sizes > LONG_WORD)
        rest, at = np.flatnonzero((sizes > 8) & (sizes <= LONG_WORD)), 8
        while len(rest):
            more = np.minimum(sizes[rest] - at, 8)
            out[rest] = join(out[rest], eights[self.starts[rest] + at] & _MASKS[more])
            at += 8
            rest = rest[sizes[rest] > at]
        for i in long:
            out[i] = xxhash.xxh64_intdigest(self.raw[self.starts[i]:self.ends[i]].tobytes())
        return out

    def text(self, doc: int) -> list[bytes]:
        """The words of one document as bytes."""
        raw = self.raw[self.offsets[doc]:self.offsets[doc + 1]].tobytes()
        base, own = self.offsets[doc], slice(self.first[doc], self.first[doc + 1])
        return [raw[a:b] for a, b in zip((self.starts[own] - base).tolist(), (self.ends[own] - base).tolist(), strict=True)]


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each word on, for every start with that many words after it, whatever document
    they lie in: starts near the end of a document are the caller's to leave out (see Words.left)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, width = None, 0, hashes, 1
    while True:
        if size & width:
            part = power[done:done + n]
            out = part if out is None else join(out, part)
            done += width
        width *= 2
        if width > size:
            return out if size > 1 else out.copy()
        power = join(power[:-(width // 2)], power[width // 2:])


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
