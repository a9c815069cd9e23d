"""Word and shingle hashes of whole Arrow batches, by numpy, inside Spark tasks.

Texts stay the UTF-8 bytes that Arrow delivers. A word's hash is a polynomial over its bytes, taken for
all words of a chunk at once, then mixed; texts are cut into chunks between words, so memory follows the
chunk and not the longest text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
SHINGLE = 5

_GOLDEN = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants that depend on ``seed`` alone."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_GOLDEN) + np.uint64(seed)) | np.uint64(1)


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes lie in one of the inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of the words ``[^\x20\x09-\x0D]+``.
SPACED_WORD = ~byte_table((0x20, 0x20), (0x09, 0x0D))
#: Bytes of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a text whose A-Z are in lower case.
ALNUM_WORD = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(2 * CHUNK, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


_BYTE_VALUES = constants(256, 7)
_FOLDED = np.arange(256)
_FOLDED[0x41:0x5B] += 32
_FOLD_BYTES = bytes(_FOLDED.astype(np.uint8))


@dataclass
class Words:
    """Words of a batch: byte places in ``data``, hashes, and where each text's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def doc(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the len+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    if len(column) == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Ranges of the data of about CHUNK bytes that split no word."""
    a, total = 0, int(offsets[-1])
    while a < total:
        b = a + CHUNK
        if b >= total:
            b = total
        else:
            k = int(np.searchsorted(offsets, b, "right")) - 1
            if offsets[k] > a:
                b = int(offsets[k])
            else:  # inside one long text: on to the next byte that is in no word
                stop = int(offsets[k + 1])
                while b < stop:
                    gap = np.flatnonzero(~is_word[data[b : min(stop, b + 65536)]])
                    if len(gap):
                        b += int(gap[0])
                        break
                    b = min(stop, b + 65536)
        yield a, b
        a = b


def words_of(column_or_bytes, is_word: np.ndarray, fold: bool) -> Words:
    """All words of a string column (or of a pair of bytes and offsets); ``fold`` takes A-Z as a-z."""
    data, offsets = column_or_bytes if isinstance(column_or_bytes, tuple) else utf8(column_or_bytes)
    values = _BYTE_VALUES[_FOLDED] if fold else _BYTE_VALUES.copy()
    values[~is_word] = 0
    starts, ends, hashes = [], [], []
    for a, b in _cuts(data, offsets, is_word):
        part = data[a:b]
        inside = is_word[part]
        lo, hi = np.searchsorted(offsets, (a, b))
        edges = offsets[lo:hi] - a  # where texts begin
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        edges = edges[(edges >= 0) & (edges < b - a)]
        before[edges] = False
        after[edges[edges > 0] - 1] = False
        s = np.flatnonzero(inside & ~before)
        if not len(s):
            continue
        e = np.flatnonzero(inside & ~after) + 1
        # A range beyond the tables ends in one overlong word, whose hash is set below.
        m = min(b - a, 2 * CHUNK)
        power, inverse = _power_tables(m)
        h = mix(np.add.reduceat(values[part[:m]] * power[:m], s) * inverse[s])
        for i in np.flatnonzero(e - s > CHUNK):
            word = part[s[i] : e[i]].tobytes()
            word = word.translate(_FOLD_BYTES) if fold else word
            h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        starts.append(s + a)
        ends.append(e + a)
        hashes.append(h)
    if not starts:
        empty = np.zeros(0, np.int64)
        return Words(data, empty, empty, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    start = np.concatenate(starts)
    return Words(data, start, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(start, offsets))


def word_hash(word: str, is_word: np.ndarray = ALNUM_WORD, fold: bool = True) -> np.uint64:
    """The hash that :func:`words_of` gives this one word."""
    return words_of(pa.array([word]), is_word, fold).hash[0]


_GRAM = constants(16, 11)


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows inside one text, with the index of each window's first word."""
    h = words.hash
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = h[: len(h) - n + 1] * _GRAM[0]
    for k in range(1, n):
        total += h[k : len(h) - n + 1 + k] * _GRAM[k]
    doc = words.doc()
    at = np.flatnonzero(doc[: len(h) - n + 1] == doc[n - 1 :])
    return mix(total[at]), at


def shingles(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-word shingles, text by text, and the offsets of the texts among them.

    A text with fewer than ``n`` words has one shingle, its whole sequence; one without words has none.
    """
    count = np.diff(words.first)
    sizes = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(offsets[-1]), dtype=np.uint64)
    h, at = windows(words, n)
    if len(at):
        doc = words.doc()[at]
        out[offsets[doc] + at - words.first[doc]] = h
    for c in range(1, n):
        short = np.flatnonzero(count == c)
        if len(short):
            total = np.full(len(short), _GRAM[n + c], dtype=np.uint64)
            for k in range(c):
                total += words.hash[words.first[short] + k] * _GRAM[k]
            out[offsets[short]] = mix(total)
    return out, offsets


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    if len(values) < 2:
        return values
    values = np.sort(values)
    keep = np.empty(len(values), dtype=bool)
    keep[0] = True
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20):
    """The batch in slices whose texts have about ``max_bytes`` at most (one text may be longer)."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    ends = np.cumsum(sizes)
    a = 0
    while a < batch.num_rows:
        base = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield batch.slice(a, b - a)
        a = b
