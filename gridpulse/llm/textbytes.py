"""Words of whole text columns as hashes, by numpy on the column's UTF-8 bytes.

A text is never turned into Python words: its bytes are classed through a table of 256 entries, words
are the runs of word bytes, and a word's hash is its value as a polynomial modulo 2^64, read off one
running sum. Work is done in slices of about ``SLICE`` bytes that never cut a word, so memory does not
follow the length of a text except for 8 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)

# Lower-cased ASCII letters, digits and everything beyond ASCII are word bytes; 0 parts words.
ALNUM = np.zeros(256, np.uint8)
ALNUM[0x30:0x3A] = np.arange(0x30, 0x3A)
ALNUM[0x41:0x5B] = np.arange(0x61, 0x7B)
ALNUM[0x61:0x7B] = np.arange(0x61, 0x7B)
ALNUM[0x80:] = np.arange(0x80, 0x100)

# All but white space, as it is written. A class is not the byte itself: byte 0 is a word byte too, and
# takes the class that the blank leaves free.
BLANKS = [0x20, *range(0x09, 0x0E)]
SOLID = np.arange(256).astype(np.uint8)
SOLID[0x00] = 0x20
SOLID[BLANKS] = 0

# The same with A-Z as a-z.
SOLID_LOWER = SOLID.copy()
SOLID_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the place where each text starts, one more than texts. Null: empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return values, starts.astype(np.int64)


@lru_cache(maxsize=2)
def _powers(n: int, of: int) -> np.ndarray:
    out = np.full(n, of, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _room(n: int) -> int:
    return max(SLICE, 1 << (n - 1).bit_length())


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h ^= h >> np.uint64(29)
    return np.maximum(h, np.uint64(1))  # 0 stands for "no word"


def hash_words(data: np.ndarray, breaks: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a slice; a word ends where one of ``breaks`` is."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = classes[data]
    word = low != 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = breaks[(breaks > 0) & (breaks < len(data))]
    first[cut] = word[cut]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    room = _room(len(data))
    total = low.astype(np.uint64)
    total *= _powers(room, int(BASE))[: len(data)]
    before = total[start]
    np.cumsum(total, out=total)
    value = total[end] - total[start] + before
    value *= _powers(room, int(INVERSE))[start]
    # Words of different length are never equal, as no class is 0; the length only mixes further.
    return start, _mixed(value + (end - start).astype(np.uint64))


def groups(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with ``limit`` bytes at most, or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def cuts(data: np.ndarray, classes: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Slices of one long text, parted where no word is; a longer word stays in one slice."""
    at, n = 0, len(data)
    while n - at > limit:
        gap = np.flatnonzero(classes[data[at : at + limit]] == 0)
        if len(gap):
            to = at + int(gap[-1]) + 1
        else:
            to = at + limit
            while to < n and classes[data[to]]:
                to += 1
        yield at, to
        at = to
    yield at, n


def column_words(column: pa.Array, classes: np.ndarray = ALNUM) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of texts (first, after the last), with the hashes of their words and, for each text and one
    more, the place of its first word among them."""
    data, offsets = text_bytes(column)
    for i, j in groups(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        if j == i + 1 and b - a > SLICE:
            parts = [hash_words(data[a + s : a + e], np.zeros(0, np.int64), classes)[1] for s, e in cuts(data[a:b], classes)]
            hashes = np.concatenate(parts)
            yield i, j, hashes, np.array([0, len(hashes)])
        else:
            local = offsets[i : j + 1] - a
            start, hashes = hash_words(data[a:b], local[:-1], classes)
            yield i, j, hashes, np.searchsorted(start, local)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between successive bounds; empty stretches give 0."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
