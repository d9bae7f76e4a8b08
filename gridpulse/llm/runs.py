"""Periodic runs of words by internal pattern matching (11).

A run is a stretch of words in which words ``period`` places apart are equal, that no neighbour extends,
at least ``exponent`` = 4 periods and ``least`` words long. In a run of period q every stretch of 3q words
has an equal one q places on, so it holds a whole *dyadic block*, one of B = 2^k words that starts at a
multiple of B, with (2B - 1) / 3 <= q < (4B - 1) / 3, which occurs again q places further. So for each
block the occurrences in that neighbouring window are asked for: the suffixes that start with the block
are one interval of the suffix array, and a wavelet tree over the array answers a range successor (the
least place from x on) and predecessor. Occurrences in so short a window form one progression. If there
are two at most, their distances are the candidate periods; if more, the block has the progression's
difference as a period, and a longer period can only take the end (or the start) of the block's own
stretch of that difference to that of the others. Candidates are extended both ways by longest common
extensions, and kept where they are long enough; of periods with the same stretch the least one counts.

Everything is done in numpy for about a megabyte of texts at a time, or one longer text: ranks of all
stretches of 2^k words come from prefix doubling, and answer the extensions too. As every word of a run
occurs four times in it, words that occur less often in a text part it beforehand, again and again
within the pieces; what is left (few words, in prose) goes into one suffix array, with a mark of its own
after each piece. Nothing is shuffled; no text is cut.

Defined results: null, empty and blank texts have no words and no runs, and stay empty. Repeated rows and
ties are answered row by row. Any id type, null ids too; other columns are not read. Words are compared
by 64-bit hashes. Memory is about 8 log2(n) bytes for each of the n words left, of one text at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from gridpulse.llm.textbytes import SOLID, column_words

EXPONENT, LEAST = 4, 6
MIX = np.uint64(0x9E3779B97F4A7C15)


class WaveletTree:
    """Over an array of numbers below ``limit``: per bit, from the top, the zeros before each place."""

    def __init__(self, values: np.ndarray, limit: int) -> None:
        self.bits = max(1, int(limit - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        for b in range(self.bits - 1, -1, -1):
            zero = (values >> b) & 1 == 0
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(zero, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate([values[zero], values[~zero]])

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values in places low..high are smaller than x."""
        inside = x < 1 << self.bits
        count = np.where(inside, 0, high - low)
        high = np.where(inside, high, low)
        for level, before in enumerate(self.zeros):
            a, b = before[low], before[high]
            one = (x >> (self.bits - 1 - level)) & 1 == 1
            count = count + np.where(one, b - a, 0)
            low, high = np.where(one, before[-1] + low - a, a), np.where(one, before[-1] + high - b, b)
        return count

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value with n smaller ones in places low..high; there must be one."""
        value = np.zeros(len(n), np.int64)
        for level, before in enumerate(self.zeros):
            a, b = before[low], before[high]
            one = n >= b - a
            n = np.where(one, n - (b - a), n)
            value |= one.astype(np.int64) << (self.bits - 1 - level)
            low, high = np.where(one, before[-1] + low - a, a), np.where(one, before[-1] + high - b, b)
        return value

    def successor(self, low: np.ndarray, high: np.ndarray, x: np.ndarray, none: int) -> np.ndarray:
        """The least value from x on in places low..high, or ``none``."""
        n, out = self.below(low, high, x), np.full(len(x), none)
        some = np.flatnonzero(n < high - low)
        out[some] = self.nth(low[some], high[some], n[some])
        return out

    def predecessor(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The greatest value below x; there must be one."""
        return self.nth(low, high, self.below(low, high, x) - 1)


class Suffixes:
    """Suffix array of a sequence in which some last symbol occurs once, with the ranks of all stretches of
    2^k symbols: a rank is the first place in the array whose suffix starts with the stretch."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = self.n = len(symbols)
        self.ranks: list[np.ndarray] = []
        key, width = symbols.astype(np.int64), 1
        while True:
            order = np.argsort(key, kind="stable")
            first = np.append(True, np.diff(key[order]) != 0)
            rank = np.empty(n, np.int64)
            rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
            self.ranks.append(rank.astype(np.int32))
            if first.all():
                break
            key = rank * (n + 1)
            key[: n - width] += rank[width:] + 1
            width *= 2
        self.places = order
        self.tree = WaveletTree(order, n)

    def interval(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the suffixes that start with the 2^level symbols from ``at`` on."""
        rank = self.ranks[level]
        low = rank[at].astype(np.int64)
        return low, low + np.bincount(rank, minlength=self.n)[low]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i on and from j on are equal (i and j differ)."""
        done = np.zeros(len(i), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            a, b = i + done, j + done
            inside = np.maximum(a, b) < self.n
            rank = self.ranks[level]
            same = inside & (rank[np.where(inside, a, 0)] == rank[np.where(inside, b, 0)])
            done += np.where(same, 1 << level, 0)
        return done

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols up to i and up to j, both included, are equal."""
        done = np.zeros(len(i), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            a, b = i - done - (1 << level) + 1, j - done - (1 << level) + 1
            inside = np.minimum(a, b) >= 0
            rank = self.ranks[level]
            same = inside & (rank[np.where(inside, a, 0)] == rank[np.where(inside, b, 0)])
            done += np.where(same, 1 << level, 0)
        return done


def pieces(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What can lie in runs: places of the words left, the piece of each and the number of each different
    word of a piece. Pieces are parted by words that occur too seldom in them."""
    place, piece = np.arange(len(words)), text
    while len(place):
        _, number, count = np.unique((words[place] ^ (piece.astype(np.uint64) * MIX)) * MIX, return_inverse=True, return_counts=True)
        often = count[number] >= EXPONENT
        before = len(place)
        place, piece, number = place[often], piece[often], number[often]
        starts = np.append(True, (np.diff(place) > 1) | (np.diff(piece) != 0)) if len(place) else np.zeros(0, bool)
        piece = np.cumsum(starts) - 1
        long = np.bincount(piece, minlength=1)[piece] >= LEAST if len(place) else starts
        place, piece, number = place[long], piece[long], number[long]
        if len(place) == before:
            return place, np.unique(piece, return_inverse=True)[1], number
    return place, piece, place


def find_runs(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in a row of texts, by start and period; a start counts all words."""
    none = np.zeros(0, np.int64)
    place, piece, number = pieces(words, text)
    if not len(place):
        return none, none, none
    # Each piece, and after it a symbol that occurs nowhere else.
    at = np.arange(len(place)) + piece
    size = np.bincount(piece)
    ends = np.cumsum(size + 1) - 1
    symbols = np.empty(len(place) + len(size), np.int64)
    symbols[at], symbols[ends] = number, number.max() + 1 + np.arange(len(size))
    index = Suffixes(symbols)
    starts, lengths, periods = [], [], []

    def keep(b: np.ndarray, q: np.ndarray) -> None:
        some = (q > 0) & (b + q < index.n)
        b, q = b[some], q[some]
        left = index.back(b - 1, b + q - 1)
        length = left + q + index.ahead(b, b + q)
        some = length >= np.maximum(LEAST, EXPONENT * q)
        starts.append((b - left)[some])
        lengths.append(length[some])
        periods.append(q[some])

    for level in range(1, len(index.ranks)):
        block = 1 << level
        least, most = -(-(2 * block - 1) // 3), -(-(4 * block - 1) // 3) - 1
        if EXPONENT * least > size.max():
            break
        b = np.arange(0, index.n - block, block)
        b = b[ends[np.searchsorted(ends, b)] >= b + block]  # those within one piece
        low, high = index.interval(level, b)
        some = high - low > 1
        b, low, high = b[some], low[some], high[some]
        first = index.tree.successor(low, high, b + least, index.n)
        some = first <= b + most
        b, low, high, first = b[some], low[some], high[some], first[some]
        if not len(b):
            continue
        keep(b, first - b)
        last = index.tree.predecessor(low, high, b + most + 1)
        some = last > first
        b, low, high, first, last = b[some], low[some], high[some], first[some], last[some]
        keep(b, last - b)
        second = index.tree.successor(low, high, first + 1, index.n)
        some = second < last
        b, first, gap = b[some], first[some], (second - first)[some]
        keep(b, first + index.ahead(first, first + gap) - b - index.ahead(b, b + gap))
        keep(b, first - index.back(first - 1, first + gap - 1) - b + index.back(b - 1, b + gap - 1))
    if not starts:
        return none, none, none
    start, length, period = (np.concatenate(x) for x in (starts, lengths, periods))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.append(True, (np.diff(start) != 0) | (np.diff(length) != 0))[: len(start)]
    start, length, period = start[new], length[new], period[new]
    start = place[np.searchsorted(at, start)]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _collapsed(text: str | None, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> str:
    """The words joined by blanks, without those after the first period of a run."""
    words = (text or "").encode().split()
    if len(start):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, start + length, -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words).decode()


RUNS = ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row its id, ``n_words``, ``runs`` (by start, then period) and ``collapsed``, the text with each
    run cut down to its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words, bounds in column_words(batch.column(1), SOLID):
                n = np.diff(bounds)
                start, length, period = find_runs(words, np.repeat(np.arange(j - i), n))
                text = np.searchsorted(bounds, start, "right") - 1
                start = start - bounds[text]
                at = np.searchsorted(text, np.arange(j - i + 1))
                texts = batch.column(1)[i:j].to_pylist()
                collapsed = [_collapsed(t, start[a:b], length[a:b], period[a:b]) for t, a, b in zip(texts, at, at[1:])]
                told = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(at, pa.int32()), told)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(n, pa.int64()), runs, pa.array(collapsed, pa.string())], [id_column, "n_words", "runs", "collapsed"])

    schema = StructType([StructField(id_column, docs.schema[id_column].dataType), StructField("n_words", LongType()), StructField("runs", RUNS), StructField("collapsed", StringType())])
    return docs.select(id_column, text_column).mapInArrow(run, schema)


def longest(runs: str = "runs") -> Column:
    """The run with the greatest length, of equal ones the first, of those the one with the least period."""
    order = F.transform(runs, lambda r: F.struct((-r["length"]).alias("by"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(order)


def written(runs: str = "runs") -> Column:
    """Every run as start,length,period and a line feed."""
    line = F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return F.array_join(line, "")
