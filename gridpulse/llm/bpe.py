"""Byte-level BPE encoding and decoding (10): two tiers of lookup per pre-token.

A pre-token that is itself in the vocabulary is resolved by a minimal perfect hash: one displacement
and one slot, then one comparison. The others are merged pair by pair, lowest rank and then leftmost
first, from a heap over a linked list of their bytes, so a pre-token of n bytes takes n log n steps.
Each task keeps up to ``KEPT`` results, whatever the input size. Texts are encoded where they
are read; nothing is shuffled.

The vocabulary (a rank file: base64 of the bytes, blank, id) is read by the driver and broadcast; its
size is fixed by the file. Ids are kept packed, 4 little-endian bytes each.

Defined results: null and empty texts give no ids and decode to no bytes. Decoding gives back exactly
the UTF-8 bytes of the text. Repeated rows are encoded each; other columns are not read. An id that the
vocabulary lacks makes ``decode`` fail.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterator
from contextlib import contextmanager
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

KEPT = 400_000
BLOCK = 100_000  # pre-tokens of a long text that are held at a time
LONG = 1 << 20
MASK = (1 << 64) - 1
STEP, SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class PerfectHash:
    """Every key of a fixed set to its own slot of as many slots as keys, by a displacement per bucket."""

    def __init__(self, keys: list[bytes]) -> None:
        n = self.n = len(keys)
        m = self.m = n // 2 + 1
        buckets: list[list[int]] = [[] for _ in range(m)]
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        for k, h in enumerate(hashes):
            buckets[h % m].append(k)
        slots, self.moves = [-1] * n, [0] * m
        for b in sorted(range(m), key=lambda b: -len(buckets[b])):
            if len(buckets[b]) < 2:
                break
            move = 1
            while True:
                at = [self._slot(hashes[k], move) for k in buckets[b]]
                if len(set(at)) == len(at) and all(slots[s] < 0 for s in at):
                    break
                move += 1
            self.moves[b] = move
            for k, s in zip(buckets[b], at, strict=True):
                slots[s] = k
        free = iter([s for s in range(n) if slots[s] < 0])
        for b in range(m):
            if len(buckets[b]) == 1:  # named outright
                s = next(free)
                slots[s], self.moves[b] = buckets[b][0], -s - 1
        self.keys = [keys[k] for k in slots]
        self.order = slots  # slot -> number of the key

    def _slot(self, h: int, move: int) -> int:
        return (((h ^ move * STEP) * SPREAD & MASK) >> 20) % self.n

    def find(self, key: bytes) -> int:
        """The number of the key, or -1."""
        h = xxhash.xxh64_intdigest(key)
        move = self.moves[h % self.m]
        slot = -move - 1 if move < 0 else self._slot(h, move)
        return self.order[slot] if self.keys[slot] == key else -1


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.tokens = {i: t for t, i in ranks.items()}
        self.ids = list(ranks.values())
        self.ranks, self.pattern = ranks, pattern
        self.whole = PerfectHash(list(ranks))


class Merger:
    """Merges of a pre-token, by a heap over the linked list of its bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}  # left id and right id in one integer -> id of both together
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Place i of the list holds an id, -1 once it was merged into the place before, and the rank of its
        pair with the next place. A heap entry is rank and place in one integer; it is stale if the place
        has another rank by now."""
        single, get = self.single, self.pairs.get
        ids = [single[b] for b in piece]
        n = len(ids)
        ranks = [get(x << 32 | y) for x, y in zip(ids, ids[1:])]
        heap = [r << 32 | i for i, r in enumerate(ranks) if r is not None]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while heap:
            entry = heappop(heap)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            if ranks[i] != rank:
                continue
            j = after[i]
            after[i] = k = after[j]
            ids[i], ids[j] = rank, -1
            if k < n:
                before[k] = i
                ranks[j] = None
                ranks[i] = r = get(rank << 32 | ids[k])
                if r is not None:
                    heappush(heap, r << 32 | i)
            else:
                ranks[i] = None
            p = before[i]
            if p >= 0:
                ranks[p] = r = get(ids[p] << 32 | rank)
                if r is not None:
                    heappush(heap, r << 32 | p)
        return tuple([x for x in ids if x >= 0])


class Encoder(dict):
    """Pre-token to its ids; fills itself and starts anew when it holds ``KEPT`` of them."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self.split = regex.compile(vocabulary.pattern)
        self.merge = Merger(vocabulary.ranks).merge

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= KEPT:
            self.clear()
        raw = token.encode()
        found = self.vocabulary.whole.find(raw)
        ids = (self.vocabulary.ids[found],) if found >= 0 else self.merge(raw)
        if len(token) <= 64:  # longer ones hardly come again
            self[token] = ids
        return ids

    def packed(self, text: str) -> bytes:
        if len(text) <= LONG:
            return np.fromiter(chain.from_iterable(map(self.__getitem__, self.split.findall(text))), "<u4").tobytes()
        parts, found = [], self.split.finditer(text)
        while block := [x.group() for x in islice(found, BLOCK)]:
            parts.append(np.fromiter(chain.from_iterable(map(self.__getitem__, block)), "<u4").tobytes())
        return b"".join(parts)


@contextmanager
def no_cycle_search() -> Iterator[None]:
    """The tuples and lists made here hold no cycles; searching them again and again takes a quarter of the time."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def _with_type(df: DataFrame, id_column: str, *more: str) -> StructType:
    return StructType([StructField(id_column, df.schema[id_column].dataType), *[StructField(x, BinaryType()) for x in more]])


def _vocabulary(df: DataFrame, ranks_path: str, pattern: str):
    return df.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(ranks_path), pattern))


def _packed(encoder: Encoder, texts: pa.Array) -> pa.Array:
    with no_cycle_search():
        return pa.array([encoder.packed(t.as_py() or "") for t in texts], pa.binary())


def _unpacked(tokens: dict[int, bytes], packed: pa.Array) -> pa.Array:
    get = tokens.__getitem__
    return pa.array([b"".join(map(get, np.frombuffer(x.as_py() or b"", "<u4").tolist())) for x in packed], pa.binary())


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row its id and ``token_ids`` (packed)."""
    shared = _vocabulary(docs, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(encoder, batch.column(1))], [id_column, "token_ids"])

    return docs.select(id_column, text_column).mapInArrow(run, _with_type(docs, id_column, "token_ids"))


def decode(tokens: DataFrame, ranks_path: str, id_column: str = "doc_id") -> DataFrame:
    """Per row its id, ``token_ids`` and ``decoded``, the bytes that the ids stand for."""
    shared = tokens.sparkSession.sparkContext.broadcast({i: t for t, i in read_ranks(ranks_path).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _unpacked(shared.value, batch.column(1))], [id_column, "token_ids", "decoded"])

    return tokens.select(id_column, "token_ids").mapInArrow(run, _with_type(tokens, id_column, "token_ids", "decoded"))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """What ``decode`` of ``encode`` gives, with both in one pass over a batch, so that ids cross over to
    Python and back only once and a task needs one worker."""
    shared = _vocabulary(docs, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            packed = _packed(encoder, batch.column(1))
            back = _unpacked(shared.value.tokens, packed)
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, back], [id_column, "token_ids", "decoded"])

    return docs.select(id_column, text_column).mapInArrow(run, _with_type(docs, id_column, "token_ids", "decoded"))


def n_tokens(column: str = "token_ids") -> Column:
    return (F.octet_length(column) / 4).cast("bigint")
