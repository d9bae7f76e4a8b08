"""Benchmark decontamination (7): suffix arrays over the words of the training documents.

Every task builds, shard by shard (about a million words), a suffix array of its documents: word
positions, sorted by the words that follow. Each suffix of the benchmark items is looked up in it by
binary search, which gives all places where the next ``window`` words occur; neighbouring places on one
diagonal make up the longest verbatim matches. Positions whose first words start no benchmark suffix
cannot be found by any search, so the array leaves them out (a table of first words decides; it may let
others pass, never the other way round). Nothing is shuffled; only matches leave the task.

Words are compared by 64-bit hashes of their lower-cased UTF-8 bytes.

Defined results: null and empty texts have no words and no hits; so do documents against an empty
benchmark. Items without words never occur; a null item_id counts as one item named "". Repeated rows
and ties are answered row by row. Long texts are taken whole. Other columns are not read.

The benchmark is the stated query set: it goes out in blocks of at most ``block_words`` words, one
narrow pass each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gridpulse.llm.common import unused
from gridpulse.llm.textbytes import column_words, hash_words, ALNUM

WINDOW = 10
BLOCK_WORDS = 2_000_000
HEAD = 4  # words that decide whether a suffix can be found
BITS = 22
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@dataclass
class Index:
    """Suffixes of a block of items: for each length of window its word rows, sorted, with their items."""

    items: list[list[str]]  # names of the items with the same words
    rows: dict[int, np.ndarray]  # length -> distinct windows (n, length)
    owners: dict[int, tuple[np.ndarray, np.ndarray]]  # length -> per window: bounds into (item * 2^32 + place)
    heads: dict[int, np.ndarray]  # words in a head -> table of those that occur


def _slot(words: list[np.ndarray]) -> np.ndarray:
    total = words[0] * ODD[0]
    for k, w in enumerate(words[1:], 1):
        total = total + w * ODD[k]
    return (total >> np.uint64(64 - BITS)).astype(np.int64)


def build_index(items: list[tuple[str, str]], window: int = WINDOW) -> Index:
    same: dict[bytes, set[str]] = {}  # items with equal words are looked up once
    for name, text in items:
        _, words = hash_words(np.frombuffer(text.encode(), np.uint8), np.zeros(0, np.int64), ALNUM)
        if len(words):
            same.setdefault(words.tobytes(), set()).add(name)
    names = [sorted(x) for x in same.values()]
    found: dict[int, list[tuple[np.ndarray, int, int]]] = {}
    for number, raw in enumerate(same):
        words = np.frombuffer(raw, np.uint64)
        size = min(window, len(words))
        for place in range(len(words) - size + 1):
            found.setdefault(size, []).append((words[place : place + size], number, place))
    rows, owners, heads = {}, {}, {}
    for size, entries in found.items():
        all_rows = np.stack([w for w, _, _ in entries])
        who = np.array([(number << 32) + place for _, number, place in entries], np.int64)
        distinct, which = np.unique(all_rows, axis=0, return_inverse=True)
        which = which.ravel()
        order = np.argsort(which, kind="stable")
        rows[size] = distinct
        owners[size] = np.searchsorted(which[order], np.arange(len(distinct) + 1)), who[order]
        head = min(HEAD, size)
        heads.setdefault(head, np.zeros(1 << BITS, bool))[_slot([distinct[:, k] for k in range(head)])] = True
    return Index(names, rows, owners, heads)


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of words as byte strings that sort as the rows do."""
    return np.ascontiguousarray(rows.astype(">u8")).view(f"V{8 * rows.shape[1]}").ravel()


def suffix_array(words: np.ndarray, ends: np.ndarray, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``places`` sorted by the ``depth`` words from there on (0 beyond the document), and those words."""
    at = places[:, None] + np.arange(depth)
    rows = np.where(at < ends[:, None], words[np.minimum(at, len(words) - 1)], np.uint64(0))
    order = np.argsort(_keys(rows), kind="stable")
    return places[order], rows[order]


def search(index: Index, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """All places where benchmark windows occur: (place, length of the window, item, place in the item)."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if not index.rows or not len(words):
        return none
    follow = [words]
    for k in range(1, max(index.heads)):
        follow.append(np.concatenate([words[k:], np.zeros(min(k, len(words)), np.uint64)])[: len(words)])
    may = np.zeros(len(words), bool)
    for head, table in index.heads.items():
        may |= table[_slot(follow[:head])]
    places = np.flatnonzero(may)
    if not len(places):
        return none
    doc = np.searchsorted(bounds, places, "right") - 1
    places, rows = suffix_array(words, bounds[doc + 1], places, max(index.rows))
    out = []
    for size, wanted in index.rows.items():
        keys = _keys(rows[:, :size])
        low = np.searchsorted(keys, _keys(wanted), "left")
        high = np.searchsorted(keys, _keys(wanted), "right")
        hit = np.flatnonzero(high > low)
        if not len(hit):
            continue
        bound, who = index.owners[size]
        n_places, n_items = high[hit] - low[hit], bound[hit + 1] - bound[hit]
        pairs = n_places * n_items
        each = np.repeat(np.arange(len(hit)), pairs)
        k = np.arange(len(each)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        place = places[low[hit][each] + k // n_items[each]]
        owner = who[bound[hit][each] + k % n_items[each]]
        out.append((place, np.full(len(place), size), owner >> 32, owner & 0xFFFFFFFF))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else none


def _longest(doc: np.ndarray, item: np.ndarray, place: np.ndarray, inside: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Words of each document's longest match: windows that follow each other in document and item."""
    best = np.zeros(n, np.int64)
    if len(doc):
        diagonal = place - inside
        order = np.lexsort((place, diagonal, item, doc))
        d, i, g, p, s = (x[order] for x in (doc, item, diagonal, place, size))
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (g[1:] != g[:-1]) | (p[1:] != p[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(d)) - 1
        np.maximum.at(best, d[first], p[last] - p[first] + s[first])
    return best


def _matcher(block: Broadcast, first: bool, last: bool):
    """Per batch: words, matched stretches, items and longest match of each document. A later block adds to
    what the blocks before it have found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = block.value
        for batch in batches:
            n = batch.num_rows
            n_words, longest = np.zeros(n, np.int64), np.zeros(n, np.int64)
            stretches: list[list[dict]] = [[] for _ in range(n)]
            names: list[list[str]] = [[] for _ in range(n)]
            if not first:
                longest = batch.column(4).to_numpy(zero_copy_only=False).copy()
                stretches = batch.column(3).to_pylist()
                names = batch.column(5).to_pylist()
            for i, j, words, bounds in column_words(batch.column(1)):
                n_words[i:j] = np.diff(bounds)
                place, size, item, inside = search(index, words, bounds)
                if not len(place):
                    continue
                doc = np.searchsorted(bounds, place, "right") - 1
                longest[i:j] = np.maximum(longest[i:j], _longest(doc, item, place, inside, size, j - i))
                for key in np.unique((doc << 32) + item):
                    names[i + int(key >> 32)] += index.items[int(key & 0xFFFFFFFF)]
                mark = np.zeros(len(words) + 1, np.int32)
                np.add.at(mark, place, 1)
                np.add.at(mark, place + size, -1)
                hit = np.cumsum(mark[:-1]) > 0
                edge = hit.copy()
                edge[1:] &= ~hit[:-1]
                edge[bounds[:-1][bounds[:-1] < len(hit)]] |= hit[bounds[:-1][bounds[:-1] < len(hit)]]
                stop = hit.copy()
                stop[:-1] &= ~hit[1:] | edge[1:]
                for s, e in zip(np.flatnonzero(edge), np.flatnonzero(stop) + 1, strict=True):
                    d = int(np.searchsorted(bounds, s, "right")) - 1
                    stretches[i + d].append({"start": int(s - bounds[d]), "end": int(e - bounds[d])})
            if not first:
                stretches = [_joined(x) for x in stretches]
            out = [
                batch.column(0), pa.nulls(n, pa.string()) if last else batch.column(1), pa.array(n_words),
                pa.array(stretches, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(longest), pa.array([sorted(set(x)) for x in names], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(out, ["id", "text", "n_words", "spans", "longest", "items"])

    return run


def _joined(stretches: list[dict]) -> list[dict]:
    """Stretches of several blocks in order, one where they meet or overlap."""
    out: list[dict] = []
    for x in sorted(stretches, key=lambda x: x["start"]):
        if out and out[-1]["end"] >= x["start"]:
            out[-1]["end"] = max(out[-1]["end"], x["end"])
        else:
            out.append(dict(x))
    return out


def find_matches(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per row of ``docs``: its id, ``n_words``, ``spans`` (matched stretches of words, end exclusive),
    ``longest`` (words of the longest verbatim match) and ``items`` (sorted ids of the items found)."""
    spark = docs.sparkSession
    query = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"),
        F.coalesce(F.col("text"), F.lit("")).alias("body"),
    )
    # A word takes two bytes with what parts it from the next.
    total = query.agg(F.sum(F.octet_length("body") / 2 + 1).alias("n")).first().n or 0
    n_blocks = int(total // block_words) + 1
    found = "text string, n_words bigint, spans array<struct<start:bigint,end:bigint>>, longest bigint, items array<string>"
    schema = StructType([StructField("id", docs.schema[id_column].dataType), *StructType.fromDDL(found).fields])
    out = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    for block in range(n_blocks):
        part = query if n_blocks == 1 else query.filter(F.pmod(F.xxhash64("name", "body"), F.lit(n_blocks)) == block)
        index = spark.sparkContext.broadcast(build_index([tuple(r) for r in part.collect()], window))
        out = out.mapInArrow(_matcher(index, block == 0, block == n_blocks - 1), schema)
    return out.select(F.col("id").alias(id_column), "n_words", "spans", "longest", "items")


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with all their columns.

    The rows pass through the search as one struct, so no join brings the decision back."""
    whole = unused(docs, "row")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole), F.col(text_column).alias(unused(docs, "body")))
    found = find_matches(packed, benchmark, whole, packed.columns[1], window)
    return found.filter(F.size("spans") == 0).select(f"{whole}.*")
