"""SimHash near-dedup by BK-trees (6).

Fingerprints: each 4-word shingle of the whole text gives its XXH64 (seed 42); a bit of the fingerprint
is 1 if over half of the hashes have it. Two fingerprints with at most ``radius`` differing bits agree
wholly on two of six parts of the 64 bits (for radius 4: at most four parts differ), so distinct
fingerprints are dealt to shards by each of the fifteen pairs of parts. A shard's fingerprints form a
BK-tree: a node's children are keyed by their distance to it, and a search goes down only the edges
that differ from the query's distance by the radius at most. All trees of a task are built and searched
together, level by level, in numpy.

A tree over everything, or a broadcast of all trees, would grow with the collection; here each tree
goes to the one task that holds its queries. A shard above ``shard_rows`` is parted at random and its
parts meet pairwise, each pair being a task's unit of work, so no shard is ever whole in one place.
Within a unit only a spanning forest of the links found is kept: copies do not multiply into pairs.

Defined results: null texts have no words, like empty ones; without words the fingerprint is zero and
linked like any other. A null doc_id is no smaller than others, and a component of nulls has a null id.
Repeated rows are answered each. Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridpulse.llm.common import Scratch, units_of_work
from gridpulse.llm.components import components
from gridpulse.llm.textbytes import SLICE, SOLID, cuts

WORDS, RADIUS, SEED = 4, 4, 42
SHARD_ROWS = 4096
UNIT_ROWS = 50_000  # rows whose trees are built together
FRONTIER = 500_000  # (query, node) pairs that are looked at together


def _bit_counts(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.sum(0, dtype=np.int64)


def _word_blocks(raw: bytes) -> Iterator[list[bytes]]:
    if len(raw) <= SLICE:
        yield raw.split()
    else:
        data = np.frombuffer(raw, np.uint8)
        for a, b in cuts(data, SOLID):
            yield raw[a:b].split()


def simhash(text: str, words: int = WORDS) -> int:
    """The fingerprint of one text, as an unsigned number."""
    counts, n, carried = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for block in _word_blocks(text.encode().lower()):  # lower() of bytes changes A-Z alone
        block = carried + block
        if len(block) >= words:
            line = b" ".join(block)
            at = np.cumsum([0, *[len(w) + 1 for w in block]])
            starts, ends = at[: len(block) - words + 1].tolist(), (at[words:] - 1).tolist()
            for k in range(0, len(starts), 1 << 16):
                part = [digest(line[a:b], SEED) for a, b in zip(starts[k : k + (1 << 16)], ends[k : k + (1 << 16)])]
                counts += _bit_counts(part)
                n += len(part)
            carried = block[len(block) - words + 1 :]
        else:
            carried = block
    if n == 0:
        if not carried:
            return 0
        counts, n = _bit_counts([digest(b" ".join(carried), SEED)]), 1
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS) -> DataFrame:
    """Per row its id, ``text_hash`` and ``fp``, the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t.as_py() or "", words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found)], [id_column, "text_hash", "fp"])

    kind = docs.schema[id_column].dataType
    schema = StructType([StructField(id_column, kind), StructField("text_hash", LongType()), StructField("fp", LongType())])
    return docs.select(id_column, F.col(text_column), F.xxhash64(F.col(text_column))).mapInArrow(run, schema)


def hex_digits(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class Forest:
    """BK-trees of many shards: one root for each, all built level by level."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray) -> None:
        n = len(fp)
        self.fp = fp
        self.parent, self.edge = np.full(n, -1), np.zeros(n, np.int64)
        _, first, which = np.unique(shard, return_index=True, return_inverse=True)
        self.root = first[which]  # each row's root
        at = self.root.copy()  # the node a row has come down to
        left = np.flatnonzero(np.arange(n) != at)
        while len(left):
            gap = np.bitwise_count(fp[left] ^ fp[at[left]]).astype(np.int64)
            _, first, which = np.unique(at[left] * 65 + gap, return_index=True, return_inverse=True)
            child = left[first]  # the first to take an edge becomes the child there
            self.parent[child], self.edge[child] = at[child], gap[first]
            down = child[which]
            at[left] = down
            left = left[left != down]
        inner = np.flatnonzero(self.parent >= 0)
        key = self.parent[inner] * 65 + self.edge[inner]
        order = np.argsort(key)
        self.children, self.keys = inner[order], key[order]

    def within(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index of the query, node) for all nodes of its tree within the radius."""
        stack = [(np.arange(len(queries)), roots)]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(q[half:], node[half:]), (q[:half], node[:half])]
                continue
            gap = np.bitwise_count(queries[q] ^ self.fp[node]).astype(np.int64)
            near = gap <= radius
            if near.any():
                yield q[near], node[near]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(gap - radius, 0), "left")
            high = np.searchsorted(self.keys, node * 65 + np.minimum(gap + radius, 64), "right")
            n = high - low
            if n.any():
                q = np.repeat(q, n)
                stack.append((q, self.children[np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]))


def spanning(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Label of each of ``n`` nodes: the smallest of its component under the links a-b so far."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            return label
        label = new


def _linked(unit: np.ndarray, part: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges between fingerprints of units of work. Part 0 of a unit makes up the tree; all rows of
    part 1 are looked up in it, or those of part 0 themselves where there is no part 1."""
    alone = ~np.isin(unit, unit[part == 1])
    tree_rows = np.flatnonzero(part == 0)
    query_rows = np.flatnonzero((part == 1) | alone)
    names, number = np.unique(unit, return_inverse=True)
    forest = Forest(number[tree_rows], fp[tree_rows])
    root_of = np.full(len(names), -1)
    root_of[number[tree_rows]] = forest.root
    query_rows = query_rows[root_of[number[query_rows]] >= 0]
    label = np.arange(len(fp))
    for q, node in forest.within(fp[query_rows], root_of[number[query_rows]], radius):
        label = spanning(len(fp), query_rows[q], tree_rows[node], label)
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[linked], fp[label[linked]]


def _unit_edges(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def edges(rows: np.ndarray) -> pa.RecordBatch:
            a, b = _linked(rows[0], rows[1], rows[2].view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)]))
            if sum(x.shape[1] for x in held) >= UNIT_ROWS:
                rows = np.concatenate(held, 1)
                whole = int(np.searchsorted(rows[0], rows[0, -1]))  # the last unit may go on
                if whole:
                    yield edges(rows[:, :whole])
                held = [rows[:, whole:]]
        if held and sum(x.shape[1] for x in held):
            yield edges(np.concatenate(held, 1))

    return run


def parts(n: int) -> list[int]:
    """Masks of ``n`` near-equal parts of the 64 bits."""
    at = [64 * k // n for k in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(at, at[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_pairs(distinct: DataFrame, scratch: Scratch, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Distinct fingerprints (``fp``) -> edges (a, b) that connect all that are linked."""
    masks = [_signed(x | y) for x, y in combinations(parts(radius + 2), 2)]
    shards = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "bits"))
    shards = shards.select("fp", F.xxhash64("mask", "bits").alias("shard"))
    units = units_of_work(scratch.table(shards), "shard", "fp", shard_rows).select("unit", "part", "fp")
    return units.mapInArrow(_unit_edges(radius), "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS, words: int = WORDS
) -> DataFrame:
    """Per row its id, ``text_hash``, ``fp``, ``component_id``, the smallest id among all that links reach, and
    ``component``, the smallest fingerprint among them."""
    scratch = Scratch(docs.sparkSession)
    marked = scratch.table(fingerprints(docs, id_column, text_column, words))
    first = scratch.table(marked.groupBy("fp").agg(F.min(id_column).alias("first")))
    found = components(near_pairs(first.select("fp"), scratch, radius), scratch)
    member = first.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    member = member.select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = member.groupBy("component").agg(F.min("first").alias("component_id"))
    named = member.join(least, "component").select("fp", "component_id", "component")
    return marked.join(named, "fp").select(id_column, "text_hash", "fp", "component_id", "component")


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that with the smallest (id, hash of
    the text), null ids first. Of rows that agree in both, one stays."""
    return keep_least(docs, near_duplicates(docs, id_column, text_column, radius), id_column, text_column)


def keep_least(docs: DataFrame, marked: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The row with the smallest (id, hash of the text) of each ``component`` of ``marked`` (id, ``text_hash``,
    ``component``), with all its columns."""
    scratch = Scratch(docs.sparkSession)
    marked = scratch.table(marked)
    key = F.struct(F.col(id_column).alias("id"), F.col("text_hash").alias("hash"))
    # By the component itself: its smallest id may be null, or stand on rows of another component too.
    chosen = marked.groupBy("component").agg(F.min(key).alias("key"))
    chosen = scratch.table(chosen.select("key.*").distinct())
    same = (marked[id_column].eqNullSafe(chosen["id"])) & (marked["text_hash"] == chosen["hash"])
    repeated = marked.join(chosen, same, "left_semi").groupBy(id_column, "text_hash").count().filter("count > 1")
    repeated = scratch.table(repeated.select(F.col(id_column).alias("id"), F.col("text_hash").alias("hash")))

    def rows(how: str, source: DataFrame, keys: DataFrame) -> DataFrame:
        return source.join(keys, source[id_column].eqNullSafe(keys["id"]) & (F.xxhash64(source[text_column]) == keys["hash"]), how)

    kept = rows("left_semi", docs, chosen)
    if repeated.isEmpty():
        return kept
    several = rows("left_semi", kept, repeated)
    columns = several.columns
    one = several.groupBy(F.col(id_column).alias("_id"), F.xxhash64(F.col(text_column)).alias("_hash"))
    one = one.agg(F.first(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("_row")).select("_row.*")
    return rows("left_anti", kept, repeated).unionAll(one)
