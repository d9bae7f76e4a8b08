"""Near copies by wide SimHash and BK-trees (6), each link verified: what the corpus pipeline removes.

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of 4/5 or
more. Texts that just reach it differ in 15 % of their SimHash bits on average, too many for a split of
64 bits into parts, one of which must agree. So fingerprints have 128 bits here, and a shard is made by
each of ``TABLES`` fixed random choices of ``BITS`` bits. Recall, measured on 1330 pairs of sf0.1 texts and
copies of them with single words changed: 0.90 at a similarity of 0.8 to 0.825, 0.95 to 0.875, 0.99 beyond.
A shard's fingerprints form a BK-tree, which is searched within ``RADIUS`` bits. A child within the radius
of its parent is linked as the tree is built, and a search leaves out subtrees whose nodes are all linked
to the query already, so thousands of near copies of one text take a pass, not all their pairs.

Links of fingerprints only propose groups. Within a group, texts meet with their whole shingle sets:
each is held against the leaders so far, then the sets that share a token of their prefixes (the
prefixes of two sets of that similarity always share one) but are not linked yet are compared. Groups
above ``UNIT_SHINGLES`` are cut at random and their parts meet pairwise. Components of the verified links
are the groups of near copies.

Bounds: a unit of trees has twice ``SHARD_ROWS`` rows at most, a unit of sets twice ``UNIT_SHINGLES`` numbers
and a text more. Texts that equal each other up to case of A-Z and white space are one node throughout. Only
(shard, node, fingerprint) is shuffled for all texts, their texts only where a group has two or more.

Defined results: null texts have no words, like empty ones; those without words are one group. A text of
fewer than five words is one shingle. Null ids come first. Other columns are never read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridpulse.llm.bktree import FRONTIER, UNIT_ROWS, keep_least, spanning
from gridpulse.llm.common import Scratch
from gridpulse.llm.components import components
from gridpulse.llm.textbytes import BASE, MIX, SOLID_LOWER, column_words

WORDS = 5
SIMILAR = (4, 5)  # Jaccard, as a fraction
BITS, TABLES, RADIUS, SEED = 18, 64, 30, 7
SHARD_ROWS = 4096
UNIT_SHINGLES = 1 << 19
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)  # makes the second half of a fingerprint's bits


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(32))


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted set of its shingles' hashes."""
    powers = np.multiply.accumulate(np.full(words, BASE, np.uint64))
    for i, j, hashes, at in column_words(column, SOLID_LOWER):
        n = max(len(hashes) - words + 1, 0)
        whole = np.zeros(n, np.uint64)
        for k in range(words):
            whole += hashes[k : k + n] * powers[k]
        whole = _mixed(whole)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(whole[a : b - words + 1])
            elif b > a:
                yield _mixed((hashes[a:b] * powers[: b - a]).sum(dtype=np.uint64, keepdims=True))
            else:
                yield np.zeros(0, np.uint64)


def simhash128(shingles: np.ndarray) -> np.ndarray:
    """Two signed numbers that hold the 128 bits; without shingles both are 0."""
    counts = np.zeros(128, np.int64)
    for k in range(0, len(shingles), 1 << 16):
        part = shingles[k : k + (1 << 16)]
        both = np.stack([part, _mixed(part * SECOND)], 1)
        counts += np.unpackbits(both.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(shingles)).view(np.int64)


def _node(shingles: np.ndarray) -> int:
    """The number that stands for a set: a sum and a size, mixed."""
    total = np.array([_mixed(shingles * SECOND).sum(dtype=np.uint64) + np.uint64(len(shingles))])
    return int(_mixed(total).view(np.int64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row its id, ``text_hash``, ``node`` (equal for equal sets), ``f0``, ``f1`` (128 bits), ``size`` of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, sizes = [], [np.zeros((0, 2), np.int64)], []
            for shingles in shingle_sets(batch.column(1)):
                nodes.append(_node(shingles))
                prints.append(simhash128(shingles)[None])
                sizes.append(len(shingles))
            fp = np.concatenate(prints)
            columns = [batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), *(pa.array(fp[:, k].copy()) for k in (0, 1)), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [id_column, "text_hash", "node", "f0", "f1", "size"])

    fields = [StructField(c, LongType()) for c in ("text_hash", "node", "f0", "f1", "size")]
    schema = StructType([StructField(id_column, docs.schema[id_column].dataType), *fields])
    return docs.select(id_column, F.col(text_column), F.xxhash64(F.col(text_column))).mapInArrow(run, schema)


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def tree_labels(shard: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """Each row's label: rows of a shard that links within the radius connect have the same one."""
    n = len(fp)
    parent, edge, label = np.full(n, -1), np.zeros(n, np.int64), np.arange(n)
    _, first, which = np.unique(shard, return_index=True, return_inverse=True)
    root = first[which]
    at, levels = root.copy(), []
    left = np.flatnonzero(np.arange(n) != at)
    while len(left):
        gap = _gap(fp[left], fp[at[left]])
        _, first, which = np.unique(at[left] * 129 + gap, return_index=True, return_inverse=True)
        child = left[first]
        parent[child], edge[child] = at[child], gap[first]
        near = child[edge[child] <= radius]
        label[near] = label[parent[near]]
        levels.append(child)
        down = child[which]
        at[left] = down
        left = left[left != down]
    low, high = label.copy(), label.copy()  # labels below a node, itself included
    for child in reversed(levels):
        np.minimum.at(low, parent[child], low[child])
        np.maximum.at(high, parent[child], high[child])
    inner = np.flatnonzero(parent >= 0)
    key = parent[inner] * 129 + edge[inner]
    order = np.argsort(key)
    children, keys = inner[order], key[order]
    found = label
    stack = [(np.arange(n), root)]
    while stack:
        q, node = stack.pop()
        open_ = (low[node] != label[q]) | (high[node] != label[q])
        q, node = q[open_], node[open_]
        if len(q) > FRONTIER:
            half = len(q) // 2
            stack += [(q[half:], node[half:]), (q[:half], node[:half])]
            continue
        gap = _gap(fp[q], fp[node])
        near = (gap <= radius) & (found[q] != found[node])
        if near.any():
            found = spanning(n, q[near], node[near], found)
        a = np.searchsorted(keys, node * 129 + np.maximum(gap - radius, 0), "left")
        b = np.searchsorted(keys, node * 129 + np.minimum(gap + radius, 128), "right")
        m = b - a
        if m.any():
            q = np.repeat(q, m)
            stack.append((q, children[np.arange(len(q)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(a, m)]))
    return found


def _tree_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def edges(rows: np.ndarray) -> pa.RecordBatch:
        # The smallest node of a shard is its root, so that shards with the same texts name the same links.
        rows = rows[:, np.lexsort((rows[1], rows[0]))]
        label = tree_labels(rows[0], rows[2:].T.astype(np.int64).view(np.uint64), RADIUS)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(rows[1][linked]), pa.array(rows[1][label[linked]])], ["a", "b"])

    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([batch.column(k).to_numpy() for k in range(4)]))
        if sum(x.shape[1] for x in held) >= UNIT_ROWS:
            rows = np.concatenate(held, 1)
            whole = int(np.searchsorted(rows[0], rows[0, -1]))  # the last unit may go on
            if whole:
                yield edges(rows[:, :whole])
            held = [rows[:, whole:]]
    if held and sum(x.shape[1] for x in held):
        yield edges(np.concatenate(held, 1))


def _choices() -> list[tuple[int, int]]:
    """The bits that each table looks at, as masks of both halves."""
    random, masks = np.random.default_rng(SEED), []
    for _ in range(TABLES):
        bits = np.zeros(128, np.uint8)
        bits[random.choice(128, BITS, replace=False)] = 1
        masks.append(tuple(np.packbits(bits).view(np.int64).tolist()))
    return masks


def proposed(nodes: DataFrame, scratch: Scratch, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Distinct (node, f0, f1) -> links (a, b) that connect all that meet in a shard within the radius."""
    shard = F.array(*[F.xxhash64(F.lit(t), F.col("f0").bitwiseAND(F.lit(x)), F.col("f1").bitwiseAND(F.lit(y))) for t, (x, y) in enumerate(_choices())])
    rows = nodes.select(F.explode(shard).alias("shard"), "node", "f0", "f1")
    hot = rows.groupBy("shard").count().filter(F.col("count") > shard_rows)
    hot = scratch.table(hot.select(F.col("shard").alias("_shard"), F.ceil(F.col("count") / shard_rows).cast("int").alias("_parts")))
    rows = rows.join(hot, F.col("shard") == F.col("_shard"), "left")
    own = F.pmod(F.xxhash64("node", F.lit("part")), F.col("_parts").cast("bigint")).cast("int")
    rows = rows.select(F.explode(_meetings("shard", "_parts", own)).alias("unit"), "node", "f0", "f1")
    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(_tree_edges, "a bigint, b bigint").distinct()


def _meetings(name: str, parts: str, own: Column) -> Column:
    """The units in which a row of part ``own`` meets the others: one for each other part."""
    each = F.filter(F.sequence(F.lit(0), F.col(parts) - 1), lambda other: other != own)
    pairs = F.transform(each, lambda other: F.xxhash64(F.col(name), F.least(own, other), F.greatest(own, other)))
    return F.when(F.coalesce(F.col(parts), F.lit(1)) == 1, F.array(F.col(name))).otherwise(pairs)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    up, down = SIMILAR
    most, least = max(len(a), len(b)), min(len(a), len(b))
    if least * down < most * up:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * down >= up * (len(a) + len(b) - both)


def verified(sets: list[np.ndarray]) -> list[int]:
    """Label of each set: those that links of similar sets connect have the same one."""
    label = list(range(len(sets)))

    def find(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    def meet(a: int, b: int) -> bool:
        x, y = find(a), find(b)
        if x != y and similar(sets[a], sets[b]):
            label[max(x, y)] = min(x, y)
            return True
        return x == y

    up, down = SIMILAR
    prefixes = [s[: len(s) - -(-len(s) * up // down) + 1].tolist() for s in sets]
    leaders: dict[int, list[int]] = defaultdict(list)
    for i, prefix in enumerate(prefixes):
        others = sorted({x for t in prefix for x in leaders.get(t, ())})
        if not sum(meet(x, i) for x in others):
            for t in prefix:
                leaders[t].append(i)
    rows: dict[int, list[int]] = defaultdict(list)
    for i, prefix in enumerate(prefixes):
        for t in prefix:
            rows[t].append(i)
    tried = set()
    for same in rows.values():
        groups = defaultdict(list)
        for i in same:
            groups[find(i)].append(i)
        if len(groups) > 1:
            apart = list(groups.values())
            for k, some in enumerate(apart):
                for a in some:
                    for b in (x for more in apart[k + 1 :] for x in more):
                        if (a, b) not in tried:
                            tried.add((a, b))
                            meet(a, b)
    return [find(x) for x in range(len(sets))]


def _set_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def edges(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        label = verified(sets)
        linked = [k for k, x in enumerate(label) if x != k]
        return pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in linked], pa.int64()), pa.array([nodes[label[k]] for k in linked], pa.int64())], ["a", "b"])

    unit, nodes, sets = None, [], []
    for batch in batches:
        for name, node, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if name != unit and nodes:
                yield edges(nodes, sets)
                nodes, sets = [], []
            unit = name
            nodes.append(node)
            sets.append(np.frombuffer(data, np.uint64))
    if nodes:
        yield edges(nodes, sets)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = pa.array([s.tobytes() for s in shingle_sets(batch.column(3))], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), data], ["node", "_group", "_parts", "shingles"])


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", unit_shingles: int = UNIT_SHINGLES) -> DataFrame:
    """Per row its id, ``text_hash``, ``node`` and ``component``, the same for all that verified links connect."""
    scratch = Scratch(docs.sparkSession)
    marked = scratch.table(fingerprints(docs, id_column, text_column))
    nodes = marked.groupBy("node").agg(F.min("f0").alias("f0"), F.min("f1").alias("f1"), F.min("size").alias("size"), F.min("text_hash").alias("hash"))
    nodes = scratch.table(nodes)
    groups = components(proposed(nodes.select("node", "f0", "f1"), scratch), scratch).withColumnRenamed("component", "_group")
    member = scratch.table(nodes.filter("size > 0").join(groups, "node").select("node", "hash", "size", "_group"))
    sizes = member.groupBy("_group").agg(F.ceil(F.sum("size") / unit_shingles).cast("int").alias("_parts"))
    member = member.join(sizes, "_group").select("node", "_group", "_parts", "hash")
    texts = docs.select(F.col(text_column).alias("text"), F.xxhash64(F.col(text_column)).alias("hash")).join(member, "hash")
    one = texts.groupBy("node", "_group", "_parts").agg(F.first("text").alias("text"))
    sets = one.mapInArrow(_sets, "node bigint, _group bigint, _parts int, shingles binary")
    own = F.pmod(F.xxhash64("node", F.lit("part")), F.col("_parts").cast("bigint")).cast("int")
    units = sets.select(F.explode(_meetings("_group", "_parts", own)).alias("unit"), "node", "shingles")
    links = units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_set_edges, "a bigint, b bigint")
    found = components(links, scratch)
    same = marked.join(found, "node", "left")
    return same.select(id_column, "text_hash", "node", F.coalesce("component", "node").alias("component"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group of near copies, with all its columns: that with the smallest (id, hash of the
    text), null ids first. Of rows that agree in both, one stays."""
    return keep_least(docs, near_copies(docs, id_column, text_column), id_column, text_column)
