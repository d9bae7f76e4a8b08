"""Embedding near-dedup by a forest of random-projection trees (2).

A tree splits the unit sphere again and again at the median of a random direction, until the largest
label has about ``leaf_rows`` vectors a leaf. A vector within ``spill`` / sqrt(dimension) of a split goes
down both sides, so a pair is parted only if its projections differ by more than twice that; projections
of unit vectors shrink with the root of the dimension, so the share of vectors that spill does not depend
on it. Vectors are compared within the leaves of ``trees`` such trees, in double precision, only with equal
label and dimension.

Directions and medians come from a sample of ``fit_rows`` vectors (those with the smallest hash), fitted in
one task; every vector is then dealt to its leaves. Where the sample has fewer than ``SUPPORT`` rows a node,
the splits go on with one random direction for each further level, at the median of the node's part of the
sample along it. So the depth follows the size of the largest label, and the forest stays small: a number
for each node of the sample's tree and further level. A leaf above ``unit_rows`` is cut into parts that meet
pairwise as separate units, so no leaf is whole in one task.

Equal vectors are one node with a count, so copies cost nothing. A linked pair is counted once, in the
first leaf that both share; each unit sends a link count per vector and a spanning forest of its links,
never the pairs themselves.

Defined results: vectors that are null, zero or hold null or non-finite components, or whose label is
null, link with nothing. Vectors of different dimension never link. Rows with the same vec_id are
vectors of their own. A null vec_id is no smaller than others. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from gridpulse.llm.bktree import spanning
from gridpulse.llm.common import Scratch, fit_in_one_task, units_of_work
from gridpulse.llm.components import components

COSINE = 0.93
TREES, LEAF_ROWS, SPILL, FIT_ROWS, SUPPORT, UNIT_ROWS, TILE = 4, 256, 0.15, 20_000, 32, 1024, 512


def unit_vectors(flat: np.ndarray, dim: int) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that squares neither vanish nor overflow."""
    rows = flat.reshape(-1, dim).astype(np.float64)
    rows /= np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


class Tree:
    """A complete tree: node k has the children 2k + 1 and 2k + 2, a direction and a threshold. Below it,
    each further level has one direction, and a threshold for each leaf of the tree."""

    def __init__(self, sample: np.ndarray, depth: int, random: np.random.Generator, further: int = 0) -> None:
        self.depth = depth
        nodes = (1 << depth) - 1
        self.directions = random.standard_normal((nodes, sample.shape[1]))
        self.directions /= np.linalg.norm(self.directions, axis=1, keepdims=True)
        self.thresholds = np.zeros(nodes)
        at = np.zeros(len(sample), np.int64)
        for level in range(depth):
            for node in range((1 << level) - 1, (2 << level) - 1):
                here = np.flatnonzero(at == node)
                along = sample[here] @ self.directions[node]
                self.thresholds[node] = np.median(along) if len(here) else 0.0
                at[here] = 2 * node + 1 + (along > self.thresholds[node])
        self.further = random.standard_normal((further, sample.shape[1]))
        self.further /= np.linalg.norm(self.further, axis=1, keepdims=True)
        self.medians = np.zeros((1 << depth, further))
        for leaf in np.unique(at) if further else ():
            self.medians[leaf - nodes] = np.median(sample[at == leaf] @ self.further.T, axis=0)

    def leaves(self, rows: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf), a row once for each leaf that it reaches."""
        row, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for _ in range(self.depth):
            along = np.einsum("ij,ij->i", rows[row], self.directions[node]) - self.thresholds[node]
            left, right = along <= spill, along > -spill
            row = np.concatenate([row[left], row[right]])
            node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        leaf = path = node - ((1 << self.depth) - 1)
        for direction, medians in zip(self.further, self.medians.T, strict=True):
            along = rows[row] @ direction - medians[leaf]
            left, right = along <= spill, along > -spill
            row = np.concatenate([row[left], row[right]])
            path = np.concatenate([2 * path[left], 2 * path[right] + 1])
            leaf = np.concatenate([leaf[left], leaf[right]])
        return row, path


def fit(sample: dict[int, np.ndarray], depths: dict[int, int], trees: int, seed: int = 7) -> dict[int, list[Tree]]:
    """Trees for each dimension that the sample has, as deep as ``depths`` says."""
    out = {}
    for dim, rows in sample.items():
        random = np.random.default_rng([seed, dim])
        deep = max(0, min(depths[dim], int(np.log2(max(1, len(rows) / SUPPORT)))))
        out[dim] = [Tree(rows, deep, random, depths[dim] - deep) for _ in range(trees)]
    return out


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets


def _by_dimension(column: pa.ChunkedArray) -> dict[int, np.ndarray]:
    """Unit vectors of each dimension."""
    parts: dict[int, list[np.ndarray]] = {}
    for chunk in (x for x in column.chunks if len(x)):
        flat, offsets = _vectors(chunk)
        size = np.diff(offsets)
        for dim in np.unique(size).tolist():
            own = np.flatnonzero(size == dim)
            parts.setdefault(dim, []).append(unit_vectors(flat[(offsets[own][:, None] + np.arange(dim)).ravel()], dim))
    return {dim: np.concatenate(x) for dim, x in parts.items()}


def _router(forests, spill: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = _vectors(batch.column(0))
            size = np.diff(offsets)
            row_leaf: list[np.ndarray] = []
            for dim in np.unique(size):
                own = np.flatnonzero(size == dim)
                rows = unit_vectors(flat[(offsets[own][:, None] + np.arange(dim)).ravel()], int(dim))
                for number, tree in enumerate(forests.value.get(int(dim), ())):
                    row, leaf = tree.leaves(rows, spill / np.sqrt(dim))
                    row_leaf.append(np.stack([own[row], (number << 48) + leaf]))
                if int(dim) not in forests.value:  # not in the sample: one leaf
                    row_leaf.append(np.stack([own, np.zeros(len(own), np.int64)]))
            row, leaf = np.concatenate(row_leaf, 1) if row_leaf else np.zeros((2, 0), np.int64)
            order = np.lexsort((leaf, row))
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(row[order], np.arange(batch.num_rows + 1)).astype(np.int32)), pa.array(leaf[order])
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "leaves"])

    return run


def _first_shared(leaves: np.ndarray, i: np.ndarray, j: np.ndarray, leaf: int) -> np.ndarray:
    """Whether no leaf before ``leaf`` holds both of a pair. ``leaves``: sorted per row, -1 beyond."""
    fresh = np.ones(len(i), bool)
    width = int((leaves < leaf).astype(int).cumprod(1).sum(1).max(initial=0))
    for x in range(width):
        a = leaves[i, x]
        known = (a >= 0) & (a < leaf)
        for y in range(width):
            fresh &= ~(known & (a == leaves[j, y]))
    return fresh


def _compare(batch: pa.Table, cosine: float) -> pa.RecordBatch:
    """One unit: per vector the number of vectors that it links with here, and a forest of the links."""
    node = batch["node"].to_numpy()
    copies = batch["copies"].to_numpy()
    part = batch["part"].to_numpy()
    leaf = batch["leaf"][0].as_py()
    flat, _ = _vectors(batch["embedding"].combine_chunks())
    rows = unit_vectors(flat, len(flat) // len(node))
    own = batch["leaves"].combine_chunks()
    width = np.diff(own.offsets.to_numpy())
    leaves = np.full((len(node), int(width.max())), -1, np.int64)
    leaves[np.arange(leaves.shape[1]) < width[:, None]] = own.values.to_numpy()
    first = np.flatnonzero(part == 0)
    second = np.flatnonzero(part == 1)
    within = not len(second)
    if within:
        second = first
    links, label = np.zeros(len(node), np.int64), np.arange(len(node))
    for a in range(0, len(first), TILE):
        for b in range(a if within else 0, len(second), TILE):
            i, j = first[a : a + TILE], second[b : b + TILE]
            x, y = np.nonzero(rows[i] @ rows[j].T >= cosine)
            i, j = i[x], j[y]
            keep = i < j if within else np.ones(len(i), bool)
            i, j = i[keep], j[keep]
            fresh = _first_shared(leaves, i, j, leaf)
            i, j = i[fresh], j[fresh]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            label = spanning(len(node), i, j, label)
    linked = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays(
        [pa.array(node[linked]), pa.array(links[linked]), pa.array(node[label[linked]])], ["node", "links", "other"]
    )


def _comparer(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            unit = held["unit"].to_numpy()
            at = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            for a, b in zip(at[:-1], at[1:], strict=True):
                yield _compare(held.slice(a, b - a), cosine)
            held = held.slice(at[-1])  # the last unit may go on
        if held is not None:
            yield _compare(held, cosine)

    return run


def near_duplicates(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
    cosine: float = COSINE, trees: int = TREES, leaf_rows: int = LEAF_ROWS, spill: float = SPILL, fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """Per row its id, ``n_links``, ``component_id`` and ``kept``."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    infinite = F.lit(float("inf"))
    usable = F.col("label").isNotNull() & F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)) & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    source = vectors.select(
        F.col(id_column).alias("id"), F.col(label_column).alias("label"), F.col(vector_column).alias("embedding")
    )
    # The number of a row depends on the scan, so it is written before anything is joined by it. Two
    # hashes of 64 bits stand for a vector with its label.
    rows = scratch.table(source.select(
        "id", "label", "embedding", usable.alias("usable"), F.monotonically_increasing_id().alias("row"),
        F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding", "label").alias("h2"),
    ))
    usable_rows = rows.filter("usable")
    nodes = usable_rows.groupBy("h1", "h2").agg(
        F.min("row").alias("node"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"),
    )
    nodes = scratch.table(nodes)
    # One row a dimension: the size of its largest label.
    largest = nodes.groupBy("label", F.size("embedding").alias("dim")).count().groupBy("dim").agg(F.max("count").alias("n")).collect()
    depths = {r.dim: max(0, int(np.ceil(np.log2(r.n / leaf_rows)))) for r in largest}

    def grow(sample: pa.Table) -> dict[int, list[Tree]]:
        return fit(_by_dimension(sample["embedding"]), depths, trees)

    sample = nodes.orderBy(F.xxhash64("h1"), "h1", "h2").limit(fit_rows).select("embedding")
    forests = spark.sparkContext.broadcast(fit_in_one_task(sample, grow))
    # The vector goes first: the router reads it there.
    plain = nodes.select("embedding", "node", "copies", "label")
    routed = scratch.table(plain.mapInArrow(_router(forests, spill), StructType([*plain.schema, StructField("leaves", ArrayType(LongType()))])))
    dealt = routed.select("*", F.explode("leaves").alias("leaf"))
    dealt = dealt.withColumn("shard", F.xxhash64("label", F.size("embedding"), "leaf"))
    units = units_of_work(dealt, "shard", "node", UNIT_ROWS)
    units = units.select("unit", "part", "node", "copies", "leaf", "embedding", "leaves")
    found = scratch.table(units.mapInArrow(_comparer(cosine), "node bigint, links bigint, other bigint"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")), scratch)
    member = nodes.select("h1", "h2", "node", "copies").join(links, "node", "left").join(joined, "node", "left")
    member = member.select("h1", "h2", "copies", "links", F.coalesce("component", "node").alias("component"))
    # Per group of equal vectors its smallest id, then per component.
    smallest = usable_rows.groupBy("h1", "h2").agg(F.min("id").alias("first"))
    member = scratch.table(member.join(smallest, ["h1", "h2"]))
    least = member.groupBy("component").agg(F.min("first").alias("component_id"))
    member = member.join(least, "component").select(
        "h1", "h2", F.lit(True).alias("usable"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id",
    )
    out = rows.select("id", "h1", "h2", "usable").join(member, ["h1", "h2", "usable"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col(id_column).eqNullSafe(F.col("component_id")))
