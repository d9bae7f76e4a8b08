"""Random forest classifier (M5), grown by one job a level for all trees together.

Features are cut once into bins (all values apart if there are few, else quantiles) and the rows are written
once as chunks, each a matrix of bins by feature, at most ``CHUNK_CELLS`` bins large. With few chunks every
chunk is written for several slices of the trees, so that all cores have work. For each level a task takes its
chunk, draws a Poisson(1) weight for each row and tree again (from the seed, the tree and the chunk), follows
the splits so far into the open nodes and counts (feature, bin, class) for the features drawn for each node.
Counts are sent sparse or dense, whichever is shorter, in parts of up to ``PART_CELLS`` counts; they are added up
and searched by Gini gain, and the driver sees one row of numbers per open node. No row moves after the chunks
are written, and what a task holds does not grow with the rows or the nodes.

Stopping, sampling of features and the merging of leaves that predict the same are those of Spark's own trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.operators.boosting import quantile_edges
from gridpulse.session import scratch_path

CHUNK_CELLS = 20_000_000  # bins that a task holds
PART_CELLS = 500_000  # counts that a task holds, and that are added up and searched at once
CHUNKS_AT_ONCE = 32  # with more chunks, fewer counts of each are added up at once
ROWS_AT_ONCE = 4096  # in scoring
SMALL_NODE = 2000  # rows; nodes below are counted together
MOST_CLASSES = 256
LEAST_GAIN = 1e-12
# Weights of a row in a bootstrap, by 16 random bits.
POISSON = np.searchsorted(np.cumsum([np.exp(-1) / np.prod(np.arange(1.0, k + 1)) for k in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


@dataclass
class _Tree:
    """Nodes in lists, children after their parents; a leaf has feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    parent: list[int] = field(default_factory=lambda: [-1])
    gain: list[float] = field(default_factory=lambda: [-1.0])
    counts: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0)])

    def split(self, node: int, feature: int, bin_: int, gain: float, on_left: np.ndarray) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.gain[node] = feature, bin_, gain
        self.left[node], self.right[node] = pair = len(self.feature), len(self.feature) + 1
        for counts in (on_left, self.counts[node] - on_left):
            for column, x in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.parent, node), (self.gain, -1.0), (self.counts, counts)):
                column.append(x)
        return pair


@dataclass
class _Level:
    """What a job needs of one tree: the splits on the way to its open nodes, their places, and the features
    drawn for each."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    live: np.ndarray
    place: np.ndarray
    drawn: np.ndarray


def _level(tree: _Tree, open_: list[int], width: int, some: int, seed: list[int]) -> _Level:
    live, place = np.zeros(len(tree.feature), bool), np.full(len(tree.feature), -1)
    place[open_] = np.arange(len(open_))
    for node in open_:
        while node >= 0 and not live[node]:
            live[node], node = True, tree.parent[node]
    drawn = np.argsort(np.random.default_rng([*seed, open_[0]]).random((len(open_), width)), 1)[:, :some]
    return _Level(*(np.array(x) for x in (tree.feature, tree.bin, tree.left, tree.right)), live, place, drawn)


def weights(seed: int, tree: int, chunk: int, rows: int) -> np.ndarray:
    """How often each row of a chunk is in the bootstrap of a tree."""
    return POISSON[np.random.default_rng([seed, tree, chunk]).integers(0, 1 << 16, rows, np.uint16)]


def _members(level: _Level, bins: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The rows in each open node."""
    out: list[np.ndarray] = [rows[:0]] * len(level.drawn)
    stack = [(0, rows)]
    while stack:
        node, at = stack.pop()
        if level.place[node] >= 0:
            out[level.place[node]] = at
        elif level.live[node] and len(at):
            goes = bins[level.feature[node]].take(at) <= level.bin[node]
            stack += [(level.left[node], at[goes]), (level.right[node], at[~goes])]
    return out


def _counts(members: list[np.ndarray], drawn: np.ndarray, coded: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Weighted rows per (node, drawn feature, code); ``coded`` has bin and class of each (feature, row)."""
    some = drawn.shape[1]
    out = np.zeros((len(members), some, size))
    small = [k for k, at in enumerate(members) if 0 < len(at) < SMALL_NODE]
    if small:
        at = np.concatenate([members[k] for k in small])
        node = np.repeat(np.array(small), [len(members[k]) for k in small])
        index = (node[:, None] * some + np.arange(some)) * size + coded[drawn[node], at[:, None]]
        out += np.bincount(index.ravel(), np.repeat(weight[at], some), out.size).reshape(out.shape)
    for k, at in enumerate(members):
        if len(at) >= SMALL_NODE:
            own = weight.take(at).astype(float)
            for j in range(some):
                out[k, j] = np.bincount(coded[drawn[k, j]].take(at), own, size)
    return out


def _packed(counts: np.ndarray) -> tuple[bytes, bytes]:
    """(places, counts) of those that are not 0, or no places and all counts."""
    flat = counts.ravel().astype(np.uint32)
    at = np.flatnonzero(flat).astype(np.uint32)
    return (b"", flat.tobytes()) if 2 * len(at) > len(flat) else (at.tobytes(), flat[at].tobytes())


def best_splits(counts: np.ndarray) -> np.ndarray:
    """(gain, place of the drawn feature, bin, rows of each class on the left, and in all) for each node, from
    its rows per (drawn feature, bin, class). Rows up to the bin go left; the first of equal gains is taken."""
    runs = counts.cumsum(2)
    total = runs[:, :1, -1:]
    left, right = runs[:, :, :-1], total - runs[:, :, :-1]
    squares = lambda c: (c * c).sum(-1)
    n, on_left, on_right = total.sum(-1), left.sum(-1), right.sum(-1)
    fits = (on_left > 0) & (on_right > 0)
    # Gini impurity of a side times its rows is its rows less this quotient, so rows cancel out.
    gain = (squares(left) / np.maximum(on_left, 1) + squares(right) / np.maximum(on_right, 1) - squares(total) / np.maximum(n, 1)) / np.maximum(n, 1)
    gain = np.where(fits, gain, -1.0).reshape(len(counts), -1)
    at, nodes = gain.argmax(1) if gain.shape[1] else np.zeros(len(counts), int), np.arange(len(counts))
    j, b = np.divmod(at, max(left.shape[2], 1))
    own = gain[nodes, at] if gain.shape[1] else np.full(len(counts), -1.0)
    return np.concatenate([np.stack([own, j, b], 1), runs[nodes, j, b], total[:, 0, 0]], 1)


def feature_cuts(values: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Cuts of each feature; a value is in the bin of the first cut that is not below it. Up to ``bins``
    different values have a cut between any two, others quantiles."""

    def add(known: np.ndarray | None, more: np.ndarray) -> np.ndarray | None:
        if known is None:
            return None
        both = np.unique(np.concatenate([known, more]))
        return both if len(both) <= bins else None

    def table(features: list[int], known: list[np.ndarray | None]) -> pa.Table:
        return pa.table({"feature": pa.array(features, pa.int32()), "known": pa.array([None if v is None else v.tolist() for v in known], pa.list_(pa.float64()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[np.ndarray | None] = [np.zeros(0)] * width
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            known = [None if v is None else add(v, x[:, f]) for f, v in enumerate(known)]
        yield from table([*range(width)], known).to_batches()

    def merge(key: tuple, found: pa.Table) -> pa.Table:
        known: np.ndarray | None = np.zeros(0)
        for v in found["known"].to_pylist():
            known = None if v is None else add(known, np.array(v, float))
        return table([key[0].as_py()], [known])

    schema = "feature int, known array<double>"
    rows = values.select("x").mapInArrow(run, schema).groupBy("feature").applyInArrow(merge, schema).collect()
    known = {r.feature: r.known for r in rows}
    wide = [f for f in range(width) if known.get(f) is None]
    quantiles = dict(zip(wide, quantile_edges(values.select(F.array(*[F.col("x")[f] for f in wide]).alias("x")), len(wide), bins), strict=True)) if wide else {}
    cuts = []
    for f in range(width):
        v = np.array(known.get(f) or [], float)
        between = (v[:-1] + v[1:]) / 2
        cuts.append(quantiles[f] if f in quantiles else np.unique(between[~np.isnan(between)]))
    return cuts


def _write_chunks(values: DataFrame, cuts: list[np.ndarray], chunks: int, slices: int, path: str) -> None:
    """One file per (chunk, slice): bins by feature, and the classes."""
    width = len(cuts)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            out = np.empty((len(x), width + 1), np.uint8)
            for f, c in enumerate(cuts):
                out[:, f] = np.searchsorted(c, x[:, f], "left")
            out[:, width] = batch.column("y").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in out], pa.binary())], ["row"])

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in b.column("row").to_pylist())  # the same chunk in every run
        table = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), width + 1).T.copy()
        for k in range(slices) if rows else ():
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([k], pa.int32()), pa.array([table.tobytes()], pa.binary())], ["chunk", "slice", "bins"]
            )

    rows = values.mapInArrow(binned, "row binary").repartition(chunks)
    rows.mapInArrow(chunk, "chunk int, slice int, bins binary").write.option("maxRecordsPerFile", 1).parquet(path)


def _found(table: DataFrame, levels: dict[int, _Level], slices: int, width: int, bins: int, classes: int, seed: int, tasks: int, part: int) -> dict[int, np.ndarray]:
    """``best_splits`` of the open nodes of each tree, ``part`` of them at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            data = np.frombuffer(row["bins"], np.uint8).reshape(width + 1, -1)
            coded = data[:width] * np.uint32(classes) + data[width]
            coded = coded.astype(np.uint16) if bins * classes <= 1 << 16 else coded
            for tree, level in levels.items():
                if tree % slices != row["slice"]:
                    continue
                weight = weights(seed, tree, row["chunk"], data.shape[1])
                members = _members(level, data, np.flatnonzero(weight))
                for first in range(0, len(members), part):
                    packed = _packed(_counts(members[first : first + part], level.drawn[first : first + part], coded, weight, bins * classes))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([tree], pa.int32()), pa.array([first], pa.int32()), pa.array([packed[0]], pa.binary()), pa.array([packed[1]], pa.binary())], ["tree", "first", "places", "counts"]
                    )

    def search(key: tuple, told: pa.Table) -> pa.Table:
        drawn = levels[key[0].as_py()].drawn[key[1].as_py() :][:part]
        total = np.zeros(drawn.size * bins * classes)
        for places, counts in zip(told["places"], told["counts"], strict=True):
            at, own = np.frombuffer(places.as_py(), np.uint32), np.frombuffer(counts.as_py(), np.uint32)
            if len(own) == len(total):
                total += own
            else:
                total[at] += own
        best = best_splits(total.reshape(*drawn.shape, bins, classes))
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "first": pa.array([key[1].as_py()], pa.int32()), "best": pa.array([best.tobytes()], pa.binary())})

    told = table.mapInArrow(count, "tree int, first int, places binary, counts binary").repartition(tasks, "tree", "first")
    rows = told.groupBy("tree", "first").applyInArrow(search, "tree int, first int, best binary").collect()
    out: dict[int, list[np.ndarray]] = {}
    for r in sorted(rows, key=lambda r: (r.tree, r.first)):
        out.setdefault(r.tree, []).append(np.frombuffer(r.best).reshape(-1, 3 + 2 * classes))
    return {tree: np.concatenate(parts) for tree, parts in out.items()}


def _pruned(tree: _Tree) -> list[int]:
    """Ids of the nodes that stay, in order; splits of leaves that predict the same become leaves."""
    says = [int(c.argmax()) for c in tree.counts]
    for node in range(len(says) - 1, -1, -1):
        if tree.feature[node] >= 0:
            a, b = tree.left[node], tree.right[node]
            if tree.feature[a] < 0 and tree.feature[b] < 0 and says[a] == says[b]:
                tree.feature[node], says[node] = -1, says[a]
    kept = [True]
    for node in range(1, len(says)):
        up = tree.parent[node]
        kept.append(kept[up] and tree.feature[up] >= 0)
    return [node for node, stays in enumerate(kept) if stays]


def _kept(tree: _Tree, cuts: list[np.ndarray]) -> dict[str, np.ndarray]:
    """The pruned tree in arrays, as a model has it; children of a leaf are the leaf itself."""
    nodes = _pruned(tree)
    place, leaf = {node: k for k, node in enumerate(nodes)}, [tree.feature[node] < 0 for node in nodes]
    counts = np.array([tree.counts[node] for node in nodes])
    return {
        "feature": np.array([tree.feature[node] for node in nodes]),
        "cut": np.array([0.0 if end else cuts[tree.feature[node]][tree.bin[node]] for node, end in zip(nodes, leaf, strict=True)]),
        "left": np.array([k if end else place[tree.left[nodes[k]]] for k, end in enumerate(leaf)]),
        "right": np.array([k if end else place[tree.right[nodes[k]]] for k, end in enumerate(leaf)]),
        "shares": counts / np.maximum(counts.sum(1, keepdims=True), 1),
    }


def leaves(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The leaf that each row comes to; ``x`` has the values by feature."""
    many = x.shape[1]
    flat, node, at, out = x.ravel(), np.zeros(many, np.intp), np.arange(many), np.zeros(many, np.intp)
    feature, cut, child = tree["feature"], tree["cut"], np.stack([tree["right"], tree["left"]], 1).ravel()
    start = feature * many
    while len(at):
        ends = feature.take(node) < 0
        if ends.any():
            out[at[ends]] = node[ends]
            at, node = at[~ends], node[~ends]
        goes = flat.take(start.take(node) + at) <= cut.take(node)
        node = child.take(2 * node + goes)
    return out


@dataclass
class FittedTree:
    """What is told of a tree."""

    numNodes: int
    depth: int


class ForestModel(Model, MLReadable, MLWritable):
    """The fitted trees as a row-wise stage: a row's chances are the mean of its leaves' shares of each class.
    It takes a batch or a stream, is saved and loaded."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "class", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "vector of the classes' probabilities", TypeConverters.toString)
    maxMemoryInMB = Param(Params._dummy(), "maxMemoryInMB", "bound of the histograms of the nodes that are split at once", TypeConverters.toInt)

    def __init__(self, forest: list[dict[str, np.ndarray]] | None = None, **params) -> None:
        super().__init__()
        self.forest = forest or []
        self._set(**params)

    def getMaxMemoryInMB(self) -> int:
        return self.getOrDefault("maxMemoryInMB")

    @property
    def trees(self) -> list[FittedTree]:
        out = []
        for tree in self.forest:
            depth = np.zeros(len(tree["feature"]), int)
            for node in np.flatnonzero(tree["feature"] >= 0):
                depth[[tree["left"][node], tree["right"][node]]] = depth[node] + 1
            out.append(FittedTree(len(depth), int(depth.max())))
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared, classes = dataset.sparkSession.sparkContext.broadcast(self.forest), self.forest[0]["shares"].shape[1]

        def chances(values: pa.Array) -> pa.Array:
            rows = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
            out = np.zeros((len(rows), classes))
            for first in range(0, len(rows), ROWS_AT_ONCE):
                x = np.ascontiguousarray(rows[first : first + ROWS_AT_ONCE].T)
                for tree in shared.value:
                    out[first : first + ROWS_AT_ONCE] += tree["shares"].take(leaves(tree, x), 0)
            total = out.sum(1, keepdims=True)
            out /= np.where(total > 0, total, 1.0)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * classes, pa.int32()), pa.array(out.ravel()))

        found = F.arrow_udf(chances, "array<double>")(vector_to_array(F.col(self.getOrDefault("featuresCol"))))
        told = dataset.withColumn("_chances", found)
        place = F.array_position("_chances", F.array_max("_chances")) - 1
        columns = {self.getOrDefault("probabilityCol"): array_to_vector("_chances"), self.getOrDefault("predictionCol"): place.cast("double")}
        return told.withColumns(columns).drop("_chances")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: ForestModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        trees = self.model.forest
        table = {"tree": np.repeat(np.arange(len(trees)), [len(t["feature"]) for t in trees])}
        table |= {"node": np.concatenate([np.arange(len(t["feature"])) for t in trees])}
        table |= {c: np.concatenate([t[c] for t in trees]) for c in ("feature", "cut", "left", "right")}
        shares = pa.array(np.concatenate([t["shares"] for t in trees]).tolist(), pa.list_(pa.float64()))
        self.sparkSession.createDataFrame(pa.table(table | {"shares": shares})).coalesce(1).write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        table = self.sparkSession.read.parquet(f"{path}/trees").orderBy("tree", "node").toArrow()
        columns = {c: table[c].to_numpy() for c in ("feature", "cut", "left", "right")} | {"shares": np.array(table["shares"].to_pylist())}
        ends = np.flatnonzero(np.diff(table["tree"].to_numpy())) + 1
        model = ForestModel([dict(zip(columns, parts, strict=True)) for parts in zip(*(np.split(v, ends) for v in columns.values()), strict=True)])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def fit_forest(
    train: DataFrame, features: str, label: str, prediction: str, probability: str, trees: int = 200, depth: int = 14, bins: int = 256, seed: int = 42, memory_mb: int = 256
) -> ForestModel:
    """``trees`` of up to ``depth`` levels, with a bootstrap and the root of the number of features drawn for
    each node. Labels are 0, 1, ..."""
    spark = train.sparkSession
    values = train.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    fits = F.coalesce((F.col("y") >= 0) & (F.col("y") < MOST_CLASSES) & (F.col("y") == F.floor("y")), F.lit(False))
    head = values.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width"), F.max("y").alias("most"), F.count_if(~fits).alias("odd")).first()
    if not head.n or head.odd:
        raise ValueError(f"a forest needs rows, with labels that are whole numbers below {MOST_CLASSES}: {head.n} rows, {head.odd} other labels")
    width, classes = head.width, int(head.most) + 1
    cuts = feature_cuts(values, width, min(bins, 256))
    bins, some = max(len(c) for c in cuts) + 1, max(1, int(np.ceil(np.sqrt(width))))
    cores = spark.sparkContext.defaultParallelism
    chunks = -(-head.n // max(1, CHUNK_CELLS // (width + 1)))
    chunks = -(-chunks // cores) * cores if 2 * chunks > cores else chunks
    slices = min(trees, -(-cores // chunks))
    cells = min(PART_CELLS, memory_mb * (1 << 20) // 64)  # a count takes 64 bytes while splits are searched
    part = max(1, cells // (some * bins * classes) // -(-chunks // CHUNKS_AT_ONCE))
    path = scratch_path(spark)
    grown, open_ = [_Tree() for _ in range(trees)], {t: [0] for t in range(trees)}
    try:
        _write_chunks(values, cuts, chunks, slices, path)
        table = spark.read.schema("chunk int, slice int, bins binary").parquet(path)
        for _ in range(depth):
            levels = {t: _level(grown[t], nodes, width, some, [seed, t, 1]) for t, nodes in open_.items()}
            found = _found(table, levels, slices, width, bins, classes, seed, max(cores, chunks), part)
            fresh: dict[int, list[int]] = {}
            for t, best in found.items():
                tree = grown[t]
                for node, drawn, r in zip(open_[t], levels[t].drawn, best, strict=True):
                    tree.counts[node] = r[3 + classes :]
                    if r[0] <= LEAST_GAIN:
                        continue
                    pair = tree.split(node, int(drawn[int(r[1])]), int(r[2]), float(r[0]), r[3 : 3 + classes])
                    fresh.setdefault(t, []).extend(k for k in pair if np.count_nonzero(tree.counts[k]) > 1)
            open_ = {t: nodes for t, nodes in fresh.items() if nodes}
            if not open_:
                break
    finally:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return ForestModel([_kept(t, cuts) for t in grown], featuresCol=features, predictionCol=prediction, probabilityCol=probability, maxMemoryInMB=memory_mb)
