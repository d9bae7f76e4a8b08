"""Histogram gradient boosting (M6, M8): one model for any number of classes, or for a number.

Features are cut once into up to 255 quantile bins, and one for missing values. A round adds one tree per
class (one in all for a regression), fitted to the gradients of the multinomial (or squared) loss. A tree
grows by its best leaves first, up to ``leaves``: a job sums gradients, hessians and rows per (class, new
leaf, feature, bin); tasks send one compact histogram per leaf, they are added up and searched for the
best split by the leaf's own task, and the driver sees one row per leaf. Leaves that hold a gain are
split in the order of their gains until the tree is full, and the next job looks at their children.

Rows keep their running predictions in a table that is written anew every ``KEEP_EVERY`` rounds; between,
tasks add the trees since. So a round reads the compact bins a handful of times and moves no row.
Up to ``ROWS_PER_TASK`` rows (and ``TASK_CELLS`` bins) are one task's share in any case: that task grows all rounds by itself, without
a job a level, and sums the rows of the smaller child only.

With more than ``early_stop_rows`` training rows a tenth of them, drawn by a hash of the features, is held
out, and boosting stops when ten rounds in a row have not lowered its loss by the tolerance.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.session import scratch_path

MISSING = 255  # the bin of missing values
BINS, KEEP_EVERY = 255, 10
LEAST_HESSIAN, TOLERANCE, PATIENCE = 1e-3, 1e-7, 10
SKETCH_ERROR = 5e-4
ROWS_PER_TASK = 100_000
TASK_CELLS = 64 * ROWS_PER_TASK  # bins that a task may hold to grow all rounds by itself
TREE_SCHEMA = "round int, output int, node int, feature int, bin int, cut double, missing_left boolean, left int, right int, value double"


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    cut: list[float] = field(default_factory=lambda: [0.0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin_: int, cut: float, missing_left: bool, values: tuple[float, float]) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.cut[node], self.missing_left[node] = feature, bin_, cut, missing_left
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for v in values:
            for column, x in ((self.feature, -1), (self.bin, 0), (self.cut, 0.0), (self.missing_left, False), (self.left, 0), (self.right, 0), (self.value, v)):
                column.append(x)
        return self.left[node], self.right[node]

    def arrays(self) -> dict[str, np.ndarray]:
        return {c: np.array(getattr(self, c)) for c in ("feature", "bin", "cut", "missing_left", "left", "right", "value")}


def descend(tree: dict[str, np.ndarray], rows: np.ndarray, by: str) -> np.ndarray:
    """The leaf that each row comes to, by ``bin`` (rows of bins) or by ``cut`` (rows of values)."""
    node = np.zeros(len(rows), np.int64)
    moving = np.arange(len(rows)) if tree["feature"][0] >= 0 else np.zeros(0, np.int64)
    while len(moving):
        at = node[moving]
        x = rows[moving, tree["feature"][at]]
        missing = x == MISSING if by == "bin" else np.isnan(x)
        left = np.where(missing, tree["missing_left"][at], x <= tree[by][at])
        node[moving] = np.where(left, tree["left"][at], tree["right"][at])
        moving = moving[tree["feature"][node[moving]] >= 0]
    return node


def probabilities(raw: np.ndarray) -> np.ndarray:
    p = np.exp(raw - raw.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def gradients(raw: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient and hessian of each output, and the loss, of each row."""
    if not classes:
        error = raw - y[:, None]
        return error, np.ones_like(raw), 0.5 * error[:, 0] ** 2
    p = probabilities(raw)
    at = np.arange(len(y)), y.astype(np.int64)
    loss = -np.log(np.maximum(p[at], 1e-300))
    g = p.copy()
    g[at] -= 1
    return g, p * (1 - p), loss


def best_split(hist: np.ndarray, bins: np.ndarray, least_rows: int) -> tuple[float, int, int, bool, np.ndarray]:
    """(gain, feature, bin, whether missing values go left, sums on the left) from the sums (gradient,
    hessian, rows) per feature and bin; ``bins`` are the numbers of cuts of each feature."""
    missing = hist[:, :, MISSING]
    total = hist[:, 0].sum(1)
    runs = np.cumsum(hist[:, :, :MISSING], axis=2)  # up to and with each bin
    best = (0.0, -1, 0, False, total)
    for left_too in (False, True) if missing[2].any() else (False,):
        left = runs + missing[:, :, None] if left_too else runs
        right = total[:, None, None] - left
        fits = (left[2] >= least_rows) & (right[2] >= least_rows) & (left[1] >= LEAST_HESSIAN) & (right[1] >= LEAST_HESSIAN)
        some = (missing[2] > 0)[:, None]
        if left_too:
            fits &= (np.arange(MISSING)[None] < bins[:, None]) & some
        else:  # where values are missing, all the others may be parted from them
            fits &= np.arange(MISSING)[None] < bins[:, None] + some
        score = lambda s: s[0] ** 2 / np.maximum(s[1], 1e-12)
        gain = np.where(fits, score(left) + score(right) - score(total), -np.inf)
        at = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if gain[at] > best[0] + 1e-12:
            best = (float(gain[at]), int(at[0]), int(at[1]), left_too, left[:, at[0], at[1]])
    return best


def quantile_edges(values: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Cuts of each feature; a value is in the bin of the first cut that is not below it."""
    columns = [f"f{k}" for k in range(width)]
    flat = values.select(*[F.nanvl(F.col("x")[k], F.lit(None).cast("double")).alias(c) for k, c in enumerate(columns)])
    found = flat.approxQuantile(columns, [k / bins for k in range(1, bins)], SKETCH_ERROR)
    return [np.unique(np.array(q, float)) for q in found]


def _binned(values: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            out = np.empty(x.shape, np.uint8)
            for k, cuts in enumerate(edges):
                out[:, k] = np.where(np.isnan(x[:, k]), MISSING, np.searchsorted(cuts, x[:, k], "left"))
            rows = pa.array([r.tobytes() for r in out], pa.binary())
            yield pa.RecordBatch.from_arrays([rows, batch.column("y"), batch.column("held")], ["bins", "y", "held"])

    return values.mapInArrow(run, "bins binary, y double, held boolean")


@dataclass
class Round:
    """What a job needs: trees that the written predictions lack, the growing ones, and their new leaves."""

    since: list[list[dict[str, np.ndarray]]]
    growing: list[dict[str, np.ndarray]]
    leaves: list[list[int]]


def _rows(batch: pa.RecordBatch, outputs: int, since: list[list[dict]]) -> tuple[np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    raw = batch.column("raw").flatten().to_numpy().reshape(batch.num_rows, outputs).copy()
    for trees in since:
        for k, tree in enumerate(trees):
            raw[:, k] += tree["value"][descend(tree, bins, "bin")]
    return bins, raw


class _Found(NamedTuple):
    """A new leaf: its best split, its sums and those on the left, the losses before the round."""

    output: int
    leaf: int
    gain: float
    feature: int
    bin: int
    missing_left: bool
    on_left: np.ndarray
    all: np.ndarray
    loss: np.ndarray


@dataclass
class _Grower:
    """One run of boosting: what to split, whichever way the sums are made."""

    edges: list[np.ndarray]
    baseline: np.ndarray
    classes: int
    leaves: int
    rate: float
    least_rows: int
    rounds: list[list[Tree]] = field(default_factory=list)
    since: list[list[dict[str, np.ndarray]]] = field(default_factory=list)

    @property
    def outputs(self) -> int:
        return len(self.baseline)

    def run(self, rounds: int, stops: bool, patience: int) -> list[tuple[float, float]]:
        """Grow up to ``rounds``; with ``stops`` none after ``patience`` ones that did not lower the loss of
        the rows held out. Gives the losses before each round and after the last."""
        told: list[tuple[float, float]] = []
        while len(self.rounds) < rounds:
            before = self.round()
            if before is None:
                break
            told.append(before)
            held = [b for _, b in told]
            if stops and len(held) > patience and min(held[-patience:]) > held[-patience - 1] - TOLERANCE:
                break
        return [*told, self.losses()]

    def value(self, sums: list[float] | np.ndarray) -> float:
        return -self.rate * sums[0] / max(sums[1], 1e-12)

    def round(self) -> tuple[float, float] | None:
        """Grow one tree per output. Gives the losses before the round; None if nothing could be split."""
        trees = [Tree() for _ in range(self.outputs)]
        fresh, open_, before = [[0] for _ in trees], [{} for _ in trees], None
        while any(fresh):
            found = self.sums(Round(self.since, [t.arrays() for t in trees], fresh))
            if before is None:
                if not found:
                    return None
                s = found[0].loss
                before = (s[0] / max(s[1], 1), s[2] / s[3] if s[3] else float("nan"))
            for r in found:
                if r.leaf == 0:
                    trees[r.output].value[0] = self.value(r.all)
                if r.gain > 0:
                    open_[r.output][r.leaf] = r
            fresh = [[] for _ in trees]
            for k, tree in enumerate(trees):
                full = (len(tree.feature) + 1) // 2
                best = sorted(open_[k].values(), key=lambda r: (-r.gain, r.leaf))[: self.leaves - full]
                for r in best:
                    del open_[k][r.leaf]
                    right = np.array(r.all) - np.array(r.on_left)
                    cuts = self.edges[r.feature]
                    cut = float(cuts[r.bin]) if r.bin < len(cuts) else float("inf")
                    pair = tree.split(r.leaf, r.feature, r.bin, cut, r.missing_left, (self.value(r.on_left), self.value(right)))
                    for leaf, rows in zip(pair, (r.on_left[2], right[2]), strict=True):
                        if rows >= 2 * self.least_rows:
                            fresh[k].append(leaf)
                if (len(tree.feature) + 1) // 2 >= self.leaves:
                    fresh[k] = []
        if all(len(t.feature) == 1 for t in trees):
            return None
        self.rounds.append(trees)
        self.grown([t.arrays() for t in trees])
        return before


class _Booster(_Grower):
    """Over a table of bins."""

    def __init__(self, table: DataFrame, *parts) -> None:
        super().__init__(*parts)
        self.spark, self.path = table.sparkSession, None
        first = F.array(*[F.lit(float(b)) for b in self.baseline])
        self._write(table.withColumn("raw", first))

    def _write(self, table: DataFrame) -> None:
        path, old = scratch_path(self.spark), self.path
        table.write.parquet(path)
        self.table, self.path = self.spark.read.schema("bins binary, y double, held boolean, raw array<double>").parquet(path), path
        if old:
            target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def keep(self) -> None:
        """Write the predictions of all rounds so far."""
        outputs, since = self.outputs, self.since

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = _rows(batch, outputs, since)[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * outputs, pa.int32()), pa.array(raw.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], ["bins", "y", "held", "raw"])

        self._write(self.table.mapInArrow(run, self.table.schema))
        self.since = []

    def grown(self, trees: list[dict[str, np.ndarray]]) -> None:
        self.since.append(trees)
        if len(self.since) == KEEP_EVERY:
            self.keep()

    def sums(self, now: Round) -> list:
        """One row per new leaf with its best split; the first leaf of output 0 also has the losses."""
        outputs, classes, width, least_rows = self.outputs, self.classes, len(self.edges), self.least_rows
        usable = np.array([len(e) for e in self.edges])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slots = [(k, leaf) for k in range(outputs) for leaf in now.leaves[k]]
            hist = {s: np.zeros((3, width, MISSING + 1)) for s in slots}
            losses = np.zeros(4)
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins, raw = _rows(batch, outputs, now.since)
                held = batch.column("held").to_numpy(zero_copy_only=False)
                g, h, loss = gradients(raw, batch.column("y").to_numpy(), classes)
                losses += [loss[~held].sum(), (~held).sum(), loss[held].sum(), held.sum()]
                for k in range(outputs):
                    node = descend(now.growing[k], bins, "bin")
                    for leaf in now.leaves[k]:
                        at = np.flatnonzero((node == leaf) & ~held)
                        if not len(at):
                            continue
                        index = (bins[at].astype(np.int64) + np.arange(width) * (MISSING + 1)).ravel()
                        size = width * (MISSING + 1)
                        own = hist[k, leaf]
                        own[0] += np.bincount(index, np.repeat(g[at, k], width), size).reshape(width, -1)
                        own[1] += np.bincount(index, np.repeat(h[at, k], width), size).reshape(width, -1)
                        own[2] += np.bincount(index, minlength=size).reshape(width, -1)
            task = TaskContext.get().partitionId()
            some = [s for s in slots if hist[s][2].any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s[0] for s in some], pa.int32()), pa.array([s[1] for s in some], pa.int32()), pa.array([task] * len(some), pa.int32()),
                 pa.array([hist[s].tobytes() for s in some], pa.binary()), pa.array([losses.tobytes()] * len(some), pa.binary())],
                ["output", "leaf", "task", "hist", "losses"],
            )

        def search(key: tuple, table: pa.Table) -> pa.Table:
            order = np.argsort(table["task"].to_numpy())  # added in one order
            hists, losses = table["hist"].to_pylist(), table["losses"].to_pylist()
            total, loss = np.zeros((3, width, MISSING + 1)), np.zeros(4)
            for k in order:
                total += np.frombuffer(hists[k]).reshape(total.shape)
                loss += np.frombuffer(losses[k])
            gain, feature, bin_, missing_left, left = best_split(total, usable, least_rows)
            return pa.table({
                "output": [key[0].as_py()], "leaf": [key[1].as_py()], "gain": [gain], "feature": pa.array([feature], pa.int32()), "bin": pa.array([bin_], pa.int32()),
                "missing_left": [missing_left], "on_left": [left.tolist()], "all": [total[:, 0].sum(1).tolist()], "loss": [loss.tolist()],
            }).cast(pa.schema([("output", pa.int32()), ("leaf", pa.int32()), ("gain", pa.float64()), ("feature", pa.int32()), ("bin", pa.int32()),
                               ("missing_left", pa.bool_()), ("on_left", pa.list_(pa.float64())), ("all", pa.list_(pa.float64())), ("loss", pa.list_(pa.float64()))]))

        told = self.table.mapInArrow(run, "output int, leaf int, task int, hist binary, losses binary")
        return told.groupBy("output", "leaf").applyInArrow(
            search, "output int, leaf int, gain double, feature int, bin int, missing_left boolean, on_left array<double>, all array<double>, loss array<double>"
        ).collect()  # one row per new leaf

    def losses(self) -> tuple[float, float]:
        """Mean loss of the rows trained on, and of those held out."""
        outputs, classes, since = self.outputs, self.classes, self.since

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = _rows(batch, outputs, since)[1]
                loss = gradients(raw, batch.column("y").to_numpy(), classes)[2]
                yield pa.RecordBatch.from_arrays([batch.column("held"), pa.array(loss)], ["held", "loss"])

        rows = self.table.mapInArrow(run, "held boolean, loss double").groupBy("held").agg(F.avg("loss").alias("loss")).collect()
        means = {r.held: r.loss for r in rows}
        return means.get(False, 0.0), means.get(True, float("nan"))


class _LocalBooster(_Grower):
    """Over rows in memory. A leaf's sums are its parent's less its sibling's, if it has more rows."""

    def __init__(self, bins: np.ndarray, y: np.ndarray, held: np.ndarray, *parts) -> None:
        super().__init__(*parts)
        self.bins, self.y, self.held, self.own = bins, y, held, np.flatnonzero(~held)
        self.raw = np.tile(self.baseline, (len(y), 1))
        self.usable = np.array([len(e) for e in self.edges])
        self.flat = bins + np.arange(len(self.edges)) * (MISSING + 1)

    def grown(self, trees: list[dict[str, np.ndarray]]) -> None:
        for k, tree in enumerate(trees):
            self.raw[:, k] += tree["value"][descend(tree, self.bins, "bin")]

    def losses(self) -> tuple[float, float]:
        """As ``_Booster.losses``."""
        loss = gradients(self.raw, self.y, self.classes)[2]
        return tuple(float(loss[side].mean()) if side.any() else other for side, other in ((~self.held, 0.0), (self.held, float("nan"))))

    def _histogram(self, k: int, rows: np.ndarray) -> np.ndarray:
        width = len(self.edges)
        index, size = self.flat[rows].ravel(), width * (MISSING + 1)
        sums = [np.bincount(index, None if w is None else np.repeat(w[rows, k], width), size) for w in (self.g, self.h, None)]
        return np.stack(sums).reshape(3, width, -1).astype(float)

    def _part(self, k: int, tree: dict[str, np.ndarray], parent: int, fresh: set[int]) -> None:
        """Rows and sums of both children of a leaf that was split; sums only where one is new."""
        rows, whole = self.members[k].pop(parent), self.hists[k].pop(parent)
        x = self.bins[rows, tree["feature"][parent]]
        goes = np.where(x == MISSING, tree["missing_left"][parent], x <= tree["bin"][parent])
        pair = {int(tree["left"][parent]): rows[goes], int(tree["right"][parent]): rows[~goes]}
        if fresh & set(pair):
            few, more = sorted(pair, key=lambda leaf: len(pair[leaf]))
            self.hists[k][few] = self._histogram(k, pair[few])
            self.hists[k][more] = whole - self.hists[k][few]
        self.members[k] |= pair

    def sums(self, now: Round) -> list[_Found]:
        if all(len(t["feature"]) == 1 for t in now.growing):
            self.g, self.h, loss = gradients(self.raw, self.y, self.classes)
            self.loss = np.array([loss[~self.held].sum(), (~self.held).sum(), loss[self.held].sum(), self.held.sum()])
            self.members = [{0: self.own} for _ in now.growing]
            self.hists = [{0: self._histogram(k, self.own)} for k in range(self.outputs)]
        found = []
        for k, (tree, leaves) in enumerate(zip(now.growing, now.leaves, strict=True)):
            for parent in [p for p in self.members[k] if tree["feature"][p] >= 0]:
                self._part(k, tree, parent, set(leaves))
            for leaf in leaves if len(self.own) else []:
                hist = self.hists[k][leaf]
                gain, feature, bin_, missing_left, left = best_split(hist, self.usable, self.least_rows)
                found.append(_Found(k, leaf, gain, feature, bin_, missing_left, left, hist[:, 0].sum(1), self.loss))
        return found


def _grow_in_a_task(table: DataFrame, parts: tuple, rounds: int, stops: bool, patience: int) -> tuple[list[list[Tree]], list[tuple[float, float]]]:
    """Trees and losses as ``_Booster`` finds them, of rows that are few enough for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches, schema)
        bins = np.frombuffer(b"".join(whole["bins"].to_pylist()), np.uint8).reshape(whole.num_rows, -1)
        booster = _LocalBooster(bins, whole["y"].combine_chunks().to_numpy(), whole["held"].to_numpy(), *parts)
        told = booster.run(rounds, stops, patience)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((booster.rounds, told))], pa.binary())], ["grown"])

    schema = pa.schema([("bins", pa.binary()), ("y", pa.float64()), ("held", pa.bool_())])
    return pickle.loads(table.coalesce(1).mapInArrow(run, "grown binary").first().grown)


class HistogramBoostingModel(Model, MLReadable, MLWritable):
    """The fitted trees as a row-wise stage: it takes a batch or a stream, is saved and loaded."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "class or number", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "vector of the classes' probabilities", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for a regression", TypeConverters.toInt)
    baseline = Param(Params._dummy(), "baseline", "prediction before the first round", TypeConverters.toListFloat)
    trainLoss = Param(Params._dummy(), "trainLoss", "mean training loss before each round and after the last", TypeConverters.toListFloat)
    heldOutLoss = Param(Params._dummy(), "heldOutLoss", "the same of the rows held out, empty without any", TypeConverters.toListFloat)

    def __init__(self, rounds: list[list[dict[str, np.ndarray]]] | None = None, **params) -> None:
        super().__init__()
        self.rounds = rounds or []
        self._set(**params)

    @property
    def rounds_used(self) -> int:
        return len(self.rounds)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        baseline, rounds = np.array(self.getOrDefault("baseline")), self.rounds
        shared = dataset.sparkSession.sparkContext.broadcast(rounds)

        def raw(values: pa.Array) -> pa.Array:
            x = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
            out = np.tile(baseline, (len(values), 1))
            for trees in shared.value:
                for k, tree in enumerate(trees):
                    out[:, k] += tree["value"][descend(tree, x, "cut")]
            if len(baseline) > 1:
                out = probabilities(out) if len(out) else out
            return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))

        found = F.arrow_udf(raw, "array<double>")(vector_to_array(F.col(self.getOrDefault("featuresCol"))))
        prediction = self.getOrDefault("predictionCol")
        if not self.getOrDefault("classes"):
            return dataset.withColumn(prediction, found[0])
        told = dataset.withColumn("_chances", found)
        place = F.array_position("_chances", F.array_max("_chances")) - 1
        return told.withColumns({self.getOrDefault("probabilityCol"): array_to_vector("_chances"), prediction: place.cast("double")}).drop("_chances")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: HistogramBoostingModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        rows = [
            (r, k, n, *(tree[c][n].item() for c in ("feature", "bin", "cut", "missing_left", "left", "right", "value")))
            for r, trees in enumerate(self.model.rounds) for k, tree in enumerate(trees) for n in range(len(tree["feature"]))
        ]
        self.sparkSession.createDataFrame(rows, TREE_SCHEMA).coalesce(1).write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> HistogramBoostingModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        table = self.sparkSession.read.schema(TREE_SCHEMA).parquet(f"{path}/trees").orderBy("round", "output", "node").toPandas()
        rounds: list[list[dict[str, np.ndarray]]] = []
        for (r, _), nodes in table.groupby(["round", "output"], sort=True):
            if len(rounds) == r:
                rounds.append([])
            rounds[r].append({c: nodes[c].to_numpy() for c in ("feature", "bin", "cut", "missing_left", "left", "right", "value")})
        model = HistogramBoostingModel(rounds)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def fit_boosting(
    train: DataFrame, features: str, label: str, prediction: str, probability: str | None = None, classes: int = 0, rounds: int = 200,
    leaves: int = 31, rate: float = 0.1, least_rows: int = 20, bins: int = BINS, early_stop_rows: int = 10_000, patience: int = PATIENCE, seed: int = 42,
) -> HistogramBoostingModel:
    """Labels are 0 to ``classes`` - 1, or numbers without ``classes``. Missing values (NaN) go to the side of
    each split that suits them best."""
    values = train.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    head = values.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    many, width = head.n, head.width or 0
    drawn = F.pmod(F.xxhash64("x", F.lit(seed)), F.lit(10)) == 0
    values = values.withColumn("held", drawn if many > early_stop_rows else F.lit(False))
    own = values.filter(~F.col("held"))
    if classes:
        counts = {int(r.y): r["count"] for r in own.groupBy("y").count().collect()}
        share = np.array([max(counts.get(k, 0), 1e-10) for k in range(classes)], float)
        baseline = np.log(share / share.sum())
    else:
        baseline = np.array([own.agg(F.avg("y")).first()[0] or 0.0])
    edges = quantile_edges(values, width, min(bins, BINS)) if many else [np.zeros(0)] * width
    # Compact rows, dealt out evenly once: a task's histograms should be worth their size.
    table = _binned(values, edges).repartition(max(1, -(-many // ROWS_PER_TASK)))
    parts = edges, baseline, classes, leaves, rate, least_rows
    stops, wanted = many > early_stop_rows, rounds if many else 0
    if 0 < many <= ROWS_PER_TASK and many * width <= TASK_CELLS:
        grown, told = _grow_in_a_task(table, parts, wanted, stops, patience)
    else:
        booster = _Booster(table, *parts)
        told, grown = booster.run(wanted, stops, patience), booster.rounds
    return HistogramBoostingModel(
        [[t.arrays() for t in trees] for trees in grown], featuresCol=features, predictionCol=prediction, probabilityCol=probability or "",
        classes=classes, baseline=baseline.tolist(), trainLoss=[a for a, _ in told], heldOutLoss=[b for _, b in told if b == b],
    )
