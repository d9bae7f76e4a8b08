"""Isolation forest (Liu, Ting and Zhou, ICDM 2008).

Every tree sees at most 256 rows, so growing the forest is a fixed amount of work once the rows are
drawn. Drawing is one pass without a shuffle of the data; scoring is a row-wise pandas UDF over the
broadcast forest, whose size depends on the number of trees only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.schema import ANOMALY_FEATURES, CONTAMINATION
from gridpulse.session import materialize

SAMPLE = 256
SPARE = 1.6  # drawn per tree in terms of the sample, then cut to size
CUT_ACCURACY = 100_000
FOREST_SCHEMA = "tree int, sample int, feature array<int>, threshold array<double>, depth array<double>"


def average_depth(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` points."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow(points: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree as a full binary layout: children of node i are 2i+1 and 2i+2.

    A node that splits no further sends everything left, so its depth sits at the leftmost leaf below.
    """
    limit = max(1, math.ceil(math.log2(max(len(points), 2))))
    feature = np.zeros(2**limit - 1, dtype=np.int32)
    threshold = np.full(2**limit - 1, np.inf)
    depth = np.zeros(2**limit)
    pending = [(0, 0, points)]
    while pending:
        node, level, rows = pending.pop()
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        usable = np.flatnonzero(high > low)
        if level == limit or len(rows) <= 1 or len(usable) == 0:
            leftmost = (node + 1) * 2 ** (limit - level) - 2**limit
            depth[leftmost] = level + average_depth(len(rows))
            continue
        f = rng.choice(usable)
        # The upper end is excluded from the draw's left side: both children get a row.
        t = rng.uniform(np.nextafter(low[f], high[f]), high[f])
        right = rows[:, f] >= t
        feature[node], threshold[node] = f, t
        pending += [(2 * node + 1, level + 1, rows[~right]), (2 * node + 2, level + 1, rows[right])]
    return feature, threshold, depth


def _mixed(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes, well mixed."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54


def draws(h: np.ndarray, n_trees: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, tree, order) of the trees that rows with these hashes are drawn for, each with the chance
    ``share``. One number a row tells how many trees go by before its first; only rows that have one go on."""
    step = np.uint64(0x9E3779B97F4A7C15)
    first = np.zeros(len(h)) if share >= 1 else np.floor(np.log(_mixed(h)) / np.log1p(-share))
    row = np.flatnonzero(first < n_trees)
    first = first[row].astype(np.int64)
    tree = np.arange(n_trees)
    order = _mixed(h[row][:, None] + step * (tree.astype(np.uint64) + np.uint64(1)))
    # The order among those drawn is uniform below the share, for the first tree as for the others.
    own = tree[None] == first[:, None]
    order = np.where(own, order * share, order)
    at, drawn = np.nonzero(own | ((tree[None] > first[:, None]) & (order < share)))
    return row[at], drawn, order[at, drawn]


def draw_samples(df: DataFrame, features: list[str], n_trees: int, seed: int, key: list[str] | None = None) -> DataFrame:
    """(tree, order, values): at least ``SAMPLE`` random rows per tree where the frame has as many.

    A row's draws come from one hash of its ``key``, which should tell rows apart: the same rows then give
    the same samples however they are partitioned. Without a key it draws from a random number per row, so
    that copies of one row are drawn like any others. Only rows that are drawn leave the task.
    """
    share = min(1.0, SPARE * SAMPLE / max(df.count(), 1))
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("values")
    rows = df.select(values, (F.xxhash64(*key, F.lit(seed)) if key else F.xxhash64(F.rand(seed))).alias("draw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, tree, order = draws(batch.column("draw").to_numpy().view(np.uint64), n_trees, share)
            columns = [pa.array(tree.astype(np.int32)), pa.array(order), batch.column("values").take(pa.array(row))]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "order", "values"])

    return rows.mapInArrow(run, "tree int, order double, values array<double>")


def fit(
    df: DataFrame, features: list[str] = ANOMALY_FEATURES, n_trees: int = 150, seed: int = 42, key: list[str] | None = None
) -> DataFrame:
    """The forest, one row per tree. It is written once, so every use sees the same trees; with a
    ``key`` (see ``draw_samples``) every fit on the same rows gives them."""

    def grow_tree(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        # Rows arrive in any order: equal tickets are told apart by their values.
        group["values"] = group["values"].map(tuple)
        chosen = group.sort_values(["order", "values"]).head(SAMPLE)
        points = np.nan_to_num(np.array(chosen["values"].tolist(), dtype=float))
        feature, threshold, depth = grow(points, np.random.default_rng([seed, int(key[0])]))
        return pd.DataFrame({
            "tree": [key[0]], "sample": [len(points)], "feature": [feature], "threshold": [threshold], "depth": [depth],
        })

    samples = draw_samples(df, features, n_trees, seed, key)
    return materialize(samples.groupBy("tree").applyInPandas(grow_tree, FOREST_SCHEMA))


def anomaly_score(forest: DataFrame, features: list[str] = ANOMALY_FEATURES) -> Column:
    """Score in (0, 1], near 1 for rows that few cuts isolate. Missing values count as 0."""
    trees = forest.orderBy("tree").collect()  # one row of fixed size per tree
    if not trees:
        return F.lit(None).cast("double")
    packed = [(np.array(t.feature), np.array(t.threshold), np.array(t.depth)) for t in trees]
    scale = average_depth(float(np.mean([t.sample for t in trees]))) or 1.0
    shared = forest.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        rows = np.column_stack([c.to_numpy(dtype=float, na_value=0.0) for c in columns])
        flat, width = np.nan_to_num(rows).ravel(), rows.shape[1]
        start = np.arange(len(rows)) * width
        total = np.zeros(len(rows))
        for feature, threshold, depth in shared.value:
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(int(math.log2(len(depth)))):
                node = 2 * node + 1 + (flat[start + feature[node]] >= threshold[node])
            total += depth[node - len(feature)]
        return pd.Series(2.0 ** (-total / len(shared.value) / scale))

    return score(*[F.col(c).cast("double") for c in features])


def score(df: DataFrame, forest: DataFrame, features: list[str] = ANOMALY_FEATURES, name: str = "anomaly_score") -> DataFrame:
    """Adds the score; works on a batch or a stream."""
    return df.withColumn(name, anomaly_score(forest, features))


def score_cut(scored: DataFrame, contamination: float = CONTAMINATION, name: str = "anomaly_score") -> float | None:
    """The score that the share ``contamination`` of all rows exceeds."""
    return scored.agg(F.percentile_approx(name, 1.0 - contamination, CUT_ACCURACY)).first()[0]


def flag(
    df: DataFrame,
    forest: DataFrame,
    features: list[str] = ANOMALY_FEATURES,
    contamination: float = CONTAMINATION,
    cut: float | None = None,
) -> DataFrame:
    """Adds the score and ``anomaly_flag``, -1 for an anomaly and 1 otherwise.

    Without a ``cut`` the scores of all rows decide it. That pass reads the features only, so scoring
    twice is cheaper than keeping whole rows; write ``df`` first where computing it is dear.
    """
    scored = score(df, forest, features)
    if cut is None:
        cut = score_cut(scored, contamination)
    return mark(scored, cut)


def mark(scored: DataFrame, cut: float | None) -> DataFrame:
    """Adds ``anomaly_flag`` by a fixed cut; without one (a forest of no rows) nothing is an anomaly."""
    return scored.withColumn("anomaly_flag", F.when(F.col("anomaly_score") > F.lit(cut).cast("double"), -1).otherwise(1))


class IsolationForestModel(Transformer, MLReadable, MLWritable):
    """M10, M11 as one model: the forest, its features in order, and the cut that the training rows gave.
    Being row-wise it takes a batch or a stream, and is saved and loaded like any other model."""

    features = Param(Params._dummy(), "features", "columns in the order that the trees know", TypeConverters.toListString)
    cut = Param(Params._dummy(), "cut", "rows with a score above it are anomalies", TypeConverters.toFloat)

    def __init__(self, forest: DataFrame | None = None, features: list[str] | None = None, cut: float | None = None) -> None:
        super().__init__()
        self.forest = forest
        if features is not None:
            self._set(features=list(features))
        if cut is not None:
            self._set(cut=cut)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = score(dataset, self.forest, self.getOrDefault("features"))
        return mark(scored, self.getOrDefault("cut") if self.isSet("cut") else None)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, model: IsolationForestModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.forest.coalesce(1).write.parquet(f"{path}/forest")  # one row of fixed size per tree


class _ModelReader(MLReader):
    def load(self, path: str) -> IsolationForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = IsolationForestModel(self.sparkSession.read.schema(FOREST_SCHEMA).parquet(f"{path}/forest"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def fit_model(
    df: DataFrame, features: list[str] = ANOMALY_FEATURES, n_trees: int = 150, seed: int = 42,
    contamination: float = CONTAMINATION, key: list[str] | None = None,
) -> IsolationForestModel:
    """The forest with the cut that ``contamination`` of these rows exceed."""
    forest = fit(df, features, n_trees, seed, key)
    return IsolationForestModel(forest, features, score_cut(score(df, forest, features), contamination))
