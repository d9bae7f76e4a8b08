"""Multinomial logistic regression with a ridge penalty (M4), fitted by Newton's method.

Classes that a rule parts almost without error need hundreds of first-order steps, and more of them the
more rows there are. Newton's method needs a dozen or two: a pass adds up the loss, its slope and its
curvature over all rows, a task at a time in numpy; the sums of the tasks are added up by entry, and the
driver solves for the next step. It sees (classes * features)^2 / 2 numbers a pass, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.operators.boosting import probabilities

TOLERANCE, LEAST_LOSS = 1e-7, 1e-9  # the expected gain of a last step, as a share of the loss
LEAST_FALL, SHORTEST = 1e-4, 2.0**-20  # of the loss, as a share of the gain; of a step
CACHED_ROWS = 1000  # at once in numpy


class SoftmaxModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted weights as a row-wise stage: it takes a batch or a stream, is saved and loaded."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "class", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "vector of the classes' probabilities", TypeConverters.toString)
    coefficients = Param(Params._dummy(), "coefficients", "weights of the features, class by class", TypeConverters.toListFloat)
    intercepts = Param(Params._dummy(), "intercepts", "one of each class", TypeConverters.toListFloat)
    losses = Param(Params._dummy(), "losses", "penalised mean loss before each step and after the last", TypeConverters.toListFloat)

    def __init__(self, **params) -> None:
        super().__init__()
        self._set(**params)

    @property
    def numClasses(self) -> int:
        return len(self.getOrDefault("intercepts"))

    @property
    def coefficientMatrix(self) -> DenseMatrix:
        values, classes = self.getOrDefault("coefficients"), self.numClasses
        return DenseMatrix(classes, len(values) // classes, values, isTransposed=True)

    @property
    def interceptVector(self) -> DenseVector:
        return DenseVector(self.getOrDefault("intercepts"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights, intercepts = self.coefficientMatrix.toArray(), np.array(self.getOrDefault("intercepts"))

        def chances(values: pa.Array) -> pa.Array:
            x = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, weights.shape[1])
            # Summed row by row, so that a row's answer does not depend on those it is scored with.
            raw = np.stack([(x * w).sum(1) + b for w, b in zip(weights, intercepts, strict=True)], axis=1)
            out = probabilities(raw) if len(raw) else raw
            return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))

        found = F.arrow_udf(chances, "array<double>")(vector_to_array(F.col(self.getOrDefault("featuresCol"))))
        told = dataset.withColumn("_chances", found)
        place = F.array_position("_chances", F.array_max("_chances")) - 1
        return told.withColumns({
            self.getOrDefault("probabilityCol"): array_to_vector("_chances"), self.getOrDefault("predictionCol"): place.cast("double"),
        }).drop("_chances")


def _pass(rows: DataFrame, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sums over all rows at ``weights`` (class by feature, the intercepts last): loss, slope and curvature."""
    classes, width = weights.shape
    pairs = [(k, m) for k in range(classes) for m in range(k + 1, classes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, slope, blocks = 0.0, np.zeros((classes, width)), np.zeros((len(pairs), width, width))
        for batch in batches:
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width - 1)
            labels = batch.column("y").to_numpy().astype(np.int64)
            for first in range(0, len(labels), CACHED_ROWS):
                x = values[first : first + CACHED_ROWS]
                x = np.column_stack([x, np.ones(len(x))])
                own = np.arange(len(x)), labels[first : first + CACHED_ROWS]
                raw = x @ weights.T
                raw -= raw.max(1, keepdims=True)
                loss += (np.log(np.exp(raw).sum(1)) - raw[own]).sum()
                p = probabilities(raw)
                for at, (k, m) in enumerate(pairs):
                    z = x * np.sqrt(p[:, k] * p[:, m])[:, None]
                    blocks[at] += z.T @ z
                p[own] -= 1
                slope += p.T @ x
        told = np.concatenate([[loss], slope.ravel(), blocks.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(told)), pa.int32()), pa.array(told)], ["entry", "value"])

    told = rows.mapInArrow(run, "entry int, value double").groupBy("entry").agg(F.sum("value").alias("value")).collect()
    sums = np.zeros(1 + classes * width + len(pairs) * width * width)
    for r in told:
        sums[r.entry] = r.value
    slope, blocks = sums[1 : 1 + classes * width], sums[1 + classes * width :].reshape(-1, width, width)
    curve = np.zeros((classes, width, classes, width))
    for (k, m), block in zip(pairs, blocks, strict=True):
        # Chances of a row add up to 1: p (1 - p) of a class is the sum of its products with the others.
        curve[k, :, k] += block
        curve[m, :, m] += block
        curve[k, :, m], curve[m, :, k] = -block, -block
    return sums[0], slope, curve.reshape(classes * width, classes * width)


def _newton(rows: DataFrame, many: int, start: np.ndarray, penalty: float, iterations: int) -> tuple[np.ndarray, list[float]]:
    """(weights, losses): steps are halved until the loss falls; the loss is convex, so its only minimum is found."""
    classes, width = start.shape
    ridge = np.full((classes, width), penalty)
    ridge[:, -1] = 0
    # A shift of all intercepts changes no probability: they keep their sum.
    shift = np.zeros((classes, width))
    shift[:, -1] = 1
    held = np.outer(shift.ravel(), shift.ravel()) / classes

    def at(weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, slope, curve = _pass(rows, weights)
        flat = ridge.ravel() * weights.ravel()
        return loss / many + 0.5 * flat @ weights.ravel(), slope / many + flat, curve / many + np.diag(ridge.ravel())

    weights = start
    loss, slope, curve = at(weights)
    losses = [loss]
    while len(losses) <= iterations:
        step = np.linalg.lstsq(curve + held, slope, rcond=None)[0]
        gain, length = float(slope @ step) / 2, 1.0
        if gain <= TOLERANCE * max(loss, LEAST_LOSS):
            break
        while True:
            tried = weights - length * step.reshape(classes, width)
            after = at(tried)
            if after[0] <= loss - LEAST_FALL * length * gain or length < SHORTEST:
                break
            length /= 2
        if after[0] >= loss:  # as low as these sums can tell
            break
        weights, (loss, slope, curve) = tried, after
        losses.append(loss)
    return weights, losses


def fit_softmax(
    train: DataFrame, features: str, label: str, prediction: str, probability: str, penalty: float, iterations: int = 2000,
) -> SoftmaxModel:
    """Weights that minimise the mean loss plus ``penalty`` / 2 times their squares, intercepts left out.
    Labels are 0, 1, ...; there are as many classes as the largest one tells. Features should be scaled."""
    rows = train.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # one row a class
        if not counts:
            raise ValueError("no rows to fit on")
        if any(y is None or not y >= 0 or y % 1 for y in counts):
            raise ValueError("labels have to be 0, 1, ...")
        classes, width = int(max(counts)) + 1, rows.agg(F.max(F.size("x"))).first()[0]
        start = np.zeros((classes, width + 1))
        start[:, -1] = np.log([counts.get(float(k), 0) + 1.0 for k in range(classes)])
        start[:, -1] -= start[:, -1].mean()
        weights, losses = _newton(rows, sum(counts.values()), start, penalty, iterations)
    finally:
        rows.unpersist()
    return SoftmaxModel(
        featuresCol=features, predictionCol=prediction, probabilityCol=probability,
        coefficients=weights[:, :-1].ravel().tolist(), intercepts=weights[:, -1].tolist(), losses=losses,
    )
