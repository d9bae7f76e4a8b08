"""M3-M9: candidate models, their comparison, and the full training run.

The definitions of the metrics equal the published ones; the fitted models do not have to: Spark's
split finding and bootstrap differ from those of other libraries. Boosting is in ``boosting``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.functions.frames import feature_columns
from gridpulse.operators import iforest
from gridpulse.operators.boosting import HistogramBoostingModel, fit_boosting
from gridpulse.operators.forest import fit_forest
from gridpulse.operators.metrics import classifier_scores, model_comparison, regression_metrics, select_best
from gridpulse.operators.softmax import fit_softmax
from gridpulse.operators.split import random_split, stratified_split
from gridpulse.schema import (
    ANOMALY_FEATURES,
    CLASS_NAMES,
    CONTAMINATION,
    DATASET,
    NOT_CLASSIFIER_FEATURES,
    NOT_REGRESSOR_FEATURES,
    RISK,
)
from gridpulse.session import checkpoint_root, materialize
from gridpulse.sources.writers import save_model, write_metadata

RISK_PREDICTION, RISK_PROBABILITY = "risk_prediction", "risk_probability"
TEMPERATURE_PREDICTION = "temperature_prediction"
# Histograms of the nodes that a forest splits in one job: each task that runs at the time holds as many, and
# so do the tasks that add them up. Splits of all features do not depend on it.
FOREST_MB = 256


@dataclass(frozen=True)
class Profile:
    """Model sizes. The defaults are the published ones."""

    trees: int = 200
    depth: int = 14
    rounds: int = 200
    boost_leaves: int = 31
    boost_leaf: int = 20
    bins: int = 256
    early_stop_rows: int = 10_000  # with more training rows, boosting holds out a tenth and may stop early:
    patience: int = 10  # after so many rounds in a row without a lower loss of that tenth
    iterations: int = 2000
    forest_trees: int = 150
    seed: int = 42


FULL = Profile()
SMALL = Profile(trees=10, depth=5, rounds=5, boost_leaves=8, bins=32, iterations=50, forest_trees=25)


@dataclass(frozen=True)
class Task:
    """What every candidate is given: assembled training rows and the names of the columns."""

    train: DataFrame
    rows: int
    width: int
    label: str
    features: str
    scaled: str
    prediction: str
    probability: str
    profile: Profile
    classes: tuple[int, ...] = tuple(CLASS_NAMES)

    def scaler(self) -> list:
        """M3: fitted on the training rows only."""
        return population_scaler(self.features, self.scaled, self.rows, self.width)


def population_scaler(source: str, target: str, rows: int, width: int) -> list:
    """Stages that centre vectors and divide them by the population deviation of the ``rows`` they are
    fitted on; Spark's own scaler divides by the sample's."""
    by_sample = f"{target}_by_sample"
    factor = math.sqrt(rows / (rows - 1)) if rows > 1 else 1.0
    return [
        StandardScaler(inputCol=source, outputCol=by_sample, withMean=True, withStd=True),
        ElementwiseProduct(scalingVec=Vectors.dense([factor] * width), inputCol=by_sample, outputCol=target),
    ]


Fit = Callable[[Task], Model]


def fit_logistic(task: Task) -> PipelineModel:
    """M4: multinomial, ridge penalty with C = 1."""
    scaler = Pipeline(stages=task.scaler()).fit(task.train)
    model = fit_softmax(
        scaler.transform(task.train), task.scaled, task.label, task.prediction, task.probability,
        penalty=1.0 / task.rows, iterations=task.profile.iterations,
    )
    return PipelineModel([*scaler.stages, model])


def fit_forest_classifier(task: Task) -> Model:
    """M5."""
    p = task.profile
    return fit_forest(
        task.train, task.features, task.label, task.prediction, task.probability, trees=p.trees, depth=p.depth, bins=p.bins, seed=p.seed, memory_mb=FOREST_MB,
    )


def _boosting(task: Task, classes: int, probability: str | None) -> HistogramBoostingModel:
    p = task.profile
    return fit_boosting(
        task.train, task.features, task.label, task.prediction, probability, classes, rounds=p.rounds, leaves=p.boost_leaves,
        least_rows=p.boost_leaf, bins=p.bins, early_stop_rows=p.early_stop_rows, patience=p.patience, seed=p.seed,
    )


def boosting_models(model: Model) -> list[HistogramBoostingModel]:
    """The boosting models in a fitted one, with ``rounds_used`` and their losses."""
    inner = model.stages if isinstance(model, PipelineModel) else [model]
    return [m for part in inner for m in (boosting_models(part) if isinstance(part, PipelineModel) else [part]) if isinstance(m, HistogramBoostingModel)]


def fit_boosted_classifier(task: Task) -> Model:
    """M6: one model for all classes, on the multinomial loss."""
    return _boosting(task, len(task.classes), task.probability)


def fit_ridge(task: Task, alpha: float = 1.0) -> PipelineModel:
    """M7: Spark divides the penalty by the deviation of the label and averages the loss."""
    deviation = task.train.agg(F.stddev_pop(task.label)).first()[0] or 0.0
    model = LinearRegression(
        featuresCol=task.scaled, labelCol=task.label, predictionCol=task.prediction,
        regParam=alpha * deviation / task.rows, elasticNetParam=0.0, standardization=False, solver="normal",
    )
    return Pipeline(stages=[*task.scaler(), model]).fit(task.train)


def fit_forest_regressor(task: Task) -> Model:
    """M8: every split may use every feature."""
    p = task.profile
    return RandomForestRegressor(
        featuresCol=task.features, labelCol=task.label, predictionCol=task.prediction, numTrees=p.trees,
        maxDepth=p.depth, maxBins=p.bins, featureSubsetStrategy="all", seed=p.seed, maxMemoryInMB=FOREST_MB,
    ).fit(task.train)


def fit_boosted_regressor(task: Task) -> Model:
    """M8."""
    return _boosting(task, 0, None)


CLASSIFIERS: dict[str, Fit] = {
    "LogisticRegression": fit_logistic,
    "RandomForest": fit_forest_classifier,
    "HistGradientBoosting": fit_boosted_classifier,
}
REGRESSORS: dict[str, Fit] = {
    "Ridge": fit_ridge,
    "RandomForest": fit_forest_regressor,
    "HistGradientBoosting": fit_boosted_regressor,
}


@dataclass
class Comparison:
    """Fitted candidates, one metrics row each, and the winner."""

    metrics: DataFrame
    best: str
    models: dict[str, PipelineModel]
    features: list[str]
    results: dict[str, dict[str, float]] = field(default_factory=dict)

    @property
    def model(self) -> PipelineModel:
        return self.models[self.best]


def _fit_candidates(
    train: DataFrame,
    test: DataFrame,
    features: list[str],
    label: str,
    candidates: dict[str, Fit],
    profile: Profile,
    score: Callable[[DataFrame, DataFrame | None], dict[str, float]],
    metric: str,
    prefix: str,
    prediction: str,
    probability: str,
) -> Comparison:
    spark = train.sparkSession
    checkpoint_root(spark)  # boosting cuts its own lineage where a folder is set
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    assembler = VectorAssembler(inputCols=features, outputCol=f"{prefix}_features")
    target = F.col(label).cast("double").alias("_label")
    vectors = [assembler.transform(f).select(assembler.getOutputCol(), target) for f in (train, test)]
    vectors = [v.persist(StorageLevel.MEMORY_AND_DISK) for v in vectors]
    try:
        task = Task(
            train=vectors[0], rows=vectors[0].count(), width=len(features), label="_label", features=assembler.getOutputCol(),
            scaled=f"{prefix}_scaled", prediction=prediction, probability=probability, profile=profile,
        )
        models, results = {}, {}
        for name, fit in candidates.items():
            fitted = fit(task)
            needs_train = metric == "test_f1_macro"
            results[name] = score(
                fitted.transform(vectors[1]), fitted.transform(vectors[0]) if needs_train else None
            )
            models[name] = PipelineModel([assembler, fitted])
    finally:
        for v in vectors:
            v.unpersist()
    names = list(next(iter(results.values())))
    rows = [(i, n, *[results[n][m] for m in names]) for i, n in enumerate(results)]
    schema = "position int, model string, " + ", ".join(f"{m} double" for m in names)
    table = spark.createDataFrame(rows, schema)
    best = select_best(table, metric).first().model
    rounded = {n: {m: round(v, 4) for m, v in r.items()} for n, r in results.items()}
    return Comparison(model_comparison(table, metric), best, models, features, rounded)


def compare_classifiers(
    train: DataFrame,
    test: DataFrame,
    features: list[str],
    label: str = RISK,
    profile: Profile = FULL,
    candidates: dict[str, Fit] = CLASSIFIERS,
) -> Comparison:
    """M9 for the risk level: the first candidate with the highest macro F1 on the test rows wins."""

    def score(on_test: DataFrame, on_train: DataFrame | None) -> dict[str, float]:
        held_out = classifier_scores(on_test, "_label", RISK_PREDICTION).first()
        return {
            "train_accuracy": classifier_scores(on_train, "_label", RISK_PREDICTION).first().accuracy,
            "test_accuracy": held_out.accuracy,
            "test_f1_macro": held_out.f1_macro,
        }

    return _fit_candidates(
        train, test, features, label, candidates, profile, score, "test_f1_macro", "_risk",
        RISK_PREDICTION, RISK_PROBABILITY,
    )


def compare_regressors(
    train: DataFrame,
    test: DataFrame,
    features: list[str],
    label: str = "OTI",
    profile: Profile = FULL,
    candidates: dict[str, Fit] = REGRESSORS,
) -> Comparison:
    """M9 for the oil temperature: the first candidate with the highest R2 on the test rows wins."""

    def score(on_test: DataFrame, _: DataFrame | None) -> dict[str, float]:
        row = regression_metrics(on_test, "_label", TEMPERATURE_PREDICTION).first()
        return {"test_rmse": row.rmse, "test_mae": row.mae, "test_r2": row.r2}

    return _fit_candidates(
        train, test, features, label, candidates, profile, score, "test_r2", "_temperature",
        TEMPERATURE_PREDICTION, "_unused",
    )


@dataclass
class Training:
    classifiers: Comparison
    regressors: Comparison
    detector: iforest.IsolationForestModel
    anomalies: DataFrame
    metadata: dict[str, Any]

    def save(self, path: str) -> None:
        """The winners, the anomaly model and the metadata that says what they read, in one folder;
        ``predictor.load_predictor`` takes it from there."""
        for name, model in (("classifier", self.classifiers.model), ("regressor", self.regressors.model), ("detector", self.detector)):
            save_model(model, f"{path}/{name}")
        write_metadata(self.anomalies.sparkSession, self.metadata, f"{path}/metadata")


def train_all(
    frame: DataFrame,
    profile: Profile = FULL,
    key: list[str] | None = None,
    also_exclude: tuple[str, ...] = (),
    anomaly_features: list[str] = ANOMALY_FEATURES,
) -> Training:
    """The whole training run on a feature frame with labels.

    The risk label is a rule over columns that stay among the classifier's features, as published:
    its scores say nothing about forecasting skill.
    """
    frame = materialize(frame)  # read by every split, fit and score below
    cls = feature_columns(frame, [*NOT_CLASSIFIER_FEATURES, *also_exclude])
    reg = feature_columns(frame, [*NOT_REGRESSOR_FEATURES, *also_exclude])
    classifiers = compare_classifiers(*stratified_split(frame, RISK, key=key), cls, profile=profile)
    regressors = compare_regressors(*random_split(frame, key=key), reg, profile=profile)
    detector = iforest.fit_model(frame, anomaly_features, profile.forest_trees, profile.seed, CONTAMINATION, key)
    anomalies = detector.transform(frame)
    metadata = {
        "dataset": DATASET,
        "records": frame.count(),
        "classification_target": RISK,
        "classification_features": cls,
        "best_classification_model": classifiers.best,
        "classification_results": classifiers.results,
        "regression_target": "OTI (Oil Temperature C)",
        "regression_features": reg,
        "best_regression_model": regressors.best,
        "regression_results": regressors.results,
        "anomaly_features": list(anomaly_features),
        "anomaly_contamination": CONTAMINATION,
        "classes": {str(k): v for k, v in CLASS_NAMES.items()},
    }
    return Training(classifiers, regressors, detector, anomalies, metadata)
