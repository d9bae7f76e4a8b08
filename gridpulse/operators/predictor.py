"""A saved training run in use: models, feature lists and class names together, and the bulk scoring flow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, SparkSession

from gridpulse.functions.frames import preview_columns
from gridpulse.operators.iforest import IsolationForestModel
from gridpulse.operators.metrics import batch_summary
from gridpulse.operators.readings import preview
from gridpulse.operators.scoring import score_batch, score_detail
from gridpulse.sources.readers import read_batch_csv
from gridpulse.sources.writers import load_model, read_metadata

@dataclass(frozen=True)
class Predictor:
    classifier: Transformer
    regressor: Transformer
    detector: IsolationForestModel
    needed: list[str]  # the features of both models; those that the input lacks get defaults
    names: dict[int, str]

    def score(self, df: DataFrame, **options) -> DataFrame:
        """M13."""
        return score_batch(df, self.classifier, self.regressor, self.names, needed=self.needed, **options)

    def detail(self, df: DataFrame, **options) -> DataFrame:
        """M14."""
        return score_detail(df, self.classifier, self.regressor, names=self.names, needed=self.needed, **options)

    def anomalies(self, df: DataFrame) -> DataFrame:
        """M11, with the cut of the training rows."""
        return self.detector.transform(df)


def load_predictor(spark: SparkSession, path: str) -> Predictor:
    """What ``Training.save`` wrote. The metadata names the features and classes; it is one record."""
    told = read_metadata(spark, f"{path}/metadata").first()
    given = dict.fromkeys([*told.classification_features, *told.regression_features])
    return Predictor(
        load_model(f"{path}/classifier"), load_model(f"{path}/regressor"), IsolationForestModel.load(f"{path}/detector"),
        list(given), {int(k): v for k, v in told.classes.items()},
    )


@dataclass(frozen=True)
class BulkScores:
    scored: DataFrame
    summary: DataFrame
    preview: DataFrame


def score_upload(
    spark: SparkSession, source: str, target: str, classifier: Transformer, regressor: Transformer,
    shown: list[str], order: list[str], n: int = 20, **options,
) -> BulkScores:
    """S5, M13, A12, P7 and T5 in a row: the CSV at ``source`` is scored in one narrow pass and written to
    ``target``; from there come the rows per class, classes without rows included, and the first ``n`` rows
    in ``order`` with those of the columns ``shown`` that exist."""
    scored = score_batch(read_batch_csv(spark, source), classifier, regressor, **options)
    scored.write.mode("overwrite").parquet(target)
    stored = spark.read.schema(scored.schema).parquet(target)
    return BulkScores(stored, batch_summary(stored), preview_columns(preview(stored, n, order), shown))
