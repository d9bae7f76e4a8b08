"""Readings table, models, metadata and reports."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.operators.readings import dedupe_keep_first, new_keys_only
from gridpulse.schema import DEVICE, READING_TIME, metadata_schema
from gridpulse.session import staged

DATE_PARTITION = "reading_date"


@dataclass(frozen=True)
class ImportTally:
    """A3: outcome of one import."""

    total: int
    inserted: int

    @property
    def skipped(self) -> int:
        return self.total - self.inserted


def readings_of_days(spark: SparkSession, path: str, days: list[date]) -> DataFrame | None:
    """The table's rows of these days, or None if it has none of them. Only their folders are looked at,
    however many days the table has."""
    folders = [f"{path.rstrip('/')}/{DATE_PARTITION}={day.isoformat()}" for day in days]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    targets = [jvm.org.apache.hadoop.fs.Path(f) for f in folders]
    there = [f for f, t in zip(folders, targets, strict=True) if t.getFileSystem(conf).exists(t)]
    return spark.read.option("basePath", path).parquet(*there) if there else None


def append_idempotent(
    batch: DataFrame,
    path: str,
    keys: tuple[str, ...] = (DEVICE, READING_TIME),
    order: tuple[str, ...] = (),
    time_column: str = READING_TIME,
) -> ImportTally:
    """Append the rows whose key is neither in the table nor earlier in the batch.

    One set-based job replaces a transaction per row. The table is partitioned by day, and only the
    days that occur in the batch are listed and read to look for known keys; the driver gets those days,
    one row each. Accepted rows go to a staging table first, so that the tally counts what was written
    and lost executors cannot change the outcome; it is removed after the append. A plain table enforces
    no key: one writer at a time.
    """
    batch = batch.withColumn(DATE_PARTITION, F.to_date(time_column))
    days = batch.groupBy(DATE_PARTITION).count().collect()
    accepted = dedupe_keep_first(batch, list(keys), list(order))
    known = readings_of_days(batch.sparkSession, path, [r[DATE_PARTITION] for r in days if r[DATE_PARTITION]])
    if known is not None:
        accepted = new_keys_only(accepted, known, list(keys), unique=True)
    with staged(accepted) as rows:
        tally = ImportTally(total=sum(r["count"] for r in days), inserted=rows.count())
        if tally.inserted:
            # Rebalancing splits a day that holds most of the rows and merges small ones.
            rows.hint("rebalance", DATE_PARTITION).write.mode("append").partitionBy(DATE_PARTITION).parquet(path)
    return tally


def save_model(model: MLWritable, path: str) -> None:
    """S7."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """S7."""
    return PipelineModel.load(path)


def write_metadata(spark: SparkSession, metadata: dict[str, Any], path: str) -> None:
    """One nested JSON record. Its size depends on the number of models, not on the data."""
    spark.createDataFrame([metadata], metadata_schema()).coalesce(1).write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """S8."""
    return spark.read.schema(metadata_schema()).json(path)


def write_report(report: DataFrame, path: str, fmt: str = "csv") -> None:
    """A report table (A7) of a few rows."""
    writer = report.coalesce(1).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown report format: {fmt}")
