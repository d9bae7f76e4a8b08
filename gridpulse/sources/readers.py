"""Feeds, uploaded batches, the readings table and JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.functions.frames import clean_numbers
from gridpulse.schema import FEED_FILES, KEY, NULL_MARKERS, reading_schema


def parse_event_time(df: DataFrame, column: str = KEY, on_error: str = "raise") -> DataFrame:
    """The column as TIMESTAMP. Text that is no time fails the job, or becomes null with
    ``on_error="null"``."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return df
    c = F.col(column)
    if isinstance(kind, T.StringType):
        text = F.when(~F.trim(c).isin(NULL_MARKERS), c)
        parsed = F.try_to_timestamp(text) if on_error == "null" else F.to_timestamp(text)
    else:
        parsed = c.cast("timestamp")
    return df.withColumn(column, parsed)


def _number(name: str) -> Column:
    text = F.trim(F.col(name))
    return F.when(~text.isin(NULL_MARKERS), text.cast("double")).alias(name)


def read_feed(
    spark: SparkSession,
    path: str | list[str],
    key: str = KEY,
    text_columns: tuple[str, ...] = (),
    on_error: str = "raise",
) -> DataFrame:
    """One CSV or parquet feed. CSV columns are found by header name, never by position; every
    column but the key and ``text_columns`` is a number. A missing path fails before any job runs."""
    paths = [path] if isinstance(path, str) else path
    if all(p.rstrip("/").endswith(".parquet") for p in paths):
        return clean_numbers(parse_event_time(spark.read.parquet(*paths), key, on_error))
    # The header of every file is checked against the first one.
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(paths)
    as_is = {key, *text_columns}
    typed = raw.select(*[F.col(c) if c in as_is else _number(c) for c in raw.columns])
    return parse_event_time(typed, key, on_error) if key in raw.columns else typed


def read_feeds(spark: SparkSession, folder: str, files: dict[str, str] = FEED_FILES) -> dict[str, DataFrame]:
    """S1 for all feeds of one folder."""
    return {name: read_feed(spark, f"{folder.rstrip('/')}/{file}") for name, file in files.items()}


def read_batch_csv(spark: SparkSession, path: str, key: str = KEY) -> DataFrame:
    """An uploaded batch; the time key is optional."""
    return read_feed(spark, path, key)


def read_readings(
    spark: SparkSession,
    path: str | None = None,
    table: str | None = None,
    jdbc: dict[str, str] | None = None,
) -> DataFrame:
    """S3: the readings table from parquet, the catalog, or JDBC. Pass ``partitionColumn``,
    ``lowerBound``, ``upperBound`` and ``numPartitions`` among the JDBC options to read in parallel;
    credentials come from those options only."""
    if path:
        return clean_numbers(spark.read.parquet(path))
    if table:
        return clean_numbers(spark.read.table(table))
    if jdbc:
        return clean_numbers(spark.read.format("jdbc").options(**jdbc).load())
    raise ValueError("give path, table or jdbc options")


def read_json_readings(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One JSON object per line; keys outside the schema are ignored. Keys that no payload has
    are best left out of ``schema``, so that the scoring defaults apply to them."""
    return clean_numbers(spark.read.schema(schema or reading_schema()).json(path))


def parse_json_readings(df: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """S4 for payloads that arrive as text in a column (a message queue, say)."""
    kept = [c for c in df.columns if c != column]
    parsed = df.select(*kept, F.from_json(column, schema).alias("_reading")).select(*kept, "_reading.*")
    return clean_numbers(parsed, skip=kept)
