"""From feeds to the labelled feature frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from gridpulse.functions.frames import clean_numbers, with_derived, with_labels, with_time_parts
from gridpulse.operators.align import align_feeds, keys_are_unique
from gridpulse.operators.fill import fill_gaps
from gridpulse.schema import KEY, RiskRules
from gridpulse.sources.readers import read_feeds


def telemetry_frame(
    feeds: dict[str, DataFrame],
    by: list[str] | None = None,
    rules: RiskRules = RiskRules(),
    how: str = "outer",
    align: str = "auto",
    fill: str = "auto",
    tiebreak: list[str] | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """Align, fill, derive and label. With ``by``, every device is a series of its own; without, all
    rows are one series."""
    by = list(by or [])
    keys = [*by, KEY]
    clean = [clean_numbers(f) for f in feeds.values()]
    if align == "auto" and keys_are_unique(clean, keys):
        align = "union"
    timed = with_time_parts(align_feeds(clean, keys, how, align))
    # With unique keys, a series has no more rows than the feeds have together.
    outline = reduce(DataFrame.unionAll, [f.select(*keys) for f in clean]) if align == "union" else None
    filled = fill_gaps(
        timed, time_column=KEY, by=by, tiebreak=tiebreak, strategy=fill, chunks=chunks, outline=outline
    )
    return with_labels(with_derived(filled, rules), rules)


def load_telemetry(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The frame from a folder with the five CSV files."""
    return telemetry_frame(read_feeds(spark, folder), **options)
