"""ST1-ST3: live panel, idempotent ingest and scoring on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.ml import Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from gridpulse.operators.carry import carry_stream
from gridpulse.operators.scoring import score_batch, score_detail
from gridpulse.schema import DEVICE, KEY, READING_TIME
from gridpulse.sources.writers import ImportTally, append_idempotent

REFRESH = "10 seconds"


def latest_stream(
    stream: DataFrame, by: list[str], time_column: str = KEY, tiebreak: list[str] | None = None
) -> DataFrame:
    """Newest reading per device over all that has arrived; a late one never replaces a newer one.

    The state is one row per device. Map tasks reduce their readings first, so a device with most of
    the traffic sends one row per task.
    """
    order = F.struct(time_column, *(tiebreak or []))
    rest = [c for c in stream.columns if c not in by]
    timed = stream.filter(F.col(time_column).isNotNull())
    newest = timed.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_reading"))
    return newest.select(*by, "_reading.*")


def monitor_stream(
    stream: DataFrame,
    classifier: Transformer,
    regressor: Transformer,
    by: list[str],
    keep: list[str] | None = None,
    time_column: str = KEY,
    tiebreak: list[str] | None = None,
    refresh: str | None = REFRESH,
    **options,
) -> DataStreamWriter:
    """ST1: the scored newest reading of every device that reported, once per refresh. Start it with
    the sink of choice; ``refresh=None`` works off what is there and stops."""
    newest = latest_stream(stream, by, time_column, tiebreak)
    kept = list(dict.fromkeys([*by, time_column, *(keep or [])]))
    scored = score_detail(newest, classifier, regressor, keep=kept, **options)
    writer = scored.writeStream.outputMode("update")
    return writer.trigger(processingTime=refresh) if refresh else writer.trigger(availableNow=True)


def ingest_stream(
    stream: DataFrame,
    path: str,
    keys: tuple[str, ...] = (DEVICE, READING_TIME),
    order: tuple[str, ...] = (),
    time_column: str = READING_TIME,
    watermark: str | None = None,
    on_tally: Callable[[int, ImportTally], None] | None = None,
) -> DataStreamWriter:
    """ST2: every micro-batch goes through the idempotent append, so a replayed batch adds nothing.

    With a ``watermark``, repeats within it are dropped before they reach the table; readings that
    arrive later than it are then dropped too, so leave it out where late readings must be kept.
    """
    if watermark:
        stream = stream.withWatermark(time_column, watermark).dropDuplicatesWithinWatermark(list(keys))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist(StorageLevel.MEMORY_AND_DISK)  # read twice
        try:
            tally = append_idempotent(batch, path, keys, order, time_column)
        finally:
            batch.unpersist()
        if on_tally:
            on_tally(batch_id, tally)

    return stream.writeStream.foreachBatch(write)


def score_stream(
    stream: DataFrame, classifier: Transformer, regressor: Transformer, by: list[str] | None = None, tiebreak: list[str] | None = None, **options
) -> DataFrame:
    """ST3: every arriving reading, scored. Choose a null policy: ``zero``, ``error``, or ``fill``, which takes
    the last known values of the device (``by``) from the stream's state (see ``carry_stream``)."""
    if options.setdefault("nulls", "error") not in ("zero", "error", "fill"):
        raise ValueError("a stream needs the null policy 'zero', 'error' or 'fill'")
    if options["nulls"] == "fill":
        stream = carry_stream(stream, list(by or [DEVICE]), options.get("key", KEY), tiebreak)
        options["nulls"] = "zero"
    return score_batch(stream, classifier, regressor, **options)
