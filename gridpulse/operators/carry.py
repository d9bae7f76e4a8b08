"""M13, ST3 with the null policy ``fill``: gaps of a reading take the device's last known values before it.

The result equals a forward fill (W1) over all that is stored and the readings to be scored, together.
Filled values go to columns of their own (``FILLED`` before the name), so the readings stay as they came.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridpulse.operators.fill import fill_gaps
from gridpulse.schema import KEY, SENSORS

FILLED = "_filled_"


def sensors_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c in SENSORS]


def carry_forward(
    batch: DataFrame, history: DataFrame, by: list[str], time_column: str = KEY, tiebreak: list[str] | None = None, columns: list[str] | None = None
) -> DataFrame:
    """``batch`` with the filled values of ``columns`` (all sensors that both frames have).

    Of the history, only devices of the batch count. What precedes a device's first reading in the batch is
    reduced to one row by the map tasks, however long it is; only later rows meet the batch in time order.
    Of rows with equal time and tiebreak, stored ones come first; stored rows without a time do not count.
    """
    tiebreak = list(tiebreak or [])
    columns = columns or [c for c in sensors_of(batch) if c in history.columns]
    owner = F.struct(*by)  # structs of nulls are equal: a missing device is one device
    first = batch.groupBy(owner.alias("_owner")).agg(F.min(time_column).alias("_first"))
    stored = history.select(*by, time_column, *tiebreak, *columns).filter(F.col(time_column).isNotNull())
    stored = stored.withColumn("_owner", owner).join(first, "_owner")
    # Readings without a time are the last of their device.
    early = F.coalesce(F.col(time_column) < F.col("_first"), F.lit(True))
    order = F.struct(time_column, *tiebreak)
    before = stored.filter(early).groupBy("_owner").agg(
        F.max(time_column).alias(time_column), *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns]
    )
    before = before.select("_owner.*", time_column, *[F.lit(None).cast(history.schema[c].dataType).alias(c) for c in tiebreak], *columns)
    late = stored.filter(~early).select(*by, time_column, *tiebreak, *columns)
    own = batch.select("*", *[F.col(c).alias(f"{FILLED}{c}") for c in columns], F.lit(1).alias("_is_batch"))
    others = [
        df.select(*by, time_column, *tiebreak, *[F.col(c).alias(f"{FILLED}{c}") for c in columns], F.lit(0).alias("_is_batch")) for df in (before, late)
    ]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [own, *others])
    filled = fill_gaps(
        together, [f"{FILLED}{c}" for c in columns], time_column, by, [*tiebreak, "_is_batch"], backward=False, constant=None
    )
    return filled.filter("_is_batch = 1").drop("_is_batch")


def carry_stream(
    stream: DataFrame, by: list[str], time_column: str = KEY, tiebreak: list[str] | None = None, columns: list[str] | None = None, timeout_ms: int | None = None
) -> DataFrame:
    """The same on a stream: the last known values of each device are kept as its state; with ``timeout_ms``, for
    as long as it reports at least once in that time. (A stream with such a timeout always looks for another
    batch, so one that is to stop by itself should not have it.) A late reading, older than the newest that was seen before its
    micro-batch, is filled from older readings of its own micro-batch only and changes no state."""
    columns, tiebreak = columns or sensors_of(stream), list(tiebreak or [])
    names = stream.columns
    out = T.StructType([*[T.StructField(f.name, f.dataType) for f in stream.schema], *[T.StructField(f"{FILLED}{c}", T.DoubleType()) for c in columns]])
    state_schema = T.StructType([T.StructField("at", T.TimestampType()), *[T.StructField(c, T.DoubleType()) for c in columns]])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames), ignore_index=True).sort_values([time_column, *tiebreak], na_position="last", kind="stable")
        at, *known = state.get if state.exists else (None, *[None] * len(columns))
        at = pd.Timestamp(at) if at is not None else None
        values = rows[columns].astype(float)
        late = rows[time_column].notna() & (rows[time_column] < at) if at is not None else pd.Series(False, index=rows.index)
        timely = values[~late].ffill()
        if at is not None:
            timely = timely.fillna({c: v for c, v in zip(columns, known, strict=True) if v is not None})
        filled = pd.concat([values[late].ffill(), timely]).loc[rows.index]
        if len(timely):
            newest = rows.loc[~late, time_column].max()
            newest = at if pd.isna(newest) else newest
            last = [None if pd.isna(v) else float(v) for v in timely.iloc[-1]]
            state.update((None if newest is None else newest.to_pydatetime(), *last))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.concat([rows[names], filled.add_prefix(FILLED)], axis=1)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy(*by).applyInPandasWithState(run, out, state_schema, "append", timeout)
