"""Fill gaps in time order, per device or over one single series.

A window over a whole series puts that series into one task, which suits any number of short ones. The
scan takes series of any length: rows are dealt once by ranges of (device, time, tiebreak), so a long series
lies in several ranges, and each task fills the rows of its range in order. A series that may go on
before or after the rows a task holds is a *segment*: the first and the last of a range, and each piece of
a series that is longer than ``FLUSH_ROWS``. Gaps at its start stay open; the task adds the first and the
last value of each column of the segment. From those few rows (two segments a range, and one for each
``FLUSH_ROWS`` rows, at most) follows what each segment inherits, and a last pass without an exchange fills
the open gaps. How rows are dealt never changes the result, only the balance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.schema import KEY
from gridpulse.session import materialize

_SEGMENT, _MARK = "_segment", "_mark"
FLUSH_ROWS = 100_000
CHUNK_ROWS = 1_000_000
LONG_SERIES = 1_000_000
MAX_LISTED_SERIES = 10_000


def default_chunks(df: DataFrame, outline: DataFrame | None = None) -> int:
    """Ranges of about ``CHUNK_ROWS`` rows, as many as the rows ask for, and at least one per shuffle
    partition. Counts ``outline``, where there is a cheaper frame with as many rows."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, partitions, -(-(df if outline is None else outline).count() // CHUNK_ROWS))


def _row_order(time_column: str, tiebreak: list[str], reverse: bool = False) -> list[Column]:
    t, rest = F.col(time_column), [F.col(c) for c in tiebreak]
    if reverse:
        return [t.desc_nulls_first(), *[c.desc_nulls_last() for c in rest]]
    return [t.asc_nulls_last(), *[c.asc_nulls_first() for c in rest]]


def _so_far(column: str, partition: list[str], order: list[Column]) -> Column:
    """Last value seen up to the row. (The mirrored frame, from the row to the end, would restart for
    every row; a backward fill runs in the opposite order instead.)"""
    running = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(column, ignorenulls=True).over(running)


def _fill_by_window(df, columns, time_column, by, tiebreak, forward, backward, constant):
    order = _row_order(time_column, tiebreak, reverse=not forward)
    whole = Window.partitionBy(*by).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )

    def value(c: str) -> Column:
        steps = [F.col(c), _so_far(c, by, order)]
        # After a forward fill only the leading gap is left: it takes the first value of the series.
        steps += [F.first(c, ignorenulls=True).over(whole)] if forward and backward else []
        # The constant takes the column's type, not the other way round.
        steps += [F.lit(constant).cast(df.schema[c].dataType)] if constant is not None else []
        return F.coalesce(*steps)

    return df.withColumns({c: value(c) for c in columns})


def _owner_starts(table: pa.Table, by: list[str]) -> np.ndarray:
    """Where the rows of each device start."""
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for c in by:
        codes = table[c].combine_chunks()
        codes = pc.dictionary_encode(codes, null_encoding="encode")
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        change[1:] |= np.diff(codes.indices.to_numpy()) != 0
    return np.flatnonzero(change)


def _filled(table: pa.Table, columns: list[str], by: list[str], starts: np.ndarray, open_: np.ndarray, both: bool, segments: np.ndarray) -> pa.Table:
    """The rows with the gaps filled that they decide themselves, and two rows for each open segment with
    the first and the last value of each column."""
    n = table.num_rows
    sizes = np.diff(np.append(starts, n))
    start, end = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
    whole = ~np.repeat(open_, sizes)
    place = np.arange(n)
    some = np.flatnonzero(open_)
    first_row, last_row = starts[some], starts[some] + sizes[some] - 1
    body, marks = {}, {}
    for c in table.column_names:
        column = table[c].combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        if c not in columns:
            body[c] = column
            inner = column.take(pa.array(first_row)) if c in by else pa.nulls(len(some), column.type)
            marks[c] = pa.concat_arrays([inner, inner])
            continue
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        before = np.maximum.accumulate(np.where(valid, place, -1))
        after = np.minimum.accumulate(np.where(valid, place, n)[::-1])[::-1]
        known = before >= start
        at = np.where(known, before, after if both else n)
        known |= both & whole & (after < end)
        body[c] = column.take(pa.array(np.where(known, at, 0), mask=~known))
        first, last = after[first_row], before[last_row]
        index = np.concatenate([first, last])
        inside = np.concatenate([first <= last_row, last >= first_row])
        marks[c] = column.take(pa.array(np.where(inside, index, 0), mask=~inside))
    body[_SEGMENT] = pa.array(np.repeat(segments, sizes), mask=whole)
    body[_MARK] = pa.array(np.zeros(n, np.int32))
    marks[_SEGMENT] = pa.array(np.tile(segments[some], 2), pa.int64())
    marks[_MARK] = pa.array(np.repeat([1, 2], len(some)), pa.int32())
    return pa.concat_tables([pa.table(body), pa.table(marks)])


def _scan_range(columns: list[str], by: list[str], both: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, continues = TaskContext.get().partitionId(), 0, True
        held: list[pa.RecordBatch] = []

        def fill(table: pa.Table, starts: np.ndarray, goes_on: bool) -> pa.Table:
            nonlocal number, continues
            open_ = np.zeros(len(starts), bool)
            open_[0], open_[-1] = continues, open_[-1] or goes_on or (continues and len(starts) == 1)
            segments = (part << 32) + number + np.arange(len(starts))
            number += len(starts)
            continues = goes_on
            return _filled(table, columns, by, starts, open_, both, segments)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= FLUSH_ROWS:
                table = pa.Table.from_batches(held)
                starts = _owner_starts(table, by)
                cut = int(starts[-1])
                if cut:  # the last series may go on, so it waits
                    yield from fill(table.slice(0, cut), starts[:-1], False).to_batches()
                    held = table.slice(cut).to_batches()
                else:
                    yield from fill(table, starts, True).to_batches()
                    held = []
        if held:
            table = pa.Table.from_batches(held)
            yield from fill(table, _owner_starts(table, by), True).to_batches()

    return run


def _fill_by_scan(df, columns, time_column, by, tiebreak, forward, backward, constant, ranges):
    order = [*[F.col(c).asc() for c in by], *_row_order(time_column, tiebreak, reverse=not forward)]
    sorted_rows = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    both = forward and backward
    fields = [T.StructField(f.name, f.dataType) for f in df.schema]
    schema = T.StructType([*fields, T.StructField(_SEGMENT, T.LongType()), T.StructField(_MARK, T.IntegerType())])
    written = materialize(sorted_rows.mapInArrow(_scan_range(columns, by, both), schema))
    marks = written.filter(F.col(_MARK) > 0)
    edges = marks.groupBy(*by, _SEGMENT).agg(*[
        F.first(F.when(F.col(_MARK) == k, F.col(c)), ignorenulls=True).alias(f"{side}_{c}") for c in columns for k, side in ((1, "_first"), (2, "_last"))
    ])
    series = Window.partitionBy(*by).orderBy(_SEGMENT)
    earlier = series.rowsBetween(Window.unboundedPreceding, -1)
    whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def seed(c: str) -> Column:
        steps = [F.last(f"_last_{c}", ignorenulls=True).over(earlier)]
        # After a forward fill, only the series' own leading gap is left: it takes the first value of all.
        steps += [F.first(f"_first_{c}", ignorenulls=True).over(whole)] if both else []
        return F.coalesce(*steps).alias(f"_seed_{c}")

    seeds = edges.select(_SEGMENT, *[seed(c) for c in columns])
    # Two rows a range and one for FLUSH_ROWS rows, at most: small however long the series are.
    rows = written.filter(F.col(_MARK) == 0).join(F.broadcast(seeds), _SEGMENT, "left")

    def value(c: str) -> Column:
        steps = [F.col(c), F.col(f"_seed_{c}")]
        return F.coalesce(*steps, *([F.lit(constant).cast(df.schema[c].dataType)] if constant is not None else [])).alias(c)

    return rows.select(*[value(c) if c in columns else F.col(c) for c in df.columns])


def _by_length(df: DataFrame, outline: DataFrame, by: list[str], limit: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(short series, long series); None for a side without any."""
    if not by:
        return (df, None) if outline.count() <= limit else (None, df)
    sizes = outline.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).select(*by)
    long = sizes.limit(MAX_LISTED_SERIES + 1).collect()
    if not long:
        return df, None
    if len(long) > MAX_LISTED_SERIES:
        return None, df
    # Few and small, so they are broadcast; on the grouping columns alone, so the test moves towards the scan.
    sides = df.sparkSession.createDataFrame(long, sizes.schema).toDF(*[f"_long_{c}" for c in by])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_long_{c}")) for c in by])
    return df.join(sides, same, "left_anti"), df.join(sides, same, "left_semi")


def fill_gaps(
    df: DataFrame,
    columns: list[str] | None = None,
    time_column: str = KEY,
    by: list[str] | None = None,
    tiebreak: list[str] | None = None,
    forward: bool = True,
    backward: bool = True,
    constant: float | None = 0.0,
    strategy: str = "auto",
    chunks: int | None = None,
    long_series: int = LONG_SERIES,
    outline: DataFrame | None = None,
) -> DataFrame:
    """W1 (forward), then W2 (backward), then W3 (constant); each step may be switched off.

    ``columns`` defaults to all but the time, device and tiebreak columns. Give a ``tiebreak`` where
    times repeat: their order is undefined otherwise. ``strategy="window"`` uses one window per
    series, ``"scan"`` (or ``"two_pass"``) ranges of rows whatever the series; ``"auto"`` counts the rows per
    series first (one job over the ``by`` columns) and scans those with more than ``long_series`` rows. ``outline`` may give a
    cheaper frame to count by, with at least as many rows per series.
    """
    by, tiebreak = list(by or []), list(tiebreak or [])
    columns = columns or [c for c in df.columns if c not in {time_column, *by, *tiebreak}]
    if not (forward or backward):
        return df if constant is None else df.fillna(constant, subset=columns)
    options = (columns, time_column, by, tiebreak, forward, backward, constant)
    if strategy == "auto":
        short, long = _by_length(df, df if outline is None else outline, by, long_series)
        parts = [_fill_by_window(short, *options)] if short is not None else []
        if long is not None:
            parts.append(_fill_by_scan(long, *options, chunks or default_chunks(df, outline)))
        return reduce(DataFrame.unionAll, parts)
    if strategy == "window":
        return _fill_by_window(df, *options)
    if strategy in ("scan", "two_pass"):
        return _fill_by_scan(df, *options, chunks or default_chunks(df, outline))
    raise ValueError(f"unknown strategy: {strategy}")


def forward_fill(df: DataFrame, columns: list[str], **options) -> DataFrame:
    """W1."""
    return fill_gaps(df, columns, backward=False, constant=None, **options)


def backward_fill(df: DataFrame, columns: list[str], **options) -> DataFrame:
    """W2."""
    return fill_gaps(df, columns, forward=False, constant=None, **options)


def fill_constant(df: DataFrame, columns: list[str], value: float = 0.0) -> DataFrame:
    """W3."""
    return df.fillna(value, subset=columns)
