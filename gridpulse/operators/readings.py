"""The readings table: order, latest, history, pages, lookups, new keys."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.schema import KEY
from gridpulse.session import materialize

SALTS = 32
SHALLOW = 1000  # a page that starts later is found by counting, not by sorting all before it
PARTITION_BITS = 33  # monotonically_increasing_id(): partition number above, row number below


def sort_by_time(df: DataFrame, time_column: str = KEY, tiebreak: list[str] | None = None) -> DataFrame:
    """For a result that is shown or written in order; windows and joins sort for themselves."""
    return df.orderBy(F.col(time_column).asc_nulls_last(), *(tiebreak or []))


def _newest_first(time_column: str, tiebreak: list[str]) -> list[Column]:
    return [F.col(time_column).desc(), *[F.col(c).desc() for c in tiebreak]]


def history(
    df: DataFrame,
    limit: int = 50,
    time_column: str = KEY,
    by: list[str] | None = None,
    tiebreak: list[str] | None = None,
    since=None,
) -> DataFrame:
    """The newest rows, of all devices together or (``by``) of each device.

    Either way no task gets all rows of a device with most of the data. Up to Spark's own bound for it
    (``spark.sql.optimizer.windowGroupLimitThreshold``) every task keeps at most ``limit`` rows per device
    before anything is shuffled; above it, a device's rows are dealt to ``SALTS`` groups, whose newest rows
    are ranked again together. Rows without a time never count as newest. ``since`` narrows the scan when the caller knows a bound.
    """
    timed = df.filter(F.col(time_column).isNotNull())
    if since is not None:
        timed = timed.filter(F.col(time_column) >= F.lit(since))
    order = _newest_first(time_column, list(tiebreak or []))
    if not by:
        return timed.orderBy(*order).limit(limit)
    if limit > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        # By all columns: rows that are alike in all of them may stay in one group.
        salted = timed.withColumn("_salt", F.pmod(F.xxhash64(*timed.columns), F.lit(SALTS)).cast("int"))
        timed = _top(salted, [*by, "_salt"], order, limit).drop("_salt")
    return _top(timed, by, order, limit)


def _top(df: DataFrame, by: list[str], order: list[Column], limit: int) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= limit).drop("_rank")


def counted_history(df: DataFrame, limit: int = 50, by: list[str] | None = None, **options) -> DataFrame:
    """T3 with its count: the rows of ``history`` and, in ``count``, how many they are (per device with
    ``by``). At most ``limit`` rows share a window."""
    return history(df, limit, by=by, **options).withColumn("count", F.count("*").over(Window.partitionBy(*by or [])))


def latest_reading(df: DataFrame, **options) -> DataFrame:
    """The newest row (of each device with ``by``); no row if there is none."""
    return history(df, limit=1, **options)


def chronological(
    df: DataFrame, limit: int = 50, time_column: str = KEY, tiebreak: list[str] | None = None, **options
) -> DataFrame:
    """T4: the newest rows, oldest first, numbered from 1 in the column ``position``."""
    newest = history(df, limit, time_column, tiebreak=tiebreak, **options)
    order = [F.col(time_column).asc(), *[F.col(c).asc() for c in tiebreak or []]]
    # At most ``limit`` rows are left, so one task may number them.
    series = Window.partitionBy(*options.get("by") or []).orderBy(*order)
    return newest.withColumn("position", F.row_number().over(series)).orderBy("position")


def preview(df: DataFrame, n: int = 20, order: list[str] | None = None) -> DataFrame:
    """T5: the first rows in the declared order."""
    return df.orderBy(*(order or [KEY])).limit(n)


def page(
    df: DataFrame, order: str, skip: int = 0, limit: int = 100, after=None, descending: bool = False
) -> DataFrame:
    """One page in the order of a unique column. ``after`` (the last key of the page before)
    starts there without sorting all that precedes it, which is the way to reach deep pages. A deep ``skip``
    counts the keys in ranges first, and sorts only the ranges that the page lies in."""
    c = F.col(order)
    if after is not None:
        df = df.filter(c < F.lit(after) if descending else c > F.lit(after))
    if skip > SHALLOW:
        df, skip = _around(df, order, skip, limit, descending)
    ordered = df.orderBy(c.desc() if descending else c.asc())
    return (ordered.offset(skip) if skip else ordered).limit(limit)


def _around(df: DataFrame, order: str, skip: int, limit: int, descending: bool) -> tuple[DataFrame, int]:
    """The rows whose keys lie in the ranges of the ranks from ``skip`` on, and how many of them to skip.
    Only keys are shuffled; the driver sees one row per range."""
    c = F.col(order)
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 32)
    dealt = df.select(c.alias("key")).repartitionByRange(ranges, F.col("key").desc() if descending else F.col("key").asc())
    told = dealt.groupBy(F.spark_partition_id().alias("range")).agg(
        F.count("*").alias("n"), F.count("key").alias("known"), F.min("key").alias("low"), F.max("key").alias("high")
    )
    before, start, wanted = 0, 0, []
    for r in told.orderBy("range").collect():
        if before + r.n > skip and before < skip + limit:
            start = start if wanted else before
            inside = c.between(F.lit(r.low), F.lit(r.high)) if r.known else F.lit(False)
            wanted.append(inside | c.isNull() if r.n > r.known else inside)
        before += r.n
    return df.filter(reduce(or_, wanted)) if wanted else df.limit(0), skip - start if wanted else 0


def equals(df: DataFrame, column: str, value) -> DataFrame:
    """F2."""
    return df.filter(F.col(column) == F.lit(value))


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    """T7 for one id: its row, or none."""
    return equals(df, column, value).limit(1)


def lookup_many(df: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """T7 for many ids: the rows found, and the ids that have none."""
    wanted = ids.select(column).distinct()
    return df.join(wanted, column, "left_semi").select(*df.columns), wanted.join(df.select(column), column, "left_anti")


def new_keys_only(batch: DataFrame, target: DataFrame, keys: list[str], unique: bool = False) -> DataFrame:
    """Rows whose key is not in the target. A missing key conflicts with nothing.

    Keys that the target repeats are reduced by its map tasks; say ``unique`` where it has none."""
    known = target.select(*keys)
    return batch.join(known if unique else known.distinct(), keys, "left_anti").select(*batch.columns)


def dedupe_keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``; where that ties (or is empty), the smallest row.

    Rows with a missing key are kept, as a unique constraint would. Repeats of a hot key are dropped
    by the map tasks already.
    """
    rest = [c for c in df.columns if c not in {*keys, *order}]
    ranked = df.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *rest))
    )
    missing = reduce(or_, [F.col(k).isNull() for k in keys])
    first = ranked.filter(~missing).filter("_rank = 1").drop("_rank")
    nullable = [k for k in keys if df.schema[k].nullable]
    return first.unionAll(df.filter(missing)) if nullable else first


def import_tally(batch: DataFrame, target: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A3: what importing ``batch`` into ``target`` would do, as one row."""
    fresh = new_keys_only(dedupe_keep_first(batch, keys, order), target, keys)
    total = batch.agg(F.count("*").alias("total"))
    inserted = fresh.agg(F.count("*").alias("inserted"))
    # One row each.
    both = total.unionByName(inserted, allowMissingColumns=True)
    return both.agg(F.max("total").alias("total"), F.max("inserted").alias("inserted")).withColumn(
        "skipped", F.col("total") - F.col("inserted")
    )


def row_index(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "row_index") -> DataFrame:
    """Dense 0-based position in ``order`` (per device with ``by``), without a window.

    The rows are range-sorted once and written; each then knows its partition and its place there,
    and adds the rows of its device in earlier partitions. That table has one row per partition and
    device met there. No task sees more than its range, however large one device is. A range cannot
    split equal rows, so rows get a number first, the last thing they are sorted by; they are written for
    that, as the number depends on the row order.
    """
    by, columns = list(by or []), list(order)
    source = materialize(df).withColumn("_copy", F.monotonically_increasing_id())
    ordered = source.orderBy(*by, *columns, "_copy").drop("_copy")
    placed = materialize(ordered.withColumn("_place", F.monotonically_increasing_id()))
    data = placed.withColumn("_index_owner", F.struct(*by)) if by else placed
    owner = ["_index_owner"] if by else []
    part = F.shiftright("_place", PARTITION_BITS).alias("_index_part")
    data = data.select("*", part)
    blocks = data.groupBy(*owner, "_index_part").agg(F.count("*").alias("_rows"), F.min("_place").alias("_start"))
    earlier = Window.partitionBy(*owner).orderBy("_index_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        *owner, "_index_part", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_start")).alias("_shift")
    )
    if not by:
        # One row per partition: the number of partitions bounds it.
        offsets = F.broadcast(offsets)
    indexed = data.join(offsets, [*owner, "_index_part"], "inner")
    return indexed.select(*df.columns, (F.col("_place") + F.col("_shift")).alias(name))
