"""M1, M2: hold-out splits that depend on the rows alone, not on how they are partitioned."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.operators.readings import row_index
from gridpulse.session import materialize

HASH_BITS = 31
HASH_RANGE = 1 << HASH_BITS
BIN_BITS = 16  # low bits of the hash: at most 2^15 bins first, 2^16 values inside one of them then
LISTED_CLASSES = 10_000  # so many classes, at most, are broadcast
_CLASS, _HASH, _BIN, _CUT = "_class", "_hash", "_bin", "_cut"


def row_hash(columns: list[str], seed: int) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(HASH_RANGE))


def _crossing(counts: DataFrame, step: str, wanted: Column) -> DataFrame:
    """The step (bin or hash) of each class in which the running count reaches ``wanted``.
    A class has at most 2^16 steps, whatever its number of rows."""
    running = Window.partitionBy(_CLASS).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(_CLASS)
    summed = counts.withColumns({
        "_upto": F.sum("_n").over(running),
        "_total": F.sum("_n").over(whole),
    }).withColumn("_wanted", wanted)
    before = F.col("_upto") - F.col("_n")
    hit = summed.filter((F.col("_upto") >= F.col("_wanted")) & (before < F.col("_wanted")))
    return hit.select(_CLASS, step, (F.col("_wanted") - before).alias("_rest"))


def _quotas(classes: DataFrame, share: float) -> DataFrame:
    """(class ``_q``, ``_wanted``): the test rows of each class, ceil(share * n) of all rows together. A class
    gets the whole part of its share of them; those with the largest remainders (then the smallest class)
    get one more."""
    total = classes.agg(F.sum("_total")).first()[0] or 0
    test = math.ceil(total * share)
    product = f"CAST(_total AS DECIMAL(19,0)) * CAST({test} AS DECIMAL(19,0))"
    shares = classes.select(
        F.col(_CLASS).alias("_q"), F.expr(f"{product} DIV {max(total, 1)}").alias("_whole"), F.expr(f"-({product} % {max(total, 1)})").alias("_miss")
    )
    left = test - (shares.agg(F.sum("_whole")).first()[0] or 0)
    ranked = row_index(shares, ["_miss", "_q"], name="_place")
    return ranked.select("_q", (F.col("_whole") + F.when(F.col("_place") < left, 1).otherwise(0)).alias("_wanted"))


def _with_cut(df: DataFrame, cuts: DataFrame, group: Column, h: Column, classes: DataFrame | None) -> DataFrame:
    """``df`` with the cut of its class, or null. Rows stay where they are if ``classes`` is None, for a few
    classes. Else they meet the cuts by class; those of a class with more than 1 / ``LISTED_CLASSES`` of all
    rows, which are too many for one task, get their cuts by a broadcast and are dealt out by their hash."""
    same = group.eqNullSafe(F.col(_CLASS))
    if classes is None:
        return df.join(F.broadcast(cuts), same, "left")
    total = classes.agg(F.sum("_total")).first()[0]
    large = classes.filter(F.col("_total") * LISTED_CLASSES > total).select(F.col(_CLASS).alias("_large"), F.lit(True).alias("_is_large"))
    placed = cuts.join(F.broadcast(large), F.col(_CLASS).eqNullSafe(F.col("_large")), "left")
    by_broadcast = placed.filter("_is_large").select("_large", "_is_large", F.col(_CUT).alias("_large_cut"))
    # -1 as well, but no literal: Spark takes those out of the keys by which rows are dealt.
    none = F.least(F.col(_CUT), F.lit(-1).cast("long")).alias("_none")
    others = placed.filter("_is_large IS NULL").select(_CLASS, F.col(_CUT).alias("_other_cut"), none)
    told = df.join(F.broadcast(by_broadcast), group.eqNullSafe(F.col("_large")), "left")
    dealt = F.when(F.col("_is_large"), h).otherwise(F.lit(-1).cast("long"))
    return told.join(others, same & (dealt == F.col("_none")), "left").withColumn(_CUT, F.coalesce("_large_cut", "_other_cut"))


def with_test_flag(
    df: DataFrame,
    key: list[str] | None = None,
    label: str | None = None,
    test_share: float = 0.2,
    seed: int = 42,
    name: str = "is_test",
) -> DataFrame:
    """Adds ``name``: true for ceil(share * n) rows, those with the smallest hashes; with ``label``, those
    of each class, which shares that number by largest remainders.

    The hash covers ``key`` (default: all columns), so rows equal there stay on one side; include
    enough columns that no value holds a large part of the rows. Two counting passes find the hash
    of that rank exactly; no row moves, unless there are more than ``LISTED_CLASSES`` classes.
    """
    h = row_hash(key or df.columns, seed)
    group = F.col(label) if label else F.lit(0)
    hashed = df.select(group.alias(_CLASS), h.alias(_HASH))
    bins = hashed.groupBy(_CLASS, F.shiftright(_HASH, BIN_BITS).alias(_BIN)).agg(F.count("*").alias("_n"))
    rank = F.ceil(F.col("_total") * F.lit(float(test_share)))
    many = None
    if label:
        bins = materialize(bins)
        classes = materialize(bins.groupBy(_CLASS).agg(F.sum("_n").alias("_total")))
        many = classes if classes.count() > LISTED_CLASSES else None
        quotas = _quotas(classes, float(test_share))
        bins, rank = bins.join(quotas, F.col(_CLASS).eqNullSafe(F.col("_q"))).drop("_q"), F.col("_wanted")
    found = _crossing(bins, _BIN, rank)
    bounds = found.select(F.col(_CLASS).alias("_c"), _BIN)
    # One row a class. Spark cannot know that they are few, and would deal all rows out by class.
    inside = hashed.join(
        F.broadcast(bounds) if many is None else bounds, F.col(_CLASS).eqNullSafe(F.col("_c")) & (F.shiftright(_HASH, BIN_BITS) == F.col(_BIN)), "left_semi"
    )
    values = inside.groupBy(_CLASS, _HASH).agg(F.count("*").alias("_n"))
    ranked = values.join(found.select(F.col(_CLASS).alias("_c"), "_rest"), F.col(_CLASS).eqNullSafe(F.col("_c")))
    cuts = _crossing(ranked.select(_CLASS, _HASH, "_n", "_rest"), _HASH, F.col("_rest"))
    cuts = cuts.select(_CLASS, F.col(_HASH).alias(_CUT))
    joined = _with_cut(df, cuts, group, h, many)
    return joined.select(*df.columns, F.coalesce(h <= F.col(_CUT), F.lit(False)).alias(name))


def _sides(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    return flagged.filter(~F.col("is_test")).drop("is_test"), flagged.filter("is_test").drop("is_test")


def stratified_split(df: DataFrame, label: str, **options) -> tuple[DataFrame, DataFrame]:
    """M1: (train, test) with equal class shares."""
    return _sides(with_test_flag(df, label=label, **options))


def random_split(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """M2: (train, test)."""
    return _sides(with_test_flag(df, **options))
