"""Sharding by jump consistent hashing (3), in column expressions only.

A key's generator is seeded with the key; it draws ever later jumps, and the key stays in the last
bucket that it jumped to below the number of shards. So one more shard takes rows only into itself, and
no table of the ring exists. The generator is x -> 2862933555777941757 x + 1 modulo 2^64, computed on
two halves of 32 bits each, since column arithmetic does not wrap around.

Defined results: a null key counts as key 0. A null text has no bytes. Repeated rows are placed each.
Only the key and the text are read; other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.llm.common import Scratch

FACTOR = 2862933555777941757
LOW = (1 << 32) - 1
FEW = 64  # jumps that are tried before the long way: a key needs about ln(shards) of them
PARTITION_BITS = 33


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """The generator's next state. Each product below stays under 2^63."""
    f_high, f_low = F.lit(FACTOR >> 32), F.lit(FACTOR & LOW)
    below, above = low.bitwiseAND(F.lit(0xFFFF)) * f_low, F.shiftrightunsigned(low, 16) * f_low
    sum_low = below + F.shiftleft(above.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftrightunsigned(above, 16) + F.shiftrightunsigned(sum_low, 32)
    high_part = high.bitwiseAND(F.lit(0xFFFF)) * f_low
    high_top = (F.shiftrightunsigned(high, 16) * f_low).bitwiseAND(F.lit(0xFFFF))
    sum_high = carry + (low * f_high).bitwiseAND(F.lit(LOW)) + high_part.bitwiseAND(F.lit(LOW)) + F.shiftleft(high_top, 16)
    return sum_high.bitwiseAND(F.lit(LOW)), sum_low.bitwiseAND(F.lit(LOW))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, of a long key."""
    key = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    start = F.struct(
        F.lit(0).cast("bigint").alias("bucket"), F.lit(0).cast("bigint").alias("jump"),
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(LOW)).alias("low"),
    )

    def step(s: Column, _: Column) -> Column:
        high, low = _next(s["high"], s["low"])
        # The top 31 bits, plus one, as a share of 2^31.
        jump = ((s["jump"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(high, 1) + 1).cast("double"))).cast("bigint")
        moved = F.struct(s["jump"].alias("bucket"), jump.alias("jump"), high.alias("high"), low.alias("low"))
        return F.when(s["jump"] >= shards, s).otherwise(moved)

    done = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, FEW))), start, step)
    if shards > FEW:  # every jump goes up, so there are no more jumps than shards
        more = F.sequence(F.lit(FEW + 1), F.lit(shards))
        done = F.when(done["jump"] >= shards, done).otherwise(F.aggregate(more, done, step))
    return done["bucket"].cast("int")


def assign(docs: DataFrame, shards: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row its id, ``size`` (bytes of the text and one), ``text_crc32``, ``shard``, ``slot`` and
    ``grown_shard`` (with one shard more).

    Slots count a shard's rows from 0 in the order of (id, size, crc). The rows, without their texts, are
    range-sorted once and written; each range then numbers its rows and adds those of its shard in the
    ranges before. That table has a row per range and shard met there. Equal rows are told apart by their
    place in the scan, so they need not share a range.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        jump_hash(F.col(id_column), shards).alias("shard"), jump_hash(F.col(id_column), shards + 1).alias("grown_shard"),
        F.monotonically_increasing_id().alias("copy"),
    )
    ordered = rows.orderBy("shard", "id", "size", "text_crc32", "copy").drop("copy")
    placed = scratch.table(ordered.withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumn("range", F.shiftright("place", PARTITION_BITS))
    blocks = placed.groupBy("shard", "range").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shift = blocks.select("shard", "range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    out = placed.join(shift, ["shard", "range"])
    return out.select(
        F.col("id").alias(id_column), "size", "text_crc32", "shard", (F.col("place") + F.col("shift")).alias("slot"), "grown_shard"
    )
