"""Bulk forms of the record-keeping queries: unique inserts, child inserts, nested reads."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.operators.readings import dedupe_keep_first, row_index
from gridpulse.session import materialize


def split_existing(batch: DataFrame, target: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows by whether ``column`` already occurs in the target."""
    known = target.select(column).distinct()
    sides = [batch.join(known, column, kind).select(*batch.columns) for kind in ("left_anti", "left_semi")]
    return sides[0], sides[1]


GROUP_ROWS = 200_000  # rows of one group of conflicts that a task works off at a time


def _first_in_all(open_rows: DataFrame, unique: list[str], order: list[str]) -> DataFrame:
    """Rows that come first among those with the same value, in every column."""
    leading = open_rows.select("_row", *dict.fromkeys([*order, *unique]))
    for c in unique:
        first = leading.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min(F.struct(*order)).alias(f"_first_{c}"))
        leading = leading.join(first, c, "left")
    here = F.struct(*order)
    firsts = [F.col(c).isNull() | (F.col(f"_first_{c}") == here) for c in unique]
    return leading.filter(reduce(and_, firsts)).select("_row", *unique)


def _not_blocked(open_rows: DataFrame, accepted: DataFrame, unique: list[str]) -> DataFrame:
    """Rows that are neither accepted nor share a value with one that is."""
    rest = open_rows.join(accepted.select("_row"), "_row", "left_anti")
    for c in unique:
        rest = rest.join(accepted.filter(F.col(c).isNotNull()).select(c), c, "left_anti")
    return rest


def conflict_groups(rows: DataFrame, unique: list[str]) -> DataFrame:
    """(``_row``, ``_group``): rows that values of the unique columns connect, however indirectly, have one
    group, named after its smallest row. Every value ties its rows to the smallest of them; then stars of
    neighbours are drawn together in turn until each group is one star, in a number of rounds that grows
    with the logarithm of the longest chain."""
    ties = []
    for c in unique:
        known = rows.filter(F.col(c).isNotNull()).select("_row", c)
        heads = known.groupBy(c).agg(F.min("_row").alias("b"), F.count("*").alias("n")).filter("n > 1")
        ties.append(known.join(heads, c).select(F.col("_row").alias("a"), "b").filter("a <> b"))
    edges = materialize(reduce(DataFrame.unionAll, ties).distinct())
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = materialize(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = edges.select(F.col("a").alias("_row"), F.col("b").alias("_group"))
    return rows.select("_row").join(found, "_row", "left").select("_row", F.coalesce("_group", "_row").alias("_group"))


def _accept_in_order(batch: DataFrame, unique: list[str], order: list[str]) -> DataFrame:
    """Rows that inserting one by one in ``order`` would accept under several unique columns.

    Rows that come first in all their columns are accepted at once, and those that share a value with them
    are settled. The rest falls into groups of rows that block each other through shared values; each group
    is worked off in order by one task. A group above ``GROUP_ROWS`` rows is cut: its first rows are worked
    off, what their values settle goes, and the remaining rows are grouped anew.
    """
    open_rows = materialize(batch.withColumn("_row", F.monotonically_increasing_id()))
    numbered, accepted = open_rows, []

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        taken: list[set] = [set() for _ in unique]
        kept = []
        for row, *values in group.sort_values("_rank")[["_row", *unique]].astype(object).itertuples(index=False, name=None):
            known = [None if pd.isna(v) else v for v in values]
            if not any(v is not None and v in t for v, t in zip(known, taken, strict=True)):
                kept.append((row, *known))
                for v, t in zip(known, taken, strict=True):
                    t.add(v)
        return pd.DataFrame(kept, columns=["_row", *unique])

    first = materialize(_first_in_all(open_rows, unique, order))
    accepted.append(first.select("_row"))
    open_rows = materialize(_not_blocked(open_rows, first, unique))
    schema = T.StructType([open_rows.schema["_row"], *[open_rows.schema[c] for c in unique]])
    while not open_rows.isEmpty():
        grouped = open_rows.select("_row", *order, *[c for c in unique if c not in order]).join(conflict_groups(open_rows, unique), "_row")
        ranked = grouped.withColumn("_rank", F.row_number().over(Window.partitionBy("_group").orderBy(*order)))
        turn = materialize(ranked.filter(F.col("_rank") <= GROUP_ROWS).select("_row", "_group", "_rank", *unique))
        won = materialize(turn.groupBy("_group").applyInPandas(greedy, schema))
        accepted.append(won.select("_row"))
        open_rows = materialize(_not_blocked(open_rows.join(turn.select("_row"), "_row", "left_anti"), won, unique))
    return numbered.join(reduce(DataFrame.unionAll, accepted), "_row", "left_semi").select(*batch.columns)


def _with_reason(rejected: DataFrame, accepted: DataFrame, target: DataFrame, unique: list[str], order: list[str]) -> DataFrame:
    """Names the first unique column whose value the target, or a row accepted earlier, has already."""
    reason, marked = None, rejected
    for k, c in enumerate(unique):
        known = target.filter(F.col(c).isNotNull()).select(c).distinct().withColumn(f"_known{k}", F.lit(True))
        earlier = accepted.filter(F.col(c).isNotNull()).select(c, F.struct(*order).alias(f"_earlier{k}"))
        marked = marked.join(known, c, "left").join(earlier, c, "left")
        taken = F.coalesce(F.col(f"_known{k}"), F.lit(False)) | F.coalesce(F.col(f"_earlier{k}") < F.struct(*order), F.lit(False))
        text = F.lit(f"{c.capitalize()} already registered")
        reason = F.when(taken, text) if reason is None else reason.when(taken, text)
    return marked.select(*rejected.columns, reason.alias("reason"))


def insert_unique(
    batch: DataFrame, target: DataFrame, unique: list[str], order: list[str], id_column: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """B1: (accepted rows with new ids, rejected rows with the reason).

    ``order`` must identify the rows of the batch. Ids continue the target's and are dense in that
    order.
    """
    fresh = batch
    for c in unique:
        fresh = fresh.join(target.select(c), c, "left_anti")
    fresh = fresh.select(*batch.columns)
    accepted = dedupe_keep_first(fresh, unique, order) if len(unique) == 1 else _accept_in_order(fresh, unique, order)
    accepted = materialize(accepted)
    highest = target.agg(F.max(id_column).alias("m")).first().m or 0
    numbered = row_index(accepted, order, name="_index")
    inserted = numbered.select((F.col("_index") + F.lit(highest + 1)).alias(id_column), *batch.columns)
    rejected = batch.join(accepted.select(*order), order, "left_anti")
    return inserted, _with_reason(rejected.select(*batch.columns), accepted, target, unique, order)


def insert_children(
    batch: DataFrame,
    parents: dict[str, DataFrame],
    defaults: dict[str, Column],
    required: tuple[str, ...] = (),
    order: list[str] | None = None,
    highest: int = 0,
    id_column: str = "id",
    target: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """B2: (accepted, orphans) after filling absent or missing values with ``defaults``.

    ``parents`` maps a reference column to a frame whose first column holds the known ids. A missing
    reference is allowed unless the column is ``required``. With an ``order`` the accepted rows get ids
    in it, dense and above the highest id of the stored children, ``target``, and above ``highest``.
    """
    filled = batch.withColumns({
        c: F.coalesce(F.col(c), v) if c in batch.columns else v for c, v in defaults.items()
    })
    marked, unknown = filled, []
    for column, parent in parents.items():
        flag = f"_known_{column}"
        known = parent.select(F.col(parent.columns[0]).alias(column)).distinct().withColumn(flag, F.lit(True))
        marked = marked.join(known, column, "left")
        absent = F.col(flag).isNull()
        unknown.append(absent if column in required else absent & F.col(column).isNotNull())
    orphan = reduce(or_, unknown)
    accepted = marked.filter(~orphan).select(*filled.columns)
    if order:
        stored = target.agg(F.max(id_column).alias("m")).first().m if target is not None else None
        numbered = row_index(accepted, order, name="_index")
        accepted = numbered.select((F.col("_index") + F.lit(max(highest, stored or 0) + 1)).alias(id_column), *filled.columns)
    return accepted, marked.filter(orphan).select(*filled.columns)


@dataclass(frozen=True)
class Lookup:
    """An optional record of each child: the row of ``records`` whose ``id_column`` is the child's
    ``reference``, as a struct ``name``."""

    records: DataFrame
    id_column: str
    reference: str
    name: str = "course"


def _items(owners: DataFrame, children: DataFrame, owner_id: str, child_owner: str, fields: list[str], lookup: Lookup | None) -> DataFrame:
    """(_owner, _item) for the children of these owners; others are left out before anything else."""
    own = owners.select(F.col(owner_id).alias("_owner"))
    kept = children.withColumn("_owner", F.col(child_owner)).join(own, "_owner", "left_semi")
    if lookup is None:
        return kept.select("_owner", F.struct(*fields).alias("_item"))
    columns = lookup.records.columns
    side = lookup.records.select(*[F.col(c).alias(f"_l_{c}") for c in columns])
    record = F.struct(*[F.col(f"_l_{c}").alias(c) for c in columns])
    joined = kept.join(side, kept[lookup.reference] == side[f"_l_{lookup.id_column}"], "left")
    found = F.when(F.col(f"_l_{lookup.id_column}").isNotNull(), record).alias(lookup.name)
    return joined.select("_owner", F.struct(*fields, found).alias("_item"))


def child_rows(
    owners: DataFrame, children: DataFrame, owner_id: str, child_owner: str, fields: list[str],
    lookup: Lookup | None = None, name: str = "deadline",
) -> DataFrame:
    """One row per owner and child, with the child's ``position`` (from 0) in the sorted list of its
    owner; nulls for an owner without children.

    Positions come from one range sort, so a list may have any length. An owner with most of the
    children is spread over many tasks; AQE splits it in the join.
    """
    items = _items(owners, children, owner_id, child_owner, fields, lookup)
    placed = row_index(items, ["_item"], by=["_owner"], name="position").withColumnRenamed("_item", name)
    return owners.join(placed, owners[owner_id] == placed["_owner"], "left").drop("_owner")


def nest_children(
    owners: DataFrame, children: DataFrame, owner_id: str, child_owner: str, fields: list[str],
    lookup: Lookup | None = None, name: str = "deadlines",
) -> DataFrame:
    """J4, nested: exactly one row per owner, with the sorted list of its children.

    Two joins replace one query per owner. An owner without children gets an empty list. A list is one
    value, so this form is for owners whose lists fit a row, such as a page; ``child_rows`` takes any.
    """
    items = _items(owners, children, owner_id, child_owner, fields, lookup)
    lists = items.groupBy("_owner").agg(F.sort_array(F.collect_list("_item")).alias(name))
    nested = owners.join(lists, owners[owner_id] == lists["_owner"], "left").drop("_owner")
    return nested.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
