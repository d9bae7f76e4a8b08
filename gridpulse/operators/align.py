"""Put several feeds side by side on their time key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.schema import KEY
from gridpulse.session import materialize

_FEED, _KEY = "_feed", "_key"
HOT_ROWS = 1_000_000
LIST_ROWS = 10_000


def _names(on: str | list[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def _check_columns(feeds: list[DataFrame], on: list[str]) -> None:
    seen: set[str] = set()
    for feed in feeds:
        values = set(feed.columns) - set(on)
        if clash := seen & values:
            raise ValueError(f"columns occur in more than one feed: {sorted(clash)}")
        seen |= values


def _present(feed: DataFrame, on: list[str], null_keys: str) -> DataFrame:
    if null_keys == "match":
        return feed
    if null_keys == "drop":
        return feed.dropna(subset=on)
    raise ValueError(f"unknown null key policy: {null_keys}")


def null_key_counts(feeds: dict[str, DataFrame], on: str | list[str] = KEY) -> DataFrame:
    """Rows per feed that ``null_keys="drop"`` leaves out."""
    keys = _names(on)
    tagged = [f.select(F.lit(name).alias("feed"), *keys) for name, f in feeds.items()]
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return reduce(DataFrame.unionAll, tagged).groupBy("feed").agg(F.count_if(missing).alias("null_keys"))


def _rows_per_key(feeds: list[DataFrame], keys: list[str]) -> DataFrame:
    """(feed number, key) with the number of rows; reads only the key columns."""
    tagged = [f.select(F.lit(i).alias(_FEED), F.struct(*keys).alias(_KEY)) for i, f in enumerate(feeds)]
    return reduce(DataFrame.unionAll, tagged).groupBy(_FEED, _KEY).agg(F.count("*").alias("_n"))


def keys_are_unique(feeds: list[DataFrame], on: str | list[str] = KEY) -> bool:
    """Whether no feed has two rows of one key."""
    return _rows_per_key(feeds, _names(on)).filter("_n > 1").isEmpty()


def _align_by_union(feeds: list[DataFrame], on: list[str], how: str) -> DataFrame:
    """One exchange for any number of feeds: stack them and take, per key, the one row of each feed.
    A feed's columns travel as one struct, so a stacked row carries no empty columns of other feeds.
    A repeated key fails the job."""
    names = [f"_feed_{i}" for i in range(len(feeds))]
    rows = [f"_rows_{i}" for i in range(len(feeds))]
    values = [[c for c in feed.columns if c not in on] for feed in feeds]
    packed = [
        feed.select(*on, F.struct(*(columns or [F.lit(1).alias("_present")])).alias(name))
        for feed, columns, name in zip(feeds, values, names, strict=True)
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), packed)
    grouped = stacked.groupBy(*on).agg(
        *[F.first(n, ignorenulls=True).alias(n) for n in names],
        *[F.count(n).alias(r) for n, r in zip(names, rows, strict=True)],
    )
    repeated = F.greatest(F.lit(0), *[F.col(r) for r in rows]) > 1
    checked = grouped.filter(
        F.assert_true(~repeated, F.lit("a feed repeats a key: align with strategy='join'")).isNull()
    )
    if how == "inner":
        checked = checked.filter(F.least(F.lit(1), *[F.col(r) for r in rows]) >= 1)
    unpacked = [F.col(n)[c].alias(c) for n, columns in zip(names, values, strict=True) for c in columns]
    return checked.select(*on, *unpacked)


def _cogroup(feeds: list[DataFrame], how: str) -> DataFrame:
    """One exchange for any number of feeds (``_key`` and values): stack them, gather each feed's rows of a key in a
    list, and expand the product of the lists in place. The inner form drops keys that a feed lacks; in
    the outer form an empty list stands for one row without values."""
    names = [f"_feed_{i}" for i in range(len(feeds))]
    values = [[c for c in feed.columns if c != _KEY] for feed in feeds]
    packed = [
        feed.select(_KEY, F.struct(*(columns or [F.lit(1).alias("_present")])).alias(name))
        for feed, columns, name in zip(feeds, values, names, strict=True)
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), packed)
    rows = stacked.groupBy(_KEY).agg(*[F.collect_list(n).alias(n) for n in names])
    if how == "inner":
        rows = rows.filter(reduce(lambda a, b: a & b, [F.size(n) > 0 for n in names]))
    for name in names:
        others = [n for n in names if n != name]
        rows = rows.select(_KEY, *others, F.explode_outer(name).alias(name))
    return rows.select(_KEY, *[F.col(n)[c].alias(c) for n, columns in zip(names, values, strict=True) for c in columns])


def _spread(feed: DataFrame, number: int, hot: DataFrame) -> DataFrame:
    """Rows of hot keys with a salt: the largest feed of a key deals its rows out, the others are
    repeated for every salt. Rows are numbered after they were written, so a lost task deals alike."""
    dealt = F.array(F.pmod("_row", "_ways"))
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("_ways") - 1)
    numbered = feed.withColumn("_row", F.monotonically_increasing_id()).join(hot, _KEY)
    salts = F.when(F.col("_largest") == number, dealt).otherwise(everywhere)
    return numbered.withColumn("_salt", F.explode(salts)).drop("_row", "_ways", "_largest")


def _align_by_cogroup(feeds: list[DataFrame], on: list[str], how: str, hot_rows: int, most: int) -> DataFrame:
    """Repeated keys multiply. ``most`` is the largest number of rows that a feed has of one key. Keys with
    more than ``LIST_ROWS`` rows in a feed (or ``hot_rows``, if that is less) are too many for a list and
    joined apart, salted."""
    key = F.struct(*on).alias(_KEY)  # a struct of nulls equals another one
    keyed = [f.select(key, *[c for c in f.columns if c not in on]) for f in feeds]
    values = [c for f in keyed for c in f.columns if c != _KEY]
    limit, salted = min(hot_rows, LIST_ROWS), None
    if most > limit:
        # At most (all rows) / limit keys.
        counts = _rows_per_key(feeds, on).filter(F.col("_n") > limit)
        hot = materialize(
            counts.groupBy(_KEY).agg(
                F.max_by(_FEED, "_n").alias("_largest"), F.ceil(F.max("_n") / hot_rows).alias("_ways")
            )
        )
        apart = [materialize(f.join(hot, _KEY, "left_semi").select(*f.columns)) for f in keyed]
        keyed = [f.join(hot, _KEY, "left_anti").select(*f.columns) for f in keyed]
        if how == "outer":
            lacking = [hot.select(_KEY).join(f.select(_KEY), _KEY, "left_anti") for f in apart]
            apart = [materialize(f.unionByName(k, allowMissingColumns=True)) for f, k in zip(apart, lacking, strict=True)]
        spread = [_spread(f, i, hot) for i, f in enumerate(apart)]
        salted = reduce(lambda a, b: a.join(b, [_KEY, "_salt"]), spread)
    joined = _cogroup(keyed, how)
    if salted is not None:
        joined = joined.unionAll(salted.select(_KEY, *values))
    return joined.select(*[F.col(_KEY)[c].alias(c) for c in on], *values)


def align_feeds(
    feeds: list[DataFrame] | dict[str, DataFrame],
    on: str | list[str] = KEY,
    how: str = "outer",
    strategy: str = "auto",
    null_keys: str = "match",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """J1 (``how="outer"``) and J2 (``how="inner"``).

    ``strategy="union"`` needs unique keys per feed and costs one exchange. ``"join"`` multiplies repeated keys:
    it looks at the keys first (one job over the key columns), then one exchange gathers the rows of a key,
    and hot keys are spread over many tasks. ``"auto"`` looks at the keys likewise and takes the union if
    none is repeated.
    Missing keys match each other (``"match"``) or are left out (``"drop"``). The result has no
    order: sort where it is shown.
    """
    keys = _names(on)
    if how not in ("outer", "inner"):
        raise ValueError(f"unknown alignment: {how}")
    frames = [_present(f, keys, null_keys) for f in (feeds.values() if isinstance(feeds, dict) else feeds)]
    _check_columns(frames, keys)
    if strategy not in ("auto", "union", "join"):
        raise ValueError(f"unknown strategy: {strategy}")
    most = 1 if strategy == "union" else _rows_per_key(frames, keys).agg(F.max("_n")).first()[0] or 0
    if strategy == "join" or most > 1:
        return _align_by_cogroup(frames, keys, how, hot_rows, most)
    return _align_by_union(frames, keys, how)
