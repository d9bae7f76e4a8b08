import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridpulse.functions.frames import clean_numbers
from gridpulse.operators import fill
from gridpulse.operators.align import align_feeds, keys_are_unique, null_key_counts
from gridpulse.plans.telemetry import load_telemetry
from gridpulse.schema import FEED_FILES, FEEDS, KEY, RISK

A = [(1, 1.0), (2, 2.0), (None, 9.0)]
B = [(2, 20.0), (3, 30.0), (None, 90.0)]
B_TWICE = [(2, 20.0), (2, 21.0), (3, 30.0), (None, 90.0), (None, 91.0)]
C = [(2, 200.0), (5, None)]


def feed(spark, rows, name):
    return spark.createDataFrame(rows, f"k int, {name} double")


def shown(df):
    return sorted([tuple(r) for r in df.select("k", "a", "b", "c").collect()], key=repr)


def merged(b, how):
    """The rule by hand: merge step by step, missing keys match each other."""
    frames = [pd.DataFrame(r, columns=["k", n]) for r, n in ((A, "a"), (b, "b"), (C, "c"))]
    out = frames[0]
    for f in frames[1:]:
        out = out.merge(f, on="k", how=how)
    plain = [tuple(None if pd.isna(v) else v for v in r) for r in out[["k", "a", "b", "c"]].itertuples(index=False)]
    return sorted([(None if r[0] is None else int(r[0]), *r[1:]) for r in plain], key=repr)


@pytest.mark.parametrize("how", ["outer", "inner"])
@pytest.mark.parametrize(("b", "strategy"), [(B, "union"), (B, "join"), (B, "auto"), (B_TWICE, "join"), (B_TWICE, "auto")])
def test_align_equals_step_by_step_merge(spark, b, strategy, how):
    feeds = [feed(spark, A, "a"), feed(spark, b, "b"), feed(spark, C, "c")]
    assert shown(align_feeds(feeds, "k", how, strategy)) == merged(b, how)


def test_union_refuses_repeated_keys(spark):
    feeds = [feed(spark, A, "a"), feed(spark, B_TWICE, "b")]
    assert not keys_are_unique(feeds, "k")
    with pytest.raises(PySparkException, match="repeats a key"):
        align_feeds(feeds, "k", strategy="union").collect()


def test_missing_keys_can_be_left_out_and_counted(spark):
    feeds = {"a": feed(spark, A, "a"), "b": feed(spark, B, "b")}
    assert align_feeds(feeds, "k", null_keys="drop").filter("k is null").isEmpty()
    assert {tuple(r) for r in null_key_counts(feeds, "k").collect()} == {("a", 1), ("b", 1)}


def test_clashing_columns_are_refused(spark):
    with pytest.raises(ValueError, match="more than one feed"):
        align_feeds([feed(spark, A, "a"), feed(spark, B, "a")], "k")


def test_union_alignment_shuffles_once(spark):
    feeds = [feed(spark, A, "a").repartition(3), feed(spark, B, "b").repartition(3), feed(spark, C, "c")]
    df = align_feeds(feeds, "k", strategy="union")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("how", ["outer", "inner"])
def test_repeated_keys_shuffle_once(spark, tmp_path, how):
    rows = {n: [(k % 40 or None, float(k)) for k in range(60 + i)] for i, n in enumerate("abcde")}
    feeds = []
    for n, r in rows.items():
        feed(spark, r, n).write.parquet(f"{tmp_path}/{n}")
        feeds.append(spark.read.parquet(f"{tmp_path}/{n}"))
    df = align_feeds(feeds, "k", how)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan parquet") == 5
    want = pd.DataFrame(rows["a"], columns=["k", "a"])
    for n in "bcde":
        want = want.merge(pd.DataFrame(rows[n], columns=["k", n]), on="k", how=how)
    assert sorted(map(repr, df.toPandas().fillna(-1).values.tolist())) == sorted(map(repr, want.fillna(-1).values.tolist()))


def test_no_rows_and_feeds_of_keys_only(spark):
    none = feed(spark, [], "a")
    assert align_feeds([none, feed(spark, B_TWICE, "b")], "k").count() == 5
    assert align_feeds([none, feed(spark, B_TWICE, "b")], "k", "inner").count() == 0
    assert align_feeds([none, feed(spark, [], "b")], "k").count() == 0
    keys = feed(spark, B_TWICE, "b").select("k")
    assert align_feeds([keys, feed(spark, A, "a")], "k").count() == 6


@pytest.mark.parametrize("how", ["outer", "inner"])
def test_hot_keys_are_spread_and_whole(spark, how):
    """Keys 2 and null count as hot here; copies of a row are dealt out like other rows."""
    rng = random.Random(4)
    rows = {
        "a": [(2, 1.0)] * 9 + [(rng.choice([1, 2, 3, None]), float(i)) for i in range(30)],
        "b": [(2, 5.0), (4, 6.0)] + [(None, float(i)) for i in range(7)],
        "c": [(2, 7.0), (1, 8.0), (None, 9.0)],
    }
    feeds = [feed(spark, r, n) for n, r in rows.items()]
    plain = shown(align_feeds(feeds, "k", how, "join"))
    assert len(plain) > 40
    assert shown(align_feeds(feeds, "k", how, "join", hot_rows=4)) == plain


def test_hot_key_multiplies_completely(spark):
    hot = spark.range(3000).select(F.lit(7).alias("k"), F.col("id").cast("double").alias("a"))
    other = spark.createDataFrame([(7, 1.0), (7, 2.0), (8, 3.0)], "k int, b double")
    assert align_feeds([hot, other], "k", "outer", "auto").count() == 3000 * 2 + 1


START = dt.datetime(2024, 1, 1)


def series(spark, rows=600, devices=3, seed=5, copies=1):
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        day = rng.randrange(0, 400) if rng.random() < 0.6 else 100  # one hot moment
        value = [rng.choice([None, None, float(i)]), rng.choice([None] * 9 + [float(-i)]), None]
        data += [(rng.randrange(devices) or None, START + dt.timedelta(hours=day), i, *value)] * copies
    data.append((1, None, rows, 5.0, None, None))
    return spark.createDataFrame(data, f"device int, {KEY} timestamp, tie int, a double, b double, c double")


def table(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.mark.parametrize("steps", [(True, True, 0.0), (True, False, None), (False, True, None), (False, True, 1.0)])
@pytest.mark.parametrize("by", [[], ["device"]])
@pytest.mark.parametrize("chunks", [2, 7, 64])
def test_two_passes_equal_one_window(spark, steps, by, chunks):
    df = series(spark)
    options = dict(
        columns=["a", "b", "c"], by=by, tiebreak=["tie"], forward=steps[0], backward=steps[1], constant=steps[2]
    )
    window = fill.fill_gaps(df, strategy="window", **options)
    two = fill.fill_gaps(df, strategy="two_pass", chunks=chunks, **options)
    auto = fill.fill_gaps(df, strategy="auto", long_series=150, chunks=chunks, **options)
    assert table(two) == table(window) == table(auto)


def test_window_equals_plain_pandas(spark):
    df = series(spark, devices=1).filter(F.col(KEY).isNotNull())
    pdf = df.toPandas().sort_values([KEY, "tie"], kind="stable")
    pdf[["a", "b", "c"]] = pdf[["a", "b", "c"]].ffill().bfill().fillna(0)
    got = fill.fill_gaps(df, ["a", "b", "c"], tiebreak=["tie"], strategy="two_pass").toPandas().sort_values([KEY, "tie"])
    assert got[["a", "b", "c"]].values.tolist() == pdf[["a", "b", "c"]].values.tolist()


@pytest.mark.parametrize("by", [[], ["device"]])
def test_long_series_are_filled_in_pieces(spark, monkeypatch, by):
    monkeypatch.setattr(fill, "FLUSH_ROWS", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "25")
    try:
        df = series(spark, rows=900)
        options = dict(columns=["a", "b", "c"], by=by, tiebreak=["tie"])
        want = table(fill.fill_gaps(df, strategy="window", **options))
        assert table(fill.fill_gaps(df, strategy="scan", chunks=3, **options)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hot_moment_is_cut_along_the_tiebreak(spark):
    df = spark.range(4000).select(
        F.lit(START).alias(KEY), F.col("id").cast("int").alias("tie"), F.when(F.col("id") % 1000 == 5, 1.0).alias("a"), F.lit("x").alias("note")
    )
    filled = fill.fill_gaps(df, ["a"], tiebreak=["tie"], strategy="scan", chunks=8)
    assert filled.filter("a IS NULL").isEmpty() and filled.count() == 4000 and filled.filter("note <> 'x'").isEmpty()
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # no row moves again


@pytest.mark.parametrize("rows", [0, 1])
def test_tiny_series(spark, rows):
    df = series(spark).limit(rows)
    for strategy in ("two_pass", "window", "auto"):
        out = fill.fill_gaps(df, ["a", "b", "c"], by=["device"], tiebreak=["tie"], strategy=strategy)
        assert out.count() == rows


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_result_does_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = table(fill.fill_gaps(series(spark), ["a", "b", "c"], tiebreak=["tie"], strategy="window"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        assert table(fill.fill_gaps(series(spark), ["a", "b", "c"], tiebreak=["tie"], strategy="two_pass")) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_telemetry_from_csv_files(spark, tmp_path):
    """Five files with gaps, a blank, an NA marker and reordered columns."""
    for i, (name, columns) in enumerate(FEEDS.items()):
        header = [*columns, KEY] if i % 2 else [KEY, *columns]
        lines = [",".join(header)]
        for h in range(6):
            if (h + i) % 5 == 0:
                continue
            cells = {c: str(10 * h + j) for j, c in enumerate(columns)}
            cells[columns[0]] = ["", "NA", "30"][h % 3]
            cells[KEY] = f"2020-01-01T0{h}:15" if h % 2 else f"2020-01-01 0{h}:15:00"
            lines.append(",".join(cells[c] for c in header))
        (tmp_path / FEED_FILES[name]).write_text("\n".join(lines))
    frame = load_telemetry(spark, str(tmp_path))
    rows = frame.orderBy(KEY).collect()
    assert len(rows) == 6 and len(frame.columns) == 50 + 3 + 10 + 2
    assert all(v is not None for r in rows for v in r)
    assert {r.OTI for r in rows} == {30.0} and all(r[RISK] in (0, 1, 2) for r in rows)
    with pytest.raises(PySparkException, match="PATH_NOT_FOUND"):
        load_telemetry(spark, str(tmp_path / "nowhere"))


def test_nan_counts_as_missing(spark):
    df = clean_numbers(spark.createDataFrame([(float("nan"),), (1.0,)], "a double"))
    assert sorted(df.collect(), key=repr) == [(1.0,), (None,)]
