import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridpulse.functions import columns
from gridpulse.functions.frames import lower_columns, with_constant
from gridpulse.operators import readings
from gridpulse.schema import DEVICE, KEY, READING_TIME, RiskRules
from gridpulse.sources import readers, writers

START = dt.datetime(2024, 1, 1)


def stamped(spark, rows):
    return spark.createDataFrame(
        [(d, None if h is None else START + dt.timedelta(hours=h), n) for d, h, n in rows],
        f"{DEVICE} string, {READING_TIME} timestamp, n int",
    )


def test_latest_ignores_missing_times_and_breaks_ties(spark):
    df = stamped(spark, [("a", 1, 1), ("a", 5, 2), ("a", 5, 3), ("a", None, 4), ("b", 2, 5)])
    options = dict(time_column=READING_TIME, tiebreak=["n"])
    assert [r.n for r in readings.latest_reading(df, **options).collect()] == [3]
    assert sorted(r.n for r in readings.latest_reading(df, by=[DEVICE], **options).collect()) == [3, 5]
    assert readings.latest_reading(df.limit(0), **options).isEmpty()
    assert [r.n for r in readings.chronological(df, 2, READING_TIME, ["n"]).collect()] == [2, 3]


def test_history_per_device_keeps_rows_back_before_the_shuffle(spark):
    df = stamped(spark, [("a", h, h) for h in range(50)])
    ranked = readings.history(df, 3, READING_TIME, [DEVICE], ["n"])
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Exchange") == 1
    assert sorted(r.n for r in ranked.collect()) == [47, 48, 49]


def test_total_history_is_a_top_k(spark):
    plan = readings.history(stamped(spark, [("a", 1, 1)]), 5, READING_TIME)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_dedupe_keeps_rows_without_key(spark):
    df = stamped(spark, [("a", 1, 2), ("a", 1, 1), ("a", None, 3), ("a", None, 4)])
    kept = readings.dedupe_keep_first(df, [DEVICE, READING_TIME], ["n"])
    assert sorted(r.n for r in kept.collect()) == [1, 3, 4]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("by", [None, ["g"]])
def test_row_index_is_dense_with_copies_of_a_row(spark, by):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(5)) for _ in range(300)] + [("a", 2)] * 400
    df = spark.createDataFrame(rows, "g string, x int").repartition(6)
    out = readings.row_index(df, ["x"], by).collect()
    for g in ("a", "b") if by else (None,):
        mine = sorted((r.row_index, r.x) for r in out if g is None or r.g == g)
        assert [i for i, _ in mine] == list(range(len(mine)))
        assert [x for _, x in mine] == sorted(x for _, x in mine)
    assert len(out) == 700


def test_pages(spark):
    df = spark.range(1000)
    assert [r.id for r in readings.page(df, "id", 10, 3).collect()] == [10, 11, 12]
    assert [r.id for r in readings.page(df, "id", limit=3, after=500).collect()] == [501, 502, 503]
    assert [r.id for r in readings.page(df, "id", limit=2, after=500, descending=True).collect()] == [499, 498]
    assert readings.page(df, "id", 2000).isEmpty()


def test_lookup(spark):
    df = spark.range(5)
    assert readings.lookup(df, "id", 3).count() == 1 and readings.lookup(df, "id", 9).count() == 0
    found, missing = readings.lookup_many(df, spark.createDataFrame([(1,), (1,), (8,)], "id long"), "id")
    assert found.collect() == [(1,)] and missing.collect() == [(8,)]


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "table")
    first = stamped(spark, [("a", 1, 1), ("a", 1, 2), ("a", 2, 3)])
    mixed = stamped(spark, [("a", 2, 9), ("a", 30, 4), ("b", 1, 5), ("b", 1, 6)])

    def run(batch):
        t = writers.append_idempotent(batch, path, order=("n",))
        return t.total, t.inserted, t.skipped

    assert run(first) == (3, 2, 1)
    assert run(mixed) == (4, 2, 2)
    assert run(mixed) == (4, 0, 4)
    assert run(first.limit(0)) == (0, 0, 0)
    assert sorted(r.n for r in readers.read_readings(spark, path).collect()) == [1, 3, 4, 5]


def test_append_tally_agrees_with_the_forecast(spark, tmp_path):
    path = str(tmp_path / "table")
    writers.append_idempotent(stamped(spark, [("a", 1, 1)]), path, order=("n",))
    batch = stamped(spark, [("a", 1, 2), ("a", 2, 3), ("a", 2, 4)])
    row = readings.import_tally(batch, readers.read_readings(spark, path), [DEVICE, READING_TIME], ["n"]).first()
    assert (row.total, row.inserted, row.skipped) == (3, 1, 2)


def test_append_reads_only_the_days_of_the_batch(spark, tmp_path):
    path = str(tmp_path / "table")
    writers.append_idempotent(stamped(spark, [("a", 24 * d, d) for d in range(9)]), path)
    table = readers.read_readings(spark, path).filter(F.col(writers.DATE_PARTITION).between("2024-01-02", "2024-01-03"))
    assert "PartitionFilters: [isnotnull(reading_date" in table._jdf.queryExecution().executedPlan().toString()
    assert table.count() == 2


def test_import_columns(spark):
    frame = spark.sql(f"SELECT timestamp'2024-01-01' AS {KEY}, 1D AS OTI, 2D AS Avg_PF")
    assert with_constant(lower_columns(frame)).columns == [DEVICE, READING_TIME, "oti", "avg_pf"]


def test_json_and_bad_times(spark, tmp_path):
    file = tmp_path / "r.json"
    file.write_text('{"OTI": 55.0, "extra": 1, "DeviceTimeStamp": "2020-01-01T13:06"}\n{"OTI": null}\n')
    rows = readers.read_json_readings(spark, str(file)).select("OTI", "KW", KEY).collect()
    assert rows[0].OTI == 55.0 and rows[0].KW is None and rows[0][KEY].hour == 13 and rows[1].OTI is None
    bad = spark.createDataFrame([("no time",), ("2020-01-01 13:15:00",)], f"{KEY} string")
    assert readers.parse_event_time(bad, on_error="null").filter(f"{KEY} is null").count() == 1
    with pytest.raises(Exception, match="CANNOT_PARSE|CAST_INVALID|cannot be parsed|malformed"):
        readers.parse_event_time(bad).collect()


def test_csv_headers_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"{KEY},OTI\n2020-01-01 00:00:00,1\n")
    (tmp_path / "b.csv").write_text(f"OTI,{KEY}\n2,2020-01-02 00:00:00\n")
    with pytest.raises(Exception, match="header|Header"):
        readers.read_feed(spark, str(tmp_path)).collect()


def test_sources_turn_nan_into_null(spark, tmp_path):
    rows = spark.sql("SELECT double('NaN') AS OTI, double('NaN') AS WTI, 30D AS OLI, 0D AS MOG_A, 0D AS OTI_A, 0D AS OTI_T")
    rows.write.parquet(str(tmp_path / "stored"))
    stored = readers.read_readings(spark, path=str(tmp_path / "stored"))
    sent = readers.parse_json_readings(spark.sql("""SELECT 1 AS n, '{"OTI": "NaN", "OLI": 30}' AS body"""), "body", "OTI double, OLI double")
    assert stored.first().OTI is None and sent.first().OTI is None and sent.first().OLI == 30
    risk = rows.select(columns.warning_condition(RiskRules()).alias("w"))  # even where nothing cleaned the rows
    assert not risk.first().w


def test_appends_leave_no_staging_behind(spark, tmp_path):
    from gridpulse.session import scratch_path

    path, folder = str(tmp_path / "table"), Path(scratch_path(spark).removeprefix("file:")).parent
    before = set(folder.iterdir())
    for d in range(4):
        writers.append_idempotent(stamped(spark, [("a", 24 * d, d), ("a", 0, 9)]), path, order=("n",))
    assert set(folder.iterdir()) == before
    day = START.date() + dt.timedelta(days=1)
    files = writers.readings_of_days(spark, path, [day, dt.date(1999, 1, 1)]).inputFiles()
    assert files and all(f"{writers.DATE_PARTITION}={day}/" in f for f in files)
    assert writers.readings_of_days(spark, path, [dt.date(1999, 1, 1)]) is None


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [1000, 100_000])
def test_history_of_a_hot_device_is_cut_before_it_meets(spark, limit):
    rows = spark.range(5000).select(F.when(F.col("id") < 4900, "hot").otherwise("cold").alias("device"), "id", F.timestamp_seconds("id").alias(KEY))
    newest = readings.history(rows, limit, by=["device"])
    # Rows are ranked once before the exchange by device alone, whatever the limit.
    assert ("WindowGroupLimit" in _plan(newest)) == (limit <= 1000) and ("_salt" in _plan(newest)) == (limit > 1000)
    want = sorted(("hot", i) for i in range(max(0, 4900 - limit), 4900)) + sorted(("cold", i) for i in range(4900, 5000))
    assert sorted((r.device, r.id) for r in newest.collect()) == sorted(want)


def test_history_above_the_bound_takes_the_newest(spark, monkeypatch):
    rows = spark.range(6000).select((F.col("id") % 2).alias("device"), "id", F.timestamp_seconds("id").alias(KEY))
    got = readings.history(rows, 1500, by=["device"])
    assert sorted(r.id for r in got.collect()) == list(range(3000, 6000))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("skip", [1001, 2995, 4990, 6000])
def test_deep_pages(spark, descending, skip):
    rows = spark.range(5000).select(F.when(F.col("id") >= 3, F.col("id") * 7 % 5003).alias("k")).repartition(7)
    keys = sorted((r.k for r in rows.collect()), key=lambda k: (k is not None, k or 0), reverse=descending)
    got = [r.k for r in readings.page(rows, "k", skip, 20, descending=descending).collect()]
    assert got == keys[skip : skip + 20]
