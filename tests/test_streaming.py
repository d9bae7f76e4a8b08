import datetime as dt

import pytest
from pyspark.ml.feature import SQLTransformer

from gridpulse.operators.scoring import score_batch
from gridpulse.schema import DEVICE, KEY, READING_TIME
from gridpulse.sources import readers
from gridpulse.streaming import streams

START = dt.datetime(2024, 1, 1)
SCHEMA = f"{DEVICE} string, {KEY} timestamp, OTI double, WTI double"
RISK_RULE = "SELECT *, CASE WHEN OTI > 75 THEN 1D ELSE 0D END AS risk_prediction FROM __THIS__"
HEAT_RULE = "SELECT *, WTI / 2 AS temperature_prediction FROM __THIS__"


@pytest.fixture(scope="module")
def rules(spark):
    return [SQLTransformer(statement=s) for s in (RISK_RULE, HEAT_RULE)]


class Feed:
    """A folder of files that arrive one by one."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, str(path)

    def arrive(self, rows):
        data = [(d, START + dt.timedelta(hours=h), o, w) for d, h, o, w in rows]
        self.spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.path)


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path / "in")


def drain(writer, tmp_path, name="check"):
    query = writer.option("checkpointLocation", str(tmp_path / name)).start()
    query.awaitTermination()
    query.stop()


def test_monitor_keeps_the_newest_reading(feed, rules, tmp_path):
    shown = {}

    def panel():
        writer = streams.monitor_stream(
            feed.stream(), *rules, by=[DEVICE], refresh=None
        )

        def show(batch, _id):
            for r in batch.collect():
                shown[r[DEVICE]] = (r[KEY].hour, r.predicted_risk_level, r.predicted_oil_temperature_celsius, r.safety_status)

        drain(writer.foreachBatch(show), tmp_path)

    feed.arrive([("a", 5, 80.0, 50.0), ("b", 1, 10.0, 20.0)])
    panel()
    assert shown == {"a": (5, 1, 25.0, "WARNING"), "b": (1, 0, 10.0, "OPTIMAL")}
    feed.arrive([("a", 3, 10.0, 99.0)])  # late: must not replace hour 5
    panel()
    assert shown["a"] == (5, 1, 25.0, "WARNING")
    feed.arrive([("a", 7, 20.0, 30.0)])
    panel()
    assert shown["a"] == (7, 0, 15.0, "OPTIMAL") and shown["b"][0] == 1


@pytest.mark.parametrize("watermark", [None, "2 days"])
def test_ingest_adds_nothing_twice(spark, feed, tmp_path, watermark):
    out, tallies = str(tmp_path / "out"), []

    def ingest(name):
        stream = feed.stream().withColumnRenamed(KEY, READING_TIME)
        writer = streams.ingest_stream(
            stream, out, order=("OTI",), watermark=watermark, on_tally=lambda i, t: tallies.append((t.inserted, t.skipped))
        )
        drain(writer.trigger(availableNow=True), tmp_path, name)

    feed.arrive([("a", 1, 1.0, 0.0), ("a", 2, 2.0, 0.0), ("a", 2, 3.0, 0.0)])
    ingest("one")
    feed.arrive([("a", 2, 9.0, 0.0), ("b", 2, 4.0, 0.0)])
    ingest("one")
    ingest("two")  # a new checkpoint replays everything
    table = readers.read_readings(spark, out)
    assert table.groupBy(DEVICE, READING_TIME).count().filter("count > 1").isEmpty()
    assert table.count() == 3 and sum(i for i, _ in tallies) == 3


def test_scored_stream_equals_scored_batch(spark, feed, rules, tmp_path):
    feed.arrive([("a", h, 70.0 + h, float(h)) for h in range(10)])
    feed.arrive([("b", h, None, 1.0) for h in range(3)])
    out = str(tmp_path / "out")
    scored = streams.score_stream(feed.stream(), *rules, nulls="zero")
    drain(scored.writeStream.format("parquet").option("path", out).trigger(availableNow=True), tmp_path)
    batch = score_batch(spark.read.schema(SCHEMA).parquet(feed.path), *rules, nulls="zero")
    assert sorted(spark.read.parquet(out).collect(), key=repr) == sorted(batch.collect(), key=repr)
    with pytest.raises(ValueError, match="null policy"):
        streams.score_stream(feed.stream(), *rules, nulls="keep")


def test_filled_stream_equals_filled_batch(spark, feed, rules, tmp_path):
    """Values known from earlier micro-batches fill later gaps; the batch takes them from the history."""
    first = [("a", 1, 80.0, None), ("a", 2, None, 40.0), ("b", 1, None, 20.0)]
    second = [("a", 3, None, None), ("b", 2, None, None), ("b", 3, 99.0, None), ("c", 1, None, 5.0)]
    out = str(tmp_path / "out")

    def drained(name):
        scored = streams.score_stream(feed.stream(), *rules, nulls="fill")
        drain(scored.writeStream.format("parquet").option("path", out).trigger(availableNow=True), tmp_path, name)

    feed.arrive(first)
    drained("one")
    history = spark.createDataFrame(spark.read.schema(SCHEMA).parquet(feed.path).collect(), SCHEMA)
    feed.arrive(second)
    drained("one")
    everything = spark.read.schema(SCHEMA).parquet(feed.path)
    late = everything.exceptAll(history)
    want = score_batch(late, *rules, nulls="fill", history=history).collect()
    assert len(want) == 4
    got = spark.read.parquet(out).collect()
    assert len(got) == 7 and {tuple(r) for r in want} <= {tuple(r) for r in got}
    with pytest.raises(ValueError, match="stored readings"):
        score_batch(late, *rules, nulls="fill")
