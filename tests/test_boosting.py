"""Histogram boosting against a plain version, and what a saved model says of a stream."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from gridpulse.operators import boosting

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """Three classes and a number; one feature has missing values, which tell something."""
    df = spark.range(1200).select("id", (F.rand(1) * 9).alias("a"), F.floor(F.rand(2) * 5).cast("double").alias("b"), F.rand(3).alias("c"))
    df = df.withColumn("c", F.when(F.col("id") % 7 == 0, float("nan")).otherwise(F.col("c")))
    level = F.when(F.isnan("c"), 2.0).when(F.col("a") > 6, 1.0).otherwise(0.0)
    df = df.withColumns({"level": level, "heat": F.col("a") * 2 + F.when(F.isnan("c"), 5.0).otherwise(F.col("b"))})
    return VectorAssembler(inputCols=COLUMNS, outputCol="v", handleInvalid="keep").transform(df).cache()


def plain_stump(x, g, h, least):
    """The best of all splits of one node, by trying them: (gain, feature, left rows)."""
    best = (0.0, None, None)
    score = lambda m: g[m].sum() ** 2 / h[m].sum() if m.any() else 0.0
    for f in range(x.shape[1]):
        missing = np.isnan(x[:, f])
        for cut in np.unique(x[~missing, f]):
            for left in (x[:, f] <= cut, (x[:, f] <= cut) | missing):
                if min(left.sum(), (~left).sum()) >= least:
                    gain = score(left) + score(~left) - score(left | True)
                    if gain > best[0] + 1e-9:
                        best = (gain, f, left)
    return best


@pytest.mark.parametrize("classes, label", [(0, "heat"), (3, "level")])
def test_first_split_is_the_best_of_all(spark, rows, classes, label):
    few = rows.filter("id < 200")  # fewer values than bins, so every split can be found
    model = boosting.fit_boosting(few, "v", label, "p", "q", classes, rounds=1, leaves=2, least_rows=10)
    data = few.toPandas()
    x, y = np.array(data["v"].map(lambda v: v.toArray()).tolist()), data[label].to_numpy()
    raw = np.tile(model.getOrDefault("baseline"), (len(y), 1))
    g, h, loss = boosting.gradients(raw, y, classes)
    assert model.getOrDefault("trainLoss")[0] == pytest.approx(loss.mean())
    for k, tree in enumerate(model.rounds[0]):
        gain, feature, left = plain_stump(x, g[:, k], h[:, k], 10)
        assert tree["feature"][0] == feature
        leaf = boosting.descend(tree, x, "cut")
        assert np.array_equal(leaf == tree["left"][0], left)
        assert tree["value"][1] == pytest.approx(-0.1 * g[left, k].sum() / h[left, k].sum())


@pytest.mark.parametrize("classes, label", [(0, "heat"), (3, "level")])
def test_loss_falls_and_saved_models_agree(spark, rows, tmp_path, classes, label):
    model = boosting.fit_boosting(rows, "v", label, "p", "q", classes, rounds=12, leaves=6, bins=16)
    losses = model.getOrDefault("trainLoss")
    assert model.rounds_used == 12 and len(losses) == 13 and all(b < a for a, b in zip(losses, losses[1:]))
    assert max(len(t["feature"]) for r in model.rounds for t in r) == 11  # six leaves
    scored = model.transform(rows).toPandas()
    if classes:
        assert (scored["p"] == scored[label]).mean() > 0.95
        assert all(q.toArray().sum() == pytest.approx(1) and q.toArray().argmax() == p for q, p in zip(scored["q"], scored["p"]))
        p = np.array([q.toArray()[int(y)] for q, y in zip(scored["q"], scored[label])])
        assert -np.log(p).mean() == pytest.approx(losses[-1])  # bins and cuts lead to the same leaves
    else:
        assert 0.5 * ((scored["p"] - scored[label]) ** 2).mean() == pytest.approx(losses[-1])
    PipelineModel([model]).write().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    rows.select("id", "v").write.parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema(rows.select("id", "v").schema)
    out = loaded.transform(stream.parquet(str(tmp_path / "rows"))).select("id", "p").writeStream.format("parquet").option("path", str(tmp_path / "out"))
    out.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(model.transform(rows).select("id", "p")).isEmpty()


def test_patience(spark, rows):
    noise = rows.withColumn("heat", F.rand(5))
    model = boosting.fit_boosting(noise, "v", "heat", "p", rounds=60, leaves=8, early_stop_rows=1000, patience=4)
    held = model.getOrDefault("heldOutLoss")
    assert 4 < model.rounds_used < 60 and len(held) == model.rounds_used + 1
    assert min(held[-5:-1]) > held[-6] - 1e-7
    whole = boosting.fit_boosting(noise, "v", "heat", "p", rounds=5, leaves=4, patience=2)
    assert whole.rounds_used == 5 and whole.getOrDefault("heldOutLoss") == []


def test_no_rows_and_one_value(spark, rows):
    empty = boosting.fit_boosting(rows.limit(0), "v", "level", "p", "q", 3, rounds=3)
    assert empty.rounds_used == 0 and empty.transform(rows.limit(2)).count() == 2
    same = boosting.fit_boosting(rows.withColumn("heat", F.lit(4.0)), "v", "heat", "p", rounds=3)
    assert same.rounds_used == 0 and {r.p for r in same.transform(rows).select("p").collect()} == {4.0}


@pytest.mark.parametrize("classes, label", [(0, "heat"), (3, "level")])
def test_a_task_by_itself_grows_what_jobs_grow(spark, rows, monkeypatch, classes, label):
    noisy = rows.withColumns({"heat": F.col("heat") + F.rand(7), "level": F.when(F.rand(8) < 0.3, 0.0).otherwise(F.col("level"))})
    fit = lambda: boosting.fit_boosting(noisy, "v", label, "p", "q", classes, rounds=3, leaves=7, early_stop_rows=1000)
    own = fit()
    monkeypatch.setattr(boosting, "TASK_CELLS", 0, raising=False)
    jobs = fit()
    for a, b in zip(own.rounds, jobs.rounds, strict=True):
        for s, t in zip(a, b, strict=True):
            assert all(np.array_equal(s[c], t[c]) for c in ("feature", "bin", "cut", "missing_left", "left", "right"))
            assert np.allclose(s["value"], t["value"])
    for losses in ("trainLoss", "heldOutLoss"):
        assert own.getOrDefault(losses) == pytest.approx(jobs.getOrDefault(losses))
