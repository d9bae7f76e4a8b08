"""The random forest against plain counting, and how its work is dealt out."""

import dataclasses

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from gridpulse.operators import forest, training

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(3000).select("id", (F.rand(1) * 9).alias("a"), F.floor(F.rand(2) * 5).cast("double").alias("b"), F.rand(3).alias("c"), F.lit(1.0).alias("d"))
    df = df.withColumn("level", F.when(F.col("b") == 3, 2.0).when(F.col("a") > 6, 1.0).otherwise(0.0))
    df = df.withColumn("noisy", F.when(F.rand(4) < 0.2, F.floor(F.rand(5) * 3).cast("double")).otherwise(F.col("level")))
    return VectorAssembler(inputCols=COLUMNS, outputCol="v").transform(df).cache()


def same(one, other):
    return len(one.forest) == len(other.forest) and all(np.array_equal(a[c], b[c]) for a, b in zip(one.forest, other.forest) for c in a)


def test_splits_are_the_best_of_all():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 4, (5, 3, 6, 2)).astype(float)
    counts[:, 1:] = 0
    for f in (1, 2):  # the same rows in each drawn feature
        for node in range(5):
            for k in range(2):
                counts[node, f, :, k] = np.bincount(rng.integers(0, 6, int(counts[node, 0, :, k].sum())), minlength=6)
    gini = lambda c: 1 - ((c / c.sum()) ** 2).sum() if c.sum() else 0.0
    for node, row in enumerate(forest.best_splits(counts)):
        total = counts[node, 0].sum(0)
        gains = {}
        for f in range(3):
            for b in range(5):
                left = counts[node, f, : b + 1].sum(0)
                if 0 < left.sum() < total.sum():
                    gains[f, b] = gini(total) - (left.sum() * gini(left) + (total - left).sum() * gini(total - left)) / total.sum()
        assert row[0] == pytest.approx(max(gains.values())) and gains[int(row[1]), int(row[2])] == pytest.approx(row[0])
        assert np.array_equal(row[3:5], counts[node, int(row[1]), : int(row[2]) + 1].sum(0)) and np.array_equal(row[5:], total)


def test_bootstrap_weights():
    w = forest.weights(42, 3, 0, 200_000)
    assert np.array_equal(w, forest.weights(42, 3, 0, 200_000)) and not np.array_equal(w, forest.weights(42, 4, 0, 200_000))
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02) and (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)


def test_cuts(rows):
    values = rows.select(F.array("a", "b", "c", "d").alias("x"))
    cuts = forest.feature_cuts(values, 4, 64)
    assert list(cuts[1]) == [0.5, 1.5, 2.5, 3.5] and len(cuts[3]) == 0 and len(cuts[0]) == 63


def test_all_trees_and_their_answers(rows):
    model = forest.fit_forest(rows, "v", "noisy", "p", "q", trees=30, depth=6)
    assert len(model.trees) == 30 and max(t.depth for t in model.trees) == 6
    scored = model.transform(rows).toPandas()
    q = np.array([v.toArray() for v in scored["q"]])
    assert (scored["p"] == scored["level"]).mean() > 0.95 and np.allclose(q.sum(1), 1) and np.array_equal(q.argmax(1), scored["p"])
    x = np.array([v.toArray() for v in scored["v"]])
    plain = np.zeros_like(q)
    for tree in model.forest:
        for i, row in enumerate(x):
            node = 0
            while tree["feature"][node] >= 0:
                node = tree["left" if row[tree["feature"][node]] <= tree["cut"][node] else "right"][node]
            plain[i] += tree["shares"][node]
    assert np.allclose(plain / 30, q)


def test_layout_does_not_change_the_forest(rows, monkeypatch):
    few = {"a": F.floor(F.col("a") * 9) / 9, "c": F.floor(F.col("c") * 90) / 90}  # all values have bins of their own
    rows = VectorAssembler(inputCols=COLUMNS, outputCol="v").transform(rows.drop("v").withColumns(few)).cache()
    fit = lambda df: forest.fit_forest(df, "v", "noisy", "p", "q", trees=9, depth=5)
    whole = fit(rows)
    assert same(whole, fit(rows.repartition(5)))
    monkeypatch.setattr(forest, "PART_CELLS", 1)  # one node at a time
    assert same(whole, fit(rows))
    monkeypatch.setattr(forest, "SMALL_NODE", 1)
    assert same(whole, fit(rows))
    monkeypatch.setattr(forest, "CHUNK_CELLS", 2500)  # 500 rows at a time
    parted = fit(rows)
    assert len(parted.forest) == 9 and parted.transform(rows).filter("p = level").count() > 2800


def test_odd_tables(rows):
    one = forest.fit_forest(rows.filter("level = 0"), "v", "level", "p", "q", trees=3)
    assert [t.depth for t in one.trees] == [0, 0, 0] and one.transform(rows).filter("p = 0").count() == 3000
    with pytest.raises(ValueError, match="rows"):
        forest.fit_forest(rows.limit(0), "v", "level", "p", "q")
    with pytest.raises(ValueError, match="1 other"):
        forest.fit_forest(rows.withColumn("level", F.when(F.col("id") > 0, F.col("level"))), "v", "level", "p", "q")


def test_jobs_do_not_grow_with_the_nodes(spark, rows, monkeypatch):
    """Groups of nodes, bounded by memory, took a job each, which sent the full histograms of all nodes."""
    monkeypatch.setattr(training, "FOREST_MB", 1)
    profile = dataclasses.replace(training.FULL, trees=100, depth=8)
    task = training.Task(rows, 3000, 4, "noisy", "v", "_scaled", "p", "q", profile)
    spark.sparkContext.setJobGroup("forest", "forest")
    try:
        model = training.fit_forest_classifier(task)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(model.trees) == 100 and max(t.depth for t in model.trees) == 8
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest")) <= 40
