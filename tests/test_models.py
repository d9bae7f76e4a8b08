import dataclasses
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from gridpulse.operators import iforest, predictor, scoring, split, training
from gridpulse.operators.metrics import anomaly_rate
from gridpulse.schema import CLASS_NAMES, RISK
from gridpulse.session import materialize
from gridpulse.sources import writers

TINY = training.Profile(trees=4, depth=4, rounds=3, boost_leaves=8, boost_leaf=1, bins=16, iterations=30, forest_trees=10)
FEATURES = ["OTI", "WTI", "OLI"]


@pytest.fixture(scope="module")
def frame(spark):
    """Readings with the classes 0, 1 and 2, and a temperature that depends on the load."""
    df = spark.range(1500).select(
        F.col("id"),
        (F.rand(1) * 120).alias("OTI"), (F.rand(2) * 120).alias("WTI"), (F.rand(3) * 100).alias("OLI"),
    )
    level = F.when(F.col("OTI") > 100, 2).when(F.col("WTI") > 90, 1).otherwise(0)
    out = df.withColumns({RISK: level, "heat": F.col("OTI") * 0.5 + F.col("WTI") * 0.2 + 3})
    return out.cache()


def test_split_is_exact_complete_and_repeatable(frame):
    flagged = split.with_test_flag(frame, key=["id"], label=RISK)
    sides = flagged.groupBy(RISK).agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    assert sum(r.t for r in sides) == 300
    assert all(math.floor(0.2 * r.n) <= r.t <= math.ceil(0.2 * r.n) for r in sides)
    train, test = split.random_split(frame, key=["id"])
    assert test.count() == 300 and train.count() == 1200
    assert train.join(test, "id").isEmpty()
    moved = split.random_split(frame.repartition(13), key=["id"])[1]
    assert {r.id for r in moved.collect()} == {r.id for r in test.collect()}
    assert {r.id for r in split.random_split(frame, key=["id"], seed=7)[1].collect()} != {r.id for r in test.collect()}


def test_classes_share_the_test_rows_by_largest_remainders(spark):
    sizes = {0: 28_891, 1: 2251, 2: 129}
    rows = spark.range(sum(sizes.values())).selectExpr("id", "CASE WHEN id < 28891 THEN 0 WHEN id < 31142 THEN 1 ELSE 2 END AS kind")
    flagged = split.with_test_flag(rows, key=["id"], label="kind").filter("is_test")
    assert {r.kind: r["count"] for r in flagged.groupBy("kind").count().collect()} == {0: 5779, 1: 450, 2: 26}


def test_split_with_many_classes(spark):
    many = spark.range(12_000).selectExpr("id", "CAST(id % 3000 AS INT) AS kind")
    flagged = split.with_test_flag(many, key=["id"], label="kind", test_share=0.25)
    counts = flagged.groupBy("kind").agg(F.count_if("is_test").alias("t")).groupBy("t").count().collect()
    assert [tuple(r) for r in counts] == [(1, 3000)]


@pytest.fixture(scope="module")
def fitted(frame):
    sides = split.stratified_split(frame, RISK, key=["id"])
    risk = training.compare_classifiers(*sides, FEATURES, profile=TINY)
    heat = training.compare_regressors(*split.random_split(frame, key=["id"]), FEATURES, label="heat", profile=TINY)
    return risk, heat


def test_candidates(fitted):
    risk, heat = fitted
    assert list(risk.results) == ["LogisticRegression", "RandomForest", "HistGradientBoosting"]
    assert list(heat.results) == ["Ridge", "RandomForest", "HistGradientBoosting"]
    assert all(0.5 < r["test_accuracy"] <= 1 for r in risk.results.values())
    assert heat.best == "Ridge" and heat.results["Ridge"]["test_r2"] > 0.99
    best = max(risk.results, key=lambda n: risk.results[n]["test_f1_macro"])
    assert risk.results[risk.best]["test_f1_macro"] == risk.results[best]["test_f1_macro"]
    assert [r.model for r in risk.metrics.filter("is_best").collect()] == [risk.best]


def test_the_query_fits_candidates_of_the_published_size(spark, monkeypatch):
    from gridpulse.plans import catalog

    class Asked(Exception):
        pass

    def compare(train, test, features, profile=training.FULL, candidates=training.CLASSIFIERS):
        raise Asked(profile, candidates)

    monkeypatch.setattr(training, "compare_classifiers", compare)
    with pytest.raises(Asked) as asked:
        catalog.QUERIES["m9_fit_candidates"](spark, "/root/testdata/sf0.001")
    assert asked.value.args == (training.Profile(), training.CLASSIFIERS)


def test_forests_hold_few_histograms_at_once(fitted):
    """Every task of an executor holds the histograms of a group of nodes."""
    for result in fitted:
        assert result.models["RandomForest"].stages[-1].getMaxMemoryInMB() <= 256


@pytest.mark.parametrize("name", ["LogisticRegression", "RandomForest", "HistGradientBoosting"])
def test_models_reload_with_the_same_answers(frame, fitted, tmp_path, name):
    model = fitted[0].models[name]
    writers.save_model(model, str(tmp_path / "m"))
    loaded = writers.load_model(str(tmp_path / "m"))
    assert isinstance(loaded, PipelineModel)
    columns = ["id", training.RISK_PREDICTION, training.RISK_PROBABILITY]
    a, b = (m.transform(frame).select(columns).orderBy("id").collect() for m in (model, loaded))
    assert a == b
    probabilities = np.array([r[training.RISK_PROBABILITY].toArray() for r in a])
    assert np.allclose(probabilities.sum(axis=1), 1) and probabilities.shape[1] == 3
    assert [int(p.argmax()) for p in probabilities] == [int(r[training.RISK_PREDICTION]) for r in a]


def test_ridge_equals_the_closed_form(frame):
    train = frame.withColumn("heat", F.col("heat") + F.rand(9) * 20).cache()
    result = training.compare_regressors(
        train, train, FEATURES, label="heat", profile=TINY, candidates={"Ridge": training.fit_ridge}
    )
    pdf = train.toPandas()
    x, y = pdf[FEATURES].to_numpy(), pdf["heat"].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean()))
    want = z @ w + y.mean()
    got = result.model.transform(frame.sparkSession.createDataFrame(pdf)).toPandas()
    assert np.allclose(got[training.TEMPERATURE_PREDICTION].to_numpy(), want, atol=1e-8)


def test_scoring(spark, frame, fitted):
    risk, heat = fitted
    some = frame.select("id", "OTI", "WTI", "OLI").withColumn("extra", F.lit("kept")).orderBy("id").limit(50)
    batch = scoring.score_batch(some, risk.model, heat.model)
    assert batch.columns == [*some.columns, "Predicted_Fault_Risk", "Risk_Status", "Predicted_OTI_Temp_C"]
    detail = scoring.score_detail(some, risk.model, heat.model, keep=["id"])
    rows, details = batch.orderBy("id").collect(), detail.orderBy("id").collect()
    for a, b in zip(rows, details, strict=True):
        assert (a.Predicted_Fault_Risk, a.Risk_Status) == (b.predicted_risk_level, b.risk_label)
        assert a.Risk_Status == CLASS_NAMES[a.Predicted_Fault_Risk] and a.extra == "kept"
        assert a.Predicted_OTI_Temp_C == b.predicted_oil_temperature_celsius
        assert sum(b.probabilities) == pytest.approx(1, abs=2e-4)
    plan = batch._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1  # the one of the limit above


def test_single_reading_needs_few_fields(spark, fitted):
    risk, heat = fitted
    sample = spark.createDataFrame([(55.0, 60.0)], "OTI double, WTI double")
    row = scoring.score_detail(sample, risk.model, heat.model).first()
    assert row.safety_status in ("OPTIMAL", "WARNING", "CRITICAL")
    assert row.predicted_oil_temperature_celsius == pytest.approx(0.5 * 55 + 0.2 * 60 + 3, abs=0.5)
    empty = spark.createDataFrame([(None, 60.0)], "OTI double, WTI double")
    assert scoring.score_detail(empty, risk.model, heat.model, nulls="zero").first().predicted_risk_level is not None
    with pytest.raises(Exception, match="null|missing"):
        scoring.score_detail(empty, risk.model, heat.model, nulls="error").collect()


def test_isolation_forest_finds_the_far_rows(spark):
    near = spark.range(3000).select("id", F.randn(1).alias("x"), F.randn(2).alias("y"))
    far = spark.range(3000, 3030).select("id", (F.randn(3) + 30).alias("x"), (F.randn(4) - 30).alias("y"))
    rows = near.unionAll(far).cache()
    forest = iforest.fit(rows, ["x", "y"], n_trees=40)
    assert forest.count() == 40 and forest.filter("sample = 256").count() == 40
    flagged = iforest.flag(rows, forest, ["x", "y"])
    rate = anomaly_rate(flagged, F.col("anomaly_flag") == -1).first()
    assert rate.n_anomalies == pytest.approx(0.05 * 3030, abs=1)
    assert flagged.filter("id >= 3000 and anomaly_flag = 1").isEmpty()
    scores = flagged.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert 0 < scores[0] < scores[1] <= 1


def test_isolation_forest_with_copies_and_few_rows(spark):
    copies = spark.range(20000).select(F.when(F.col("id") < 19900, 0.0).otherwise(F.rand(1)).alias("x"))
    forest = iforest.fit(copies, ["x"], n_trees=20)
    assert forest.agg(F.min("sample")).first()[0] == 256
    few = iforest.fit(copies.limit(5), ["x"], n_trees=5)
    assert {r.sample for r in few.collect()} == {5}


def test_isolation_forest_does_not_depend_on_partitions(spark):
    rows = spark.range(4000).select("id", (F.col("id") * 7 % 101).cast("double").alias("x"))
    one, other = (iforest.fit(d, ["x"], n_trees=6, key=["id"]).orderBy("tree").collect() for d in (rows, rows.repartition(5)))
    assert one == other


def test_one_tree_isolates_every_point():
    points = np.arange(8.0).reshape(-1, 1)
    feature, threshold, depth = iforest.grow(points, np.random.default_rng(1))
    node = np.zeros(8, dtype=int)
    for _ in range(3):
        node = 2 * node + 1 + (points[:, 0] >= threshold[node])
    leaves = node - len(feature)
    reached = depth[leaves]
    assert len(feature) == 7 and len(depth) == 8 and (reached > 0).all()
    assert iforest.average_depth(256) == pytest.approx(10.2448, abs=1e-3)


def test_the_whole_training_run(spark, tmp_path):
    from gridpulse.plans import catalog

    frame = catalog.fleet_frame(spark, "/root/testdata/sf0.001")
    result = training.train_all(
        frame, TINY, key=["transformer_id", "DeviceTimeStamp"], also_exclude=("transformer_id",)
    )
    writers.write_metadata(spark, result.metadata, str(tmp_path / "meta"))
    row = writers.read_metadata(spark, str(tmp_path / "meta")).first()
    assert row.records == frame.count() and row.classes["2"] == "Critical Alarm / Trip"
    assert row.best_regression_model == result.regressors.best
    assert set(row.classification_results) == {"LogisticRegression", "RandomForest", "HistGradientBoosting"}
    assert {r.anomaly_flag for r in result.anomalies.select("anomaly_flag").distinct().collect()} == {-1, 1}
    result.save(str(tmp_path / "run"))
    loaded = predictor.load_predictor(spark, str(tmp_path / "run"))
    assert loaded.names == CLASS_NAMES and set(result.classifiers.features) <= set(loaded.needed)
    direct = scoring.score_batch(frame, result.classifiers.model, result.regressors.model, nulls="zero")
    key = ["transformer_id", "DeviceTimeStamp"]
    columns = [*key, "Predicted_Fault_Risk", "Predicted_OTI_Temp_C"]
    assert direct.select(columns).exceptAll(loaded.score(frame, nulls="zero").select(columns)).isEmpty()
    flags = [*key, "anomaly_flag"]
    assert result.anomalies.select(flags).exceptAll(loaded.anomalies(frame).select(flags)).isEmpty()


def test_saved_anomaly_model_flags_a_stream(spark, tmp_path):
    rows = spark.range(3000).select("id", F.randn(1).alias("x"), F.when(F.col("id") < 20, 50.0).otherwise(F.randn(2)).alias("y"))
    rows.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    model = iforest.fit_model(stored, ["x", "y"], n_trees=20, key=["id"])
    PipelineModel([model]).write().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    stream = spark.readStream.schema(stored.schema).parquet(str(tmp_path / "rows"))
    out = loaded.transform(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    out.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(model.transform(stored)).isEmpty()
    assert model.transform(stored).filter("id < 20 AND anomaly_flag = 1").isEmpty()
    # One row alone is judged by the cut of the training rows, not by itself.
    assert model.transform(stored.filter("id = 100")).first().anomaly_flag == 1
    nothing = iforest.fit_model(stored.limit(0), ["x", "y"], n_trees=2)
    assert nothing.transform(stored.limit(3)).filter("anomaly_flag = -1").isEmpty()


@pytest.mark.parametrize("listed", [10_000, 5])
def test_a_split_leaves_no_class_to_one_task(spark, monkeypatch, listed):
    """Nine tenths of the rows are of one class, in a session that broadcasts nothing by itself."""
    monkeypatch.setattr(split, "LISTED_CLASSES", listed, raising=False)
    kind = "CAST(CASE WHEN id % 10 > 0 THEN NULL ELSE id % 7 END AS INT) AS kind"
    rows = materialize(spark.range(0, 20_000, 1, 8).selectExpr("id", kind))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        flagged = split.with_test_flag(rows, key=["id"], label="kind")
        placed = flagged.select("kind", "id", "is_test", F.spark_partition_id().alias("at")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r.id for r in placed) == list(range(20_000)) and sum(r.is_test for r in placed) == 4000
    for kind in (None, *range(7)):
        own = [r.is_test for r in placed if r.kind == kind]
        assert math.floor(0.2 * len(own)) <= sum(own) <= math.ceil(0.2 * len(own))
    assert max(Counter(r.at for r in placed).values()) < 10_000
