import random

import pytest
from pyspark.sql import functions as F

from gridpulse.operators import metrics

# The published hold-out report: support per class and the rows that were missed.
PAIRS = [(0, 0)] * 5778 + [(1, 1)] * 450 + [(2, 2)] * 26 + [(2, 0)]


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "a int, p int")


def test_published_report(spark):
    report = {r.label: r for r in metrics.classification_report(frame(spark, PAIRS), "a", "p").collect()}
    assert [report[k].support for k in ("Normal", "Warning", "Critical", "accuracy")] == [5778, 450, 27, 6255]
    shown = {k: [f"{v:.2f}" for v in (r.precision, r.recall, r.f1)] for k, r in report.items()}
    assert shown["Critical"] == ["1.00", "0.96", "0.98"]
    assert shown["macro avg"] == ["1.00", "0.99", "0.99"]
    assert shown["weighted avg"] == ["1.00", "1.00", "1.00"]


def by_hand(pairs, classes):
    f1 = []
    for c in classes:
        hit = sum(a == p == c for a, p in pairs)
        chosen, real = sum(p == c for _, p in pairs), sum(a == c for a, _ in pairs)
        f1.append(2 * hit / (chosen + real) if chosen + real else 0.0)
    return sum(a == p for a, p in pairs) / len(pairs), sum(f1) / len(f1)


@pytest.mark.parametrize("classes", [(0, 1, 2), (0, 1), (2,)])
def test_scores_against_plain_counting(spark, classes):
    rng = random.Random(1)
    pairs = [(rng.choice(classes), rng.choice([0, *classes])) for _ in range(200)]
    occurring = {c for pair in pairs for c in pair}
    row = metrics.classifier_scores(frame(spark, pairs), "a", "p").first()
    assert (row.accuracy, row.f1_macro) == pytest.approx(by_hand(pairs, occurring))
    assert metrics.accuracy(frame(spark, pairs), "a", "p").first()[0] == pytest.approx(row.accuracy)
    assert metrics.f1_macro(frame(spark, pairs), "a", "p").first()[0] == pytest.approx(row.f1_macro)


def test_class_that_is_never_predicted(spark):
    report = {r.label: r for r in metrics.classification_report(frame(spark, [(0, 0), (1, 0)]), "a", "p").collect()}
    assert (report["Warning"].precision, report["Warning"].recall, report["Critical"].support) == (0.0, 0.0, 0)
    matrix = metrics.confusion_matrix(frame(spark, [(0, 0), (1, 0)]), "a", "p").orderBy("actual").collect()
    assert [tuple(r) for r in matrix] == [(0, 1, 0, 0), (1, 1, 0, 0), (2, 0, 0, 0)]


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 1.0)], "y double, p double")
    row = metrics.regression_metrics(df, "y", "p").first()
    assert (row.rmse, row.mae, row.r2) == pytest.approx(((5 / 3) ** 0.5, 1.0, 1 - 5 / 2))
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert metrics.regression_metrics(flat, "y", "p").first().r2 == 1.0
    assert metrics.value_range(df, "y", "p").first() == (1.0, 3.0)


def test_first_of_equal_candidates_wins(spark):
    table = spark.createDataFrame([(0, "x", 0.5), (1, "y", 0.9), (2, "z", 0.9)], "position int, model string, f1 double")
    assert metrics.select_best(table, "f1").first().model == "y"
    compared = metrics.model_comparison(table, "f1").orderBy("position").collect()
    assert [r.is_best for r in compared] == [False, True, False]


def test_counts(spark):
    df = frame(spark, [(0, 0), (0, 1), (1, 1), (None, 2)])
    assert [tuple(r) for r in metrics.value_counts(df, "a").collect()] == [(0, 2), (1, 1)]
    assert metrics.string_keyed_counts(df, "a").first().distribution == {"0": 2, "1": 1}
    rows = metrics.count_rows({"x": df, "none": df.limit(0)}).collect()
    assert {tuple(r) for r in rows} == {("x", 4), ("none", 0)}
    assert tuple(metrics.shape(df).first()) == (4, 2)
    rate = metrics.anomaly_rate(df, F.col("a") == 1).first()
    assert (rate.n_anomalies, rate.n_rows, rate.anomaly_pct) == (1, 4, 25.0)
    summary = metrics.batch_summary(df, "p").first()
    assert tuple(summary) == (4, 1, 2, 1)


def test_metrics_read_the_data_once(spark):
    df = frame(spark, PAIRS)
    df.write.format("noop").mode("overwrite").save()
    for out in (metrics.classification_report(df, "a", "p"), metrics.classifier_scores(df, "a", "p")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan ExistingRDD") <= 2  # the pairs, and the class names


def test_scaler_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    assert tuple(metrics.scaler_stats(df, ["x"]).first()) == ("x", 2.0, 1.0)
