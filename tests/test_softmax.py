from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from gridpulse.operators import softmax, split, training
from gridpulse.schema import RISK


def vectors(df, columns):
    return VectorAssembler(inputCols=columns, outputCol="v").transform(df).select("v", F.col("kind").cast("double").alias("kind"))


def fit(df, penalty, **options):
    return softmax.fit_softmax(df, "v", "kind", "p", "c", penalty, **options)


def test_logistic_takes_few_passes_to_its_minimum(spark):
    """Features that almost follow from each other, and classes that a rule parts: a dozen first-order steps do not do."""
    base = spark.range(4000).select("id", *[(F.rand(k) * 100).alias(f"x{k}") for k in range(4)])
    base = base.withColumns({f"y{k}": F.col(f"x{k}") + F.col(f"x{(k + 1) % 4}") + F.rand(10 + k) * 0.5 for k in range(4)})
    rows = base.withColumn(RISK, F.when(F.col("x0") > 80, 2).when((F.col("x1") > 90) | (F.col("x2") < 10), 1).otherwise(0)).cache()
    names = [c for c in rows.columns if c not in ("id", RISK)]
    train, test = split.stratified_split(rows, RISK, key=["id"])
    profile = replace(training.FULL, iterations=12)
    result = training.compare_classifiers(train, test, names, profile=profile, candidates={"LogisticRegression": training.fit_logistic})
    model = result.model.stages[-1].stages[-1]
    scored = result.model.transform(train).select("_risk_scaled", RISK, training.RISK_PROBABILITY, training.RISK_PREDICTION).collect()
    z, chance = (np.array([r[c].toArray() for r in scored]) for c in ("_risk_scaled", training.RISK_PROBABILITY))
    error = chance - np.eye(3)[[r[RISK] for r in scored]]
    slope = (error.T @ z + model.coefficientMatrix.toArray()) / len(z)
    assert np.abs(slope).max() < 1e-4 and np.abs(error.mean(0)).max() < 1e-4
    assert [int(c.argmax()) for c in chance] == [int(r[training.RISK_PREDICTION]) for r in scored]
    rows.unpersist()


def test_weights_equal_those_of_first_order_steps(spark):
    df = vectors(spark.range(900).select(
        F.randn(1).alias("a"), F.randn(2).alias("b"), F.lit(0.0).alias("c"),
    ).withColumn("kind", F.when(F.col("a") + F.randn(3) > 1, 2).when(F.col("b") + F.randn(4) > 0, 1).otherwise(0)), ["a", "b", "c"]).cache()
    own = fit(df, 0.01)
    other = LogisticRegression(featuresCol="v", labelCol="kind", family="multinomial", regParam=0.01, standardization=False, maxIter=2000, tol=1e-12).fit(df)
    assert np.allclose(own.coefficientMatrix.toArray(), other.coefficientMatrix.toArray(), atol=1e-4)
    assert np.allclose(own.interceptVector, other.interceptVector, atol=1e-4)
    losses = own.getOrDefault("losses")
    assert all(b < a for a, b in zip(losses, losses[1:]))
    assert len(fit(df, 0.01, iterations=1).getOrDefault("losses")) == 2
    df.unpersist()


@pytest.mark.parametrize("kinds, classes", [((0,), 1), ((1,), 2), ((0, 2), 3), ((0, 1), 2)])
def test_classes_that_do_not_occur(spark, kinds, classes):
    df = vectors(spark.range(40).select((F.col("id") % 2).alias("a"), F.lit(1.0).alias("b"), F.element_at(F.array(*map(F.lit, kinds)), (F.col("id") % len(kinds) + 1).cast("int")).alias("kind")), ["a", "b"])
    model = fit(df, 1 / 40)
    rows = model.transform(df).collect()
    assert model.numClasses == classes and all(r.p == r.kind and len(r.c) == classes for r in rows)
    assert model.transform(df.limit(0)).collect() == []


def test_odd_labels_are_refused(spark):
    for kind in (None, -1.0, 0.5, float("nan")):
        with pytest.raises(ValueError, match="labels"):
            fit(vectors(spark.range(3).select(F.col("id").alias("a"), F.lit(kind).cast("double").alias("kind")), ["a"]), 0.1)
    with pytest.raises(ValueError, match="rows"):
        fit(vectors(spark.range(0).select(F.col("id").alias("a"), F.lit(0.0).alias("kind")), ["a"]), 0.1)
