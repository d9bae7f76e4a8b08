"""Counts, scaler statistics and model metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.schema import REPORT_NAMES

RISK_CLASSES = (0, 1, 2)


def count_rows(frames: dict[str, DataFrame]) -> DataFrame:
    """A1: rows of every frame in one job; no column is read."""
    tagged = [f.select(F.lit(name).alias("feed")) for name, f in frames.items()]
    counted = reduce(DataFrame.unionAll, tagged).groupBy("feed").agg(F.count("*").alias("n_rows"))
    # A frame without rows is still reported.
    spark = next(iter(frames.values())).sparkSession
    names = spark.createDataFrame([(n,) for n in frames], "feed string")
    return names.join(counted, "feed", "left").select("feed", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def shape(df: DataFrame) -> DataFrame:
    """A1: rows and columns."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """A2: most frequent first; ties in value order. Missing values are not counted."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), column)


def string_keyed_counts(df: DataFrame, column: str, name: str = "distribution") -> DataFrame:
    """Value counts as one map with text keys, for a column of few classes."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    entry = F.struct(F.col(column).cast("string").alias("key"), F.col("n").alias("value"))
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias(name))


def anomaly_rate(df: DataFrame, flag: Column) -> DataFrame:
    """A4."""
    hit = F.coalesce(flag, F.lit(False))
    return df.agg(
        F.count_if(hit).alias("n_anomalies"),
        F.count("*").alias("n_rows"),
        (F.avg(hit.cast("double")) * 100).alias("anomaly_pct"),
    )


def scaler_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """A5: one row per column with mean and population deviation, all from one pass."""
    wide = df.agg(*[
        F.struct(
            F.lit(c).alias("feature"),
            F.avg(c).alias("mean"),
            F.stddev_pop(c).alias("std"),
        ).alias(c)
        for c in columns
    ])
    return wide.select(F.inline(F.array(*columns)))


def confusion_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Long form of A6: the small table from which the class metrics follow."""
    pair = df.select(F.col(actual).cast("int").alias("actual"), F.col(predicted).cast("int").alias("predicted"))
    return pair.groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str, classes=RISK_CLASSES) -> DataFrame:
    """One row per actual class, one column per predicted class, absent pairs as 0."""
    spark = df.sparkSession
    rows = spark.createDataFrame([(c,) for c in classes], "actual int")
    cells = confusion_counts(df, actual, predicted).groupBy("actual").pivot("predicted", list(classes)).sum("n")
    named = cells.select("actual", *[F.col(str(c)).alias(f"predicted_{c}") for c in classes])
    return rows.join(named, "actual", "left").fillna(0)


def _ratio(top: Column, bottom: Column) -> Column:
    """Division by zero counts as 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def _class_metrics(confusion: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per class in actual or predicted (and value of ``by``): precision, recall, F1, support, predicted
    count, hits."""
    sides = confusion.select(
        *by,
        F.inline(F.array(
            F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("chosen"),
                     F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits")),
            F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("chosen"),
                     F.lit(0).cast("long").alias("hits")),
        ))
    )
    totals = sides.groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("chosen").alias("chosen"), F.sum("hits").alias("hits")
    )
    rated = totals.withColumns({
        "precision": _ratio(F.col("hits"), F.col("chosen")),
        "recall": _ratio(F.col("hits"), F.col("support")),
    })
    # Harmonic mean of precision and recall in terms of counts.
    return rated.withColumn("f1", _ratio(F.col("hits") * 2, F.col("support") + F.col("chosen")))


def classification_report(
    df: DataFrame, actual: str, predicted: str, names: dict[int, str] = REPORT_NAMES
) -> DataFrame:
    """One row per class, then accuracy, macro and weighted averages, in the column ``label``.

    The data is read once into the confusion counts; all else works on those few rows.
    """
    metrics = _class_metrics(confusion_counts(df, actual, predicted))
    spark = df.sparkSession
    classes = spark.createDataFrame(list(names.items()), "class int, label string")
    listed = classes.join(metrics, "class", "left").select(
        "label", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")],
        F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("hits", F.lit(0)).alias("hits"),
    )
    total = F.sum("support")

    def weighted(c: str) -> Column:
        return _ratio(F.sum(F.col(c) * F.col("support")), total)

    accuracy = _ratio(F.sum("hits"), total)
    rows = listed.agg(
        F.collect_list(F.struct("label", "precision", "recall", "f1", "support")).alias("per_class"),
        F.struct(F.lit("accuracy").alias("label"), accuracy.alias("precision"), accuracy.alias("recall"),
                 accuracy.alias("f1"), total.alias("support")).alias("accuracy"),
        F.struct(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                 F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), total.alias("support")).alias("macro"),
        F.struct(F.lit("weighted avg").alias("label"), weighted("precision").alias("precision"),
                 weighted("recall").alias("recall"), weighted("f1").alias("f1"), total.alias("support")).alias("weighted"),
    )
    return rows.select(F.inline(F.concat("per_class", F.array("accuracy", "macro", "weighted"))))


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """A8."""
    return df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"))


def f1_macro(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Plain mean over the classes that occur in either column."""
    return _class_metrics(confusion_counts(df, actual, predicted)).agg(F.avg("f1").alias("f1_macro"))


def classifier_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy and macro F1 from one pass over the data."""
    metrics = _class_metrics(confusion_counts(df, actual, predicted))
    return metrics.agg(
        _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("f1_macro")
    )


def candidate_scores(df: DataFrame, actual: str, predictions: dict[str, str]) -> DataFrame:
    """A8 for several candidates, each with its own column of predictions: ``position``, ``model``,
    accuracy and macro F1, from one pass over the data into one small confusion table."""
    combined = df.groupBy(actual, *predictions.values()).agg(F.count("*").alias("n"))
    each = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("model"), F.col(column).cast("int").alias("predicted"))
        for i, (name, column) in enumerate(predictions.items())
    ])
    confusion = combined.select(F.col(actual).cast("int").alias("actual"), "n", F.inline(each))
    rated = _class_metrics(confusion, ("position", "model"))
    return rated.groupBy("position", "model").agg(
        _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("f1_macro")
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One pass."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    error = y - p
    squared = F.sum(error * error)
    spread = F.var_pop(y) * F.count(y)
    # Without any spread, a perfect prediction scores 1 and any other 0.
    flat = F.when(squared == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return df.agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.when(spread > 0, F.lit(1.0) - F.try_divide(squared, spread)).otherwise(flat).alias("r2"),
    )


def value_range(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """A10."""
    return df.agg(
        F.least(F.min(actual), F.min(predicted)).alias("lo"),
        F.greatest(F.max(actual), F.max(predicted)).alias("hi"),
    )


def select_best(metrics: DataFrame, metric: str, position: str = "position") -> DataFrame:
    """M9: the candidate with the highest metric; the earlier one on a tie."""
    return metrics.orderBy(F.col(metric).desc_nulls_last(), position).limit(1)


def model_comparison(metrics: DataFrame, metric: str, position: str = "position") -> DataFrame:
    """Every candidate with a flag on the winner. One row per candidate, so one task may rank them,
    and the candidates are computed once."""
    ranking = Window.orderBy(F.col(metric).desc_nulls_last(), position)
    return metrics.withColumn("is_best", F.row_number().over(ranking) == 1)


def batch_summary(df: DataFrame, column: str = "Predicted_Fault_Risk", classes=RISK_CLASSES) -> DataFrame:
    """Rows in total and per class, in one pass."""
    c = F.col(column)
    return df.agg(
        F.count("*").alias("total_rows"), *[F.count_if(c == k).alias(f"risk_{k}") for k in classes]
    )


def actual_vs_predicted(df: DataFrame, actual: str, predicted: str, bin_width: float | None = None) -> DataFrame:
    """The points of the scatter plot, or their counts per square of ``bin_width``."""
    pairs = df.select(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))
    if bin_width is None:
        return pairs
    width = F.lit(float(bin_width))
    binned = pairs.select(*[(F.floor(F.col(c) / width) * width).alias(f"{c}_bin") for c in ("actual", "predicted")])
    return binned.groupBy("actual_bin", "predicted_bin").agg(F.count("*").alias("n"))
