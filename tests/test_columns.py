import pytest
from pyspark.errors import PySparkException

from gridpulse.functions import columns as C
from gridpulse.functions import frames as P
from gridpulse.schema import (
    CLASSIFIER_FEATURES,
    KEY,
    REGRESSOR_FEATURES,
    SENSORS,
    TABLE_TO_SENSOR,
    RiskRules,
)


def values(df, column):
    return df.select(column.alias("v")).toPandas()["v"].tolist()


def one(spark, **row):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} double" for c in row))


@pytest.mark.parametrize(
    ("phases", "floor", "want"),
    [
        ((12.0, 12.0, 15.0), 10, (15 - 13) / 13 * 100),
        ((10.0, 10.0, 10.0), 10, 0.0),  # the mean must exceed the floor
        ((0.0, 0.0, 0.0), 10, 0.0),
        ((None, 12.0, 12.0), 10, 0.0),
        ((-30.0, 60.0, 30.0), 1, 250.0),
    ],
)
def test_imbalance(spark, phases, floor, want):
    df = spark.createDataFrame([phases], "a double, b double, c double")
    assert values(df, C.imbalance_pct(["a", "b", "c"], floor)) == [pytest.approx(want)]


@pytest.mark.parametrize(
    ("row", "level"),
    [
        ({}, 0),
        ({"OTI": 75.0}, 0), ({"OTI": 75.1}, 1), ({"WTI": 85.0}, 0), ({"WTI": 85.5}, 1),
        ({"OLI": 20.0}, 0), ({"OLI": 19.9}, 1), ({"MOG_A": 1.0}, 1),
        ({"OTI_A": 1.0}, 2), ({"OTI_T": 1.0}, 2), ({"OTI_A": 1.0, "OTI": 90.0}, 2),
        ({"OTI": None, "OLI": None}, 0), ({"OTI": float("nan")}, 0),
    ],
)
def test_risk_level(spark, row, level):
    base = {"OTI": 50.0, "WTI": 50.0, "OLI": 50.0, "OTI_A": 0.0, "OTI_T": 0.0, "MOG_A": 0.0}
    df = P.clean_numbers(one(spark, **{**base, **row}))
    assert values(df, C.risk_level(RiskRules())) == [level]


def test_any_flag_is_never_null(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None), (0.0, 0.0)], "a double, b double")
    assert values(df, C.any_flag(["a", "b"])) == [1, 0, 0]


def test_labels_and_status(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (7,), (None,)], "c int")
    assert values(df, C.class_label("c"))[-2:] == ["Unknown", "Unknown"]
    assert values(df, C.class_label("c"))[1] == "Warning / Pre-Alarm"
    assert values(df, C.safety_status("c")) == ["OPTIMAL", "WARNING", "CRITICAL", "OPTIMAL", "OPTIMAL"]


def test_rounding_goes_to_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (2.5,), (-0.125,)], "x double")
    assert values(df, C.round_half_even("x", 2)) == [0.12, 0.38, 2.5, -0.12]
    assert values(df, C.round_half_even("x", 0))[2] == 2.0


@pytest.mark.parametrize(
    ("text", "number"),
    [
        ("12abc", 12.0), ("", 0.0), ("abc", 0.0), ("-.5e1", -5.0), ("  7 V", 7.0), ("+3.", 3.0), ("1e", 1.0),
        ("NaN", 0.0), ("-0", 0.0), ("Infinity", float("inf")), (None, 0.0), (".", 0.0), ("1,5", 1.0),
    ],
)
def test_form_numbers(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string")
    assert values(df, C.coerce_number("t")) == [number]


def test_probabilities(spark):
    df = spark.createDataFrame([([0.25, 0.75],)], "p array<double>")
    assert df.select(C.probability_struct("p").alias("s")).first().s.asDict() == {
        "Normal": 0.25, "Warning": 0.75, "Critical_Alarm": 0.0,
    }
    assert df.select(C.probability_struct(None).alias("s")).first().s.Normal == 0.0


def test_feature_lists():
    assert len(SENSORS) == 49 and len(TABLE_TO_SENSOR) == 49
    assert len(CLASSIFIER_FEATURES) == 59 and len(REGRESSOR_FEATURES) == 54
    assert CLASSIFIER_FEATURES[0] == "OTI" and REGRESSOR_FEATURES[0] == "ATI"


def test_time_parts_and_defaults(spark):
    timed = spark.sql(f"SELECT timestamp'2024-01-07 23:15:00' AS {KEY}, 5 AS Hour")
    row = P.with_time_parts(timed).first()
    assert (row.Hour, row.DayOfWeek, row.Month) == (23, 6, 1)
    untimed = spark.sql("SELECT 5 AS Hour")
    row = P.with_time_parts(untimed).first()
    assert (row.Hour, row.DayOfWeek, row.Month) == (5, 2, 6)


def test_rename_drops_what_is_not_mapped(spark):
    df = spark.sql("SELECT 1D AS oti, 2D AS extra, timestamp'2024-01-01' AS device_timestamp")
    assert P.rename_map(df).columns == ["OTI", KEY]


def test_preview_columns(spark):
    df = spark.sql("SELECT 1 a, 2 b, 3 c, 4 d, 5 e, 6 f")
    assert P.preview_columns(df, ["c", "zz"]).columns == ["c"]
    assert P.preview_columns(df, ["zz"]).columns == ["b", "c", "d", "e", "f"]


def test_engineer_features_defaults_and_null_policies(spark):
    sample = one(spark, VL1=240.0, VL2=239.5, VL3=240.2, OTI=55.0, WTI=60.0, ATI=32.0, OLI=None)
    row = P.engineer_features(sample).first()
    assert row.KW == 0.0 and row.Hour == 12 and row.OTI_ATI_Diff == 23.0 and row.OLI is None
    assert row.Voltage_Imbalance_Pct == pytest.approx(0.4 / 239.9 * 100)
    assert P.engineer_features(sample, nulls="zero").first().OLI == 0.0
    with pytest.raises(PySparkException, match="missing value in OLI"):
        P.engineer_features(sample, nulls="error").collect()


def test_scalars_stay_native(spark):
    plan = P.engineer_features(one(spark, VL1=1.0))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_long_series(spark):
    df = spark.sql(f"SELECT timestamp'2024-01-01' AS {KEY}, 1D AS OTI, 2D AS WTI")
    assert P.select_series(df, ["OTI", "WTI"], long=True).orderBy("series").select("value").collect() == [(1.0,), (2.0,)]
