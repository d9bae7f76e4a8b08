"""Column contracts, thresholds and class names shared by every module."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The column names, ids and class names of the telemetry data sets.
KEY = "DeviceTimeStamp"
DEVICE = "transformer_id"
READING_TIME = "device_timestamp"
DEFAULT_DEVICE = "ML-TRANSFORMER-01"

FEEDS: dict[str, list[str]] = {
    "alarm": ["OTI", "WTI", "ATI", "OLI", "OTI_A", "OTI_T", "MOG_A"],
    "current_voltage": [
        "VL1", "VL2", "VL3", "IL1", "IL2", "IL3", "VL12", "VL23", "VL31", "INUT",
    ],
    "power": ["WL1", "WL2", "WL3", "VAL1", "VAL2", "VAL3", "RVAL1", "RVAL2", "RVAL3"],
    "power_factor": [
        "PFL1", "PFL2", "PFL3", "Avg_PF", "Sum_PF", "FRQ",
        "THDVL1", "THDVL2", "THDVL3", "THDIL1", "THDIL2", "THDIL3",
        "MDIL1", "MDIL2", "MDIL3",
    ],
    "total_power": ["KWH", "KWH_I", "KVARH", "KW", "KVA", "KVAR", "MPD", "MKVAD"],
}
FEED_FILES = {
    "alarm": "Alarm.csv",
    "current_voltage": "CurrentVoltage.csv",
    "power": "Power.csv",
    "power_factor": "PowerFactor.csv",
    "total_power": "TotalPower.csv",
}
TIME_PARTS = ["Hour", "DayOfWeek", "Month"]
DERIVED = [
    "Voltage_Imbalance_Pct", "Current_Imbalance_Pct",
    "Total_VA", "Total_W", "Total_RVA", "Avg_THD_V", "Avg_THD_I",
    "OTI_ATI_Diff", "WTI_ATI_Diff", "WTI_OTI_Diff",
]
RISK = "Fault_Risk_Level"
ANY_ALARM = "Any_Alarm_Triggered"
CLASS_NAMES = {0: "Normal Operation", 1: "Warning / Pre-Alarm", 2: "Critical Alarm / Trip"}
REPORT_NAMES = {0: "Normal", 1: "Warning", 2: "Critical"}
PROBABILITY_FIELDS = ["Normal", "Warning", "Critical_Alarm"]
TIME_DEFAULTS = {"Hour": 12, "DayOfWeek": 2, "Month": 6}
ANOMALY_FEATURES = [
    "VL1", "VL2", "VL3", "IL1", "IL2", "IL3",
    "Voltage_Imbalance_Pct", "Current_Imbalance_Pct",
    "Avg_THD_V", "Avg_THD_I", "Total_W", "Total_VA", "FRQ",
]
NOT_CLASSIFIER_FEATURES = [KEY, "OTI_A", "OTI_T", "MOG_A", RISK, ANY_ALARM]
NOT_REGRESSOR_FEATURES = NOT_CLASSIFIER_FEATURES + [
    "OTI", "WTI", "OTI_ATI_Diff", "WTI_ATI_Diff", "WTI_OTI_Diff",
]
CONTAMINATION = 0.05
DATASET = "Distributed Transformer Monitoring IoT Telemetry"

# Text cells that a CSV feed may use for "no value".
NULL_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

SENSORS = [c for columns in FEEDS.values() for c in columns]
TABLE_TO_SENSOR = {c.lower(): c for c in SENSORS}

_FRAME = [KEY] + SENSORS + TIME_PARTS + DERIVED + [RISK, ANY_ALARM]
CLASSIFIER_FEATURES = [c for c in _FRAME if c not in NOT_CLASSIFIER_FEATURES]
REGRESSOR_FEATURES = [c for c in _FRAME if c not in NOT_REGRESSOR_FEATURES]


@dataclass(frozen=True)
class RiskRules:
    """Thresholds of the risk label and floors of the imbalance percentages."""

    oil_hot: float = 75.0
    winding_hot: float = 85.0
    oil_low: float = 20.0
    gauge: float = 0.0
    alarm: float = 0.0
    trip: float = 0.0
    voltage_floor: float = 10.0
    current_floor: float = 1.0


def doubles(columns: list[str]) -> list[T.StructField]:
    return [T.StructField(c, T.DoubleType()) for c in columns]


def feed_schema(feed: str) -> T.StructType:
    return T.StructType([T.StructField(KEY, T.TimestampType())] + doubles(FEEDS[feed]))


def reading_schema() -> T.StructType:
    """One reading as a JSON payload carries it."""
    return T.StructType([T.StructField(KEY, T.TimestampType())] + doubles(SENSORS))


def readings_table_schema() -> T.StructType:
    return T.StructType(
        [T.StructField(DEVICE, T.StringType()), T.StructField(READING_TIME, T.TimestampType())]
        + doubles(list(TABLE_TO_SENSOR))
    )


CLASSIFIER_METRICS = ["train_accuracy", "test_accuracy", "test_f1_macro"]
REGRESSOR_METRICS = ["test_rmse", "test_mae", "test_r2"]


def metadata_schema() -> T.StructType:
    names = T.ArrayType(T.StringType())
    return T.StructType([
        T.StructField("dataset", T.StringType()),
        T.StructField("records", T.LongType()),
        T.StructField("classification_target", T.StringType()),
        T.StructField("classification_features", names),
        T.StructField("best_classification_model", T.StringType()),
        T.StructField(
            "classification_results",
            T.MapType(T.StringType(), T.StructType(doubles(CLASSIFIER_METRICS))),
        ),
        T.StructField("regression_target", T.StringType()),
        T.StructField("regression_features", names),
        T.StructField("best_regression_model", T.StringType()),
        T.StructField(
            "regression_results",
            T.MapType(T.StringType(), T.StructType(doubles(REGRESSOR_METRICS))),
        ),
        T.StructField("anomaly_features", names),
        T.StructField("anomaly_contamination", T.DoubleType()),
        T.StructField("classes", T.MapType(T.StringType(), T.StringType())),
    ])
