"""Feeds derived from an event table: its five event types act as the five sensor feeds.

``events`` holds (event_id, ts, user_id, event_type, value, props). A device is a user; a feed row is
one device and day (``fleet=True``), or one hour of all users together (one single series).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.schema import DEVICE, KEY, RiskRules

EVENT_TYPES = {
    "alarm": "error",
    "current_voltage": "click",
    "power": "purchase",
    "power_factor": "view",
    "total_power": "signup",
}
RULES = RiskRules(oil_hot=100.0, winding_hot=145.0, oil_low=3.0, alarm=0.0, trip=0.0)
SHIFTED_RULES = RiskRules(oil_hot=90.0, winding_hot=147.0, oil_low=2.0, alarm=1.0, trip=0.0)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "events")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _measures() -> dict[str, dict[str, object]]:
    value, part = F.col("value"), F.col("event_id") % 150
    cents = F.sum(value.cast("decimal(18,2)"))
    rows = F.count("*")
    hundred = F.col("event_id") % 100
    k = F.from_json("props", "k int")["k"]
    return {
        "alarm": {
            "OTI": F.max(value), "WTI": F.max(part), "ATI": F.min(value), "OLI": F.min(part),
            "OTI_A": F.count_if(value > 200), "OTI_T": F.count_if(value > 300),
            "MOG_A": F.count_if(part % 50 == 49),
        },
        "current_voltage": {
            "VL1": F.min(value), "VL2": F.max(value), "VL3": cents,
            "IL1": F.min(part), "IL2": F.max(part), "IL3": rows,
        },
        "power": {
            "WL1": F.min(value), "WL2": F.max(value), "WL3": cents,
            "VAL1": F.min(part), "VAL2": F.max(part), "VAL3": F.sum(part),
            "RVAL1": rows, "RVAL2": F.min(hundred), "RVAL3": F.max(hundred),
        },
        "power_factor": {
            "THDVL1": F.min(value), "THDVL2": F.max(value), "THDVL3": cents,
            "THDIL1": F.min(part), "THDIL2": F.max(part), "THDIL3": F.sum(part),
            "FRQ": rows, "Avg_PF": F.max(k).cast("double") / 100,
        },
        "total_power": {"KW": F.max(value), "KVA": cents, "KWH": F.sum(part)},
    }


MEASURE_COLUMNS = {
    "alarm": ["OTI", "WTI", "ATI", "OLI", "OTI_A", "OTI_T", "MOG_A"],
    "current_voltage": ["VL1", "VL2", "VL3", "IL1", "IL2", "IL3"],
    "power": ["WL1", "WL2", "WL3", "VAL1", "VAL2", "VAL3", "RVAL1", "RVAL2", "RVAL3"],
    "power_factor": ["THDVL1", "THDVL2", "THDVL3", "THDIL1", "THDIL2", "THDIL3", "FRQ", "Avg_PF"],
    "total_power": ["KW", "KVA", "KWH"],
}
SENSOR_COLUMNS = [c for columns in MEASURE_COLUMNS.values() for c in columns]


def feeds(
    spark: SparkSession, folder: str, fleet: bool = True, grain: str | None = None
) -> dict[str, DataFrame]:
    grain = grain or ("day" if fleet else "hour")
    rows = events(spark, folder).withColumn(KEY, F.date_trunc(grain, "ts"))
    keys = [F.col("user_id").alias(DEVICE), KEY] if fleet else [KEY]
    return {
        name: rows.filter(F.col("event_type") == EVENT_TYPES[name])
        .groupBy(*keys)
        .agg(*[m.cast("double").alias(c) for c, m in measures.items()])
        for name, measures in _measures().items()
    }


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Events as single readings: device, time, a unique id and a few sensor values."""
    e = events(spark, folder)
    return e.select(
        F.col("user_id").alias(DEVICE),
        F.col("ts").alias(KEY),
        "event_id",
        F.col("value").alias("OTI"),
        (F.col("event_id") % 150).cast("double").alias("WTI"),
        (F.col("value") / 2).alias("ATI"),
        (F.col("event_id") % 50).cast("double").alias("OLI"),
        F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("OTI_A"),
    )


# The same feeds for the SQL checks.
_SQL_MEASURES = {
    "alarm": [
        "max(value)", "max(event_id % 150)", "min(value)", "min(event_id % 150)",
        "count(*) FILTER (value > 200)", "count(*) FILTER (value > 300)",
        "count(*) FILTER ((event_id % 150) % 50 = 49)",
    ],
    "current_voltage": [
        "min(value)", "max(value)", "sum(CAST(value AS DECIMAL(18,2)))",
        "min(event_id % 150)", "max(event_id % 150)", "count(*)",
    ],
    "power": [
        "min(value)", "max(value)", "sum(CAST(value AS DECIMAL(18,2)))",
        "min(event_id % 150)", "max(event_id % 150)", "sum(event_id % 150)",
        "count(*)", "min(event_id % 100)", "max(event_id % 100)",
    ],
    "power_factor": [
        "min(value)", "max(value)", "sum(CAST(value AS DECIMAL(18,2)))",
        "min(event_id % 150)", "max(event_id % 150)", "sum(event_id % 150)",
        "count(*)", "CAST(max(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)) AS DOUBLE) / 100",
    ],
    "total_power": ["max(value)", "sum(CAST(value AS DECIMAL(18,2)))", "sum(event_id % 150)"],
}


def feeds_sql(fleet: bool = True, grain: str | None = None) -> str:
    """Common table expressions, one per feed."""
    grain = grain or ("day" if fleet else "hour")
    keys = f"date_trunc('{grain}', ts) AS {KEY}"
    if fleet:
        keys = f"user_id AS {DEVICE}, {keys}"
    parts = []
    for name, measures in _SQL_MEASURES.items():
        columns = ", ".join(
            f"CAST({m} AS DOUBLE) AS {c}" for m, c in zip(measures, MEASURE_COLUMNS[name], strict=True)
        )
        parts.append(
            f"{name} AS (SELECT {keys}, {columns} FROM events "
            f"WHERE event_type = '{EVENT_TYPES[name]}' GROUP BY {'1, 2' if fleet else '1'})"
        )
    return ",\n".join(parts)


def aligned_sql(how: str = "FULL OUTER", fleet: bool = True, grain: str | None = None) -> str:
    using = f"USING ({DEVICE}, {KEY})" if fleet else f"USING ({KEY})"
    first, *rest = EVENT_TYPES
    chain = " ".join(f"{how} JOIN {name} {using}" for name in rest)
    keys = f"{DEVICE}, {KEY}" if fleet else KEY
    return (
        f"{feeds_sql(fleet, grain)},\n"
        f"aligned AS (SELECT {keys}, {', '.join(SENSOR_COLUMNS)} FROM {first} {chain})"
    )


def filled_sql(fleet: bool = True, grain: str | None = None) -> str:
    keys = f"{DEVICE}, {KEY}" if fleet else KEY
    series = f"PARTITION BY {DEVICE} ORDER BY {KEY}" if fleet else f"ORDER BY {KEY}"
    columns = ", ".join(
        f"coalesce({c}, last_value({c} IGNORE NULLS) OVER up, first_value({c} IGNORE NULLS) OVER down, 0) AS {c}"
        for c in SENSOR_COLUMNS
    )
    return (
        f"{aligned_sql(fleet=fleet, grain=grain)},\n"
        f"filled AS (SELECT {keys}, {columns} FROM aligned WINDOW "
        f"up AS ({series} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"down AS ({series} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    )


def _imbalance_sql(phases: list[str], floor: float) -> str:
    mean = f"(({' + '.join(phases)}) / 3)"
    deviation = f"greatest({', '.join(f'abs({p} - {mean})' for p in phases)})"
    return f"CASE WHEN {mean} > {floor} THEN {deviation} / {mean} * 100 ELSE 0 END"


def derived_sql(rules: RiskRules = RULES) -> dict[str, str]:
    return {
        "Hour": f"CAST(hour({KEY}) AS INTEGER)",
        "DayOfWeek": f"CAST(isodow({KEY}) - 1 AS INTEGER)",
        "Month": f"CAST(month({KEY}) AS INTEGER)",
        "Voltage_Imbalance_Pct": _imbalance_sql(["VL1", "VL2", "VL3"], rules.voltage_floor),
        "Current_Imbalance_Pct": _imbalance_sql(["IL1", "IL2", "IL3"], rules.current_floor),
        "Total_VA": "VAL1 + VAL2 + VAL3",
        "Total_W": "WL1 + WL2 + WL3",
        "Total_RVA": "RVAL1 + RVAL2 + RVAL3",
        "Avg_THD_V": "(THDVL1 + THDVL2 + THDVL3) / 3",
        "Avg_THD_I": "(THDIL1 + THDIL2 + THDIL3) / 3",
        "OTI_ATI_Diff": "OTI - ATI",
        "WTI_ATI_Diff": "WTI - ATI",
        "WTI_OTI_Diff": "WTI - OTI",
    }


def level_sql(rules: RiskRules = RULES) -> str:
    return (
        f"CASE WHEN OTI_A > {rules.alarm} OR OTI_T > {rules.trip} THEN 2 "
        f"WHEN OTI > {rules.oil_hot} OR WTI > {rules.winding_hot} OR OLI < {rules.oil_low} "
        f"OR MOG_A > {rules.gauge} THEN 1 ELSE 0 END"
    )


def features_sql(fleet: bool = True, grain: str | None = None) -> str:
    """Up to the CTE ``features``: the labelled frame."""
    derived = ", ".join(f"{sql} AS {name}" for name, sql in derived_sql().items())
    return (
        f"{filled_sql(fleet, grain)},\n"
        f"features AS (SELECT *, {derived}, CAST({level_sql()} AS INTEGER) AS Fault_Risk_Level, "
        "CAST(OTI_A > 0 OR OTI_T > 0 OR MOG_A > 0 AS INTEGER) AS Any_Alarm_Triggered FROM filled)"
    )
