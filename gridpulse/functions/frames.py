"""Changes to the column set (P1-P10, M12). All are narrow projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.functions import columns as C
from gridpulse.schema import (
    CLASSIFIER_FEATURES,
    DEFAULT_DEVICE,
    DEVICE,
    KEY,
    READING_TIME,
    REGRESSOR_FEATURES,
    TABLE_TO_SENSOR,
    TIME_DEFAULTS,
    RiskRules,
)


def rename_map(
    df: DataFrame,
    names: dict[str, str] = TABLE_TO_SENSOR,
    time_column: str = READING_TIME,
    key: str = KEY,
    keep: list[str] | None = None,
) -> DataFrame:
    """Mapped columns under their new names plus the time key; every other column is dropped
    unless it is listed in ``keep`` (the device id, say)."""
    chosen = [F.col(c).alias(names[c]) for c in df.columns if c in names]
    return df.select(*(keep or []), *chosen, F.col(time_column).alias(key))


def lower_columns(df: DataFrame, key: str = KEY, time_column: str = READING_TIME) -> DataFrame:
    """P2."""
    return df.toDF(*[time_column if c == key else c.lower() for c in df.columns])


def with_constant(df: DataFrame, name: str = DEVICE, value: str = DEFAULT_DEVICE) -> DataFrame:
    """The constant column comes first, as in the readings table."""
    return df.select(F.lit(value).alias(name), *[c for c in df.columns if c != name])


def feature_columns(df: DataFrame, exclude: list[str]) -> list[str]:
    """Every column but the excluded ones, order kept."""
    return [c for c in df.columns if c not in set(exclude)]


def select_except(df: DataFrame, exclude: list[str]) -> DataFrame:
    """P4."""
    return df.select(*feature_columns(df, exclude))


def default_columns(df: DataFrame, needed: list[str], value: float = 0.0) -> DataFrame:
    """P5: adds absent columns; values already there, nulls included, stay as they are."""
    absent = [c for c in needed if c not in df.columns]
    return df.withColumns({c: F.lit(float(value)) for c in absent}) if absent else df


def with_time_parts(df: DataFrame, key: str = KEY, defaults: dict[str, int] = TIME_DEFAULTS) -> DataFrame:
    """E1 where the key exists, else P6: constants for the parts that are absent."""
    if key in df.columns:
        return df.withColumns(C.time_parts(key))
    absent = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def preview_columns(df: DataFrame, wanted: list[str], fallback: int = 5) -> DataFrame:
    """The wanted columns that exist; the last few if none does."""
    present = [c for c in wanted if c in df.columns]
    return df.select(*(present or df.columns[-fallback:]))


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """P8."""
    return df.withColumns({c: C.coerce_number(c) for c in columns})


def select_series(df: DataFrame, columns: list[str], key: str = KEY, long: bool = False) -> DataFrame:
    """Chart input, one column per series or (``long``) one row per point."""
    wide = df.select(key, *columns)
    return wide.unpivot(key, columns, "series", "value") if long else wide


def temperature_only(df: DataFrame) -> DataFrame:
    """P10."""
    return df.select("predicted_oil_temperature_celsius", "safety_status")


def clean_numbers(df: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """NaN to null in every floating-point column."""
    floating = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in (skip or [])
    ]
    return df.withColumns({c: C.nan_to_null(c) for c in floating}) if floating else df


def with_derived(df: DataFrame, rules: RiskRules = RiskRules()) -> DataFrame:
    """The ten derived features. Differences are added only where both inputs exist."""
    present = set(df.columns)
    new = {
        "Voltage_Imbalance_Pct": C.imbalance_pct(["VL1", "VL2", "VL3"], rules.voltage_floor),
        "Current_Imbalance_Pct": C.imbalance_pct(["IL1", "IL2", "IL3"], rules.current_floor),
        "Total_VA": C.row_sum(["VAL1", "VAL2", "VAL3"]),
        "Total_W": C.row_sum(["WL1", "WL2", "WL3"]),
        "Total_RVA": C.row_sum(["RVAL1", "RVAL2", "RVAL3"]),
        "Avg_THD_V": C.row_mean(["THDVL1", "THDVL2", "THDVL3"]),
        "Avg_THD_I": C.row_mean(["THDIL1", "THDIL2", "THDIL3"]),
    }
    for left, right in [("OTI", "ATI"), ("WTI", "ATI"), ("WTI", "OTI")]:
        if left in present and right in present:
            new[f"{left}_{right}_Diff"] = C.difference(left, right)
    return df.withColumns(new)


def with_labels(df: DataFrame, rules: RiskRules = RiskRules()) -> DataFrame:
    """E6, E7."""
    return df.withColumns({
        "Fault_Risk_Level": C.risk_level(rules),
        "Any_Alarm_Triggered": C.any_flag(["OTI_A", "OTI_T", "MOG_A"]),
    })


def engineer_features(
    df: DataFrame,
    needed: list[str] | None = None,
    rules: RiskRules = RiskRules(),
    nulls: str = "keep",
    key: str = KEY,
) -> DataFrame:
    """Defaults, time parts and derived features for scoring, on a batch or a stream.

    ``nulls`` is the policy for values missing in the input: ``keep`` leaves them to the model's
    own handling, ``zero`` replaces them, ``error`` makes the job fail on the first one.
    """
    needed = needed or list(dict.fromkeys(CLASSIFIER_FEATURES + REGRESSOR_FEATURES))
    if nulls not in ("keep", "zero", "error"):
        raise ValueError(f"unknown null policy: {nulls}")
    full = default_columns(with_time_parts(clean_numbers(df), key), needed)
    if nulls == "zero":
        full = full.fillna(0, subset=needed)
    elif nulls == "error":
        full = full.withColumns({
            c: F.coalesce(F.col(c), F.raise_error(F.lit(f"missing value in {c}")).cast("double"))
            for c in needed
            if not c.startswith(("Total_", "Avg_THD")) and not c.endswith(("_Diff", "_Pct"))
        })
    return with_derived(full, rules)
