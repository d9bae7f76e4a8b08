"""Scalar expressions (E1-E12, F1, P8). Every function returns a native ``Column``."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridpulse.schema import CLASS_NAMES, PROBABILITY_FIELDS, TIME_PARTS, RiskRules

# How far a number reaches at the start of a text, as browsers read it.
LEADING_NUMBER = r"^\s*([+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?))"


def time_parts(timestamp: str) -> dict[str, Column]:
    """Hour of day, weekday with Monday = 0, month."""
    t = F.col(timestamp)
    return dict(zip(TIME_PARTS, [F.hour(t), F.weekday(t), F.month(t)], strict=True))


def row_sum(columns: list[str]) -> Column:
    """Null as soon as one input is null."""
    return reduce(add, [F.col(c) for c in columns])


def row_mean(columns: list[str]) -> Column:
    """E4."""
    return row_sum(columns) / F.lit(float(len(columns)))


def imbalance_pct(columns: list[str], floor: float) -> Column:
    """Largest deviation from the mean in percent of the mean; 0 unless the mean exceeds ``floor``."""
    mean = row_mean(columns)
    deviation = F.greatest(*[F.abs(F.col(c) - mean) for c in columns])
    return F.when(mean > F.lit(float(floor)), deviation / mean * F.lit(100.0)).otherwise(F.lit(0.0))


def difference(left: str, right: str) -> Column:
    """E5."""
    return F.col(left) - F.col(right)


def above(column: str, limit: float) -> Column:
    """false, not null, where the value is missing or NaN, which Spark orders above every number."""
    value = F.col(column).cast("double")
    return F.coalesce((value > F.lit(float(limit))) & ~F.isnan(value), F.lit(False))


def below(column: str, limit: float) -> Column:
    """F1."""
    return F.coalesce(F.col(column) < F.lit(float(limit)), F.lit(False))


def warning_condition(rules: RiskRules) -> Column:
    """hot oil or winding, low oil, or a gauge alarm."""
    return (
        above("OTI", rules.oil_hot)
        | above("WTI", rules.winding_hot)
        | below("OLI", rules.oil_low)
        | above("MOG_A", rules.gauge)
    )


def critical_condition(rules: RiskRules) -> Column:
    """oil temperature alarm or trip."""
    return above("OTI_A", rules.alarm) | above("OTI_T", rules.trip)


def tiered(tiers: list[tuple[int, Column]], default: int = 0) -> Column:
    """Level of the last tier whose condition holds (tiers are given from low to high)."""
    level = None
    for value, condition in reversed(tiers):
        level = F.when(condition, F.lit(value)) if level is None else level.when(condition, F.lit(value))
    return level.otherwise(F.lit(default))


def risk_level(rules: RiskRules) -> Column:
    """E6 with the telemetry rules."""
    return tiered([(1, warning_condition(rules)), (2, critical_condition(rules))])


def any_flag(columns: list[str], limit: float = 0.0) -> Column:
    """1 if any of the columns exceeds ``limit``, else 0."""
    return reduce(or_, [above(c, limit) for c in columns]).cast("int")


def class_label(column: str | Column, names: dict[int, str] = CLASS_NAMES, unknown: str = "Unknown") -> Column:
    """E8."""
    c = F.col(column) if isinstance(column, str) else column
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c.cast("int")), F.lit(unknown))


def safety_status(column: str | Column) -> Column:
    """E9."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c == 2, "CRITICAL").when(c == 1, "WARNING").otherwise("OPTIMAL")


def round_half_even(column: str | Column, places: int) -> Column:
    """Scale, round to the nearest even integer, scale back, as array libraries do. (Decimal
    rounding of the printed value, ``F.bround``, differs on ties that binary numbers only approach.)"""
    c = F.col(column) if isinstance(column, str) else column
    scale = F.lit(10.0**places)
    return F.rint(c * scale) / scale


def probability_struct(
    column: str | Column | None, fields: list[str] = PROBABILITY_FIELDS, places: int = 4
) -> Column:
    """Vector (or array) of class probabilities as a struct; absent classes, or a model without
    probabilities (``None``), read as 0."""
    if column is None:
        return F.struct(*[F.lit(0.0).alias(f) for f in fields])
    c = F.col(column) if isinstance(column, str) else column
    values = [F.coalesce(F.get(c, F.lit(i)), F.lit(0.0)) for i in range(len(fields))]
    return F.struct(*[round_half_even(v, places).alias(f) for v, f in zip(values, fields, strict=True)])


def vector_probability_struct(column: str, **options) -> Column:
    return probability_struct(vector_to_array(F.col(column)), **options)


def coerce_number(column: str) -> Column:
    """The number a form text starts with; 0 for anything else, including NaN and -0."""
    text = F.regexp_extract(F.col(column), LEADING_NUMBER, 1)
    value = F.coalesce(text.try_cast("double"), F.lit(0.0))
    return F.when(F.isnan(value) | (value == F.lit(0.0)), F.lit(0.0)).otherwise(value)


def nan_to_null(column: str) -> Column:
    """Spark orders NaN above every number; the label and imbalance rules need it missing instead."""
    return F.nanvl(F.col(column), F.lit(None).cast("double"))
