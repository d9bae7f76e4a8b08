"""Score readings with fitted models, in bulk or from a stream."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.functions import columns as C
from gridpulse.functions.frames import engineer_features
from gridpulse.operators.carry import FILLED, carry_forward
from gridpulse.operators.training import RISK_PREDICTION, RISK_PROBABILITY, TEMPERATURE_PREDICTION
from gridpulse.schema import CLASS_NAMES, DEVICE, KEY, RiskRules


def predict(
    df: DataFrame,
    classifier: Transformer,
    regressor: Transformer,
    needed: list[str] | None = None,
    nulls: str = "keep",
    rules: RiskRules = RiskRules(),
    key: str = KEY,
) -> DataFrame:
    """The input as the struct ``_input``, next to the outputs of both models. Values that ``carry`` has filled
    stand in for those of the input."""
    columns = [c for c in df.columns if not c.startswith(FILLED)]
    values = [F.col(f"{FILLED}{c}").alias(c) if f"{FILLED}{c}" in df.columns else F.col(c) for c in columns]
    kept = df.select(F.struct(*columns).alias("_input"), *values)
    features = engineer_features(kept, needed, rules, nulls, key)
    return regressor.transform(classifier.transform(features))


def score_batch(
    df: DataFrame, classifier: Transformer, regressor: Transformer, names: dict[int, str] = CLASS_NAMES,
    history: DataFrame | None = None, by: list[str] | None = None, tiebreak: list[str] | None = None, **options
) -> DataFrame:
    """The input columns as they came, plus predicted risk, its name and the oil temperature.
    One narrow plan, but with ``nulls="fill"``: then gaps take the last known values of the device (``by``)
    before the reading, from the readings table ``history`` and the batch itself, and 0 without any."""
    if options.get("nulls") == "fill":
        if history is None:
            raise ValueError("the null policy 'fill' needs the stored readings")
        df = carry_forward(df, history, list(by or [DEVICE]), options.get("key", KEY), tiebreak)
        options["nulls"] = "zero"
    risk = F.col(RISK_PREDICTION).cast("int")
    return predict(df, classifier, regressor, **options).select(
        "_input.*",
        risk.alias("Predicted_Fault_Risk"),
        C.class_label(risk, names).alias("Risk_Status"),
        C.round_half_even(TEMPERATURE_PREDICTION, 2).alias("Predicted_OTI_Temp_C"),
    )


def score_detail(
    df: DataFrame,
    classifier: Transformer,
    regressor: Transformer,
    keep: list[str] | None = None,
    names: dict[int, str] = CLASS_NAMES,
    **options,
) -> DataFrame:
    """The full answer per reading, next to the input columns in ``keep``."""
    scored = predict(df, classifier, regressor, **options)
    risk = F.col(RISK_PREDICTION).cast("int")
    probability = (
        C.vector_probability_struct(RISK_PROBABILITY)
        if RISK_PROBABILITY in scored.columns
        else C.probability_struct(None)
    )
    return scored.select(
        *[F.col("_input")[c].alias(c) for c in keep or []],
        risk.alias("predicted_risk_level"),
        C.class_label(risk, names).alias("risk_label"),
        probability.alias("probabilities"),
        C.round_half_even(TEMPERATURE_PREDICTION, 2).alias("predicted_oil_temperature_celsius"),
        C.safety_status(risk).alias("safety_status"),
    )
