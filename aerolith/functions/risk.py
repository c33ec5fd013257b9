"""Risk category, alerts, intervals and labels of a concentration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (upper bound inclusive, category, colour, advisory).
RISK_LEVELS = [
    (12.0, "Good", "#00e400", "Air quality is considered satisfactory."),
    (35.4, "Moderate", "#f1c40f", "Air quality is acceptable; moderate health concern for sensitive individuals."),
    (55.4, "Unhealthy for Sensitive Groups", "#ff7e00", "Members of sensitive groups may experience health effects."),
    (150.4, "Unhealthy", "#ff0000", "Everyone may begin to experience health effects."),
    (250.4, "Very Unhealthy", "#8f3f97", "Health alert: everyone may experience more serious health effects."),
    (None, "Hazardous", "#7e0023", "Health warnings of emergency conditions."),
]

# Texts of the alert payload.
OUTDOOR_OK = "Normal activities permitted"
OUTDOOR_LIMIT = "Limit prolonged outdoor exertion"
SENSITIVE_OK = "No special precautions needed"
SENSITIVE_LIMIT = "Avoid intense outdoor workouts"

# Width of the prediction interval, least forecast, limits of the alerts.
INTERVAL_Z = 1.645
INTERVAL_GROWTH = 0.015
DEFAULT_RMSE = 2.40
PREDICTION_FLOOR = 0.5
RAISED_ABOVE = 35.4
SEVERE_ABOVE = 55.4


def _by_level(value: Column, pick: int) -> Column:
    expr = None
    for level in RISK_LEVELS:
        bound, text = level[0], F.lit(level[pick])
        if bound is None:
            return expr.otherwise(F.when(value.isNotNull(), text))
        test = value <= F.lit(bound)
        expr = F.when(test, text) if expr is None else expr.when(test, text)
    return expr


def risk_columns(value: Column, null_as: float | None = None) -> dict[str, Column]:
    """Category, colour and advisory. Null (or NaN) stays null unless ``null_as`` is given."""
    clean = F.when(~F.isnan(value), value)
    if null_as is not None:
        clean = F.coalesce(clean, F.lit(null_as))
    return {
        "aqi_category": _by_level(clean, 1),
        "color_code": _by_level(clean, 2),
        "health_advisory": _by_level(clean, 3),
    }


def risk_struct(value: Column, null_as: float | None = None) -> Column:
    cols = risk_columns(value, null_as)
    return F.struct(
        cols["aqi_category"].alias("category"),
        cols["color_code"].alias("color"),
        cols["health_advisory"].alias("health_advisory"),
    )


def alert_columns(value: Column) -> dict[str, Column]:
    raised, severe = value > F.lit(RAISED_ABOVE), value > F.lit(SEVERE_ABOVE)
    return {
        "is_hazardous": severe,
        "general_population": F.when(raised, OUTDOOR_LIMIT).when(~raised, OUTDOOR_OK),
        "sensitive_groups": F.when(raised, SENSITIVE_LIMIT).when(~raised, SENSITIVE_OK),
        "mask_recommended": severe,
        "air_purifier_recommended": raised,
    }


def floored_prediction(raw: Column) -> Column:
    """Concentrations are not negative; two decimals."""
    return F.round(F.when(raw < 0, F.lit(0.0)).otherwise(raw), 2)


def interval_columns(
    prediction: Column, step: Column, rmse: Column | float = DEFAULT_RMSE, z: float = INTERVAL_Z
) -> dict[str, Column]:
    """Bounds widening with the square root of the step; the lower one is at least 0."""
    rmse = F.lit(rmse) if isinstance(rmse, (int, float)) else rmse
    half = F.lit(z) * rmse * (F.lit(1.0) + F.lit(INTERVAL_GROWTH) * F.sqrt(step))
    return {
        "lower_bound_90": F.when(prediction - half < 0, F.lit(0.0)).otherwise(prediction - half),
        "upper_bound_90": prediction + half,
    }


def is_infinite(value: Column) -> Column:
    return F.coalesce(F.abs(value) == F.lit(float("inf")), F.lit(False))
