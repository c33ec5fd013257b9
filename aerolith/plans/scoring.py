"""Batch scoring, prediction log, what-if scenarios and status rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions.risk import alert_columns, floored_prediction, risk_columns
from aerolith.schema import VALUE, require_columns

# Constants of the what-if row.
WHAT_IF_STD_24 = 3.5
WHAT_IF_STD_72 = 4.5
WHAT_IF_MONTH_COS = -0.5
WHAT_IF_FEELS_LIKE = 2.0


def linear_prediction(coefficients: Mapping[str, float], intercept: float) -> Column:
    """A linear model as a column expression."""
    total = F.lit(float(intercept))
    for name, weight in coefficients.items():
        total = total + F.lit(float(weight)) * F.col(name)
    return total


def linear_model(coefficients: Mapping[str, float], intercept: float) -> Callable[[DataFrame], DataFrame]:
    """A linear model in the shape of ``PipelineModel.transform``."""
    return lambda df: df.withColumn("prediction", linear_prediction(coefficients, intercept))


def score(df: DataFrame, predict: Callable[[DataFrame], DataFrame], features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Prediction (not negative, two decimals) and its category, for every row of ``df``."""
    require_columns(df, features)
    scored = predict(df)
    raw = F.when(F.col("prediction") < 0, F.lit(0.0)).otherwise(F.col("prediction"))
    rows = scored.select(*keep, floored_prediction(F.col("prediction")).alias("predicted_target_pm25"), raw.alias("_raw"))
    return rows.withColumns(risk_columns(F.col("_raw"))).drop("_raw")


def prediction_log(scored: DataFrame, keys: Sequence[str], model_name: str, when: Column, ts: str = "datetime", value: str = VALUE) -> DataFrame:
    """Scored latest rows in the layout of the log."""
    return scored.select(
        *keys,
        when.alias("prediction_time"),
        F.col(ts).alias("input_timestamp"),
        F.col(value).alias("current_pm25"),
        F.col("predicted_target_pm25").alias("predicted_next_hour_pm25"),
        "aqi_category",
        "color_code",
        "health_advisory",
        F.lit(model_name).alias("champion_model"),
    )


def what_if_features(scenarios: DataFrame) -> DataFrame:
    """Model inputs from nine scenario columns; history is taken as flat at the current value."""
    return scenarios.withColumns(
        {
            **{f"pm25_lag_{n}": F.col(VALUE) for n in (24, 48, 72)},
            **{f"pm25_roll_mean_{n}": F.col(VALUE) for n in (24, 72)},
            "pm25_roll_std_24": F.lit(WHAT_IF_STD_24),
            "pm25_roll_std_72": F.lit(WHAT_IF_STD_72),
            "month_cos": F.lit(WHAT_IF_MONTH_COS),
            "wind_pm25": F.col("wind_speed_10m") * F.col(VALUE),
            "temp_humidity": F.col("temperature_2m") * F.col("relative_humidity_2m"),
            "apparent_temperature": F.col("temperature_2m") + F.lit(WHAT_IF_FEELS_LIKE),
        }
    )


def scenario_rows(df: DataFrame, changes: Mapping[str, Sequence[float]]) -> DataFrame:
    """Every row under every factor of each changed column, one column at a time."""
    cases = [F.struct(F.lit(c).alias("changed"), F.lit(float(f)).alias("factor")) for c, factors in changes.items() for f in factors]
    rows = df.withColumn("_case", F.explode(F.array(*cases)))
    return rows.withColumns(
        {
            "changed": F.col("_case.changed"),
            "factor": F.col("_case.factor"),
            **{c: F.when(F.col("_case.changed") == c, F.col(c) * F.col("_case.factor")).otherwise(F.col(c)) for c in changes},
        }
    ).drop("_case")


def scenario_grid(df: DataFrame, changes: Mapping[str, Sequence[float]]) -> DataFrame:
    """Every row under every combination of the columns' factors, with the factors in ``<column>_factor``."""
    for c, factors in changes.items():
        df = df.withColumn(f"{c}_factor", F.explode(F.array(*[F.lit(float(f)) for f in factors])))
    return df.withColumns({c: F.col(c) * F.col(f"{c}_factor") for c in changes})


def current_status(latest: DataFrame, keys: Sequence[str], ts: str = "datetime", value: str = VALUE) -> DataFrame:
    """Current value and category of each series; a missing value counts as 25."""
    known = F.coalesce(F.when(~F.isnan(value), F.col(value)), F.lit(25.0))
    return latest.select(*keys, ts, known.alias("current_pm25")).withColumns(risk_columns(F.col("current_pm25")))


def health_alerts(latest: DataFrame, keys: Sequence[str], ts: str = "datetime", value: str = VALUE) -> DataFrame:
    return current_status(latest, keys, ts, value).withColumns(alert_columns(F.col("current_pm25")))
