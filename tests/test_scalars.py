"""Calendar, cyclic and risk columns against known values."""

import math

import pytest
from pyspark.sql import functions as F

from aerolith.functions.calendar import day_offset
from aerolith.functions.risk import alert_columns, floored_prediction, interval_columns, risk_columns, risk_struct
from aerolith.operators.features import cyclic_features, interaction_features, time_features


def test_live_row(spark):
    df = spark.sql(
        "SELECT timestamp'2026-08-22 20:00:00' AS datetime, 26.4D AS temperature_2m, 87.0D AS relative_humidity_2m, 13.8D AS wind_speed_10m, 16.6D AS pm2_5"
    )
    r = cyclic_features(interaction_features(time_features(df))).first()
    assert (r.year, r.month, r.day, r.hour, r.weekday, r.is_weekend) == (2026, 8, 22, 20, 5, 1)
    assert math.isclose(r.temp_humidity, 2296.8) and math.isclose(r.wind_pm25, 229.08)
    assert math.isclose(r.hour_sin, -0.8660254037844386, abs_tol=1e-12) and math.isclose(r.hour_cos, 0.5, abs_tol=1e-12)
    assert math.isclose(r.month_sin, -0.8660254037844384, abs_tol=1e-12) and math.isclose(r.month_cos, -0.5, abs_tol=1e-12)


def test_sunday_row(spark):
    df = time_features(spark.sql("SELECT timestamp'2023-01-08 01:00:00' AS datetime"))
    r = cyclic_features(df).first()
    assert (r.weekday, r.is_weekend) == (6, 1)
    assert [round(x, 3) for x in (r.hour_sin, r.hour_cos, r.month_sin, r.month_cos)] == [0.259, 0.966, 0.5, 0.866]


@pytest.mark.parametrize(
    ("value", "category"),
    [
        (-3.0, "Good"),
        (12.0, "Good"),
        (12.01, "Moderate"),
        (16.74, "Moderate"),
        (35.4, "Moderate"),
        (55.4, "Unhealthy for Sensitive Groups"),
        (150.4, "Unhealthy"),
        (250.4, "Very Unhealthy"),
        (250.5, "Hazardous"),
        (None, None),
        (float("nan"), None),
    ],
)
def test_category(spark, value, category):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(risk_columns(F.col("v"))["aqi_category"]).first()[0] == category
    assert df.select(risk_struct(F.col("v"), null_as=25.0)["category"]).first()[0] == (category or "Moderate")


def test_alerts_and_intervals(spark):
    df = spark.createDataFrame([(35.4, 1), (35.5, 24), (60.0, 25), (1.0, 72)], "v double, step int")
    rows = df.withColumns(alert_columns(F.col("v"))).withColumns(interval_columns(F.col("v"), F.col("step"))).withColumn("day", day_offset(F.col("step"))).collect()
    assert [r.air_purifier_recommended for r in rows] == [False, True, True, False]
    assert [r.is_hazardous for r in rows] == [False, False, True, False]
    assert [r.day for r in rows] == [1, 1, 2, 3]
    assert rows[3].lower_bound_90 == 0.0
    assert math.isclose(rows[2].upper_bound_90, 60 + 1.645 * 2.4 * (1 + 0.015 * 5))


def test_floored_prediction(spark):
    df = spark.createDataFrame([(-2.0,), (3.14159,), (None,)], "v double")
    assert [r[0] for r in df.select(floored_prediction(F.col("v"))).collect()] == [0.0, 3.14, None]
