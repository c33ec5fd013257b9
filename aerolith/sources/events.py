"""Hourly observation tables derived from the ``events`` table.

Sums are made in decimals, so a mean does not depend on the order rows are added in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

USERS_PER_CITY = 40
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _amount(value: Column) -> Column:
    return value.cast("decimal(12,2)")


def _total(value: Column) -> Column:
    return F.sum(_amount(value)).cast("double")


def _mean(value: Column) -> Column:
    return F.try_divide(_total(value), F.count(value))


def hourly_means(events: DataFrame, keys: Sequence[str] = (), value: str = "v") -> DataFrame:
    """(keys, datetime, value)."""
    return events.groupBy(*keys, F.date_trunc("hour", "ts").alias("datetime")).agg(_mean(F.col("value")).alias(value))


def hourly_by_type(events: DataFrame) -> DataFrame:
    return hourly_means(events, [F.col("event_type")])


def hourly_wide(events: DataFrame, city: str = "all") -> DataFrame:
    """One column per event type; hours without an event of a type are null there."""
    per_type = [_mean(F.when(F.col("event_type") == t, F.col("value"))).alias(f"{t}_v") for t in EVENT_TYPES]
    return events.groupBy(F.lit(city).alias("city"), F.date_trunc("hour", "ts").alias("datetime")).agg(*per_type)


def observations(events: DataFrame) -> DataFrame:
    """(city, datetime, 16 measures): a city is a block of users, a measure one hourly aggregate.

    Measures of a single event type are null in hours without it; hours without any event are
    missing. Some measures leave their plausible range.
    """
    value = F.col("value")
    k = F.get_json_object("props", "$.k").cast("double")
    events = events.withColumn("k", k)

    def of(kind: str) -> Column:
        return F.when(F.col("event_type") == kind, value)

    measures = {
        "temperature_2m": _mean(of("view")),
        "relative_humidity_2m": F.try_divide(F.sum("k"), F.count("k")),
        "dew_point_2m": F.min("value"),
        "apparent_temperature": _mean(of("click")),
        "precipitation": F.count(of("error")).cast("double"),
        "rain": F.count(of("signup")).cast("double"),
        "surface_pressure": F.max("value") + 900,
        "cloud_cover": F.max("k"),
        "wind_speed_10m": _mean(of("purchase")),
        "wind_direction_10m": _total(value),
        "pm2_5": _mean(value),
        "pm10": F.max("value"),
        "no2": _mean(of("error")),
        "so2": F.min("k"),
        "co": _total(value) * 10,
        "o3": _mean(of("signup")),
    }
    city = F.concat(F.lit("city_"), F.floor(F.col("user_id") / USERS_PER_CITY).cast("string")).alias("city")
    hour = F.date_trunc("hour", "ts").alias("datetime")
    return events.groupBy(city, hour).agg(*[m.alias(n) for n, m in measures.items()])
