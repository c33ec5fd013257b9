"""Column names, types and fixed values of the observation model."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TS = "datetime"
CITY = "city"
VALUE = "pm2_5"
TARGET = "target_pm25"

# Observation columns in canonical order.
WEATHER = [
    "temperature_2m",
    "relative_humidity_2m",
    "dew_point_2m",
    "apparent_temperature",
    "precipitation",
    "rain",
    "surface_pressure",
    "cloud_cover",
    "wind_speed_10m",
    "wind_direction_10m",
]
POLLUTANTS = ["pm2_5", "pm10", "no2", "so2", "co", "o3"]
MEASURES = WEATHER + POLLUTANTS
OBSERVATION = [TS, *MEASURES]

# Plausible range of each measure (inclusive).
PLAUSIBLE = {
    "temperature_2m": (-10.0, 65.0),
    "relative_humidity_2m": (0.0, 100.0),
    "dew_point_2m": (-20.0, 50.0),
    "apparent_temperature": (-15.0, 70.0),
    "precipitation": (0.0, 500.0),
    "rain": (0.0, 500.0),
    "surface_pressure": (850.0, 1100.0),
    "cloud_cover": (0.0, 100.0),
    "wind_speed_10m": (0.0, 150.0),
    "wind_direction_10m": (0.0, 360.0),
    "pm2_5": (0.0, 1500.0),
    "pm10": (0.0, 2500.0),
    "no2": (0.0, 1000.0),
    "so2": (0.0, 1000.0),
    "co": (0.0, 50000.0),
    "o3": (0.0, 1000.0),
}

# Narrower bounds used for live rows.
LIVE_BOUNDS = {
    "pm2_5": (0.0, 1000.0),
    "pm10": (0.0, 1500.0),
    "relative_humidity_2m": (0.0, 100.0),
}

# Feed names of the pollutants.
POLLUTANT_FEED_NAMES = {
    "pm2_5": "pm2_5",
    "pm10": "pm10",
    "nitrogen_dioxide": "no2",
    "sulphur_dioxide": "so2",
    "carbon_monoxide": "co",
    "ozone": "o3",
}

# Taken when a current observation lacks the field.
CURRENT_DEFAULTS = {
    "temperature_2m": 25.0,
    "relative_humidity_2m": 60.0,
    "dew_point_2m": 18.0,
    "apparent_temperature": 26.0,
    "precipitation": 0.0,
    "rain": 0.0,
    "surface_pressure": 1010.0,
    "cloud_cover": 20.0,
    "wind_speed_10m": 12.0,
    "wind_direction_10m": 220.0,
    "pm2_5": 35.0,
    "pm10": 70.0,
    "no2": 25.0,
    "so2": 10.0,
    "co": 450.0,
    "o3": 30.0,
}

# Weather used next to the secondary pollutant feed.
FALLBACK_WEATHER = {
    "temperature_2m": 28.0,
    "relative_humidity_2m": 65.0,
    "dew_point_2m": 20.0,
    "apparent_temperature": 30.0,
    "precipitation": 0.0,
    "rain": 0.0,
    "surface_pressure": 1011.0,
    "cloud_cover": 25.0,
    "wind_speed_10m": 14.0,
    "wind_direction_10m": 230.0,
}

# Lags and windows in rows, and the names of the columns made from them.
LAGS = [24, 48, 72, 168]
ROLLINGS = [24, 72]

CALENDAR = ["year", "month", "day", "hour", "weekday", "is_weekend"]
ENGINEERED = [
    *CALENDAR,
    *[f"pm25_lag_{n}" for n in LAGS],
    *[f"pm25_roll_{stat}_{n}" for n in ROLLINGS for stat in ("mean", "std")],
    "temp_humidity",
    "wind_pm25",
    "hour_sin",
    "hour_cos",
    "month_sin",
    "month_cos",
    TARGET,
]

# The 18 features of the stored champion, in vector order.
SELECTED_FEATURES = [
    "pm2_5",
    "pm25_roll_mean_24",
    "pm25_roll_mean_72",
    "pm25_lag_24",
    "pm10",
    "co",
    "pm25_roll_std_24",
    "pm25_roll_std_72",
    "so2",
    "no2",
    "wind_pm25",
    "pm25_lag_48",
    "pm25_lag_72",
    "month_cos",
    "temp_humidity",
    "surface_pressure",
    "apparent_temperature",
    "wind_speed_10m",
]

# Names whose storage form is not just the lower-cased name.
DISPLAY_NAMES = {"pm2_5": "PM2.5", "pm10": "PM10", "no2": "NO2", "so2": "SO2", "co": "CO", "o3": "O3"}


def observation_schema(keys: Sequence[str] = (CITY,)) -> T.StructType:
    """Typed schema of an observation table."""
    fields = [T.StructField(TS, T.TimestampType())]
    fields += [T.StructField(c, T.DoubleType()) for c in MEASURES]
    fields += [T.StructField(k, T.StringType()) for k in keys]
    return T.StructType(fields)


def storage_name(name: str) -> str:
    """Lower-case word-character name a column is stored under."""
    known = {shown: stored for stored, shown in DISPLAY_NAMES.items()}
    if name in known:
        return known[name]
    return "_".join(part for part in re.split(r"[\W_]+", name.lower()) if part)


def sanitize_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Rename all columns to their storage names; also returns ``{old: new}``."""
    mapping = {c: storage_name(c) for c in df.columns}
    clash = [n for n in mapping.values() if list(mapping.values()).count(n) > 1]
    if clash:
        raise ValueError(f"columns collide after sanitizing: {sorted(set(clash))}")
    return df.toDF(*mapping.values()), mapping


def restore_columns(df: DataFrame) -> DataFrame:
    """Undo :func:`sanitize_columns` for the pollutant names."""
    return df.withColumnsRenamed({c: DISPLAY_NAMES[c] for c in df.columns if c in DISPLAY_NAMES})


def add_city(df: DataFrame, city: str, column: str = CITY) -> DataFrame:
    """Add a constant series key when the table has none."""
    if column in [c.lower() for c in df.columns]:
        return df
    return df.withColumn(column, F.lit(city))


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Fail before any job when columns are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
