"""Calendar, cyclic and display columns of a timestamp."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_columns(ts: Column) -> dict[str, Column]:
    weekday = F.weekday(ts)
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "hour": F.hour(ts),
        "weekday": weekday,
        "is_weekend": weekday.isin(5, 6).cast("int"),
    }


def _turn(part: Column, period: int) -> Column:
    return F.lit(2 * math.pi) * part / F.lit(period)


def cyclic_columns(hour: Column, month: Column) -> dict[str, Column]:
    return {
        "hour_sin": F.sin(_turn(hour, 24)),
        "hour_cos": F.cos(_turn(hour, 24)),
        "month_sin": F.sin(_turn(month, 12)),
        "month_cos": F.cos(_turn(month, 12)),
    }


def interaction_columns(pairs: dict[str, tuple[str, str]]) -> dict[str, Column]:
    """``{name: (a, b)}`` as products."""
    return {name: F.col(a) * F.col(b) for name, (a, b) in pairs.items()}


INTERACTIONS = {
    "temp_humidity": ("temperature_2m", "relative_humidity_2m"),
    "wind_pm25": ("wind_speed_10m", "pm2_5"),
}


def hour_label(ts: Column) -> Column:
    return F.date_format(ts, "EEE hh:mm a")


def day_label(ts: Column) -> Column:
    return F.date_format(ts, "EEEE, MMM dd")


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "MMM")


def day_offset(step: Column) -> Column:
    """Steps 1..24 are day 1, 25..48 day 2, and so on."""
    return (F.floor((step - 1) / 24) + 1).cast("int")


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts)
