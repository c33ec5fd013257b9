"""Recursive multi-step forecast, its intervals and daily roll-up.

A series is one row: its held columns and an array of its newest values. Series run side by
side and steps follow each other; each step reads its inputs from the array, predicts and puts
the prediction at the end.

``mode="replay"`` (default) takes inputs the way the stored champion is called: lags one row
younger than in training, population deviation, calendar of the hour to predict, other calendar
columns held. ``mode="training"`` takes the inputs exactly as the training table defines them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions.calendar import calendar_columns, cyclic_columns, day_label, day_offset, hour_label
from aerolith.functions.risk import PREDICTION_FLOOR, floored_prediction, interval_columns, risk_columns
from aerolith.operators.chunks import SeriesSpec, latest_rows
from aerolith.schema import LAGS, ROLLINGS, VALUE, require_columns
from aerolith.session import discard, stage

HISTORY = "_history"
MAX_HOURS = 168
_KEEP = max(LAGS) + 1
_NEEDED = 72
_CUT_EVERY = 12


def forecast_state(df: DataFrame, latest: DataFrame, spec: SeriesSpec, value: str = VALUE) -> DataFrame:
    """One row per series: the columns of ``latest`` and its newest values, oldest first.

    A series with fewer than 72 values starts from its current value repeated.
    """
    newest = latest_rows(df.select(*spec.keys, spec.ts, value), spec, _KEEP)
    # At most 169 values per series.
    arrays = newest.groupBy(*spec.keys).agg(F.array_sort(F.collect_list(F.struct(spec.ts, value))).alias("_h"))
    history = F.transform("_h", lambda p: p[value])
    full = F.when(F.size("_h") >= _NEEDED, history).otherwise(F.array_repeat(F.col(value), _NEEDED))
    return latest.join(arrays, list(spec.keys)).withColumn(HISTORY, full).drop("_h")


def _mean(values: Column, n: int) -> Column:
    return F.aggregate(F.slice(values, -n, n), F.lit(0.0), lambda a, x: a + x) / n


def _deviation(values: Column, n: int, mean: Column, ddof: int) -> Column:
    squares = F.aggregate(F.slice(values, -n, n), F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.sqrt(squares / (n - ddof))


def step_inputs(history: Column, base: Column, step: Column, mode: str = "replay", value: str = VALUE) -> dict[str, Column]:
    """Columns that change from step to step, from the value array alone."""
    replay = mode == "replay"
    ahead = step if replay else step - 1
    ts = F.timestamp_micros(F.unix_micros(base) + ahead.cast("long") * F.lit(3_600_000_000))
    now = F.element_at(history, -1)
    calendar = calendar_columns(ts)
    cyclic = cyclic_columns(calendar["hour"], calendar["month"])
    out = {value: now}
    if replay:
        out |= {k: calendar[k] for k in ("hour", "month")}
        out |= {k: cyclic[k] for k in ("month_cos", "hour_sin", "hour_cos")}
        out |= {f"pm25_lag_{n}": F.element_at(history, -n) for n in LAGS if n <= _NEEDED}
    else:
        out |= {**calendar, **cyclic}
        out |= {f"pm25_lag_{n}": F.get(history, F.size(history) - 1 - n) for n in LAGS}
    for n in ROLLINGS:
        mean = _mean(history, n)
        out[f"pm25_roll_mean_{n}"] = mean
        out[f"pm25_roll_std_{n}"] = _deviation(history, n, mean, 0 if replay else 1)
    out["temp_humidity"] = F.col("temperature_2m") * F.col("relative_humidity_2m")
    out["wind_pm25"] = F.col("wind_speed_10m") * now
    return out


def _accept(raw: Column, decimals: int | None) -> Column:
    value = floored_prediction(raw) if decimals == 2 else F.greatest(raw, F.lit(0.0))
    return F.greatest(value, F.lit(PREDICTION_FLOOR))


def _rows(state: DataFrame, spec: SeriesSpec, hours: int, rmse: float) -> DataFrame:
    """(keys, step, forecast_ts, predicted...) from the filled arrays."""
    steps = state.select(*spec.keys, F.col(spec.ts).alias("_base"), F.posexplode(F.slice(HISTORY, -hours, hours)).alias("_i", "predicted"))
    steps = steps.withColumn("step", F.col("_i") + 1)
    ts = F.timestamp_micros(F.unix_micros("_base") + F.col("step").cast("long") * F.lit(3_600_000_000))
    return (
        steps.withColumn("forecast_ts", ts)
        .withColumn("forecast_hour_display", hour_label(F.col("forecast_ts")))
        .withColumn("day_offset", day_offset(F.col("step")))
        .withColumns(interval_columns(F.col("predicted"), F.col("step"), rmse))
        .withColumns(risk_columns(F.col("predicted")))
        .drop("_i", "_base")
    )


def _check_hours(hours: int) -> None:
    if not 1 <= hours <= MAX_HOURS:
        raise ValueError(f"hours must be 1..{MAX_HOURS}")


def forecast_linear(
    state: DataFrame,
    spec: SeriesSpec,
    coefficients: Mapping[str, float],
    intercept: float,
    *,
    hours: int = 72,
    rmse: float = 2.40,
    mode: str = "replay",
    decimals: int | None = 2,
    value: str = VALUE,
) -> DataFrame:
    """Forecast with a linear model: one fold over the steps inside each row, no shuffle."""
    _check_hours(hours)

    def advance(history: Column, step: Column) -> Column:
        changing = step_inputs(history, F.col(spec.ts), step, mode, value)
        raw = F.lit(float(intercept))
        for name, weight in coefficients.items():
            raw = raw + F.lit(float(weight)) * changing.get(name, F.col(name))
        return F.concat(history, F.array(_accept(raw, decimals)))

    filled = F.aggregate(F.sequence(F.lit(1), F.lit(hours)), F.col(HISTORY), advance)
    return _rows(state.select(*spec.keys, spec.ts, filled.alias(HISTORY)), spec, hours, rmse)


def forecast_model(
    state: DataFrame,
    spec: SeriesSpec,
    predict: Callable[[DataFrame], DataFrame],
    features: Sequence[str],
    *,
    hours: int = 72,
    rmse: float = 2.40,
    mode: str = "replay",
    decimals: int | None = 2,
    value: str = VALUE,
) -> DataFrame:
    """Forecast with any model that adds ``prediction``, such as ``PipelineModel.transform``.

    The state (one row per series) is written every few steps, so the plan stays short.
    """
    _check_hours(hours)
    needed = {*spec.keys, spec.ts, *features, "temperature_2m", "relative_humidity_2m", "wind_speed_10m"}
    held = [c for c in state.columns if c in needed and c != HISTORY]
    previous: DataFrame | None = None
    for step in range(1, hours + 1):
        changing = step_inputs(F.col(HISTORY), F.col(spec.ts), F.lit(step), mode, value)
        # The held time stays the base of all steps; the model only sees the changing columns.
        rows = state.withColumns({k: c for k, c in changing.items() if k != spec.ts})
        require_columns(rows, features)
        grown = F.concat(HISTORY, F.array(_accept(F.col("prediction"), decimals)))
        state = predict(rows).select(*held, grown.alias(HISTORY))
        if step % _CUT_EVERY == 0 and step < hours:
            state = stage(state)
            if previous is not None:
                discard(previous)
            previous = state
    return _rows(state.select(*spec.keys, spec.ts, HISTORY), spec, hours, rmse)


def daily_summary(forecast: DataFrame, spec: SeriesSpec, days: int = 3) -> DataFrame:
    """Mean, max, min and first peak hour of each forecast day, with the category of the mean."""
    daily = (
        forecast.filter(F.col("day_offset") <= days)
        .groupBy(*spec.keys, "day_offset")
        .agg(
            F.min_by(day_label(F.col("forecast_ts")), "step").alias("day_name"),
            F.avg("predicted").alias("avg_value"),
            F.max("predicted").alias("max_value"),
            F.min("predicted").alias("min_value"),
            F.max_by("forecast_hour_display", F.struct("predicted", -F.col("step"))).alias("peak_hour"),
        )
    )
    return daily.withColumns(risk_columns(F.col("avg_value")))
