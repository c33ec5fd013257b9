"""Calendar, lag, rolling, interaction, cyclic and target columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerolith.functions.calendar import (
    INTERACTIONS,
    calendar_columns,
    cyclic_columns,
    interaction_columns,
)
from aerolith.operators.chunks import SeriesSpec, frame_columns, latest_rows
from aerolith.schema import LAGS, ROLLINGS, TARGET, VALUE


def lag_exprs(w: WindowSpec, value: str, lags: Sequence[int], prefix: str) -> dict[str, Column]:
    return {f"{prefix}_lag_{n}": F.lag(value, n).over(w) for n in lags}


def rolling_exprs(
    w: WindowSpec,
    value: str,
    windows: Sequence[int],
    prefix: str,
    *,
    half_full: bool = False,
) -> dict[str, Column]:
    """Trailing mean and sample deviation, this row included.

    A frame needs all its values; with ``half_full`` half of them do, and a missing deviation is 0.
    """
    out = {}
    for n in windows:
        frame = w.rowsBetween(-(n - 1), 0)
        needed = max(1, n // 2) if half_full else n
        enough = F.count(value).over(frame) >= needed
        std = F.when(enough, F.stddev_samp(value).over(frame))
        out[f"{prefix}_roll_mean_{n}"] = F.when(enough, F.avg(value).over(frame))
        out[f"{prefix}_roll_std_{n}"] = F.coalesce(std, F.lit(0.0)) if half_full else std
    return out


def time_features(df: DataFrame, ts: str = "datetime") -> DataFrame:
    return df.withColumns(calendar_columns(F.col(ts)))


def cyclic_features(df: DataFrame, hour: str = "hour", month: str = "month") -> DataFrame:
    return df.withColumns(cyclic_columns(F.col(hour), F.col(month)))


def interaction_features(df: DataFrame, pairs: dict[str, tuple[str, str]] = INTERACTIONS) -> DataFrame:
    return df.withColumns(interaction_columns(pairs))


def lag_features(
    df: DataFrame, spec: SeriesSpec, value: str = VALUE, lags: Sequence[int] = tuple(LAGS), prefix: str = "pm25"
) -> DataFrame:
    """The value ``n`` rows earlier."""
    return frame_columns(df, spec, [value], lambda w: lag_exprs(w, value, lags, prefix), before=max(lags))


def rolling_features(
    df: DataFrame,
    spec: SeriesSpec,
    value: str = VALUE,
    windows: Sequence[int] = tuple(ROLLINGS),
    prefix: str = "pm25",
    half_full: bool = False,
) -> DataFrame:
    return frame_columns(
        df,
        spec,
        [value],
        lambda w: rolling_exprs(w, value, windows, prefix, half_full=half_full),
        before=max(windows) - 1,
    )


def lead_target(df: DataFrame, spec: SeriesSpec, value: str = VALUE, horizon: int = 1, name: str = TARGET) -> DataFrame:
    """The value ``horizon`` rows later."""
    return frame_columns(df, spec, [value], lambda w: {name: F.lead(value, horizon).over(w)}, after=horizon)


def series_features(
    df: DataFrame,
    spec: SeriesSpec,
    value: str = VALUE,
    *,
    lags: Sequence[int] = tuple(LAGS),
    windows: Sequence[int] = tuple(ROLLINGS),
    horizon: int = 1,
    prefix: str = "pm25",
    target: str = TARGET,
) -> DataFrame:
    """All lag, rolling and target columns over one shuffle and one sort."""

    def build(w: WindowSpec) -> dict[str, Column]:
        return {
            **lag_exprs(w, value, lags, prefix),
            **rolling_exprs(w, value, windows, prefix),
            target: F.lead(value, horizon).over(w),
        }

    return frame_columns(df, spec, [value], build, before=max(*lags, *windows), after=horizon)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Rows without any null."""
    return df.dropna("any")


def incomplete_report(df: DataFrame) -> DataFrame:
    """Rows in, rows :func:`drop_incomplete` removes and keeps."""
    full = F.lit(True)
    for c in df.columns:
        full = full & F.col(c).isNotNull()
    return df.agg(
        F.count("*").alias("rows_before"),
        F.count_if(~full).alias("rows_removed"),
        F.count_if(full).alias("rows_remaining"),
    )


def engineer_features(df: DataFrame, spec: SeriesSpec, value: str = VALUE, horizon: int = 1) -> DataFrame:
    """The training table: all engineered columns and the target, complete rows only."""
    rows = series_features(df, spec, value, horizon=horizon)
    rows = cyclic_features(interaction_features(time_features(rows, spec.ts)))
    return drop_incomplete(rows)


def live_features(df: DataFrame, spec: SeriesSpec, value: str = VALUE) -> DataFrame:
    """The newest row of each series with its features.

    Only the last 169 rows of a series can matter, so all others go before the windows.
    """
    recent = latest_rows(df, spec, max(LAGS) + 1)
    w = W.partitionBy(*spec.keys).orderBy(spec.ts)
    rows = recent.withColumns(
        {**lag_exprs(w, value, LAGS, "pm25"), **rolling_exprs(w, value, ROLLINGS, "pm25", half_full=True)}
    )
    newest = W.partitionBy(*spec.keys).orderBy(F.col(spec.ts).desc())
    rows = rows.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") == 1).drop("_r")
    return cyclic_features(interaction_features(time_features(rows, spec.ts)))
