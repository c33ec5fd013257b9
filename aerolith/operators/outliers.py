"""Outliers against the median of a moving frame, and their removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.operators.chunks import SeriesSpec, drop_halo, with_halo

#: Median deviation of a normal distribution with standard deviation 1 is the inverse of this.
NORMAL = 1.4826


def _middle(ordered: Column) -> Column:
    """Median of an ordered array; null if it is empty."""
    n = F.size(ordered)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return (F.get(ordered, low) + F.get(ordered, high)) / 2


def _distances(frame: Column, centre: Column) -> Column:
    return F.transform(frame, lambda v: F.abs(v - centre))


def rolling_medians(df: DataFrame, spec: SeriesSpec, columns: Sequence[str], half: int = 12) -> DataFrame:
    """Adds ``<c>_median``, ``<c>_deviation`` (median distance from it, times 1.4826) and ``<c>_known`` for each column.

    Over the row, ``half`` rows before it and ``half`` after it in its series; nulls do not count. A frame
    is an array of 2 * half + 1 values at most, ordered by column functions.
    """
    w = spec.in_chunk().rowsBetween(-half, half)
    rows = with_halo(df, spec, columns, before=half, after=half)
    rows = drop_halo(rows.withColumns({f"_f_{c}": F.sort_array(F.collect_list(c).over(w)) for c in columns}))
    rows = rows.withColumns({f"{c}_median": _middle(F.col(f"_f_{c}")) for c in columns})
    spread = {f"{c}_deviation": F.lit(NORMAL) * _middle(F.sort_array(_distances(F.col(f"_f_{c}"), F.col(f"{c}_median")))) for c in columns}
    known = {f"{c}_known": F.size(f"_f_{c}") for c in columns}
    return rows.withColumns(spread | known).drop(*[f"_f_{c}" for c in columns])


def flag_outliers(df: DataFrame, spec: SeriesSpec, columns: Sequence[str], *, half: int = 12, times: float = 3.0, least_known: int = 5) -> DataFrame:
    """Adds median, deviation and ``<c>_outlier``: the value lies more than ``times`` deviations from the median.

    Frames with fewer than ``least_known`` values, or with a deviation of 0, have no outliers; a null is none.
    """
    rows = rolling_medians(df, spec, columns, half)

    def outlier(c: str) -> Column:
        far = F.abs(F.col(c) - F.col(f"{c}_median")) > times * F.col(f"{c}_deviation")
        return F.coalesce(far & (F.col(f"{c}_deviation") > 0) & (F.col(f"{c}_known") >= least_known), F.lit(False))

    return rows.withColumns({f"{c}_outlier": outlier(c) for c in columns}).drop(*[f"{c}_known" for c in columns])


def remove_outliers(df: DataFrame, spec: SeriesSpec, columns: Sequence[str], **settings) -> DataFrame:
    """The rows of ``df`` with outlying values set to null, for interpolation to fill. No row is dropped."""
    rows = flag_outliers(df, spec, columns, **settings)
    cleaned = {c: F.when(~F.col(f"{c}_outlier"), F.col(c)) for c in columns}
    return rows.select(*[cleaned[c].alias(c) if c in cleaned else F.col(c) for c in df.columns])


def outlier_counts(df: DataFrame, spec: SeriesSpec, columns: Sequence[str], **settings) -> DataFrame:
    """(keys, column_name, known_count, outlier_count)."""
    rows = flag_outliers(df, spec, columns, **settings)
    counts = rows.groupBy(*spec.keys).agg(*[F.struct(F.count(c).alias("known_count"), F.count_if(f"{c}_outlier").alias("outlier_count")).alias(c) for c in columns])
    listed = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).getField("known_count").alias("known_count"), F.col(c).getField("outlier_count").alias("outlier_count")) for c in columns])
    return counts.select(*spec.keys, F.inline(listed))
