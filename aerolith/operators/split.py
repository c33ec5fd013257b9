"""Splits by time and scaling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.operators.chunks import SeriesSpec, times_at_positions
from aerolith.session import stage


def time_split(df: DataFrame, spec: SeriesSpec, test_ratio: float = 0.20) -> DataFrame:
    """Add ``split``: the first ``int(n * (1 - ratio))`` rows of each series train, the rest test.

    The rows are compared with one boundary time per series; they are not ordered. The boundaries
    are staged, so their size is known when the join is planned: up to the session's broadcast
    threshold the rows are not moved either, beyond it the join is shuffled.
    """
    first_test = stage(times_at_positions(df, spec, {"_cut": lambda n: F.floor(n * F.lit(1.0 - test_ratio)) + 1}))
    before = F.col("_cut").isNull() | (F.col(spec.ts) < F.col("_cut"))
    return df.join(first_test, list(spec.keys), "left").withColumn("split", F.when(before, "train").otherwise("test")).drop("_cut")


def expanding_folds(df: DataFrame, spec: SeriesSpec, splits: int = 4) -> DataFrame:
    """Add ``fold``: 0 is only trained on; round i trains on folds below i and tests on fold i.

    Test parts have ``n // (splits + 1)`` rows each and end with the series.
    """

    def start(i: int):
        return lambda n: n - (splits - i + 1) * F.floor(n / (splits + 1)) + 1

    cuts = stage(times_at_positions(df, spec, {f"_cut{i}": start(i) for i in range(1, splits + 1)}))
    fold = F.lit(0)
    for i in range(1, splits + 1):
        fold = fold + F.coalesce((F.col(spec.ts) >= F.col(f"_cut{i}")).cast("int"), F.lit(0))
    return df.join(cuts, list(spec.keys), "left").withColumn("fold", fold).drop(*[f"_cut{i}" for i in range(1, splits + 1)])


def standard_moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """{column: (mean, population deviation)}; a deviation of 0 becomes 1."""
    row = df.agg(*[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_pop(c).alias(f"{c}_s") for c in columns]).first()
    return {c: (row[f"{c}_m"], row[f"{c}_s"] or 1.0) for c in columns}


def scaled(column: str, moments: Mapping[str, tuple[float, float]]) -> Column:
    mean, std = moments[column]
    return (F.col(column) - F.lit(mean)) / F.lit(std)


def scale_columns(df: DataFrame, moments: Mapping[str, tuple[float, float]], suffix: str = "_z") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": scaled(c, moments) for c in moments})
