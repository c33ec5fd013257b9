"""Reports and checks of a dataset, each from one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions.risk import is_infinite
from aerolith.operators.chunks import SeriesSpec, frame_columns
from aerolith.schema import ENGINEERED, require_columns


def _unpivot(counts: DataFrame, columns: Sequence[str], parts: dict[str, Column | str], extra: Sequence[str] = ()) -> DataFrame:
    """One output row per column; ``parts`` maps an output name to a suffix of the aggregate."""
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}{suffix}").alias(name) for name, suffix in parts.items()])
            for c in columns
        ]
    )
    return counts.select(*extra, F.inline(rows))


def coverage(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Rows, earliest and latest time of each series."""
    return df.groupBy(*spec.keys).agg(
        F.count("*").alias("row_count"), F.min(spec.ts).alias("earliest"), F.max(spec.ts).alias("latest")
    )


def column_presence(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """(column_name, present, known_count): the required columns in their order, with null counts for missing ones.

    The report form of :func:`aerolith.schema.require_columns`, which raises before any job.
    """
    counts = df.agg(*[(F.count(c) if c in df.columns else F.lit(None).cast("long")).alias(f"_{i}") for i, c in enumerate(required)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(c in df.columns).alias("present"), F.col(f"_{i}").alias("known_count")) for i, c in enumerate(required)])
    return counts.select(F.inline(rows))


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, null_count, null_pct)."""
    counts = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns],
    )
    table = _unpivot(counts, columns, {"null_count": "_nulls"}, ["_rows"])
    return table.withColumn("null_pct", F.col("null_count") * 100.0 / F.col("_rows")).drop("_rows")


def dataset_report(df: DataFrame, columns: Sequence[str], ts: str = "datetime") -> DataFrame:
    """Null report with row count and time range of the whole dataset on every row."""
    require_columns(df, [ts, *columns])
    counts = df.agg(
        F.count("*").alias("row_count"),
        F.min(ts).alias("earliest"),
        F.max(ts).alias("latest"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns],
    )
    table = _unpivot(counts, columns, {"null_count": "_nulls"}, ["row_count", "earliest", "latest"])
    return table.withColumn("null_pct", F.col("null_count") * 100.0 / F.col("row_count"))


def column_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, min_value, mean_value, max_value, null_count, inf_count)."""
    counts = df.agg(
        *[F.min(c).alias(f"{c}_min") for c in columns],
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.max(c).alias(f"{c}_max") for c in columns],
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns],
        *[F.count_if(is_infinite(F.col(c))).alias(f"{c}_infs") for c in columns],
    )
    parts = {
        "min_value": "_min",
        "mean_value": "_mean",
        "max_value": "_max",
        "null_count": "_nulls",
        "inf_count": "_infs",
    }
    return _unpivot(counts, columns, parts)


def before_after(raw: DataFrame, clean: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row and null totals of a table before and after cleaning."""

    def totals(df: DataFrame, stage: str) -> DataFrame:
        nulls = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0))
        infs = sum((F.count_if(is_infinite(F.col(c))) for c in columns), F.lit(0))
        return df.agg(F.count("*").alias("row_count"), nulls.alias("null_total"), infs.alias("inf_total")).withColumn(
            "stage", F.lit(stage)
        )

    return totals(raw, "raw").unionByName(totals(clean, "clean"))


def unsorted_count(df: DataFrame, spec: SeriesSpec, arrival: str) -> DataFrame:
    """Rows whose time is before that of the previous row in ``arrival`` order, per series.

    ``arrival`` must be a number rising with storage order; it is cut into chunks like time.
    """
    ordered = df.select(*spec.keys, F.timestamp_seconds(arrival).alias("_arrival"), F.col(spec.ts).alias("_t"))
    by_arrival = SeriesSpec(spec.keys, "_arrival", spec.chunk_hours)
    rows = frame_columns(ordered, by_arrival, ["_t"], lambda w: {"_prev": F.lag("_t").over(w)}, before=1)
    return rows.groupBy(*spec.keys).agg(F.count_if(F.col("_prev") > F.col("_t")).alias("unsorted_count"))


def feature_report(df: DataFrame, spec: SeriesSpec, columns: Sequence[str] = tuple(ENGINEERED)) -> DataFrame:
    """Per series: rows, duplicate times, null and infinite cells."""
    require_columns(df, columns)
    nulls = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in columns), F.lit(0))
    infs = sum((is_infinite(F.col(c)).cast("int") for c in columns), F.lit(0))
    per_time = df.groupBy(*spec.keys, spec.ts).agg(
        F.count("*").alias("_n"), F.sum(nulls).alias("_nulls"), F.sum(infs).alias("_infs")
    )
    return per_time.groupBy(*spec.keys).agg(
        F.sum("_n").alias("row_count"),
        F.sum(F.col("_n") - 1).alias("duplicate_count"),
        F.sum("_nulls").alias("null_cells"),
        F.sum("_infs").alias("inf_cells"),
    )


def check_features(df: DataFrame, spec: SeriesSpec, columns: Sequence[str] = tuple(ENGINEERED)) -> DataFrame:
    """:func:`feature_report`, raising when any series breaks a rule."""
    report = feature_report(df, spec, columns)
    broken = report.filter((F.col("duplicate_count") > 0) | (F.col("null_cells") > 0) | (F.col("inf_cells") > 0))
    bad = broken.limit(5).collect()
    if bad:
        raise ValueError(f"feature table breaks its rules, for example: {[r.asDict() for r in bad]}")
    return report
