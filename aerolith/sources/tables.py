"""Typed scans and plain sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.operators.chunks import SeriesSpec
from aerolith.schema import CITY, OBSERVATION, observation_schema, restore_columns, sanitize_columns


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {list(paths)} exists")


def read_observations(spark: SparkSession, *paths: str, keys: Sequence[str] = (CITY,), fmt: str = "parquet") -> DataFrame:
    """The first existing of ``paths``, typed. CSV may carry display names; times are UTC."""
    path = first_existing(spark, paths)
    if fmt == "parquet":
        return spark.read.schema(observation_schema(keys)).parquet(path)
    head = spark.read.option("header", True).csv(path)
    text = T.StructType([T.StructField(c, T.StringType()) for c in head.columns])
    plain, _ = sanitize_columns(spark.read.schema(text).option("header", True).csv(path))
    types = {f.name: f.dataType for f in observation_schema(keys)}
    cast = {
        c: F.try_to_timestamp(c) if isinstance(types[c], T.TimestampType) else F.col(c).try_cast(types[c])
        for c in plain.columns
        if c in types
    }
    return plain.withColumns(cast)


def write_observations(df: DataFrame, path: str, *, keys: Sequence[str] = (CITY,), fmt: str = "parquet") -> None:
    """Replace a table, columns in canonical order."""
    ordered = df.select(*[k for k in keys if k in df.columns], *OBSERVATION)
    if fmt == "csv":
        restore_columns(ordered).write.mode("overwrite").option("header", True).csv(path)
    else:
        ordered.write.mode("overwrite").parquet(path)


def write_latest_json(latest: DataFrame, path: str) -> None:
    latest.write.mode("overwrite").json(path)


def write_feature_list(ranked: DataFrame, path: str, k: int = 18) -> None:
    """Names of the ``k`` best features as text, one per line, best first."""
    best = ranked.filter(F.col("overall_rank") <= k).orderBy("overall_rank").select("feature")
    best.coalesce(1).write.mode("overwrite").text(path)


def raw_subset(df: DataFrame, columns: Sequence[str], spec: SeriesSpec) -> DataFrame:
    """Keys, time and the named raw columns."""
    return df.select(*spec.keys, spec.ts, *columns)
