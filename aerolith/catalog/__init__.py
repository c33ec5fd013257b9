"""Queries over the given tables, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.operators.chunks import SeriesSpec
from aerolith.operators.clean import clean_observations
from aerolith.operators.features import engineer_features
from aerolith.session import stage
from aerolith.sources import events as E
from aerolith.sources.tables import exists

Query = Callable[[SparkSession, str], DataFrame]

NUDGE = 3.3e-8

SPEC = SeriesSpec()
TYPE_SPEC = SeriesSpec(keys=("event_type",))


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name. ``sql`` is its comparison, or none."""

    def add(run: Query) -> Query:
        key = name or run.__name__
        if key in ENTRIES:
            raise ValueError(f"query {key} registered twice")
        ENTRIES[key] = Entry(lambda spark, sf_dir: settle(run(spark, sf_dir)), sql)
        return run

    return add


def settle(df: DataFrame) -> DataFrame:
    """Doubles to six decimals and times without zone, to compare across engines.

    The nudge keeps exact halves from hanging on the last bit of a sum.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[
            F.round(F.col(c) + NUDGE, 6).alias(c) if isinstance(t, (T.DoubleType, T.FloatType)) else F.col(c).cast("timestamp_ntz").alias(c) if isinstance(t, T.TimestampType) else F.col(c)
            for c, t in kinds.items()
        ]
    )


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def _stored(kind: str, spark: SparkSession, sf_dir: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table written once per session, as the jobs write theirs between steps."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _STORED or not exists(spark, _STORED[key]._stage_path):
        _STORED[key] = stage(build())
    return _STORED[key]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.read_events(spark, sf_dir)


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored("obs", spark, sf_dir, lambda: E.observations(events(spark, sf_dir)))


def h_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored("h_type", spark, sf_dir, lambda: E.hourly_by_type(events(spark, sf_dir)))


def h_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored("h_all", spark, sf_dir, lambda: E.hourly_means(events(spark, sf_dir), [F.lit("all").alias("city")]))


def h_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored("h_wide", spark, sf_dir, lambda: E.hourly_wide(events(spark, sf_dir)))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored("clean", spark, sf_dir, lambda: clean_observations(obs(spark, sf_dir), SPEC))


def feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored("feat", spark, sf_dir, lambda: engineer_features(clean(spark, sf_dir), SPEC))


def load_all() -> None:
    """Import the modules that register queries."""
    from importlib import import_module

    for module in ("ingest", "windows", "explore", "modelling", "streams", "monitor"):
        import_module(f"aerolith.catalog.{module}")
