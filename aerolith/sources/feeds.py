"""Landed JSON responses turned into observation rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions.calendar import hour_of
from aerolith.operators.chunks import SeriesSpec
from aerolith.operators.clean import drop_duplicate_times
from aerolith.schema import (
    CURRENT_DEFAULTS,
    FALLBACK_WEATHER,
    MEASURES,
    POLLUTANT_FEED_NAMES,
    POLLUTANTS,
    TS,
    WEATHER,
)


def parse_hourly(df: DataFrame, fields: Sequence[str], payload: str = "payload", rename: Mapping[str, str] | None = None) -> DataFrame:
    """``{"hourly": {"time": [...], field: [...]}}`` as one row per time; other columns are kept."""
    layout = ", ".join(["time array<string>", *[f"{f} array<double>" for f in fields]])
    keep = [c for c in df.columns if c != payload]
    parsed = df.select(*keep, F.from_json(payload, f"hourly struct<{layout}>")["hourly"].alias("_h"))
    # A field the payload lacks is padded with nulls.
    none = {f: F.array().cast("array<string>" if f == "time" else "array<double>") for f in ("time", *fields)}
    zipped = F.arrays_zip(*[F.coalesce(F.col(f"_h.{f}"), empty).alias(f) for f, empty in none.items()])
    rows = parsed.select(*keep, F.inline(zipped))
    return rows.withColumn("time", F.try_to_timestamp("time")).withColumnsRenamed({"time": TS, **(rename or {})})


def parse_weather(df: DataFrame, payload: str = "payload") -> DataFrame:
    return parse_hourly(df, WEATHER, payload)


def parse_air_quality(df: DataFrame, payload: str = "payload") -> DataFrame:
    return parse_hourly(df, list(POLLUTANT_FEED_NAMES), payload, POLLUTANT_FEED_NAMES)


def _current(df: DataFrame, names: Mapping[str, str], payload: str) -> DataFrame:
    keep = [c for c in df.columns if c != payload]
    layout = ", ".join(f"{n} double" for n in names)
    body = F.from_json(payload, f"current struct<{layout}>")["current"]
    return df.select(*keep, body.alias("_c")).select(
        *keep,
        *[F.coalesce(F.col(f"_c.{feed}"), F.lit(CURRENT_DEFAULTS[name])).alias(name) for feed, name in names.items()],
    )


def parse_current_weather(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Current observation; a field that is absent or null takes its default."""
    return _current(df, {c: c for c in WEATHER}, payload)


def parse_current_air_quality(df: DataFrame, payload: str = "payload") -> DataFrame:
    return _current(df, POLLUTANT_FEED_NAMES, payload)


def parse_secondary(df: DataFrame, payload: str = "payload") -> DataFrame:
    """``{"list": [{"components": {...}}]}``: pollutants of the first entry, 0 where absent.

    A payload without an entry gives null values (no reading).
    """
    keep = [c for c in df.columns if c != payload]
    layout = ", ".join(f"{c} double" for c in POLLUTANTS)
    entry = F.get(F.from_json(payload, f"list array<struct<components: struct<{layout.replace(' double', ': double')}>>>")["list"], F.lit(0))
    parts = df.select(*keep, entry["components"].alias("_c"))
    return parts.select(*keep, *[F.when(F.col("_c").isNotNull(), F.coalesce(F.col(f"_c.{c}"), F.lit(0.0))).alias(c) for c in POLLUTANTS])


def combine_current(weather: DataFrame, air: DataFrame, spec: SeriesSpec, seen: str = "fetched_at") -> DataFrame:
    """Join both current feeds on (keys, hour); the time is cut to the hour."""

    def hourly(df: DataFrame) -> DataFrame:
        return drop_duplicate_times(df.withColumn(spec.ts, hour_of(F.col(seen))).drop(seen), spec)

    return hourly(weather).join(hourly(air), [*spec.keys, spec.ts]).select(*spec.keys, spec.ts, *MEASURES)


def with_fallback(primary: DataFrame, secondary: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Primary rows; where a (keys, ts) has none, secondary pollutants with fixed weather."""
    on = [*spec.keys, spec.ts]
    first = primary.select(*on, *[F.col(c).alias(f"_1_{c}") for c in MEASURES], F.lit(True).alias("_primary"))
    second = secondary.select(*on, *[F.col(c).alias(f"_2_{c}") for c in POLLUTANTS])

    def chosen(c: str) -> Column:
        other = F.col(f"_2_{c}") if c in POLLUTANTS else F.lit(FALLBACK_WEATHER[c])
        return F.when(F.col("_primary"), F.col(f"_1_{c}")).otherwise(other).alias(c)

    rows = first.join(second, on, "full_outer").withColumn("_primary", F.coalesce("_primary", F.lit(False)))
    return rows.select(*on, *[chosen(c) for c in MEASURES], F.when(F.col("_primary"), "primary").otherwise("secondary").alias("source"))


def merge_feeds(weather: DataFrame, air: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Inner join of both feeds on (keys, ts), one row each.

    Each side is made unique first: copies of a time never multiply in the join.
    """
    left, right = drop_duplicate_times(weather, spec), drop_duplicate_times(air, spec)
    return left.join(right, [*spec.keys, spec.ts])


def within_days(df: DataFrame, as_of: str, days: int = 24 * 30, ts: str = TS) -> DataFrame:
    """Rows of the ``days`` days up to and including the date ``as_of``; a plain range for pushdown."""
    end = F.lit(as_of).cast("date")
    low = F.date_sub(end, days).cast("timestamp")
    high = F.date_add(end, 1).cast("timestamp")
    return df.filter((F.col(ts) >= low) & (F.col(ts) < high))


def pack_hourly(df: DataFrame, spec: SeriesSpec, fields: Mapping[str, str]) -> DataFrame:
    """One landed payload per series and day, the inverse of :func:`parse_hourly`.

    A day of one series holds at most 24 hours.
    """
    # Nulls stay in place as null entries of the arrays.
    row = F.struct(F.date_format(spec.ts, "yyyy-MM-dd'T'HH:mm").alias("time"), *[F.col(c).alias(feed) for c, feed in fields.items()])
    days = df.groupBy(*spec.keys, F.to_date(spec.ts).alias("day")).agg(F.array_sort(F.collect_list(row)).alias("_r"))
    body = F.struct(*[F.col("_r").getField(n).alias(n) for n in ("time", *fields.values())])
    return days.select(*spec.keys, F.to_json(F.struct(body.alias("hourly"))).alias("payload"))


def newest_per_series(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Newest row of each series as one partial aggregation."""
    rest = [c for c in df.columns if c not in spec.keys]
    return df.groupBy(*spec.keys).agg(F.max_by(F.struct(*rest), spec.ts).alias("_row")).select(*spec.keys, "_row.*")

