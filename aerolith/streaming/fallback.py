"""The current feeds joined as they arrive, with a second source where the first does not come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.functions.calendar import hour_of
from aerolith.operators.chunks import SeriesSpec
from aerolith.schema import FALLBACK_WEATHER, MEASURES, POLLUTANTS


def _known(feed: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        feed = feed.filter(F.col(c).isNotNull())
    return feed


def live_combined(weather: DataFrame, air: DataFrame, spec: SeriesSpec, *, seen: str = "fetched_at", delay: str = "2 hours") -> DataFrame:
    """Both current feeds joined on (keys, hour), the first reading of each in an hour (of one micro-batch: any).

    The state of an hour goes once both feeds are ``delay`` past it. Rows without key or time are left out.
    """
    on = [*spec.keys, spec.ts]

    def hourly(feed: DataFrame) -> DataFrame:
        rows = _known(feed, *spec.keys, seen).withColumn(spec.ts, hour_of(F.col(seen))).drop(seen)
        return rows.withWatermark(spec.ts, delay).dropDuplicatesWithinWatermark(on)

    other = hourly(air).withColumnsRenamed({c: f"_a_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & (F.col(c) == F.col(f"_a_{c}"))
    return hourly(weather).join(other, same).select(*on, *MEASURES)


def live_fallback(primary: DataFrame, secondary: DataFrame, spec: SeriesSpec, *, seen: str = "fetched_at", delay: str = "2 hours") -> DataFrame:
    """Primary rows as they come; an hour without one takes the secondary pollutants with fixed weather.

    ``primary`` is the stream of :func:`live_combined`, ``secondary`` one of parsed second-source rows. They
    are joined where a secondary reading was taken within the hour of a primary row (the first reading of
    an hour counts). Primary rows with a partner come at once; an hour that lacks either side comes when
    both streams are past it by ``delay``. What arrives for it later is dropped. So every hour gives one
    row, the same as :func:`aerolith.sources.feeds.with_fallback` gives over all rows.
    """
    keys, ts = list(spec.keys), spec.ts
    readings = _known(secondary, *keys, seen).withWatermark(seen, delay).withColumn("_s_hour", hour_of(F.col(seen)))
    readings = readings.dropDuplicatesWithinWatermark([*keys, "_s_hour"])
    second = readings.select(*[F.col(c).alias(f"_s_{c}") for c in keys], "_s_hour", F.col(seen).alias("_s_seen"), *[F.col(c).alias(f"_2_{c}") for c in POLLUTANTS])
    first = primary.select(*keys, ts, *[F.col(c).alias(f"_1_{c}") for c in MEASURES], F.lit(True).alias("_primary"))
    # The hour spreads a series over tasks; the interval bounds how long either side must be kept. Keys come first, as
    # in what both sides are already dealt by, so that no row is shuffled again.
    on = F.lit(True)
    for c in keys:
        on = on & (F.col(c) == F.col(f"_s_{c}"))
    on = on & (F.col("_s_hour") == F.col(ts)) & (F.col("_s_seen") >= F.col(ts)) & (F.col("_s_seen") < F.col(ts) + F.expr("INTERVAL 1 HOUR"))
    both = first.join(second, on, "full_outer")
    found = F.coalesce(F.col("_primary"), F.lit(False))

    def chosen(c: str):
        other = F.col(f"_2_{c}") if c in POLLUTANTS else F.lit(FALLBACK_WEATHER[c])
        return F.when(found, F.col(f"_1_{c}")).otherwise(other).alias(c)

    where = [F.coalesce(F.col(c), F.col(f"_s_{c}")).alias(c) for c in keys] + [F.coalesce(F.col(ts), F.col("_s_hour")).alias(ts)]
    return both.select(*where, *[chosen(c) for c in MEASURES], F.when(found, "primary").otherwise("secondary").alias("source"))
