"""Predictions matched with what came later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerolith.operators.chunks import CHUNK, SeriesSpec, with_chunk


def match_later(predictions: DataFrame, observations: DataFrame, spec: SeriesSpec, *, at: str, value: str, tolerance_hours: float) -> DataFrame:
    """Each prediction with the first observation at or after its time ``at``, if it comes within the tolerance.

    Adds ``observed_at`` and ``observed``. Observations without a value do not count; of several at one time
    the highest counts. Predictions without key or time stay, unmatched; repeated ones each find theirs.

    Both tables go through chunks of time together, so no range of one is joined with the other: a prediction looks
    forward in its chunk, and beyond it to the first observation of the next chunk that has one.
    """
    keys, ts = list(spec.keys), spec.ts
    whole = F.struct(*[F.col(c) for c in predictions.columns]).alias("_p")
    none = F.lit(None)
    asked = predictions.select(*keys, F.col(at).alias(ts), none.cast("double").alias("_v"), whole)
    seen = observations.select(*keys, ts, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    both = with_chunk(asked.unionByName(seen, allowMissingColumns=True), spec)
    # Newest first; at equal times observations come first, so a prediction sees its own hour.
    w = W.partitionBy(*spec.chunk_keys).orderBy(F.col(ts).desc(), F.col("_v").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    point = F.when(F.col("_v").isNotNull(), F.struct(F.col(ts).alias("t"), F.col("_v").alias("v")))
    rows = both.withColumn("_next", F.last(point, ignorenulls=True).over(w))
    firsts = seen.select(*keys, ts, "_v").transform(lambda d: with_chunk(d, spec)).groupBy(*spec.chunk_keys).agg(F.min(F.struct(F.col(ts).alias("t"), (-F.col("_v")).alias("v"))).alias("_first"))
    firsts = firsts.withColumn("_first", F.struct(F.col("_first.t").alias("t"), (-F.col("_first.v")).alias("v")))
    chunks = both.select(*spec.chunk_keys).distinct().join(firsts, spec.chunk_keys, "left")
    later = W.partitionBy(*keys).orderBy(F.col(CHUNK).desc()).rowsBetween(W.unboundedPreceding, -1)
    ahead = chunks.select(*spec.chunk_keys, F.last("_first", ignorenulls=True).over(later).alias("_ahead"))
    found = rows.filter(F.col("_p").isNotNull()).join(ahead, spec.chunk_keys, "left").withColumn("_hit", F.coalesce("_next", "_ahead"))
    near = F.unix_micros("_hit.t") - F.unix_micros(ts) <= F.lit(round(tolerance_hours * 3_600_000_000))
    hit = F.when(near, F.col("_hit"))
    matched = found.select("_p.*", hit.getField("t").alias("observed_at"), hit.getField("v").alias("observed"))
    lost = F.lit(False)
    for c in (*keys, at):
        lost = lost | F.col(c).isNull()
    return matched.unionByName(predictions.filter(lost).withColumn("observed_at", none.cast("timestamp")).withColumn("observed", none.cast("double")))


def error_report(matched: DataFrame, spec: SeriesSpec, *, at: str, predicted: str) -> DataFrame:
    """(keys, day, predictions, matched, mae, rmse, bias, mean_age_hours) by series and day of the predicted time.

    Age is the time from the predicted hour to the observation it was matched with.
    """
    error = F.col(predicted) - F.col("observed")
    age = (F.unix_micros("observed_at") - F.unix_micros(at)) / 3_600_000_000
    return matched.groupBy(*spec.keys, F.to_date(at).alias("day")).agg(
        F.count("*").alias("predictions"),
        F.count("observed").alias("matched"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(error).alias("bias"),
        F.avg(age).alias("mean_age_hours"),
    )


def freshness(df: DataFrame, spec: SeriesSpec, value: str, as_of) -> DataFrame:
    """(keys, newest, age_hours, newest_value_at, value_age_hours): how old the newest row and the newest known value are."""
    hours = lambda t: (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(t)) / 3_600_000_000
    newest = df.groupBy(*spec.keys).agg(F.max(spec.ts).alias("newest"), F.max(F.when(F.col(value).isNotNull(), F.col(spec.ts))).alias("newest_value_at"))
    return newest.select(*spec.keys, "newest", hours(F.col("newest")).alias("age_hours"), "newest_value_at", hours(F.col("newest_value_at")).alias("value_age_hours"))
