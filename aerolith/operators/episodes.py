"""Spike episodes: stretches in which a running sum of excess, reset at zero, stays above zero.

The score of a row is max(0, score of the row before + value - level). Steps of that kind compose: what a
chunk does to any score coming in is told by its total and by the lowest point of its running sum. So chunks
are summed up side by side, the summaries are scanned in order, and the scores of a chunk follow from
what comes in. Scores are kept in whole millionths: sums agree in any order, and a reset is exactly 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerolith.operators.chunks import CHUNK, SeriesSpec, with_chunk

UNIT = 1_000_000


def excess_scores(df: DataFrame, spec: SeriesSpec, value: str, level: float, name: str = "score") -> DataFrame:
    """Adds the score, and ``_start`` (the row that leaves 0), ``_chunk`` and the running count of starts in the chunk.

    A row without a value leaves the score as it is.
    """
    step = F.coalesce(F.round((F.col(value) - F.lit(float(level))) * UNIT).cast("long"), F.lit(0))
    w = spec.in_chunk()
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = with_chunk(df, spec).withColumn("_sum", F.sum(step).over(upto)).withColumn("_low", F.min("_sum").over(upto))
    ends = rows.groupBy(*spec.chunk_keys).agg(F.max_by("_sum", spec.ts).alias("_total"), F.min("_low").alias("_least"))
    before = spec.over_chunks().rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("_ahead", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    ends = ends.withColumn("_in", F.col("_ahead") - F.least(F.lit(0), F.min(F.col("_ahead") + F.col("_least")).over(before)))
    rows = rows.join(ends.select(*spec.chunk_keys, "_in"), spec.chunk_keys, "left")
    rows = rows.withColumn("_score", F.col("_sum") - F.least(-F.col("_in"), F.col("_low")))
    rows = rows.withColumn("_start", (F.col("_score") > 0) & (F.coalesce(F.lag("_score").over(w), F.col("_in")) == 0))
    rows = rows.withColumn("_starts", F.sum(F.col("_start").cast("long")).over(upto))
    return rows.withColumn(name, F.col("_score") / UNIT).drop("_sum", "_low", "_in", "_score")


def episodes(df: DataFrame, spec: SeriesSpec, value: str, *, level: float, threshold: float) -> DataFrame:
    """(keys, started, ended, rows, peak_score, peak_value, peak_time) of every stretch whose score exceeds ``threshold``.

    A stretch runs from the row that leaves 0 to the last one before 0. ``peak_time`` is the first time of
    the highest value. An episode of any length is added up in the map tasks first.
    """
    rows = excess_scores(df.select(*spec.keys, spec.ts, value), spec, value, level)
    starts = rows.groupBy(*spec.chunk_keys).agg(F.max("_starts").alias("_n"))
    before = spec.over_chunks().rowsBetween(W.unboundedPreceding, -1)
    offsets = starts.select(*spec.chunk_keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    open_rows = rows.join(offsets, spec.chunk_keys, "left").filter(F.col("score") > 0)
    peak = F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), (-F.unix_micros(spec.ts)).alias("t")))).alias("_peak")
    found = open_rows.groupBy(*spec.keys, (F.col("_offset") + F.col("_starts")).alias("_episode")).agg(
        F.min(spec.ts).alias("started"), F.max(spec.ts).alias("ended"), F.count("*").alias("rows"), F.max("score").alias("peak_score"), peak
    )
    over = found.filter(F.col("peak_score") > threshold)
    return over.select(*spec.keys, "started", "ended", "rows", "peak_score", F.col("_peak.v").alias("peak_value"), F.timestamp_micros(-F.col("_peak.t")).alias("peak_time"))


def highlighted(df: DataFrame, spec: SeriesSpec, value: str, *, level: float, threshold: float) -> DataFrame:
    """The rows of ``df`` with their score and ``is_spike`` (the score exceeds the threshold)."""
    rows = excess_scores(df, spec, value, level).drop("_start", "_starts", CHUNK)
    return rows.withColumn("is_spike", F.col("score") > threshold)
