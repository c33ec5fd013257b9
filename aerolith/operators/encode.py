"""Target encoding of categories in which a row only sees what was known before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerolith.operators.chunks import CHUNK, SeriesSpec
from aerolith.session import stage


def _before(rows: DataFrame, keys: Sequence[str], ts: str, chunk_hours: int) -> DataFrame:
    """(keys, ts, n, s -> _n, _s): counts and sums of all strictly earlier times, from one row for each (keys, ts)."""
    spec = SeriesSpec(keys=tuple(keys), ts=ts, chunk_hours=chunk_hours)
    placed = rows.withColumn(CHUNK, spec.chunk_id())
    before = lambda order: W.partitionBy(*keys, *([CHUNK] if order == ts else [])).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    chunks = placed.groupBy(*keys, CHUNK).agg(F.sum("n").alias("_cn"), F.sum("s").alias("_cs"))
    chunks = chunks.select(*keys, CHUNK, *[F.coalesce(F.sum(c).over(before(CHUNK)), F.lit(0)).alias(c) for c in ("_cn", "_cs")])
    inside = placed.select(*keys, ts, CHUNK, *[F.coalesce(F.sum(c).over(before(ts)), F.lit(0)).alias(f"_in_{c}") for c in ("n", "s")])
    return inside.join(chunks, [*keys, CHUNK]).select(*keys, ts, (F.col("_in_n") + F.col("_cn")).alias("_n"), (F.col("_in_s") + F.col("_cs")).alias("_s"))


def encode_by_target(df: DataFrame, categories: Sequence[str], target: str, *, ts: str = "datetime", weight: float = 20.0, suffix: str = "_encoded", chunk_hours: int = 720) -> DataFrame:
    """Adds ``<category>_encoded``: the smoothed mean target of the category's rows at strictly earlier times.

    (sum of earlier targets of the category + weight x m) / (their count + weight), where m is the mean of all
    earlier targets; null before any target is known. Rows of one time do not see each other, whatever the
    order they come in. A null category is one of its own; a row without a time gets null; a null target
    teaches nothing.

    Rows are first added up by (category, time), so a category that holds most rows is small before it
    is ordered; its times are cut into chunks whose sums are scanned in order.
    """
    times = df.filter(F.col(ts).isNotNull())
    sums = [F.count(target).alias("n"), F.coalesce(F.sum(F.col(target).cast("double")), F.lit(0.0)).alias("s")]
    # Every time takes part; those without a target add nothing.
    everywhere = stage(times.groupBy(ts).agg(*sums))
    overall = _before(everywhere.withColumn("_all", F.lit(1)), ["_all"], ts, chunk_hours)
    overall = overall.select(F.col(ts).alias("_t"), (F.col("_s") / F.nullif(F.col("_n"), F.lit(0))).alias("_m"))
    out = df.join(overall, df[ts] == overall["_t"], "left").drop("_t")
    for c in categories:
        label = F.coalesce(F.col(c).cast("string"), F.lit("\0null"))
        groups = times.select(label.alias("_c"), ts, target).groupBy("_c", ts).agg(*sums)
        earlier = _before(groups, ["_c"], ts, chunk_hours).withColumnRenamed(ts, "_t")
        value = (F.coalesce(F.col("_s"), F.lit(0.0)) + F.lit(float(weight)) * F.col("_m")) / (F.coalesce(F.col("_n"), F.lit(0)) + F.lit(float(weight)))
        out = out.withColumn("_label", label)
        out = out.join(earlier, (F.col("_label") == earlier["_c"]) & (F.col(ts) == earlier["_t"]), "left")
        out = out.withColumn(f"{c}{suffix}", value).drop("_c", "_t", "_n", "_s", "_label")
    return out.drop("_m")
