"""Drift of columns between a reference period and a current one, per series.

Both measures come from counts of equal values, so copies cost one row. Distinct values are cut into ranges
of about a million as in :mod:`aerolith.operators.ranks`; a series or column with most of the rows is
ordered in many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerolith.operators.chunks import SeriesSpec
from aerolith.operators.ranks import BIN_VALUES, exact_quantiles, unpivot
from aerolith.session import stage

#: Share that an empty bin counts as, so that its logarithm stays finite.
LEAST_SHARE = 1e-4


def reference_edges(reference: DataFrame, columns: Sequence[str], bins: int = 10) -> dict[str, list[float]]:
    """Inner edges of equal-frequency bins of each column; to be stored with the model that was trained on it.

    Columns x edges reach the driver. Equal edges are merged; a column without values has none.
    """
    rows = exact_quantiles(reference, columns, [i / bins for i in range(1, bins)]).collect()
    edges: dict[str, set[float]] = {c: set() for c in columns}
    for r in rows:
        edges[r.feature].add(r["quantile"])
    return {c: sorted(v) for c, v in edges.items()}


def period_counts(df: DataFrame, spec: SeriesSpec, columns: Sequence[str], current: Column) -> DataFrame:
    """(keys, feature, x, n_ref, n_cur): copies of each value in both periods. Nulls and NaN are left out."""
    long = unpivot(df, columns, [*spec.keys, F.coalesce(current, F.lit(False)).alias("_current")])
    known = long.filter(F.col("x").isNotNull() & ~F.isnan("x"))
    return known.groupBy(*spec.keys, "feature", "x").agg(F.count_if(~F.col("_current")).alias("n_ref"), F.count_if("_current").alias("n_cur"))


def ks_distance(counts: DataFrame, spec: SeriesSpec, bin_values: int = BIN_VALUES) -> DataFrame:
    """(keys, feature, n_ref, n_cur, ks_distance) from :func:`period_counts`; null where a period is empty.

    The largest distance of both distribution functions, over all values. ``counts`` should be staged
    if it is dear: the number of values and the values are two passes.
    """
    of = [*spec.keys, "feature"]
    bins = max(1, -(-counts.count() // bin_values))
    if bins > 1:
        ranged = stage(counts.repartitionByRange(bins, *of, "x").withColumn("_bin", F.spark_partition_id()))
    else:
        ranged = counts.withColumn("_bin", F.lit(0))
    earlier = W.partitionBy(*of).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*of)
    sums = ranged.groupBy(*of, "_bin").agg(F.sum("n_ref").alias("_r"), F.sum("n_cur").alias("_c"))
    sums = sums.select(
        *of,
        "_bin",
        F.coalesce(F.sum("_r").over(earlier), F.lit(0)).alias("_r_before"),
        F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_c_before"),
        F.sum("_r").over(whole).alias("_r_all"),
        F.sum("_c").over(whole).alias("_c_all"),
    )
    inside = W.partitionBy(*of, "_bin").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    upto = ranged.select(*of, "_bin", F.sum("n_ref").over(inside).alias("_r"), F.sum("n_cur").over(inside).alias("_c"))
    # Within a range only the largest and the smallest difference can count; they are taken before ranges meet.
    gap = (F.col("_r_before") + F.col("_r")) / F.col("_r_all") - (F.col("_c_before") + F.col("_c")) / F.col("_c_all")
    gap = F.when((F.col("_r_all") > 0) & (F.col("_c_all") > 0), F.abs(gap))
    joined = upto.join(sums, [*of, "_bin"])
    return joined.groupBy(*of).agg(F.max("_r_all").alias("n_ref"), F.max("_c_all").alias("n_cur"), F.max(gap).alias("ks_distance"))


def stability_index(counts: DataFrame, spec: SeriesSpec, edges: Mapping[str, Sequence[float]], least: float = LEAST_SHARE) -> DataFrame:
    """(keys, feature, stability_index): sum of (p - q) ln(p / q) over the fixed bins; p current, q reference share.

    A share below ``least`` counts as ``least``. Null where a period has no value of the column.
    """
    bin_of = F.lit(None).cast("int")
    for c, cuts in edges.items():
        above = F.lit(0)
        for e in cuts:
            above = above + (F.col("x") > float(e)).cast("int")
        bin_of = F.when(F.col("feature") == c, above).otherwise(bin_of)
    of = [*spec.keys, "feature"]
    # Bins are few: they are added up in the map tasks, whatever the number of rows.
    binned = counts.withColumn("_b", bin_of).filter(F.col("_b").isNotNull()).groupBy(*of, "_b").agg(F.sum("n_ref").alias("_r"), F.sum("n_cur").alias("_c"))
    whole = W.partitionBy(*of)
    shared = binned.withColumn("_r_all", F.sum("_r").over(whole)).withColumn("_c_all", F.sum("_c").over(whole))
    both = (F.col("_r_all") > 0) & (F.col("_c_all") > 0)
    p = F.greatest(F.col("_c") / F.nullif(F.col("_c_all"), F.lit(0)), F.lit(least))
    q = F.greatest(F.col("_r") / F.nullif(F.col("_r_all"), F.lit(0)), F.lit(least))
    return shared.groupBy(*of).agg(F.sum(F.when(both, (p - q) * F.log(p / q))).alias("stability_index"))


def drift_report(df: DataFrame, spec: SeriesSpec, since, edges: Mapping[str, Sequence[float]], bin_values: int = BIN_VALUES) -> DataFrame:
    """Kolmogorov-Smirnov distance and stability index of each column of ``edges``, rows before ``since`` against those from it on.

    (keys, feature, n_ref, n_cur, ks_distance, stability_index). The rows are counted in one pass and one
    shuffle; all else works on distinct values.
    """
    counts = stage(period_counts(df, spec, list(edges), F.col(spec.ts) >= F.lit(since).cast("timestamp")))
    return ks_distance(counts, spec, bin_values).join(stability_index(counts, spec, edges), [*spec.keys, "feature"], "left")
