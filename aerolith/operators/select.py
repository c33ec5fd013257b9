"""Feature scores put together, ranked and cut to the top k."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerolith.operators import stats
from aerolith.operators.forest import binned, fit_forest
from aerolith.session import discard, stage

# Weights of the four normalised scores.
SCORE_WEIGHTS = {"norm_pearson": 0.30, "norm_spearman": 0.20, "norm_mi": 0.25, "norm_tree": 0.25}


def tree_importance(
    df: DataFrame, columns: Sequence[str], target: str, *, trees: int = 100, depth: int = 12, seed: int = 42
) -> DataFrame:
    """(feature, rf_importance, et_importance, avg_tree_importance) from two forests.

    The second forest sees all rows and a third of the columns per split, the nearest Spark ML
    comes to fully random trees.
    """
    rows = stage(df.select(*columns, target).dropna("any"))
    prepared = binned(rows, columns, target)
    kinds = [{"subset": "all"}, {"subset": "onethird", "bootstrap": False}]
    # Side by side: while one forest waits for its last tasks the other uses the cluster.
    with ThreadPoolExecutor(len(kinds)) as pool:
        bagged, random = pool.map(lambda kind: fit_forest(rows, columns, target, trees=trees, depth=depth, seed=seed, prepared=prepared, **kind).featureImportances.toArray(), kinds)
    discard(rows, prepared.blocks)
    table = [(c, float(a), float(b), float(a + b) / 2) for c, a, b in zip(columns, bagged, random, strict=True)]
    return df.sparkSession.createDataFrame(
        table, "feature string, rf_importance double, et_importance double, avg_tree_importance double"
    )


def consolidate_scores(
    pearson: DataFrame, spearman: DataFrame, mutual: DataFrame, trees: DataFrame, inflation: DataFrame
) -> DataFrame:
    """Join the five score tables, scale by their maxima, weight and rank.

    All tables hold one row per feature.
    """
    table = pearson
    for other in (spearman, mutual, trees, inflation):
        table = table.join(other, "feature")
    whole = W.partitionBy()
    parts = {
        "norm_pearson": "abs_pearson_r",
        "norm_spearman": "abs_spearman_rho",
        "norm_mi": "mi_score",
        "norm_tree": "avg_tree_importance",
    }
    table = table.withColumns({name: F.coalesce(F.try_divide(F.col(c), F.max(c).over(whole)), F.lit(0.0)) for name, c in parts.items()})
    score = sum((F.lit(w) * F.col(name) for name, w in SCORE_WEIGHTS.items()), F.lit(0.0))
    table = table.withColumn("composite_score", score)
    order = W.orderBy(F.col("composite_score").desc(), F.col("feature"))
    return table.withColumn("overall_rank", F.row_number().over(order))


def top_features(ranked: DataFrame, k: int = 18) -> list[str]:
    """Names of the ``k`` best features, best first."""
    best = ranked.filter(F.col("overall_rank") <= k).select("overall_rank", "feature").collect()
    return [r.feature for r in sorted(best, key=lambda r: r.overall_rank)]


def score_features(
    df: DataFrame, columns: Sequence[str], target: str, *, trees: int = 100, depth: int = 12, seed: int = 42
) -> DataFrame:
    """All scores of all features of one (staged) feature table."""
    cells = stage(stats.target_cells(df, columns, target))
    return consolidate_scores(
        stats.pearson_with_target(df, columns, target),
        stats.spearman_with_target(df, columns, target, cells),
        stats.mutual_information(df, columns, target, cells=cells),
        tree_importance(df, columns, target, trees=trees, depth=depth, seed=seed),
        stats.variance_inflation(df, columns),
    )
