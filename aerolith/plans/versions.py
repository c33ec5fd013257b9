"""Stored model versions side by side: leaderboard, and whether one is truly better than another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerolith.plans.registry import ModelRegistry

#: Replicates drawn from one digest: 128 bits, 32 each.
_A_DIGEST = 4


def stored_leaderboard(registry: ModelRegistry) -> DataFrame:
    """(rank, model, version, rmse, mae, r2, is_champion) of all stored versions by their test error.

    A version saved more than once counts by its newest row. One row a version; no model is loaded.
    """
    newest = W.partitionBy("model_name", "version").orderBy(F.col("saved_at").desc())
    rows = registry.versions().withColumn("_r", F.row_number().over(newest)).filter("_r = 1")
    last = rows.agg(F.max(F.when(F.col("is_champion"), F.struct("saved_at", "version"))).alias("c"))
    metric = lambda m: F.try_element_at("metrics", F.lit(m)).alias(m.lower())
    listed = rows.crossJoin(last).select(  # one row on the right
        F.col("model_name").alias("model"), "version", metric("RMSE"), metric("MAE"), metric("R2"), (F.col("version") == F.col("c.version")).alias("is_champion")
    )
    order = W.partitionBy(F.lit(1)).orderBy(F.col("rmse").asc_nulls_last(), "model", "version")
    return listed.select(F.row_number().over(order).alias("rank"), "*")


def poisson_cuts(most: int = 12) -> list[float]:
    """P(X <= k) of a Poisson variable with mean 1, for k = 0, 1, ..."""
    from math import exp

    out, term, total = [], exp(-1), 0.0
    for k in range(most):
        total += term
        out.append(total)
        term /= k + 1
    return out


def resample_weight(digest: Column, word: Column) -> Column:
    """Poisson(1) weight from 32 bits of an md5 digest: the number of cuts that the bits, as a share, reach."""
    share = F.conv(F.substring(digest, word * 8 + 1, F.lit(8)), 16, 10).cast("long") / F.lit(float(2**32))
    weight = F.lit(0)
    for cut in poisson_cuts():
        weight = weight + (share >= cut).cast("int")
    return weight


def resampled_errors(scored: DataFrame, row_key: Column, actual: str, predictions: Sequence[str], replicates: int = 200, seed: str = "1") -> DataFrame:
    """(replicate, weight, <p>_rmse, <p>_mae ...): errors of each prediction column in each resample of the rows.

    Row i counts Poisson(1) times in a replicate, drawn from the md5 of ``seed``, replicate and ``row_key``, so
    all predictions see the same resample (paired) and reruns agree. Rows without actual value or a prediction
    are left out. All replicates are one aggregation: rows are spread over replicates and added up in
    the map tasks; replicates x columns numbers are shuffled a task.
    """
    known = F.col(actual).isNotNull()
    for p in predictions:
        known = known & F.col(p).isNotNull()
    errors = [(F.col(p) - F.col(actual)).alias(f"_e{k}") for k, p in enumerate(predictions)]
    rows = scored.filter(known).select(row_key.cast("string").alias("_key"), *errors)
    blocks = -(-replicates // _A_DIGEST)
    spread = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    spread = spread.withColumn("_digest", F.md5(F.concat_ws("/", F.lit(seed), F.col("_block").cast("string"), "_key")))
    spread = spread.withColumn("_word", F.explode(F.array(*[F.lit(k) for k in range(_A_DIGEST)])))
    spread = spread.select((F.col("_block") * _A_DIGEST + F.col("_word")).alias("replicate"), resample_weight(F.col("_digest"), F.col("_word")).alias("_w"), *[f"_e{k}" for k in range(len(predictions))])
    drawn = spread.filter((F.col("replicate") < replicates) & (F.col("_w") > 0))
    sums = drawn.groupBy("replicate").agg(
        F.sum("_w").alias("weight"),
        *[F.sum(F.col("_w") * F.col(f"_e{k}") * F.col(f"_e{k}")).alias(f"_s{k}") for k in range(len(predictions))],
        *[F.sum(F.col("_w") * F.abs(f"_e{k}")).alias(f"_a{k}") for k in range(len(predictions))],
    )
    made = [c for k, p in enumerate(predictions) for c in (F.sqrt(F.col(f"_s{k}") / F.col("weight")).alias(f"{p}_rmse"), (F.col(f"_a{k}") / F.col("weight")).alias(f"{p}_mae"))]
    return sums.select("replicate", "weight", *made)


def compared_predictions(scored: DataFrame, row_key: Column, actual: str, old: str, new: str, *, replicates: int = 200, level: float = 0.9, seed: str = "1") -> DataFrame:
    """One row: difference in error of ``new`` against ``old`` with its interval over paired resamples.

    (rmse_change, rmse_change_low, rmse_change_high, mae_change_low, mae_change_high, share_better, replicates).
    Negative is better; ``share_better`` is the share of resamples in which the new one has the lower rmse.
    rmse_change itself is over the rows as they are. Without rows all are null.
    """
    drawn = resampled_errors(scored, row_key, actual, [old, new], replicates, seed)
    tail = (1 - level) / 2
    change = lambda m: F.col(f"{new}_{m}") - F.col(f"{old}_{m}")
    spread = drawn.agg(
        F.percentile(change("rmse"), F.lit(tail)).alias("rmse_change_low"),
        F.percentile(change("rmse"), F.lit(1 - tail)).alias("rmse_change_high"),
        F.percentile(change("mae"), F.lit(tail)).alias("mae_change_low"),
        F.percentile(change("mae"), F.lit(1 - tail)).alias("mae_change_high"),
        F.avg((change("rmse") < 0).cast("double")).alias("share_better"),
        F.count("*").alias("replicates"),
    )
    error = lambda p: F.sqrt(F.avg((F.col(p) - F.col(actual)) * (F.col(p) - F.col(actual))))
    known = scored.filter(F.col(actual).isNotNull() & F.col(old).isNotNull() & F.col(new).isNotNull())
    return known.agg((error(new) - error(old)).alias("rmse_change")).crossJoin(spread)  # a row each


def compare_versions(registry: ModelRegistry, data: DataFrame, row_key: Column, actual: str, old: str, new: str, **settings) -> DataFrame:
    """Two stored versions scored on the same rows and compared by :func:`compared_predictions`; with their names."""
    (first, meta_old), (second, meta_new) = registry.load(old), registry.load(new)
    base = [c for c in data.columns]
    scored = first.transform(data).select(*base, F.col("prediction").alias("old_prediction"))
    scored = second.transform(scored).select(*base, "old_prediction", F.col("prediction").alias("new_prediction"))
    result = compared_predictions(scored, row_key, actual, "old_prediction", "new_prediction", **settings)
    return result.select(F.lit(meta_old["model_name"]).alias("old_model"), F.lit(meta_new["model_name"]).alias("new_model"), "*")
