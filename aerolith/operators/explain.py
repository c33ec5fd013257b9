"""Attribution of predictions to features, global importance and narrative text."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Shown names of features.
FRIENDLY_NAMES = {
    "pm2_5": "Current PM2.5 Level",
    "pm25_roll_mean_24": "24h Avg PM2.5",
    "pm25_roll_mean_72": "72h Avg PM2.5",
    "pm25_lag_24": "Yesterday's PM2.5 (24h lag)",
    "pm10": "PM10 Coarse Dust",
    "co": "Carbon Monoxide (CO)",
    "pm25_roll_std_24": "24h PM2.5 Variability",
    "pm25_roll_std_72": "72h PM2.5 Variability",
    "so2": "Sulfur Dioxide (SO2)",
    "no2": "Nitrogen Dioxide (NO2)",
    "wind_pm25": "Wind × Pollution Dispersion",
    "pm25_lag_48": "48h Lagged PM2.5",
    "pm25_lag_72": "72h Lagged PM2.5",
    "month_cos": "Seasonal Cycle (Month)",
    "temp_humidity": "Heat & Humidity Trapping",
    "surface_pressure": "Barometric Pressure",
    "apparent_temperature": "Feels-Like Temperature",
    "wind_speed_10m": "Surface Wind Speed",
}
NEUTRAL_BASE = 25.0

# Labels and sentences of explanations.
RAISES, LOWERS = "Increases PM2.5", "Decreases PM2.5"
PREDICTED_TEXT = "The AI model predicts a PM2.5 concentration of **%.1f µg/m³** (baseline expectation is %.1f µg/m³)."
RAISING_TEXT, RAISING_ITEM = "• **Key factors elevating pollution**: ", "**%s** (+%.2f)"
LOWERING_TEXT, LOWERING_ITEM = "• **Key factors mitigating pollution**: ", "**%s** (%.2f)"


def friendly_name(feature: Column) -> Column:
    names = F.create_map(*[F.lit(v) for kv in FRIENDLY_NAMES.items() for v in kv])
    return F.coalesce(names[feature], feature)


def _contribution(feature: str, amount: Column) -> Column:
    return F.struct(
        F.lit(feature).alias("feature"),
        F.col(feature).cast("double").alias("value"),
        amount.cast("double").alias("shap_value"),
        F.when(amount > 0, RAISES).otherwise(LOWERS).alias("direction"),
        F.abs(amount).cast("double").alias("abs_impact"),
        friendly_name(F.lit(feature)).alias("display_name"),
    )


def _strongest_first(items: Column) -> Column:
    def order(a: Column, b: Column) -> Column:
        return (
            F.when(a["abs_impact"] > b["abs_impact"], -1)
            .when(a["abs_impact"] < b["abs_impact"], 1)
            .when(a["feature"] < b["feature"], -1)
            .when(a["feature"] > b["feature"], 1)
            .otherwise(0)
        )

    return F.array_sort(items, order)


def explain_linear(
    df: DataFrame, coefficients: Mapping[str, float], intercept: float, means: Mapping[str, float]
) -> DataFrame:
    """Add ``base_value`` and ``contributions``: weight × (value − mean), strongest first."""
    base = intercept + sum(w * means[c] for c, w in coefficients.items())
    parts = [_contribution(c, F.lit(float(w)) * (F.col(c) - F.lit(float(means[c])))) for c, w in coefficients.items()]
    return df.withColumn("base_value", F.lit(float(base))).withColumn("contributions", _strongest_first(F.array(*parts)))


def explain_by_importance(
    df: DataFrame, importances: Mapping[str, float], prediction: str = "prediction", base: float = NEUTRAL_BASE
) -> DataFrame:
    """Fallback: share the distance from the base by global importance."""
    parts = [_contribution(c, F.lit(float(w)) * (F.col(prediction) - F.lit(base))) for c, w in importances.items()]
    return df.withColumn("base_value", F.lit(base)).withColumn("contributions", _strongest_first(F.array(*parts)))


def contribution_rows(explained: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Long form: one row per (row, feature)."""
    return explained.select(*keep, "base_value", F.inline("contributions"))


def top_contributions(explained: DataFrame, keep: Sequence[str], k: int = 2) -> DataFrame:
    """The ``k`` strongest raising and lowering features of each explained row, without a shuffle."""

    def side(sign: int) -> Column:
        mine = F.filter("contributions", lambda c: F.signum(c["shap_value"]) == sign)
        return F.transform(
            F.slice(mine, 1, k),
            lambda c, i: F.struct(
                F.lit(sign).alias("sign"), (i + 1).alias("place"), *[c[n].alias(n) for n in ("feature", "value", "shap_value", "abs_impact", "display_name")]
            ),
        )

    return explained.select(*keep, F.inline(F.concat(side(1), side(-1))))


def narrative(prediction: Column, base: Column, contributions: Column, k: int = 2) -> Column:
    """Sentence per row: prediction, base, and the ``k`` strongest features each way."""

    def listed(items: Column, pattern: str) -> Column:
        texts = F.transform(F.slice(items, 1, k), lambda c: F.format_string(pattern, c["display_name"], c["shap_value"]))
        return F.array_join(texts, ", ")

    up = F.filter(contributions, lambda c: c["shap_value"] > 0)
    down = F.filter(contributions, lambda c: c["shap_value"] < 0)
    head = F.format_string(PREDICTED_TEXT, prediction, base)
    raising = F.when(F.size(up) > 0, F.concat(F.lit(RAISING_TEXT), listed(up, RAISING_ITEM), F.lit(".")))
    lowering = F.when(F.size(down) > 0, F.concat(F.lit(LOWERING_TEXT), listed(down, LOWERING_ITEM), F.lit(".")))
    return F.concat_ws("\n\n", head, raising, lowering)


def global_importance(spark, features: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """(feature, importance, relative_importance_pct) of trees, or of absolute coefficients."""
    rows = [(f, abs(float(w))) for f, w in zip(features, weights, strict=True)]
    table = spark.createDataFrame(rows, "feature string, importance double")
    # One row per feature.
    share = F.col("importance") / F.sum("importance").over(W.partitionBy()) * 100
    return table.withColumn("relative_importance_pct", share).orderBy(F.col("importance").desc(), "feature")


# --- trees -------------------------------------------------------------------------------------


def _leaf_paths(nodes: dict[int, tuple]) -> list[tuple]:
    """Leaves of one tree as (value, [(feature, low, high, share of cover)]), one entry per feature."""
    out = []
    stack = [(0, {})]
    while stack:
        node, path = stack.pop()
        value, cover, left, right, feature, threshold = nodes[node]
        if left < 0:
            out.append((value, [(f, *box) for f, box in path.items()]))
            continue
        low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
        for child, box in ((left, (low, min(high, threshold))), (right, (max(low, threshold), high))):
            part = share * (nodes[child][1] / cover if cover else 0.0)
            stack.append((child, {**path, feature: (*box, part)}))
    return out


#: Numbers in one array operation of tree attribution.
_CELLS = 1 << 21


def _shapley_of_leaves(inside: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values of the game "product of inside (known) or share (unknown)".

    ``inside`` is rows x leaves x features of the path (0 or 1), ``share`` is leaves x features. The
    product over all features is a polynomial in the number known; leaving one feature out divides it
    by that feature's factor.
    """
    k = inside.shape[-1]
    weights = [factorial(s) * factorial(k - 1 - s) / factorial(k) for s in range(k)]
    full = np.zeros((*inside.shape[:-1], k + 1))
    full[..., 0] = 1.0
    for g in range(k):
        shifted = full[..., : g + 1] * inside[..., g, None]
        full[..., : g + 1] *= share[:, g, None]
        full[..., 1 : g + 2] += shifted
    out = np.empty(inside.shape)
    for f in range(k):
        part = share[:, f]
        without = full[..., k] * weights[k - 1]
        at = full[..., k]
        for j in range(k - 1, 0, -1):
            at = full[..., j] - part * at
            without = without + at * weights[j - 1]
        outside = (full[..., :k] @ np.array(weights)) / np.where(part > 0, part, 1.0)
        out[..., f] = np.where(inside[..., f] > 0, without, outside) * (inside[..., f] - part)
    return out


def _by_length(leaves: Sequence[tuple[float, list]]) -> list[tuple[np.ndarray, ...]]:
    """(values, features, low, high, share) of the leaves with equally long paths, as arrays."""
    groups: dict[int, list] = {}
    for value, path in leaves:
        groups.setdefault(len(path), []).append((value, path))
    return [(np.array([v for v, _ in g]), *(np.array([[p[i] for p in path] for _, path in g], dtype=t) for i, t in enumerate((int, float, float, float)))) for g in groups.values()]


#: Numbers in the tables of a group of leaves; larger groups are worked out row by row.
_TABLE_CELLS = 1 << 23


def _tabled(group: tuple[np.ndarray, ...]) -> np.ndarray | None:
    """What each leaf attributes to each feature of its path (features x leaves x cases), for every case of features inside or out.

    A row only decides which case it is, so short paths are worked out once and not for every row.
    """
    values, at, _, _, share = group
    leaves, k = at.shape
    if k > 20 or (leaves << k) * k > _TABLE_CELLS:
        return None
    cases = ((np.arange(1 << k)[:, None] >> np.arange(k)) & 1).astype(float)
    out = np.empty((k, leaves, 1 << k))
    step = max(1, _CELLS // ((k + 1) << k))
    for a in range(0, leaves, step):
        part = slice(a, a + step)
        inside = np.broadcast_to(cases[:, None, :], (1 << k, len(values[part]), k))
        out[:, part] = (_shapley_of_leaves(inside, share[part]) * values[part][:, None]).transpose(2, 1, 0)
    return out


def _add_tabled(total: np.ndarray, x: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, table: np.ndarray) -> None:
    """Adds to ``total`` (rows x features) what the leaves attribute, by their tables."""
    k, leaves, cases = table.shape
    columns, sums = np.ascontiguousarray(x.T), total.T
    step = max(1, _CELLS // 8 // max(1, len(x)))
    for a in range(0, leaves, step):
        part = slice(a, min(a + step, leaves))
        case = np.zeros((part.stop - a, len(x)), dtype=np.int32)
        for j in range(k):
            seen = columns[at[part, j]]
            case |= ((seen > low[part, j, None]) & (seen <= high[part, j, None])).astype(np.int32) << j
        case += np.arange(part.stop - a, dtype=np.int32)[:, None] * cases
        for j in range(k):
            order = at[part, j].argsort(kind="stable")
            feature, starts = np.unique(at[part, j][order], return_index=True)
            sums[feature] += np.add.reduceat(table[j, part].ravel()[case[order]], starts, axis=0)


def explain_trees(df: DataFrame, features: Sequence[str], trees: Sequence[tuple[float, dict]]) -> DataFrame:
    """Add ``base_value`` and one ``shap_<feature>`` column each, exact for the ensemble.

    ``trees`` is ``[(weight, {node: (value, cover, left, right, feature, threshold)})]``, as
    :func:`aerolith.plans.registry.tree_nodes` reads it; its size is that of the model. Batches of
    rows run vectorised in their own partitions. Leaves are broadcast in parts of ``MOST_LEAF_BYTES`` at most; a larger
    ensemble takes several passes over the columns read, whose amounts are added up.
    """
    base, part, size = 0.0, [], 0
    names = list(features)
    df = df.withColumns({f"shap_{f}": F.lit(0.0) for f in names})
    for w, tree in trees:
        leaves = [(w * value, path) for value, path in _leaf_paths(tree)]
        base += sum(value * float(np.prod([p[3] for p in path])) for value, path in leaves)
        part += [leaf for leaf in leaves if leaf[1]]
        size += sum(8 + 32 * len(path) for _, path in leaves)
        if size >= MOST_LEAF_BYTES:
            df, part, size = _with_amounts(df, names, part), [], 0
    if part:
        df = _with_amounts(df, names, part)
    return df.withColumn("base_value", F.lit(base))


#: Bytes of leaves (a value, and four numbers for each feature of its path) in one broadcast.
MOST_LEAF_BYTES = 64 << 20


def _with_amounts(df: DataFrame, names: Sequence[str], leaves: Sequence[tuple[float, list]]) -> DataFrame:
    """Adds what the leaves attribute to the columns ``shap_<feature>``."""
    shared = df.sparkSession.sparkContext.broadcast(_by_length(leaves))
    added = [f"shap_{f}" for f in names]
    schema = df.schema

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = [_tabled(group) for group in shared.value]
        for batch in batches:
            x = batch[names].to_numpy(dtype=float)
            total = np.zeros((len(batch), len(names)))
            for (values, at, low, high, share), table in zip(shared.value, tables, strict=True):
                if table is not None:
                    _add_tabled(total, x, at, low, high, table)
                    continue
                step = max(1, _CELLS // max(1, len(batch) * (at.shape[1] + 1)))
                for a in range(0, len(values), step):
                    part = slice(a, a + step)
                    seen = x[:, at[part]]
                    inside = ((seen > low[part]) & (seen <= high[part])).astype(float)
                    amounts = _shapley_of_leaves(inside, share[part]) * values[part][:, None]
                    np.add.at(total.T, at[part].ravel(), amounts.reshape(len(batch), -1).T)
            yield batch.assign(**{a: batch[a].to_numpy(dtype=float) + total[:, i] for i, a in enumerate(added)})

    return df.mapInPandas(attribute, schema)


def collect_contributions(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Turn the ``shap_<feature>`` columns into the sorted ``contributions`` array."""
    parts = [_contribution(f, F.col(f"shap_{f}")) for f in features]
    return df.withColumn("contributions", _strongest_first(F.array(*parts))).drop(*[f"shap_{f}" for f in features])
