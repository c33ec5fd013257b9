"""End-to-end jobs over stored tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.operators.chunks import SeriesSpec, latest_rows
from aerolith.operators.clean import clean_observations, clip_ranges, coerce_numeric, parse_times
from aerolith.operators.explain import collect_contributions, explain_trees, narrative
from aerolith.operators.features import engineer_features, live_features
from aerolith.operators.select import score_features, top_features
from aerolith.operators.validate import check_features, dataset_report
from aerolith.plans.registry import ModelRegistry, tree_nodes
from aerolith.plans.scoring import prediction_log, score
from aerolith.schema import LIVE_BOUNDS, MEASURES, OBSERVATION, TARGET, TS, VALUE
from aerolith.session import job, stage
from aerolith.sources import feeds
from aerolith.sources.store import DATE, FeatureStore, append_log, newest_rows, read_table, upsert
from aerolith.sources.tables import exists, write_feature_list, write_latest_json, write_observations

_RECENT_DAYS = 30


def backfill(weather: DataFrame, air: DataFrame, spec: SeriesSpec, path: str) -> DataFrame:
    """Landed payloads → joined observations → table; returns the report."""
    rows = feeds.merge_feeds(feeds.parse_weather(weather), feeds.parse_air_quality(air), spec)
    write_observations(rows, path, keys=spec.keys)
    return dataset_report(rows.sparkSession.read.parquet(path), MEASURES)


def build_training_table(raw: DataFrame, spec: SeriesSpec, path: str, tie_break: Sequence[str] = ()) -> DataFrame:
    """Clean → features → checked table. The cleaned rows are staged: two passes read them."""
    with job():
        clean = stage(clean_observations(raw, spec, tie_break=tie_break))
        engineer_features(clean, spec).write.mode("overwrite").parquet(path)
        table = raw.sparkSession.read.parquet(path)
        check_features(table, spec)
    return table


def select_features(
    table: DataFrame, spec: SeriesSpec, path: str, *, k: int = 18, target: str = TARGET, trees: int = 100, depth: int = 12, train_only: bool = False
) -> list[str]:
    """Score, rank, write the list and the narrowed table. ``train_only`` leaves test rows out of the scores."""
    from aerolith.operators.split import time_split

    candidates = [c for c in table.columns if c not in (*spec.keys, spec.ts, target)]
    scored = table
    with job():
        if train_only:
            scored = stage(time_split(table, spec).filter(F.col("split") == "train").drop("split"))
        ranked = stage(score_features(scored, candidates, target, trees=trees, depth=depth))
        chosen = top_features(ranked, k)
        write_feature_list(ranked, f"{path}/feature_list", k)
        table.select(*spec.keys, spec.ts, *chosen, target).write.mode("overwrite").parquet(f"{path}/selected")
    return chosen


def clean_live(rows: DataFrame, ts: str = TS) -> DataFrame:
    """Per-row part of cleaning for newly arrived rows."""
    return clip_ranges(parse_times(coerce_numeric(rows), ts), LIVE_BOUNDS)


def recent_history(store: DataFrame, touched: DataFrame, spec: SeriesSpec, rows: int, days: int = _RECENT_DAYS) -> DataFrame:
    """The newest ``rows`` rows of the touched series, reading old dates only for sparse series.

    Every scan has a date bound. For series with too few rows the range is widened fourfold at a
    time, until they have enough or no older date is left, so the result does not depend on ``days``.
    """
    keys = list(spec.keys)
    last = touched.agg(F.max(spec.ts)).first()[0]
    if last is None:
        return store.limit(0).drop(DATE)
    names, done = stage(touched.select(*keys).distinct()), []
    while True:
        since = F.date_sub(F.lit(last).cast("date"), days)
        fresh = stage(latest_rows(store.filter(F.col(DATE) >= since).join(names, keys, "left_semi"), spec, rows))
        filled = fresh.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= rows)
        names = stage(names.join(filled, keys, "left_anti"))
        if names.isEmpty() or store.filter(F.col(DATE) < since).isEmpty():
            done.append(fresh)
            break
        done.append(fresh.join(filled, keys, "left_semi"))
        days *= 4
    return reduce(DataFrame.unionByName, done).drop(DATE)


def series_history(spark: SparkSession, path: str, touched: DataFrame, spec: SeriesSpec, rows: int) -> DataFrame:
    """The newest ``rows`` rows of the touched series from the table at ``path``.

    With the table's own counts only the dates that hold them are read; a table that has none is searched
    by :func:`recent_history`.
    """
    near = newest_rows(spark, path, touched, list(spec.keys), rows)
    if near is None:
        return recent_history(read_table(spark, path), touched, spec, rows)
    return latest_rows(near.drop(DATE), spec, rows)


def hourly_features(new: DataFrame, spec: SeriesSpec, raw_path: str, store: FeatureStore | None = None, group: str = "live_features") -> DataFrame:
    """Clean the new rows, merge them into the raw table, compute live features of their series.

    The result is staged; discard it when it is used up.
    """
    spark = new.sparkSession
    with job() as staged:
        rows = stage(clean_live(new, spec.ts).select(*spec.keys, *OBSERVATION))
        upsert(spark, raw_path, rows, list(spec.keys), spec.ts)
        history = series_history(spark, raw_path, rows, spec, 169)
        latest = stage(live_features(history, spec))
        if store is not None:
            store.insert(latest, group, primary_key=[*spec.keys, spec.ts], event_time=spec.ts)
        staged.remove(latest)
    return latest


def hourly_predictions(
    latest: DataFrame, spec: SeriesSpec, registry: ModelRegistry, log_path: str, latest_path: str, retrain: Callable[[], object] | None = None
) -> DataFrame:
    """Score the latest features with the champion, append to the log, rewrite the latest file."""
    model, meta = registry.load(retrain=retrain)
    keep = [*spec.keys, spec.ts, VALUE]
    scored = score(latest, model.transform, meta["features"], keep)
    now = F.lit(datetime.now(timezone.utc))
    rows = prediction_log(scored, spec.keys, meta["model_name"], now, spec.ts)
    append_log(rows, log_path)
    write_latest_json(rows, latest_path)
    return rows


def explain_latest(latest: DataFrame, spec: SeriesSpec, registry: ModelRegistry, work: str, retrain: Callable[[], object] | None = None) -> DataFrame:
    """Prediction, base value, sorted contributions and the sentence for the newest row of each series.

    A linear champion is explained by its weights on the scaled columns, whose means are 0; a tree
    champion by exact tree attribution. ``work`` is where the champion's node table is written.
    """
    model, meta = registry.load(retrain=retrain)
    features, last = meta["features"], model.stages[-1]
    scored = model.transform(latest)
    if hasattr(last, "coefficients"):
        scaled = {f"{f}_z": float(w) for f, w in zip(features, last.coefficients, strict=True)}
        amounts = {f"shap_{f}": F.lit(w) * F.col(z) for f, (z, w) in zip(features, scaled.items(), strict=True)}
        explained = scored.withColumns(amounts).withColumn("base_value", F.lit(float(last.intercept)))
    else:
        rows = scored.select(*spec.keys, spec.ts, *features, "prediction")
        explained = explain_trees(rows, features, tree_nodes(latest.sparkSession, last, work))
    explained = collect_contributions(explained, features)
    text = narrative(F.col("prediction"), F.col("base_value"), F.col("contributions"))
    return explained.select(*spec.keys, spec.ts, "prediction", "base_value", "contributions", text.alias("narrative_explanation"))


def observation_table(spark: SparkSession, cleaned: str, raw: str) -> DataFrame:
    """The cleaned table if there is one, else the raw one."""
    return spark.read.parquet(cleaned if exists(spark, cleaned) else raw)
