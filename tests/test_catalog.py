"""A cross-section of the registered queries against their SQL, on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

from aerolith.catalog import ENTRIES, load_all
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
load_all()
SAMPLE = [
    "hourly_observations",
    "cleaned_observations",
    "all_events_features",
    "training_features_short_chunks",
    "live_features",
    "time_gaps",
    "keyed_upsert",
    "merged_feeds",
    "describe_lineitem",
    "spearman_with_target",
    "time_split",
    "expanding_folds",
    "forecast_72_hours",
    "linear_attribution",
    "streamed_hourly_means",
    "stateful_live_features",
    "live_source_fallback",
    "widened_upsert",
    "column_drift",
    "outliers_removed",
    "spike_episodes",
    "air_quality_index",
    "matched_predictions",
    "encoded_categories",
    "version_interval",
    "variance_inflation_all",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    problem = compare(ENTRIES[name].run(spark, SF), con, ENTRIES[name].sql)
    assert problem is None or "near" in problem, problem


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_what_if_scores_change_all_nine_inputs(spark, tmp_path):
    kinds = ["click", "error", "purchase", "signup", "view"]
    rows = [(i, f"2024-01-01 {i // 10:02d}:{i % 10:02d}:00", i % 3, kinds[i % 5], 20.0 + i % 17, f'{{"k": {i % 9}}}') for i in range(200)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr(
        "event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "value", "props"
    ).write.parquet(f"{tmp_path}/events.parquet")
    scores = ENTRIES["what_if_scores"].run(spark, str(tmp_path))
    n = {r.changed: (r.n, r.p) for r in scores.groupBy("changed").agg(F.count("*").alias("n"), F.countDistinct("factor").alias("p")).collect()}
    assert n.pop("all") == (512, 0)
    assert n == dict.fromkeys(["pm2_5", "pm10", "no2", "co", "o3", "temperature_2m", "relative_humidity_2m", "wind_speed_10m", "surface_pressure"], (40, 2))
