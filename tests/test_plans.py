"""Physical plans: what is shuffled, pruned, pushed down."""

import re

import pytest

from aerolith import SeriesSpec, stage
from aerolith.operators import chunks, clean, features
from aerolith.sources import feeds
from tests.test_tables import observations

SPEC = SeriesSpec()


@pytest.fixture(scope="module")
def stored(spark):
    return stage(observations(spark, 2, 60))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_take_one_scan_one_shuffle_one_sort(stored):
    text = plan(features.engineer_features(stored, SPEC))
    assert text.count("Exchange hashpartitioning") == 1
    assert text.count("FileScan") == 1 and len(re.findall(r"\bSort \[", text)) == 1
    assert re.search(r"hashpartitioning\(city#\d+, _chunk#\d+L", text)
    assert "Python" not in text


def test_only_needed_columns_are_read(stored):
    text = plan(features.lag_features(stored, SPEC).select("city", "pm25_lag_24"))
    assert "ReadSchema: struct<datetime:timestamp,pm2_5:double,city:string>" in text


def test_interpolation_reuses_its_shuffle(spark, stored):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        narrow = stored.select("city", "datetime", "pm2_5", "no2")
        text = plan(clean.interpolate_gaps(narrow, SPEC, ["pm2_5", "no2"]))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert text.count("ReusedExchange") >= 1 and text.count("FileScan") == 1
    assert not re.search(r"windowspecdefinition\(city#\d+, datetime", text)


def test_top_rows_and_duplicates_are_cut_before_the_shuffle(stored):
    for df in (chunks.latest_rows(stored, SPEC, 168), clean.drop_duplicate_times(stored, SPEC)):
        text = plan(df)
        below = text[text.rindex("Exchange hashpartitioning"):]
        assert "WindowGroupLimit" in below


def test_time_range_reaches_the_scan(stored):
    text = plan(feeds.within_days(stored, "2024-01-02", 1))
    assert "GreaterThanOrEqual(datetime" in text and "LessThan(datetime" in text


def test_split_does_not_move_the_rows(spark, stored):
    from aerolith.operators.split import expanding_folds, time_split

    for df in (time_split(stored, SPEC), expanding_folds(stored, SPEC)):
        text = plan(df)
        assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_reports_are_one_aggregation(stored):
    from aerolith.operators.validate import dataset_report
    from aerolith.schema import MEASURES

    assert plan(dataset_report(stored, MEASURES)).count("FileScan") == 1


def test_no_query_joins_without_a_key(spark):
    """No cartesian or nested-loop join in batch queries of every kind over the smallest tables.

    Left out are those that join one row with one row (version_interval, stored_versions).
    """
    from aerolith.catalog import ENTRIES, load_all

    load_all()
    names = """scaled_features target_histogram time_split describe_lineitem rank_compare what_if_scores what_if_grid keyed_upsert source_fallback hourly_observations
        cleaned_observations training_features lag_features rolling_features live_features time_gaps first_of_each_hour merged_feeds dataset_report diurnal_mean
        seasonal_mean pearson_with_target spearman_with_target mutual_information expanding_folds batch_scores linear_attribution column_drift flagged_outliers
        outliers_removed outlier_counts spike_episodes highlighted_spikes air_quality_index matched_predictions prediction_errors series_freshness encoded_categories
        required_columns""".split()
    for name in names:
        text = plan(ENTRIES[name].run(spark, "/root/testdata/sf0.001"))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name
