"""Sources, sinks, projections, validation, joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from aerolith.catalog import SPEC, TYPE_SPEC, clean, events, feat, obs, query
from aerolith.catalog.sql import (
    CLEAN,
    FEAT,
    H_TYPE,
    K,
    MEASURES_SQL,
    OBS,
    clip,
    cols,
    with_,
)
from aerolith.operators import clean as C
from aerolith.operators import features as X
from aerolith.operators import validate as V
from aerolith.schema import (
    CURRENT_DEFAULTS,
    ENGINEERED,
    FALLBACK_WEATHER,
    LIVE_BOUNDS,
    MEASURES,
    PLAUSIBLE,
    POLLUTANT_FEED_NAMES,
    POLLUTANTS,
    SELECTED_FEATURES,
    WEATHER,
    add_city,
    restore_columns,
    sanitize_columns,
)
from aerolith.session import shared_dir
from aerolith.sources import events as E
from aerolith.sources import feeds, store, tables


def scratch(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(with_(OBS) + f"SELECT {cols('city datetime', MEASURES_SQL)} FROM obs")
def hourly_observations(spark, sf_dir):
    return E.observations(events(spark, sf_dir))


@query(with_(OBS) + f"SELECT {cols('city datetime', MEASURES_SQL)} FROM obs")
def observation_csv_round_trip(spark, sf_dir):
    path = scratch(spark, "csv")
    tables.write_observations(obs(spark, sf_dir), path, fmt="csv")
    return tables.read_observations(spark, f"{path}-missing", path, fmt="csv")


WEATHER_NAMES = " ".join(WEATHER)
POLLUTANT_NAMES = " ".join(POLLUTANTS)


@query(with_(OBS) + f"SELECT {cols('city datetime', WEATHER_NAMES)} FROM obs")
def weather_json_rows(spark, sf_dir):
    packed = feeds.pack_hourly(obs(spark, sf_dir), SPEC, {c: c for c in WEATHER})
    return feeds.parse_weather(packed)


@query(with_(OBS) + f"SELECT {cols('city datetime', POLLUTANT_NAMES)} FROM obs")
def air_quality_json_rows(spark, sf_dir):
    packed = feeds.pack_hourly(obs(spark, sf_dir), SPEC, {own: feed for feed, own in POLLUTANT_FEED_NAMES.items()})
    return feeds.parse_air_quality(packed)


def current_payload(names):
    """Landed current observations; a null field is absent from the text."""
    body = F.struct(*[F.col(own).alias(feed) for feed, own in names.items()])
    return F.to_json(F.struct(body.alias("current")))


def defaulted(names, prefix=""):
    return ", ".join(f"round(coalesce({prefix}{c}, {CURRENT_DEFAULTS[c]}) + 3.3e-8, 6) AS {c}" for c in names)


@query(with_(OBS) + f"SELECT city, datetime, {defaulted(WEATHER)} FROM obs")
def current_weather_defaults(spark, sf_dir):
    df = obs(spark, sf_dir).select("city", "datetime", current_payload({c: c for c in WEATHER}).alias("payload"))
    return feeds.parse_current_weather(df)


@query(with_(OBS) + f"SELECT city, datetime, {defaulted(POLLUTANTS)} FROM obs")
def current_air_quality_defaults(spark, sf_dir):
    df = obs(spark, sf_dir).select("city", "datetime", current_payload(POLLUTANT_FEED_NAMES).alias("payload"))
    return feeds.parse_current_air_quality(df)


def secondary_payload():
    parts = F.struct(F.struct(*[F.col(c) for c in POLLUTANTS]).alias("components"))
    return F.to_json(F.struct(F.array(parts).alias("list")))


@query(with_(OBS) + f"SELECT city, datetime, {', '.join(f'round(coalesce({c}, 0.0) + 3.3e-8, 6) AS {c}' for c in POLLUTANTS)} FROM obs")
def secondary_pollutants(spark, sf_dir):
    df = obs(spark, sf_dir).select("city", "datetime", secondary_payload().alias("payload"))
    return feeds.parse_secondary(df)


def current_feeds(spark, sf_dir):
    seen = (F.col("datetime") + F.expr("INTERVAL 17 MINUTES")).alias("fetched_at")
    rows = obs(spark, sf_dir)
    weather = feeds.parse_current_weather(rows.select("city", seen, current_payload({c: c for c in WEATHER}).alias("payload")))
    air = feeds.parse_current_air_quality(rows.select("city", seen, current_payload(POLLUTANT_FEED_NAMES).alias("payload")))
    return weather, air


@query(with_(OBS) + f"SELECT city, datetime, {defaulted(MEASURES)} FROM obs")
def current_combined(spark, sf_dir):
    return feeds.combine_current(*current_feeds(spark, sf_dir), SPEC)


_CHOSEN = ", ".join(
    f"round(CASE WHEN temperature_2m IS NOT NULL THEN {c} ELSE {FALLBACK_WEATHER[c] if c in WEATHER else f'coalesce({c}, 0.0)'} END + 3.3e-8, 6) AS {c}"
    for c in MEASURES
)


@query(
    with_(OBS)
    + f"SELECT city, datetime, {_CHOSEN}, CASE WHEN temperature_2m IS NOT NULL THEN 'primary' ELSE 'secondary' END AS source FROM obs"
)
def source_fallback(spark, sf_dir):
    rows = obs(spark, sf_dir)
    primary = rows.filter(F.col("temperature_2m").isNotNull())
    secondary = feeds.parse_secondary(rows.select("city", "datetime", secondary_payload().alias("payload")))
    return feeds.with_fallback(primary, secondary, SPEC)


@query(
    with_(OBS)
    + f"SELECT {cols('city datetime', 'pm2_5')} FROM obs WHERE datetime >= DATE '2024-01-25' - INTERVAL 14 DAYS AND datetime < DATE '2024-01-26'"
)
def recent_days(spark, sf_dir):
    return feeds.within_days(obs(spark, sf_dir), "2024-01-25", 14).select("city", "datetime", "pm2_5")


def revised(spark, sf_dir):
    """Old hourly means up to the 20th, and newer ones from the 19th that also carry a count."""
    rows = events(spark, sf_dir)
    old = E.hourly_by_type(rows.filter(F.col("ts") < "2024-01-20"))
    late = rows.filter(F.col("ts") >= "2024-01-19")
    new = late.groupBy("event_type", F.date_trunc("hour", "ts").alias("datetime")).agg(F.max("value").alias("v"), F.count("*").alias("n"))
    return old, new


REVISED = f"""old AS (SELECT event_type, datetime, v FROM ({H_TYPE.split(' AS ', 1)[1].strip()[1:-1].replace('FROM events', "FROM events WHERE ts < TIMESTAMP '2024-01-20'")})),
  new AS (SELECT event_type, date_trunc('hour', ts) AS datetime, max(value) AS v, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-19' GROUP BY 1, 2)"""


@query(with_(REVISED) + "SELECT event_type, datetime, round(v + 3.3e-8, 6) AS v, NULL::BIGINT AS n FROM old UNION ALL SELECT event_type, datetime, round(v + 3.3e-8, 6), n FROM new")
def union_by_name(spark, sf_dir):
    old, new = revised(spark, sf_dir)
    return old.unionByName(new, allowMissingColumns=True)


UPSERTED = (
    with_(REVISED)
    + """SELECT event_type, datetime, round(v + 3.3e-8, 6) AS v, n FROM new UNION ALL
  SELECT event_type, datetime, round(v + 3.3e-8, 6), NULL FROM old WHERE (event_type, datetime) NOT IN (SELECT (event_type, datetime) FROM new)"""
)


@query(UPSERTED)
def keyed_upsert(spark, sf_dir):
    old, new = revised(spark, sf_dir)
    return store.latest_version(old, new, ["event_type", "datetime"])


@query(with_(REVISED) + "SELECT event_type, datetime, round(coalesce(n.v, CAST(floor(o.v) AS INTEGER)) + 3.3e-8, 6) AS v FROM old o FULL JOIN new n USING (event_type, datetime)")
def widened_upsert(spark, sf_dir):
    """A column that came as whole numbers later brings fractions, and then whole numbers again: nothing is cut."""
    path = scratch(spark, "upsert")
    old, new = revised(spark, sf_dir)
    whole = old.withColumn("v", F.floor("v").cast("int"))
    store.upsert(spark, path, whole, ["event_type"])
    store.upsert(spark, path, new.drop("n"), ["event_type"])
    store.upsert(spark, path, whole.join(new, ["event_type", "datetime"], "left_anti"), ["event_type"])
    return store.read_table(spark, path).drop(store.DATE)


@query(UPSERTED)
def table_upsert(spark, sf_dir):
    """The second batch brings a column; the third has it not and leaves it as it is in other rows."""
    path = scratch(spark, "upsert")
    old, new = revised(spark, sf_dir)
    store.upsert(spark, path, old, ["event_type"])
    store.upsert(spark, path, new, ["event_type"])
    store.upsert(spark, path, old.join(new, ["event_type", "datetime"], "left_anti"), ["event_type"])
    return store.read_table(spark, path).drop(store.DATE)


@query(
    UPSERTED.replace("SELECT event_type, datetime, round(v + 3.3e-8, 6) AS v, n FROM new UNION ALL", "SELECT 'rows' AS kind, event_type, datetime, round(v + 3.3e-8, 6) AS v, n FROM new UNION ALL SELECT 'rows',", 1).replace("SELECT 'rows',\n  SELECT", "SELECT 'rows',")
    + " UNION ALL SELECT 'left out', event_type, NULL, NULL, count(*) FROM events WHERE event_type = 'view' GROUP BY event_type"
)
def upsert_without_times(spark, sf_dir):
    """Rows without a time are counted, not stored, and do not touch what is there."""
    path = scratch(spark, "upsert")
    old, new = revised(spark, sf_dir)
    timeless = events(spark, sf_dir).filter("event_type = 'view'").select("event_type", F.lit(None).cast("timestamp").alias("datetime"), F.col("value").alias("v"))
    store.upsert(spark, path, old, ["event_type"])
    store.upsert(spark, path, new, ["event_type"])
    left_out = store.upsert(spark, path, timeless, ["event_type"])
    rows = store.read_table(spark, path).select(F.lit("rows").alias("kind"), "event_type", "datetime", "v", "n")
    counted = [("left out", "view", None, None, left_out)] if left_out else []
    return rows.unionByName(spark.createDataFrame(counted, rows.schema))


@query(with_(OBS, CLEAN, FEAT) + f"SELECT {cols('city datetime', ' '.join(SELECTED_FEATURES) + ' target_pm25')} FROM feat")
def stored_feature_view(spark, sf_dir):
    features = store.FeatureStore(spark, scratch(spark, "features"))
    features.insert(feat(spark, sf_dir), "hourly_features")
    return features.get_or_create_view("training", "hourly_features", SELECTED_FEATURES)


@query(with_(OBS) + f"SELECT {cols('city datetime', 'pm2_5 pm10 temperature_2m')} FROM obs")
def raw_subset(spark, sf_dir):
    return tables.raw_subset(obs(spark, sf_dir), ["pm2_5", "pm10", "temperature_2m"], SPEC)


@query(with_(OBS) + f"SELECT {cols('city datetime', POLLUTANT_NAMES)} FROM obs")
def column_names_restored(spark, sf_dir):
    shown = restore_columns(obs(spark, sf_dir).select("city", "datetime", *POLLUTANTS))
    stored, _ = sanitize_columns(shown)
    return stored


@query(with_("h AS (SELECT date_trunc('hour', ts) AS datetime, count(*) AS n FROM events GROUP BY 1)") + "SELECT datetime, n, 'harbour' AS city FROM h")
def constant_city(spark, sf_dir):
    hours = events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("datetime")).agg(F.count("*").alias("n"))
    return add_city(add_city(hours, "harbour"), "elsewhere")


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN round(value + 3.3e-8, 6) END AS reading FROM events")
def numeric_coercion(spark, sf_dir):
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    return C.coerce_numeric(events(spark, sf_dir).select("event_id", text.alias("reading")), ["reading"])


@query("SELECT event_id, date_trunc('second', ts) AS datetime FROM events WHERE event_type <> 'view'")
def time_parsing(spark, sf_dir):
    text = F.when(F.col("event_type") == "view", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return C.parse_times(events(spark, sf_dir).select("event_id", text.alias("datetime")))


@query("SELECT count(*) AS rows_in, count(*) FILTER (WHERE event_type = 'view') AS rows_dropped FROM events")
def unparseable_times(spark, sf_dir):
    text = F.when(F.col("event_type") == "view", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return C.count_unparseable(events(spark, sf_dir).select(text.alias("datetime")))


@query(with_(OBS) + "SELECT city, datetime, " + ", ".join(f"round({clip(c, *PLAUSIBLE[c])} + 3.3e-8, 6) AS {c}" for c in MEASURES) + " FROM obs")
def plausible_clip(spark, sf_dir):
    return C.clip_ranges(obs(spark, sf_dir))


@query(
    with_(OBS)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} < {lo}) AS below_count, count(*) FILTER (WHERE {c} > {hi}) AS above_count FROM obs"
        for c, (lo, hi) in PLAUSIBLE.items()
    )
)
def clip_counts(spark, sf_dir):
    return C.clip_report(obs(spark, sf_dir))


@query(with_(OBS) + "SELECT city, datetime, " + ", ".join(f"round({clip(c, *b)} + 3.3e-8, 6) AS {c}" for c, b in LIVE_BOUNDS.items()) + " FROM obs")
def live_clip(spark, sf_dir):
    return C.clip_ranges(obs(spark, sf_dir), LIVE_BOUNDS).select("city", "datetime", *LIVE_BOUNDS)


ALL_KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in MEASURES)


@query(with_(OBS) + f"SELECT {cols('city datetime', MEASURES_SQL)} FROM obs WHERE {ALL_KNOWN}")
def complete_rows(spark, sf_dir):
    return X.drop_incomplete(obs(spark, sf_dir))


@query(with_(OBS) + f"SELECT count(*) AS rows_before, count(*) FILTER (WHERE NOT ({ALL_KNOWN})) AS rows_removed, count(*) FILTER (WHERE {ALL_KNOWN}) AS rows_remaining FROM obs")
def incomplete_counts(spark, sf_dir):
    return X.incomplete_report(obs(spark, sf_dir))


@query(
    with_(OBS)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, min(datetime) AS earliest, max(datetime) AS latest, "
        f"count(*) FILTER (WHERE {c} IS NULL) AS null_count, round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*) + 3.3e-8, 6) AS null_pct FROM obs"
        for c in MEASURES
    )
)
def dataset_report(spark, sf_dir):
    return V.dataset_report(obs(spark, sf_dir), MEASURES)


@query(
    with_(OBS)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
        f"round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*) + 3.3e-8, 6) AS null_pct FROM obs"
        for c in MEASURES
    )
)
def null_report(spark, sf_dir):
    return V.null_report(obs(spark, sf_dir), MEASURES)


@query(
    with_(OBS)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(min({c}) + 3.3e-8, 6) AS min_value, round(avg({c}) + 3.3e-8, 6) AS mean_value, round(max({c}) + 3.3e-8, 6) AS max_value, "
        f"count(*) FILTER (WHERE {c} IS NULL) AS null_count, CAST(0 AS BIGINT) AS inf_count FROM obs"
        for c in MEASURES
    )
)
def column_summary(spark, sf_dir):
    return V.column_summary(obs(spark, sf_dir), MEASURES)


_NULLS = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in MEASURES)


@query(
    with_(OBS, CLEAN)
    + f"""SELECT count(*) AS row_count, CAST(sum({_NULLS}) AS BIGINT) AS null_total, CAST(0 AS BIGINT) AS inf_total, 'raw' AS stage FROM obs
  UNION ALL SELECT count(*), CAST(sum({_NULLS}) AS BIGINT), CAST(0 AS BIGINT), 'clean' FROM clean"""
)
def before_after_cleaning(spark, sf_dir):
    return V.before_after(obs(spark, sf_dir), clean(spark, sf_dir), MEASURES)


@query(with_(OBS) + "SELECT city, count(*) AS row_count, min(datetime) AS earliest, max(datetime) AS latest FROM obs GROUP BY city")
def coverage(spark, sf_dir):
    return V.coverage(obs(spark, sf_dir), SPEC)


@query(
    with_(OBS, CLEAN, FEAT)
    + "SELECT city, count(*) AS row_count, count(*) - count(DISTINCT datetime) AS duplicate_count, CAST(0 AS BIGINT) AS null_cells, CAST(0 AS BIGINT) AS inf_cells FROM feat GROUP BY city"
)
def feature_report(spark, sf_dir):
    return V.check_features(feat(spark, sf_dir), SPEC, ENGINEERED)


def dirty(spark, sf_dir):
    """Observations with infinite values at 03:00 and 05:00 and with the rows of 07:00 twice."""
    rows, hour = obs(spark, sf_dir), F.hour("datetime")
    rows = rows.withColumn("pm2_5", F.when(hour == 3, float("inf")).otherwise(F.col("pm2_5"))).withColumn("pm10", F.when(hour == 5, float("-inf")).otherwise(F.col("pm10")))
    return rows.unionByName(rows.filter(hour == 7))


DIRTY = OBS.replace("obs AS (", "tidy AS (", 1) + """,
  marked AS (SELECT * REPLACE (CASE WHEN hour(datetime) = 3 THEN CAST('inf' AS DOUBLE) ELSE pm2_5 END AS pm2_5, CASE WHEN hour(datetime) = 5 THEN CAST('-inf' AS DOUBLE) ELSE pm10 END AS pm10) FROM tidy),
  obs AS (SELECT * FROM marked UNION ALL SELECT * FROM marked WHERE hour(datetime) = 7)"""
_INFS = " + ".join(f"CASE WHEN isinf({c}) THEN 1 ELSE 0 END" for c in MEASURES)


@query(with_(DIRTY) + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(*) FILTER (WHERE isinf({c})) AS inf_count FROM obs" for c in MEASURES))
def infinite_counts(spark, sf_dir):
    return V.column_summary(dirty(spark, sf_dir), MEASURES).select("column_name", "null_count", "inf_count")


@query(with_(DIRTY) + f"SELECT count(*) AS row_count, CAST(sum({_NULLS}) AS BIGINT) AS null_total, CAST(sum({_INFS}) AS BIGINT) AS inf_total, s AS stage FROM obs, (SELECT unnest(['raw', 'clean']) AS s) GROUP BY s")
def dirty_before_after(spark, sf_dir):
    rows = dirty(spark, sf_dir)
    return V.before_after(rows, rows, MEASURES)


@query(
    with_(DIRTY)
    + f"SELECT city, count(*) AS row_count, count(*) - count(DISTINCT datetime) AS duplicate_count, CAST(sum({_NULLS}) AS BIGINT) AS null_cells, CAST(sum({_INFS}) AS BIGINT) AS inf_cells FROM obs GROUP BY city"
)
def broken_feature_report(spark, sf_dir):
    """The report of a table that breaks every rule."""
    return V.feature_report(dirty(spark, sf_dir), SPEC, MEASURES)


@query("WITH o AS (SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events) SELECT event_type, count(*) FILTER (WHERE p > ts) AS unsorted_count FROM o GROUP BY 1")
def arrival_order(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_type", "event_id", F.col("ts").alias("datetime"))
    return V.unsorted_count(rows, TYPE_SPEC, "event_id")


@query("SELECT event_id, event_type FROM events WHERE isodow(ts) IN (6, 7)")
def weekend_rows(spark, sf_dir):
    return events(spark, sf_dir).filter(F.weekday("ts").isin(5, 6)).select("event_id", "event_type")


@query(with_(OBS, CLEAN, FEAT) + f"SELECT {cols('city datetime', ' '.join(SELECTED_FEATURES) + ' target_pm25')} FROM feat")
def features_and_target(spark, sf_dir):
    return store.feature_view(feat(spark, sf_dir), ["city", "datetime"], SELECTED_FEATURES)


@query(
    f"""WITH w AS (SELECT user_id, date_trunc('hour', ts) AS datetime, min(value) AS low FROM events GROUP BY 1, 2),
  a AS (SELECT user_id, date_trunc('hour', ts) AS datetime, min({K}) AS k FROM events WHERE event_type <> 'error' GROUP BY 1, 2)
  SELECT user_id, datetime, round(low + 3.3e-8, 6) AS low, round(k + 3.3e-8, 6) AS k FROM w JOIN a USING (user_id, datetime)"""
)
def merged_feeds(spark, sf_dir):
    """Both sides hold several rows per user and hour; the lowest one counts."""
    from aerolith import SeriesSpec

    rows = events(spark, sf_dir).withColumn("datetime", F.date_trunc("hour", "ts"))
    left = rows.select("user_id", "datetime", F.col("value").alias("low"))
    k = F.get_json_object("props", "$.k").cast("double").alias("k")
    right = rows.filter(F.col("event_type") != "error").select("user_id", "datetime", k)
    return feeds.merge_feeds(left, right, SeriesSpec(keys=("user_id",)))


@query(with_(OBS) + f"SELECT {cols('city datetime', MEASURES_SQL)} FROM obs")
def backfilled_observations(spark, sf_dir):
    """Daily payloads of both feeds, parsed, joined and stored."""
    from aerolith.plans.jobs import backfill

    rows = obs(spark, sf_dir)
    weather = feeds.pack_hourly(rows, SPEC, {c: c for c in WEATHER})
    air = feeds.pack_hourly(rows, SPEC, {own: feed for feed, own in POLLUTANT_FEED_NAMES.items()})
    path = scratch(spark, "backfill")
    backfill(weather, air, SPEC, path)
    return spark.read.parquet(path)


@query(with_(OBS) + "SELECT city, datetime, round(pm2_5 + 3.3e-8, 6) AS pm2_5 FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY datetime DESC) AS r FROM obs) WHERE r = 1")
def latest_record_json(spark, sf_dir):
    path = scratch(spark, "latest")
    tables.write_latest_json(feeds.newest_per_series(obs(spark, sf_dir), SPEC), path)
    return spark.read.schema("city string, datetime timestamp, pm2_5 double").json(path)
