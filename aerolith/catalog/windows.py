"""Ordered-series queries: cleaning, features, gaps, ranks, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith import SeriesSpec
from aerolith.catalog import SPEC, TYPE_SPEC, clean, events, feat, h_all, h_type, h_wide, obs, query
from aerolith.catalog.sql import (
    CALENDAR_NAMES,
    CALENDAR_SQL,
    CLEAN,
    CYCLIC_NAMES,
    CYCLIC_SQL,
    FEAT,
    H_ALL,
    H_TYPE,
    H_WIDE,
    INTERACTION_SQL,
    LAG_NAMES,
    LIVE,
    MEASURES_SQL,
    OBS,
    ROLL_NAMES,
    cols,
    interpolated,
    lag_sql,
    rolling_sql,
    with_,
)
from aerolith.functions.calendar import day_label, hour_label, hour_of, month_label
from aerolith.operators import chunks
from aerolith.operators import clean as C
from aerolith.operators import features as X
from aerolith.operators import split as S
from aerolith.schema import MEASURES
from aerolith.sources import events as E

# Short chunks: the tables span 30 days, so frames of 168 rows reach over many of them.
SHORT = SeriesSpec(chunk_hours=100)
SHORT_TYPE = SeriesSpec(keys=("event_type",), chunk_hours=50)
FEATURE_NAMES = f"{MEASURES_SQL} {LAG_NAMES} {ROLL_NAMES} temp_humidity wind_pm25 {CYCLIC_NAMES}"


TRAINING_SQL = with_(OBS, CLEAN, FEAT) + f"SELECT {cols('city datetime ' + CALENDAR_NAMES, FEATURE_NAMES + ' target_pm25')} FROM feat"
FEATURE_ORDER = ["city", "datetime", *CALENDAR_NAMES.split(), *FEATURE_NAMES.split(), "target_pm25"]


@query(TRAINING_SQL)
def training_features(spark, sf_dir):
    return X.engineer_features(clean(spark, sf_dir), SPEC).select(*FEATURE_ORDER)


@query(TRAINING_SQL)
def training_features_short_chunks(spark, sf_dir):
    return X.engineer_features(clean(spark, sf_dir), SHORT).select(*FEATURE_ORDER)


FIRST_SLICE = (
    with_(
        H_ALL,
        f"""f AS (SELECT city, datetime, v, {lag_sql('v')}, {rolling_sql('v')}, lead(v, 1) OVER (PARTITION BY city ORDER BY datetime) AS target_pm25,
  {CALENDAR_SQL} FROM h_all)""",
    )
    + f"SELECT {cols('city datetime ' + CALENDAR_NAMES, 'v ' + LAG_NAMES + ' ' + ROLL_NAMES + ' target_pm25')} FROM f WHERE pm25_lag_168 IS NOT NULL AND target_pm25 IS NOT NULL"
)


@query(FIRST_SLICE)
def all_events_features(spark, sf_dir):
    rows = X.series_features(h_all(spark, sf_dir), SPEC, "v")
    return X.drop_incomplete(X.time_features(rows))


LIVE_NAMES = f"SELECT {cols('city datetime ' + CALENDAR_NAMES, FEATURE_NAMES)} FROM live"


@query(with_(OBS, CLEAN, LIVE) + LIVE_NAMES)
def live_features(spark, sf_dir):
    return X.live_features(clean(spark, sf_dir), SPEC).select(*FEATURE_ORDER[:-1])


@query(with_(OBS, CLEAN) + f"SELECT {cols('city datetime', MEASURES_SQL)} FROM clean")
def cleaned_observations(spark, sf_dir):
    return C.clean_observations(obs(spark, sf_dir), SPEC)


@query(with_(OBS, CLEAN) + f"SELECT {cols('city datetime', MEASURES_SQL)} FROM filled")
def interpolation_short_chunks(spark, sf_dir):
    return C.interpolate_gaps(obs(spark, sf_dir), SHORT, MEASURES)


WIDE_NAMES = " ".join(f"{t}_v" for t in E.EVENT_TYPES)


@query(with_(H_WIDE, interpolated("h_wide", "filled", WIDE_NAMES.split())) + f"SELECT {cols('city datetime', WIDE_NAMES)} FROM filled")
def interpolation_by_type(spark, sf_dir):
    return C.interpolate_gaps(h_wide(spark, sf_dir), SPEC, WIDE_NAMES.split())


def _fill_sql():
    w = "PARTITION BY city ORDER BY datetime"
    parts = ", ".join(
        f"coalesce(first_value({c} IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), "
        f"last_value({c} IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS {c}"
        for c in WIDE_NAMES.split()
    )
    return with_(H_WIDE, f"f AS (SELECT city, datetime, {parts} FROM h_wide)") + f"SELECT {cols('city datetime', WIDE_NAMES)} FROM f"


@query(_fill_sql())
def nearest_fill(spark, sf_dir):
    return C.fill_nearest(h_wide(spark, sf_dir), SeriesSpec(chunk_hours=60), WIDE_NAMES.split())


@query(with_(H_TYPE, f"f AS (SELECT *, {lag_sql('v', 'event_type')} FROM h_type)") + f"SELECT {cols('event_type datetime', 'v ' + LAG_NAMES)} FROM f")
def lag_features(spark, sf_dir):
    return X.lag_features(h_type(spark, sf_dir), SHORT_TYPE, "v")


@query(with_(H_TYPE, f"f AS (SELECT *, {rolling_sql('v', 'event_type')} FROM h_type)") + f"SELECT {cols('event_type datetime', 'v ' + ROLL_NAMES)} FROM f")
def rolling_features(spark, sf_dir):
    return X.rolling_features(h_type(spark, sf_dir), SHORT_TYPE, "v")


@query(
    with_(H_TYPE, f"f AS (SELECT *, {rolling_sql('v', 'event_type', True)} FROM h_type)")
    + f"SELECT {cols('event_type datetime', 'v ' + ROLL_NAMES)} FROM f"
)
def rolling_half_full(spark, sf_dir):
    return X.rolling_features(h_type(spark, sf_dir), TYPE_SPEC, "v", half_full=True)


@query(
    with_(H_TYPE, "f AS (SELECT *, lead(v, 3) OVER (PARTITION BY event_type ORDER BY datetime) AS target_pm25 FROM h_type)")
    + f"SELECT {cols('event_type datetime', 'v target_pm25')} FROM f"
)
def lead_target(spark, sf_dir):
    return X.lead_target(h_type(spark, sf_dir), SHORT_TYPE, "v", horizon=3)


@query(with_(OBS) + f"SELECT city, datetime, {CALENDAR_SQL} FROM obs")
def calendar_features(spark, sf_dir):
    return X.time_features(obs(spark, sf_dir).select("city", "datetime"))


@query(with_(OBS, f"c AS (SELECT city, datetime, {CYCLIC_SQL} FROM obs)") + f"SELECT {cols('city datetime', CYCLIC_NAMES)} FROM c")
def cyclic_features(spark, sf_dir):
    rows = X.time_features(obs(spark, sf_dir).select("city", "datetime"))
    return X.cyclic_features(rows).select("city", "datetime", *CYCLIC_NAMES.split())


@query(with_(OBS, f"c AS (SELECT city, datetime, {INTERACTION_SQL} FROM obs)") + f"SELECT {cols('city datetime', 'temp_humidity wind_pm25')} FROM c")
def interaction_features(spark, sf_dir):
    return X.interaction_features(obs(spark, sf_dir)).select("city", "datetime", "temp_humidity", "wind_pm25")


@query(
    "SELECT event_id, strftime(ts, '%a %I:%M %p') AS hour_label, strftime(ts, '%A, %b %d') AS day_label, strftime(ts, '%b') AS month_label, "
    "date_trunc('hour', ts) AS hour FROM events"
)
def display_formats(spark, sf_dir):
    ts = F.col("ts")
    return events(spark, sf_dir).select(
        "event_id", hour_label(ts).alias("hour_label"), day_label(ts).alias("day_label"), month_label(ts).alias("month_label"), hour_of(ts).alias("hour")
    )


GAPS = f"""gaps AS (SELECT event_type, p AS gap_start, datetime AS gap_end, epoch(datetime - p) / 3600.0 AS gap_hours FROM
  (SELECT event_type, datetime, lag(datetime) OVER (PARTITION BY event_type ORDER BY datetime) AS p FROM h_type) WHERE datetime - p > INTERVAL 1 HOUR)"""


@query(with_(H_TYPE, GAPS) + f"SELECT {cols('event_type gap_start gap_end', 'gap_hours')} FROM gaps")
def time_gaps(spark, sf_dir):
    return C.time_gaps(h_type(spark, sf_dir), SHORT_TYPE)


@query(with_(H_TYPE, GAPS) + "SELECT event_type, count(*) AS gap_count, round(max(gap_hours) + 3.3e-8, 6) AS longest_gap_hours FROM gaps GROUP BY 1")
def gap_summary(spark, sf_dir):
    return C.gap_summary(h_type(spark, sf_dir), TYPE_SPEC)


@query(with_(H_TYPE, GAPS) + f"SELECT {cols('event_type gap_start gap_end', 'gap_hours')} FROM gaps ORDER BY gap_start, event_type LIMIT 5")
def first_gaps(spark, sf_dir):
    return C.first_gaps(h_type(spark, sf_dir), TYPE_SPEC, 5)


@query(
    """SELECT event_type, datetime, event_id, value FROM (SELECT event_type, date_trunc('hour', ts) AS datetime, event_id, value,
  row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id) AS r FROM events) WHERE r = 1"""
)
def first_of_each_hour(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_type", F.date_trunc("hour", "ts").alias("datetime"), "event_id", "value")
    return C.drop_duplicate_times(rows, TYPE_SPEC, ["event_id"])


@query(
    """WITH c AS (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1, 2)
  SELECT event_type, CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_count FROM c GROUP BY 1"""
)
def duplicate_times(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_type", F.date_trunc("hour", "ts").alias("datetime"))
    return C.duplicate_time_count(rows, TYPE_SPEC)


def _newest(n):
    return f"SELECT event_type, datetime, round(v + 3.3e-8, 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY datetime DESC) AS r FROM h_type) WHERE r <= {n}"


@query(with_(H_TYPE) + _newest(1))
def latest_row(spark, sf_dir):
    return chunks.latest_rows(h_type(spark, sf_dir), TYPE_SPEC)


@query(with_(H_TYPE) + _newest(300))
def trailing_rows(spark, sf_dir):
    return chunks.latest_rows(h_type(spark, sf_dir), SHORT_TYPE, 300)


@query(
    with_(H_TYPE)
    + """SELECT event_type, CAST(row_number() OVER w AS BIGINT) AS position, CAST(count(*) OVER (PARTITION BY event_type) AS BIGINT) AS total,
  datetime FROM h_type WINDOW w AS (PARTITION BY event_type ORDER BY datetime)"""
)
def row_positions(spark, sf_dir):
    placed = chunks.with_position(h_type(spark, sf_dir), SHORT_TYPE, "position", "total")
    return placed.select("event_type", "position", "total", "datetime")


@query(
    with_(OBS, CLEAN, FEAT)
    + """SELECT city, datetime, CASE WHEN row_number() OVER (PARTITION BY city ORDER BY datetime) <= floor(count(*) OVER (PARTITION BY city) * CAST(0.8 AS DOUBLE))
  THEN 'train' ELSE 'test' END AS split FROM feat"""
)
def time_split(spark, sf_dir):
    return S.time_split(feat(spark, sf_dir), SPEC).select("city", "datetime", "split")


@query(
    with_(OBS, CLEAN, FEAT, "p AS (SELECT city, datetime, row_number() OVER (PARTITION BY city ORDER BY datetime) AS r, count(*) OVER (PARTITION BY city) AS n FROM feat)")
    + "SELECT city, datetime, CAST(CASE WHEN r <= n - 4 * (n // 5) THEN 0 ELSE (r - 1 - (n - 4 * (n // 5))) // (n // 5) + 1 END AS INTEGER) AS fold FROM p"
)
def expanding_folds(spark, sf_dir):
    return S.expanding_folds(feat(spark, sf_dir), SHORT).select("city", "datetime", "fold")
