"""Building blocks of the comparison SQL: the derived tables as CTEs."""

from __future__ import annotations

from collections.abc import Sequence

from aerolith.functions.risk import RISK_LEVELS
from aerolith.schema import LAGS, MEASURES, PLAUSIBLE, ROLLINGS
from aerolith.sources.events import EVENT_TYPES, USERS_PER_CITY

DEC = "CAST({} AS DECIMAL(12,2))"


def _sum(value: str, where: str = "") -> str:
    tail = f" FILTER (WHERE {where})" if where else ""
    return f"CAST(sum({DEC.format(value)}){tail} AS DOUBLE)"


def _mean(value: str, where: str = "") -> str:
    tail = f" FILTER (WHERE {where})" if where else ""
    return f"{_sum(value, where)} / nullif(count({value}){tail}, 0)"


def _of(kind: str) -> str:
    return f"event_type = '{kind}'"


K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"

OBS = f"""obs AS (
  SELECT 'city_' || CAST(user_id // {USERS_PER_CITY} AS VARCHAR) AS city, date_trunc('hour', ts) AS datetime,
    {_mean('value', _of('view'))} AS temperature_2m,
    sum({K}) / count({K}) AS relative_humidity_2m,
    min(value) AS dew_point_2m,
    {_mean('value', _of('click'))} AS apparent_temperature,
    CAST(count(*) FILTER (WHERE {_of('error')}) AS DOUBLE) AS precipitation,
    CAST(count(*) FILTER (WHERE {_of('signup')}) AS DOUBLE) AS rain,
    max(value) + 900 AS surface_pressure,
    max({K}) AS cloud_cover,
    {_mean('value', _of('purchase'))} AS wind_speed_10m,
    {_sum('value')} AS wind_direction_10m,
    {_mean('value')} AS pm2_5,
    max(value) AS pm10,
    {_mean('value', _of('error'))} AS no2,
    min({K}) AS so2,
    {_sum('value')} * 10 AS co,
    {_mean('value', _of('signup'))} AS o3
  FROM events GROUP BY 1, 2)"""

H_TYPE = f"""h_type AS (
  SELECT event_type, date_trunc('hour', ts) AS datetime, {_mean('value')} AS v FROM events GROUP BY 1, 2)"""

H_ALL = f"""h_all AS (
  SELECT 'all' AS city, date_trunc('hour', ts) AS datetime, {_mean('value')} AS v FROM events GROUP BY 2)"""

H_WIDE = f"""h_wide AS (
  SELECT 'all' AS city, date_trunc('hour', ts) AS datetime,
    {", ".join(f"{_mean('value', _of(t))} AS {t}_v" for t in EVENT_TYPES)}
  FROM events GROUP BY 2)"""


def interpolated(source: str, name: str, columns: Sequence[str], key: str = "city", limit: int = 3) -> str:
    """CTEs that fill ``columns`` in two written-out passes."""
    w = f"PARTITION BY {key} ORDER BY datetime"
    sides, first, back, both = [], [], [], []
    for c in columns:
        known = f"CASE WHEN {c} IS NOT NULL THEN {{}} END"
        for col in ("rn", "datetime"):
            sides.append(f"last_value({known.format(col)} IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}_p_{col}")
            sides.append(f"first_value({known.format(col)} IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}_q_{col}")
        sides.append(f"last_value({c} IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}_p")
        sides.append(f"first_value({c} IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}_q")
        near = f"(rn - {c}_p_rn <= {limit} OR {c}_q_rn - rn <= {limit})"
        line = (
            f"{c}_p + ({c}_q - {c}_p) / (epoch_us({c}_q_datetime) - epoch_us({c}_p_datetime)) * (epoch_us(datetime) - epoch_us({c}_p_datetime))"
        )
        first.append(
            f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_p IS NOT NULL AND {c}_q IS NOT NULL THEN CASE WHEN {near} THEN {line} END"
            f" WHEN {near} THEN coalesce({c}_q, {c}_p) END AS {c}"
        )
        back.append(f"first_value({c} IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}")
        both.append(f"last_value({c} IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}")
    return f"""{name}_rn AS (SELECT *, row_number() OVER ({w}) AS rn FROM {source}),
  {name}_sides AS (SELECT *, {", ".join(sides)} FROM {name}_rn),
  {name}_first AS (SELECT {key}, datetime, {", ".join(first)} FROM {name}_sides),
  {name}_back AS (SELECT {key}, datetime, {", ".join(back)} FROM {name}_first),
  {name} AS (SELECT {key}, datetime, {", ".join(both)} FROM {name}_back)"""


def clip(column: str, low: float, high: float) -> str:
    return f"CASE WHEN {column} < {low} THEN {low} WHEN {column} > {high} THEN {high} ELSE {column} END"


CLEAN = (
    interpolated("obs", "filled", MEASURES)
    + f""",
  clean AS (SELECT city, datetime, {", ".join(f"{clip(c, *PLAUSIBLE[c])} AS {c}" for c in MEASURES)} FROM filled)"""
)

WEEKDAY = "CAST((isodow(datetime) - 1) AS INTEGER)"
CALENDAR_SQL = f"""CAST(year(datetime) AS INTEGER) AS year, CAST(month(datetime) AS INTEGER) AS month,
    CAST(day(datetime) AS INTEGER) AS day, CAST(hour(datetime) AS INTEGER) AS hour, {WEEKDAY} AS weekday,
    CAST(CASE WHEN isodow(datetime) IN (6, 7) THEN 1 ELSE 0 END AS INTEGER) AS is_weekend"""
CYCLIC_SQL = """sin(2 * pi() * hour(datetime) / 24) AS hour_sin, cos(2 * pi() * hour(datetime) / 24) AS hour_cos,
    sin(2 * pi() * month(datetime) / 12) AS month_sin, cos(2 * pi() * month(datetime) / 12) AS month_cos"""
INTERACTION_SQL = "temperature_2m * relative_humidity_2m AS temp_humidity, wind_speed_10m * pm2_5 AS wind_pm25"


def lag_sql(value: str = "pm2_5", key: str = "city") -> str:
    return ", ".join(f"lag({value}, {n}) OVER (PARTITION BY {key} ORDER BY datetime) AS pm25_lag_{n}" for n in LAGS)


def rolling_sql(value: str = "pm2_5", key: str = "city", half_full: bool = False) -> str:
    parts = []
    for n in ROLLINGS:
        frame = f"OVER (PARTITION BY {key} ORDER BY datetime ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        enough = f"count({value}) {frame} >= {max(1, n // 2) if half_full else n}"
        std = f"CASE WHEN {enough} THEN stddev_samp({value}) {frame} END"
        parts.append(f"CASE WHEN {enough} THEN avg({value}) {frame} END AS pm25_roll_mean_{n}")
        parts.append(f"{f'coalesce({std}, 0)' if half_full else std} AS pm25_roll_std_{n}")
    return ", ".join(parts)


LEAD_SQL = "lead(pm2_5, 1) OVER (PARTITION BY city ORDER BY datetime) AS target_pm25"

FEAT = f"""wide AS (
  SELECT *, {lag_sql()}, {rolling_sql()}, {INTERACTION_SQL}, {CALENDAR_SQL}, {CYCLIC_SQL}, {LEAD_SQL} FROM clean),
  feat AS (SELECT * FROM wide WHERE pm25_lag_168 IS NOT NULL AND target_pm25 IS NOT NULL
    AND {" AND ".join(f"{c} IS NOT NULL" for c in MEASURES)})"""

LIVE = f"""live_wide AS (
  SELECT *, {lag_sql()}, {rolling_sql(half_full=True)}, {INTERACTION_SQL}, {CALENDAR_SQL}, {CYCLIC_SQL},
    row_number() OVER (PARTITION BY city ORDER BY datetime DESC) AS newest FROM clean),
  live AS (SELECT * EXCLUDE (newest) FROM live_wide WHERE newest = 1)"""

MODEL = {"pm2_5": 0.6, "pm25_lag_24": 0.2, "pm25_roll_mean_24": 0.1}
INTERCEPT = 1.0
SCORE = f"({INTERCEPT} + 0.6 * pm2_5 + 0.2 * pm25_lag_24 + 0.1 * pm25_roll_mean_24)"


def risk_case(value: str, pick: int) -> str:
    whens = " ".join(f"WHEN {value} <= {level[0]} THEN '{level[pick]}'" for level in RISK_LEVELS[:-1])
    return f"CASE WHEN {value} IS NULL THEN NULL {whens} ELSE '{RISK_LEVELS[-1][pick]}' END"


def risk_sql(value: str) -> str:
    return f"{risk_case(value, 1)} AS aqi_category, {risk_case(value, 2)} AS color_code, {risk_case(value, 3)} AS health_advisory"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def cols(plain: str, doubles: str = "") -> str:
    """Select list: ``plain`` columns as they are, ``doubles`` rounded as the Spark side is."""
    return ", ".join([*plain.split(), *[f"round({c} + 3.3e-8, 6) AS {c}" for c in doubles.split()]])


MEASURES_SQL = " ".join(MEASURES)
CALENDAR_NAMES = "year month day hour weekday is_weekend"
LAG_NAMES = " ".join(f"pm25_lag_{n}" for n in LAGS)
ROLL_NAMES = " ".join(f"pm25_roll_{s}_{n}" for n in ROLLINGS for s in ("mean", "std"))
CYCLIC_NAMES = "hour_sin hour_cos month_sin month_cos"
