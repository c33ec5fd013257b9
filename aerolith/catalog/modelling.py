"""Scaling, models, scoring, forecast and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.catalog import NUDGE, SPEC, clean, feat, h_type, obs, query
from aerolith.catalog.explore import r6
from aerolith.catalog.ingest import scratch
from aerolith.catalog.sql import (
    CLEAN,
    FEAT,
    H_TYPE,
    INTERCEPT,
    LIVE,
    MODEL,
    OBS,
    SCORE,
    risk_sql,
    with_,
)
from aerolith.functions.risk import OUTDOOR_LIMIT, OUTDOOR_OK, SENSITIVE_LIMIT, SENSITIVE_OK, interval_columns, risk_columns
from aerolith.operators import explain as Ex
from aerolith.operators import forecast as Fc
from aerolith.operators import stats as St
from aerolith.operators.chunks import latest_rows
from aerolith.operators.features import live_features
from aerolith.operators.split import scale_columns, standard_moments, time_split
from aerolith.plans import models as M
from aerolith.plans import scoring as Sc
from aerolith.plans.registry import ModelRegistry, tree_nodes
from aerolith.schema import SELECTED_FEATURES, TARGET
from aerolith.session import stage

BASE = with_(OBS, CLEAN, FEAT)
PREDICT = Sc.linear_model(MODEL, INTERCEPT)
SCALED = SELECTED_FEATURES

_SPLIT = """s AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY datetime) <= floor(count(*) OVER (PARTITION BY city) * CAST(0.8 AS DOUBLE)) AS is_train FROM feat),
  mo AS (SELECT {} FROM s WHERE is_train)""".format(
    ", ".join(f"avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS {c}_s" for c in SCALED)
)


@query(
    with_(OBS, CLEAN, FEAT, _SPLIT)
    + "SELECT city, datetime, CASE WHEN is_train THEN 'train' ELSE 'test' END AS split, "
    + ", ".join(r6(f"({c} - {c}_m) / {c}_s", f"{c}_z") for c in SCALED)
    + " FROM s, mo"
)
def scaled_features(spark, sf_dir):
    """Moments of the train rows, applied to all."""
    rows = time_split(feat(spark, sf_dir), SPEC)
    moments = standard_moments(rows.filter(F.col("split") == "train"), SCALED)
    return scale_columns(rows, moments).select("city", "datetime", "split", *[f"{c}_z" for c in SCALED])


def training(spark, sf_dir):
    return M.TrainingData.of(feat(spark, sf_dir), SPEC, SELECTED_FEATURES)


@query()
def leaderboard(spark, sf_dir):
    board, _, _ = M.compare(training(spark, sf_dir))
    return board.drop("train_time_sec")


_RIVALS = {"half": 0.5, "most": 0.8, "all": 1.0}


@query(
    BASE
    + "SELECT model, rmse FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS model, {r6(f'sqrt(avg(pow(target_pm25 - {w} * pm2_5, 2)))', 'rmse')} FROM feat" for n, w in _RIVALS.items())
    + ") ORDER BY rmse, model LIMIT 1"
)
def champion_by_rmse(spark, sf_dir):
    """Three persistence rules as candidates; one pass scores them all."""
    rival = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.lit(w).alias("w")) for n, w in _RIVALS.items()]))
    rows = feat(spark, sf_dir).select(TARGET, "pm2_5", rival.alias("_m")).select(TARGET, "_m.model", (F.col("_m.w") * F.col("pm2_5")).alias("p"))
    return St.regression_metrics(rows, TARGET, "p", ["model"]).select("model", "rmse").orderBy("rmse", "model").limit(1)


@query()
def tuned_ridge(spark, sf_dir):
    data = training(spark, sf_dir)
    _, best, rmse = M.tune(M.RIDGE, data, SPEC)
    return spark.createDataFrame([(M.RIDGE, float(best["alpha"]), float(rmse), data.rows)], "model string, alpha double, cv_rmse double, train_rows long")


@query()
def trained_champion_scores(spark, sf_dir):
    """Train, register, load the champion and score the latest row of each series."""
    registry = ModelRegistry(spark, scratch(spark, "models"))
    M.train(feat(spark, sf_dir), SPEC, SELECTED_FEATURES, registry)
    model, meta = registry.load()
    latest = live_features(clean(spark, sf_dir), SPEC)
    return Sc.score(latest, model.transform, meta["features"], ["city", "datetime"])


SCORED_SQL = f"s AS (SELECT *, CASE WHEN {SCORE} < 0 THEN 0 ELSE {SCORE} END AS p FROM {{}})"


@query(with_(OBS, CLEAN, FEAT, SCORED_SQL.format("feat")) + f"SELECT city, datetime, round(p, 2) AS predicted_target_pm25, {risk_sql('p')} FROM s")
def batch_scores(spark, sf_dir):
    return Sc.score(feat(spark, sf_dir), PREDICT, list(MODEL), ["city", "datetime"])


@query(
    with_(OBS, CLEAN, LIVE, SCORED_SQL.format("live"))
    + f"""SELECT city, TIMESTAMP '2024-02-01 00:00:00' AS prediction_time, datetime AS input_timestamp, {r6('pm2_5', 'current_pm25')},
  round(p, 2) AS predicted_next_hour_pm25, {risk_sql('p')}, 'Linear Regression' AS champion_model FROM s"""
)
def prediction_log(spark, sf_dir):
    latest = live_features(clean(spark, sf_dir), SPEC)
    scored = Sc.score(latest, PREDICT, list(MODEL), ["city", "datetime", "pm2_5"])
    return Sc.prediction_log(scored, ["city"], "Linear Regression", F.lit("2024-02-01 00:00:00").cast("timestamp"))


@query("SELECT event_id, " + risk_sql("value") + " FROM events")
def risk_categories(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", "value").withColumns(risk_columns(F.col("value"))).drop("value")


NEWEST = "n AS (SELECT city, datetime, coalesce(no2, 25.0) AS v FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY datetime DESC) AS r FROM obs) WHERE r = 1)"


@query(with_(OBS, NEWEST) + f"SELECT city, datetime, {r6('v', 'current_pm25')}, {risk_sql('v')} FROM n")
def current_status(spark, sf_dir):
    from aerolith.sources.feeds import newest_per_series

    return Sc.current_status(newest_per_series(obs(spark, sf_dir), SPEC), ["city"], value="no2")


@query(
    with_(OBS)
    + f"""SELECT city, datetime, {r6('coalesce(no2, 25.0)', 'current_pm25')}, {risk_sql('coalesce(no2, 25.0)')}, coalesce(no2, 25.0) > 55.4 AS is_hazardous,
  CASE WHEN coalesce(no2, 25.0) > 35.4 THEN '{OUTDOOR_LIMIT}' ELSE '{OUTDOOR_OK}' END AS general_population,
  CASE WHEN coalesce(no2, 25.0) > 35.4 THEN '{SENSITIVE_LIMIT}' ELSE '{SENSITIVE_OK}' END AS sensitive_groups,
  coalesce(no2, 25.0) > 55.4 AS mask_recommended, coalesce(no2, 25.0) > 35.4 AS air_purifier_recommended FROM obs"""
)
def health_alerts(spark, sf_dir):
    return Sc.health_alerts(obs(spark, sf_dir), ["city"], value="no2")


@query(
    with_(OBS, CLEAN)
    + f"""SELECT city, datetime, {r6('greatest(0, pm2_5 - 1.645 * 2.4 * (1 + 0.015 * sqrt(hour(datetime) + 1)))', 'lower_bound_90')},
  {r6('pm2_5 + 1.645 * 2.4 * (1 + 0.015 * sqrt(hour(datetime) + 1))', 'upper_bound_90')} FROM clean"""
)
def prediction_intervals(spark, sf_dir):
    rows = clean(spark, sf_dir).select("city", "datetime", "pm2_5")
    return rows.withColumns(interval_columns(F.col("pm2_5"), F.hour("datetime") + 1)).drop("pm2_5")


# --- forecast ----------------------------------------------------------------------------------

_SLICE24 = "b[-24:]"
_RAW = f"({INTERCEPT} + 0.6 * b[-1] + 0.2 * b[-24] + 0.1 * list_avg({_SLICE24}))"
FORECAST = f"""hist AS (SELECT event_type, max(datetime) AS base, list(v ORDER BY datetime) AS b0 FROM h_type GROUP BY 1),
  start AS (SELECT event_type, base, CASE WHEN len(b0) >= 72 THEN b0[-169:] ELSE list_resize(CAST([] AS DOUBLE[]), 72, b0[-1]) END AS b FROM hist),
  steps AS (SELECT event_type, base, 0 AS step, b FROM start
    UNION ALL SELECT event_type, base, step + 1, list_append(b, greatest(0.5, round(greatest({_RAW}, 0), 2))) FROM steps WHERE step < 72),
  fc AS (SELECT event_type, CAST(step AS INTEGER) AS step, base + to_hours(CAST(step AS BIGINT)) AS forecast_ts, b[-1] AS predicted FROM steps WHERE step > 0)"""


def forecast_input(spark, sf_dir):
    """Newest hourly means per event type, with held weather columns the model ignores."""
    hourly = h_type(spark, sf_dir).withColumnRenamed("v", "pm2_5")
    held = {c: F.lit(0.0) for c in ("temperature_2m", "relative_humidity_2m", "wind_speed_10m")}
    spec = type(SPEC)(keys=("event_type",))
    return Fc.forecast_state(hourly, latest_rows(hourly, spec).withColumns(held), spec), spec


@query(
    "WITH RECURSIVE " + H_TYPE + ", " + FORECAST
    + f""" SELECT event_type, step, forecast_ts, strftime(forecast_ts, '%a %I:%M %p') AS forecast_hour_display, CAST((step - 1) // 24 + 1 AS INTEGER) AS day_offset,
  {r6('predicted', 'predicted')}, {r6('greatest(0, predicted - 1.645 * 2.4 * (1 + 0.015 * sqrt(step)))', 'lower_bound_90')},
  {r6('predicted + 1.645 * 2.4 * (1 + 0.015 * sqrt(step))', 'upper_bound_90')}, {risk_sql('predicted')} FROM fc"""
)
def forecast_72_hours(spark, sf_dir):
    state, spec = forecast_input(spark, sf_dir)
    return Fc.forecast_linear(state, spec, MODEL, INTERCEPT)


@query(
    "WITH RECURSIVE " + H_TYPE + ", " + FORECAST
    + f""", d AS (SELECT event_type, CAST((step - 1) // 24 + 1 AS INTEGER) AS day_offset, strftime(min(forecast_ts), '%A, %b %d') AS day_name, avg(predicted) AS a,
    max(predicted) AS hi, min(predicted) AS lo, first(strftime(forecast_ts, '%a %I:%M %p') ORDER BY predicted DESC, step) AS peak_hour FROM fc GROUP BY 1, 2)
  SELECT event_type, day_offset, day_name, {r6('a', 'avg_value')}, {r6('hi', 'max_value')}, {r6('lo', 'min_value')}, peak_hour, {risk_sql('a')} FROM d"""
)
def forecast_daily_summary(spark, sf_dir):
    state, spec = forecast_input(spark, sf_dir)
    return Fc.daily_summary(Fc.forecast_linear(state, spec, MODEL, INTERCEPT), spec)


# A weight for each of the 18 inputs.
WHOLE = {
    "pm2_5": 0.4137,
    "pm25_roll_mean_24": 0.1511,
    "pm25_roll_mean_72": 0.0713,
    "pm25_lag_24": 0.0917,
    "pm10": 0.0119,
    "co": 0.0007,
    "pm25_roll_std_24": 0.0523,
    "pm25_roll_std_72": 0.0311,
    "so2": 0.0171,
    "no2": 0.0237,
    "wind_pm25": 0.0013,
    "pm25_lag_48": 0.0419,
    "pm25_lag_72": 0.0331,
    "month_cos": 0.7011,
    "temp_humidity": 0.0003,
    "surface_pressure": 0.0009,
    "apparent_temperature": 0.0127,
    "wind_speed_10m": 0.0211,
}


def _whole_sql(mode: str) -> str:
    """The recursion over each city's newest values, held columns from its newest clean row."""
    replay = mode == "replay"
    at = "step + 1" if replay else "step"
    changing = {
        "pm2_5": "b[-1]",
        "wind_pm25": "wind_speed_10m * b[-1]",
        "temp_humidity": "temperature_2m * relative_humidity_2m",
        "month_cos": f"cos(2 * pi() * month(base + to_hours(CAST({at} AS BIGINT))) / 12)",
        **{f"pm25_lag_{n}": f"b[-{n}]" if replay else f"b[len(b) - {n}]" for n in (24, 48, 72)},
        **{f"pm25_roll_mean_{n}": f"list_avg(b[-{n}:])" for n in (24, 72)},
        **{f"pm25_roll_std_{n}": f"list_aggregate(b[-{n}:], '{'stddev_pop' if replay else 'stddev_samp'}')" for n in (24, 72)},
    }
    raw = f"{INTERCEPT} + " + " + ".join(f"{w} * {changing.get(c, c)}" for c, w in WHOLE.items())
    held = "temperature_2m, relative_humidity_2m, wind_speed_10m, pm10, co, so2, no2, surface_pressure, apparent_temperature"
    steps = f"""hist AS (SELECT city, max(datetime) AS base, list(pm2_5 ORDER BY datetime) AS b0 FROM clean GROUP BY city),
  start AS (SELECT city, base, {held}, CASE WHEN len(b0) >= 72 THEN b0[-169:] ELSE list_resize(CAST([] AS DOUBLE[]), 72, b0[-1]) END AS b
    FROM hist JOIN (SELECT city, datetime AS base, {held} FROM clean) USING (city, base)),
  steps AS (SELECT city, base, {held}, 0 AS step, b FROM start
    UNION ALL SELECT city, base, {held}, step + 1, list_append(b, greatest(0.5, round(greatest({raw}, 0), 2))) FROM steps WHERE step < 72)"""
    return (
        "WITH RECURSIVE " + OBS + ", " + CLEAN + ", " + steps
        + f" SELECT city, CAST(step AS INTEGER) AS step, base + to_hours(CAST(step AS BIGINT)) AS forecast_ts, {r6('b[-1]', 'predicted')}, {risk_sql('b[-1]')} FROM steps WHERE step > 0"
    )


def city_forecast(spark, sf_dir, mode):
    rows = clean(spark, sf_dir)
    state = Fc.forecast_state(rows, latest_rows(rows, SPEC), SPEC)
    return Fc.forecast_linear(state, SPEC, WHOLE, INTERCEPT, mode=mode).select("city", "step", "forecast_ts", "predicted", "aqi_category", "color_code", "health_advisory")


@query(_whole_sql("replay"))
def city_forecast_72_hours(spark, sf_dir):
    """All 18 inputs, weather held from the newest clean row."""
    return city_forecast(spark, sf_dir, "replay")


@query(_whole_sql("training"))
def city_forecast_training_mode(spark, sf_dir):
    return city_forecast(spark, sf_dir, "training")


WHOLE_SCORE = f"({INTERCEPT} + " + " + ".join(f"{w} * {c}" for c, w in WHOLE.items()) + ")"


@query(with_(OBS, CLEAN, FEAT, f"s AS (SELECT *, greatest({WHOLE_SCORE}, 0) AS p FROM feat)") + f"SELECT city, datetime, round(p, 2) AS predicted_target_pm25, {risk_sql('p')} FROM s")
def batch_scores_all_inputs(spark, sf_dir):
    return Sc.score(feat(spark, sf_dir), Sc.linear_model(WHOLE, INTERCEPT), list(WHOLE), ["city", "datetime"])


@query()
def forecast_with_boosted_trees(spark, sf_dir):
    """72 steps of a fitted ensemble for every city."""
    data = training(spark, sf_dir)
    model = M.fit(M.BOOST, data)
    rows = clean(spark, sf_dir)
    state = Fc.forecast_state(rows, live_features(rows, SPEC), SPEC)
    return Fc.forecast_model(stage(state), SPEC, model.transform, SELECTED_FEATURES)


# --- what-if -----------------------------------------------------------------------------------

_CHANGES = {
    "pm2_5": [0.8, 1.2],
    "pm10": [0.9, 1.1],
    "no2": [0.9, 1.1],
    "co": [0.9, 1.1],
    "o3": [0.9, 1.1],
    "temperature_2m": [0.9, 1.1],
    "relative_humidity_2m": [0.9, 1.1],
    "wind_speed_10m": [0.5, 2.0],
    "surface_pressure": [0.99, 1.01],
}
_WHAT_IF = {
    "pm2_5": 0.5137,
    "pm10": 0.0113,
    "no2": 0.0207,
    "co": -0.0011,
    "o3": 0.0171,
    "surface_pressure": 0.0031,
    "pm25_lag_24": 0.2071,
    "pm25_roll_std_24": 0.3019,
    "wind_pm25": -0.0010357,
    "temp_humidity": 0.0020713,
    "apparent_temperature": 0.0507,
    "month_cos": 1.0091,
}


def _what_if_sql():
    changed = ", ".join(f"{c} * {c}_factor AS {c}, {c}_factor" for c in _CHANGES)
    grid = ", ".join(f"(SELECT unnest({factors})::DOUBLE AS {c}_factor)" for c, factors in _CHANGES.items())
    newest = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY datetime DESC) AS r FROM clean) WHERE r = 1)"
    score = (
        "1.0 + 0.5137 * pm2_5 + 0.0113 * pm10 + 0.0207 * no2 - 0.0011 * co + 0.0171 * o3 + 0.0031 * surface_pressure + 0.2071 * pm2_5 + 0.3019 * 3.5"
        " - 0.0010357 * wind_speed_10m * pm2_5 + 0.0020713 * temperature_2m * relative_humidity_2m + 0.0507 * (temperature_2m + 2.0) + 1.0091 * -0.5"
    )
    return (
        with_(OBS, CLEAN, newest, f"c AS (SELECT city, datetime, {changed} FROM newest, {grid})", f"s AS (SELECT *, {score} AS raw FROM c)", "t AS (SELECT *, CASE WHEN raw < 0 THEN 0 ELSE raw END AS p FROM s)")
        + f"SELECT city, datetime, {', '.join(f'{c}_factor' for c in _CHANGES)}, round(p, 2) AS predicted_target_pm25, {risk_sql('p')} FROM t"
    )


@query(_what_if_sql())
def what_if_grid(spark, sf_dir):
    """Every combination of the factors of nine inputs, for the newest row of each series."""
    newest = latest_rows(clean(spark, sf_dir), SPEC)
    scenarios = Sc.what_if_features(Sc.scenario_grid(newest, _CHANGES))
    return Sc.score(scenarios, Sc.linear_model(_WHAT_IF, 1.0), list(_WHAT_IF), ["city", "datetime", *[f"{c}_factor" for c in _CHANGES]])


_FACTORS = [f"{c}_factor" for c in _CHANGES]


def _all_changes_sql():
    single = " UNION ALL ".join(
        f"SELECT city, datetime, '{c}' AS changed, CAST({f} AS DOUBLE) AS factor, "
        + ", ".join(f"{x} * {f} AS {x}, CAST({f} AS DOUBLE) AS {x}_factor" if x == c else f"{x}, CAST(1 AS DOUBLE) AS {x}_factor" for x in _CHANGES)
        + " FROM clean"
        for c, factors in _CHANGES.items()
        for f in factors
    )
    grid = ", ".join(f"(SELECT unnest({factors})::DOUBLE AS {c}_factor)" for c, factors in _CHANGES.items())
    newest = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY datetime DESC) AS r FROM clean) WHERE r = 1)"
    every = f"SELECT city, datetime, 'all' AS changed, CAST(NULL AS DOUBLE) AS factor, {', '.join(f'{c} * {c}_factor AS {c}, {c}_factor' for c in _CHANGES)} FROM newest, {grid}"
    score = (
        "1.0 + 0.5137 * pm2_5 + 0.0113 * pm10 + 0.0207 * no2 - 0.0011 * co + 0.0171 * o3 + 0.0031 * surface_pressure + 0.2071 * pm2_5 + 0.3019 * 3.5"
        " - 0.0010357 * wind_speed_10m * pm2_5 + 0.0020713 * temperature_2m * relative_humidity_2m + 0.0507 * (temperature_2m + 2.0) + 1.0091 * -0.5"
    )
    return (
        with_(OBS, CLEAN, newest, f"c AS ({single} UNION ALL {every})", f"s AS (SELECT *, {score} AS raw FROM c)", "t AS (SELECT *, CASE WHEN raw < 0 THEN 0 ELSE raw END AS p FROM s)")
        + f"SELECT city, datetime, changed, factor, {', '.join(_FACTORS)}, round(p, 2) AS predicted_target_pm25, {risk_sql('p')} FROM t"
    )


@query(_all_changes_sql())
def what_if_scores(spark, sf_dir):
    """Every row of every series under each single change of nine inputs, and the newest of each under all of them at once."""
    rows = clean(spark, sf_dir)
    single = Sc.scenario_rows(rows, _CHANGES).withColumns({f"{c}_factor": F.when(F.col("changed") == c, F.col("factor")).otherwise(1.0) for c in _CHANGES})
    every = Sc.scenario_grid(latest_rows(rows, SPEC), _CHANGES).withColumns({"changed": F.lit("all"), "factor": F.lit(None).cast("double")})
    scenarios = Sc.what_if_features(single.unionByName(every))
    return Sc.score(scenarios, Sc.linear_model(_WHAT_IF, 1.0), list(_WHAT_IF), ["city", "datetime", "changed", "factor", *_FACTORS])


# --- attribution -------------------------------------------------------------------------------

MEANS = {"pm2_5": 75.0, "pm25_lag_24": 74.0, "pm25_roll_mean_24": 73.0}
_AMOUNT = {c: f"{w} * ({c} - {MEANS[c]})" for c, w in MODEL.items()}
BASE_VALUE = INTERCEPT + sum(w * MEANS[c] for c, w in MODEL.items())


def _long(amounts, source="feat"):
    return " UNION ALL ".join(
        f"SELECT city, datetime, '{c}' AS feature, {c} AS value, {a} AS shap_value, '{Ex.FRIENDLY_NAMES[c]}' AS display_name FROM {source}".replace("Yesterday's", "Yesterday''s")
        for c, a in amounts.items()
    )


_LONG_PICK = (
    f"{r6('value', 'value')}, {r6('shap_value', 'shap_value')}, CASE WHEN shap_value > 0 THEN 'Increases PM2.5' ELSE 'Decreases PM2.5' END AS direction, "
    f"{r6('abs(shap_value)', 'abs_impact')}, display_name"
)


@query(with_(OBS, CLEAN, FEAT, f"l AS ({_long(_AMOUNT)})") + f"SELECT city, datetime, {r6(str(BASE_VALUE), 'base_value')}, feature, {_LONG_PICK} FROM l")
def linear_attribution(spark, sf_dir):
    return Ex.contribution_rows(Ex.explain_linear(feat(spark, sf_dir), MODEL, INTERCEPT, MEANS), ["city", "datetime"])


_IMPORTANCE = {"pm2_5": 0.5, "pm25_lag_24": 0.3, "pm25_roll_mean_24": 0.2}


@query(
    with_(OBS, CLEAN, FEAT, "l AS (" + _long({c: f"{w} * ({SCORE} - 25.0)" for c, w in _IMPORTANCE.items()}) + ")")
    + f"SELECT city, datetime, CAST(25.0 AS DOUBLE) AS base_value, feature, {_LONG_PICK} FROM l"
)
def importance_attribution(spark, sf_dir):
    return Ex.contribution_rows(Ex.explain_by_importance(PREDICT(feat(spark, sf_dir)), _IMPORTANCE), ["city", "datetime"])


@query(
    with_(
        OBS,
        CLEAN,
        FEAT,
        f"l AS ({_long(_AMOUNT)})",
        "t AS (SELECT *, CAST(sign(shap_value) AS INTEGER) AS sg, CAST(row_number() OVER (PARTITION BY city, datetime, sign(shap_value) ORDER BY abs(shap_value) DESC, feature) AS INTEGER) AS place FROM l WHERE shap_value <> 0)",
    )
    + f"SELECT city, datetime, sg AS sign, place, feature, {r6('shap_value', 'shap_value')} FROM t WHERE place <= 2"
)
def top_contributions(spark, sf_dir):
    explained = Ex.explain_linear(feat(spark, sf_dir), MODEL, INTERCEPT, MEANS)
    return Ex.top_contributions(explained, ["city", "datetime"]).select("city", "datetime", "sign", "place", "feature", "shap_value")


def _listed(sign: str, item: str) -> str:
    chosen = f"shap_value {sign} 0 AND place <= 2"
    return f"string_agg(printf('{item}', display_name, shap_value + {NUDGE}), ', ' ORDER BY place) FILTER (WHERE {chosen})"


@query(
    with_(
        OBS,
        CLEAN,
        FEAT,
        f"l AS ({_long(_AMOUNT)})",
        "p AS (SELECT *, row_number() OVER (PARTITION BY city, datetime, sign(shap_value) ORDER BY abs(shap_value) DESC, feature) AS place FROM l)",
        f"t AS (SELECT city, datetime, {_listed('>', Ex.RAISING_ITEM)} AS up, {_listed('<', Ex.LOWERING_ITEM)} AS down FROM p GROUP BY city, datetime)",
        f"h AS (SELECT city, datetime, printf('{Ex.PREDICTED_TEXT}', {SCORE} + {NUDGE}, {BASE_VALUE!r} + {NUDGE}) AS head FROM feat)",
    )
    + f"""SELECT city, datetime, head || coalesce(chr(10) || chr(10) || '{Ex.RAISING_TEXT}' || up || '.', '')
  || coalesce(chr(10) || chr(10) || '{Ex.LOWERING_TEXT}' || down || '.', '') AS narrative_explanation FROM h JOIN t USING (city, datetime)"""
)
def narratives(spark, sf_dir):
    """The nudge keeps a printed digit from hanging on how an engine rounds an exact half."""
    explained = Ex.explain_linear(PREDICT(feat(spark, sf_dir)), MODEL, INTERCEPT, MEANS)
    nudged = F.transform("contributions", lambda c: c.withField("shap_value", c["shap_value"] + F.when(c["shap_value"] != 0, NUDGE).otherwise(0.0)))
    text = Ex.narrative(F.col("prediction") + NUDGE, F.col("base_value") + NUDGE, nudged)
    return explained.select("city", "datetime", text.alias("narrative_explanation"))


@query(BASE + "SELECT city, count(*) AS n, CAST(0 AS BIGINT) AS unexplained FROM feat GROUP BY city")
def tree_attribution_adds_up(spark, sf_dir):
    """Rows whose tree attributions and base do not sum to the prediction: none."""
    data = training(spark, sf_dir)
    model = M.fit(M.BOOST, data)
    nodes = tree_nodes(spark, model.stages[-1], scratch(spark, "trees"))
    rows = model.transform(feat(spark, sf_dir)).select("city", "datetime", *SELECTED_FEATURES, "prediction")
    explained = Ex.explain_trees(rows, SELECTED_FEATURES, nodes)
    total = sum((F.col(f"shap_{f}") for f in SELECTED_FEATURES), F.col("base_value"))
    return explained.groupBy("city").agg(F.count("*").alias("n"), F.count_if(F.abs(total - F.col("prediction")) > 1e-6).alias("unexplained"))


@query(with_(OBS, CLEAN, LIVE) + "SELECT city, datetime, CAST(18 AS BIGINT) AS n_features, TRUE AS adds_up FROM live WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in SELECTED_FEATURES))
def latest_explanations(spark, sf_dir):
    """From the stored linear champion to the sentence, for the newest row of each series."""
    from aerolith.plans.jobs import explain_latest

    registry = ModelRegistry(spark, scratch(spark, "models"))
    rows = feat(spark, sf_dir)
    latest = live_features(clean(spark, sf_dir), SPEC).dropna("any", subset=SELECTED_FEATURES)
    explained = explain_latest(latest, SPEC, registry, scratch(spark, "trees"), lambda: M.train(rows, SPEC, SELECTED_FEATURES, registry, candidates={M.LINEAR: {}}))
    total = F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c["shap_value"]) + F.col("base_value")
    whole = (F.abs(total - F.col("prediction")) < 1e-6) & F.col("narrative_explanation").contains("baseline expectation")
    return explained.select("city", "datetime", F.size("contributions").cast("long").alias("n_features"), whole.alias("adds_up"))


@query(with_(OBS, CLEAN, LIVE) + "SELECT city, datetime, CAST(18 AS BIGINT) AS n_features, TRUE AS adds_up, TRUE AS strongest_first FROM live WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in SELECTED_FEATURES))
def latest_tree_explanations(spark, sf_dir):
    """The same from a stored champion of boosted trees with its full settings: exact tree attribution."""
    from aerolith.plans.jobs import explain_latest

    registry = ModelRegistry(spark, scratch(spark, "models"))
    rows = feat(spark, sf_dir)
    latest = live_features(clean(spark, sf_dir), SPEC).dropna("any", subset=SELECTED_FEATURES)
    explained = explain_latest(latest, SPEC, registry, scratch(spark, "trees"), lambda: M.train(rows, SPEC, SELECTED_FEATURES, registry, candidates={M.BOOST: M.CANDIDATES[M.BOOST]}))
    total = F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c["shap_value"]) + F.col("base_value")
    impacts = F.transform("contributions", lambda c: c["abs_impact"])
    ordered = impacts == F.reverse(F.array_sort(impacts))
    return explained.select("city", "datetime", F.size("contributions").cast("long").alias("n_features"), (F.abs(total - F.col("prediction")) < 1e-6).alias("adds_up"), ordered.alias("strongest_first"))


@query()
def global_importance(spark, sf_dir):
    model = M.fit(M.FOREST, training(spark, sf_dir))
    return Ex.global_importance(spark, SELECTED_FEATURES, model.stages[-1].featureImportances.toArray())


@query()
def selected_feature_table(spark, sf_dir):
    """The selection job: scores, list, narrowed table."""
    from aerolith.plans.jobs import select_features

    path = scratch(spark, "selection")
    select_features(feat(spark, sf_dir), SPEC, path)
    return spark.read.parquet(f"{path}/selected")


