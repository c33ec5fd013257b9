"""Monitoring: drift, outliers, spikes, index, predictions against what came, encodings, model versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.catalog import SPEC, TYPE_SPEC, clean, events, feat, h_type, obs, query
from aerolith.catalog.explore import r6
from aerolith.catalog.ingest import scratch
from aerolith.catalog.sql import CLEAN, FEAT, H_TYPE, INTERCEPT, MODEL, OBS, SCORE, with_
from aerolith.functions import index as I
from aerolith.operators import drift as D
from aerolith.operators import episodes as Ep
from aerolith.operators import match as Ma
from aerolith.operators import outliers as Out
from aerolith.operators.encode import encode_by_target
from aerolith.operators.validate import column_presence
from aerolith.plans import models as M
from aerolith.plans import versions as V
from aerolith.plans.registry import ModelRegistry
from aerolith.plans.scoring import linear_prediction
from aerolith.schema import MEASURES
from aerolith.session import stage

SINCE = "2024-01-20"
BINS = 10

_LONG = "long AS (" + " UNION ALL ".join(f"SELECT city, datetime >= TIMESTAMP '{SINCE}' AS cur, '{c}' AS feature, {c} AS x FROM clean WHERE {c} IS NOT NULL" for c in MEASURES) + ")"
_DRIFT = f"""edges AS (SELECT DISTINCT feature, unnest(q) AS edge FROM (SELECT feature, quantile_cont(x, [{", ".join(str(i / BINS) for i in range(1, BINS))}]) AS q FROM long WHERE NOT cur GROUP BY feature)),
  binned AS (SELECT l.*, (SELECT count(*) FROM edges e WHERE e.feature = l.feature AND l.x > e.edge) AS b FROM long l),
  sizes AS (SELECT city, feature, count(*) FILTER (NOT cur) AS n_ref, count(*) FILTER (cur) AS n_cur FROM long GROUP BY ALL),
  steps AS (SELECT city, feature, n_ref, n_cur,
      abs(count(*) FILTER (NOT cur) OVER (PARTITION BY city, feature ORDER BY x) / n_ref::DOUBLE - count(*) FILTER (cur) OVER (PARTITION BY city, feature ORDER BY x) / n_cur::DOUBLE) AS gap
    FROM long JOIN sizes USING (city, feature)),
  ks AS (SELECT city, feature, n_ref, n_cur, max(CASE WHEN n_ref > 0 AND n_cur > 0 THEN gap END) AS ks_distance FROM steps GROUP BY ALL),
  shares AS (SELECT city, feature, b, greatest(count(*) FILTER (cur) / nullif(n_cur, 0)::DOUBLE, {D.LEAST_SHARE}) AS p, greatest(count(*) FILTER (NOT cur) / nullif(n_ref, 0)::DOUBLE, {D.LEAST_SHARE}) AS q, n_ref, n_cur
    FROM binned JOIN sizes USING (city, feature) GROUP BY city, feature, b, n_ref, n_cur),
  psi AS (SELECT city, feature, sum(CASE WHEN n_ref > 0 AND n_cur > 0 THEN (p - q) * ln(p / q) END) AS stability_index FROM shares GROUP BY ALL)"""


@query(with_(OBS, CLEAN, _LONG, _DRIFT) + f"SELECT city, feature, n_ref, n_cur, {r6('ks_distance', 'ks_distance')}, {r6('stability_index', 'stability_index')} FROM ks LEFT JOIN psi USING (city, feature)")
def column_drift(spark, sf_dir):
    """All measures of all cities from the 20th on against the days before, whose bin edges are stored with a model version."""
    rows = clean(spark, sf_dir)
    registry = ModelRegistry(spark, scratch(spark, "models"))
    registry.save_edges("1", D.reference_edges(rows.filter(F.col("datetime") < SINCE), MEASURES, BINS))
    return D.drift_report(rows, SPEC, SINCE, registry.edges("1"))


HALF, TIMES, KNOWN = 12, 3.0, 5
OUTLYING = ("pm2_5", "pm10", "co")


def _hampel(columns, source: str, key: str) -> str:
    w = f"PARTITION BY {key} ORDER BY datetime ROWS BETWEEN {HALF} PRECEDING AND {HALF} FOLLOWING"
    lists = ", ".join(f"list({c}) FILTER (WHERE {c} IS NOT NULL) OVER ({w}) AS l_{c}" for c in columns)
    middle = ", ".join(f"list_aggregate(l_{c}, 'median') AS {c}_median, coalesce(len(l_{c}), 0) AS k_{c}" for c in columns)
    spread = ", ".join(f"{Out.NORMAL} * list_aggregate(list_transform(l_{c}, lambda x: abs(x - {c}_median)), 'median') AS {c}_deviation" for c in columns)
    flags = ", ".join(f"coalesce(abs({c} - {c}_median) > {TIMES} * {c}_deviation AND {c}_deviation > 0 AND k_{c} >= {KNOWN}, FALSE) AS {c}_outlier" for c in columns)
    return f"""fl AS (SELECT *, {lists} FROM {source}), fm AS (SELECT *, {middle} FROM fl), fs AS (SELECT *, {spread} FROM fm), flagged AS (SELECT *, {flags} FROM fs)"""


@query(with_(OBS, _hampel(OUTLYING, "obs", "city")) + "SELECT city, datetime, " + ", ".join(f"{r6(c, c)}, {r6(f'{c}_median', f'{c}_median')}, {r6(f'{c}_deviation', f'{c}_deviation')}, {c}_outlier" for c in OUTLYING) + " FROM flagged")
def flagged_outliers(spark, sf_dir):
    rows = obs(spark, sf_dir).select("city", "datetime", *OUTLYING)
    return Out.flag_outliers(rows, SPEC, OUTLYING, half=HALF, times=TIMES, least_known=KNOWN)


@query(with_(H_TYPE, _hampel(("v",), "h_type", "event_type")) + f"SELECT event_type, datetime, {r6('CASE WHEN NOT v_outlier THEN v END', 'v')} FROM flagged")
def outliers_removed(spark, sf_dir):
    """Hourly means of each type with outlying ones set to null; chunks of two days."""
    return Out.remove_outliers(h_type(spark, sf_dir), type(TYPE_SPEC)(keys=TYPE_SPEC.keys, chunk_hours=48), ("v",), half=HALF, times=TIMES, least_known=KNOWN)


@query(
    with_(OBS, _hampel(OUTLYING, "obs", "city"))
    + " UNION ALL ".join(f"SELECT city, '{c}' AS column_name, count({c}) AS known_count, count(*) FILTER ({c}_outlier) AS outlier_count FROM flagged GROUP BY city" for c in OUTLYING)
)
def outlier_counts(spark, sf_dir):
    return Out.outlier_counts(obs(spark, sf_dir), SPEC, OUTLYING, half=HALF, times=TIMES, least_known=KNOWN)


LEVEL, THRESHOLD = 55.4, 60.0

_SCORES = f"""o AS (SELECT city, datetime, pm2_5, row_number() OVER (PARTITION BY city ORDER BY datetime) AS rn, coalesce(CAST(round((pm2_5 - {LEVEL}::DOUBLE) * 1000000) AS BIGINT), 0) AS step FROM obs),
  s AS (SELECT city, rn, greatest(0, step) AS score FROM o WHERE rn = 1
    UNION ALL SELECT o.city, o.rn, greatest(0, s.score + o.step) FROM s JOIN o ON o.city = s.city AND o.rn = s.rn + 1),
  marked AS (SELECT o.*, s.score, s.score > 0 AND coalesce(lag(s.score) OVER (PARTITION BY city ORDER BY rn), 0) = 0 AS begins FROM o JOIN s USING (city, rn)),
  numbered AS (SELECT *, count(*) FILTER (begins) OVER (PARTITION BY city ORDER BY rn) AS episode FROM marked)"""


@query(
    "WITH RECURSIVE " + OBS + ", " + _SCORES
    + f""" SELECT city, min(datetime) AS started, max(datetime) AS ended, count(*) AS rows, {r6('max(score) / 1000000.0::DOUBLE', 'peak_score')}, {r6('max(pm2_5)', 'peak_value')}, arg_max(datetime, (pm2_5, -epoch_us(datetime))) FILTER (pm2_5 IS NOT NULL) AS peak_time
  FROM numbered WHERE score > 0 GROUP BY city, episode HAVING max(score) > {THRESHOLD} * 1000000"""
)
def spike_episodes(spark, sf_dir):
    return Ep.episodes(obs(spark, sf_dir), type(SPEC)(chunk_hours=48), "pm2_5", level=LEVEL, threshold=THRESHOLD)


@query("WITH RECURSIVE " + OBS + ", " + _SCORES + f" SELECT city, datetime, {r6('pm2_5', 'pm2_5')}, {r6('score / 1000000.0::DOUBLE', 'score')}, score > {THRESHOLD} * 1000000 AS is_spike FROM numbered")
def highlighted_spikes(spark, sf_dir):
    return Ep.highlighted(obs(spark, sf_dir).select("city", "datetime", "pm2_5"), SPEC, "pm2_5", level=LEVEL, threshold=THRESHOLD)


def _points() -> str:
    rows = []
    for p in I.CLASSES:
        _, step, intervals = I.break_points(p)
        rows += [f"('{p}', {round(i.low / step)}, {round(i.high / step)}, {i.index_low}, {i.index_high})" for i in intervals]
    return "points(p, low, high, index_low, index_high) AS (VALUES " + ", ".join(rows) + ")"


def _index_sql() -> str:
    w = "PARTITION BY city ORDER BY datetime"
    hours = ", ".join(f"[{', '.join(f'lag({c}, {k}) OVER ({w})' for k in range(I.MEAN_HOURS))}] AS h_{c}" for c in ("pm2_5", "pm10"))
    weights = ", ".join(f"greatest(CASE WHEN list_max(h_{c}) > 0 THEN list_min(h_{c}) / list_max(h_{c}) ELSE 1 END, {I.LEAST_WEIGHT}) AS w_{c}" for c in ("pm2_5", "pm10"))

    def mean(c: str) -> str:
        top = " + ".join(f"coalesce(h_{c}[{k + 1}] * pow(w_{c}, {k}), 0)" for k in range(I.MEAN_HOURS))
        low = " + ".join(f"CASE WHEN h_{c}[{k + 1}] IS NOT NULL THEN pow(w_{c}, {k}) ELSE 0 END" for k in range(I.MEAN_HOURS))
        return f"CASE WHEN len(list_filter(h_{c}[1:{I.NEWEST}], lambda x: x IS NOT NULL)) >= {I.NEEDED} THEN ({top}) / ({low}) END AS {c}"

    parts = []
    for k, p in enumerate(I.CLASSES):
        unit, step, _ = I.break_points(p)
        factor = 1.0 if unit == "ug" else I.MOLE_LITRES / I.MOLE_GRAMS[p] / (1000.0 if unit == "ppm" else 1.0)
        parts.append(f"SELECT city, datetime, '{p}' AS p, {k} AS k, {p} AS c, CAST(floor({p} * {factor!r}::DOUBLE / {step}::DOUBLE + 0.000001::DOUBLE) AS BIGINT) AS cut FROM means")
    return f"""hours AS (SELECT city, datetime, o3, co, so2, no2, {hours} FROM obs), weighted AS (SELECT *, {weights} FROM hours),
  means AS (SELECT city, datetime, o3, co, so2, no2, {mean('pm2_5')}, {mean('pm10')} FROM weighted),
  {_points()}, tops AS (SELECT p, max(index_high) AS top FROM points GROUP BY p),
  cuts AS ({" UNION ALL ".join(parts)}),
  found AS (SELECT city, datetime, p, k, CASE WHEN c >= 0 THEN CAST(floor(coalesce(index_low::DOUBLE + (index_high - index_low)::DOUBLE / (high - low)::DOUBLE * (cut - low), top) + 0.5::DOUBLE) AS INTEGER) END AS i
    FROM cuts JOIN tops USING (p) LEFT JOIN points USING (p) WHERE cut BETWEEN low AND high OR low IS NULL),
  beyond AS (SELECT c.city, c.datetime, c.p, c.k, CASE WHEN c.c >= 0 THEN CAST(top AS INTEGER) END AS i FROM cuts c JOIN tops USING (p) LEFT JOIN found f USING (city, datetime, p) WHERE f.p IS NULL),
  every AS (SELECT * FROM found UNION ALL SELECT * FROM beyond)"""


@query(
    with_(OBS, _index_sql())
    + "SELECT city, datetime, " + ", ".join(f"max(i) FILTER (p = '{p}') AS {p}_index" for p in I.CLASSES) + ", max(i) AS aqi, arg_max(p, (i, -k)) FILTER (i IS NOT NULL) AS dominant_pollutant FROM every GROUP BY city, datetime"
)
def air_quality_index(spark, sf_dir):
    rows = I.with_index(obs(spark, sf_dir), SPEC)
    return rows.select("city", "datetime", *[f"{p}_index" for p in I.CLASSES], "aqi", "dominant_pollutant")


TOLERANCE = 3
_MATCHED = f"""p AS (SELECT city, datetime, datetime + INTERVAL 90 MINUTE AS predicted_for, {SCORE} AS predicted FROM feat),
  seen AS (SELECT city, datetime, pm2_5 FROM obs WHERE pm2_5 IS NOT NULL),
  matched AS (SELECT p.*, CASE WHEN o.datetime - p.predicted_for <= INTERVAL {TOLERANCE} HOUR THEN o.datetime END AS observed_at, CASE WHEN o.datetime - p.predicted_for <= INTERVAL {TOLERANCE} HOUR THEN o.pm2_5 END AS observed
    FROM p ASOF LEFT JOIN seen o ON p.city = o.city AND p.predicted_for <= o.datetime)"""


def matched(spark, sf_dir):
    at = (F.col("datetime") + F.expr("INTERVAL 90 MINUTES")).alias("predicted_for")
    made = feat(spark, sf_dir).select("city", "datetime", at, linear_prediction(MODEL, INTERCEPT).alias("predicted"))
    return Ma.match_later(made, obs(spark, sf_dir), type(SPEC)(chunk_hours=48), at="predicted_for", value="pm2_5", tolerance_hours=TOLERANCE)


@query(with_(OBS, CLEAN, FEAT, _MATCHED) + f"SELECT city, datetime, predicted_for, {r6('predicted', 'predicted')}, observed_at, {r6('observed', 'observed')} FROM matched")
def matched_predictions(spark, sf_dir):
    return matched(spark, sf_dir)


@query(
    with_(OBS, CLEAN, FEAT, _MATCHED)
    + f"""SELECT city, CAST(predicted_for AS DATE) AS day, count(*) AS predictions, count(observed) AS matched, {r6('avg(abs(predicted - observed))', 'mae')},
    {r6('sqrt(avg(pow(predicted - observed, 2)))', 'rmse')}, {r6('avg(predicted - observed)', 'bias')}, {r6('avg((epoch_us(observed_at) - epoch_us(predicted_for)) / 3600000000.0::DOUBLE)', 'mean_age_hours')} FROM matched GROUP BY 1, 2"""
)
def prediction_errors(spark, sf_dir):
    """Error and age of data of each city and day of the predicted hours."""
    return Ma.error_report(matched(spark, sf_dir), SPEC, at="predicted_for", predicted="predicted")


_AS_OF = "2024-02-01 00:00:00"


@query(
    with_(OBS)
    + f"""SELECT city, max(datetime) AS newest, {r6(f"(epoch_us(TIMESTAMP '{_AS_OF}') - epoch_us(max(datetime))) / 3600000000.0::DOUBLE", 'age_hours')}, max(datetime) FILTER (no2 IS NOT NULL) AS newest_value_at,
    {r6(f"(epoch_us(TIMESTAMP '{_AS_OF}') - epoch_us(max(datetime) FILTER (no2 IS NOT NULL))) / 3600000000.0::DOUBLE", 'value_age_hours')} FROM obs GROUP BY city"""
)
def series_freshness(spark, sf_dir):
    return Ma.freshness(obs(spark, sf_dir), SPEC, "no2", _AS_OF)


WEIGHT = 20.0
_EARLIER = "RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"


def _encoded(column: str) -> str:
    n, s = (f"coalesce({f} OVER (PARTITION BY {column} ORDER BY ts {_EARLIER}), 0)" for f in ("count(value)", "sum(value)"))
    m = f"sum(value) OVER (ORDER BY ts {_EARLIER}) / nullif(count(value) OVER (ORDER BY ts {_EARLIER}), 0)"
    return r6(f"({s} + {WEIGHT} * ({m})) / ({n} + {WEIGHT})", f"{column}_encoded")


@query(f"SELECT event_id, event_type, user_id, {_encoded('event_type')}, {_encoded('user_id')} FROM events")
def encoded_categories(spark, sf_dir):
    """Every event with the mean value of its type and of its user before it; times of 12 hours make a chunk."""
    rows = events(spark, sf_dir).select("event_id", "event_type", "user_id", "ts", "value")
    made = encode_by_target(rows, ["event_type", "user_id"], "value", ts="ts", weight=WEIGHT, chunk_hours=12)
    return made.select("event_id", "event_type", "user_id", "event_type_encoded", "user_id_encoded")


_TRAIN = """s AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY datetime) <= floor(count(*) OVER (PARTITION BY city) * CAST(0.8 AS DOUBLE)) AS is_train FROM feat),
  w AS (SELECT regr_slope(target_pm25, pm2_5) AS slope, avg(target_pm25) AS my, avg(pm2_5) AS mx, count(*) AS n FROM s WHERE is_train)"""
_SHRINK = 5000.0
REPLICATES = 40
_PAIRED = f"""t AS (SELECT city || '/' || CAST(epoch(datetime) AS BIGINT) AS key, my + slope * (pm2_5 - mx) - target_pm25 AS e1, my + slope * (pm2_5 - mx) * n / (n + {_SHRINK}) - target_pm25 AS e0 FROM s, w WHERE NOT is_train),
  r AS (SELECT i AS replicate, e0, e1, ('0x' || substr(md5('1/' || (i // 4) || '/' || key), CAST(i % 4 * 8 + 1 AS BIGINT), 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM t, range({REPLICATES}) x(i)),
  d AS (SELECT *, {" + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in V.poisson_cuts())} AS wt FROM r),
  e AS (SELECT replicate, sqrt(sum(wt * e1 * e1) / sum(wt)) - sqrt(sum(wt * e0 * e0) / sum(wt)) AS rmse, sum(wt * abs(e1)) / sum(wt) - sum(wt * abs(e0)) / sum(wt) AS mae FROM d GROUP BY replicate)"""


def two_versions(spark, sf_dir):
    """A shrunk and a plain one-column model, stored as versions 1 and 2; the plain one is champion."""
    data = M.TrainingData.of(feat(spark, sf_dir), SPEC, ["pm2_5"])
    registry = ModelRegistry(spark, scratch(spark, "models"))
    _, models, _ = M.compare(data, {M.RIDGE: {"alpha": _SHRINK}, M.LINEAR: {}})
    for version, name in (("1", M.RIDGE), ("2", M.LINEAR)):
        registry.save(models[name], name, M.evaluate(models[name], data.test), ["pm2_5"], version=version, is_champion=name == M.LINEAR)
    return registry, data


@query(
    with_(OBS, CLEAN, FEAT, _TRAIN, _PAIRED)
    + f"""SELECT 'Ridge Regression' AS old_model, 'Linear Regression' AS new_model, {r6('sqrt(avg(e1 * e1)) - sqrt(avg(e0 * e0))', 'rmse_change')}, {r6('any_value(a)', 'rmse_change_low')}, {r6('any_value(b)', 'rmse_change_high')},
    {r6('any_value(c)', 'mae_change_low')}, {r6('any_value(g)', 'mae_change_high')}, {r6('any_value(h)', 'share_better')}, any_value(k) AS replicates
  FROM t, (SELECT quantile_cont(rmse, 0.05) AS a, quantile_cont(rmse, 0.95) AS b, quantile_cont(mae, 0.05) AS c, quantile_cont(mae, 0.95) AS g, avg((rmse < 0)::INT) AS h, count(*) AS k FROM e)"""
)
def version_interval(spark, sf_dir):
    """Is stored version 2 better than 1 on the test rows? Paired resamples."""
    registry, data = two_versions(spark, sf_dir)
    key = F.concat_ws("/", "city", F.unix_seconds("datetime").cast("string"))
    return V.compare_versions(registry, data.test, key, data.target, "1", "2", replicates=REPLICATES)


def _version_metrics(version: str, name: str, error: str) -> str:
    return f"""SELECT '{name}' AS model, '{version}' AS version, round(sqrt(avg(pow({error}, 2))) + 3.3e-8, 4) AS rmse, round(avg(abs({error})) + 3.3e-8, 4) AS mae,
    round(1 - sum(pow({error}, 2)) / (var_pop(y) * count(*)) + 3.3e-8, 4) AS r2, {'TRUE' if version == '2' else 'FALSE'} AS is_champion FROM q"""


@query(
    with_(OBS, CLEAN, FEAT, _TRAIN, f"q AS (SELECT target_pm25 AS y, my + slope * (pm2_5 - mx) - target_pm25 AS e1, my + slope * (pm2_5 - mx) * n / (n + {_SHRINK}) - target_pm25 AS e0 FROM s, w WHERE NOT is_train)")
    + f"SELECT CAST(row_number() OVER (ORDER BY rmse, model, version) AS INTEGER) AS rank, * FROM ({_version_metrics('1', 'Ridge Regression', 'e0')} UNION ALL {_version_metrics('2', 'Linear Regression', 'e1')})"
)
def stored_versions(spark, sf_dir):
    """Leaderboard over the versions in the registry."""
    return stage(V.stored_leaderboard(two_versions(spark, sf_dir)[0]))


_REQUIRED = ["datetime", *MEASURES, "visibility", "uv_index"]


@query(with_(OBS) + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {'TRUE' if c in ('datetime', *MEASURES) else 'FALSE'} AS present, {f'count({c})' if c in ('datetime', *MEASURES) else 'NULL::BIGINT'} AS known_count FROM obs" + ("" if c in ("datetime", *MEASURES) else " LIMIT 1") for c in _REQUIRED).replace(" FROM obs LIMIT 1", ""))
def required_columns(spark, sf_dir):
    """Two columns that the observations do not have are asked for as well."""
    return column_presence(obs(spark, sf_dir), _REQUIRED)
