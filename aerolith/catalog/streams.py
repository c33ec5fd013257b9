"""Streaming queries: each runs over all landed rows and ends (available-now trigger)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.catalog import SPEC, clean, feat, h_type, obs, query
from aerolith.catalog.explore import r6
from aerolith.catalog.ingest import current_payload, scratch, secondary_payload
from aerolith.catalog.sql import (
    CALENDAR_NAMES,
    CLEAN,
    FEAT,
    H_TYPE,
    INTERCEPT,
    LIVE,
    MEASURES_SQL,
    MODEL,
    OBS,
    SCORE,
    clip,
    cols,
    risk_sql,
    with_,
)
from aerolith.catalog.windows import FEATURE_NAMES, FEATURE_ORDER
from aerolith.operators.chunks import SeriesSpec, latest_rows
from aerolith.operators.features import live_features
from aerolith.plans import models as M
from aerolith.plans.registry import ModelRegistry
from aerolith.plans.scoring import linear_model
from aerolith.schema import CURRENT_DEFAULTS, FALLBACK_WEATHER, LIVE_BOUNDS, MEASURES, POLLUTANT_FEED_NAMES, WEATHER
from aerolith.session import discard, stage
from aerolith.sources import feeds, store
from aerolith.streaming import fallback, live, state

LIVE_CLEAN = "clean AS (SELECT city, datetime, " + ", ".join(f"{clip(c, *LIVE_BOUNDS[c])} AS {c}" if c in LIVE_BOUNDS else c for c in MEASURES) + " FROM obs)"


def event_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def run_landings(spark, batches, start):
    """Land each batch as many files as it has partitions, then run the stream to its end, from its checkpoint."""
    path = scratch(spark, "landing")
    for batch in batches:
        batch.write.mode("append").parquet(path)
        start(live.landed(spark, path, batch.schema)).awaitTermination()


def to_folders(path, checkpoint, mode="append"):
    """A start function for streams whose batches go to a folder each, which a repeated batch replaces."""

    def start(rows):
        def put(batch, batch_id):
            batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

        with live.state_settings(rows.sparkSession):
            return rows.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    return start


def three_batches(spark, sf_dir):
    """Rows up to the 20th; then all from the 15th, corrected by one; then the first days again, late and unchanged."""
    rows = obs(spark, sf_dir)
    corrected = rows.filter(F.col("datetime") >= "2024-01-15").withColumn("pm2_5", F.col("pm2_5") + 1)
    return [rows.filter(F.col("datetime") < "2024-01-20"), corrected, rows.filter(F.col("datetime") < "2024-01-05")]


ARRIVED = OBS.replace("obs AS (", "all_obs AS (", 1) + """,
  obs AS (SELECT * REPLACE (pm2_5 + CASE WHEN datetime >= TIMESTAMP '2024-01-15' THEN 1 ELSE 0 END AS pm2_5) FROM all_obs)"""


@query(f"SELECT event_type, date_trunc('hour', ts) AS hour, {r6('avg(value)', 'mean_value')}, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_hourly_means(spark, sf_dir):
    path, means = scratch(spark, "means"), live.hourly_means(event_stream(spark, sf_dir), ["event_type"], "ts", "value")
    spec = SeriesSpec(keys=("event_type",), ts="hour")
    with live.state_settings(spark):
        stream = live.upsert_stream(means, spec, path, scratch(spark, "cp"), mode="update")
    stream.awaitTermination()
    return spark.read.parquet(path).drop(store.DATE)


@query(with_(H_TYPE) + f"SELECT event_type, datetime, {r6("v + CASE WHEN datetime >= TIMESTAMP '2024-01-20' THEN 1000 ELSE 0 END", 'v')} FROM h_type")
def streamed_first_arrivals(spark, sf_dir):
    """Of each (type, hour) the first batch wins; the second brings all hours again with other values."""
    spec = SeriesSpec(keys=("event_type",))
    hours = h_type(spark, sf_dir)
    path, cp = scratch(spark, "first"), scratch(spark, "cp")
    batches = [hours.filter(F.col("datetime") < "2024-01-20"), hours.withColumn("v", F.col("v") + 1000)]

    def start(rows):
        writer = live.first_arrivals(rows, spec, "60 days").writeStream.format("parquet").option("path", path)
        with live.state_settings(spark):
            return writer.option("checkpointLocation", cp).trigger(availableNow=True).start()

    run_landings(spark, batches, start)
    return spark.read.parquet(path)


def newest_of_batches(spark, path, ts):
    """The rows of the last batch that has a series."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("city").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(last, ["city", "batch_id"])


@query(with_(ARRIVED, LIVE_CLEAN) + f"SELECT {cols('city datetime', MEASURES_SQL)} FROM clean")
def streamed_upsert(spark, sf_dir):
    path = scratch(spark, "raw")
    cp = scratch(spark, "cp")
    run_landings(spark, three_batches(spark, sf_dir), lambda rows: live.upsert_stream(live.clean_stream(rows), SPEC, path, cp))
    return spark.read.parquet(path).drop(store.DATE)


@query(with_(ARRIVED, LIVE_CLEAN, LIVE) + f"SELECT {cols('city datetime ' + CALENDAR_NAMES, FEATURE_NAMES)} FROM live")
def streamed_live_features(spark, sf_dir):
    raw, features, cp = (scratch(spark, name) for name in ("raw", "features", "cp"))
    run_landings(spark, three_batches(spark, sf_dir), lambda rows: live.live_stream(live.clean_stream(rows), SPEC, raw, features, cp))
    return newest_of_batches(spark, features, "datetime").select(*FEATURE_ORDER[:-1])


@query(
    with_(ARRIVED, LIVE_CLEAN, LIVE, f"s AS (SELECT *, CASE WHEN {SCORE} < 0 THEN 0 ELSE {SCORE} END AS p FROM live)")
    + f"SELECT city, datetime AS input_timestamp, {r6('pm2_5', 'current_pm25')}, round(p, 2) AS predicted_next_hour_pm25, {risk_sql('p')}, 'Linear Regression' AS champion_model FROM s"
)
def streamed_predictions(spark, sf_dir):
    raw, features, log, cp = (scratch(spark, name) for name in ("raw", "features", "log", "cp"))

    def start(rows):
        model = linear_model(MODEL, INTERCEPT)
        return live.live_stream(live.clean_stream(rows), SPEC, raw, features, cp, predict=model, features=list(MODEL), model_name="Linear Regression", log_path=log)

    run_landings(spark, three_batches(spark, sf_dir), start)
    return newest_of_batches(spark, log, "input_timestamp").drop("batch_id", "prediction_time")


@query(with_(ARRIVED, LIVE_CLEAN, LIVE) + f"SELECT {cols('city datetime ' + CALENDAR_NAMES, FEATURE_NAMES)} FROM live")
def stateful_live_features(spark, sf_dir):
    """The same landings through keyed state: corrections, late rows, a start from the checkpoint after each landing."""
    path, cp = scratch(spark, "features"), scratch(spark, "cp")
    start = to_folders(path, cp, "update")
    run_landings(spark, three_batches(spark, sf_dir), lambda rows: start(state.stateful_live_features(live.clean_stream(rows), SPEC)))
    return newest_of_batches(spark, path, "datetime").select(*FEATURE_ORDER[:-1])


def _present(row: str) -> str:
    return f"{row}.temperature_2m IS NOT NULL AND {row}.o3 IS NOT NULL"


_LIVE_CHOSEN = ", ".join(
    f"round(CASE WHEN {_present('obs')} THEN coalesce({c}, {CURRENT_DEFAULTS[c]}) ELSE {FALLBACK_WEATHER[c] if c in WEATHER else f'coalesce({c}, 0.0)'} END + 3.3e-8, 6) AS {c}" for c in MEASURES
)


@query(with_(OBS) + f"SELECT city, datetime, {_LIVE_CHOSEN}, CASE WHEN {_present('obs')} THEN 'primary' ELSE 'secondary' END AS source FROM obs")
def live_source_fallback(spark, sf_dir):
    """Three feeds in three landings: weather and air quality each miss hours, and two days of air quality come a landing late."""
    rows = obs(spark, sf_dir).withColumn("fetched_at", F.col("datetime") + F.expr("INTERVAL 17 MINUTES"))
    clock = F.lit("2024-06-01 00:17:00").cast("timestamp")  # a reading of no city, far ahead, moves every watermark on
    end = rows.limit(1).select(*[F.lit("").alias(c) if c == "city" else clock.alias(c) if c in ("datetime", "fetched_at") else F.lit(1.0).alias(c) for c in rows.columns])
    rows = rows.unionByName(end)
    late = F.col("datetime").between("2024-01-08", "2024-01-09 23:00:00")
    landing = F.when(F.col("datetime") < "2024-01-10", 0).when(F.col("datetime") < "2024-01-20", 1).otherwise(2)
    feeds_ = {
        "weather": rows.filter("temperature_2m IS NOT NULL").select("city", "fetched_at", current_payload({c: c for c in WEATHER}).alias("payload"), landing.alias("n")),
        "air": rows.filter("o3 IS NOT NULL").select("city", "fetched_at", current_payload(POLLUTANT_FEED_NAMES).alias("payload"), F.when(late, 1).otherwise(landing).alias("n")),
        "second": rows.select("city", "fetched_at", secondary_payload().alias("payload"), landing.alias("n")),
    }
    landed = stage(reduce(DataFrame.unionByName, [df.withColumn("feed", F.lit(name)) for name, df in feeds_.items()]))
    folders = {name: scratch(spark, name) for name in feeds_}
    path = scratch(spark, "fallback")
    start = to_folders(path, scratch(spark, "cp"))
    for n in range(3):
        for name, folder in folders.items():
            landed.filter((F.col("n") == n) & (F.col("feed") == name)).select("city", "fetched_at", "payload").write.mode("append").parquet(folder)
        weather, air, second = (live.landed(spark, f, landed.select("city", "fetched_at", "payload").schema) for f in folders.values())
        primary = fallback.live_combined(feeds.parse_current_weather(weather), feeds.parse_current_air_quality(air), SPEC)
        start(fallback.live_fallback(primary, feeds.parse_secondary(second), SPEC)).awaitTermination()
    return spark.read.parquet(path).filter("city <> ''").drop("batch_id")


@query(
    with_(OBS, LIVE_CLEAN, LIVE) + f"SELECT {cols('city datetime ' + CALENDAR_NAMES, FEATURE_NAMES)} FROM live"
)
def hourly_features(spark, sf_dir):
    """The hourly job: two landings merged into the raw table, live features of all series, read back from the store."""
    from aerolith.plans import jobs

    rows = obs(spark, sf_dir)
    raw, features = scratch(spark, "raw"), store.FeatureStore(spark, scratch(spark, "features"))
    for batch in (rows.filter(F.col("datetime") < "2024-01-20"), rows.filter(F.col("datetime") >= "2024-01-19")):
        discard(jobs.hourly_features(batch, SPEC, raw, features))
    stored = features.read("live_features")
    return latest_rows(stored, SPEC).select(*FEATURE_ORDER[:-1])


_TRAIN = """s AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY datetime) <= floor(count(*) OVER (PARTITION BY city) * CAST(0.8 AS DOUBLE)) AS is_train FROM feat),
  w AS (SELECT regr_slope(target_pm25, pm2_5) AS slope, regr_intercept(target_pm25, pm2_5) AS icpt, avg(target_pm25) AS my, avg(pm2_5) AS mx, count(*) AS n FROM s WHERE is_train)"""


@query(
    with_(OBS, CLEAN, FEAT, _TRAIN, LIVE, "p AS (SELECT city, datetime, pm2_5, greatest(icpt + slope * pm2_5, 0) AS p FROM live, w)")
    + f"SELECT city, datetime AS input_timestamp, {r6('pm2_5', 'current_pm25')}, round(p, 2) AS predicted_next_hour_pm25, {risk_sql('p')}, 'Linear Regression' AS champion_model FROM p"
)
def hourly_predictions(spark, sf_dir):
    """The prediction job with a stored one-column champion, whose weights SQL has too; the log is read back."""
    from aerolith.plans import jobs

    registry = ModelRegistry(spark, scratch(spark, "models"))
    log = scratch(spark, "log")
    latest = live_features(clean(spark, sf_dir), SPEC)
    rows = feat(spark, sf_dir)
    jobs.hourly_predictions(latest, SPEC, registry, log, scratch(spark, "latest"), lambda: M.train(rows, SPEC, ["pm2_5"], registry, candidates={M.LINEAR: {}}))
    return spark.read.parquet(log).drop("prediction_time")


def _metric(predicted: str, where: str) -> str:
    return f"""SELECT round(sqrt(avg(pow(y - {predicted}, 2))) + 3.3e-8, 4) AS rmse, round(avg(abs(y - {predicted})) + 3.3e-8, 4) AS mae,
    round(1 - sum(pow(y - {predicted}, 2)) / (var_pop(y) * count(*)) + 3.3e-8, 4) AS r2 FROM q WHERE {where}"""


_BOARD = {"Linear Regression": "(my + slope * (x - mx))", "Ridge Regression": "(my + slope * (x - mx) * n / (n + 5000.0))"}


@query(
    with_(OBS, CLEAN, FEAT, _TRAIN, "q AS (SELECT s.is_train, s.target_pm25 AS y, s.pm2_5 AS x, w.* FROM s, w)")
    + "SELECT CAST(row_number() OVER (ORDER BY test_rmse, model) AS INTEGER) AS rank, * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{m}' AS model, a.rmse AS train_rmse, b.rmse AS test_rmse, a.mae AS train_mae, b.mae AS test_mae, a.r2 AS train_r2, b.r2 AS test_r2, TRUE AS needs_scaling"
        f" FROM ({_metric(p, 'is_train')}) a, ({_metric(p, 'NOT is_train')}) b"
        for m, p in _BOARD.items()
    )
    + ")"
)
def compared_linear_models(spark, sf_dir):
    """Split, fit, compare and rank: one-column models, whose weights have a closed form."""
    data = M.TrainingData.of(feat(spark, sf_dir), SPEC, ["pm2_5"])
    board, _, _ = M.compare(data, {M.LINEAR: {}, M.RIDGE: {"alpha": 5000.0}})
    return board.drop("train_time_sec", "overfit_gap_r2")


