"""Cleaning rules, reports, feeds, store and streams on small frames."""

import json

import pytest
from pyspark.sql import functions as F

from aerolith import SeriesSpec
from aerolith.operators import clean as C
from aerolith.operators import features as X
from aerolith.operators import validate as V
from aerolith.operators.chunks import with_chunk
from aerolith.plans import jobs
from aerolith.schema import CURRENT_DEFAULTS, FALLBACK_WEATHER, MEASURES, observation_schema, sanitize_columns, storage_name
from aerolith.sources import feeds, store, tables
from aerolith.streaming import live
from tests.frames import hours, series_frame

SPEC = SeriesSpec()


def observations(spark, cities, n, start=0, pm=lambda c, h: float(h % 29 + c)):
    rows = [
        (*hours(start + h), *[float((h + i) % 7 + 1) for i in range(10)], pm(c, start + h), *[float(h % 5 + i) for i in range(5)], f"city_{c}")
        for c in range(cities)
        for h in range(n)
    ]
    return spark.createDataFrame(rows, observation_schema())


def test_storage_names(spark):
    assert [storage_name(c) for c in ("PM2.5", "CO", " Wind speed (km/h) ", "a__b")] == ["pm2_5", "co", "wind_speed_km_h", "a_b"]
    with pytest.raises(ValueError, match="collide"):
        sanitize_columns(spark.createDataFrame([(1, 2)], "`a b` int, `a_b` int"))


def test_coerce_clip_and_reports(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("-4",), ("2000",), ("NaN",), ("0",)], "pm2_5 string")
    typed = C.coerce_numeric(df, ["pm2_5"])
    assert [r[0] for r in typed.collect()] == [1.5, None, None, -4.0, 2000.0, None, 0.0]
    assert [r[0] for r in C.clip_ranges(typed).collect()] == [1.5, None, None, 0.0, 1500.0, None, 0.0]
    assert C.clip_report(typed).collect() == [("pm2_5", 1, 1)]
    assert V.null_report(typed, ["pm2_5"]).first().null_count == 3
    assert X.incomplete_report(typed).first() == (7, 3, 4)
    with pytest.raises(ValueError, match="missing"):
        C.coerce_numeric(df, ["pm10"])


def test_parse_times(spark):
    df = spark.createDataFrame([("2024-01-01 05:00:00+02:00",), ("2024-01-01T03:00",), ("later",), (None,)], "datetime string")
    assert [r[0] for r in C.parse_times(df).select(F.unix_seconds("datetime")).collect()] == [1704078000, 1704078000]
    assert C.count_unparseable(df).first() == (4, 2)


def test_duplicates_keep_first_by_tie_break(spark):
    df = spark.createDataFrame([("a", *hours(0), float(v), b) for v, b in [(3, 2), (9, 1), (4, 3)]] * 500, "city string, datetime timestamp, v double, batch int")
    assert C.drop_duplicate_times(df, SPEC, ["batch"]).select("v").collect() == [(9.0,)]
    assert C.drop_duplicate_times(df, SPEC, ["batch"], keep="last").select("v").collect() == [(4.0,)]
    assert C.duplicate_time_count(df, SPEC).first() == ("a", 1500, 1499)


def test_long_series_is_cut_into_chunks(spark):
    df = series_frame(spark, {"hot": [(h, 1.0) for h in range(30_000)], "b": [(0, 1.0)]})
    sizes = with_chunk(df, SPEC).groupBy("city", "_chunk").count()
    assert sizes.agg(F.max("count")).first()[0] <= SPEC.chunk_hours
    out = X.series_features(df.withColumnRenamed("v", "pm2_5"), SPEC)
    assert out.filter("city = 'hot' AND pm25_lag_168 IS NULL").count() == 168
    assert out.filter("city = 'hot' AND target_pm25 IS NULL").count() == 1


def test_rows_without_key_are_left_out(spark):
    df = spark.createDataFrame([(None, *hours(0), 1.0), ("a", *hours(0), 2.0)], "city string, datetime timestamp, pm2_5 double")
    assert X.lag_features(df, SPEC).count() == 1


def test_feature_rules_are_enforced(spark):
    df = observations(spark, 1, 200)
    table = X.engineer_features(df, SPEC)
    assert table.count() == 200 - 168 - 1
    V.check_features(table, SPEC)
    with pytest.raises(ValueError, match="breaks"):
        V.check_features(table.unionByName(table), SPEC)


def test_current_feed_defaults(spark):
    body = {"current": {"temperature_2m": 3.5, "rain": None}}
    df = spark.createDataFrame([("a", json.dumps(body)), ("b", json.dumps({}))], "city string, payload string")
    rows = {r.city: r for r in feeds.parse_current_weather(df).collect()}
    assert rows["a"].temperature_2m == 3.5 and rows["a"].rain == 0.0 and rows["a"].cloud_cover == CURRENT_DEFAULTS["cloud_cover"]
    assert rows["b"].temperature_2m == 25.0


def test_hourly_feed(spark):
    body = {"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "pm2_5": [1.0, None], "ozone": [3.0, 4.0]}}
    df = spark.createDataFrame([("a", json.dumps(body))], "city string, payload string")
    rows = feeds.parse_air_quality(df).orderBy("datetime").collect()
    assert [(r.pm2_5, r.o3, r.no2) for r in rows] == [(1.0, 3.0, None), (None, 4.0, None)]


def test_secondary_feed_and_fallback(spark):
    bodies = [{"list": [{"components": {"pm2_5": 9.0, "so2": 2.0}}]}, {"list": []}]
    df = spark.createDataFrame([(c, *hours(0), json.dumps(b)) for c, b in zip("ab", bodies, strict=True)], "city string, datetime timestamp, payload string")
    second = feeds.parse_secondary(df)
    rows = {r.city: r for r in second.collect()}
    assert (rows["a"].pm2_5, rows["a"].so2, rows["a"].co) == (9.0, 2.0, 0.0) and rows["b"].pm2_5 is None
    first = observations(spark, 1, 1).withColumn("city", F.lit("z"))
    both = {r.city: r for r in feeds.with_fallback(first, second, SPEC).collect()}
    assert both["z"].source == "primary" and both["a"].source == "secondary"
    assert both["a"].wind_speed_10m == FALLBACK_WEATHER["wind_speed_10m"] and both["a"].pm2_5 == 9.0


def test_path_fallback_and_csv(spark, tmp_path):
    df = observations(spark, 2, 5)
    tables.write_observations(df, str(tmp_path / "raw.csv"), fmt="csv")
    assert "PM2.5" in spark.read.option("header", True).csv(str(tmp_path / "raw.csv")).columns
    back = tables.read_observations(spark, str(tmp_path / "none"), str(tmp_path / "raw.csv"), fmt="csv")
    assert sorted(back.select("city", "pm2_5").collect()) == sorted(df.select("city", "pm2_5").collect())
    with pytest.raises(FileNotFoundError):
        tables.read_observations(spark, str(tmp_path / "none"))


def test_upsert_replaces_and_repeats_safely(spark, tmp_path):
    path = str(tmp_path / "t")
    old = series_frame(spark, {"a": [(h, 1.0) for h in range(60)], "b": [(0, 5.0)]})
    new = series_frame(spark, {"a": [(59, 2.0), (60, 2.0)], "c": [(30, 7.0)]})
    store.upsert(spark, path, old, ["city"])
    for _ in range(2):
        store.upsert(spark, path, new, ["city"])
        rows = spark.read.parquet(path)
        assert rows.count() == 63
        assert rows.filter("v = 2.0").count() == 2 and rows.filter("city = 'c'").first().v == 7.0


def test_feature_store(spark, tmp_path):
    features = store.FeatureStore(spark, str(tmp_path))
    rows = spark.createDataFrame([("2024-01-01 00:00:00", 1.0, 2.0), ("2024-01-01 01:00:00", 3.0, 4.0)], "datetime string, `PM2.5` double, target_pm25 double")
    features.insert(rows, "g", city="harbour")
    features.insert(rows.limit(1).withColumn("PM2.5", F.lit(9.0)), "g", city="harbour")
    assert features.read("g").count() == 2
    view = features.get_or_create_view("v", "g", ["pm2_5"])
    assert view.columns == ["datetime", "city", "pm2_5", "target_pm25"]
    assert sorted(r.pm2_5 for r in view.collect()) == [3.0, 9.0]
    again = features.get_or_create_view("v", "g", ["other"])
    assert again.columns == view.columns


def test_live_stream_matches_batch(spark, tmp_path):
    landing, raw = str(tmp_path / "landing"), str(tmp_path / "raw")
    df = observations(spark, 2, 240)
    fixed = observations(spark, 1, 1, start=239, pm=lambda c, h: 77.0)
    df.write.parquet(landing)
    stream = lambda: live.clean_stream(live.landed(spark, landing, df.schema))
    for _ in range(2):
        live.live_stream(stream(), SPEC, raw, str(tmp_path / "f"), str(tmp_path / "cp")).awaitTermination()
        fixed.write.mode("append").parquet(landing)
    table = spark.read.parquet(raw)
    assert table.count() == 480
    want = {r.city: r for r in X.live_features(table.drop(store.DATE), SPEC).collect()}
    got = spark.read.parquet(str(tmp_path / "f")).filter("batch_id = 1").collect()
    assert [r.city for r in got] == ["city_0"] and got[0].pm2_5 == 77.0
    assert got[0].pm25_roll_mean_24 == want["city_0"].pm25_roll_mean_24 and got[0].pm25_lag_168 == want["city_0"].pm25_lag_168


def test_first_arrivals(spark, tmp_path):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = series_frame(spark, {"a": [(0, 1.0), (1, 2.0)]})
    for part in (df, df.withColumn("v", F.lit(9.0))):
        part.coalesce(1).write.mode("append").parquet(landing)
        rows = live.first_arrivals(live.landed(spark, landing, df.schema), SPEC)
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
        query.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.v for r in spark.read.parquet(out).collect()) == [1.0, 2.0]


def test_recent_history_reads_on_for_sparse_series(spark, tmp_path):
    path = str(tmp_path / "raw")
    data = {"dense": [(h, float(h)) for h in range(24 * 60)], "thin": [(h * 36, float(h)) for h in range(40)]}
    store.upsert(spark, path, series_frame(spark, data), ["city"])
    touched = series_frame(spark, {"dense": [(24 * 60 - 1, 0.0)], "thin": [(39 * 36, 0.0)]})
    rows = jobs.recent_history(spark.read.parquet(path), touched, SPEC, 30, days=3)
    got = {k: sorted(r.v for r in rows.filter(F.col("city") == k).collect()) for k in data}
    assert got == {k: [v for _, v in items[-30:]] for k, items in data.items()}


def test_unsorted_arrivals(spark):
    df = spark.createDataFrame([("a", i, *hours(h)) for i, h in enumerate([0, 2, 1, 3, 3, 2])], "city string, n long, datetime timestamp")
    assert V.unsorted_count(df, SPEC, "n").first().unsorted_count == 2


def test_backfill_and_training_table(spark, tmp_path):
    rows = observations(spark, 2, 200)
    weather = feeds.pack_hourly(rows, SPEC, {c: c for c in MEASURES[:10]})
    names = {own: feed for feed, own in feeds.POLLUTANT_FEED_NAMES.items()}
    report = jobs.backfill(weather, feeds.pack_hourly(rows, SPEC, names), SPEC, str(tmp_path / "raw"))
    assert report.first().row_count == 400 and report.agg(F.sum("null_count")).first()[0] == 0
    table = jobs.build_training_table(spark.read.parquet(str(tmp_path / "raw")), SPEC, str(tmp_path / "features"))
    assert table.count() == 2 * (200 - 169)


def test_store_keeps_columns_and_leaves_out_rows_without_time(spark, tmp_path):
    from aerolith.sources.store import read_table, upsert

    path = str(tmp_path / "t")

    def rows(data, schema):
        return spark.createDataFrame(data, schema).withColumn("datetime", F.to_timestamp("datetime"))

    base, wide = "city string, datetime string, v double", "city string, datetime string, v double, n long"
    assert upsert(spark, path, rows([("a", "2024-01-01 01:00:00", 1.0), ("a", None, 5.0)], base), ["city"]) == 1
    assert upsert(spark, path, rows([("b", "2024-01-01 02:00:00", 2.0, 7)], wide), ["city"]) == 0
    assert upsert(spark, path, rows([("c", "2024-01-01 03:00:00", 3.0), ("c", None, 6.0)], base), ["city"]) == 1
    assert upsert(spark, path, rows([("d", "2024-01-02 03:00:00", 4.0)], base), ["city"]) == 0
    got = {(r.city, r.v, r.n) for r in read_table(spark, path).collect()}
    assert got == {("a", 1.0, None), ("b", 2.0, 7), ("c", 3.0, None), ("d", 4.0, None)}
    upsert(spark, path, rows([("b", "2024-01-01 02:00:00", 2.5)], base), ["city"])
    assert {(r.city, r.v) for r in read_table(spark, path).collect()} == {("a", 1.0), ("b", 2.5), ("c", 3.0), ("d", 4.0)}


def _stages(spark):
    import os

    from aerolith.session import shared_dir

    return {f for f in os.listdir(shared_dir(spark)) if f.startswith("stage-")}


def test_jobs_delete_what_they_staged(spark, tmp_path):
    from aerolith.catalog import obs
    from aerolith.operators.chunks import SeriesSpec
    from aerolith.plans import jobs
    from aerolith.session import discard

    rows = obs(spark, "/root/testdata/sf0.001")
    before = _stages(spark)
    jobs.build_training_table(rows, SeriesSpec(), str(tmp_path / "training"))
    assert _stages(spark) == before
    latest = jobs.hourly_features(rows, SeriesSpec(), str(tmp_path / "raw"))
    assert len(_stages(spark) - before) == 1
    discard(latest)
    assert _stages(spark) == before


def test_live_reads_have_a_date_bound(spark, tmp_path):
    from aerolith.operators.chunks import SeriesSpec
    from aerolith.plans.jobs import recent_history
    from aerolith.sources.store import read_table, upsert

    path, spec = str(tmp_path / "raw"), SeriesSpec()
    hours = spark.sql("SELECT 'old' AS city, timestamp'2023-01-01 00:00:00' + make_interval(0, 0, 0, 0, 3 * id) AS datetime, cast(id as double) AS v FROM range(400)")
    upsert(spark, path, hours, ["city"])
    fresh = spark.sql("SELECT 'new' AS city, timestamp'2023-02-19 21:00:00' AS datetime, 0.5D AS v UNION ALL SELECT 'old', timestamp'2023-02-20 00:00:00', 1.5D")
    upsert(spark, path, fresh, ["city"])
    history = recent_history(read_table(spark, path), fresh, spec, 169, days=3)
    counts = {r["city"]: r["count"] for r in history.groupBy("city").count().collect()}
    assert counts == {"old": 169, "new": 1}


def test_series_too_short_to_split(spark):
    from aerolith.operators.chunks import SeriesSpec
    from aerolith.plans import models

    rows = spark.sql("SELECT 'a' AS city, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id) AS datetime, cast(id as double) AS x, cast(id as double) AS target_pm25 FROM range(1)")
    with pytest.raises(ValueError, match="too short"):
        models.compare(models.TrainingData.of(rows, SeriesSpec(), ["x"]), {models.LINEAR: {}})


def test_store_widens_types_and_never_narrows(spark, tmp_path):
    from datetime import datetime
    from decimal import Decimal

    path, when = str(tmp_path / "wide"), lambda h: datetime(2024, 1, 1 + h // 24, h % 24)

    def put(kind, *values):
        rows = [(f"c{h}", when(h), v) for h, v in values]
        store.upsert(spark, path, spark.createDataFrame(rows, f"city string, datetime timestamp, n {kind}"), ["city"])

    put("int", (0, 1), (30, 2))
    put("double", (1, 2.75))  # same date as the first row, another than the second
    put("int", (2, 7))  # narrower than the table by now
    put("bigint", (31, 2**40))
    put("void", (3, None))
    got = {r.city: r.n for r in store.read_table(spark, path).collect()}
    assert got == {"c0": 1.0, "c30": 2.0, "c1": 2.75, "c2": 7.0, "c31": float(2**40), "c3": None}
    assert dict(store.read_table(spark, path).dtypes)["n"] == "double"
    put("double", (0, None))  # a correction to null hides no older value
    assert {r.city: r.n for r in store.read_table(spark, path).collect()}["c0"] is None
    with pytest.raises(TypeError, match="no type"):
        put("string", (4, "x"))
    assert store.read_table(spark, path).count() == 6

    path = str(tmp_path / "long")
    put("int", (0, 1))
    put("bigint", (1, 2**40))
    put("decimal(6,2)", (2, Decimal("1.25")))
    got = store.read_table(spark, path)
    assert dict(got.dtypes)["n"] == "decimal(21,2)" and {r.n for r in got.collect()} == {Decimal(1), Decimal(2**40), Decimal("1.25")}


def test_jobs_side_by_side_keep_their_stages(spark):
    from threading import Event, Thread

    from aerolith.session import job, stage

    staged, ended, counts, gone = Event(), Event(), [], []

    def first():
        with job():
            mine = stage(spark.range(5))
            staged.set()
            ended.wait(60)
            counts.append(mine.count())
        gone.append(mine)

    def second():
        staged.wait(60)
        with job():
            stage(spark.range(3))
            with job():
                stage(spark.range(2))
        ended.set()

    threads = [Thread(target=first), Thread(target=second)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert counts == [5]
    with pytest.raises(Exception, match="PATH|FILE|exist"):
        gone[0].count()


def test_two_live_streams_in_one_session(spark, tmp_path):
    """Batches of both streams overlap; each gives what it gives alone, and nothing stays behind."""
    import os

    from aerolith.session import shared_dir

    rows = observations(spark, 2, 190)
    before = set(os.listdir(shared_dir(spark)))
    started = []
    for k in ("one", "two"):
        landing = str(tmp_path / k / "landing")
        for part in (rows.filter("city = 'city_0'"), rows.filter("city = 'city_1'")):
            part.coalesce(1).write.mode("append").parquet(landing)
        stream = live.landed(spark, landing, rows.schema, files_per_trigger=1)
        started.append(live.live_stream(stream, SPEC, str(tmp_path / k / "raw"), str(tmp_path / k / "features"), str(tmp_path / k / "cp")))
    for s in started:
        s.awaitTermination()
    found = [sorted((r.city, str(r.datetime), r.pm25_lag_24) for r in spark.read.parquet(str(tmp_path / k / "features")).collect()) for k in ("one", "two")]
    assert found[0] == found[1] and {c for c, _, _ in found[0]} == {"city_0", "city_1"}
    assert set(os.listdir(shared_dir(spark))) == before


def test_new_series_read_only_their_own_dates(spark, tmp_path):
    """Counts kept with the table bound the read: also of new, short, sparse and corrected series."""
    path = str(tmp_path / "raw")
    data = {"dense": [(h, float(h)) for h in range(24 * 60)], "thin": [(h * 36, float(h)) for h in range(40)]}
    store.upsert(spark, path, series_frame(spark, data), ["city"])
    fresh = series_frame(spark, {"new": [(24 * 59 + h, 1.0) for h in range(5)], "dense": [(24 * 59, -1.0)]})
    store.upsert(spark, path, fresh, ["city"])

    def read(city, rows):
        touched = spark.createDataFrame([(city,)], "city string")
        near = store.newest_rows(spark, path, touched, ["city"], rows)
        got = jobs.series_history(spark, path, touched, SPEC, rows)
        return near.select(store.DATE).distinct().count(), near.count(), sorted(r.v for r in got.collect())

    assert read("new", 169) == (1, 5, [1.0] * 5)
    dates, _, values = read("dense", 30)
    assert dates == 2 and values == sorted([-1.0, *[float(h) for h in range(24 * 60 - 30, 24 * 60) if h != 24 * 59]])
    assert read("thin", 10) == (10, 10, [float(h) for h in range(30, 40)])
    assert read("nobody", 5) == (0, 0, [])
    counts = {(r.city, str(r.event_date)): r.n for r in store.series_counts(spark, path, ["city"]).collect()}
    assert counts["dense", "2024-02-29"] == 24 and sum(n for (c, _), n in counts.items() if c == "thin") == 40
    plan = store.newest_rows(spark, path, spark.createDataFrame([("new",)], "city string"), ["city"], 169)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and plan.count("2024-") >= 1
