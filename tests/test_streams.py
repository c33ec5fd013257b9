"""Keyed state and live joins: order of arrival, corrections, timers, restarts."""


import pytest
from pyspark.sql import functions as F

from aerolith import SeriesSpec
from aerolith.catalog.streams import to_folders
from aerolith.operators.features import live_features
from aerolith.schema import FALLBACK_WEATHER, POLLUTANTS, WEATHER
from aerolith.streaming import fallback, live, state
from tests.test_tables import observations

SPEC = SeriesSpec()


def run(spark, tmp_path, batches, build, mode="append"):
    """One run of the stream after each landing, all from one checkpoint; rows by batch."""
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    for batch in batches:
        batch.write.mode("append").parquet(landing)

        def put(rows, batch_id):
            rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

        query = build(live.landed(spark, landing, batches[0].schema)).writeStream.outputMode(mode).foreachBatch(put)
        query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def newest(rows):
    last = {}
    for r in rows.orderBy("batch_id").collect():
        last[r.city] = r
    return last


def test_state_places_late_rows_and_corrections(spark, tmp_path):
    everything = observations(spark, 2, 240)
    numbered = everything.withColumn("n", F.pmod(F.xxhash64("city", "datetime"), F.lit(3)))
    parts = [numbered.filter(F.col("n") == k).drop("n") for k in range(3)]  # all hours in disorder
    fixed = observations(spark, 1, 60, start=150, pm=lambda c, h: float(h % 5))
    old = observations(spark, 1, 20, pm=lambda c, h: 900.0)  # behind all kept rows
    batches = [*parts, fixed.unionByName(fixed.withColumn("pm2_5", F.lit(-1.0))), old]
    got = newest(run(spark, tmp_path, batches, lambda rows: state.stateful_live_features(rows, SPEC, delay="30 days"), "update"))
    merged = everything.join(fixed.select("city", "datetime", F.col("pm2_5").alias("new")), ["city", "datetime"], "left")
    merged = merged.withColumn("pm2_5", F.coalesce("new", "pm2_5")).drop("new")
    want = {r.city: r for r in live_features(merged, SPEC).collect()}
    assert set(got) == set(want) == {"city_0", "city_1"}
    for city, row in want.items():
        for c, v in row.asDict().items():
            assert got[city][c] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v), c


def test_state_keeps_few_rows_and_drops_dead_series(spark, tmp_path):
    first = observations(spark, 2, 30)
    later = observations(spark, 1, 3, start=24 * 90)  # city_0 only, far ahead: city_1 is forgotten
    again = observations(spark, 2, 1, start=24 * 90 + 4).filter("city = 'city_1'")
    build = lambda rows: state.with_trail(rows, SPEC, size=5, delay="1 day", drop_after="10 days")
    rows = run(spark, tmp_path, [first, later, again], build, "update")
    got = [(r.city, len(r._trail)) for r in rows.orderBy("batch_id", "city").collect()]
    assert got == [("city_0", 5), ("city_1", 5), ("city_0", 5), ("city_1", 1)]  # what was kept of city_1 is gone


def test_trail_of_one_null_value(spark):
    df = spark.createDataFrame([([None],), ([1.0],), ([],), ([None, 2.0] * 6,)], f"{state.TRAIL} array<double>")
    got = [(r.v_lag_1, r.v_roll_mean_2, r.v_roll_std_2) for r in state.trail_features(df, lags=(1,), windows=(2,), prefix="v").collect()]
    assert got == [(None, None, 0.0), (None, 1.0, 0.0), (None, None, 0.0), (None, 2.0, 0.0)]


def test_feeds_late_missing_and_repeated(spark, tmp_path):
    """Weather and air in one landing file by kind; hour 2 lacks air, hour 3 both, 4 the second source; hour 1's air comes late."""

    def rows(*items):
        columns = ", ".join(f"{c} double" for c in (*WEATHER, *POLLUTANTS))
        values = [(kind, "a", f"2024-01-01 {h:02d}:{m:02d}:00" if h < 24 else "2024-02-01 00:00:00", *[float(v)] * (len(WEATHER) + len(POLLUTANTS))) for kind, h, m, v in items]
        df = spark.createDataFrame(values, f"kind string, city string, fetched_at string, {columns}")
        return df.withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))

    batches = [
        rows(("w", 1, 5, 1), ("w", 2, 5, 2), ("s", 1, 9, 10), ("s", 2, 9, 20), ("w", 4, 0, 4), ("a", 4, 0, 4)),
        rows(("a", 1, 7, 1), ("w", 1, 50, 99), ("s", 3, 0, 30)),
        rows(("s", 3, 59, 31)),
        rows(("w", 30, 0, 0), ("a", 30, 0, 0), ("s", 30, 0, 0)),
        rows(("a", 2, 0, 2)),  # its hour is settled
    ]

    def build(stream):
        parts = {k: stream.filter(F.col("kind") == k).drop("kind") for k in "was"}
        primary = fallback.live_combined(parts["w"].drop(*POLLUTANTS), parts["a"].drop(*WEATHER), SPEC, delay="6 hours")
        return fallback.live_fallback(primary, parts["s"].drop(*WEATHER), SPEC, delay="6 hours")

    got = {r.datetime.hour: (r.source, r.pm2_5, r.temperature_2m) for r in run(spark, tmp_path, batches, build).filter("datetime < '2024-01-15'").collect()}
    fixed = FALLBACK_WEATHER["temperature_2m"]
    assert got == {1: ("primary", 1.0, 1.0), 2: ("secondary", 20.0, fixed), 3: ("secondary", 30.0, fixed), 4: ("primary", 4.0, 4.0)}


def test_stores_follow_cores_and_feeds_are_shuffled_once(spark, tmp_path):
    """A session set for large shuffles does not multiply the stores that each micro-batch commits."""
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    rows = observations(spark, 2, 5).withColumn("fetched_at", F.col("datetime") + F.expr("INTERVAL 5 MINUTES")).drop("datetime")
    rows.write.parquet(landing)
    cores, provider = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(3 * cores))
    try:
        weather, air, second = (live.landed(spark, landing, rows.schema) for _ in range(3))
        primary = fallback.live_combined(weather.drop(*POLLUTANTS), air.drop(*WEATHER), SPEC)
        query = to_folders(out, str(tmp_path / "cp"))(fallback.live_fallback(primary, second.drop(*WEATHER), SPEC))
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(3 * cores)
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    operators = query.lastProgress.stateOperators
    assert len(operators) == 5 and all(s.numStateStoreInstances == cores for s in operators)
    assert query._jsq.explainInternal(False).count("Exchange hashpartitioning") == 3
    assert spark.read.parquet(out).filter("source = 'primary'").count() == 10
