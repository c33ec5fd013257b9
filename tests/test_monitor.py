"""Monitoring operators on small and skewed frames, against plain loops; plans."""

import math
import statistics
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from aerolith import SeriesSpec
from aerolith.functions import index as I
from aerolith.operators import drift as D
from aerolith.operators import episodes as Ep
from aerolith.operators import match as Ma
from aerolith.operators import outliers as Out
from aerolith.operators.encode import encode_by_target
from aerolith.plans import versions as V
from aerolith.plans.registry import ModelRegistry
from tests.frames import T0, hour_of, hours, random_series, series_frame

SPEC = SeriesSpec()


def skewed(seed=3, long=600):
    """One series with a third of all rows and gaps, many short ones, one without values."""
    data = {"long": random_series(seed, long)} | {f"s{i}": random_series(seed + i, long * 2 // 40) for i in range(1, 41)}
    return data | {"void": [(h, None) for h in range(9)], "one": [(5, 1.0)]}


@pytest.fixture(scope="module")
def frame(spark):
    return series_frame(spark, skewed())


def rows_of(df, *columns):
    return sorted(((r.city, hour_of(r.datetime), *[r[c] for c in columns]) for r in df.collect()), key=str)


def near(a, b):
    return (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-9))


def test_outliers_of_a_long_series(frame):
    half, times, least = 4, 3.0, 4
    got = {(r.city, hour_of(r.datetime)): r for r in Out.flag_outliers(frame, replace(SPEC, chunk_hours=48), ["v"], half=half, times=times, least_known=least).collect()}
    assert len(got) == sum(map(len, skewed().values()))
    for city, series in skewed().items():
        for i, (h, v) in enumerate(series):
            known = [x for _, x in series[max(0, i - half) : i + half + 1] if x is not None]
            median = statistics.median(known) if known else None
            spread = Out.NORMAL * statistics.median(abs(x - median) for x in known) if known else None
            r = got[city, h]
            assert near(r.v_median, median) and near(r.v_deviation, spread)
            assert r.v_outlier == bool(v is not None and spread and len(known) >= least and abs(v - median) > times * spread)


def test_outliers_are_removed_not_rows(spark):
    df = series_frame(spark, {"a": [(h, 500.0 if h == 20 else float(h % 5)) for h in range(40)]}).withColumn("v_outlier_note", F.lit("kept"))
    out = Out.remove_outliers(df, SPEC, ["v"])
    assert out.columns == df.columns and out.count() == 40 and [hour_of(r.datetime) for r in out.filter("v IS NULL").collect()] == [20]
    assert Out.remove_outliers(df.limit(0), SPEC, ["v"]).count() == 0


def plain_scores(series, level):
    score, out = 0, []
    for h, v in series:
        score = max(0, score + (0 if v is None else round((v - level) * Ep.UNIT)))
        out.append((h, v, score))
    return out


@pytest.mark.parametrize("chunk", [1, 48, 8760])
def test_episodes_in_any_chunks(frame, chunk):
    level, threshold = 27.0, 20.0
    spec = replace(SPEC, chunk_hours=chunk)
    got = sorted((r.city, hour_of(r.started), hour_of(r.ended), r.rows, r.peak_score, r.peak_value, hour_of(r.peak_time)) for r in Ep.episodes(frame, spec, "v", level=level, threshold=threshold).collect())
    want = []
    for city, series in skewed().items():
        run = []
        for h, v, s in [*plain_scores(series, level), (None, None, 0)]:
            if s > 0:
                run.append((h, v, s))
                continue
            if run and max(x[2] for x in run) > threshold * Ep.UNIT:
                top = max(x[1] for x in run if x[1] is not None)
                want.append((city, run[0][0], run[-1][0], len(run), max(x[2] for x in run) / Ep.UNIT, top, next(h for h, v, _ in run if v == top)))
            run = []
    assert got == sorted(want) and len(got) > 20
    scores = {(r.city, hour_of(r.datetime)): r.score for r in Ep.highlighted(frame, spec, "v", level=level, threshold=threshold).collect()}
    assert scores == {(c, h): s / Ep.UNIT for c, x in skewed().items() for h, _, s in plain_scores(x, level)}


def test_index_at_the_edges_of_intervals(spark):
    cases = {"pm2_5": [(0.0, 0), (12.0, 50), (12.05, 50), (12.1, 51), (35.4, 100), (35.5, 101), (500.4, 500), (9999.0, 500), (-1.0, None), (None, None)], "pm10": [(54.0, 50), (54.9, 50), (55.0, 51), (604.0, 500)]}
    for pollutant, pairs in cases.items():
        df = spark.createDataFrame([(c,) for c, _ in pairs], "c double").withColumn("i", I.index_of(F.col("c"), pollutant))
        assert [r.i for r in df.collect()] == [i for _, i in pairs]
    for pollutant in I.CLASSES:  # intervals meet, in steps of the pollutant
        unit, step, points = I.break_points(pollutant)
        assert all(b.low == pytest.approx(a.high + step) and b.index_low == a.index_high + 1 for a, b in zip(points, points[1:], strict=False))
    gas = spark.createDataFrame([(100.0 * 46.0055 / 24.45,)], "c double").select(I.index_of(F.col("c"), "no2").alias("i")).first().i
    assert gas == 100


def test_weighted_mean_and_dominant_pollutant(spark):
    series = [(h, v, v and 2 * v) for h, v in random_series(5, 120)]
    rows = series_frame(spark, {"a": series}, ("pm2_5", "pm10"))
    got = {hour_of(r.datetime): r for r in I.with_index(I.weighted_means(rows, replace(SPEC, chunk_hours=24)), SPEC, {"pm2_5": "pm2_5_weighted", "pm10": "pm10_weighted"}).collect()}
    for i, (h, *_) in enumerate(series):
        frame = [series[k][1] if k >= 0 else None for k in range(i, i - 12, -1)]
        known = [(k, v) for k, v in enumerate(frame) if v is not None]
        want = None
        if sum(v is not None for v in frame[:3]) >= 2:
            w = max(min(v for _, v in known) / max(v for _, v in known), 0.5)
            want = sum(v * w**k for k, v in known) / sum(w**k for k, _ in known)
        r = got[h]
        assert near(r.pm2_5_weighted, want)
        both = {"pm2_5": r.pm2_5_index, "pm10": r.pm10_index}
        assert r.aqi == max((v for v in both.values() if v is not None), default=None)
        assert r.dominant_pollutant == next((p for p, v in both.items() if v is not None and v == r.aqi), None)


def test_drift_in_any_ranges(frame):
    since, cut = hours(200)[0], 200
    edges = D.reference_edges(frame.filter(F.col("datetime") < F.lit(since)), ["v"], 4)
    got = {r.city: r for r in D.drift_report(frame, SPEC, since, edges, bin_values=50).collect()}
    plain = {r.city: r for r in D.drift_report(frame, SPEC, since, edges).collect()}
    assert {k: tuple(v) for k, v in got.items()} == {k: pytest.approx(tuple(v)) if None not in tuple(v) else tuple(v) for k, v in plain.items()}
    for city, series in skewed().items():
        ref = [v for h, v in series if h < cut and v is not None]
        cur = [v for h, v in series if h >= cut and v is not None]
        if not ref and not cur:
            assert city not in got
            continue
        r = got[city]
        assert (r.n_ref, r.n_cur) == (len(ref), len(cur))
        if not ref or not cur:
            assert r.ks_distance is None and r.stability_index is None
            continue
        share = lambda xs, v: sum(x <= v for x in xs) / len(xs)
        assert r.ks_distance == pytest.approx(max(abs(share(ref, v) - share(cur, v)) for v in {*ref, *cur}))
        of = lambda v: sum(v > e for e in edges["v"])
        index = 0.0
        for b in range(len(edges["v"]) + 1):
            p, q = (max(sum(of(v) == b for v in xs) / len(xs), D.LEAST_SHARE) for xs in (cur, ref))
            index += (p - q) * math.log(p / q)
        assert r.stability_index == pytest.approx(index)


def test_edges_are_kept_with_the_version(spark, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path / "m"))
    assert registry.edges("1") == {}
    registry.save_edges("1", {"a": [1.0, 2.0], "b": []})
    registry.save_edges("2", {"a": [5.0]})
    registry.save_edges("1", {"a": [3.0]})
    assert registry.edges("1") == {"a": [3.0], "b": []} and registry.edges("2") == {"a": [5.0]}


def test_predictions_meet_the_first_later_observation(spark, frame):
    asked = [(c, T0.timestamp() + 3600 * h, i) for i, (c, h) in enumerate([(c, h + 0.5 * (h % 3)) for c, s in skewed().items() for h, _ in s[::2]] + [("long", 3.0), ("long", 3.0), ("nobody", 1.0), ("long", 10_000.0)])]
    asked += [(None, T0.timestamp(), -1), ("long", None, -2)]
    predictions = spark.createDataFrame(asked, "city string, second double, n long").select("city", F.timestamp_micros((F.col("second") * 1e6).cast("long")).alias("due"), "n")
    twice = frame.unionByName(frame.filter("city = 's1'").withColumn("v", F.col("v") - 1))
    for chunk in (3, 8760):
        got = {r.n: r for r in Ma.match_later(predictions, twice, replace(SPEC, chunk_hours=chunk), at="due", value="v", tolerance_hours=4).collect()}
        assert len(got) == len(asked)
        for city, second, n in asked:
            due = None if second is None else (second - T0.timestamp()) / 3600
            later = [(h, v) for h, v in skewed().get(city, []) if v is not None and due is not None and h >= due]
            want = later[0] if later and later[0][0] - due <= 4 else (None, None)
            r = got[n]
            assert (r.observed_at and hour_of(r.observed_at), r.observed) == want
    report = Ma.error_report(Ma.match_later(predictions.withColumn("p", F.lit(1.0)), frame, SPEC, at="due", value="v", tolerance_hours=4), SPEC, at="due", predicted="p")
    assert sum(r.predictions for r in report.collect()) == len(asked)


def test_match_joins_no_ranges(frame):
    p = frame.select("city", F.col("datetime").alias("due"))
    plan = Ma.match_later(p, frame, SPEC, at="due", value="v", tolerance_hours=4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_encoding_sees_only_earlier_rows(spark):
    import random

    rnd = random.Random(2)
    rows = [(i, rnd.choice(["hot"] * 4 + ["a", "b", None]), rnd.randrange(60), rnd.choice([None, float(rnd.randrange(9))])) for i in range(500)] + [(900, "hot", None, 5.0), (901, "new", 30, None)]
    df = spark.createDataFrame(rows, "id long, c string, h long, y double").withColumn("datetime", F.timestamp_seconds(F.col("h") * 3600 + int(T0.timestamp()))).withColumn("n", F.lit(0))
    for chunk in (1, 7, 720):
        got = {r.id: r.c_encoded for r in encode_by_target(df.repartition(5), ["c"], "y", weight=3.0, chunk_hours=chunk).collect()}
        assert len(got) == len(rows)
        for i, c, h, _ in rows:
            seen = [(k, y) for _, k, g, y in rows if h is not None and g is not None and g < h and y is not None]
            mine = [y for k, y in seen if k == c]
            want = (sum(mine) + 3.0 * sum(y for _, y in seen) / len(seen)) / (len(mine) + 3.0) if seen else None
            assert near(got[i], want)


def test_resamples_are_poisson_paired_and_repeatable(spark):
    df = spark.range(3000).select("id", (F.col("id") % 17).cast("double").alias("y"), (F.col("id") % 5).cast("double").alias("a"))
    df = df.withColumn("b", F.col("a")).withColumn("c", F.col("y") + 0.01)
    drawn = V.resampled_errors(df, F.col("id"), "y", ["a", "b"], 30).collect()
    assert len(drawn) == 30 and all(r.a_rmse == r.b_rmse and r.a_mae == r.b_mae for r in drawn)
    weights = [r.weight / 3000 for r in drawn]
    assert 0.99 < sum(weights) / 30 < 1.01 and 0.01 < statistics.pstdev(weights) < 0.03
    again = V.resampled_errors(df.repartition(7), F.col("id"), "y", ["a", "b"], 30).collect()
    assert {r.replicate: r.weight for r in drawn} == {r.replicate: r.weight for r in again}
    better = V.compared_predictions(df, F.col("id"), "y", "a", "c", replicates=30).first()
    assert better.share_better == 1.0 and better.rmse_change_high < 0 and better.replicates == 30
    assert V.compared_predictions(df.limit(0), F.col("id"), "y", "a", "c").first().rmse_change is None


@pytest.mark.parametrize("build", [lambda d, s: Out.flag_outliers(d, s, ["v"]), lambda d, s: Ep.episodes(d, s, "v", level=1, threshold=1), lambda d, s: I.weighted_means(d, s, ["v"]), lambda d, s: Ma.match_later(d.select("city", F.col("datetime").alias("due")), d, s, at="due", value="v", tolerance_hours=3)])
def test_no_window_over_a_whole_series_of_rows(frame, build):
    """Every window over rows is cut by the chunk; only chunk summaries are ordered by series."""
    plan = build(frame, SPEC)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line and "unix" not in line and "datetime" in line.split("], [")[-1]:
            assert "_chunk" in line
    assert "python" not in plan.lower()
