"""Window operators against plain loops, with chunks far smaller than their reach."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from aerolith import SeriesSpec
from aerolith.operators import chunks, clean, features
from tests.frames import hour_of, random_series, series_frame

CHUNKS = [5, 30, 200, 100_000]


def collect(df, *cols):
    out = {}
    for r in df.select("city", F.unix_seconds("datetime").alias("s"), *cols).collect():
        out[(r.city, (r.s - 1704067200) // 3600)] = tuple(r[c] for c in cols)
    return out


def close(a, b):
    if a is None or b is None:
        return a is b
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@pytest.fixture(scope="module")
def data():
    return {
        "a": random_series(1, 420),
        "b": random_series(2, 35),
        "c": random_series(3, 3),
        "d": [(0, 1.0)],
        "e": [(h, None) for h in range(12)],
        "f": [(h * 150, float(h)) for h in range(60)],
    }


@pytest.fixture(scope="module")
def frame(spark, data):
    return series_frame(spark, data).cache()


@pytest.mark.parametrize("chunk", CHUNKS)
def test_lags_rollings_and_target(frame, data, chunk):
    spec = SeriesSpec(chunk_hours=chunk)
    got = collect(
        features.series_features(frame, spec, "v", lags=[1, 24, 40], windows=[3, 24], target="t"),
        "pm25_lag_1",
        "pm25_lag_24",
        "pm25_lag_40",
        "pm25_roll_mean_3",
        "pm25_roll_std_3",
        "pm25_roll_mean_24",
        "t",
    )
    assert len(got) == sum(len(v) for v in data.values())
    for city, rows in data.items():
        values = [v for _, v in rows]
        for i, (h, _) in enumerate(rows):
            def at(j):
                return values[j] if 0 <= j < len(values) else None

            def frame_of(n):
                part = values[max(0, i - n + 1): i + 1]
                return part if len(part) == n and None not in part else None

            f3, f24 = frame_of(3), frame_of(24)
            want = (
                at(i - 1),
                at(i - 24),
                at(i - 40),
                statistics.fmean(f3) if f3 else None,
                statistics.stdev(f3) if f3 else None,
                statistics.fmean(f24) if f24 else None,
                at(i + 1),
            )
            for g, x in zip(got[(city, h)], want, strict=True):
                assert close(g, x), (city, h, got[(city, h)], want)


@pytest.mark.parametrize("chunk", [7, 100_000])
def test_half_full_rolling(frame, data, chunk):
    got = collect(
        features.rolling_features(frame, SeriesSpec(chunk_hours=chunk), "v", [6], half_full=True),
        "pm25_roll_mean_6",
        "pm25_roll_std_6",
    )
    for city, rows in data.items():
        for i, (h, _) in enumerate(rows):
            part = [v for _, v in rows[max(0, i - 5): i + 1] if v is not None]
            mean = statistics.fmean(part) if len(part) >= 3 else None
            std = statistics.stdev(part) if len(part) >= 3 else 0.0
            assert close(got[(city, h)][0], mean) and close(got[(city, h)][1], std)


def plain_interpolate(rows, limit):
    """Two passes: line within ``limit`` rows of a known value, then back-fill and forward-fill."""
    known = [i for i, (_, v) in enumerate(rows) if v is not None]
    first = []
    for i, (h, v) in enumerate(rows):
        p = max((k for k in known if k <= i), default=None)
        q = min((k for k in known if k >= i), default=None)
        near = (p is not None and i - p <= limit) or (q is not None and q - i <= limit)
        if v is not None:
            first.append(v)
        elif not near:
            first.append(None)
        elif p is not None and q is not None:
            (hp, vp), (hq, vq) = rows[p], rows[q]
            first.append(vp + (vq - vp) * (h - hp) / (hq - hp))
        elif q is not None and q - i <= limit:
            first.append(rows[q][1])
        else:
            first.append(rows[p][1])
    out = list(first)
    for i in reversed(range(len(out) - 1)):
        if out[i] is None:
            out[i] = out[i + 1]
    for i in range(1, len(out)):
        if out[i] is None:
            out[i] = out[i - 1]
    return out


@pytest.mark.parametrize("chunk", CHUNKS)
@pytest.mark.parametrize("limit", [1, 3])
def test_interpolation(frame, data, chunk, limit):
    got = collect(clean.interpolate_gaps(frame, SeriesSpec(chunk_hours=chunk), ["v"], limit), "v")
    assert len(got) == sum(len(v) for v in data.values())
    for city, rows in data.items():
        for (h, _), want in zip(rows, plain_interpolate(rows, limit), strict=True):
            assert close(got[(city, h)][0], want), (city, h, got[(city, h)], want)


def test_interpolation_known_runs(spark):
    data = {
        "nine": [(0, 2.0)] + [(h, None) for h in range(1, 10)] + [(10, 12.0)],
        "six": [(0, 1.0)] + [(h, None) for h in range(1, 7)] + [(7, 8.0)],
        "uneven": [(0, 0.0), (1, None), (5, 10.0)],
        "lead": [(h, None) for h in range(5)] + [(5, 5.0)],
        "tail": [(0, 7.0)] + [(h, None) for h in range(1, 6)],
    }
    got = collect(clean.interpolate_gaps(series_frame(spark, data), SeriesSpec(chunk_hours=4), ["v"]), "v")
    pick = lambda k, hs: [round(got[(k, h)][0], 9) for h in hs]
    assert pick("nine", range(1, 10)) == [3, 4, 5, 9, 9, 9, 9, 10, 11]
    assert pick("six", range(1, 7)) == [2, 3, 4, 5, 6, 7]
    assert pick("uneven", [1]) == [2.0]
    assert pick("lead", range(5)) == [5.0] * 5
    assert pick("tail", range(1, 6)) == [7.0] * 5


@pytest.mark.parametrize("how", ["bfill", "ffill", "bfill_ffill"])
def test_fill_nearest(frame, data, how):
    got = collect(clean.fill_nearest(frame, SeriesSpec(chunk_hours=9), ["v"], how), "v")
    for city, rows in data.items():
        values = [v for _, v in rows]
        for i, (h, _) in enumerate(rows):
            later = next((v for v in values[i:] if v is not None), None)
            before = next((v for v in reversed(values[: i + 1]) if v is not None), None)
            want = {"bfill": later, "ffill": before, "bfill_ffill": later if later is not None else before}[how]
            assert close(got[(city, h)][0], want)


@pytest.mark.parametrize("chunk", CHUNKS)
def test_gaps(frame, data, chunk):
    got = {
        (r.city, r.s): r.gap_hours
        for r in clean.time_gaps(frame, SeriesSpec(chunk_hours=chunk))
        .select("city", F.unix_seconds("gap_end").alias("s"), "gap_hours")
        .collect()
    }
    want = {}
    for city, rows in data.items():
        for (h0, _), (h1, _) in zip(rows, rows[1:], strict=False):
            if h1 - h0 > 1:
                want[(city, 1704067200 + 3600 * h1)] = float(h1 - h0)
    assert got == want


@pytest.mark.parametrize("chunk", [6, 100_000])
def test_positions_and_cut(frame, data, chunk):
    spec = SeriesSpec(chunk_hours=chunk)
    got = collect(chunks.with_position(frame, spec, "pos", "n"), "pos", "n")
    for city, rows in data.items():
        for i, (h, _) in enumerate(rows):
            assert got[(city, h)] == (i + 1, len(rows))
    cuts = chunks.times_at_positions(frame, spec, {"mid": lambda n: F.ceil(n / 2), "third": lambda n: F.lit(3)})
    cuts = {r.city: (r.m, r.t) for r in cuts.select("city", F.unix_seconds("mid").alias("m"), F.unix_seconds("third").alias("t")).collect()}
    for city, rows in data.items():
        at = [1704067200 + 3600 * h for h, _ in rows]
        assert cuts[city] == (at[math.ceil(len(rows) / 2) - 1], at[2] if len(at) > 2 else None)


@pytest.mark.parametrize("n", [1, 5, 50])
def test_latest_rows(frame, data, n):
    got = {(r.city, r.s) for r in chunks.latest_rows(frame, SeriesSpec(chunk_hours=11), n).select("city", F.unix_seconds("datetime").alias("s")).collect()}
    assert got == {(c, 1704067200 + 3600 * h) for c, rows in data.items() for h, _ in rows[-n:]}
