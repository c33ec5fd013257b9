"""Ranks, statistics, splits, models, forecast and attribution against plain computations."""

import math
from collections import Counter
from datetime import timedelta
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith import SeriesSpec
from aerolith.functions.risk import floored_prediction
from aerolith.operators import explain, forecast, forest, ranks, select, split, stats
from aerolith.operators.features import engineer_features, live_features
from aerolith.plans import jobs
from aerolith.plans import models as M
from aerolith.plans.registry import ModelRegistry, tree_nodes
from aerolith.plans.scoring import linear_model, score
from aerolith.session import stage
from tests.frames import T0, series_frame
from tests.test_tables import observations

SPEC = SeriesSpec()
MODEL, INTERCEPT = {"pm2_5": 0.6, "pm25_lag_24": 0.2, "pm25_roll_mean_24": 0.1, "pm25_roll_std_72": 0.05, "hour_sin": 1.5}, 1.0


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 12, 900).astype(float)
    b = np.where(rng.random(900) < 0.4, 5.0, rng.normal(size=900))
    y = a * 2 + b + rng.normal(size=900)
    table = np.c_[a, b, y]
    df = spark.createDataFrame([tuple(map(float, r)) for r in table], "a double, b double, y double").repartition(5).cache()
    return df, table


def plain_rank(x):
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


@pytest.mark.parametrize("bin_values", [7, 100, 300, 10**6])
def test_value_ranks(numbers, bin_values):
    df, table = numbers
    rows = ranks.value_ranks(df, ["a", "b"], bin_values).withColumn("r", ranks.average_rank()).collect()
    got = {(r.feature, r.x): (r.r, r.total) for r in rows}
    for i, c in enumerate("ab"):
        for v, want in zip(table[:, i], plain_rank(table[:, i]), strict=True):
            assert got[(c, v)] == (want, 900)


def test_rank_of_special_values(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(x,) for x in (1.0, -inf, inf, nan, 1.0, None, 0.0, -0.0)], "x double")
    got = {str(r.x): (r.below, r.n) for r in ranks.value_ranks(df, ["x"]).collect()}
    assert got == {"-inf": (0, 1), "0.0": (1, 2), "1.0": (3, 2), "inf": (5, 1), "nan": (6, 1)}


def test_a_mostly_zero_column_fills_its_ranges_evenly(spark):
    df = spark.range(20_000).selectExpr("CASE WHEN id % 50 = 0 THEN cast(id as double) ELSE 0.0 END AS x")
    ranged, sums = ranks._ranged(df, ["x"], 8)
    sizes = [r["count"] for r in ranged.groupBy("_bin").count().collect()]
    assert sum(sizes) == 400 and len(sizes) == 8 and max(sizes) <= 80
    assert sums.agg({"_in_bin": "sum"}).first()[0] == 20_000


def test_statistics(numbers):
    df, table = numbers
    a, b, y = table.T
    pearson = {r.feature: r.pearson_r for r in stats.pearson_with_target(df, ["a", "b"], "y").collect()}
    spearman = {r.feature: r.spearman_rho for r in stats.spearman_with_target(df, ["a", "b"], "y").collect()}
    for name, x in (("a", a), ("b", b)):
        assert math.isclose(pearson[name], np.corrcoef(x, y)[0, 1], rel_tol=1e-9)
        assert math.isclose(spearman[name], np.corrcoef(plain_rank(x), plain_rank(y))[0, 1], rel_tol=1e-9)
    for bin_values in (50, 10**6):
        quart = {(r.feature, r.share): r.quantile for r in ranks.exact_quantiles(df, ["a", "b"], [0.0, 0.25, 0.5, 0.9, 1.0], bin_values).collect()}
        for name, x in (("a", a), ("b", b)):
            for q in (0.0, 0.25, 0.5, 0.9, 1.0):
                assert math.isclose(quart[(name, q)], np.quantile(x, q), abs_tol=1e-9)
    cells = {}
    place = lambda x: np.floor([(x < v).sum() * 8 / 900 for v in x])
    for p, q in zip(place(a), place(y), strict=True):
        cells[(p, q)] = cells.get((p, q), 0) + 1 / 900
    px, py = {}, {}
    for (p, q), w in cells.items():
        px[p], py[q] = px.get(p, 0) + w, py.get(q, 0) + w
    want = sum(w * math.log(w / px[p] / py[q]) for (p, q), w in cells.items())
    got = stats.mutual_information(df, ["a"], "y", bins=8).first().mi_score
    assert math.isclose(got, want, rel_tol=1e-9)


@pytest.mark.parametrize("bin_values", [40, 300, 10**6])
def test_cells_of_many_ranges_give_both_scores(numbers, bin_values):
    df, table = numbers
    cells = ranks.rank_cells(df, ["a", "b", "y"], "y", 8, bin_values).localCheckpoint()
    rho = {r.feature: r.spearman_rho for r in stats.spearman_with_target(df, ["a", "b", "y"], "y", cells).collect()}
    got = {r.feature: {} for r in cells.select("feature").distinct().collect()}
    for r in cells.collect():
        got[r.feature][(r.x_bin, r.y_bin)] = got[r.feature].get((r.x_bin, r.y_bin), 0) + r.n
    place = lambda x: [int((x < v).sum() * 8 // 900) for v in x]
    for name, x in zip("aby", table.T, strict=True):
        assert math.isclose(rho[name], np.corrcoef(plain_rank(x), plain_rank(table[:, 2]))[0, 1], rel_tol=1e-9)
        assert got[name] == Counter(zip(place(x), place(table[:, 2]), strict=True))


def test_ranges_of_a_mostly_zero_column(spark):
    df = spark.range(4000).selectExpr("CASE WHEN id % 50 = 0 THEN cast(id as double) ELSE 0.0 END AS a", "cast(id as double) AS y")
    x = np.array([float(i) if i % 50 == 0 else 0.0 for i in range(4000)])
    cells = ranks.rank_cells(df, ["a"], "y", 8, 100)
    rho = stats.spearman_with_target(df, ["a"], "y", cells).first().spearman_rho
    assert math.isclose(rho, np.corrcoef(plain_rank(x), np.arange(4000))[0, 1], rel_tol=1e-9)
    assert cells.agg({"n": "sum"}).first()[0] == 4000


def test_the_selection_ranks_and_bins_its_rows_once(numbers, monkeypatch):
    """Before, each score ranked all columns for itself and each forest cut its own bins."""
    df, _ = numbers
    calls = Counter()

    def counted(module, name):
        plain = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *args, **kw: calls.update([name]) or plain(*args, **kw))

    counted(ranks, "value_ranks")
    counted(forest, "_cuts")
    scores = select.score_features(df, ["a", "b"], "y", trees=2, depth=2)
    assert {r.feature for r in scores.collect()} == {"a", "b"}
    assert calls == {"value_ranks": 1, "_cuts": 1}


def test_constant_column_has_no_correlation(spark):
    df = spark.range(50).select(F.lit(3.0).alias("c"), F.col("id").cast("double").alias("y"))
    assert stats.pearson_with_target(df, ["c"], "y").first().pearson_r is None
    assert stats.spearman_with_target(df, ["c"], "y").first().spearman_rho is None
    assert stats.trend_lines(df, ["c"], "y").first().slope is None


def test_variance_inflation(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    x = np.c_[x, x[:, 0] + 0.3 * x[:, 1] + 0.2 * rng.normal(size=300), x[:, 2]]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], [f"c{i}" for i in range(5)])
    got = {r.feature: (r.r_squared, r.vif) for r in stats.variance_inflation(df, df.columns).collect()}
    for i in range(5):
        others = np.c_[np.delete(x, i, 1), np.ones(300)]
        fitted = others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        r2 = 1 - ((x[:, i] - fitted) ** 2).sum() / ((x[:, i] - x[:, i].mean()) ** 2).sum()
        assert got[f"c{i}"] == (round(r2, 4), round(1 / (1 - r2), 2) if r2 < 0.99999 else 10000.0)


def test_histogram_and_sample(numbers):
    df, table = numbers
    counts, edges = np.histogram(table[:, 2], bins=20)
    got = {r.bin: r for r in stats.histogram(df, "y", 20).collect()}
    assert [got[i].n if i in got else 0 for i in range(20)] == list(counts)
    assert math.isclose(got[0].bin_start, edges[0])
    keyed = df.select("y", F.monotonically_increasing_id().alias("id"))
    first = stats.fixed_sample(keyed.coalesce(1), 40, ["y"]).select("y").collect()
    assert sorted(first) == sorted(stats.fixed_sample(keyed.repartition(7), 40, ["y"]).select("y").collect()) and len(first) == 40


@pytest.mark.parametrize("chunk", [10, 8760])
def test_split_and_folds(spark, chunk):
    spec = SeriesSpec(chunk_hours=chunk)
    data = {f"n{n}": [(h * 3, float(h)) for h in range(n)] for n in (1, 2, 5, 10, 23)}
    df = series_frame(spark, data)
    parts = split.time_split(df, spec).collect()
    folds = split.expanding_folds(df, spec, 4).collect()
    for n in (1, 2, 5, 10, 23):
        mine = sorted((r.v, r.split) for r in parts if r.city == f"n{n}")
        cut = int(n * (1 - 0.20))
        assert [s for _, s in mine] == ["train"] * cut + ["test"] * (n - cut)
        size = n // 5
        if size:
            got = [f for _, f in sorted((r.v, r.fold) for r in folds if r.city == f"n{n}")]
            assert got == [0] * (n - 4 * size) + [f for f in (1, 2, 3, 4) for _ in range(size)]


def test_composite_ranking(spark):
    def table(name, values):
        return spark.createDataFrame(list(zip("pqr", values, strict=True)), f"feature string, {name} double")

    out = select.consolidate_scores(
        table("abs_pearson_r", [0.8, 0.4, 0.2]),
        table("abs_spearman_rho", [0.5, 0.5, 0.1]),
        table("mi_score", [0.1, 0.4, 0.2]),
        table("avg_tree_importance", [0.5, 0.25, 0.25]),
        table("vif", [1.0, 2.0, 3.0]),
    )
    rows = {r.feature: r for r in out.collect()}
    assert math.isclose(rows["p"].composite_score, 0.30 + 0.20 + 0.25 * 0.25 + 0.25)
    assert math.isclose(rows["q"].composite_score, 0.15 + 0.20 + 0.25 + 0.125)
    assert select.top_features(out, 2) == ["p", "q"]


def test_rank_difference_with_ties(spark):
    pe = spark.createDataFrame([("a", 0.9), ("b", 0.5), ("c", 0.5), ("d", 0.1)], "feature string, abs_pearson_r double")
    sp = spark.createDataFrame([("a", 0.2), ("b", 0.8), ("c", 0.4), ("d", 0.3)], "feature string, abs_spearman_rho double")
    got = {r.feature: r.rank_diff for r in stats.rank_compare(pe, sp).collect()}
    assert got == {"a": 3.0, "b": 1.5, "c": 0.5, "d": 1.0}


@pytest.fixture(scope="module")
def cities(spark):
    def pm(c, h):
        return 30 + 10 * math.sin(h / 24 * 2 * math.pi) + 5 * math.cos(h / 60) + c * 3 + (h * 7919 % 13) / 4

    return stage(observations(spark, 2, 420, pm=pm))


@pytest.fixture(scope="module")
def table(cities):
    return stage(engineer_features(cities, SPEC))


FEATURES = ["pm2_5", "pm25_lag_24", "pm25_roll_mean_24", "hour_sin", "hour_cos"]


def test_linear_candidates_match_closed_forms(table):
    data = M.TrainingData.of(table, SPEC, FEATURES)
    rows = data.train.select(*FEATURES, "target_pm25").toPandas().to_numpy()
    x, y = rows[:, :-1], rows[:, -1]
    z, yc = (x - x.mean(0)) / x.std(0), y - y.mean()
    want = {M.LINEAR: np.linalg.lstsq(z, yc, rcond=None)[0], M.RIDGE: np.linalg.solve(z.T @ z + np.eye(5), z.T @ yc)}
    for name, weights in want.items():
        model = M.fit(name, data)
        assert np.allclose(model.stages[-1].coefficients.toArray(), weights, atol=1e-6)
        raw, intercept = M.linear_terms(model, FEATURES, data.moments)
        predicted = model.transform(data.test).select("prediction", (sum(F.lit(w) * F.col(c) for c, w in raw.items()) + F.lit(intercept)).alias("p"))
        assert predicted.filter(F.abs(F.col("p") - F.col("prediction")) > 1e-6).count() == 0


def test_training_registers_a_champion(spark, table, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path / "models"))
    with pytest.raises(FileNotFoundError):
        registry.load()
    kept = {M.LASSO: {}, M.BOOST: {"trees": 5, "depth": 3}}
    _, meta = registry.load(retrain=lambda: M.train(table, SPEC, FEATURES, registry, candidates=kept))
    board, champion, metrics = M.train(table, SPEC, FEATURES, registry, candidates=kept)
    rows = board.orderBy("rank").collect()
    assert [r.test_rmse for r in rows] == sorted(r.test_rmse for r in rows)
    model, meta = registry.load()
    assert meta["model_name"] == champion == rows[0].model and meta["features"] == FEATURES
    assert meta["metrics"]["RMSE"] == metrics["RMSE"] == rows[0].test_rmse
    registry.save(model, "Other Model", {"RMSE": 1.0}, FEATURES, version="v7", is_champion=False)
    assert registry.load()[1]["model_name"] == champion and registry.load("v7")[1]["model_name"] == "Other Model"


def test_search_settings_do_not_repeat():
    chosen = M.draws(M.SEARCH[M.FOREST], 15)
    assert len({tuple(sorted((k, str(v)) for k, v in d.items())) for d in chosen}) == 15
    assert chosen == M.draws(M.SEARCH[M.FOREST], 15) and len(M.draws({"alpha": [1, 2]}, 15)) == 2


def test_tuning_on_expanding_folds(table):
    model, best, rmse = M.tune(M.RIDGE, M.TrainingData.of(table, SPEC, FEATURES), SPEC, n_iter=2, splits=2)
    assert best["alpha"] in M.SEARCH[M.RIDGE]["alpha"] and rmse > 0 and model.stages


def replay(history, base, hours, row):
    """The forecast loop in plain Python."""
    out, h = [], list(history)
    for s in range(1, hours + 1):
        ts = base + timedelta(hours=s)
        feats = {
            "pm2_5": h[-1],
            "pm25_lag_24": h[-24],
            "pm25_roll_mean_24": float(np.mean(h[-24:])),
            "pm25_roll_std_72": float(np.std(h[-72:])),
            "hour_sin": math.sin(2 * math.pi * ts.hour / 24),
        }
        raw = INTERCEPT + sum(w * feats[c] for c, w in MODEL.items())
        h.append(max(0.5, round(max(0.0, raw), 2)))
        out.append(h[-1])
    return out


@pytest.mark.parametrize("hours", [1, 30])
def test_forecast_replay_both_ways(spark, cities, hours):
    state = stage(forecast.forecast_state(cities, live_features(cities, SPEC), SPEC))
    fold = forecast.forecast_linear(state, SPEC, MODEL, INTERCEPT, hours=hours).collect()
    steps = forecast.forecast_model(state, SPEC, linear_model(MODEL, INTERCEPT), list(MODEL), hours=hours).collect()
    series = {}
    for r in cities.orderBy("datetime").collect():
        series.setdefault(r.city, []).append(r.pm2_5)
    for city, values in series.items():
        want = replay(values, T0 + timedelta(hours=419), hours, None)
        for rows in (fold, steps):
            got = [r.predicted for r in sorted((r for r in rows if r.city == city), key=lambda r: r.step)]
            assert got == pytest.approx(want, abs=1e-9)
    assert all(r.lower_bound_90 >= 0 and r.upper_bound_90 > r.predicted for r in fold)


def test_forecast_from_short_history(spark):
    df = observations(spark, 1, 5, pm=lambda c, h: 40.0 + h)
    state = forecast.forecast_state(df, live_features(df, SPEC), SPEC)
    assert state.first()[forecast.HISTORY] == [44.0] * 72
    rows = forecast.forecast_linear(state, SPEC, {"pm2_5": 1.0}, 0.0, hours=168).collect()
    assert len(rows) == 168 and {r.predicted for r in rows} == {44.0}
    assert max(r.day_offset for r in rows) == 7
    days = forecast.daily_summary(forecast.forecast_linear(state, SPEC, {"pm2_5": 1.0}, 0.0), SPEC).collect()
    assert sorted(r.day_offset for r in days) == [1, 2, 3]
    first = next(r for r in days if r.day_offset == 1)
    assert first.peak_hour == "Mon 05:00 AM" and first.day_name == "Monday, Jan 01" and first.aqi_category.startswith("Unhealthy for")
    with pytest.raises(ValueError, match="hours"):
        forecast.forecast_linear(state, SPEC, {}, 0.0, hours=169)


def test_first_training_mode_step_equals_scoring(cities):
    latest = stage(live_features(cities, SPEC))
    weights = {**MODEL, "pm25_lag_168": 0.3, "weekday": 0.2, "pm25_roll_std_24": 0.1, "month_cos": 1.0}
    state = forecast.forecast_state(cities, latest, SPEC)
    one = {r.city: r.predicted for r in forecast.forecast_linear(state, SPEC, weights, INTERCEPT, hours=1, mode="training").collect()}
    scored = score(latest, linear_model(weights, INTERCEPT), list(weights), ["city"]).collect()
    assert one == {r.city: r.predicted_target_pm25 for r in scored}


def test_linear_attribution_and_narrative(spark):
    df = spark.createDataFrame([(10.0, 2.0, 5.0)], "pm2_5 double, pm10 double, co double")
    weights, means = {"pm2_5": 2.0, "pm10": -1.0, "co": 0.5}, {"pm2_5": 4.0, "pm10": 1.0, "co": 9.0}
    row = explain.explain_linear(df, weights, 3.0, means)
    text = explain.narrative(F.lit(22.5), F.col("base_value"), F.col("contributions"))
    r = row.withColumn("text", text).first()
    assert [(c.feature, c.shap_value) for c in r.contributions] == [("pm2_5", 12.0), ("co", -2.0), ("pm10", -1.0)]
    assert r.base_value + sum(c.shap_value for c in r.contributions) == 3.0 + 20.0 - 2.0 + 2.5
    assert r.text == (
        "The AI model predicts a PM2.5 concentration of **22.5 µg/m³** (baseline expectation is 14.5 µg/m³).\n\n"
        "• **Key factors elevating pollution**: **Current PM2.5 Level** (+12.00).\n\n"
        "• **Key factors mitigating pollution**: **Carbon Monoxide (CO)** (-2.00), **PM10 Coarse Dust** (-1.00)."
    )


def conditional(nodes, x, known, node=0):
    """Expected prediction with only ``known`` features, by cover."""
    value, cover, left, right, feature, threshold = nodes[node]
    if left < 0:
        return value
    if feature in known:
        return conditional(nodes, x, known, left if x[feature] <= threshold else right)
    return sum(nodes[c][1] / cover * conditional(nodes, x, known, c) for c in (left, right))


@pytest.mark.parametrize("name", [M.BOOST, M.FOREST])
def test_tree_attribution_is_exact(spark, table, tmp_path, name):
    data = M.TrainingData.of(table, SPEC, FEATURES)
    model = M.fit(name, data, {"trees": 3, "depth": 4})
    trees = tree_nodes(spark, model.stages[-1], str(tmp_path / "trees"))
    rows = model.transform(data.test.limit(20)).select("city", *FEATURES, "prediction")
    for r in explain.explain_trees(rows, FEATURES, trees).collect():
        parts = [r[f"shap_{f}"] for f in FEATURES]
        assert r.base_value + sum(parts) == pytest.approx(r.prediction, abs=1e-8)
        x = [r[f] for f in FEATURES]
        want = []
        for f in range(5):
            total = 0.0
            others = [g for g in range(5) if g != f]
            for size in range(5):
                for s in combinations(others, size):
                    gain = sum(w * (conditional(t, x, {*s, f}) - conditional(t, x, set(s))) for w, t in trees)
                    total += factorial(size) * factorial(4 - size) / factorial(5) * gain
            want.append(total)
        assert parts == pytest.approx(want, abs=1e-8)


def test_hourly_jobs(spark, cities, table, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path / "models"))
    M.train(table, SPEC, FEATURES, registry, candidates={M.LINEAR: {}})
    raw, log = str(tmp_path / "raw"), str(tmp_path / "log")
    jobs.hourly_features(cities, SPEC, raw)
    for hour in (420, 421):
        latest = jobs.hourly_features(observations(spark, 2, 1, start=hour, pm=lambda c, h: 31.0 + c), SPEC, raw)
        jobs.hourly_predictions(latest, SPEC, registry, log, str(tmp_path / "latest"))
    rows = spark.read.parquet(log)
    assert rows.count() == 4 and spark.read.json(str(tmp_path / "latest")).count() == 2
    assert {r.current_pm25 for r in rows.collect()} == {31.0, 32.0}
    want = registry.load()[0].transform(latest).select("city", floored_prediction(F.col("prediction")).alias("p")).collect()
    newest = rows.filter(F.col("input_timestamp") == rows.agg(F.max("input_timestamp")).first()[0]).collect()
    assert {(r.city, r.predicted_next_hour_pm25) for r in newest} == {(r.city, r.p) for r in want}


def test_selection_job(spark, table, tmp_path):
    narrow = table.select("city", "datetime", *FEATURES, "target_pm25")
    chosen = jobs.select_features(narrow, SPEC, str(tmp_path), k=3, trees=3, depth=3, train_only=True)
    assert [r.value for r in spark.read.text(str(tmp_path / "feature_list")).collect()] == chosen and len(chosen) == 3
    assert spark.read.parquet(str(tmp_path / "selected")).columns == ["city", "datetime", *chosen, "target_pm25"]


def test_tabled_attribution_is_that_of_single_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    x[:5, 0] = 0.5
    nodes = {0: (0.0, 100, 1, 2, 0, 0.5), 1: (0.0, 60, 3, 4, 1, 0.1), 2: (4.0, 40, -1, -1, -1, 0.0), 3: (1.0, 20, -1, -1, -1, 0.0), 4: (0.0, 40, 5, 6, 0, -0.4), 5: (-2.0, 30, -1, -1, -1, 0.0), 6: (3.0, 10, -1, -1, -1, 0.0)}
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").localCheckpoint()
    single = explain._shapley_of_leaves
    sizes = []
    monkeypatch.setattr(explain, "_shapley_of_leaves", lambda inside, share: sizes.append(len(inside)) or single(inside, share))
    tables = [explain._tabled(group) for group in explain._by_length(explain._leaf_paths(nodes))]
    assert len(tables) == len(sizes) and all(n <= 4 for n in sizes)  # cases of a path, not rows
    monkeypatch.undo()
    tabled = [tuple(r) for r in explain.explain_trees(rows, ["a", "b", "c"], [(0.5, nodes), (2.0, nodes)]).collect()]
    total = np.zeros((len(x), 3))
    for w in (0.5, 2.0):
        for value, path in explain._leaf_paths(nodes):
            at, low, high, share = (np.array([p[i] for p in path]) for i in range(4))
            seen = x[:, at]
            amounts = single(((seen > low) & (seen <= high)).astype(float)[:, None, :], share[None, :])[:, 0] * value * w
            np.add.at(total.T, at, amounts.T)
    assert np.allclose(np.array(tabled)[:, 3:6], total, atol=1e-12)
