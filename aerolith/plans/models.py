"""Candidate regressors, comparison, tuning and the training job."""

from __future__ import annotations

import random
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from aerolith.operators.chunks import SeriesSpec
from aerolith.operators.forest import fit_forest
from aerolith.operators.split import expanding_folds, standard_moments, time_split
from aerolith.operators.stats import regression_metrics
from aerolith.plans.registry import ModelRegistry
from aerolith.schema import TARGET
from aerolith.session import discard, job, stage

SEED = 42
VECTOR = "_features"
LINEAR, RIDGE, LASSO = "Linear Regression", "Ridge Regression", "Lasso Regression"
FOREST, BOOST, XBOOST = "Random Forest", "Gradient Boosting", "Subsampled Gradient Boosting"

# Settings of the six candidates.
CANDIDATES: dict[str, dict] = {
    LINEAR: {},
    RIDGE: {"alpha": 1.0},
    LASSO: {"alpha": 0.01, "max_iter": 2000},
    FOREST: {"trees": 100, "depth": 14, "min_leaf": 2},
    BOOST: {"trees": 100, "depth": 5, "rate": 0.08},
    XBOOST: {"trees": 120, "depth": 6, "rate": 0.08, "subsample": 0.85},
}
SCALED = {LINEAR, RIDGE, LASSO}

# Search spaces of the tuning step.
SEARCH: dict[str, dict[str, list]] = {
    XBOOST: {
        "trees": [100, 150, 200, 250],
        "depth": [4, 5, 6, 8],
        "rate": [0.03, 0.05, 0.08, 0.1],
        "subsample": [0.75, 0.85, 0.95],
    },
    FOREST: {
        "trees": [100, 150, 200],
        "depth": [10, 14, 18, 30],
        "min_leaf": [1, 2, 4],
        "subset": ["sqrt", "0.8", "all"],
    },
    RIDGE: {"alpha": [0.01, 0.1, 1.0, 10.0, 100.0]},
}


def _regressor(name: str, settings: Mapping, target: str, rows: int, spread: float) -> Estimator:
    common = {"featuresCol": VECTOR, "labelCol": target, "predictionCol": "prediction"}
    if name in SCALED:
        alpha = settings.get("alpha", 0.0)
        # The solver scales the label to deviation 1: a ridge penalty on the sum of squares is
        # divided by n and multiplied by that deviation. "normal" needs one pass over the data.
        penalty = alpha * spread / rows if name == RIDGE else alpha
        return LinearRegression(
            **common,
            standardization=False,
            regParam=penalty,
            elasticNetParam=1.0 if name == LASSO else 0.0,
            maxIter=settings.get("max_iter", 200),
            tol=1e-9,
            solver="normal",
        )
    trees = {"maxDepth": settings["depth"], "minInstancesPerNode": settings.get("min_leaf", 1), "seed": SEED}
    return GBTRegressor(
        **common, **trees, maxIter=settings["trees"], stepSize=settings["rate"], subsamplingRate=settings.get("subsample", 1.0)
    )


def _scaler(moments: Mapping[str, tuple[float, float]]) -> SQLTransformer:
    parts = [f"(`{c}` - ({m!r}D)) / ({s!r}D) AS `{c}_z`" for c, (m, s) in moments.items()]
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


@dataclass
class TrainingData:
    """Staged train and test tables and the few numbers models need of the train part."""

    train: DataFrame
    test: DataFrame
    features: list[str]
    target: str = TARGET
    moments: dict = field(default_factory=dict)
    rows: int = 0
    spread: float = 1.0

    @classmethod
    def of(cls, table: DataFrame, spec: SeriesSpec, features: Sequence[str], target: str = TARGET, test_ratio: float = 0.20) -> TrainingData:
        narrow = table.select(*dict.fromkeys([*spec.keys, spec.ts, *features, target])).dropna("any")
        split = stage(time_split(narrow, spec, test_ratio))
        return cls.split_on(split.filter(F.col("split") == "train"), split.filter(F.col("split") == "test"), features, target)

    @classmethod
    def split_on(cls, train: DataFrame, test: DataFrame, features: Sequence[str], target: str = TARGET) -> TrainingData:
        size = train.agg(F.count("*").alias("n"), F.stddev_pop(target).alias("s")).first()
        if not size["n"]:
            raise ValueError("no rows to train on: the series are too short for this split")
        return cls(train, test, list(features), target, standard_moments(train, features), size["n"], size["s"] or 1.0)


def fit(name: str, data: TrainingData, settings: Mapping | None = None) -> PipelineModel:
    """One candidate as a model that can be saved whole: scaling (linear models), vector, regressor."""
    settings = {**CANDIDATES.get(name, {}), **(settings or {})}
    stages: list = []
    inputs = data.features
    if name in SCALED:
        stages.append(_scaler(data.moments))
        inputs = [f"{c}_z" for c in data.features]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=VECTOR))
    if name == FOREST:
        kinds = {k: settings[k] for k in ("trees", "depth", "min_leaf", "subset") if k in settings}
        return PipelineModel([*stages, fit_forest(data.train, data.features, data.target, seed=SEED, featuresCol=VECTOR, predictionCol="prediction", **kinds)])
    stages.append(_regressor(name, settings, data.target, data.rows, data.spread))
    return Pipeline(stages=stages).fit(data.train)


def _metrics(row: Row | None) -> dict[str, float]:
    if row is None or not row["n"]:
        raise ValueError("no rows to evaluate on: the series are too short for this split")
    return {"MAE": round(row["mae"], 4), "RMSE": round(row["rmse"], 4), "R2": round(row["r2"], 4) if row["r2"] is not None else float("nan")}


def evaluate(model: PipelineModel, data: DataFrame, target: str = TARGET) -> dict[str, float]:
    """Metrics to four decimals."""
    return _metrics(regression_metrics(model.transform(data), target, "prediction").first())


def evaluate_parts(model: PipelineModel, data: TrainingData) -> tuple[dict[str, float], dict[str, float]]:
    """Metrics of the train and the test part, in one pass."""
    parts = data.train.withColumn("_part", F.lit("train")).unionByName(data.test.withColumn("_part", F.lit("test")))
    rows = {r["_part"]: r for r in regression_metrics(model.transform(parts), data.target, "prediction", ["_part"]).collect()}
    return _metrics(rows.get("train")), _metrics(rows.get("test"))


def compare(data: TrainingData, candidates: Mapping[str, Mapping] | None = None, parallelism: int = 2) -> tuple[DataFrame, dict[str, PipelineModel], str]:
    """Fit all candidates; leaderboard by test RMSE, the models, and the champion's name.

    Fits run next to each other: while one waits for its last tasks the next uses the cluster.
    """
    chosen = CANDIDATES if candidates is None else candidates

    def run(item):
        name, settings = item
        begin = time.time()
        model = fit(name, data, settings)
        seconds = time.time() - begin
        train, test = evaluate_parts(model, data)
        return name, model, train, test, seconds

    with ThreadPool(parallelism) as pool:
        results = pool.map(run, list(chosen.items()))
    results.sort(key=lambda r: (r[3]["RMSE"], r[0]))
    rows = [
        (i, name, tr["RMSE"], te["RMSE"], tr["MAE"], te["MAE"], tr["R2"], te["R2"], round(tr["R2"] - te["R2"], 4), round(sec, 2), name in SCALED)
        for i, (name, _, tr, te, sec) in enumerate(results, 1)
    ]
    board = data.train.sparkSession.createDataFrame(
        rows,
        "rank int, model string, train_rmse double, test_rmse double, train_mae double, test_mae double, train_r2 double, "
        "test_r2 double, overfit_gap_r2 double, train_time_sec double, needs_scaling boolean",
    )
    return board, {r[0]: r[1] for r in results}, results[0][0]


def draws(space: Mapping[str, Sequence], n: int, seed: int = SEED) -> list[dict]:
    """``n`` different settings in seeded random order (all of a smaller space)."""
    grid = [dict(zip(space, values, strict=True)) for values in product(*space.values())]
    random.Random(seed).shuffle(grid)
    return grid[:n]


def tune(
    name: str,
    data: TrainingData,
    spec: SeriesSpec,
    *,
    n_iter: int = 15,
    splits: int = 4,
    space: Mapping | None = None,
    parallelism: int = 2,
) -> tuple[PipelineModel, dict, float]:
    """Search settings by mean RMSE over expanding folds; refit the best on all train rows."""
    folded = stage(expanding_folds(data.train, spec, splits))
    parts = []
    for i in range(1, splits + 1):
        parts.append(TrainingData.split_on(folded.filter(F.col("fold") < i), folded.filter(F.col("fold") == i), data.features, data.target))
    name = name if name in SEARCH or space else RIDGE
    best: tuple[float, dict] | None = None
    with ThreadPool(parallelism) as pool:
        for settings in draws(space or SEARCH[name], n_iter):

            def rmse_on(part: TrainingData, settings: dict = settings) -> float:
                return evaluate(fit(name, part, settings), part.test, part.target)["RMSE"]

            scores = pool.map(rmse_on, parts)
            score = sum(scores) / len(scores)
            if best is None or score < best[0]:
                best = (score, settings)
    discard(folded)
    return fit(name, data, best[1]), best[1], best[0]


def linear_terms(model: PipelineModel, features: Sequence[str], moments: Mapping[str, tuple[float, float]]) -> tuple[dict[str, float], float]:
    """Coefficients and intercept of a scaled linear candidate, in units of the raw columns."""
    last = model.stages[-1]
    raw = {c: float(w) / moments[c][1] for c, w in zip(features, last.coefficients, strict=True)}
    return raw, float(last.intercept) - sum(raw[c] * moments[c][0] for c in features)


def train(
    table: DataFrame,
    spec: SeriesSpec,
    features: Sequence[str],
    registry: ModelRegistry | None = None,
    *,
    target: str = TARGET,
    test_ratio: float = 0.20,
    candidates: Mapping[str, Mapping] | None = None,
    tuned: bool = False,
    n_iter: int = 15,
) -> tuple[DataFrame, str, dict[str, float]]:
    """Split, compare, optionally tune a tree champion, save. Returns leaderboard, name, metrics."""
    with job():
        data = TrainingData.of(table, spec, features, target, test_ratio)
        board, models, champion = compare(data, candidates)
        model, settings = models[champion], {}
        if tuned and champion in (XBOOST, FOREST):
            model, settings, _ = tune(champion, data, spec, n_iter=n_iter)
        metrics = evaluate(model, data.test, target)
        if registry is not None:
            registry.save(model, champion, metrics, features, hyperparameters=settings)
    return board, champion, metrics
