import random
import re

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor

from aerolith.operators import forest

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    made = [(float(rng.randrange(12)), float(rng.randrange(20)), rng.gauss(0, 1)) for _ in range(3000)]
    return spark.createDataFrame([(a, b, c, 3 * a - (b > 7) * a + round(c, 1)) for a, b, c in made], "a double, b double, c double, y double").repartition(4).localCheckpoint()


def test_one_tree_is_that_of_spark(spark, rows):
    few = rows.select("a", "b", "y")
    model = forest.fit_forest(few, ["a", "b"], "y", trees=1, depth=5, min_leaf=3, bootstrap=False, featuresCol="v", group_rows=500)
    data = VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(few)
    other = RandomForestRegressor(featuresCol="v", labelCol="y", numTrees=1, maxDepth=5, minInstancesPerNode=3, bootstrap=False, featureSubsetStrategy="all").fit(data)
    assert np.allclose(model.featureImportances.toArray(), other.featureImportances.toArray(), atol=1e-9)
    got, want = ([r.prediction for r in m.transform(data).select("prediction").collect()] for m in (model, other))
    assert np.allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("settings", [{"subset": "all"}, {"subset": "onethird", "bootstrap": False}, {"subset": "sqrt", "min_leaf": 4}])
def test_nodes_split_from_sums_are_those_finished_in_one_place(spark, rows, settings, monkeypatch):
    whole = forest.fit_forest(rows, NAMES, "y", trees=4, depth=6, **settings)
    parts = forest.fit_forest(rows, NAMES, "y", trees=4, depth=6, group_rows=100, **settings)
    assert _rounded(whole) == _rounded(parts)
    assert np.allclose(whole.featureImportances.toArray(), parts.featureImportances.toArray())
    # Before, all statistics of all nodes were summed; now no group holds more rows than it may.
    assert all(size <= 100 for top in _tops(rows, monkeypatch, settings) for i, size in enumerate(top.rows) if i in top.small)


def _rounded(model):
    return re.sub(r"-?\d+\.\d+(E-?\d+)?", lambda m: f"{float(m[0]):.8f}", model.toDebugString.split("\n", 1)[1])


def _tops(rows, monkeypatch, settings):
    seen = []
    finish = forest._finish_small
    monkeypatch.setattr(forest, "_finish_small", lambda blocks, tops, *rest: seen.extend(tops) or finish(blocks, tops, *rest))
    forest.fit_forest(rows, NAMES, "y", trees=2, depth=6, group_rows=100, **settings)
    assert any(len(top.small) > 1 for top in seen)
    return seen


def test_bootstrap_draws_are_poisson():
    drawn = np.stack([forest.repeats(np.arange(20000), t, 1, True) for t in range(3)])
    assert abs(drawn.mean() - 1) < 0.02 and abs(drawn.var() - 1) < 0.03 and abs((drawn == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(drawn)[0, 1]) < 0.03
    assert [forest.columns_per_split(s, 18) for s in ("all", "onethird", "sqrt", "0.8")] == [18, 6, 5, 15]


def test_equal_gains_do_not_go_to_the_first_column(spark):
    rng = random.Random(2)
    made = spark.createDataFrame([(*(rng.random() for _ in range(6)), rng.gauss(0, 1)) for _ in range(400)], [*"abcdef", "y"])
    parts = forest.fit_forest(made, list("abcdef"), "y", trees=30, depth=12).featureImportances.toArray()
    vectors = VectorAssembler(inputCols=list("abcdef"), outputCol="v").transform(made)
    other = RandomForestRegressor(featuresCol="v", labelCol="y", numTrees=30, maxDepth=12, featureSubsetStrategy="all").fit(vectors).featureImportances.toArray()
    assert np.abs(parts - other).max() < 0.04


@pytest.mark.parametrize(("chosen", "bootstrap"), [(6, True), (6, False), (2, False)])
def test_nodes_grown_in_pieces_are_those_grown_at_once(monkeypatch, chosen, bootstrap):
    rng = np.random.default_rng(4)
    x = rng.integers(0, forest.BINS, (6, 5000)).astype(np.uint8)
    y = np.round(x[0] * 2.0 + x[3] * (x[5] > 9) + rng.normal(0, 9, 5000) + 50, 2)
    w = rng.integers(1, 4, 5000).astype(float) if bootstrap else None
    settings = {"depth": 8, "least": 2, "seed": 3, "chosen": chosen}
    counted = []
    histograms = forest._histograms
    monkeypatch.setattr(forest, "_histograms", lambda x, at, w, wy, slots, rows=None: counted.append(len(slots) * len(at)) or histograms(x, at, w, wy, slots, rows))

    def grown(derive, piece):
        monkeypatch.setattr(forest, "DERIVE_ROWS", derive)
        monkeypatch.setattr(forest, "PIECE_ROWS", piece)
        counted.clear()
        made = forest.grow(x, y, w, 1, 1, settings)
        return [v[made[1].argsort()] for v in made], sum(counted)

    (whole, cells), (pieces, fewer) = grown(10**9, 10**9), grown(60, 300)
    # Only columns a node may be split by are counted; of two children with all columns, the smaller one.
    assert cells <= 8 * chosen * 5000 and (fewer < 0.75 * cells if chosen == 6 else fewer == cells)
    assert all(np.array_equal(a, b) for a, b in zip(whole[:4], pieces[:4], strict=True))
    assert all(np.allclose(a, b, rtol=1e-6) for a, b in zip(whole[4:], pieces[4:], strict=True))


def test_packed_bins_come_back():
    x = np.random.default_rng(1).integers(0, forest.BINS, (7, 50)).astype(np.uint8)
    words = forest._packed(x)
    assert words.shape == (3, 50) and np.array_equal(forest._unpacked(words, 7), x)
