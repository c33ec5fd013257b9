"""Clusters and whitening of integer vectors against plain loops."""

import hashlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.llm import vp_clusters, whitening

ODD = [(900, None), (901, [0.1] * 3), (902, [float("nan")] + [0.1] * 3), (903, [float("inf")] + [0.1] * 3), (904, [None] + [0.1] * 3), (905, [])]


def plain_clusters(rows, clusters, rounds, salt="2"):
    """The definition with Python integers, one vector and one centroid at a time."""
    keyed = sorted((hashlib.sha256(f"{salt}:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in rows)
    centroids = [list(x) for _, x in keyed[:clusters]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, x in rows:
            members.setdefault(nearest(x)[1], []).append(x)
        for k, xs in members.items():
            centroids[k] = [sum(column) // len(xs) for column in zip(*xs, strict=True)]
    return [(i, *reversed(nearest(x))) for i, x in rows], centroids


def key(r):
    return tuple((v is not None, v) for v in r)


def check_clusters(spark, rows, clusters, rounds, dims, scale=256):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash")).withColumn("x", F.lit(1)).repartition(3)
    got = vp_clusters.cluster(df, clusters, rounds, dims, scale).collect()
    good = [(i, [int(np.floor(float(scale) * c)) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    want, centroids = plain_clusters(good, clusters, rounds)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(((i, k, d if d < 2**63 else None) for i, k, d in want), key=key)
    sums = {}
    for _, k, d in want:
        sums[k] = sums.get(k, 0) + d
    for r in got:
        assert r.cluster_inertia == (sums[r.cluster] if sums[r.cluster] < 2**63 else None)
        assert r.inertia == (sum(sums.values()) if max(sums.values()) < 2**63 else None)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_clusters_against_plain_loops(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=4)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 4) for i in range(200)] + [(7, [0.25] * 4)] * 3 + [(None, [0.125] * 4)] * 2 + ODD
    check_clusters(spark, rows, 40, 5, 4)


def test_clusters_with_ties_and_few_vectors(spark):
    grid = [(10 * a + b, [float(a), float(b)]) for a in range(6) for b in range(6)] * 2
    check_clusters(spark, grid, 9, 4, 2, scale=1)
    check_clusters(spark, grid[:3], 9, 2, 2, scale=1)
    check_clusters(spark, [(1, [1.0, 1.0])] * 5 + [(2, [1.0, 1.0])], 4, 3, 2)


def test_clusters_of_very_large_components(spark):
    rows = [(i, [float(i), 2.0]) for i in range(20)] + [(100, [1e9, -1e9]), (101, [1e15, 3.0]), (102, [-1e15, 3.0])]
    check_clusters(spark, rows, 6, 3, 2)


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<float>")
    got = vp_clusters.cluster(df, 4, 2, 4)
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(ValueError, match="bounded"):
        vp_clusters.cluster(df, 1 << 20, 2, 64)


@pytest.mark.parametrize("k", [1, 2, 5, 300])
def test_tree_search_is_exact(k):
    rng = np.random.default_rng(k)
    centroids = rng.integers(-9, 9, (k, 3))
    x = rng.integers(-12, 12, (2000, 3))
    best, found = vp_clusters.VantageTree(centroids).nearest(x)
    full = ((x[:, None] - centroids) ** 2).sum(axis=2)
    assert (best == full.argmin(axis=1)).all() and (found == full.min(axis=1)).all()


def test_tree_search_prunes():
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(512, 2)) * 1000
    tree = vp_clusters.VantageTree(np.floor(centers).astype(np.int64))
    seen, plain = [], vp_clusters.squared
    try:
        vp_clusters.squared = lambda x, c, wide=False: seen.append(len(x) * len(c)) or plain(x, c, wide)
        tree.nearest(np.floor(rng.normal(size=(500, 2)) * 1000).astype(np.int64))
    finally:
        vp_clusters.squared = plain
    assert sum(seen) < 0.2 * 500 * 512


def check_whitened(spark, rows, dims, components=4, scale=256, want_k=None, near=1e-9):
    """Against exact integers and a dense eigendecomposition."""
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("component", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    got = whitening.whiten(df, components, scale).collect()
    good = [(i, [int(np.floor(float(scale) * c)) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    away = np.array(fit, dtype=float) - mean
    cov = away.T @ away / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = want_k if want_k is not None else min(components, dims)
    assert len(got) == k * len(good)
    by = {}
    for r in got:
        assert r.n == n
        assert abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < near and 0 <= r.identity_error < near
        by.setdefault((r.vec_id, r.component), []).append(r)
    deviation = {}
    for i, x in good:
        d = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        deviation.setdefault(i, []).append(d if d < 2**63 else None)
    for (i, _), rs in by.items():
        assert sorted((r.deviation is not None, r.deviation) for r in rs) == sorted((d is not None, d) for d in deviation[i])
    for c in range(1, k + 1):
        gap = min([abs(e[c - 1] - x) for j, x in enumerate(e) if j != c - 1], default=1) / e[0]
        if gap < 1e-6:
            continue
        pairs = [(by[i, c][0].whitened, float((np.array(x) - mean) @ u[:, c - 1] / np.sqrt(e[c - 1]))) for i, x in good if len(by[i, c]) == 1]
        a, b = np.array(pairs).T
        assert np.abs(a * np.sign(a @ b) - b).max() < near / gap
    return got


def test_whitening_against_a_dense_solver(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(400, 24)) * np.linspace(1, 2, 24))]
    rows += [(500 + i, rows[3][1]) for i in range(300)] + [(7, rows[9][1])] * 2 + [(None, [0.5] * 24)] + ODD + [(910, [1.0] * 25)] * 9
    check_whitened(spark, rows, 24)


def test_whitening_of_few_and_flat_vectors(spark):
    rng = np.random.default_rng(6)
    check_whitened(spark, [(i, [float(c) for c in rng.normal(size=3)]) for i in range(40)], 3)
    check_whitened(spark, [(i, [float(c), 2.0, float(c * c)]) for i, c in enumerate(range(12))], 3, want_k=2)
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 5, "vec_id long, embedding array<double>")).count() == 0
    empty = whitening.whiten(spark.createDataFrame(ODD[:1], "vec_id long, embedding array<float>"))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_of_very_large_entries(spark):
    rows = [(i, [float(i * i % 17), float(i)]) for i in range(30)] + [(99, [1e5, -4e5])]
    got = check_whitened(spark, rows, 2, want_k=2, near=1e-6)
    assert any(r.deviation is None for r in got)


@pytest.mark.parametrize("values", [[9, 9, 9, 9, 1], np.linspace(1, 2, 200), [100, 1e-3, 1e-6], np.r_[50, 49.99, 49.98, np.ones(97)], np.r_[7, np.zeros(30)], [0, 0], [3]])
def test_leading_pairs_reach_double_precision(values):
    values = np.array(values, dtype=float)
    q = np.linalg.qr(np.random.default_rng(len(values)).normal(size=(len(values), len(values))))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    e, u = whitening.leading_pairs(lambda b: a @ b, len(values), 4)
    want = np.sort(values[values > 0])[::-1][:4]
    assert len(e) == len(want)
    if len(want):
        assert np.allclose(e, want, rtol=1e-9, atol=1e-13 * want[0])
        assert np.linalg.norm(a @ u - u * e, axis=0).max() <= whitening.ROUNDINGS * np.finfo(float).eps * want[0] * 1.5
        assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-13


def test_minres_solves_indefinite_systems_side_by_side():
    rng = np.random.default_rng(8)
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    a = (q * np.r_[-np.linspace(1, 3, 15), np.linspace(0.5, 4, 15)]) @ q.T
    shifts = np.array([0.0, 0.1, -0.2])
    right = rng.normal(size=(30, 3))
    x = whitening.minres(lambda b: a @ b - b * shifts, right, 60, 1e-12)
    assert np.abs(a @ x - x * shifts - right).max() < 1e-9
    assert (whitening.minres(lambda b: a @ b, np.zeros((30, 2)), 5, 1e-3) == 0).all()
