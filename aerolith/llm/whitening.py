"""Embedding whitening: leading principal components by block Jacobi-Davidson, without a covariance matrix.

The covariance is only ever applied: one Spark job multiplies it with a block of directions, centring every
vector before it is multiplied; a task sends dims x block numbers. The driver holds a few columns of dims
numbers. Each outer round takes Ritz pairs of a small subspace, locks those whose residual has reached
double precision and solves the projected correction equation of the others by MINRES, all of them side
by side, so an inner step is one job.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.int_vectors import SUMS, column_sums, fits_long, matrix, merged_sums, scaled, task_sums, usable
from aerolith.session import discard, stage

#: A residual of this many roundings of the largest eigenvalue counts as double precision.
ROUNDINGS = 64
#: Eigenvalues below this many roundings of the largest one count as zero; such components are not returned.
_ZERO = 1e4
#: Inner steps and the reduction of the residual after which a correction is good enough.
INNER_STEPS = 8
INNER_GAIN = 1e-3
#: Pairs corrected besides the wanted ones. Wanted pairs converge faster with their neighbours at hand, and a
#: job costs much the same for a wider block.
GUARD = 12
#: Columns of the subspace, in blocks, at which it is cut back to the best ones.
_MOST_BLOCKS = 6
_MOST_ROUNDS = 100

Product = Callable[[np.ndarray], np.ndarray]


def _orthonormal(new: np.ndarray, against: np.ndarray) -> np.ndarray:
    """The columns ``new`` made orthonormal to each other and to ``against``; those that vanish are left out."""
    kept: list[np.ndarray] = []
    for column in new.T:
        norm = np.linalg.norm(column)
        if not norm > 0 or not np.isfinite(norm):
            continue
        v = column / norm
        for _ in range(3):
            held = np.column_stack([against, *kept])
            v = v - held @ (held.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-8:
                break
            v = v / left
        else:
            kept.append(v)
    return np.column_stack(kept) if kept else new[:, :0]


def minres(apply: Product, right: np.ndarray, steps: int, gain: float) -> np.ndarray:
    """Minimal residual solutions of symmetric systems, a column each, all columns in step.

    ``apply`` maps a block, its columns each by their own operator. A column stops when its residual has
    shrunk by ``gain``.
    """
    x = np.zeros_like(right)
    v_old, v = np.zeros_like(right), right.copy()
    beta = np.linalg.norm(v, axis=0)
    live = beta > 0
    v[:, live] /= beta[live]
    first, eta = beta.copy(), beta.copy()
    w_old, w = np.zeros_like(right), np.zeros_like(right)
    c_old, c, s_old, s = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    beta = np.zeros_like(beta)  # the first vector has none before it
    for _ in range(steps):
        if not live.any():
            break
        p = apply(np.where(live, v, 0.0))
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * v_old
        after = np.linalg.norm(p, axis=0)
        r1 = c * alpha - c_old * s * beta
        r = np.hypot(r1, after)
        ok = live & (r > 0)
        safe = np.where(r > 0, r, 1.0)
        w_new = (v - (s_old * beta) * w_old - (s * alpha + c_old * c * beta) * w) / safe
        c_old, c, s_old, s = c, np.where(ok, r1 / safe, c), s, np.where(ok, after / safe, s)
        x = x + np.where(ok, c * eta, 0.0) * w_new
        eta = np.where(ok, -s * eta, eta)
        live = ok & (np.abs(eta) > gain * first) & (after > 0)
        v_old, v = v, p / np.where(after > 0, after, 1.0)
        w_old, w, beta = w, w_new, after
    return x


def leading_pairs(product: Product, dims: int, count: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``count`` largest eigenvalues (falling) and unit eigenvectors of a positive semidefinite operator.

    Pairs are locked from the largest one on, each when its residual is ``ROUNDINGS`` roundings of the
    largest eigenvalue or less. Afterwards what is left of the subspace must hold nothing larger.
    Eigenvalues that are zero to rounding are left out.
    """
    count = min(count, dims)
    block = min(count + GUARD, dims)
    rng = np.random.default_rng(seed)
    basis = _orthonormal(rng.normal(size=(dims, block)), np.zeros((dims, 0)))
    image = product(basis)
    locked, values, top = np.zeros((dims, 0)), np.zeros(0), 0.0
    for _ in range(_MOST_ROUNDS):
        theta, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        top = max(top, float(theta[0]) if len(theta) else 0.0, *values, 0.0)
        tolerance = ROUNDINGS * np.finfo(float).eps * top
        if len(values) and len(theta) and theta[0] > values.min() + tolerance:  # a larger one turned up late
            basis, image = np.column_stack([locked, basis]), np.column_stack([product(locked), image])
            locked, values = locked[:, :0], values[:0]
            continue
        residual = image - basis * theta
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        need = count - len(values)
        done = 0
        while done < min(need, len(theta)) and size[done] <= tolerance:
            done += 1
        if done:
            locked, values = np.column_stack([locked, basis[:, :done]]), np.append(values, theta[:done])
            basis, image, theta, residual = basis[:, done:], image[:, done:], theta[done:], residual[:, done:]
            need -= done
        if not need or top == 0.0 or (not len(theta) and locked.shape[1] == dims):
            if need or not len(theta) or theta[0] <= values.min() + tolerance:
                break
            continue
        wanted = min(block, len(theta))
        if basis.shape[1] > _MOST_BLOCKS * block:
            basis, image = basis[:, : 2 * block], image[:, : 2 * block]
        if wanted:
            ritz = np.column_stack([locked, basis[:, :wanted]])
            inside = lambda b: b - ritz @ (ritz.T @ b)
            shift = theta[:wanted]
            corrected = lambda b, inside=inside, shift=shift: inside(product(inside(b)) - inside(b) * shift)
            correction = minres(corrected, -inside(residual[:, :wanted]), INNER_STEPS, INNER_GAIN)
        else:
            correction = rng.normal(size=(dims, need))
        new = _orthonormal(correction, np.column_stack([locked, basis]))
        if not new.shape[1]:
            new = _orthonormal(rng.normal(size=(dims, need)), np.column_stack([locked, basis]))
        if not new.shape[1]:  # the subspace is the whole space: what is left of the residual is rounding
            image = product(basis)
            theta, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
            values = np.append(values, theta[::-1][:need])
            locked = np.column_stack([locked, (basis @ turn)[:, ::-1][:, :need]])
            break
        basis, image = np.column_stack([basis, new]), np.column_stack([image, product(new)])
    else:
        raise RuntimeError(f"no double precision after {_MOST_ROUNDS} rounds")
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > _ZERO * np.finfo(float).eps * top]
    return values[order], locked[:, order]


def _added(df: DataFrame, run: Callable, size: int) -> np.ndarray:
    """Sum over tasks of the ``size`` numbers that ``run`` makes of a task's batches; added up on the executors."""

    def task(batches):
        yield pa.RecordBatch.from_pydict({"pos": pa.array(range(size), pa.int32()), "part": run(batches)})

    parts = df.mapInArrow(task, "pos int, part double").repartition(8, "pos").groupBy("pos").agg(F.sum("part").alias("part"))
    out = np.zeros(size)
    for r in parts.collect():
        out[r.pos] = r.part
    return out


def covariance_product(fit: DataFrame, mean: np.ndarray, n: int) -> Product:
    """Multiplies the covariance of the vectors x of ``fit`` with a block: one job."""
    dims = len(mean)

    def product(block: np.ndarray) -> np.ndarray:
        if not block.shape[1]:
            return block.copy()

        def run(batches):
            total = np.zeros(block.shape)
            for batch in batches:
                x = matrix(batch.column(0), dims) - mean
                total += x.T @ (x @ block)
            return total.ravel()

        return _added(fit, run, block.size).reshape(block.shape) / n

    return product


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sum over dimensions of (n * x - S) ** 2 for every row."""
    if not len(x):
        return []
    top = max(abs(int(x.min())), abs(int(x.max()))) * n + max(map(abs, sums))
    exact = x if top * top * x.shape[1] < 1 << 63 else x.astype(object)
    away = exact * n - np.array(sums, dtype=exact.dtype)
    return (away * away).sum(axis=1).tolist()


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id``, component, n, deviation, whitened, explained and identity_error: a row for each vector and component.

    Vectors that are null or hold null or non-finite entries are left out; each other entry c becomes
    x = floor(scale * c). Mean and covariance (divisor n) are over the distinct x vectors. Components are
    numbered from 1 by falling eigenvalue e, their sign is free but one for all rows. deviation is the
    exact sum over dimensions of (n * x - S) ** 2, null where a long cannot hold it; whitened is x less the
    mean, projected, over sqrt(e); explained is e over the trace; identity_error the largest entry of the
    covariance of whitened less the identity.

    All vectors must have one length: those of another than the commonest (of equally common: the longest)
    are left out. Repeated rows and null ids come out as they go in. Components whose eigenvalue is zero
    (fewer vectors than components, equal vectors) are left out, so a table of copies gives no rows, as
    does an empty one. Equal eigenvalues: any orthonormal basis. Other columns are not read.
    """
    spark = vectors.sparkSession
    lengths = usable(vectors.select(F.col(vector).alias("v")), "v").groupBy(F.size("v").alias("size")).count().filter("size > 0")
    common = lengths.orderBy(F.desc("count"), F.desc("size")).first()
    schema = f"{id} {vectors.schema[id].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if common is None:
        return spark.createDataFrame([], schema)
    dims = int(common["size"])
    rows = stage(scaled(vectors, id, vector, scale, dims))
    fit = stage(rows.select("x").distinct())

    def add(batches):
        n, sums = 0, np.zeros(dims, dtype=object)
        for batch in batches:
            n, sums = n + batch.num_rows, sums + column_sums(matrix(batch.column(0), dims))
        if n:
            yield from task_sums({0: (n, sums)})

    n, sums = merged_sums(fit.mapInArrow(add, SUMS))[0]
    mean = np.array([s / n for s in sums])
    product = covariance_product(fit, mean, n)
    values, axes = leading_pairs(product, dims, components)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    white = axes / np.sqrt(values)

    def spread(batches):
        total = np.zeros(1 + k + k * k)
        for batch in batches:
            x = matrix(batch.column(0), dims) - mean
            w = x @ white
            total += np.concatenate([[np.einsum("ij,ij->", x, x)], w.sum(axis=0), (w.T @ w).ravel()])
        return total

    found = _added(fit, spread, 1 + k + k * k) / n
    discard(fit)
    explained = values / found[0]
    middle = found[1 : 1 + k]
    error = float(np.abs(found[1 + k :].reshape(k, k) - np.outer(middle, middle) - np.eye(k)).max())

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), dims)
            m = len(x)
            deviation = pa.array([fits_long(d) for d in deviations(x, n, sums)], pa.int64())
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    deviation.take(pa.array(each)),
                    pa.array(((x - mean) @ white).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=[id, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
