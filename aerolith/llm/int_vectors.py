"""Vectors of scaled integers: checking and scaling rows, exact sums over tasks."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Magnitude up to which a batch's sums stay in 64 bits.
_SMALL = 1 << 40
LONG_MAX = (1 << 63) - 1


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null and holds no null and no non-finite component."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    return vectors.filter(F.col(vector).isNotNull() & F.forall(vector, finite))


def scaled(vectors: DataFrame, id: str, vector: str, scale: int, dims: int) -> DataFrame:
    """``id`` and x: floor(scale * component) as longs, of the usable vectors with ``dims`` components.

    A component beyond what a long holds becomes the largest or smallest long.
    """
    fit = usable(vectors.select(F.col(id).alias("id"), F.col(vector).alias("v")), "v").filter(F.size("v") == dims)
    return fit.select(F.col("id").alias(id), F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")).alias("x"))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of a column of lists that all have ``dims`` entries."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def column_sums(x: np.ndarray) -> np.ndarray:
    """Exact sums of the columns, as Python integers."""
    if not len(x):
        return np.zeros(x.shape[1], dtype=object)
    if max(abs(int(x.min())), abs(int(x.max()))) < _SMALL and len(x) < 1 << 22:
        return x.sum(axis=0).astype(object)
    return x.astype(object).sum(axis=0)


def fits_long(value: int) -> int | None:
    """The value, or null where a long cannot hold it."""
    return int(value) if -LONG_MAX - 1 <= value <= LONG_MAX else None


def task_sums(groups: dict[int, tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """A task's rows (grp, pos, total, n) of what it added up by group."""
    for group, (count, sums) in groups.items():
        d = len(sums)
        yield pa.RecordBatch.from_pydict(
            {"grp": pa.array([group] * d, pa.int32()), "pos": pa.array(range(d), pa.int32()), "total": pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0)), "n": pa.array([count] * d, pa.int64())}
        )


SUMS = "grp int, pos int, total decimal(38,0), n long"


def merged_sums(parts: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """group -> (rows, exact sum of each component) from the rows of ``task_sums``.

    Rows are added up on the executors, already added up by task; groups x components reach the driver.
    """
    rows = parts.groupBy("grp", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows, key=lambda r: (r.grp, r.pos)):
        out.setdefault(r.grp, (r.n, []))[1].append(int(r.total))
    return out
