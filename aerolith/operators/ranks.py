"""Exact ranks over whole columns without ordering a column in one task.

Equal values are counted first, so a value held by very many rows becomes one row. The distinct
values are dealt into ranges of about a million, by cuts that are drawn from the distinct values
themselves; a range is ordered on its own, and the sums of the ranges before it are added. The
number of ranges follows the number of distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerolith.session import stage

BIN_VALUES = 1_000_000

_DEALT = "i int, k int, x binary, y_bin binary, n binary, sums binary"
_DEALT_NAMES = ["i", "k", "x", "y_bin", "n", "sums"]


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str | Column] = (), name: str = "feature", value: str = "x") -> DataFrame:
    """Long form: one row per (row, column)."""
    entries = ", ".join(f"named_struct('{name}', '{c}', '{value}', CAST(`{c}` AS DOUBLE))" for c in columns)
    return df.select(*keep, F.expr(f"inline(array({entries}))"))


def _value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, x, n): copies of each non-null value."""
    return unpivot(df, columns).filter(F.col("x").isNotNull()).groupBy("feature", "x").agg(F.count("*").alias("n"))


def _bins(df: DataFrame, columns: Sequence[str], bin_values: int) -> int:
    about = df.agg(*[F.approx_count_distinct(F.col(c).cast("double"), 0.05).alias(c) for c in columns]).first()
    return max(1, -(-sum(about) // bin_values))


def _ranged(df: DataFrame, columns: Sequence[str], bins: int) -> tuple[DataFrame, DataFrame]:
    """Value counts with their range (``_bin``), and one row per (feature, range) with the rows before it.

    The ranges are cut once and written, so that both results mean the same ones.
    """
    counts = _value_counts(df, columns).repartitionByRange(bins, "feature", "x")
    ranged = stage(counts.withColumn("_bin", F.spark_partition_id()))
    upto = W.partitionBy("feature").orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    sums = (
        ranged.groupBy("feature", "_bin")
        .agg(F.sum("n").alias("_in_bin"))
        .withColumn("_before", F.sum("_in_bin").over(upto) - F.col("_in_bin"))
        .withColumn("total", F.sum("_in_bin").over(W.partitionBy("feature")))
    )
    return ranged, sums


def _placed(ranged: DataFrame, sums: DataFrame) -> DataFrame:
    inside = W.partitionBy("feature", "_bin").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    upto = ranged.withColumn("_upto", F.sum("n").over(inside))
    below = (F.col("_before") + F.col("_upto") - F.col("n")).alias("below")
    return upto.join(sums.select("feature", "_bin", "_before", "total"), ["feature", "_bin"]).select("feature", "x", "n", below, "total")


def value_ranks(df: DataFrame, columns: Sequence[str], bin_values: int = BIN_VALUES) -> DataFrame:
    """(feature, x, n, below, total): copies of each value, rows below it, non-null rows in all."""
    columns = list(dict.fromkeys(columns))
    bins = _bins(df, columns, bin_values)
    if bins > 1:
        return _placed(*_ranged(df, columns, bins))
    ordered = W.partitionBy("feature").orderBy("x")
    below = F.sum("n").over(ordered.rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    total = F.sum("n").over(ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return _value_counts(df, columns).select("feature", "x", "n", below.alias("below"), total.alias("total"))


def average_rank() -> Column:
    """1-based rank of a value; equal values share the mean of their places."""
    return F.col("below") + (F.col("n") + 1) / 2


def quantile_bin(bins: int) -> Column:
    """0-based equal-frequency bin; equal values fall into the same one."""
    return F.floor(F.col("below") * bins / F.col("total")).cast("int")


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], bin_values: int = BIN_VALUES) -> DataFrame:
    """(feature, share, quantile) with linear interpolation between the two nearest values.

    Only ranges that hold one of the places are ordered: two per column and share at most.
    """
    columns = list(dict.fromkeys(columns))
    place = F.col("share") * (F.col("total") - 1)
    low, high = F.floor(place), F.ceil(place)

    def holds(i: Column, before: str = "below", size: str = "n") -> Column:
        return (F.col(before) <= i) & (i < F.col(before) + F.col(size))

    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    bins = _bins(df, columns, bin_values)
    if bins > 1:
        ranged, sums = _ranged(df, columns, bins)
        holding = sums.withColumn("share", wanted).filter(holds(low, "_before", "_in_bin") | holds(high, "_before", "_in_bin"))
        needed = holding.select("feature", "_bin", "_before", "total").distinct()
        values = _placed(ranged.join(needed.select("feature", "_bin"), ["feature", "_bin"], "left_semi"), needed)
    else:
        values = value_ranks(df, columns, bin_values)
    # Filtered before the group: two values per column and share are left.
    spots = values.withColumn("share", wanted).filter(holds(low) | holds(high))
    at_low, at_high = F.max(F.when(holds(low), F.col("x"))), F.max(F.when(holds(high), F.col("x")))
    return spots.groupBy("feature", "share").agg((at_low + (at_high - at_low) * F.max(place - low)).alias("quantile"))


def with_ranks(df: DataFrame, columns: Sequence[str], suffix: str = "_rank", bin_values: int = BIN_VALUES) -> DataFrame:
    """Add the average rank of each column; rows without the value get null.

    One lookup per column by value. The lookup side has one row per distinct value, so a value
    held by many rows is split over tasks by the adaptive skew join.
    """
    ranks = value_ranks(df, columns, bin_values).select("feature", "x", average_rank().alias("_rank"))
    for c in columns:
        places = ranks.filter(F.col("feature") == c).select(F.col("x").alias("_x"), F.col("_rank").alias(f"{c}{suffix}"))
        df = df.join(places, df[c].cast("double") == places["_x"], "left").drop("_x")
    return df


def _range_cuts(rows: DataFrame, columns: int, ranges: int) -> list[np.ndarray]:
    """Upper ends of all ranges of a column (of the array ``_x``) but the last; they hold about equally many rows."""
    if ranges == 1:
        return [np.empty(0)] * columns
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    found = rows.agg(*[F.percentile_approx(F.col("_x")[i], shares, F.lit(max(1000, 20 * ranges))) for i in range(columns)]).first()
    return [np.unique(np.array(cut, dtype=float)) for cut in found]


def _values(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    """columns x rows, from the array ``_x`` that is the first column."""
    return np.ascontiguousarray(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, columns).T)


def _rows_before(rows: DataFrame, cuts: list[np.ndarray]) -> list[np.ndarray]:
    """Of each column: the rows in the ranges before each range."""

    def count(batches):
        sums = [np.zeros(len(cut) + 1, dtype=np.int64) for cut in cuts]
        for batch in batches:
            for mine, cut, x in zip(sums, cuts, _values(batch, len(cuts)), strict=True):
                mine += np.bincount(np.searchsorted(cut, x), minlength=len(cut) + 1)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(sums).tolist()], pa.list_(pa.int64()))], names=["n"])

    if not any(map(len, cuts)):
        return [np.zeros(1, dtype=np.int64) for _ in cuts]
    per_range = rows.select("_x").mapInArrow(count, "n array<long>").select(F.posexplode("n").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n"))
    counts = np.array([r.n for r in sorted(per_range.collect(), key=lambda r: r.i)], dtype=np.int64)
    each = np.split(counts, np.cumsum([len(cut) + 1 for cut in cuts])[:-1])
    return [n.cumsum() - n for n in each]


def rank_cells(df: DataFrame, columns: Sequence[str], target: str, bins: int, bin_values: int = BIN_VALUES) -> DataFrame:
    """(feature, x_bin, y_bin, n, sxx, sxy, syy): rows without nulls by the equal-frequency bins of column and target, with the
    sums of squares and products of their average ranks (less the mean rank); ``syy`` is that of the target over all rows.

    The target is ranked first. Then the values of a column are dealt into ranges of about ``bin_values`` rows, equal
    (value, target bin) of a batch as one, and each range is ordered on its own: one shuffle of a few bytes a value.
    A column's cells come in parts, one for each range.
    """
    columns = list(dict.fromkeys(columns))
    spots = value_ranks(df, [target], bin_values)
    spots = spots.select(F.col("x").alias("_y"), (average_rank() - (F.col("total") + 1) / 2).alias("_rank"), quantile_bin(bins).alias("_bin"))
    plain = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"), F.col(target).cast("double").alias("_y"))
    rows = stage(plain.join(spots, "_y").drop("_y"))
    total, syy = rows.agg(F.count("*"), F.sum(F.col("_rank") * F.col("_rank"))).first()
    cuts = _range_cuts(rows, len(columns), max(1, -(-total // bin_values)))
    before = _rows_before(rows, cuts)

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rank, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            by_place = place.argsort(kind="stable")
            rank, place, out = rank[by_place], place[by_place], []
            for i, (cut, x) in enumerate(zip(cuts, _values(batch, len(cuts)), strict=True)):
                x = x[by_place]
                order = x.argsort(kind="stable")
                x, y_bin = x[order], place[order]
                first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y_bin[1:] != y_bin[:-1])))
                n, sums = np.diff(np.append(first, len(x))).astype(np.int32), np.add.reduceat(rank[order], first)
                x, y_bin = x[first], y_bin[first]
                edges = [0, *np.searchsorted(x, cut, side="right"), len(x)]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    if b > a:
                        out.append((i, k, *[v[a:b].tobytes() for v in (x, y_bin, n, sums)]))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=_DEALT_NAMES)

    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]

    def order_range(table: pa.Table) -> pa.Table:
        i, k = table.column("i")[0].as_py(), table.column("k")[0].as_py()
        x, y_bin, n, sums = (np.concatenate([np.frombuffer(v.as_py(), dtype=t) for v in table.column(c)]) for c, t in (("x", np.float64), ("y_bin", np.int32), ("n", np.int32), ("sums", np.float64)))
        order = x.argsort(kind="stable")
        x, y_bin, n, sums = x[order], y_bin[order], n[order].astype(np.int64), sums[order]
        first = np.append(True, x[1:] != x[:-1])
        copies = np.add.reduceat(n, np.flatnonzero(first))
        below = before[i][k] + copies.cumsum() - copies
        which = first.cumsum() - 1
        rank = (below + (copies + 1) / 2 - (total + 1) / 2)[which]
        cell = np.floor(below * bins / total).astype(np.int64)[which] * bins + y_bin
        parts = [np.bincount(cell, v, bins * bins) for v in (n, n * rank * rank, rank * sums)]
        held = np.flatnonzero(parts[0])
        return pa.table({"i": np.full(len(held), i, dtype=np.int32), "x_bin": (held // bins).astype(np.int32), "y_bin": (held % bins).astype(np.int32), "n": parts[0][held].astype(np.int64), "sxx": parts[1][held], "sxy": parts[2][held]})

    cells = rows.select("_x", "_rank", "_bin").mapInArrow(deal, _DEALT).groupBy("i", "k").applyInArrow(order_range, "i int, x_bin int, y_bin int, n long, sxx double, sxy double")
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1)
    return cells.select(name.alias("feature"), "x_bin", "y_bin", "n", "sxx", "sxy", F.lit(syy).cast("double").alias("syy"))
