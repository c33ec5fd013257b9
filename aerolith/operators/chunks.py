"""Exact ordered-series work without one task per series.

A series (one value of the keys) may hold a large share of all rows, so no window here is
partitioned by the series alone. Rows are put in *chunks*: one series, one fixed span of time.
A chunk holds at most ``chunk_hours`` rows of an hourly series, however long the series is.
What a chunk must know of its neighbours comes in one of two ways:

* halo rows, for row frames of fixed reach (lag, lead, rolling): at least the last ``before``
  rows ahead of a chunk and the first ``after`` rows behind it are copied into it and dropped
  afterwards;
* chunk summaries, for unbounded look-around (nearest known value, row position): one small row
  per chunk, scanned in chunk order and joined back on (series, chunk).

Both give the same result as a window over the whole series. Series order must be total: (keys,
ts) unique, as :func:`aerolith.operators.clean.drop_duplicate_times` makes it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerolith.session import discard, stage

CHUNK = "_chunk"
HALO = "_halo"


@dataclass(frozen=True)
class SeriesSpec:
    """Which columns make a series and how it is cut."""

    keys: Sequence[str] = field(default=("city",))
    ts: str = "datetime"
    chunk_hours: int = 8760

    def chunk_id(self) -> Column:
        return F.floor(F.unix_seconds(F.col(self.ts)) / (self.chunk_hours * 3600)).cast("long")

    @property
    def chunk_keys(self) -> list[str]:
        return [*self.keys, CHUNK]

    def in_chunk(self, *, newest_first: bool = False) -> WindowSpec:
        order = F.col(self.ts).desc() if newest_first else F.col(self.ts).asc()
        return W.partitionBy(*self.chunk_keys).orderBy(order)

    def over_chunks(self, *, newest_first: bool = False) -> WindowSpec:
        """Order of the chunks of one series; only for one-row-per-chunk tables."""
        order = F.col(CHUNK).desc() if newest_first else F.col(CHUNK).asc()
        return W.partitionBy(*self.keys).orderBy(order)


def with_chunk(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Rows with their chunk. A row whose key or time is null belongs to no series and is left out."""
    for c in (*spec.keys, spec.ts):
        df = df.filter(F.col(c).isNotNull())
    return df.withColumn(CHUNK, spec.chunk_id())


def _edge_copies(rows: DataFrame, spec: SeriesSpec, reach: int, *, ahead: bool) -> DataFrame:
    """Edge rows of each chunk, re-labelled with every chunk whose frames reach them.

    ``ahead=True`` takes the newest ``reach`` rows of a chunk for the chunks after it. The rank
    filter lets Spark drop all other rows before the shuffle. Where chunks hold fewer rows than
    the reach, a row goes on to all the later chunks it is still in reach of.
    """
    edge = rows.withColumn("_r", F.row_number().over(spec.in_chunk(newest_first=ahead)))
    edge = edge.filter(F.col("_r") <= reach)

    order = spec.over_chunks(newest_first=not ahead)
    sizes = (
        edge.groupBy(*spec.chunk_keys)
        .agg(F.count("*").alias("_m"))
        .withColumn("_end", F.sum("_m").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_begin", F.col("_end") - F.col("_m"))
        .withColumn("_later", F.collect_list(F.struct(F.col(CHUNK).alias("id"), "_begin")).over(order.rowsBetween(1, reach)))
        .select(
            *spec.chunk_keys,
            F.transform("_later", lambda c: F.struct(c["id"].alias("id"), (c["_begin"] - F.col("_end")).alias("skip"))).alias("_later"),
        )
        .withColumn("_later", F.filter("_later", lambda c: c["skip"] < reach))
        .filter(F.size("_later") > 0)
    )
    return (
        edge.join(sizes, spec.chunk_keys)
        .withColumn("_to", F.explode(F.filter("_later", lambda c: c["skip"] + F.col("_r") <= reach)))
        .withColumn(CHUNK, F.col("_to.id"))
        .drop("_r", "_later", "_to")
        .withColumn(HALO, F.lit(True))
    )


def _margin(reach: int) -> int:
    """Hours next to a chunk border whose rows are copied across for frames of ``reach`` rows."""
    return max(2 * reach, reach + 24) if reach else 0


def _sparse_series(rows: DataFrame, spec: SeriesSpec, before: int, after: int) -> DataFrame:
    """Keys of series that have a chunk with too few rows in the margins around it.

    One count per chunk, combined before the shuffle.
    """
    width, into = spec.chunk_hours * 3600, F.unix_seconds(F.col(spec.ts)) - F.col(CHUNK) * spec.chunk_hours * 3600
    counts = rows.groupBy(*spec.chunk_keys).agg(
        F.count("*").alias("_n"),
        F.count_if(into >= width - _margin(before) * 3600).alias("_tail"),
        F.count_if(into < _margin(after) * 3600).alias("_head"),
    )

    def lacking(order: WindowSpec, step: int, edge: str, reach: int) -> Column:
        beyond = F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        next_to = F.lag(CHUNK).over(order) == F.col(CHUNK) - step
        have = F.coalesce(F.when(next_to, F.lag(edge).over(order)), F.lit(0))
        return have < F.least(F.lit(reach), beyond)

    tests = counts.withColumn("_short", lacking(spec.over_chunks(), 1, "_tail", before))
    if after:
        tests = tests.withColumn("_short", F.col("_short") | lacking(spec.over_chunks(newest_first=True), -1, "_head", after))
    return tests.filter("_short").select(*spec.keys).distinct()


def with_halo(
    df: DataFrame,
    spec: SeriesSpec,
    columns: Sequence[str],
    *,
    before: int = 0,
    after: int = 0,
) -> DataFrame:
    """Rows of ``df`` with their chunk, plus halo rows, partitioned by (keys, chunk).

    Rows within a margin of hours of a border are copied over it by a plain explode: one scan, one
    shuffle. Where a series has gaps the margin may hold fewer rows than the reach. One cheap job
    finds such series, and only their missing rows (``columns``, from further away) are looked up
    by rank and added, so frames are complete for every series.
    """
    spec = replace(spec, chunk_hours=max(spec.chunk_hours, _margin(before), _margin(after)))
    rows = with_chunk(df, spec)
    second, width = F.unix_seconds(F.col(spec.ts)), spec.chunk_hours * 3600

    def place(chunk: Column, halo: bool) -> Column:
        return F.struct(chunk.alias(CHUNK), F.lit(halo).alias(HALO))

    places = [place(F.col(CHUNK), False)]
    if before:
        places.append(F.when(second >= (F.col(CHUNK) + 1) * width - _margin(before) * 3600, place(F.col(CHUNK) + 1, True)))
    if after:
        places.append(F.when(second < F.col(CHUNK) * width + _margin(after) * 3600, place(F.col(CHUNK) - 1, True)))
    spread = rows.select(*df.columns, F.inline(F.array_compact(F.array(*places))))

    # Staged: counted once, and of known size where it is joined.
    sparse = stage(_sparse_series(rows.select(*spec.chunk_keys, spec.ts), spec, before, after))
    if sparse.isEmpty():
        discard(sparse)
    else:
        narrow = rows.select(*spec.chunk_keys, spec.ts, *[c for c in columns if c not in (*spec.keys, spec.ts)])
        narrow = narrow.join(sparse, list(spec.keys), "left_semi")
        if before:
            far = second < F.col(CHUNK) * width - _margin(before) * 3600
            spread = spread.unionByName(_edge_copies(narrow, spec, before, ahead=True).filter(far), allowMissingColumns=True)
        if after:
            far = second >= (F.col(CHUNK) + 1) * width + _margin(after) * 3600
            spread = spread.unionByName(_edge_copies(narrow, spec, after, ahead=False).filter(far), allowMissingColumns=True)
    return spread.repartition(*spec.chunk_keys)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(HALO, CHUNK)


def frame_columns(
    df: DataFrame,
    spec: SeriesSpec,
    inputs: Sequence[str],
    build,
    *,
    before: int = 0,
    after: int = 0,
) -> DataFrame:
    """Add ``build(window) -> {name: column}`` computed over fixed row frames."""
    rows = with_halo(df, spec, inputs, before=before, after=after)
    return drop_halo(rows.withColumns(build(spec.in_chunk())))


def chunk_counts(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """(keys, chunk, _n, _offset, _total): rows in, before and in all chunks of the series."""
    counts = with_chunk(df.select(*spec.keys, spec.ts), spec).groupBy(*spec.chunk_keys).agg(F.count("*").alias("_n"))
    upto = spec.over_chunks().rowsBetween(W.unboundedPreceding, 0)
    return counts.withColumn("_offset", F.sum("_n").over(upto) - F.col("_n")).withColumn(
        "_total", F.sum("_n").over(W.partitionBy(*spec.keys))
    )


def with_position(df: DataFrame, spec: SeriesSpec, name: str = "position", total: str | None = None) -> DataFrame:
    """1-based row position in the series, and optionally the series length."""
    rows = with_chunk(df, spec).withColumn("_local", F.row_number().over(spec.in_chunk()))
    placed = rows.join(chunk_counts(df, spec), spec.chunk_keys)
    placed = placed.withColumn(name, F.col("_offset") + F.col("_local"))
    if total:
        placed = placed.withColumn(total, F.col("_total"))
    return placed.drop("_local", "_n", "_offset", "_total", CHUNK)


def times_at_positions(df: DataFrame, spec: SeriesSpec, positions: dict) -> DataFrame:
    """(keys, name...): times of the rows at ``{name: position(total)}`` (1-based) of each series.

    Only the chunks that hold such a position are ordered. A position outside the series gives
    null; a series without any is left out.
    """
    spots = F.array(*[F.struct(F.lit(n).alias("name"), p(F.col("_total")).cast("long").alias("at")) for n, p in positions.items()])
    wanted = (
        chunk_counts(df, spec)
        .select(*spec.chunk_keys, "_offset", "_n", F.inline(spots))
        .filter((F.col("at") > F.col("_offset")) & (F.col("at") <= F.col("_offset") + F.col("_n")))
        .select(*spec.chunk_keys, "name", (F.col("at") - F.col("_offset")).alias("_local"))
    )
    rows = with_chunk(df.select(*spec.keys, spec.ts), spec).join(wanted.select(*spec.chunk_keys).distinct(), spec.chunk_keys, "left_semi")
    rows = rows.withColumn("_local", F.row_number().over(spec.in_chunk()))
    found = rows.join(wanted, [*spec.chunk_keys, "_local"])
    return found.groupBy(*spec.keys).agg(*[F.max(F.when(F.col("name") == n, F.col(spec.ts))).alias(n) for n in positions])


def latest_rows(df: DataFrame, spec: SeriesSpec, n: int = 1) -> DataFrame:
    """The newest ``n`` rows of each series.

    Ranked inside chunks first, so the second ranking sees at most ``n`` rows per chunk.
    """
    rows = with_chunk(df, spec)
    rows = rows.withColumn("_r", F.row_number().over(spec.in_chunk(newest_first=True))).filter(F.col("_r") <= n)
    newest = W.partitionBy(*spec.keys).orderBy(F.col(spec.ts).desc())
    return rows.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n).drop("_r", CHUNK)
