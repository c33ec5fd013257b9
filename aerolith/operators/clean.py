"""Typing, de-duplication, gap report, interpolation and clipping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerolith.operators.chunks import CHUNK, HALO, SeriesSpec, frame_columns, with_halo
from aerolith.schema import MEASURES, OBSERVATION, PLAUSIBLE, require_columns
from aerolith.session import stage


def coerce_numeric(df: DataFrame, columns: Sequence[str] = tuple(MEASURES)) -> DataFrame:
    """Cast to double; text that is no number, and NaN, become null."""
    require_columns(df, columns)
    types = dict(df.dtypes)

    def as_double(name: str) -> Column:
        number = F.col(name).try_cast("double") if types[name] == "string" else F.col(name).cast("double")
        return F.when(~F.isnan(number), number)

    return df.withColumns({c: as_double(c) for c in columns})


def parse_times(df: DataFrame, ts: str = "datetime", zone: str = "UTC") -> DataFrame:
    """Timestamps in UTC; rows whose time cannot be read are dropped."""
    kind = dict(df.dtypes)[ts]
    parsed = F.try_to_timestamp(F.col(ts)) if kind == "string" else F.col(ts).cast("timestamp")
    if zone != "UTC":
        parsed = F.to_utc_timestamp(parsed, zone)
    return df.withColumn(ts, parsed).filter(F.col(ts).isNotNull())


def count_unparseable(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """Rows in, and rows :func:`parse_times` would drop."""
    parsed = F.try_to_timestamp(F.col(ts).cast("string"))
    return df.agg(F.count("*").alias("rows_in"), F.count_if(parsed.isNull()).alias("rows_dropped"))


def drop_duplicate_times(
    df: DataFrame, spec: SeriesSpec, tie_break: Sequence[Column | str] = (), keep: str = "first"
) -> DataFrame:
    """One row per (keys, ts): the first (or last) by the tie-break columns.

    The rank filter keeps one row per key and map task before the shuffle, so many copies of
    one key do not meet in one task. Remaining columns complete the order, so the choice does
    not depend on how the rows are laid out.
    """
    rest = [c for c in df.columns if c not in (*spec.keys, spec.ts)]
    order = [F.col(c) if isinstance(c, str) else c for c in tie_break] + [F.col(c) for c in rest]
    order = [c.desc() for c in order] if keep == "last" else [c.asc() for c in order]
    one = W.partitionBy(*spec.keys, spec.ts).orderBy(*(order or [F.col(spec.ts)]))
    return df.withColumn("_r", F.row_number().over(one)).filter(F.col("_r") == 1).drop("_r")


def duplicate_time_count(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Rows beyond the first of their (keys, ts), per series."""
    per_time = df.groupBy(*spec.keys, spec.ts).agg(F.count("*").alias("_n"))
    return per_time.groupBy(*spec.keys).agg(
        F.sum("_n").alias("row_count"), F.sum(F.col("_n") - 1).alias("duplicate_count")
    )


def time_gaps(df: DataFrame, spec: SeriesSpec, step_hours: int = 1) -> DataFrame:
    """Neighbouring rows further apart than one step: start, end and hours of each gap."""
    rows = frame_columns(
        df.select(*spec.keys, spec.ts),
        spec,
        [],
        lambda w: {"gap_start": F.lag(spec.ts).over(w)},
        before=1,
    )
    hours = (F.unix_micros(spec.ts) - F.unix_micros("gap_start")) / F.lit(3_600_000_000)
    rows = rows.withColumn("gap_hours", hours).filter(F.col("gap_hours") > step_hours)
    return rows.select(*spec.keys, "gap_start", F.col(spec.ts).alias("gap_end"), "gap_hours")


def gap_summary(df: DataFrame, spec: SeriesSpec, step_hours: int = 1) -> DataFrame:
    return time_gaps(df, spec, step_hours).groupBy(*spec.keys).agg(
        F.count("*").alias("gap_count"), F.max("gap_hours").alias("longest_gap_hours")
    )


def first_gaps(df: DataFrame, spec: SeriesSpec, n: int = 5, step_hours: int = 1) -> DataFrame:
    """The earliest ``n`` gaps (a report)."""
    return time_gaps(df, spec, step_hours).orderBy("gap_start", *spec.keys).limit(n)


def clip_ranges(df: DataFrame, bounds: Mapping[str, tuple[float, float]] = PLAUSIBLE) -> DataFrame:
    """Move values outside the bounds onto them; null stays null."""

    def clipped(name: str, low: float, high: float) -> Column:
        c = F.col(name)
        return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)

    return df.withColumns({c: clipped(c, *b) for c, b in bounds.items() if c in df.columns})


def clip_report(df: DataFrame, bounds: Mapping[str, tuple[float, float]] = PLAUSIBLE) -> DataFrame:
    """(column_name, below_count, above_count), from one pass."""
    used = {c: b for c, b in bounds.items() if c in df.columns}
    counts = df.agg(
        *[F.count_if(F.col(c) < low).alias(f"{c}_below") for c, (low, _) in used.items()],
        *[F.count_if(F.col(c) > high).alias(f"{c}_above") for c, (_, high) in used.items()],
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"{c}_below").alias("below_count"), F.col(f"{c}_above").alias("above_count"))
            for c in used
        ]
    )
    return counts.select(F.inline(rows))


def _over(spec: SeriesSpec, keys: Sequence[str], order: str, frame: str = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW") -> str:
    return f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY {order} {frame})"


def _neighbours(df: DataFrame, spec: SeriesSpec, columns: Sequence[str], limit: int) -> DataFrame:
    """Per column: nearest known value on both sides.

    A known value is (t, v, i, b): its time, the value, its place counted from the newest row, and
    the time ``limit`` rows before it. ``_p_c`` and ``_q_c`` are those within the chunk and its halo,
    ``_cp_c`` and ``_cq_c`` those beyond the chunk. Both sorts stay inside the chunk, and no frame is
    open to the end (such frames are re-scanned for every row).
    """
    ts = spec.ts
    newest, oldest = f"`{ts}` DESC", f"`{ts}` ASC"
    known = {c: f"CASE WHEN `{c}` IS NOT NULL THEN named_struct('t', `{ts}`, 'v', `{c}`, 'i', _i, 'b', _b) END" for c in columns}

    rows = with_halo(df, spec, columns, before=limit, after=limit)
    rows = rows.withColumns(
        {
            "_i": F.expr(f"row_number() {_over(spec, spec.chunk_keys, newest, '')}"),
            "_b": F.expr(f"lead(`{ts}`, {limit}) {_over(spec, spec.chunk_keys, newest, '')}"),
        }
    )
    own = rows.filter(~F.col(HALO))
    # What each chunk offers its neighbours, carried along the chunks of the series.
    ends = own.groupBy(*spec.chunk_keys).agg(
        *[F.expr(f"max({known[c]}) AS `_lp_{c}`") for c in columns], *[F.expr(f"min({known[c]}) AS `_fq_{c}`") for c in columns]
    )
    past = _over(spec, spec.keys, f"{CHUNK} ASC", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    future = _over(spec, spec.keys, f"{CHUNK} DESC", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    ends = ends.select(
        *spec.chunk_keys,
        *[F.expr(f"last(`_lp_{c}`, true) {past} AS `_cp_{c}`") for c in columns],
        *[F.expr(f"last(`_fq_{c}`, true) {future} AS `_cq_{c}`") for c in columns],
    )
    rows = rows.withColumns({f"_q_{c}": F.expr(f"last({known[c]}, true) {_over(spec, spec.chunk_keys, newest)}") for c in columns})
    rows = rows.withColumns({f"_p_{c}": F.expr(f"last({known[c]}, true) {_over(spec, spec.chunk_keys, oldest)}") for c in columns})
    # The left join adds no null filters, so both sides read the same shuffled rows.
    return rows.filter(~F.col(HALO)).join(ends, spec.chunk_keys, "left")


def interpolate_gaps(
    df: DataFrame, spec: SeriesSpec, columns: Sequence[str] = tuple(MEASURES), limit: int = 3
) -> DataFrame:
    """Fill nulls on the line through the nearest known values, by time.

    A missing row within ``limit`` rows of a known value takes the line at its own time. One
    further in takes the line at the first later row that is within ``limit`` rows of the next
    known value (so the middle of a long run is flat). With only one side known, that value is
    taken. An all-null column stays null.
    """
    rows = _neighbours(df, spec, columns, limit)

    def filled(c: str) -> Column:
        p, q = f"coalesce(`_p_{c}`, `_cp_{c}`)", f"coalesce(`_q_{c}`, `_cq_{c}`)"
        near = f"`_p_{c}`.i - _i <= {limit} OR _i - `_q_{c}`.i <= {limit}"
        at = f"CASE WHEN {near} THEN `{spec.ts}` ELSE {q}.b END"
        slope = f"({q}.v - {p}.v) / (unix_micros({q}.t) - unix_micros({p}.t))"
        line = f"{p}.v + {slope} * (unix_micros({at}) - unix_micros({p}.t))"
        return F.expr(
            f"CASE WHEN `{c}` IS NOT NULL THEN `{c}` WHEN {p} IS NOT NULL AND {q} IS NOT NULL THEN {line} "
            f"ELSE coalesce({q}.v, {p}.v) END AS `{c}`"
        )

    return rows.select(*[filled(c) if c in columns else F.col(c) for c in df.columns])


def fill_nearest(df: DataFrame, spec: SeriesSpec, columns: Sequence[str], how: str = "bfill_ffill") -> DataFrame:
    """Back-fill, forward-fill, or back-fill and then forward-fill."""
    rows = _neighbours(df, spec, columns, 0)

    def filled(c: str) -> Column:
        before, later = f"coalesce(`_p_{c}`, `_cp_{c}`).v", f"coalesce(`_q_{c}`, `_cq_{c}`).v"
        value = {"bfill": later, "ffill": before, "bfill_ffill": f"coalesce({later}, {before})"}[how]
        return F.expr(f"{value} AS `{c}`")

    return rows.select(*[filled(c) if c in columns else F.col(c) for c in df.columns])


def clean_observations(
    df: DataFrame,
    spec: SeriesSpec,
    *,
    tie_break: Sequence[str] = (),
    limit: int = 3,
    bounds: Mapping[str, tuple[float, float]] = PLAUSIBLE,
) -> DataFrame:
    """Type, parse times, de-duplicate, interpolate, clip and order the columns.

    The gap report is a query of its own (:func:`time_gaps`).
    """
    require_columns(df, [*spec.keys, *OBSERVATION])
    typed = parse_times(coerce_numeric(df), spec.ts)
    unique = stage(drop_duplicate_times(typed, spec, tie_break).select(*spec.keys, *OBSERVATION))
    # A column without nulls has nothing to fill and is not carried through the sorts.
    missing = unique.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in MEASURES]).first()
    lacking = [c for c in MEASURES if missing[c]]
    return clip_ranges(interpolate_gaps(unique, spec, lacking, limit) if lacking else unique, bounds)
