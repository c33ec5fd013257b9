"""Live features from keyed state: the newest rows of each series stay with the stream.

Unlike :func:`aerolith.streaming.live.live_stream` no table is read: a series keeps its last times and
values, and its newest row, in the state store. Python only puts arriving rows in order; features
are column expressions over the kept values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from aerolith.functions.calendar import INTERACTIONS
from aerolith.operators.chunks import SeriesSpec
from aerolith.operators.features import cyclic_features, interaction_features, time_features
from aerolith.schema import LAGS, MEASURES, ROLLINGS, VALUE

TRAIL = "_trail"


def _last_of(rows: pd.DataFrame, ts: str, rest: list[str], size: int) -> pd.DataFrame:
    """The last ``size`` times, ascending; of several rows with one time the one with the highest values."""
    ordered = rows.sort_values(rest, ascending=False, na_position="last", kind="stable").sort_values(ts, kind="stable")
    return ordered.drop_duplicates(ts).tail(size)


def _listed(values) -> list:
    return [None if pd.isna(v) else float(v) for v in values]


def with_trail(rows: DataFrame, spec: SeriesSpec, *, value: str = VALUE, measures: Sequence[str] = tuple(MEASURES), size: int = max(LAGS) + 1, delay: str = "7 days", drop_after: str = "60 days") -> DataFrame:
    """For each series that a micro-batch touches: its newest row and ``_trail``, its last ``size`` values in order of time.

    A late row takes its place among the kept ones; a row whose time is kept replaces it, so corrections
    count; one older than all kept rows of a full trail changes nothing. Rows later than ``delay`` behind
    the newest time of the stream are dropped. Of rows of one batch with equal time the highest values
    win, as in an upsert. A series without rows for ``drop_after`` of event time is forgotten.

    A batch's rows of one series are read in pieces, and only ``size`` of them are held at a time.
    """
    keys, ts, measures = list(spec.keys), spec.ts, list(measures)
    for c in (*keys, ts):
        rows = rows.filter(F.col(c).isNotNull())
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    out = T.StructType([T.StructField(c, kinds[c]) for c in (*keys, ts, *measures)] + [T.StructField(TRAIL, T.ArrayType(T.DoubleType()))])
    held = T.StructType.fromDDL("times array<bigint>, trail array<double>, newest array<double>")
    linger = int(pd.Timedelta(drop_after).total_seconds() * 1000)

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fresh = None
        for part in parts:
            fresh = _last_of(part if fresh is None else pd.concat([fresh, part]), ts, measures, size)
        when = fresh[ts].to_numpy().astype("datetime64[us]").astype("int64")
        points = dict(zip(when.tolist(), _listed(fresh[value]), strict=True))
        newest_at, newest = int(when[-1]), _listed(fresh.iloc[-1][measures])
        if state.exists:
            times, trail, row = state.get
            points = dict(zip(times, trail, strict=True)) | points
            if times[-1] > newest_at:
                newest_at, newest = times[-1], list(row)
        times = sorted(points)[-size:]
        trail = [points[t] for t in times]
        state.update((times, trail, newest))
        state.setTimeoutTimestamp(max(newest_at // 1000 + linger, state.getCurrentWatermarkMs() + 1))
        made = {c: [k] for c, k in zip(keys, key, strict=True)} | {ts: [pd.Timestamp(newest_at, unit="us", tz="UTC")]}
        made |= {c: [v] for c, v in zip(measures, newest, strict=True)} | {TRAIL: [trail]}
        yield pd.DataFrame(made)

    picked = rows.withWatermark(ts, delay).select(*keys, ts, *measures)
    return picked.groupBy(*keys).applyInPandasWithState(advance, out, held, "update", GroupStateTimeout.EventTimeTimeout)


def trail_features(df: DataFrame, *, lags: Sequence[int] = tuple(LAGS), windows: Sequence[int] = tuple(ROLLINGS), prefix: str = "pm25") -> DataFrame:
    """Lags, and rolling means and deviations (half a frame is enough), of the last value of ``_trail``."""
    trail, n = F.col(TRAIL), F.size(TRAIL)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)

    def squares(values: Column, mean: Column) -> Column:
        return F.transform(values, lambda v: (v - mean) * (v - mean))

    made: dict[str, Column] = {f"{prefix}_lag_{k}": F.get(trail, n - 1 - k) for k in lags}
    for w in windows:
        frame = F.filter(F.slice(trail, F.greatest(n - w + 1, F.lit(1)), F.lit(w)), lambda v: v.isNotNull())
        count = F.size(frame)
        mean = total(frame) / count
        spread = total(squares(frame, mean))
        enough = count >= max(1, w // 2)
        made[f"{prefix}_roll_mean_{w}"] = F.when(enough, mean)
        made[f"{prefix}_roll_std_{w}"] = F.when(enough & (count > 1), F.sqrt(spread / (count - 1))).otherwise(0.0)
    return df.withColumns(made).drop(TRAIL)


def stateful_live_features(rows: DataFrame, spec: SeriesSpec, *, delay: str = "7 days", drop_after: str = "60 days") -> DataFrame:
    """Live features of every series a micro-batch touches, as a stream in update mode."""
    newest = trail_features(with_trail(rows, spec, delay=delay, drop_after=drop_after))
    return cyclic_features(interaction_features(time_features(newest, spec.ts), INTERACTIONS))
