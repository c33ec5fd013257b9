"""Air quality index from 0 to 500, and the pollutant that sets it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.operators.chunks import SeriesSpec, drop_halo, with_halo

# Index at the class borders, and for each pollutant its unit, the step its concentration is cut
# to and the highest concentration of each class (the next class begins one step above it).
INDEX_TOPS = (50, 100, 150, 200, 300, 400, 500)
CLASSES = {
    "pm2_5": ("ug", 0.1, (12.0, 35.4, 55.4, 150.4, 250.4, 350.4, 500.4)),
    "pm10": ("ug", 1.0, (54, 154, 254, 354, 424, 504, 604)),
    "o3": ("ppm", 0.001, (0.054, 0.070, 0.085, 0.105, 0.200)),
    "co": ("ppm", 0.1, (4.4, 9.4, 12.4, 15.4, 30.4, 40.4, 50.4)),
    "so2": ("ppb", 1.0, (35, 75, 185, 304, 604, 804, 1004)),
    "no2": ("ppb", 1.0, (53, 100, 360, 649, 1249, 1649, 2049)),
}
# Grams a mole, and litres a mole of air at 25 degrees.
MOLE_GRAMS = {"o3": 48.0, "co": 28.01, "so2": 64.066, "no2": 46.0055}
MOLE_LITRES = 24.45

#: Hours of the weighted mean of particles, the least weight, and of how many newest hours how many must be known.
MEAN_HOURS = 12
LEAST_WEIGHT = 0.5
NEWEST, NEEDED = 3, 2


@dataclass(frozen=True)
class Interval:
    """Concentrations from ``low`` to ``high`` have an index from ``index_low`` to ``index_high``."""

    low: float
    high: float
    index_low: float
    index_high: float


def break_points(pollutant: str) -> tuple[str, float, list[Interval]]:
    """Unit, step and intervals of a pollutant."""
    unit, step, tops = CLASSES[pollutant]
    digits = max(0, len(f"{step:g}".partition(".")[2]))
    out, low, index_low = [], 0.0, 0
    for top, index in zip(tops, INDEX_TOPS, strict=False):
        out.append(Interval(low, float(top), index_low, index))
        low, index_low = round(top + step, digits), index + 1
    return unit, step, out


def in_unit(c: Column, pollutant: str, unit: str) -> Column:
    """Micrograms a cubic metre as parts per million or billion."""
    if unit == "ug":
        return c
    return c * (MOLE_LITRES / MOLE_GRAMS[pollutant] / (1000.0 if unit == "ppm" else 1.0))


def index_of(c: Column, pollutant: str) -> Column:
    """Index of a concentration: on the line through the ends of its interval, to a whole number.

    The concentration is cut to its step first. Beyond the last interval the index stays at its top; below
    0, and for a null, it is null.
    """
    unit, step, intervals = break_points(pollutant)
    # A hair is added so that a value that stands on a step stays there.
    cut = F.floor(in_unit(c, pollutant, unit) / step + 1e-6)
    out = F.lit(float(intervals[-1].index_high))
    for i in reversed(intervals):
        low, high = round(i.low / step), round(i.high / step)
        out = F.when(cut <= high, F.lit(float(i.index_low)) + (i.index_high - i.index_low) / (high - low) * (cut - low)).otherwise(out)
    return F.when(c >= 0, F.floor(out + 0.5)).cast("int")


def _weighted(hours: Column) -> Column:
    """Weighted mean of an array of hourly values, newest first, nulls among them.

    Each hour back weighs ``w`` times the one after it; ``w`` is the smallest over the largest value, 0.5 at
    least. Null unless two of the three newest hours are known.
    """
    top, low = F.array_max(hours), F.array_min(hours)
    weight = F.greatest(F.when(top > 0, low / top).otherwise(1.0), F.lit(LEAST_WEIGHT))
    sums = F.transform(hours, lambda v, i: F.when(v.isNotNull(), F.struct((v * F.pow(weight, i)).alias("v"), F.pow(weight, i).alias("w"))))
    total = F.aggregate(F.filter(sums, lambda s: s.isNotNull()), F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w")), lambda a, s: F.struct((a["v"] + s["v"]).alias("v"), (a["w"] + s["w"]).alias("w")))
    fresh = F.size(F.filter(F.slice(hours, 1, NEWEST), lambda v: v.isNotNull()))
    return F.when(fresh >= NEEDED, total["v"] / total["w"])


def weighted_means(df: DataFrame, spec: SeriesSpec, columns: Sequence[str] = ("pm2_5", "pm10"), hours: int = MEAN_HOURS) -> DataFrame:
    """Adds ``<c>_weighted``: the weighted mean of the last ``hours`` rows of the series, this one included."""
    w = spec.in_chunk()
    rows = with_halo(df, spec, columns, before=hours - 1)
    rows = drop_halo(rows.withColumns({f"_h_{c}": F.array(*[F.lag(c, k).over(w) for k in range(hours)]) for c in columns}))
    return rows.withColumns({f"{c}_weighted": _weighted(F.col(f"_h_{c}")) for c in columns}).drop(*[f"_h_{c}" for c in columns])


def with_index(df: DataFrame, spec: SeriesSpec, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Adds ``<pollutant>_index`` for each pollutant, ``aqi`` (the largest) and ``dominant_pollutant``.

    ``columns`` maps pollutants to the columns with their concentrations; by default particles go by their
    weighted mean and gases by the hour's value. Of equal indexes the pollutant named first is dominant.
    """
    if columns is None:
        df = weighted_means(df, spec)
        columns = {p: f"{p}_weighted" if p in ("pm2_5", "pm10") else p for p in CLASSES}
    df = df.withColumns({f"{p}_index": index_of(F.col(c), p) for p, c in columns.items()})
    listed = F.array(*[F.struct(F.col(f"{p}_index").alias("i"), F.lit(-k).alias("k"), F.lit(p).alias("p")) for k, p in enumerate(columns)])
    top = F.array_max(F.filter(listed, lambda s: s["i"].isNotNull()))
    return df.withColumn("aqi", top["i"]).withColumn("dominant_pollutant", top["p"])
