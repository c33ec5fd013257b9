"""Small frames with gaps, and plain re-computations to compare with."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import types as T

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def hours(*offsets):
    return [T0 + timedelta(hours=h) for h in offsets]


def series_frame(spark, data, columns=("v",), key="city"):
    """``data``: {key: [(hour, value...), ...]} as a DataFrame."""
    schema = T.StructType(
        [T.StructField(key, T.StringType()), T.StructField("datetime", T.TimestampType())]
        + [T.StructField(c, T.DoubleType()) for c in columns]
    )
    rows = [(k, T0 + timedelta(hours=h), *vals) for k, items in data.items() for h, *vals in items]
    random.Random(7).shuffle(rows)
    return spark.createDataFrame(rows, schema).repartition(3)


def random_series(seed, n, null_share=0.3, gap_share=0.2, long_runs=True):
    """[(hour, value or None)] with missing hours and runs of nulls."""
    rnd = random.Random(seed)
    out, hour, run = [], 0, 0
    for _ in range(n):
        hour += 1 if rnd.random() > gap_share else rnd.randint(2, 9)
        if run == 0 and long_runs and rnd.random() < 0.08:
            run = rnd.randint(4, 14)
        value = None if run > 0 or rnd.random() < null_share else round(rnd.uniform(0, 50), 3)
        run = max(0, run - 1)
        out.append((hour, value))
    return out


def hour_of(ts):
    stamp = ts if ts.tzinfo else ts.replace(tzinfo=timezone.utc)
    return round((stamp - T0).total_seconds() / 3600)
