"""Aerolith: keyed hourly observation series on Spark.

Every operator takes a DataFrame plus a :class:`SeriesSpec` and returns a DataFrame.
"""

from aerolith.operators.chunks import SeriesSpec
from aerolith.session import build_session, discard, shared_dir, stage

__all__ = ["SeriesSpec", "build_session", "discard", "shared_dir", "stage"]
