"""Streams of landed observations: clean, de-duplicate, upsert, features, scores, hourly means."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from aerolith.operators.chunks import SeriesSpec
from aerolith.operators.features import live_features
from aerolith.plans.jobs import clean_live, series_history
from aerolith.plans.scoring import prediction_log, score
from aerolith.schema import OBSERVATION, VALUE
from aerolith.session import job, stage
from aerolith.sources.store import upsert


_SHUFFLE = "spark.sql.shuffle.partitions"
_STORES = "spark.sql.streaming.stateStore"

#: State on local disk with bounded memory, one store for both sides of a join; a commit writes what changed.
_STATE_CONF = {
    f"{_STORES}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORES}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STORES}.rocksdb.boundedMemoryUsage": "true",
    f"{_STORES}.rocksdb.trackTotalNumberOfRows": "false",  # a look-up for each row written
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


@contextmanager
def state_settings(spark: SparkSession, parts: int | None = None) -> Iterator[None]:
    """Streams started inside keep their state in ``parts`` partitions (default: one for each core).

    Every store of every partition is committed to the checkpoint in every micro-batch, however little it holds,
    so the session's number of shuffle partitions, which follows the input of batch jobs, is only an upper bound. A stream
    takes its settings when it starts; one that goes on from a checkpoint keeps those it began with.
    """
    parts = min(int(spark.conf.get(_SHUFFLE)), parts or spark.sparkContext.defaultParallelism)
    settings = _STATE_CONF | {_SHUFFLE: str(parts)}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def landed(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the files landed in a folder."""
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def clean_stream(rows: DataFrame, ts: str = "datetime") -> DataFrame:
    return clean_live(rows, ts)


def first_arrivals(rows: DataFrame, spec: SeriesSpec, delay: str = "2 hours") -> DataFrame:
    """First row of each (keys, ts) wins; state is kept for ``delay`` of event time.

    Leaves out later corrections. Use :func:`upsert_stream` alone where corrections count.
    """
    return rows.withWatermark(spec.ts, delay).dropDuplicatesWithinWatermark([*spec.keys, spec.ts])


def hourly_means(events: DataFrame, keys: Sequence[str], ts: str, value: str, delay: str = "2 hours") -> DataFrame:
    """Mean of raw events per key and hour. Works on streams and tables."""
    if events.isStreaming:
        events = events.withWatermark(ts, delay)
    means = events.groupBy(F.window(ts, "1 hour"), *keys).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n"))
    return means.select(*keys, F.col("window.start").alias("hour"), "mean_value", "n")


def _start(rows: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool, mode: str = "append") -> StreamingQuery:
    writer = rows.writeStream.outputMode(mode).foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def upsert_stream(
    rows: DataFrame, spec: SeriesSpec, path: str, checkpoint: str, *, tie_break: Sequence[str] = (), available_now: bool = True, mode: str = "append"
) -> StreamingQuery:
    """Merge every micro-batch into the table at ``path``; the last row of a key wins.

    ``mode`` is the stream's output mode: "update" for aggregates that come again as they grow.

    A batch that is run again after a failure merges the same rows again and changes nothing.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        upsert(batch.sparkSession, path, batch, list(spec.keys), spec.ts, tie_break)

    return _start(rows, merge, checkpoint, available_now, mode)


def live_stream(
    rows: DataFrame,
    spec: SeriesSpec,
    raw_path: str,
    features_path: str,
    checkpoint: str,
    *,
    predict: Callable[[DataFrame], DataFrame] | None = None,
    features: Sequence[str] = (),
    model_name: str = "",
    log_path: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Upsert each micro-batch, then live features of its series, and predictions if a model is given.

    Features and log go to a folder per batch id that is replaced, so a repeated batch does not
    add its rows twice.
    """

    def advance(batch: DataFrame, batch_id: int) -> None:
        with job():
            merge(stage(batch.select(*spec.keys, *OBSERVATION)), batch_id)

    def merge(new: DataFrame, batch_id: int) -> None:
        spark = new.sparkSession
        if new.isEmpty():
            return
        upsert(spark, raw_path, new, list(spec.keys), spec.ts)
        history = series_history(spark, raw_path, new, spec, 169)
        latest = stage(live_features(history, spec))
        latest.write.mode("overwrite").parquet(f"{features_path}/batch_id={batch_id}")
        if predict is not None and log_path is not None:
            scored = score(latest, predict, features, [*spec.keys, spec.ts, VALUE])
            rows_out = prediction_log(scored, spec.keys, model_name, F.current_timestamp(), spec.ts)
            rows_out.write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")

    return _start(rows, advance, checkpoint, available_now)
