"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "aerolith", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution on; extra settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a folder of our own with a warning; any other is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get(_CHECKPOINT_CONF, None) or context.getConf().get(_CHECKPOINT_CONF)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {_CHECKPOINT_CONF} to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="aerolith-")
        warnings.warn(f"{_CHECKPOINT_CONF} is not set; using {named}", stacklevel=2)
        spark.conf.set(_CHECKPOINT_CONF, named)
    return named.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where several passes follow: the passes scan columnar files (pruned, pushed down)
    instead of computing the same plan again, and a lost executor only costs a re-read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._stage_path = path
    made = _JOB.get()
    if made is not None:
        made.append(staged)
    return staged


#: What the job of this thread (or task) has staged. Jobs of other threads, such as the batches of another
#: stream of the session, have lists of their own.
_JOB: ContextVar[list[DataFrame] | None] = ContextVar("aerolith_job", default=None)


@contextmanager
def job() -> Iterator[list[DataFrame]]:
    """Deletes at its end all that was staged inside. A job writes its own output before.

    A staged result that outlives the job is taken out of the list. Jobs may be nested, and may run side by
    side in several threads; each deletes its own.
    """
    made: list[DataFrame] = []
    outer = _JOB.set(made)
    try:
        yield made
    finally:
        _JOB.reset(outer)
        discard(*made)


def discard(*staged: DataFrame) -> None:
    """Delete the files of staged DataFrames nothing reads any more."""
    for df in staged:
        path = getattr(df, "_stage_path", None)
        if path:
            delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)
