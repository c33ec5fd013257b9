"""Named, versioned feature tables with keyed upsert, and saved views over them.

Layout: ``<root>/<group>/v=<n>/event_date=<d>/``. An upsert rewrites only the dates it touches;
the new content is staged first, so the table is never read and overwritten by one plan.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.schema import CITY, TARGET, TS, add_city, require_columns, sanitize_columns
from aerolith.session import discard, stage
from aerolith.sources.tables import exists

DATE = "event_date"


def latest_version(old: DataFrame, new: DataFrame, keys: Sequence[str], tie_break: Sequence[str | Column] = ()) -> DataFrame:
    """Rows of both by name, the new one where a key is in both.

    Missing columns become null. Copies of a key inside one side are settled by the tie-break
    columns (highest wins), then by the remaining values.
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "_new"]
    order = [F.col("_new"), *[F.col(c) if isinstance(c, str) else c for c in tie_break], *[F.col(c) for c in rest]]
    w = W.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return both.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r", "_new")


_SCHEMA = "_schema"

#: Key of a field's metadata: the columns of the files that held it under an earlier, narrower type.
_EARLIER = "earlier"

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds the values of both; an error where there is none.

    Whole numbers widen to longer ones and to doubles, decimals to decimals with room for both, dates to
    times, arrays by their elements. A column without a type yet (all null) takes the other's.
    """
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    for x, y in ((a, b), (b, a)):
        if isinstance(x, _WHOLE) and isinstance(y, _WHOLE):
            return max(x, y, key=lambda t: _DIGITS[type(t)])
        if isinstance(x, (T.FloatType, T.DoubleType)) and isinstance(y, (*_WHOLE, T.DecimalType, T.FloatType, T.DoubleType)):
            return T.DoubleType()
        if isinstance(x, T.DecimalType) and isinstance(y, (*_WHOLE, T.DecimalType)):
            digits, scale = (y.precision, y.scale) if isinstance(y, T.DecimalType) else (_DIGITS[type(y)], 0)
            places = max(x.scale, scale)
            whole = max(x.precision - x.scale, digits - scale)
            if whole + places <= 38:
                return T.DecimalType(whole + places, places)
        if isinstance(x, T.DateType) and isinstance(y, T.TimestampType):
            return y
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType), True)
    raise TypeError(f"no type holds both {a.simpleString()} and {b.simpleString()}")


def _held(field: T.StructField) -> list[T.StructField]:
    """The columns of the files that hold a field, newest first. All but the newest are only read."""
    earlier = [T.StructField.fromJson(f) for f in field.metadata.get(_EARLIER, [])]
    newest = f"{field.name}__{field.dataType.simpleString()}" if earlier else field.name
    return [T.StructField(newest, field.dataType), *reversed(earlier)]


def table_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The columns a table has had so far, without the date; None if there is no table yet."""
    kept = f"{path}/{_SCHEMA}"
    if exists(spark, kept):
        newest = spark.read.json(kept, schema="version long, columns string").orderBy(F.desc("version")).first()
        return T.StructType.fromJson(json.loads(newest["columns"]))
    if exists(spark, path):  # written by other means
        found = spark.read.option("mergeSchema", True).parquet(path).schema
        return T.StructType([T.StructField(f.name, f.dataType) for f in found.fields if f.name != DATE])
    return None


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table with all columns it has had; rows written before a column came have null in it.

    A column that was widened stands in the files under a column for each type it has had; a row has its
    value in one of them, and all are read as the widest.
    """
    schema = table_schema(spark, path)
    if schema is None:
        raise FileNotFoundError(f"no table at {path}")
    files = T.StructType([h for f in schema.fields for h in _held(f)] + [T.StructField(DATE, T.DateType())])
    values = [F.coalesce(*[F.col(h.name).cast(f.dataType) for h in _held(f)]).alias(f.name) for f in schema.fields]
    return spark.read.schema(files).parquet(path).select(*values, DATE)


def _widen(spark: SparkSession, path: str, new: T.StructType) -> T.StructType:
    """Adds the columns the table does not have yet and widens those that come with a wider type.

    No file is rewritten: from now on a widened column is written under another name.
    """
    old = table_schema(spark, path)
    known = {f.name: f for f in old} if old else {}
    for f in new.fields:
        held = known.get(f.name)
        if held is None:
            if not isinstance(f.dataType, T.NullType):  # without a type there is nothing to keep yet
                known[f.name] = T.StructField(f.name, f.dataType)
            continue
        wider = common_type(held.dataType, f.dataType)
        if wider != held.dataType:
            earlier = [json.loads(h.json()) for h in reversed(_held(held))]
            known[f.name] = T.StructField(f.name, wider, True, {_EARLIER: earlier})
    schema = T.StructType(list(known.values()))
    taken = [h.name for f in schema for h in _held(f)]
    if len(set(taken)) < len(taken):
        raise ValueError(f"columns of one name in {sorted(taken)}")
    if old is None or json.loads(schema.json()) != json.loads(old.json()):
        kept = f"{path}/{_SCHEMA}"
        last = spark.read.json(kept, schema="version long").agg(F.max("version")).first()[0] if exists(spark, kept) else 0
        spark.createDataFrame([(last + 1, schema.json())], "version long, columns string").coalesce(1).write.mode("append").json(kept)
    return schema


_COUNTS = "_counts"


def series_counts(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame | None:
    """(keys, event_date, n): rows of each series and date. None for a table written without upserts.

    Kept next to the table by every upsert, so a reader knows how far back a series must be read.
    """
    kept = f"{path}/{_COUNTS}"
    if not exists(spark, kept):
        return None
    schema = table_schema(spark, path)
    kinds = [T.StructField(k, schema[k].dataType) for k in keys]
    return spark.read.schema(T.StructType([*kinds, T.StructField("n", T.LongType()), T.StructField(DATE, T.DateType())])).parquet(kept)


def newest_rows(spark: SparkSession, path: str, touched: DataFrame, keys: Sequence[str], rows: int) -> DataFrame | None:
    """Stored rows of the dates that hold the newest ``rows`` rows of the series in ``touched``; None without counts.

    Only these dates are read, however long the history is and however new or sparse a series is. May
    hold a date's earlier rows too.
    """
    counts = series_counts(spark, path, keys)
    if counts is None:
        return None
    names = touched.select(*keys).distinct()
    newer = W.partitionBy(*keys).orderBy(F.col(DATE).desc()).rowsBetween(W.unboundedPreceding, -1)
    days = counts.join(names, list(keys), "left_semi").withColumn("_newer", F.coalesce(F.sum("n").over(newer), F.lit(0)))
    needed = stage(days.filter((F.col("_newer") < rows) & (F.col("n") > 0)).select(*keys, DATE))
    dates = [r[0] for r in needed.select(DATE).distinct().collect()]  # dates of the table at most
    return read_table(spark, path).filter(F.col(DATE).isin(dates)).join(needed, [*keys, DATE], "left_semi")


def upsert(
    spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], ts: str = TS, tie_break: Sequence[str | Column] = ()
) -> int:
    """Merge ``new`` into the table at ``path``, rewriting only the dates in it.

    Rows without a time belong to no date: they are left out, and their number is returned. Columns may
    be missing from ``new`` (they become null) or come with it (they are null in older rows). A column
    whose type is wider than the table's widens it (``common_type``); one that no type holds together with
    the old values is an error before anything is written. Running the same upsert again changes nothing. Output is rebalanced by date: a large date is
    spread over several tasks and files.
    """
    known = table_schema(spark, path) is not None
    schema = _widen(spark, path, new.schema)
    typed = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields if f.name in new.columns])
    staged = stage(typed.withColumn(DATE, F.to_date(ts)))
    left_out = staged.filter(F.col(DATE).isNull()).count()
    dated = staged.filter(F.col(DATE).isNotNull())
    old = dated.limit(0)
    if known:
        dates = [r[0] for r in dated.select(DATE).distinct().collect()]
        old = read_table(spark, path).filter(F.col(DATE).isin(dates))
    merged = stage(latest_version(old, dated, [*keys, ts], tie_break))
    written = merged.select(*[F.col(f.name).alias(_held(f)[0].name) for f in schema.fields], DATE)
    writer = written.hint("rebalance", F.col(DATE)).write.mode("overwrite").partitionBy(DATE)
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    if not known or exists(spark, f"{path}/{_COUNTS}"):
        counts = merged.groupBy(*keys, DATE).agg(F.count("*").alias("n")).hint("rebalance", F.col(DATE))
        counts.write.mode("overwrite").partitionBy(DATE).option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{_COUNTS}")
    discard(staged, merged)
    return left_out


class FeatureStore:
    """Feature groups and views under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _group_path(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v={version}"

    def _spec_path(self, kind: str, name: str, version: int) -> str:
        return f"{self.root}/_{kind}/{name}/v={version}"

    def _save_spec(self, kind: str, name: str, version: int, spec: dict) -> dict:
        path = self._spec_path(kind, name, version)
        if not exists(self.spark, path):
            self.spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.text(path)
        return self._load_spec(kind, name, version)

    def _load_spec(self, kind: str, name: str, version: int) -> dict:
        return json.loads(self.spark.read.text(self._spec_path(kind, name, version), wholetext=False).first()[0])

    def get_or_create_group(
        self,
        name: str,
        version: int = 1,
        *,
        primary_key: Sequence[str] = (TS, CITY),
        event_time: str = TS,
        description: str = "",
    ) -> dict:
        """The group's specification; made on first use, unchanged afterwards."""
        spec = {"primary_key": list(primary_key), "event_time": event_time, "description": description}
        return self._save_spec("groups", name, version, spec)

    def insert(self, df: DataFrame, name: str, version: int = 1, *, city: str = "unknown", **group) -> int:
        """Add the series key if absent, use storage names, read the time as UTC, upsert on the key.

        Returns how many rows without a time were left out.
        """
        spec = self.get_or_create_group(name, version, **group)
        rows, _ = sanitize_columns(add_city(df, city))
        require_columns(rows, spec["primary_key"])
        ts = spec["event_time"]
        if isinstance(rows.schema[ts].dataType, T.StringType):
            rows = rows.withColumn(ts, F.try_to_timestamp(ts))
        keys = [k for k in spec["primary_key"] if k != ts]
        return upsert(self.spark, self._group_path(name, version), rows, keys, ts)

    def read(self, name: str, version: int = 1) -> DataFrame:
        return read_table(self.spark, self._group_path(name, version))

    def get_or_create_view(
        self, name: str, group: str, columns: Sequence[str], version: int = 1, *, group_version: int = 1, labels: Sequence[str] = (TARGET,)
    ) -> DataFrame:
        """A saved selection (primary key, columns, labels) over a group, as a DataFrame."""
        wanted = {"group": group, "group_version": group_version, "columns": list(columns), "labels": list(labels)}
        spec = self._save_spec("views", name, version, wanted)
        keys = self._load_spec("groups", spec["group"], spec["group_version"])["primary_key"]
        listed = dict.fromkeys([*keys, *spec["columns"], *spec["labels"]])
        return self.read(spec["group"], spec["group_version"]).select(*listed)


def feature_view(df: DataFrame, keys: Sequence[str], columns: Sequence[str], labels: Sequence[str] = (TARGET,)) -> DataFrame:
    """The selection of a view over any table."""
    return df.select(*dict.fromkeys([*keys, *columns, *labels]))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
