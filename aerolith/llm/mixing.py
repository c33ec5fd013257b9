"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within a source the keys cut the documents into ranges of
similar size, the ranges are added up, and a running sum inside each range gives every document its
place in the source's random order. A source is read in that order until its budget is spent, whole
rounds first. A source of any size is spread over as many tasks as it has ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerolith.llm.common import WORD_SQL
from aerolith.session import stage

#: Weights of the sources in order of their names; repeated as often as needed.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, and the most often a source may be read.
SHARE = 1.5
MOST_ROUNDS = 2
#: Documents in one range of random keys, and ranges that are added up together. Only the spread of the work
#: depends on them.
RANGE_ROWS = 2_000
SPAN_RANGES = 1_000

_KEY_SPAN = 16**12
_BREAK = r"[\x20\x09-\x0D]+"


def word_count(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def random_key(*columns: str | Column) -> Column:
    """A number below 16**12 that only depends on the columns' values."""
    text = F.concat_ws("/", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("-")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def document_key() -> Column:
    """Random key of a document by its id, its size and its text, so that rows without ids are spread too."""
    return random_key("doc_id", "size", F.md5(F.col("text").cast("binary")))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST_ROUNDS) -> DataFrame:
    """Targets of sources (source, source_size, n_docs): shares by weight, none above ``most`` times its size.

    Sources are ordered by code point, null last. A source at its limit passes its excess to the
    others by weight: with sources ordered by limit per unit of weight, the limited ones come first,
    so running sums find where the limits end. One row per source takes part; documents do not.
    """
    by_name = W.orderBy(F.col("source").cast("binary").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    listed = sizes.withColumn("_place", place).withColumn("_weight", weight).withColumn("_limit", F.lit(float(most)) * F.col("source_size"))
    by_limit = W.orderBy(F.col("_limit") / F.col("_weight"), "_place")
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / (
        F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    )
    levels = listed.withColumn("_level", level).withColumn("_open", F.col("_level") * F.col("_weight") <= F.col("_limit"))
    first_open = F.min(F.when(F.col("_open"), F.struct(F.col("_limit") / F.col("_weight"), F.col("_place"), F.col("_level")))).over(everything)
    final = levels.withColumn("_final", first_open.getField("_level"))
    return final.select("source", "source_size", "n_docs", F.coalesce(F.least("_limit", F.col("_final") * F.col("_weight")), F.col("_limit")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST_ROUNDS, range_rows: int = RANGE_ROWS, extra: Sequence[str] = ()) -> DataFrame:
    """How many words the mix takes of each document.

    ``docs`` needs doc_id, source and text. Returns doc_id, source, size, source_size, target, taken
    and the columns ``extra``. A document is taken once for every whole round of its source; the last
    round runs in random order up to the budget (the target without its fraction), and the document on
    which it ends gives only the words that are left. So a source's taken words add up to its budget,
    and no document gives more than ``most`` times its size.

    Targets are set in one task from one row a source. Null texts have size 0 and give nothing. A null source is a source of its own. Rows with equal id,
    equal size and equal text are interchangeable, so reruns agree on every output row and on every
    mixed text. An empty table gives an empty result; a table without words takes 0 of every row.
    """
    slim = stage(docs.select("doc_id", "source", "text", word_count().alias("size")).withColumn("_key", document_key()).drop("text"))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = stage(source_targets(sizes, weights, share, most).withColumn("_ranges", F.ceil(F.col("n_docs") / range_rows)).drop("n_docs"))

    def in_ranges(rows: DataFrame) -> DataFrame:
        known = targets.withColumnRenamed("source", "_name")
        joined = rows.join(known, rows["source"].eqNullSafe(known["_name"])).drop("_name")
        return joined.withColumn("_range", F.floor(F.col("_key") / F.lit(_KEY_SPAN) * F.col("_ranges")).cast("long"))

    range_sums = in_ranges(slim).groupBy("source", "_range").agg(F.sum("size").alias("_sum")).withColumn("_span", F.floor(F.col("_range") / SPAN_RANGES))
    # Running sums in two levels: ranges inside a span, and one row for each span of a source.
    ahead = lambda *by: W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)
    spans = range_sums.groupBy("source", "_span").agg(F.sum("_sum").alias("_sum"))
    spans = spans.select(F.col("source").alias("_s"), F.col("_span").alias("_p"), F.coalesce(F.sum("_sum").over(ahead("source", "_span")), F.lit(0)).alias("_before"))
    placed = range_sums.withColumn("_inside", F.coalesce(F.sum("_sum").over(ahead("source", "_span", "_range")), F.lit(0)))
    placed = placed.join(spans, placed["source"].eqNullSafe(spans["_s"]) & (placed["_span"] == spans["_p"]))
    # Staged: a row a range, of known size where the documents are joined with it, so that these stay where they are.
    offsets = stage(placed.select("_s", F.col("_range").alias("_r"), (F.col("_before") + F.col("_inside")).alias("_offset")))

    rows, ties = slim, ["_key", "doc_id", "size"]
    if extra:
        rows = docs.select("doc_id", "source", *extra, "text", word_count().alias("size"), F.xxhash64("text").alias("_text")).withColumn("_key", document_key()).drop("text")
        ties = [*ties, "_text"]
    inside = W.partitionBy("source", "_range").orderBy(*ties).rowsBetween(W.unboundedPreceding, -1)
    placed = in_ranges(rows).withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, placed["source"].eqNullSafe(offsets["_s"]) & (placed["_range"] == offsets["_r"]))
    begin = F.col("_offset") + F.col("_inside")

    budget = F.floor("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    remaining = budget - rounds * F.col("source_size") - begin
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), remaining))
    return placed.select("doc_id", "source", *extra, "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: a row for each time a document is taken, with the columns of ``docs``.

    The document on which a source's budget ends gives its first words up to the budget as its last
    row. Whole repeats keep their text as it is. n_chars follows the text where it is a column.
    """
    columns = docs.columns
    taken = mix(docs.select("doc_id", "source", "text", F.struct(*[F.col(c) for c in columns]).alias("_row")), extra=("_row",), **settings)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    counts = F.concat(F.array_repeat(F.col("size"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    rows = taken.select("_row", "size", F.explode(counts).alias("_words"))
    body = F.regexp_replace("_row.text", "^" + _BREAK, "")
    rest = F.element_at(F.split(body, _BREAK, F.col("_words").cast("int") + 1), -1)
    head = F.regexp_replace(F.substring(body, F.lit(1), F.char_length(body) - F.char_length(rest)), _BREAK + "$", "")
    text = F.when(F.col("_words") == F.col("size"), F.col("_row.text")).otherwise(head)
    rows = rows.withColumn("_text", text)
    out = {c: F.col("_row").getField(c) for c in columns} | {"text": F.col("_text")}
    if "n_chars" in columns:
        out["n_chars"] = F.when(F.col("_words") == F.col("size"), F.col("_row.n_chars")).otherwise(F.char_length("_text")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[e.alias(c) for c, e in out.items()])
