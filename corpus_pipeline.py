"""From documents to tokens: quality rules, language, near-duplicates, mix, pieces.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame,
which is written as Parquet and read again as the next one's ``docs``. All but the last return the columns
of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm import bpe_rounds, language_id, mixing, quality_rules, simhash
from aerolith.llm.common import held_out
from aerolith.llm.queries import PIECES, trusted_ids
from aerolith.session import discard, job, stage

#: Differing bits up to which fingerprints are near-duplicates here: a near copy moves three bits as often as two.
NEAR_BITS = 3


def packed(docs: DataFrame) -> DataFrame:
    """The text, and the whole row in one column, so that no column of it meets a new one's name."""
    return docs.select("text", F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Rows are judged one for one: repeated rows stay repeated, null and empty texts fail the base and go, a
    null id is judged by its text. An empty table stays empty.
    """
    rules = quality_rules.fit(docs, trusted_ids(spark, sf_dir))
    return quality_rules.judge(packed(docs), rules, keep=("_row",)).filter("kept").select("_row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in a learned language, by their text alone.

    Those without letters go, and those whose code in the best language is far longer than texts of that
    language have: noise, and languages that were not learned. Where nothing could be learned, all with
    a letter stay. Rows are judged one for one, ids and repeats do not matter. An empty table stays empty.
    """
    learned = docs.filter(~held_out())
    model = language_id.fit(learned)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    rates = language_id.usual_rates(learned, model)
    named = language_id.identify(packed(docs), model, keep=("_row", "text"))
    return named.filter((F.col("lang_pred") != language_id.UNDETERMINED) & language_id.usual_text(rates)).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Null, empty and blank texts are one group. Rows without an id come last in their group; of rows equal in
    id and text one stays. An empty table stays empty.
    """
    return simhash.one_of_each(docs, most=NEAR_BITS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time a document is taken, whole repeats with their text as it is.

    Null and empty texts are never taken. A null source is one of its own. An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the pieces of each text, and the digest of what they decode to; null texts are empty."""
    return bpe_rounds.encode_decode(docs, public_tokenizers.path(PIECES))


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources", mix),
    ("SentencePiece", pieces),
]

#: Language models cannot be said in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. What a stage wrote goes when the next one has been written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        with job() as made:
            done = stage(step(spark, docs, sf_dir))
            made.remove(done)
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
