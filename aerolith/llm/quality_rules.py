"""Quality rules: base counts of a text, and a hashed n-gram log-likelihood ratio.

The n-grams (one and two words, without regard to A-Z case) of trusted texts and of all texts are
counted in hash buckets. A document's score is the mean over its n-grams of the log of how much more
likely their buckets are in trusted texts than in the corpus. Every document is held against one
threshold, which is taken from trusted texts that were not counted: how low their scores get depends on
how much text there was to count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import BEGINS_CHAR, IN_WORD, MIX, Words, map_texts, mixed, segment_sums, slices, text_bytes
from aerolith.session import stage

BUCKETS = 1 << 15
#: Weight of the corpus in the smoothed target counts, in n-grams.
PRIOR = 20_000.0
#: The threshold lies this far below the score that all but this share of the uncounted trusted texts reach.
MARGIN = 0.04
LEAST_SHARE = 0.001
#: Parts of a range of scores that are counted in one pass when a quantile is sought.
PARTS = 1024

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

#: Fixed value: the characters counted as symbols.
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.zeros(256, dtype=np.int8)
_IS_SYMBOL[list(SYMBOLS)] = 1
_WORD_CHARS = (IN_WORD & BEGINS_CHAR).astype(np.int8)


def repeated_words(words: Words, hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each text inside a window of ``window`` words that the text has twice or more."""
    out = np.zeros(words.texts, dtype=np.int64)
    n = len(hashes) - window + 1
    if n <= 0:
        return out
    same = np.flatnonzero(words.text[:n] == words.text[window - 1 :])
    key = words.text[same].astype(np.uint64)
    for k in range(window):
        key = mixed(key ^ hashes[same + k])
    order = np.argsort(key)
    alike = key[order[1:]] == key[order[:-1]]
    candidate = np.zeros(len(same), dtype=bool)
    candidate[order[1:][alike]] = True
    candidate[order[:-1][alike]] = True
    places = same[candidate]
    if not len(places):
        return out
    # Windows with equal hashes are compared word by word.
    used = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(used, places, 1)
    np.add.at(used, places + window, -1)
    numbers: dict[bytes, int] = {}
    exact = np.zeros(len(hashes), dtype=np.int64)
    for i in np.flatnonzero(np.cumsum(used[:-1])).tolist():
        exact[i] = numbers.setdefault(words.word(i), len(numbers))
    rows = np.column_stack([words.text[places], *[exact[places + k] for k in range(window)]])
    by_row = np.lexsort(rows.T[::-1])
    equal = (rows[by_row[1:]] == rows[by_row[:-1]]).all(axis=1)
    twice = np.zeros(len(places), dtype=bool)
    twice[by_row[1:][equal]] = True
    twice[by_row[:-1][equal]] = True
    steps = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(steps, places[twice], 1)
    np.add.at(steps, places[twice] + window, -1)
    return segment_sums((np.cumsum(steps[:-1]) > 0).astype(np.int64), words.first, words.last)


def repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def base_counts(texts: list[bytes], words: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    return {
        "n_words": words.last - words.first,
        "word_chars": segment_sums(_WORD_CHARS[words.data], words.text_starts, words.text_ends),
        "n_symbols": segment_sums(_IS_SYMBOL[words.data], words.text_starts, words.text_ends),
        "n_dup_lines": np.array([repeated_lines(t) for t in texts], dtype=np.int64),
        "n_repeat_words": repeated_words(words, hashes),
    }


def gram_buckets(words: Words, hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every one- and two-word gram, and which text it is in."""
    pairs = np.flatnonzero(words.text[1:] == words.text[:-1])
    two = mixed(hashes[pairs] * MIX ^ hashes[pairs + 1])
    grams = np.concatenate([hashes, two]) % np.uint64(buckets)
    return grams.astype(np.int64), np.concatenate([words.text, words.text[pairs]])


#: Rows that a task hands on for its counts; each holds the counts of as many buckets side by side.
_STRIPES = 64


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, corpus, target): n-grams of all rows and of the rows whose column ``trusted`` is true.

    Each task adds up its own rows first and gives ``_STRIPES`` rows with a stretch of the buckets each, which are
    added up stretch by stretch.
    """
    stripes = min(_STRIPES, buckets)
    bounds = np.linspace(0, buckets, stripes + 1).astype(int)
    layout = "stripe int, corpus array<long>, target array<long>"

    def rows(counts: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"stripe": pa.array(list(counts), pa.int32()), "corpus": [c[0] for c in counts.values()], "target": [c[1] for c in counts.values()]})

    def run(batches):
        counts = np.zeros((2, buckets), dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                trusted = np.array(part.column("trusted").to_pylist(), dtype=bool)
                words = Words(text_bytes(part.column("text")))
                grams, doc = gram_buckets(words, words.hashes(), buckets)
                counts[0] += np.bincount(grams, minlength=buckets)
                counts[1] += np.bincount(grams[trusted[doc]], minlength=buckets)
        if counts[0].any():
            yield rows({k: counts[:, bounds[k] : bounds[k + 1]] for k in range(stripes)})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, corpus, target in zip(batch.column("stripe").to_pylist(), batch.column("corpus"), batch.column("target"), strict=True):
                both = np.stack([corpus.values.to_numpy(), target.values.to_numpy()])
                sums[k] = sums[k] + both if k in sums else both
        if sums:
            yield rows(sums)

    summed = docs.select("trusted", "text").mapInArrow(run, layout).repartition("stripe").mapInArrow(add, layout)
    first = F.element_at(F.array(*[F.lit(int(b)) for b in bounds[:-1]]), F.col("stripe") + 1)
    each = summed.select(first.alias("first"), F.posexplode(F.arrays_zip("corpus", "target")).alias("at", "c"))
    return each.select((F.col("first") + F.col("at")).cast("long").alias("bucket"), "c.corpus", "c.target").filter("corpus > 0")


#: Bits of the filter of trusted ids, and how many of them an id sets. The filter is broadcast: 4 MB whatever the number
#: of ids. With 10 million ids one row in five passes it wrongly; with far more it lets all pass, and only
#: costs what it saved before.
FILTER_BITS = 1 << 25
_PROBES = 3


def _spots(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    h = hashes.astype(np.int64).view(np.uint64)
    return [(mixed(h + np.uint64(k) * MIX) % np.uint64(bits)).astype(np.int64) for k in range(_PROBES)]


def id_filter(ids: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of the column doc_id as words of 64 bits. Each task sets its own bits; the words are merged by bitwise or."""

    def run(batches):
        words = np.zeros(bits // 64, dtype=np.uint64)
        for batch in batches:
            for spot in _spots(batch.column("h").to_numpy(), bits):
                np.bitwise_or.at(words, spot >> 6, np.uint64(1) << (spot & 63).astype(np.uint64))
        full = np.flatnonzero(words)
        yield pa.RecordBatch.from_pydict({"word": full, "mask": words[full].view(np.int64)})

    hashed = ids.filter("doc_id is not null").select(F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    merged = hashed.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[merged["word"].to_numpy(np.int64)] = merged["mask"].to_numpy(np.int64).view(np.uint64)
    return out


def id_hash() -> Column:
    return F.xxhash64(F.col("doc_id").cast("string"))


def hits(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter cannot rule out: all of trusted ids, and a few others."""
    found = np.ones(len(hashes), dtype=bool)
    for spot in _spots(hashes, 64 * len(words)):
        found &= (words[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) != 0
    return found


def may_be_trusted(rows: DataFrame, words: np.ndarray) -> DataFrame:
    """doc_id and text of the rows that the filter cannot rule out."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(hits(shared.value, batch.column("h").to_numpy()))).drop_columns(["h"])

    asked = rows.select("doc_id", "text", id_hash().alias("h"))
    return asked.mapInArrow(run, asked.drop("h").schema)


def _of_ids(rows: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is a trusted one. Always a shuffle, whatever the size; only ids are held in memory and no text is sorted."""
    ids = trusted_ids.select(F.col("doc_id").alias("_id")).filter("_id is not null").hint("shuffle_hash")
    return rows.join(ids, F.col("doc_id") == F.col("_id"), "left_semi")


def _counted() -> Column:
    """Whether a trusted id is counted; the others set the threshold."""
    return F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0


def log_ratios(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR, among: Column | None = None, words: np.ndarray | None = None) -> np.ndarray:
    """Log ratio of each bucket: trusted texts over the whole corpus. All 0 where no row is trusted.

    ``trusted_ids`` has the column doc_id. All its ids are used, or those for which ``among`` is true; it is
    asked of the documents before they are joined. The corpus counts cover every row. Only texts that ``words``,
    the filter of the ids, does not rule out move to the ids.
    """
    asked = docs.select("doc_id", "text").filter("doc_id is not null")
    asked = may_be_trusted(asked if among is None else asked.filter(among), id_filter(trusted_ids) if words is None else words)
    trusted = _of_ids(asked, trusted_ids)
    sums = bucket_counts(docs.select(F.lit(False).alias("trusted"), "text"), buckets).toPandas()
    good = bucket_counts(trusted.select(F.lit(True).alias("trusted"), "text"), buckets).toPandas()
    corpus, target = np.zeros(buckets), np.zeros(buckets)
    corpus[sums["bucket"]], target[good["bucket"]] = sums["corpus"], good["target"]
    if not target.sum():
        return np.zeros(buckets)
    base = (corpus + 1) / (corpus.sum() + buckets)
    return np.log((target + prior * base) / (target.sum() + prior) / base)


def lower_quantile(scores: DataFrame, share: float, name: str = "llr", parts: int = PARTS) -> float | None:
    """The exact value at place ``floor(share * (rows - 1))`` of a column; None without rows.

    Each pass counts the rows in equal parts of a range and goes on with the part that holds the place.
    """
    v = F.col(name)
    facts = scores.agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).first()
    if not facts["n"]:
        return None
    place, low, high = int(share * (facts["n"] - 1)), facts["low"], facts["high"]
    while low < high:
        part = F.floor((v - F.lit(low)) / F.lit(high - low) * parts)
        rows = scores.filter((v >= low) & (v <= high)).groupBy(part.alias("part")).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).collect()
        for r in sorted(rows, key=lambda r: r["part"]):
            if place < r["n"]:
                low, high = r["low"], r["high"]
                break
            place -= r["n"]
    return low


@dataclass(frozen=True)
class Rules:
    """Log ratio of each bucket, and the least mean of a document that is kept."""

    ratios: np.ndarray
    threshold: float


def fit(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> Rules:
    """The rules of a corpus. Half of the trusted ids, by hash, are counted; the others set the threshold.

    Without a trusted text left to set it, every document that passes the base is kept. A filter of the trusted
    ids goes to the documents first. The texts it lets through are moved to the ids to be counted, those that set the
    threshold are scored where they are and only their scores are moved.
    """
    words = id_filter(trusted_ids)
    ratios = log_ratios(docs, trusted_ids, buckets, prior, among=_counted(), words=words)
    others = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & ~_counted())
    scored = judge(others, Rules(ratios, -np.inf), among=words).filter(~F.col("base_failed")).select("doc_id", "llr")
    least = lower_quantile(stage(_of_ids(scored, trusted_ids).select("llr")), LEAST_SHARE)
    return Rules(ratios, -np.inf if least is None else float(least) - MARGIN)


def judge(docs: DataFrame, rules: Rules, keep: tuple[str, ...] = ("doc_id",), among: np.ndarray | None = None) -> DataFrame:
    """``keep``, the base counts, base_failed, llr (mean log ratio, 0 without words) and kept of each text.

    base_failed: under 20 words, or over 30% of the words in repeated windows; such a row is not kept.
    Null and empty texts have all counts 0 and fail. Rows are kept one for one, or those whose id the filter ``among``
    does not rule out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rules.ratios)
    out = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double"

    def work():
        table = shared.value

        def run(texts: list[bytes]) -> dict[str, list]:
            words = Words(texts)
            hashes = words.hashes()
            grams, doc = gram_buckets(words, hashes, len(table))
            made = base_counts(texts, words, hashes)
            n = np.bincount(doc, minlength=len(texts))
            return made | {"llr": np.bincount(doc, weights=table[grams], minlength=len(texts)) / np.maximum(n, 1)}

        return run

    only = None
    if among is not None:
        filtered = docs.sparkSession.sparkContext.broadcast(among)
        only = (id_hash(), lambda h: hits(filtered.value, h))
    judged = map_texts(docs, out, work, keep=keep, only=only)
    failed = (F.col("n_words") < LEAST_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MOST_REPEATED_PERCENT) * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= F.lit(float(rules.threshold))))
