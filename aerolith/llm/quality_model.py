"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins. Shallow trees, boosted in turn over the features with a small
step, add up to one table of values for each feature; the most useful pairs of features get a table over
both. A score is the sum of the looked-up values, so scoring is a few vectorised additions.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import BEGINS_CHAR, IN_WORD, MIX, Words, map_texts, mixed, segment_sums
from aerolith.session import stage

#: Labelled rows that a model learns from, at most (the first by a hash of the id).
SAMPLE_ROWS = 20_000
BINS = 32
ROUNDS = 120
STEP = 0.1
PAIRS = 8
PAIR_BINS = 8
PAIR_ROUNDS = 60
LEAVES = 3
#: Weight of the prior in a leaf, in units of the second derivative.
CALM = 2.0

PREDICT_AT = 0.3

FEATURES = [
    "log_words", "mean_word", "upper", "digits", "symbols", "punctuation", "line_words", "short_lines", "repeated_lines", "distinct_words",
    "distinct_pairs", "same_as_before", "top_word", "symbol_words", "upper_words", "ended_lines", "shouts", "bars", "squeeze",
]

_CLASS = np.zeros((256, 6), dtype=np.int8)
_CLASS[65:91, 0] = 1
_CLASS[48:58, 1] = 1
_CLASS[list(b"#*$%&|<>@~^_=+\\{}[]/"), 2] = 1
_CLASS[list(b".,;:!?'\"()-"), 3] = 1
_CLASS[list(b"!?"), 4] = 1
_CLASS[list(b"|\t"), 5] = 1
_SIZE = (IN_WORD & BEGINS_CHAR).astype(np.int8)


def _kinds(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and number of each distinct value of an owner."""
    _, first, counts = np.unique(mixed(values ^ (owner.astype(np.uint64) * MIX)), return_index=True, return_counts=True)
    return owner[first], counts


def features_of(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text; all 0 for a text without words."""
    words = Words(texts)
    hashes = words.hashes()
    n = (words.last - words.first).astype(np.float64)
    some = np.maximum(n, 1)
    marks = segment_sums(_CLASS[words.data], words.text_starts, words.text_ends)
    chars = np.maximum(segment_sums(_SIZE[words.data], words.text_starts, words.text_ends), 1).astype(np.float64)
    out = np.zeros((len(texts), len(FEATURES)))
    out[:, 0] = np.log1p(n)
    out[:, 1] = chars / some
    out[:, 2:6] = marks[:, :4] / chars[:, None]
    out[:, 16] = marks[:, 4] / some
    out[:, 17] = marks[:, 5] / some
    for i, text in enumerate(texts):
        lines = [line for line in text.split(b"\n") if line.strip()]
        if not lines:
            continue
        out[i, 6] = np.log1p(n[i] / len(lines))
        out[i, 7] = sum(len(line) < 30 for line in lines) / len(lines)
        out[i, 8] = 1 - len(set(lines)) / len(lines)
        out[i, 15] = sum(line.rstrip()[-1:] in b".!?" for line in lines) / len(lines)
        out[i, 18] = len(zlib.compress(text, 1)) / len(text)
    if len(hashes):
        who = words.text
        owner, runs = _kinds(who, hashes)
        out[:, 9] = np.bincount(owner, minlength=len(texts)) / np.sqrt(some)
        most = np.zeros(len(texts))
        np.maximum.at(most, owner, runs)
        out[:, 12] = most / some
        together = who[1:] == who[:-1]
        pairs = mixed(hashes[1:][together] * np.uint64(31) + hashes[:-1][together])
        out[:, 10] = np.bincount(_kinds(who[1:][together], pairs)[0], minlength=len(texts)) / np.maximum(n - 1, 1)
        same = together & (hashes[1:] == hashes[:-1])
        out[:, 11] = np.bincount(who[1:][same], minlength=len(texts)) / some
        inside = _CLASS[words.data[words.inside]]
        has = np.maximum.reduceat(inside[:, 2], words.offsets)
        out[:, 13] = np.bincount(who, weights=has, minlength=len(texts)) / some
        upper = np.add.reduceat(inside[:, 0], words.offsets, dtype=np.int64)
        out[:, 14] = np.bincount(who, weights=(upper >= 2), minlength=len(texts)) / some
    out[n == 0] = 0
    return out


@dataclass
class Additive:
    """Edges of the bins, a table for each feature, and a table for each pair (i, j) over coarser bins."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, k], side="right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -500, 500)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between distinct values, at about equal shares of the rows."""
    values = np.unique(x)
    if len(values) > bins:
        values = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))
        return values
    return (values[1:] + values[:-1]) / 2


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + CALM)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + CALM)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf values over the bins: the best cut, then the best cut of a part, until there are enough leaves."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, -1, -1)
        for p, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
            at = int(gains.argmax())
            if gains[at] > best[0]:
                best = (float(gains[at]), p, a + at + 1)
        if best[1] < 0:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best cross cut of a pair's bins: one cut in each feature, four leaves."""
    cum_g, cum_h = (np.pad(t.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for t in (g, h))
    m, n = g.shape
    best, values = 0.0, np.zeros_like(g)
    if m < 2 or n < 2:
        return best, values
    a, b = np.meshgrid(np.arange(1, m), np.arange(1, n), indexing="ij")

    def quarters(c):
        first, top, left, whole = c[a, b], c[a, n], c[m, b], c[m, n]
        return first, top - first, left - first, whole - top - left + first

    qg, qh = quarters(cum_g), quarters(cum_h)
    gains = sum(_gain(x, y) for x, y in zip(qg, qh, strict=True)) - _gain(cum_g[m, n], cum_h[m, n])
    at = np.unravel_index(int(gains.argmax()), gains.shape)
    i, j = int(a[at]), int(b[at])
    leaf = [_leaf(x[at], y[at]) for x, y in zip(qg, qh, strict=True)]
    values[:i, :j], values[:i, j:], values[i:, :j], values[i:, j:] = leaf
    return float(gains[at]), values


def fit_additive(x: np.ndarray, y: np.ndarray) -> Additive:
    """The model of rows ``x`` and labels ``y`` (0 or 1). The same rows give the same model."""
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model = Additive(float(np.log(share / (1 - share))), [_edges(c, BINS) for c in x.T], [])
    bins = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T, strict=True)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            p = 1 / (1 + np.exp(-total))
            size = len(model.tables[k])
            values = STEP * _tree(np.bincount(b, weights=y - p, minlength=size), np.bincount(b, weights=p * (1 - p), minlength=size), LEAVES)
            model.tables[k] += values
            total += values[b]
    model.pair_edges = [_edges(c, PAIR_BINS) for c in x.T]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.pair_edges, x.T, strict=True)]
    sizes = [len(e) + 1 for e in model.pair_edges]

    def sums(i: int, j: int, w: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[i] * sizes[j] + coarse[j], weights=w, minlength=sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    p = 1 / (1 + np.exp(-total))
    ranked = sorted(((-_pair_tree(sums(i, j, y - p), sums(i, j, p * (1 - p)))[0], i, j) for i, j in combinations(range(x.shape[1]), 2)))[:PAIRS]
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for _, i, j in ranked]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            p = 1 / (1 + np.exp(-total))
            values = STEP * _pair_tree(sums(i, j, y - p), sums(i, j, p * (1 - p)))[1]
            table += values
            total += values[coarse[i], coarse[j]]
    return model


def with_features(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and the array ``features`` of each whole text."""

    def work():
        return lambda texts: {"features": list(features_of(texts))}

    return map_texts(docs, "features array<double>", work, keep=keep)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Additive | None:
    """A model of the documents (doc_id, text) that have a label (doc_id, label 0 or 1). None without any.

    It learns from the ``sample_rows`` first labelled ids by hash: that many ids are broadcast and that
    many rows of features reach the driver. An id with several labels has their largest.
    """
    known = labels.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = stage(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    ids = F.broadcast(chosen.select(F.col("doc_id").alias("_id"), F.col("label").alias("_label")))
    rows = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id"))
    sample = with_features(rows, keep=("doc_id", "_label")).orderBy("doc_id").limit(2 * sample_rows).toPandas()
    if not len(sample):
        return None
    return fit_additive(np.stack(sample["features"].to_numpy()), sample["_label"].to_numpy(np.float64))


def score(docs: DataFrame, model: Additive | None, keep: tuple[str, ...] = ("doc_id",), at: float = PREDICT_AT) -> DataFrame:
    """``keep``, score (0 to 1; higher: label 1 likelier) and predicted (1 if score >= ``at``) of each text.

    Null and empty texts are scored like any other, with all features 0. Without a model all scores are
    0.5. Rows are kept one for one; an empty table gives an empty result.
    """
    if model is None:
        return docs.select(*keep, F.lit(0.5).alias("score"), F.lit(int(at <= 0.5)).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        additive = shared.value
        return lambda texts: {"score": additive.score(features_of(texts))}

    return map_texts(docs, "score double", work, keep=keep).withColumn("predicted", (F.col("score") >= at).cast("int"))
