"""SimHash near-duplicates over an inverted index of positional fingerprint bytes, with count filtering.

Two fingerprints that differ in at most ``k`` bits differ in at most ``k`` of their 8 bytes, so at least
``8 - k`` bytes at the same positions are shared. The bytes are put in blocks, so many that some blocks
are whole in every such pair; the index holds a fingerprint under each choice of blocks (for two bits: six
postings of four positional bytes). In a posting the shared positional bytes of each pair are tallied,
pairs below the guaranteed minimum are dropped, the others are verified by their differing bits. A
pair counts in the first of its postings only.

Postings of single bytes would hold a 256th of all fingerprints each, and a tally over their pairs grows
with the square of the corpus. A posting with very many fingerprints (thousands of near copies) is dealt
out anew under the guaranteed minimum of bytes, where it is bounded. Only distinct fingerprints are
indexed, so copies of a text cost one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerolith.llm.common import map_texts
from aerolith.session import discard, stage

SEED = 42
SHINGLE = 3
MOST_BITS = 2

#: Fewest bytes of a posting's key.
_KEY_BYTES = 4
#: Postings with more fingerprints are dealt out anew.
CROWD = 4096
#: Up to this many fingerprints of a posting are tallied one with another. Beyond it every fingerprint looks up
#: its neighbours within the bytes that are not in the key.
_COMPARED = 512


def fingerprints_of(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text: bit i is set if it is set in over half of the shingle hashes."""
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    out = np.zeros(len(texts), dtype=np.uint64)
    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        if len(words) < shingle:
            hashes = np.array([digest(b" ".join(words))], dtype=np.uint64)
        else:
            grams = map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False))
            hashes = np.fromiter(map(digest, grams), dtype=np.uint64, count=len(words) - shingle + 1)
        counts = np.zeros(64, dtype=np.int64)
        for a in range(0, len(hashes), 1 << 14):
            bits = np.unpackbits(hashes[a : a + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.uint16).astype(np.int64)
        out[i] = np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep`` and fp (the fingerprint as a signed long). Null and wordless texts have 0."""

    def work():
        return lambda texts: {"fp": fingerprints_of(texts, shingle).view(np.int64)}

    return map_texts(docs, "fp long", work, keep=("doc_id", *keep))


def key_choices(most: int) -> list[tuple[int, ...]]:
    """Choices of bytes to file a fingerprint under: any pair within ``most`` bits agrees on all bytes of one choice.

    The 8 bytes are cut into ``most + j`` blocks, of which j are whole in such a pair; j is the least that
    gives keys of ``_KEY_BYTES``.
    """
    if not 0 <= most < 8:
        raise ValueError("most is from 0 to 7")
    for j in range(1, 9 - most):
        blocks = [tuple(int(x) for x in part) for part in np.array_split(np.arange(8), most + j)]
        choices = [tuple(sorted(sum(c, ()))) for c in combinations(blocks, j)]
        if min(map(len, choices)) >= _KEY_BYTES or j == 8 - most:
            return choices
    raise AssertionError


def _mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << 8 * p for p in positions)


def _signed(mask: int) -> int:
    return int(np.array(mask, dtype=np.uint64).view(np.int64))


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Number of zero bytes of each xor: positions at which a pair agrees."""
    return (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def posting_links(fps: np.ndarray, mask: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within one posting: distinct ascending fingerprints that agree in the bits of ``mask``."""
    if len(fps) <= _COMPARED:
        a, b = np.triu_indices(len(fps), 1)
    else:
        bits = [np.uint64(1 << i) for i in range(64) if not mask >> i & 1]
        found = []
        for n in range(1, most + 1):
            for choice in combinations(bits, n):
                other = fps ^ sum(choice, np.uint64(0))
                at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
                hit = np.flatnonzero((fps[at] == other) & (fps < other))
                found.append((hit, at[hit]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
    return _verified(fps[a], fps[b], most)


def _verified(x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose tally reaches the guaranteed minimum and whose differing bits are few enough."""
    differ = x ^ y
    tallied = shared_bytes(differ) >= 8 - most
    x, y, differ = x[tallied], y[tallied], differ[tallied]
    near = np.bitwise_count(differ) <= most
    return x[near], y[near]


def _links_of(keys: np.ndarray, fps: np.ndarray, masks: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole postings that lie one after another. keys: (choice of bytes, the bytes)."""
    new = np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(fps))
    sizes, left, right, choice = ends - starts, [], [], []
    for size in range(2, 9):  # small postings, all of one size at once
        at = starts[sizes == size]
        for i, j in combinations(range(size), 2):
            if len(at):
                left.append(fps[at + i])
                right.append(fps[at + j])
                choice.append(keys[at, 0])
    x, y, c = (np.concatenate(v) if v else np.zeros(0, t) for v, t in ((left, np.uint64), (right, np.uint64), (choice, np.int64)))
    differ = x ^ y
    tallied = shared_bytes(differ) >= 8 - most
    x, y, c = x[tallied], y[tallied], c[tallied]
    x, y, c = (v[np.bitwise_count(x ^ y) <= most] for v in (x, y, c))
    parts = [(x, y, c)]
    for a, b in zip(starts[sizes > 8], ends[sizes > 8], strict=True):
        x, y = posting_links(fps[a:b], masks[int(keys[a, 0])], most)
        parts.append((x, y, np.full(len(x), keys[a, 0])))
    x, y, c = (np.concatenate(v) for v in zip(*parts, strict=True))
    first = np.ones(len(x), dtype=bool)
    for k, mask in enumerate(masks):  # a pair counts in the first choice it agrees on
        first &= (c <= k) | ((x ^ y) & np.uint64(mask) != 0)
    return x[first], y[first]


def _linked(dealt: DataFrame, masks: list[int], most: int) -> DataFrame:
    """Links of postings (c, key, fp), each whole in one task."""
    dealt = dealt.repartition("c", "key").sortWithinPartitions("c", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)

        def flush(keys, values):
            order = np.lexsort((values, keys[:, 1], keys[:, 0]))
            x, y = _links_of(keys[order], values[order], masks, most)
            return pa.RecordBatch.from_pydict({"a": np.minimum(x.view(np.int64), y.view(np.int64)), "b": np.maximum(x.view(np.int64), y.view(np.int64))})

        for batch in batches:
            keys = np.stack([batch.column("c").to_numpy().astype(np.int64), batch.column("key").to_numpy()], axis=1)
            keys = np.concatenate([held_keys, keys])
            values = np.concatenate([held, batch.column("fp").to_numpy().view(np.uint64)])
            whole = np.flatnonzero((keys != keys[-1]).any(axis=1))
            cut = int(whole[-1]) + 1 if len(whole) else 0  # the last posting may go on in the next batch
            if cut:
                yield flush(keys[:cut], values[:cut])
            held_keys, held = keys[cut:], values[cut:]
        if len(held):
            yield flush(held_keys, held)

    return dealt.mapInArrow(run, "a long, b long")


def _filed(fps: DataFrame, masks: list[int]) -> DataFrame:
    entries = [F.struct(F.lit(c).cast("short").alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"), F.col("fp")) for c, m in enumerate(masks)]
    return fps.select(F.explode(F.array(*entries)).alias("p")).select("p.c", "p.key", "p.fp")


def near_links(fps: DataFrame, most: int = MOST_BITS, crowd: int = CROWD) -> DataFrame:
    """All pairs (a, b) of distinct fingerprints (column fp) that differ in at most ``most`` bits.

    Postings with more than ``crowd`` fingerprints are found by a count; their fingerprints go to postings
    of ``8 - most`` bytes instead, which hold 2 ** (8 * most) at most, so a large group of near copies is
    spread over tasks. Pairs of those may be listed more than once, the others once.
    """
    masks = [_mask(c) for c in key_choices(most)]
    filed = _filed(fps, masks)
    crowded = stage(filed.groupBy("c", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("c", "key"))
    if crowded.isEmpty():
        discard(crowded)
        return _linked(filed, masks, most)
    finest = [_mask(c) for c in combinations(range(8), 8 - most)]
    dense = filed.join(crowded, ["c", "key"], "left_semi").select("fp").distinct()
    return _linked(filed.join(crowded, ["c", "key"], "left_anti"), masks, most).union(_linked(_filed(dense, finest), finest, most))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node it can reach.

    Every round hooks each root to the smallest root next to it, follows the hooks to their ends and
    keeps the links between different roots; these at least halve in nodes every other round. Each
    round is written to the shared folder, so a lost executor costs one round at most.
    """
    links = stage(links.distinct())
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = stage(nodes.withColumn("root", F.col("node")))
    open_links = links
    while not open_links.isEmpty():
        both = open_links.union(open_links.select("b", "a"))
        hooks = stage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")))
        while True:
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            higher = stage(hooks.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), (F.coalesce("top", "up") < F.col("up")).alias("_moved")))
            moved = not higher.filter("_moved").isEmpty()
            discard(hooks)
            hooks = higher
            if not moved:
                break
        up = hooks.select(F.col("node").alias("root"), "up")
        renamed = stage(labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        ends = hooks.select("node", "up")
        moved_links = open_links.join(ends.toDF("a", "ua"), "a", "left").join(ends.toDF("b", "ub"), "b", "left")
        next_links = stage(moved_links.select(F.coalesce("ua", "a").alias("a"), F.coalesce("ub", "b").alias("b")).filter("a <> b").distinct())
        discard(labels, open_links, hooks)
        labels, open_links = renamed, next_links
    discard(open_links)
    return labels


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST_BITS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, fp, root (smallest fingerprint of the group) and component_id: the smallest doc_id that links can reach.

    ``docs`` needs doc_id and text; columns not in ``keep`` are not read. Rows with equal fingerprints
    belong together, also the rows with fingerprint 0 (null, empty and blank texts). Repeated rows come
    out as often as they go in. A null doc_id never names a component unless no other id is in it.
    An empty table gives an empty result.
    """
    marks = stage(fingerprints(docs, shingle, keep))
    distinct = stage(marks.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(distinct.select("fp"), most)).withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marks.join(named.join(ids, "root").select("fp", "root", "component_id"), "fp").select("doc_id", *keep, "fp", "root", "component_id")


def hex_fingerprint(column: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """One document of each group, the one with the smallest id, with the columns of ``docs``.

    Rows without an id come last in their group, rows that share an id go by the hash of their text.
    Of rows equal in both, one stays.
    """
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("_text"), F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    # One key for the join and for what follows it, so that the texts move once.
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("_text").cast("string")).alias("_key")
    groups = near_duplicates(marked, keep=("_text",), **settings)
    first = groups.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("late"), F.col("doc_id").alias("id"), F.col("_text").alias("hash"))).alias("first"))
    kept = stage(first.select(F.col("first.id").alias("doc_id"), F.col("first.hash").alias("_text")).select(key))
    rows = marked.select(key, "_row").join(kept, "_key", "left_semi")
    others = [F.col("_row").getField(c) for c in docs.columns if c not in ("doc_id", "text")]
    among = W.partitionBy("_key").orderBy(*others, "_key")
    return rows.withColumn("_n", F.row_number().over(among)).filter("_n = 1").select("_row.*")
