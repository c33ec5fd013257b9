"""Nearest neighbours by inner product: one navigable small-world graph per shard, results merged.

The vectors are dealt into shards by a hash. Each shard builds a hierarchy of graphs, kept as flat arrays
of neighbour numbers: every vector is on level 0, and each level above holds a random 16th of the one
below. Vectors enter in small batches that search the graph built so far for their neighbours. A search
goes down the levels and keeps a beam of the best vectors seen on level 0. Each shard gives its best for
every query, with exact scores, and the best of all shards are kept.

Inner products are turned into distances by one more component, so that all vectors get the same length
and the nearest is the one with the largest product. That component must not swamp the others, so a shard
has a graph for each band of lengths, in which no vector is more than twice as long as another; a band of
few vectors is scored whole. Equal vectors enter a graph once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerolith.session import stage

#: Distinct vectors of a shard on average, links of a vector on level 0 (half of it above), beams and batch.
SHARD_ROWS = 16_384
#: Queries that one task takes to a shard on average. With more, several tasks build the shard's graph.
QUERY_ROWS = 16_384
LINKS = 32
BUILD_BEAM = 80
SEARCH_BEAM = 192
BATCH = 256
_FANOUT = 16
_EXPAND = 4  # beam entries whose neighbours are looked at in one step


class Graph:
    """A hierarchical small-world graph over the rows of ``x`` (equal lengths; nearness is the inner product)."""

    def __init__(self, x: np.ndarray, seed: int = 0, links: int = LINKS, beam: int = BUILD_BEAM, batch: int = BATCH):
        n = len(x)
        # The last row stands for no vector: it is the farthest from all.
        self.x = np.concatenate([x, np.zeros((1, x.shape[1]), x.dtype)]).astype(np.float32)
        self.none = n
        height = np.random.default_rng(seed).geometric(1 - 1 / _FANOUT, size=n) - 1
        # Tall vectors enter first, so that every level's entry is known from the beginning.
        order = np.argsort(-height, kind="stable")
        self.levels = int(height[order[0]]) + 1
        self.width = [links] + [links // 2] * (self.levels - 1)
        self.near = [np.full((n + 1, w), n, dtype=np.int32) for w in self.width]
        self.entry = int(order[0])
        done = 0
        while done < n:
            size = max(1, min(batch, done, n - done))
            self._insert(order[done : done + size], height, beam)
            done += size

    def _scores(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.einsum("qd,qkd->qk", queries, self.x[nodes])

    def _beam(self, queries: np.ndarray, start: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best nodes and scores of each query on a level, best first. ``start`` has the first nodes of each."""
        q, near, none = len(queries), self.near[level], self.none
        rows = np.arange(q)[:, None]
        seen = np.zeros((q, none + 1), dtype=bool)
        seen[:, none] = True
        nodes = np.full((q, beam), none, dtype=np.int32)
        scores = np.full((q, beam), -np.inf, dtype=np.float32)
        spent = np.ones((q, beam), dtype=bool)
        k = min(start.shape[1], beam)
        nodes[:, :k] = start[:, :k]
        real = nodes[:, :k] != none
        scores[:, :k] = np.where(real, self._scores(queries, nodes[:, :k]), -np.inf)
        spent[:, :k] = ~real
        seen[rows, nodes[:, :k]] = True
        active = np.arange(q)
        step = min(_EXPAND, beam)
        while len(active):
            a = np.arange(len(active))[:, None]
            open_scores = np.where(spent[active], -np.inf, scores[active])
            pick = np.argpartition(-open_scores, step - 1, axis=1)[:, :step] if step < beam else np.argsort(-open_scores, axis=1)
            alive = np.take_along_axis(open_scores, pick, axis=1) > -np.inf
            still = alive.any(axis=1)
            if not still.all():
                active, pick, alive = active[still], pick[still], alive[still]
                a = np.arange(len(active))[:, None]
                if not len(active):
                    break
            chosen = np.where(alive, nodes[active[:, None], pick], none)
            spent[active[:, None], pick] = True
            found = near[chosen].reshape(len(active), -1)
            found[seen[active[:, None], found]] = none
            # the same node may come from two entries: keep it once
            found.sort(axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = none
            seen[active[:, None], found] = True
            fresh = np.where(found != none, self._scores(queries[active], found), -np.inf).astype(np.float32)
            all_nodes = np.concatenate([nodes[active], found], axis=1)
            all_scores = np.concatenate([scores[active], fresh], axis=1)
            all_spent = np.concatenate([spent[active], found == none], axis=1)
            best = np.argpartition(-all_scores, beam - 1, axis=1)[:, :beam]
            nodes[active] = all_nodes[a, best]
            scores[active] = all_scores[a, best]
            spent[active] = all_spent[a, best]
        by_score = np.argsort(-scores, axis=1, kind="stable")
        return np.take_along_axis(nodes, by_score, axis=1), np.take_along_axis(scores, by_score, axis=1)

    def _descend(self, queries: np.ndarray, level: int) -> np.ndarray:
        start = np.full((len(queries), 1), self.entry, dtype=np.int32)
        for up in range(self.levels - 1, level, -1):
            start = self._beam(queries, start, up, 8)[0][:, :4]
        return start

    def _spread(self, nodes: np.ndarray, scores: np.ndarray, width: int) -> np.ndarray:
        """Up to ``width`` of the candidates of each owner: those nearer to it than to any chosen before, then the nearest others."""
        vectors = self.x[nodes]
        between = np.einsum("qid,qjd->qij", vectors, vectors)
        real = nodes != self.none
        taken = np.zeros(nodes.shape, dtype=bool)
        closest = np.full(nodes.shape, -np.inf, dtype=np.float32)  # to a chosen one
        for i in range(nodes.shape[1]):
            good = real[:, i] & (scores[:, i] >= closest[:, i]) & (taken.sum(axis=1) < width)
            taken[good, i] = True
            closest[good] = np.maximum(closest[good], between[good, i])
        rank = np.where(taken, 0, np.where(real, 1, 2))
        order = np.argsort(rank, axis=1, kind="stable")[:, :width]
        out = np.take_along_axis(np.where(real, nodes, self.none), order, axis=1)
        if out.shape[1] < width:
            out = np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=self.none)
        return out.astype(np.int32)

    def _insert(self, batch: np.ndarray, height: np.ndarray, beam: int) -> None:
        if len(batch) == 1 and batch[0] == self.entry:
            return
        x = self.x[batch]
        among = x @ x.T
        np.fill_diagonal(among, -np.inf)
        for level in range(int(height[batch].max()), -1, -1):
            on = np.flatnonzero(height[batch] >= level)
            members, queries = batch[on], x[on]
            nodes, scores = self._beam(queries, self._descend(queries, level), level, beam)
            # vectors of the batch do not see each other in the graph
            k = min(len(on), 2 * self.width[level])
            peers = np.argsort(-among[np.ix_(on, on)], axis=1)[:, :k]
            peer_nodes = np.where(peers == np.arange(len(on))[:, None], self.none, members[peers]).astype(np.int32)
            nodes = np.concatenate([nodes, peer_nodes], axis=1)
            scores = np.concatenate([scores, np.where(peer_nodes == self.none, -np.inf, np.take_along_axis(among[np.ix_(on, on)], peers, axis=1))], axis=1)
            order = np.argsort(-scores, axis=1, kind="stable")[:, :beam]
            nodes, scores = np.take_along_axis(nodes, order, axis=1), np.take_along_axis(scores, order, axis=1)
            chosen = self._spread(nodes, scores, self.width[level])
            self.near[level][members] = chosen
            self._link_back(level, np.repeat(members, chosen.shape[1]), chosen.ravel())

    def _link_back(self, level: int, sources: np.ndarray, targets: np.ndarray) -> None:
        """Adds each source to its target's neighbours; a full list keeps a well spread choice."""
        real = targets != self.none
        sources, targets = sources[real], targets[real]
        if not len(targets):
            return
        order = np.argsort(targets, kind="stable")
        sources, targets = sources[order], targets[order]
        owners, first, counts = np.unique(targets, return_index=True, return_counts=True)
        near, width = self.near[level], self.width[level]
        incoming = np.full((len(owners), int(counts.max())), self.none, dtype=np.int32)
        incoming[np.repeat(np.arange(len(owners)), counts), np.arange(len(targets)) - np.repeat(first, counts)] = sources
        nodes = np.concatenate([near[owners], incoming], axis=1)
        nodes.sort(axis=1)
        nodes[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = self.none
        nodes.sort(axis=1)
        full = (nodes != self.none).sum(axis=1) > width
        near[owners[~full]] = nodes[~full][:, :width]
        for part in np.array_split(np.flatnonzero(full), max(1, int(full.sum()) // 512)):
            if len(part):
                some = nodes[part]
                scores = np.where(some != self.none, self._scores(self.x[owners[part]], some), -np.inf)
                by_score = np.argsort(-scores, axis=1, kind="stable")[:, : 3 * width]
                some, scores = np.take_along_axis(some, by_score, axis=1), np.take_along_axis(scores, by_score, axis=1)
                near[owners[part]] = self._spread(some, scores, width)

    def search(self, queries: np.ndarray, beam: int = SEARCH_BEAM, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and scores of each query, best first; the number ``none`` fills up where there are fewer."""
        beam = min(beam, self.none)
        parts = [self._beam(q, self._descend(q, 0), 0, beam) for q in np.array_split(queries.astype(np.float32), max(1, -(-len(queries) // batch)))]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id and v (array of double) of the vectors that take part: not null or zero, all components finite."""
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda c: c != 0))


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return pc.list_flatten(column).to_numpy().reshape(len(column), -1)


def _bands(lengths: np.ndarray) -> list[np.ndarray]:
    """Numbers of the vectors, in bands from the longest on: none is shorter than half the longest of its band."""
    order = np.argsort(-lengths, kind="stable")
    ordered, bands, start = lengths[order], [], 0
    while start < len(order):
        end = int(np.searchsorted(-ordered, -ordered[start] / 2, side="right"))
        bands.append(np.sort(order[start:end]))
        start = end
    return bands


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (none zero) at length 1, and their lengths over the largest component of all. Neither overflows."""
    most = np.abs(x).max(axis=1)
    scaled = x / most[:, None]
    norms = np.sqrt((scaled * scaled).sum(axis=1))
    return scaled / norms[:, None], most / most.max() * norms


def _found(x: np.ndarray, queries: np.ndarray, beam: int) -> list[np.ndarray]:
    """For each query the numbers of the vectors of ``x`` that graphs over them find (all of a band with no more than the beam)."""
    units, lengths = _units(x)
    directions = np.hstack([_units(queries)[0], np.zeros((len(queries), 1))])
    whole, parts = [], []
    for band in _bands(lengths):
        if len(band) <= beam:
            whole.append(band)
            continue
        longest = lengths[band].max()
        share = lengths[band] / longest if longest > 0 else np.ones(len(band))
        extra = np.sqrt(np.maximum(1.0 - share * share, 0.0))
        graph = Graph(np.hstack([units[band] * share[:, None], extra[:, None]]))
        nodes, _ = graph.search(directions, beam)
        parts.append([band[n[n != graph.none]] for n in nodes])
    return [np.concatenate([*whole, *(p[i] for p in parts)]) for i in range(len(queries))]


def search(vectors: DataFrame, query_divisor: int, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` found for each row whose id is a multiple of ``query_divisor``.

    Nearness is the inner product of the original vectors in double precision, ties go to the smaller id.
    A query is no candidate of its own; other rows with its vector are. All other rows are candidates, so
    there are fewer than ``k`` only if the table has no more. Vectors that are null, zero or not finite
    take part in nothing, nor do rows without an id. Rows that repeat an id are candidates each; the id asks once, with its smallest
    vector. An empty table gives an empty result. Vectors of different lengths are an error.

    Equal vectors are one node of a graph. Of the rows behind it only the ``k + 1`` smallest ids can be
    among the ``k`` nearest of any query, so no others are carried.
    """
    rows = stage(usable(vectors, vec_id, embedding))
    facts = rows.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if facts["least"] != facts["most"]:
        raise ValueError(f"vectors of {facts['least']} and {facts['most']} components")
    # Ranked within tasks first: of a vector that many rows share, a task hands on k + 1 at most.
    of_vector = W.partitionBy("v").orderBy("id")
    first = rows.withColumn("_n", F.row_number().over(of_vector)).filter(F.col("_n") <= k + 1)
    distinct = stage(first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    queries = stage(rows.filter(F.pmod("id", F.lit(query_divisor)) == 0).groupBy("id").agg(F.min("v").alias("v")))
    shards = max(1, -(-distinct.count() // shard_rows))
    slots = max(1, -(-queries.count() // query_rows))

    everywhere = F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))
    base = distinct.select(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), everywhere.alias("slot"), F.lit(None).cast("long").alias("id"), "ids", "v")
    to_all = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asked = queries.select(to_all.alias("shard"), F.pmod(F.xxhash64("id"), F.lit(slots)).cast("int").alias("slot"), "id", F.lit(None).cast("array<bigint>").alias("ids"), "v")

    def run(group: pa.Table) -> pa.Table:
        asks = pc.is_valid(group.column("id"))
        vectors, wanted = group.filter(pc.invert(asks)).combine_chunks(), group.filter(asks).combine_chunks()
        columns: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(vectors) and len(wanted):
            x, q = _flat(vectors.column("v")), _flat(wanted.column("v"))
            ids = vectors.column("ids").to_pylist()
            order = np.lexsort(x.T[::-1])  # the same graph whatever order the rows arrive in
            x, ids = x[order], [ids[i] for i in order]
            for name, vector, found in zip(wanted.column("id").to_pylist(), q, _found(x, q, max(beam, 2 * k)), strict=True):
                scores = x[found] @ vector
                hits = sorted((-s, i) for s, n in zip(scores.tolist(), found.tolist(), strict=True) for i in ids[n] if i != name)[:k]
                columns["query_id"] += [name] * len(hits)
                columns["vec_id"] += [i for _, i in hits]
                columns["score"] += [-s for s, _ in hits]
        return pa.table({"query_id": pa.array(columns["query_id"], pa.int64()), "vec_id": pa.array(columns["vec_id"], pa.int64()), "score": pa.array(columns["score"], pa.float64())})

    found = base.unionByName(asked).groupBy("shard", "slot").applyInArrow(run, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
