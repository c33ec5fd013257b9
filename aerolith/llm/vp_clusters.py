"""Centroid clustering: Lloyd rounds whose assignment searches a vantage-point tree over the centroids.

Vectors and centroids are integers, so distances, sums and means are exact and every run agrees. Each
round the tree is built anew from the centroids and broadcast (clusters x components long integers, see
``MOST_VALUES``). A task searches it best first for its vectors; it adds up its vectors by cluster, and
only these sums are shuffled, so a cluster with a third of all rows is no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.int_vectors import SUMS, column_sums, fits_long, matrix, merged_sums, scaled, task_sums
from aerolith.session import discard, stage

#: Centroids that one leaf of the tree holds at most.
LEAF = 4
#: Bound on clusters x components, hence on what a round broadcasts (8 bytes each) and what reaches the driver.
MOST_VALUES = 1 << 24
#: Vectors x nodes of the tree whose bounds a task holds at a time.
_CELLS = 1 << 20
#: Distances are searched in doubles; a bound must exceed the radius by more than their rounding to cut.
_SLACK = 1e-9


#: More than any squared distance.
_FAR = 1 << 200


def squared(x: np.ndarray, c: np.ndarray, wide: bool = False) -> np.ndarray:
    """Exact squared distances of rows x to rows c: int64, or Python integers if ``wide``."""
    if wide:
        x, c = x.astype(object), c.astype(object)
    else:
        top = max((abs(int(v)) for a in (x, c) if a.size for v in (a.min(), a.max())), default=0)
        if 4 * top * top * x.shape[1] < 1 << 53:  # every product and sum is a whole number that doubles hold
            a, b = x.astype(np.float64), c.astype(np.float64)
            return ((a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


class VantageTree:
    """Centroids in a tree of flat arrays. An inner node has a vantage point and two halves by distance from it.

    ``point``: the vantage point of an inner node, -1 for a leaf; ``child``: its two nodes; ``near``/``far``: least
    and largest distance of each half's centroids from the vantage point; ``held``: centroids of a leaf.
    """

    def __init__(self, centroids: np.ndarray, leaf: int = LEAF):
        self.centroids = centroids
        self.wide = beyond(centroids).any()
        self.point: list[int] = []
        self.child: list[tuple[int, int]] = []
        self.near: list[tuple[float, float]] = []
        self.far: list[tuple[float, float]] = []
        self.held: list[np.ndarray] = []
        waiting = [(np.arange(len(centroids)), None)]
        while waiting:
            members, parent = waiting.pop()
            here = len(self.point)
            if parent is not None:
                above, side = parent
                self.child[above] = (here, self.child[above][1]) if side == 0 else (self.child[above][0], here)
            self.child.append((-1, -1))
            self.near.append((0.0, 0.0))
            self.far.append((0.0, 0.0))
            if len(members) <= leaf:
                self.point.append(-1)
                self.held.append(members)
                continue
            vantage = self._vantage(members)
            rest = members[members != vantage]
            away = np.sqrt(squared(centroids[rest], centroids[[vantage]], self.wide)[:, 0].astype(np.float64))
            order = np.argsort(away, kind="stable")
            halves = np.array_split(order, 2)
            self.point.append(vantage)
            self.held.append(members[:0])
            self.near[here] = tuple(float(away[h[0]]) for h in halves)
            self.far[here] = tuple(float(away[h[-1]]) for h in halves)
            waiting += [(rest[h], (here, side)) for side, h in enumerate(halves)]

    def _vantage(self, members: np.ndarray) -> int:
        """The member farthest from the first one: edge points part the rest best."""
        return int(members[np.argmax(squared(self.centroids[members], self.centroids[members[:1]], self.wide)[:, 0])])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid of each row and its exact squared distance; of equals the smaller number.

        Distances are int64, or Python integers if any of them needs more than 64 bits on its way.
        """
        wide = beyond(x) | self.wide
        if not wide.any():
            return self._blocks(x, False)
        best, distance = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=object)
        for part, big in ((np.flatnonzero(wide), True), (np.flatnonzero(~wide), False)):
            if len(part):
                best[part], distance[part] = self._blocks(x[part], big)
        return best, distance

    def _blocks(self, x: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
        rows = max(1, _CELLS // len(self.point))
        parts = [self._search(x[a : a + rows], wide) for a in range(0, len(x), rows)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, x: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
        """Best-first branch and bound, all rows side by side; each row goes its own way through the tree.

        A row visits its open node with the smallest lower bound. It is done when that bound is above the
        distance of its best centroid; a bound equal to it is still visited, so no tie is missed.
        """
        n = len(x)
        bound = np.full((n, len(self.point)), np.inf)
        bound[:, 0] = 0.0
        best = np.full(n, len(self.centroids), dtype=np.int64)
        found = np.full(n, _FAR, dtype=object) if wide else np.full(n, np.iinfo(np.int64).max)
        radius = np.full(n, np.inf)

        def meet(rows: np.ndarray, members: np.ndarray) -> np.ndarray:
            exact = squared(x[rows], self.centroids[members], wide)
            for d, c in zip(exact.T, members, strict=True):
                less = ((d < found[rows]) | ((d == found[rows]) & (c < best[rows]))).astype(bool)
                better = rows[less]
                best[better], found[better], radius[better] = c, d[less], np.sqrt(d[less].astype(np.float64))
            return np.sqrt(exact[:, 0].astype(np.float64))

        rows_left = np.arange(n)
        while len(rows_left):
            node = bound[rows_left].argmin(axis=1)
            least = bound[rows_left, node]
            go = np.isfinite(least) & (least <= radius[rows_left] * (1 + _SLACK))
            rows_left, node = rows_left[go], node[go]
            order = np.argsort(node, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(node[order])) + 1) if len(order) else ():
                at, rows = int(node[group[0]]), rows_left[group]
                below = bound[rows, at]
                bound[rows, at] = np.inf
                if self.point[at] < 0:
                    meet(rows, self.held[at])
                    continue
                away = meet(rows, np.array([self.point[at]]))
                for side in (0, 1):
                    lo, hi = self.near[at][side], self.far[at][side]
                    bound[rows, self.child[at][side]] = np.maximum(below, np.maximum(away - hi, lo - away) - _SLACK * (away + hi))
        return best, found


def beyond(x: np.ndarray) -> np.ndarray:
    """Rows with a component so large that a squared distance might not fit in 64 bits."""
    return (np.abs(x.astype(np.float64)) > np.sqrt(float(1 << 62) / (4 * max(x.shape[1], 1)))).any(axis=1)


def _rows(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, matrix(batch.column(batch.num_columns - 1), dims)


def first_centroids(rows: DataFrame, clusters: int, id: str, salt: str) -> np.ndarray:
    """The vectors with the smallest hashes of ``salt:id``, in order of the hash (of equal ids: of the vector)."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)
    return np.array([r.x for r in rows.select(key.alias("key"), "x").orderBy("key", "x").limit(clusters).collect()], dtype=np.int64)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floor of the mean of each one's vectors; one without vectors stays."""
    dims = centroids.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(VantageTree(centroids))

    def run(batches):
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for _, x in _rows(batches, dims):
            cluster = shared.value.nearest(x)[0]
            order = np.argsort(cluster, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
                c = int(cluster[part[0]])
                n, held = sums.get(c, (0, 0))
                sums[c] = n + len(part), held + column_sums(x[part])
        yield from task_sums(sums)

    found = merged_sums(rows.select("x").mapInArrow(run, SUMS))
    shared.destroy()
    out = centroids.copy()
    for c, (n, sums) in found.items():
        out[c] = [s // n for s in sums]
    return out


def cluster(vectors: DataFrame, clusters: int, rounds: int, dims: int, scale: int = 256, id: str = "vec_id", vector: str = "embedding", salt: str = "2") -> DataFrame:
    """``id``, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part.

    Vectors with exactly ``dims`` components, none null or non-finite, take part; each component becomes
    floor(scale * component). The first centroids are the vectors with the smallest sha256 of
    ``salt:id`` (fewer vectors than ``clusters``: all of them). ``rounds`` times, vectors go to the nearest
    centroid (of equals the smaller number) and centroids to the floor of their vectors' mean; then
    vectors are assigned once more.

    Repeated rows count as often as they come. A null id hashes as an empty one and comes back as null.
    Equal centroids: the first one gets the vectors, the others stay. A distance or inertia that a long
    cannot hold is null (components above 2 ** 27 or so). An empty table gives an empty result. Other
    columns are not read, whatever their names.
    """
    if clusters * dims > MOST_VALUES:
        raise ValueError(f"clusters x dims is bounded by {MOST_VALUES}")
    spark = vectors.sparkSession
    rows = stage(scaled(vectors, id, vector, scale, dims))
    centroids = first_centroids(rows, clusters, id, salt)
    schema = "cluster int, distance long"
    if not len(centroids):
        return rows.select(id, *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    shared = spark.sparkContext.broadcast(VantageTree(centroids))

    def run(batches):
        for batch, x in _rows(batches, dims):
            best, distance = shared.value.nearest(x)
            held = pa.array([fits_long(d) for d in distance], pa.int64()) if distance.dtype == object else pa.array(distance)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), held], names=["id", "cluster", "distance"])

    kind = rows.schema[id].dataType.simpleString()
    final = stage(rows.select(F.col(id).alias("id"), "x").mapInArrow(run, f"id {kind}, {schema}"))
    discard(rows)
    shared.destroy()
    by = final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"), F.count_if(F.isnull("distance")).alias("lost")).collect()
    total = None if any(r.lost for r in by) else fits_long(sum(int(r["sum"]) for r in by))
    facts = [(r.cluster, None if r.lost else fits_long(int(r["sum"])), total, hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in by]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row for each cluster
    return final.join(F.broadcast(known), "cluster").select(F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
