"""Random forests whose cost follows the rows and not the number of nodes.

Spark ML sums the statistics of every node over every partition; deep trees have very many nodes of few rows. Here only
nodes of more than ``GROUP_ROWS`` rows are split from summed statistics. Smaller ones get their rows, as one byte a column, in one
place each and are finished there, so a group never holds more. The result is a model of Spark ML.

Rows are kept by column, three bins in two bytes. A node counts only the columns it may be split by; where those are all columns, the
larger child of a node is what the smaller one leaves of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import ceil, factorial, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.session import delete_path, discard, shared_dir, stage

#: Values of a column that splits tell apart.
BINS = 32
#: Most rows (repeats of the bootstrap included) of a node that is finished in one place.
GROUP_ROWS = 1 << 20
#: Rows a node must have on average for its histograms to be taken from its parent's.
DERIVE_ROWS = 1 << 12
#: Rows of neighbouring nodes that are split further together.
PIECE_ROWS = 1 << 15
#: Rows of a block.
BLOCK_ROWS = 1 << 16
#: Gains that differ by no more than this share are equal.
_EQUAL = 1e-9
#: Gains below this share of a node's squares are rounding.
_NOTHING = 1e-12

_BLOCK = "start long, bins binary, y binary"
_NODE = "tree int, node long, feature int, bin int, gain double, n double, s double, ss double"
_NAMES = ["tree", "node", "feature", "bin", "gain", "n", "s", "ss"]
_CHANCES = np.cumsum([np.exp(-1.0) / factorial(i) for i in range(18)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _drawn(ids: np.ndarray, *salt: int | np.ndarray) -> np.ndarray:
    """Numbers from 0 to 1 that depend on the ids and the salt only."""
    x = ids.astype(np.uint64)
    for part in salt:
        x = _mixed(x + (np.atleast_1d(part).astype(np.int64) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def repeats(ids: np.ndarray, tree: int, seed: int, bootstrap: bool) -> np.ndarray:
    """How often a tree sees each row."""
    return np.searchsorted(_CHANCES, _drawn(ids, seed, tree), side="right").astype(np.uint8) if bootstrap else np.ones(len(ids), dtype=np.uint8)


def columns_per_split(subset: str, columns: int) -> int:
    if subset == "all":
        return columns
    named = {"onethird": columns / 3, "auto": columns / 3, "sqrt": sqrt(columns), "log2": max(1.0, log2(columns))}
    asked = named[subset] if subset in named else float(subset) * (columns if float(subset) <= 1.0 and "." in subset else 1)
    return max(1, min(columns, ceil(asked)))


def allowed_columns(nodes: np.ndarray, tree: int, seed: int, chosen: int, columns: int) -> np.ndarray:
    """nodes x columns: which columns a node may be split by."""
    if chosen == columns:
        return np.ones((len(nodes), columns), dtype=bool)
    draws = np.stack([_drawn(nodes, seed, tree, c + 1) for c in range(columns)], axis=1)
    return draws.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable") < chosen


def _slots(allowed: np.ndarray) -> np.ndarray:
    """chosen x nodes: the columns each node may be split by, in order."""
    return np.nonzero(allowed)[1].reshape(len(allowed), -1).T


def _packed(x: np.ndarray) -> np.ndarray:
    """columns x rows of bins, three columns in 16 bits."""
    words = np.zeros((-(-len(x) // 3), x.shape[1]), dtype=np.uint16)
    for c, column in enumerate(x):
        words[c // 3] |= column.astype(np.uint16) << np.uint16(5 * (c % 3))
    return words


def _unpacked(words: np.ndarray, columns: int) -> np.ndarray:
    x = np.empty((columns, words.shape[1]), dtype=np.uint8)
    for c in range(columns):
        x[c] = words[c // 3] >> np.uint16(5 * (c % 3)) & np.uint16(BINS - 1)
    return x


def _histograms(x: np.ndarray, at: np.ndarray, w: np.ndarray | None, wy: np.ndarray, slots: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """slots x 2 x nodes x bins: counts and sums. ``at`` and the weights are those of ``rows`` (all if None); no ``w``: all weights are 1.

    A few rows at a time, whose numbers stay in the processor's cache.
    """
    m = slots.shape[1]
    out, flat = np.zeros((len(slots), 2, m, BINS)), x.ravel()
    same, first = (slots == slots[:, :1]).all(axis=1), slots * x.shape[1]
    step = max(PIECE_ROWS, 4 * m * BINS)
    for a in range(0, len(at), step):
        part = slice(a, a + step)
        here, sums = at[part], wy[part]
        weights = None if w is None else w[part]
        places = np.arange(a, a + len(here)) if rows is None else rows[part]
        base = here * BINS
        for k in range(len(slots)):
            if not same[k]:
                cell = flat.take(first[k].take(here) + places)
            else:
                cell = x[slots[k, 0], part] if rows is None else x[slots[k, 0]].take(places)
            cell = base + cell
            out[k, 0] += np.bincount(cell, weights, m * BINS).reshape(m, BINS)
            out[k, 1] += np.bincount(cell, sums, m * BINS).reshape(m, BINS)
    return out


def _best_bin(n: np.ndarray, s: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From counts and sums (nodes x bins): best last bin of the left side, its gain over all rows, rows on the left."""
    n, s = n.cumsum(axis=1), s.cumsum(axis=1)
    whole = s[:, -1] ** 2 / np.maximum(n[:, -1], 1.0)
    left, right = n[:, :-1], n[:, -1:] - n[:, :-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = s[:, :-1] ** 2 / left + (s[:, -1:] - s[:, :-1]) ** 2 / right - whole[:, None]
    gain = np.where((left >= max(least, 1)) & (right >= max(least, 1)) & (gain > _NOTHING * whole[:, None]), gain, -np.inf)
    at, rows = gain.argmax(axis=1), np.arange(len(gain))
    return at, gain[rows, at], left[rows, at]


@dataclass
class _Best:
    """The best split of each node so far; of equal gains that of a column drawn by tree and node.

    Deep nodes hold few rows, which many columns part equally well; no column may win there by its place.
    """

    nodes: np.ndarray
    tree: int
    seed: int
    feature: np.ndarray = field(init=False)

    def __post_init__(self):
        m = len(self.nodes)
        self.feature, self.bin = np.full(m, -1), np.zeros(m, dtype=np.int64)
        self.gain, self.left, self.draw = np.full(m, -np.inf), np.zeros(m), np.ones(m)

    def offer(self, columns: np.ndarray, n: np.ndarray, s: np.ndarray, least: int) -> None:
        """``columns``: that of each node."""
        at, gain, left = _best_bin(n, s, least)
        draw = _drawn(self.nodes, self.seed, self.tree, -2 - columns)
        known = np.where(self.feature >= 0, self.gain, 0.0)
        better = np.isfinite(gain) & ((gain > known * (1 + _EQUAL)) | ((gain >= known * (1 - _EQUAL)) & (draw < self.draw)))
        self.feature[better] = columns[better]
        self.bin[better], self.gain[better], self.left[better], self.draw[better] = at[better], gain[better], left[better], draw[better]


def _whole_numbers(y: np.ndarray, w: np.ndarray | None) -> tuple[np.ndarray, float]:
    """``y`` from its middle in units too small to matter to nodes of many rows, and the unit; 0 where there is none.

    Whole numbers are summed and subtracted without any rounding.
    """
    middle = (y.min() + y.max()) / 2
    widest, rows = np.abs(y - middle).max(), len(y) if w is None else w.sum()
    if not 0 < widest < np.inf:
        return y, 0.0
    unit = 2.0 ** (ceil(log2(widest)) + ceil(log2(rows)) - 52)
    return (np.rint((y - middle) / unit), unit) if unit <= 1e-8 * y.std() else (y, 0.0)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray | None, tree: int, root: int, settings: dict) -> list[np.ndarray]:
    """All nodes below and with ``root`` (1 is the whole tree's; the children of i are 2i and 2i + 1), in arrays as ``_NODE`` says.

    ``x`` is columns x rows; no ``w``: all weights are 1.
    """
    columns, seed, out = len(x), settings["seed"], []
    z, unit = _whole_numbers(y, w) if settings["chosen"] == columns else (y, 0.0)
    wy, wz = (y, z) if w is None else (w * y, w * z)
    pieces = [(np.array([root], dtype=np.int64), root.bit_length() - 1, np.zeros(len(y), dtype=np.int64), x, y, w, wy, wz, None)]
    del x, y, w, z, wy, wz
    while pieces:
        nodes, depth, at, x, y, w, wy, wz, parents = pieces.pop()
        m = len(nodes)
        n, s, ss = (np.bincount(at, v, m).astype(float) for v in (w, wy, wy * y))
        best, many = _Best(nodes, tree, seed), False
        if depth < settings["depth"]:
            slots = _slots(allowed_columns(nodes, tree, seed, settings["chosen"], columns))
            many = unit > 0 and len(y) >= DERIVE_ROWS * m
            if many and parents is not None:
                sums = _of_children(parents, x, at, w, wz)
            else:
                sums = _histograms(x, at, w, wz if many else wy, slots)
            for k, mine in enumerate(slots):
                best.offer(mine, *sums[k], settings["least"])
            if many:
                best.gain *= unit**2
        split = best.feature >= 0
        gain = np.where(split, best.gain / np.maximum(n, 1.0), -1.0)
        out.append([np.full(m, tree), nodes, best.feature, best.bin, gain, n, s, ss])
        if not split.any():
            continue
        left = np.full(m, -1)
        left[split] = 2 * np.arange(split.sum())
        rows = np.flatnonzero(split[at])
        at = at[rows]
        at = left[at] + (x.ravel().take(best.feature[at] * len(y) + rows) > best.bin[at])
        nodes, parents = (2 * nodes[split][:, None] + np.array([0, 1])).ravel(), sums[:, :, split] if many else None
        cuts = _pieces(np.bincount(at, minlength=len(nodes)))
        if len(cuts) > 2:
            order = at.astype(np.uint16).argsort(kind="stable")
            rows, at = rows[order], at[order]
        ends = np.searchsorted(at, cuts) if len(cuts) > 2 else [0, len(at)]
        for i, j, a, b in zip(cuts[:-1], cuts[1:], ends[:-1], ends[1:], strict=True):
            kept = rows[a:b]
            mine = (x, y, w, wy, wz) if len(kept) == len(y) and len(cuts) == 2 else (x.take(kept, axis=1), y[kept], None if w is None else w[kept], wy[kept], wz[kept])
            pieces.append((nodes[i:j], depth + 1, at[a:b] - i, *mine, None if parents is None else parents[:, :, i // 2 : j // 2]))
    return [np.concatenate(parts) for parts in zip(*out, strict=True)]


def _pieces(sizes: np.ndarray) -> list[int]:
    """Where to cut the nodes (children in pairs) into runs of about ``PIECE_ROWS`` rows: first nodes and the end."""
    if sizes.sum() <= 2 * PIECE_ROWS or len(sizes) > 1 << 16:
        return [0, len(sizes)]
    cuts, rows = [0], 0
    for i, pair in enumerate(sizes[0::2] + sizes[1::2]):
        if rows and rows + pair > PIECE_ROWS:
            cuts.append(2 * i)
            rows = 0
        rows += pair
    return [*cuts, len(sizes)]


def _of_children(parents: np.ndarray, x: np.ndarray, at: np.ndarray, w: np.ndarray | None, wz: np.ndarray) -> np.ndarray:
    """Histograms of all children: the smaller one of a node is counted, the other is the rest."""
    pairs = parents.shape[2]
    sizes = np.bincount(at, minlength=2 * pairs)
    small = 2 * np.arange(pairs) + (sizes[0::2] > sizes[1::2])
    number = np.full(2 * pairs, -1)
    number[small] = np.arange(pairs)
    mine = number[at]
    rows = np.flatnonzero(mine >= 0)
    slots = np.repeat(np.arange(len(x))[:, None], pairs, axis=1)
    counted = _histograms(x, mine[rows], None if w is None else w[rows], wz[rows], slots, rows)
    out = np.empty((*counted.shape[:2], 2 * pairs, BINS))
    out[:, :, small], out[:, :, small ^ 1] = counted, parents - counted
    return out


@dataclass
class _Top:
    """The nodes of one tree that were split from summed statistics."""

    feature: list = field(default_factory=lambda: [-1])
    bin: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [-1])
    node: list = field(default_factory=lambda: [1])
    rows: list = field(default_factory=lambda: [0.0])
    #: Places still to be split this way, and those finished in one place.
    open: list = field(default_factory=list)
    small: list = field(default_factory=list)

    def split(self, place: int, feature: int, at: int, sizes: Sequence[float], group_rows: int) -> None:
        self.feature[place], self.bin[place], self.left[place] = feature, at, len(self.node)
        for side, size in enumerate(sizes):
            (self.open if size > group_rows else self.small).append(len(self.node))
            for column, value in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.node, 2 * self.node[place] + side), (self.rows, size)):
                column.append(value)

    def places(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left = (np.array(v) for v in (self.feature, self.bin, self.left))
        rows, flat = x.shape[1], x.ravel()
        at = np.zeros(rows, dtype=np.int64)
        moving = np.arange(rows) if left[0] >= 0 else np.arange(0)
        here = at[moving]
        while len(moving):
            here = left[here] + (flat.take(feature[here] * rows + moving) > cut[here])
            at[moving] = here
            inner = left[here] >= 0
            moving, here = moving[inner], here[inner]
        return at


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start, bins, y in zip(*(batch.column(i) for i in range(3)), strict=True):
            target = np.frombuffer(y.as_py())
            yield start.as_py(), np.frombuffer(bins.as_py(), dtype=np.uint16).reshape(-1, len(target)), target


def _cuts(rows: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Upper ends of the bins of each column: between all values where there are few, else at equal shares of the rows."""
    about = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in features]).first()
    few = [c for c in features if about[c] <= 2 * BINS]
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    found = rows.agg(*[(F.collect_set(F.col(c).cast("double")) if c in few else F.percentile_approx(F.col(c).cast("double"), shares, F.lit(10_000))).alias(c) for c in features]).first()
    out = []
    for c in features:
        values = np.unique(np.array(found[c], dtype=float))
        if c in few and len(values) > BINS:
            few_shares = rows.agg(F.percentile_approx(F.col(c).cast("double"), shares, F.lit(10_000))).first()[0]
            out.append(np.unique(np.array(few_shares, dtype=float)))
        else:
            out.append((values[:-1] + values[1:]) / 2 if c in few else values)
    return out


def _packed_rows(rows: DataFrame, features: Sequence[str], target: str, cuts: list[np.ndarray]) -> DataFrame:
    """The rows in blocks: the number of the first, packed bins by column, the targets."""

    def pack(batches):
        start = TaskContext.get().partitionId() << 40
        words, ys = [], []

        def block():
            nonlocal start
            y = np.concatenate(ys)
            yield pa.RecordBatch.from_pydict({"start": [start], "bins": [np.concatenate(words, axis=1).tobytes()], "y": [y.tobytes()]})
            start += len(y)
            words.clear()
            ys.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([np.searchsorted(cut, batch.column(i).to_numpy(zero_copy_only=False), side="left").astype(np.uint8) for i, cut in enumerate(cuts)])
            words.append(_packed(x))
            ys.append(np.asarray(batch.column(len(cuts)).to_numpy(zero_copy_only=False), dtype=float))
            if sum(map(len, ys)) >= BLOCK_ROWS:
                yield from block()
        if ys:
            yield from block()

    plain = [F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate([*features, target])]
    return rows.select(*plain).mapInArrow(pack, _BLOCK)


@dataclass
class Binned:
    """Rows as bins, staged: what several forests over the same rows share."""

    cuts: list[np.ndarray]
    blocks: DataFrame
    rows: int


def binned(rows: DataFrame, features: Sequence[str], target: str) -> Binned:
    cuts = _cuts(rows, features)
    blocks = stage(_packed_rows(rows, features, target, cuts))
    size = blocks.agg(F.sum(F.octet_length("y") / 8)).first()[0]
    if not size:
        raise ValueError("no rows to grow a forest on")
    return Binned(cuts, blocks, int(size))


def _split_open(blocks: DataFrame, tops: list[_Top], columns: int, settings: dict) -> list:
    """Of each open node: column and last bin of its best split (column -1: none), gain, rows, sums, squares, rows on the left."""
    shared = blocks.sparkSession.sparkContext.broadcast(tops)

    def open_slots(tree: int, top: _Top) -> tuple[np.ndarray, np.ndarray]:
        nodes = np.array(top.node, dtype=np.int64)[top.open]
        return nodes, _slots(allowed_columns(nodes, tree, settings["seed"], settings["chosen"], columns))

    def count(batches):
        parts = list(_blocks(batches))
        if not parts:
            return
        x, y = np.concatenate([_unpacked(p[1], columns) for p in parts], axis=1), np.concatenate([p[2] for p in parts])
        ids = np.concatenate([p[0] + np.arange(len(p[2])) for p in parts])
        del parts
        for tree, top in enumerate(shared.value):
            if not top.open:
                continue
            number, m = np.full(len(top.node), -1), len(top.open)
            number[top.open] = np.arange(m)
            at = number[top.places(x)]
            seen, w = at >= 0, None
            if settings["bootstrap"]:
                w = repeats(ids, tree, settings["seed"], True)
                seen &= w > 0
            rows = np.flatnonzero(seen)
            at, mine = at[rows], y[rows]
            w = None if w is None else w[rows].astype(float)
            wy = mine if w is None else w * mine
            sums = [np.concatenate([np.bincount(at, v, m) for v in (w, wy, wy * mine)]), _histograms(x, at, w, wy, open_slots(tree, top)[1], rows).ravel()]
            yield pa.RecordBatch.from_pydict({"tree": pa.array([tree], pa.int32()), "start": [int(ids[0])], "sums": [np.concatenate(sums).tobytes()]})

    def choose(table: pa.Table) -> pa.Table:
        tree, top = table.column("tree")[0].as_py(), shared.value[table.column("tree")[0].as_py()]
        total = 0.0
        for _, part in sorted(zip(table.column("start").to_pylist(), table.column("sums").to_pylist(), strict=True)):
            total = total + np.frombuffer(part)
        nodes, slots = open_slots(tree, top)
        m = len(nodes)
        n, s, ss = total[: 3 * m].reshape(3, m)
        cells = total[3 * m :].reshape(len(slots), 2, m, BINS)
        cells[:, :, [int(i).bit_length() - 1 >= settings["depth"] for i in nodes]] = 0.0
        best = _Best(nodes, tree, settings["seed"])
        for k, mine in enumerate(slots):
            best.offer(mine, *cells[k], settings["least"])
        gain = np.where(best.feature >= 0, best.gain / np.maximum(n, 1.0), -1.0)
        values = [np.full(m, tree, dtype=np.int32), np.array(top.open), best.feature.astype(np.int32), best.bin.astype(np.int32), gain, n, s, ss, best.left]
        return pa.table(dict(zip(["tree", "node", "feature", "bin", "gain", "n", "s", "ss", "left"], values, strict=True)))

    summed = blocks.mapInArrow(count, "tree int, start long, sums binary").groupBy("tree").applyInArrow(choose, _NODE + ", left double")
    return summed.collect()


def _finish_small(blocks: DataFrame, tops: list[_Top], columns: int, settings: dict) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast(tops)

    def deal(batches):
        for start, words, y in _blocks(batches):
            ids, x = start + np.arange(len(y)), _unpacked(words, columns)
            for tree, top in enumerate(shared.value):
                if not top.small:
                    continue
                small = np.zeros(len(top.node), dtype=bool)
                small[top.small] = True
                at, w = top.places(x), None
                seen = small[at]
                if settings["bootstrap"]:
                    w = repeats(ids, tree, settings["seed"], True)
                    seen &= w > 0
                rows = np.flatnonzero(seen)
                if not len(rows):
                    continue
                at = at[rows]
                order = at.astype(np.uint16 if len(top.node) <= 1 << 16 else np.int64).argsort(kind="stable")
                rows, at = rows[order], at[order]
                edges = [0, *(np.flatnonzero(np.diff(at)) + 1), len(rows)]
                runs = [(int(at[a]), rows[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "tree": pa.array([tree] * len(runs), pa.int32()),
                        "node": pa.array([top.node[i] for i, _ in runs], pa.int64()),
                        "start": pa.array([start] * len(runs), pa.int64()),
                        "bins": pa.array([np.take(words, r, axis=1).tobytes() for _, r in runs], pa.binary()),
                        "y": pa.array([y[r].tobytes() for _, r in runs], pa.binary()),
                        "w": pa.array([b"" if w is None else w[r].tobytes() for _, r in runs], pa.binary()),
                    }
                )

    def finish(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("start").to_numpy(), kind="stable")
        ys, words, ws = [], [], []
        for i in map(int, order):
            ys.append(np.frombuffer(table.column("y")[i].as_py()))
            words.append(np.frombuffer(table.column("bins")[i].as_py(), dtype=np.uint16).reshape(-1, len(ys[-1])))
            ws.append(np.frombuffer(table.column("w")[i].as_py(), dtype=np.uint8))
        tree, root = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        x, y = _unpacked(np.concatenate(words, axis=1), columns), np.concatenate(ys)
        w = np.concatenate(ws).astype(float) if settings["bootstrap"] else None
        del table, ys, words, ws
        made = grow(x, y, w, tree, root, settings)
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 4]
        return pa.table([pa.array(v, k) for v, k in zip(made, kinds, strict=True)], names=_NAMES)

    # A number of its own: the rows of many small trees are few bytes, but much work.
    spark = blocks.sparkSession
    parts = min(sum(len(top.small) for top in tops), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    dealt = blocks.mapInArrow(deal, "tree int, node long, " + _BLOCK + ", w binary").repartition(max(1, parts), "tree", "node")
    return dealt.groupBy("tree", "node").applyInArrow(finish, _NODE)


def _numbered(nodes: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Nodes as Spark ML keeps them: numbered from 0 in every tree, children after their parents."""

    def number(table: pa.Table) -> pa.Table:
        tree, node, feature, cut, gain, n, s, ss = (table.column(c).to_numpy()[table.column("node").to_numpy().argsort()] for c in _NAMES)
        inner = feature >= 0
        left = np.where(inner, np.searchsorted(node, 2 * node), -1)
        some = np.maximum(n, 1.0)
        out = {
            "id": np.arange(len(node), dtype=np.int32),
            "prediction": s / some,
            "impurity": np.maximum(ss / some - (s / some) ** 2, 0.0),
            "impurityStats": [list(v) for v in zip(n, s, ss, strict=True)],
            "rawCount": n.astype(np.int64),
            "gain": gain,
            "leftChild": left.astype(np.int32),
            "rightChild": np.where(inner, left + 1, -1).astype(np.int32),
            "featureIndex": feature.astype(np.int32),
            "threshold": [float(cuts[f][b]) if f >= 0 else None for f, b in zip(feature, cut, strict=True)],
        }
        return pa.table({"treeID": tree.astype(np.int32), **out})

    flat = "treeID int, id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, leftChild int, rightChild int, featureIndex int, threshold double"
    made = nodes.groupBy("tree").applyInArrow(number, flat)
    threshold = F.when(F.col("threshold").isNull(), F.array().cast("array<double>")).otherwise(F.array("threshold"))
    split = F.struct(F.col("featureIndex"), threshold.alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    plain = ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild"]
    return made.select("treeID", F.struct(*plain, split.alias("split")).alias("nodeData"))


def fit_forest(
    rows: DataFrame,
    features: Sequence[str],
    target: str,
    *,
    trees: int,
    depth: int,
    min_leaf: int = 1,
    subset: str = "all",
    bootstrap: bool = True,
    seed: int = 42,
    group_rows: int = GROUP_ROWS,
    prepared: Binned | None = None,
    **columns: str,
) -> RandomForestRegressionModel:
    """A forest over all rows; ``columns`` are names of columns for the model (``featuresCol`` and the like).

    Settings mean what they mean in Spark ML. Bins are cut from all rows. The rows of a tree are drawn by a hash of each row's place
    in the staged table, so a repeated task draws the same. ``prepared`` are the same rows, binned before and discarded by the caller.
    """
    spark, names = rows.sparkSession, list(features)
    bins = prepared or binned(rows, names, target)
    blocks = bins.blocks
    settings = {"depth": depth, "least": min_leaf, "seed": seed, "bootstrap": bootstrap, "chosen": columns_per_split(subset, len(names))}
    tops = [_Top() for _ in range(trees)]
    for top in tops:
        (top.open if bins.rows > group_rows else top.small).append(0)
    done: list[tuple] = []
    while any(top.open for top in tops):
        found = _split_open(blocks, tops, len(names), settings)
        for top in tops:
            top.open = []
        for r in sorted(found, key=lambda r: (r.tree, r.node)):
            top = tops[r.tree]
            done.append((r.tree, top.node[r.node], r.feature, r.bin, r.gain, r.n, r.s, r.ss))
            if r.feature >= 0:
                top.split(r.node, r.feature, r.bin, (r.left, r.n - r.left), group_rows)
    nodes = _finish_small(blocks, tops, len(names), settings)
    if done:
        nodes = nodes.unionByName(spark.createDataFrame(done, _NODE))
    # Spark ML writes a forest with these settings; its nodes are replaced by those grown here.
    shell = RandomForestRegressor(numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed, labelCol=target, featureSubsetStrategy=subset, bootstrap=bootstrap, **columns)
    vectors = VectorAssembler(inputCols=names, outputCol=columns.get("featuresCol", "features"))
    path = f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}"
    shell.fit(vectors.transform(rows.limit(1))).write().save(path)
    _numbered(nodes, bins.cuts).write.mode("overwrite").parquet(f"{path}/data")
    model = RandomForestRegressionModel.load(path)
    delete_path(spark, path)
    if prepared is None:
        discard(blocks)
    return model
