"""Random forests of regression trees over the values before, one rule for series of every length.

The rule: values are put into bins between quantiles of the series, a tree weighs each row by a Poisson draw that depends on seed,
tree and the row's place alone, and each node takes the lag and bin that lower the squared error most, until a leaf would hold less
than one row in ``LEAVES`` of the series, the depth is reached or nothing is gained. Values are whole numbers inside (31 bits of the
largest one), so sums do not depend on their order and the same rows always give the same trees.

Two ways grow them, equal to the last bit:

* :class:`Grown` in the task that holds a series, from its rows sorted by node and bin;
* :func:`grow_spread` over all tasks, a level of all trees in each job: tasks add up counts and sums by tree, node, lag and bin, Spark
  adds those of the tasks and finds the best split of each node with windows. The driver gets a row a node, ``LEAVES`` bounds these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAVES = 10_000
_GAIN = 1e-9
"""Least share by which a split has to raise the sum of squares over nodes."""

_CHANCES = np.cumsum(np.concatenate([[math.exp(-1)], math.exp(-1) / np.cumprod(np.arange(1.0, 19.0))]))
_FEW_ROWS = 8192


def least_rows(train: int, leaves: int = LEAVES) -> int:
    """Fewest (weighted) rows of a leaf."""
    return max(1, -(-train // leaves))


def weights(places: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row counts in a tree: Poisson draws of mean 1 from a hash of seed, tree and place."""
    x = places.astype(np.uint64) + np.uint64(((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return np.searchsorted(_CHANCES, (x >> np.uint64(11)).astype(np.float64) / 2.0**53, "right").astype(np.int64)


def scale_of(largest: float, train: int) -> float:
    """The factor that makes values whole numbers of at most 31 bits, fewer where their sum would not fit."""
    bits = min(31, 58 - max(1, train).bit_length())
    return 2.0 ** (bits - math.frexp(largest)[1]) if largest > 0 else 1.0


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    return np.rint(values * scale).astype(np.int64)


def binned(features: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, features.T, strict=True)], axis=1)


class Tree:
    """Nodes as arrays: feature, last bin of the left child, number of the left child (-1 in a leaf; the right one follows), value."""

    def __init__(self, value: float):
        self.feature, self.cut = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.left, self.value = np.full(1, -1), np.array([value])

    def split(self, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray, values: np.ndarray) -> None:
        """Split ``nodes`` (ascending); ``values`` has those of the left and right child in a row each."""
        total = len(self.left)
        self.feature[nodes], self.cut[nodes], self.left[nodes] = feature, cut, total + 2 * np.arange(len(nodes))
        fresh = 2 * len(nodes)
        self.feature = np.concatenate([self.feature, np.zeros(fresh, np.int64)])
        self.cut = np.concatenate([self.cut, np.zeros(fresh, np.int64)])
        self.left = np.concatenate([self.left, np.full(fresh, -1)])
        self.value = np.concatenate([self.value, values.ravel()])

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        while (inner := self.left[at] >= 0).any():
            right = bins[np.arange(len(bins)), self.feature[at]] > self.cut[at]
            at = np.where(inner, self.left[at] + right, at)
        return at


class Forest:
    """Trees over the same edges, and the share of each feature in what their splits gained."""

    def __init__(self, edges: list[np.ndarray], trees: list[Tree], gains: np.ndarray, scale: float):
        self.edges, self.trees, self.scale = edges, trees, scale
        shares = gains / np.maximum(gains.sum(axis=1, keepdims=True), 1e-300)
        self.importance = shares.sum(axis=0) / max(shares.sum(), 1e-300)

    def predict(self, features: np.ndarray) -> np.ndarray:
        bins = binned(features, self.edges)
        return np.mean([t.value[t.leaves(bins)] for t in self.trees], axis=0) / self.scale

    def steps(self, newest: list[float], periods: int) -> list[float]:
        """Predictions one after the other, each becoming the newest value."""
        values: list[float] = []
        for _ in range(periods):
            values.append(float(self.predict(np.array([newest]))[0]))
            newest = [values[-1], *newest[:-1]]
        return values


def _best(place: np.ndarray, bins: np.ndarray, weight: np.ndarray, weighed: np.ndarray, nodes: int, count: int,
          least: int) -> tuple[np.ndarray, ...]:
    """For rows with the number of their node: gain, feature and bin of each node's best split, with the counts and sums of its
    children; gain is -inf where there is none. Every node has rows. Ties go to the smaller feature, then bin.

    Rows are sorted by node and bin, so the work grows with the rows, not with nodes times bins.
    """
    total_n, total_s = np.bincount(place, weight, nodes), np.bincount(place, weighed, nodes)
    gain, chosen, where = np.full(nodes, -np.inf), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    left_n, left_s, base = np.zeros(nodes), np.zeros(nodes), total_s * total_s / total_n
    every = np.arange(nodes)
    for f in range(bins.shape[1]):
        key = place * count + bins[:, f]
        order = np.argsort(key, kind="stable")
        key, n, s = key[order], np.cumsum(weight[order]), np.cumsum(weighed[order])  # whole numbers: differences are exact
        node = key // count
        first = np.searchsorted(node, every)
        n -= np.concatenate([[0.0], n])[first][node]
        s -= np.concatenate([[0.0], s])[first][node]
        above, rest = total_n[node] - n, total_s[node] - s
        fits = (np.append(key[1:] != key[:-1], True)) & (n >= least) & (above >= least)
        own = np.where(fits, s * s / n + rest * rest / np.maximum(above, 1), -np.inf)
        best = np.maximum.reduceat(own, first)
        hits = np.flatnonzero(own == best[node])
        at = hits[np.searchsorted(node[hits], every)]
        better = best > gain
        gain, chosen, where = np.where(better, best, gain), np.where(better, f, chosen), np.where(better, key[at] % count, where)
        left_n, left_s = np.where(better, n[at], left_n), np.where(better, s[at], left_s)
    gain = np.where(gain > base + _GAIN * base, gain, -np.inf)
    return gain, base, chosen, where, left_n, left_s, total_n - left_n, total_s - left_s


class Grown(Forest):
    """A forest grown from rows in memory."""

    def __init__(self, features: np.ndarray, y: np.ndarray, edges: list[np.ndarray], places: np.ndarray, trees: int, depth: int, seed: int,
                 largest: float | None = None, leaves: int = LEAVES):
        scale = scale_of(float(np.abs(y).max(initial=0)) if largest is None else largest, len(y))
        values, bins, least = whole(y, scale), binned(features, edges), least_rows(len(y), leaves)
        gains, grown = np.zeros((trees, features.shape[1])), []
        for number in range(trees):
            tree, gain = _grow(bins, values, weights(places, number, seed), max(len(e) for e in edges) + 1, depth, least)
            grown.append(tree)
            gains[number] = gain
        super().__init__(edges, grown, gains, scale)


def _grow(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, count: int, depth: int, least: int) -> tuple[Tree, np.ndarray]:
    drawn = np.flatnonzero(weight)
    bins, weight, y = bins[drawn], weight[drawn].astype(np.float64), y[drawn]
    weighed = weight * y  # whole numbers below 2^53: sums are exact
    features = bins.shape[1]
    tree = Tree(weighed.sum() / max(weight.sum(), 1))
    gains, active, place = np.zeros(features), np.zeros(1, np.int64), np.zeros(len(y), np.int64)
    for _ in range(depth):
        live = np.flatnonzero(place >= 0)
        if not len(live) or not len(active):
            break
        gain, base, chosen, where, n0, s0, n1, s1 = _best(place[live], bins[live], weight[live], weighed[live], len(active), count, least)
        split = np.flatnonzero(gain > -np.inf)
        if not len(split):
            break
        gains += np.bincount(chosen[split], (gain - base)[split], features)
        first = len(tree.left)
        tree.split(active[split], chosen[split], where[split], np.stack([s0[split] / n0[split], s1[split] / n1[split]], axis=1))
        number = np.full(len(active), -1)
        number[split] = 2 * np.arange(len(split))
        own = place[live]
        right = bins[live, chosen[own]] > where[own]
        place[live] = np.where(number[own] >= 0, number[own] + right, -1)
        active = first + np.arange(2 * len(split))
    return tree, gains


def grow_spread(rows: DataFrame, features: list[str], y: str, place: str, edges: list[np.ndarray], largest: float, train: int, trees: int,
                depth: int, seed: int, leaves: int = LEAVES) -> Forest:
    """The forest of one series whose ``train`` rows are spread over the cluster: one job a level."""
    context = rows.sparkSession.sparkContext
    scale, least, width = scale_of(largest, train), least_rows(train, leaves), len(features)
    count = max(len(e) for e in edges) + 1
    chosen = rows.select(F.col(place).cast("long").alias("place"), F.col(y).cast("double").alias("y"),
                         *[F.col(c).cast("double").alias(f"f{n}") for n, c in enumerate(features)])
    grown: list[Tree] = []
    active: list[np.ndarray] = []
    gains = np.zeros((trees, width))
    kind = "tree int, node long, feature int, bin int, n long, s long"
    for level in range(depth + 1):
        sent = context.broadcast((grown, active))

        def cells(batches: Iterator[pa.RecordBatch], sent=sent, level=level) -> Iterator[pa.RecordBatch]:
            grown, active = sent.value
            for batch in batches:
                for low in range(0, batch.num_rows, _FEW_ROWS):
                    part = [c.slice(low, _FEW_ROWS).to_numpy(zero_copy_only=False) for c in batch.columns]
                    places, values, bins = part[0], whole(part[1], scale), binned(np.stack(part[2:], axis=1), edges)
                    for tree in range(trees):
                        weight = weights(places, tree, seed)
                        node = grown[tree].leaves(bins) if level else np.zeros(len(bins), np.int64)
                        live = weight > 0
                        if level:
                            wanted = np.zeros(len(grown[tree].left), bool)
                            wanted[active[tree]] = True
                            live &= wanted[node]
                        live = np.flatnonzero(live)
                        if not len(live):
                            continue
                        nodes, of_node = np.unique(node[live], return_inverse=True)
                        if level:
                            cell = ((of_node[:, None] * width + np.arange(width)) * count + bins[live]).ravel()
                        else:  # the root: sums alone
                            cell = np.zeros(len(live), np.int64)
                        used, of_cell = np.unique(cell, return_inverse=True)
                        times = width if level else 1
                        n = np.bincount(of_cell, np.repeat(weight[live], times)).astype(np.int64)
                        s = np.bincount(of_cell, np.repeat(weight[live] * values[live], times)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(used), tree, np.int32)), pa.array(nodes[used // (width * count)]),
                             pa.array((used // count % width).astype(np.int32)), pa.array((used % count).astype(np.int32)), pa.array(n), pa.array(s)],
                            names=["tree", "node", "feature", "bin", "n", "s"])

        summed = chosen.mapInArrow(cells, kind).groupBy("tree", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        if not level:
            roots = {r.tree: r.s / r.n for r in summed.collect()}
            grown = [Tree(roots.get(t, 0.0)) for t in range(trees)]
            active = [np.zeros(1 if t in roots else 0, np.int64) for t in range(trees)]
            continue
        found = _splits(summed, least).collect()
        by_tree: dict[int, list] = {}
        for r in found:
            by_tree.setdefault(r.tree, []).append(r)
        for tree in range(trees):
            own = sorted(by_tree.get(tree, []), key=lambda r: r.node)
            first = len(grown[tree].left)
            if own:
                grown[tree].split(np.array([r.node for r in own]), np.array([r.feature for r in own]), np.array([r.bin for r in own]),
                                  np.array([[r.s0 / r.n0, r.s1 / r.n1] for r in own]))
                gains[tree] += np.bincount([r.feature for r in own], [r.gain - r.base for r in own], width)
            active[tree] = first + np.arange(2 * len(own))
        if not found:
            break
    return Forest(edges, grown, gains, scale)


def _splits(cells: DataFrame, least: int) -> DataFrame:
    """The best split of each node that has one: tree, node, feature, bin, gain, base, and counts and sums of its children."""
    feature = Window.partitionBy("tree", "node", "feature")
    upto = feature.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cut = cells.withColumns({"n0": F.sum("n").over(upto), "s0": F.sum("s").over(upto), "n": F.sum("n").over(feature), "s": F.sum("s").over(feature)})
    cut = cut.select("tree", "node", "feature", "bin", *[F.col(c).cast("double").alias(c) for c in ("n0", "s0", "n", "s")])
    cut = cut.withColumns({"n1": F.col("n") - F.col("n0"), "s1": F.col("s") - F.col("s0")}).filter(
        (F.col("n0") >= least) & (F.col("n1") >= least))
    cut = cut.withColumns({"gain": F.col("s0") * F.col("s0") / F.col("n0") + F.col("s1") * F.col("s1") / F.col("n1"),
                           "base": F.col("s") * F.col("s") / F.col("n")})
    best = F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "feature", "bin", "base", "n0", "s0", "n1", "s1"))
    best = cut.groupBy("tree", "node").agg(best.alias("x")).select("tree", "node", "x.*").drop("f", "b")
    return best.filter(F.col("gain") > F.col("base") + _GAIN * F.col("base"))
