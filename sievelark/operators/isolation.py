"""Isolation forest (Liu, Ting and Zhou, 2008) on Spark.

Each tree is grown from a small random sample of rows, so fitting needs one scan that
draws the samples; the trees grow in parallel, one group per tree. All trees together are
some ten thousand nodes, whatever the size of the data: they are broadcast and every
executor scores its own rows in Arrow batches.

A small sample often misses the far rows, and then they end where its outermost rows do. So a
branch counts for a row only within its acceptable range (Liu, Ting and Zhou, 2010: SCiForest): a value
farther from the cut than the sample of that branch is wide is isolated already, and the branch adds nothing to its path.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelark.functions import roles
from sievelark.plans.longform import quoted
from sievelark.plans.quantiles import QUANTILE_ROWS, collect_quantiles
from sievelark.plans.rowid import with_row_index
from sievelark.plans.shared import write_shared

TREES, SAMPLE, SEED, CONTAMINATION = 100, 256, 42, 0.05
_DRAWS = 1 << 53  # draws are whole numbers a double holds exactly
_SPARE = 3  # candidates drawn per wanted row, so that each tree gets its full sample
_EULER = 0.5772156649015329
_NODES = "tree int, node int, feature int, threshold double, reach double, length double"
SPREAD_ROWS = 20_000_000
"""Below this many rows a frame may lie in few partitions and is spread for scoring."""


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` values."""
    n = np.asarray(n, dtype=float)
    long = 2 * (np.log(np.maximum(n - 1, 1)) + _EULER) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def draw_samples(df: DataFrame, ids: list[str], trees: int, sample: int, seed: int, rows: int) -> DataFrame:
    """(columns of df, tree, draw): ``sample`` rows per tree, chosen by hash of the row id.

    The choice depends on ids and seed only, not on partitions. A row is a candidate with probability ``p``
    and then enters each tree with probability ``q``; ``p q`` is the share a tree needs. ``p`` is as small as lets a
    candidate enter one tree on average, so in a large frame few rows are looked at again.
    """
    keys = [quoted(c) for c in ids]

    def draw(*salt) -> Column:
        return F.pmod(F.xxhash64(*keys, *salt), F.lit(_DRAWS))

    share = min(1.0, sample * _SPARE / max(rows, 1))
    p = min(1.0, trees * share)
    q = share / p
    candidates = df.filter(draw(F.lit(seed + 1)) < F.lit(p * _DRAWS))
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t, F.lit(seed)) < F.lit(q * _DRAWS))
    drawn = candidates.withColumn("tree", F.explode(chosen)).withColumn("draw", draw(F.col("tree"), F.lit(seed)))
    order = Window.partitionBy("tree").orderBy("draw", *keys)
    return drawn.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= sample).drop("__n")


def _grow(values: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes of one tree as a full binary tree: node ``i`` has the children 2i+1 and 2i+2.

    Each tuple is (node, feature, threshold, reach, path length). A leaf above the last level sends
    all rows to the left; its path length is kept at the bottom of that way. ``reach`` is the width of the
    sample at the node: how far from the threshold a value may lie for the branch to count.
    """
    nodes: list[tuple] = []
    waiting = [(0, np.arange(len(values)), 0)]
    while waiting:
        node, rows, depth = waiting.pop()
        part = values[rows]
        splittable = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 else ()
        if depth >= limit or not len(splittable):
            length = depth + float(average_path(len(rows)))
            for _ in range(depth, limit):
                nodes.append((node, 0, np.inf, np.inf, 0.0))
                node = 2 * node + 1
            nodes.append((node, 0, np.inf, np.inf, length))
            continue
        feature = int(rng.choice(splittable))
        low, high = float(part[:, feature].min()), float(part[:, feature].max())
        cut = float(rng.uniform(low, high))
        goes_right = part[:, feature] > cut
        nodes.append((node, feature, cut, high - low, 0.0))
        waiting += [(2 * node + 1, rows[~goes_right], depth + 1), (2 * node + 2, rows[goes_right], depth + 1)]
    return nodes


@dataclass(frozen=True)
class Forest:
    """Node arrays, one row per tree; ``length`` holds the path length of the last level."""

    columns: list[str]
    feature: np.ndarray
    threshold: np.ndarray
    reach: np.ndarray
    length: np.ndarray
    depth: int
    sample: int

    def scores(self, values: np.ndarray) -> np.ndarray:
        """Negative anomaly score per row: the lower, the more isolated."""
        flat = np.ascontiguousarray(values).ravel()
        start = np.arange(len(values), dtype=np.int64) * values.shape[1]
        total = np.zeros(len(values))
        for feature, threshold, reach, length in zip(self.feature, self.threshold, self.reach, self.length):
            at = np.zeros(len(values), dtype=np.int64)
            for _ in range(self.depth):
                beyond = flat.take(start + feature.take(at)) - threshold.take(at)
                total -= np.abs(beyond) > reach.take(at)
                at = 2 * at + 1 + (beyond > 0)
            total += length.take(at)
        usual = max(float(average_path(self.sample)), 1e-12)
        return -np.power(2.0, -(total / len(self.feature)) / usual)


def fit(df: DataFrame, ids: list[str], columns: list[str], trees: int = TREES, sample: int = SAMPLE,
        seed: int = SEED, rows: int | None = None) -> Forest:
    """Grow the forest from the rows whose ``columns`` are all known."""
    rows = df.count() if rows is None else rows
    sample = max(1, min(sample, rows))
    limit = ceil(log2(max(sample, 2)))
    shown = df.select(*[quoted(c) for c in ids], *[quoted(c).cast("double").alias(f"__x{i}") for i, c in enumerate(columns)])
    drawn = draw_samples(shown, ids, trees, sample, seed, rows)
    features = [f"__x{i}" for i in range(len(columns))]

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["draw", *features])
        tree = int(group["tree"].iloc[0])
        nodes = _grow(group[features].to_numpy(dtype=float), limit, np.random.default_rng([seed, tree]))
        listed = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "reach", "length"])
        return listed.assign(tree=tree)[["tree", "node", "feature", "threshold", "reach", "length"]]

    grown = drawn.select("tree", "draw", *features).groupBy("tree").applyInPandas(grow, _NODES).toPandas()
    numbers = sorted(grown["tree"].unique())
    shape = (len(numbers), 2 ** (limit + 1) - 1)
    feature, threshold, reach, length = np.zeros(shape, dtype=np.int64), np.full(shape, np.inf), np.full(shape, np.inf), np.zeros(shape)
    row, node = grown["tree"].map({t: i for i, t in enumerate(numbers)}).to_numpy(), grown["node"].to_numpy()
    feature[row, node], threshold[row, node], reach[row, node], length[row, node] = (
        grown[name].to_numpy() for name in ("feature", "threshold", "reach", "length"))
    return Forest(list(columns), feature, threshold, reach, length, limit, sample)


def score(df: DataFrame, forest: Forest, name: str = "anomaly_score") -> DataFrame:
    """``df`` with the score of each row."""
    shared = df.sparkSession.sparkContext.broadcast(forest)  # bounded by trees x sample nodes

    def judge(batch: pd.DataFrame) -> pd.Series:
        return pd.Series(shared.value.scores(batch.to_numpy(dtype=float)))

    packed = F.struct(*[quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(forest.columns)])
    return df.withColumn(name, F.pandas_udf(judge, "double")(packed))


def isolation_forest(df: DataFrame, ids: list[str] | None = None, columns: list[str] | None = None,
                     contamination: float = CONTAMINATION, trees: int = TREES, sample: int = SAMPLE,
                     seed: int = SEED, limit: int = QUANTILE_ROWS) -> DataFrame:
    """(ids..., columns..., anomaly_score) of the rows below the contamination quantile.

    ``ids`` must tell rows apart; without them the row position is added. Rows with a
    missing feature are left out. The scores are written once, because the quantile and
    the selection both read them and scoring costs more than reading.
    """
    if ids is None:
        df, ids = with_row_index(df), ["row_index"]
    columns = [c for c in roles.existing(df, columns, roles.numeric_columns(df)) if c not in ids]
    if not columns:
        raise ValueError("no numeric columns to look at")
    known = df.select(*[quoted(c) for c in ids], *[quoted(c) for c in columns]).dropna(subset=columns)
    rows = known.count()
    if rows == 0:
        return known.withColumn("anomaly_score", F.lit(None).cast("double"))
    forest = fit(known, ids, columns, trees, sample, seed, rows)
    if rows <= SPREAD_ROWS:
        known = known.repartition(df.sparkSession.sparkContext.defaultParallelism, *[quoted(c) for c in ids])
    scored = write_shared(score(known, forest), "isolation-scores")
    cut = collect_quantiles(scored, ["anomaly_score"], [contamination], rows=rows, limit=limit)["anomaly_score"][0]
    return scored.filter(F.col("anomaly_score") < cut)
