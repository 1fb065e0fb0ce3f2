"""Moments and co-moments of many columns from plain sums.

The built-in higher moments and correlations update many running values per row and
column. Over a handful of columns the generated method grows past what the JVM compiles,
and a pass becomes some twenty times slower. Here the first pass takes the means, the second
sums powers and products of the distances from them. Plain sums stay small in generated
code, and working from the mean keeps their precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelark.plans.longform import quoted

SUMS_PER_PASS = 48
"""Most sums in one aggregate."""

PAIR_SUMS = 144
"""More pair sums than this are taken as a matrix product in Arrow batches instead."""

_NOTHING = 1e-13  # share of a square sum that is rounding noise


@dataclass(frozen=True)
class Moments:
    """Figures of one column; ``m2`` to ``m4`` are sums of powers about the mean."""

    rows: int
    count: int
    mean: float | None
    min: float | None
    max: float | None
    m2: float = 0.0
    m3: float = 0.0
    m4: float = 0.0

    @property
    def varies(self) -> bool:
        return self.count > 0 and self.min != self.max

    @property
    def std(self) -> float | None:
        """Sample deviation."""
        if self.count < 2:
            return None
        return sqrt(self.m2 / (self.count - 1)) if self.varies else 0.0

    @property
    def std_pop(self) -> float | None:
        if self.count == 0:
            return None
        return sqrt(self.m2 / self.count) if self.varies else 0.0

    @property
    def skewness(self) -> float | None:
        """Population skewness; None for a constant column."""
        return (self.m3 / self.count) / (self.m2 / self.count) ** 1.5 if self.varies else None

    @property
    def kurtosis(self) -> float | None:
        """Excess population kurtosis; None for a constant column."""
        return self.count * self.m4 / self.m2 ** 2 - 3 if self.varies else None


def _gather(df: DataFrame, wanted: dict[str, Column]) -> dict[str, float]:
    """Many aggregates by name, a bounded number of them per pass."""
    names, found = list(wanted), {}
    for start in range(0, len(names), SUMS_PER_PASS):
        part = names[start:start + SUMS_PER_PASS]
        found.update(df.agg(*[wanted[n].alias(n) for n in part]).first().asDict())
    return found


def _number(c: str) -> Column:
    return quoted(c).cast("double")


def moments(df: DataFrame, columns: list[str], powers: int = 4) -> dict[str, Moments]:
    """Moments up to ``powers`` of each column, NULLs left out."""
    wanted = {"rows": F.count(F.lit(1))}
    for i, c in enumerate(columns):
        wanted |= {f"n{i}": F.count(quoted(c)), f"s{i}": F.sum(_number(c)),
                   f"a{i}": F.min(_number(c)), f"b{i}": F.max(_number(c))}
    first = _gather(df, wanted)
    means = {i: first[f"s{i}"] / first[f"n{i}"] if first[f"n{i}"] else None for i in range(len(columns))}
    sums = {}
    for i, c in enumerate(columns):
        if means[i] is None or powers < 2:
            continue
        away = _number(c) - F.lit(means[i])
        square = away * away
        sums[f"p2_{i}"] = F.sum(square)
        if powers >= 4:
            sums[f"p3_{i}"], sums[f"p4_{i}"] = F.sum(square * away), F.sum(square * square)
    second = _gather(df, sums)
    return {
        c: Moments(first["rows"], first[f"n{i}"], means[i], first[f"a{i}"], first[f"b{i}"],
                   *(second.get(f"p{k}_{i}") or 0.0 for k in (2, 3, 4)))
        for i, c in enumerate(columns)
    }


@dataclass(frozen=True)
class PairSums:
    """Sums over the rows where both columns are known, as distances from the column means."""

    n: float
    x: float
    y: float
    xx: float
    yy: float
    xy: float

    @property
    def correlation(self) -> float | None:
        if self.n < 2:
            return None
        vx, vy = self.xx - self.x * self.x / self.n, self.yy - self.y * self.y / self.n
        if vx <= _NOTHING * self.xx or vy <= _NOTHING * self.yy:
            return None
        return (self.xy - self.x * self.y / self.n) / sqrt(vx * vy)


def correlations(df: DataFrame, columns: list[str], pair_sums: int = PAIR_SUMS) -> dict[tuple[str, str], float | None]:
    """Pearson correlation of all pairs over their common rows; None for a constant column."""
    known = moments(df, columns, powers=2)
    result: dict[tuple[str, str], float | None] = {(c, c): 1.0 if known[c].varies else None for c in columns}
    varying = [c for c in columns if known[c].varies]
    result |= {(a, b): None for a in columns for b in columns if a != b}
    whole = {c for c in varying if known[c].count == known[c].rows}
    pairs = [(a, b) for i, a in enumerate(varying) for b in varying[i + 1:]]
    needed = sum(1 if a in whole and b in whole else 6 for a, b in pairs)
    found = _pairs_by_sums(df, pairs, known, whole) if needed <= pair_sums else _pairs_by_product(df, varying, known)
    for a, b in pairs:
        result[a, b] = result[b, a] = found[a, b].correlation
    return result


def _pairs_by_sums(df: DataFrame, pairs: list, known: dict[str, Moments], whole: set[str]) -> dict:
    def away(c: str) -> Column:
        return _number(c) - F.lit(known[c].mean)

    wanted = {}
    for k, (a, b) in enumerate(pairs):
        wanted[f"xy{k}"] = F.sum(away(a) * away(b))
        if not (a in whole and b in whole):
            x, y = F.when(quoted(b).isNotNull(), away(a)), F.when(quoted(a).isNotNull(), away(b))
            wanted |= {f"n{k}": F.count(x), f"x{k}": F.sum(x), f"y{k}": F.sum(y),
                       f"xx{k}": F.sum(x * x), f"yy{k}": F.sum(y * y)}
    got = _gather(df, wanted)
    found = {}
    for k, (a, b) in enumerate(pairs):
        if f"n{k}" in got:
            found[a, b] = PairSums(*((got[f"{p}{k}"] or 0.0) for p in ("n", "x", "y", "xx", "yy", "xy")))
        else:
            found[a, b] = PairSums(known[a].count, 0.0, 0.0, known[a].m2, known[b].m2, got[f"xy{k}"])
    return found


def _pairs_by_product(df: DataFrame, columns: list[str], known: dict[str, Moments]) -> dict:
    """All pair sums of a wide frame in one pass, as matrix products per Arrow batch.

    Each task adds up its own matrices and emits them once, cell by cell.
    """
    width = len(columns)
    means = np.array([known[c].mean for c in columns])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, width, width))
        for batch in batches:
            away = batch.to_numpy(dtype=float) - means
            present = ~np.isnan(away)
            away = np.where(present, away, 0.0)
            marks = present.astype(float)
            total += np.stack([marks.T @ marks, away.T @ marks, (away * away).T @ marks, away.T @ away])
        yield pd.DataFrame({"cell": np.arange(total.size), "value": total.ravel()})

    numbers = df.select(*[_number(c).alias(f"x{i}") for i, c in enumerate(columns)])
    summed = numbers.mapInPandas(products, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("v"))
    flat = np.zeros(4 * width * width)
    for r in summed.collect():
        flat[r["cell"]] = r["v"]
    both, first, square, cross = flat.reshape(4, width, width)
    return {
        (a, b): PairSums(both[i, j], first[i, j], first[j, i], square[i, j], square[j, i], cross[i, j])
        for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j
    }
