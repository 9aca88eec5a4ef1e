"""Sort-tile-recursive tiling of vector tables into packed tiles of bounded size, shared by the vector joins.

Cuts come from a bounded sample; every row is placed. A tile's number of rows is bounded by splitting regions that hold
more rows by a hash, so copies and dense regions do not end in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import cut_lineage


class Tiling:
    """Recursive cuts at sample quantiles along ``axes``: about ``regions`` regions, ``first`` slabs on the first axis."""

    def __init__(self, points: np.ndarray, regions: int, axes: list[int], first: int | None = None):
        self.n = 0
        self.root = self._cut(points, max(1, regions), axes, first)

    def _cut(self, points: np.ndarray, regions: int, axes: list[int], first: int | None = None):
        if regions <= 1 or not axes or len(points) < 2:
            self.n += 1
            return self.n - 1
        slabs = first or int(np.ceil(regions ** (1 / len(axes)) - 1e-9))
        x = np.sort(points[:, axes[0]])
        edges = np.unique(x[[len(x) * i // slabs for i in range(1, slabs)]])
        side = np.searchsorted(edges, points[:, axes[0]], side="right")
        parts = [points[side == i] for i in range(len(edges) + 1)]
        share = [int(round(regions * len(p) / len(points))) for p in parts]
        return axes[0], edges, [self._cut(p, s, axes[1:]) for p, s in zip(parts, share)]

    def region(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if isinstance(node, int):
                out[at] = node
                continue
            axis, edges, children = node
            side = np.searchsorted(edges, points[at, axis], side="right")
            todo += [(c, at[side == i]) for i, c in enumerate(children) if (side == i).any()]
        return out


def usable(vector: Column) -> Column:
    """Neither null nor empty, and every component present and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def stacked(vectors: pd.Series, dtype=np.float64) -> np.ndarray:
    return np.array(list(vectors), dtype)


def split_regions(rows: DataFrame, key: Column, tile: Column) -> DataFrame:
    """Adds ``part`` to rows with (length, region): regions of more than ``tile`` rows are split by the hash of ``key``."""
    sizes = rows.groupBy("length", "region").agg(F.count("*").alias("__n"))
    rows = rows.join(sizes, ["length", "region"])
    return rows.withColumn("part", F.pmod(F.xxhash64(key), F.ceil(F.col("__n") / tile)).cast("int")).drop("__n")


def region_boxes(packed: DataFrame) -> DataFrame:
    """(length, region, lo, hi) from packed tiles with (length, region, lo, hi): arrays of the least and greatest coordinates."""
    axes = packed.select("length", "region", F.posexplode(F.arrays_zip("lo", "hi")).alias("axis", "c"))
    axes = axes.groupBy("length", "region", "axis").agg(F.min("c.lo").alias("lo"), F.max("c.hi").alias("hi"))
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("axis", c))), lambda x: x[c]).alias(c)
    return cut_lineage(axes.groupBy("length", "region").agg(ordered("lo"), ordered("hi")))
