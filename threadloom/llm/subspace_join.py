"""Near-duplicate vectors by a subspace pigeonhole join: every pair with a cosine of at least the threshold, none lost.

For unit vectors a cosine of t means a squared distance of 2 - 2t. After a rotation the coordinates are dealt into blocks
of few dimensions. Squared distances add up over blocks, so a pair within the whole budget is within the budget's share
of at least one block, the share being the block's part of the dimensions. Each block is joined on its own range, the
union of what the blocks find is decided by the cosine of the whole vectors in double precision.

1. Equal vectors are one class with their number of copies. The rotation is the principal basis of a bounded sample, its
   axes dealt to the blocks in turn, so that every block starts with an axis that separates and has its part of the spread.
2. Classes are tiled along the leading axes (cuts from the sample, all classes placed) and packed. Regions whose boxes
   are further apart than the whole budget are never brought together.
3. A task takes two tiles. In each block both are sorted by the leading axis; rows further apart on it than the block's
   range are skipped, the others are joined by the block's distance. Candidates of all blocks are one bit map of bounded
   size. The task returns, for each vector, its number of links and the root of a spanning forest; pairs stay in the task.
4. Counts add up, the forests' links give components.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing and form components of their
own, as do vectors of different lengths. Copies count as links of each other, also rows with the same id. A null id never
names a component that has another id. Empty tables give empty results. Only the id and vector columns are read and the
result has fixed columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.components import components
from threadloom.llm.tiles import Tiling, region_boxes, split_regions, stacked, usable
from threadloom.session import cut_lineage

#: Bytes of vectors in a tile, rows in a tile, rows compared at once, lengths that get a basis (others keep their axes).
TILE_BYTES, TILE_ROWS, STEP, BASES = 2_000_000, 8_192, 256, 8
_EPS = 1e-5


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; the greatest component goes first so that no square overflows."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def tile_rows(length: int, kind: str) -> int:
    return min(TILE_ROWS, max(64, TILE_BYTES // (length * np.dtype(kind).itemsize)))


class _Frame:
    """Rotation and regions of the vectors of one length."""

    def __init__(self, sample: np.ndarray, regions: int):
        d = sample.shape[1]
        points = unit(sample)
        basis = np.linalg.eigh(np.cov(points.T).reshape(d, d) if len(points) > 1 else np.eye(d))[1][:, ::-1]
        self.basis = basis
        self.tiling = Tiling(points @ self.basis, regions, list(range(min(4, d))))


class Plan:
    """What tasks need to know: frames by length; lengths outside the sample keep their own axes in one region."""

    def __init__(self, sample: list[np.ndarray], total: int, threshold: float, blocks: int, regions: int, kind: str):
        self.threshold, self.n_blocks, self.frames = threshold, blocks, {}
        lengths, counts = np.unique([len(v) for v in sample], return_counts=True)
        for i in np.argsort(-counts, kind="stable")[:BASES]:
            own = np.array([v for v in sample if len(v) == lengths[i]], np.float64)
            # no more regions than full tiles: small tiles meet more often and are read as often
            full = -(-total * counts[i] // (len(sample) * tile_rows(int(lengths[i]), kind)))
            self.frames[int(lengths[i])] = _Frame(own, int(min(regions, full)))

    def rotated(self, points: np.ndarray) -> np.ndarray:
        frame = self.frames.get(points.shape[1])
        return points @ frame.basis if frame else points

    def region(self, rotated: np.ndarray) -> np.ndarray:
        frame = self.frames.get(rotated.shape[1])
        return frame.tiling.region(rotated) if frame else np.zeros(len(rotated), np.int32)

    def blocks(self, d: int) -> list[np.ndarray]:
        n = min(self.n_blocks, d)
        return [np.arange(b, d, n) for b in range(n)]


def candidates(a: np.ndarray, b: np.ndarray, blocks: list[np.ndarray], budget: float) -> np.ndarray:
    """Bit map of the pairs of rotated unit rows that are within a block's share of the squared distance."""
    d = a.shape[1]
    found = np.zeros((len(a), len(b)), bool)
    for axes in blocks:
        share = budget * len(axes) / d
        reach = np.sqrt(share) + _EPS
        order_a, order_b = np.argsort(a[:, axes[0]]), np.argsort(b[:, axes[0]])
        x, y = a[order_a][:, axes].astype(np.float32), b[order_b][:, axes].astype(np.float32)
        lead = b[order_b, axes[0]]
        one = lambda m: np.ones((len(m), 1), np.float32)
        # squared distances by one product: [-2x, |x|², 1] . [y, 1, |y|²]
        left = np.hstack([-2 * x, (x * x).sum(axis=1, keepdims=True), one(x)])
        right = np.hstack([y, one(y), (y * y).sum(axis=1, keepdims=True)]).T
        for i in range(0, len(a), STEP):
            rows = order_a[i : i + STEP]
            lo, hi = np.searchsorted(lead, [a[rows[0], axes[0]] - reach, a[rows[-1], axes[0]] + reach])
            near = np.flatnonzero((left[i : i + STEP] @ right[:, lo:hi] <= share + _EPS).ravel())
            if len(near):
                found[rows[near // (hi - lo)], order_b[lo + near % (hi - lo)]] = True
    return found


def _linked(a: np.ndarray, b: np.ndarray, asked: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the asked pairs of unit rows whose cosine reaches the threshold."""
    i, j = np.nonzero(asked)
    keep = np.zeros(len(i), bool)
    for s in range(0, len(i), 16_384):
        at = slice(s, s + 16_384)
        keep[at] = np.einsum("ij,ij->i", a[i[at]], b[j[at]]) >= threshold
    return i[keep], j[keep]


def _fold(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Joins the groups of linked nodes; ``root`` maps each node to the least of its group."""
    while True:
        x, y = root[u], root[v]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _compare(plan: Plan, length: int, frame: pd.DataFrame) -> pd.DataFrame:
    tiles = [frame.iloc[i] for i in range(len(frame))]
    names = [np.frombuffer(t["names"], np.int64) for t in tiles]
    copies = [np.frombuffer(t["copies"], np.int64) for t in tiles]
    units = [unit(np.frombuffer(t["matrix"], t["kind"]).reshape(-1, length)) for t in tiles]
    turned = [plan.rotated(u) for u in units]
    one, other = 0, len(tiles) - 1  # a tile that meets itself comes once
    found = candidates(turned[one], turned[other], plan.blocks(length), 2 - 2 * plan.threshold)
    if one == other:
        np.fill_diagonal(found, False)
    all_names = np.concatenate(names)
    shift = 0 if one == other else len(names[one])
    links = [np.zeros(len(n), np.int64) for n in names]
    root = np.arange(len(all_names))
    for s in range(0, len(found), STEP):
        if not found[s : s + STEP].any():
            continue
        i, j = _linked(units[one][s : s + STEP], units[other], found[s : s + STEP], plan.threshold)
        if not len(i):
            continue
        i += s
        links[one] += np.bincount(i, copies[other][j], len(links[one])).astype(np.int64)
        if one != other:
            links[other] += np.bincount(j, copies[one][i], len(links[other])).astype(np.int64)
        root = _fold(root, i, j + shift)
    links = np.concatenate(links)
    at = np.flatnonzero(links)
    return pd.DataFrame({"node": all_names[at], "root": all_names[root[at]], "links": links[at]})


def _packed(classes: DataFrame, plan: Plan, kind: str) -> DataFrame:
    """Tiles: (length, region, part, names, copies, kind, matrix, lo, hi)."""

    def placed(frames):
        for f in frames:
            for length, g in f.groupby("length"):
                g = g.copy()
                g["region"] = plan.region(plan.rotated(unit(stacked(g["vector"]))))
                yield g

    rows = cut_lineage(classes.mapInPandas(placed, classes.schema.simpleString()[7:-1] + ",region:int"))
    rows = split_regions(rows, F.col("class"), F.least(F.lit(TILE_ROWS), F.greatest(F.lit(64), F.floor(F.lit(TILE_BYTES) / (F.col("length") * np.dtype(kind).itemsize)))))

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("class")
        v = stacked(f["vector"], kind)
        turned = plan.rotated(unit(v))
        return pd.DataFrame({
            "length": [f["length"].iloc[0]], "region": [f["region"].iloc[0]], "part": [f["part"].iloc[0]],
            "names": [f["class"].to_numpy(np.int64).tobytes()], "copies": [f["copies"].to_numpy(np.int64).tobytes()],
            "kind": [kind], "matrix": [v.tobytes()], "lo": [turned.min(axis=0)], "hi": [turned.max(axis=0)],
        })

    schema = "length int, region int, part int, names binary, copies binary, kind string, matrix binary, lo array<double>, hi array<double>"
    return cut_lineage(rows.groupBy("length", "region", "part").applyInPandas(pack, schema))


def near_regions(boxes: DataFrame, budget: float) -> DataFrame:
    """(length, region, other): regions, region <= other, whose boxes come within the squared distance."""

    def near(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("region")
        lo, hi, names = stacked(f["lo"]), stacked(f["hi"]), f["region"].to_numpy()
        i, j = np.triu_indices(len(f))
        keep = np.zeros(len(i), bool)
        for s in range(0, len(i), 4_096):
            a, b = i[s : s + 4_096], j[s : s + 4_096]
            gap = np.maximum(np.maximum(lo[a] - hi[b], lo[b] - hi[a]), 0)
            keep[s : s + 4_096] = (gap * gap).sum(axis=1) <= budget + _EPS
        return pd.DataFrame({"length": f["length"].iloc[0], "region": names[i[keep]], "other": names[j[keep]]})

    return boxes.groupBy("length").applyInPandas(near, "length int, region int, other int")


def links(classes: DataFrame, kind: str = "f8", threshold: float = 0.9, blocks: int = 4, regions: int = 64, sample: int = 4_000) -> DataFrame:
    """(node, root, links) for pairs of tiles in which a class has links: how many, and its root among them.

    ``classes`` holds (class, vector, copies, length), one row for each distinct usable vector.
    """
    drawn = classes.orderBy(F.xxhash64("vector"), "class").limit(sample).select("vector").collect()
    plan = Plan([np.array(r[0]) for r in drawn], classes.count(), threshold, blocks, regions, kind)
    packed = _packed(classes, plan, kind)
    tiles = packed.select("length", "region", "part")
    near = near_regions(region_boxes(packed), 2 - 2 * threshold)
    first = near.join(tiles, ["length", "region"]).withColumnRenamed("part", "part_a")
    second = tiles.select("length", F.col("region").alias("other"), F.col("part").alias("part_b"))
    pairs = first.join(second, ["length", "other"]).where("region < other or part_a <= part_b")
    side = lambda r, p, s: F.struct(F.col(r).alias("region"), F.col(p).alias("part"), F.lit(s).alias("side"))
    both = F.array_compact(F.array(side("region", "part_a", 0), F.when((F.col("region") != F.col("other")) | (F.col("part_a") != F.col("part_b")), side("other", "part_b", 1))))
    key = F.concat_ws(" ", "length", "region", "part_a", "other", "part_b").alias("pair")
    wanted = cut_lineage(pairs.select(key, "length", F.explode(both).alias("tile")).select("pair", "length", "tile.*"))
    met = wanted.join(packed.drop("lo", "hi"), ["length", "region", "part"])

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        return _compare(plan, int(f["length"].iloc[0]), f.sort_values("side"))

    return met.groupBy("pair").applyInPandas(compare, "node long, root long, links long")


def group(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, blocks: int = 4,
    regions: int = 64, sample: int = 4_000,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row; kept: rows whose id names their component."""
    kind = "f4" if vectors.schema[vector].dataType.elementType.simpleString() == "float" else "f8"
    v = F.col(vector)
    given = usable(v) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = cut_lineage(vectors.select(F.col(id).alias("id"), F.when(given, v if kind == "f4" else v.cast("array<double>")).alias("vector")))
    classes = rows.where("vector is not null").groupBy("vector").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    classes = cut_lineage(classes.withColumns({"class": F.monotonically_increasing_id(), "length": F.size("vector")}))
    found = cut_lineage(links(classes.select("class", "vector", "copies", "length"), kind, threshold, blocks, regions, sample))
    counts = found.groupBy(F.col("node").alias("class")).agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.select("class", "vector", "copies", "least").join(roots.withColumnRenamed("node", "class"), "class", "left")
    named = cut_lineage(named.join(counts, "class", "left").withColumn("root", F.coalesce("root", "class")))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(names, "root").select("vector", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.join(named, "vector", "left")
    out = out.withColumn("component_id", F.when(F.col("vector").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(
        F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
