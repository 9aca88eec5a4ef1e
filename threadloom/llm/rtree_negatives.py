"""Hard negatives by an STR-packed R-tree over integer vectors and their labels, exact.

Root, regions, pages, leaves, rows: regions come from recursive cuts of a bounded sample (label first, then the axes of
greatest spread), all rows are placed; a page holds some ``page`` rows of a region, STR-sorted into leaves of ``leaf`` rows.
Every box carries the interval of each coordinate and of the labels. For an anchor q the interval of a coordinate times
q's coordinate is an interval again, and their sums bound every inner product in the box from both sides.

A search has targets: an anchor, a window of scores, and whether labels must be equal or differ. The most promising
regions of each target are visited first and give a kth best score; then exactly the regions which the bounds leave
over: label possible, score interval meeting the window, upper bound not strictly below the kth best. Inside a page the
leaves are taken best first and dropped by the same rules. Positives are the best of the same label; each positive opens
a window for the negatives. Anchors of one region share a chunk, so that they look at the same pages; a task takes one
chunk and one page.

Rows with a null id, label or vector, or an empty vector, take no part (the caller turns bad components into a null
vector). Equal rows count once; rows that share an id and differ take part each, and "other rows" are those of another id.
Vectors of different lengths have no score. Scores must fit 64 bits; products beyond 2^53 are taken in integers. Fewer
candidates give fewer rows, an anchor without positives or negatives none, an empty table an empty result. The result
has fixed columns; others are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.tiles import Tiling, region_boxes, split_regions, stacked
from threadloom.session import cut_lineage

PAGE, LEAF, CHUNK, REGIONS, SAMPLE, FIRST = 4_096, 64, 256, 256, 4_000, 2
#: Lengths of vectors that get cuts of their own; others form one region each.
_LENGTHS = 8
_NONE = -(2**63)


def _spread_axes(points: np.ndarray, n: int) -> list[int]:
    """The label (axis 0), then the ``n`` coordinates of greatest spread."""
    return [0, *(1 + np.argsort(-points[:, 1:].var(axis=0), kind="stable")[:n]).tolist()]


def _tiling(points: np.ndarray, regions: int) -> Tiling:
    labels = len(np.unique(points[:, 0]))
    return Tiling(points, regions, _spread_axes(points, max(1, int(np.log2(max(regions, 2))))), max(2, min(regions, labels)) if labels > 1 else 1)


def _points(labels, vectors) -> np.ndarray:
    return np.column_stack([np.asarray(labels, np.float64), stacked(vectors)])


def _small(m: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    top = max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0
    return m.astype("i2" if top < 2**15 else "i4" if top < 2**31 else "i8")


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(v.astype(np.float64)).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    return q.astype(np.int64) @ v.T.astype(np.int64)


def score_intervals(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of q with each box, a little generous for rounding."""
    q = q.astype(np.float64)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    slack = 1e-12 * (np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T)
    return up @ lo.T + down @ hi.T - slack, up @ hi.T + down @ lo.T + slack


class _Asked:
    """A chunk of anchors and their targets."""

    def __init__(self, row, length: int):
        self.q = np.frombuffer(row.matrix, row.kind).reshape(-1, length)
        self.ids, self.labels = np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64)
        rows = np.frombuffer(row.rows, np.int64)  # ascending
        self.target = np.array([t["target"] for t in row.targets], np.int64)
        self.owner = np.searchsorted(rows, [t["row"] for t in row.targets])
        self.lo, self.hi = (np.array([t[c] for t in row.targets], np.float64) for c in ("lo", "hi"))
        self.edge = np.array([t["edge"] for t in row.targets], np.float64)

    def open_boxes(self, lo: np.ndarray, hi: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """(targets x boxes) of what can hold an answer, and the greatest score there. The first coordinate is the label."""
        least, most = score_intervals(self.q, lo[:, 1:], hi[:, 1:])
        label = self.labels[:, None]
        fits = (lo[:, 0] <= label) & (label <= hi[:, 0]) if same else (lo[:, 0] != label) | (hi[:, 0] != label)
        least, most, fits = least[self.owner], most[self.owner], fits[self.owner]
        return fits & (most >= self.lo[:, None]) & (least <= self.hi[:, None]), np.minimum(most, self.hi[:, None])


def visits(asked: _Asked, lo: np.ndarray, hi: np.ndarray, same: bool, first: int, known: bool) -> np.ndarray:
    """Boxes to look at: the most promising of each target, or the others that the kth best scores leave over."""
    alive, most = asked.open_boxes(lo, hi, same)
    order = np.argsort(np.where(alive, -most, np.inf), axis=1, kind="stable")[:, :first]
    early = np.zeros(alive.shape, bool)
    np.put_along_axis(early, order, True, axis=1)
    early = (early & alive).any(axis=0)
    return ~early & (alive & (most >= asked.edge[:, None])).any(axis=0) if known else early


def search_page(asked: _Asked, page, length: int, same: bool, k: int) -> pd.DataFrame:
    """(target, id, score): the k best answers of each target in a page, its leaves best first."""
    v = np.frombuffer(page.matrix, page.kind).reshape(-1, length)
    ids, labels, starts = (np.frombuffer(x, np.int64) for x in (page.ids, page.labels, page.starts))
    lo, hi = (np.frombuffer(x).reshape(len(starts), length + 1) for x in (page.leaf_lo, page.leaf_hi))
    alive, most = asked.open_boxes(lo, hi, same)
    ends = np.append(starts[1:], len(v))
    n = len(asked.target)
    best, kth = np.full((n, k), -np.inf), asked.edge.copy()
    parts = []
    for leaf in np.argsort(-np.where(alive, most, -np.inf).max(axis=0, initial=-np.inf), kind="stable"):
        at = np.flatnonzero(alive[:, leaf] & (most[:, leaf] >= kth))
        if not len(at):
            continue
        own = slice(starts[leaf], ends[leaf])
        anchors, place = np.unique(asked.owner[at], return_inverse=True)
        scores = _scores(asked.q[anchors], v[own])
        equal = asked.labels[anchors][:, None] == labels[own]
        fits = equal & (asked.ids[anchors][:, None] != ids[own]) if same else ~equal
        scores, fits = scores[place], fits[place] & (scores[place] >= asked.lo[at][:, None]) & (scores[place] <= asked.hi[at][:, None])
        fits &= scores >= kth[at][:, None]
        if not fits.any():
            continue
        merged = np.concatenate([best[at], np.where(fits, scores, -np.inf)], axis=1)
        best[at] = np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:]
        kth[at] = np.maximum(kth[at], best[at].min(axis=1))
        i, j = np.nonzero(fits)
        parts.append((at[i], ids[own][j], scores[i, j]))
    if not parts:
        return pd.DataFrame({"target": [], "id": [], "score": []})
    t, name, score = (np.concatenate(c) for c in zip(*parts))
    keep = score >= kth[t]
    t, name, score = t[keep], name[keep], score[keep]
    order = np.lexsort((name, -score, t))
    t, name, score = t[order], name[order], score[order]
    rank = np.arange(len(t)) - np.searchsorted(t, t)
    return pd.DataFrame({"target": asked.target[t], "id": name, "score": score})[rank < k]


class _Tree:
    """The packed tree and the anchors in chunks, as checkpointed tables."""

    def __init__(self, rows: DataFrame, page: int, leaf: int, chunk: int, regions: int, sample: int):
        total = rows.count()
        drawn = rows.orderBy(F.xxhash64("id", "vector"), "id").limit(sample).select("label", "vector").collect()
        lengths, counts = np.unique([len(r.vector) for r in drawn], return_counts=True)
        cuts = {}
        for i in np.argsort(-counts, kind="stable")[:_LENGTHS]:
            own = [r for r in drawn if len(r.vector) == lengths[i]]
            pages = -(-total * counts[i] // (len(drawn) * page))
            cuts[int(lengths[i])] = _tiling(_points([r.label for r in own], [r.vector for r in own]), int(min(regions, pages)))

        def placed(frames):
            for f in frames:
                for length, g in f.groupby("length"):
                    g = g.copy()
                    g["region"] = cuts[length].region(_points(g["label"], g["vector"])) if length in cuts else np.zeros(len(g), np.int32)
                    yield g

        rows = cut_lineage(rows.mapInPandas(placed, rows.schema.simpleString()[7:-1] + ",region:int"))
        rows = split_regions(rows, F.struct("id", "vector"), F.lit(page))

        def pack(f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values(["id", "row"])
            points = _points(f["label"], f["vector"])
            own = _tiling(points, -(-len(f) // leaf)).region(points)
            order = np.argsort(own, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(own[order]) != 0))
            lo, hi = (m.reduceat(points[order], starts, axis=0) for m in (np.minimum, np.maximum))
            matrix = _small(stacked(f["vector"], np.int64)[order])
            return pd.DataFrame({
                "length": [f["length"].iloc[0]], "region": [f["region"].iloc[0]], "part": [f["part"].iloc[0]],
                "ids": [f["id"].to_numpy(np.int64)[order].tobytes()], "labels": [f["label"].to_numpy(np.int64)[order].tobytes()],
                "kind": [matrix.dtype.str], "matrix": [matrix.tobytes()], "starts": [starts.astype(np.int64).tobytes()],
                "leaf_lo": [lo.tobytes()], "leaf_hi": [hi.tobytes()], "lo": [lo.min(axis=0)], "hi": [hi.max(axis=0)],
            })

        schema = "length int, region int, part int, ids binary, labels binary, kind string, matrix binary, starts binary, leaf_lo binary, leaf_hi binary, lo array<double>, hi array<double>"
        packed = cut_lineage(rows.groupBy("length", "region", "part").applyInPandas(pack, schema))
        self.pages = packed.drop("lo", "hi")
        # one row for each length: at most ``regions`` boxes
        self.boxes = region_boxes(packed).groupBy("length").agg(F.sort_array(F.collect_list(F.struct("region", "lo", "hi"))).alias("boxes"))

        asked = rows.where("is_anchor")
        slices = F.ceil(F.count("*").over(Window.partitionBy("length", "region")) / chunk)
        asked = asked.withColumn("slice", F.pmod(F.xxhash64("row"), slices).cast("int"))
        self.anchors = cut_lineage(asked.select("row", "id", "label", "length", "vector", F.concat_ws(" ", "length", "region", "slice").alias("chunk")))

        def gather(f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values("row")
            matrix = _small(stacked(f["vector"], np.int64))
            return pd.DataFrame({
                "chunk": [f["chunk"].iloc[0]], "length": [f["length"].iloc[0]], "rows": [f["row"].to_numpy(np.int64).tobytes()],
                "ids": [f["id"].to_numpy(np.int64).tobytes()], "labels": [f["label"].to_numpy(np.int64).tobytes()],
                "kind": [matrix.dtype.str], "matrix": [matrix.tobytes()],
            })

        self.chunks = cut_lineage(self.anchors.groupBy("chunk").applyInPandas(gather, "chunk string, length int, rows binary, ids binary, labels binary, kind string, matrix binary"))

    def _look(self, targets: DataFrame, same: bool, k: int, first: int, known: bool) -> DataFrame:
        wanted = targets.join(self.anchors.select("row", "chunk"), "row").groupBy("chunk")
        queries = self.chunks.join(wanted.agg(F.sort_array(F.collect_list(F.struct("target", "row", "lo", "hi", "edge"))).alias("targets")), "chunk")
        queries = cut_lineage(queries)

        def plan(f: pd.DataFrame) -> pd.DataFrame:
            r = f.iloc[0]
            lo, hi = stacked([b["lo"] for b in r.boxes]), stacked([b["hi"] for b in r.boxes])
            at = np.flatnonzero(visits(_Asked(r, int(r.length)), lo, hi, same, first, known))
            return pd.DataFrame({"chunk": r.chunk, "length": r.length, "region": [r.boxes[i]["region"] for i in at]})

        pairs = queries.join(self.boxes, "length").groupBy("chunk").applyInPandas(plan, "chunk string, length int, region int")
        pairs = pairs.join(self.pages.select("length", "region", "part"), ["length", "region"])
        pairs = cut_lineage(pairs.withColumn("pair", F.concat_ws(" ", "chunk", "region", "part")))
        left = pairs.select("pair", "chunk").join(queries, "chunk").groupBy("pair")
        right = pairs.select(F.col("pair").alias("met"), "length", "region", "part").join(self.pages, ["length", "region", "part"]).groupBy("met")

        def meet(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            length = int(q["length"].iloc[0])
            return search_page(_Asked(q.iloc[0], length), p.iloc[0], length, same, k)

        found = left.cogroup(right).applyInPandas(meet, "target long, id long, score long")
        return _first(found, k)

    def search(self, targets: DataFrame, same: bool, k: int, first: int) -> DataFrame:
        """(target, id, score, rank) for targets (target, row, lo, hi)."""
        early = cut_lineage(self._look(targets.withColumn("edge", F.lit(float("-inf"))), same, k, first, False))
        edges = early.groupBy("target").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("edge"))
        known = targets.join(edges, "target", "left").withColumn("edge", F.coalesce("edge", F.lit(float("-inf"))))
        late = self._look(known, same, k, first, True)
        return _first(early.drop("rank").union(late.drop("rank")), k)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("target").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id: str = "vec_id",
    label: str = "label", vector: str = "vector", page: int = PAGE, leaf: int = LEAF, chunk: int = CHUNK, regions: int = REGIONS,
    sample: int = SAMPLE, first: int = FIRST,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``is_anchor`` holds.

    A negative's score lies between ``low`` and ``high`` percent of the positive's; ``vector`` holds integers.
    """
    rows = vectors.select(
        F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<long>").alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )
    rows = rows.where("id is not null and label is not null and vector is not null and size(vector) > 0").dropDuplicates()
    rows = cut_lineage(rows.withColumns({"row": F.monotonically_increasing_id(), "length": F.size("vector")}))
    tree = _Tree(rows, page, leaf, chunk, regions, sample)
    every = tree.anchors.select(F.col("row").alias("target"), "row", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    close = cut_lineage(tree.search(every, True, positives, first).withColumnRenamed("rank", "place"))
    # whole numbers within the window; none where the positive's score is below zero
    exact = lambda share, up: f"cast((cast(score as decimal(20, 0)) * {share} + {99 if up else 0}) div 100 as long)"
    windows = close.where("score >= 0").select(
        (F.col("target") * positives + F.col("place") - 1).alias("target"), F.col("target").alias("row"), F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"), F.expr(exact(low, True)).cast("double").alias("lo"), F.expr(exact(high, False)).cast("double").alias("hi"),
    )
    windows = cut_lineage(windows.where("lo <= hi"))
    found = tree.search(windows.select("target", "row", "lo", "hi"), False, negatives, first)
    out = found.join(windows.select("target", "row", "positive_id", "positive_score"), "target")
    out = out.join(tree.anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
