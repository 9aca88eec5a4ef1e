"""A stored index of vectors in cells around centroids; queries are a table joined to it by cell.

Centroids come from a bounded sample, every vector is placed. A cell keeps the greatest angle to its centroid, so a query
knows the best cosine a cell can hold: a probing search looks at the nearest cells only, an exact one goes on to exactly
those cells whose bound still reaches the k-th best cosine found. Scores are always taken anew from the whole vectors.
Cells with more than ``part`` vectors are split by a hash, and queries meet a part in chunks, so no task holds a hot
cell or all queries. Nothing but the sample and the centroids passes through the driver.

Null vectors and vectors of another length than the centroids' are not indexed and find nothing; zero vectors have a
cosine of 0 with everything.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.session import cut_lineage

#: Queries that are compared with a part of a cell at a time.
_TOGETHER = 128


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _stack(vectors) -> np.ndarray:
    return _unit(np.array(list(vectors), np.float64))


def centroids(vectors: DataFrame, cells: int, sample: int = 20_000, rounds: int = 8, vec_col: str = "embedding") -> np.ndarray:
    """Centres of spherical k-means over a sample of at most ``sample`` vectors of the sample's commonest length."""
    drawn = vectors.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).orderBy(F.xxhash64(vec_col)).limit(sample).select(vec_col).collect()
    if not drawn:
        return np.zeros((1, 1))
    lengths, counts = np.unique([len(r[0]) for r in drawn], return_counts=True)
    x = _stack(r[0] for r in drawn if len(r[0]) == lengths[counts.argmax()])
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        full = np.bincount(home, minlength=len(centres)) > 0
        centres = np.where(full[:, None], _unit(sums), centres)
    return centres


def _cosine_bound(angle: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Greatest cosine with anything within ``reach`` of a centre that lies ``angle`` away."""
    return np.cos(np.maximum(angle - reach - 1e-7, 0))


def write_index(vectors: DataFrame, path: str, cells: int = 256, part: int = 4_096, sample: int = 20_000, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
    """Writes (cell, part, id, embedding, angle, other columns) below ``path/rows`` and the cells below ``path/cells``."""
    centres = centroids(vectors, cells, sample, vec_col=vec_col)
    fields = ", ".join(f"`{c}` {t}" for c, t in vectors.dtypes)

    def place(frames):
        for f in frames:
            f = f[f[vec_col].map(lambda v: v is not None and len(v) == centres.shape[1])].copy()
            if len(f):
                cos = _stack(f[vec_col]) @ centres.T
                f["cell"] = cos.argmax(axis=1).astype(np.int32)
                f["angle"] = np.arccos(np.clip(cos.max(axis=1), -1, 1))
                yield f

    rows = cut_lineage(vectors.mapInPandas(place, f"{fields}, cell int, angle double"))
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("reach"))
    rows = rows.join(sizes.select("cell", F.ceil(F.col("n") / part).alias("parts")), "cell")
    rows = rows.withColumn("part", F.pmod(F.xxhash64(id_col), F.col("parts")).cast("int")).drop("parts")
    rows.repartitionByRange("cell", "part").sortWithinPartitions("cell", "part").write.parquet(f"{path}/rows")
    spark = vectors.sparkSession
    known = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>")
    sizes = sizes.withColumn("parts", F.ceil(F.col("n") / part).cast("int"))
    known.join(sizes, "cell").write.parquet(f"{path}/cells")


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, id_col: str = "vec_id", vec_col: str = "embedding"):
        self.spark, self.id_col, self.vec_col = spark, id_col, vec_col
        self.rows = spark.read.parquet(f"{path}/rows")
        cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # as many as centroids
        self.cells = np.array([c.cell for c in cells], np.int32)
        self.centres = np.array([c.centre for c in cells]) if cells else np.zeros((0, 1))
        self.reach = np.array([c.reach for c in cells])
        self.parts = np.array([c.parts for c in cells], np.int64)

    def _probes(self, queries: DataFrame, cells: int, exact: bool) -> DataFrame:
        """(query_id, query, cell, part): the nearest cells, or for ``exact`` the others whose bound reaches ``edge``."""
        centres, reach, names, parts = self.centres, self.reach, self.cells, self.parts

        def probe(frames):
            for f in frames:
                f = f[f["query"].map(lambda v: v is not None and len(v) == centres.shape[1])]
                # few queries at a time and few rows out: each can come out once per part of every cell
                for s in range(0, len(f), 64):
                    g = f.iloc[s : s + 64]
                    cos = _stack(g["query"]) @ centres.T
                    near = np.zeros(cos.shape, bool)
                    np.put_along_axis(near, np.argsort(-cos, axis=1, kind="stable")[:, :cells], True, axis=1)
                    if exact:
                        near = ~near & (_cosine_bound(np.arccos(np.clip(cos, -1, 1)), reach) >= g["edge"].to_numpy()[:, None])
                    i, j = np.nonzero(near)
                    i, j = np.repeat(i, parts[j]), np.repeat(j, parts[j])
                    first = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1]))) if len(i) else np.zeros(0, int)
                    part = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
                    ids, asked = g["query_id"].to_numpy(), g["query"].to_numpy()
                    for r in range(0, len(i), 2_048):
                        o = slice(r, r + 2_048)
                        yield pd.DataFrame({"query_id": ids[i[o]], "query": asked[i[o]], "cell": names[j[o]], "part": part[o].astype(np.int32)})

        kind = dict(queries.dtypes)["query_id"]
        return queries.mapInPandas(probe, f"query_id {kind}, query array<double>, cell int, part int")

    def _scored(self, probes: DataFrame, k: int, least: float | None, strict: bool, exclude_self: bool, keep, chunk: int = 1_024) -> DataFrame:
        """(query_id, id, similarity): the ``k`` best of each query in each part it looks at."""
        id_col, vec_col, rows = self.id_col, self.vec_col, self.rows if keep is None else self.rows.where(keep)
        crowd = Window.partitionBy("cell", "part")
        probes = probes.withColumn("slice", F.pmod(F.xxhash64("query_id"), F.ceil(F.count("*").over(crowd) / chunk)).cast("int"))
        probes = cut_lineage(probes)
        slices = probes.select("cell", "part", F.col("slice").alias("met")).distinct()
        met = rows.select("cell", "part", id_col, vec_col).join(slices, ["cell", "part"])
        kinds = dict(self.rows.dtypes)[id_col], dict(probes.dtypes)["query_id"]

        def score(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(v):
                return pd.DataFrame({"query_id": [], id_col: [], "similarity": []})
            v = v.sort_values(id_col)
            own, against, out = v[id_col].to_numpy(), _stack(v[vec_col]).T, []
            for r in range(0, len(q), _TOGETHER):  # the products of a part with a whole slice would be the most that a task holds
                some = q.iloc[r : r + _TOGETHER]
                asked = some["query_id"].to_numpy()
                sims = _stack(some["query"]) @ against
                fits = np.ones(sims.shape, bool) if not exclude_self else asked[:, None] != own[None, :]
                if least is not None:
                    fits &= sims > least if strict else sims >= least
                best = np.argsort(np.where(fits, -sims, np.inf), axis=1, kind="stable")[:, :k]
                found = np.take_along_axis(fits, best, axis=1)
                i = np.nonzero(found)[0]
                out.append(pd.DataFrame({"query_id": asked[i], id_col: own[best[found]], "similarity": np.take_along_axis(sims, best, axis=1)[found]}))
            return pd.concat(out)

        return probes.groupBy("cell", "part", "slice").cogroup(met.groupBy("cell", "part", "met")).applyInPandas(score, f"query_id {kinds[1]}, {id_col} {kinds[0]}, similarity double")

    def search(
        self, queries: DataFrame, k: int = 10, cells: int = 8, exact: bool = False, least: float | None = None, strict: bool = True,
        exclude_self: bool = False, keep=None,
    ) -> DataFrame:
        """(query_id, id, similarity, rank) for queries (query_id, query); the plan does not grow with them.

        ``keep`` is a condition on the index's columns (a scope or metadata filter).
        """
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), self.id_col)
        best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query"))
        out = best(self._scored(self._probes(asked, cells, False), k, least, strict, exclude_self, keep))
        if not exact:
            return out
        out = cut_lineage(out)
        floor = -2.0 if least is None else least
        edges = out.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("edge"))
        known = asked.join(edges, "query_id", "left").withColumn("edge", F.coalesce("edge", F.lit(floor)))
        late = self._scored(self._probes(known, cells, True), k, least, strict, exclude_self, keep)
        return best(out.drop("rank").unionByName(late))
