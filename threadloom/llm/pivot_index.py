"""Exact top-k by inner product with a pivot-distance index.

Inner products become distances by one more coordinate: with M the greatest norm, a stored vector v gets
sqrt(M² - |v|²) and a query 0; the distance of the two then falls as the product grows. Vectors are keyed by their
nearest pivot and the distance to it and cut into annuli of about equal size. For a query at distance d of a pivot,
the triangle inequality bounds every product inside an annulus [a, b]: no vector is nearer than max(d - b, a - d).
The search looks at the most promising annuli first and then at exactly those whose bound still reaches the k-th best
product, so results are exact; where pivots prune little it degrades to all annuli, block by block.

Equal vectors are one class with its k + 1 smallest ids: no other copy can be among the best k. The pivots come from
a bounded sample (``sample`` vectors, farthest first); every vector is indexed. There are pivots x annuli annuli at
any size, so their table is bounded; large annuli are split into blocks of ``block`` vectors, and queries into chunks.

Vectors with a null, NaN or infinite component, null vectors and rows with a null id take no part. Vectors of other
lengths than a query are no candidates for it. Rows repeated with the same id and vector count once. Fewer than k
candidates give fewer rows; empty tables give empty results. Only the id and vector columns are read, and the result has fixed columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import cut_lineage


def floor_scaled(vector: Column, scale: int = 256) -> Column:
    """Integer components floor(scale * x); null where a component is null or not finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return F.when(vector.isNotNull() & ~F.exists(vector, bad), whole)


def _matrix(rows) -> np.ndarray:
    return np.array(list(rows), np.float64)


def _farthest_first(points: np.ndarray, n: int) -> np.ndarray:
    chosen = [0]
    near = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(points)):
        far = int(near.argmax())
        if near[far] == 0:
            break
        chosen.append(far)
        near = np.minimum(near, ((points - points[far]) ** 2).sum(axis=1))
    return points[chosen]


class _Metric:
    """Distances in the space with one more coordinate."""

    def __init__(self, pivots: np.ndarray, greatest: float):
        self.pivots, self.greatest = pivots, greatest
        self.lift = np.sqrt(np.maximum(greatest - (pivots**2).sum(axis=1), 0))

    def stored(self, v: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(self.greatest - (v**2).sum(axis=1), 0))
        return np.sqrt(np.maximum(2 * self.greatest - 2 * (v @ self.pivots.T) - 2 * lift[:, None] * self.lift[None, :], 0))

    def asked(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] + self.greatest - 2 * (q @ self.pivots.T), 0))


def _classes(vectors: DataFrame, k: int) -> DataFrame:
    """(class, vector, ids): distinct vectors with their k + 1 smallest ids; the smallest names the class."""
    first = Window.partitionBy("vector").orderBy("id")
    few = vectors.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= k + 1)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("class"), "vector", "ids")


def _bounds(metric: _Metric, annuli: pd.DataFrame, q: np.ndarray) -> np.ndarray:
    """Greatest possible product of each query with each annulus, a little generous for rounding."""
    d = metric.asked(q)[:, annuli["pivot"].to_numpy()]
    low = np.maximum(np.maximum(d - annuli["b"].to_numpy(), annuli["a"].to_numpy() - d), 0)
    low = np.maximum(low * (1 - 1e-9) - 1e-6, 0)
    return ((q**2).sum(axis=1)[:, None] + metric.greatest - low**2) / 2


def _best(scores: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of each row: greatest score, then least name. Names must ascend."""
    if scores.shape[1] <= k:
        return np.argsort(-scores, axis=1, kind="stable")
    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, [scores.shape[1] - k]]
    out = []
    for row, e in zip(scores, edge[:, 0]):
        at = np.flatnonzero(row >= e)
        out.append(at[np.argsort(-row[at], kind="stable")[:k]])
    return np.stack(out)


def _length_search(classes: DataFrame, asked: DataFrame, k: int, pivots: int, rings: int, sample: int, block: int, chunk: int, first: int) -> DataFrame:
    """(query class, class, score): the k + 1 best classes of each query class, all of one vector length."""
    greatest = float(classes.agg(F.max(F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x * x))).first()[0])
    drawn = classes.orderBy(F.xxhash64("class"), "class").limit(sample).select("vector").collect()
    metric = _Metric(_farthest_first(_matrix(r[0] for r in drawn), pivots), greatest)

    def keyed(frames):
        for f in frames:
            if len(f):
                d = metric.stored(_matrix(f["vector"]))
                near = d.argmin(axis=1)
                yield pd.DataFrame({"class": f["class"], "vector": f["vector"], "pivot": near.astype(np.int32), "d": d[np.arange(len(f)), near]})

    rows = cut_lineage(classes.select("class", "vector").mapInPandas(keyed, "class long, vector array<long>, pivot int, d double"))
    # approximate quantiles can differ when computed again: they are taken once, at most one row for each pivot
    found = rows.groupBy("pivot").agg(F.percentile_approx("d", [i / rings for i in range(1, rings)], 1000).alias("edges")).collect()
    edges = F.create_map(*[F.lit(x) if isinstance(x, int) else F.array(*map(F.lit, x)) for r in found for x in (r["pivot"], r["edges"])])
    rows = rows.withColumn("ring", F.size(F.filter(F.element_at(edges, F.col("pivot")), lambda e: e < F.col("d"))))
    annuli = rows.groupBy("pivot", "ring").agg(F.min("d").alias("a"), F.max("d").alias("b"), F.count("*").alias("n")).toPandas()
    annuli = annuli.sort_values(["pivot", "ring"], ignore_index=True)  # at most pivots x rings rows
    annuli["blocks"] = -(-annuli["n"] // block)
    number = F.create_map(*[F.lit(x) for r in annuli.itertuples() for x in (f"{r.pivot} {r.ring}", r.Index)])
    count = F.array(*[F.lit(int(x)) for x in annuli["blocks"]])
    rows = rows.withColumn("annulus", F.element_at(number, F.concat_ws(" ", "pivot", "ring")))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("class"), F.element_at(count, F.col("annulus") + 1)).cast("int"))

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("class")
        return pd.DataFrame({
            "annulus": [f["annulus"].iloc[0]], "part": [f["part"].iloc[0]],
            "names": [f["class"].to_numpy(np.int64).tobytes()], "matrix": [_matrix(f["vector"]).astype(np.float64).tobytes()],
        })

    packed = cut_lineage(rows.groupBy("annulus", "part").applyInPandas(pack, "annulus int, part int, names binary, matrix binary"))

    # queries near the same pivot share a chunk
    near = rows.join(asked, "class").select("class", "vector", "pivot", "ring")
    chunks = max(1, -(-near.count() // chunk))
    near = near.withColumn("chunk", F.pmod(F.col("pivot") * rings + F.col("ring"), F.lit(chunks)))
    spread = F.ceil(F.count("*").over(Window.partitionBy("chunk")) / chunk)
    near = cut_lineage(near.withColumn("slice", F.pmod(F.xxhash64("class"), spread).cast("int")))

    def gather(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("class")
        return pd.DataFrame({
            "chunk": [f["chunk"].iloc[0]], "slice": [f["slice"].iloc[0]],
            "asked": [f["class"].to_numpy(np.int64).tobytes()], "queries": [_matrix(f["vector"]).tobytes()],
        })

    queries = cut_lineage(near.groupBy("chunk", "slice").applyInPandas(gather, "chunk long, slice int, asked binary, queries binary"))
    width = metric.pivots.shape[1]

    def visits(known: bool):
        """(chunk, slice, annulus, part) to look at: the most promising annuli, or the others that can still matter."""

        def plan(frames):
            for f in frames:
                for r in f.itertuples():
                    q = np.frombuffer(r.queries).reshape(-1, width)
                    bound = _bounds(metric, annuli, q)
                    order = np.argsort(-bound, axis=1, kind="stable")[:, :first]
                    early = np.zeros(bound.shape, bool)
                    np.put_along_axis(early, order, True, axis=1)
                    early = early.any(axis=0)
                    need = (~early) & (bound >= np.array(r.edge)[:, None]).any(axis=0) if known else early
                    pairs = [(int(i), p) for i in np.flatnonzero(need) for p in range(int(annuli["blocks"].iloc[i]))]
                    if pairs:
                        yield pd.DataFrame({"chunk": r.chunk, "slice": r.slice, "annulus": [a for a, _ in pairs], "part": [p for _, p in pairs]})

        return plan

    def products(frames):
        for f in frames:
            for r in f.itertuples():
                q, v = np.frombuffer(r.queries).reshape(-1, width), np.frombuffer(r.matrix).reshape(-1, width)
                asked_, names = np.frombuffer(r.asked, np.int64), np.frombuffer(r.names, np.int64)
                scores = q @ v.T
                best = _best(scores, names, k + 1)
                yield pd.DataFrame({
                    "asked": np.repeat(asked_, best.shape[1]), "class": names[best].ravel(),
                    "score": np.take_along_axis(scores, best, axis=1).ravel().astype(np.int64),
                })

    def look(source: DataFrame, known: bool) -> DataFrame:
        pairs = source.mapInPandas(visits(known), "chunk long, slice int, annulus int, part int")
        joined = pairs.join(packed, ["annulus", "part"]).join(queries, ["chunk", "slice"])
        found = joined.select("asked", "queries", "names", "matrix").mapInPandas(products, "asked long, class long, score long")
        top = Window.partitionBy("asked").orderBy(F.desc("score"), "class")
        return found.withColumn("__n", F.row_number().over(top)).where(F.col("__n") <= k + 1).drop("__n")

    early = cut_lineage(look(queries, False))
    edge = early.groupBy("asked").agg(F.count("*").alias("n"), F.min("score").alias("edge"))
    edge = edge.select(F.col("asked").alias("class"), F.when(F.col("n") > k, F.col("edge").cast("double")).otherwise(F.lit(float("-inf"))).alias("edge"))
    places = near.select("class", "chunk", "slice").join(edge, "class", "left")
    edges_ = places.groupBy("chunk", "slice").agg(F.transform(F.sort_array(F.collect_list(F.struct("class", "edge"))), lambda x: F.coalesce(x["edge"], F.lit(float("-inf")))).alias("edge"))
    late = look(queries.join(edges_, ["chunk", "slice"]), True)
    top = Window.partitionBy("asked").orderBy(F.desc("score"), "class")
    return early.union(late).withColumn("__n", F.row_number().over(top)).where(F.col("__n") <= k + 1).drop("__n")


def search(
    vectors: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "vector",
    pivots: int = 16, rings: int = 8, sample: int = 1_000, block: int = 4_096, chunk: int = 512, first: int = 4,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` holds, against all rows but the query's own id.

    ``vector`` holds integer components; score is the integer inner product, ties go to the smaller id.
    """
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("__q"))
    rows = rows.where("id is not null and vector is not null and size(vector) > 0").groupBy("id", "vector").agg(F.max("__q").alias("__q"))
    rows = cut_lineage(rows)
    classes = cut_lineage(_classes(rows, k))
    asked = cut_lineage(rows.where("__q").join(classes.select("vector", "class"), "vector").select("id", "class", F.size("vector").alias("length")))
    parts = []
    for r in asked.groupBy("length").count().orderBy("length").collect():
        same = classes.where(F.size("vector") == r["length"])
        parts.append(_length_search(same, asked.where(F.col("length") == r["length"]).select("class").distinct(), k, pivots, rings, sample, block, chunk, first))
    if not parts:
        return asked.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score")).where("false")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    ids = classes.select("class", F.explode("ids").alias("vec_id"))
    pairs = asked.select(F.col("id").alias("query_id"), F.col("class").alias("asked")).join(found, "asked").join(ids, "class").where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
