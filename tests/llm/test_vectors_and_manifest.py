"""Hard negatives, the vector join and the Merkle manifest against brute force on odd tables."""

import collections
import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadloom.llm import merkle_manifest, rtree_negatives, subspace_join

CLASHING = "region int, part int, row string, length string, class string, root int, n int, target string, pair string, chunk int, is_anchor string, copies string, tree string, position string"


def with_clashes(spark, rows, schema):
    extra = [c.split()[0] for c in CLASHING.split(", ")]
    return spark.createDataFrame([(*r, *[None] * len(extra)) for r in rows], f"{schema}, {CLASHING}")


# ---------------------------------------------------------------- hard negatives
def plain_negatives(rows, anchors, positives=5, negatives=3, low=50, high=95):
    rows = list({(i, lab, tuple(v)) for i, lab, v in rows if i is not None and lab is not None and v})
    out = []
    for a, lab, q in rows:
        if not anchors(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, l) for i, l, v in rows if len(v) == len(q))
        for ps, p, _ in [s for s in scored if s[2] == lab and s[1] != a][:positives]:
            fits = [s for s in scored if s[2] != lab and low * -ps <= 100 * -s[0] <= high * -ps][:negatives]
            out += [(a, p, r, n, -ps, -ns) for r, (ns, n, _) in enumerate(fits, 1)]
    return sorted(out)


def odd_vectors(seed, n=260, d=6):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        v = [r.randint(-4, 9) for _ in range(r.choice([d, d, d, d, 3]))]
        rows.append((i, r.choice([0, 0, 0, 1, 2, 7]), v))
    rows += [(1_000 + i, i % 3, list(rows[0][2])) for i in range(40)]  # copies: ties on every score
    rows += [rows[5], rows[5], (5, 1, rows[6][2]), (2_000, None, [1] * d), (2_001, 1, None), (2_002, 1, []), (None, 1, [1] * d), (2_003, 1, [0] * d)]
    rows += [(3_000, 1, [2**31, -(2**30), 7]), (3_003, 1, [2**31, 2**30, 9]), (3_006, 2, [2**31 - 5, 3, 1])]
    return rows


@pytest.mark.parametrize("page, leaf, chunk, regions, first", [(4_096, 64, 256, 256, 2), (24, 4, 8, 12, 1)])
def test_negatives_like_brute_force(spark, page, leaf, chunk, regions, first):
    rows = odd_vectors(page)
    table = with_clashes(spark, rows, "vec_id long, label int, vector array<long>")
    got = rtree_negatives.mine(table, F.col("vec_id") % 3 == 0, page=page, leaf=leaf, chunk=chunk, regions=regions, first=first)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows, lambda i: i % 3 == 0)


def test_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, vector array<long>")
    assert rtree_negatives.mine(empty, F.lit(True)).collect() == []
    alone = spark.createDataFrame([(1, 1, [1, 2]), (2, 2, [3, 4])], "vec_id long, label int, vector array<long>")
    assert rtree_negatives.mine(alone, F.lit(True)).collect() == []


def test_leaves_are_skipped_where_vectors_cluster():
    r = np.random.default_rng(5)
    centres = r.integers(-200, 200, (16, 8))
    v = (centres[:, None, :] + r.integers(-5, 6, (16, 100, 8))).reshape(-1, 8)
    points = np.column_stack([np.arange(len(v)) // 400, v]).astype(float)
    own = rtree_negatives._tiling(points, 32).region(points)
    lo, hi = (np.stack([f(points[own == i], axis=0) for i in np.unique(own)]) for f in (np.min, np.max))
    row = pd.Series({
        "matrix": v[:1].astype("i8").tobytes(), "kind": "i8", "ids": np.zeros(1, "i8").tobytes(), "labels": np.zeros(1, "i8").tobytes(), "rows": np.zeros(1, "i8").tobytes(),
        "targets": [{"target": 0, "row": 0, "lo": -np.inf, "hi": np.inf, "edge": float(np.sort(v[:400] @ v[0])[-5])}],
    })
    left = rtree_negatives.visits(rtree_negatives._Asked(row, 8), lo, hi, True, 0, True)
    assert 1 <= left.sum() <= len(lo) / 4
    # intervals hold every score of their box
    least, most = rtree_negatives.score_intervals(v[:50], lo[:, 1:], hi[:, 1:])
    scores = v[:50] @ v.T
    assert (least[:, np.searchsorted(np.unique(own), own)] <= scores).all() and (scores <= most[:, np.searchsorted(np.unique(own), own)]).all()


# ---------------------------------------------------------------- near-duplicate vectors
def plain_groups(rows, threshold=0.9):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v in rows]
    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if good else None for (_, v), good in zip(rows, ok)]
    up, n = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= threshold:
                n[i] += 1
                n[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    ids = collections.defaultdict(list)
    for i, (name, _) in enumerate(rows):
        ids[root(i)].append(name)
    least = [min((x for x in ids[root(i)] if x is not None), default=None) for i in range(len(rows))]
    return [(name, n[i], least[i], name == least[i]) for i, (name, _) in enumerate(rows)]


def near_vectors(seed, d, n):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, d))
    chain = np.cumsum(r.normal(size=(60, d)) * 0.08, axis=0) + base[0]  # neighbours link, ends do not
    noisy = base[r.integers(0, 8, 150)] + r.normal(size=(150, d)) * 0.12
    return [[float(x) for x in v] for v in np.concatenate([base, chain, noisy])]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vector_groups_like_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(subspace_join, "TILE_ROWS", 64)
    rows = list(enumerate(near_vectors(3, 12, 120) + near_vectors(4, 5, 60)))
    rows = [(i, [float(np.float32(x)) for x in v] if kind == "float" else v) for i, v in rows]
    rows += [(900 + i, list(rows[7][1])) for i in range(30)] + [rows[9], rows[9], (None, list(rows[9][1])), (None, None)]
    rows += [(950, None), (951, []), (952, [0.0] * 12), (953, [1.0, None]), (954, [float("nan")] * 12), (955, [float("inf"), 1.0]), (956, [2.0]), (957, [3.0]), (958, [-1.0])]
    table = with_clashes(spark, rows, f"vec_id long, embedding array<{kind}>")
    got = subspace_join.group(table, regions=6)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain_groups(rows), key=key)


def test_vector_groups_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert subspace_join.group(empty).collect() == []
    blank = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in subspace_join.group(blank).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_blocks_lose_no_pair():
    r = np.random.default_rng(8)
    a = subspace_join.unit(r.normal(size=(300, 10)))
    b = subspace_join.unit(np.concatenate([a[:200] + r.normal(size=(200, 10)) * 0.13, r.normal(size=(100, 10))]))
    blocks = [np.arange(i, 10, 3) for i in range(3)]
    found = subspace_join.candidates(a, b, blocks, 0.2)
    assert found[a @ b.T >= 0.9].all() and found.mean() < 0.5


def test_far_regions_are_not_compared(spark):
    boxes = spark.createDataFrame([(2, 0, [0.9, 0.0], [1.0, 0.1]), (2, 1, [0.9, 0.2], [1.0, 0.3]), (2, 2, [-1.0, 0.0], [-0.9, 0.1])], "length int, region int, lo array<double>, hi array<double>")
    got = sorted(tuple(r) for r in subspace_join.near_regions(boxes, 0.2).collect())
    assert got == [(2, 0, 0), (2, 0, 1), (2, 1, 1), (2, 2, 2)]


def test_large_numbers_keep_their_cosine():
    v = np.array([[1e200, 1e200], [1e-200, 1e-200]])
    u = subspace_join.unit(v)
    assert np.allclose(u[0] @ u[1], 1)


# ---------------------------------------------------------------- manifest
def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def written(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes):
    """Root and, for each leaf, its witness: (place in the run, siblings) by level."""
    witness, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for w, a in zip(witness, at):
            w.append((a % 3, [x for k, x in enumerate(runs[a // 3]) if k != a % 3]))
        at, nodes = [a // 3 for a in at], [digest(*r) for r in runs]
    return nodes[0], witness


def plain_manifest(rows):
    leaf = lambda r: digest(*map(written, r))
    sources = collections.defaultdict(list)
    for r in rows:
        sources[r[1]].append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: plain_tree([leaf(r) for r in sources[s]]) for s in order}
    root, above = plain_tree([trees[s][0] for s in order])
    return [(r[0], leaf(r), trees[s][0], root, [*w, *above[i]]) for i, s in enumerate(order) for r, w in zip(sources[s], trees[s][1])]


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest_like_brute_force(spark, levels):
    r = random.Random(levels)
    rows = [(r.choice([None, 7, i, i, i]), r.choice(["a", "a", "a", "é", "z", None, "", f"s{i % 11}"]), r.choice(["x", "", None, "é😀\n", "long " * 2_000])) for i in range(200)]
    rows += [rows[3]] * 20
    table = with_clashes(spark, rows, "doc_id long, source string, text string").withColumns({"digest": F.lit(1), "witness": F.lit(2), "n": F.lit(3), "block": F.lit(4)})
    got = merkle_manifest.manifest(table, ["doc_id", "source", "text"], levels=levels)
    got = got.withColumn("folded", merkle_manifest.fold(F.col("leaf"), F.col("witness"))).collect()
    assert all(g.folded == g.root and g.other_leaf == g.leaf for g in got)
    flat = lambda g: (g[0] is None, *g[:4], [(w[0], list(w[1])) for w in g[4]])
    key = lambda g: str(g)
    assert sorted((flat((g.doc_id, g.leaf, g.subroot, g.root, g.witness)) for g in got), key=key) == sorted(map(flat, plain_manifest(rows)), key=key)


def test_manifest_of_one_and_of_nothing(spark):
    schema = "doc_id long, source string, text string"
    one = merkle_manifest.manifest(spark.createDataFrame([(1, None, "t")], schema), ["doc_id", "source", "text"]).collect()
    assert [(r.leaf, r.subroot, r.root, r.witness) for r in one] == [(digest("1:1", "-", "1:t"),) * 3 + ([],)]
    assert merkle_manifest.manifest(spark.createDataFrame([], schema), ["doc_id", "source", "text"]).collect() == []


def test_altered_rows_do_not_verify(spark):
    rows = spark.createDataFrame([(i, "s", f"line\n{i}" if i % 2 else f"{i}") for i in range(30)], "doc_id long, source string, text string")
    got = merkle_manifest.manifest(rows, ["doc_id", "source", "text"], changed={"text": F.replace("text", F.lit("\n"), F.lit(""))})
    got = got.withColumn("ok", merkle_manifest.fold(F.col("other_leaf"), F.col("witness")) == F.col("root")).collect()
    assert {r.doc_id: r.ok for r in got} == {i: i % 2 == 0 for i in range(30)}


def test_witnesses_grow_with_appends():
    block = merkle_manifest.Block()
    for i in range(5):
        block.append(digest(str(i)))
    first = block.open[1][0].children[0]
    assert first.witness == [digest("1"), digest("2")] and block.open[0][0].witness == [digest("4")]
    inner = block.open[1][0]
    assert inner.witness == []
    block.append(digest("5"))  # completes the second run: the first one learns its digest
    assert inner.witness == [digest(*[digest(str(i)) for i in (3, 4, 5)])]
