"""Keyed tables, edit-distance joins and shortest paths against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import fuzzy as fz
from threadloom.operators import graph as gr
from threadloom.operators import search as sr
from threadloom.sinks import keyed


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("d", [0, 1, 2])
def test_edit_pairs_brute_force(spark, d):
    r = random.Random(d)
    word = lambda: "".join(r.choice("abé😀") for _ in range(r.randint(0, 9)))
    a = [None, "", "ab", *(word() for _ in range(90))] + ["hot"] * 50
    b = [None, "", "ho", *(word() for _ in range(90))]
    one = lambda words: spark.createDataFrame([(w,) for w in words], "name string")
    got = {(p.left_text, p.right_text): (p.distance, p.left_copies, p.right_copies) for p in fz.edit_pairs(one(a), one(b), d).collect()}
    want = {(x, y): (distance(x, y), a.count(x), b.count(y)) for x in set(a) - {None} for y in set(b) - {None} if distance(x, y) <= d}
    assert got == want and want
    assert fz.edit_pairs(one(a), one([]), d).isEmpty()
    nearest = {p.left_text: (p.distance, p.right_text) for p in fz.ranked_by_text(fz.edit_pairs(one(a), one(b), d)).collect()}
    assert nearest == {x: min((v[0], y) for (z, y), v in want.items() if z == x) for x, _ in want}


def test_edit_pairs_is_an_equi_join(spark):
    df = spark.createDataFrame([("a",)], "name string")
    plan = fz.edit_pairs(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_keyed_table(spark, tmp_path):
    r = random.Random(5)
    path, want = str(tmp_path / "t"), {}
    table = keyed.KeyedTable(spark, path, ["k"], buckets=32)
    df = lambda rows: spark.createDataFrame(rows, "k int, v int, s string")
    assert table.read() is None and not table.upsert(df([]), 0)
    first = [(k, 0, "x") for k in range(2_000)]
    assert table.upsert(df(first), 1)
    want.update({k: (v, s) for k, v, s in first})
    for number in range(2, 5):
        rows = [(r.randrange(2_500), r.randrange(1_000_000), "y") for _ in range(3)]
        rows += [(rows[0][0], -1, "older")]
        assert table.upsert(df(rows), number, ["v"]) and not table.upsert(df([(1, 9, "replay")]), number, ["v"])
        for k, v, s in sorted(rows, key=lambda x: x[1]):
            want[k] = (v, s)
        assert {x.k: (x.v, x.s) for x in table.read().collect()} == want
        # rows written follow the batch: at most three buckets of 32
        wrote = table.commits().where(F.col("batch") == number)
        assert wrote.count() <= 3 and wrote.agg(F.sum("rows")).first()[0] < 400
    small = table.compact(str(tmp_path / "u"))
    assert {x.k: (x.v, x.s) for x in small.read().collect()} == want


def test_keyed_table_ignores_an_unfinished_batch(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    df = lambda rows: spark.createDataFrame(rows, "k int, v int")
    table.upsert(df([(k, 0) for k in range(20)]), 1)
    # rows of batch 2 without a commit: as if the driver was lost between the two writes
    left = df([(k, 7) for k in range(20)]).select("*", F.pmod(F.xxhash64("k"), F.lit(4)).cast("int").alias("key_bucket"), F.lit(2).alias("batch"))
    left.write.mode("append").partitionBy("key_bucket", "batch").parquet(f"{table.path}/rows")
    assert {x.v for x in table.read().collect()} == {0}
    assert table.upsert(df([(3, 5)]), 2)
    assert sorted((x.k, x.v) for x in table.read().collect()) == [(k, 5 if k == 3 else 0) for k in range(20)]
    assert table.upsert(df([(None, 1)]), 3) and table.read().count() == 21


def test_first_of_a_million_shortest_paths(spark):
    layers = [["s"], *[[f"{c}{i}" for i in range(10)] for c in "abcdef"], ["t"]]
    edges = [(x, y, "T") for one, two in zip(layers, layers[1:]) for x in one for y in two]
    edges += [("s", "dead", "T"), ("dead", "end", "T"), ("a0", "stray", "T")]
    e = spark.createDataFrame(edges, "src string, dst string, type string")
    got = [tuple(p.path) for p in gr.shortest_paths(e, "s", "t", 8, limit=12).collect()]
    want = [("s", "a0", "b0", "c0", "d0", "e0", f"f{i}", "t") for i in range(10)]
    assert got == want + [("s", "a0", "b0", "c0", "d0", "e1", f"f{i}", "t") for i in range(2)]
    some = spark.createDataFrame(edges[:330], "src string, dst string, type string")
    assert gr.shortest_paths(some, "s", "c3", 8).count() == 100 and gr.shortest_paths(some, "c3", "s", 8, directed=True).isEmpty()


def test_edit_distance_of_bits_is_that_of_the_table(spark):
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcé😀 ") for _ in range(n))
    rows = [(text(r.randint(0, 90)), text(r.randint(0, 90))) for _ in range(300)]
    rows += [("", ""), ("", "abc"), ("abc", ""), ("same", "same"), (None, "a"), ("a", None), (text(700), text(650))]
    pairs = spark.createDataFrame(rows, "a string, b string")
    got = pairs.select(sr.edit_distance(F.col("a"), F.col("b")).alias("d"), F.levenshtein("a", "b").alias("want"))
    assert got.where(~F.col("d").eqNullSafe(F.col("want"))).isEmpty()
    two = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(F.lower(c), i, F.lit(2))))
    want = 2 * F.size(F.array_intersect(two("a"), two("b"))) / (F.size(two("a")) + F.size(two("b")))
    long = sr.text_similarities(pairs.where("length(a) > 1 and length(b) > 1"), "a", "b")
    assert long.where(F.abs(F.col("dice") - want) > 1e-12).isEmpty()
