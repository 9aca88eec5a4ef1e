"""Version lineages of any depth."""

from pyspark.sql import functions as F

from threadloom.operators import graph as gr


def test_deep_lineage_is_whole(spark):
    n = 10_000
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.col("id").alias("version"))
    other = spark.range(n, n + 50).select("id", F.when(F.col("id") > n, F.lit(n)).alias("parent_id"), F.col("id").alias("version"))
    got = gr.version_lineage(chain.unionByName(other), 4_321)
    assert got.count() == n and got.agg(F.max("id")).first()[0] == n - 1
    assert gr.version_lineage(chain.unionByName(other), n + 7).count() == 50


def test_roots_of_odd_tables(spark):
    rows = [(1, None), (2, 1), (3, 2), (10, 99), (11, 10), (20, 21), (21, 22), (22, 20), (23, 20)]
    versions = spark.createDataFrame([(i, p, i) for i, p in rows], "id long, parent_id long, version long")
    assert {r.id: r.root for r in gr.lineage_roots(versions).collect()} == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10}
    assert gr.version_lineage(versions, 20).collect() == [] and gr.version_lineage(versions, 5).collect() == []
    assert gr.lineage_roots(versions.where("false")).collect() == []
