"""Streams over tables stored as folders, and the size of custody plans."""

from pyspark.sql import functions as F

from threadloom.operators import custody as cu
from threadloom.streaming import jobs as sj


def test_streams_read_folders_and_files(spark, tmp_path):
    rows = spark.range(100).withColumn("v", F.col("id") % 7)
    folder, single = str(tmp_path / "t.parquet"), str(tmp_path / "one")
    rows.repartition(3).write.parquet(folder)
    rows.coalesce(1).write.parquet(single)
    file = next(str(p) for p in (tmp_path / "one").glob("*.parquet"))
    for name, path in (("folder", folder), ("file", file)):
        out = sj.run_to_table(sj.file_stream(spark, path, rows.schema), f"read-{name}")
        assert out.count() == 100 and out.agg(F.sum("v")).first()[0] == rows.agg(F.sum("v")).first()[0]


def chain(spark, stages):
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("a.txt").alias("name"))
    at = lambda s: F.timestamp_seconds(F.lit(1704067200 + s))
    base = cu.create_chains(docs, "doc_id", "name", "text", at(0))
    result = lambda k: docs.where(F.col("doc_id") % (k + 1) == 0).select(F.col("doc_id").alias("evidence_id"), F.md5(F.concat("text", F.lit(str(k)))).alias("hash"))
    return cu.add_stages(base, [(f"stage{k}", result(k), at(k + 1)) for k in range(stages)])


def test_chains_link_record_to_record(spark):
    found = {}
    for r in chain(spark, 3).collect():
        found.setdefault(r.evidence_id, []).append(r)
    for i, records in found.items():
        records.sort(key=lambda r: r.seq)
        assert [r.seq for r in records] == list(range(1 + sum(i % (k + 1) == 0 for k in range(3))))
        assert records[0].input_hash is None and all(b.input_hash == a.hash for a, b in zip(records, records[1:]))
        assert {(r.mime_type, r.size_bytes) for r in records} == {(records[0].mime_type, records[0].size_bytes)}


def test_chain_plans_grow_with_the_stages(spark):
    scans = lambda n: chain(spark, n)._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 20")
    assert [scans(n) for n in (1, 3, 6)] == [2, 4, 7]


def test_chains_of_unknown_type_stay(spark):
    base = chain(spark, 0).where("evidence_id < 2").withColumn("mime_type", F.lit(None).cast("string"))
    results = spark.createDataFrame([(0, "h0"), (1, "h1"), (7, "without a first record")], "evidence_id long, hash string")
    got = cu.add_stages(base, [("next", results, F.timestamp_seconds(F.lit(1704067300)))]).collect()
    assert sorted((r.evidence_id, r.seq, r.stage, r.mime_type) for r in got) == [
        (0, 0, "original", None), (0, 1, "next", None), (1, 0, "original", None), (1, 1, "next", None),
    ]
