"""Stored indexes against the plain operators, and what they read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import retrieval as rt
from threadloom.operators import text_index as ti

WORDS = [f"w{i}" for i in range(60)]


def texts(spark, n):
    r = random.Random(n)
    # a word's rank decides how often it comes; some documents dwell on one word
    word = lambda: WORDS[min(int(r.paretovariate(0.6)) - 1, len(WORDS) - 1)]
    para = lambda own: " ".join(own if own and r.random() < 0.3 else word() for _ in range(r.randint(6, 30)))
    rows = []
    for i in range(n):
        own = r.choice(WORDS) if (i // 40) % 5 == 0 else None
        rows.append((i, "\n\n".join(para(own) + "." for _ in range(r.randint(1, 3)))))
    return spark.createDataFrame([*rows, (n, None), (n + 1, ""), (n + 2, "short")], "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("df", ["fixed", "corpus"])
def test_index_gives_the_same_best_documents(spark, tmp_path, df):
    docs = texts(spark, 400)
    path = str(tmp_path / "index")
    ti.write_index(ti.postings(docs, df=df), path, block_docs=16, buckets=8)
    asked = [(1, "w3 w7 w20"), (2, "w0 w0"), (3, "w41"), (4, "unknown words"), (5, "")]
    index = ti.TextIndex(spark, path, buckets=8)
    got, _ = index.top(spark.createDataFrame(asked, "query_id int, query string"), 7)
    got = {(r.query_id, r.rank): (r.doc_id, r.passage_no, round(r.score, 9)) for r in got.collect()}
    want = {}
    for q, text in asked:
        if rt.query_terms(text):
            best = rt.best_passage_per_doc(rt.bm25_passages(docs, text, df=df), 7).collect()
            want |= {(q, i): (r.doc_id, r.passage_no, round(r.score, 9)) for i, r in enumerate(best, 1)}
    assert got == want and {q for q, _ in got} == {1, 2, 3}


def test_fewer_blocks_for_fewer_results(spark, tmp_path):
    docs = texts(spark, 2_000)
    path = str(tmp_path / "index")
    ti.write_index(ti.postings(docs), path, block_docs=16, buckets=8)
    index = ti.TextIndex(spark, path, buckets=8)
    asked = spark.createDataFrame([(1, "w12")], "query_id int, query string")
    every = index.bounds(asked).count()
    read = {k: index.top(asked, k)[1].count() for k in (1, 10, 500)}
    assert read[1] <= read[10] < read[500] <= every and read[10] < every / 2
    # bounds come from narrow columns of the terms' own buckets
    plan = index.bounds(asked)._jdf.queryExecution().executedPlan().toString()
    assert "postings" not in plan.split("ReadSchema")[1]


def test_a_passage_is_one_row_until_its_block_is_built(spark, tmp_path):
    docs = texts(spark, 100)
    rows = ti.postings(docs)
    # no word is a row of its own, so none is shuffled
    assert rows.groupBy("doc_id", "passage_no").count().where("count > 1").isEmpty()
    path = str(tmp_path / "index")
    ti.write_index(rows, path, block_docs=16, buckets=8)
    index = ti.TextIndex(spark, path, buckets=8).rows
    assert index.groupBy("term", "block").count().where("count > 1").isEmpty()
    words = rows.select(F.explode(F.split("terms", " ")).alias("term")).groupBy("term").count().collect()
    held = index.select("term", F.explode("postings").alias("p")).groupBy("term").agg(F.sum("p.tf")).collect()
    assert words and sorted(map(tuple, words)) == sorted(map(tuple, held))
    assert index.where(F.col("greatest") != F.array_max("postings.impact")).isEmpty()


def test_terms_of_a_few_queries_do_not_shuffle_the_index(spark, tmp_path):
    path = str(tmp_path / "index")
    ti.write_index(ti.postings(texts(spark, 100)), path, block_docs=16, buckets=8)
    index = ti.TextIndex(spark, path, buckets=8)
    asked = spark.createDataFrame([(1, "w3 w7")], "query_id int, query string")
    found = index._scored(index._terms(asked), index.bounds(asked))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == plan.count("rightHint=(strategy=broadcast)")


# ---------------------------------------------------------------- vectors
def clustered(spark, n, d, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(24, d))
    v = centres[r.integers(0, 24, n)] + r.normal(size=(n, d)) * 0.25
    rows = [(i, [float(x) for x in x], i % 5) for i, x in enumerate(v)]
    odd = [(n, None, 1), (n + 1, [1.0], 1), (n + 2, [0.0] * d, 1), (n + 3, rows[0][1], 2), (n + 4, rows[0][1], 0)]
    return rows, spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>, label int"), odd


def plain_search(rows, asked, k, keep=lambda label: True):
    from collections import defaultdict

    ok = [(i, v, l) for i, v, l in rows if v is not None and len(v) == len(asked[0][1]) and keep(l)]
    m = np.array([v for _, v, _ in ok])
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    out = defaultdict(list)
    for q, v in asked:
        s = m @ (np.array(v) / np.linalg.norm(v))
        order = sorted(range(len(ok)), key=lambda j: (-round(float(s[j]), 12), ok[j][0]))
        out[q] = [ok[j][0] for j in order if ok[j][0] != q][:k]
    return out


def test_vector_index_is_exact_and_probes_find_most(spark, tmp_path):
    from threadloom.operators import vector_index as vi

    rows, table, odd = clustered(spark, 3_000, 16)
    path = str(tmp_path / "vectors")
    vi.write_index(table, path, cells=32, part=100, sample=1_000)
    index = vi.VectorIndex(spark, path)
    assert index.rows.count() == 3_003 and index.rows.groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 200
    asked = [(i, v) for i, v, _ in rows if i % 20 == 0]
    queries = spark.createDataFrame([*asked, (9_001, None), (9_002, [2.0])], "query_id long, query array<double>")
    got = lambda out: {q: [x.vec_id for x in sorted(g, key=lambda x: x["rank"])] for q, g in by_query(out.collect()).items()}
    want = plain_search([*rows, *odd], asked, 10)
    assert got(index.search(queries, 10, cells=3, exact=True, exclude_self=True)) == want
    found = got(index.search(queries, 10, cells=3, exclude_self=True))
    recall = np.mean([len(set(found[q]) & set(want[q])) / 10 for q in want])
    assert recall >= 0.9
    kept = got(index.search(queries, 10, cells=3, exact=True, exclude_self=True, keep=F.col("label") == 2))
    assert kept == plain_search([*rows, *odd], asked, 10, lambda label: label == 2)


def by_query(rows):
    out = {}
    for r in rows:
        out.setdefault(r.query_id, []).append(r)
    return out


def test_vector_search_plan_does_not_grow_with_queries(spark, tmp_path):
    from threadloom.operators import vector_index as vi

    rows, table, _ = clustered(spark, 1_000, 8)
    path = str(tmp_path / "vectors")
    vi.write_index(table, path, cells=8, sample=500)
    index = vi.VectorIndex(spark, path)
    many = spark.range(5_000).join(table.withColumnRenamed("embedding", "query"), F.col("id") % 1_000 == F.col("vec_id")).select(F.col("id").alias("query_id"), "query")
    size = lambda q: len(index.search(q, 3)._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(many) == size(many.limit(2))
    got = index.search(many, 3, cells=2)
    assert got.count() == 15_000 and got.where("rank = 1 and similarity < 0.999").isEmpty()


def test_many_queries_match_as_the_sql_function_does(spark):
    """A table of queries gives what the SQL function gives one by one, without a row for every pair; copies tie by id."""
    import numpy as np

    import __spark_entry__ as entry
    from threadloom.functions.sql import register_functions
    from threadloom.operators.search import match_embeddings

    rng = np.random.default_rng(4)
    x = [*rng.normal(size=(60, 5)), *[rng.normal(size=5)] * 30, np.zeros(5)]
    chunks = spark.createDataFrame(
        [(str(i), str(i // 4), f"text {i}", i % 4, f"p{i % 2}", f"case{i % 3}", str(i), v.tolist(), None) for i, v in enumerate(x)],
        "chunk_id string, document_id string, text string, chunk_index int, platform string, case_id string, evidence_id string, embedding array<double>, created_at timestamp_ntz")
    chunks.createOrReplaceTempView("few_chunks")
    register_functions(spark, "few_chunks")
    queries = chunks.where("chunk_index = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    columns = ["query_id", "chunk_id", "document_id", "text", "similarity"]
    got = match_embeddings(chunks, queries, 0.1, 6, case_id="case1").withColumn("similarity", F.round("similarity", 9)).select(columns)
    want = spark.sql("""SELECT q.chunk_id AS query_id, m.chunk_id, m.document_id, m.text, round(m.similarity, 9) AS similarity
        FROM few_chunks q, LATERAL match_embeddings(q.embedding, 0.1D, 6, filter_case_id => 'case1') m WHERE q.chunk_index = 0""")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    plan = entry.queries()["sql_match_embeddings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_slice_of_queries_is_compared_piece_by_piece(spark, tmp_path, monkeypatch):
    from threadloom.operators import vector_index as vi

    rows, table, _ = clustered(spark, 400, 8)
    path = str(tmp_path / "vectors")
    vi.write_index(table, path, cells=4, part=100, sample=300)
    asked = [(i, v) for i, v, _ in rows if i % 20 == 0]
    queries = spark.createDataFrame(asked, "query_id long, query array<double>")
    monkeypatch.setattr(vi, "_TOGETHER", 3)
    found = vi.VectorIndex(spark, path).search(queries, 4, exact=True, exclude_self=True).orderBy("query_id", "rank").collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: len(ids) for q, ids in got.items()} == {q: 4 for q, _ in asked}
    want = plain_search(rows, asked, 4)
    # two more rows repeat the first vector, so what is near it may come before the fourth
    assert all(set(ids) <= set(want[q]) | {403, 404} for q, ids in got.items())
