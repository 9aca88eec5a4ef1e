"""A stored inverted index of passages with block maxima, and exact best-first top-k from it.

A posting's part of a BM25 score (its impact) does not depend on the query, so it is computed once. Documents are dealt
to blocks of about ``block_docs``; a row of the index is one term in one block: the greatest impact, and the postings.
All postings of a document lie in one block, so a block's score bound is the sum of its terms' maxima, and the postings
of the few blocks that can still reach the k-th best score are all that a query reads. Texts are not read again.

Files are partitioned by a hash bucket of the term and sorted by term and block, so a query touches the buckets and row
groups of its own terms, and bounds come from two narrow columns. No row grows with the corpus: a frequent term has many
rows, one for each block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from threadloom.functions.sizing import broadcast_if_small
from threadloom.operators.chunking import passages
from threadloom.operators.retrieval import B, K1, passage_terms, query_terms
from threadloom.session import cut_lineage

#: Slack for sums of doubles taken in another order.
_EPS = 1e-9


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(docs: DataFrame, spans: Column | None = None, df: str = "fixed", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, passage_no, n, average, dl, terms, held): a row per passage with what its terms' scores are made of.

    Terms are one string parted by blanks; ``held`` maps a term to the passages that have it and is null where that is a
    tenth of them. ``df='fixed'`` and ``df='corpus'`` as in ``retrieval.bm25_passages``. No term is a row but to count it.
    """
    rows = passage_terms(docs, passages(F.col(text_col)) if spans is None else spans, id_col)
    rows = rows.select(F.col(id_col).alias("doc_id"), "passage_no", F.col("n_passages").cast("long").alias("n"), F.col("avg_len").alias("average"), "dl", "terms")
    text = F.array_join("terms", " ").alias("terms")
    if df != "corpus":
        return rows.where("dl > 0").select("doc_id", "passage_no", "n", "average", "dl", text, F.lit(None).cast("map<string,bigint>").alias("held"))
    lengths = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("average"))
    each = rows.select("doc_id", "passage_no", F.explode(F.array_distinct("terms")).alias("term"))
    counted = each.join(each.groupBy("term").agg(F.count("*").alias("f")), "term")
    held = counted.groupBy("doc_id", "passage_no").agg(F.map_from_entries(F.collect_list(F.struct("term", "f"))).alias("held"))
    return rows.select("doc_id", "passage_no", "dl", text).join(held, ["doc_id", "passage_no"]).join(F.broadcast(lengths)).select(  # one row
        "doc_id", "passage_no", "n", "average", "dl", "terms", "held")


def _grouped(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Index rows of the blocks of passages, which come in order of blocks; one block is held at a time."""
    kept: list = []

    def flush() -> pa.RecordBatch:
        words, counts, sizes, held = [], [], [], []
        for row in kept:
            tf = Counter(row["terms"].split(" "))
            words.extend(tf)
            counts.extend(tf.values())
            sizes.append(len(tf))
            held.extend([max(1.0, row["n"] * 0.1)] * len(tf) if row["held"] is None else map(dict(row["held"]).get, tf))
        each = lambda name, kind: np.repeat(np.array([row[name] for row in kept], dtype=kind), sizes)
        tf, f = np.array(counts, dtype=np.float64), np.array(held, dtype=np.float64)
        idf = np.log((each("n", np.float64) - f + 0.5) / (f + 0.5) + 1)
        impact = idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * (each("dl", np.float64) / each("average", np.float64))))
        coded = pa.array(words, pa.string()).dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        first = np.append(np.flatnonzero(np.diff(codes[order], prepend=-1)), len(codes)).astype(np.int32)
        row_of = np.repeat(np.arange(len(kept)), sizes)[order]
        posting = dict(zip(schema.names, schema.types))["postings"].value_type
        ids = pa.array([row["doc_id"] for row in kept], posting.field("doc_id").type)
        parts = [ids.take(pa.array(row_of)), pa.array(each("passage_no", np.int32)[order]), pa.array(tf[order].astype(np.int32)), pa.array(impact[order])]
        listed = pa.ListArray.from_arrays(first, pa.StructArray.from_arrays(parts, fields=list(posting)))
        block = pa.array([kept[0]["block"]] * len(coded.dictionary), pa.int64())
        return pa.RecordBatch.from_arrays([coded.dictionary, block, listed], names=schema.names)

    for batch in batches:
        for i in range(batch.num_rows):  # row by row: a batch as Python objects is many times the batch
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            if kept and row["block"] != kept[0]["block"]:
                yield flush()
                kept.clear()
            kept.append(row)
    if kept:
        yield flush()


def write_index(rows: DataFrame, path: str, block_docs: int = 32, buckets: int = 64) -> None:
    """Writes the passages of ``postings`` as the index. Blocks follow the order of ids: neighbours in a corpus often speak of the same things.

    Passages are shuffled once as texts to come together by blocks, and the finished rows of the index once to its buckets.
    """
    kind = dict(rows.dtypes)["doc_id"]
    block = F.floor(F.col("doc_id") / block_docs) if kind in ("int", "bigint") else F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    placed = rows.withColumn("block", block.cast("long")).repartition("block").sortWithinPartitions("block")
    types = StructType.fromDDL(f"term string, block bigint, postings array<struct<doc_id:{kind},passage_no:int,tf:int,impact:double>>")
    schema = to_arrow_schema(types)
    out = placed.mapInArrow(lambda batches: _grouped(batches, schema), types)
    # a frequent term has rows in all blocks: they go to several tasks; what follows from a row is added after its shuffle
    out = out.repartition(_bucket(F.col("term"), buckets), F.pmod(F.floor(F.col("block") / 1024), F.lit(8)))
    out = out.select("term", "block", F.array_max("postings.impact").alias("greatest"), "postings", _bucket(F.col("term"), buckets).alias("bucket"))
    out.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(path)


class TextIndex:
    """A stored index. ``buckets`` must be what it was written with."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.rows, self.buckets = spark.read.parquet(path), buckets

    def _terms(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, times, bucket); terms as in ``retrieval.query_terms``."""
        words = F.udf(query_terms, "array<string>")  # one short row per query
        terms = queries.select("query_id", F.explode(words("query")).alias("term"))
        return terms.groupBy("query_id", "term").agg(F.count("*").alias("times")).withColumn("bucket", _bucket(F.col("term"), self.buckets))

    def bounds(self, queries: DataFrame) -> DataFrame:
        """(query_id, block, bound): the greatest score that a passage of a block can have. Postings are not read."""
        hits = self.rows.select("bucket", "term", "block", "greatest").join(broadcast_if_small(self._terms(queries)), ["bucket", "term"])
        return hits.groupBy("query_id", "block").agg(F.sum(F.col("greatest") * F.col("times")).alias("bound"))

    def _scored(self, terms: DataFrame, blocks: DataFrame) -> DataFrame:
        """(query_id, doc_id, passage_no, score): the best passage of each document in the given (query_id, block)."""
        # the terms first: the rows of other terms are not shuffled
        asked = self.rows.select("bucket", "term", "block", "postings").join(broadcast_if_small(terms), ["bucket", "term"])
        hits = asked.join(broadcast_if_small(blocks.select("query_id", "block")), ["query_id", "block"])
        flat = hits.select("query_id", "times", F.explode("postings").alias("p")).select("query_id", "times", "p.*")
        scores = flat.groupBy("query_id", "doc_id", "passage_no").agg(F.sum(F.col("impact") * F.col("times")).alias("score"))
        best = F.max_by(F.struct("passage_no", "score"), F.struct(F.round("score", 9), -F.col("passage_no")))
        return scores.where("score > 0").groupBy("query_id", "doc_id").agg(best.alias("p")).select("query_id", "doc_id", "p.*")

    def top(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """The ``k`` best documents of each query by their best passage, and the blocks that were read for it.

        ``queries`` has (query_id, query), ids not repeated. The ``k`` most promising blocks give a k-th best score; then
        exactly the other blocks whose bound reaches it are read. For one term these are none: a bound is a passage's score.
        """
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
        best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        terms = cut_lineage(self._terms(queries))
        bounds = cut_lineage(self.bounds(queries))
        promising = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        early = bounds.withColumn("n", F.row_number().over(promising)).where(F.col("n") <= k)
        early = cut_lineage(early.select("query_id", "block", "bound"))
        found = cut_lineage(best(self._scored(terms, early)))
        edges = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("edge"))
        rest = bounds.join(early.select("query_id", "block"), ["query_id", "block"], "left_anti").join(edges, "query_id", "left")
        late = cut_lineage(rest.where(F.col("edge").isNull() | (F.col("bound") >= F.col("edge") - _EPS)).select("query_id", "block", "bound"))
        out = best(found.drop("rank").unionByName(self._scored(terms, late)))
        return out.select("query_id", "rank", "doc_id", "passage_no", "score"), early.unionByName(late)
