"""The corpus pipeline: quality rules, near-duplicates, personal data, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it returns is written as
Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import byte_bpe, fertility, lsh_forest, mixing, private_data
from threadloom.llm.queries import PATTERN, PIECE_MODEL, RANK_FILE
from threadloom.session import read_table, scratch_path

#: Rows of texts, ids and decoded bytes that a token worker holds at once.
BATCH_ROWS = 1_000
ROW_GROUP_BYTES = 16 << 20
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the base rules and the fertility band of their language stay."""
    return fertility.rate(docs, PIECE_MODEL.read_bytes()).where("kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8)."""
    return lsh_forest.deduplicated(docs, width=5, percent=80).select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by the name of their kind."""
    found = private_data.find(docs, private_data.fit(docs))
    text = private_data.redacted(F.col("text"), F.col("spans"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    mixed = mixing.mix(docs).where("copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(COLUMNS)


def _small_batches(spark: SparkSession) -> None:
    """Bounds the rows that a worker holds at once; it sets the session, since Spark reads the size when it runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    spark.conf.set(key, str(BATCH_ROWS if now <= 0 else min(now, BATCH_ROWS)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    _small_batches(spark)
    vocabulary = byte_bpe.vocabulary_from_ranks(RANK_FILE, PATTERN)
    coded = docs.withColumn("coded", byte_bpe.round_trip_column("text", vocabulary, PATTERN))
    ids = F.col("coded.ids")
    same = F.col("coded.decoded") == F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    return coded.select("doc_id", "lang", "source", F.size(ids).cast("long").alias("n_tokens"), ids.alias("ids"), same.alias("round_trip"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
    ("source_mix", source_mix), ("tokens", tokens),
]

#: Verdicts of tokenizers and of models trained on the corpus are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        # small row groups: a writer holds one of raw text in memory, next to the stage's Python workers
        stage(spark, docs, sf_dir).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
        docs = spark.read.parquet(path)
    return docs
