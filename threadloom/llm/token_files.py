"""Token ids in ORC files: integer run-length encoding, stripes, row indexes and Bloom filters on the document id.

``write`` puts documents in ascending id order over files whose id ranges do not overlap (null ids first, then by id,
text; repeated rows stay). A range exchange places them, so no task holds more than its range. Stripes are the unit of
parallel reads; the stripe and row-group statistics and the Bloom filter let a look-up by id skip the rest.

A null text counts as empty: it has only its end id. Empty tables give an empty table of files. Columns other than the
id and the text are not stored, so names cannot clash.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.byte_bpe import encode_column, id_rows

SCHEMA = "doc_id bigint, position bigint, n_tokens int, ids array<int>"


def write(
    docs: DataFrame, path: str, vocabulary: str, pattern: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text",
    stripe_bytes: int = 64 << 20, index_rows: int = 1_000, false_positives: float = 0.01,
) -> None:
    """Encode the texts and write (doc_id, position, n_tokens, ids) as ORC.

    ``position`` grows in file order over all files: the part number in its upper bits, the row in the lower 33.
    """
    placed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text"))
    placed = placed.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "__text")
    placed = placed.select("doc_id", F.monotonically_increasing_id().alias("position"), encode_column("__text", vocabulary, pattern, end_id, 600_000, 16_000_000).alias("ids"))
    (
        placed.select("doc_id", "position", F.size("ids").alias("n_tokens"), "ids").write.mode("overwrite")
        .option("compression", "zstd").option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", index_rows)
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", false_positives).orc(path)
    )


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of the files; with ``doc_ids`` only those, pruned by statistics and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows.where(F.col("doc_id").isin(doc_ids)) if doc_ids is not None else rows


def with_starts(rows: DataFrame, start: str = "start") -> DataFrame:
    """Adds the number of ids before each document. One sum per file, then a window inside each file."""
    part = F.shiftright("position", 33)
    files = rows.groupBy(part.alias("__part")).agg(F.sum("n_tokens").alias("__n"))
    # one row per file, so this window and the broadcast are bounded by the number of files
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("__part", part).withColumn("__own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    out = out.join(F.broadcast(files), "__part")
    return out.withColumn(start, F.col("__before") + F.col("__own")).drop("__part", "__before", "__own")


def ids_crc32(ids: Column | str) -> Column:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("long")
    def crc(lists: pa.Array) -> pa.Array:
        return pa.array([zlib.crc32(row.astype("<u4").tobytes()) for row in id_rows(lists)], pa.int64())

    return crc(ids)
