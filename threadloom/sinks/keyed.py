"""Keyed upsert into a bucketed table: a batch rewrites the buckets it touches, not the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.tables import keep_latest, upsert

_HASH = "key_bucket"


class KeyedTable:
    """Parquet rows below ``path`` in folders (key_bucket, batch) and a table of commits beside them.

    The key's hash names the bucket. A batch writes its touched buckets whole under its own number, then one commit row
    per bucket; readers take each bucket's newest committed batch. A batch that failed before its commit is not seen and
    is written again; one that was committed is skipped, so a replayed stream batch changes nothing. Batches of one
    table run one after another, with rising numbers. Folders of replaced batches stay until ``compact`` copies the
    table. The number of buckets is fixed per table: choose it so that a bucket fits into one task. Within a batch the
    row with the greatest ``order`` columns wins; without ``order`` its keys must be unique. Rows with null keys have a bucket too;
    they are never equal, so they are added.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 256):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(_HASH)

    def _exists(self) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def commits(self) -> DataFrame:
        """(key_bucket, batch, rows) of every committed bucket; as many rows as buckets were ever written."""
        kinds = f"{_HASH} int, rows long, batch long"
        return self.spark.read.schema(kinds).parquet(f"{self.path}/commits") if self._exists() else self.spark.createDataFrame([], kinds)

    def read(self, touched: DataFrame | None = None) -> DataFrame | None:
        """The table, or the part of it in the touched buckets; only folders of newest batches are scanned."""
        newest = self.commits().groupBy(_HASH).agg(F.max("batch").alias("batch"))
        if touched is not None:
            newest = newest.join(touched, _HASH, "left_semi")
        if not self._exists():
            return None
        # at most one row a bucket: pruned at run time by both folder columns
        return self.spark.read.parquet(f"{self.path}/rows").join(F.broadcast(newest), [_HASH, "batch"]).drop(_HASH, "batch")

    def upsert(self, new: DataFrame, batch: int, order: Sequence[str] = ()) -> bool:
        """Merge a batch; False when it is empty or was committed before."""
        if new.isEmpty() or not self.commits().where(F.col("batch") >= batch).isEmpty():
            return False
        fresh = keep_latest(new, self.keys, order).select(*new.columns) if order else new
        touched = fresh.select(self._bucket()).distinct()
        old = self.read(touched)
        merged = fresh if old is None else upsert(old.select(*fresh.columns), fresh, self.keys)
        placed = merged.select("*", self._bucket(), F.lit(batch).cast("long").alias("batch"))
        writer = placed.repartition(_HASH).sortWithinPartitions(_HASH, *self.keys).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(_HASH, "batch").parquet(f"{self.path}/rows")
        # of these buckets only: an unfinished writer may have left others under the same number
        written = self.spark.read.parquet(f"{self.path}/rows").where(F.col("batch") == batch).join(touched, _HASH, "left_semi")
        rows = written.groupBy(_HASH).agg(F.count("*").alias("rows")).withColumn("batch", F.lit(batch).cast("long"))
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return True

    def compact(self, path: str) -> KeyedTable:
        """A copy of the newest rows alone, as the first batch of another table."""
        out = KeyedTable(self.spark, path, self.keys, self.buckets)
        table = self.read()
        if table is not None:
            out.upsert(table, 0)
        return out


def upsert_batches(path: str, keys: Sequence[str], order: Sequence[str], buckets: int = 256):
    """foreachBatch function: each micro-batch once, whatever is replayed."""

    def write(batch: DataFrame, number: int) -> None:
        KeyedTable(batch.sparkSession, path, keys, buckets).upsert(batch, number, order)

    return write
