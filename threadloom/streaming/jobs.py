"""Structured Streaming forms of the batch operators.

Sources are any streaming DataFrames; every stateful job takes an explicit watermark and keeps a
bounded state per key. Checkpoints and sink tables live below the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType

from threadloom.operators.tables import upsert
from threadloom.session import scratch_path


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """Incremental file source over a file, a table stored as a folder of part files, or a glob of either.

    The checkpoint records which files were read, which is the resume point.
    """
    if not any(c in path for c in "*?[{"):
        # the source takes a plain path for a partitioned folder and refuses files; a glob of one name takes both
        path = path.rstrip("/")
        path = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def run_to_table(stream: DataFrame, name: str, mode: str = "append", path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process everything available into a Parquet table and return it."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    checkpoint = checkpoint or scratch_path(spark, f"{name}-checkpoint")
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Process everything available through ``foreachBatch``."""
    query = (
        stream.writeStream.foreachBatch(each).outputMode(mode)
        .option("checkpointLocation", checkpoint or scratch_path(stream.sparkSession, f"{name}-checkpoint"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


class Clock:
    """A second source that only moves the watermark: ``strike`` adds a row at a time, the rest of the row is null.

    A finished stream leaves its last windows, sessions and waiting rows open. ``run_closed`` runs it, strikes the clock
    past its end and runs it on from its checkpoint, so append mode ends with everything that was read.
    """

    def __init__(self, spark: SparkSession, schema, ts: str = "ts"):
        self.spark, self.ts, self.path = spark, ts, scratch_path(spark, "clock")
        # a struck row is of no key, so every column may be null
        self.schema = StructType([StructField(f.name, f.dataType, True) for f in schema])
        spark.createDataFrame([], self.schema).write.parquet(self.path)

    def strike(self, at: Column) -> None:
        row = self.spark.range(1).select(*[(at if f.name == self.ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema])
        row.write.mode("append").parquet(self.path)

    def joined(self, stream: DataFrame) -> DataFrame:
        return stream.unionByName(file_stream(self.spark, self.path, self.schema))


def run_closed(stream: DataFrame, job: Callable[[DataFrame], DataFrame], name: str, last: Column, ts: str = "ts") -> DataFrame:
    """The job's rows in append mode over all of the stream, with everything closed that ends before ``last``.

    Rows of the clock itself stay open: ``last`` lies a watermark delay past the end of the stream.
    """
    spark = stream.sparkSession
    clock = Clock(spark, stream.schema, ts)
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    run_to_table(job(clock.joined(stream)), name, path=path, checkpoint=checkpoint)
    clock.strike(last)
    return run_to_table(job(clock.joined(stream)), name, path=path, checkpoint=checkpoint)


def event_time(stream: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Watermarked stream; a time without zone is read as UTC because watermarks need an instant."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def filtered_logs(stream: DataFrame, predicate: Column) -> DataFrame:
    return stream.where(predicate)


def sliding_metrics(stream: DataFrame, window: str = "60 seconds", slide: str = "2 seconds", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Rate, mean latency and error rate per sliding window."""
    grouped = event_time(stream, ts, delay).groupBy(F.window(ts, window, slide).alias("w"))
    seconds = F.unix_seconds("w.end") - F.unix_seconds("w.start")
    return grouped.agg(
        F.count("*").alias("requests"), F.avg("duration").alias("avg_latency"), F.avg((~F.col("success")).cast("int")).alias("error_rate")
    ).select(F.col("w.start").alias("start"), "requests", (F.col("requests") / seconds).alias("rate"), "avg_latency", "error_rate")


def hourly_stats(stream: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Tumbling hours; an hour is emitted once the watermark passes it."""
    grouped = event_time(stream, ts, delay).groupBy(F.window(ts, "1 hour").alias("w"))
    return grouped.agg(
        F.count("*").alias("calls"), F.count_if("success").alias("successes"), F.sum("duration").alias("total_duration")
    ).select(F.col("w.start").alias("hour"), "calls", "successes", "total_duration")


def sessions(stream: DataFrame, key: str, gap: str = "2 hours", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    grouped = event_time(stream, ts, delay).groupBy(key, F.session_window(ts, gap).alias("w"))
    return grouped.agg(F.count("*").alias("message_count")).select(key, F.col("w.start").alias("start_ts"), "message_count")


def first_copies(stream: DataFrame, text: str = "text", ts: str = "ts", delay: str = "72 hours") -> DataFrame:
    """Each content once within the watermark delay."""
    hashed = event_time(stream, ts, delay).withColumn("content_hash", F.sha2(text, 256))
    return hashed.dropDuplicatesWithinWatermark(["content_hash"])


def alerts(stream: DataFrame, rules: Sequence[dict], id_col: str, text_col: str) -> DataFrame:
    """Screening matches of incoming messages; the rules are constants, so the job is stateless."""
    from threadloom.operators.patterns import regex_matches

    return regex_matches(stream, rules, id_col, text_col).drop(text_col)


def chunk_stream(stream: DataFrame, size: int, overlap: int, id_col: str, text_col: str) -> DataFrame:
    from threadloom.operators.chunking import fixed_chunks

    return fixed_chunks(stream, size, overlap, id_col, text_col)


def upsert_batches(path: str, keys: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """Idempotent upsert sink: batch ``n`` merges into version ``n`` of the table.

    A replayed batch rewrites the same version from the version before it, so retries and
    restarts leave the same table. ``latest_version`` reads the newest complete one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        from threadloom.operators.tables import keep_latest

        spark = batch.sparkSession
        fresh = keep_latest(batch, keys, order).select(*batch.columns)
        before = [v for v in versions(spark, path) if v < batch_id]
        merged = upsert(spark.read.parquet(f"{path}/v={before[-1]}"), fresh, keys) if before else fresh
        merged.write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return write


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions below a path, oldest first."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    names = [s.getPath() for s in fs.listStatus(hadoop)]
    done = [p for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done if p.getName().startswith("v="))


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v={versions(spark, path)[-1]}")


def newest_batches(path: str, order: Sequence[Column], n: int) -> Callable[[DataFrame, int], None]:
    """Sink of a bounded buffer: version ``k`` holds the newest ``n`` rows up to batch ``k``.

    A replayed batch rewrites its version from the one before it; older versions go.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark, path) if v < batch_id]
        rows = spark.read.schema(batch.schema).parquet(f"{path}/v={before[-1]}").unionByName(batch) if before else batch
        rows.orderBy(*order).limit(n).write.mode("overwrite").parquet(f"{path}/v={batch_id}")
        for old in before[:-1]:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={old}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return write


# --- custom state ----------------------------------------------------------------------------

STATE_TTL_MS = 30 * 24 * 3600 * 1000


def _expire_later(state: GroupState, last_ms: int) -> None:
    """Drop the state once the watermark is a TTL past the key's last event.

    Event time, because a processing-time timeout keeps an available-now query running for ever.
    """
    state.setTimeoutTimestamp(max(last_ms, state.getCurrentWatermarkMs()) + STATE_TTL_MS)


def averages_stream(stream: DataFrame, alpha: float = 0.1, delay: str = "72 hours") -> DataFrame:
    """Running averages per provider after every batch (``provider, event_id, ts, success, duration``).

    A row weighs ``alpha`` times ``1 - alpha`` to the power of the rows after it. After ``depth`` rows that is less than the
    least positive double, so a task holds the newest ``depth`` rows and successes; all rows are read and counted.
    """
    depth = math.ceil(math.log(5e-324) / math.log(1 - alpha)) + 1 if alpha < 1 else 1

    kinds = {"us": np.int64, "event_id": np.int64, "success": np.bool_, "duration": np.float64}

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ok, latency, calls = state.get if state.exists else (1.0, 0.0, 0)
        held = None
        for pdf in batches:
            part = [pdf[c].to_numpy(kind) for c, kind in kinds.items()]
            calls += len(pdf)
            held = part if held is None else [np.concatenate(x) for x in zip(held, part)]
            order = np.lexsort((held[1], held[0]))
            held = [x[order] for x in held]
            felt = np.arange(len(order)) >= len(order) - depth
            felt[np.flatnonzero(held[2] & (held[3] > 0))[-depth:]] = True
            held = [x[felt] for x in held]
        us, _, success, duration = held
        for s, d in zip(success.tolist(), duration.tolist()):
            ok = alpha * s + (1 - alpha) * ok
            if s and d > 0:
                latency = alpha * d + (1 - alpha) * latency
        state.update((ok, latency, calls))
        _expire_later(state, int(us[-1]) // 1000)
        yield pd.DataFrame([(key[0], calls, ok, latency)], columns=["provider", "calls", "success_rate", "avg_latency"])

    timed = event_time(stream, "ts", delay).withColumn("us", F.unix_micros("ts"))
    return timed.groupBy("provider").applyInPandasWithState(
        step,
        "provider string, calls long, success_rate double, avg_latency double",
        "ok double, latency double, calls long",
        "update",
        GroupStateTimeout.EventTimeTimeout,
    )
