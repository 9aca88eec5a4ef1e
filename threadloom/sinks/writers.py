"""Exports. Every writer is a distributed write; only counts travel to the driver."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.ordered import running_sums
from threadloom.operators.tables import upsert


def write_json(messages: DataFrame, path: str, exported_at: str | None = None) -> None:
    """Message rows as JSON lines and, beside them, a one-row manifest with the count."""
    messages.write.mode("overwrite").json(f"{path}/messages")
    manifest = messages.agg(F.count("*").alias("count"))
    if exported_at:
        manifest = manifest.withColumn("exported", F.lit(exported_at))
    manifest.write.mode("overwrite").json(f"{path}/manifest")


CSV_FIELDS = ["date", "readableDate", "contactName", "address", "body"]


def csv_rows(messages: DataFrame) -> DataFrame:
    """The five export fields, line breaks as blanks, values cut to 500 characters."""
    value = lambda c: F.substring(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "\n", " "), 1, 500)
    return messages.select(*[(value(c) if c in messages.columns else F.lit("")).alias(c) for c in CSV_FIELDS])


def write_csv(messages: DataFrame, path: str) -> None:
    _csv(csv_rows(messages), path)


def _csv(rows: DataFrame, path: str) -> None:
    """Fully quoted CSV with quotes doubled; blanks at either end of a value are part of it."""
    writer = rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def markdown_lines(messages: DataFrame, order: Sequence[str]) -> DataFrame:
    """Markdown block per message: bold header line and quoted body."""
    present = lambda *names: [F.col(n).cast("string") for n in names if n in messages.columns]
    date = F.coalesce(*present("readableDate", "readable_date", "date"), F.lit("N/A"))
    sender = F.coalesce(*present("contactName", "contact_name", "sender", "address"), F.lit("Unknown"))
    return messages.select(*order, F.format_string("**[%s] %s**\n> %s\n", date, sender, F.coalesce("body", F.lit(""))).alias("value"))


def write_markdown(messages: DataFrame, path: str, order: Sequence[str]) -> None:
    """Blocks in order across the part files: range partitions, sorted inside each."""
    lines = markdown_lines(messages, order)
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def write_by_platform(messages: DataFrame, path: str, platforms: Sequence[str], default: str = "sms") -> None:
    """One partition folder per platform; unknown platforms go to the default one."""
    routed = messages.withColumn(
        "platform", F.when(F.lower("platform").isin(list(platforms)), F.lower("platform")).otherwise(default)
    )
    routed.write.mode("overwrite").partitionBy("platform").parquet(path)


def upsert_folder(new: DataFrame, path: str, keys: Sequence[str], out: str) -> None:
    """Merge new rows into the table at ``path`` and write the result to ``out``."""
    spark = new.sparkSession
    upsert(spark.read.parquet(path), new, keys).write.mode("overwrite").parquet(out)


def document_records(docs: DataFrame, chunks: DataFrame, entities: DataFrame) -> dict[str, DataFrame]:
    """documents, chunks and entities tables with counts and generated ids."""
    per_chunk = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    per_entity = entities.groupBy("doc_id").agg(F.count("*").alias("entity_count"))
    documents = docs.join(per_chunk, "doc_id", "left").join(per_entity, "doc_id", "left").fillna(0, ["chunk_count", "entity_count"])
    numbered = running_sums(
        entities, ["doc_id"], ["start", "end", "type"], F.floor(F.col("start") / 1_000_000), {"__n": F.lit(1)}
    )
    named = numbered.withColumn("id", F.concat_ws("-", "doc_id", F.lit("entity"), F.col("__n") - 1)).drop("__n")
    return {"documents": documents, "chunks": chunks, "entities": named}


def vector_rows(vectors: DataFrame, id_col: str, vec_col: str, metadata: Sequence[str]) -> DataFrame:
    return vectors.select(
        F.col(id_col).cast("string").alias("id"), F.col(vec_col).alias("values"), F.to_json(F.struct(*metadata)).alias("metadata")
    )


def vector_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.size("values").alias("dimension")).agg(F.count("*").alias("n_vectors"))


def batch_export(df: DataFrame, destinations: Mapping[str, Callable[[DataFrame], None]]) -> DataFrame:
    """Run every destination's distributed write; a failure is reported, not raised."""
    rows = []
    for name, write in destinations.items():
        try:
            write(df)
            rows.append((name, True, None))
        except Exception as error:  # one destination must not stop the others
            rows.append((name, False, type(error).__name__))
    return df.sparkSession.createDataFrame(rows, "destination string, success boolean, error string")


def write_chunks(chunks: DataFrame, path: str, fmt: str = "jsonl") -> None:
    if fmt == "csv":
        _csv(chunks, path)
    else:
        chunks.write.mode("overwrite").json(path)


def split_conversations(turns: DataFrame, path: str, n: int, key: str = "conv_id") -> None:
    """Folders of ``n`` conversations each."""
    numbered_file(turns, n, key).write.mode("overwrite").partitionBy("file_no").json(path)


def numbered_file(turns: DataFrame, n: int, key: str = "conv_id", width: int = 100_000) -> DataFrame:
    """Turns with the file their conversation goes to (conversations counted in key order)."""
    ids = turns.select(key).distinct()
    ranked = running_sums(ids, [], [key], F.floor(F.col(key) / width), {"__r": F.lit(1)})
    return turns.join(ranked.select(key, F.floor((F.col("__r") - 1) / n).alias("file_no")), key)


def write_log(entries: DataFrame, predicate: Column, path: str) -> None:
    """Filtered log rows as JSON lines."""
    entries.where(predicate).write.mode("overwrite").json(path)


def processing_summary(original: DataFrame, processed: DataFrame, key: str = "doc_id", text: str = "text", result: str = "summary") -> DataFrame:
    """Sizes before and after and the reduction in per cent."""
    a = original.groupBy(key).agg(F.sum(F.length(text)).alias("original_size"))
    b = processed.groupBy(key).agg(F.sum(F.length(result)).alias("processed_size"), F.count("*").alias("n_parts"))
    return a.join(b, key).withColumn(
        "reduction", F.when(F.col("original_size") == 0, 0).otherwise(
            F.round((1 - F.col("processed_size") / F.col("original_size")) * 100)).cast("int")
    )
