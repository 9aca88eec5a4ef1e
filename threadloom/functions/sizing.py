"""Size checks that decide between broadcasting a table and shuffling it."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
INLINE_ROWS = 5_000


def rows_within(df: DataFrame, limit: int) -> list[Row] | None:
    """The rows when there are at most ``limit`` of them, else None."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a table whose row count was checked; otherwise leave it to a shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def inline_rows(rows: Sequence[Row], schema: str) -> Column:
    """A constant array<struct> holding rows of a checked size, usable inside a projection."""
    payload = json.dumps([r.asDict(recursive=True) for r in rows], default=str)
    return F.from_json(F.lit(payload), f"array<struct<{schema}>>")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-distribute a table that arrives in fewer partitions than there are cores.

    Text work is CPU-bound; a table read as one or two file splits would leave most cores idle.
    A large table already has more splits than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def row_blocks(df: DataFrame, key: str, limit: int) -> list[list[Row]]:
    """The rows of a rule or term table in blocks of about ``limit`` rows, for repeated inlining."""
    rows = rows_within(df, limit)
    if rows is not None:
        return [rows]
    n = df.count() // limit * 2 + 2
    block = F.pmod(F.xxhash64(key), F.lit(n))
    return [df.where(block == i).collect() for i in range(n)]
