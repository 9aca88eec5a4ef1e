"""Ordered analytics that stay parallel when one key holds a large share of the rows.

A plain window over a hot key sorts that key in a single task. Here each key is cut into
ordered buckets (a day, a block of line numbers); lags and running sums are computed inside
the buckets, and only one summary row per bucket travels through the per-key window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "__bucket"


def _with_bucket(df: DataFrame, bucket: Column) -> DataFrame:
    return df.withColumn(_BUCKET, bucket)


def _joined(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the summary of their key and bucket; a null key is a key like others."""
    own = [*keys, _BUCKET]
    right = summary.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(own)], *[c for c in summary.columns if c not in own])
    same = [F.col(k).eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(own)]
    return rows.join(right, same).drop(*[f"__r{i}" for i in range(len(own))])


def _neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    columns: Mapping[str, str],
    backwards: bool,
) -> DataFrame:
    rows = _with_bucket(df, bucket)
    packed = F.struct(*[F.col(src).alias(new) for new, src in columns.items()])
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(_BUCKET)
    edge, shift = (F.max_by, F.lag) if backwards else (F.min_by, F.lead)
    edges = (
        rows.groupBy(*keys, _BUCKET)
        .agg(edge(packed, F.struct(*order)).alias("__edge"))
        .select(*keys, _BUCKET, shift("__edge").over(across).alias("__carry"))
    )
    joined = _joined(rows.withColumn("__near", shift(packed).over(inside)), edges, keys)
    picked = {
        new: F.when(F.col("__near").isNotNull(), F.col("__near")[new]).otherwise(
            F.col("__carry")[new]
        )
        for new in columns
    }
    return joined.withColumns(picked).drop(_BUCKET, "__near", "__carry")


def previous(df, keys, order, bucket, columns) -> DataFrame:
    """Add ``columns`` (new name -> source name) taken from the preceding row of the same key.

    ``bucket`` must not decrease along ``order``, and ``order`` must be unique within a key.
    """
    return _neighbour(df, keys, order, bucket, columns, backwards=True)


def following(df, keys, order, bucket, columns) -> DataFrame:
    """Like :func:`previous`, from the next row."""
    return _neighbour(df, keys, order, bucket, columns, backwards=False)


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    sums: Mapping[str, Column],
) -> DataFrame:
    """Add inclusive running sums per key; ``F.lit(1)`` gives a row number."""
    rows = _with_bucket(df, bucket).withColumns({f"__{n}": e for n, e in sums.items()})
    inside = (
        Window.partitionBy(*keys, _BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = (
        Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = rows.groupBy(*keys, _BUCKET).agg(
        *[F.sum(f"__{n}").alias(f"__total_{n}") for n in sums]
    )
    offsets = totals.select(
        *keys,
        _BUCKET,
        *[F.coalesce(F.sum(f"__total_{n}").over(before), F.lit(0)).alias(f"__off_{n}") for n in sums],
    )
    out = rows.withColumns({n: F.sum(f"__{n}").over(inside) for n in sums})
    out = _joined(out, offsets, keys)
    out = out.withColumns({n: F.col(n) + F.col(f"__off_{n}") for n in sums})
    return out.drop(_BUCKET, *[f"__{n}" for n in sums], *[f"__off_{n}" for n in sums])


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], bucket: Column
) -> DataFrame:
    """Exact interpolated percentiles per key.

    Equal values are counted before the shuffle and the cumulative counts are built bucket by
    bucket, so no task ever holds all values of a hot key.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    cumulated = running_sums(counts, keys, [value], bucket, {"__upto": F.col("__n")})
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__size"))
    if keys:
        ranked = cumulated.join(totals, list(keys))
    else:
        size = totals.first()["__size"] or 0
        ranked = cumulated.withColumn("__size", F.lit(size))
    aggs = []
    for name, p in probs.items():
        target = F.lit(float(p)) * (F.col("__size") - 1)
        low, high = F.floor(target) + 1, F.ceil(target) + 1
        covers = lambda rank: (F.col("__upto") >= rank) & (F.col("__upto") - F.col("__n") < rank)
        lower = F.max(F.when(covers(low), F.col(value)))
        upper = F.max(F.when(covers(high), F.col(value)))
        share = F.max(target - F.floor(target))
        aggs.append((lower + (upper - lower) * share).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)
