"""Usage, latency, cost and log statistics over call and event tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.ordered import exact_percentiles, running_sums

LATENCY_PROBS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def call_stats(
    calls: DataFrame, keys: Sequence[str], percentile_bucket: Column | None = None
) -> DataFrame:
    """Counts, latency, tokens, cost, last use and last error per tool or provider.

    ``calls`` has ``ts, duration, success, error, tokens, cost``. With a bucket expression over
    ``duration`` exact p50/p95/p99 are added.
    """
    failed = ~F.col("success")
    stats = calls.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        F.count_if("success").alias("successes"),
        F.count_if(failed).alias("failures"),
        F.avg("duration").alias("avg_duration"),
        F.sum("tokens").alias("total_tokens"),
        F.sum("cost").alias("total_cost"),
        F.max("ts").alias("last_used"),
        F.max_by(F.when(failed, F.col("error")), F.when(failed, F.col("ts"))).alias("last_error"),
    )
    if percentile_bucket is None:
        return stats
    return stats.join(
        exact_percentiles(calls, keys, "duration", LATENCY_PROBS, percentile_bucket), list(keys)
    )


def call_stats_approx(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketched percentiles in one pass, for dashboards."""
    return calls.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        F.percentile_approx("duration", [0.5, 0.95, 0.99], 10_000).alias("p"),
    ).select(
        *keys, "calls", *[F.col("p")[i].alias(n) for i, n in enumerate(LATENCY_PROBS)]
    )


def hourly_stats(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(
        F.count("*").alias("calls"),
        F.count_if("success").alias("successes"),
        F.count_if(~F.col("success")).alias("failures"),
        F.sum("duration").alias("total_duration"),
        F.sum("tokens").alias("total_tokens"),
        F.sum("cost").alias("total_cost"),
    )


def hourly_breakdown(calls: DataFrame, by: str, values: Sequence[str]) -> DataFrame:
    """Calls per hour with one column per tool or provider."""
    hourly = calls.groupBy(F.date_trunc("hour", "ts").alias("hour"))
    return hourly.pivot(by, list(values)).agg(F.count(F.lit(1))).fillna(0, list(values))


def dashboard_summary(calls: DataFrame) -> DataFrame:
    return calls.agg(
        F.count("*").alias("total_calls"),
        F.avg(F.col("success").cast("int")).alias("success_rate"),
        F.avg("duration").alias("avg_latency"),
        F.sum("tokens").alias("total_tokens"),
        F.sum("cost").alias("total_cost"),
        F.count_distinct("tool").alias("active_tools"),
        F.count_distinct("provider").alias("active_providers"),
    )


def hour_trend(calls: DataFrame, hours: int = 24) -> DataFrame:
    """The last ``hours`` hours up to the newest call, empty hours as zero."""
    newest = calls.agg(F.date_trunc("hour", F.max("ts")).alias("last"))
    grid = newest.select(
        F.explode(F.expr(f"sequence(last - interval {hours - 1} hours, last, interval 1 hour)")).alias("hour")
    )
    counted = calls.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(
        F.count("*").alias("calls"), F.count_if("success").alias("successes")
    )
    return grid.join(counted, "hour", "left").fillna(0, ["calls", "successes"])


def heatmap(calls: DataFrame) -> DataFrame:
    """Calls per weekday (0 = Sunday) and hour, all 168 cells."""
    counted = calls.groupBy(
        (F.dayofweek("ts") - 1).alias("day"), F.hour("ts").alias("hour")
    ).agg(F.count("*").alias("value"))
    cells = calls.sparkSession.range(7 * 24).select(
        F.floor(F.col("id") / 24).cast("int").alias("day"), (F.col("id") % 24).cast("int").alias("hour")
    )
    return cells.join(counted, ["day", "hour"], "left").fillna(0, ["value"])


def usage_stats(calls: DataFrame, key: str) -> DataFrame:
    """Per API key: calls, tokens, cost, mean latency and the share of 2xx answers."""
    ok = F.col("status").between(200, 299)
    return calls.groupBy(key).agg(
        F.count("*").alias("calls"),
        F.sum("tokens").alias("tokens"),
        F.sum("cost").alias("cost"),
        F.avg("duration").alias("avg_latency"),
        F.avg(ok.cast("int")).alias("success_rate"),
    )


def prompt_usage(calls: DataFrame, key: str) -> DataFrame:
    """Uses, success in percent and mean duration. A mean of a half goes up whatever the order in which doubles were added."""
    return calls.groupBy(key).agg(
        F.count("*").alias("usage_count"),
        F.round(F.avg(F.col("success").cast("int")) * 100).cast("int").alias("success_rate"),
        F.round(F.round(F.avg("duration"), 9)).cast("int").alias("avg_latency"),
    )


def metric_aggregates(
    points: DataFrame, start: Column, end: Column, names: Sequence[str] | None = None
) -> DataFrame:
    """count/sum/avg/min/max per metric name inside a time range."""
    inside = points.where((F.col("ts") >= start) & (F.col("ts") <= end))
    if names is not None:
        inside = inside.where(F.col("name").isin(list(names)))
    return inside.groupBy("name").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    )


def invocation_summary(spans: DataFrame, since: Column) -> DataFrame:
    """Invocations, errors and mean duration per tool since a time; spans without end are active."""
    recent = spans.where(F.col("start_ts") >= since)
    return recent.groupBy("tool").agg(
        F.count("*").alias("invocations"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.avg("duration").alias("avg_duration"),
        F.count_if(F.col("end_ts").isNull()).alias("active"),
    )


def embedding_stats(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    return chunks.groupBy(*keys).agg(
        F.count_distinct("doc_id").alias("n_documents"),
        F.count("*").alias("n_chunks"),
        F.avg(F.length("chunk")).alias("avg_chunk_length"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
    )


def evidence_stats(evidence: DataFrame) -> DataFrame:
    """Counts by case and by platform, each with the earliest expiry."""

    def by(column: str) -> DataFrame:
        return evidence.groupBy(F.col(column).cast("string").alias("value")).agg(
            F.count("*").alias("n"), F.min("expires_at").alias("next_expiry")
        ).withColumn("dimension", F.lit(column))

    return by("case_id").unionByName(by("platform"))


def status_counts(tasks: DataFrame, statuses: Sequence[str]) -> DataFrame:
    return tasks.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in statuses],
    )


def category_counts(terms: DataFrame, categories: DataFrame, key: str) -> DataFrame:
    """Terms per category; categories without terms stay with 0."""
    counted = terms.groupBy(key).agg(F.count("*").alias("term_count"))
    return categories.join(counted, key, "left").fillna(0, ["term_count"])


def library_stats(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("category").agg(
        F.count("*").alias("total"),
        F.count_if("is_custom").alias("custom"),
        F.count_if(~F.col("is_custom")).alias("builtin"),
        F.avg("severity").alias("avg_severity"),
        F.max_by("name", F.struct("match_count", "name")).alias("top_matched"),
    )


def estimate_cost(input_text: Column, output_tokens: Column, input_cost: Column, output_cost: Column) -> Column:
    """Price of a request with a quarter token per character, prices per thousand tokens."""
    return (F.length(input_text) / 4 * input_cost + output_tokens * output_cost) / 1000


def spend(calls: DataFrame, unit: str, keys: Sequence[str] = ()) -> DataFrame:
    """Cost per day or month, optionally per provider."""
    return calls.groupBy(*keys, F.date_trunc(unit, "ts").alias("period")).agg(
        F.sum("cost").alias("spent"), F.count("*").alias("calls")
    )


def budget_check(calls: DataFrame, unit: str, budget: float, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Spend so far in the period before each call and whether the call still fits the budget.

    Costs are summed exactly, in decimals; hours inside a period keep the running sum parallel.
    """
    priced = calls.withColumn("period", F.date_trunc(unit, "ts")).withColumn(
        "__c", F.col("cost").cast("decimal(18,6)")
    )
    out = running_sums(priced, ["period"], list(order), F.date_trunc("hour", "ts"), {"spent": F.col("__c")})
    before = F.col("spent") - F.col("__c")
    return out.withColumns(
        {"spent_before": before, "affordable": F.col("spent") <= F.lit(budget).cast("decimal(18,6)")}
    ).drop("__c", "spent")


def rolling_metrics(calls: DataFrame, key: str, seconds: int = 60, last: int = 100) -> DataFrame:
    """Per call: requests and errors in the last minute, mean of the last hundred latencies.

    Both frames are bounded. The row frame needs the ``last - 1`` rows before each row, so each
    key is cut into blocks of rows and every block borrows the tail of the one before it.
    """
    numbered = running_sums(calls, [key], ["ts", "event_id"], F.date_trunc("day", "ts"), {"__rn": F.lit(1)})
    block = max(last * 10, 10_000)
    home = F.floor((F.col("__rn") - 1) / block)
    borrowed = F.floor((F.col("__rn") - 1 + (last - 1)) / block)
    blocks = numbered.withColumn("__home", home).withColumn(
        "__blk", F.explode(F.array_distinct(F.array(home, borrowed)))
    )
    rows = Window.partitionBy(key, "__blk").orderBy("__rn").rowsBetween(-(last - 1), 0)
    averaged = blocks.withColumn("avg_latency", F.avg("duration").over(rows)).where("__blk = __home")
    # the time frame: each row also visits the next slot, so every slot sees a full minute back
    slot = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (seconds * 60))
    later = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) + seconds - 1) / (seconds * 60))
    slots = averaged.withColumn("__slot", slot).withColumn(
        "__at", F.explode(F.array_distinct(F.array(slot, later)))
    )
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))
    span = Window.partitionBy(key, "__at").orderBy(sec).rangeBetween(-(seconds - 1), 0)
    out = slots.withColumns(
        {
            "requests": F.count("*").over(span),
            "error_rate": F.avg((~F.col("success")).cast("int")).over(span),
        }
    ).where("__at = __slot")
    return out.drop("__rn", "__home", "__blk", "__slot", "__at")


def moving_averages(calls: DataFrame, key: str, order: Sequence[str], bucket: Column, alpha: float = 0.1) -> DataFrame:
    """Exponential moving averages of success and latency per key, from 1.0 and 0.0.

    After n steps an average is (1-a)^n times the start plus the sum of a(1-a)^(n-i) times the
    i-th value, so row numbers turn the fold into a plain sum and nothing is collected. Latency
    counts successful calls with a positive duration only.
    """
    timed = F.col("success") & (F.col("duration") > 0)
    steps = {"__i": F.lit(1), "__j": timed.cast("int")}
    numbered = running_sums(calls, [key], order, bucket, steps)
    sizes = calls.groupBy(key).agg(F.count("*").alias("calls"), F.count_if(timed).alias("__m"))
    decay = F.lit(1 - alpha)
    weigh = lambda total, i, x: F.pow(decay, F.col(total) - F.col(i)) * alpha * x
    out = numbered.join(sizes, key).groupBy(key).agg(
        F.first("calls").alias("calls"),
        (F.pow(decay, F.first("calls")) + F.sum(weigh("calls", "__i", F.col("success").cast("double")))).alias("success_rate"),
        F.coalesce(F.sum(F.when(timed, weigh("__m", "__j", F.col("duration")))), F.lit(0.0)).alias("avg_latency"),
        F.max_by("success", F.struct(*order)).alias("__ok"),
    )
    return out.withColumn("available", F.col("__ok") | (F.col("success_rate") > 0.5)).drop("__ok")


# --- logs --------------------------------------------------------------------------------------


def log_filter(
    levels: Sequence[str] | None = None,
    categories: Sequence[str] | None = None,
    tools: Sequence[str] | None = None,
    trace_id: str | None = None,
    since: Column | None = None,
    search: str | None = None,
) -> Column:
    """Predicate shared by the batch and the streaming log reader; rows without a tool pass the tool test."""
    cond = F.lit(True)
    if levels:
        cond &= F.col("level").isin(list(levels))
    if categories:
        cond &= F.col("category").isin(list(categories))
    if tools:
        cond &= F.col("tool").isNull() | F.col("tool").isin(list(tools))
    if trace_id is not None:
        cond &= F.col("trace_id") == trace_id
    if since is not None:
        cond &= F.col("ts") >= since
    if search:
        term = F.lit(search.lower())
        cond &= F.contains(F.lower("message"), term) | F.contains(F.lower("data"), term)
    return cond


def newest(df: DataFrame, order: Sequence[Column], n: int, skip: int = 0) -> DataFrame:
    """The newest rows, or a page of them."""
    out = df.orderBy(*order)
    return (out.offset(skip) if skip else out).limit(n)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pivot_values(df: DataFrame, index: str, column: str, values: Sequence[str], agg: Column) -> DataFrame:
    return df.groupBy(index).pivot(column, list(values)).agg(agg)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, stddev, min and max as one row per column."""
    aggs = []
    for c in columns:
        aggs += [
            F.struct(
                F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"),
                F.stddev(c).alias("stddev"), F.min(c).cast("double").alias("low"),
                F.max(c).cast("double").alias("high"),
            )
        ]
    return df.agg(F.array(*aggs).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def group_aggregate(df: DataFrame, by: Sequence[str], aggregates: Mapping[str, str]) -> DataFrame:
    """``{'column': 'sum'}`` style aggregation."""
    allowed = {"sum": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}
    return df.groupBy(*by).agg(*[allowed[fn](c).alias(f"{c}_{fn}") for c, fn in aggregates.items()])
