"""Evidence integrity: hashes, custody chains, assessment deltas and as-of history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom import lexicons as lx
from threadloom.functions import ordered


def hash_content(df: DataFrame, content: str = "text") -> DataFrame:
    """SHA-256 and size in bytes; works for text and for the content column of binary files."""
    return df.withColumns({"hash": F.sha2(F.col(content), 256), "size_bytes": F.octet_length(content)})


def verify_hashes(df: DataFrame, expected: DataFrame, key: str, content: str = "text") -> DataFrame:
    checked = hash_content(df, content).join(expected.select(key, F.col("hash").alias("expected")), key)
    return checked.select(key, "hash", "expected", (F.lower("hash") == F.lower("expected")).alias("valid"))


def create_chains(files: DataFrame, evidence_id: str, name: str, content: str, ts: Column, operator: str = "system") -> DataFrame:
    """First record ('original') of every evidence item, with its mime type by extension."""
    mime = F.create_map(*[F.lit(x) for kv in lx.MIME_TYPES.items() for x in kv])
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return hash_content(files, content).select(
        F.col(evidence_id).alias("evidence_id"),
        F.lit(0).alias("seq"),
        F.lit("original").alias("stage"),
        "hash",
        F.lit(None).cast("string").alias("input_hash"),
        ts.alias("ts"),
        F.lit(operator).alias("operator"),
        F.coalesce(F.try_element_at(mime, extension), F.lit("application/octet-stream")).alias("mime_type"),
        "size_bytes",
    )


def add_stages(base: DataFrame, stages: Sequence[tuple[str, DataFrame, Column]], operator: str = "system") -> DataFrame:
    """Append processing stages (name, results, time) in order; ``results`` has ``evidence_id, hash``.

    A record's input hash is the hash before it, its number follows on, and mime type and size come from the first
    record. All records are put together once and linked by one window per item, so the plan grows with the stages
    and not with their square or more. Results of items without a first record are left out.
    """
    columns = ["evidence_id", "seq", "stage", "hash", "input_hash", "ts", "operator", "mime_type", "size_bytes"]
    rows = base.select(*columns, F.lit(0).alias("__stage"))
    for number, (stage, results, ts) in enumerate(stages, 1):
        rows = rows.unionByName(results.select(
            "evidence_id", F.lit(None).cast("int").alias("seq"), F.lit(stage).alias("stage"), "hash",
            F.lit(None).cast("string").alias("input_hash"), ts.alias("ts"), F.lit(operator).alias("operator"),
            F.lit(None).cast("string").alias("mime_type"), F.lit(None).cast("long").alias("size_bytes"), F.lit(number).alias("__stage"),
        ))
    order = Window.partitionBy("evidence_id").orderBy("__stage", "seq")
    first = lambda c: F.first(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    added = F.col("__stage") > 0
    return rows.select(
        "evidence_id", (F.row_number().over(order) - 1).alias("seq"), "stage", "hash",
        F.when(added, F.lag("hash").over(order)).otherwise(F.col("input_hash")).alias("input_hash"),
        "ts", "operator", first("mime_type").alias("mime_type"), first("size_bytes").alias("size_bytes"),
        F.min("__stage").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("__least"),
    ).where("__least = 0").drop("__least")


def chain_links(chain: DataFrame, block: int = 10_000) -> DataFrame:
    """Every record with the hash, time and stage before it."""
    return ordered.previous(
        chain, ["evidence_id"], ["seq"], F.floor(F.col("seq") / block),
        {"prev_hash": "hash", "prev_ts": "ts", "prev_stage": "stage"},
    )


def verify_chains(evidence: DataFrame, chain: DataFrame) -> DataFrame:
    """Validity per evidence item with error and warning counts and the first of each.

    ``evidence`` has ``evidence_id, original_hash``; items without records are invalid. Messages
    of single records are available from :func:`chain_problems`; the verdict itself is a plain
    aggregation.
    """
    problems = chain_problems(evidence, chain)
    per = problems.groupBy("evidence_id").agg(
        F.count_if(F.col("kind") == "error").alias("n_errors"),
        F.count_if(F.col("kind") == "warning").alias("n_warnings"),
        F.min_by(F.when(F.col("kind") == "error", F.col("message")), F.when(F.col("kind") == "error", F.struct("seq", "message"))).alias("first_error"),
    )
    sizes = chain.groupBy("evidence_id").agg(
        F.count("*").alias("chain_length"), F.max_by("stage", "seq").alias("__last")
    )
    joined = evidence.select("evidence_id").join(sizes, "evidence_id", "left").join(per, "evidence_id", "left")
    joined = joined.fillna(0, ["chain_length", "n_errors", "n_warnings"])
    valid = F.col("n_errors") == 0
    return joined.select(
        "evidence_id", "chain_length", valid.alias("valid"), "n_errors", "n_warnings", "first_error",
        F.when(valid, F.col("__last")).alias("last_verified_stage"),
    )


def chain_problems(evidence: DataFrame, chain: DataFrame) -> DataFrame:
    """One row per problem: (evidence_id, seq, kind, message)."""
    linked = chain_links(chain).join(evidence.select("evidence_id", "original_hash"), "evidence_id")
    first = F.col("prev_hash").isNull() & F.col("prev_ts").isNull() & F.col("prev_stage").isNull()
    broken = ~first & F.col("input_hash").isNotNull() & (F.col("input_hash") != F.col("prev_hash"))
    problem = lambda cond, kind, text: F.when(cond, F.struct(F.lit(kind).alias("kind"), text.alias("message")))
    found = F.array_compact(F.array(
        problem(first & (F.col("stage") != "original"), "error",
                F.format_string("First stage should be 'original', found '%s'", "stage")),
        problem(first & (F.col("hash") != F.col("original_hash")), "error", F.lit("Original hash mismatch")),
        problem(broken, "error", F.format_string(
            "Chain break at stage %d (%s): input hash doesn't match previous output", "seq", "stage")),
        problem(~first & (F.col("ts") < F.col("prev_ts")), "warning", F.format_string(
            "Timestamp anomaly at stage %d: %s is before %s", "seq", "stage", "prev_stage")),
    ))
    inside = linked.select("evidence_id", "seq", F.explode(found).alias("p")).select("evidence_id", "seq", "p.*")
    missing = evidence.join(chain.select("evidence_id").distinct(), "evidence_id", "left_anti").select(
        "evidence_id", F.lit(0).alias("seq"), F.lit("error").alias("kind"),
        F.lit("Chain is empty - no processing records").alias("message"),
    )
    return inside.unionByName(missing)


def court_rows(chain: DataFrame) -> DataFrame:
    return chain.select(
        F.col("evidence_id").alias("Evidence ID"), F.col("stage").alias("Stage"), F.col("hash").alias("Hash"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("Timestamp"), F.col("operator").alias("Operator"),
    )


def chain_timeline(chain: DataFrame) -> DataFrame:
    """Timeline entries with the hash cut to sixteen digits."""
    return chain.select("evidence_id", "seq", "stage", F.concat(F.substring("hash", 1, 16), F.lit("...")).alias("hash"), "ts")


def report_lines(chain: DataFrame) -> DataFrame:
    """Report text, one numbered block per record."""
    block = F.format_string(
        "%d. %s\n   Hash: %s\n   Time: %s", F.col("seq") + 1, F.upper("stage"), "hash", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    )
    return chain.select("evidence_id", "seq", block.alias("block"))


def assessment_delta(preliminary: DataFrame, full: DataFrame, key: str = "evidence_id") -> DataFrame:
    """Change from preliminary to full assessment (``severity, confidence, patterns``)."""
    p, f = preliminary.alias("p"), full.alias("f")
    change = F.col("f.severity") - F.col("p.severity")
    added = F.array_sort(F.array_except("f.patterns", "p.patterns"))
    removed = F.array_sort(F.array_except("p.patterns", "f.patterns"))
    differs = (F.size(added) + F.size(removed)) > 0
    conflicts = (F.abs(change) > 3).cast("int") + differs.cast("int")
    return p.join(f, F.col(f"p.{key}") == F.col(f"f.{key}")).select(
        F.col(f"p.{key}").alias(key),
        change.alias("severity_change"),
        (F.col("f.confidence") - F.col("p.confidence")).alias("confidence_change"),
        added.alias("added_patterns"),
        removed.alias("removed_patterns"),
        conflicts.alias("contradictions"),
        (conflicts > 0).alias("significant"),
    )


def analysis_at(snapshots: DataFrame, moment: Column, ts: str = "ts") -> DataFrame:
    """Snapshots known at a moment, newest first."""
    return snapshots.where(F.col(ts) <= moment).orderBy(F.desc(ts), "evidence_id")


def latest_at(snapshots: DataFrame, moment: Column, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    rest = [c for c in snapshots.columns if c not in keys]
    rows = snapshots.where(F.col(ts) <= moment).groupBy(*keys).agg(F.max_by(F.struct(*rest), ts).alias("r"))
    return rows.select(*keys, "r.*")


def supersede(hypotheses: DataFrame, changes: DataFrame) -> DataFrame:
    """Mark hypotheses replaced by a change (``old_id, new_id``) and keep the rest current."""
    by = changes.groupBy(F.col("old_id").alias("id")).agg(F.max("new_id").alias("__by"))
    marked = hypotheses.join(by, "id", "left")
    return marked.withColumn("superseded_by", F.coalesce("__by", "superseded_by")).drop("__by").withColumn(
        "current", F.col("superseded_by").isNull()
    )


def report_timeline(**parts: DataFrame) -> DataFrame:
    """Hypotheses, preliminary and final assessments (``ts, ref, text``) in one chronology."""
    out = None
    for kind, df in parts.items():
        one = df.select(F.lit(kind).alias("kind"), "ts", "ref", "text")
        out = one if out is None else out.unionByName(one)
    return out.orderBy("ts", "kind", "ref")


def pattern_sequences(matches: DataFrame, pattern: str, evidence: str, ts: str) -> DataFrame:
    """Occurrences, period and number of distinct evidence items per pattern."""
    return matches.groupBy(pattern).agg(
        F.count("*").alias("occurrences"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"),
        F.count_distinct(evidence).alias("n_evidence"),
    )
