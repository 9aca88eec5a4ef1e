"""Normalising raw records: canonical columns, schema inference, resolution and validation."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import lexicons as lx


def _first_of(df: DataFrame, names: Sequence[str], default: str | None = None) -> Column:
    present = [F.col(f"`{n}`").cast("string") for n in names if n in df.columns]
    parts = present + ([F.lit(default)] if default is not None else [])
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")


def normalize_messages(raw: DataFrame) -> DataFrame:
    """Raw export columns to ``message_id, ts, sender, recipient, text, type``.

    Alternatives are tried in a fixed order; a missing id becomes a hash of the content, so the
    result does not change from run to run.
    """
    ts = _first_of(raw, ["timestamp", "date", "time"])
    sender = _first_of(raw, ["sender", "from", "address"], "unknown")
    recipient = _first_of(raw, ["recipient", "to"], "unknown")
    text = _first_of(raw, ["text", "body", "message"], "")
    kind = _first_of(raw, ["type"])
    if "is_from_me" in raw.columns:
        kind = F.coalesce(F.when(F.col("is_from_me"), "sent").otherwise("received"), kind)
    given = _first_of(raw, ["id", "_id", "message_id"])
    return raw.select(
        F.coalesce(given, F.sha2(F.concat_ws("|", ts, sender, recipient, text), 256)).alias("message_id"),
        ts.alias("ts"),
        sender.alias("sender"),
        recipient.alias("recipient"),
        text.alias("text"),
        F.coalesce(kind, F.lit("unknown")).alias("type"),
    )


def message_columns(messages: DataFrame, text: str = "text", ts: str = "ts") -> DataFrame:
    """Derived columns of a message row."""
    t = F.col(text)
    return messages.withColumns(
        {
            "body_lower": F.lower(t),
            "word_count": F.size(F.split(t, r"\s+", -1)),
            "character_count": F.char_length(t),
            "content_hash": F.sha2(t, 256),
            "date_us": F.date_format(ts, "MM/dd/yyyy"),
            "time_12h": F.date_format(ts, "hh:mm a"),
        }
    )


def export_row(messages: DataFrame) -> DataFrame:
    """Processed messages to export rows with their preliminary assessment."""
    return messages.select(
        "message_id", "platform", "ts", "sender", "text",
        F.col("label").alias("preliminary_sentiment"),
        F.col("severity").alias("preliminary_severity"),
        F.col("confidence").alias("preliminary_confidence"),
    )


def infer_schema(df: DataFrame) -> DataFrame:
    """Field, type, required flag (never NULL) and an example value, from one aggregation."""
    simple = lambda t: (
        "number" if re.match(r"(tinyint|smallint|int|bigint|float|double|decimal)", t)
        else "boolean" if t == "boolean"
        else "date" if re.match(r"(date|timestamp)", t)
        else "array" if t.startswith("array")
        else "object" if re.match(r"(struct|map|variant)", t)
        else "string"
    )
    facts = [
        F.struct(
            F.lit(name).alias("field"),
            F.lit(simple(kind)).alias("type"),
            (F.count(F.col(f"`{name}`")) == F.count("*")).alias("required"),
            F.min(F.col(f"`{name}`").cast("string")).alias("example"),
        )
        for name, kind in df.dtypes
        if not kind.startswith(("array", "map", "struct"))
    ]
    return df.agg(F.array(*facts).alias("f")).select(F.explode("f").alias("f")).select(
        "f.*", F.lit(0.9).alias("confidence")
    )


def name_scores(fields: Sequence[str]) -> list[tuple[str, str, float]]:
    """(field, target, score): 1 for a known alias, else the share of the longer name that the shorter one covers."""
    def score(field: str, alias: str) -> float:
        short, long = sorted((field.casefold(), alias.casefold()), key=len)
        return len(short) / len(long) if long and short in long else 0.0

    return [(f, target, max(score(f, a) for a in aliases)) for f in fields for target, aliases in lx.FIELD_ALIASES.items()]


#: Shape of a value -> (pattern, target, confidence); a value has the first shape that fits.
VALUE_SHAPES = {
    "date": (r"^\d{4}-\d{2}-\d{2}|^\d{10,13}$", "date", 0.7),
    "phone": (r"^[\+\d\(\)\-\s]{7,}$", "address", 0.7),
    "text": (r"(?s)^.{51,}$", "body", 0.7),
    "name": (r"^[A-Za-z\s]{3,49}$", "contactName", 0.6),
}


def content_scores(df: DataFrame) -> list[tuple[str, str, float]]:
    """(field, target, score) from the most frequent shape of each column's values, one aggregation over all rows."""
    columns = [c for c, t in df.dtypes if t in ("string", "bigint", "int", "double")]
    if not columns:
        return []

    def shape(value: Column) -> Column:
        return F.coalesce(*[F.when(value.rlike(pattern), F.lit(name)) for name, (pattern, _, _) in VALUE_SHAPES.items()])

    counts = df.agg(*[
        F.struct(*[F.count_if(shape(F.col(f"`{c}`").cast("string")) == name).alias(name) for name in VALUE_SHAPES]).alias(str(i))
        for i, c in enumerate(columns)
    ]).first()
    out = []
    for i, c in enumerate(columns):
        name = max(VALUE_SHAPES, key=lambda n: counts[i][n])
        if counts[i][name]:
            out.append((c, VALUE_SHAPES[name][1], VALUE_SHAPES[name][2]))
    return out


def assign(scores: Sequence[tuple[str, str, float]], method: str, least: float, taken: Sequence[Mapping] = ()) -> list[dict]:
    """Best scores first, every field and every target once, beside what is taken already."""
    fields, targets, out = {m["source"] for m in taken}, {m["target"] for m in taken}, []
    for field, target, score in sorted(scores, key=lambda s: -s[2]):
        if score >= least and field not in fields and target not in targets:
            fields.add(field)
            targets.add(target)
            out.append(dict(source=field, target=target, confidence=score, method=method))
    return out


def resolve_schema(df: DataFrame, enough: int = 2, least: float = 0.3) -> list[dict]:
    """Field mapping: known aliases, and only while fewer than ``enough`` fit, like names and then value shapes."""
    names, out = name_scores(df.columns), []
    for method, scores, floor in (("exact", lambda: names, 1.0), ("fuzzy", lambda: names, least), ("content", lambda: content_scores(df), 0.0)):
        if len(out) < enough:
            out += assign(scores(), method, floor, out)
    return out


def mapping_table(spark, mappings: Sequence[Mapping]) -> DataFrame:
    rows = [(m["source"], m["target"], float(m["confidence"]), m["method"]) for m in mappings]
    return spark.createDataFrame(rows, "source string, target string, confidence double, method string")


def apply_mapping(df: DataFrame, mappings: Sequence[Mapping]) -> DataFrame:
    """Rename mapped fields; the others keep their value under ``_orig_<name>``."""
    renames = {m["source"]: m["target"] for m in mappings}
    return df.withColumnsRenamed({c: renames.get(c, f"_orig_{c}") for c in df.columns})


def schema_fingerprint(fields: Column) -> Column:
    """Twelve hex digits identifying a set of field names (array<string>)."""
    names = F.array_sort(F.transform(fields, F.lower))
    return F.substring(F.md5(F.array_join(names, "|")), 1, 12)


def record_mapping_use(cache: DataFrame, used: DataFrame) -> DataFrame:
    """Add the uses of this run to the mapping cache (``fingerprint, used_count``)."""
    return cache.unionByName(used).groupBy("fingerprint").agg(F.sum("used_count").alias("used_count"))


def field_coverage(df: DataFrame) -> DataFrame:
    """Filled values per canonical field, validity and warnings."""
    alternates = {
        "body": ["body", "text", "message", "content"],
        "date": ["date", "timestamp"],
        "readableDate": ["readableDate", "readable_date"],
        "contactName": ["contactName", "contact_name", "sender", "from", "role"],
        "address": ["address", "phone", "number"],
    }
    filled = {f: F.count_if(F.coalesce(F.nullif(_first_of(df, names), F.lit(""))).isNotNull()) for f, names in alternates.items()}
    counts = df.agg(F.count("*").alias("message_count"), *[c.alias(f) for f, c in filled.items()])
    missing = F.col("message_count") - F.col("body")
    warnings = F.array_compact(F.array(
        F.when(missing > 0, F.format_string("Missing body in %d messages", missing)),
        F.when(F.col("date") == 0, F.lit("No dates found")),
    ))
    return counts.withColumns({"valid": F.col("body") > 0, "warnings": F.array_join(warnings, "; ")})


def validation_errors(df: DataFrame, required: Sequence[str], allowed: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Rows with ``errors``: missing required fields and values outside an allowed set."""
    checks = [
        F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(f"missing {c}")) for c in required
    ] + [
        F.when(~F.col(c).isin(list(values)), F.concat(F.lit(f"invalid {c}: "), F.col(c).cast("string")))
        for c, values in (allowed or {}).items()
    ]
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def split_valid(df: DataFrame, required: Sequence[str], allowed=None) -> tuple[DataFrame, DataFrame]:
    checked = validation_errors(df, required, allowed)
    good = checked.where(F.size("errors") == 0).drop("errors")
    bad = checked.where(F.size("errors") > 0)
    return good, bad


def rule_rows(raw: DataFrame) -> DataFrame:
    """Rule records with defaults (priority 0, enabled, flag) and the reasons a row is unusable."""
    types = ["regex", "keyword", "path", "structural", "semantic"]
    filled = raw.withColumns(
        {
            "priority": F.coalesce("priority", F.lit(0)),
            "enabled": F.coalesce("enabled", F.lit(True)),
            "action": F.coalesce("action", F.lit("flag")),
        }
    )
    return validation_errors(filled, ["id", "name", "type", "pattern"], {"type": types})
