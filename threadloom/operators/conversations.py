"""Segmenting message streams into conversations, linking turns, threads and participants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import ordered
from threadloom.functions import textfn as tx
from threadloom.functions.vectors import cosine

DAY = "day"


def _day(ts: str) -> Column:
    return F.date_trunc("day", ts)


def segment_messages(
    messages: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    message_id: str = "message_id",
    topic: str | None = "topic",
    embedding: str | None = None,
    gap_seconds: int = 7200,
    min_similarity: float = 0.6,
    bucket: Column | None = None,
    compat: bool = False,
) -> DataFrame:
    """Conversation numbers per key in time order.

    A conversation starts at the first message, after a pause longer than ``gap_seconds``, when
    the similarity to the previous message drops below ``min_similarity`` (reason topic_change), or
    when the topic differs (entity_change). ``reason`` is NULL on continuing rows (``compat`` repeats 'first_message'), and
    ``similarity`` is 1 where it was not needed.
    """
    bucket = _day(ts) if bucket is None else bucket
    order = [ts, message_id]
    carried = {"__pts": ts, **({"__ptopic": topic} if topic else {}), **({"__pemb": embedding} if embedding else {})}
    rows = ordered.previous(messages, keys, order, bucket, carried)
    first = F.col("__pts").isNull()
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("__pts").cast("timestamp"))
    late = ~first & (gap > gap_seconds * 1_000_000)
    sim = cosine(F.col(embedding), F.col("__pemb")) if embedding else F.lit(1.0)
    similarity = F.when(first | late, F.lit(1.0)).otherwise(sim)
    rows = rows.withColumn("similarity", similarity)
    apart = ~first & ~late & (F.col("similarity") < min_similarity)
    moved = (F.col(topic) != F.col("__ptopic")) if topic else F.lit(False)
    reason = (
        F.when(first, "first_message")
        .when(late, "time_gap")
        .when(apart, "topic_change")
        .when(moved, "entity_change")
    )
    rows = rows.withColumn("__r", reason).withColumn("is_new", F.col("__r").isNotNull())
    shown = F.coalesce("__r", F.lit("first_message")) if compat else F.col("__r")
    rows = rows.withColumn("reason", shown).drop("__r", "__pts", "__ptopic", "__pemb")
    return ordered.running_sums(
        rows, keys, order, bucket, {"segment_no": F.col("is_new").cast("int")}
    )


def cluster_summary(segments: DataFrame, keys: Sequence[str], ts: str = "ts", topic: str | None = "topic") -> DataFrame:
    """One row per conversation: start, end, size and topic of its first message.

    Membership stays in the segment table (key + ``segment_no``); ids are not collected into
    arrays, whose size nothing bounds.
    """
    first_topic = [F.min_by(topic, ts).alias("topic")] if topic else []
    return segments.groupBy(*keys, "segment_no").agg(
        F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("message_count"), *first_topic
    )


def number_clusters(clusters: DataFrame, platform: str, ts: str = "start_ts", topic: str = "topic", tie: str = "segment_no") -> DataFrame:
    """Running number per platform and month and the readable cluster id."""
    rows = clusters.withColumn("__pc", tx.platform_code(F.col(platform))).withColumn("__ym", F.date_format(ts, "yyMM"))
    out = ordered.running_sums(rows, ["__pc", "__ym"], [ts, platform, tie], _day(ts), {"seq": F.lit(1)})
    return out.withColumn(
        "cluster_id", tx.cluster_id(F.col(platform), F.col(ts), F.col(topic), F.col("seq"))
    ).drop("__pc", "__ym")


def assign_clusters(messages: DataFrame, segments: DataFrame, message_id: str = "message_id") -> DataFrame:
    """Messages with the conversation they belong to."""
    return messages.join(segments.select(message_id, "segment_no", "is_new", "reason"), message_id)


def turn_links(messages: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, message_id: str = "message_id", ts: str = "ts") -> DataFrame:
    """Previous and next message id, seconds since the previous one and the serial number."""
    rows = ordered.previous(messages, keys, order, bucket, {"prev_id": message_id, "__pts": ts})
    rows = ordered.following(rows, keys, order, bucket, {"next_id": message_id})
    seconds = F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(F.col("__pts").cast("timestamp"))
    rows = rows.withColumn("seconds_since_prev", seconds).drop("__pts")
    return ordered.running_sums(rows, keys, order, bucket, {"serial_number": F.lit(1)})


def thread_summary(messages: DataFrame, a: str = "sender", b: str = "recipient", ts: str = "ts") -> DataFrame:
    """Threads by unordered pair of participants."""
    return messages.groupBy(tx.thread_key(F.col(a), F.col(b)).alias("thread_key")).agg(
        F.count("*").alias("message_count"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts")
    )


def participants(messages: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Distinct participants per group as rows."""
    return messages.select(*keys, F.explode(F.array(*columns)).alias("participant")).where(
        F.col("participant").isNotNull()
    ).distinct()


def date_range(messages: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    return messages.groupBy(*keys).agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"))


def conversation_groups(messages: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    return messages.groupBy(*keys).agg(
        F.count("*").alias("message_count"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts")
    )


def with_all_participants(members: DataFrame, key: str, wanted: Sequence[str]) -> DataFrame:
    """Conversations that contain every wanted participant (``members`` has key, participant)."""
    found = members.where(F.col("participant").isin(list(wanted))).groupBy(key).agg(
        F.count_distinct("participant").alias("n")
    )
    return found.where(F.col("n") == len(set(wanted))).select(key)


def normal_identity(identity: Column) -> Column:
    """Phone numbers keep digits and plus, everything else is lower case."""
    digits = F.regexp_replace(identity, "[^0-9+]", "")
    return F.when(F.length(digits) >= 7, digits).otherwise(F.lower(F.trim(identity)))


def link_across_platforms(messages: DataFrame, minutes: int = 60, a: str = "sender", b: str = "recipient") -> DataFrame:
    """Messages of the same two people on any platform, at most ``minutes`` apart, form one conversation."""
    keyed = messages.withColumn(
        "pair", tx.thread_key(normal_identity(F.col(a)), normal_identity(F.col(b)))
    )
    return segment_messages(keyed, ["pair"], topic=None, gap_seconds=minutes * 60)


def format_messages(messages: DataFrame, keys: Sequence[str], ts: str = "ts", sender: str = "sender", text: str = "text") -> DataFrame:
    """One formatted line per message; writers sort by key and time (see the text sink)."""
    line = F.format_string("[%s] %s: %s", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), sender, text)
    return messages.select(*keys, ts, line.alias("line"))


# --- markers --------------------------------------------------------------------------------


def pronoun_ratio(docs: DataFrame, first: Sequence[str], second: Sequence[str], id_col: str = "doc_id", text_col: str = "text", high_first: float = 0.08, high_second: float = 0.12) -> DataFrame:
    words = tx.tokens(F.col(text_col), r"[a-z']+")
    counted = docs.select(id_col, words.alias("w")).select(
        id_col, F.size("w").alias("n_words"), tx.count_in(F.col("w"), first).alias("n_first"), tx.count_in(F.col("w"), second).alias("n_second")
    )
    ratio = lambda c: F.when(F.col("n_words") == 0, 0.0).otherwise(F.col(c) / F.col("n_words"))
    return counted.withColumns({"first_ratio": ratio("n_first"), "second_ratio": ratio("n_second")}).withColumns(
        {"self_focus": F.col("first_ratio") > high_first, "blame_focus": F.col("second_ratio") > high_second}
    )


def marker_counts(docs: DataFrame, markers: dict[str, Sequence[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Occurrences of each marker vocabulary as whole words or phrases."""
    from threadloom.functions.spans import find_all
    import re

    counts = {
        name: F.size(find_all(F.lower(text_col), r"\b(?:" + "|".join(re.escape(w) for w in words) + r")\b"))
        for name, words in markers.items()
    }
    return docs.select(id_col, *[c.alias(n) for n, c in counts.items()])


def escalation(scores: DataFrame, key: str, ts: str, severity: str) -> DataFrame:
    """Trend of severity per participant: least-squares slope per day, first and last day means."""
    seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
    return scores.groupBy(key).agg(
        F.count("*").alias("n"),
        (F.regr_slope(F.col(severity), seconds / 86400.0)).alias("slope_per_day"),
        F.avg(severity).alias("mean_severity"),
    ).withColumn("escalating", F.col("slope_per_day") > 0)


def phase_transitions(sessions: DataFrame, key: str, order: Sequence[str], phase: str, bucket: Column) -> DataFrame:
    """How often one phase follows another, counted over neighbouring sessions of a key."""
    linked = ordered.following(sessions, [key], order, bucket, {"next_phase": phase})
    return linked.where("next_phase is not null").groupBy(phase, "next_phase").agg(F.count("*").alias("n"))


def denial_contradictions(mentions: DataFrame, denials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Denials of something the same person mentioned earlier.

    The earliest mention per key decides, so the range join shrinks to one row per key.
    """
    earliest = mentions.groupBy(*keys).agg(F.min("ts").alias("first_mention"), F.count("*").alias("n_mentions"))
    return denials.join(earliest, list(keys)).where(F.col("first_mention") < F.col("ts"))


def overelaboration(docs: DataFrame, phrases: dict[str, Sequence[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    counts = marker_counts(docs, phrases, id_col, text_col)
    sentences = F.filter(F.split(text_col, "[.!?]+"), lambda s: F.trim(s) != "")
    length = docs.select(id_col, F.transform(sentences, lambda s: F.size(F.split(F.trim(s), r"\s+"))).alias("l"))
    mean = F.when(F.size("l") == 0, 0.0).otherwise(F.aggregate("l", F.lit(0), lambda a, x: a + x) / F.size("l"))
    total = sum((F.col(n) for n in phrases), F.lit(0))
    return counts.join(length.select(id_col, mean.alias("avg_sentence_words")), id_col).withColumn("n_markers", total)
