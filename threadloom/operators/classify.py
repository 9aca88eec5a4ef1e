"""Scores and roll-ups over pattern matches and per-text classifications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom import lexicons as lx
from threadloom.functions import textfn as tx
from threadloom.functions.sizing import inline_rows, row_blocks


def severity_value(avg_weight: Column, n: Column) -> Column:
    """min(100, round(avg weight x min(2, 1 + log10(n + 1)))), 0 without matches."""
    factor = F.least(F.lit(2.0), F.log10(n + 1) + 1)
    return (
        F.when(n == 0, F.lit(0))
        .otherwise(F.least(F.lit(100), F.round(avg_weight * factor).cast("int")))
        .cast("int")
    )


def severity_scores(matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    negative = F.col("category") == "negative"
    n = F.count_if(negative)
    return matches.groupBy(id_col).agg(
        F.count("*").alias("n_matches"),
        n.alias("n_negative"),
        F.count_if(F.col("category") == "positive").alias("n_positive"),
        severity_value(F.avg(F.when(negative, F.col("severity"))), n).alias("severity_score"),
    )


def factor_counts(matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return (
        matches.select(id_col, F.explode("factors").alias("factor"))
        .groupBy(id_col, "factor")
        .agg(F.count("*").alias("n"))
    )


def _top_modules(matches: DataFrame, id_col: str, category: str, k: int = 3) -> DataFrame:
    counts = (
        matches.where(F.col("category") == category)
        .groupBy(id_col, "module_name")
        .agg(F.count("*").alias("n"))
    )
    w = Window.partitionBy(id_col).orderBy(F.desc("n"), "module_name")
    ranked = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    named = F.format_string("%s (%d)", "module_name", "n")
    return ranked.groupBy(id_col).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", named.alias("t")))), lambda x: x["t"]),
            ", ",
        ).alias(f"top_{category}")
    )


def summarise_matches(
    matches: DataFrame, contradictions: DataFrame, id_col: str = "doc_id"
) -> DataFrame:
    """One summary sentence per text: counts, leading modules, contradictions and level."""
    scores = severity_scores(matches, id_col)
    conflicts = contradictions.groupBy(id_col).agg(F.count("*").alias("n_contradictions"))
    joined = (
        scores.join(_top_modules(matches, id_col, "negative"), id_col, "left")
        .join(_top_modules(matches, id_col, "positive"), id_col, "left")
        .join(conflicts, id_col, "left")
        .withColumn("n_contradictions", F.coalesce("n_contradictions", F.lit(0)))
    )
    level = (
        F.when(F.col("severity_score") >= 80, "HIGH")
        .when(F.col("severity_score") >= 50, "MODERATE")
        .otherwise("LOW")
    )
    parts = F.array_compact(
        F.array(
            F.when(F.col("n_negative") > 0, F.format_string(
                "Detected %d concerning patterns, primarily: %s.", "n_negative", "top_negative")),
            F.when(F.col("n_positive") > 0, F.format_string(
                "Found %d positive/affectionate patterns: %s.", "n_positive", "top_positive")),
            F.when(F.col("n_contradictions") > 0, F.format_string(
                "Identified %d potential contradictions between positive and negative statements.",
                "n_contradictions")),
            F.when(F.col("severity_score") > 0, F.format_string(
                "Overall severity: %s (%d/100).", level, "severity_score")),
        )
    )
    summary = F.when(F.size(parts) == 0, "No significant patterns detected.").otherwise(
        F.array_join(parts, " ")
    )
    return joined.select(id_col, "severity_score", "n_contradictions", summary.alias("summary"))


def nlp_severity(avg_severity: Column, n: Column, compat: bool = False) -> Column:
    """1..10 severity: average weight (tenths of the 0-100 weight) plus half a point per match."""
    avg = avg_severity if compat else avg_severity / 10
    boosted = F.round(avg + F.least(n * 0.5, F.lit(3.0)))
    return F.when(n == 0, 1).otherwise(F.least(boosted, F.lit(10)).cast("int")).cast("int")


def nlp_confidence(n_matches: Column, sentiment_confidence: Column) -> Column:
    return F.when(n_matches == 0, sentiment_confidence).otherwise(
        (F.least(n_matches * 0.1, F.lit(0.9)) + sentiment_confidence) / 2
    )


def classify_nlp(
    docs: DataFrame, matches: DataFrame, id_col: str = "doc_id", text_col: str = "text", compat: bool = False
) -> DataFrame:
    """Per text: sentiment, negative and positive counts, severity and confidence."""
    scores = matches.groupBy(id_col).agg(
        F.count_if(F.col("category") == "negative").alias("n_negative"),
        F.count_if(F.col("category") == "positive").alias("n_positive"),
        F.avg(F.when(F.col("category") == "negative", F.col("severity"))).alias("__avg"),
    )
    text = F.col(text_col)
    base = docs.select(
        id_col,
        tx.sentiment_by_words(text).alias("__s"),
        F.size(F.split(text, r"\s+", -1)).alias("word_count"),
        F.size(F.split(text, "[.!?]+", -1)).alias("sentence_count"),
        F.length(text).alias("text_length"),
    )
    joined = base.join(scores, id_col, "left").fillna(0, ["n_negative", "n_positive"])
    return joined.select(
        id_col,
        F.col("__s.label").alias("sentiment"),
        "n_negative",
        "n_positive",
        nlp_severity(F.col("__avg"), F.col("n_negative"), compat).alias("severity"),
        nlp_confidence(F.col("n_negative") + F.col("n_positive"), F.col("__s.confidence")).alias("confidence"),
        "word_count",
        "sentence_count",
        "text_length",
    )


def modal_value(df: DataFrame, keys: Sequence[str], value: str, seen: str | Column, alias: str) -> DataFrame:
    """Most frequent value per key; the one seen first (smallest ``seen``) wins a tie."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"), F.min(seen).alias("__first"))
    best = F.min_by(value, F.struct(-F.col("__n"), F.col("__first"), F.col(value)))
    return counts.groupBy(*keys).agg(best.alias(alias))


def rollup_classifications(df: DataFrame, keys: Sequence[str], seen: str) -> DataFrame:
    """Modal sentiment, mean severity and confidence and the count of severities >= 7."""
    numbers = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("severity").alias("avg_severity"),
        F.avg("confidence").alias("confidence_avg"),
        F.count_if(F.col("severity") >= 7).alias("high_severity_count"),
    )
    return numbers.join(modal_value(df, keys, "sentiment", seen, "overall_sentiment"), list(keys))


def pattern_frequency(df: DataFrame, keys: Sequence[str], patterns: str) -> DataFrame:
    return df.select(*keys, F.explode(patterns).alias("pattern")).groupBy(*keys, "pattern").agg(
        F.count("*").alias("n")
    )


def keyword_rollup(keywords: DataFrame, keys: Sequence[str], k: int = 20) -> DataFrame:
    """Top keywords per group by summed score."""
    summed = keywords.groupBy(*keys, "keyword").agg(F.sum("score").alias("score"), F.count("*").alias("n_docs"))
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 6)), "keyword")
    return summed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vote(sources: Sequence[Column]) -> Column:
    """Majority of the non-null sources; the earliest source wins a tie; neutral without sources."""
    votes = F.array_compact(F.array(*sources))
    counted = F.transform(
        votes, lambda v, i: F.struct((-F.size(F.filter(votes, lambda w: w == v))).alias("n"), i.alias("i"), v.alias("v"))
    )
    return F.coalesce(F.try_element_at(F.array_sort(counted), F.lit(1))["v"], F.lit("neutral"))


def consensus(
    df: DataFrame,
    sources: Sequence[str],
    polarity: str,
    subjectivity: str,
    n_negative: str,
    n_positive: str,
    negation: str,
    priority_severity: str,
    passes: Column,
    compat: bool = False,
) -> DataFrame:
    """Consensus label, severity, confidence and sarcasm flag over per-pass columns."""
    neg, pos, pol = F.col(n_negative), F.col(n_positive), F.col(polarity)
    winner = vote([F.col(s) for s in sources])
    label = (
        F.when(winner == "positive", "positive")
        .when((winner == "negative") & (neg >= 5), "abusive")
        .when((winner == "negative") & (neg >= 3), "hostile")
        .when(winner == "negative", "negative")
        .otherwise("neutral")
    )
    sarcasm = (F.col(subjectivity) > 0.7) & (neg > 0) & (pol > 0.2)
    raw = (
        F.lit(5.0)
        + neg * 0.8
        + F.when(pol < -0.5, 2).when(pol < -0.2, 1).otherwise(0)
        + F.when(sarcasm, 1.5).otherwise(0.0)
        + F.when(F.col(negation) & (pol > 0), 1).otherwise(0)
    )
    severity = F.greatest(F.least(F.round(raw), F.lit(10)).cast("int"), F.col(priority_severity))
    agrees = ((neg > 0) & (label != "positive")) | ((pos > 0) & (label == "positive"))
    base = F.lit(0.0) if compat else passes / 6.0
    votes = F.size(F.array_compact(F.array(*sources)))
    confidence = F.when(votes == 0, 0.0).otherwise(
        F.least(base + F.when(agrees, 0.2).otherwise(0.0), F.lit(1.0))
    )
    return df.withColumns(
        {"label": label, "sarcasm": sarcasm, "severity": severity, "confidence": confidence}
    )


def classify_multipass(
    docs: DataFrame,
    matches: DataFrame,
    flags_summary: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All passes of one text joined on its id and combined into a consensus record.

    The second polarity scorer is the token lexicon; subjectivity is the share of tokens that
    carry sentiment (an external scorer can replace either column before ``consensus``).
    """
    text = F.col(text_col)
    words = tx.tokens(text, r"\b[a-z]+\b")
    flags = tx.linguistic_flags(text)
    scored = docs.select(
        id_col,
        tx.sentiment_by_words(text).alias("a"),
        tx.sentiment_by_tokens(text).alias("b"),
        F.size(words).alias("n_words"),
        flags["question"].alias("question"),
        flags["imperative"].alias("imperative"),
        flags["negation"].alias("negation"),
        F.size(flags["intensifiers"]).alias("n_intensifiers"),
    )
    counts = matches.groupBy(id_col).agg(
        F.count_if(F.col("category") == "negative").alias("n_negative"),
        F.count_if(F.col("category") == "positive").alias("n_positive"),
    )
    joined = (
        scored.join(counts, id_col, "left")
        .join(flags_summary, id_col, "left")
        .fillna(0, ["n_negative", "n_positive"])
        .withColumn("immediate_severity", F.coalesce("immediate_severity", F.lit(5)))
    )
    b = F.col("b.score")
    enriched = joined.withColumns(
        {
            "lexicon_vote": F.col("a.label"),
            "pattern_vote": F.when(F.col("n_negative") > F.col("n_positive"), "negative").when(
                F.col("n_positive") > 0, "positive"
            ),
            "polarity_vote": F.when(b > 0.2, "positive").when(b < -0.2, "negative").otherwise("neutral"),
            "polarity": (F.col("a.score") + b) / 2,
            "subjectivity": F.when(F.col("n_words") == 0, 0.0).otherwise(
                (F.col("b.positive") + F.col("b.negative")) / F.col("n_words")
            ),
        }
    )
    out = consensus(
        enriched, ["lexicon_vote", "pattern_vote", "polarity_vote"], "polarity", "subjectivity",
        "n_negative", "n_positive", "negation", "immediate_severity", F.lit(6),
    )
    return out.select(
        id_col, "label", "severity", "confidence", "polarity", "sarcasm", "question", "imperative",
        "negation", "n_intensifiers", "n_negative", "n_positive",
    )


def flag_summary(flags: DataFrame) -> DataFrame:
    """Counts of screening flags by type and by factor, with the highest severity of each."""
    by_type = flags.groupBy(F.col("type").alias("value")).agg(
        F.count("*").alias("n"), F.max("severity").alias("max_severity")
    ).withColumn("dimension", F.lit("type"))
    by_factor = flags.groupBy(F.col("factor").alias("value")).agg(
        F.count("*").alias("n"), F.max("severity").alias("max_severity")
    ).withColumn("dimension", F.lit("factor"))
    return by_type.unionByName(by_factor)


def behavior_flags(messages: DataFrame, matches: DataFrame, id_col: str = "message_id") -> DataFrame:
    """Messages with behaviour columns derived from their matches."""
    has = lambda *mods: F.bool_or(F.col("module").isin(*mods))
    per = matches.groupBy(id_col).agg(
        F.count("*").alias("behavior_count"),
        F.max("severity").alias("max_severity"),
        has("apologies").alias("contains_apology"),
        has("blame_shifting").alias("contains_blame"),
        has("threats_intimidation").alias("contains_threat"),
        has("minimization").alias("contains_minimizing"),
    )
    joined = messages.join(per, id_col, "left")
    booleans = ["contains_apology", "contains_blame", "contains_threat", "contains_minimizing"]
    return (
        joined.fillna(0, ["behavior_count", "max_severity"])
        .fillna(False, booleans)
        .withColumn("has_behaviors", F.col("behavior_count") > 0)
    )


def behavior_scores(
    docs: DataFrame,
    terms: DataFrame,
    low: float,
    medium: float,
    high: float,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """User-defined behaviours: weights of the present terms summed and bucketed by threshold.

    ``terms`` holds ``behavior, term, weight``; it is inlined in blocks of five thousand.
    """
    low_text = F.lower(text_col)
    hits = None
    for rows in row_blocks(terms, "term", 5_000):
        inline = inline_rows(rows, "behavior string, term string, weight double")
        present = F.filter(inline, lambda t: F.contains(low_text, F.lower(t["term"])))
        part = docs.select(id_col, F.explode(present).alias("t"))
        hits = part if hits is None else hits.unionByName(part)
    score = F.sum("t.weight")
    return hits.groupBy(id_col, F.col("t.behavior").alias("behavior")).agg(
        F.count("*").alias("n_terms"), score.alias("score"),
        F.when(score >= high, "high").when(score >= medium, "medium").when(score >= low, "low")
        .otherwise("none").alias("level"),
    )
