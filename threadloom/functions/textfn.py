"""Scalar text expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom import lexicons as lx
from threadloom.functions.spans import ascii_boundaries, find_all


def string_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def tokens(text: Column, pattern: str) -> Column:
    return find_all(F.lower(text), pattern)


def search_terms(text: Column) -> Column:
    """Words of two or more characters without the retrieval stop words."""
    # a list of literals is looked up in a hash set, an array element by element
    return F.filter(tokens(text, r"\b\w{2,}\b"), lambda t: ~t.isin(lx.RETRIEVAL_STOP_WORDS))


def count_in(words: Column, vocabulary: Sequence[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(list(vocabulary))))


def language_scores(text: Column, prefix: int | None = None) -> dict[str, Column]:
    sample = F.lower(F.substring(text, 1, prefix) if prefix else text)
    return {
        lang: sum((sample.rlike(ascii_boundaries(p)).cast("int") for p in pats), F.lit(0))
        for lang, pats in lx.LANGUAGE_MARKERS.items()
    }


def guess_language(text: Column, prefix: int | None = None) -> Column:
    """struct<language,confidence>: most marker words in the text (or its prefix), ties by list order."""
    scores = language_scores(text, prefix)
    best = F.greatest(*scores.values())
    language = F.when(best == 0, F.lit("en"))
    for lang, score in scores.items():
        language = language.when(score == best, F.lit(lang))
    return F.struct(
        language.alias("language"), F.least(best / F.lit(5.0), F.lit(1.0)).alias("confidence")
    )


def sentiment_by_tokens(text: Column) -> Column:
    """struct<label,score,confidence> counting every lexicon token."""
    words = tokens(text, r"\b[a-z]+\b")
    p = count_in(words, lx.POSITIVE_WORDS)
    n = count_in(words, lx.NEGATIVE_WORDS)
    return _sentiment(p, n, 0.1, lambda s: F.least(F.abs(s) + 0.5, F.lit(1.0)))


def sentiment_by_words(text: Column) -> Column:
    """struct<label,score,confidence,positive,negative> counting distinct lexicon words."""
    words = F.array_distinct(F.split(F.lower(text), r"\s+"))
    p = F.size(F.array_intersect(words, string_array(lx.POSITIVE_WORDS_SHORT)))
    n = F.size(F.array_intersect(words, string_array(lx.NEGATIVE_WORDS_SHORT)))
    return _sentiment(p, n, 0.2, lambda s: F.least(F.abs(s) * 0.5 + 0.5, F.lit(1.0)))


def _sentiment(p: Column, n: Column, margin: float, confidence) -> Column:
    total = p + n
    score = F.when(total == 0, F.lit(0.0)).otherwise((p - n) / total)
    label = (
        F.when(score > margin, "positive").when(score < -margin, "negative").otherwise("neutral")
    )
    return F.struct(
        label.alias("label"),
        score.alias("score"),
        F.when(total == 0, F.lit(0.5)).otherwise(confidence(score)).alias("confidence"),
        p.alias("positive"),
        n.alias("negative"),
    )


def linguistic_flags(text: Column, whole_word: bool = False) -> dict[str, Column]:
    """Question, imperative, negation and intensifier markers."""
    low = F.lower(text)
    if whole_word:
        words = tokens(text, r"[a-z']+")
        hit = lambda w: F.array_contains(words, w)
    else:
        hit = lambda w: F.contains(low, w)
    return {
        "question": F.contains(text, F.lit("?")),
        "imperative": F.trim(text).rlike(r"(?i)^(do|don't|stop|give|tell|show|let)"),
        "negation": F.exists(string_array(lx.NEGATION_WORDS), hit),
        "intensifiers": F.filter(string_array(lx.INTENSIFIERS), hit),
    }


def topic_code(text: Column, topics: Sequence[tuple[str, str]], default: str = "GENRL") -> Column:
    """Code of the first keyword, in list order, that occurs in the text."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(c)) for k, c in topics], F.lit(default))


def platform_code(platform: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in lx.PLATFORM_CODES.items() for x in kv])
    return F.coalesce(
        F.try_element_at(mapping, F.lower(platform)), F.upper(F.substring(platform, 1, 4))
    )


def cluster_id(platform: Column, ts: Column, topic: Column, seq: Column) -> Column:
    return F.concat_ws(
        "_",
        platform_code(platform),
        F.date_format(ts, "yyMM"),
        F.rpad(F.substring(F.upper(topic), 1, 6), 6, "X"),
        # padded, never cut
        F.when(seq < 1000, F.lpad(seq.cast("string"), 3, "0")).otherwise(seq.cast("string")),
    )


def thread_key(a: Column, b: Column) -> Column:
    return F.array_join(F.array_sort(F.array(a, b)), "_")


def severity_bucket(severity: Column) -> Column:
    return (
        F.when(severity >= 9, "critical")
        .when(severity >= 7, "high")
        .when(severity >= 4, "medium")
        .otherwise("low")
    )


def sniff_timestamp(text: Column) -> Column:
    """First timestamp-like fragment, trying the known notations in priority order."""
    found = [
        F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in lx.TIMESTAMP_NOTATIONS
    ]
    return F.coalesce(*found)


def parse_timestamp(text: Column) -> Column:
    """struct<ts,precision>; unreadable values give NULL and 'inferred' rather than the current time."""
    bare = F.regexp_replace(
        F.trim(text), r"(?i)^(monday|tuesday|wednesday|thursday|friday|saturday|sunday),?\s*", ""
    )
    bare = F.regexp_replace(bare, r"\s+at\s+", " ")
    ts = F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in lx.TIMESTAMP_FORMATS])
    return F.struct(
        ts.alias("ts"), F.when(ts.isNull(), "inferred").otherwise("exact").alias("precision")
    )


def question_type(question: Column) -> Column:
    low = F.lower(question)
    out = None
    for word in ("what", "how", "why", "when", "who", "where", "which"):
        cond = F.startswith(low, F.lit(word))
        out = F.when(cond, word) if out is None else out.when(cond, word)
    return out.otherwise("other")


def render_template(template: Column, variables: Column) -> Column:
    """Replace each ``{name}`` of the template by the map's value."""
    return F.aggregate(
        F.map_entries(variables),
        template,
        lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]),
    )


def template_variables(template: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1)))


def clean_text(text: Column) -> tuple[Column, Column]:
    """(cleaned text, array of the kinds of change made)."""
    spaced = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    bare = F.regexp_replace(spaced, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    straight = F.translate(bare, "“”‘’", "\"\"''")
    trimmed = F.regexp_replace(straight, r"(?m)^[ \t]+|[ \t]+$", "")
    changes = F.array_compact(
        F.array(
            F.when(F.length(spaced) != F.length(text), F.lit("Normalized whitespace")),
            F.when(F.length(bare) != F.length(spaced), F.lit("Removed control characters")),
            F.when(straight != bare, F.lit("Normalized quotes")),
        )
    )
    return trimmed, changes


def unify_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


#: Characters with a meaning in HTML and their names; the ampersand goes first when written, last when read.
HTML_NAMES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def escape_html(text: Column) -> Column:
    for sign, name in HTML_NAMES:
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def unescape_html(html: Column) -> Column:
    for sign, name in reversed(HTML_NAMES):
        html = F.replace(html, F.lit(name), F.lit(sign))
    return html


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(html, r"<[^>]+>", ""))


def preview(text: Column, size: int = 200) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def bigrams(text: Column) -> Column:
    return F.when(F.length(text) < 2, F.array().cast("array<string>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))),
            lambda i: F.substring(text, i, F.lit(2)),
        )
    )
