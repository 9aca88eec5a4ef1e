"""Inputs that several named queries share, in Spark and SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import lexicons as lx
from threadloom.operators import patterns as pm

# The driver corpus is invented prose in four languages, so the queries use terms found in it.
CORPUS_TERMS = [
    ("gaslighting", "Gaslighting Detection", "negative", 90, "jkl",
     ["worthless", "stupid", "nicht für", "thth the"]),
    ("blame_shifting", "Blame Shifting", "negative", 85, "jl", ["clown", "que la ", "of the."]),
    ("minimization", "Minimization & Dismissal", "negative", 75, "fj", ["hahe", "from the "]),
    ("love_bombing", "Love Bombing", "positive", 80, "l", ["and of", "heea"]),
    ("apologies", "Apologies & Remorse", "positive", 60, "l", ["with the", "ist die"]),
    ("scheduling", "Scheduling & Custody", "neutral", 40, "abd", ["is the", "est la"]),
]


def corpus_lexicon(spark: SparkSession) -> DataFrame:
    rows = [
        (m, name, t, cat, sev, list(fac)) for m, name, cat, sev, fac, ts in CORPUS_TERMS for t in ts
    ]
    return spark.createDataFrame(rows, lx.LEXICON_SCHEMA)


def corpus_matches(t) -> DataFrame:
    return pm.match_lexicon(t.documents, corpus_lexicon(t.spark))


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LEXICON_CTE = "lex(module, module_name, term, category, severity, factors) as (values " + ", ".join(
    f"({_quote(m)}, {_quote(n)}, {_quote(t)}, {_quote(c)}, {s}, {_quote(f)})"
    for m, n, c, s, f, ts in CORPUS_TERMS
    for t in ts
) + ")"

MATCHES_CTE = f"""{LEXICON_CTE},
hitdocs as (
  select d.doc_id, d.text, lower(d.text) as low, lex.*
  from documents d join lex on contains(lower(d.text), lex.term)),
pieces as (
  select * exclude (low), unnest(string_split(low, term)) as piece,
         unnest(generate_series(1, len(string_split(low, term)))) as k, len(string_split(low, term)) as n_pieces
  from hitdocs),
occ as (
  select *, cast(sum(length(piece) + length(term)) over (partition by doc_id, module, term order by k) - length(term) as int) as start
  from pieces),
matches as (
  select doc_id, text, module, module_name, term, category, severity, factors, start,
         cast(start + length(term) as int) as "end", substring(text, start + 1, length(term)) as matched_text
  from occ where k < n_pieces)"""

# matches as messages: one row per conversation turn
MESSAGES_CTE = """messages as (
  select conv_id || '-' || turn as message_id, conv_id, turn, role as sender, text,
         timestamp '2024-01-01 00:00:00' + to_seconds(conv_id * 3600 + turn * 300) as ts
  from conversations)"""


def messages(t) -> DataFrame:
    """Conversation turns as messages; the table has no clock, so the turn number sets the time."""
    seconds = F.col("conv_id") * 3600 + F.col("turn") * 300
    return t.conversations.select(
        F.concat_ws("-", "conv_id", "turn").alias("message_id"),
        "conv_id",
        "turn",
        F.col("role").alias("sender"),
        "text",
        F.timestamp_seconds(F.lit(1704067200) + seconds).cast("timestamp_ntz").alias("ts"),
    )


# page text with markdown headings and blank lines between blocks
PAGE_TEXT_CTE = r"""page_text as (
  select page_id as doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '<h1[^>]*>', chr(10) || chr(10) || '# ', 'g'), '<h[2-6][^>]*>', chr(10) || chr(10) || '## ', 'g'),
    '</(h[1-6]|p|li|div)>', chr(10) || chr(10), 'g'), '<[^>]+>', '', 'g') as text from pages)"""


def page_text(t) -> DataFrame:
    text = F.col("html")
    for pattern, new in (
        (r"<h1[^>]*>", "\n\n# "), (r"<h[2-6][^>]*>", "\n\n## "), (r"</(h[1-6]|p|li|div)>", "\n\n"), (r"<[^>]+>", ""),
    ):
        text = F.regexp_replace(text, pattern, new)
    return t.pages.select(F.col("page_id").alias("doc_id"), text.alias("text"))


LINES_CTE = """lines as (select doc_id, unnest(string_split(text, chr(10))) as line,
 unnest(generate_series(1, len(string_split(text, chr(10))))) as line_no from documents)"""
