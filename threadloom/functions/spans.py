"""Positions of literals and regular expressions inside a text column, JVM-side.

Offsets are zero-based and count code points; ``end`` is exclusive.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \b follows Unicode letters while \w is ASCII; the surveyed rules assume ASCII for both.
_ASCII_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def ascii_boundaries(pattern: str) -> str:
    """Rewrite ``\\b`` so that it agrees with the ASCII ``\\w``.

    Before something that must be a word character a boundary is just "no word character to the
    left", which is much cheaper to test at every position than the general form. A longest run of
    word characters (``\\b\\w+\\b``) needs none: a greedy match starts where a run starts and ends where it ends.
    """
    run = re.fullmatch(r"\\b(\\w(?:\+|\{\d+,\}))\\b", pattern)
    if run:
        return run.group(1)
    branches_start_with_words = re.search(r"\|(?![A-Za-z0-9])", pattern) is None
    opening = r"(?:\((?:\?:)?)*" if branches_start_with_words else ""
    word_ahead = rf"(?={opening}(?:[A-Za-z0-9]|\\d|\\w|\[A-Z\]|\[a-z\])(?![?*]))"
    pattern = re.sub(rf"(?<!\\)\\b{word_ahead}", lambda m: r"(?<!\w)", pattern)
    return re.sub(r"(?<!\\)\\b", lambda m: _ASCII_BOUNDARY, pattern)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once however often the body mentions it.

    Expressions below a higher-order function take no part in common-subexpression elimination;
    a lambda variable over a one-element array does the same job.
    """
    return F.transform(F.array(value), body)[0]


def _as_column(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def find_all(text: Column, pattern: Column | str) -> Column:
    """All non-overlapping matches of a pattern, as array<string>."""
    if isinstance(pattern, str):
        pattern = ascii_boundaries(pattern)
    return F.regexp_extract_all(text, _as_column(pattern), F.lit(0))


def _prefix_fold(lengths: Column, start: Column) -> Column:
    zero = F.struct(start.alias("pos"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(
        lengths,
        zero,
        lambda acc, n: F.struct(
            (acc["pos"] + n).alias("pos"), F.array_append(acc["out"], acc["pos"]).alias("out")
        ),
        lambda acc: acc["out"],
    )


def starts_from_lengths(lengths: Column, block: int = 256) -> Column:
    """Exclusive prefix sums of array<int>.

    Appending copies the array, so one fold over n items costs n squared. Sums of blocks are
    folded first and every block then on its own, which keeps long texts near linear.
    """

    def blocked(ls: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / F.lit(block)).cast("int"))
        part = lambda k: F.slice(ls, k * block + 1, F.lit(block))
        sums = F.transform(blocks, lambda k: F.aggregate(part(k), F.lit(0), lambda a, x: a + x))
        return let(
            _prefix_fold(sums, F.lit(0)),
            lambda bases: F.flatten(F.transform(bases, lambda base, k: _prefix_fold(part(k), base))),
        )

    return let(
        lengths,
        lambda ls: F.when(F.size(ls) > block, blocked(ls)).otherwise(_prefix_fold(ls, F.lit(0))),
    )


def regex_spans(text: Column, pattern: Column | str) -> Column:
    """array<struct<start,end,text>> of the non-overlapping matches of a pattern.

    The text is cut at the matches; prefix sums over gap and match lengths give the offsets.
    The pattern must not match the empty string.
    """
    if isinstance(pattern, str):
        pattern = ascii_boundaries(pattern)
    pat = _as_column(pattern)
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def locate(hits: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pat, -1), F.length), 1, F.size(hits))
        pieces = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))

        def place(ps: Column) -> Column:
            bases = starts_from_lengths(F.transform(ps, lambda p: p["gap"] + F.length(p["hit"])))

            def span(p: Column, base: Column) -> Column:
                start = base + p["gap"]
                return F.struct(
                    start.alias("start"), (start + F.length(p["hit"])).alias("end"), p["hit"].alias("text")
                )

            return F.zip_with(ps, bases, span)

        # most texts match nothing; they skip the second pass
        return F.when(F.size(hits) == 0, empty).otherwise(let(pieces, place))

    return let(F.regexp_extract_all(text, pat, F.lit(0)), locate)


def literal_starts(text: Column, term: Column) -> Column:
    """Start offsets of every occurrence of a literal, overlapping ones included.

    The text is cut before each occurrence with a zero-width look-ahead, so one regex pass
    finds all of them; pieces before the first cut do not count unless the text starts there.
    """
    pieces = F.split(text, F.concat(F.lit(r"(?=\Q"), term, F.lit(r"\E)")), -1)
    starts = starts_from_lengths(F.transform(pieces, F.length))
    return F.when(F.startswith(text, term), starts).otherwise(
        F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0)))
    )


def literal_starts_disjoint(text: Column, term: Column) -> Column:
    """Start offsets of a literal where the search resumes after each occurrence."""
    spans = regex_spans(text, F.concat(F.lit(r"\Q"), term, F.lit(r"\E")))
    return F.transform(spans, lambda s: s["start"])


def snippet(text: Column, start: Column, end: Column, margin: int) -> Column:
    """Text around a span; an ellipsis marks each side that was cut."""
    left = F.greatest(start - margin, F.lit(0))
    right = F.least(end + margin, F.length(text))
    body = F.substring(text, left + 1, right - left)
    return F.concat(
        F.when(left > 0, F.lit("...")).otherwise(F.lit("")),
        body,
        F.when(right < F.length(text), F.lit("...")).otherwise(F.lit("")),
    )


def drop_overlaps(spans: Column, schema: str) -> Column:
    """Keep spans in start order; a later overlapping one wins only with higher confidence."""

    def step(acc: Column, span: Column) -> Column:
        last = F.element_at(acc, -1)
        return (
            F.when((F.size(acc) == 0) | (span["start"] >= last["end"]), F.array_append(acc, span))
            .when(
                span["confidence"] > last["confidence"],
                F.array_append(F.slice(acc, 1, F.size(acc) - 1), span),
            )
            .otherwise(acc)
        )

    return F.aggregate(F.array_sort(spans), F.array().cast(f"array<{schema}>"), step)
