"""Row-expanding text operators: sentences, entities, keywords, outlines, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from threadloom import lexicons as lx
from threadloom.functions import spans as sp
from threadloom.functions import textfn as tx
from threadloom.functions.sizing import inline_rows
from threadloom.operators.patterns import numbered_lines

# The look-behinds admit only the places where a sentence can begin. Without them the engine
# retries every character of an unterminated stretch and its time grows with the square of it.
SENTENCE = r"(?:(?<![^.!?])|(?<=[.!?]\s))(?:[^.!?]*+[.!?]+(?:\s|$)|[^.!?]++$)"
TERMINATED_SENTENCE = r"(?<![^.!?])[^.!?]++[.!?]+"


def split_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentence_no from 0, text, start, end); offsets cover the untrimmed piece."""
    found = F.filter(sp.regex_spans(F.col(text_col), SENTENCE), lambda s: F.trim(_blank(s["text"])) != "")
    return docs.select(id_col, F.posexplode(found).alias("sentence_no", "s")).select(
        id_col,
        "sentence_no",
        F.trim(_blank(F.col("s.text"))).alias("sentence"),
        F.col("s.start").alias("start"),
        F.col("s.end").alias("end"),
    )


def _blank(text: Column) -> Column:
    """Leading and trailing white space of any kind as blanks, so that trim removes it."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


#: By place in the entity patterns: what a text must contain to match, and what the match begins with, which is cheaper
#: to test at every position than the look-behind that follows it.
_ENTITY_NEEDS = {2: ":", 3: "$", 5: "%", 6: "@", 7: "http"}
_ENTITY_BEGINS = {0: r"\d", 1: "[JFMASOND]", 2: r"\d", 5: r"\d"}


def _entity_regex(order: int, pattern: str) -> str:
    regex = sp.ascii_boundaries(pattern)
    # the name of a mail address never gives back a sign for the @ after it
    regex = regex.replace("[A-Za-z0-9._%+-]+@", "[A-Za-z0-9._%+-]++@")
    return regex.replace(r"(?<!\w)", rf"(?={_ENTITY_BEGINS[order]})(?<!\w)", 1) if order in _ENTITY_BEGINS else regex


def entity_spans(text: Column, types: list[str] | None = None) -> Column:
    """All matches of the entity patterns (of some types) as array<struct<start,ord,end,type,text,confidence>>."""

    def tagged(spans: Column, kind: Column, order: Column) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"),
                order.alias("ord"),
                s["end"].alias("end"),
                kind.alias("type"),
                s["text"].alias("text"),
                F.lit(0.7).alias("confidence"),
            ),
        )

    table = inline_rows(
        [
            Row(ord=i, type=kind, regex=_entity_regex(i, pattern), needs=_ENTITY_NEEDS.get(i, ""))
            for i, (kind, pattern) in enumerate(lx.ENTITY_PATTERNS)
            if kind != "PERSON" and (types is None or kind in types)
        ],
        "ord int, type string, regex string, needs string",
    )
    # whether a text matches at all is mostly settled by one sign that it lacks
    possible = F.filter(table, lambda p: F.contains(text, p["needs"]))
    by_pattern = F.flatten(
        F.transform(possible, lambda p: tagged(sp.regex_spans(text, p["regex"]), p["type"], p["ord"]))
    )
    if types is not None and "PERSON" not in types:
        return by_pattern
    names = tagged(_name_spans(text), F.lit("PERSON"), F.lit(len(lx.ENTITY_PATTERNS)))
    return F.concat(by_pattern, names)


def _name_spans(text: Column) -> Column:
    """Runs of two or more capitalised words.

    A repeated group would make the JVM's regex engine recurse once per word of a run, so single
    words are matched and neighbours separated only by white space are merged. Most texts have no
    two such neighbours and none of their words is placed.
    """
    pattern = sp.ascii_boundaries(r"\b[A-Z][a-z]+\b")

    def runs(both: Column) -> Column:
        words, gaps = both["words"], both["gaps"]
        opens = F.filter(
            F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | ~gaps[i].rlike(r"^\s+$")
        )

        def joined(starts: Column) -> Column:
            def run(first: Column, k: Column) -> Column:
                after = F.when(k + 1 < F.size(starts), F.get(starts, k + 1)).otherwise(F.size(words))
                return F.struct(
                    words[first]["start"].alias("start"),
                    words[after - 1]["end"].alias("end"),
                    (after - first).alias("n"),
                )

            several = F.filter(F.transform(starts, run), lambda r: r["n"] > 1)
            return F.transform(
                several,
                lambda r: F.struct(
                    r["start"].alias("start"),
                    r["end"].alias("end"),
                    F.substring(text, r["start"] + 1, r["end"] - r["start"]).alias("text"),
                ),
            )

        empty = F.array().cast("array<struct<start:int,end:int,text:string>>")
        return F.when(F.size(words) == 0, empty).otherwise(sp.let(opens, joined))

    pieces = F.struct(
        sp.regex_spans(text, pattern).alias("words"), F.split(text, pattern, -1).alias("gaps")
    )
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    return F.when(text.rlike(r"[A-Z][a-z]++\s++[A-Z][a-z]"), sp.let(pieces, runs)).when(text.isNotNull(), none)


ENTITY_STRUCT = "struct<start:int,ord:int,end:int,type:string,text:string,confidence:double>"


def extract_entities(
    docs: DataFrame,
    types: list[str] | None = None,
    resolve_overlaps: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    # overlaps are decided among all types, so only then are all patterns needed
    spans = entity_spans(F.col(text_col), None if resolve_overlaps else types)
    if resolve_overlaps:
        spans = sp.drop_overlaps(spans, ENTITY_STRUCT)
    out = docs.select(id_col, F.explode(spans).alias("e")).select(
        id_col, "e.type", "e.text", "e.start", "e.end", "e.confidence"
    )
    return out.where(F.col("type").isin(types)) if types else out


def entity_rollup(entities: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Occurrences per normalised entity of a text."""
    return entities.groupBy(id_col, "type", F.lower(F.trim("text")).alias("normalized")).agg(
        F.count("*").alias("occurrences"),
        F.min("start").alias("first_offset"),
        F.max("confidence").alias("max_confidence"),
    )


def extract_keywords(
    docs: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Top words per text by count (first appearance breaks ties), score relative to the best."""
    found = _placed(tx.tokens(F.col(text_col), r"\b[a-z]{3,}\b"))
    words = F.filter(found, lambda w: ~w["keyword"].isin(lx.KEYWORD_STOP_WORDS))
    ranked = docs.select(id_col, F.posexplode(sp.let(_top_words(words, k), lambda top: F.transform(top, lambda w: F.struct(w.alias("w"), top[0]["frequency"].alias("best"))))).alias("rank", "k"))
    return _keyword_rows(ranked, id_col, F.col("k.w"), F.col("k.best"))


def extract_keywords_by_share(
    docs: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Variant: blank-separated words longer than three characters, score = count / all words."""
    parts = F.filter(F.split(F.lower(text_col), r"\s+"), lambda w: w != "")

    def counted(ps: Column) -> Column:
        words = F.filter(_placed(ps), lambda w: F.length(w["keyword"]) > 3)
        return F.transform(_top_words(words, k), lambda w: F.struct(w.alias("w"), F.size(ps).alias("total")))

    ranked = docs.select(id_col, F.posexplode(sp.let(parts, counted)).alias("rank", "k"))
    return _keyword_rows(ranked, id_col, F.col("k.w"), F.col("k.total"))


def _placed(words: Column) -> Column:
    return F.transform(words, lambda w, i: F.struct(w.alias("keyword"), i.alias("pos")))


def _top_words(placed: Column, k: int) -> Column:
    """The ``k`` most frequent of a text's words as array<struct<frequency,first_pos,keyword>>, counted inside its row.

    Sorted words make runs: a word's count is the distance to the next run's start. No word leaves its row, so nothing is shuffled.
    """
    def runs(s: Column) -> Column:
        marked = F.transform(s, lambda w, i: F.struct(w["keyword"].alias("keyword"), w["pos"].alias("pos"), i.alias("i")))
        starts = F.filter(marked, lambda w: ~F.get(s, w["i"] - 1)["keyword"].eqNullSafe(w["keyword"]))
        return sp.let(starts, lambda st: F.transform(st, lambda w, j: F.struct(
            (w["i"] - F.coalesce(F.get(st, j + 1)["i"], F.size(s))).cast("long").alias("less"), w["pos"].alias("first_pos"), w["keyword"].alias("keyword"))))

    best = F.slice(F.sort_array(sp.let(F.sort_array(placed), runs)), 1, k)
    return F.transform(best, lambda w: F.struct((-w["less"]).alias("frequency"), w["first_pos"].alias("first_pos"), w["keyword"].alias("keyword")))


def _keyword_rows(ranked: DataFrame, id_col: str, word: Column, base: Column) -> DataFrame:
    return ranked.select(
        id_col, word["keyword"].alias("keyword"), word["frequency"].alias("frequency"), word["first_pos"].alias("first_pos"),
        (F.col("rank") + 1).alias("rank"), (word["frequency"] / base).alias("score"))


def outline(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Markdown headings with level, title and offset."""
    lines = numbered_lines(docs, id_col, text_col).where(F.col("line").rlike(r"^#{1,6}\s+.+$"))
    return lines.select(
        id_col,
        "line_no",
        F.length(F.regexp_extract("line", r"^(#{1,6})", 1)).alias("level"),
        F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1)).alias("title"),
        F.col("line_start").alias("offset"),
    )


def outline_loose(
    docs: DataFrame, max_depth: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Headings including capital lines (level 1) and short lines ending in a colon (level 2)."""
    line = F.trim("line")
    marks = F.length(F.regexp_extract(line, r"^(#+)", 1))
    capital = (F.upper(line) == line) & (F.lower(line) != line) & (F.length(line) > 3)
    colon = line.endswith(":") & (F.length(line) < 100)
    level = F.when(marks > 0, marks).when(capital, 1).when(colon, 2).otherwise(0)
    title = (
        F.when(marks > 0, F.trim(F.regexp_replace(line, r"^#+", "")))
        .when(capital, F.initcap(F.lower(line)))
        .otherwise(F.regexp_replace(line, r":+$", ""))
    )
    return (
        numbered_lines(docs, id_col, text_col)
        .select(id_col, "line_no", level.alias("level"), title.alias("title"))
        .where(F.col("level").between(1, max_depth))
    )


def outline_with_preview(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 150
) -> DataFrame:
    """Headings with the text up to the next one; texts without headings list their paragraphs."""
    heads = F.filter(
        sp.regex_spans(F.col(text_col), r"(?m)^#{1,6}\s+.+$"), lambda s: F.length(s["text"]) > 0
    )
    base = docs.select(id_col, text_col, heads.alias("__h"))
    nth = base.where(F.size("__h") > 0).select(
        id_col, text_col, "__h", F.posexplode("__h").alias("section_no", "h")
    )
    nxt = F.coalesce(F.try_element_at("__h", F.col("section_no") + 2)["start"], F.length(text_col))
    body = _blank(F.substring(text_col, F.col("h.end") + 1, nxt - F.col("h.end")))
    headed = nth.select(
        id_col,
        "section_no",
        F.length(F.regexp_extract("h.text", r"^(#{1,6})", 1)).alias("level"),
        F.trim(F.regexp_extract("h.text", r"^#{1,6}\s+(.+)$", 1)).alias("title"),
        tx.preview(body, size).alias("summary"),
    )
    paragraphs = F.slice(
        F.filter(F.split(text_col, r"\n\n+"), lambda p: F.length(_blank(p)) > 50), 1, 10
    )
    first = F.regexp_extract("para", r"^[^.!?]+[.!?]", 0)
    plain = base.where(F.size("__h") == 0).select(
        id_col, F.posexplode(F.transform(paragraphs, _blank)).alias("section_no", "para")
    ).select(
        id_col,
        "section_no",
        F.lit(1).alias("level"),
        F.concat(F.lit("Section "), F.col("section_no") + 1).alias("title"),
        F.when(first != "", first).otherwise(F.substring("para", 1, 50)).alias("summary"),
    )
    return headed.unionByName(plain)


def text_pages(docs: DataFrame, size: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every page of every text: page number, content, total pages and whether more follow."""
    total = F.greatest(F.ceil(F.length(text_col) / F.lit(size)), F.lit(1)).cast("int")
    return docs.select(
        id_col, text_col, total.alias("total_pages"), F.explode(F.sequence(F.lit(1), total)).alias("page")
    ).select(
        id_col,
        "page",
        "total_pages",
        F.substring(text_col, (F.col("page") - 1) * size + 1, F.lit(size)).alias("content"),
        (F.col("page") < F.col("total_pages")).alias("has_more"),
    )


def text_page(
    docs: DataFrame, page: int, size: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One requested page, clamped to the existing ones."""
    total = F.greatest(F.ceil(F.length(text_col) / F.lit(size)), F.lit(1)).cast("int")
    p = F.greatest(F.least(F.lit(page), total), F.lit(1))
    return docs.select(
        id_col, p.alias("page"), total.alias("total_pages"),
        F.substring(text_col, (p - 1) * size + 1, F.lit(size)).alias("content"),
        (p < total).alias("has_more"),
    )
