"""Phrase lexicons, screening rules, rule sets, line search and weighted keyword search."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from threadloom import lexicons as lx
from threadloom.functions import keybits
from threadloom.functions import spans as sp
from threadloom.functions import ordered
from threadloom.operators import automaton
from threadloom.functions.sizing import INLINE_ROWS, broadcast_if_small, inline_rows, row_blocks, rows_within

MATCH_CONFIDENCE = 80


def enabled_lexicon(
    lexicon: DataFrame,
    modules: Sequence[str] | None = None,
    custom: DataFrame | None = None,
) -> DataFrame:
    """Built-in phrases plus active custom ones, limited to the enabled modules.

    ``custom`` holds ``category, term, is_active``; a custom phrase counts only when its
    category names an existing module (lower case, blanks as underscores).
    """
    out = lexicon
    if custom is not None:
        about = lexicon.groupBy("module").agg(
            F.first("module_name").alias("module_name"),
            F.first("category").alias("category"),
            F.first("severity").alias("severity"),
            F.first("factors").alias("factors"),
        )
        added = (
            custom.where(F.col("is_active") & F.col("term").isNotNull())
            .select(
                F.regexp_replace(F.lower("category"), r"\s+", "_").alias("module"), "term"
            )
            .join(about, "module")
        )
        out = out.unionByName(added.select(*lexicon.columns))
    return out.where(F.col("module").isin(list(modules))) if modules is not None else out


def match_lexicon(
    docs: DataFrame,
    lexicon: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    context_chars: int = 100,
) -> DataFrame:
    """One row per case-insensitive occurrence of a lexicon phrase, overlaps included.

    A lexicon of checked size travels as a constant inside the projection, so matching is a
    narrow operation. A larger one becomes an automaton in the workers, see :mod:`automaton`, and one
    whose phrases are too many bytes to send is joined on character keys, see :func:`_match_by_keys`.
    """
    rows = rows_within(lexicon.dropDuplicates(["module", "term"]), INLINE_ROWS)
    if rows is None:
        distinct = lexicon.dropDuplicates(["module", "term"])
        phrases = automaton.phrases_within(distinct.select(F.lower("term").alias("term")), "term")
        if phrases is None:
            found = _match_by_keys(docs, lexicon, id_col, text_col)
        else:
            found = automaton.match_phrases(docs, distinct, phrases, "term", id_col, text_col)
    else:
        found = _match_inline(docs, inline_rows(rows, lx.LEXICON_SCHEMA), id_col, text_col)
    return found.select(
        id_col,
        "module",
        "module_name",
        "term",
        "category",
        "severity",
        F.lit(MATCH_CONFIDENCE).alias("confidence"),
        "start",
        "end",
        F.substring(text_col, F.col("start") + 1, F.col("end") - F.col("start")).alias("matched_text"),
        sp.snippet(F.col(text_col), F.col("start"), F.col("end"), context_chars).alias("context"),
        "factors",
    )


def _match_inline(docs: DataFrame, terms: Column, id_col: str, text_col: str) -> DataFrame:
    low = docs.select(id_col, text_col, F.lower(text_col).alias("__low"))
    present = F.filter(terms, lambda t: F.contains(F.col("__low"), F.lower(t["term"])))
    hits = low.select(id_col, text_col, "__low", F.explode(present).alias("__t"))
    starts = sp.literal_starts(F.col("__low"), F.lower(F.col("__t.term")))
    return hits.select(
        id_col, text_col, "__t.*", F.explode(starts).alias("start")
    ).withColumn("end", F.col("start") + F.length("term"))


def _match_by_keys(docs: DataFrame, lexicon: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Exact matching for a lexicon too large to inline.

    A text position is keyed by its next k characters (k = shortest phrase) and joined to the phrases
    with the same first k characters; the window is then compared in full. Only positions whose key
    has its bit among those of the phrases become rows of (id, position, window), see
    :mod:`threadloom.functions.keybits`; skewed keys are split by adaptive execution; texts are joined
    back for the hits alone.
    """
    lexicon = lexicon.dropDuplicates(["module", "term"]).withColumn("__term", F.lower("term"))
    size = lexicon.agg(
        F.min(F.length("__term")).alias("k"), F.max(F.length("__term")).alias("m")
    ).first()
    if size["k"] is None:
        return docs.limit(0).join(lexicon.drop("__term"), F.lit(False)).withColumns(
            {"start": F.lit(0), "end": F.lit(0)}
        )
    keyed = lexicon.withColumn("__key", F.substring("__term", 1, size["k"]))
    windows = keybits.windows(
        docs.select(id_col, F.lower(text_col).alias("__low")), id_col, "__low",
        keybits.of_keys(keyed, "__key", size["k"]), size["k"], size["m"],
    ).select(id_col, "start", F.col("window").alias("__win"), F.substring("window", 1, size["k"]).alias("__key"))
    hits = (
        windows.join(broadcast_if_small(keyed), "__key")
        .where(F.startswith("__win", "__term"))
        .drop("__key", "__win", "__term")
    )
    return hits.join(docs.select(id_col, text_col), id_col).withColumn(
        "end", F.col("start") + F.length("term")
    )


def contradictions(
    matches: DataFrame, id_col: str = "doc_id", love_gap: int = 2000, apology_gap: int = 3000
) -> DataFrame:
    """Positive statements contradicted by a negative one nearby in the same text.

    The distance test becomes an equi-join: both sides carry the block number of their start
    (blocks as wide as the gap) and only equal or neighbouring blocks meet, so a text with many
    matches is spread over blocks rather than paired with itself as a whole.
    """
    sides = matches.select(id_col, "module", "module_name", "category", "matched_text", "start", "end", "term")

    def near(pos: DataFrame, neg: DataFrame, gap: int, reach: Sequence[int]) -> DataFrame:
        p = pos.select(
            id_col,
            F.explode(F.array(*[F.floor(F.col("start") / gap) + r for r in reach])).alias("__blk"),
            *[F.col(c).alias(f"pos_{c}") for c in ("module", "matched_text", "start", "term")],
        )
        n = neg.select(
            id_col,
            F.floor(F.col("start") / gap).alias("__blk"),
            *[F.col(c).alias(f"neg_{c}") for c in ("module", "module_name", "matched_text", "start", "term")],
        )
        return p.join(n, [id_col, "__blk"]).drop("__blk")

    distance = F.col("neg_start") - F.col("pos_start")
    negative = sides.where("category = 'negative'")
    love = near(
        sides.where("category = 'positive' AND module = 'love_bombing'"),
        negative.where(F.col("module").isin(lx.DEVALUATION_MODULES)),
        love_gap,
        (-1, 0, 1),
    ).where(F.abs(distance) < love_gap)
    sorry = near(
        sides.where("category = 'positive' AND module = 'apologies'"), negative, apology_gap, (0, 1)
    ).where((distance > 0) & (distance < apology_gap))
    love = love.withColumn(
        "description",
        F.format_string(
            'Love bombing ("%s") followed by %s ("%s")',
            "pos_matched_text", F.lower("neg_module_name"), "neg_matched_text",
        ),
    )
    sorry = sorry.withColumn(
        "description",
        F.format_string(
            'Apology ("%s") contradicted by subsequent %s', "pos_matched_text", F.lower("neg_module_name")
        ),
    )
    return love.unionByName(sorry).withColumn("distance", distance)


def timeline(matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Matches in text order (stable order for equal starts)."""
    return matches.orderBy(id_col, "start", "end", "module", "term")


# --- screening -------------------------------------------------------------------------------


def screening_rules(protected_terms: Sequence[str] = ()) -> list[dict]:
    """Screening patterns; protected-person terms become a group of severity 9."""
    rules = []
    if protected_terms:
        rules += [
            dict(grp="child_name", severity=9, factor="a", type="child_reference",
                 pattern=rf"\b{re.escape(t)}\b")
            for t in protected_terms
        ]
    for grp, severity, factor, kind, patterns in lx.SCREENING:
        rules += [dict(grp=grp, severity=severity, factor=factor, type=kind, pattern=p) for p in patterns]
    return rules


def regex_matches(
    docs: DataFrame, rules: Sequence[dict], id_col: str = "doc_id", text_col: str = "text", flags: str = "(?i)"
) -> DataFrame:
    """All matches of a list of regex rules; each rule is ``{'pattern': ..., other columns}``.

    The rules are driver-side constants, so each becomes one expression of a single narrow
    projection; patterns that do not compile are skipped.
    """
    usable = [
        {**r, "regex": flags + sp.ascii_boundaries(r["pattern"])}
        for r in rules
        if _compiles(r["pattern"])
    ]
    if not usable:
        raise ValueError("no usable pattern among the rules")
    fields = [k for k in usable[0] if k != "regex"]
    types = {int: "int", float: "double", bool: "boolean", str: "string"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in usable[0].items())
    # one expression walks the whole rule list, so the plan does not grow with the rules; the
    # generator takes it directly: over a named array the optimizer would add a size filter,
    # push it below the projection and compute every span twice
    table = inline_rows([Row(**r) for r in usable], schema)

    def apply_rule(rule: Column) -> Column:
        return F.transform(
            sp.regex_spans(F.col(text_col), rule["regex"]),
            lambda s: F.struct(
                *[rule[f].alias(f) for f in fields],
                s["start"].alias("start"),
                s["end"].alias("end"),
                s["text"].alias("matched_text"),
            ),
        )

    found = F.explode(F.flatten(F.transform(table, apply_rule)))
    return docs.select(id_col, text_col, found.alias("__m")).select(id_col, text_col, "__m.*")


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
        return True
    except re.error:
        return False


def screen(
    docs: DataFrame,
    rules: Sequence[dict] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    context_chars: int = 50,
) -> DataFrame:
    """Priority flags with context; a match at the very start of a text counts too."""
    rules = screening_rules() if rules is None else rules
    hits = regex_matches(docs, rules, id_col, text_col)
    return hits.withColumn(
        "context", sp.snippet(F.col(text_col), F.col("start"), F.col("end"), context_chars)
    ).drop(text_col)


def screen_summary(docs: DataFrame, flags: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per text: highest severity (5 without flags) and the two immediate booleans."""
    per_doc = flags.groupBy(id_col).agg(
        F.count("*").alias("n_flags"),
        F.max("severity").alias("__sev"),
        F.bool_or(F.col("type") == "child_reference").alias("__child"),
        F.bool_or(F.col("type").isin("parental_alienation", "communication_blocking")).alias("__alien"),
    )
    return docs.select(id_col).join(per_doc, id_col, "left").select(
        id_col,
        F.coalesce("n_flags", F.lit(0)).alias("n_flags"),
        F.coalesce("__sev", F.lit(5)).alias("immediate_severity"),
        F.coalesce("__child", F.lit(False)).alias("child_mentioned"),
        F.coalesce("__alien", F.lit(False)).alias("alienation_detected"),
    )


# --- rule sets -------------------------------------------------------------------------------


def glob_to_regex(pattern: str) -> str:
    return pattern.replace("*", r"[^/\s]*").replace("?", r"[^/\s]")


def evaluate_rules(
    docs: DataFrame,
    rules: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Matches of every enabled regex, keyword, path and structural rule, with its action.

    Rules are inlined in blocks of a thousand, one pass over the texts per block.
    """
    out = None
    for rows in row_blocks(rules.where("enabled"), "rule_id", 1_000):
        part = _evaluate_block(docs, rows, id_col, text_col)
        out = part if out is None else out.unionByName(part)
    return out


def _evaluate_block(docs: DataFrame, rows: Sequence[Row], id_col: str, text_col: str) -> DataFrame:
    compiled = []
    for r in rows:
        base = dict(
            ruleset_id=r["ruleset_id"], rule_id=r["rule_id"], type=r["type"], priority=r["priority"],
            action=r["action"], confidence=lx.RULE_CONFIDENCE.get(r["type"], 0.0), cut=0,
        )
        if r["type"] == "regex":
            compiled.append({**base, "pattern": r["pattern"]})
        elif r["type"] == "path":
            compiled.append({**base, "pattern": glob_to_regex(r["pattern"])})
        elif r["type"] == "structural" and r["pattern"] in lx.STRUCTURES:
            compiled.append({**base, "pattern": lx.STRUCTURES[r["pattern"]], "cut": 100})
        elif r["type"] == "keyword":
            compiled += [
                {**base, "pattern": re.escape(k.strip().lower())}
                for k in r["pattern"].split(",") if k.strip()
            ]
    if not compiled:
        empty = "ruleset_id string, rule_id string, type string, priority int, action string, confidence double, start int, end int, matched_text string"
        kind = dict(docs.dtypes)[id_col]
        return docs.sparkSession.createDataFrame([], f"{id_col} {kind}, {empty}")
    out = regex_matches(docs, compiled, id_col, text_col)
    text = F.when(F.col("cut") > 0, F.substring("matched_text", 1, 100)).otherwise(F.col("matched_text"))
    return out.withColumn("matched_text", text).select(
        id_col, "ruleset_id", "rule_id", "type", "priority", "action", "confidence", "start", "end",
        "matched_text",
    )


def by_priority(matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return matches.orderBy(F.desc("priority"), id_col, "start", "end", "rule_id")


def suggest_rule_sets(matches: DataFrame, id_col: str = "doc_id", top: int | None = None) -> DataFrame:
    """Rule sets per text by score, all or the ``top`` best: a tenth per match, at most 1."""
    scored = matches.groupBy(id_col, "ruleset_id").agg(F.count("*").alias("n_matches"))
    scored = scored.withColumn("score", F.least(F.col("n_matches") * 0.1, F.lit(1.0)))
    w = Window.partitionBy(id_col).orderBy(F.desc("score"), "ruleset_id")
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


# --- line search -----------------------------------------------------------------------------


def numbered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no from 1, line, line_start offset)."""
    lines = F.split(F.col(text_col), "\n", -1)
    starts = sp.starts_from_lengths(F.transform(lines, lambda x: F.length(x) + 1))
    zipped = F.zip_with(lines, starts, lambda a, b: F.struct(a.alias("line"), b.alias("line_start")))
    return docs.select(id_col, F.posexplode(zipped).alias("__i", "__l")).select(
        id_col, (F.col("__i") + 1).alias("line_no"), "__l.line", "__l.line_start"
    )


def line_search(
    docs: DataFrame,
    term: str,
    regex: bool = False,
    ignore_case: bool = True,
    whole_word: bool = False,
    context: int = 0,
    max_per_doc: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Grep over documents: line number, column, absolute offset and surrounding lines.

    Lines stay in an array per document, so context lines are slices of it and nothing is
    shuffled. ``max_per_doc`` is the caller's own result limit.
    """
    pattern = term if regex else re.escape(term)
    if whole_word:
        pattern = rf"\b(?:{pattern})\b"
    pattern = ("(?i)" if ignore_case else "") + sp.ascii_boundaries(pattern)
    lines = docs.where(F.col(text_col).rlike(pattern)).select(
        id_col, F.split(F.col(text_col), "\n", -1).alias("__lines")
    )
    starts = sp.starts_from_lengths(F.transform("__lines", lambda x: F.length(x) + 1))
    numbered = F.transform(
        F.arrays_zip(F.col("__lines").alias("line"), starts.alias("line_start")),
        lambda z, i: F.struct((i + 1).alias("line_no"), z["line"].alias("line"), z["line_start"].alias("line_start")),
    )
    hits = F.filter(numbered, lambda s: s["line"].rlike(pattern))
    if max_per_doc is not None:
        hits = F.slice(hits, 1, max_per_doc)
    out = lines.select(id_col, "__lines", F.explode(hits).alias("__h")).select(id_col, "__lines", "__h.*")
    column = F.regexp_instr("line", F.lit(pattern))
    return out.select(
        id_col,
        "line_no",
        column.alias("column"),
        (F.col("line_start") + column - 1).alias("offset"),
        "line",
        F.array_join(
            F.slice("__lines", F.greatest(F.col("line_no") - context, F.lit(1)),
                    F.col("line_no") - F.greatest(F.col("line_no") - context, F.lit(1))), "\n"
        ).alias("before"),
        F.array_join(F.slice("__lines", F.col("line_no") + 1, F.lit(context)), "\n").alias("after"),
    )


def search_stats(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Matches per file plus the totals of the search."""
    per = hits.groupBy(id_col).agg(
        F.count("*").alias("n_matches"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")
    )
    totals = per.agg(F.sum("n_matches").alias("total_matches"), F.count("*").alias("n_files"))
    row = totals.first()
    return per.withColumns(
        {"total_matches": F.lit(row["total_matches"] or 0), "n_files": F.lit(row["n_files"])}
    )


# --- keyword search over tagged tables -------------------------------------------------------


def keyword_search(
    table: DataFrame,
    query: str,
    name: str,
    description: str,
    tags: str,
    k: int | None = None,
    weights: tuple[int, int, int, int] = (100, 50, 25, 10),
    tie: str | None = None,
) -> DataFrame:
    """Score rows by where the query terms occur: equal name, name, tag, description."""
    exact, partial, tag, desc = weights
    low_name, low_desc = F.lower(name), F.lower(description)
    score = F.lit(0)
    for term in [t for t in re.split(r"\s+", query.lower()) if t]:
        t = F.lit(term)
        score = (
            score
            + F.when(low_name == t, exact).when(F.contains(low_name, t), partial).otherwise(0)
            + F.when(F.exists(tags, lambda x: F.contains(F.lower(x), t)), tag).otherwise(0)
            + F.when(F.contains(low_desc, t), desc).otherwise(0)
        )
    order = [F.desc("score"), F.col(tie or name)]
    found = table.withColumn("score", score).where("score > 0").orderBy(*order)
    return found if k is None else found.limit(k)


def route(
    docs: DataFrame, routes: Sequence[dict], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Best route per text: 10 for the intent phrase and 2 per keyword; first route wins ties."""
    low = F.lower(text_col)
    scores = [
        (
            F.when(F.contains(low, F.lit(r["intent"].replace("_", " "))), 10).otherwise(0)
            + sum((F.when(F.contains(low, F.lit(k)), 2).otherwise(0) for k in r["keywords"]), F.lit(0))
        )
        for r in routes
    ]
    scored = docs.select(id_col, *[s.alias(f"__s{i}") for i, s in enumerate(scores)])
    best = F.greatest(*[F.col(f"__s{i}") for i in range(len(routes))]) if len(routes) > 1 else F.col("__s0")
    chosen = F.coalesce(*[F.when(F.col(f"__s{i}") == F.col("__b"), F.lit(r["target"])) for i, r in enumerate(routes)])
    return (
        scored.withColumn("__b", best)
        .where("__b > 0")
        .select(id_col, chosen.alias("route"), F.col("__b").alias("score"),
                F.least(F.col("__b") / 10.0, F.lit(1.0)).alias("confidence"))
    )


def related_items(
    items: DataFrame, subjects: DataFrame, item: str, category: str, tags: str, k: int = 5
) -> DataFrame:
    """Items of the same category, scored 1 + 2 per shared tag, best ``k`` per subject.

    A score depends only on two tag lists, so pairs are formed of the tag lists of a category, and each list of the subjects
    ranks its items once. ``2 k`` rows, at most ``k`` of one item, hold the best ``k`` of every subject without its own rows.
    """
    s = subjects.select(F.col(item).alias("subject"), category, F.col(tags).alias("__st"))
    order = [F.desc("score"), F.col(item)]

    def first(rows, n, keys, *by):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
        return rows.withColumn("__n", place).where(F.col("__n") <= n).drop("__n")

    rows = first(items.select(item, category, tags).where(F.col(item).isNotNull()), k, [category, tags, item], F.col(item))
    rows = first(rows, 2 * k, [category, tags], F.col(item))
    kinds = rows.select(category, tags).distinct().join(s.select(category, "__st").distinct(), category)
    kinds = kinds.withColumn("score", F.size(F.array_intersect(tags, "__st")) * 2 + 1)
    held = rows.withColumnRenamed(category, "__c").withColumnRenamed(tags, "__t")
    found = kinds.join(held, (F.col(category) == F.col("__c")) & F.col(tags).eqNullSafe(F.col("__t"))).select(category, "__st", item, "score")
    best = first(first(found, k, [category, "__st", item], *order), 2 * k, [category, "__st"], *order)
    best = best.select(F.col(category).alias("__c"), F.col("__st").alias("__t"), item, "score")
    scored = s.join(best, (F.col(category) == F.col("__c")) & F.col("__st").eqNullSafe(F.col("__t"))).where(F.col(item) != F.col("subject"))
    w = Window.partitionBy("subject").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "subject", item, category, "score", "rank"
    )
