"""BM25 passages, hybrid search, answers and extractive summaries."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom import lexicons as lx
from threadloom.functions import textfn as tx
from threadloom.functions.spans import ascii_boundaries, let
from threadloom.session import cut_lineage
from threadloom.operators.chunking import packed_paragraphs, passages
from threadloom.operators.text import TERMINATED_SENTENCE, _blank

K1, B = 1.2, 0.75


def query_terms(query: str) -> list[str]:
    import re

    words = re.findall(r"\b\w{2,}\b", query.lower(), flags=re.ASCII)
    return [w for w in words if w not in set(lx.RETRIEVAL_STOP_WORDS)]


def passage_terms(docs: DataFrame, spans: Column, id_col: str) -> DataFrame:
    """Passages with their terms and, per document, passage count and mean length."""
    # everything happens inside the generator: over a named array the optimizer would add a size
    # filter, push it down and build all passages twice
    def measured(ps: Column) -> Column:
        sizes = F.aggregate(ps, F.lit(0), lambda a, p: a + F.size(p["terms"]))
        return let(
            F.struct(F.size(ps).alias("n_passages"), (sizes / F.greatest(F.size(ps), F.lit(1))).alias("avg_len")),
            lambda about: F.transform(
                ps,
                lambda p: F.struct(about["n_passages"], about["avg_len"], p["text"], p["start"], p["terms"]),
            ),
        )

    with_terms = F.transform(
        spans, lambda p: F.struct(p["text"].alias("text"), p["start"].alias("start"), tx.search_terms(p["text"]).alias("terms"))
    )
    return docs.select(id_col, F.posexplode(let(with_terms, measured)).alias("passage_no", "p")).select(
        id_col, "p.n_passages", "p.avg_len", "passage_no", "p.text", "p.start", "p.terms",
        F.size("p.terms").alias("dl"),
    )


def bm25_passages(
    docs: DataFrame, query: str, spans: Column | None = None, df: str = "fixed", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """BM25 score of every passage.

    ``df='fixed'`` assumes a term occurs in a tenth of a document's passages and scores within
    the document. ``df='corpus'`` counts real document frequencies in one aggregation whose
    single row is joined back; passages are checkpointed for it, not built twice.
    """
    terms = query_terms(query)
    rows = passage_terms(docs, passages(F.col(text_col)) if spans is None else spans, id_col)
    tf = {i: _term_count(term) for i, term in enumerate(terms)}
    rows = rows.withColumns({f"__tf{i}": c for i, c in tf.items()})
    if df == "corpus":
        rows = cut_lineage(rows.select(id_col, "passage_no", "text", "start", "dl", *[f"__tf{i}" for i in tf]))
        stats = rows.agg(
            F.count("*").alias("__n"), F.avg("dl").alias("__avg"),
            *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in tf],
        )
        rows = rows.join(F.broadcast(stats))  # one row
        n, avg = F.col("__n"), F.col("__avg")
        freq = {i: F.greatest(F.col(f"__df{i}"), F.lit(1)) for i in tf}
    else:
        n, avg = F.col("n_passages"), F.col("avg_len")
        freq = {i: F.greatest(F.lit(1.0), n * 0.1) for i in tf}
    score = F.lit(0.0)
    for i in tf:
        t = F.col(f"__tf{i}")
        idf = F.log((n - freq[i] + 0.5) / (freq[i] + 0.5) + 1)
        part = idf * (t * (K1 + 1)) / (t + K1 * (1 - B + B * (F.col("dl") / avg)))
        score = score + F.when(t == 0, 0.0).otherwise(part)
    return rows.select(id_col, "passage_no", "text", "start", "dl", score.alias("score"))


def _term_count(term: str) -> Column:
    return F.size(F.filter("terms", lambda x: x == F.lit(term)))


def best_passage_per_doc(scored: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """Documents by their best passage."""
    best = scored.where("score > 0").groupBy(id_col).agg(
        F.max_by(F.struct("passage_no", "text", "score"), F.struct(F.round("score", 9), -F.col("passage_no"))).alias("p")
    )
    return best.select(id_col, "p.*").orderBy(F.desc(F.round("score", 9)), id_col).limit(k)


def supporting_spans(scored: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """Best passages of each document with their offsets as citations."""
    w = Window.partitionBy(id_col).orderBy(F.desc(F.round("score", 9)), "passage_no")
    hits = scored.where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return hits.withColumns(
        {"end": F.col("start") + F.length("text"), "citation": F.concat_ws("-", F.lit("cite"), F.col(id_col), F.col("rank") - 1)}
    )


def hybrid_scores(bm25: DataFrame, semantic: DataFrame, weight: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """weight x BM25 + (1 - weight) x semantic similarity; a missing side counts as 0."""
    joined = bm25.select(id_col, F.col("score").alias("bm25")).join(
        semantic.select(id_col, F.col("similarity").alias("semantic")), id_col, "full_outer"
    ).fillna(0.0, ["bm25", "semantic"])
    return joined.withColumn("score", F.col("bm25") * weight + F.col("semantic") * (1 - weight))


_BOOSTS = {
    "what": r"(?i)\b(is|are|means?|defined?)\b",
    "how": r"(?i)\b(steps?|process|method|way)\b",
    "why": r"(?i)\b(because|reason|cause|due to)\b",
    "when": r"(?i)\b\d{4}\b|\b(date|time|year|month)\b",
    "who": r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b",
}


def question_kind(question: str) -> str:
    low = question.lower()
    return next((w for w in ("what", "how", "why", "when", "who", "where", "which") if low.startswith(w)), "other")


def answer_passages(docs: DataFrame, question: str, k: int = 3, spans: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Top passages per document with a boost for the kind of question, and the best sentence."""
    scored = bm25_passages(docs, question, spans, "fixed", id_col, text_col)
    boost = _BOOSTS.get(question_kind(question))
    factor = F.when(F.col("text").rlike(ascii_boundaries(boost)), 1.2).otherwise(1.0) if boost else F.lit(1.0)
    scored = scored.withColumn("confidence", F.least(F.col("score") * factor, F.lit(1.0)))
    w = Window.partitionBy(id_col).orderBy(F.desc(F.round("confidence", 9)), "passage_no")
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    wanted = tx.string_array(sorted(set(query_terms(question))))
    sentences = F.regexp_extract_all("text", F.lit(TERMINATED_SENTENCE), F.lit(0))
    overlaps = F.transform(
        sentences,
        lambda s, i: F.struct(F.size(F.array_intersect(wanted, tx.search_terms(s))).alias("n"), (-i).alias("i"), F.trim(s).alias("s")),
    )
    return top.select(
        id_col, "rank", "passage_no", "start", "text", "confidence", F.array_max(overlaps)["s"].alias("best_sentence")
    )


# --- extractive summaries --------------------------------------------------------------------


def summary_sentences(text: Column) -> Column:
    """Terminated sentences longer than ten characters."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TERMINATED_SENTENCE), F.lit(0)), _blank)
    return F.filter(found, lambda s: F.length(s) > 10)


def _overlap_sums():
    """Sum of Jaccard similarities of each sentence of one block to the sentences of another; null: to the others of its own."""

    def one(left, right, same) -> list[float]:
        vocabulary: dict[str, int] = {}
        rows = []
        for side in (left, right):
            rows.append([[vocabulary.setdefault(w, len(vocabulary)) for w in ws] for ws in side])
        a, b = (np.zeros((len(r), max(len(vocabulary), 1)), dtype=np.float32) for r in rows)
        for m, r in ((a, rows[0]), (b, rows[1])):
            for i, cols in enumerate(r):
                m[i, cols] = 1.0
        inter = (a @ b.T).astype(np.float64)
        union = a.sum(1, dtype=np.float64)[:, None] + b.sum(1, dtype=np.float64)[None, :] - inter
        jac = inter / np.maximum(union, 1.0)
        if same:
            np.fill_diagonal(jac, 0.0)
        return jac.sum(axis=1).tolist()

    @F.arrow_udf("array<double>")
    def sums(left: pa.Array, right: pa.Array) -> pa.Array:
        # row by row: the words of a whole batch as Python strings are ten times the batch
        out = []
        for i in range(len(left)):
            x, y = left[i].as_py(), right[i].as_py()
            out.append(one(x, x if y is None else y, y is None))
        return pa.array(out, pa.list_(pa.float64()))

    return sums


def rank_sentences(units: DataFrame, keys: Sequence[str], text_col: str = "text", block: int = 1000) -> DataFrame:
    """(keys, idx, sentence, score): summed word overlap of a sentence with all others of its text.

    Texts are compared block of sentences against block of sentences, each pair of blocks being a
    row of its own, so a very long text spreads over tasks and memory stays bounded; no pair of
    sentences ever becomes a row.
    """
    def blocks(sets: Column) -> Column:
        last = F.greatest(F.ceil(F.size(sets) / F.lit(block)).cast("int") - 1, F.lit(0))
        part = lambda i: F.slice(sets, i * block + 1, F.lit(block))
        pair = lambda i, j: F.struct(i.alias("i"), part(i).alias("left"), F.when(i != j, part(j)).alias("right"))
        grid = F.sequence(F.lit(0), last)
        pairs = F.flatten(F.transform(grid, lambda i: F.transform(grid, lambda j: pair(i, j))))
        return F.filter(pairs, lambda p: F.size(p["left"]) > 0)

    words = lambda s: F.array_distinct(tx.tokens(s, r"\b\w{3,}\b"))
    sets = F.transform(summary_sentences(F.col(text_col)), words)
    pairs = units.select(*keys, F.explode(let(sets, blocks)).alias("b"))
    partial = pairs.select(
        *keys, F.col("b.i").alias("__i"), _overlap_sums()("b.left", "b.right").alias("__p")
    )
    scored = partial.select(*keys, "__i", F.posexplode("__p").alias("__k", "__v")).groupBy(
        *keys, (F.col("__i") * block + F.col("__k")).alias("idx")
    ).agg(F.sum("__v").alias("score"))
    rows = units.select(*keys, F.posexplode(summary_sentences(F.col(text_col))).alias("idx", "sentence"))
    return rows.join(scored, [*keys, "idx"])


def _counted_sentences(units: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    """(keys, idx, sentence, __n) with the number of sentences of the text."""
    counted = let(
        summary_sentences(F.col(text_col)),
        lambda ss: F.transform(ss, lambda s: F.struct(s.alias("sentence"), F.size(ss).alias("n"))),
    )
    return units.select(*keys, F.posexplode(counted).alias("idx", "s")).select(
        *keys, F.col("s.n").alias("__n"), "idx", "s.sentence"
    )


def position_scores(units: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    rows = _counted_sentences(units, keys, text_col)
    score = F.when(F.col("idx") < 3, 1 - F.col("idx") * 0.2).when(F.col("idx") >= F.col("__n") - 2, 0.6).otherwise(0.3)
    return rows.withColumn("score", score).drop("__n")


def tfidf_scores(units: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """Sum over a sentence's words of tf x ln(sentences / occurrences of the word in the text)."""
    # a text's words stay in its row, so nothing is shuffled
    found = units.select(*keys, summary_sentences(F.col(text_col)).alias("__ss"))
    words = F.transform("__ss", lambda s: tx.tokens(s, r"\b\w{3,}\b"))
    scored = found.select(*keys, F.posexplode(F.arrays_zip(F.col("__ss").alias("sentence"), _rarity_sums()(words).alias("score"))).alias("idx", "s"))
    return scored.select(*keys, "idx", "s.sentence", "s.score")


def _rarity_sums():
    """Sum over each sentence's words of ln(sentences / occurrences of the word in all sentences)."""

    def one(sentences) -> list[float]:
        occurrences = Counter(w for ws in sentences for w in ws)
        weight = {w: math.log(len(sentences) / n) for w, n in occurrences.items()}
        return [math.fsum(weight[w] for w in ws) for ws in sentences]

    @F.arrow_udf("array<double>")
    def sums(texts: pa.Array) -> pa.Array:
        return pa.array([one(t.as_py() or []) for t in texts], pa.list_(pa.float64()))

    return sums


def pick_sentences(scored: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The ``n`` best sentences per text with their rank; order by ``idx`` to read them."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), "idx")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def summary_text(picked: DataFrame, keys: Sequence[str], joiner: str = " ") -> DataFrame:
    """Chosen sentences of each text joined in reading order (their number is bounded)."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "sentence")))
    return picked.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["sentence"]), joiner).alias("summary"))


def _summarise(units: DataFrame, keys: Sequence[str], budget: str) -> DataFrame:
    """Best sentences of each unit while their total length stays within its budget."""
    ranked = rank_sentences(units, [*keys, budget])
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), "idx").rowsBetween(Window.unboundedPreceding, 0)
    chosen = ranked.withColumn("__used", F.sum(F.length("sentence")).over(w)).where(F.col("__used") <= F.col(budget))
    out = units.select(*keys).join(summary_text(chosen, keys), list(keys), "left")
    return out.fillna("", ["summary"])


def hierarchical_summary(
    docs: DataFrame, max_length: int = 500, chunk_size: int = 4000, rounds: int = 3,
    separator: str = r"\n\n+", joiner: str = "\n\n", id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Summarise chunks, join the chunk summaries and summarise the result.

    Only texts whose joined chunk summaries exceed twice ``max_length`` go into another round;
    a text leaves the loop with the others' work untouched.
    """
    todo = docs.select(id_col, F.col(text_col).alias("text"))
    original = docs.select(id_col, F.length(text_col).alias("original_length"))
    done = None
    for i in range(rounds):
        chunks = let(
            packed_paragraphs(F.col("text"), chunk_size, separator, joiner),
            lambda cs: F.transform(cs, lambda c: F.struct(c.alias("text"), F.size(cs).alias("n"))),
        )
        units = todo.select(id_col, F.posexplode(chunks).alias("chunk_no", "c")).select(
            id_col, "chunk_no", "c.n", "c.text", (F.lit(float(max_length)) / F.col("c.n")).alias("budget")
        )
        parts = _summarise(units, [id_col, "chunk_no", "n"], "budget")
        ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "summary")))
        # three branches follow; the checkpoint keeps the map phase from running once per branch
        combined = cut_lineage(
            parts.groupBy(id_col).agg(
                F.first("n").alias("n"), F.array_join(F.transform(ordered, lambda x: x["summary"]), "\n\n").alias("text")
            )
        )
        single = combined.where("n = 1").select(id_col, F.col("text").alias("summary"))
        many = combined.where("n > 1")
        last = i == rounds - 1
        short = many if last else many.where(F.length("text") <= 2 * max_length)
        final = _summarise(short.select(id_col, "text", F.lit(float(max_length)).alias("budget")), [id_col], "budget")
        finished = single.unionByName(final.select(id_col, "summary"))
        done = finished if done is None else done.unionByName(finished)
        if last:
            break
        todo = many.where(F.length("text") > 2 * max_length).select(id_col, "text")
        if todo.isEmpty():
            break
    ratio = F.when(F.length("summary") > 0, F.col("original_length") / F.length("summary"))
    return done.join(original, id_col).withColumn("compression_ratio", ratio)


def bullet_summary(summary: Column) -> Column:
    return F.array_join(F.transform(summary_sentences(summary), lambda s: F.concat(F.lit("• "), s)), "\n")
