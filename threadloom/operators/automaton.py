"""Phrase matching with one automaton for all phrases: one pass over each text, whatever the number of phrases.

The phrases (a checked number of bytes) are broadcast once; each Python worker builds its automaton from them on first
use and keeps the latest one. Texts come in Arrow batches and leave as arrays of hits, so nothing is shuffled and there is
no row for a text position.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.sizing import broadcast_if_small

#: Greatest total length of the phrases, in bytes, that is sent to the workers.
PHRASE_BYTES = 32 << 20

_built: dict = {}


def phrases_within(phrases: DataFrame, column: str, limit: int = PHRASE_BYTES) -> list[str] | None:
    """The distinct phrases in order when they take at most ``limit`` bytes, else None. Empty and null ones match nothing."""
    distinct = phrases.where(F.length(column) > 0).select(column).distinct()
    size = distinct.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]
    return sorted(r[0] for r in distinct.collect()) if size <= limit else None


def _automaton(shared):
    if shared.id not in _built:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for number, phrase in enumerate(shared.value):
            machine.add_word(phrase, (number, len(phrase)))
        machine.make_automaton()
        _built.clear()
        _built[shared.id] = machine
    return _built[shared.id]


class _Shared:
    """A broadcast with its number, by which workers know an automaton again."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id() if broadcast._jbroadcast is not None else 0

    def __getstate__(self):
        return self.broadcast, self.id

    def __setstate__(self, state):
        self.broadcast, self.id = state

    @property
    def value(self):
        return self.broadcast.value


def hits(text: Column, phrases: list[str], spark) -> Column:
    """array<struct<phrase:int,start:int>>: every occurrence of every phrase, overlaps included, by start and phrase."""
    shared = _Shared(spark.sparkContext.broadcast(phrases))
    kind = pa.list_(pa.struct([("phrase", pa.int32()), ("start", pa.int32())]))

    @F.arrow_udf("array<struct<phrase:int,start:int>>")
    def find(texts: pa.Array) -> pa.Array:
        machine = _automaton(shared) if shared.value else None
        out = []
        for value in texts:  # one text at a time, so that a batch is not held twice
            value = value.as_py()
            if value is None or machine is None:
                out.append([])
            else:
                out.append([{"phrase": p, "start": s} for s, p in sorted((end - n + 1, p) for end, (p, n) in machine.iter(value))])
        return pa.array(out, kind)

    return find(text)


def match_phrases(docs: DataFrame, lexicon: DataFrame, phrases: list[str], term: str, id_col: str, text_col: str) -> DataFrame:
    """Lexicon rows with ``start`` and ``end`` for every occurrence of their lower-cased ``term`` in the texts."""
    spark = docs.sparkSession
    found = docs.select(id_col, text_col, F.explode(hits(F.lower(text_col), phrases, spark)).alias("__h"))
    numbered = spark.createDataFrame(list(enumerate(phrases)), "__phrase int, __low string")
    about = lexicon.withColumn("__low", F.lower(term)).join(numbered, "__low").drop("__low")
    rows = found.select(id_col, text_col, F.col("__h.phrase").alias("__phrase"), F.col("__h.start").alias("start"))
    return rows.join(broadcast_if_small(about), "__phrase").drop("__phrase").withColumn("end", F.col("start") + F.length(term))
