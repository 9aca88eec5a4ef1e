"""Large lexicons: the automaton against plain search and the other ways of matching."""

import random

from pyspark.sql import functions as F

from threadloom import lexicons as lx
from threadloom.operators import automaton
from threadloom.operators import patterns as pm


def lexicon(spark, terms):
    rows = [(m, "Name", t, "negative", 50, ["j"]) for m, t in terms]
    return spark.createDataFrame(rows, lx.LEXICON_SCHEMA)


def test_a_hundred_thousand_phrases(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    terms = {" ".join(word() for _ in range(r.randint(2, 3))) for _ in range(110_000)}
    terms = sorted(terms)[:100_000]
    docs = [(i, " ".join(word().upper() if r.random() < 0.1 else word() for _ in range(400))) for i in range(12)] + [(90, None), (91, ""), (92, terms[5] * 3)]
    got = pm.match_lexicon(spark.createDataFrame(docs, "doc_id long, text string"), lexicon(spark, [("m", t) for t in terms]))
    got = sorted((x.doc_id, x.term, x.start, x.end) for x in got.select("doc_id", "term", "start", "end").collect())
    want = []
    for i, text in docs:
        low = (text or "").lower()
        for t in terms:
            at = low.find(t)
            while at >= 0:
                want.append((i, t, at, at + len(t)))
                at = low.find(t, at + 1)
    assert len(want) > 500 and got == sorted(want)


def test_same_as_inline_and_keys(spark, monkeypatch):
    terms = [("a", "Is"), ("a", "this"), ("b", "is"), ("b", "is is"), ("c", "ça"), ("c", "x"), ("a", "this"), ("d", "aa")]
    docs = spark.createDataFrame([(1, "This is is ÇA 😀 ça"), (2, "aaaa"), (3, None), (4, "")], "doc_id long, text string")
    shown = lambda: sorted(map(str, pm.match_lexicon(docs, lexicon(spark, terms)).collect()))
    inline = shown()
    monkeypatch.setattr(pm, "INLINE_ROWS", 3)
    assert shown() == inline and len(inline) > 10
    monkeypatch.setattr(automaton.phrases_within, "__defaults__", (3,))
    assert shown() == inline


def test_phrases_of_nothing(spark):
    none = lexicon(spark, [("a", "")])
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    phrases = automaton.phrases_within(none.select(F.lower("term").alias("term")), "term")
    assert phrases == [] and automaton.match_phrases(docs, none, phrases, "term", "doc_id", "text").collect() == []


def test_only_positions_of_a_key_become_windows(spark):
    from threadloom.functions import keybits

    texts = [(1, "ab cd é😀x ab"), (2, "nothing"), (3, "a"), (4, None), (5, ""), (6, "éxab" * 3000)]
    docs = spark.createDataFrame(texts, "doc_id long, low string")
    keys = spark.createDataFrame([("ab",), ("é😀",), ("zz",), (None,)], "k string")
    got = keybits.windows(docs, "doc_id", "low", keybits.of_keys(keys, "k", 2), 2, 5).collect()
    want = [(i, p, t[p : p + 5]) for i, t in texts if t for p in range(len(t) - 1) if t[p : p + 2] in ("ab", "é😀", "zz")]
    assert sorted(map(tuple, got)) == sorted(want)
    assert keybits.windows(docs, "doc_id", "low", keybits.of_keys(keys.limit(0), "k", 2), 2, 5).isEmpty()
