"""Operators on small literal inputs, against brute force where a result is not obvious."""

import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom import lexicons as lx
from threadloom.functions import ordered
from threadloom.functions import spans as sp
from threadloom.functions import textfn as tx
from threadloom.functions import vectors as vec
from threadloom.operators import chunking as ch
from threadloom.operators import classify as cl
from threadloom.operators import conversations as cv
from threadloom.operators import custody as cu
from threadloom.operators import graph as gr
from threadloom.operators import mapping as mp
from threadloom.operators import patterns as pm
from threadloom.operators import retrieval as rt
from threadloom.operators import search as sr
from threadloom.operators import stats as st
from threadloom.operators import tables as tb
from threadloom.operators import text as tt
from threadloom.sinks import writers as wr
from threadloom.sources import readers as rd
from threadloom.streaming import jobs as sj


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# --- spans and lexicon ------------------------------------------------------------------------


def test_literal_starts_overlapping(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aab ") for _ in range(rng.randrange(0, 40))) for _ in range(60)] + ["aaaa", "", "baa"]
    df = docs(spark, *texts).select("text", sp.literal_starts(F.col("text"), F.lit("aa")).alias("s"))
    for text, got in df.collect():
        assert got == [i for i in range(len(text) - 1) if text[i : i + 2] == "aa"]


def test_regex_spans_agree_with_finditer(spark):
    texts = ["12 ab 345", "", "é12é 7", "no digits", "99"]
    for pattern in (r"\d+", r"\b[a-z]{2}\b", r"\b\d{2}\b"):
        df = docs(spark, *texts).select("text", sp.regex_spans(F.col("text"), pattern).alias("s"))
        for text, got in df.collect():
            want = [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, text, re.ASCII)]
            assert [tuple(x) for x in got] == want


def test_builtin_phrases(spark):
    lexicon = lx.builtin_lexicon(spark)
    modules = ["gaslighting", "love_bombing", "blame_shifting", "threats_intimidation"]
    terms = {r.module: r.term for r in lexicon.where(F.col("module").isin(modules)).groupBy("module").agg(F.min("term").alias("term")).collect()}
    d = docs(spark, *[f"Last spring a neighbour wrote: {terms[m].upper()} -- and went home." for m in modules], "Rain fell on the orchard.")
    found = pm.match_lexicon(d, lexicon)
    by_doc = {}
    for r in found.collect():
        by_doc.setdefault(r.doc_id, set()).add(r.module)
        assert r.matched_text.lower() == r.term
    assert all(m in by_doc[i] for i, m in enumerate(modules)) and 4 not in by_doc
    only = pm.match_lexicon(d, pm.enabled_lexicon(lexicon, ["love_bombing"]))
    assert {r.module for r in only.collect()} == {"love_bombing"}
    scores = {r.doc_id: r.severity_score for r in cl.severity_scores(found).collect()}
    assert all(0 < scores[i] <= 100 for i in (0, 2, 3))


def test_large_lexicon_path_equals_inline(spark):
    rng = random.Random(5)
    d = docs(spark, *["".join(rng.choice("abc") for _ in range(1500)) for _ in range(6)], "ab", "")
    lexicon = lx.term_lexicon(spark, {"m": ["abc", "bca", "aaaa", "cabcab"], "n": ["abc"]})
    key = ["doc_id", "module", "term", "start", "end"]
    inline = pm.match_lexicon(d, lexicon).select(key)
    keyed = pm._match_by_keys(d, lexicon, "doc_id", "text").select(key)
    assert inline.exceptAll(keyed).isEmpty() and keyed.exceptAll(inline).isEmpty()


def test_severity_formula(spark):
    df = spark.createDataFrame([(1, "negative", 90), (1, "negative", 85), (2, "positive", 80)], "doc_id int, category string, severity int")
    got = {r.doc_id: r.severity_score for r in cl.severity_scores(df).collect()}
    assert got == {1: min(100, round(87.5 * min(2, 1 + math.log10(3)))), 2: 0}


def test_contradictions_brute_force(spark):
    rng = random.Random(1)
    mods = [("love_bombing", "positive"), ("apologies", "positive"), ("gaslighting", "negative"), ("projection", "negative")]
    rows = []
    for i in range(120):
        m, c = rng.choice(mods)
        s = rng.randrange(0, 20000)
        rows.append((1, m, m, f"t{i}", c, "x", s, s + 3))
    df = spark.createDataFrame(rows, "doc_id int, module string, module_name string, term string, category string, matched_text string, start int, end int")
    want = {
        (p[3], n[3]) for p in rows for n in rows if n[4] == "negative" and (
            (p[1] == "love_bombing" and n[1] in lx.DEVALUATION_MODULES and abs(n[6] - p[6]) < 2000)
            or (p[1] == "apologies" and 0 < n[6] - p[6] < 3000))
    }
    got = [(r.pos_term, r.neg_term) for r in pm.contradictions(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_screening_keeps_match_at_offset_zero(spark):
    d = docs(spark, "my daughter called", "She won't let you see anyone. Casey is here", "hello")
    flags = pm.screen(d, pm.screening_rules(["Casey"])).collect()
    assert (0, 0) in {(f.doc_id, f.start) for f in flags}
    assert {f.grp for f in flags if f.doc_id == 1} >= {"child_name", "visit_blocking"}
    summary = {r.doc_id: r for r in pm.screen_summary(d, pm.screen(d)).collect()}
    assert summary[2].immediate_severity == 5 and summary[0].child_mentioned


def test_rule_types(spark):
    d = docs(spark, "# Title\n- item\nsee src/main.py TODO fix\n555-123-4567", "plain")
    rules = spark.createDataFrame(
        [("s", "h", "h", "structural", "has-heading", 1, True, "label"), ("s", "p", "p", "path", "src/*.py", 2, True, "flag"),
         ("s", "bad", "b", "regex", "(", 9, True, "flag"), ("s", "off", "o", "keyword", "plain", 9, False, "flag")], lx.RULE_SCHEMA)
    got = pm.evaluate_rules(d, rules.unionByName(lx.builtin_rules(spark)))
    by_rule = {r.rule_id: r.matched_text for r in got.collect()}
    assert by_rule["h"] == "# Title" and by_rule["p"] == "src/main.py"
    assert by_rule["code-todo"] == "TODO" and by_rule["pii-phone"] == "555-123-4567"
    assert "bad" not in by_rule and "off" not in by_rule


# --- ordered helpers --------------------------------------------------------------------------


def test_bucketed_order_equals_plain_windows(spark):
    rng = random.Random(2)
    # one key holds most of the rows
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, rng.randrange(100)) for i in rng.sample(range(3000), 600)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    bucket = F.floor(F.col("t") / 37)
    w = Window.partitionBy("k").orderBy("t")
    want = df.withColumns({"p": F.lag("v").over(w), "n": F.lead("v").over(w), "s": F.sum("v").over(w), "r": F.row_number().over(w)})
    got = ordered.previous(df, ["k"], ["t"], bucket, {"p": "v"})
    got = ordered.following(got, ["k"], ["t"], bucket, {"n": "v"})
    got = ordered.running_sums(got, ["k"], ["t"], bucket, {"s": F.col("v"), "r": F.lit(1)})
    cols = ["k", "t", "v", "p", "n", "s", "r"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_exact_percentiles(spark):
    rng = random.Random(4)
    values = {k: [round(rng.random() * 50, 2) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 333))}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    got = ordered.exact_percentiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}, F.floor("v"))
    for r in got.collect():
        assert r.p50 == pytest.approx(np.percentile(values[r.k], 50)) and r.p95 == pytest.approx(np.percentile(values[r.k], 95))


def test_moving_averages_fold(spark):
    rng = random.Random(9)
    rows = [("p", i, rng.random() < 0.8, rng.random() * 10) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t int, success boolean, duration double")
    ok, lat = 1.0, 0.0
    for _k, _t, s, d in rows:
        ok = 0.1 * s + 0.9 * ok
        if s and d > 0:
            lat = 0.1 * d + 0.9 * lat
    got = st.moving_averages(df, "k", ["t"], F.floor(F.col("t") / 20)).first()
    assert got.success_rate == pytest.approx(ok) and got.avg_latency == pytest.approx(lat)


# --- text and chunks --------------------------------------------------------------------------


def test_overlap_resolution_brute_force(spark):
    d = docs(spark, "Call Ann Lee on 01/02/2024 at 10:30 PM for $5,000 or 12.5% see https://x.org/a Ann Lee", "John Smith Brown-Jones Alpha Beta")
    for doc, text in d.collect():
        found = []
        for i, (kind, p) in enumerate(lx.ENTITY_PATTERNS):
            found += [(m.start(), i, m.end(), kind) for m in re.finditer(p, text, re.ASCII)]
        kept = []
        for s in sorted(found):
            if not kept or s[0] >= kept[-1][2]:
                kept.append(s)
        got = tt.extract_entities(d.where(F.col("doc_id") == doc)).collect()
        assert [(r.start, r.end, r.type) for r in got] == [(k[0], k[2], k[3]) for k in kept]


def test_long_runs_do_not_overflow_the_regex_stack(spark):
    d = docs(spark, "Abc Def " * 6_000, "x" * 100_000, "\n".join(["line"] * 10_000))
    assert tt.extract_entities(d).where("type = 'PERSON'").count() == 1
    assert tt.split_sentences(d).count() == 3
    assert ch.paragraph_chunks(d).count() == 3


def test_fixed_chunks(spark):
    d = docs(spark, "abcdefghijklmnopqrstuvwxyz", "", "short")
    for size, overlap in ((10, 0), (10, 3), (30, 10), (5, 4)):
        by_doc = {}
        for r in ch.fixed_chunks(d, size, overlap).orderBy("chunk_no").collect():
            by_doc.setdefault(r.doc_id, []).append(r)
        text = "abcdefghijklmnopqrstuvwxyz"
        want, at = [], 0
        while True:
            want.append(text[at : at + size])
            if at + size >= len(text):
                break
            at += size - overlap
        assert [r.chunk for r in by_doc[0]] == want and 1 not in by_doc and len(by_doc[2]) >= 1
    with pytest.raises(ValueError):
        ch.fixed_chunks(d, 5, 5)


def test_separator_chunks(spark):
    rows = ch.separator_chunks(docs(spark, "Section 1\n\nSection 2\n\nSection 3"), "\n\n").collect()
    assert [r.chunk for r in rows] == ["Section 1", "Section 2", "Section 3"] and [r.start for r in rows] == [0, 11, 22]


def _boundary(text, size, overlap):
    out, pos = [], 0
    while len(text) - pos >= size:
        window = text[pos:]
        brk = size
        para, sent = window.rfind("\n\n", 0, size + 2), window.rfind(". ", 0, size + 2)
        if para > size * 0.5:
            brk = para + 2
        elif sent > size * 0.5:
            brk = sent + 2
        brk = min(brk, len(window))
        out.append((pos, window[:brk]))
        pos += brk - overlap
    if pos < len(text):
        out.append((pos, text[pos:]))
    return out


def test_boundary_chunks_brute_force(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["word ", "x. ", "\n\n", "longer words "]) for _ in range(rng.randrange(1, 120))) for _ in range(12)]
    for size, overlap in ((60, 0), (80, 10)):
        got = {}
        for r in ch.boundary_chunks(docs(spark, *texts), size, overlap).orderBy("doc_id", "chunk_no").collect():
            got.setdefault(r.doc_id, []).append((r.start, r.chunk))
        for i, text in enumerate(texts):
            assert got.get(i, []) == _boundary(text, size, overlap)


def test_text_page(spark):
    d = docs(spark, "A" * 10_000)
    assert tt.text_pages(d, 1000).count() == 10
    last = tt.text_page(d, 99, 1000).first()
    assert last.page == 10 and not last.has_more and len(last.content) == 1000


def test_timestamps(spark):
    d = docs(spark, "Monday, January 15, 2024 at 3:45 PM", "Jan 15, 2024 at 3:45 PM", "2024-01-15 15:45:00", "soon")
    got = d.select(tx.parse_timestamp(F.col("text")).alias("p")).select("p.*").collect()
    assert [r.ts for r in got[:3]] == [dt.datetime(2024, 1, 15, 15, 45)] * 3
    assert got[3].ts is None and got[3].precision == "inferred"


# --- conversations ----------------------------------------------------------------------------


def test_segmentation_reasons(spark):
    t0 = dt.datetime(2024, 1, 1, 10)
    s = lambda h: t0 + dt.timedelta(seconds=h)
    unit = lambda c: [c, math.sqrt(1 - c * c)]
    rows = [
        (1, "sms", s(0), "A", [1.0, 0.0]), (2, "sms", s(7200), "A", unit(0.61)), (3, "sms", s(14401), "A", [1.0, 0.0]),
        (4, "sms", s(14402), "A", unit(0.59)), (5, "sms", s(14403), "B", unit(0.59)), (6, "fb", s(1), "A", [1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "message_id long, platform string, ts timestamp_ntz, topic string, e array<double>")
    got = {r.message_id: (r.reason, r.segment_no) for r in cv.segment_messages(df, ["platform"], embedding="e", bucket=F.date_trunc("hour", "ts")).collect()}
    assert got == {1: ("first_message", 1), 2: (None, 1), 3: ("time_gap", 2), 4: ("topic_change", 3), 5: ("entity_change", 4), 6: ("first_message", 1)}
    ids = spark.range(1).select(tx.cluster_id(F.lit("sms"), F.lit(t0).cast("timestamp"), F.lit("topic"), F.lit(1)).alias("c"))
    assert ids.first().c == "SMS_2401_TOPICX_001"
    many = spark.range(1, 1006).select(tx.cluster_id(F.lit("sms"), F.lit(t0).cast("timestamp"), F.lit("topic"), F.col("id")).alias("c"))
    assert many.distinct().count() == 1005 and many.where("endswith(c, '_1005')").count() == 1


def test_upsert_sink_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    write = sj.upsert_batches(path, ["k"], ["v"])
    df = lambda rows: spark.createDataFrame(rows, "k int, v int")
    write(df([(1, 1), (2, 1), (1, 2)]), 0)
    write(df([(1, 5)]), 1)
    write(df([(1, 5)]), 1)
    assert {tuple(r) for r in sj.latest_version(spark, path).collect()} == {(1, 5), (2, 1)}


# --- search and retrieval ---------------------------------------------------------------------


def test_cosine_edge_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vec.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_similar_pairs_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    x = np.concatenate([c + rng.normal(scale=0.2, size=(30, 8)) for c in centres] + [np.tile(centres[0], (40, 1)), np.zeros((2, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sr.similar_pairs(df, 0.9, pivots=5, block=16).collect()
    first, copies = {}, {}
    for i, v in enumerate(map(tuple, x)):
        first.setdefault(v, i)
        copies[v] = copies.get(v, 0) + 1
    reps = [(i, np.array(v), copies[v]) for v, i in first.items() if np.linalg.norm(v) > 0]
    want = {}
    for a in reps:
        for b in reps:
            if a[0] < b[0]:
                c = a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1])
                if c > 0.9:
                    want[(a[0], b[0])] = (a[2], b[2])
    assert len(got) == len(want) and {(r.id1, r.id2): (r.copies1, r.copies2) for r in got} == want


def test_top_matches_in_query_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    whole = sr.top_matches(df, q, 3, exclude_self=True).select("query_id", "vec_id", "rank").collect()
    monkeypatch.setattr(sr, "QUERY_BLOCK", 20)
    blocked = sr.top_matches(df, q, 3, exclude_self=True).select("query_id", "vec_id", "rank").collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, blocked)) and len(whole) == 240


def test_sentence_ranking_is_block_independent(spark):
    text = " ".join(f"Sentence number {i % 7} talks about topic {i % 5} again." for i in range(40))
    d = docs(spark, text, "No terminator here", "")
    one = {(r.doc_id, r.idx): round(r.score, 9) for r in rt.rank_sentences(d, ["doc_id"]).collect()}
    many = {(r.doc_id, r.idx): round(r.score, 9) for r in rt.rank_sentences(d, ["doc_id"], block=7).collect()}
    assert one == many and len(one) == 40


def test_hierarchical_summary(spark):
    para = lambda i: " ".join(f"Topic {i} sentence {j} mentions shared words and topic {i}." for j in range(12))
    d = docs(spark, "\n\n".join(para(i) for i in range(9)), "Only one short text. It has two sentences.")
    got = {r.doc_id: r for r in rt.hierarchical_summary(d, 1000, 1000).collect()}
    assert set(got) == {0, 1} and 0 < len(got[0].summary) <= 1000
    assert got[1].summary == "Only one short text. It has two sentences."


def test_bm25_by_hand(spark):
    d = docs(spark, "alpha beta gamma delta alpha\n\nbeta beta epsilon zeta eta\n\ngamma theta iota kappa lambda")
    got = {r.passage_no: r.score for r in rt.bm25_passages(d, "alpha beta").collect()}
    idf = math.log((3 - 1 + 0.5) / 1.5 + 1)
    tf = lambda n: idf * n * 2.2 / (n + 1.2)
    assert got[0] == pytest.approx(tf(2) + tf(1)) and got[1] == pytest.approx(tf(2)) and got[2] == 0


# --- tables, mapping, custody, graph ----------------------------------------------------------


def test_schema_resolution(spark):
    df = spark.createDataFrame([("A", "B", "a@b.c", "+1 555 0100")], "first_name string, last_name string, email_address string, phone_number string")
    exact = {m["source"]: m["target"] for m in mp.assign(mp.name_scores(df.columns), "exact", 1.0)}
    assert exact["phone_number"] == "address" and mp.resolve_schema(df)
    unknown = spark.createDataFrame([("2024-01-01", "x" * 60, "Ann Lee")] * 3, "q1 string, q2 string, q3 string")
    assert {m["source"]: m["target"] for m in mp.resolve_schema(unknown)} == {"q1": "date", "q2": "body", "q3": "contactName"}


def test_normalised_messages(spark):
    raw = spark.createDataFrame([("Ann", "Bob", "hi", "2024-01-01")], "from string, to string, body string, date string")
    r = mp.normalize_messages(raw).first()
    assert (r.sender, r.recipient, r.text, r.type) == ("Ann", "Bob", "hi", "unknown") and len(r.message_id) == 64


def test_parsers(spark):
    log = docs(spark, "[2024-01-01 10:00:00] Ann: Hello\nmore\n[2024-01-01 10:05:00] Bob: Hi: there")
    got = rd.parse_log(log).orderBy("message_no").collect()
    assert [(r.sender, r.text) for r in got] == [("Ann", "Hello\nmore"), ("Bob", "Hi: there")]
    talk = docs(spark, "intro\nMe [2024-01-01 10:00]: Hello\nagain\n2024-01-01 10:05 - Bob: Yes")
    got = rd.parse_transcript(talk).orderBy("message_no").collect()
    assert [(r.sender, r.is_from_me) for r in got][0] == ("Me", True) and got[0].text == "Hello again"


def test_custody_faults(spark):
    t0 = dt.datetime(2024, 1, 1)
    schema = "evidence_id int, seq int, stage string, hash string, input_hash string, ts timestamp"
    chain = spark.createDataFrame(
        [(1, 0, "original", "h", None, t0), (1, 1, "parsed", "p", "h", t0), (2, 0, "original", "h", None, t0),
         (2, 1, "parsed", "p", "zzz", t0 - dt.timedelta(days=1)), (3, 0, "parsed", "x", None, t0)], schema)
    evidence = spark.createDataFrame([(i, "h") for i in (1, 2, 3, 4)], "evidence_id int, original_hash string")
    got = {r.evidence_id: r for r in cu.verify_chains(evidence, chain).collect()}
    assert got[1].valid and got[1].last_verified_stage == "parsed"
    assert (got[2].n_errors, got[2].n_warnings) == (1, 1) and got[3].n_errors == 2
    assert got[4].first_error.startswith("Chain is empty")


def test_graph_shortcut_and_depth(spark):
    e = spark.createDataFrame([(a, b, "T") for a, b in [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("b", "e")]], "src string, dst string, type string")
    paths = gr.shortest_paths(e, "a", "f", 5).collect()
    assert [(r.hops, r.path) for r in paths] == [(3, ["a", "b", "e", "f"])]
    assert gr.shortest_paths(e, "a", "f", 2).isEmpty()
    near = {r.id: r.hops for r in gr.neighbourhood(e, spark.createDataFrame([("a",)], "id string"), 2).collect()}
    assert near == {"a": 0, "b": 1, "c": 2, "e": 2}


def test_three_way_merge_conflict(spark):
    t = lambda *ls: spark.createDataFrame(list(enumerate(ls)), "n int, line string")
    got = tb.three_way_merge(t("a", "b", "c"), t("a", "x", "c"), t("a", "y", "z"), ["n"]).orderBy("n").collect()
    assert [r.conflict for r in got] == [False, True, False] and got[2].merged == "z" and "OURS\nx" in got[1].merged


def test_reader_roundtrips(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('{"export_date": "x", "messages": [{"id": "1", "from": "Ann", "body": "hi", "date": "2024-01-01"}]}')
    r = mp.normalize_messages(rd.read_json_messages(spark, str(p))).first()
    assert (r.sender, r.text) == ("Ann", "hi")
    x = tmp_path / "b.xml"
    x.write_text('<smses><sms address="+15551" date="1704103200000" type="2" body="one"/><sms address="+15552" date="1704103200000" type="1" body="two"/></smses>')
    got = {r.text: (r.sender, r.address) for r in rd.read_sms_xml(spark, str(x)).collect()}
    assert got == {"one": ("Me", "+15551"), "two": ("+15552", "+15552")}
    wr.write_csv(spark.createDataFrame([('say "hi"\nyou ', "Ann")], "body string, contactName string"), str(tmp_path / "c"))
    back = rd.read_delimited(spark, str(tmp_path / "c")).first()
    assert back.body == 'say "hi" you ' and back.contactName == "Ann"


def test_consensus_votes(spark):
    df = spark.createDataFrame([("negative", None, "negative", -0.6, 0.1, 5, 0, False, 5), ("positive", "negative", "neutral", 0.3, 0.8, 1, 0, True, 9)],
                               "a string, b string, c string, pol double, sub double, n int, p int, neg boolean, pri int")
    got = cl.consensus(df, ["a", "b", "c"], "pol", "sub", "n", "p", "neg", "pri", F.lit(6)).collect()
    assert (got[0].label, got[0].severity) == ("abusive", 10)
    assert (got[1].label, got[1].sarcasm, got[1].severity) == ("positive", True, 9)


def test_rule_blocks(spark, monkeypatch):
    from threadloom.functions import sizing

    d = docs(spark, "one two three two", "three")
    rows = [("s", f"r{i}", w, "keyword", w, i, True, "flag") for i, w in enumerate(["one", "two", "three", "four"])]
    rules = spark.createDataFrame(rows, lx.RULE_SCHEMA)
    whole = sorted(map(str, pm.evaluate_rules(d, rules).collect()))
    monkeypatch.setattr(pm, "row_blocks", lambda df, key, _n: sizing.row_blocks(df, key, 1))
    assert sorted(map(str, pm.evaluate_rules(d, rules).collect())) == whole and len(whole) == 5


def test_related_items_brute_force(spark):
    """Own rows, repeated items, repeated and missing tags and categories; no pair of items is formed."""
    r = random.Random(5)
    rows = [(r.randint(0, 60), r.choice(["x", "y", None]), r.choice([None, ["a"], ["b", "a"], ["a", "a", "c"], [], ["c", "b"]])) for _ in range(120)]
    df = spark.createDataFrame(rows, "item long, category string, tags array<string>")
    score = lambda a, b: -1 if a is None or b is None else 2 * len(set(a) & set(b)) + 1
    want = []
    asked = [x for x in rows if x[0] % 3 == 0]
    for subject in {x[0] for x in asked}:
        found = [(-score(t, st), i, c) for s, sc, st in asked if s == subject for i, c, t in rows if c is not None and c == sc and i != subject]
        want += [(subject, i, c, -n, rank) for rank, (n, i, c) in enumerate(sorted(found, key=lambda f: f[:2])[:4], 1)]
    got = pm.related_items(df, df.where("item % 3 = 0"), "item", "category", "tags", 4)
    have = [(*x[:3], -1 if x.score is None else x.score, x.rank) for x in got.collect()]
    plain = lambda all_rows: sorted((s, n, rank, i) for s, i, c, n, rank in all_rows)
    assert plain(have) == plain(want) and want


def test_related_items_of_one_kind_are_not_paired(spark):
    df = spark.range(30_000).select(F.col("id").alias("item"), F.lit("x").alias("category"), F.array(F.lit("a")).alias("tags"))
    got = pm.related_items(df, df, "item", "category", "tags", 2).where("rank = 2")
    assert got.count() == 30_000 and {r.related for r in got.select(F.col("item").alias("related")).distinct().collect()} == {1, 2}


def test_chunks_without_words_have_unit_vectors(spark):
    got = sr.embed_chunks(ch.fixed_chunks(docs(spark, "### $$$ ***", "é ü", "word", "### word"), 1000, 100))
    norms = {r.doc_id: r.n for r in got.select("doc_id", vec.norm(F.col("embedding")).alias("n")).collect()}
    assert norms.keys() == {0, 1, 2, 3} and all(abs(n - 1) < 1e-9 for n in norms.values())
    word, mixed = (next(r.embedding for r in got.collect() if r.doc_id == i) for i in (2, 3))
    assert word == mixed
    assert all(not any(r.e) for r in docs(spark, "", None).select(sr.hash_embedding(F.col("text")).alias("e")).collect())


def test_hash_embedding_is_a_sum_of_sines(spark):
    def word_hash(word):
        h = 0
        for c in word:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return h - (1 << 32) if h >> 31 else h

    texts = ["one two two", "x", "é ☂ 🌧", "many " * 5000 + "words " * 3, "", None]
    words = [["one", "two", "two"], ["x"], ["é ☂ 🌧"], ["many"] * 5000 + ["words"] * 3, [], []]
    for n in (384, 7, 1):
        got = [r.e for r in docs(spark, *texts).orderBy("doc_id").select(sr.hash_embedding(F.col("text"), n).alias("e")).collect()]
        for ws, e in zip(words, got):
            v = sum((np.sin(word_hash(w) * np.arange(1, n + 1, dtype=np.float64)) for w in ws), np.zeros(n))
            assert e == pytest.approx(v / (np.linalg.norm(v) or 1), abs=1e-11)


def test_vectors_of_chunks_are_not_shuffled(spark):
    """Equal texts become neighbours and share a vector, across batches too; a filter after it takes no wrong one."""
    texts = ["a b c", "d", "", "e f", "d"] * 40 + [None, "g"]
    plain = {r.text: r.e for r in docs(spark, *texts).select("text", sr.hash_embedding(F.col("text")).alias("e")).distinct().collect()}
    made = sr.embed_chunks(docs(spark, *texts), text_col="text")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(text_hash") == 1
    counted = made.groupBy("doc_id").agg(F.count("embedding"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [text_hash" in counted
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for rows in (made.collect(), made.where("doc_id % 3 = 1").collect()):
            assert rows and all(list(r.embedding) == list(plain[r.text]) for r in rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert made.count() == 202 and made.columns == ["text_hash", "doc_id", "text", "embedding", "model"]


@pytest.fixture(scope="module")
def odd_texts(spark, tmp_path_factory):
    """A documents table with empty and null texts and a null language, and its SQL side."""
    import duckdb

    path = tmp_path_factory.mktemp("odd")
    rows = [(0, "a" * 3001, "en"), (1, "", "de"), (2, None, "de"), (3, " ", "fr"), (4, "5% of 7.5% x@y.org 5%", None), (5, "###", "en"), (6, "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    return str(path), con


def as_in_sql(spark, odd_texts, name):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "scripts"))
    from check_oracle import compare

    status, _rows, _s, _q, note = compare(spark, odd_texts[0], name, odd_texts[1])
    assert status == "ok", note


@pytest.mark.parametrize("name", ["document_records", "graph_export", "embedded_chunks", "fixed_chunks", "chunk_statistics"])
def test_texts_without_characters_are_one_chunk(spark, odd_texts, name):
    as_in_sql(spark, odd_texts, name)


def test_mean_latency_of_a_half_goes_up(spark):
    """Added in this order, nine values of sum 4.5 give 4.499999999999999."""
    values = [0.4, 0.4, 0.1, 1.2, 0.4, 0.4, 0.7, 0.8, 0.1]
    calls = spark.createDataFrame([(1, v, True) for v in values], "u int, duration double, success boolean").coalesce(1)
    assert [tuple(r) for r in st.prompt_usage(calls, "u").collect()] == [(1, 9, 100, 1)]


def test_added_vectors_do_not_replace_old_ones(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    spark.createDataFrame([(i, i % 3) for i in (0, 2, 5, 100_000, 100_002, 100_005)], "vec_id long, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["vector_store_ops"]).fetchall()
    assert sorted(map(tuple, entry.queries()["vector_store_ops"](spark, str(tmp_path)).collect())) == sorted(want)


def test_keywords_are_counted_without_a_shuffle(spark):
    text = "the bbb aaa bbb ccc aaa ddd"
    for made in (tt.extract_keywords(docs(spark, text, "", None, "x"), 3), tt.extract_keywords_by_share(docs(spark, f"{text} eeee  eeee ffff", " ", None), 2)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in tt.extract_keywords(docs(spark, text, "", None, "x"), 3).collect()]
    assert got == [(0, "bbb", 2, 1, 1, 1.0), (0, "aaa", 2, 2, 2, 1.0), (0, "ccc", 1, 4, 3, 0.5)]
    got = [tuple(r) for r in tt.extract_keywords_by_share(docs(spark, f"{text} eeee  eeee ffff", " ", None), 2).collect()]
    assert got == [(0, "eeee", 2, 7, 1, 0.2), (0, "ffff", 1, 9, 2, 0.1)]


def test_limited_pairs_are_the_best_of_all(spark):
    """Tasks keep no more than the limit, and ties at its edge go by id."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 4)).round(0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    every = sr.similar_pairs(df, 0.5, pivots=3, block=200).orderBy(F.desc("similarity"), "id1", "id2").limit(40).collect()
    some = sr.similar_pairs(df, 0.5, 40, pivots=3, block=200)
    assert [(r.id1, r.id2) for r in some.collect()] == [(r.id1, r.id2) for r in every] and len(every) == 40


def test_no_pair_above_the_threshold_is_left_out(spark, tmp_path):
    """More than a hundred pairs, copies among them, each once; small blocks, one cluster or several."""
    import __spark_entry__ as entry

    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 6))
    x[200:230], x[250] = x[0], 0
    df = spark.createDataFrame([(i * 7 % 300, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    by_id = {r.vec_id: np.array(r.embedding) for r in df.collect()}
    unit = np.array([by_id[i] / (np.linalg.norm(by_id[i]) or 1) for i in range(300)])
    want = lambda t: {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T > t)) if i < j}
    got = entry.queries()["near_dup_vectors"](spark, str(tmp_path)).collect()
    assert len(got) == len(want(0.35)) > 1000 and {(r.id1, r.id2) for r in got} == want(0.35)
    assert all(r.similarity == pytest.approx(unit[r.id1] @ unit[r.id2], abs=1e-6) for r in got)
    for threshold, pivots in ((0.35, 4), (0.8, 4), (0.97, 7)):
        some = sr.similar_pairs(df, threshold, pivots=pivots, block=20, collapse=False).collect()
        assert len(some) == len(want(threshold)) and {(r.id1, r.id2) for r in some} == want(threshold)


def test_tfidf_scores_stay_in_their_row(spark):
    made = rt.tfidf_scores(docs(spark, "One two three words. Three two more words! And three again here?", "", None, "no end"), ["doc_id"])
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    words = [["one", "two", "three", "words"], ["three", "two", "more", "words"], ["and", "three", "again", "here"]]
    every = sum(words, [])
    got = {(r.doc_id, r.idx): r.score for r in made.collect()}
    assert got == pytest.approx({(0, i): sum(math.log(3 / every.count(w)) for w in ws) for i, ws in enumerate(words)})


def test_entity_shortcuts_change_no_match(spark):
    from threadloom.functions import spans as sp
    from threadloom.operators import text as tt

    words = ["12/03/2024", "x1-2-99", "March 3, 2024", "may 5 1999", "at 10:30 pm", "$1,200.50 million", "300 EUR", "12.5%", "_7%", "a.b+c@d-e.org", "x@y", "@home.de",
             "https://a.b/c?d", "Anna Maria Lang", "Anna", "Anna  Lang", "AnnaX Lang", "éAnna Lang", "\n", "dismay 3 1999", "a@b.co@c.de"]
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 6)))) for i in range(400)] + [(400, None), (401, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = tt.extract_entities(docs, resolve_overlaps=False).select("doc_id", "type", "text", "start")
    want = None
    for kind, pattern in tt.lx.ENTITY_PATTERNS:
        found = docs.select("doc_id", F.lit(kind).alias("type"), F.explode(sp.regex_spans(F.col("text"), pattern)).alias("e")).select("doc_id", "type", "e.text", "e.start")
        want = found if want is None else want.unionByName(found)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # a text without the sign that a pattern needs is not searched for it
    assert set(tt._ENTITY_NEEDS) | set(tt._ENTITY_BEGINS) < set(range(len(tt.lx.ENTITY_PATTERNS)))


def test_runs_of_word_characters_need_no_boundaries(spark):
    from threadloom.functions import spans as sp

    assert sp.ascii_boundaries(r"\b\w{2,}\b") == r"\w{2,}" and sp.ascii_boundaries(r"\b[a-z]+\b") != "[a-z]+"
    text = "a bc é1x_ 22-3 xé don't  \nzz"
    rows = spark.createDataFrame([(text,)], "text string")
    for pattern in (r"\b\w+\b", r"\b\w{2,}\b", r"\b\w{3,}\b"):
        got = rows.select(sp.find_all(F.col("text"), pattern)).first()[0]
        assert got == re.findall(pattern, text, flags=re.ASCII)


def test_corpus_frequencies_do_not_build_passages_twice(spark):
    from threadloom.operators import retrieval as rt

    docs = spark.createDataFrame([(1, "first words of a passage here\n\nsecond words of the same"), (2, None)], "doc_id long, text string")
    scored = rt.bm25_passages(docs, "second passage", df="corpus")
    assert "regexp_extract_all" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.passage_no for r in scored.where("score > 0").collect()) == [0, 1]


def test_digest_embedding_reads_each_byte_once(spark):
    import hashlib

    from threadloom.operators import search as sr

    texts = ["a", "", "some text", "é😀"]
    rows = spark.createDataFrame([*[(t,) for t in texts], (None,)], "text string")
    for dimensions in (768, 384, 50, 7):
        column = sr.digest_embedding(F.col("text"), dimensions)
        # the digest is no part of the function of an element
        assert "sha2" not in column._jc.toString().split("sequence", 1)[1]
        got = {r.text: r.e for r in rows.select("text", column.alias("e")).collect()}
        assert got.pop(None) == [None] * dimensions
        for text, e in got.items():
            v = np.array([b / 255 * 2 - 1 for b in hashlib.sha256(text.encode()).digest()] * 24)[:dimensions]
            assert len(e) == dimensions and np.allclose(e, v / np.linalg.norm(v), atol=1e-12)
