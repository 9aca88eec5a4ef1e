"""Content of the queries that SQL cannot express, against plain forms over the same tables."""

import collections
import math
import re

import numpy as np

import __spark_entry__ as entry
from threadloom import lexicons as lx

FOLDER = "/root/testdata/sf0.001"


def rows(spark, table):
    return spark.read.parquet(f"{FOLDER}/{table}.parquet").collect()


def soundex(word):
    digit = {c: str(d) for d, cs in enumerate(["bfpv", "cgjkqsxz", "dt", "l", "mn", "r"], 1) for c in cs}
    out, last = word[0].upper(), digit.get(word[0], "0")
    for c in word[1:]:
        if c in "hw":
            continue
        d = digit.get(c, "0")
        if d != "0" and d != last:
            out += d
        last = d
    return (out + "000")[:4]


def test_soundex_names(spark):
    n, distinct = collections.Counter(), collections.defaultdict(set)
    for r in rows(spark, "documents"):
        for w in set(re.findall(r"\b[a-z]{4,}\b", r.text.lower(), re.ASCII)):
            n[soundex(w)] += 1
            distinct[soundex(w)].add(w)
    got = {r.code: (r.n, r.n_words) for r in entry.queries()["soundex_names"](spark, FOLDER).collect()}
    assert got == {c: (n[c], len(distinct[c])) for c in n}


def test_entities_resolved(spark):
    """Spans follow each other; a later overlapping one only replaces the last with more confidence."""
    text = {r.doc_id: r.text for r in rows(spark, "documents")}
    last = collections.defaultdict(int)
    found = entry.queries()["entities_resolved"](spark, FOLDER).collect()
    assert found
    for r in sorted(found, key=lambda r: (r.doc_id, r.start)):
        assert r.start >= last[r.doc_id] and text[r.doc_id][r.start : r.end] == r.text
        assert r.type in {k for k, _ in lx.ENTITY_PATTERNS}
        last[r.doc_id] = r.end


def test_sketched_percentiles_lie_within_the_error(spark):
    from threadloom.plans.catalog import Tables
    from threadloom.plans.usage import calls

    durations = collections.defaultdict(list)
    for r in calls(Tables(spark, FOLDER)).select("tool", "duration").collect():
        durations[r.tool].append(r.duration)
    found = entry.queries()["tool_stats_sketched"](spark, FOLDER).collect()
    assert {r.tool for r in found} == set(durations)
    for r in found:
        own = sorted(durations[r.tool])
        assert r.calls == len(own)
        for share, value in zip((0.5, 0.95, 0.99), list(r.asDict().values())[2:5]):
            rank, slack = share * len(own), 1 + len(own) / 10_000
            low, high = own[max(0, math.floor(rank - slack) - 1)], own[min(len(own) - 1, math.ceil(rank + slack))]
            assert low <= value <= high


def test_naive_bayes_is_the_plain_one(spark):
    """Smoothed multinomial Bayes over the same hashed features gives the same class nearly everywhere."""
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r.quality for r in rows(spark, "labels")}
    words = RegexTokenizer(inputCol="text", outputCol="w", pattern=r"\W+").transform(docs)
    tf = HashingTF(inputCol="w", outputCol="tf", numFeatures=1 << 14).transform(words)
    labelled = tf.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id")
    idf = IDF(inputCol="tf", outputCol="x").fit(labelled)
    x = {r.doc_id: r.x.toArray() for r in idf.transform(tf).select("doc_id", "x").collect()}
    classes = sorted(set(labels.values()))
    prior, theta = [], []
    for c in classes:
        own = [x[i] for i, q in labels.items() if q == c and i in x]
        total = np.sum(own, axis=0) + 1.0
        prior.append(math.log((len(own) + 1.0) / (len(labels) + len(classes))))
        theta.append(np.log(total / total.sum()))
    want = {i: classes[int(np.argmax([p + t @ v for p, t in zip(prior, theta)]))] for i, v in x.items()}
    got = {r.doc_id: r.prediction for r in entry.queries()["nb_classifier"](spark, FOLDER).collect()}
    assert got.keys() == want.keys() and sum(got[i] == want[i] for i in got) >= 0.98 * len(got)


def test_topic_clusters(spark):
    found = entry.queries()["topic_clusters"](spark, FOLDER).collect()
    assert 1 <= len(found) <= 9 and len({r.cluster for r in found}) == len(found)
    texts = " ".join(r.text.lower() for r in rows(spark, "documents"))
    for r in found:
        words = r.label.split("_")
        assert 1 <= len(words) <= 3 and all(re.search(rf"\b{w}\b", texts) for w in words) and r.topic in ("ENGL", "ROMAN", "GENRL")
