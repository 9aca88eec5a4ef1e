"""Fertility rules, sharding, mixing and personal data against plain forms."""

import collections
import hashlib
import math
import re
import struct
import zlib

import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from threadloom.llm import fertility, mixing, private_data, queries, shard_tree

SPACE = re.compile(r"[\x20\x09-\x0D]+")


# ---------------------------------------------------------------- fertility
def plain_measures(text, model):
    words = [w for w in SPACE.split(text or "") if w]
    lines = [x for x in (text or "").split("\n") if SPACE.sub("", x)]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    ids = [i for w in words for i in model.encode(w)]
    counts = collections.Counter(ids)
    entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in counts.values()) if ids else 0.0
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), len(ids),
        sum(map(len, words)) / len(ids) if ids else 0.0, sum(model.is_byte(i) for i in ids) / len(ids) if ids else 0.0, entropy,
    )


def same(row, want):
    return tuple(row)[:6] == want[:6] and all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(tuple(row)[6:9], want[6:]))


def test_measures(spark, sample, odd_documents, no_documents):
    model = sentencepiece.SentencePieceProcessor(model_file=str(queries.PIECE_MODEL))
    docs = spark.read.parquet(f"{sample}/documents.parquet").select("doc_id", "text", "lang")
    for table in (docs, odd_documents):
        rated = fertility.rate(table, queries.PIECE_MODEL.read_bytes()).collect()
        assert len(rated) == table.count()
        for r in rated:
            want = plain_measures(r.text, model)
            assert same(r.measure, want), r.doc_id
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (r.kept and r.base_failed)
    assert fertility.rate(no_documents, queries.PIECE_MODEL.read_bytes()).count() == 0


def test_good_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.op5_fertility(spark, folder).collect() if not r.base_failed]
    assert all(r.kept for r in rows if labels.get(r.doc_id) == 1)
    junk = [r for r in rows if labels.get(r.doc_id) == 0]
    assert sum(not r.kept for r in junk) >= len(junk) * 0.2


def test_most_junk_goes(spark):
    folder = "/root/testdata/sf0.1"
    # the bands' centres were fitted to even ids; their widths were chosen with odd ids in view
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.doc_id % 2}
    rows = [r for r in queries.op5_fertility(spark, folder).collect() if not r.base_failed and r.doc_id in labels]
    junk, good = ([r.kept for r in rows if labels[r.doc_id] == q] for q in (0, 1))
    assert len(junk) > 100 and junk.count(False) >= len(junk) * 0.95
    assert good.count(False) <= len(good) * 0.005


def test_bands(spark):
    english = (
        "Long before the harbour was built, fishermen dragged their boats across the sand and slept beneath them while rain fell. A single lamp "
        "marked the inn, whose keeper sold bread, rope and candles. Travellers complained about the smoke, yet nobody left hungry, and children "
        "learned every song by listening at the door until their mothers called them home."
    )
    russian = (
        "Когда наступила осень, старик собрал яблоки в саду и отвёз их на рынок, где уже шумела толпа. Продавцы спорили о ценах, дети бегали "
        "между телегами, а над крышами медленно поднимался дым. К вечеру дорога опустела, и только собака ещё долго лаяла у закрытых ворот, "
        "пока не погас последний огонь в окне мельницы за тихой рекой под холмом."
    )
    noise = " ".join(chr(0x1400 + i % 500) * 3 for i in range(60))
    df = spark.createDataFrame([(1, english, None), (2, russian, "ru"), (3, noise, "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in fertility.rate(df, queries.PIECE_MODEL.read_bytes(), most_repeated=100).collect()}
    assert got[1].measure.script == "latin" and got[2].measure.script == "cyrillic"
    assert got[1].kept and got[2].kept and not got[3].kept
    assert got[3].measure.fallback_share > 0.5


# ---------------------------------------------------------------- sharding
def plain_shard(key, tree):
    mask = (1 << 64) - 1

    def draw(node, weight):
        seed = xxhash.xxh64_intdigest(struct.pack("<q", key), 42) if key is not None else 42
        h = xxhash.xxh64_intdigest(node.encode(), seed & mask)
        return -math.log(((h >> 11) + 0.5) / 2.0**53) / weight

    def least(children):
        return min((draw(n, w), n) for n, w in children.items())[1]

    level = lambda pairs: {n: sum(w for m, w in pairs if m == n) for n in {m for m, _ in pairs}}
    g = least(level([(f"g{s.region}", s.weight) for s in tree]))
    k = least(level([(f"k{s.rack}", s.weight) for s in tree if f"g{s.region}" == g]))
    return int(least({f"s{s.shard}": s.weight for s in tree if f"k{s.rack}" == k})[1:])


def test_query_op3(spark, sample, documents):
    rows = queries.op3_shard_tree(spark, sample).collect()
    texts = {r.doc_id: r.text for r in documents}
    tree = shard_tree.regular_tree(40)
    slots = collections.defaultdict(list)
    for r in rows:
        body = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(body) + 16, zlib.crc32(body), "key")
        assert r.shard == plain_shard(r.doc_id, tree)
        assert r.grown_shard == plain_shard(r.doc_id, shard_tree.with_region(tree, 40)) and r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert len(rows) == len(documents) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_movement_stays_in_changed_subtrees(spark):
    keys = spark.range(20_000)
    tree = shard_tree.regular_tree(16)
    heavier = [shard_tree.Shard(s.shard, s.region, s.rack, 2.0 if s.shard == 5 else 1.0) for s in tree]
    rows = keys.select(shard_tree.shard_of(F.col("id"), tree).alias("a"), shard_tree.shard_of(F.col("id"), heavier).alias("b")).collect()
    region, rack = {s.shard: s.region for s in tree}, {s.shard: s.rack for s in tree}
    moved = [r for r in rows if r.a != r.b]
    assert moved
    for r in moved:  # into the region, rack and shard whose weight rose, or on inside its region
        assert region[r.b] == region[5]
        if region[r.a] == region[5]:
            assert rack[r.b] == rack[5]
            assert r.b == 5 or rack[r.a] != rack[5]
    share = sum(r.b == 5 for r in rows) / len(rows)
    assert abs(share - 2 / 17) < 0.01
    empty = [shard_tree.Shard(s.shard, s.region, s.rack, 0.0 if s.rack == 1 else 1.0) for s in tree]
    assert keys.where(shard_tree.shard_of(F.col("id"), empty).isin([s.shard for s in tree if s.rack == 1])).count() == 0


def test_shards_of_odd_rows(odd_documents, no_documents):
    tree = shard_tree.regular_tree(3, 1, 2)
    rows = shard_tree.assign(odd_documents, tree, rows_per_group=3).collect()
    assert len(rows) == odd_documents.count() and len({r.shard for r in rows if r.doc_id is None}) == 1
    for shard in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))
    assert shard_tree.assign(no_documents, tree).count() == 0


# ---------------------------------------------------------------- mixing
def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: rest * w[s] / sum(w[o] for o in open_) for s in open_}
        over = {s for s in open_ if target[s] > cap * sizes[s] + 1e-9}
        if not over:
            return {s: target.get(s, cap * sizes[s]) for s in order}
        full |= over


def test_query_op6(spark, sample, documents):
    size = {r.doc_id: len([w for w in SPACE.split(r.text or "") if w]) for r in documents}
    source = {r.doc_id: r.source for r in documents}
    sizes = collections.Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    want, taken = plain_targets(sizes), collections.Counter()
    first = queries.op6_pareto_mix(spark, sample).collect()
    for r in first:
        s = source[r.doc_id]
        assert (r["size"], r.source_size) == (size[r.doc_id], sizes[s]) and math.isclose(r.target, want[s], rel_tol=1e-9)
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
    for s in want:
        assert abs(taken[s] - want[s]) <= max(size[i] for i in size if source[i] == s)
    assert sorted(map(tuple, first)) == sorted(map(tuple, queries.op6_pareto_mix(spark, sample).collect()))


@pytest.mark.parametrize("ranked", [2, 100_000])
def test_order_sampling_is_the_plain_one(spark, ranked):
    rows = [(i, "a" if i % 3 else "b", "w " * (1 + i * 7 % 50)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df, weights=[1.0, 3.0], share=0.8, buckets=4, rows_ranked=ranked).collect()
    for s in ("a", "b"):
        own = [r for r in got if r.source == s]
        target, total = own[0].target, own[0].source_size
        whole = int(target // total)
        assert abs(sum(r.copies * r["size"] for r in own) - target) <= max(r["size"] for r in own) / 2
        assert {r.copies for r in own} <= {whole, whole + 1}
    small = [r for r in got if r["size"] <= 15]
    large = [r for r in got if r["size"] >= 36]
    assert sum(r.copies for r in large) / len(large) > sum(r.copies for r in small) / len(small)  # odds grow with size


def test_mix_of_odd_rows(odd_documents, no_documents):
    rows = mixing.mix(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    twins = [r.copies for r in rows if r.doc_id == 1]
    assert twins[0] == twins[1]
    for r in rows:
        assert 0 <= r.copies <= 2 and r["size"] == len([w for w in SPACE.split(r.text or "") if w])
    assert mixing.mix(no_documents).count() == 0


# ---------------------------------------------------------------- personal data
PLAIN = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum((lambda v: v - 9 if v > 9 else v)(int(c) * (1 + i % 2)) for i, c in enumerate(reversed(digits))) % 10 == 0
            fits = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}
            if fits[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_query_op8(spark, documents):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries.op8_private_data(spark, folder).collect():
        want = plain_spans(texts[r.doc_id])
        name = ",".join(f"{PLAIN[k][0]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(name.encode()).hexdigest(), r.doc_id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert set(filter(None, name.split(","))) <= set(r.spans.split(","))
        for s in set(filter(None, r.spans.split(","))) - set(name.split(",")):
            kind, a, b = s.split(":")
            token = texts[r.doc_id][int(a) : int(b)]
            assert kind == "secret" and len(token) >= 8 and re.search("[0-9]", token)


def test_hard_spans(spark):
    texts = [
        "a@b.c.@d.e f@g.h.i", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 999999999999.1.1.1", "4111 1111 1111 1111 1 4111-1111-1111-1111",
        "+1 (555) 123-4567. +44 20 7946 0958-", "x@y..z@a.b", "5 -4111111111111111", "é😀 a@b.co 😀4111111111111111", "", None, "a+b%c@-.-",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in private_data.find(df, None).collect():
        assert [tuple(s) for s in r.base] == plain_spans(texts[r.doc_id])


def test_long_runs_keep_the_stack_flat(spark):
    texts = ["1 " * 20_000, "a@" + "b." * 30_000 + "c", "9" * 200_000, "+1" + "(" * 50_000, "x" * 200_000 + "@"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.base for r in private_data.find(df, None).collect()}
    assert [len(got[i]) for i in range(5)] == [0, 1, 0, 0, 0] and got[1][0].end == len(texts[1])


def test_learned_secrets(spark):
    keys = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(60)]
    rows = [f'here is token = "{k}" ok' for k in keys] + [f"order {10**15 + 7 * i} of room12345" for i in range(60)] + ["page item1234 of version 20240101"] * 10
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    model = private_data.fit(df)
    for r in private_data.find(df, model).withColumn("clean", private_data.redacted(F.col("text"), F.col("spans"))).collect():
        assert r.clean == ('here is token = "[SECRET]" ok' if r.doc_id < 60 else r.text)


def test_reliabilities_follow_the_better_labeler():
    counts = {(1, 1): 400, (-1, -1): 400, (1, 0): 50, (-1, 0): 50, (1, -1): 20, (-1, 1): 5}
    share = private_data.reliabilities(counts)
    assert share[(1, 1)] > 0.9 > 0.1 > share[(-1, -1)] and share[(1, 0)] > 0.5 > share[(-1, 0)]


def test_private_data_of_odd_rows(odd_documents, no_documents):
    rows = private_data.find(odd_documents, private_data.fit(odd_documents)).collect()
    assert len(rows) == odd_documents.count() and all(r.spans is not None for r in rows)
    assert private_data.fit(no_documents) is None and private_data.find(no_documents, None).count() == 0
