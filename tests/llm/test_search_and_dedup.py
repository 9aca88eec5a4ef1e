"""Near-duplicates, repeats, exact search, toxicity and the pipeline against brute force."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests_llm_words import prose
from threadloom.llm import components, fertility, lsh_forest, mixing, pivot_index, private_data, queries, string_kernel, suffix_dedup

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


# ---------------------------------------------------------------- near-duplicates
def shingles(text, width):
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1)))


def plain_components(rows, width, percent):
    """{row number: (set size, least id of the component)} by comparing all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x]}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                up[max(root(i), root(j))] = min(root(i), root(j))
        for x in s:
            holders[x].append(i)
    ids = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[root(i)].append(doc_id)
    least = lambda xs: min((x for x in xs if x is not None), default=None)
    return [(len(s), least(ids[root(i)]) if s else rows[i][0]) for i, s in enumerate(sets)]


def test_query_op4(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = {i: (n, c) for (i, _), (n, c) in zip(rows, plain_components(rows, 3, 85))}
    got = queries.op4_lsh_forest(spark, folder).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


@pytest.fixture(scope="module")
def near_copies():
    """A large group of near copies around one text, small groups, and loners."""
    r = random.Random(5)
    base, rows = prose(100, 150).split(), []
    for i in range(260):
        words = list(base)
        for _ in range(r.randint(0, 9)):
            words[r.randrange(len(words))] = f"new{r.randint(0, 10**6)}"
        rows.append(" ".join(words))
    for k in range(30):
        rows += [prose(200 + k, 60), prose(200 + k, 60) + " more words"]
    rows += [prose(500 + k, 40) for k in range(60)]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("limits", [(1_500, 1_500_000), (40, 4_000)])
def test_large_groups_lose_no_link(spark, near_copies, monkeypatch, limits):
    monkeypatch.setattr(lsh_forest, "BLOCK_DOCUMENTS", limits[0])
    monkeypatch.setattr(lsh_forest, "BLOCK_SHINGLES", limits[1])
    df = spark.createDataFrame(near_copies, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in lsh_forest.group(df, 3, 85).collect()}
    assert got == {i: want for (i, _), want in zip(near_copies, plain_components(near_copies, 3, 85))}


@pytest.fixture(scope="module")
def hot_region():
    """Documents that all share one long passage; every one has a near copy."""
    r, shared, rows = random.Random(11), prose(900, 120), []
    for k in range(400):
        words = (shared + " " + " ".join(f"own{k}x{i}" for i in range(50))).split()
        copy = list(words)
        copy[r.randrange(120, len(words))] = f"new{k}"
        rows += [" ".join(words), " ".join(copy)]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("tile", [3_000, 50])
def test_hot_regions_lose_no_link(spark, hot_region, monkeypatch, tile):
    monkeypatch.setattr(lsh_forest, "TILE_CLASSES", tile)
    df = spark.createDataFrame(hot_region, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in lsh_forest.group(df, 3, 85).collect()}
    assert got == {i: want for (i, _), want in zip(hot_region, plain_components(hot_region, 3, 85))}


@pytest.mark.parametrize("share", [0.6, 0.78])
def test_every_candidate_of_a_crowded_run_is_compared(spark, share):
    """Signatures of one region, each with one partner: all alike that share the least depth in a tree end in one group."""
    rng = np.random.default_rng(3)
    common, n, size = rng.integers(0, 256, 96, dtype=np.uint8), 1_000, lsh_forest.TREES * lsh_forest.TREE_BYTES
    mine, other = (np.where(rng.random((n, size)) < share, common, rng.integers(0, 256, (n, size), dtype=np.uint8)) for _ in range(2))
    sigs = np.concatenate([mine, np.where(rng.random((n, size)) < 0.85, mine, other)])
    rows = [(b"%06d" % i, s.tobytes()) for i, s in enumerate(sigs)]
    groups = {int(r.node): int(r.root) for r in lsh_forest.loose_groups(spark.createDataFrame(rows, "key binary, sig binary"), 0.8).collect()}
    runs = sigs.reshape(2 * n, lsh_forest.TREES, -1)[:, :, : lsh_forest.LEAST_DEPTH]
    for i in range(2 * n):
        alike = ((sigs == sigs[i]).sum(axis=1) >= 0.6 * size) & (runs == runs[i]).all(axis=2).any(axis=1)
        assert {groups.get(int(j), int(j)) for j in np.flatnonzero(alike)} == {groups.get(i, i)}


def test_links_inside_keeps_outsiders():
    sets = [np.unique(np.random.default_rng(i % 7).integers(0, 2**60, 40, dtype=np.uint64)) for i in range(200)]
    links = lsh_forest._links_inside(sets, 85)
    assert len(links) == 193 and {i % 7 == j % 7 for i, j in links} == {True}


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1300), 1000)}


def test_groups_of_odd_rows(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    got = lsh_forest.group(odd_documents, 5, 80).collect()
    key = lambda i: (i is not None, i)
    want = sorted(((i, n, c) for (i, _), (n, c) in zip(rows, plain_components(rows, 5, 80))), key=lambda x: (key(x[0]), x[1]))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=lambda x: (key(x[0]), x[1])) == want
    kept = lsh_forest.deduplicated(odd_documents).collect()
    assert collections.Counter(r.doc_id for r in kept) == collections.Counter([1, 4, 5, None, None, 6, 7, 8, 9, 10])
    assert lsh_forest.group(no_documents).count() == 0 and lsh_forest.deduplicated(no_documents).count() == 0


# ---------------------------------------------------------------- repeated strings
def plain_removal(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(hashlib.md5(b[i : i + length]).digest() for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        edge = [0] * (len(b) + 1)
        for i in range(len(b) - length + 1):
            if count[hashlib.md5(b[i : i + length]).digest()] > 1:
                edge[i] += 1
                edge[i + length] -= 1
        gone = np.cumsum(edge[:-1]) > 0 if b else np.zeros(0, bool)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def test_query_op10(spark, sample, documents):
    want = {r.doc_id: w for r, w in zip(documents, plain_removal([r.text for r in documents], 200))}
    for r in queries.op10_suffix_dedup(spark, sample).collect():
        n, removed, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest()), r.doc_id


@pytest.mark.parametrize("length", [30, 64, 200])
def test_repeats_at_edges(spark, length, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PIECE", 700)  # long texts are cut and put together again
    r = random.Random(length)
    alphabet = "abé "
    noise = lambda n: "".join(r.choice(alphabet + "cdefghij") for _ in range(n))
    shared = [noise(length + d) for d in (-1, 0, 1, 40, 500)]
    texts = [noise(90) + s + noise(r.randint(0, 300)) for s in shared for _ in range(3)] + shared[:3]
    texts += ["ab" * 300, "xy" * 200 + noise(50), noise(900) * 2, shared[4][5:-7], noise(length - 1), "", None, noise(4000)]
    texts += [t[: len(t) // 2] + "!" + t[len(t) // 2 :] for t in texts[9:12]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_removal(texts, length)
    for row in suffix_dedup.remove_repeats(df, length).collect():
        assert (row.n_bytes, row.n_removed, row.n_spans, bytes(row.kept)) == want[row.doc_id], row.doc_id


@pytest.mark.parametrize("length", [30, 64, 200])
def test_runs_of_cut_texts_are_whole(length, monkeypatch):
    r = random.Random(length)
    texts = ["".join(r.choice("abé cdefghij") for _ in range(9_000)), "ab" * 2_000, "x" * 3_000]
    runs = lambda text: [tuple(x) for part in suffix_dedup._runs(pa.array([text]), length) for x in zip(*(c.tolist() for c in part))]
    whole = [runs(t) for t in texts]
    for piece in (257, 700, 701, 2_999):
        monkeypatch.setattr(suffix_dedup, "_PIECE", piece)
        assert [runs(t) for t in texts] == whole, piece


def test_text_longer_than_a_piece(spark):
    piece = suffix_dedup._PIECE
    raw = bytearray(random.Random(5).randbytes(2 * piece + 150_000).hex()[: 2 * piece + 150_000].encode())
    text = bytes(raw)  # nothing repeats
    shared = raw[piece - 250 : piece + 50]
    raw[70_000:70_302] = b"<" + shared + b">"
    df = spark.createDataFrame([(1, text.decode()), (2, raw.decode())], "doc_id long, text string")
    alone = df.where("doc_id = 1").coalesce(1)
    assert [(x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix_dedup.remove_repeats(alone).collect()] == [(0, 0, text)]
    (got,) = suffix_dedup.remove_repeats(df.where("doc_id = 2").coalesce(1)).collect()
    kept = raw[:70_001] + raw[70_301 : piece - 250] + raw[piece + 50 :]
    assert (got.n_removed, got.n_spans, bytes(got.kept)) == (600, 2, bytes(kept))


def test_repeats_of_odd_rows(odd_documents, no_documents):
    rows = odd_documents.collect()
    got = suffix_dedup.remove_repeats(odd_documents).collect()
    want = sorted(plain_removal([r.text for r in rows], 200))
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert suffix_dedup.remove_repeats(no_documents).count() == 0


# ---------------------------------------------------------------- exact search
def plain_search(rows, is_query, k):
    out = set()
    for i, v in rows:
        if is_query(i):
            scored = sorted((-sum(a * b for a, b in zip(v, u)), j) for j, u in rows if j != i and len(u) == len(v))
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])}
    return out


def test_query_op2(spark, sample):
    rows = spark.read.parquet(f"{sample}/embeddings.parquet").collect()
    whole = [(r.vec_id, [int(np.floor(256 * float(x))) for x in r.embedding]) for r in rows]
    assert set(map(tuple, queries.op2_pivot_index(spark, sample).collect())) == plain_search(whole, lambda i: i % 50 == 0, 5)


def test_search_with_copies_ties_and_bad_rows(spark):
    r = random.Random(3)
    vectors = [[r.randint(-3, 3) for _ in range(4)] for _ in range(300)] + [[1, 2, 3, 0]] * 200 + [[0, 0, 0, 0]] * 5 + [[5, 1]] * 3
    rows = list(enumerate(vectors))
    bad = [(900, None), (901, [1.0, None, 2.0, 0.0]), (902, [float("nan"), 0.0, 0.0, 0.0]), (903, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 2.0, 3.0, 4.0]), (904, [])]
    table = [(i, None if v is None else [None if x is None else x / 256 for x in v], 7) for i, v in rows + rows[:20]] + [(i, v, 7) for i, v in bad]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, rank int")
    df = df.select("vec_id", pivot_index.floor_scaled(F.col("embedding")).alias("vector"), "rank")
    got = pivot_index.search(df, F.col("vec_id") % 7 == 0, k=5, pivots=5, rings=3, block=16, chunk=8, first=1).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == plain_search(rows, lambda i: i % 7 == 0, 5)
    assert pivot_index.search(df.where("false"), F.col("vec_id") % 7 == 0).count() == 0
    assert pivot_index.search(df.where("vec_id = 0"), F.col("vec_id") % 7 == 0).count() == 0  # no other row


def test_bounds_never_cut_off(spark):
    g = np.random.default_rng(1)
    v = np.floor(g.normal(size=(500, 8)) * 40)
    metric = pivot_index._Metric(v[:6], float((v**2).sum(axis=1).max()))
    d = metric.stored(v)
    near = d.argmin(axis=1)
    import pandas as pd

    annuli = pd.DataFrame({"pivot": range(6), "a": [d[near == p, p].min() for p in range(6)], "b": [d[near == p, p].max() for p in range(6)]})
    bound = pivot_index._bounds(metric, annuli, v)
    scores = v @ v.T
    for p in range(6):
        assert (scores[:, near == p].max(axis=1) <= bound[:, p] + 1e-6).all()


# ---------------------------------------------------------------- toxicity
def test_kernel_is_the_plain_one():
    import itertools

    def plain(a, b):
        def weights(w):
            out, marked = collections.Counter(), f"^{w}$"
            for at in itertools.combinations(range(len(marked)), string_kernel.LENGTH):
                span = at[-1] - at[0] + 1
                if span <= string_kernel.SPAN:
                    out["".join(marked[i] for i in at)] += string_kernel.DECAY**span
            return out

        x, y = weights(a), weights(b)
        dot = lambda p, q: sum(p[k] * q[k] for k in p)
        return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5

    words = ["amber", "ambler", "ember", "stone", "stones", "banana"]
    got = string_kernel.kernel(words, words)
    assert np.allclose(got, [[plain(a, b) for b in words] for a in words], atol=1e-5)
    assert got[0, 1] > 0.3 > got[0, 3]


@pytest.fixture(scope="module")
def insults(spark):
    r = random.Random(8)
    bad = ["grobnok", "snivlard", "wretchel", "muckfin", "blathered"]
    rows, labels = [], []
    for i in range(1200):
        words, toxic = prose(1000 + i, 40).split(), i % 8 == 0
        if toxic:
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string").cache(), spark.createDataFrame(labels, "doc_id long, toxic int").cache()


def test_insults_with_gaps(spark, insults):
    docs, labels = insults
    model = string_kernel.fit(docs, labels)
    scored = {r.doc_id: r for r in string_kernel.score(docs, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    out = [r.doc_id for r in docs.where(string_kernel.held_out(F.col("doc_id"))).collect()]
    assert 150 < len(out) < 350 and all(scored[i].predicted == truth[i] for i in out)
    hidden = ["you g-r-o-b-n-o-k there", "such a gro.bnok", "SNIVLARD!", "a snivxlard", "m u c k f i n here", "wretche1"]
    clean = ["amber stone birch", "", None, "the maple ridge", "x" * 5000]
    df = spark.createDataFrame(list(enumerate(hidden + clean)), "doc_id long, text string")
    got = {r.doc_id: r for r in string_kernel.score(df, model).collect()}
    assert [got[i].predicted for i in range(len(hidden))] == [1] * len(hidden)
    assert [got[i + len(hidden)].predicted for i in range(len(clean))] == [0] * len(clean)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_query_op9_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [(r.predicted, truth[r.doc_id]) for r in queries.op9_string_kernel(spark, folder).collect() if r.held_out and r.doc_id in truth]
    hit = sum(p and t for p, t in rows)
    assert sum(p == t for p, t in rows) / len(rows) > 0.95
    assert hit / sum(t for _, t in rows) > 0.8 and hit / sum(p for p, _ in rows) > 0.8


def test_toxicity_of_odd_rows(spark, odd_documents, no_documents, insults):
    model = string_kernel.fit(*insults)
    assert string_kernel.score(odd_documents, model).count() == odd_documents.count()
    assert string_kernel.score(no_documents, model).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    assert string_kernel.fit(odd_documents, labels) is None and string_kernel.fit(no_documents, labels.where("false")) is None
    assert {r.score for r in string_kernel.score(odd_documents, None).collect()} == {0.0}


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet").cache()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "source_mix", "tokens"]
    good = corpus_pipeline.quality_rules(spark, docs, sample).cache()
    kept = {r.doc_id for r in fertility.rate(docs, queries.PIECE_MODEL.read_bytes()).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept and good.columns == docs.columns
    alone = corpus_pipeline.near_duplicates(spark, good, sample).cache()
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in alone.collect()} == {i for (i, _), (_, c) in zip(rows, plain_components(rows, 5, 80)) if i == c}
    safe = corpus_pipeline.personal_data(spark, alone, sample).cache()
    before = {r.doc_id: r for r in private_data.find(alone, private_data.fit(alone)).collect()}
    for r in safe.collect():
        text, at, out = before[r.doc_id].text, 0, []
        for s in before[r.doc_id].spans:
            if s.start >= at:
                out += [text[at : s.start], f"[{private_data.KINDS[s.kind].upper()}]"]
            at = max(at, s.end)
        assert r.text == "".join([*out, text[at:]]) and r.n_chars == len(r.text)
    mixed = corpus_pipeline.source_mix(spark, safe, sample).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(safe).collect() if r.copies}
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter(copies) and mixed.columns == docs.columns
    coded = corpus_pipeline.tokens(spark, mixed, sample).collect()
    assert len(coded) == mixed.count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in coded)


def test_pipeline_of_odd_rows(spark, odd_documents, no_documents, sample):
    for table in (odd_documents, no_documents):
        docs = table.withColumn("n_chars", F.length("text").cast("long"))
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sample)
        assert docs.count() <= 2 * table.count()


def test_run(spark, sample):
    out = corpus_pipeline.run(spark, sample)
    assert out.count() > 100 and out.where("not round_trip").count() == 0
