"""Byte-level BPE and token files against the libraries' own results."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadloom.llm import byte_bpe, queries, token_files

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    lines = open(queries.RANK_FILE, "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.vocabulary_from_ranks(queries.RANK_FILE, PATTERN)


def encoded(vocabulary, texts):
    return [ids.tolist() for ids in byte_bpe.id_rows(byte_bpe.encoder(vocabulary, PATTERN).encode(pa.array(texts, pa.string())))]


def test_blanks_marks_and_scripts(library, vocabulary):
    texts = [
        "  a b", "a  b", " a\n b", "a \n  b \n", "\t x", "don't  we'll 's", "a b  ", "   ", " ", "", "x　y z", "a\x1c b", "a\x85 b c", "don't we'll it's",
        "Ünïcödé wörds, naïve. café!", "数字 123 ４５ ٣", "😀 😀😀 a😀", "<|endoftext|> x", "a.b c,d e!? (f)", "1,000 2.5 $3",
    ]
    assert encoded(vocabulary, texts) == [library.encode_ordinary(t) for t in texts]


def test_every_character_between_words(library, vocabulary):
    points = [*range(0x3000), *range(0x3000, 0xD800, 41), *range(0xE000, 0x110000, 997)]
    texts = [f"x{chr(p)}y {chr(p)} 1" for p in points]
    assert encoded(vocabulary, texts) == [library.encode_ordinary(t) for t in texts]


def test_words_are_forgotten_without_a_trace(library, vocabulary, documents):
    own = byte_bpe.Encoder(vocabulary, PATTERN, remembered=50)
    texts = [r.text for r in documents[:40]]
    assert [x.tolist() for x in byte_bpe.id_rows(own.encode(pa.array(texts)))] == [library.encode_ordinary(t) for t in texts]


def test_query_op7(spark, sample, documents, library):
    want = set()
    for r in documents:
        ids = library.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert set(map(tuple, queries.op7_byte_bpe(spark, sample).collect())) == want


def test_query_op1(spark, sample, documents):
    library = Tokenizer.from_file(queries.VOCABULARY_FILE)
    want, start = set(), 0
    for r in sorted(documents, key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.add((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert set(map(tuple, queries.op1_token_files(spark, sample).collect())) == want


def test_added_tokens_of_the_file(spark):
    library = Tokenizer.from_file(queries.VOCABULARY_FILE)
    own = byte_bpe.vocabulary_from_file(queries.VOCABULARY_FILE)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  y<|endoftext|><|endoftext|>\n z.", "<|endoftext| > plain", "no token here", None, "", "é <|endoftext|>"]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    assert encoded(own, texts) == want
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = byte_bpe.decode(byte_bpe.encode(df, own, PATTERN), own, PATTERN).collect()
    assert [bytes(r.decoded).decode() for r in sorted(rows, key=lambda r: r.id)] == [t or "" for t in texts]


def test_offsets_cover_split_characters(spark, vocabulary, library):
    text = "naïve 😀 日本ሴx"
    row = byte_bpe.encode(spark.createDataFrame([(text,)], "text string"), vocabulary, PATTERN, offsets="at").first()
    raw, at = text.encode(), 0
    for i, o in zip(row["ids"], row["at"]):
        piece = library.decode_single_token_bytes(i)
        assert raw[o.byte_start : o.byte_end] == piece and o.byte_start == at
        at = o.byte_end
        assert len(raw[: o.byte_start].decode(errors="ignore")) == o.start
        assert o.end == len(raw[: o.byte_end].decode(errors="ignore")) + ((raw[o.byte_end : o.byte_end + 1] or b"a")[0] & 0xC0 == 0x80)
        assert o.split == (b"\x80" <= piece[:1] < b"\xc0" or (at < len(raw) and raw[at] & 0xC0 == 0x80))
    assert any(o.split for o in row["at"]) and at == len(raw)


def test_odd_rows(odd_documents, no_documents, vocabulary):
    out = byte_bpe.decode(byte_bpe.encode(odd_documents, vocabulary, PATTERN), vocabulary, PATTERN)
    assert sorted(out.columns) == sorted(odd_documents.columns)  # clashing names are replaced
    for r in out.collect():
        assert bytes(r.decoded) == (r.text or "").encode() and (r.ids == []) == (not r.text)
    assert byte_bpe.encode(no_documents, vocabulary, PATTERN, offsets="at").count() == 0


def test_token_files_of_odd_rows(spark, tmp_path, odd_documents, no_documents):
    vocabulary = byte_bpe.vocabulary_from_file(queries.VOCABULARY_FILE)
    path = str(tmp_path / "tokens")
    token_files.write(odd_documents, path, vocabulary, PATTERN)
    rows = token_files.with_starts(token_files.read(spark, path)).orderBy("position").collect()
    assert [r.doc_id for r in rows] == sorted([r.doc_id for r in odd_documents.collect()], key=lambda i: (i is not None, i))
    start = 0
    for r in rows:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids[-1] == 0
        start += r.n_tokens
    empty = str(tmp_path / "none")
    token_files.write(no_documents, empty, vocabulary, PATTERN)
    assert token_files.with_starts(token_files.read(spark, empty)).count() == 0


def test_token_files_prune_by_id(spark, tmp_path, sample):
    path = str(tmp_path / "tokens")
    vocabulary = byte_bpe.vocabulary_from_file(queries.VOCABULARY_FILE)
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    token_files.write(docs, path, vocabulary, PATTERN)
    one = token_files.read(spark, path, [17])
    assert [r.doc_id for r in one.collect()] == [17]
    assert "PushedFilters: [EqualTo(doc_id,17)]" in one._jdf.queryExecution().toString() or "In(doc_id" in one._jdf.queryExecution().toString() or "EqualTo(doc_id,17)" in one._jdf.queryExecution().toString()
    import pyarrow.orc as orc
    from pathlib import Path

    file = orc.ORCFile(next(str(p) for p in Path(path).glob("*.orc")))
    assert file.compression == "ZSTD" and file.nstripes >= 1
    assert token_files.read(spark, path).agg(F.sum("n_tokens")).first()[0] == docs.count() + sum(len(x.ids) - 1 for x in token_files.read(spark, path).collect())


def test_round_trip_in_one_column(spark, odd_documents):
    vocabulary = byte_bpe.vocabulary_from_ranks(queries.RANK_FILE, queries.PATTERN)
    rows = odd_documents.select("doc_id", "text")
    plain = byte_bpe.decode(byte_bpe.encode(rows, vocabulary, queries.PATTERN), vocabulary, queries.PATTERN)
    once = rows.withColumn("c", byte_bpe.round_trip_column("text", vocabulary, queries.PATTERN)).select("doc_id", "text", "c.ids", "c.decoded")
    assert sorted(map(str, once.collect())) == sorted(map(str, plain.collect()))
    assert once.where("false").collect() == []
