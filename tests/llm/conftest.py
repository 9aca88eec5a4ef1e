import pytest
from tests_llm_words import prose


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls everywhere, empty and long texts, repeated rows, ties, columns named like outputs and internals."""
    base = prose(1, 120)
    rows = [
        (1, base, "en", "a"), (1, base, "en", "a"), (2, base, "en", None), (3, base + " tail", "xx", "b"), (4, "", "en", "a"),
        (5, None, None, "b"), (None, prose(2, 80), "en", "a"), (None, None, None, None), (6, "one two", "de", "c"),
        (7, "é ñ😀 x  y\n\n z\t", "fr", "c"), (8, prose(3, 40_000), "en", "c"), (9, "x" * 300_000, "en", "b"), (10, " \n\t ", "en", "b"),
    ]
    extra = "ids array<int>, size string, kept string, n int, key string, measure int, score string, spans string, base int, target string, copies int, decoded int, x int, version int"
    schema = "doc_id long, text string, lang string, source string, " + extra
    return spark.createDataFrame([(*r, *[None] * 14) for r in rows], schema)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")


@pytest.fixture(scope="session")
def sample(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sample):
    return spark.read.parquet(f"{sample}/documents.parquet").collect()
