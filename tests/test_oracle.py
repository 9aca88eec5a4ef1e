"""Every registered query against its SQL twin on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "scripts"))

import __spark_entry__ as entry
from check_oracle import TABLES, compare

FOLDER = "/root/testdata/sf0.001"

# Queries that SQL cannot express, with the test that holds their content.
HELD_ELSEWHERE = {
    "hierarchical_summary": "test_operators.py", "tool_stats_sketched": "test_without_sql.py", "nb_classifier": "test_without_sql.py",
    "topic_clusters": "test_without_sql.py", "entities_resolved": "test_without_sql.py", "soundex_names": "test_without_sql.py",
    "boundary_chunks": "test_operators.py",
    "op1_token_files": "llm/test_tokens.py", "op7_byte_bpe": "llm/test_tokens.py", "op2_pivot_index": "llm/test_search_and_dedup.py",
    "op3_shard_tree": "llm/test_measures.py", "op5_fertility": "llm/test_measures.py", "op6_pareto_mix": "llm/test_measures.py",
    "op8_private_data": "llm/test_measures.py", "op4_lsh_forest": "llm/test_search_and_dedup.py", "op9_string_kernel": "llm/test_search_and_dedup.py",
    "op10_suffix_dedup": "llm/test_search_and_dedup.py", "pipeline": "llm/test_search_and_dedup.py",
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query(spark, con, name):
    status, _rows, _s, _q, note = compare(spark, FOLDER, name, con)
    assert status == "ok", note


def test_queries_without_sql_are_held_elsewhere():
    assert set(entry.queries()) - set(entry.oracle_sql()) <= set(HELD_ELSEWHERE)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
