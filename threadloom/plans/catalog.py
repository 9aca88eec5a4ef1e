"""Registry of named queries: the Spark form, the operators it covers and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from threadloom.functions.sizing import spread
from threadloom.session import read_table

# tables whose rows are expensive to process, with their row key
_TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


@dataclass(frozen=True)
class Query:
    name: str
    ops: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


class Tables:
    """Lazy access to the tables of one folder: ``t.documents``, ``t.events`` ..."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        table = read_table(self.spark, self.folder, name)
        return spread(table, _TEXT_TABLES[name]) if name in _TEXT_TABLES else table


def query(name: str, ops: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, ops, lambda spark, folder: fn(Tables(spark, folder)), sql)
        return fn

    return register
