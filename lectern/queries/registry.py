"""The registry of queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.session import small_batches, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def all_cores(self, name: str) -> DataFrame:
        """A table for work that is heavy in processor time, which goes to Python in small batches."""
        return small_batches(spread(table(self.spark, self.sf_dir, name)))


def query(name: str, sql: str | None = None):
    """Registers a function of `Tables` as a query, with its SQL."""

    def add(make: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return make

    return add
