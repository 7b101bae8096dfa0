"""Named queries over the test tables, each with the SQL that states its result independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import KEYS, load, with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables and views of one folder, read on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)

    def dealt(self, name: str, table: str, *keys: str) -> DataFrame:
        """``name`` with the rows of ``table`` dealt over all tasks first, for work that costs much per row; by ``keys``, if they are named."""
        return load(self.spark, self.sf_dir, name, {table: list(keys) or KEYS[table]})


def query(name: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame`` under ``name``; ``sql`` may use the views by name."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return register
