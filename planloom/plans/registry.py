"""Named queries: a Spark callable and, where SQL can express it over whole tables, the oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from planloom.plans import bind

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


class Tables:
    """Lazy access to the driver tables and domain views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in bind.VIEWS:
            return bind.view(self.spark, self.sf_dir, name)
        return bind.table(self.spark, self.sf_dir, name)


def query(name: str, covers: str, sql: str | None = None):
    """Registers ``fn(tables) -> DataFrame``; ``covers`` lists the inventory ids it answers."""

    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        COVERS[name] = covers
        return fn

    return wrap
