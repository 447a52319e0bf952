"""Register of queries and their reference SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Tables, with_views

Build = Callable[[Tables], DataFrame]
QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}
TEXTS_OF: dict[str, str] = {}  # the reference SQL before its views are written out


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = build
        if sql is not None:
            TEXTS_OF[name] = sql
            ORACLES[name] = with_views(sql)
        return build

    return add


def runnable(build: Build) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: build(Tables(spark, folder))
