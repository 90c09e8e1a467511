"""Named queries and, where plain SQL can say the same, the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fixtures as fx
from .oracle_views import ORACLE_VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Data:
    """Views and tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in fx.VIEWS:
            return fx.view(self.spark, self.sf_dir, name)
        if name in fx.TABLES:
            return fx.table(self.spark, self.sf_dir, name)
        raise AttributeError(name)


def query(name: str, sql: str | None = None):
    """Register ``fn(data) -> DataFrame`` and its check."""
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Data(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = fx.with_views(sql, fx.DuckText, ORACLE_VIEWS)
        return fn
    return deco
