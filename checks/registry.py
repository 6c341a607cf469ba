"""Registration of checked queries."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.views import VIEWS

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Base tables and shared views of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        for table in TABLES:
            if f"FROM {table}" in text:
                self.table(table).createOrReplaceTempView(table)
        return self.spark.sql(text)


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = (), recursive: bool = False):
    """Register ``fn(Inputs) -> DataFrame``; ``oracle`` may use the named views as CTEs."""

    def register(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if oracle is not None:
            head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views)
            text = oracle.strip()
            if head and text.upper().startswith("WITH "):
                text = f"WITH {'RECURSIVE ' if recursive else ''}{head}, {text[5:]}"
            elif head:
                text = f"WITH {head} {text}"
            ORACLES[name] = text
        return fn

    return register
