"""The registered queries and their DuckDB twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """The tables of a directory as DataFrames: t.orders reads orders.parquet."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Spark SQL over {name} references to tables, or to the frames given."""
        names = set(re.findall(r"\{(\w+)\}", text)) - set(frames)
        return self.spark.sql(text, **{n: getattr(self, n) for n in names}, **frames)

    def dialect(self, text: str) -> DataFrame:
        """A statement of the dialect over the directory's tables."""
        from quern.operators.catalog import Database

        db = Database(self.spark)
        for name in TABLES:
            if re.search(rf"\b{name}\b", text):
                db.create(name, getattr(self, name))
        return db.sql(text)


def query(name: str, oracle: str | None = None):
    """Registers a function of Tables under a name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLES


def _load() -> None:
    from quern.plans import aggregates, answers, database, expressions, joins, mutations, relations, sets, warehouse, windows  # noqa: F401
