"""User functions: scalar ones in Arrow batches, aggregates by seed, step and result."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def create_function(spark: SparkSession, name: str, f: Callable[..., Any], returns: str, deterministic: bool = True, variadic: int | None = None):
    """A scalar function of any number of arguments for SQL and columns; nulls come as None."""

    @pandas_udf(returns)
    def run(*columns: pd.Series) -> pd.Series:
        rows = zip(*(c.astype(object).where(c.notna(), None) for c in columns), strict=True)
        return pd.Series([f(*r) for r in rows], dtype=object)

    made = run if deterministic else run.asNondeterministic()
    spark.udf.register(name, made)
    return made


def aggregate(df: DataFrame, by: list[str], value: Column, seed: Any, step: Callable[[Any, Any], Any], merge: Callable[[Any, Any], Any], result: Callable[[Any], Any], name: str, returns: str, buckets: int = 64) -> DataFrame:
    """An aggregate by seed, step and result. States of salted parts of a group are merged, so that no task holds a group's rows."""
    import pickle

    rows = df.select(*by, value.alias("__v"), F.pmod(F.spark_partition_id(), F.lit(buckets)).alias("__part"))

    @pandas_udf("binary")
    def part(v: pd.Series) -> bytes:
        state = seed
        for x in v.astype(object).where(v.notna(), None):
            state = step(state, x)
        return pickle.dumps(state)

    @pandas_udf(returns)
    def whole(states: pd.Series) -> Any:
        parts = [pickle.loads(s) for s in states]
        state = parts[0]
        for other in parts[1:]:
            state = merge(state, other)
        return result(state)

    return rows.groupBy(*by, "__part").agg(part("__v").alias("__s")).groupBy(*by).agg(whole("__s").alias(name))


def collation_key(f: Callable[[str], str]):
    """A sort key that stands for a user collation: order and group by it."""

    @pandas_udf("string")
    def key(v: pd.Series) -> pd.Series:
        return v.map(f, na_action="ignore")

    return key
