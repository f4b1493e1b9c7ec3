"""Window frames and functions beyond what Spark's OVER takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, partition: list[str], order: list[Column], name: str = "__group") -> DataFrame:
    """Adds the number of each row's peer group; a RANGE frame over it is a GROUPS frame."""
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))


def groups_between(partition: list[str], low: int, high: int, name: str = "__group"):
    return Window.partitionBy(*partition).orderBy(name).rangeBetween(low, high)


def excluding(frame: Column, excluded: Column) -> Column:
    """A sum over a frame without an excluded part of it; null if nothing is left is up to the count."""
    return F.coalesce(frame, F.lit(0)) - F.coalesce(excluded, F.lit(0))


def sum_excluding(value: Column, frame, part) -> Column:
    """sum() OVER frame EXCLUDE part: both are windows, part within frame."""
    left = F.count(value).over(frame) - F.count(value).over(part)
    return F.when(left > 0, excluding(F.sum(value).over(frame), F.sum(value).over(part)))


def filtered(aggregate, value: Column, condition: Column, window) -> Column:
    """agg(value) FILTER (WHERE condition) OVER window."""
    return aggregate(F.when(condition, value)).over(window)


def first_of_value(value: Column, partition: list[str], order: list[Column]) -> Column:
    """Whether a row is the first of its partition with its (non-null) value: what DISTINCT counts, once, in frames that begin with the partition."""
    window = Window.partitionBy(*partition, value).orderBy(*(order or [F.lit(1)]))
    return (F.row_number().over(window) == 1) & value.isNotNull()


def with_distinct(df: DataFrame, value: Column, partition: list[str], order: list[Column], count: str | None = None, total: str | None = None) -> DataFrame:
    """count(DISTINCT value) and sum(DISTINCT value) OVER (PARTITION BY ... ORDER BY ...): a flag and a sum, so no row holds a set of values."""
    window = Window.partitionBy(*partition).orderBy(*order) if order else Window.partitionBy(*partition)
    rows = df.withColumn("__first", first_of_value(value, partition, order))
    if count:
        rows = rows.withColumn(count, F.count_if("__first").over(window))
    if total:
        rows = rows.withColumn(total, F.sum(F.when(F.col("__first"), value)).over(window))
    return rows.drop("__first")


def lag_by(value: Column, offset: Column, partition: list[str], order: list[Column], df: DataFrame, name: str) -> DataFrame:
    """lag(value, offset) with an offset of each row's own; negative ones look ahead. A self-join on row numbers."""
    window = Window.partitionBy(*partition).orderBy(*order)
    rows = df.withColumn("__n", F.row_number().over(window)).withColumn("__want", F.col("__n") - offset)
    other = rows.select(*(F.col(c).alias(f"__p_{c}") for c in partition), F.col("__n").alias("__m"), value.alias(name))
    on = F.col("__want") == F.col("__m")
    for c in partition:
        on = on & F.col(c).eqNullSafe(F.col(f"__p_{c}"))
    return rows.join(other, on, "left").select(*df.columns, name)
