"""Join shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Estimated bytes up to which a side may be broadcast.
BROADCAST_BYTES = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a frame's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the estimate is under the limit; otherwise the planner shuffles both sides."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def using(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """JOIN ... USING: the named columns once, coalesced."""
    return left.join(right, names, how)


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """NATURAL JOIN: on all common columns; without any, each row with each."""
    names = [c for c in left.columns if c in right.columns]
    return left.join(right, names, how) if names else left.crossJoin(right)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, columns: list[str], strict: bool = False, width: float | None = None) -> DataFrame:
    """Each left row with the given columns of the last right row of its keys before (or at) its time.

    A union of both sides and one window over it: one shuffle, no row meets more than its predecessors. With a width
    (in seconds, or in the numbers that times are), a key's rows are dealt by buckets of time and each bucket takes what the ones before it end
    with, so no task holds all rows of a key that has many.
    """
    payload = F.struct(*(F.col(c) for c in columns))
    a = left.withColumn("__at", F.col(at)).withColumn("__side", F.lit(0 if strict else 1)).withColumn("__row", F.struct(*(F.col(c) for c in left.columns)))
    b = right.withColumn("__at", F.col(since)).withColumn("__side", F.lit(1 if strict else 0)).withColumn("__hit", payload)
    both = a.select(*keys, "__at", "__side", "__row").unionByName(b.select(*keys, "__at", "__side", "__hit"), allowMissingColumns=True)
    time = F.col("__at") if isinstance(both.schema["__at"].dataType, NumericType) else F.unix_micros(F.col("__at").cast("timestamp")) / 1e6
    bucket = F.floor(time / width) if width else F.lit(0)
    both = both.withColumn("__bucket", bucket)
    window = Window.partitionBy(*keys, "__bucket").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last("__hit", ignorenulls=True).over(window)).where(F.col("__row").isNotNull())
    if width:
        ends = both.where("__hit is not null").groupBy(*keys, "__bucket").agg(F.max_by("__hit", "__at").alias("__end"))
        known = ends.unionByName(found.select(*keys, "__bucket").distinct(), allowMissingColumns=True).groupBy(*keys, "__bucket").agg(F.max("__end").alias("__end"))
        earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        known = known.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__bucket").alias("__b"), F.last("__end", ignorenulls=True).over(earlier).alias("__before"))
        on = F.col("__bucket") == F.col("__b")
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        found = found.join(known, on, "left").withColumn("__found", F.coalesce("__found", "__before"))
    return found.select("__row.*", *(F.col(f"__found.{c}").alias(f"asof_{c}") for c in columns))


def interval(left: DataFrame, right: DataFrame, low: str, high: str, point: str, width: float, how: str = "inner") -> DataFrame:
    """Left intervals [low, high] with the right points in them: grid cells make it an equi-join, then the bounds are checked."""
    cells = F.sequence(F.floor(F.col(low) / width).cast("bigint"), F.floor(F.col(high) / width).cast("bigint"))
    a = left.withColumn("__cell", F.explode(cells))
    b = right.withColumn("__cell", F.floor(F.col(point) / width).cast("bigint"))
    return a.join(b, (a["__cell"] == b["__cell"]) & b[point].between(a[low], a[high]), how).drop("__cell")


def in_subquery(left: DataFrame, key: Column, right: DataFrame, value: str) -> DataFrame:
    """key IN (SELECT value ...)."""
    return left.join(right.select(F.col(value).alias("__v")).distinct(), key == F.col("__v"), "left_semi")


def not_in_subquery(left: DataFrame, key: Column, right: DataFrame, value: str) -> DataFrame:
    """key NOT IN (SELECT value ...): nothing once a value is null, and null keys only over no values."""
    values = right.select(F.col(value).alias("__v")).distinct()
    facts = F.broadcast(values.agg(F.count("*").alias("__n"), F.count_if(F.col("__v").isNull()).alias("__nulls")))  # one row
    kept = left.join(values, key == F.col("__v"), "left_anti")
    return kept.crossJoin(facts).where((F.col("__n") == 0) | ((F.col("__nulls") == 0) & key.isNotNull())).drop("__n", "__nulls")
