"""Change data: what differs between two states of a table, and applying it to a stream's sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change_type (insert, update, delete), before and after (structs), updated (names of changed columns)."""
    rest = [c for c in before.columns if c not in keys]
    a = before.select(*keys, F.struct(*rest).alias("before"), F.lit(1).alias("__a"))
    b = after.select(*keys, F.struct(*rest).alias("after"), F.lit(1).alias("__b"))
    both = a.join(b, keys, "full_outer")
    kind = F.when(F.col("__a").isNull(), "insert").when(F.col("__b").isNull(), "delete").when(~F.col("before").eqNullSafe(F.col("after")), "update")
    differs = F.filter(F.array(*(F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.lit(c)) for c in rest)), lambda x: x.isNotNull())
    out = both.withColumn("change_type", kind).where("change_type is not null")
    return out.select(*keys, "change_type", "before", "after", F.when(F.col("change_type") == "update", differs).otherwise(F.array().cast("array<string>")).alias("updated"))


def captured(before: DataFrame, after: DataFrame, keys: list[str], mode: str = "full") -> DataFrame:
    """changes() with what a capture mode keeps: id (keys and kind alone), before, after, or full (both, and updated)."""
    if mode not in ("id", "before", "after", "full"):
        raise ValueError("mode must be id, before, after or full")
    feed = changes(before, after, keys)
    kept = {"id": [], "before": ["before"], "after": ["after"], "full": ["before", "after", "updated"]}[mode]
    return feed.select(*keys, "change_type", *kept)


def replayed(table: DataFrame, feed: DataFrame, keys: list[str]) -> DataFrame:
    """The table after a change feed of changes()."""
    rest = [c for c in table.columns if c not in keys]
    gone = feed.where("change_type in ('update', 'delete')").select(*keys)
    new = feed.where("change_type in ('insert', 'update')").select(*keys, *(F.col(f"after.{c}").alias(c) for c in rest))
    return table.join(gone, keys, "left_anti").unionByName(new.select(*table.columns))


def stream_changes(stream: DataFrame, snapshot, keys: list[str], sink):
    """A writer that gives sink(changes, batch) the difference between snapshot() and each micro-batch's rows by key."""

    def each(batch: DataFrame, number: int) -> None:
        old = snapshot().join(batch.select(*keys).distinct(), keys, "left_semi")
        sink(changes(old, batch, keys), number)

    return stream.writeStream.foreachBatch(each)


def tumbling(events: DataFrame, at: str, width: str, late: str, **aggregates: Column) -> DataFrame:
    """start, end and named aggregates by event-time windows, of a stream (with a watermark) or of a table."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    made = rows.groupBy(F.window(at, width)).agg(*(c.alias(n) for n, c in aggregates.items()))
    return made.select("window.start", "window.end", *aggregates)
