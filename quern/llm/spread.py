"""The session's partitions, tables between steps, and names that can't clash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.sources.scratch import shared_folder, written

__all__ = ["freed", "neutral", "partitions", "shared_folder", "written"]

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def freed(df: DataFrame) -> DataFrame:
    """As written; the shuffle files that it took go at once, not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return written(df)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def neutral(docs: DataFrame) -> DataFrame:
    """The rows with all columns but doc_id and text renamed by place, so that those that an operator adds are new; toDF(*docs.columns) goes back."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)))
