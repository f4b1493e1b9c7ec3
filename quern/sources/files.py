"""Import and export: CSV with a header, JSON arrays of objects, Parquet copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header row, read with the schema given rather than by inference."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True, escape='"')


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """An array of objects, or lines of them."""
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def write_json(df: DataFrame, path: str) -> None:
    """Lines of objects, nulls kept."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def backup(df: DataFrame, path: str, files: int | None = None) -> None:
    """VACUUM INTO: a compact copy at a new path."""
    (df.coalesce(files) if files else df).write.mode("errorifexists").parquet(path)


def bulk_copy(spark: SparkSession, rows: list[tuple], schema: str, path: str) -> None:
    """Rows appended all or not at all: the commit publishes them together."""
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)


def attach(spark: SparkSession, sf_dir: str, prefix: str, tables: list[str]) -> None:
    """ATTACH: the tables of a directory as views prefix_name."""
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"{prefix}_{t}")


def detach(spark: SparkSession, prefix: str, tables: list[str]) -> None:
    for t in tables:
        spark.catalog.dropTempView(f"{prefix}_{t}")
