"""SQLite files as tables: spark.read.format("quern_sqlite"), in parts by rowid, and an atomic copy into a file.

The path must be one that all executors see. A file without rowids, or a view, is one part.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Spark's types for the affinities of declared types, by what a type's name contains, in order.
AFFINITIES = (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))
BATCH = 10_000


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class Part(InputPartition):
    def __init__(self, low: int | None, high: int | None) -> None:
        self.low, self.high = low, high


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quern_sqlite"

    def schema(self) -> str:
        with _open(self.options["path"]) as db:
            columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no such table: {self.options['table']}")
        kind = lambda t: next((s for word, s in AFFINITIES if word in t.upper()), "double" if t else "string")
        return ", ".join(f"`{c[1]}` {kind(c[2])}" for c in columns)

    def reader(self, schema) -> Reader:
        return Reader(self.options, schema)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema) -> None:
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("parts", "8"))
        self.kinds = [f.dataType.typeName() for f in schema.fields]
        self.columns = [f.name for f in schema.fields]

    def partitions(self) -> list[Part]:
        with _open(self.path) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:
                return [Part(None, None)]
        if low is None:
            return [Part(None, None)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Part(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, part: Part) -> Iterator[tuple]:
        where = "" if part.low is None else f" WHERE rowid BETWEEN {part.low} AND {part.high}"
        with _open(self.path) as db:
            for row in db.execute(f"SELECT {', '.join(map(_quoted, self.columns))} FROM {_quoted(self.table)}{where}"):
                yield tuple(map(_typed, row, self.kinds))


def _typed(x, kind: str):
    """A value as its column's type; what can't be is null."""
    if x is None:
        return None
    try:
        if kind == "string":
            return x.decode("utf-8", "replace") if isinstance(x, bytes) else str(x)
        if kind == "binary":
            return x if isinstance(x, bytes) else str(x).encode()
        return float(x) if kind == "double" else int(x)
    except ValueError:
        return None


def read_sqlite(spark: SparkSession, path: str, table: str, parts: int = 8) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("quern_sqlite").option("path", path).option("table", table).option("parts", parts).load()


def write_sqlite(df: DataFrame, path: str, table: str) -> int:
    """Copies the rows into a new table of a file, all or none; the number of rows. They come to the driver a partition at a time."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
    plain = df.select(*(df[c].cast("string").alias(c) if df.schema[c].dataType.simpleString() not in kinds else df[c] for c in df.columns))
    declared = ", ".join(f"{_quoted(f.name)} {kinds.get(f.dataType.simpleString(), 'TEXT')}" for f in plain.schema.fields)
    marks = ", ".join("?" * len(plain.columns))
    count = 0
    db = sqlite3.connect(path, isolation_level=None)
    try:
        db.execute("BEGIN")
        db.execute(f"CREATE TABLE {_quoted(table)} ({declared})")
        batch: list[tuple] = []
        for row in plain.toLocalIterator():
            batch.append(tuple(row))
            if len(batch) == BATCH:
                db.executemany(f"INSERT INTO {_quoted(table)} VALUES ({marks})", batch)
                count, batch = count + len(batch), []
        db.executemany(f"INSERT INTO {_quoted(table)} VALUES ({marks})", batch)
        db.execute("COMMIT")
        return count + len(batch)
    except BaseException:
        if db.in_transaction:
            db.execute("ROLLBACK")
        raise
    finally:
        db.close()
