"""Row changes as rewrites: each takes frames and returns the table after the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """INSERT: missing columns take their default, else null."""
    made = rows
    for f in table.schema.fields:
        if f.name not in rows.columns:
            made = made.withColumn(f.name, (defaults or {}).get(f.name, F.lit(None)).cast(f.dataType))
    return table.unionByName(made.select(*(F.col(f.name).cast(f.dataType) for f in table.schema.fields)))


def _first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first of the rows of a key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def fresh(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key isn't taken, one of each key: the first by its columns; a key with a null is none."""
    free = rows.join(table.select(*keys), keys, "left_anti")
    whole = [F.col(k).isNotNull() for k in keys]
    keyed = whole[0]
    for w in whole[1:]:
        keyed = keyed & w
    return free.where(~keyed).unionByName(_first(free.where(keyed), keys, [F.col(c) for c in rows.columns]))


def last(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key: the last by its columns; a key with a null is none."""
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    return rows.where(~keyed).unionByName(_first(rows.where(keyed), keys, [F.col(c).desc() for c in rows.columns]))


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is taken, or was by an earlier new row, are left out."""
    fresh = rows.join(table.select(*keys), keys, "left_anti")
    return insert(table, _first(fresh, keys, [F.col(c) for c in rows.columns]))


def insert_or_replace(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """New rows take the place of old ones with their key; of new ones with one key the last by its columns stays."""
    last = _first(rows, keys, [F.col(c).desc() for c in rows.columns])
    return insert(table.join(last.select(*keys), keys, "left_anti"), last)


def duplicates(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that INSERT OR ABORT would fail on."""
    return table.select(*keys).unionAll(rows.select(*keys)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], update: dict[str, Column], where: Column | None = None) -> DataFrame:
    """ON CONFLICT (keys) DO UPDATE SET ... WHERE: expressions see the old columns as old_x and the new as new_x."""
    old = table.select(*(F.col(c).alias(f"old_{c}") for c in table.columns), F.lit(True).alias("__old"))
    new = rows.select(*(F.col(c).alias(f"new_{c}") for c in rows.columns), F.lit(True).alias("__new"))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"old_{k}") == F.col(f"new_{k}"))
    both = old.join(new, on, "full_outer")
    hit = F.col("__old").isNotNull() & F.col("__new").isNotNull()
    hit = hit & where if where is not None else hit
    out = []
    for f in table.schema.fields:
        c = f.name
        fresh = F.col(f"new_{c}") if c in rows.columns else F.lit(None)
        value = F.when(F.col("__old").isNull(), fresh).otherwise(F.when(hit, update[c]).otherwise(F.col(f"old_{c}")) if c in update else F.col(f"old_{c}"))
        out.append(value.cast(f.dataType).alias(c))
    return both.select(*out)


def update_from(table: DataFrame, source: DataFrame, on: Column, sets: dict[str, Column]) -> DataFrame:
    """UPDATE ... FROM: rows with a match in source get their new values; source has one match a row at most."""
    joined = table.join(source.withColumn("__hit", F.lit(True)), on, "left")
    cols = [F.when(F.col("__hit"), sets[c]).otherwise(table[c]).cast(table.schema[c].dataType).alias(c) if c in sets else table[c] for c in table.columns]
    return joined.select(*cols)


def update(table: DataFrame, where: Column, sets: dict[str, Column]) -> DataFrame:
    return table.select(*(F.when(where, sets[c]).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c) if c in sets else F.col(c) for c in table.columns))


def delete(table: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition is not true."""
    return table.where(~F.coalesce(where, F.lit(False)))


def returning(table: DataFrame, where: Column, *columns: Column) -> DataFrame:
    """What DELETE or UPDATE ... RETURNING gives: expressions over the affected rows."""
    return table.where(where).select(*columns)


def foreign_key_check(child: DataFrame, key: str, parent: DataFrame, target: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(target).alias("__t")), F.col(key) == F.col("__t"), "left_anti")


def cascade_delete(child: DataFrame, key: str, gone: DataFrame, target: str) -> DataFrame:
    """ON DELETE CASCADE: the child without rows of deleted parents."""
    return child.join(gone.select(F.col(target).alias("__t")).distinct(), F.col(key) == F.col("__t"), "left_anti")


def set_null(child: DataFrame, key: str, gone: DataFrame, target: str) -> DataFrame:
    """ON DELETE SET NULL."""
    marked = child.join(gone.select(F.col(target).alias("__t")).distinct(), F.col(key) == F.col("__t"), "left")
    return marked.withColumn(key, F.when(F.col("__t").isNull(), F.col(key))).drop("__t")


def check_violations(table: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """name, and the rows' columns, of each CHECK that is false (null passes)."""
    failed = F.filter(F.array(*(F.when(~c, F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())
    return table.withColumn("violated", F.explode(failed))


def generated(table: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Generated columns, in order."""
    for name, value in columns.items():
        table = table.withColumn(name, value)
    return table
