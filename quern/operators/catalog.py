"""A database of named frames with the constraints, indexes and triggers that Spark's catalogue has no place for.

Every change makes a new frame, which is written to the shared folder, so that plans don't grow with the
number of statements; what was before stays as it was, which is what savepoints and transactions keep.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import dml
from quern.sources.scratch import written


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    target: str
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"
    deferred: bool = False


@dataclass(frozen=True)
class Trigger:
    time: str
    event: str
    columns: tuple[str, ...] | None
    table: str
    when: Any
    body: tuple


@dataclass(frozen=True)
class Table:
    frame: DataFrame
    key: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    checks: dict[str, Column] = field(default_factory=dict)
    defaults: dict[str, Column] = field(default_factory=dict)
    generated: dict[str, Column] = field(default_factory=dict)
    foreign: tuple[ForeignKey, ...] = ()
    indexes: dict[str, tuple[tuple[str, ...], bool]] = field(default_factory=dict)
    collations: dict[str, str] = field(default_factory=dict)
    counted: str | None = None  # the integer key that numbers rows by itself
    autoincrement: bool = False  # numbers of deleted rows aren't used again
    last: int = 0


#: Session settings and their defaults.
SETTINGS = {"foreign_keys": 0, "query_only": 0, "recursive_triggers": 0, "ignore_check_constraints": 0, "defer_foreign_keys": 0, "case_sensitive_like": 0, "user_version": 0, "application_id": 0, "schema_version": 0, "full_column_names": 0, "short_column_names": 1, "cache_size": -2000, "busy_timeout": 0, "synchronous": 2}


class Database:
    """Tables by name, without regard to case."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.views: dict[str, DataFrame] = {}
        self.triggers: dict[str, Trigger] = {}
        self.stats: dict[str, list[tuple]] = {}
        self.settings = dict(SETTINGS)
        self.saved: list[tuple[str, tuple]] = []
        self.started: tuple | None = None
        #: Callables by event: update (event, table, rows), commit (), rollback (), authorize (statement) and trace (text).
        self.hooks: dict[str, list[Callable]] = {n: [] for n in ("update", "commit", "rollback", "authorize", "trace")}
        self.functions: dict[str, str] = {}  # users' functions and the kinds that they return
        self.attached: dict[str, str] = {}  # directories of Parquet tables by name
        self.changed: list[DataFrame] = []  # the rows of each change, for changes() and total_changes()

    # names

    def name(self, name: str) -> str:
        found = next((n for n in [*self.tables, *self.views] if n.lower() == name.lower()), None)
        if found is None:
            raise KeyError(f"no such table: {name}")
        return found

    def table(self, name: str) -> Table:
        found = self.name(name)
        if found not in self.tables:
            raise ValueError(f"cannot modify {name} because it is a view")
        return self.tables[found]

    def lookup(self, name: str) -> DataFrame | None:
        """A table's, view's or catalogue table's frame; None if there is none."""
        try:
            return self.frame(self.name(name))
        except KeyError:
            pass
        schema, _, table = name.rpartition(".")
        if schema:
            path = self.attached.get(schema.lower())
            return None if path is None else self.spark.read.parquet(f"{path}/{table}.parquet")
        if name.lower() in ("sqlite_schema", "sqlite_master"):
            return self.schema()
        if name.lower() == "sqlite_stat1":
            return self.spark.createDataFrame([r for rows in self.stats.values() for r in rows], "tbl string, idx string, stat string")
        return self.table_function(name, []) if name.lower().startswith("pragma_") else None

    def table_function(self, name: str, args: list) -> DataFrame | None:
        """pragma_x(argument) in FROM."""
        return self.pragma(name[7:].lower(), args[0] if args else None) if name.lower().startswith("pragma_") else None

    def rowid(self, name: str) -> str | None:
        t = next((t for n, t in self.tables.items() if n.lower() == name.lower()), None)
        return None if t is None else t.counted or (t.key[0] if len(t.key) == 1 else None)

    def collation(self, table: str, column: str) -> str | None:
        t = next((t for n, t in self.tables.items() if n.lower() == table.lower()), None)
        return t.collations.get(column) if t else None

    # definitions

    def create(self, name: str, frame: DataFrame, **constraints) -> None:
        """CREATE TABLE, or CREATE TABLE AS SELECT."""
        if any(n.lower() == name.lower() for n in [*self.tables, *self.views]):
            raise ValueError(f"table {name} already exists")
        generated = constraints.get("generated", {})
        self.tables[name] = Table(dml.generated(frame, generated), **constraints)
        self.settings["schema_version"] += 1

    def create_view(self, name: str, frame: DataFrame) -> None:
        if any(n.lower() == name.lower() for n in [*self.tables, *self.views]):
            raise ValueError(f"table {name} already exists")
        self.views[name] = frame

    def create_index(self, name: str, table: str, columns: tuple[str, ...], unique: bool = False) -> None:
        """Metadata only; a unique one takes part in the checks of inserts."""
        t = self.tables[table]
        self.tables[table] = replace(t, indexes={**t.indexes, name: (columns, unique)}, unique=(*t.unique, columns) if unique else t.unique)

    def create_trigger(self, name: str, time: str, event: str, columns: list[str] | None, table: str, when: Any, body: list, if_not_exists: bool = False) -> None:
        if name in self.triggers:
            if if_not_exists:
                return
            raise ValueError(f"trigger {name} already exists")
        self.triggers[name] = Trigger(time, event, tuple(columns) if columns else None, self.name(table), when, tuple(body))

    def drop(self, name: str, if_exists: bool = False) -> None:
        for names in (self.tables, self.views, self.triggers):
            found = next((n for n in names if n.lower() == name.lower()), None)
            if found is not None:
                del names[found]
                return
        owner = next((n for n, t in self.tables.items() if name in t.indexes), None)
        if owner is not None:
            t = self.tables[owner]
            columns, unique = t.indexes[name]
            self.tables[owner] = replace(t, indexes={i: x for i, x in t.indexes.items() if i != name}, unique=tuple(u for u in t.unique if not (unique and u == columns)))
        elif not if_exists:
            raise KeyError(f"no such table: {name}")

    def add_column(self, name: str, column: str, kind, default: Column | None = None) -> None:
        t = self.tables[name]
        value = (default if default is not None else F.lit(None)).cast(kind)
        self.tables[name] = replace(t, frame=t.frame.withColumn(column, value), defaults={**t.defaults, **({column: default} if default is not None else {})})

    def drop_column(self, name: str, column: str) -> None:
        t = self.tables[name]
        if column in t.key or any(column in u for u in t.unique):
            raise ValueError(f"cannot drop column {column}: it is part of a key")
        self.tables[name] = replace(t, frame=t.frame.drop(column))

    def rename_column(self, name: str, old: str, new: str) -> None:
        t = self.tables[name]
        swap = lambda cs: tuple(new if c == old else c for c in cs)
        self.tables[name] = replace(t, frame=t.frame.withColumnRenamed(old, new), key=swap(t.key), not_null=swap(t.not_null), unique=tuple(map(swap, t.unique)), indexes={i: (swap(c), u) for i, (c, u) in t.indexes.items()}, counted=new if t.counted == old else t.counted)

    def rename(self, old: str, new: str) -> None:
        self.tables[new] = self.tables.pop(old)
        for n, t in self.tables.items():
            self.tables[n] = replace(t, foreign=tuple(replace(fk, parent=new) if fk.parent.lower() == old.lower() else fk for fk in t.foreign))

    # rows

    def frame(self, name: str) -> DataFrame:
        return self.views[name] if name in self.views else self.tables[name].frame

    def insert(self, name: str, rows: DataFrame, conflict: str = "abort", upsert: tuple | None = None) -> DataFrame:
        """INSERT [OR IGNORE | REPLACE] or with ON CONFLICT (keys, sets or None, where); the rows it made or changed.

        With abort (fail and rollback as well: a statement is one rewrite) a violated constraint raises and
        nothing changes. Of rows with one key, ignore keeps the first by their columns and replace the last.
        """
        name = self.name(name)
        return self._whole(lambda: self._insert(name, rows, conflict, upsert), conflict)

    def _insert(self, name: str, rows: DataFrame, conflict: str, upsert: tuple | None) -> DataFrame:
        t = self.table(name)
        rows = self._completed(t, rows)
        keys = [list(k) for k in ([t.key] if t.key else []) + list(t.unique)]
        if conflict == "ignore":
            for c in t.not_null:
                rows = rows.where(F.col(c).isNotNull())
            for check in t.checks.values():
                rows = rows.where(F.coalesce(check, F.lit(True)))
        gone = None
        if upsert is not None and (upsert[0] or keys):
            on, sets, where = upsert
            on = on or keys[0]
            if sets is None:
                fresh = dml.fresh(t.frame, rows, on)
                new, added = t.frame.unionByName(fresh), fresh
            else:
                new = dml.upsert(t.frame, rows, on, sets, where)
                added = new.join(rows.select(*on).distinct(), on, "left_semi")
        elif conflict in ("ignore", "replace") and keys:
            added = rows
            for k in keys:
                added = dml.fresh(t.frame, added, k) if conflict == "ignore" else dml.last(added, k)
            old = t.frame
            if conflict == "replace":
                for k in keys:
                    old = old.join(added.select(*k).dropna(), k, "left_anti")
                gone = t.frame.join(added.select(*keys[0]), keys[0], "left_semi")
            new = old.unionByName(added)
        else:
            new, added = t.frame.unionByName(rows), rows
        added = written(dml.generated(added, t.generated))
        self._store(name, dml.generated(new, t.generated))
        if gone is not None and self.settings["foreign_keys"]:
            self._orphaned(name, written(gone.join(added.select(*keys[0]), keys[0], "left_anti")))
        if t.counted:
            most = added.agg(F.max(t.counted)).first()[0]
            self.tables[name] = replace(self.tables[name], last=max(t.last, most or 0))
        self._fire(name, "INSERT", None, added)
        return added

    def _completed(self, t: Table, rows: DataFrame) -> DataFrame:
        """The rows with all columns of the table: defaults, and numbers for a counted key that is null."""
        made = rows
        for f in t.frame.schema.fields:
            if f.name not in rows.columns and f.name not in t.generated:
                made = made.withColumn(f.name, t.defaults.get(f.name, F.lit(None)).cast(f.dataType))
        made = dml.generated(made, t.generated)
        made = made.select(*(F.col(f.name).cast(f.dataType) for f in t.frame.schema.fields))
        if t.counted and t.counted in made.columns:
            # rows keep the order that they come in
            made = written(made.withColumn("__at", F.monotonically_increasing_id()))
            bare = made.where(F.col(t.counted).isNull()).withColumn("__part", F.shiftright("__at", 33))
            sizes = {r["__part"]: r["count"] for r in bare.groupBy("__part").count().collect()}  # a row a partition
            if sizes:
                top = max(t.last if t.autoincrement else 0, t.frame.agg(F.max(t.counted)).first()[0] or 0, made.agg(F.max(t.counted)).first()[0] or 0)
                before = {}
                for part in sorted(sizes):
                    before[part] = top
                    top += sizes[part]
                # numbers by partition, so that no window holds all rows
                ranks = Window.partitionBy("__part").orderBy("__at")
                start = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
                numbered = bare.withColumn(t.counted, (F.row_number().over(ranks) + start[F.col("__part")]).cast(t.frame.schema[t.counted].dataType)).drop("__part")
                made = made.where(F.col(t.counted).isNotNull()).unionByName(numbered)
            made = made.drop("__at")
        return made

    def remove(self, name: str, marked: DataFrame) -> DataFrame:
        """DELETE of the rows with __hit, with foreign-key actions, through all generations; the rows deleted."""
        name = self.name(name)

        def run() -> DataFrame:
            t = self.table(name)
            both = written(marked)
            gone = both.where("__hit").drop("__hit")
            self.tables[name] = replace(t, frame=both.where("not __hit").drop("__hit").select(*t.frame.columns))
            if self.settings["foreign_keys"]:
                self._orphaned(name, gone)
            self._fire(name, "DELETE", gone, None)
            return gone

        return self._whole(run)

    def _orphaned(self, name: str, gone: DataFrame) -> None:
        """What happens to rows that refer to deleted ones."""
        for child in list(self.tables):
            for fk in self.tables[child].foreign:
                if fk.parent.lower() != name.lower():
                    continue
                t = self.tables[child]
                lost = gone.select(F.col(fk.target).alias("__t")).distinct()
                held = t.frame.join(lost, F.col(fk.column) == F.col("__t"), "left")
                hit = F.col("__t").isNotNull()
                if held.where(hit).isEmpty():
                    continue
                if fk.on_delete == "CASCADE":
                    self.remove(child, held.withColumn("__hit", hit).drop("__t"))
                elif fk.on_delete in ("SET NULL", "SET DEFAULT"):
                    value = t.defaults.get(fk.column, F.lit(None)) if fk.on_delete == "SET DEFAULT" else F.lit(None)
                    self._store(child, held.withColumn(fk.column, F.when(hit, value).otherwise(F.col(fk.column)).cast(t.frame.schema[fk.column].dataType)).drop("__t"))
                elif fk.on_delete == "RESTRICT" or not self._later(fk):
                    raise ValueError("FOREIGN KEY constraint failed")

    def _later(self, fk: ForeignKey) -> bool:
        """Whether a key is checked when the transaction ends."""
        return self.started is not None and (fk.deferred or bool(self.settings["defer_foreign_keys"]))

    def change(self, name: str, marked: DataFrame, sets: dict[str, Column], conflict: str = "abort") -> DataFrame:
        """UPDATE of the rows with __hit, with foreign-key actions; the rows after it."""
        name = self.name(name)

        def run() -> DataFrame:
            t = self.table(name)
            hit = F.col("__hit")
            new = [F.when(hit, sets[c]).otherwise(F.col(c)).cast(t.frame.schema[c].dataType).alias(c) if c in sets else F.col(c) for c in t.frame.columns]
            both = written(marked.select(*new, F.struct(*t.frame.columns).alias("__before"), "__hit"))
            after = dml.generated(both.where(hit).drop("__hit", "__before"), t.generated)
            self._store(name, dml.generated(both.drop("__hit", "__before"), t.generated).select(*t.frame.columns), conflict)
            if self.settings["foreign_keys"]:
                self._moved(name, both.where(hit), set(sets))
            self._fire(name, "UPDATE", both.where(hit).select("__before.*"), after, set(sets), pairs=both.where(hit))
            return after

        return self._whole(run, conflict)

    def _moved(self, name: str, both: DataFrame, columns: set[str]) -> None:
        """What happens to rows that refer to changed keys."""
        for child in list(self.tables):
            for fk in self.tables[child].foreign:
                if fk.parent.lower() != name.lower() or fk.target not in columns:
                    continue
                t = self.tables[child]
                pairs = both.select(F.col(f"__before.{fk.target}").alias("__t"), F.col(fk.target).alias("__u")).where("__t is distinct from __u").distinct()
                held = t.frame.join(pairs, F.col(fk.column) == F.col("__t"), "left")
                hit = F.col("__t").isNotNull()
                if held.where(hit).isEmpty():
                    continue
                if fk.on_update in ("CASCADE", "SET NULL", "SET DEFAULT"):
                    value = F.col("__u") if fk.on_update == "CASCADE" else t.defaults.get(fk.column, F.lit(None)) if fk.on_update == "SET DEFAULT" else F.lit(None)
                    self.change(child, held.withColumn("__hit", hit).withColumn("__value", value).drop("__t", "__u"), {fk.column: F.col("__value")})
                elif fk.on_update == "RESTRICT" or not self._later(fk):
                    raise ValueError("FOREIGN KEY constraint failed")

    def delete(self, name: str, where: Column) -> DataFrame:
        """DELETE with a condition; the rows deleted."""
        name = self.name(name)
        return self.remove(name, self.tables[name].frame.withColumn("__hit", F.coalesce(where, F.lit(False))))

    def update(self, name: str, where: Column, sets: dict[str, Column]) -> DataFrame:
        """UPDATE with a condition; the rows before it."""
        name = self.name(name)
        before = self.tables[name].frame
        self.change(name, before.withColumn("__hit", F.coalesce(where, F.lit(False))), sets)
        return before.where(where)

    def _store(self, name: str, frame: DataFrame, conflict: str = "abort") -> None:
        """The table's new rows, if no constraint is violated; with ignore or replace, an update drops rows that would be."""
        t = self.tables[name]
        frame = written(frame)
        if conflict in ("ignore", "replace"):
            for k in ([t.key] if t.key else []) + list(t.unique):
                frame = dml.last(frame, list(k))
        self.tables[name] = replace(t, frame=frame)
        for problem, bad in self.violations(self.tables[name]):
            if not bad.isEmpty():
                raise ValueError(f"constraint failed: {name}: {problem}")

    def violations(self, t: Table) -> list[tuple[str, DataFrame]]:
        """What each constraint of a table finds against it."""
        out = [(f"UNIQUE {', '.join(u)}", t.frame.dropna(subset=list(u)).groupBy(*u).agg(F.count("*").alias("n")).where("n > 1")) for u in ([t.key] if t.key else []) + list(t.unique)]
        out += [(f"NOT NULL {c}", t.frame.where(F.col(c).isNull())) for c in t.not_null]
        if t.checks and not self.settings["ignore_check_constraints"]:
            out.append(("CHECK", dml.check_violations(t.frame, t.checks)))
        if self.settings["foreign_keys"]:
            out += [(f"FOREIGN KEY {fk.column}", dml.foreign_key_check(t.frame, fk.column, self.frame(self.name(fk.parent)), fk.target)) for fk in t.foreign if not self._later(fk)]
        return out

    def _fire(self, name: str, event: str, old: DataFrame | None, new: DataFrame | None, columns: set[str] | None = None, pairs: DataFrame | None = None) -> None:
        """The triggers of a change: each statement of a body runs once over all changed rows, as new and old."""
        rows = new if new is not None else old
        self.changed.append(rows)
        for hook in self.hooks["update"]:
            hook(event, name, rows)
        found = [g for g in self.triggers.values() if g.table == name and g.event == event and (g.columns is None or columns is None or set(g.columns) & columns)]
        if not found:
            return
        from quern.sql.triggers import fire

        if pairs is not None:
            both = pairs.select(*(F.col(c).alias(f"new_{c}") for c in new.columns), *(F.col(f"__before.{c}").alias(f"old_{c}") for c in new.columns))
        else:
            side, df = ("new", new) if new is not None else ("old", old)
            both = df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns))
        both = written(both)
        if not both.isEmpty():
            for g in found:
                fire(self, g, both)

    def _whole(self, run: Callable[[], DataFrame], conflict: str = "abort") -> DataFrame:
        """A change that happens as a whole or not at all."""
        if self.settings["query_only"]:
            raise PermissionError("attempt to write a readonly database")
        before = self._snapshot()
        try:
            return run()
        except Exception:
            self._restore(before)
            if conflict == "rollback" and self.started is not None:
                self.rollback()
            raise

    # savepoints and transactions: frames are immutable, so a snapshot is the dictionaries

    def _snapshot(self) -> tuple:
        return dict(self.tables), dict(self.views), dict(self.triggers)

    def _restore(self, state: tuple) -> None:
        self.tables, self.views, self.triggers = (dict(x) for x in state)

    def savepoint(self, name: str) -> None:
        self.saved.append((name, self._snapshot()))

    def _saved(self, name: str) -> int:
        found = [i for i, s in enumerate(self.saved) if s[0].lower() == name.lower()]
        if not found:
            raise KeyError(f"no such savepoint: {name}")
        return found[-1]

    def release(self, name: str) -> None:
        del self.saved[self._saved(name) :]

    def rollback_to(self, name: str) -> None:
        at = self._saved(name)
        self._restore(self.saved[at][1])
        del self.saved[at + 1 :]

    def begin(self) -> None:
        if self.started is not None:
            raise ValueError("cannot start a transaction within a transaction")
        self.started = self._snapshot()

    def commit(self) -> None:
        """Ends a transaction; keys that were to be checked at its end are."""
        if self.started is None:
            raise ValueError("cannot commit - no transaction is active")
        state, self.started = self.started, None
        for hook in self.hooks["commit"]:
            if hook():  # a true answer turns the commit into a rollback
                self.started = state
                return self.rollback()
        if self.settings["foreign_keys"]:
            for t in self.tables.values():
                if any(not bad.isEmpty() for problem, bad in self.violations(t) if problem.startswith("FOREIGN")):
                    self.started = state
                    raise ValueError("FOREIGN KEY constraint failed")
        self.saved.clear()

    def rollback(self) -> None:
        if self.started is None:
            raise ValueError("cannot rollback - no transaction is active")
        self._restore(self.started)
        self.started = None
        self.saved.clear()
        for hook in self.hooks["rollback"]:
            hook()

    def state(self, name: str) -> Any:
        """What changes(), total_changes(), last_insert_rowid() and is_autocommit() say; rows are counted when asked for."""
        if name == "changes":
            return self.changed[-1].count() if self.changed else 0
        if name == "total_changes":
            return sum(df.count() for df in self.changed)
        if name == "is_autocommit":
            return int(self.started is None)
        return max((t.last for t in self.tables.values()), default=0)

    def dry(self, run: Callable[[], DataFrame]) -> DataFrame:
        """What a statement gives, without its effect."""
        before = self._snapshot()
        try:
            return run()
        finally:
            self._restore(before)

    # statements

    def create_function(self, name: str, f: Callable, returns: str, deterministic: bool = True) -> None:
        """A scalar function that statements can call; it runs in Arrow batches."""
        from pyspark.sql.types import _parse_datatype_string

        from quern.functions.udf import create_function
        from quern.sql.expressions import kind_of

        create_function(self.spark, name.lower(), f, returns, deterministic)
        self.functions[name.lower()] = kind_of(_parse_datatype_string(returns))

    def rows(self, text: str, *values, **args):
        """A statement's rows one at a time: partitions are fetched as they are read, so a reader can stop and go on."""
        return self.sql(text, *values, **args).toLocalIterator(prefetchPartitions=False)

    def sql(self, text: str, *values, **args) -> DataFrame:
        """Runs the statements of a text; the last one's rows. Parameters by place (?) or name (:name)."""
        from quern.sql.parser import statements
        from quern.sql.statements import Runner

        runner = Runner(self, {**{str(i + 1): v for i, v in enumerate(values)}, **args})
        out = runner.empty()
        for hook in self.hooks["trace"]:
            hook(text)
        for statement in statements(text):
            for hook in self.hooks["authorize"]:
                if not hook(statement):
                    raise PermissionError("not authorized")
            out = runner.run(statement)
        return out

    # pragmas

    def pragma(self, name: str, argument: str | int | None = None) -> DataFrame:
        """Introspection pragmas as frames; a setting is read, or written with an argument; others give nothing."""
        make = self.spark.createDataFrame
        if name in ("table_info", "table_xinfo"):
            t = self.tables.get(self.name(argument)) or Table(self.views[self.name(argument)])
            rows = [(i, f.name, f.dataType.simpleString(), int(f.name in t.not_null), list(t.key).index(f.name) + 1 if f.name in t.key else 0, 2 * int(f.name in t.generated)) for i, f in enumerate(t.frame.schema.fields)]
            if name == "table_info":
                return make([r[:5] for r in rows if not r[5]], "cid int, name string, type string, notnull int, pk int")
            return make(rows, "cid int, name string, type string, notnull int, pk int, hidden int")
        if name == "table_list":
            return make([("main", n, "table", len(t.frame.columns)) for n, t in self.tables.items()] + [("main", n, "view", len(v.columns)) for n, v in self.views.items()], "schema string, name string, type string, ncol int")
        if name == "index_list":
            return make([(i, n, int(u), "c", 0) for i, (n, (_, u)) in enumerate(self.table(argument).indexes.items())], "seq int, name string, unique int, origin string, partial int")
        if name in ("index_info", "index_xinfo"):
            t, columns = next((t, t.indexes[argument][0]) for t in self.tables.values() if argument in t.indexes)
            return make([(i, t.frame.columns.index(c), c) for i, c in enumerate(columns)], "seqno int, cid int, name string")
        if name == "foreign_key_list":
            return make([(i, 0, fk.parent, fk.column, fk.target, fk.on_update, fk.on_delete) for i, fk in enumerate(self.table(argument).foreign)], "id int, seq int, `table` string, `from` string, `to` string, on_update string, on_delete string")
        if name == "foreign_key_check":
            out = make([], "`table` string, parent string, fkid int")
            for n, t in self.tables.items():
                for i, fk in enumerate(t.foreign):
                    bad = dml.foreign_key_check(t.frame, fk.column, self.frame(fk.parent), fk.target)
                    out = out.unionAll(bad.select(F.lit(n), F.lit(fk.parent), F.lit(i)))
            return out
        if name in ("integrity_check", "quick_check"):
            found = [f"{n}: {p}" for n, t in self.tables.items() for p, frame in self.violations(t) if not frame.isEmpty()]
            return make([(x,) for x in found or ["ok"]], f"{name} string")
        if name == "function_list":
            from quern.sql.calls import AGGREGATES, RANKING, SCALAR

            kinds = {**dict.fromkeys(SCALAR, "s"), **dict.fromkeys(AGGREGATES, "a"), **dict.fromkeys(RANKING, "w")}
            return make(sorted(kinds.items()), "name string, type string")
        if name == "module_list":
            return make([(n,) for n in ("fts5", "generate_series", "json_each", "json_tree", "rtree")], "name string")
        if name == "collation_list":
            return make([(0, "RTRIM"), (1, "NOCASE"), (2, "BINARY")], "seq int, name string")
        if name == "list_types":
            return make([(n,) for n in ("BLOB", "INTEGER", "NUMERIC", "REAL", "TEXT")], "name string")
        if name == "database_list":
            return make([(0, "main", ""), *((i + 2, n, p) for i, (n, p) in enumerate(self.attached.items()))], "seq int, name string, file string")
        if name == "encoding":
            return make([("UTF-8",)], "encoding string")
        if name in self.settings:
            if argument is not None:
                self.settings[name] = int(argument)  # a word is not a setting's value
            return make([(self.settings[name],)], f"{name} int")
        return make([], "value string")

    def schema(self) -> DataFrame:
        """sqlite_schema: type, name, tbl_name."""
        rows = [("table", n, n) for n in self.tables] + [("view", n, n) for n in self.views] + [("index", i, n) for n, t in self.tables.items() for i in t.indexes]
        rows += [("trigger", n, g.table) for n, g in self.triggers.items()]
        return self.spark.createDataFrame(rows, "type string, name string, tbl_name string")

    def analyze(self, name: str) -> DataFrame:
        """ANALYZE: rows, and distinct values of each index's leading column, in the shape of sqlite_stat1."""
        t = self.tables[name]
        n = t.frame.count()
        rows = [(name, i, f"{n} {max(1, -(-n // max(1, t.frame.select(c[0]).distinct().count())))}") for i, (c, _) in t.indexes.items()] or [(name, None, str(n))]
        self.stats[name] = rows
        return self.spark.createDataFrame(rows, "tbl string, idx string, stat string")


def explain_query_plan(df: DataFrame) -> DataFrame:
    """EXPLAIN QUERY PLAN: id, parent and detail of the physical operators."""
    rows, stack = [], []
    for i, line in enumerate(df._jdf.queryExecution().executedPlan().toString().splitlines()):
        depth = len(line) - len(line.lstrip(" :+-"))
        while stack and stack[-1][0] >= depth:
            stack.pop()
        rows.append((i, stack[-1][1] if stack else 0, line.lstrip(" :+-")))
        stack.append((depth, i))
    return df.sparkSession.createDataFrame(rows, "id int, parent int, detail string")
