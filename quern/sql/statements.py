"""Statements of the dialect run against a ``Database`` of frames.

Queries become one Spark SQL text. Changes of rows are rewrites: each makes a new frame from the old one, and
constraints are checked on what it gives. RETURNING gives the affected rows; other changes give an empty frame.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import json as json_functions
from quern.functions import text as text_functions
from quern.sql import parser as P
from quern.sql.expressions import Entry, Expressions, Scope, Value, affinity_of, kind_of, plain, quoted, truth
from quern.sql.queries import Queries

#: Spark's types for the affinities of declared types.
TYPES = {"integer": T.LongType(), "real": T.DoubleType(), "text": T.StringType(), "blob": T.BinaryType(), "numeric": T.DoubleType()}


def prepare(spark) -> None:
    """Registers the functions that queries name, once a session."""
    if not getattr(spark, "_quern_functions", False):
        from quern.operators.relations import JsonEach, JsonTree

        json_functions.register(spark)
        text_functions.register(spark)
        spark.udtf.register("quern_json_each", JsonEach)
        spark.udtf.register("quern_json_tree", JsonTree)
        spark._quern_functions = True


class Runner:
    def __init__(self, db, parameters: dict[str, Any] | None = None) -> None:
        self.db, self.spark, self.parameters = db, db.spark, parameters or {}
        prepare(self.spark)

    def queries(self, extra: dict[str, DataFrame] | None = None) -> Queries:
        more = {k.lower(): v for k, v in (extra or {}).items()}

        def frame_of(name: str) -> DataFrame | None:
            return more.get(name.lower(), self.db.lookup(name))

        return Queries(self.spark, frame_of, self.parameters, self.db.table_function, self.db.rowid, self.db.collation, self.db.state, self.db.functions)

    def run(self, statement: Any) -> DataFrame:
        if isinstance(statement, P.Select):
            q = self.queries()
            return q.run(q.select(statement))
        if isinstance(statement, P.Insert):
            return self.insert(statement)
        if isinstance(statement, P.Change):
            return self.delete(statement) if statement.sets is None else self.update(statement)
        return getattr(self, f"do_{statement.kind}")(**statement.parts) or self.empty()

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "changes bigint")

    # changes of rows

    def insert(self, s: P.Insert) -> DataFrame:
        t = self.db.table(s.table)
        schema = t.frame.schema
        columns = [self.column(t, c) for c in s.columns] if s.columns else [f.name for f in schema.fields if f.name not in t.generated]
        if s.rows is None:
            rows = self.spark.range(1).select()
        else:
            select = replace(s.rows, ctes=[*s.ctes, *s.rows.ctes]) if s.ctes else s.rows
            q = self.queries()
            made = q.select(select)
            if len(made.columns) != len(columns):
                raise P.SqlError(f"{len(made.columns)} values for {len(columns)} columns")
            rows = q.run(made).toDF(*columns)
        rows = self.converted(rows, schema)
        upsert = None
        for wanted, sets, where in s.upserts:
            keys = [self.column(t, c) for c in wanted] if wanted else list(t.key)
            upsert = (keys, None if sets is None else self.upserted(t, schema, sets), None if where is None else self.upsert_condition(t, schema, where))
        added = self.db.insert(s.table, rows, s.conflict, upsert=upsert)
        return self.returned(s.returning, s.table, added)

    def converted(self, rows: DataFrame, schema: T.StructType) -> DataFrame:
        """Rows with the affinities of the table's columns."""
        out = []
        for f in rows.schema.fields:
            target = schema[f.name].dataType
            own = Value(quoted(f.name), kind_of(f.dataType))
            out.append(self.stored(own, target).alias(f.name))
        return rows.select(*out)

    def stored(self, v: Value, target: T.DataType) -> Column:
        from quern.sql import expressions as E

        kind = kind_of(target)
        if v.kind == "other" or kind in ("other", "bool"):
            return F.expr(plain(v)).cast(target)
        made = {"integer": E.integer, "real": E.real, "text": E.text}.get(kind, lambda x: x)(v)
        return F.expr(plain(made)).cast(target)

    def column(self, t, name: str) -> str:
        found = next((c for c in t.frame.columns if c.lower() == name.lower()), None)
        if found is None and name.lower() in ("rowid", "_rowid_", "oid") and len(t.key) == 1:
            return t.key[0]
        if found is None:
            raise P.SqlError(f"no such column: {name}")
        return found

    def _upsert_scope(self, t, schema: T.StructType) -> Scope:
        entries = []
        for f in schema.fields:
            kind = kind_of(f.dataType)
            entries.append(Entry("\x01old", f.name, Value(quoted(f"old_{f.name}"), kind, kind)))
            entries.append(Entry("excluded", f.name, Value(quoted(f"new_{f.name}"), kind, kind)))
        return Scope([e for e in entries if e.table != "excluded"], Scope([e for e in entries if e.table == "excluded"]))

    def upserted(self, t, schema: T.StructType, sets: list) -> dict[str, Column]:
        compile_ = Expressions(self._upsert_scope(t, schema), self.queries())
        out = {}
        for names, x in sets:
            values = x[1] if x[0] == "row" else [x]
            for n, v in zip(names, values, strict=True):
                c = self.column(t, n)
                out[c] = self.stored(compile_(v), schema[c].dataType)
        return out

    def upsert_condition(self, t, schema: T.StructType, where: Any) -> Column:
        return F.expr(truth(Expressions(self._upsert_scope(t, schema), self.queries())(where)))

    def _head(self, q: Queries, s: P.Change) -> str:
        """The statement's WITH clause."""
        q.ctes.append({})
        return q.with_clause(P.Select([], s.ctes), None)

    def _affected(self, s: P.Change) -> tuple[Any, DataFrame, str]:
        """The table, its rows with __hit (whether the statement is about them), and the alias."""
        t = self.db.table(s.table)
        alias = s.alias or s.table
        q = self.queries()
        head = self._head(q, s)
        source = q.table(s.table, alias)
        condition = "true" if s.where is None else truth(Expressions(Scope(source.entries), q)(s.where))
        if s.limit is None and s.offset is None:
            return t, q.frame(f"{head}SELECT *, coalesce({condition}, false) AS `__hit` FROM {source.sql}"), alias
        terms = [q.order_term(o, Expressions(Scope(source.entries), q), []) for o in s.order] or ["1"]
        frame = q.frame(f"{head}SELECT *, row_number() OVER (ORDER BY NOT coalesce({condition}, false), {', '.join(terms)}) AS `__n`, coalesce({condition}, false) AS `__hit` FROM {source.sql}")
        first = int(q.count(s.offset)) if s.offset is not None and q.count(s.offset) != "ALL" else 0
        most = q.count(s.limit) if s.limit is not None else "ALL"
        within = F.col("__n") > first
        if most != "ALL":
            within &= F.col("__n") <= first + int(most)
        return t, frame.withColumn("__hit", F.col("__hit") & within).drop("__n"), alias

    def delete(self, s: P.Change) -> DataFrame:
        _, marked, _ = self._affected(s)
        gone = self.db.remove(s.table, marked)
        return self.returned(s.returning, s.table, gone)

    def update(self, s: P.Change) -> DataFrame:
        t = self.db.table(s.table)
        schema = t.frame.schema
        if s.source is not None:
            marked = self._from(s, t)
        else:
            _, marked, alias = self._affected(s)
            q = self.queries({alias: marked, s.table: marked})
            head = self._head(q, s)
            source = q.table(alias, alias)
            compile_ = Expressions(Scope(source.entries), q)
            new = self._assigned(s, t, compile_, q)
            texts = ["*", *(f"{_typed(v)} AS {quoted('__new_' + c)}" for c, v in new.items())]
            marked = q.frame(f"{head}SELECT {', '.join(texts)} FROM {source.sql}")
        sets = {c: self.stored(Value(quoted(f"__new_{c}"), kind_of(marked.schema[f"__new_{c}"].dataType)), schema[c].dataType) for c in (c[6:] for c in marked.columns if c.startswith("__new_"))}
        after = self.db.change(s.table, marked, sets, s.conflict)
        return self.returned(s.returning, s.table, after)

    def _assigned(self, s: P.Change, t, compile_: Expressions, q: Queries) -> dict[str, Value]:
        out = {}
        for names, x in s.sets:
            if len(names) == 1:
                out[self.column(t, names[0])] = compile_(x)
            elif x[0] == "row":
                out.update({self.column(t, n): compile_(v) for n, v in zip(names, x[1], strict=True)})
            else:  # a subquery: each column by itself
                for i, n in enumerate(names):
                    cores = [(op, replace(c, items=[c.items[i]])) for op, c in x[1].cores]
                    out[self.column(t, n)] = compile_(("scalar", replace(x[1], cores=cores)))
        return out

    def _from(self, s: P.Change, t) -> DataFrame:
        """UPDATE ... FROM: each row with the first match of the source."""
        alias = s.alias or s.table
        keyed = t.frame.withColumn("__id", F.monotonically_increasing_id() if not t.key else F.xxhash64(*t.key))
        from quern.sources.scratch import written

        keyed = keyed if t.key else written(keyed)
        q = self.queries({alias: keyed, s.table: keyed})
        head = self._head(q, s)
        own = q.table(alias, alias)
        other = q.source(s.source, None, own.entries)
        scope = Scope([*(e for e in own.entries if e.name != "__id"), *other.entries])
        compile_ = Expressions(scope, q)
        condition = "true" if s.where is None else truth(compile_(s.where))
        new = self._assigned(s, t, compile_, q)
        texts = [f"{quoted(alias)}.`__id` AS `__id`", *(f"{_typed(v)} AS {quoted('__new_' + c)}" for c, v in new.items())]
        found = q.frame(f"{head}SELECT {', '.join(texts)} FROM {own.sql}, {other.sql} WHERE {condition}")
        first = found.groupBy("__id").agg(F.min(F.struct(*(F.col(f"__new_{c}") for c in new))).alias("x")).select("__id", "x.*", F.lit(True).alias("__hit"))
        return keyed.join(first, "__id", "left").drop("__id").withColumn("__hit", F.coalesce("__hit", F.lit(False)))

    def returned(self, items: list, table: str, rows: DataFrame) -> DataFrame:
        if not items:
            return self.empty()
        q = self.queries({table: rows})
        return q.run(q.select(P.Select([(None, P.Core(items=items, source=("table", table, None)))])))

    # definitions

    def do_create_table(self, name, columns, keys, uniques, checks, foreign, if_not_exists, options) -> None:
        if if_not_exists and self.db.lookup(name) is not None:
            return
        schema = T.StructType([T.StructField(c.name, TYPES[affinity_of(c.type)] if c.type else T.StringType()) for c in columns])
        frame = self.spark.createDataFrame([], schema)
        scope = Scope([Entry(name, f.name, Value(quoted(f.name), kind_of(f.dataType), kind_of(f.dataType), next(c.collate for c in columns if c.name == f.name))) for f in schema.fields])
        compile_ = Expressions(scope, self.queries())
        key = tuple(keys) or tuple(c.name for c in columns if c.key)
        all_checks = [c.check for c in columns if c.check is not None] + checks
        self.db.create(
            name, frame, key=key,
            not_null=tuple(c.name for c in columns if c.not_null or (c.name in key and ("STRICT" in options or "WITHOUT ROWID" in options))),
            unique=tuple([(c.name,) for c in columns if c.unique] + [tuple(u) for u in uniques]),
            checks={f"check{i + 1}": F.expr(truth(compile_(x))) for i, x in enumerate(all_checks)},
            defaults={c.name: self.stored(compile_(c.default), schema[c.name].dataType) for c in columns if c.default is not None},
            generated={c.name: self.stored(compile_(c.generated), schema[c.name].dataType) for c in columns if c.generated is not None},
            foreign=tuple(self.foreign_key(x) for x in foreign),
            collations={c.name: c.collate for c in columns if c.collate},
            counted=next((c.name for c in columns if c.key and affinity_of(c.type) == "integer"), None),
            autoincrement=any(c.autoincrement for c in columns),
        )

    def foreign_key(self, parts: tuple):
        from quern.operators.catalog import ForeignKey

        columns, parent, targets, on_delete, on_update, deferred = parts
        target = targets[0] if targets else (self.db.table(parent).key or ("id",))[0] if self.db.lookup(parent) is not None else "id"
        return ForeignKey(columns[0], parent, target, on_delete, on_update, deferred)

    def do_create_virtual(self, name, module, columns, if_not_exists) -> None:
        """fts5: a table of texts, which MATCH searches; rtree: an id and pairs of bounds, rtree_i32 with whole ones."""
        if if_not_exists and self.db.lookup(name) is not None:
            return
        if module == "fts5":
            schema = T.StructType([T.StructField(c.split()[0], T.StringType()) for c in columns])
        elif module in ("rtree", "rtree_i32"):
            number = T.DoubleType() if module == "rtree" else T.LongType()
            schema = T.StructType([T.StructField(c.split()[0], number if i else T.LongType()) for i, c in enumerate(columns)])
        else:
            raise P.SqlError(f"no such module: {module}")
        self.db.create(name, self.spark.createDataFrame([], schema), key=() if module == "fts5" else (schema[0].name,), counted=None if module == "fts5" else schema[0].name)

    def do_attach(self, path, name) -> None:
        self.db.attached[name.lower()] = path

    def do_detach(self, name) -> None:
        if self.db.attached.pop(name.lower(), None) is None:
            raise P.SqlError(f"no such database: {name}")

    def do_create_table_as(self, name, select, if_not_exists) -> None:
        if not (if_not_exists and self.db.lookup(name) is not None):
            self.db.create(name, self.run(select))

    def do_create_view(self, name, columns, select, if_not_exists) -> None:
        if not (if_not_exists and self.db.lookup(name) is not None):
            made = self.run(select)
            self.db.create_view(name, made.toDF(*columns) if columns else made)

    def do_create_index(self, name, table, columns, unique, where, if_not_exists) -> None:
        if if_not_exists and any(name in t.indexes for t in self.db.tables.values()):
            return
        plain_columns = tuple(x[1][-1] for x, _, _ in columns if x[0] == "col")
        self.db.create_index(name, self.db.name(table), plain_columns, unique and len(plain_columns) == len(columns) and where is None)

    def do_create_trigger(self, name, time, event, columns, table, when, body, if_not_exists) -> None:
        self.db.create_trigger(name, time, event, columns, table, when, body, if_not_exists)

    def do_drop(self, what, name, if_exists) -> None:
        self.db.drop(name, if_exists)

    def do_rename(self, name, to) -> None:
        self.db.rename(self.db.name(name), to)

    def do_rename_column(self, name, old, new) -> None:
        self.db.rename_column(self.db.name(name), old, new)

    def do_add_column(self, name, column, foreign) -> None:
        kind = TYPES[affinity_of(column.type)] if column.type else T.StringType()
        default = None if column.default is None else self.stored(Expressions(Scope([]), self.queries())(column.default), kind)
        self.db.add_column(self.db.name(name), column.name, kind, default)

    def do_drop_column(self, name, column) -> None:
        self.db.drop_column(self.db.name(name), column)

    # the rest

    def do_pragma(self, name, value) -> DataFrame:
        if isinstance(value, str) and name in self.db.settings:
            value = {"on": 1, "true": 1, "yes": 1, "off": 0, "false": 0, "no": 0}.get(value.lower(), value)
        return self.db.pragma(name, value)

    def do_explain(self, plan, statement) -> DataFrame:
        from quern.operators.catalog import explain_query_plan

        return explain_query_plan(self.run(statement) if isinstance(statement, P.Select) else self.db.dry(lambda: self.run(statement)))

    def do_savepoint(self, name) -> None:
        self.db.savepoint(name)

    def do_release(self, name) -> None:
        self.db.release(name)

    def do_rollback_to(self, name) -> None:
        self.db.rollback_to(name)

    def do_begin(self) -> None:
        self.db.begin()

    def do_commit(self) -> None:
        self.db.commit()

    def do_rollback(self) -> None:
        self.db.rollback()

    def do_analyze(self, name) -> None:
        for n in [name] if name else list(self.db.tables):
            self.db.analyze(self.db.name(n))

    def do_reindex(self, name) -> None:
        """Frames have no index to rebuild."""

    def do_vacuum(self, name) -> None:
        """Frames have no pages to give back."""


def _typed(v: Value) -> str:
    """A value's text; a null has a type, as it becomes a column."""
    return "CAST(NULL AS STRING)" if v.sql == "NULL" else plain(v)
