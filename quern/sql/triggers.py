"""Triggers: the statements of a body run once over all rows that a change made, not once a row.

A body's INSERT takes its values or query from the changed rows, whose columns are new.x and old.x. A body
that updates or deletes by values of changed rows runs if no row would be met twice.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from quern.sql import parser as P
from quern.sql.expressions import Entry, Scope, Value, kind_of, quoted, truth
from quern.sql.queries import Queries, Source
from quern.sql.statements import Runner


class Changed(Queries):
    """Queries that may also read the changed rows."""

    def __init__(self, *args, changed: DataFrame, **more) -> None:
        super().__init__(*args, **more)
        self.changed = changed

    def rows(self) -> Source:
        entries = []
        for f in self.changed.schema.fields:
            side, _, column = f.name.partition("_")
            kind = kind_of(f.dataType)
            entries.append(Entry(side, column, Value(f"`__changed`.{quoted(f.name)}", kind, kind)))
        return Source(f"{self.place(self.changed)} AS `__changed`", entries)

    def source(self, node, outer, before=None) -> Source:
        if node[0] == "table" and node[1] == "\x01changed":
            return self.rows()
        return super().source(node, outer, before)


def _over_changed(select: P.Select) -> P.Select:
    """A query of a body as one over the changed rows."""
    cores = []
    for op, c in select.cores:
        changed = ("table", "\x01changed", None)
        if c.rows is not None:
            if len(c.rows) > 1:
                cores += [(op if i == 0 else "UNION ALL", P.Core(items=[(x, None, f"c{k}") for k, x in enumerate(r)], source=changed)) for i, r in enumerate(c.rows)]
                continue
            c = P.Core(items=[(x, None, f"c{k}") for k, x in enumerate(c.rows[0])], source=changed)
        elif c.source is None:
            c = replace(c, source=changed)
        else:
            c = replace(c, source=("join", "CROSS", False, changed, c.source, None, None))
        cores.append((op, c))
    return replace(select, cores=cores)


def fire(db, trigger, changed: DataFrame) -> None:
    runner = Runner(db)

    def queries(extra: dict[str, DataFrame] | None = None) -> Queries:
        more = {k.lower(): v for k, v in (extra or {}).items()}
        return Changed(db.spark, lambda name: more.get(name.lower(), db.lookup(name)), {}, db.table_function, db.rowid, db.collation, db.state, db.functions, changed=changed)

    runner.queries = queries
    if trigger.when is not None:
        q = queries()
        source = q.rows()
        changed = q.frame(f"SELECT * FROM {source.sql} WHERE {truth(q.expressions(Scope(source.entries), P.Core())(trigger.when))}")
        runner.queries = lambda extra=None: _with(queries(extra), changed)
    for statement in trigger.body:
        if isinstance(statement, P.Insert) and statement.rows is not None:
            runner.insert(replace(statement, rows=_over_changed(statement.rows)))
        elif isinstance(statement, P.Select):
            continue
        elif isinstance(statement, P.Change) and statement.sets is not None and statement.source is None:
            if changed.count() > 1:
                raise P.SqlError("a trigger's UPDATE runs for one changed row at a time")
            runner.update(replace(statement, source=("table", "\x01changed", None)))
        else:
            raise P.SqlError("a trigger's body may insert, update or select")


def _with(q: Changed, changed: DataFrame) -> Changed:
    q.changed = changed
    return q
