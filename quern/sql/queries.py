"""SELECT statements of the dialect as Spark SQL: names, stars, joins, groups, windows, compounds."""

from __future__ import annotations

import copy
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quern.sql import calls
from quern.sql.expressions import Entry, Expressions, Scope, Value, _collated, integer, kind_of, literal, number, plain, quoted, real, text, text_of, truth
from quern.sql.parser import Call, Core, Select, SqlError, Window


@dataclass
class Output:
    name: str
    value: Value  # its sql is the column's name


@dataclass
class Query:
    sql: str
    columns: list[Output]
    single: bool = False  # one row at most, by its form

    def first(self) -> str:
        """As a scalar: the first column of the first row."""
        own = f"SELECT {quoted(self.columns[0].name)} FROM ({self.sql})" if len(self.columns) > 1 else self.sql
        return own if self.single else f"{own} LIMIT 1" if not re.search(r"LIMIT \S+(?: OFFSET \S+)?$", own) else own


@dataclass
class Source:
    sql: str
    entries: list[Entry]
    extra: list[str] = field(default_factory=list)


class Queries:
    """Compiles the queries of one statement; frames are put in by ``run``."""

    def __init__(self, spark: SparkSession, frame_of: Callable[[str], DataFrame | None], parameters: dict[str, Any] | None = None, function_of: Callable | None = None, rowid_of: Callable[[str], str | None] = lambda name: None, collation_of: Callable[[str, str], str | None] = lambda t, c: None, state_of: Callable[[str], Any] | None = None, functions: dict[str, str] | None = None) -> None:
        self.spark, self.frame_of, self.parameters, self.function_of, self.rowid_of, self.collation_of, self.state_of = spark, frame_of, parameters or {}, function_of, rowid_of, collation_of, state_of
        self.functions = functions or {}
        self.frames: dict[str, DataFrame] = {}
        self.ctes: list[dict[str, Any]] = []
        self.made = 0

    def parameter(self, name: str) -> Any:
        for key in (name, f"p{name}"):
            if key in self.parameters:
                return self.parameters[key]
        raise SqlError(f"no value for parameter {name}")

    def run(self, query: Query) -> DataFrame:
        return self.frame(query.sql)

    def frame(self, sql: str) -> DataFrame:
        used = {n: f for n, f in self.frames.items() if f"\x00{n}\x00" in sql}
        if not used:
            return self.spark.sql(sql)
        # with frames, Spark takes braces for their places
        body = sql.replace("{", "{{").replace("}", "}}")
        return self.spark.sql(re.sub("\x00(\\w+)\x00", r"{\1}", body), **used)

    def fresh(self, prefix: str) -> str:
        self.made += 1
        return f"__{prefix}{self.made}"

    def place(self, df: DataFrame) -> str:
        """A frame's stand-in in the text."""
        name = next((n for n, f in self.frames.items() if f is df), None)
        if name is None:
            name = f"q{len(self.frames)}"
            self.frames[name] = df
        return f"\x00{name}\x00"

    # queries

    def select(self, s: Select, outer: Scope | None = None) -> Query:
        self.ctes.append({})
        try:
            head = self.with_clause(s, outer)
            made = self.compound(s, outer)
            return replace(made, sql=head + made.sql)
        finally:
            self.ctes.pop()

    def with_clause(self, s: Select, outer: Scope | None) -> str:
        parts, recursive = [], False
        for name, columns, body in s.ctes:
            if s.recursive and len(body.cores) > 1 and _mentions(body.cores[-1][1], name):
                made, text_, again = self.recursive_cte(name, columns, body, outer)
                recursive |= again
            else:
                made = self.select(body, outer)
                text_ = made.sql
            names = columns or [o.name for o in made.columns]
            self.ctes[-1][name.lower()] = [Output(n, replace(o.value, sql=quoted(n))) for n, o in zip(names, made.columns, strict=True)]
            if isinstance(text_, DataFrame):
                self.ctes[-1][name.lower()] = (text_, self.ctes[-1][name.lower()])
            else:
                parts.append(f"{quoted(name)} ({', '.join(map(quoted, names))}) AS ({text_})")
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} " if parts else ""

    def recursive_cte(self, name: str, columns: list[str] | None, body: Select, outer: Scope | None) -> tuple[Query, Any, bool]:
        """UNION ALL runs as Spark's recursion; UNION by generations, each without the rows that came before."""
        seed = self.select(Select(body.cores[:-1]), outer)
        names = columns or [o.name for o in seed.columns]
        own = [Output(n, Value(quoted(n), o.value.kind)) for n, o in zip(names, seed.columns, strict=True)]
        op, step = body.cores[-1]
        kinds = [o.value.kind for o in seed.columns]
        if op == "UNION ALL":
            self.ctes[-1][name.lower()] = own
            made = self.core(step, outer)
            cast = {"integer": "BIGINT", "real": "DOUBLE", "text": "STRING"}
            left = f"SELECT {', '.join(f'CAST({quoted(o.name)} AS {cast[k]}) AS {quoted(n)}' if k in cast else f'{quoted(o.name)} AS {quoted(n)}' for o, n, k in zip(_unique(seed), names, kinds, strict=True))} FROM ({_renamed(seed)})"
            tail = ""
            if body.limit is not None:
                tail = f" LIMIT {self.count(body.limit)}"
            return seed, f"{left} UNION ALL ({made.sql}){tail}", True
        from quern.operators.relations import recursive_union

        first = self.run(seed).toDF(*names)

        def follow(df: DataFrame) -> DataFrame:
            self.ctes[-1][name.lower()] = (df, own)
            made = self.run(self.core(step, outer)).toDF(*names)
            return made.select(*(made[n].cast(first.schema[n].dataType).alias(n) for n in names))

        return seed, recursive_union(first, follow), False

    def count(self, node: Any) -> str:
        """LIMIT and OFFSET: a constant; null or negative is none."""
        v = integer(Expressions(Scope([]), self)(node))
        if not v.known:
            raise SqlError("LIMIT must be a constant")
        return "ALL" if v.constant is None or v.constant < 0 else str(v.constant)

    def tail(self, s: Select) -> str:
        out = ""
        if s.limit is not None and (n := self.count(s.limit)) != "ALL":
            out += f" LIMIT {n}"
        if s.offset is not None and (n := self.count(s.offset)) not in ("ALL", "0"):
            out += f" OFFSET {n}"
        return out

    def compound(self, s: Select, outer: Scope | None) -> Query:
        if len(s.cores) == 1:
            made = self.core(s.cores[0][1], outer, s.order)
            return replace(made, sql=made.sql + self.tail(s), single=made.single or s.limit == ("lit", 1))
        made = [self.core(c, outer) for _, c in s.cores]
        if len({len(m.columns) for m in made}) > 1:
            raise SqlError("SELECTs to the left and right do not have the same number of result columns")
        names = [o.name for o in made[0].columns]
        kinds = []
        for parts in zip(*(m.columns for m in made), strict=True):
            found = {p.value.kind for p in parts} - {"null"}
            kinds.append(found.pop() if len(found) == 1 else "real" if found <= {"integer", "real", "bool"} and found else "text" if found else "null")
        cast = {"integer": "BIGINT", "real": "DOUBLE", "text": "STRING"}

        def typed(m: Query) -> str:
            """The part with the kinds that all parts share."""
            if all(o.value.kind == k for o, k in zip(m.columns, kinds, strict=True)):
                return m.sql
            own = _unique(m)
            return "SELECT " + ", ".join(f"CAST({quoted(o.name)} AS {cast[k]}) AS {quoted(n)}" if k in cast else f"{quoted(o.name)} AS {quoted(n)}" for o, k, n in zip(own, kinds, names, strict=True)) + f" FROM ({_renamed(m)})"

        sql = f"({typed(made[0])})"
        for (op, _), m in zip(s.cores[1:], made[1:], strict=True):
            sql = f"({sql} {op} ({typed(m)}))"
        columns = [Output(n, Value(quoted(n), k)) for n, k in zip(names, kinds, strict=True)]
        if s.order:
            scope = Scope([Entry("", o.name, o.value) for o in columns])
            terms = [self.order_term(t, Expressions(scope, self), columns) for t in s.order]
            sql = f"SELECT * FROM {sql} ORDER BY {', '.join(terms)}"
        elif s.limit is not None or s.offset is not None:
            sql = f"SELECT * FROM {sql}"
        return Query(sql + self.tail(s), columns)

    def order_term(self, term: tuple, compile_: Expressions, columns: list[Output]) -> str:
        x, down, nulls = term
        node, name = (x[1], x[2]) if x[0] == "collate" else (x, None)
        if node[0] == "lit" and isinstance(node[1], int) and not isinstance(node[1], bool):
            if not 1 <= node[1] <= len(columns):
                raise SqlError("ORDER BY term out of range")
            place = node[1] - 1
        else:
            place = next((i for i, o in enumerate(columns) if node[0] == "col" and len(node[1]) == 1 and o.name.lower() == node[1][0].lower()), None)
        v = compile_(node) if place is None else columns[place].value
        if place is not None and (name or v.collation) in (None, "BINARY", "JSON"):
            # by place, as names needn't be unique
            return f"{place + 1}" + (" DESC" if down else "") + (f" NULLS {nulls}" if nulls else "")
        v = _collated(v, name or v.collation)
        return plain(v) + (" DESC" if down else "") + (f" NULLS {nulls}" if nulls else "")

    # one SELECT

    def core(self, c: Core, outer: Scope | None, order: list | None = None) -> Query:
        order = order or []
        if c.rows is not None:
            return self.values(c.rows, outer)
        c = _bound(c)
        source = self.source(c.source, outer) if c.source is not None else Source("", [])
        where = None
        scope = Scope(source.entries, outer)
        if c.where is not None:
            compile_ = self.expressions(scope, c)
            scope.aliases = {alias.lower(): lambda node=node: compile_(node) for node, alias, _ in c.items if alias}
            where = truth(compile_(c.where))
            scope.aliases = None
        calls_ = [x for x in _calls([i[0] for i in c.items] + [c.having] + [o[0] for o in order])]
        grouped = bool(c.group) or c.having is not None or any(x.over is None and calls.is_aggregate(x) for x in calls_)
        special = [x for x in calls_ if x.over is not None and self.needs_numbers(x, c)]
        numbers: dict[int, tuple[str, str]] = {}
        if special and not grouped:
            source, where, numbers = self.numbered(source, where, special, c, outer)
            scope = Scope(source.entries, outer)
        compile_ = self.expressions(scope, c, numbers)
        items = self.items(c, source)
        groups: list[str] = []
        if grouped:
            groups = self.groups(c, items, scope, compile_)
            compile_.grouped = dict(self._terms)
            compile_.bare = self.bare(calls_, compile_)
        columns, texts = [], []
        for node, name, value in items:
            v = value or compile_(node)
            sql = f"CAST({v.sql} AS BIGINT)" if v.kind == "bool" else v.sql
            sql = "CAST(NULL AS STRING)" if v.sql == "NULL" else sql
            texts.append(f"{sql} AS {quoted(name)}")
            kind = "integer" if v.kind == "bool" else v.kind
            columns.append(Output(name, Value(quoted(name), kind, v.affinity, v.collation)))
        having = ""
        scope.aliases = {o.name.lower(): Value(o.value.sql, o.value.kind) for o in columns}
        if c.having is not None:
            own = {name.lower(): value or compile_(node) for node, name, value in items}
            scope.aliases = own
            having = f" HAVING {truth(compile_(c.having))}"
            scope.aliases = {o.name.lower(): o.value for o in columns}
        sql = f"SELECT {'DISTINCT ' if c.distinct else ''}{', '.join(texts)}"
        sql += f" FROM {source.sql}" if source.sql else ""
        sql += f" WHERE {where}" if where else ""
        if grouped and groups:
            sql += f" GROUP BY {', '.join(groups)}"
        sql += having
        if order and c.distinct:
            # only the result's columns are left to order by
            own = Expressions(Scope([Entry("", o.name, o.value) for o in columns], outer), self)
            sql = f"SELECT * FROM ({sql}) ORDER BY {', '.join(self.order_term(t, own, columns) for t in order)}"
        elif order:
            terms = [self.order_term(t, compile_, columns) for t in order]
            if grouped and any(not re.match(r"\d+\b", t) for t in terms):
                # aggregates to order by are columns of the query within
                inner = [re.sub(r" AS `(?:[^`]|``)*`$", f" AS c{i}", x) for i, x in enumerate(texts)]
                outside = []
                for i, t in enumerate(terms):
                    place, tail = re.match(r"(\d+)\b(.*)", t, re.DOTALL).groups() if re.match(r"\d+\b", t) else (None, "")
                    if place is None:
                        body, tail = re.match(r"(.*?)((?: DESC)?(?: NULLS (?:FIRST|LAST))?)$", t, re.DOTALL).groups()
                        inner.append(f"{body} AS o{i}")
                    outside.append((f"c{int(place) - 1}" if place else f"o{i}") + tail)
                sql = f"SELECT {', '.join(inner)}{sql[len('SELECT ') + len(', '.join(texts)) :]}"
                sql = f"SELECT {', '.join(f'c{i} AS {quoted(o.name)}' for i, o in enumerate(columns))} FROM ({sql}) ORDER BY {', '.join(outside)}"
            else:
                sql += f" ORDER BY {', '.join(terms)}"
        return Query(sql, columns, single=grouped and not c.group)

    def expressions(self, scope: Scope, c: Core, numbers: dict | None = None) -> Expressions:
        return Expressions(scope, self, lambda call, compile_: self.windowed(call, compile_, c, numbers or {}))

    def items(self, c: Core, source: Source) -> list[tuple[Any, str, Value | None]]:
        """The result columns: node, name and, for those of a star, the value."""
        out: list[tuple[Any, str, Value | None]] = []
        for node, alias, written in c.items:
            if node[0] != "star":
                name = alias or (node[1][-1] if node[0] == "col" else written)
                if node[0] == "col" and not alias:
                    known = [e.name for e in source.entries if e.name.lower() == name.lower()]
                    name = known[0] if known else name
                out.append((node, name, None))
                continue
            found = [e for e in source.entries if (node[1] is None and not (e.table and e.name.lower() in self._hidden(source) and not e.merged)) or (node[1] is not None and e.table.lower() == node[1].lower() and not e.merged)]
            found = [e for e in found if e.table != "\x01rowid"]
            if not found:
                raise SqlError(f"no such table: {node[1]}" if node[1] else "no tables specified")
            out += [(("col", (e.name,), False), e.name, e.value) for e in found]
        return out

    @staticmethod
    def _hidden(source: Source) -> set[str]:
        return {e.name.lower() for e in source.entries if e.merged}

    def groups(self, c: Core, items: list, scope: Scope, compile_: Expressions) -> list[str]:
        terms: dict[str, Value] = {}
        for node in c.group:
            collation = node[2] if node[0] == "collate" else None
            node = node[1] if node[0] == "collate" else node
            if node[0] == "lit" and isinstance(node[1], int):
                if not 1 <= node[1] <= len(items):
                    raise SqlError("GROUP BY term out of range")
                inner, _, value = items[node[1] - 1]
                v = value or compile_(inner)
            elif node[0] == "col" and scope.find(node[1]) is None and any(n.lower() == node[1][-1].lower() for _, n, _ in items):
                inner, _, value = next(i for i in items if i[1].lower() == node[1][-1].lower())
                v = value or compile_(inner)
            else:
                v = compile_(node)
            name = collation or v.collation
            if name not in (None, "BINARY", "JSON"):
                key = _collated(v, name)
                terms[key.sql] = key
                continue
            terms[v.sql] = v
        self._terms = terms
        # a constant would be read as a place in the list
        return [plain(v) if not v.known else f"coalesce({plain(v)})" for v in terms.values()]

    def bare(self, found: list[Call], compile_: Expressions) -> Callable[[str], str]:
        """How columns outside of aggregates are read: on the row of the only min() or max(), else of any."""
        extremes = [x for x in found if x.over is None and x.name in ("min", "max") and len(x.args) == 1]
        if len({repr(x) for x in extremes}) == 1 and extremes[0].where is None:
            c = extremes[0]
            compile_.in_aggregate = True
            by = plain(compile_(c.args[0]))
            compile_.in_aggregate = False
            return lambda sql: f"{c.name}_by({sql}, {by})"
        return lambda sql: f"any_value({sql})"

    def values(self, rows: list[list], outer: Scope | None) -> Query:
        compile_ = Expressions(Scope([], outer), self)
        made = [compile_.all(r) for r in rows]
        if len({len(r) for r in made}) > 1:
            raise SqlError("all VALUES must have the same number of terms")
        kinds, texts = [], []
        for column in zip(*made, strict=True):
            found = {v.kind for v in column} - {"null"}
            kind = found.pop() if len(found) == 1 else "real" if found <= {"integer", "real", "bool"} and found else "text"
            kinds.append("integer" if kind == "bool" else kind)
            convert = {"integer": plain, "real": lambda v: real(v).sql, "text": lambda v: text(v).sql if v.kind != "null" else v.sql}.get(kind, plain)
            cast = {"integer": "BIGINT", "real": "DOUBLE", "text": "STRING", "bool": "BIGINT"}.get(kind)
            texts.append([f"CAST({convert(v)} AS {cast})" if cast else convert(v) for v in column])
        names = [f"column{i + 1}" for i in range(len(kinds))]
        body = ", ".join("(" + ", ".join(r) + ")" for r in zip(*texts, strict=True))
        return Query(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})", [Output(n, Value(quoted(n), k)) for n, k in zip(names, kinds, strict=True)])

    # FROM

    def source(self, node: Any, outer: Scope | None, before: list[Entry] | None = None) -> Source:
        kind = node[0]
        if kind == "table":
            return self.table(node[1], node[2] or node[1])
        if kind == "query":
            made = self.select(node[1], outer)
            alias = node[2] or self.fresh("t")
            return Source(f"({_renamed(made)}) AS {quoted(alias)}", [Entry(alias, o.name, replace(o.value, sql=f"{quoted(alias)}.{quoted(u.name)}")) for o, u in zip(made.columns, _unique(made), strict=True)])
        if kind == "function":
            return self.table_function(node, outer, before or [])
        return self.join(node, outer, before)

    def table(self, name: str, alias: str) -> Source:
        for level in reversed(self.ctes):
            if name.lower() in level:
                own = level[name.lower()]
                sql, own = (self.place(own[0]), own[1]) if isinstance(own, tuple) else (quoted(name), own)
                return Source(f"{sql} AS {quoted(alias)}", [Entry(alias, o.name, replace(o.value, sql=f"{quoted(alias)}.{quoted(o.name)}")) for o in own])
        df = self.frame_of(name)
        if df is None:
            raise SqlError(f"no such table: {name}")
        entries = []
        for f in df.schema.fields:
            kind = kind_of(f.dataType)
            affinity = kind if kind in ("integer", "real", "text") else None
            entries.append(Entry(alias, f.name, Value(f"{quoted(alias)}.{quoted(f.name)}", kind, affinity, self.collation_of(name, f.name))))
        key = self.rowid_of(name)
        if key:
            for n in ("rowid", "_rowid_", "oid"):
                if all(e.name.lower() != n for e in entries):
                    entries.append(Entry("\x01rowid", n, next(e.value for e in entries if e.name == key)))
        return Source(f"{self.place(df)} AS {quoted(alias)}", entries)

    def table_function(self, node: tuple, outer: Scope | None, before: list[Entry]) -> Source:
        _, name, args, alias = node
        alias = alias or name
        compile_ = Expressions(Scope(before, outer), self)
        xs = compile_.all(args)
        if name == "generate_series":
            start, stop, step = (integer(x) for x in (*xs, literal(4294967295), literal(1))[: max(3, len(xs))][:1] + tuple((*xs[1:], *(literal(4294967295), literal(1))[len(xs) - 1 :])[:2]))
            by = f"CASE WHEN {step.sql} = 0L THEN 1L ELSE {step.sql} END"
            inner = f"SELECT explode(CASE WHEN sign({by}) * sign({stop.sql} - {start.sql}) >= 0 THEN sequence({start.sql}, {stop.sql}, {by}) ELSE CAST(array() AS ARRAY<BIGINT>) END) AS value"
            own = [("value", "integer")]
        elif name in ("json_each", "json_tree", "jsonb_each", "jsonb_tree"):
            where = text(xs[1]).sql if len(xs) > 1 else "'$'"
            inner = f"SELECT * FROM quern_{name.replace('jsonb', 'json')}({text(xs[0]).sql}, {where})"
            own = [("key", "any"), ("value", "any"), ("type", "text"), ("atom", "any"), ("id", "integer"), ("parent", "integer"), ("fullkey", "text"), ("path", "text")]
        else:
            df = self.function_of(name, [x.constant if x.known else None for x in xs]) if self.function_of else None
            if df is None:
                raise SqlError(f"no such table: {name}")
            inner, own = f"SELECT * FROM {self.place(df)}", [(f.name, kind_of(f.dataType)) for f in df.schema.fields]
        entries = [Entry(alias, n, Value(f"{quoted(alias)}.{quoted(n)}", k)) for n, k in own]
        lateral = "LATERAL " if before else ""
        return Source(f"{lateral}({inner}) AS {quoted(alias)}", entries)

    def join(self, node: tuple, outer: Scope | None, before: list[Entry] | None) -> Source:
        _, how, natural, left_node, right_node, on, using = node
        left = self.source(left_node, outer, before)
        right = self.source(right_node, outer, left.entries)
        mine = [e for e in left.entries if e.table != "\x01rowid"]
        theirs = [e for e in right.entries if e.table != "\x01rowid"]
        if natural:
            names = {e.name.lower() for e in theirs}
            using = list(dict.fromkeys(e.name for e in mine if e.name.lower() in names))
        if using:
            merged = []
            for n in using:
                own = next((e for e in mine if e.name.lower() == n.lower()), None)
                if own is None or all(e.name.lower() != n.lower() for e in theirs):
                    raise SqlError(f"cannot join using column {n} - column not present in both tables")
                merged.append(Entry("", own.name, Value(quoted(own.name), own.value.kind, own.value.affinity, own.value.collation), merged=True))
            word = "INNER" if how == "CROSS" else how
            rest = [e for e in left.entries if not (e.merged and e.name.lower() in {n.lower() for n in using})]
            return Source(f"{left.sql} {word} JOIN {right.sql} USING ({', '.join(quoted(m.name) for m in merged)})", merged + rest + right.entries)
        entries = left.entries + right.entries
        if on is not None:
            condition = truth(Expressions(Scope(entries, outer), self)(on))
            return Source(f"{left.sql} {'INNER' if how == 'CROSS' else how} JOIN {right.sql} ON {condition}", entries)
        if how in ("LEFT", "RIGHT", "FULL"):
            return Source(f"{left.sql} {how} JOIN {right.sql} ON true", entries)
        return Source(f"{left.sql} CROSS JOIN {right.sql}", entries)

    # windows

    def resolved(self, over: Window | str, c: Core) -> Window:
        """A window with what it takes from a named one."""
        if isinstance(over, str):
            if over.lower() not in c.windows:
                raise SqlError(f"no such window: {over}")
            return self.resolved(c.windows[over.lower()], c)
        if over.base is None:
            return over
        base = self.resolved(over.base, c)
        return Window(None, base.partition or over.partition, base.order or over.order, over.frame or base.frame)

    def needs_numbers(self, x: Call, c: Core) -> bool:
        w = self.resolved(x.over, c)
        return w.frame is not None and (w.frame[0] == "GROUPS" or w.frame[3] != "NO OTHERS") or x.distinct or x.name in ("lag", "lead") and len(x.args) > 1 and x.args[1][0] != "lit"

    def numbered(self, source: Source, where: str | None, special: list[Call], c: Core, outer: Scope | None) -> tuple[Source, None, dict]:
        """The source with the numbers of rows and peer groups in each special window; its columns get new names."""
        compile_ = Expressions(Scope(source.entries, outer), self)
        alias = self.fresh("n")
        names = {e.value.sql: f"c{i}" for i, e in enumerate(source.entries)}
        texts = [f"{sql} AS {n}" for sql, n in names.items()]
        numbers: dict[Any, tuple[str, str]] = {}
        known: dict[str, tuple[str, str]] = {}
        for x in special:
            w = self.resolved(x.over, c)
            spec = self.spec(Window(None, w.partition, w.order), compile_)
            if spec not in known:
                row, group = f"r{len(known)}", f"g{len(known)}"
                texts += [f"row_number() OVER ({spec}) AS {row}", f"dense_rank() OVER ({spec}) AS {group}"]
                known[spec] = (f"{alias}.{row}", f"{alias}.{group}")
            numbers[id(x)] = known[spec]
            if x.distinct and self.from_start(w) and x.name in ("count", "sum", "avg", "total") and x.where is None:
                value = plain(compile_(x.args[0]))
                flag = f"f{len(numbers)}"
                first = self.spec(Window(None, [*w.partition, x.args[0]], w.order), compile_)
                texts.append(f"({value} IS NOT NULL AND row_number() OVER ({first}) = 1) AS {flag}")
                numbers[id(x)] = (*known[spec], f"{alias}.{flag}")
        sql = f"(SELECT {', '.join(texts)} FROM {source.sql}{f' WHERE {where}' if where else ''}) AS {alias}"
        entries = [replace(e, value=replace(e.value, sql=f"{alias}.{names[e.value.sql]}")) for e in source.entries]
        return Source(sql, entries), None, numbers

    @staticmethod
    def from_start(w: Window) -> bool:
        """Whether the frame begins with the partition and leaves out no row."""
        return w.frame is None or w.frame[1][0] == "FIRST" and w.frame[3] == "NO OTHERS" and w.frame[0] != "GROUPS"

    def spec(self, w: Window, compile_: Expressions, order: str | None = None) -> str:
        """PARTITION BY and ORDER BY; without an order, all rows are peers."""
        parts = [f"PARTITION BY {', '.join(plain(compile_(p)) for p in w.partition)}"] if w.partition else []
        terms = [self.order_term(t, compile_, []) for t in w.order]
        return " ".join([*parts, f"ORDER BY {order or ', '.join(terms) or '1'}"])

    def bounds(self, frame: tuple, compile_: Expressions) -> str:
        def one(b: tuple) -> str:
            kind, n = b
            if kind in ("FIRST", "LAST"):
                return f"UNBOUNDED {'PRECEDING' if kind == 'FIRST' else 'FOLLOWING'}"
            if kind == "CURRENT":
                return "CURRENT ROW"
            v = number(compile_(n))
            if not v.known or v.constant is None or v.constant < 0:
                raise SqlError("frame offset must be a non-negative number")
            size = text_of(v.constant) if isinstance(v.constant, int) else f"{v.constant}D"
            return f"{size} {'PRECEDING' if kind == 'BEFORE' else 'FOLLOWING'}"

        return f"BETWEEN {one(frame[1])} AND {one(frame[2])}"

    def windowed(self, x: Call, compile_: Expressions, c: Core, numbers: dict) -> Value:
        w = self.resolved(x.over, c)
        if id(x) in numbers and len(numbers[id(x)]) == 3:
            # each value counts on its first row
            flagged = ("case", None, [(("raw", numbers[id(x)][2]), x.args[0])], None)
            own = copy.copy(x)
            own.distinct, own.args = False, [flagged]
            return self.windowed(own, compile_, c, {})
        if id(x) in numbers:
            return self.listed(x, w, compile_, *numbers[id(x)])
        ranking = x.name in calls.RANKING
        if not ranking and not calls.is_aggregate(x):
            raise SqlError(f"{x.name}() may not be used as a window function")
        spec = self.spec(w, compile_)
        frame = w.frame
        if x.name in ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead"):
            frame = None
        if frame is not None:
            kind = frame[0]
            spec += f" {kind} {self.bounds(frame, compile_)}"
        elif not w.order and x.name not in ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead"):
            spec += " ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
        if ranking:
            return self.ranked(x, compile_, spec)
        own = copy.copy(x)
        own.over = None
        if own.name in ("group_concat", "string_agg"):
            v = compile_.all(own.args)
            body = f"collect_list({_when(x, compile_, text(v[0]).sql)}) OVER ({spec})"
            return Value(f"CASE WHEN size({body}) > 0 THEN array_join({body}, {text(v[1]).sql if len(v) > 1 else chr(39) + ',' + chr(39)}) END", "text")
        v = calls.aggregate(own, compile_)
        if own.name == "total":
            inner = real(compile_(x.args[0])).sql
            return Value(f"coalesce(sum({_when(x, compile_, inner)}) OVER ({spec}), 0.0D)", "real")
        if x.where is not None:
            arg = "1" if own.star or not own.args else plain(compile_(own.args[0]))
            return Value(f"{own.name}({_when(x, compile_, arg)}) OVER ({spec})", v.kind)
        return Value(f"{v.sql} OVER ({spec})", v.kind)

    def ranked(self, x: Call, compile_: Expressions, spec: str) -> Value:
        xs = compile_.all(x.args)
        if x.name in ("lag", "lead"):
            n = integer(xs[1]).constant if len(xs) > 1 else 1
            name = x.name if n >= 0 else {"lag": "lead", "lead": "lag"}[x.name]
            more = f", {plain(xs[2])}" if len(xs) > 2 else ""
            return Value(f"{name}({plain(xs[0])}, {abs(n)}{more}) OVER ({spec})", xs[0].kind if xs[0].kind != "bool" else "integer")
        if x.name in ("first_value", "last_value", "nth_value"):
            more = f", {integer(xs[1]).constant}" if x.name == "nth_value" else ""
            return Value(f"{x.name}({plain(xs[0])}{more}) OVER ({spec})", xs[0].kind if xs[0].kind != "bool" else "integer")
        if x.name == "ntile":
            return Value(f"CAST(ntile({integer(xs[0]).constant}) OVER ({spec}) AS BIGINT)", "integer")
        if x.name in ("percent_rank", "cume_dist"):
            return Value(f"{x.name}() OVER ({spec})", "real")
        return Value(f"CAST({x.name}() OVER ({spec}) AS BIGINT)", "integer")

    def listed(self, x: Call, w: Window, compile_: Expressions, row: str, group: str) -> Value:
        """A function over the frame's rows as a list: for frames by groups, excluded rows, distinct values and offsets by row."""
        xs = compile_.all(x.args)
        parts = ", ".join([f"{row} AS r", f"{group} AS g", *(f"{plain(v)} AS v{i}" for i, v in enumerate(xs))])
        kind, low, high, exclude = w.frame or ("ROWS" if not w.order else "RANGE", ("FIRST", None), ("LAST" if not w.order else "CURRENT", None), "NO OTHERS")
        by_row = x.name in ("lag", "lead")
        if by_row:
            kind, low, high = "ROWS", ("FIRST", None), ("LAST", None)
        order = group if kind == "GROUPS" else row if kind == "ROWS" else None
        if kind == "RANGE" and not {low[0], high[0]} & {"BEFORE", "AFTER"}:
            order = group
        spec = self.spec(w, compile_, order)
        unit = "RANGE" if kind == "GROUPS" else kind
        plain_sum = exclude == "NO OTHERS" and not x.distinct and x.where is None and not by_row
        over = f"OVER ({spec} {unit} {self.bounds((kind, low, high), compile_)})"
        if plain_sum and x.name in ("sum", "count", "avg", "min", "max", "total"):
            own = copy.copy(x)
            own.over = None
            v = calls.aggregate(_renamed_call(own, "sum" if x.name == "total" else x.name), compile_)
            return Value(f"coalesce(CAST({v.sql} {over} AS DOUBLE), 0.0D)" if x.name == "total" else f"{v.sql} {over}", "real" if x.name == "total" else v.kind)
        rows = f"collect_list({_when(x, compile_, f'STRUCT({parts})')}) {over}"
        keep = {"NO OTHERS": None, "CURRENT ROW": f"x.r <> {row}", "GROUP": f"x.g <> {group}", "TIES": f"(x.g <> {group} OR x.r = {row})"}[exclude]
        if keep:
            rows = f"filter({rows}, x -> {keep})"
        own = xs[0] if xs else literal(None)
        own_kind = "integer" if own.kind == "bool" else own.kind
        if by_row:
            offset = integer(xs[1]).sql if len(xs) > 1 else "1L"
            place = f"CAST({row} - 1 {'-' if x.name == 'lag' else '+'} {offset} AS INT)"
            default = f"CASE WHEN {place} < 0 OR {place} >= size({rows}) THEN {plain(xs[2]) if len(xs) > 2 else 'NULL'} ELSE get({rows}, {place}).v0 END"
            return Value(default, own_kind)
        if x.name in ("first_value", "last_value", "nth_value"):
            place = {"first_value": "0", "last_value": f"size({rows}) - 1", "nth_value": f"{integer(xs[1]).constant - 1 if x.name == 'nth_value' else 0}"}[x.name]
            return Value(f"get({rows}, {place}).v0", own_kind)
        if x.name == "count" and (x.star or not xs):
            return Value(f"CAST(size({rows}) AS BIGINT)", "integer")
        items = f"filter(transform({rows}, x -> x.v0), x -> x IS NOT NULL)"
        items = f"array_distinct({items})" if x.distinct else items
        if x.name == "count":
            return Value(f"CAST(size({items}) AS BIGINT)", "integer")
        if x.name in ("min", "max"):
            return Value(f"array_{x.name}({items})", own_kind)
        if x.name in ("group_concat", "string_agg"):
            as_text = text(Value("x", own_kind)).sql
            return Value(f"CASE WHEN size({items}) > 0 THEN array_join(transform({items}, x -> {as_text}), {text(xs[1]).sql if len(xs) > 1 else chr(39) + ',' + chr(39)}) END", "text")
        total = f"aggregate({items}, {'0L' if own_kind == 'integer' and x.name == 'sum' else '0.0D'}, (a, x) -> a + x)"
        if x.name == "sum":
            return Value(f"CASE WHEN size({items}) > 0 THEN {total} END", own_kind)
        if x.name == "total":
            return Value(total, "real")
        if x.name == "avg":
            return Value(f"try_divide({total}, CAST(size({items}) AS DOUBLE))", "real")
        raise SqlError(f"{x.name}() can't be used with this frame")


def _bound(c: Core) -> Core:
    """A table function without arguments takes them from WHERE: its hidden columns equal to something."""
    hidden = {"generate_series": ("start", "stop", "step"), "json_each": ("json", "root"), "json_tree": ("json", "root")}
    if c.source is None or c.source[0] != "table" or c.source[1].lower() not in hidden or c.where is None:
        return c
    names = hidden[c.source[1].lower()]
    parts, rest, args = [c.where], [], {}
    while parts:
        x = parts.pop(0)
        if x[0] == "binary" and x[1] == "AND":
            parts = [x[2], x[3], *parts]
            continue
        one = x[2] if x[0] == "binary" and x[1] == "=" else None
        if one is not None and one[0] == "col" and one[1][-1].lower() in names:
            args[one[1][-1].lower()] = x[3]
        else:
            rest.append(x)
    if names[0] not in args:
        return c
    given = [args[n] for n in names[: 1 + max(i for i, n in enumerate(names) if n in args)] if n in args]
    where = None
    for x in rest:
        where = x if where is None else ("binary", "AND", where, x)
    return replace(c, source=("function", c.source[1].lower(), given, c.source[2]), where=where)


def _renamed_call(c: Call, name: str) -> Call:
    out = copy.copy(c)
    out.name = name
    return out


def _when(x: Call, compile_: Expressions, sql: str) -> str:
    return f"CASE WHEN {truth(compile_(x.where))} THEN {sql} END" if x.where is not None else sql


def _unique(q: Query) -> list[Output]:
    """The columns with names that are unique without regard to case."""
    seen: dict[str, int] = {}
    out = []
    for o in q.columns:
        n = seen[o.name.lower()] = seen.get(o.name.lower(), 0) + 1
        out.append(o if n == 1 else replace(o, name=f"{o.name}:{n - 1}"))
    return out


def _renamed(q: Query) -> str:
    """The query with unique names."""
    own = _unique(q)
    if [o.name for o in own] == [o.name for o in q.columns]:
        return q.sql
    return f"SELECT * FROM ({q.sql}) AS u({', '.join(quoted(o.name) for o in own)})"


def _calls(nodes: Any) -> list[Call]:
    """All calls of some expressions, not those of queries within."""
    out: list[Call] = []

    def walk(x: Any) -> None:
        if isinstance(x, Call):
            out.append(x)
            for y in (x.args, x.where, [o[0] for o in x.order]):
                walk(y)
            if isinstance(x.over, Window):
                walk([x.over.partition, [o[0] for o in x.over.order]])
        elif isinstance(x, (list, tuple)):
            for y in x:
                walk(y)

    walk(nodes)
    return out


def _mentions(x: Any, name: str) -> bool:
    """Whether a query reads a table."""
    if isinstance(x, tuple) and len(x) == 3 and x[0] == "table" and isinstance(x[1], str) and x[1].lower() == name.lower():
        return True
    if isinstance(x, (list, tuple)):
        return any(_mentions(y, name) for y in x)
    if isinstance(x, (Core, Select)):
        return any(_mentions(y, name) for y in vars(x).values())
    return isinstance(x, Call) and any(_mentions(y, name) for y in (x.args, x.where))
