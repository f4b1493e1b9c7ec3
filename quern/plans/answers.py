"""Statements of the dialect over whole tables whose answers Spark's own SQL would give otherwise, and statements that change tables."""

from __future__ import annotations

from quern.operators.catalog import Database, ForeignKey
from quern.plans.catalogue import Tables, query

#: For each query the dialect's text and its twin.
TEXTS = {
    "dialect_arithmetic": (
        "SELECT o_orderkey, o_custkey / 7 AS q, -o_custkey / 7 AS n, o_custkey % 5 AS m, o_custkey / (o_orderkey % 3) AS z, o_totalprice / 0 AS d, 9223372036854775807 + 1 AS big FROM orders",
        "select o_orderkey, o_custkey // 7 as q, -(o_custkey // 7) as n, o_custkey % 5 as m, case when o_orderkey % 3 = 0 then null else o_custkey // (o_orderkey % 3) end as z, null::double as d, 9223372036854775808::double as big from orders",
    ),
    "dialect_classes": (
        "SELECT p_partkey, 1 = '1' AS a, p_size = '7' AS b, p_brand > p_size AS c, typeof(p_retailprice) AS t, CAST(p_brand AS INTEGER) AS i, CAST(p_size || 'abc' AS INTEGER) AS p, quote(p_name) AS q FROM part",
        "select p_partkey, 0 as a, (p_size = 7)::int as b, 1 as c, 'real' as t, 0::bigint as i, p_size::bigint as p, '''' || replace(p_name, '''', '''''') || '''' as q from part",
    ),
    "dialect_texts": (
        "SELECT n_nationkey, substr(n_name, 0, 3) AS s, substr(n_name, -2) AS e, trim(n_name, 'N') AS t, like('nation_1%', n_name) AS l, char(65, 65 + n_nationkey) AS c, instr(n_name, '_') AS i, '{' || n_name || '}' AS b FROM nation",
        "select n_nationkey, substr(n_name, 1, 2) as s, right(n_name, 2) as e, trim(n_name, 'N') as t, (n_name ilike 'nation_1%')::int as l, 'A' || chr(65 + n_nationkey) as c, instr(n_name, '_') as i, '{' || n_name || '}' as b from nation",
    ),
    "dialect_math": (
        "SELECT c_custkey, sign(c_acctbal) AS s, sqrt(c_acctbal) AS r, ln(c_acctbal) AS l, round(c_acctbal) AS o, abs(c_custkey - 50) AS a, max(c_custkey, 50) AS m, nullif(c_nationkey, 3) AS n FROM customer",
        "select c_custkey, sign(c_acctbal)::int as s, case when c_acctbal >= 0 then sqrt(c_acctbal) end as r, case when c_acctbal > 0 then ln(c_acctbal) end as l, round(c_acctbal) as o, abs(c_custkey - 50) as a, greatest(c_custkey, 50) as m, nullif(c_nationkey, 3) as n from customer",
    ),
    "dialect_json": (
        "SELECT event_id, props -> '$.k' AS j, props ->> 'k' AS v, json_type(props, '$.k') AS t, json_object('id', event_id, 'k', json(props)) AS o, json_set(props, '$.z', 'q') AS s FROM events",
        "select event_id, json_extract_string(props, '$.k') as j, json_extract_string(props, '$.k') as v, 'integer' as t, '{\"id\":' || event_id || ',\"k\":' || replace(props, ' ', '') || '}' as o, replace(replace(props, ' ', ''), '}', ',\"z\":\"q\"}') as s from events",
    ),
    "dialect_dates": (
        "SELECT o_orderkey, strftime('%Y-%m', o_orderdate) AS m, date(o_orderdate, 'start of month', '+1 month', '-1 day') AS e, unixepoch(o_orderdate) AS u, julianday(o_orderdate) AS j FROM orders",
        "select o_orderkey, strftime(o_orderdate, '%Y-%m') as m, strftime(last_day(o_orderdate), '%Y-%m-%d') as e, epoch(o_orderdate)::bigint as u, epoch(o_orderdate) / 86400.0 + 2440587.5 as j from orders",
    ),
    "dialect_collate": (
        "SELECT c_mktsegment COLLATE NOCASE AS k, count(*) AS n FROM customer WHERE lower(c_mktsegment) = c_mktsegment COLLATE NOCASE GROUP BY c_mktsegment COLLATE NOCASE",
        "select c_mktsegment as k, count(*) as n from customer group by 1",
    ),
    "dialect_row_values": (
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, 2 FROM orders) AND (l_quantity, l_partkey) > (25, 100)",
        "select l_orderkey, l_linenumber from lineitem where l_linenumber = 2 and l_orderkey in (select o_orderkey from orders) and (l_quantity > 25 or l_quantity = 25 and l_partkey > 100)",
    ),
    "dialect_bare_columns": (
        "SELECT o_custkey, max(o_totalprice) AS high, o_orderkey FROM orders GROUP BY o_custkey",
        "select o_custkey, max(o_totalprice) as high, arg_max(o_orderkey, o_totalprice) as o_orderkey from orders group by o_custkey",
    ),
    "dialect_groups": (
        "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_partkey GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM lineitem",
        "select l_orderkey, l_linenumber, count(*) over (partition by l_suppkey order by l_partkey groups between 1 preceding and 1 following) as n from lineitem",
    ),
    "dialect_aggregates": (
        "SELECT n_regionkey, group_concat(n_name, '|' ORDER BY n_nationkey DESC) AS names, json_group_array(n_nationkey ORDER BY n_nationkey) AS keys, total(n_nationkey) FILTER (WHERE n_nationkey > 10) AS t FROM nation GROUP BY n_regionkey",
        "select n_regionkey, string_agg(n_name, '|' order by n_nationkey desc) as names, '[' || string_agg(n_nationkey::varchar, ',' order by n_nationkey) || ']' as keys, coalesce(sum(n_nationkey) filter (where n_nationkey > 10), 0)::double as t from nation group by n_regionkey",
    ),
}
for _name, (_text, _twin) in TEXTS.items():
    query(_name, _twin)(lambda t, text=_text: t.dialect(text))


@query("dialect_recursive", "select n_name from nation")
def _(t: Tables):
    """Keys reached from 0 by two steps modulo 25: every one."""
    return t.dialect("WITH RECURSIVE r(k) AS (SELECT 0 UNION SELECT (k * s + 1 + 6 * (2 - s)) % 25 FROM r, (SELECT 1 AS s UNION SELECT 2)) SELECT n_name FROM nation WHERE n_nationkey IN (SELECT k FROM r)")


def _keyed(t: Tables) -> Database:
    db = Database(t.spark)
    db.create("region", t.region, key=("r_regionkey",))
    db.create("nation", t.nation, key=("n_nationkey",), foreign=(ForeignKey("n_regionkey", "region", "r_regionkey", "CASCADE", "CASCADE"),))
    db.create("supplier", t.supplier, key=("s_suppkey",), foreign=(ForeignKey("s_nationkey", "nation", "n_nationkey", "CASCADE"),))
    db.sql("PRAGMA foreign_keys = ON")
    return db


#: For each query the statements, the last of which gives its rows, and the twin.
CHANGES = {
    "text_insert": ("INSERT INTO region SELECT r_regionkey + 10, r_name || '!' FROM region RETURNING r_regionkey, r_name", "select r_regionkey + 10 as r_regionkey, r_name || '!' as r_name from region"),
    "text_or_ignore": ("INSERT OR IGNORE INTO region VALUES (0, 'no'), (50, 'yes'); SELECT * FROM region", "select * from region union all select 50, 'yes'"),
    "text_replace": ("PRAGMA foreign_keys = OFF; REPLACE INTO region VALUES (1, 'one'), (51, 'new'); SELECT * FROM region", "select * from region where r_regionkey <> 1 union all select 1, 'one' union all select 51, 'new'"),
    "text_upsert": ("INSERT INTO region VALUES (1, 'x'), (52, 'y') ON CONFLICT(r_regionkey) DO UPDATE SET r_name = r_name || excluded.r_name; SELECT * FROM region", "select r_regionkey, case when r_regionkey = 1 then r_name || 'x' else r_name end as r_name from region union all select 52, 'y'"),
    "text_update": ("UPDATE nation SET n_name = lower(n_name) WHERE n_regionkey IN (1, 2) RETURNING n_nationkey, n_name", "select n_nationkey, lower(n_name) as n_name from nation where n_regionkey in (1, 2)"),
    "text_update_from": ("UPDATE nation SET n_name = r_name FROM region WHERE n_regionkey = r_regionkey AND r_regionkey > 2; SELECT n_nationkey, n_name FROM nation", "select n_nationkey, case when r_regionkey > 2 then r_name else n_name end as n_name from nation join region on n_regionkey = r_regionkey"),
    "text_update_limit": ("UPDATE nation SET n_name = 'first' ORDER BY n_nationkey DESC LIMIT 3 OFFSET 1; SELECT n_nationkey FROM nation WHERE n_name = 'first'", "select n_nationkey from nation order by n_nationkey desc limit 3 offset 1"),
    "text_delete": ("DELETE FROM supplier WHERE s_acctbal < (SELECT avg(s_acctbal) FROM supplier); SELECT s_suppkey FROM supplier", "select s_suppkey from supplier where s_acctbal >= (select avg(s_acctbal) from supplier)"),
    "text_delete_cascade": ("DELETE FROM region WHERE r_regionkey = 2; SELECT s_suppkey FROM supplier", "select s_suppkey from supplier join nation on s_nationkey = n_nationkey where n_regionkey <> 2"),
    "text_update_cascade": ("UPDATE region SET r_regionkey = r_regionkey + 100 WHERE r_regionkey < 2; SELECT n_nationkey, n_regionkey FROM nation", "select n_nationkey, case when n_regionkey < 2 then n_regionkey + 100 else n_regionkey end as n_regionkey from nation"),
    "text_transaction": ("BEGIN; DELETE FROM supplier; ROLLBACK; SAVEPOINT a; DELETE FROM nation; ROLLBACK TO a; SELECT count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey", "select count(*) as n from supplier"),
    "text_trigger": ("CREATE TABLE log(k INT, old_name TEXT); CREATE TRIGGER g AFTER UPDATE ON nation WHEN new.n_name <> old.n_name BEGIN INSERT INTO log VALUES (new.n_nationkey, old.n_name); END; UPDATE nation SET n_name = iif(n_regionkey = 1, 'z', n_name); SELECT * FROM log", "select n_nationkey as k, n_name as old_name from nation where n_regionkey = 1"),
    "text_definitions": ("CREATE TABLE t(a INTEGER PRIMARY KEY, b TEXT DEFAULT 'd', c INT AS (a * 2)); INSERT INTO t(b) SELECT n_name FROM nation; ALTER TABLE t ADD COLUMN e REAL DEFAULT 0.5; CREATE VIEW v AS SELECT count(*) AS n, sum(c) AS s, sum(e) AS e FROM t; SELECT * FROM v", "select count(*) as n, (count(*) * (count(*) + 1))::bigint as s, count(*) * 0.5::double as e from nation"),
    "text_pragma": ("SELECT name, pk FROM pragma_table_info('nation')", "select column_name as name, (column_name = 'n_nationkey')::int as pk from duckdb_columns() where table_name = 'nation'"),
}
for _name, (_text, _twin) in CHANGES.items():
    query(_name, _twin)(lambda t, text=_text: _keyed(t).sql(text))
