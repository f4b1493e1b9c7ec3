"""The dialect as text: statements against a database, with the answers the dialect gives."""

from __future__ import annotations

import pytest

from quern.operators.catalog import Database
from quern.sql.parser import SqlError, statements


@pytest.fixture(scope="module")
def fixed(spark):
    """A database that the tests of queries read."""
    d = Database(spark)
    d.sql("create table dept(id integer primary key, name text not null)")
    d.sql("insert into dept values (1,'Ops'),(2,'Dev'),(3,'ops')")
    d.sql("create table t(x integer, g text)")
    d.sql("insert into t values (1,'a'),(2,'a'),(2,'b'),(3,'b'),(5,'b')")
    d.sql("create table r(v real, s text, b blob, n integer)")
    d.sql("insert into r values (1.5, '12', x'4142', 7), (-2.0, 'abc', null, null), (1e20, '3.5', x'', -9223372036854775808)")
    return d


@pytest.fixture
def db(spark):
    return Database(spark)


def rows(df):
    return [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect()]


SCALARS = [
    ("7/2, -7/2, 7%3, -7%3, 7.0/2", (3, -3, 1, -1, 3.5)),
    ("1/0, 5%0, 1.0/0, 9223372036854775807+1, -9223372036854775808 - 1", (None, None, None, 9.223372036854775807e18, -9.223372036854775808e18)),
    ("CAST('12abc' AS INTEGER), CAST('x' AS REAL), CAST(3.99 AS INTEGER), CAST(1e30 AS INTEGER), CAST('  7.5z' AS REAL), CAST(2.0 AS TEXT), CAST('12' AS NUMERIC)", (12, 0.0, 3, (1 << 63) - 1, 7.5, "2.0", 12)),
    ("substr('abc',0,2), substr('hello',-3,2), substr('hello',3,-2), substr('abc',2)", ("a", "ll", "he", "bc")),
    ("trim('xax','x'), ltrim('  a '), rtrim('a  '), trim('  b  ')", ("a", "a ", "a", "b")),
    ("like('a%','abc'), glob('a*','abc'), 'ABC' LIKE 'a_c', 'abc' GLOB 'A*', 'a%' LIKE 'a\\%' ESCAPE '\\', 'abc' NOT LIKE 'b%'", (1, 1, 1, 0, 1, 1)),
    ("1 = '1', 1 < '0', 'b' > 'a', x'00' > 'z', 1 = 1.0, NULL = NULL, NULL IS NULL, 1 IS NOT 2", (0, 1, 1, 1, 1, None, 1, 1)),
    ("typeof(1), typeof(1.0), typeof('a'), typeof(x'00'), typeof(NULL)", ("integer", "real", "text", "blob", "null")),
    ("quote('a''b'), quote(1.5), quote(x'4142'), quote(NULL), quote(3)", ("'a''b'", "1.5", "X'4142'", "NULL", "3")),
    ("sign(-5), sqrt(-1), ln(0), log(100), log(2,8), abs(-3), round(2.567,2), max(1,NULL), min(2,1)", (-1, None, None, 2.0, 3.0, 3, 2.57, None, 1)),
    ("'a' || 1.0 || 2, 3 || '', 'a' || NULL, '10' + 5, '3x' * 2, 'x' + 1", ("a1.02", "3", None, 15, 6, 1)),
    ("'{x}', '}{', 'it''s', \"quoted\", 0x1F, 1_000, .5, 1e3", ("{x}", "}{", "it's", "quoted", 31, 1000, 0.5, 1000.0)),
    ("char(65,66), unicode('A'), hex('AB'), unhex('4142'), length('héé'), octet_length('hé'), instr('hello','l'), upper('é a'), replace('aXbX','X','-')", ("AB", 65, "4142", b"AB", 3, 3, 3, "é A", "a-b-")),
    ("strftime('%Y-%m', '2023-05-18 10:00:00'), date('2023-01-31','+1 month'), julianday('2000-01-01 12:00'), unixepoch('1970-01-02'), time('10:20'), datetime(0, 'unixepoch')", ("2023-05", "2023-03-03", 2451545.0, 86400, "10:20:00", "1970-01-01 00:00:00")),
    ("timediff('2023-02-15','2022-03-15'), date('2024-02-29','start of month','-1 day')", ("+0000-11-00 00:00:00.000", "2024-01-31")),
    ("printf('%05d|%s|%.2f', 42, 'x', 1.5), format('%q', 'it''s')", ("00042|x|1.50", "it''s")),
    ("iif(1 > 2, 'y', 'n'), if(1, 2), coalesce(NULL, 3), nullif(1, 1), ifnull(NULL, 'd'), CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END, CASE WHEN NULL THEN 1 ELSE 2 END", ("n", 2, 3, None, "d", "b", 2)),
    ("5 & 3, 5 | 3, ~5, 1 << 3, -8 >> 1, 1 << 64, -1 >> 70", (1, 7, -6, 8, -4, 0, -1)),
    ("NOT 1, NOT 0, NOT NULL, 1 AND NULL, 0 AND NULL, 1 OR NULL, 2 IS TRUE, 0 IS NOT TRUE, NULL IS FALSE", (0, 1, None, None, 0, 1, 1, 1, 0)),
    ("(1,2) < (1,3), (1,2) = (1,2), (1,NULL) = (2,NULL), 2 IN (1,2), 2 NOT IN (1,NULL), 1 IN (), 5 BETWEEN 1 AND 3", (1, 1, 0, 1, None, 0, 0)),
    ("concat('a', NULL, 1), concat_ws('-', 'a', NULL, 'b'), reverse('abc'), repeat('ab', 2), lpad('7', 3, '0'), soundex('Robert')", ("a1", "a-b", "cba", "abab", "007", "R163")),
    ("'a' = 'A' COLLATE NOCASE, 'a ' = 'a' COLLATE RTRIM, 'a' < 'B' COLLATE NOCASE", (1, 1, 1)),
    ("gcd(12, 18), lcm(4, 6), mod(7, 2), pow(2, 10), ceil(1.2), floor(-1.2), trunc(-1.7), pi() > 3", (6, 12, 1.0, 1024.0, 2.0, -2.0, -1.0, 1)),
    ("unistr('a\\0041b'), likely(3), likelihood(4, 0.5), zeroblob(2), sqlite_version() IS NOT NULL", ("aAb", 3, 4, b"\0\0", 1)),
]
JSON = [
    ("'{\"a\":[1,{\"b\":2}]}' -> '$.a', '{\"a\":[1,2]}' ->> '$.a[1]', '{\"a\":\"x\"}' -> 'a', '{\"a\":\"x\"}' ->> 'a', '[5,6]' ->> 1, '[5,6]' ->> '$[#-1]'", ('[1,{"b":2}]', 2, '"x"', "x", 6, 6)),
    ("json(' { \"a\" : [ 1 , 2 ] } '), json_valid('{'), json_type('[1]'), json_array_length('[1,2,3]'), json_extract('{\"a\":null}', '$.a'), json_extract('[1,2]', '$[0]', '$[1]')", ('{"a":[1,2]}', 0, "array", 3, None, "[1,2]")),
    ("json_object('a', 1, 'b', json_array(1,'x',NULL)), json_array(), json_quote('q'), json_array(json('[1]'), '[1]')", ('{"a":1,"b":[1,"x",null]}', "[]", '"q"', '[[1],"[1]"]')),
    ("json_set('{\"a\":1}', '$.b', 'z'), json_insert('{\"a\":1}', '$.a', 9), json_replace('{\"a\":1}', '$.a', 9), json_remove('[1,2,3]', '$[1]'), json_patch('{\"a\":1,\"b\":2}', '{\"b\":null}')", ('{"a":1,"b":"z"}', '{"a":1}', '{"a":9}', "[1,3]", '{"a":1}')),
    ("json_replace('{\"a\": 1, \"b\": 2}', '$.a', 42) -> '$.a', json_set('{}', '$.a', json('[1]')), json_error_position('{\"a\":}'), jsonb_extract('{\"a\":7}', '$.a')", ("42", '{"a":[1]}', 6, 7)),
]
QUERIES = [
    ("SELECT count(*) FROM dept WHERE name = 'OPS' COLLATE NOCASE", [(2,)]),
    ("SELECT id, name FROM dept ORDER BY name COLLATE NOCASE DESC, id LIMIT 1 OFFSET 1", [(3, "ops")]),
    ("SELECT id FROM dept ORDER BY id LIMIT 1, 1", [(2,)]),
    ("SELECT id FROM dept ORDER BY id LIMIT -1 OFFSET 1", [(2,), (3,)]),
    ("SELECT rowid, name FROM dept WHERE rowid = 2", [(2, "Dev")]),
    ("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n+1 FROM r WHERE n<5) SELECT sum(n) FROM r", [(15,)]),
    ("WITH RECURSIVE r(n) AS (SELECT 1 UNION SELECT (n*2)%7 FROM r) SELECT n FROM r ORDER BY n", [(1,), (2,), (4,)]),
    ("WITH a(k) AS MATERIALIZED (SELECT id FROM dept), b AS (SELECT k + 1 AS k FROM a) SELECT a.k FROM a JOIN b USING (k) ORDER BY 1", [(2,), (3,)]),
    ("SELECT column1, column2 FROM (VALUES (1,'a'),(2,NULL))", [(1, "a"), (2, None)]),
    ("SELECT id, max(id), name FROM dept", [(3, 3, "ops")]),
    ("SELECT d.id, j.value FROM dept d, json_each('[10,' || d.id || ']') j WHERE j.key = 1 ORDER BY 1", [(1, "1"), (2, "2"), (3, "3")]),
    ("SELECT key, value, type, atom, parent, fullkey, path FROM json_each('[1, 2.5, \"x\", true, null]')", [("0", "1", "integer", "1", None, "$[0]", "$"), ("1", "2.5", "real", "2.5", None, "$[1]", "$"), ("2", "x", "text", "x", None, "$[2]", "$"), ("3", "1", "true", "1", None, "$[3]", "$"), ("4", None, "null", None, None, "$[4]", "$")]),
    ("SELECT fullkey, type, parent FROM json_tree('{\"a\":{\"b\":[7]}}', '$.a') ORDER BY id", [("$.a", "object", None), ("$.a.b", "array", 0), ("$.a.b[0]", "integer", 1)]),
    ("SELECT count(*) FROM json_each('[]') UNION ALL SELECT count(*) FROM json_tree('{\"a\":1}', '$.missing')", [(0,), (0,)]),
    ("SELECT x, sum(x) OVER (ORDER BY x GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t ORDER BY x", [(1, 1), (2, 5), (2, 5), (3, 7), (5, 8)]),
    ("SELECT x, sum(x) OVER w s FROM t WINDOW w AS (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) ORDER BY x, s", [(1, 12), (2, 11), (2, 11), (3, 10), (5, 8)]),
    ("SELECT x, sum(x) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP) s, max(x) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES) m FROM t ORDER BY x", [(1, 12, 5), (2, 9, 5), (2, 9, 5), (3, 10, 5), (5, 8, 5)]),
    ("SELECT x, count(DISTINCT g) OVER (PARTITION BY x) n, count(*) FILTER (WHERE g = 'b') OVER (ORDER BY x) b FROM t ORDER BY x, n", [(1, 1, 0), (2, 2, 1), (2, 2, 1), (3, 1, 2), (5, 1, 3)]),
    ("SELECT x, lag(x, 1, 0) OVER (ORDER BY x, g) l, ntile(2) OVER (ORDER BY x, g) n, lag(x, x - 1) OVER (ORDER BY x, g) o FROM t ORDER BY x, l", [(1, 0, 1, 1), (2, 1, 1, 1), (2, 2, 1, 2), (3, 2, 2, 2), (5, 3, 2, 1)]),
    ("SELECT rank() OVER (), row_number() OVER (PARTITION BY g ORDER BY x) FROM t WHERE g = 'a'", [(1, 1), (1, 2)]),
    ("SELECT g, count(DISTINCT x) n, group_concat(x, '-' ORDER BY x DESC) c, total(x) FROM t GROUP BY g HAVING n > 1 ORDER BY 1", [("a", 2, "2-1", 3.0), ("b", 3, "5-3-2", 10.0)]),
    ("SELECT json_group_array(x ORDER BY x), json_group_object(g, x) FROM t WHERE x = 1", [("[1]", '{"a":1}')]),
    ("SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY x), median(x), mode(x), percentile(x, 25) FROM t", [(2.0, 2.0, 2, 2.0)]),
    ("SELECT x FROM t WHERE x IN (SELECT x FROM t WHERE g='b') GROUP BY x ORDER BY x", [(2,), (3,), (5,)]),
    ("SELECT x, (SELECT count(*) FROM t u WHERE u.x < t.x) n FROM t WHERE g = 'b' ORDER BY x", [(2, 1), (3, 3), (5, 4)]),
    ("SELECT g, x FROM t WHERE (g, x) IN (VALUES ('a', 1), ('b', 5)) ORDER BY 2", [("a", 1), ("b", 5)]),
    ("SELECT x FROM t INTERSECT SELECT 2 UNION ALL SELECT 9 ORDER BY 1", [(2,), (9,)]),
    ("SELECT DISTINCT g FROM t EXCEPT SELECT 'a'", [("b",)]),
    ("SELECT s FROM r WHERE s = 12 OR n = '7'", [("12",)]),
    ("SELECT n + 1, n - 1, v / 0, s + 1, -n FROM r ORDER BY v", [(None, None, None, 1.0, None), (8, 6, None, 13.0, -7), (-9223372036854775807, None, None, 4.5, None)]),
    ("SELECT typeof(v), length(b), v || '' FROM r ORDER BY v", [("real", None, "-2.0"), ("real", 2, "1.5"), ("real", 0, "1.0e+20")]),
    ("SELECT count(*) FROM t NATURAL JOIN (SELECT 2 AS x)", [(2,)]),
    ("SELECT d.name, t.g FROM dept d LEFT JOIN t ON t.x = d.id AND t.g = 'b' ORDER BY d.id", [("Ops", None), ("Dev", "b"), ("ops", "b")]),
    ("SELECT * FROM t JOIN dept ON id = x WHERE g = 'a' ORDER BY x", [(1, "a", 1, "Ops"), (2, "a", 2, "Dev")]),
    ("SELECT value FROM generate_series(1, 9, 4)", [(1,), (5,), (9,)]),
    ("SELECT name FROM pragma_table_info('dept') ORDER BY cid", [("id",), ("name",)]),
    ("SELECT name, type FROM sqlite_schema WHERE name = 'dept'", [("dept", "table")]),
    ("SELECT x, (SELECT name FROM dept WHERE id <= t.x ORDER BY id DESC LIMIT 1) n, (SELECT name FROM dept WHERE id = t.x) m FROM t WHERE g = 'b' ORDER BY x", [(2, "Dev", "Dev"), (3, "ops", "ops"), (5, "ops", None)]),
    ("SELECT DISTINCT g FROM t ORDER BY length(g), g DESC", [("b",), ("a",)]),
    ("SELECT x + 1 AS y FROM t WHERE y > 3 ORDER BY y", [(4,), (6,)]),
    ("SELECT a.x, b.x FROM t a JOIN t b ON a.x = b.x + 1 WHERE a.g = 'b' ORDER BY 1, b.x", [(2, 1), (3, 2), (3, 2)]),
    ("WITH s AS (SELECT g, sum(x) n FROM t GROUP BY g) SELECT g, n * 100 / (SELECT sum(n) FROM s) p FROM s ORDER BY p DESC", [("b", 76), ("a", 23)]),
    ("SELECT x, count(*) FROM t GROUP BY x HAVING sum(x) > 4 ORDER BY sum(x) DESC, x", [(5, 1)]),
    ("SELECT id FROM dept INDEXED BY nothing WHERE name MATCH 'dev'", [(2,)]),
]


@pytest.mark.parametrize("text,want", SCALARS + JSON)
def test_scalars(fixed, text, want):
    assert rows(fixed.sql(f"SELECT {text}")) == [want]


@pytest.mark.parametrize("text,want", QUERIES)
def test_queries(fixed, text, want):
    assert rows(fixed.sql(text)) == want


def test_over_columns(fixed):
    """The functions over a column, not over constants, which are folded."""
    got = rows(fixed.sql("SELECT x / 2, x % 2, CAST(g || x AS INTEGER), substr(g || x, -1), g || x LIKE 'A%', x || '', round(x / 3.0, 1), typeof(x), x -> '$', json_array(x, g) ->> '$[1]' FROM t WHERE x = 3"))
    assert got == [(1, 1, 0, "3", 0, "3", 1.0, "integer", "3", "b")]


def test_parameters(fixed):
    assert rows(fixed.sql("SELECT ? + :k, @z, ?2", 2, 8, k=3, z="s")) == [(5, "s", 8)]
    with pytest.raises(SqlError, match="parameter"):
        fixed.sql("SELECT :missing")


@pytest.mark.parametrize("text", ["SELECT", "SELEC 1", "SELECT nope(1)", "SELECT a FROM dept", "SELECT id FROM nothing", "SELECT id, id FROM dept GROUP BY 9", "SELECT sum(sum(x)) FROM t", "SELECT (1, 2)", "SELECT x FROM t, t u", "SELECT 'a", "SELECT 1 UNION SELECT 1, 2"])
def test_errors(fixed, text):
    with pytest.raises(ValueError):
        fixed.sql(text).collect()


def test_insert_update_delete(db):
    db.sql("CREATE TABLE d(id INTEGER PRIMARY KEY, name TEXT NOT NULL UNIQUE, pay REAL DEFAULT 1.5 CHECK(pay > 0), twice REAL AS (pay * 2))")
    assert sorted(rows(db.sql("INSERT INTO d(name) VALUES ('a'), ('b') RETURNING id, name, pay, twice"))) == [(1, "a", 1.5, 3.0), (2, "b", 1.5, 3.0)]
    with pytest.raises(ValueError, match="CHECK"):
        db.sql("INSERT INTO d(name, pay) VALUES ('c', -1)")
    with pytest.raises(ValueError, match="NOT NULL"):
        db.sql("INSERT INTO d DEFAULT VALUES")
    with pytest.raises(ValueError, match="UNIQUE"):
        db.sql("INSERT INTO d(name) VALUES ('a')")
    db.sql("INSERT OR IGNORE INTO d(name, pay) VALUES ('a', 9), ('c', -1), ('e', 4)")
    assert rows(db.sql("SELECT id, name, pay FROM d ORDER BY id"))[-1][1:] == ("e", 4.0) and db.sql("SELECT * FROM d").count() == 3
    assert rows(db.sql("INSERT INTO d(id, name) VALUES (1, 'z') ON CONFLICT(id) DO UPDATE SET name = excluded.name || name WHERE id < 5 RETURNING name")) == [("za",)]
    db.sql("INSERT INTO d(id, name) VALUES (1, 'q') ON CONFLICT DO NOTHING")
    db.sql("REPLACE INTO d(id, name) VALUES (2, 'new')")
    assert rows(db.sql("SELECT name FROM d WHERE id = 2")) == [("new",)]
    assert rows(db.sql("UPDATE d SET pay = pay + 1, name = upper(name) WHERE id <= 2 RETURNING id, name, pay, twice")) in ([(1, "ZA", 2.5, 5.0), (2, "NEW", 2.5, 5.0)], [(2, "NEW", 2.5, 5.0), (1, "ZA", 2.5, 5.0)])
    assert rows(db.sql("UPDATE d SET (name, pay) = ('x', 7) ORDER BY id DESC LIMIT 1 RETURNING name, pay")) == [("x", 7.0)]
    db.sql("UPDATE d SET pay = s.p FROM (SELECT 1 AS k, 50 AS p UNION ALL SELECT 9, 60) s WHERE d.id = s.k")
    assert rows(db.sql("SELECT pay FROM d WHERE id = 1")) == [(50.0,)]
    assert rows(db.sql("WITH low AS (SELECT 2 AS k) DELETE FROM d WHERE id IN (SELECT k FROM low) RETURNING id")) == [(2,)]
    db.sql("DELETE FROM d ORDER BY id LIMIT 1")
    assert rows(db.sql("SELECT count(*) FROM d")) == [(1,)]
    db.sql("INSERT INTO d(name, pay) SELECT name || id, pay FROM d")
    assert rows(db.sql("SELECT count(*) FROM d")) == [(2,)]


def test_autoincrement(db):
    db.sql("CREATE TABLE a(id INTEGER PRIMARY KEY AUTOINCREMENT, v); INSERT INTO a(v) VALUES ('x'), ('y'); DELETE FROM a WHERE id = 2; INSERT INTO a(v) VALUES ('z')")
    assert rows(db.sql("SELECT id FROM a ORDER BY id")) == [(1,), (3,)]


def test_foreign_keys(db):
    db.sql("PRAGMA foreign_keys = ON")
    db.sql("CREATE TABLE p(id INTEGER PRIMARY KEY); INSERT INTO p VALUES (1), (2), (3), (4)")
    db.sql("CREATE TABLE c(id INTEGER PRIMARY KEY, p INT REFERENCES p(id) ON DELETE CASCADE ON UPDATE CASCADE, boss INT REFERENCES c(id) ON DELETE CASCADE)")
    db.sql("INSERT INTO c VALUES (1, 1, NULL), (2, 2, 1), (3, 3, 2), (4, 4, NULL)")
    db.sql("CREATE TABLE n(p INT DEFAULT 4 REFERENCES p(id) ON DELETE SET DEFAULT ON UPDATE SET NULL); INSERT INTO n VALUES (3)")
    with pytest.raises(ValueError, match="FOREIGN KEY"):
        db.sql("INSERT INTO c VALUES (9, 99, NULL)")
    db.sql("UPDATE p SET id = 10 WHERE id = 1")
    assert rows(db.sql("SELECT p FROM c WHERE id = 1")) == [(10,)]
    db.sql("DELETE FROM c WHERE id = 1")  # its staff go with it, through two generations
    assert rows(db.sql("SELECT id FROM c")) == [(4,)]
    db.sql("DELETE FROM p WHERE id = 3")
    assert rows(db.sql("SELECT p FROM n")) == [(4,)]
    db.sql("UPDATE p SET id = 40 WHERE id = 4")
    assert rows(db.sql("SELECT p FROM n")) == [(None,)]
    db.sql("CREATE TABLE s(p INT REFERENCES p(id) ON DELETE RESTRICT); INSERT INTO s VALUES (2)")
    before = rows(db.sql("SELECT count(*) FROM p"))
    with pytest.raises(ValueError, match="FOREIGN KEY"):
        db.sql("DELETE FROM p")
    assert rows(db.sql("SELECT count(*) FROM p")) == before
    db.sql("CREATE TABLE l(p INT REFERENCES p(id) DEFERRABLE INITIALLY DEFERRED)")
    db.sql("BEGIN; INSERT INTO l VALUES (77); INSERT INTO p VALUES (77); COMMIT")
    db.sql("BEGIN; INSERT INTO l VALUES (78)")
    with pytest.raises(ValueError, match="FOREIGN KEY"):
        db.sql("COMMIT")
    db.sql("ROLLBACK")
    assert rows(db.sql("SELECT p FROM l")) == [(77,)] and db.pragma("foreign_key_check").count() == 0


def test_transactions(db):
    db.sql("CREATE TABLE t(x INT); INSERT INTO t VALUES (1), (2)")
    db.sql("BEGIN; DELETE FROM t; ROLLBACK")
    db.sql("SAVEPOINT a; INSERT INTO t VALUES (3); SAVEPOINT b; DELETE FROM t; ROLLBACK TO b; RELEASE a")
    assert rows(db.sql("SELECT sum(x) FROM t")) == [(6,)]
    with pytest.raises(ValueError):
        db.sql("COMMIT")
    db.sql("PRAGMA query_only = 1")
    with pytest.raises(PermissionError):
        db.sql("DELETE FROM t")


def test_triggers(db):
    db.sql("CREATE TABLE t(x INT); CREATE TABLE log(what TEXT, a INT, b INT)")
    db.sql("CREATE TRIGGER i AFTER INSERT ON t BEGIN INSERT INTO log VALUES ('i', NULL, new.x); END")
    db.sql("CREATE TRIGGER u AFTER UPDATE OF x ON t WHEN new.x > old.x BEGIN INSERT INTO log SELECT 'u', old.x, new.x; END")
    db.sql("CREATE TRIGGER d AFTER DELETE ON t BEGIN INSERT INTO log VALUES ('d', old.x, NULL); END")
    db.sql("INSERT INTO t VALUES (1), (5); UPDATE t SET x = 3; DELETE FROM t WHERE x = 3")
    assert sorted(rows(db.sql("SELECT * FROM log")), key=str) == sorted([("i", None, 1), ("i", None, 5), ("u", 1, 3), ("d", 3, None), ("d", 3, None)], key=str)
    db.sql("DROP TRIGGER i; INSERT INTO t VALUES (9)")
    assert rows(db.sql("SELECT count(*) FROM log WHERE what = 'i'")) == [(2,)]


def test_definitions(db):
    db.sql("CREATE TABLE t(a INT, b TEXT COLLATE NOCASE); INSERT INTO t VALUES (1, 'X'), (2, 'y')")
    assert rows(db.sql("SELECT a FROM t WHERE b = 'x'")) == [(1,)]
    db.sql("CREATE UNIQUE INDEX ib ON t(b); CREATE INDEX IF NOT EXISTS ia ON t(a DESC)")
    with pytest.raises(ValueError, match="UNIQUE"):
        db.sql("INSERT INTO t VALUES (3, 'X')")
    db.sql("DROP INDEX ib; INSERT INTO t VALUES (3, 'X')")
    db.sql("ALTER TABLE t ADD COLUMN z TEXT DEFAULT 'q'; ALTER TABLE t RENAME COLUMN z TO w; ALTER TABLE t RENAME TO u")
    assert rows(db.sql("SELECT DISTINCT w FROM u")) == [("q",)]
    db.sql("ALTER TABLE u DROP COLUMN w; CREATE VIEW v(k, n) AS SELECT b, count(*) FROM u GROUP BY b; CREATE TABLE copy AS SELECT * FROM v")
    assert rows(db.sql("SELECT sum(n) FROM copy")) == [(3,)]
    with pytest.raises(ValueError):
        db.sql("DELETE FROM v")
    db.sql("ANALYZE u; REINDEX; VACUUM")
    assert rows(db.sql("SELECT stat FROM sqlite_stat1")) == [("3 1",)]
    assert db.sql("EXPLAIN QUERY PLAN SELECT * FROM u").count() > 0
    assert db.sql("EXPLAIN QUERY PLAN DELETE FROM u").count() > 0 and db.sql("SELECT * FROM u").count() == 3
    db.sql("DROP VIEW v; DROP TABLE IF EXISTS nothing; DROP TABLE copy")
    assert {r[0] for r in rows(db.sql("SELECT name FROM sqlite_schema"))} == {"u", "ia"}
    assert db.pragma("function_list").count() > 100 and db.sql("PRAGMA user_version = 3").first()[0] == 3


def test_plans_do_not_grow(db):
    """A table's plan is a scan, however many statements made it."""
    db.sql("CREATE TABLE t(x INT)")
    for i in range(4):
        db.sql(f"INSERT INTO t VALUES ({i}); UPDATE t SET x = x + 1")
    plan = db.frame("t")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan.splitlines()) <= 2 and rows(db.sql("SELECT sum(x) FROM t")) == [(4 + 4 + 4 + 4,)]


def test_hooks_and_state(db):
    seen = []
    db.hooks["update"].append(lambda event, table, rows: seen.append((event, table, rows.count())))
    db.hooks["rollback"].append(lambda: seen.append("rollback"))
    db.hooks["trace"].append(lambda text: None)
    db.sql("CREATE TABLE t(id INTEGER PRIMARY KEY, x INT); INSERT INTO t(x) VALUES (1), (2), (3); UPDATE t SET x = 0 WHERE id > 1")
    assert rows(db.sql("SELECT changes(), total_changes(), last_insert_rowid(), is_autocommit()")) == [(2, 5, 3, 1)]
    db.hooks["commit"].append(lambda: True)
    db.sql("BEGIN; DELETE FROM t; COMMIT")
    assert rows(db.sql("SELECT count(*) FROM t")) == [(3,)]
    assert seen == [("INSERT", "t", 3), ("UPDATE", "t", 2), ("DELETE", "t", 3), "rollback"]
    db.hooks["authorize"].append(lambda statement: type(statement).__name__ == "Select")
    with pytest.raises(PermissionError):
        db.sql("DELETE FROM t")


def test_hidden_arguments(fixed):
    assert rows(fixed.sql("SELECT value FROM generate_series WHERE start = 1 AND stop = 7 AND step = 3 AND value > 1")) == [(4,), (7,)]
    assert rows(fixed.sql("SELECT key FROM json_each WHERE json = '{\"a\":1}'")) == [("a",)]


def test_search_tables(db):
    db.sql("CREATE VIRTUAL TABLE f USING fts5(title, body, tokenize = 'unicode61')")
    db.sql("INSERT INTO f VALUES ('Old ships', 'a harbour by the sea'), ('Trains', 'an old station'), ('Cars', 'new roads')")
    assert sorted(rows(db.sql("SELECT title FROM f WHERE f MATCH 'old'"))) == [("Old ships",), ("Trains",)]
    assert rows(db.sql("SELECT title FROM f WHERE f MATCH '\"old station\" OR harb*' AND body MATCH 'sea'")) == [("Old ships",)]
    db.sql("CREATE VIRTUAL TABLE r USING rtree(id, x0, x1); INSERT INTO r VALUES (1, 0, 2), (2, 5, 7); INSERT INTO r(x0, x1) VALUES (6.5, 9)")
    assert rows(db.sql("SELECT id FROM r WHERE x0 <= 6 AND x1 >= 6")) == [(2,)] and rows(db.sql("SELECT max(id) FROM r")) == [(3,)]


def test_attached_directories(spark, db, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "n.parquet"))
    db.sql(f"ATTACH '{tmp_path}' AS other; CREATE TABLE n AS SELECT id + 10 AS id FROM other.n WHERE n.id > 0")
    assert sorted(rows(db.sql("SELECT a.id FROM main.n a JOIN other.n b ON a.id = b.id + 10"))) == [(11,), (12,)]
    db.sql("DETACH other")
    with pytest.raises(SqlError):
        db.sql("SELECT * FROM other.n")


def test_user_functions_in_text(fixed):
    fixed.create_function("Twice", lambda x: None if x is None else 2 * x, "bigint")
    assert rows(fixed.sql("SELECT sum(twice(x)) / 4 FROM t")) == [(6,)]
    reader = fixed.rows("SELECT x FROM t ORDER BY x")
    assert next(reader)[0] == 1 and [r[0] for r in reader] == [2, 2, 3, 5]


def test_sqlite_files(spark, tmp_path):
    from quern.sources.sqlite import read_sqlite, write_sqlite

    path = str(tmp_path / "file.db")
    df = spark.createDataFrame([(1, "a", 1.5, bytearray(b"x")), (2, None, None, None), (700, "é", -2.0, bytearray(b""))], "id bigint, s string, v double, b binary")
    assert write_sqlite(df, path, "t") == 3
    back = read_sqlite(spark, path, "t", parts=3)
    assert back.schema.simpleString() == df.schema.simpleString() and sorted(rows(back), key=str) == sorted(rows(df), key=str)
    with pytest.raises(Exception, match="exists"):
        write_sqlite(df, path, "t")
    import sqlite3

    with sqlite3.connect(path) as own:
        own.execute("CREATE TABLE w(k TEXT PRIMARY KEY, n INT) WITHOUT ROWID")
        own.execute("INSERT INTO w VALUES ('q', 'no number')")
    assert rows(read_sqlite(spark, path, "w")) == [("q", None)]


def test_grammar():
    assert len(statements("SELECT 1; -- a remark\nSELECT ';' /* ; */;")) == 2
