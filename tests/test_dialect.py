"""Dialect texts and the database of constrained frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.functions import udf
from quern.operators.catalog import Database, ForeignKey, explain_query_plan


@pytest.fixture
def db(spark):
    d = Database(spark)
    d.create("dept", spark.createDataFrame([(1, "Ops"), (2, "Dev")], "id int, name string"), key=("id",))
    emp = spark.createDataFrame([(1, "Ann", 1, 10.0), (2, "bob", 1, 20.0), (3, "Cy", None, None)], "id int, name string, dept int, pay double")
    d.create("emp", emp, key=("id",), not_null=("name",), checks={"pay": F.col("pay") >= 0}, foreign=(ForeignKey("dept", "dept", "id", "SET NULL"),))
    return d


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


CASES = [
    ("SELECT id FROM emp WHERE name LIKE 'A%' OR name GLOB '[b-c]*'", [(1,), (2,)]),
    ("SELECT id FROM emp WHERE dept IS NOT 1", [(3,)]),
    ("SELECT id FROM emp WHERE dept IS NULL", [(3,)]),
    ("SELECT id FROM emp WHERE dept ISNULL OR id == 1", [(1,), (3,)]),
    ("SELECT e.id, d.name FROM emp e JOIN dept d ON e.dept = d.id WHERE d.name = 'Ops'", [(1, "Ops"), (2, "Ops")]),
    ("SELECT id FROM emp ORDER BY id LIMIT 1, 1", [(2,)]),
    ("SELECT id FROM emp ORDER BY id LIMIT -1 OFFSET 1", [(2,), (3,)]),
    ("SELECT 0x1F AS a, 'it''s' AS b, CAST('12' AS INTEGER) AS c", [(31, "it's", 12)]),
    ("SELECT total(pay) AS t FROM emp WHERE id > 9", [(0.0,)]),
    ("SELECT max(1, NULL, 3) AS m, iif(1 = 1, 'y', 'n') AS i, log(100) AS l", [(None, "y", 2.0)]),
    ("SELECT id FROM emp WHERE id IN ()", []),
    ("SELECT id FROM emp NOT INDEXED WHERE id = 1", [(1,)]),
    ("SELECT 1 AS k UNION ALL SELECT 2 INTERSECT SELECT 2", [(2,)]),
    ('SELECT "id" FROM emp WHERE [name] REGEXP \'^C\'', [(3,)]),
    ("SELECT value FROM generate_series(1, 7, 3)", [(1,), (4,), (7,)]),
    ("WITH a AS MATERIALIZED (SELECT id FROM emp) SELECT count(*) AS n FROM a", [(3,)]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_text(db, text, want):
    assert rows(db.sql(text)) == sorted(want, key=repr)


def test_parameters(db):
    assert rows(db.sql("SELECT id FROM emp WHERE id > :low", low=2)) == [(3,)]


def test_constraints(spark, db):
    bad = spark.createDataFrame([(1, "Dup", 1, 1.0)], "id int, name string, dept int, pay double")
    with pytest.raises(ValueError, match="UNIQUE"):
        db.insert("emp", bad)
    db.insert("emp", bad, "ignore")
    assert db.frame("emp").count() == 3
    db.insert("emp", bad, "replace")
    assert ("Dup",) in rows(db.frame("emp").select("name"))
    with pytest.raises(ValueError, match="CHECK"):
        db.update("emp", F.col("id") == 2, {"pay": F.lit(-1.0)})
    db.settings["query_only"] = 1
    with pytest.raises(PermissionError):
        db.delete("emp", F.lit(True))


def test_foreign_keys_and_savepoints(db):
    db.settings["foreign_keys"] = 1
    db.savepoint("s")
    gone = db.delete("dept", F.col("id") == 1)
    assert rows(gone) == [(1, "Ops")]
    assert rows(db.frame("emp").select("dept").distinct()) == [(None,)]
    db.rollback_to("s")
    assert db.frame("dept").count() == 2 and db.pragma("foreign_key_check").count() == 0
    assert rows(db.pragma("integrity_check")) == [("ok",)]


def test_definitions(spark, db):
    db.create_index("by_name", "emp", ("name",), unique=True)
    assert [tuple(r)[1:3] for r in db.pragma("index_list", "emp").collect()] == [("by_name", 1)]
    assert [r["name"] for r in db.pragma("index_info", "by_name").collect()] == ["name"]
    db.add_column("emp", "city", "string", F.lit("X"))
    db.rename_column("emp", "city", "town")
    assert [r["name"] for r in db.pragma("table_info", "emp").collect()][-1] == "town"
    db.drop_column("emp", "town")
    with pytest.raises(ValueError):
        db.drop_column("emp", "id")
    db.create_view("v", db.sql("SELECT name FROM emp WHERE id = 1"))
    assert rows(db.sql("SELECT name FROM v")) == [("Ann",)]
    assert {r["name"] for r in db.schema().collect()} == {"dept", "emp", "v", "by_name"}
    assert rows(db.analyze("emp")) == [("emp", "by_name", "3 1")]
    db.drop("v")
    db.drop("v", if_exists=True)
    with pytest.raises(KeyError):
        db.drop("v")
    assert [r["from"] for r in db.pragma("foreign_key_list", "emp").collect()] == ["dept"]
    assert db.pragma("user_version", 7).first()[0] == 7 and db.pragma("nonsense").count() == 0
    assert explain_query_plan(db.frame("emp")).count() > 0


def test_user_functions(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", None)], "g string, v int")
    plus = udf.create_function(spark, "plus_one", lambda x: None if x is None else x + 1, "bigint")
    assert rows(df.select(plus("v"))) == [(2,), (4,), (None,)]
    got = udf.aggregate(df, ["g"], F.col("v"), 0, lambda s, x: s + (x or 0), lambda a, b: a + b, lambda s: s * 10, "x", "bigint")
    assert rows(got) == [("a", 40), ("b", 0)]
    key = udf.collation_key(lambda s: s[::-1])
    assert [r[0] for r in spark.createDataFrame([("az",), ("ba",)], "s string").orderBy(key("s")).collect()] == ["ba", "az"]
