"""Operators on small frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.operators import dml, relations, setops
from quern.operators import joins as J
from quern.sources import files
from quern.streaming import changes as changes_


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_natural_without_common_columns(spark):
    a, b = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int"), spark.createDataFrame([(5, 6), (7, 8)], "c int, d int")
    assert len(rows(J.natural(a, b))) == 4


def test_not_in(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    values = spark.createDataFrame([(1,)], "v int")
    assert rows(J.not_in_subquery(left, F.col("k"), values, "v")) == [(2,)]
    assert rows(J.not_in_subquery(left, F.col("k"), values.unionAll(spark.sql("select cast(null as int)")), "v")) == []
    assert len(rows(J.not_in_subquery(left, F.col("k"), values.where("v > 5"), "v"))) == 3


def test_as_of_ties(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1)], "k string, at int")
    right = spark.createDataFrame([("a", 5, 50), ("a", 2, 20)], "k string, at int, v int")
    assert rows(J.as_of(left, right, ["k"], "at", "at", ["v"])) == [("a", 1, None), ("a", 5, 50)]
    assert rows(J.as_of(left, right, ["k"], "at", "at", ["v"], strict=True)) == [("a", 1, None), ("a", 5, 20)]
    for width in (1, 2, 100):
        assert rows(J.as_of(left, right, ["k"], "at", "at", ["v"], strict=True, width=width)) == [("a", 1, None), ("a", 5, 20)]


def test_chain_associates_left(spark):
    one, two = spark.sql("select 1 as k"), spark.sql("select 2 as k")
    assert rows(setops.chain(one, ("union all", two), ("intersect", two))) == [(2,)]
    with pytest.raises(ValueError):
        setops.chain(one, ("minus", two))


def test_series(spark):
    assert [r[0] for r in relations.generate_series(spark, 1, 10, 4).collect()] == [1, 5, 9]
    assert rows(relations.generate_series(spark, 5, 1)) == []
    assert [r[0] for r in relations.generate_series(spark, 1, 3, 0).collect()] == [1, 2, 3]


def test_json_tree(spark):
    df = spark.createDataFrame([(1, '{"a":[1,{"b":null}]}')], "id int, j string")
    got = [(r["fullkey"], r["type"], r["parent"]) for r in relations.json_tree(df.withColumnRenamed("id", "k"), "j", ["k"]).orderBy("id").collect()]
    assert got == [("$", "object", None), ("$.a", "array", 0), ("$.a[0]", "integer", 1), ("$.a[1]", "object", 1), ("$.a[1].b", "null", 3)]


def test_recursive_union_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a int, b int")
    step = edges.select(F.col("a").alias("m"), F.col("b").alias("t"))
    reach = relations.recursive_union(edges, lambda df: df.join(step, F.col("b") == F.col("m")).select("a", F.col("t").alias("b")))
    assert len(rows(reach)) == 9


def test_fts(spark):
    df = spark.createDataFrame([(1, "The Café of the World"), (2, "world of cats"), (3, None)], "id int, t string")
    tok = relations.tokens(F.col("t"))
    hits = lambda c: [r[0] for r in df.where(c).select("id").collect()]
    assert hits(relations.fts_match(tok, "cafe world")) == [1]
    assert hits(relations.fts_match(tok, '"of the"')) == [1]
    assert hits(relations.fts_match(tok, "ca* NOT cats")) == [1]
    assert hits(relations.fts_match(tok, "(cafe OR cats) AND of")) == [1, 2]


def test_dml(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (3, "z")], "k int, v string")
    assert rows(dml.insert_or_ignore(t, new, ["k"])) == [(1, "a"), (2, "b"), (3, "y")]
    assert rows(dml.insert_or_replace(t, new, ["k"])) == [(1, "a"), (2, "x"), (3, "z")]
    assert rows(dml.upsert(t, new.where("v <> 'z'"), ["k"], {"v": F.concat("old_v", "new_v")})) == [(1, "a"), (2, "bx"), (3, "y")]
    assert rows(dml.delete(t, F.col("v") == "a")) == [(2, "b")]
    assert rows(dml.check_violations(t, {"small": F.col("k") < 2})) == [(2, "b", "small")]


def test_changes_round_trip(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d")], "k int, v string")
    feed = changes_.changes(a, b, ["k"])
    assert sorted((r["k"], r["change_type"], r["updated"]) for r in feed.collect()) == [(2, "update", ["v"]), (3, "delete", []), (4, "insert", [])]
    assert rows(changes_.replayed(a, feed, ["k"])) == rows(b)


def test_stream_changes(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "z"), (9, "n")], "k int, v string").write.parquet(src)
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    seen = []
    stream = spark.readStream.schema("k int, v string").parquet(src)
    q = changes_.stream_changes(stream, lambda: old, ["k"], lambda df, n: seen.extend((r["k"], r["change_type"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [(1, "update"), (9, "insert")]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b\nc'), (2, None)], "k int, v string")
    files.write_csv(df, str(tmp_path / "c"))
    assert rows(files.read_csv(spark, str(tmp_path / "c"), "k int, v string")) == rows(df)
    files.write_json(df, str(tmp_path / "j"))
    assert rows(files.read_json(spark, str(tmp_path / "j"), "k int, v string", multi_line=False)) == rows(df)
    files.backup(df, str(tmp_path / "b"), 1)
    files.bulk_copy(spark, [(3, "x")], "k int, v string", str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 3
