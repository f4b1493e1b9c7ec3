"""Dialect texts over a database, its catalogue, user functions, collations, blobs, event streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions import udf
from quern.functions.misc import random
from quern.functions.semantics import lower
from quern.operators.catalog import Database, ForeignKey, explain_query_plan
from quern.plans.catalogue import Tables, query
from quern.sources.scratch import shared_folder
from quern.streaming.changes import tumbling

C = F.col


def _database(t: Tables) -> Database:
    db = Database(t.spark)
    db.create("region", t.region, key=("r_regionkey",), not_null=("r_name",))
    db.create("nation", t.nation, key=("n_nationkey",), foreign=(ForeignKey("n_regionkey", "region", "r_regionkey", "CASCADE"),))
    db.create("customer", t.customer, key=("c_custkey",), foreign=(ForeignKey("c_nationkey", "nation", "n_nationkey"),))
    for name in ("orders", "part", "events"):
        db.create(name, getattr(t, name))
    return db


TEXTS = {
    "dialect_predicates": (
        "SELECT n_nationkey FROM nation WHERE n_name GLOB 'NATION_1*' AND n_regionkey IS NOT 3 AND n_name NOTNULL OR n_nationkey == 0x02",
        "select n_nationkey from nation where n_name glob 'NATION_1*' and n_regionkey is distinct from 3 and n_name is not null or n_nationkey = 2",
    ),
    "dialect_compound": (
        "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3 UNION ALL SELECT r_regionkey FROM region INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 1",
        "(select n_nationkey as k from nation where n_nationkey < 3 union all select r_regionkey from region) intersect select n_nationkey from nation where n_nationkey > 1",
    ),
    "dialect_limit": (
        "SELECT o_orderkey FROM orders NOT INDEXED ORDER BY o_totalprice DESC, o_orderkey LIMIT 5, 10",
        "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 10 offset 5",
    ),
    "dialect_functions": (
        "SELECT c_nationkey, total(c_custkey) AS t, max(c_custkey) AS m, iif(count(*) > 50, 'many', 'few') AS size FROM customer WHERE c_name LIKE 'customer%' GROUP BY c_nationkey",
        "select c_nationkey, cast(sum(c_custkey) as double) as t, max(c_custkey) as m, if(count(*) > 50, 'many', 'few') as size from customer where c_name ilike 'customer%' group by c_nationkey",
    ),
    "dialect_join_cte": (
        "WITH big AS MATERIALIZED (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT c.c_name, big.n FROM customer c JOIN big ON c.c_custkey = big.o_custkey WHERE big.n > 12",
        "with big as (select o_custkey, count(*) as n from orders group by o_custkey) select c_name, n from customer join big on c_custkey = o_custkey where n > 12",
    ),
    "dialect_series": ("SELECT value FROM generate_series(3, 30, 9)", "select unnest(generate_series(3, 30, 9))::int as value"),
    "dialect_cast": (
        "SELECT p_partkey, CAST(p_size AS TEXT) || 'x' AS s, CAST(p_retailprice AS INTEGER) AS i FROM part",
        "select p_partkey, p_size::varchar || 'x' as s, trunc(p_retailprice)::bigint as i from part",
    ),
}
for _name, (_text, _twin) in TEXTS.items():
    query(_name, _twin)(lambda t, text=_text: _database(t).sql(text))


@query("catalog_schema", "select 'table' as type, name, name as tbl_name from (values ('region'), ('nation'), ('customer'), ('orders'), ('part'), ('events')) v(name) union all select 'index', 'by_region', 'nation'")
def _(t: Tables):
    db = _database(t)
    db.create_index("by_region", "nation", ("n_regionkey",))
    return db.schema()


@query("pragma_foreign_key_list", "select 0 as id, 0 as seq, 'region' as \"table\", 'n_regionkey' as \"from\", 'r_regionkey' as \"to\", 'NO ACTION' as on_update, 'CASCADE' as on_delete")
def _(t: Tables):
    return _database(t).pragma("foreign_key_list", "nation")


@query("pragma_foreign_key_check", "select 'nation' as \"table\", 'region' as parent, 0 as fkid from nation where n_regionkey = 4")
def _(t: Tables):
    db = _database(t)
    db.delete("region", C("r_regionkey") == 4)  # foreign keys are off by default
    return db.pragma("foreign_key_check")


@query("pragma_integrity_check", "select 'ok' as integrity_check")
def _(t: Tables):
    return _database(t).pragma("integrity_check")


@query("delete_cascade", "select n_nationkey from nation where n_regionkey <> 1")
def _(t: Tables):
    db = _database(t)
    db.settings["foreign_keys"] = 1
    db.drop("customer")
    db.delete("region", C("r_regionkey") == 1)
    return db.frame("nation").select("n_nationkey")


@query("savepoint_rollback", "select r_regionkey from region where r_regionkey <> 0")
def _(t: Tables):
    db = _database(t)
    db.delete("region", C("r_regionkey") == 0)
    db.savepoint("s")
    db.delete("region", C("r_regionkey") > 0)
    db.rollback_to("s")
    return db.frame("region").select("r_regionkey")


@query("analyze_stat", "select 'nation' as tbl, 'by_region' as idx, count(*) || ' ' || ceil(count(*) / count(distinct n_regionkey))::bigint as stat from nation")
def _(t: Tables):
    db = _database(t)
    db.create_index("by_region", "nation", ("n_regionkey",))
    return db.analyze("nation")


@query("explain_query_plan")
def _(t: Tables):
    """No twin: the plan's text."""
    return explain_query_plan(t.orders.groupBy("o_custkey").count())


@query("udf_registered", "select p_partkey, p_size * 2 + length(p_name) as v from part")
def _(t: Tables):
    f = udf.create_function(t.spark, "quern_twice_and", lambda a, b: 2 * a + len(b), "bigint")
    return t.part.select("p_partkey", f("p_size", "p_name").alias("v"))


@query("udaf_seed_step", "select o_orderstatus, cast(sum(o_custkey % 7) as bigint) as v from orders group by o_orderstatus")
def _(t: Tables):
    return udf.aggregate(t.orders, ["o_orderstatus"], C("o_custkey"), 0, lambda s, x: s + int(x) % 7, lambda a, b: a + b, lambda s: s, "v", "bigint")


@query("collate_nocase_group", "select lower(event_type) as k, count(*) as n from events group by 1")
def _(t: Tables):
    mixed = F.when(C("event_id") % 2 == 0, F.upper("event_type")).otherwise(C("event_type"))
    return t.events.groupBy(lower(mixed).alias("k")).agg(F.count("*").alias("n"))


@query("collate_rtrim", "select count(*) as n from orders where o_orderpriority = rtrim(o_orderpriority)")
def _(t: Tables):
    padded = F.concat("o_orderpriority", F.lit("   "))
    return t.orders.where(F.collate(padded, "UTF8_BINARY_RTRIM") == F.collate(C("o_orderpriority"), "UTF8_BINARY_RTRIM")).agg(F.count("*").alias("n"))


@query("fn_blob", "select n_nationkey, 'X''' || hex(n_name) || '''' as q, hex(substr(n_name, 2, 3)) as s, '0000' as z, strlen(n_name) as n from nation")
def _(t: Tables):
    blob = C("n_name").cast("binary")
    return t.nation.select("n_nationkey", X.quote(blob, "binary").alias("q"), F.hex(F.substring(blob, 2, 3)).alias("s"), F.hex(X.zeroblob(2)).alias("z"), F.octet_length(blob).cast("bigint").alias("n"))


@query("fn_random")
def _(t: Tables):
    """No twin: random values."""
    return t.nation.select("n_nationkey", random().alias("r"))


@query("stream_event_windows", "select time_bucket(interval '1 hour', ts) as start, count(*) as n, sum(event_id)::bigint as ids from events group by 1")
def _(t: Tables):
    """An extension: the events as a stream, in event-time windows, run to its end."""
    out = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/event[s].parquet").withColumn("at", C("ts").cast("timestamp"))
    counted = tumbling(stream, "at", "1 hour", "1 hour", n=F.count("*"), ids=F.sum("event_id"))
    run = counted.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/rows")).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return t.spark.read.parquet(f"{out}/rows").select(C("start").cast("timestamp_ntz").alias("start"), "n", "ids")
