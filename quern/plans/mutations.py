"""DML as rewrites, constraints, change data, event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import dml
from quern.plans.catalogue import Tables, query
from quern.streaming.changes import captured, changes, replayed

C = F.col
NEW = "(select r_regionkey + 3 as r_regionkey, r_name || ' 2' as r_name from region)"


def _new(t: Tables):
    return t.region.select((C("r_regionkey") + 3).alias("r_regionkey"), F.concat("r_name", F.lit(" 2")).alias("r_name"))


@query("dml_insert", f"select * from region union all select * from {NEW} union all select 99, null")
def _(t: Tables):
    return dml.insert(dml.insert(t.region, _new(t)), t.spark.sql("select 99 as r_regionkey"))


@query("dml_or_ignore", f"select * from region union all select * from {NEW} where r_regionkey not in (select r_regionkey from region)")
def _(t: Tables):
    return dml.insert_or_ignore(t.region, _new(t), ["r_regionkey"])


@query("dml_or_replace", f"select * from {NEW} union all select * from region where r_regionkey not in (select r_regionkey from {NEW})")
def _(t: Tables):
    return dml.insert_or_replace(t.region, _new(t), ["r_regionkey"])


@query("dml_or_abort", f"select r_regionkey, 2::bigint as n from region where r_regionkey in (select r_regionkey from {NEW})")
def _(t: Tables):
    return dml.duplicates(t.region, _new(t), ["r_regionkey"])


@query("dml_upsert", f"select coalesce(o.r_regionkey, n.r_regionkey) as r_regionkey, case when o.r_regionkey is null then n.r_name when n.r_regionkey is null or o.r_regionkey = 3 then o.r_name else o.r_name || '+' || n.r_name end as r_name from region o full join {NEW} n on o.r_regionkey = n.r_regionkey")
def _(t: Tables):
    return dml.upsert(t.region, _new(t), ["r_regionkey"], {"r_name": F.concat("old_r_name", F.lit("+"), "new_r_name")}, where=C("old_r_regionkey") != 3)


@query("dml_update", "select c_custkey, case when c_acctbal < 0 then 0 else c_acctbal end as c_acctbal, case when c_acctbal < 0 then upper(c_name) else c_name end as c_name from customer")
def _(t: Tables):
    return dml.update(t.customer, C("c_acctbal") < 0, {"c_acctbal": F.lit(0.0), "c_name": F.upper("c_name")}).select("c_custkey", "c_acctbal", "c_name")


@query("dml_delete", "select o_orderkey from orders where not coalesce(o_totalprice > 100000, false)")
def _(t: Tables):
    return dml.delete(t.orders, C("o_totalprice") > 100000).select("o_orderkey")


@query("dml_returning", "select o_orderkey, o_custkey * 2 as twice from orders where o_orderstatus = 'P'")
def _(t: Tables):
    return dml.returning(t.orders, C("o_orderstatus") == "P", C("o_orderkey"), (C("o_custkey") * 2).alias("twice"))


@query("fk_check", "select n_nationkey from nation where n_regionkey not in (select r_regionkey from region where r_regionkey <> 3)")
def _(t: Tables):
    return dml.foreign_key_check(t.nation, "n_regionkey", t.region.where("r_regionkey <> 3"), "r_regionkey").select("n_nationkey")


@query("fk_cascade", "select s_suppkey from supplier where s_nationkey not in (select n_nationkey from nation where n_regionkey = 1)")
def _(t: Tables):
    return dml.cascade_delete(t.supplier, "s_nationkey", t.nation.where("n_regionkey = 1"), "n_nationkey").select("s_suppkey")


@query("fk_set_null", "select s_suppkey, case when s_nationkey in (select n_nationkey from nation where n_regionkey = 1) then null else s_nationkey end as s_nationkey from supplier")
def _(t: Tables):
    return dml.set_null(t.supplier, "s_nationkey", t.nation.where("n_regionkey = 1"), "n_nationkey").select("s_suppkey", "s_nationkey")


@query("check_violations", "select c_custkey, 'balance' as violated from customer where c_acctbal < 0 union all select c_custkey, 'segment' from customer where c_mktsegment = 'MACHINERY'")
def _(t: Tables):
    return dml.check_violations(t.customer, {"balance": C("c_acctbal") >= 0, "segment": C("c_mktsegment") != "MACHINERY"}).select("c_custkey", "violated")


@query("generated_column", "select o_orderkey, year(o_orderdate)::int as y, (year(o_orderdate) * 100 + o_orderkey % 100)::bigint as code from orders")
def _(t: Tables):
    return dml.generated(t.orders, {"y": F.year("o_orderdate"), "code": C("y") * 100 + C("o_orderkey") % 100}).select("o_orderkey", "y", "code")


def _after(t: Tables):
    rows = t.orders.where("o_orderkey % 10 <> 3")
    rows = rows.withColumn("o_totalprice", F.when(C("o_orderkey") % 7 == 0, C("o_totalprice") + 1).otherwise(C("o_totalprice")))
    return rows.unionByName(t.orders.where("o_orderkey % 50 = 1").withColumn("o_orderkey", C("o_orderkey") + 100_000_000))


AFTER = """(select * replace (case when o_orderkey % 7 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice) from orders where o_orderkey % 10 <> 3
union all select * replace (o_orderkey + 100000000 as o_orderkey) from orders where o_orderkey % 50 = 1)"""


@query("cdc_diff", f"""select coalesce(b.o_orderkey, a.o_orderkey) as o_orderkey, case when b.o_orderkey is null then 'insert' when a.o_orderkey is null then 'delete' else 'update' end as change_type, b.o_totalprice as old_price, a.o_totalprice as new_price
from orders b full join {AFTER} a on a.o_orderkey = b.o_orderkey where b.o_orderkey is null or a.o_orderkey is null or a.o_totalprice is distinct from b.o_totalprice""")
def _(t: Tables):
    return changes(t.orders, _after(t), ["o_orderkey"]).select("o_orderkey", "change_type", C("before.o_totalprice").alias("old_price"), C("after.o_totalprice").alias("new_price"))


@query("cdc_replay", f"select o_orderkey, o_totalprice from {AFTER}")
def _(t: Tables):
    return replayed(t.orders, changes(t.orders, _after(t), ["o_orderkey"]), ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("cdc_modes", f"""select coalesce(b.o_orderkey, a.o_orderkey) as o_orderkey, case when b.o_orderkey is null then 'insert' when a.o_orderkey is null then 'delete' else 'update' end as change_type, b.o_totalprice as old_price
from orders b full join {AFTER} a on a.o_orderkey = b.o_orderkey where b.o_orderkey is null or a.o_orderkey is null or a.o_totalprice is distinct from b.o_totalprice""")
def _(t: Tables):
    return captured(t.orders, _after(t), ["o_orderkey"], "before").select("o_orderkey", "change_type", C("before.o_totalprice").alias("old_price"))


@query("event_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def _(t: Tables):
    """An extension: tumbling event-time windows, as a batch."""
    return t.events.groupBy(F.window(C("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(C("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
