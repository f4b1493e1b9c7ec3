"""Join shapes and subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import joins as J
from quern.plans.catalogue import Tables, query

SQL = {
    "join_inner": "select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey",
    "join_left": "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 150000",
    "join_right": "select c_custkey, o_orderkey from orders right join customer on c_custkey = o_custkey and o_totalprice > 200000",
    "join_full": "select n_nationkey, s_suppkey from (select * from nation where n_nationkey < 15) n full outer join (select * from supplier where s_acctbal > 1000) s on n_nationkey = s_nationkey",
    "join_cross": "select n_name, r_name from nation cross join region",
    "join_theta": "select r_regionkey, n_nationkey from region join nation on n_regionkey < r_regionkey and n_nationkey > 5",
    "join_self": "select a.n_name as first_name, b.n_name as second_name from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey",
    "join_derived": "select c_nationkey, n, n_name from (select c_nationkey, count(*) as n from customer group by c_nationkey) d join nation on c_nationkey = n_nationkey",
    "join_lateral": "select n_nationkey, c_custkey, c_acctbal from nation, lateral (select c_custkey, c_acctbal from customer where c_nationkey = n_nationkey order by c_acctbal desc, c_custkey limit 2) x",
    "join_outer_chain": "select n_nationkey, count(c_custkey) as customers, count(o_orderkey) as orders from nation left join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by n_nationkey",
    "sub_correlated": "select o_orderkey from orders o where o_totalprice > (select 1.2 * avg(o_totalprice) from orders i where i.o_custkey = o.o_custkey)",
    "sub_exists": "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')",
    "sub_not_exists": "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000)",
    "sub_in_select_list": "select n_nationkey, (select count(*) from customer where c_nationkey = n_nationkey) as customers from nation",
}

LATERAL = SQL.pop("join_lateral")
for _name, _sql in SQL.items():
    query(_name, _sql)(lambda t, sql=_sql: t.dialect(sql))


@query("join_lateral", LATERAL)
def _(t: Tables):
    """An extension: the dialect has no LATERAL of its own."""
    return t.sql(LATERAL.replace("from nation", "from {nation}").replace("from customer", "from {customer}"))


@query("sub_scalar", "select c_custkey, (c_acctbal - (select avg(cast(c_acctbal as decimal(12,2))) from customer) > 0)::int as above from customer")
def _(t: Tables):
    return t.dialect("SELECT c_custkey, c_acctbal - (SELECT sum(CAST(round(c_acctbal * 100) AS INTEGER)) / 100.0 / count(c_acctbal) FROM customer) > 0 AS above FROM customer")


@query("join_using", "select n_nationkey as k, n_name, r_name from nation join (select r_regionkey as n_regionkey, r_name from region) using (n_regionkey)")
def _(t: Tables):
    return J.using(t.nation, t.region.withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"]).select(F.col("n_nationkey").alias("k"), "n_name", "r_name")


@query("join_natural", "select a.k, x, y from (select n_nationkey as k, n_name as x from nation) a natural join (select s_nationkey as k, s_name as y from supplier) b")
def _(t: Tables):
    a = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("x"))
    return J.natural(a, t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("y"))).select("k", "x", "y")


@query("join_natural_no_common", "select n_name, r_name from nation, region")
def _(t: Tables):
    return J.natural(t.nation.select("n_name"), t.region.select("r_name"))


@query("join_semi", "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)")
def _(t: Tables):
    return J.in_subquery(t.customer, F.col("c_custkey"), t.orders.where("o_totalprice > 200000"), "o_custkey").select("c_custkey", "c_name")


@query("join_anti", "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 100000)")
def _(t: Tables):
    return J.not_in_subquery(t.customer, F.col("c_custkey"), t.orders.where("o_totalprice > 100000"), "o_custkey").select("c_custkey", "c_name")


@query("sub_not_in_with_null", "select n_nationkey from nation where n_nationkey not in (select case when s_suppkey % 2 = 0 then s_nationkey end from supplier)")
def _(t: Tables):
    values = t.supplier.select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("v"))
    return J.not_in_subquery(t.nation, F.col("n_nationkey"), values, "v").select("n_nationkey")


@query("sub_in", "select s_suppkey from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey in (1, 3))")
def _(t: Tables):
    return J.in_subquery(t.supplier, F.col("s_nationkey"), t.nation.where("n_regionkey in (1, 3)"), "n_nationkey").select("s_suppkey")


@query("sub_row_value", "select l_orderkey, l_linenumber from lineitem where (l_orderkey, l_linenumber) in (select o_orderkey, 1 from orders where o_orderstatus = 'O') and (l_partkey, l_suppkey) < (100, 5)")
def _(t: Tables):
    from quern.functions.semantics import row_less

    o = t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    less = row_less([F.col("l_partkey"), F.col("l_suppkey")], [F.lit(100), F.lit(5)])
    return t.lineitem.where(less).join(o, ["l_orderkey", "l_linenumber"], "left_semi").select("l_orderkey", "l_linenumber")


@query("asof_by_lateral", """
select e.event_id, (select p.value from events p where p.user_id = e.user_id and p.event_type = 'purchase' and p.ts < e.ts order by p.ts desc, p.event_id desc limit 1) as asof_value
from events e where e.event_type = 'click'""")
def _(t: Tables):
    clicks = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = t.events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    return J.as_of(clicks, bought, ["user_id"], "ts", "ts", ["value"], strict=True).select("event_id", "asof_value")


@query("asof_by_buckets", """
select e.event_id, (select p.value from events p where p.user_id = e.user_id and p.event_type = 'purchase' and p.ts < e.ts order by p.ts desc, p.event_id desc limit 1) as asof_value
from events e where e.event_type = 'click'""")
def _(t: Tables):
    """The same with each key's rows dealt by days."""
    clicks = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = t.events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    return J.as_of(clicks, bought, ["user_id"], "ts", "ts", ["value"], strict=True, width=86400).select("event_id", "asof_value")


@query("join_interval", """
select s_suppkey, count(*) as n from (select s_suppkey, s_acctbal as low, s_acctbal + 50 as high from supplier) s join customer on c_acctbal between low and high group by s_suppkey""")
def _(t: Tables):
    s = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 50).alias("high"))
    return J.interval(s, t.customer.select("c_acctbal"), "low", "high", "c_acctbal", 50.0).groupBy("s_suppkey").agg(F.count("*").alias("n"))


@query("update_from_join", "select c_custkey, case when n_name is null then c_acctbal else c_acctbal + 10 end as c_acctbal from customer left join nation on c_nationkey = n_nationkey and n_regionkey = 2")
def _(t: Tables):
    from quern.operators.dml import update_from

    picked = t.nation.where("n_regionkey = 2").select("n_nationkey")
    return update_from(t.customer, picked, F.col("c_nationkey") == F.col("n_nationkey"), {"c_acctbal": F.col("c_acctbal") + 10}).select("c_custkey", "c_acctbal")
