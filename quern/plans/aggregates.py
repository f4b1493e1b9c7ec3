"""Aggregates."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quern.operators import aggregates as A
from quern.plans.catalogue import Tables, query

SQL = {
    "agg_empty": "select count(*) as n, cast(sum(o_custkey) as bigint) as s, max(o_orderkey) as m from orders where o_orderkey < 0",
    "agg_grouped": "select o_orderstatus, o_orderpriority, count(*) as n, min(o_totalprice) as low from orders group by o_orderstatus, o_orderpriority",
    "agg_expression": "select o_custkey % 10 as bucket, count(*) as n from orders group by o_custkey % 10",
    "agg_distinct": "select l_returnflag, count(distinct l_suppkey) as suppliers, cast(sum(distinct l_linenumber) as bigint) as lines from lineitem group by l_returnflag",
    "agg_filter": "select l_returnflag, count(*) filter (where l_quantity > 25) as many, max(l_extendedprice) filter (where l_linenumber = 1) as first_line from lineitem group by l_returnflag",
    "agg_having": "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 15",
    "select_distinct": "select distinct o_orderstatus, o_orderpriority from orders",
    "agg_cube": "select l_returnflag, l_linestatus, grouping(l_returnflag) as g, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)",
    "agg_rollup": "select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "select n_regionkey, n_name, count(*) as n from nation group by grouping sets ((n_regionkey), (n_name), ())",
}

EXTENSIONS = {n: SQL.pop(n) for n in ("agg_cube", "agg_rollup", "agg_grouping_sets")}  # the dialect has no grouping sets
for _name, _sql in SQL.items():
    query(_name, _sql)(lambda t, sql=_sql: t.dialect(sql))
for _name, _sql in EXTENSIONS.items():
    query(_name, _sql)(lambda t, sql=_sql: t.sql(re.sub(r"from (\w+)", r"from {\1}", sql)))


@query("agg_scalar", "select count(*) as n, cast(sum(cast(o_totalprice as decimal(14,2))) as double) as total, min(o_orderdate) as first_date, max(o_totalprice) as high from orders")
def _(t: Tables):
    return t.dialect("SELECT count(*) AS n, sum(CAST(round(o_totalprice * 100) AS INTEGER)) / 100.0 AS total, min(o_orderdate) AS first_date, max(o_totalprice) AS high FROM orders")


@query("agg_total", "select o_orderstatus, coalesce(sum(case when o_orderkey < 0 then 1.0 end), 0.0)::double as nothing, cast(sum(o_shippriority) as double) as total from (select *, cast(o_custkey as double) as o_shippriority from orders) group by o_orderstatus")
def _(t: Tables):
    return t.orders.groupBy("o_orderstatus").agg(A.total(F.when(F.col("o_orderkey") < 0, F.lit(1.0))).alias("nothing"), A.total(F.col("o_custkey")).alias("total"))


@query("agg_bare_max", "select o_custkey, max(o_totalprice) as high, arg_max(o_orderkey, o_totalprice) as o_orderkey from orders group by o_custkey")
def _(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("high"), A.bare(F.col("o_orderkey"), F.col("o_totalprice")).alias("o_orderkey"))


@query("agg_bare_min", "select o_custkey, min(o_totalprice) as low, arg_min(o_orderdate, o_totalprice) as o_orderdate from orders group by o_custkey")
def _(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.min("o_totalprice").alias("low"), A.bare(F.col("o_orderdate"), F.col("o_totalprice"), largest=False).alias("o_orderdate"))


@query("agg_group_concat_ordered", "select n_regionkey, string_agg(n_name, ';' order by n_name desc) as names, string_agg(cast(n_nationkey as varchar), ',' order by n_nationkey) as ids from nation group by n_regionkey")
def _(t: Tables):
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.reverse(F.sort_array(F.collect_list("n_name"))), ";").alias("names"), A.group_concat(F.col("n_nationkey"), ",", F.col("n_nationkey")).alias("ids"))


@query("agg_array_agg", "select n_regionkey, to_json(list(case when n_nationkey % 3 = 0 then null else n_nationkey end order by n_nationkey))::varchar as keys from nation group by n_regionkey")
def _(t: Tables):
    v = F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey"))
    return t.nation.groupBy("n_regionkey").agg(F.to_json(A.array_agg(v, F.col("n_nationkey")), {"ignoreNullFields": "false"}).alias("keys"))


@query("agg_json_group_array", "select n_regionkey, to_json(list(n_name order by n_nationkey))::varchar as names from nation group by n_regionkey")
def _(t: Tables):
    return t.nation.groupBy("n_regionkey").agg(A.json_group_array(F.col("n_name"), F.col("n_nationkey")).alias("names"))


@query("agg_json_group_object", "select n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' order by n_nationkey) || '}' as members from nation group by n_regionkey")
def _(t: Tables):
    return t.nation.groupBy("n_regionkey").agg(A.json_group_object(F.col("n_name"), F.col("n_nationkey"), F.col("n_nationkey")).alias("members"))


@query("agg_median", "select l_returnflag, median(l_quantity)::double as mid from lineitem group by l_returnflag")
def _(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(A.median(F.col("l_quantity")).alias("mid"))


@query("agg_percentile", "select l_returnflag, quantile_cont(l_quantity, 0.25)::double as cont, quantile_disc(l_linenumber, 0.75)::double as disc, quantile_cont(l_quantity, 0.9)::double as p90 from lineitem group by l_returnflag")
def _(t: Tables):
    return t.dialect("SELECT l_returnflag, percentile_cont(0.25) WITHIN GROUP (ORDER BY l_quantity) AS cont, percentile_disc(0.75) WITHIN GROUP (ORDER BY l_linenumber) AS disc, percentile(l_quantity, 90) AS p90 FROM lineitem GROUP BY l_returnflag")


@query("agg_mode", "select n_regionkey, min(k) as mode from (select n_regionkey, length(n_name) as k, count(*) as n, rank() over (partition by n_regionkey order by count(*) desc) as r from nation group by 1, 2) where r = 1 group by 1")
def _(t: Tables):
    return t.dialect("SELECT n_regionkey, mode() WITHIN GROUP (ORDER BY length(n_name)) AS mode FROM nation GROUP BY n_regionkey")


@query("agg_approx_distinct")
def _(t: Tables):
    """An extension: no twin, as the sketches differ."""
    return t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"))
