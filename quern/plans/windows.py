"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import windows as W
from quern.plans.catalogue import Tables, query

SQL = {
    "win_rank_family": "select o_orderkey, row_number() over w as rn, rank() over w as rk, dense_rank() over w as dr, percent_rank() over w as pr, cume_dist() over w as cd from orders window w as (partition by o_orderstatus order by o_orderpriority, o_orderkey)",
    "win_rank_ties": "select o_orderkey, rank() over (partition by o_custkey order by o_orderpriority) as rk, dense_rank() over (partition by o_custkey order by o_orderpriority) as dr from orders",
    "win_ntile": "select o_orderkey, ntile(4) over (partition by o_orderstatus order by o_orderkey) as quarter from orders",
    "win_lag_lead": "select event_id, lag(value) over w as before, lead(value, 2) over w as after, lag(value, 1, -1.0) over w as filled from events window w as (partition by user_id order by ts, event_id)",
    "win_nth": "select o_orderkey, first_value(o_totalprice) over w as f, last_value(o_totalprice) over w as l, nth_value(o_totalprice, 2) over w as second from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following)",
    "win_range": "select l_orderkey, l_linenumber, count(*) over (partition by l_suppkey order by l_partkey range between 10 preceding and 10 following) as near from lineitem",
    "win_default_frame": "select o_orderkey, count(*) over (partition by o_custkey order by o_orderpriority) as upto from orders",
    "win_over_group": "select o_orderstatus, o_orderpriority, count(*) as n, sum(count(*)) over (partition by o_orderstatus) as all_n from orders group by o_orderstatus, o_orderpriority",
    "win_multiple_orders": "select o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as a, row_number() over (partition by o_custkey order by o_orderkey desc) as b from orders",
    "win_topk_per_group": "select * from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) x where rn <= 2",
}

for _name, _sql in SQL.items():
    query(_name, _sql.replace("sum(count(*)) over (partition by o_orderstatus)", "cast(sum(count(*)) over (partition by o_orderstatus) as bigint)"))(lambda t, sql=_sql: t.dialect(sql))


@query("win_groups", "select l_orderkey, l_linenumber, count(*) over (partition by l_suppkey order by l_partkey groups between 1 preceding and 1 following) as n from lineitem")
def _(t: Tables):
    rows = W.groups_frame(t.lineitem, ["l_suppkey"], [F.col("l_partkey")])
    return rows.select("l_orderkey", "l_linenumber", F.count("*").over(W.groups_between(["l_suppkey"], -1, 1)).alias("n"))


@query("win_running", "select o_orderkey, cast(sum(cast(o_totalprice as decimal(14,2))) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and current row) as double) as running from orders")
def _(t: Tables):
    return t.dialect("SELECT o_orderkey, sum(CAST(round(o_totalprice * 100) AS INTEGER)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) / 100.0 AS running FROM orders")


@query("win_rows", "select event_id, cast(sum(cast(value as decimal(14,4))) over (partition by user_id order by ts, event_id rows between 1 preceding and 1 following) as double) as around from events")
def _(t: Tables):
    return t.dialect("SELECT event_id, sum(CAST(round(value * 10000) AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 10000.0 AS around FROM events")


@query("win_unordered", "select n_nationkey, 1::bigint as r, count(*) over (partition by n_regionkey) as n from nation")
def _(t: Tables):
    return t.dialect("SELECT n_nationkey, rank() OVER (PARTITION BY n_regionkey) AS r, max(n) OVER (PARTITION BY n_regionkey) AS n FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey) AS n FROM nation)")


@query("win_exclude_text", "select o_orderkey, max(o_totalprice) over (partition by o_custkey order by o_orderpriority range between unbounded preceding and unbounded following exclude group) as others, sum(o_orderkey) over (partition by o_custkey order by o_orderpriority groups between 1 preceding and 1 following exclude ties)::bigint as near from orders")
def _(t: Tables):
    return t.dialect("SELECT o_orderkey, max(o_totalprice) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP) AS others, sum(o_orderkey) OVER (w GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE TIES) AS near FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")


def _frames():
    ordered = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return ordered.rowsBetween(-2, 2), ordered.rowsBetween(0, 0)


@query("win_exclude_current", "select event_id, cast(sum(cast(value as decimal(14,4))) over (partition by user_id order by ts, event_id rows between 2 preceding and 2 following exclude current row) as double) as others from events")
def _(t: Tables):
    frame, own = _frames()
    return t.events.select("event_id", W.sum_excluding(F.col("value").cast("decimal(14,4)"), frame, own).cast("double").alias("others"))


@query("win_exclude_group", "select o_orderkey, count(*) over (partition by o_custkey order by o_orderpriority range between unbounded preceding and unbounded following exclude group) as n from orders")
def _(t: Tables):
    whole = Window.partitionBy("o_custkey")
    peers = Window.partitionBy("o_custkey", "o_orderpriority")
    return t.orders.select("o_orderkey", (F.count("*").over(whole) - F.count("*").over(peers)).alias("n"))


@query("win_exclude_ties", "select o_orderkey, count(*) over (partition by o_custkey order by o_orderpriority range between unbounded preceding and unbounded following exclude ties) as n from orders")
def _(t: Tables):
    whole = Window.partitionBy("o_custkey")
    peers = Window.partitionBy("o_custkey", "o_orderpriority")
    return t.orders.select("o_orderkey", (F.count("*").over(whole) - F.count("*").over(peers) + 1).alias("n"))


@query("win_filter", "select o_orderkey, count(*) filter (where o_orderstatus = 'F') over (partition by o_custkey order by o_orderkey) as finished from orders")
def _(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t.orders.select("o_orderkey", W.filtered(F.count, F.lit(1), F.col("o_orderstatus") == "F", w).alias("finished"))


@query("win_distinct", "select o_orderkey, count(distinct o_orderpriority) over (partition by o_custkey) as kinds from orders")
def _(t: Tables):
    return W.with_distinct(t.orders, F.col("o_orderpriority"), ["o_custkey"], [], count="kinds").select("o_orderkey", "kinds")


@query("win_named_chain", "select o_orderkey, count(*) over (partition by o_custkey order by o_orderkey) as n, count(*) over (partition by o_custkey) as all_n from orders")
def _(t: Tables):
    base = Window.partitionBy("o_custkey")
    return t.orders.select("o_orderkey", F.count("*").over(base.orderBy("o_orderkey")).alias("n"), F.count("*").over(base).alias("all_n"))


@query("win_lag_per_row", """with r as (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from orders)
select a.o_orderkey, b.o_totalprice as before from r a left join r b on a.o_custkey = b.o_custkey and b.n = a.n - (a.o_orderkey % 3 - 1)""")
def _(t: Tables):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return W.lag_by(F.col("o_totalprice"), F.col("o_orderkey") % 3 - 1, ["o_custkey"], [F.col("o_orderkey")], rows, "before").select("o_orderkey", "before")
