"""Set operations, sorting, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators.setops import chain, limited
from quern.plans.catalogue import Tables, query

NATIONS = "select n_nationkey as k from nation where n_nationkey < 12"
REGIONS = "select r_regionkey as k from region"
HIGH = "select n_nationkey as k from nation where n_nationkey > 3"


def _frames(t: Tables):
    n = t.nation.select(F.col("n_nationkey").alias("k"))
    return n.where("k < 12"), t.region.select(F.col("r_regionkey").alias("k")), n.where("k > 3")


for _name, _kind in (("set_union", "union"), ("set_union_all", "union all"), ("set_intersect", "intersect"), ("set_except", "except")):

    @query(_name, f"{NATIONS} {_kind} {REGIONS}")
    def _(t: Tables, kind=_kind):
        a, b, _ = _frames(t)
        return chain(a, (kind, b))


@query("set_chain_left_assoc", f"(({NATIONS} union all {REGIONS}) intersect ({HIGH})) except (select 5 as k)")
def _(t: Tables):
    a, b, c = _frames(t)
    return chain(a, ("union all", b), ("intersect", c), ("except", t.spark.sql("select 5 as k")))


@query("set_nulls_equal", "select case when n_nationkey % 2 = 0 then n_regionkey end as k from nation intersect select case when r_regionkey > 1 then r_regionkey end from region")
def _(t: Tables):
    a = t.nation.select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("k"))
    return chain(a, ("intersect", t.region.select(F.when(F.col("r_regionkey") > 1, F.col("r_regionkey")).alias("k"))))


@query("sort_nulls", "select event_id, v from (select event_id, case when event_id % 3 = 0 then null else value end as v from events) order by v asc nulls first, event_id")
def _(t: Tables):
    v = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    return t.events.select("event_id", v.alias("v")).orderBy(F.col("v").asc_nulls_first(), "event_id")


@query("sort_collate", "select p_partkey, p_name from part order by lower(p_name), p_partkey")
def _(t: Tables):
    return t.dialect("SELECT p_partkey, p_name FROM part ORDER BY p_name COLLATE NOCASE, p_partkey")


@query("sort_ordinal", "select o_orderstatus, o_orderkey from orders order by 1, 2 desc")
def _(t: Tables):
    return t.dialect("SELECT o_orderstatus, o_orderkey FROM orders ORDER BY 1, 2 DESC")


@query("sort_offset", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 10 offset 20")
def _(t: Tables):
    return limited(t.orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey").select("o_orderkey"), 10, 20)


@query("sort_limit_negative", "select n_nationkey from nation order by n_nationkey")
def _(t: Tables):
    return limited(t.nation.select("n_nationkey").orderBy("n_nationkey"), -1, -5)


@query("set_intersect_all", "select n_regionkey as k from nation intersect all select s_nationkey from supplier")
def _(t: Tables):
    """An extension."""
    return t.nation.select(F.col("n_regionkey").alias("k")).intersectAll(t.supplier.select("s_nationkey"))


@query("set_except_all", "select n_regionkey as k from nation except all select r_regionkey from region")
def _(t: Tables):
    """An extension."""
    return t.nation.select(F.col("n_regionkey").alias("k")).exceptAll(t.region.select("r_regionkey"))
