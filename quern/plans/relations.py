"""Table-valued functions, CTEs, text search, boxes, catalogue frames, user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quern.operators import relations as R
from quern.plans.catalogue import Tables, query

C = F.col

SQL = {
    "cte_plain": "with big as (select o_custkey, count(*) as n from orders where o_totalprice > 150000 group by o_custkey) select c_name, n from big join customer on c_custkey = o_custkey",
    "cte_recursive_all": "with recursive r(n, f) as (select 1, cast(1 as bigint) union all select n + 1, f * (n + 1) from r where n < 15) select n, f from r",
    "values_rows": "select column1, column2 from (values (1, 'a'), (2, 'b'), (3, null))",
    "derived_view": "select r_name, n from (select n_regionkey, count(*) as n from nation group by n_regionkey) d join region on r_regionkey = n_regionkey",
    "source_less": "select 1 as a, 'x' as b, cast(null as int) as c",
}
for _name, _sql in SQL.items():
    query(_name, _sql.replace("(3, null))", "(3, null)) v(column1, column2)"))(lambda t, sql=_sql: t.dialect(sql))


@query("cte_materialized", "with m as (select o_custkey, sum(cast(o_totalprice as decimal(14,2))) as s from orders group by o_custkey) select a.o_custkey from m a where a.s > (select avg(s) from m)")
def _(t: Tables):
    m = t.orders.groupBy("o_custkey").agg(F.sum(C("o_totalprice").cast("decimal(14,2)")).alias("s"))
    mean = m.agg(F.avg("s").alias("mean"))  # one row
    return m.crossJoin(F.broadcast(mean)).where("s > mean").select("o_custkey")


@query("cte_recursive_distinct", "select n_nationkey as k from nation")
def _(t: Tables):
    """Keys reached from 0 by two steps modulo 25: every one."""
    seed = t.nation.where("n_nationkey = 0").select(C("n_nationkey").alias("k"))
    return R.recursive_union(seed, lambda df: df.select(((C("k") * 2 + 1) % 25).cast("int").alias("k")).unionAll(df.select(((C("k") + 7) % 25).cast("int").alias("k"))))


@query("cte_graph", """with recursive edges as (select distinct s_nationkey as a, c_nationkey as b from supplier join customer on s_suppkey = c_custkey),
reach(a, b) as (select a, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a) select a, b from reach""")
def _(t: Tables):
    edges = t.supplier.join(t.customer, C("s_suppkey") == C("c_custkey")).select(C("s_nationkey").alias("a"), C("c_nationkey").alias("b")).distinct()
    step = edges.select(C("a").alias("m"), C("b").alias("to"))
    return R.recursive_union(edges, lambda df: df.join(step, C("b") == C("m")).select("a", C("to").alias("b")))


@query("tvf_generate_series", "select unnest(generate_series(5, 100, 7)) as value union all select unnest(generate_series(10, 1, -3))")
def _(t: Tables):
    return R.generate_series(t.spark, 5, 100, 7).unionAll(R.generate_series(t.spark, 10, 1, -3)).unionAll(R.generate_series(t.spark, 5, 1))


JSON_EACH = "select event_id, 'k' as key, json_extract_string(props, '$.k') as value, 'integer' as type, json_extract_string(props, '$.k') as atom, 1::bigint as id, null::bigint as parent, '$.k' as fullkey, '$' as path from events"


@query("tvf_json_each", JSON_EACH)
def _(t: Tables):
    return R.json_each(t.events, "props", ["event_id"])


@query("tvf_json_each_text", JSON_EACH)
def _(t: Tables):
    return t.dialect("SELECT event_id, j.* FROM events, json_each(props) j")


@query("tvf_json_tree", "select event_id, null as key, replace(props, ' ', '') as value, 'object' as type, null as atom, 0::bigint as id, null::bigint as parent, '$' as fullkey, '$' as path from events union all select event_id, 'k', json_extract_string(props, '$.k'), 'integer', json_extract_string(props, '$.k'), 1, 0, '$.k', '$' from events")
def _(t: Tables):
    return R.json_tree(t.events.select("event_id", "props"), "props", ["event_id"])


WORDS = "list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


@query("fts_term", f"select doc_id, len(list_filter({WORDS}, lambda x: x = 'the')) as n from documents where list_contains({WORDS}, 'the')")
def _(t: Tables):
    tok = R.tokens(C("text"))
    return t.documents.where(R.fts_term(tok, "the")).select("doc_id", R.fts_count(tok, "the").cast("bigint").alias("n"))


@query("fts_phrase", f"select doc_id from documents where contains(' ' || array_to_string({WORDS}, ' ') || ' ', ' of the ')")
def _(t: Tables):
    return t.documents.where(R.fts_phrase(R.tokens(C("text")), "of", "the")).select("doc_id")


@query("fts_prefix", f"select doc_id from documents where len(list_filter({WORDS}, lambda x: starts_with(x, 'worth'))) > 0")
def _(t: Tables):
    return t.documents.where(R.fts_prefix(R.tokens(C("text")), "worth")).select("doc_id")


@query("fts_boolean", f"select doc_id from documents where (list_contains({WORDS}, 'the') or list_contains({WORDS}, 'der')) and not list_contains({WORDS}, 'with')")
def _(t: Tables):
    return t.documents.where(R.fts_match(R.tokens(C("text")), "(the OR der) NOT with")).select("doc_id")


@query("fts_postings", f"select token, count(*) as docs, sum(n)::bigint as n from (select doc_id, token, count(*) as n from (select doc_id, unnest({WORDS}) as token from documents) group by 1, 2) group by 1")
def _(t: Tables):
    return R.postings(t.documents, "doc_id", "text").groupBy("token").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))


@query("rtree_intersects", "select l_orderkey, l_linenumber from lineitem where l_partkey <= 120 and l_partkey + 10 >= 100 and l_quantity <= 20 and l_quantity + 5 >= 10")
def _(t: Tables):
    x, y = C("l_partkey"), C("l_quantity")
    return t.lineitem.where(R.intersects([(x, x + 10), (y, y + 5)], [(100, 120), (10, 20)])).select("l_orderkey", "l_linenumber")


@query("rtree_contains", "select l_orderkey, l_linenumber from lineitem where l_partkey >= 100 and l_partkey + 10 <= 150 and l_quantity >= 10 and l_quantity + 5 <= 30")
def _(t: Tables):
    x, y = C("l_partkey"), C("l_quantity")
    return t.lineitem.where(R.contained([(x, x + 10), (y, y + 5)], [(100, 150), (10, 30)])).select("l_orderkey", "l_linenumber")


@query("rtree_join", """with a as (select s_suppkey as id, s_acctbal as x0, s_acctbal + 20 as x1, s_nationkey as y0, s_nationkey + 1 as y1 from supplier), b as (select c_custkey as id, c_acctbal as x0, c_acctbal + 20 as x1, c_nationkey as y0, c_nationkey + 1 as y1 from customer)
select a.id as a_id, b.id as b_id from a join b on a.x0 <= b.x1 and a.x1 >= b.x0 and a.y0 <= b.y1 and a.y1 >= b.y0""")
def _(t: Tables):
    box = lambda df, k, x, y: df.select(C(k).alias("id"), C(x).alias("x0"), (C(x) + 20).alias("x1"), C(y).alias("y0"), (C(y) + 1).alias("y1"))
    return R.box_join(box(t.supplier, "s_suppkey", "s_acctbal", "s_nationkey"), box(t.customer, "c_custkey", "c_acctbal", "c_nationkey"), 20.0)


@query("catalog_table_info", "select (row_number() over ()) - 1 as cid, column_name as name, case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' when 'VARCHAR' then 'string' else 'timestamp_ntz' end as type, 0 as notnull from (select * from duckdb_columns() where table_name = 'lineitem' order by column_index)")
def _(t: Tables):
    return R.table_info(t.lineitem)


@query("catalog_table_list", "select table_name as name, 'table' as type, count(*) as ncol from duckdb_columns() where table_name in ('region', 'nation', 'customer', 'orders', 'lineitem', 'events') group by 1")
def _(t: Tables):
    return R.table_list({n: getattr(t, n) for n in ("region", "nation", "customer", "orders", "lineitem", "events")})


@query("udf_scalar", "select p_partkey, length(p_name) - length(replace(replace(replace(replace(replace(p_name, 'a', ''), 'e', ''), 'i', ''), 'o', ''), 'u', '')) as vowels from part")
def _(t: Tables):
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("bigint")
    def vowels(s):
        return s.str.count("[aeiou]")

    return t.part.select("p_partkey", vowels("p_name").alias("vowels"))


@query("udaf_grouped", "select o_orderstatus, cast(max(o_orderkey) - min(o_orderkey) as bigint) as spread from orders group by o_orderstatus")
def _(t: Tables):
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("bigint")
    def spread(s: pd.Series) -> int:
        return int(s.max() - s.min())

    # the extremes of each bucket first, so that no group is larger than the number of buckets
    bounds = t.orders.groupBy("o_orderstatus", (C("o_orderkey") % 64).alias("b")).agg(F.array(F.min("o_orderkey"), F.max("o_orderkey")).alias("k"))
    return bounds.select("o_orderstatus", F.explode("k").alias("k")).groupBy("o_orderstatus").agg(spread("k").alias("spread"))


@query("udtf_split", "select n_nationkey, unnest(string_split(n_name, ' ')) as word from nation")
def _(t: Tables):
    from pyspark.sql.functions import udtf

    @udtf(returnType="word string")
    class Split:
        def eval(self, text: str):
            for word in text.split(" "):
                yield (word,)

    t.spark.udtf.register("quern_split", Split)
    return t.spark.sql("select n_nationkey, word from {n}, lateral quern_split(n_name)", n=t.nation)
