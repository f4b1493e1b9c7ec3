"""Star-schema reports in the dialect: scans, filters, joins, aggregates, top-k.

Money is summed as whole ten-thousandths, so that sums don't depend on the order of rows; the twins sum decimals.
"""

from __future__ import annotations

from quern.plans.catalogue import Tables, query

MONEY = "cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))"

PRICING = f"""
select l_returnflag, l_linestatus,
  cast(sum(cast(l_quantity as decimal(12,2))) as double) as sum_qty,
  cast(sum(cast(l_extendedprice as decimal(12,2))) as double) as sum_base_price,
  cast(sum({MONEY}) as double) as sum_disc_price,
  cast(sum({MONEY} * (1 + cast(l_tax as decimal(4,2)))) as double) as sum_charge,
  cast(sum(cast(l_quantity as decimal(12,2))) as double) / count(*) as avg_qty,
  cast(sum(cast(l_discount as decimal(12,2))) as double) / count(*) as avg_disc,
  count(*) as count_order
from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00'
group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus"""

TWINS = {
    "pricing_summary": PRICING,
    "shipping_priority": f"""
select l_orderkey, cast(sum({MONEY}) as double) as revenue, o_orderdate
from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
where c_mktsegment = 'BUILDING' and o_orderdate < timestamp '1995-03-15 00:00:00' and l_shipdate > timestamp '1995-03-15 00:00:00'
group by l_orderkey, o_orderdate order by revenue desc, o_orderdate, l_orderkey limit 10""",
    "local_supplier_volume": f"""
select n_name, cast(sum({MONEY}) as double) as revenue
from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where r_name = 'ASIA' and o_orderdate >= timestamp '1996-01-01 00:00:00' and o_orderdate < timestamp '1999-01-01 00:00:00'
group by n_name order by revenue desc, n_name""",
    "forecast_revenue": """
select cast(sum(cast(l_extendedprice as decimal(12,2)) * cast(l_discount as decimal(4,2))) as double) as revenue from lineitem
where l_shipdate >= timestamp '1996-01-01 00:00:00' and l_shipdate < timestamp '1997-01-01 00:00:00' and l_discount between 0.05 and 0.07 and l_quantity < 24""",
    "volume_shipping": f"""
select supp_nation, cust_nation, l_year, cast(sum(volume) as double) as revenue from (
  select n1.n_name as supp_nation, n2.n_name as cust_nation, cast(extract(year from l_shipdate) as bigint) as l_year, {MONEY} as volume
  from supplier join lineitem on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
  join nation n1 on s_nationkey = n1.n_nationkey join nation n2 on c_nationkey = n2.n_nationkey
  where n1.n_regionkey = 2 and n2.n_regionkey = 3) shipping
group by supp_nation, cust_nation, l_year""",
    "market_share": f"""
select o_year, cast(sum(case when nation = 'NATION_2' then volume else 0 end) as double) / cast(sum(volume) as double) as mkt_share from (
  select cast(extract(year from o_orderdate) as bigint) as o_year, {MONEY} as volume, n2.n_name as nation
  from part join lineitem on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey join nation n1 on c_nationkey = n1.n_nationkey join region on n1.n_regionkey = r_regionkey
  join nation n2 on s_nationkey = n2.n_nationkey where r_name = 'AMERICA') all_nations
group by o_year""",
    "returned_items": f"""
select c_custkey, c_name, cast(sum({MONEY}) as double) as revenue, c_acctbal, n_name
from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join nation on c_nationkey = n_nationkey
where o_orderdate >= timestamp '1996-10-01 00:00:00' and o_orderdate < timestamp '1997-01-01 00:00:00' and l_returnflag = 'R'
group by c_custkey, c_name, c_acctbal, n_name order by revenue desc, c_custkey limit 20""",
    "promotion_effect": f"""
select 100.0 * cast(sum(case when p_type like 'PROMO%' then {MONEY} else 0 end) as double) / cast(sum({MONEY}) as double) as promo_revenue
from lineitem join part on l_partkey = p_partkey where l_shipdate >= timestamp '1995-09-01 00:00:00' and l_shipdate < timestamp '1995-10-01 00:00:00'""",
    "top_supplier": f"""
with revenue as (select l_suppkey as supplier_no, sum({MONEY}) as total_revenue from lineitem where l_shipdate >= timestamp '1996-01-01 00:00:00' and l_shipdate < timestamp '1996-04-01 00:00:00' group by l_suppkey)
select s_suppkey, s_name, cast(total_revenue as double) as total_revenue from supplier join revenue on s_suppkey = supplier_no
where total_revenue = (select max(total_revenue) from revenue)""",
    "large_volume_customers": """
select c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, cast(sum(cast(l_quantity as decimal(12,2))) as double) as sum_qty
from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey
where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 200)
group by c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice order by o_totalprice desc, o_orderdate, o_orderkey limit 100""",
    "catalog_search": """
select p_partkey, p_name, p_brand, o_orderkey from part join lineitem on p_partkey = l_partkey join orders on o_orderkey = l_orderkey
where lower(p_name) like '%a%' and o_orderstatus = 'F' order by p_name, o_orderkey, p_partkey limit 20""",
}



CENTS, PERCENT = "CAST(round(l_extendedprice * 100) AS INTEGER)", "CAST(round(l_discount * 100) AS INTEGER)"
PRICE = f"{CENTS} * (100 - {PERCENT})"  # in ten-thousandths
QUANTITY = "CAST(round(l_quantity * 100) AS INTEGER)"

REPORTS = {
    "pricing_summary": f"""
SELECT l_returnflag, l_linestatus, sum({QUANTITY}) / 100.0 AS sum_qty, sum({CENTS}) / 100.0 AS sum_base_price, sum({PRICE}) / 10000.0 AS sum_disc_price,
  sum({PRICE} * (100 + CAST(round(l_tax * 100) AS INTEGER))) / 1000000.0 AS sum_charge, sum({QUANTITY}) / 100.0 / count(*) AS avg_qty, sum({PERCENT}) / 100.0 / count(*) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "shipping_priority": f"""
SELECT l_orderkey, sum({PRICE}) / 10000.0 AS revenue, o_orderdate
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < '1995-03-15' AND l_shipdate > '1995-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "local_supplier_volume": f"""
SELECT n_name, sum({PRICE}) / 10000.0 AS revenue
FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
  AND r_name = 'ASIA' AND o_orderdate >= '1996-01-01' AND o_orderdate < '1999-01-01' GROUP BY n_name ORDER BY revenue DESC, n_name""",
    "forecast_revenue": f"""
SELECT sum({CENTS} * {PERCENT}) / 10000.0 AS revenue FROM lineitem
WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "volume_shipping": f"""
SELECT supp_nation, cust_nation, l_year, sum(volume) / 10000.0 AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(strftime('%Y', l_shipdate) AS INTEGER) AS l_year, {PRICE} AS volume
  FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey WHERE n1.n_regionkey = 2 AND n2.n_regionkey = 3) shipping
GROUP BY supp_nation, cust_nation, l_year""",
    "market_share": f"""
SELECT o_year, sum(iif(nation = 'NATION_2', volume, 0)) / 10000.0 / (sum(volume) / 10000.0) AS mkt_share FROM (
  SELECT CAST(strftime('%Y', o_orderdate) AS INTEGER) AS o_year, {PRICE} AS volume, n2.n_name AS nation
  FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey
  JOIN nation n2 ON s_nationkey = n2.n_nationkey WHERE r_name = 'AMERICA') GROUP BY o_year""",
    "returned_items": f"""
SELECT c_custkey, c_name, sum({PRICE}) / 10000.0 AS revenue, c_acctbal, n_name
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= '1996-10-01' AND o_orderdate < '1997-01-01' AND l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "promotion_effect": f"""
SELECT 100.0 * (sum(iif(p_type LIKE 'PROMO%', {PRICE}, 0)) / 10000.0) / (sum({PRICE}) / 10000.0) AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= '1995-09-01' AND l_shipdate < '1995-10-01'""",
    "top_supplier": f"""
WITH revenue AS (SELECT l_suppkey AS supplier_no, sum({PRICE}) AS total_revenue FROM lineitem WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1996-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue / 10000.0 AS total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)""",
    "large_volume_customers": f"""
SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum({QUANTITY}) / 100.0 AS sum_qty
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "catalog_search": """
SELECT p_partkey, p_name, p_brand, o_orderkey FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
WHERE p_name LIKE '%a%' AND o_orderstatus = 'F' ORDER BY p_name, o_orderkey, p_partkey LIMIT 20""",
}

for _name, _text in REPORTS.items():
    query(_name, TWINS[_name])(lambda t, text=_text: t.dialect(text))


@query("point_and_range_scan", "select o_orderkey, o_totalprice from orders where o_orderkey = 7 or o_orderkey between 100 and 200 or o_orderkey in (1, 2, 3)")
def _(t: Tables):
    from pyspark.sql import functions as F

    k = F.col("o_orderkey")
    return t.orders.where((k == 7) | k.between(100, 200) | k.isin(1, 2, 3)).select("o_orderkey", "o_totalprice")


@query("count_rows", "select count(*) as n from lineitem")
def _(t: Tables):
    from pyspark.sql import functions as F

    return t.lineitem.agg(F.count("*").alias("n"))


@query("reverse_scan", "select o_orderkey, o_orderstatus from orders order by o_orderkey desc")
def _(t: Tables):
    from pyspark.sql import functions as F

    return t.orders.select("o_orderkey", "o_orderstatus").orderBy(F.col("o_orderkey").desc())
