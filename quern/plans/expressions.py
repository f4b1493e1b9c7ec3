"""Expression semantics and scalar function families."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import datetime as D
from quern.functions import json as Js
from quern.functions import math as M
from quern.functions import misc as U
from quern.functions import semantics as S
from quern.functions import text as X
from quern.functions.format import printf
from quern.plans.catalogue import Tables, query

C = F.col


@query("arith_overflow", "select o_orderkey, (9223372036854775807::hugeint + o_orderkey % 2 > 9223372036854775807) as over, 9223372036854775807::double + (o_orderkey % 2)::double as promoted, case when o_orderkey % 2 = 0 then 9223372036854775807 end as whole from orders")
def _(t: Tables):
    big, odd = F.lit(S.INT_MAX), C("o_orderkey") % 2
    return t.orders.select("o_orderkey", S.overflows("add", big, odd).alias("over"), S.add_real(big, odd).alias("promoted"), S.add(big, odd).alias("whole"))


@query("arith_div", "select l_orderkey, l_linenumber, (l_partkey - 100) // nullif(l_linenumber - 3, 0) * 0 + trunc((l_partkey - 100) / nullif(l_linenumber - 3, 0))::bigint as q, l_quantity / nullif(l_discount, 0) as r from lineitem")
def _(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", S.int_div(C("l_partkey") - 100, C("l_linenumber") - 3).alias("q"), S.real_div(C("l_quantity"), C("l_discount")).alias("r"))


@query("arith_mod", "select l_orderkey, l_linenumber, (l_partkey - 100) % nullif(l_linenumber - 3, 0) as m, fmod(l_quantity, l_linenumber) as f from lineitem")
def _(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", S.int_mod(C("l_partkey") - 100, C("l_linenumber") - 3).alias("m"), M.mod(C("l_quantity"), C("l_linenumber")).alias("f"))


@query("arith_bits", "select p_partkey, p_partkey & 12 as a, p_partkey | 5 as o, ~p_partkey as n, case when p_size > 5 then 0 else p_partkey << (p_size * 10) end as l, case when p_size >= 0 then p_partkey >> p_size end as r from (select p_partkey, p_size % 8 as p_size from part)")
def _(t: Tables):
    k, n = C("p_partkey"), C("p_size") % 8
    shift = F.when(n > 5, 64).otherwise(n * 10)
    return t.part.select("p_partkey", k.bitwiseAND(F.lit(12)).alias("a"), k.bitwiseOR(F.lit(5)).alias("o"), F.bitwise_not(k).alias("n"), S.shift_left(k, shift).alias("l"), S.shift_right(k, n).alias("r"))


@query("cast_prefix", r"select p_partkey, try_cast(regexp_extract(p_size || 'kg' || p_partkey, '^\s*([+-]?\d+)', 1) as bigint) as i, try_cast(p_size || '.5' as double) as r, 0 as z from part")
def _(t: Tables):
    text = S.concat_op(C("p_size"), F.lit("kg"), C("p_partkey"))
    return t.part.select("p_partkey", S.cast_integer(text).alias("i"), S.cast_real(S.concat_op(C("p_size"), F.lit(".5x"))).alias("r"), S.cast_integer(F.lit("abc")).cast("int").alias("z"))


@query("like_ci", "select p_partkey from part where p_name ilike '%RED%' and p_type not ilike 'pro_o%'")
def _(t: Tables):
    return t.part.where(S.like(C("p_name"), "%RED%") & ~S.like(C("p_type"), "pro_o%")).select("p_partkey")


@query("glob", "select p_partkey from part where p_brand glob 'Brand#[1-3]?' or p_name glob '*[!a-m]'")
def _(t: Tables):
    return t.part.where(S.glob(C("p_brand"), "Brand#[1-3]?") | S.glob(C("p_name"), "*[^a-m]")).select("p_partkey")


@query("regexp", "select p_partkey from part where regexp_matches(p_type, '^(PROMO|ECONO.Y)$')")
def _(t: Tables):
    return t.part.where(C("p_type").rlike("^(PROMO|ECONO.Y)$")).select("p_partkey")


@query("case_iif", "select o_orderkey, case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end as s, case when o_totalprice > 100000 then 'big' end as b, if(o_custkey % 2 = 0, 'even', 'odd') as p from orders")
def _(t: Tables):
    s = F.when(C("o_orderstatus") == "F", 1).when(C("o_orderstatus") == "O", 2).otherwise(3)
    return t.orders.select("o_orderkey", s.alias("s"), F.when(C("o_totalprice") > 100000, "big").alias("b"), F.when(C("o_custkey") % 2 == 0, "even").otherwise("odd").alias("p"))


@query("is_distinct", "select event_id, (v is not distinct from w) as same, (v is distinct from 3) as other, (v = w) as eq from (select event_id, case when event_id % 3 > 0 then user_id % 5 end as v, case when event_id % 4 > 0 then user_id % 3 end as w from events)")
def _(t: Tables):
    v, w = F.when(C("event_id") % 3 > 0, C("user_id") % 5), F.when(C("event_id") % 4 > 0, C("user_id") % 3)
    return t.events.select("event_id", S.is_(v, w).alias("same"), S.is_not(v, F.lit(3)).alias("other"), (v == w).alias("eq"))


@query("truth_values", "select event_id, coalesce((user_id % 3) <> 0, false) as t, not coalesce((user_id % 3) <> 0, false) as f, ((user_id % 3 <> 0) and null) is null as n from events")
def _(t: Tables):
    x = S.truth(C("user_id") % 3, "bigint")
    return t.events.select("event_id", F.coalesce(x, F.lit(False)).alias("t"), (~F.coalesce(x, F.lit(False))).alias("f"), (x & F.lit(None).cast("boolean")).isNull().alias("n"))


@query("between_in", "select o_orderkey, o_orderkey between 10 and 500 as b, o_custkey not between 5 and 50 as nb, o_orderstatus in ('F', 'P') as i, false as empty from orders")
def _(t: Tables):
    return t.orders.select("o_orderkey", C("o_orderkey").between(10, 500).alias("b"), (~C("o_custkey").between(5, 50)).alias("nb"), C("o_orderstatus").isin("F", "P").alias("i"), F.lit(False).alias("empty"))


@query("concat_nulls", "select event_id, case when event_id % 2 = 0 then null else event_type || '-' || user_id end as op, concat(case when event_id % 2 = 1 then event_type end, '-', user_id) as fn, concat_ws('/', case when event_id % 2 = 1 then event_type end, user_id) as ws from events")
def _(t: Tables):
    v = F.when(C("event_id") % 2 == 1, C("event_type"))
    return t.events.select("event_id", S.concat_op(v, F.lit("-"), C("user_id")).alias("op"), S.concat(v, F.lit("-"), C("user_id")).alias("fn"), F.concat_ws("/", v, C("user_id").cast("string")).alias("ws"))


@query("scalar_min_max", "select l_orderkey, l_linenumber, case when l_linenumber <> 2 then least(l_partkey, l_suppkey, 50) end as lo, case when l_linenumber <> 2 then greatest(l_partkey, l_suppkey, 50) end as hi from lineitem")
def _(t: Tables):
    third = F.when(C("l_linenumber") != 2, F.lit(50).cast("bigint"))
    return t.lineitem.select("l_orderkey", "l_linenumber", S.scalar_min(C("l_partkey"), C("l_suppkey"), third).alias("lo"), S.scalar_max(C("l_partkey"), C("l_suppkey"), third).alias("hi"))


@query("bind_parameters", "select n_nationkey, n_name from nation where n_regionkey = 2 and n_name > 'C'")
def _(t: Tables):
    return t.spark.sql("select n_nationkey, n_name from {nation} where n_regionkey = :region and n_name > :after", args={"region": 2, "after": "C"}, nation=t.nation)


@query("literals", "select 31 as hex, 1000000 as big, 1.5e3::double as real, 'it''s' as text, null::int as nothing")
def _(t: Tables):
    return t.spark.sql("select cast(conv('1F', 16, 10) as int) as hex, 1000000 as big, 1.5e3D as real, 'it\\'s' as text, cast(null as int) as nothing")


@query("fn_math", """select p_partkey, abs(p_size - 25) as a, ceil(p_retailprice) as c, floor(p_retailprice) as f, trunc(p_retailprice) as t, sign(p_size - 25)::int as s,
gcd(p_partkey, 36) as g, lcm(p_partkey, 6) as l, round(sqrt(p_size), 9) as q, round(log10(p_size), 9) as lg, round(log2(p_size), 9) as l2, round(ln(p_size), 9) as ln_, round(power(p_size, 0.5), 9) as pw, case when p_size > 25 then round(sqrt(p_size - 25), 9) end as dom from part""")
def _(t: Tables):
    p, z = C("p_retailprice"), C("p_size")
    r = lambda x: F.round(x, 9)
    return t.part.select(
        "p_partkey", F.abs(z - 25).alias("a"), M.ceil(p).alias("c"), M.floor(p).alias("f"), M.trunc(p).alias("t"), M.sign(z - 25).alias("s"), M.gcd(C("p_partkey"), 36).alias("g"), M.lcm(C("p_partkey"), 6).alias("l"),
        r(M.UNARY["sqrt"](z)).alias("q"), r(M.log(z)).alias("lg"), r(M.UNARY["log2"](z)).alias("l2"), r(M.UNARY["ln"](z)).alias("ln_"), r(M.power(z, 0.5)).alias("pw"), r(F.when(z > 25, M.UNARY["sqrt"](z - 25))).alias("dom"),
    )


@query("fn_trig", """select p_partkey, round(sin(x), 9) as s, round(cos(x), 9) as c, round(tan(x), 9) as t, round(asin(y), 9) as a, round(acos(y), 9) as ac, round(atan(x), 9) as at, round(atan2(x, 2), 9) as a2, round(sinh(y), 9) as sh, round(cosh(y), 9) as ch, round(tanh(y), 9) as th,
round(asinh(x), 9) as ash, round(acosh(x), 9) as ach, round(atanh(y), 9) as ath, round(degrees(x), 9) as d, round(radians(x), 9) as r, round(pi(), 9) as p, round(exp(y), 9) as e from (select p_partkey, p_size::double as x, p_size / 100.0 as y from part)""")
def _(t: Tables):
    x, y = C("p_size").cast("double"), C("p_size") / 100.0
    u = M.UNARY
    names = (("s", "sin", x), ("c", "cos", x), ("t", "tan", x), ("a", "asin", y), ("ac", "acos", y), ("at", "atan", x), ("sh", "sinh", y), ("ch", "cosh", y), ("th", "tanh", y), ("ash", "asinh", x), ("ach", "acosh", x), ("ath", "atanh", y), ("d", "degrees", x), ("r", "radians", x), ("e", "exp", y))
    return t.part.select("p_partkey", *(F.round(u[f](v), 9).alias(n) for n, f, v in names), F.round(M.atan2(x, 2), 9).alias("a2"), F.round(F.pi(), 9).alias("p"))


@query("fn_string", """select p_partkey, upper(p_name) as u, lower(p_type) as l, length(p_name) as n, substr(p_name, 2, 3) as s, right(p_name, 3) as e, replace(p_type, 'E', '3') as r, reverse(p_name) as rv, repeat(p_brand, 2) as rp, instr(p_name, 'a') as i, strlen(p_name) as o from part""")
def _(t: Tables):
    n = C("p_name")
    return t.part.select("p_partkey", S.upper(n).alias("u"), S.lower(C("p_type")).alias("l"), F.length(n).cast("bigint").alias("n"), X.substr(n, 2, 3).alias("s"), X.substr(n, -3).alias("e"), X.replace(C("p_type"), F.lit("E"), F.lit("3")).alias("r"), F.reverse(n).alias("rv"), F.repeat(C("p_brand"), F.lit(2)).alias("rp"), X.instr(n, F.lit("a")).cast("bigint").alias("i"), F.octet_length(n).cast("bigint").alias("o"))


@query("fn_trim_pad", "select p_partkey, trim('xy' || p_brand || 'yx', 'xy') as t, ltrim('  ' || p_brand) as l, rtrim(p_brand || '00', '0') as r, lpad(p_brand, 12, '*') as lp, rpad(p_brand, 4, '*') as rp from part")
def _(t: Tables):
    b = C("p_brand")
    return t.part.select("p_partkey", X.trim(F.concat(F.lit("xy"), b, F.lit("yx")), "xy").alias("t"), X.ltrim(F.concat(F.lit("  "), b)).alias("l"), X.rtrim(F.concat(b, F.lit("00")), "0").alias("r"), F.lpad(b, 12, "*").alias("lp"), F.rpad(b, 4, "*").alias("rp"))


@query("fn_null", "select event_id, coalesce(v, -1) as c, ifnull(v, 0) as i, nullif(user_id % 3, 1) as n, v is null as isn from (select *, case when event_id % 3 > 0 then user_id end as v from events)")
def _(t: Tables):
    v = F.when(C("event_id") % 3 > 0, C("user_id"))
    return t.events.select("event_id", F.coalesce(v, F.lit(-1)).alias("c"), F.ifnull(v, F.lit(0)).alias("i"), F.nullif(C("user_id") % 3, F.lit(1)).alias("n"), v.isNull().alias("isn"))


@query("fn_text_code", "select p_partkey, unicode(p_name) as u, chr((65 + p_partkey % 26)::int) || chr((128512 + p_size)::int) as c, '''' || replace(p_name, '''', '''''') || '''' as q from part")
def _(t: Tables):
    return t.part.select("p_partkey", X.unicode(C("p_name")).alias("u"), X.char(65 + C("p_partkey") % 26, 128512 + C("p_size")).alias("c"), X.quote(C("p_name")).alias("q"))


@query("fn_hex", "select p_partkey, hex(p_brand) as h, decode(unhex(hex(p_brand))) as b from part")
def _(t: Tables):
    return t.part.select("p_partkey", F.hex("p_brand").alias("h"), X.unhex(F.hex("p_brand")).cast("string").alias("b"))


DATES = "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"


@query("fn_date", f"select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as d, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as som, strftime(date_trunc('year', o_orderdate) + interval 1 year - interval 1 day, '%Y-%m-%d') as eoy, strftime(o_orderdate + interval 10 day, '%Y-%m-%d') as plus from orders")
def _(t: Tables):
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return t.orders.select("o_orderkey", D.date(text).alias("d"), D.date(text, "start of month").alias("som"), D.date(text, "start of year", "+1 year", "-1 day").alias("eoy"), D.date(text, "+10 days").alias("plus"))


@query("fn_time", "select event_id, strftime(ts, '%H:%M:%S') as t, strftime(ts + interval 90 minute, '%Y-%m-%d %H:%M:%S') as dt, (epoch(date_trunc('second', ts)))::bigint as u, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as sod from events")
def _(t: Tables):
    text = F.date_format(C("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSS")
    return t.events.select("event_id", D.time(text).alias("t"), D.datetime(text, "+90 minutes").alias("dt"), D.unixepoch(text).alias("u"), D.datetime(text, "start of day").alias("sod"))


@query("fn_strftime", "select event_id, strftime(ts, '%d/%m/%Y %H:%M') as a, strftime(ts, '%j') as j, strftime(ts, '%w') as w, strftime(ts, '%I %p') as p, strftime(ts, '%U') as u, strftime(ts, '%W') as wk, strftime(ts, '%G-%V') as iso from events")
def _(t: Tables):
    f = lambda p: D.format_timestamp(C("ts"), p)
    return t.events.select("event_id", f("%d/%m/%Y %H:%M").alias("a"), f("%j").alias("j"), f("%w").alias("w"), f("%I %p").alias("p"), f("%U").alias("u"), f("%W").alias("wk"), f("%G-%V").alias("iso"))


@query("fn_julian", "select o_orderkey, round(epoch(o_orderdate) / 86400.0 + 2440587.5, 6) as j, strftime(o_orderdate + interval ((7 + 1 - dayofweek(o_orderdate)) % 7) day, '%Y-%m-%d') as monday from orders")
def _(t: Tables):
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return t.orders.select("o_orderkey", F.round(D.julianday(text), 6).alias("j"), D.date(text, "weekday 1").alias("monday"))


TIMEDIFF = """select o_orderkey, sign || printf('%04d-%02d-%02d %02d:%02d:%02d.000', m // 12, m % 12, datediff('day', low + to_months(m), high) - (case when (low + to_months(m))::time > high::time then 1 else 0 end), s // 3600 % 24, s // 60 % 60, s % 60) as d from (
select o_orderkey, case when o_orderdate < other then '-' else '+' end as sign, least(o_orderdate, other) as low, greatest(o_orderdate, other) as high, datesub('month', least(o_orderdate, other), greatest(o_orderdate, other)) as m,
epoch(greatest(o_orderdate, other) - (least(o_orderdate, other) + to_months(datesub('month', least(o_orderdate, other), greatest(o_orderdate, other)))))::bigint as s
from (select *, timestamp '1995-06-17 12:30:00' as other from orders))"""


@query("fn_timediff", TIMEDIFF)
def _(t: Tables):
    a, b = (F.date_format(C(c), "yyyy-MM-dd HH:mm:ss") for c in ("o_orderdate", "other"))
    rows = t.orders.withColumn("other", F.lit("1995-06-17 12:30:00").cast("timestamp"))
    return rows.select("o_orderkey", D.timediff(a, b).alias("d"))


@query("fn_printf", "select p_partkey, printf('%5d|%-8s|%08.2f|%x|%+d', p_size, p_brand, p_retailprice, p_partkey, p_size - 25) as f from part")
def _(t: Tables):
    return t.part.select("p_partkey", printf("%5d|%-8s|%08.2f|%x|%+d", C("p_size"), C("p_brand"), C("p_retailprice"), C("p_partkey"), C("p_size") - 25).alias("f"))


@query("fn_typeof", "select p_partkey, 'text' as a, 'integer' as b, 'real' as c, case when p_size % 2 = 0 then 'null' else 'integer' end as d from part")
def _(t: Tables):
    return t.part.select("p_partkey", X.typeof(C("p_name"), "string").alias("a"), X.typeof(C("p_size"), "int").alias("b"), X.typeof(C("p_retailprice"), "double").alias("c"), X.typeof(F.when(C("p_size") % 2 == 1, C("p_size")), "int").alias("d"))


@query("fn_json_read", "select event_id, json_extract_string(props, '$.k') as k, json_valid(props)::int as v, case json_type(props, '$.k')::varchar when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' when 'VARCHAR' then 'text' when 'DOUBLE' then 'real' end as t, 0 as n from events")
def _(t: Tables):
    return t.events.select("event_id", Js.json_extract(C("props"), "$.k").alias("k"), Js.json_valid(C("props")).alias("v"), Js.json_type(C("props"), "$.k").alias("t"), Js.json_array_length(C("props")).alias("n"))


@query("fn_json_build", "select event_id, '[' || event_id || ',\"' || event_type || '\",null]' as a, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' as o from events")
def _(t: Tables):
    return t.events.select("event_id", Js.json_array(C("event_id"), C("event_type"), F.lit(None).cast("string")).alias("a"), Js.json_object(F.lit("id"), C("event_id"), F.lit("type"), C("event_type")).alias("o"))


@query("fn_json_write", "select event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"type\":\"' || event_type || '\"}' as s, '{}' as r, '{\"k\":0}' as p from events")
def _(t: Tables):
    return t.events.select("event_id", Js.json_set(C("props"), "$.type", C("event_type")).alias("s"), Js.json_remove(C("props"), "$.k").alias("r"), Js.json_patch(C("props"), F.lit('{"k":0}')).alias("p"))


@query("fn_uuid")
def _(t: Tables):
    """No twin: random values; their form is tested."""
    return t.nation.select("n_nationkey", U.uuid4_str().alias("u4"), U.uuid7_str().alias("u7"), F.length(U.uuid4()).alias("n"), U.randomblob(F.lit(5)).alias("r"))


@query("fn_misc", "select n_nationkey, '3.50.4' as v, (n_nationkey % 2)::int as b, case when n_nationkey % 2 <> 0 then 'true' else 'false' end as t, '10.0.0.' || n_nationkey as ip, n_name as l from nation")
def _(t: Tables):
    yes = F.when(C("n_nationkey") % 2 == 1, "yes").otherwise("off")
    return t.nation.select("n_nationkey", F.lit(U.SQLITE_VERSION).alias("v"), U.boolean_to_int(yes).alias("b"), U.int_to_boolean(C("n_nationkey") % 2).alias("t"), U.validate_ipaddr(F.concat(F.lit("10.0.0."), C("n_nationkey"))).alias("ip"), C("n_name").alias("l"))
