"""Expression semantics and functions on literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.functions import datetime as D
from quern.functions import json as J
from quern.functions import math as M
from quern.functions import misc as U
from quern.functions import semantics as S
from quern.functions import text as X
from quern.functions.format import printf


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def big(n):
    return F.lit(n).cast("bigint")


def cases():
    return [
        (S.add(big(S.INT_MAX), big(1)), None),
        (S.add_real(big(S.INT_MAX), big(1)), 9.223372036854775807e18),
        (S.overflows("multiply", big(1 << 40), big(1 << 40)), True),
        (S.int_div(-7, 2), -3),
        (S.int_div(7, 0), None),
        (S.int_div(big(S.INT_MIN), -1), None),
        (S.int_mod(-7, 3), -1),
        (S.int_mod(7, 0), None),
        (S.shift_left(1, 64), 0),
        (S.shift_left(8, -2), 2),
        (S.shift_right(-1, 70), -1),
        (S.cast_integer(F.lit(" 12abc")), 12),
        (S.cast_integer(F.lit("abc")), 0),
        (S.cast_integer(F.lit("99999999999999999999")), S.INT_MAX),
        (S.cast_real(F.lit("4.5e1x")), 45.0),
        (S.whole_number(F.lit("4x")), None),
        (S.whole_number(F.lit(" 4 ")), 4.0),
        (S.is_(F.lit(None).cast("int"), F.lit(None).cast("int")), True),
        (S.like(F.lit("AbC"), "a_c"), True),
        (S.like(F.lit("50%"), "50!%", "!"), True),
        (S.like(F.lit("505"), "50!%", "!"), False),
        (S.glob(F.lit("abc"), "a[a-c]?"), True),
        (S.glob(F.lit("Abc"), "a*"), False),
        (S.glob(F.lit("axc"), "a[^x]c"), False),
        (S.concat(F.lit("a"), F.lit(None).cast("string"), 1), "a1"),
        (S.concat_op(F.lit("a"), F.lit(None).cast("string")), None),
        (S.scalar_max(1, F.lit(None).cast("int")), None),
        (S.row_equal([F.lit(1), F.lit(None).cast("int")], [F.lit(1), F.lit(None).cast("int")]), None),
        (S.row_less([F.lit(1), F.lit(2)], [F.lit(1), F.lit(3)]), True),
        (S.round_(F.lit(-2.5)), -3.0),
        (S.real_text(F.lit(3.0)), "3.0"),
        (S.real_text(F.lit(1e20)), "1.0e+20"),
        (M.UNARY["sqrt"](F.lit(-1.0)), None),
        (M.log(100), 2.0),
        (M.log(2, 8), pytest.approx(3.0)),
        (M.mod(5, 0), None),
        (M.gcd(48, 36), 12),
        (M.lcm(4, 6), 12),
        (M.lcm(0, 6), 0),
        (M.trunc(F.lit(-2.7)), -2.0),
        (X.substr(F.lit("hello"), 2, 3), "ell"),
        (X.substr(F.lit("hello"), -3), "llo"),
        (X.substr(F.lit("hello"), 0, 2), "h"),
        (X.substr(F.lit("hello"), 3, -2), "he"),
        (X.replace(F.lit("abc"), F.lit(""), F.lit("x")), "abc"),
        (X.trim(F.lit("xxaxx"), "x"), "a"),
        (X.quote(F.lit("it's")), "'it''s'"),
        (X.quote(F.lit(None).cast("string")), "NULL"),
        (X.char(65, 0x1F600), "A\U0001f600"),
        (X.unicode(F.lit("")), None),
        (X.unhex(F.lit("4a4")), None),
        (F.hex(X.zeroblob(3)), "000000"),
        (X.soundex(F.lit("123")), "?000"),
        (X.soundex(F.lit("Robert")), "R163"),
        (X.unistr(F.lit("a\\u0062c")), "abc"),
        (D.date(F.lit("2023-05-18 15:30:45")), "2023-05-18"),
        (D.date(F.lit("2024-01-31"), "+1 month"), "2024-03-02"),
        (D.datetime(F.lit("2023-05-18"), "start of month", "+1 month", "-1 day"), "2023-05-31 00:00:00"),
        (D.date(F.lit("2023-05-18"), "weekday 0"), "2023-05-21"),
        (D.datetime(F.lit("1092941466"), "unixepoch"), "2004-08-19 18:51:06"),
        (D.julianday(F.lit("2000-01-01 12:00:00")), 2451545.0),
        (D.datetime(F.lit("2451545.0")), "2000-01-01 12:00:00"),
        (D.time(F.lit("12:30:15.250"), "subsec"), "12:30:15.250"),
        (D.datetime(F.lit("2023-05-18 15:30:00+02:00")), "2023-05-18 13:30:00"),
        (D.date(F.lit("nonsense")), None),
        (D.date(F.lit("2023-13-01")), None),
        (D.unixepoch(F.lit("1970-01-02")), 86400),
        (D.strftime("%Y/%j %w %%", F.lit("2023-02-01")), "2023/032 3 %"),
        (D.strftime("%B", F.lit("2023-02-01")), None),
        (D.timediff(F.lit("2023-03-15"), F.lit("2023-01-31")), "+0000-01-12 00:00:00.000"),
        (D.timediff(F.lit("2000-01-01"), F.lit("2001-02-03 04:05:06")), "-0001-01-02 04:05:06.000"),
        (printf("%05.1f|%-4s|%+d|%x|%,d", F.lit(3.14159), F.lit("ab"), F.lit(5), F.lit(255), F.lit(1234567)), "003.1|ab  |+5|ff|1,234,567"),
        (printf("%q %Q %w", F.lit("it's"), F.lit(None).cast("string"), F.lit('a"b')), "it''s NULL a\"\"b"),
        (printf("%%"), "%"),
        (J.json_set(F.lit('{"a":1,"b":[1,2]}'), "$.b[#]", F.lit(3)), '{"a":1,"b":[1,2,3]}'),
        (J.json_set(F.lit('{"a":1}'), "$.c.d", F.lit("x")), '{"a":1,"c":{"d":"x"}}'),
        (J.json_insert(F.lit('{"a":1}'), "$.a", F.lit(2)), '{"a":1}'),
        (J.json_replace(F.lit('{"a":1}'), "$.b", F.lit(2)), '{"a":1}'),
        (J.json_remove(F.lit('[0,1,2]'), "$[#-1]"), "[0,1]"),
        (J.json_patch(F.lit('{"a":1,"b":2}'), F.lit('{"a":null,"c":3}')), '{"b":2,"c":3}'),
        (J.json(F.lit(' { "a" : 1 , "a" : 2 } ')), '{"a":1,"a":2}'),
        (J.json_pretty(F.lit('{"a":[1]}')), '{\n    "a": [\n        1\n    ]\n}'),
        (J.json_valid(F.lit("{")), 0),
        (J.json_error_position(F.lit("[1 2]")), 4),
        (J.json_type(F.lit('{"a":[1]}'), "$.a"), "array"),
        (J.json_type(F.lit('{"a":true}'), "$.a"), "true"),
        (J.json_array_length(F.lit("[1,2,3]")), 3),
        (J.json_array(F.lit(1), F.lit("x"), F.lit(None).cast("string")), '[1,"x",null]'),
        (U.uuid_str(U.uuid_blob(F.lit("123e4567-e89b-12d3-a456-426614174000"))), "123e4567-e89b-12d3-a456-426614174000"),
        (F.length(U.uuid7_str()), 36),
        (F.length(U.randomblob(F.lit(11))), 11),
        (U.boolean_to_int(F.lit("Off")), 0),
        (U.int_to_boolean(F.lit(3)), "true"),
    ]


def test_cases(spark):
    found = cases()
    names = [f"c{i}" for i in range(len(found))]
    wrong = []
    for begin in range(0, len(found), 12):
        part = found[begin : begin + 12]
        row = spark.range(1).select(*(c.alias(n) for (c, _), n in zip(part, names[begin:], strict=False))).first()
        wrong += [(n, row[n], want) for (_, want), n in zip(part, names[begin:], strict=False) if row[n] != want]
    assert not wrong


def test_errors(spark):
    with pytest.raises(Exception, match="not a boolean"):
        one(spark, U.boolean_to_int(F.lit("maybe")))
    with pytest.raises(Exception, match="not an address"):
        one(spark, U.validate_ipaddr(F.lit("300.1.1.1")))
