"""String and blob functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.semantics import _c


def substr(x, start, length=None) -> Column:
    """1-based; a negative start counts from the end, a negative length takes what precedes, start 0 uses up one."""
    x, p = _c(x), _c(start).cast("bigint")
    n = F.length(x).cast("bigint")
    p = F.when(p < 0, n + p + 1).otherwise(p)
    if length is None:
        begin, end = p, n + 1
    else:
        k = _c(length).cast("bigint")
        begin, end = F.when(k < 0, p + k).otherwise(p), F.when(k < 0, p).otherwise(p + k)
    begin, end = F.greatest(begin, F.lit(1)), F.least(end, n + 1)
    return F.substring(x, begin.cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))


def replace(s, p, r) -> Column:
    return F.when(_c(p) == "", _c(s)).otherwise(F.replace(_c(s), _c(p), _c(r)))


def trim(s, chars=" ") -> Column:
    return F.btrim(_c(s), _c(chars))


def ltrim(s, chars=" ") -> Column:
    return F.ltrim(_c(s), _c(chars))


def rtrim(s, chars=" ") -> Column:
    return F.rtrim(_c(s), _c(chars))


def quote(x: Column, kind: str = "string") -> Column:
    """The SQL literal of a value."""
    if kind == "string":
        made = F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
    elif kind == "binary":
        made = F.concat(F.lit("X'"), F.hex(x), F.lit("'"))
    else:
        made = x.cast("string")
    return F.coalesce(made, F.lit("NULL"))


def char(*codes) -> Column:
    """The characters of code points; what is none becomes U+FFFD, null NUL."""
    out = []
    for code in codes:
        n = F.coalesce(_c(code).cast("int"), F.lit(0))
        n = F.when((n < 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit(0xFFFD)).otherwise(n)
        out.append(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "utf-32"))
    return F.concat(*out)


def unicode(s) -> Column:
    return F.when(F.length(_c(s)) > 0, F.ascii(_c(s)))


def unhex(s, ignore: str = "") -> Column:
    """Bytes of an even number of hex digits, else null."""
    t = F.translate(_c(s), ignore, "") if ignore else _c(s)
    return F.when(t.rlike(r"^(?:[0-9A-Fa-f]{2})*\z"), F.unhex(t))


def zeroblob(n) -> Column:
    return F.unhex(F.repeat(F.lit("00"), _c(n).cast("int")))


def soundex(s) -> Column:
    """?000 for what doesn't begin with a letter."""
    return F.when(F.coalesce(_c(s), F.lit("")).rlike("^[A-Za-z]"), F.soundex(_c(s))).otherwise(F.lit("?000"))


def instr(s, part) -> Column:
    return F.instr(_c(s), _c(part))


def typeof(x: Column, kind: str) -> Column:
    """The storage class of a column of a Spark type."""
    name = {"string": "text", "binary": "blob", "double": "real", "float": "real"}.get(kind, "integer")
    return F.when(x.isNull(), F.lit("null")).otherwise(F.lit(name))


_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|\+([0-9A-Fa-f]{6})|([0-9A-Fa-f]{4})|\\)")


def unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2] or m[3] or m[4], 16)) if m[0] != "\\\\" else "\\", text)


def unistr(s) -> Column:
    r"""\XXXX, \uXXXX, \+XXXXXX and \UXXXXXXXX escapes, and \\, decoded, in Arrow batches."""
    return _decoder()(_c(s))


def _decoder():
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def decode(v: pd.Series) -> pd.Series:
        return v.map(unescaped, na_action="ignore")

    return decode


def register(spark) -> None:
    spark.udf.register("quern_unistr", _decoder())
