"""Expression semantics of the SQLite dialect where they differ from ANSI Spark."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INT_MAX, INT_MIN = (1 << 63) - 1, -(1 << 63)
INT_PREFIX = r"^[ \t\n\f\r]*([+-]?\d+)"
REAL_PREFIX = r"^[ \t\n\f\r]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def add(a, b) -> Column:
    """Integer sum; null where it leaves 64 bits (see add_real)."""
    return F.try_add(_c(a), _c(b))


def subtract(a, b) -> Column:
    return F.try_subtract(_c(a), _c(b))


def multiply(a, b) -> Column:
    return F.try_multiply(_c(a), _c(b))


def add_real(a, b) -> Column:
    """What a sum promotes to when it overflows."""
    return _c(a).cast("double") + _c(b).cast("double")


def multiply_real(a, b) -> Column:
    return _c(a).cast("double") * _c(b).cast("double")


def overflows(kind: str, a, b) -> Column:
    """Whether an integer operation leaves 64 bits; null operands give null."""
    whole = {"add": add, "subtract": subtract, "multiply": multiply}[kind](a, b)
    return F.when(_c(a).isNotNull() & _c(b).isNotNull(), whole.isNull())


def int_div(a, b) -> Column:
    """Truncating division; null for a zero divisor and for the one quotient that doesn't fit."""
    a, b = _c(a).cast("bigint"), _c(b).cast("bigint")
    safe = F.when((b != 0) & ~((a == INT_MIN) & (b == -1)), b)
    return _div(a, safe)


def _div(a: Column, b: Column) -> Column:
    quotient = F.floor(F.try_divide(F.abs(a).cast("decimal(38,0)"), F.abs(b).cast("decimal(38,0)"))).cast("bigint")
    return F.when((a < 0) != (b < 0), -quotient).otherwise(quotient)


def real_div(a, b) -> Column:
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def int_mod(a, b) -> Column:
    """Remainder with the dividend's sign; null for zero."""
    a, b = _c(a).cast("bigint"), _c(b).cast("bigint")
    return a % F.nullif(b, F.lit(0).cast("bigint"))


def shift_left(x, n) -> Column:
    """Shifts that saturate at 64; a negative count shifts the other way, arithmetically to the right."""
    x, n = _c(x).cast("bigint"), _c(n).cast("int")
    return F.when(n < 0, _right(x, -n)).otherwise(_left(x, n))


def shift_right(x, n) -> Column:
    return shift_left(x, -_c(n).cast("int"))


def _left(x: Column, n: Column) -> Column:
    return F.when(n >= 64, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", x, n))


def _right(x: Column, n: Column) -> Column:
    return F.when(n >= 64, F.when(x < 0, F.lit(-1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))).otherwise(F.call_function("shiftright", x, n))


def is_(a, b) -> Column:
    return _c(a).eqNullSafe(_c(b))


def is_not(a, b) -> Column:
    return ~_c(a).eqNullSafe(_c(b))


def cast_integer(text) -> Column:
    """CAST(text AS INTEGER): the longest integer prefix, 0 without one, saturating at 64 bits."""
    digits = F.regexp_extract(_c(text).cast("string"), INT_PREFIX, 1)
    wide = digits.try_cast("decimal(38,0)")
    fits = F.when(wide > INT_MAX, F.lit(INT_MAX)).when(wide < INT_MIN, F.lit(INT_MIN)).otherwise(wide.try_cast("bigint"))
    return F.when(_c(text).isNull(), F.lit(None).cast("bigint")).when(digits == "", F.lit(0).cast("bigint")).otherwise(fits)


def cast_real(text) -> Column:
    """CAST(text AS REAL): the longest numeric prefix, 0.0 without one."""
    digits = F.regexp_extract(_c(text).cast("string"), REAL_PREFIX, 1)
    return F.when(_c(text).isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(digits.try_cast("double"), F.lit(0.0)))


def whole_number(text) -> Column:
    """A text's value if all of it is a number, else null: what math functions need."""
    t = F.regexp_replace(_c(text).cast("string"), r"^[ \t\n\f\r]+|[ \t\n\f\r]+$", "")
    return F.when(t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), t.try_cast("double"))


def truth(x: Column, kind: str) -> Column:
    """Truth of a value of a type: numbers by zero, text by its numeric prefix."""
    if kind == "boolean":
        return x
    return (cast_real(x) if kind == "string" else x) != 0


def round_(x, digits: int = 0) -> Column:
    """round(): half away from zero, digits clamped to 0..30, always real."""
    return F.round(_c(x).cast("double"), max(0, min(30, digits)))


def lower(x) -> Column:
    return F.translate(_c(x), UPPER, LOWER)


def upper(x) -> Column:
    return F.translate(_c(x), LOWER, UPPER)


def like(x, pattern: str, escape: str | None = None) -> Column:
    """LIKE without regard to the case of ASCII letters."""
    p = pattern.translate(str.maketrans(UPPER, LOWER))
    return lower(x).rlike(like_regex(p, escape))


def like_regex(pattern: str, escape: str | None = None) -> str:
    out, i = ["(?s)^"], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append({"%": ".*", "_": "."}.get(c) or re.escape(c))
        i += 1
    return "".join([*out, r"\z"])


def glob_regex(pattern: str) -> str:
    """A regular expression for a GLOB pattern: * ? [set] [^set]."""
    out, i = ["(?s)^"], 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + (3 if pattern[i + 1 : i + 2] == "^" else 2)) if c == "[" else -1
        if c == "[" and close > 0:
            body = pattern[i + 1 : close]
            negated, body = ("^", body[1:]) if body.startswith("^") else ("", body)
            body = re.sub(r"([\[\]\\^&])", r"\\\1", body)
            out.append(f"[{negated}{body}]")
            i = close
        elif c == "[":
            return r"(?!)"  # an open set matches nothing
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
        i += 1
    return "".join([*out, r"\z"])


def glob(x, pattern: str) -> Column:
    return _c(x).rlike(glob_regex(pattern))


def concat_op(*xs) -> Column:
    """||: null if any operand is."""
    return F.concat(*(_c(x).cast("string") for x in xs))


def concat(*xs) -> Column:
    """concat(): nulls are skipped."""
    return F.concat_ws("", *(_c(x).cast("string") for x in xs))


def scalar_min(*xs) -> Column:
    return F.when(_none_null(xs), F.least(*map(_c, xs)))


def scalar_max(*xs) -> Column:
    return F.when(_none_null(xs), F.greatest(*map(_c, xs)))


def _none_null(xs) -> Column:
    ok = F.lit(True)
    for x in xs:
        ok = ok & _c(x).isNotNull()
    return ok


def row_equal(left: list[Column], right: list[Column]) -> Column:
    """(a, b) = (c, d) by three-valued logic."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & (a == b)
    return out


def row_less(left: list[Column], right: list[Column]) -> Column:
    """(a, b) < (c, d): the first difference decides."""
    out = F.lit(False)
    for a, b in reversed(list(zip(left, right, strict=True))):
        out = (a < b) | ((a == b) & out)
    return out


def real_text(x) -> Column:
    """A real as text: integral values end in .0, large exponents are written e+NN."""
    x = _c(x).cast("double")
    plain = F.when((F.abs(x) < 1e15) & (x == F.floor(x)), F.concat(x.cast("bigint").cast("string"), F.lit(".0"))).otherwise(F.regexp_replace(x.cast("string"), r"E(\d)$", "e+0$1"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"E(\d\d+)$", "e+$1"), r"E-(\d)$", "e-0$1"), r"E-(\d\d+)$", "e-$1")
    return F.when(x.isNotNull(), plain)
