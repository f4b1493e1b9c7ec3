"""Math functions: a null operand, a domain error, NaN and infinities give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.semantics import _c, finite


def _real(f):
    return lambda x: finite(f(_c(x).cast("double")))


UNARY = {
    name: _real(f)
    for name, f in {
        "ln": F.ln, "log10": F.log10, "log2": F.log2, "exp": F.exp, "sqrt": F.sqrt, "degrees": F.degrees, "radians": F.radians,
        "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
        "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh,
    }.items()
}


def log(*xs) -> Column:
    """log(x) is base 10; log(b, x) is base b."""
    if len(xs) == 1:
        return UNARY["log10"](xs[0])
    base, x = (_c(v).cast("double") for v in xs)
    return finite(F.try_divide(F.ln(x), F.ln(base)))


def power(x, y) -> Column:
    return finite(F.pow(_c(x).cast("double"), _c(y).cast("double")))


def mod(a, b) -> Column:
    """fmod: always real, null for zero."""
    return finite(_c(a).cast("double") % F.nullif(_c(b).cast("double"), F.lit(0.0)))


def atan2(y, x) -> Column:
    return finite(F.atan2(_c(y).cast("double"), _c(x).cast("double")))


def sign(x) -> Column:
    return F.signum(_c(x).cast("double")).cast("int")


def ceil(x, kind: str = "double") -> Column:
    """Integers stay integers, reals real."""
    return _c(x) if kind in ("int", "bigint") else F.ceil(_c(x).cast("double")).cast("double")


def floor(x, kind: str = "double") -> Column:
    return _c(x) if kind in ("int", "bigint") else F.floor(_c(x).cast("double")).cast("double")


def trunc(x, kind: str = "double") -> Column:
    x = _c(x)
    return x if kind in ("int", "bigint") else F.when(x < 0, ceil(x)).otherwise(floor(x))


def gcd(a, b) -> Column:
    """Euclid's algorithm as a fold: 64-bit operands need fewer than 93 steps."""
    start = F.struct(F.abs(_c(a).cast("bigint")).alias("a"), F.abs(_c(b).cast("bigint")).alias("b"))

    def step(s: Column, _: Column) -> Column:
        return F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0).cast("bigint"))).alias("b")))

    return F.when(_c(a).isNotNull() & _c(b).isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["a"]))


def lcm(a, b) -> Column:
    a, b = _c(a).cast("bigint"), _c(b).cast("bigint")
    return F.when((a == 0) | (b == 0), F.lit(0).cast("bigint")).otherwise(F.abs(a / F.nullif(gcd(a, b), F.lit(0).cast("bigint")) * b).cast("bigint"))
