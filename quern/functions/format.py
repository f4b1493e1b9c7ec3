"""printf: a constant format compiled to expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.semantics import _c
from quern.functions.text import quote

SPEC = re.compile(r"%([-+ 0#,!]*)(\d+)?(?:\.(\d+))?(?:l|ll)?([diuxXofeEgGsqQwczp%])")


def printf(pattern: str, *args) -> Column:
    """%d %i %u %x %X %o %f %e %g %s %q %Q %w %c %z %% with width, precision and the flags - + space 0 , #.

    Missing arguments count as 0 or empty; null counts so too, but for %Q, which gives NULL.
    """
    out, at, rest = [], 0, list(args)
    for m in SPEC.finditer(pattern):
        if m.start() > at:
            out.append(F.lit(pattern[at : m.start()]))
        at = m.end()
        flags, width, precision, kind = m[1], int(m[2] or 0), m[3], m[4]
        if kind == "%":
            out.append(F.lit("%"))
            continue
        x = _c(rest.pop(0)) if rest else F.lit(None).cast("string")
        out.append(_one(flags, width, int(precision) if precision is not None else None, kind, x))
    if at < len(pattern):
        out.append(F.lit(pattern[at:]))
    return F.concat(*out) if out else F.lit("")


def _one(flags: str, width: int, precision: int | None, kind: str, x: Column) -> Column:
    if kind in "diu":
        n = F.coalesce(x.cast("bigint"), F.lit(0).cast("bigint"))
        body = F.format_number(F.abs(n), 0) if "," in flags else F.abs(n).cast("string")
        return _padded(flags, width, body, F.when(n < 0, "-").otherwise("+" if "+" in flags else " " if " " in flags else ""))
    if kind in "xXo":
        n = F.coalesce(x.cast("bigint"), F.lit(0).cast("bigint"))
        body = F.conv(n.cast("string"), 10, 8) if kind == "o" else F.hex(n)
        return _padded(flags, width, F.lower(body) if kind == "x" else body, F.lit("0x" if "#" in flags and kind == "x" else "0X" if "#" in flags and kind == "X" else ""))
    if kind in "feEgG":
        v = F.coalesce(x.cast("double"), F.lit(0.0))
        digits = 6 if precision is None else precision
        if kind == "f":
            body = F.format_number(F.abs(v), digits) if "," in flags else F.format_string(f"%.{digits}f", F.abs(v))
        elif kind in "eE":
            body = F.format_string(f"%.{digits}{kind}", F.abs(v))
        else:
            body = F.regexp_replace(F.format_string(f"%.{max(1, digits)}{kind}", F.abs(v)), r"(\.\d*?)0+(?=$|[eE])", "$1")
            body = F.regexp_replace(body, r"\.(?=$|[eE])", "")
        return _padded(flags, width, body, F.when(v < 0, "-").otherwise("+" if "+" in flags else " " if " " in flags else ""))
    text = x.cast("string")
    if kind in "sz":
        body = F.coalesce(text, F.lit(""))
    elif kind == "c":
        body = F.coalesce(F.substring(text, 1, 1), F.lit(""))
    elif kind == "q":
        body = F.coalesce(F.replace(text, F.lit("'"), F.lit("''")), F.lit("(NULL)"))
    elif kind == "w":
        body = F.coalesce(F.replace(text, F.lit('"'), F.lit('""')), F.lit("(NULL)"))
    else:
        body = quote(text)
    if precision is not None:
        body = F.substring(body, 1, precision)
    return _padded(flags.replace("0", ""), width, body, F.lit(""))


def _padded(flags: str, width: int, body: Column, sign: Column) -> Column:
    if not width:
        return F.concat(sign, body)
    if "-" in flags:
        whole = F.concat(sign, body)
        return F.concat(whole, F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(whole), F.lit(0))))
    gap = F.greatest(F.lit(width) - F.length(sign) - F.length(body), F.lit(0))
    if "0" in flags:
        return F.concat(sign, F.repeat(F.lit("0"), gap), body)
    return F.concat(F.repeat(F.lit(" "), gap), sign, body)
