"""Date and time functions over text, julian day numbers and unix times.

An instant is a bigint column of milliseconds since 1970 UTC; parsing gives one, modifiers map one to
another, formats make text of it. Everything stays in built-in expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.semantics import _c

DAY = 86_400_000
EPOCH = 2440587.5
TIME = r"(\d\d):(\d\d)(?::(\d\d)(\.\d+)?)?"
ZONE = r"\s*(?:(Z|z)|([+-])(\d\d):(\d\d))?"


def from_text(x) -> Column:
    """Milliseconds of YYYY-MM-DD[( |T)HH:MM[:SS[.fff]]][zone], HH:MM..., or a julian day number; else null."""
    return let(F.trim(_c(x).cast("string")), _parsed)


def _parsed(x: Column) -> Column:
    full = rf"^(\d\d\d\d)-(\d\d)-(\d\d)(?:[ T]+{TIME}{ZONE})?$"
    clock = rf"^{TIME}{ZONE}$"
    groups = lambda n: "|".join(f"${i}" for i in range(1, n + 1))
    parts = F.when(x.rlike(full), F.split(F.regexp_replace(x, full, groups(11)), r"\|")).when(x.rlike(clock), F.split(F.regexp_replace(x, clock, "2000|01|01|" + groups(8)), r"\|"))
    number = x.try_cast("double")
    julian = F.when(number.between(0, 5373484.5), F.round((number - EPOCH) * DAY).cast("bigint"))
    return F.coalesce(let(parts, _from_parts), F.when(~x.contains(":"), julian))


def _from_parts(g: Column) -> Column:
    """Milliseconds of year, month, day, hour, minute, second, its fraction, Z, and a zone's sign, hours and minutes."""
    part = lambda i: F.coalesce(F.nullif(g[i], F.lit("")).try_cast("double"), F.lit(0.0))
    year, month, day = (g[i].try_cast("int") for i in range(3))
    zone = (part(9) * 60 + part(10)) * F.when(g[8] == "-", -1).otherwise(1)
    ok = month.between(1, 12) & day.between(1, 31) & (part(3) < 25) & (part(4) < 60) & (part(5) < 60)
    days = F.datediff(F.make_date(F.when(ok, year), month, F.lit(1)), F.lit("1970-01-01").cast("date")) + day - 1
    clock = part(3) * 3_600_000 + (part(4) - zone) * 60_000 + F.round((part(5) + part(6)) * 1000)
    return F.when(ok, days.cast("bigint") * DAY + clock.cast("bigint"))


def from_timestamp(x) -> Column:
    return F.floor(F.unix_micros(_c(x).cast("timestamp")) / 1000).cast("bigint")


def from_unix(x) -> Column:
    return F.round(_c(x).cast("double") * 1000).cast("bigint")


def let(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _date(ms: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / DAY).cast("int"))


def _of_day(ms: Column) -> Column:
    return F.pmod(ms, F.lit(DAY).cast("bigint"))


def _at(date: Column, rest: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date")).cast("bigint") * DAY + rest


def modify(ms: Column, modifier: str) -> Column:
    """An instant after one modifier; an unknown one gives null."""
    m = modifier.strip().lower()
    found = re.fullmatch(r"([+-]?\d+(?:\.\d+)?)\s*(day|hour|minute|second|month|year)s?", m)
    if found:
        n, unit = float(found[1]), found[2]
        step = {"day": DAY, "hour": 3_600_000, "minute": 60_000, "second": 1000}.get(unit)
        if step:
            return ms + F.lit(round(n * step)).cast("bigint")
        months, rest = int(n) * (12 if unit == "year" else 1), n - int(n)
        date = _date(ms)
        first = F.add_months(F.trunc(date, "month"), months)
        moved = _at(F.date_add(first, F.dayofmonth(date) - 1), _of_day(ms))
        return moved + F.lit(round(rest * (365 if unit == "year" else 30) * DAY)).cast("bigint")
    if m == "start of day":
        return ms - _of_day(ms)
    if m in ("start of month", "start of year"):
        return _at(F.trunc(_date(ms), m.split()[-1]), F.lit(0).cast("bigint"))
    found = re.fullmatch(r"weekday\s+([0-6])", m)
    if found:
        ahead = F.pmod(F.lit(int(found[1])) - (F.dayofweek(_date(ms)) - 1), F.lit(7))
        return ms + ahead.cast("bigint") * DAY
    if m in ("utc", "localtime", "subsec", "subsecond", "auto"):
        return ms  # sessions run in UTC
    return F.lit(None).cast("bigint")


def instant(x, *modifiers: str) -> Column:
    """The instant of a text or number after its modifiers; unixepoch and julianday first say how to read a number."""
    rest = list(modifiers)
    # each step is bound, so that expressions grow with the number of modifiers and not as a power of it
    if rest and rest[0].strip().lower() == "unixepoch":
        ms = from_unix(x)
        rest = rest[1:]
    else:
        rest = rest[1:] if rest and rest[0].strip().lower() == "julianday" else rest
        ms = from_text(x)
    for m in rest:
        ms = _bound(ms, m)
    return ms


def _bound(ms: Column, modifier: str) -> Column:
    return let(ms, lambda v: modify(v, modifier))


def date(x, *modifiers: str) -> Column:
    return _format(instant(x, *modifiers), "%F")


def time(x, *modifiers: str) -> Column:
    return _format(instant(x, *modifiers), "%H:%M:%f" if _fine(modifiers) else "%T")


def datetime(x, *modifiers: str) -> Column:
    return _format(instant(x, *modifiers), "%F %H:%M:%f" if _fine(modifiers) else "%F %T")


def julianday(x, *modifiers: str) -> Column:
    return instant(x, *modifiers) / float(DAY) + EPOCH


def unixepoch(x, *modifiers: str) -> Column:
    ms = instant(x, *modifiers)
    return ms / 1000.0 if _fine(modifiers) else F.floor(ms / 1000).cast("bigint")


def _fine(modifiers: tuple[str, ...]) -> bool:
    return any(m.strip().lower() in ("subsec", "subsecond") for m in modifiers)


def strftime(pattern: str, x, *modifiers: str) -> Column:
    return _format(instant(x, *modifiers), pattern)


def _pad(x: Column, n: int, fill: str = "0") -> Column:
    return F.lpad(x.cast("string"), n, fill)


def _format(ms: Column, pattern: str) -> Column:
    return let(ms, lambda v: _formatted(v, pattern))


def format_timestamp(x, pattern: str) -> Column:
    """A timestamp formatted, without the way over text: all of it stays in generated code."""
    return _formatted(from_timestamp(x), pattern)


def _formatted(ms: Column, pattern: str) -> Column:
    day, rest = _date(ms), _of_day(ms)
    hour, minute, second = (F.floor(rest / k).cast("int") % m for k, m in ((3_600_000, 24), (60_000, 60), (1000, 60)))
    week_day = F.dayofweek(day) - 1
    twelve = F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12)
    year_day = F.dayofyear(day)
    iso_year = F.year(F.date_add(day, 3 - F.weekday(day)))
    pieces = {
        "d": lambda: _pad(F.dayofmonth(day), 2), "e": lambda: _pad(F.dayofmonth(day), 2, " "), "m": lambda: _pad(F.month(day), 2), "Y": lambda: _pad(F.year(day), 4),
        "G": lambda: _pad(iso_year, 4), "g": lambda: _pad(iso_year % 100, 2), "H": lambda: _pad(hour, 2), "k": lambda: _pad(hour, 2, " "), "I": lambda: _pad(twelve, 2), "l": lambda: _pad(twelve, 2, " "),
        "M": lambda: _pad(minute, 2), "S": lambda: _pad(second, 2), "f": lambda: F.concat(_pad(second, 2), F.lit("."), _pad(rest % 1000, 3)),
        "j": lambda: _pad(year_day, 3), "J": lambda: (ms / float(DAY) + EPOCH).cast("string"), "s": lambda: F.floor(ms / 1000).cast("bigint").cast("string"),
        "p": lambda: F.when(hour < 12, "AM").otherwise("PM"), "P": lambda: F.when(hour < 12, "am").otherwise("pm"),
        "u": lambda: F.when(week_day == 0, 7).otherwise(week_day).cast("string"), "w": lambda: week_day.cast("string"),
        "U": lambda: _pad(F.floor((year_day + 6 - week_day) / 7).cast("int"), 2), "W": lambda: _pad(F.floor((year_day + 6 - F.weekday(day)) / 7).cast("int"), 2), "V": lambda: _pad(F.weekofyear(day), 2),
    }
    pattern = pattern.replace("%F", "%Y-%m-%d").replace("%R", "%H:%M").replace("%T", "%H:%M:%S")
    out = []
    for plain, letter in re.findall(r"([^%]+)|%(.?)", pattern):
        if plain:
            out.append(F.lit(plain))
        elif letter == "%":
            out.append(F.lit("%"))
        elif letter in pieces:
            out.append(pieces[letter]())
        else:
            return F.lit(None).cast("string")
    return F.when(ms.isNotNull(), F.concat(*out) if out else F.lit(""))


def timediff(a, b) -> Column:
    """(+|-)YYYY-MM-DD HH:MM:SS.SSS: years, months and days of the difference counted from the earlier instant."""
    return let(F.struct(instant(a).alias("x"), instant(b).alias("y")), _difference)


def _difference(pair: Column) -> Column:
    x, y = pair["x"], pair["y"]
    low, high = F.least(x, y), F.greatest(x, y)
    d1, d2 = _date(low), _date(high)

    def moved(k: Column) -> Column:
        first = F.add_months(F.trunc(d1, "month"), k)
        return _at(F.date_add(first, F.dayofmonth(d1) - 1), _of_day(low))

    months = (F.year(d2) - F.year(d1)) * 12 + F.month(d2) - F.month(d1)
    months = let(months, lambda m: F.when(moved(m) > high, m - 1).otherwise(m))

    def text(s: Column) -> Column:
        k, rest = s["k"], s["rest"]
        clock = rest % DAY
        return F.concat(
            F.when(x < y, "-").otherwise("+"), _pad(F.floor(k / 12).cast("int"), 4), F.lit("-"), _pad(k % 12, 2), F.lit("-"), _pad(F.floor(rest / DAY).cast("int"), 2), F.lit(" "),
            _pad(F.floor(clock / 3_600_000).cast("int"), 2), F.lit(":"), _pad(F.floor(clock / 60_000).cast("int") % 60, 2), F.lit(":"), _pad(F.floor(clock / 1000).cast("int") % 60, 2), F.lit("."), _pad(clock % 1000, 3),
        )

    both = let(months, lambda m: F.struct(m.alias("k"), (high - moved(m)).alias("rest")))
    return F.when(x.isNotNull() & y.isNotNull(), let(both, text))
