"""UUID, type and session helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.semantics import _c

#: The dialect versions reported.
SQLITE_VERSION, ENGINE_VERSION = "3.50.4", "0.7.2"


def uuid4_str() -> Column:
    return F.uuid()


def uuid4() -> Column:
    return uuid_blob(F.uuid())


def uuid_str(blob) -> Column:
    return F.regexp_replace(F.lower(F.hex(_c(blob))), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def uuid_blob(text) -> Column:
    return F.unhex(F.replace(_c(text), F.lit("-"), F.lit("")))


def uuid7_str() -> Column:
    """48 bits of the time in ms, version 7, random bits of a version 4."""
    stamp = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    random = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return F.concat_ws("-", stamp.substr(1, 8), stamp.substr(9, 4), F.concat(F.lit("7"), random.substr(14, 3)), random.substr(17, 4), random.substr(21, 12))


def uuid7_timestamp_ms(text) -> Column:
    return F.conv(F.replace(_c(text), F.lit("-"), F.lit("")).substr(1, 12), 16, 10).cast("bigint")


def boolean_to_int(x) -> Column:
    t = F.lower(_c(x).cast("string"))
    return F.when(_c(x).isNull(), None).when(t.isin("1", "true", "yes", "on", "t", "y"), 1).when(t.isin("0", "false", "no", "off", "f", "n"), 0).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), t)).cast("int"))


def int_to_boolean(x) -> Column:
    return (_c(x) != 0).cast("string")


def validate_ipaddr(x) -> Column:
    part = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    ok = _c(x).rlike(rf"^{part}(?:\.{part}){{3}}$") | _c(x).rlike(r"^(?=.*:)[0-9A-Fa-f:]+(?:\d+\.\d+\.\d+\.\d+)?$")
    return F.when(ok, _c(x)).when(_c(x).isNull(), None).otherwise(F.raise_error(F.concat(F.lit("not an address: "), _c(x))))


def random() -> Column:
    return F.xxhash64(F.uuid())


def randomblob(n) -> Column:
    """n random bytes, made of uuids."""
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(_c(n) / 8).cast("int"))), lambda i: F.hex(F.xxhash64(F.rand(), i)))
    return F.unhex(F.array_join(blocks, "").substr(F.lit(1), (2 * _c(n)).cast("int")))
