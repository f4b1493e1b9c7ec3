"""Aggregates that Spark names or computes otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.json import json_quote


def total(x: Column) -> Column:
    """Always real; 0.0 over nothing."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def group_concat(x: Column, separator: str = ",", *order: Column) -> Column:
    """The non-null values joined, in the order given, else in the values' own; null over nothing."""
    keyed = F.sort_array(F.collect_list(F.when(x.isNotNull(), F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], x.cast("string").alias("v")))))
    return F.when(F.size(keyed) > 0, F.array_join(F.transform(keyed, lambda s: s["v"]), separator))


def array_agg(x: Column, *order: Column) -> Column:
    """All values, nulls too; null over no rows."""
    keyed = F.sort_array(F.collect_list(F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], x.alias("v"))))
    return F.when(F.size(keyed) > 0, F.transform(keyed, lambda s: s["v"]))


def json_group_array(x: Column, *order: Column) -> Column:
    """A JSON array of all values, nulls as null."""
    keyed = F.sort_array(F.collect_list(F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], x.alias("v"))))
    return F.to_json(F.transform(keyed, lambda s: s["v"]), {"ignoreNullFields": "false"})


def json_group_object(k: Column, v: Column, *order: Column) -> Column:
    """A JSON object with an entry for each row; repeated keys stay, a null key is empty."""
    entry = F.concat(json_quote(F.coalesce(k.cast("string"), F.lit(""))), F.lit(":"), json_quote(v))
    keyed = F.sort_array(F.collect_list(F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], entry.alias("v"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(keyed, lambda s: s["v"]), ","), F.lit("}"))


def percentile_cont(x: Column, p: float) -> Column:
    return F.percentile(x.cast("double"), p)


def median(x: Column) -> Column:
    return F.median(x.cast("double"))


def bare(x: Column, extremum: Column, largest: bool = True) -> Column:
    """A bare column's value on the row of the only max() (or min())."""
    return F.max_by(x, extremum) if largest else F.min_by(x, extremum)
