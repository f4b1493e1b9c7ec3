"""Set operations that associate from left to right with one precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame


def chain(first: DataFrame, *steps: tuple[str, DataFrame]) -> DataFrame:
    """first OP frame OP frame ...; OP is union, union all, intersect or except."""
    out = first
    for kind, frame in steps:
        if kind == "union all":
            out = out.unionAll(frame)
        elif kind == "union":
            out = out.unionAll(frame).distinct()
        elif kind == "intersect":
            out = out.intersect(frame)
        elif kind == "except":
            out = out.subtract(frame)
        else:
            raise ValueError(kind)
    return out


def limited(df: DataFrame, limit: int | None, offset: int | None = None) -> DataFrame:
    """LIMIT and OFFSET: a null or negative limit is none, a negative offset 0."""
    if offset is not None and offset > 0:
        df = df.offset(offset)
    return df if limit is None or limit < 0 else df.limit(limit)
