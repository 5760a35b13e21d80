"""Row filters over typed cells: comparisons, equality, membership; include and exclude."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class RowFilter:
    """``column code value``; ``code`` is gt, ge, lt, le, eq, ne, in or in_exact; ``include`` or not."""

    column: str
    code: str
    value: object
    include: bool = True


_COMPARE = {
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
}


def condition(df: DataFrame, f: RowFilter) -> Column:
    """``in`` also matches a string cell that contains one of the values."""
    c = F.col(f.column)
    if f.code in _COMPARE:
        return _COMPARE[f.code](c, F.lit(f.value))
    values = list(f.value) if isinstance(f.value, (list, tuple, set)) else [f.value]
    if f.code == "in_exact":
        return c.isin(values)
    if f.code == "in":
        found = c.isin(values)
        if isinstance(df.schema[f.column].dataType, T.StringType):
            for v in values:
                if isinstance(v, str):
                    found = found | F.contains(c, F.lit(v))
        return found
    raise ValueError(f"no filter {f.code!r}")


def filtered(df: DataFrame, filters: Iterable[RowFilter]) -> DataFrame:
    """The rows that pass every filter; a null cell passes none, not even to be excluded."""
    for f in filters:
        if f.column not in df.columns:
            raise ValueError(f"the filter's column {f.column!r} isn't there")
        keep = condition(df, f)
        df = df.where(F.col(f.column).isNotNull() & (keep if f.include else ~keep))
    return df
