"""Detection of categorical columns, and their marginals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_list
from .catalogue import Catalogue, default_catalogue

_DERIVED = ("_closure", "_closure_label", "_label", "_name")


@dataclass(frozen=True)
class ProfileLimits:
    most: int = 1000
    few: int = 50
    share: float = 0.01
    exact_rows: int = 10_000_000


def distinct_counts(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """(column_name, distinct_values, row_count), lists counted by element, in one pass over the rows."""
    count = F.count_distinct if exact else F.approx_count_distinct
    lists = [c for c in columns if is_list(df, c)]
    rows = df.agg(F.count(F.lit(1)).alias("_rows"), *[count(F.col(c)).alias(c) for c in columns if c not in lists])
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("distinct_values")) for c in columns if c not in lists]
    empty = F.array().cast("array<struct<column_name:string,distinct_values:bigint>>")
    out = rows.select(F.inline(F.array(*pairs) if pairs else empty), F.col("_rows").alias("row_count"))
    for c in lists:
        # row counts come from the same frame; a list column is exploded by itself
        one = df.select(F.explode(c).alias("x")).agg(F.lit(c).alias("column_name"), count("x").alias("distinct_values"))
        out = out.unionByName(one.crossJoin(rows.select(F.col("_rows").alias("row_count"))))
    return out


def _probed(df: DataFrame, columns: list[str]) -> list[str]:
    skip = (T.StructType, T.MapType)
    kinds = {c: df.schema[c].dataType for c in columns}
    inner = {c: k.elementType if isinstance(k, T.ArrayType) else k for c, k in kinds.items()}
    return [c for c in columns if not isinstance(inner[c], skip)]


def categorical_columns(df: DataFrame, catalogue: Catalogue | None = None, limits: ProfileLimits = ProfileLimits()) -> list[str]:
    """The columns worth a marginal, fewest values first.

    The model decides first; what it leaves open is decided by the number of
    distinct values: more than one, fewer than rows, at most ``most``, and at
    most ``few`` or the given share of rows.
    """
    catalogue = catalogue or default_catalogue()
    verdict = {c: catalogue.categorical(c) for c in df.columns}
    open_ = {c: v for c, v in verdict.items() if v is not False and not (v is None and c.endswith(_DERIVED))}
    columns = _probed(df, list(open_))
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    columns = [c for c in columns if c not in numeric or open_[c]]
    if not columns:
        return []
    exact = df.count() <= limits.exact_rows
    found = []
    for r in distinct_counts(df, columns, exact).collect():  # a row for each column
        n, rows = r["distinct_values"], r["row_count"]
        wanted = n >= 1 if open_[r["column_name"]] else 1 < n < rows and (n <= limits.few or n / rows <= limits.share)
        if wanted and n <= limits.most:
            found.append((n, r["column_name"]))
    return [c for _, c in sorted(found)]


def marginals(df: DataFrame, columns: list[str], table: str = "nodes", top: int | None = None) -> DataFrame:
    """(table_name, column_name, value, count, share): counts of every value, of list elements where lists.

    All columns are counted in one shuffle. The share is of rows, or of elements.
    """

    def cell(c: str):
        values = F.col(c).cast("array<string>") if is_list(df, c) else F.array(F.col(c).cast("string"))
        return F.transform(values, lambda x: F.struct(F.lit(c).alias("column_name"), x.alias("value")))

    cells = [cell(c) for c in columns]
    empty = F.array().cast("array<struct<column_name:string,value:string>>")
    flat = F.flatten(F.array(*[F.coalesce(x, empty) for x in cells]))
    counts = df.select(F.inline(flat)).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))
    whole = counts.groupBy("column_name").agg(F.sum("count").alias("_all"))
    out = counts.join(whole, "column_name").select(F.lit(table).alias("table_name"), "column_name", "value", "count", (F.col("count") / F.col("_all")).alias("share"))
    if top:
        from .reports import first_of_each

        out = first_of_each(out.withColumn("_down", -F.col("count")), ["column_name"], ["_down", "value"], top).drop("_down")
    return out


def render(rows: list[tuple[str, str | None, int, float]]) -> str:
    """Text lines: column, value, aligned share in percent, count."""
    width = max((len(str(v)) for _, v, _, _ in rows), default=0)
    lines, last = [], None
    for column, value, n, share in rows:
        if column != last:
            lines.append(column)
            last = column
        lines.append(f"  {value!s:<{width}} {100 * share:6.2f}% {n:>12,}")
    return "\n".join(lines)
