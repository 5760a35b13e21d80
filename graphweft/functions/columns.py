"""Column expressions over identifiers, lists and cells."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def curie_prefix(x: Column) -> Column:
    """What stands before the first colon; the whole id without a colon."""
    return F.split_part(x, F.lit(":"), F.lit(1))


def namespace_of(x: Column) -> Column:
    """What stands before the first colon; empty without a colon."""
    return F.substr(x, F.lit(1), F.instr(x, ":") - 1)


def is_list(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.ArrayType)


def present(df: DataFrame, columns: Iterable[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def split_multivalued(cell: Column) -> Column:
    """``a|b`` as a list without blank elements; null for a blank cell, [] for separators only."""
    parts = F.filter(F.split(F.trim(cell), r"\|"), lambda x: F.trim(x) != "")
    return F.when(F.trim(cell) == "", F.lit(None)).otherwise(parts)


def first_of(values: Column) -> Column:
    return F.get(values, F.lit(0))


def list_text(df: DataFrame, column: str, separator: str = "|") -> Column:
    """A scalar as it is, a list joined."""
    return F.array_join(column, separator) if is_list(df, column) else F.col(column)


def as_list(df: DataFrame, column: str) -> Column:
    """A list column as it is; a scalar as a list of one, null for null."""
    return F.col(column) if is_list(df, column) else F.when(F.col(column).isNotNull(), F.array(F.col(column)))


def distinct_list(values: Column) -> Column:
    return F.array_compact(F.array_distinct(values))


def none_if_empty(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def prefixed(x: Column, prefix: str = "biolink:") -> Column:
    return F.when(F.contains(x, F.lit(":")), x).otherwise(F.concat(F.lit(prefix), x))


def not_negated(df: DataFrame, column: str = "negated") -> Column:
    """Null or false, as a boolean or as text of any case."""
    if column not in df.columns:
        return F.lit(True)
    return F.col(column).isNull() | (F.lower(F.col(column).cast("string")) == "false")


def any_of(df: DataFrame, column: str, values: Iterable[str]) -> Column:
    values = list(values)
    return F.arrays_overlap(F.col(column), F.array(*map(F.lit, values))) if is_list(df, column) else F.col(column).isin(values)


def is_deprecated(name: Column) -> Column:
    return F.coalesce(name.like("obsolete%"), F.lit(False))


#: Identifier prefixes and what they become.
CURIE_SYNONYMS = {"taxon:": "NCBITaxon:", "NCBI_Gene:": "NCBIGene:", "NCBI_taxid:": "NCBITaxon:"}


def clean_curie(x: Column) -> Column:
    for old, new in CURIE_SYNONYMS.items():
        x = F.regexp_replace(x, f"^{old}", new)
    return x


def safe_cell(x: Column) -> Column:
    """A string cell for export: blank is null, line breaks and tabs are spaces, escaped quotes are quotes."""
    clean = F.replace(F.translate(x, "\n\r\t", "   "), F.lit('\\"'), F.lit('"'))
    return F.when(F.trim(clean) != "", clean)


def tsv_cell(df: DataFrame, column: str) -> Column:
    """Lists of scalars joined by ``|``; structs, maps and nested lists as JSON; the rest as it is."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.ArrayType, T.StructType, T.MapType)):
        return F.array_join(F.col(column).cast("array<string>"), "|")
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(column, {"ignoreNullFields": "false"})
    return F.col(column)


def core_first(columns: Iterable[str], core: Iterable[str]) -> list[str]:
    """Core columns, then the rest sorted, then those that begin with an underscore sorted."""
    columns, core = list(columns), list(core)
    rest = sorted(c for c in columns if c not in core)
    return [c for c in core if c in columns] + [c for c in rest if c[0] != "_"] + [c for c in rest if c[0] == "_"]
