"""Mapping lookups and exact-match mapping of identifiers on write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .integrity import distinct_on


def mapping_table(df: DataFrame, key: str, value: str, order: Sequence[str] = ()) -> DataFrame:
    """(key, value), one row a key: the last by ``order`` and value."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"), *order).where("key is not null")
    return rows.groupBy("key").agg(F.max_by("value", F.struct(*order, "value")).alias("value"))


def looked_up(df: DataFrame, column: str, maps: Sequence[DataFrame], into: str, on_failure: str = "warning") -> DataFrame:
    """``into``: the value of ``column`` in the first of ``maps`` that has it; else the cell itself,
    or an error when the row is read if ``on_failure`` is ``error``."""
    found = []
    for i, m in enumerate(maps):
        df = df.join(m.select(F.col("key").alias(f"_key{i}"), F.col("value").alias(f"_value{i}")), F.col(column).cast("string") == F.col(f"_key{i}"), "left")
        found.append(F.col(f"_value{i}"))
    cell = F.col(column).cast("string")
    if on_failure == "error":
        failed = F.raise_error(F.concat(F.lit(f"no mapping of {column} "), cell)).cast("string")
        cell = F.when(cell.isNotNull(), failed)
    return df.withColumn(into, F.coalesce(*found, cell)).drop(*[f"_{x}{i}" for x in ("key", "value") for i in range(len(maps))])


def exact_matches(sssom: DataFrame) -> DataFrame:
    """(from_id, to_id, prefix): exact matches both ways, the first target of each prefix."""
    rows = sssom.where("predicate_id = 'skos:exactMatch'").select("subject_id", "object_id").where("subject_id is not null and object_id is not null")
    both = rows.select(F.col("subject_id").alias("from_id"), F.col("object_id").alias("to_id")).union(rows.select("object_id", "subject_id"))
    return distinct_on(both.withColumn("prefix", F.split_part("to_id", F.lit(":"), F.lit(1))), ["from_id", "prefix"], ["to_id"])


def mapped_on_write(edges: DataFrame, sssom: DataFrame, subject_prefixes: Sequence[str] = (), object_prefixes: Sequence[str] = ()) -> DataFrame:
    """Edge ends replaced by an exact match of the first wanted prefix that has one; ids of a wanted prefix stay.

    Without prefixes an end takes its least match of any prefix. The old id goes to ``original_<end>``.
    """
    matches = exact_matches(sssom)
    for end, prefixes in (("subject", subject_prefixes), ("object", object_prefixes)):
        wanted = F.array(*map(F.lit, prefixes)) if prefixes else None
        own = matches.where(F.col("prefix").isin(list(prefixes))) if prefixes else matches
        rank = F.array_position(wanted, F.col("prefix")) if prefixes else F.lit(0)
        best = own.groupBy(F.col("from_id").alias(end)).agg(F.min_by("to_id", F.struct(rank, "to_id")).alias("_to"))
        edges = edges.join(best, end, "left")
        stays = F.split_part(end, F.lit(":"), F.lit(1)).isin(list(prefixes)) if prefixes else F.lit(False)
        moved = F.col("_to").isNotNull() & ~stays
        before = F.col(f"original_{end}") if f"original_{end}" in edges.columns else F.lit(None).cast("string")
        edges = edges.withColumns({f"original_{end}": F.when(moved, F.col(end)).otherwise(before), end: F.when(moved, F.col("_to")).otherwise(F.col(end))}).drop("_to")
    return edges
