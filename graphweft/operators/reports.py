"""Quality, statistics, cross-tab and example reports. One grouped pass a question."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_list, curie_prefix, is_list, list_text, present
from .closure import denormalized_edges
from .integrity import union_by_name

NODE_REPORT = ("category", "provided_by", "namespace", "in_taxon")
EDGE_REPORT = (
    "subject_category", "subject_namespace", "predicate", "object_category", "object_namespace", "primary_knowledge_source",
    "aggregator_knowledge_source", "supporting_data_source", "knowledge_level", "agent_type", "provided_by",
)
QUANTILES = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)


def counted(df: DataFrame, by: Sequence[str], name: str = "count") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def source_column(df: DataFrame, table: str) -> str | None:
    """provided_by, or for edges else primary_knowledge_source, if there is one."""
    return next(iter(present(df, ["provided_by", "primary_knowledge_source"] if table == "edges" else ["provided_by"])), None)


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count)."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        out = row if out is None else out.unionByName(row)
    return out


def by_source(df: DataFrame, table: str) -> DataFrame:
    """(source, value, count): categories of nodes, predicates of edges, for each non-null source."""
    source, value = source_column(df, table), "category" if table == "nodes" else "predicate"
    if source is None or value not in df.columns:
        raise ValueError(f"{table} have no source or no {value}")
    rows = df.select(F.col(source).alias("source"), list_text(df, value).alias("value")).where("source is not null")
    return counted(rows, ["source", "value"])


def namespaces_by_source(df: DataFrame, table: str) -> DataFrame:
    """(source, namespace, count): of ids, or of both ends of edges."""
    source = source_column(df, table)
    ends = F.array(F.col("id")) if table == "nodes" else F.array("subject", "object")
    rows = df.select(F.col(source).alias("source"), F.explode(ends).alias("x")).where("source is not null and x is not null")
    return counted(rows.select("source", curie_prefix(F.col("x")).alias("namespace")), ["source", "namespace"])


def graph_stats(df: DataFrame, table: str) -> DataFrame:
    """(kind, value, source, count): by category, and nodes by id prefix or edges by predicate; one pass.

    Every kind is counted by source; the whole is the sum over sources.
    """
    source = source_column(df, table)
    own = F.col(source) if source else F.lit(None).cast("string")
    kinds = [F.struct(F.lit(c).alias("kind"), list_text(df, c).alias("value")) for c in present(df, ["category"] + (["predicate"] if table == "edges" else []))]
    if table == "nodes":
        kinds.append(F.struct(F.lit("id_prefix").alias("kind"), curie_prefix(F.col("id")).alias("value")))
    return counted(df.select(own.alias("source"), F.inline(F.array(*kinds))), ["kind", "value", "source"])


def schema_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, data_type, n_rows, n_values): one pass over each table; null cells are no values."""
    parts = []
    for t, df in tables.items():
        cells = [F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.count(f.name).alias("n_values")) for f in df.schema]
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*cells).alias("c")).select(F.lit(t).alias("table_name"), "n_rows", F.inline("c")))
    return union_by_name(parts).select("table_name", "column_name", "data_type", "n_rows", "n_values")


# --- cross-tabs -----------------------------------------------------------------


def node_report(nodes: DataFrame, columns: Sequence[str] = NODE_REPORT) -> DataFrame:
    """Counts by the columns that there are; ``namespace`` is derived. Fails if none is left."""
    if "namespace" in columns and "namespace" not in nodes.columns:
        nodes = nodes.withColumn("namespace", curie_prefix(F.col("id")))
    by = present(nodes, columns)
    if not by:
        raise ValueError("none of the columns is there")
    return counted(nodes, by).orderBy(F.desc("count"), *by)


def with_source_roles(edges: DataFrame) -> DataFrame:
    """Knowledge sources pulled out of ``sources`` where they aren't columns."""
    if "sources" not in edges.columns:
        return edges
    role = lambda name: F.array_distinct(F.transform(F.filter("sources", lambda s: s["resource_role"] == name), lambda s: s["resource_id"]))
    if "primary_knowledge_source" not in edges.columns:
        edges = edges.withColumn("primary_knowledge_source", F.get(role("primary_knowledge_source"), F.lit(0)))
    for name in ("aggregator_knowledge_source", "supporting_data_source"):
        if name not in edges.columns:
            edges = edges.withColumn(name, role(name))
    return edges


def edge_report(
    edges: DataFrame, nodes: DataFrame, columns: Sequence[str] = EDGE_REPORT, sets: Sequence[str] = (), percentiles: Sequence[str] = (), exact: bool = True
) -> DataFrame:
    """Counts by denormalized columns, with each group's share of all edges, the largest groups first.

    ``sets``: a list of the distinct values, lists flattened, null when none; such a column isn't grouped by.
    ``percentiles``: average (3 digits) and quantiles (9 digits) of a number or of a list's
    length, a null list counting 0. Approximate quantiles don't gather values.
    """
    edges = with_source_roles(edges)
    needed = [c for c in (*columns, *sets, *percentiles)]
    made = [f"{f}_{x}" for f in ("subject", "object") for x in ("category", "label", "namespace", "taxon")]
    full = denormalized_edges(edges, nodes, wanted=list(dict.fromkeys([*edges.columns, *[c for c in made if c in needed and (c != f"{c.split('_')[0]}_taxon" or "in_taxon" in nodes.columns)]])))
    by = [c for c in present(full, columns) if c not in sets]
    if not by:
        raise ValueError("none of the columns is there")
    out = [F.count(F.lit(1)).alias("count")]
    quantile = F.percentile if exact else F.percentile_approx
    for c in present(full, percentiles):
        value = F.coalesce(F.size(c), F.lit(0)).cast("double") if is_list(full, c) else F.col(c).cast("double")
        quantiles = F.transform(quantile(value, list(QUANTILES)), lambda x: F.round(x, 9))
        out += [F.round(F.avg(value), 3).alias(f"{c}_avg"), quantiles.alias(f"{c}_quantiles")]
    grouped = full.groupBy(*by).agg(*out)
    for c in present(full, sets):
        # distinct values first, so that no buffer holds a group's repeated lists
        values = full.select(*[F.col(x).alias(f"_by{i}") for i, x in enumerate(by)], F.explode(as_list(full, c)).alias("_value")).where("_value is not null").distinct()
        lists = values.groupBy(*[f"_by{i}" for i in range(len(by))]).agg(F.array_sort(F.collect_set("_value")).alias(f"{c}_set"))
        same = [F.equal_null(F.col(x), F.col(f"_by{i}")) for i, x in enumerate(by)]
        grouped = grouped.join(lists, reduce(and_, same), "left").drop(*[f"_by{i}" for i in range(len(by))])
    whole = F.broadcast(grouped.agg(F.sum("count").alias("_all")))  # one row, from the same exchange
    shared = grouped.crossJoin(whole).withColumn("proportion", F.col("count") / F.col("_all")).drop("_all")
    return shared.orderBy(F.desc("count"), *by)


# --- examples -------------------------------------------------------------------


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key. Rows are thinned inside key and hash bin first, so that a hot
    key's rows aren't ranked by one task; ``n`` rows of each bin go on."""
    cells = F.xxhash64(*df.columns) if not any(isinstance(f.dataType, T.MapType) for f in df.schema) else F.lit(0)
    by_order = [F.col(c).asc_nulls_last() for c in order] + [F.col("_cells")]
    salted = df.withColumn("_cells", cells).withColumn("_bin", F.pmod(F.xxhash64(*order, "_cells"), F.lit(64)))
    thin = salted.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy(*by_order))).where(F.col("_rank") <= n)
    last = thin.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by_order))).where(F.col("_rank") <= n)
    return last.drop("_cells", "_bin", "_rank")


def node_examples(nodes: DataFrame, n: int = 5, by: str = "category") -> DataFrame:
    """The first ``n`` nodes of each type by id, in that order; a null type is one too, and comes last."""
    return first_of_each(nodes, [by], ["id"], n).orderBy(F.col(by).asc_nulls_last(), F.col("id").asc_nulls_last())


def edge_examples(edges: DataFrame, nodes: DataFrame, n: int = 5, by: Sequence[str] = ("subject_category", "predicate", "object_category")) -> DataFrame:
    full = denormalized_edges(edges, nodes, wanted=[*edges.columns, "subject_category", "object_category"])
    return first_of_each(full, present(full, by), ["subject", "object"], n)


def types_sampled(examples: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row: the types, those with a null left out, that examples were taken of, and the examples."""
    named = F.lit(True)
    for c in by:
        named = named & F.col(c).isNotNull()
    types = F.count_distinct(F.when(named, F.struct(*by)))
    return examples.agg(types.alias("types_sampled"), F.count(F.lit(1)).alias("examples"))


def file_schemas(df: DataFrame) -> DataFrame:
    """(filename, table_type, column_count, columns, record_count) of rows (filename, table_type, column_name, record_count): the
    names of each file's columns as one text, each once and in order."""
    return df.groupBy("filename", "table_type").agg(
        F.count_distinct("column_name").alias("column_count"), F.array_join(F.array_sort(F.collect_set("column_name")), ", ").alias("columns"), F.max("record_count").alias("record_count")
    )
