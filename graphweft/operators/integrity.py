"""Union, de-duplication, normalization, pruning and appending of graphs.

Every operation is lazy, takes and returns DataFrames, and moves problem rows to
archives instead of dropping them. Orders are total, with nulls last.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import first_of, present, split_multivalued
from ..model import MULTIVALUED, Graph

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def _nullable(kind: T.DataType) -> T.DataType:
    """``kind`` with nulls allowed everywhere inside."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(_nullable(kind.keyType), _nullable(kind.valueType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in kind])
    return kind


def _common_type(kinds: Sequence[T.DataType]) -> T.DataType:
    distinct = list(dict.fromkeys(_nullable(k) for k in kinds if not isinstance(k, T.NullType)))
    if len(distinct) == 1:
        return distinct[0]
    if not distinct:
        return T.StringType()
    if all(isinstance(k, _NUMBERS) for k in distinct):
        return max(distinct, key=lambda k: [type(k) is n for n in _NUMBERS].index(True))
    strings = T.ArrayType(T.StringType())
    if all(isinstance(k, T.StringType) or k == strings for k in distinct):
        return strings
    return T.StringType()


def _as_type(df: DataFrame, column: str, kind: T.DataType) -> Column:
    own, c = _nullable(df.schema[column].dataType), F.col(column)
    if own == kind:
        return c
    if isinstance(kind, T.ArrayType) and isinstance(own, T.StringType):
        return split_multivalued(c)
    if isinstance(kind, T.StringType) and isinstance(own, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return c.cast(kind)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows and all columns; types are reconciled first.

    A list beside a string makes the string a list, split at ``|``; numbers
    widen; any other mixture becomes text.
    """
    frames = [f for f in frames if f is not None]
    kinds: dict[str, list[T.DataType]] = {}
    for f in frames:
        for x in f.schema:
            kinds.setdefault(x.name, []).append(x.dataType)
    wanted = {c: _common_type(k) for c, k in kinds.items()}
    same = [f.select(*[_as_type(f, c, wanted[c]).alias(c) for c in f.columns]) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), same)


def with_provenance(df: DataFrame, source: str, provided_by: str | None = None) -> DataFrame:
    """``file_source`` set, and ``provided_by`` overwritten if given; colliding input columns go."""
    df = df.drop("file_source").withColumn("file_source", F.lit(source))
    return df.withColumn("provided_by", F.lit(provided_by)) if provided_by is not None else df


def split_lists(df: DataFrame, columns: Sequence[str] = tuple(sorted(MULTIVALUED)), single: Sequence[str] = ()) -> DataFrame:
    """Text cells of multivalued ``columns`` as lists; columns in ``single`` keep their first value."""
    for c in present(df, columns):
        if isinstance(df.schema[c].dataType, T.StringType):
            df = df.withColumn(c, split_multivalued(F.col(c)))
    for c in present(df, single):
        if isinstance(df.schema[c].dataType, T.ArrayType):
            df = df.withColumn(c, first_of(F.col(c)))
    return df


def losing_values(df: DataFrame, column: str) -> Column:
    """The number of rows that would lose values if only the first of ``column`` was kept."""
    return F.count_if(F.size(column) > 1)


def missing_required(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows (field, missing, total): cells that are null or blank, in one pass. An absent column misses everywhere."""
    total = F.count(F.lit(1)).alias("_total")
    counts = [
        (F.count_if(F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == "")) if f in df.columns else F.count(F.lit(1))).alias(f) for f in fields
    ]
    row = df.agg(total, *counts)
    return row.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("missing"), F.col("_total").alias("total")) for f in fields])))


# --- de-duplication -------------------------------------------------------------


def _ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with _n rows of the keys and _rank among them, ordered by ``order`` and then by all other
    columns in the order of their names, nulls last; so only equal rows tie."""
    rest = [F.to_json(c) if isinstance(df.schema[c].dataType, T.MapType) else F.col(c) for c in sorted(df.columns) if c not in (*keys, *order)]
    by = Window.partitionBy(*keys)
    ordered = by.orderBy(*[F.col(c).asc_nulls_last() for c in order], *[c.asc_nulls_last() for c in rest]) if order or rest else by.orderBy(*keys)
    return df.withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_rank", F.row_number().over(ordered))


def deduplicate(df: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(kept, archive). The archive has every row of every repeated key, and the row with the
    smallest ``file_source`` (or ``provided_by``) is kept. Null keys are never repeated.

    Rows are combined by key first, so that only repeated keys go through a window.
    """
    if key not in df.columns:
        return df, df.limit(0)
    order = present(df, ["file_source"]) or present(df, ["provided_by"])
    repeated = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_times")).where("_times > 1").select(key)
    archive = df.join(repeated, key, "left_semi")
    single = df.join(repeated, key, "left_anti")
    first = _ranked(archive, [key], order).where("_rank = 1").drop("_n", "_rank")
    return single.unionByName(first), archive


def deduplicate_graph(graph: Graph) -> Graph:
    tables, parts = {}, {}
    for name in ("nodes", "edges"):
        df = getattr(graph, name)
        if df is not None:
            parts[name], tables[f"duplicate_{name}"] = deduplicate(df)
    return Graph(parts.get("nodes"), parts.get("edges"), {**graph.tables, **tables})


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row for each combination of ``keys``, nulls included, by a total order."""
    return _ranked(df, keys, order).where("_rank = 1").drop("_n", "_rank")


# --- normalization ----------------------------------------------------------------


def one_mapping_each(mappings: DataFrame) -> DataFrame:
    """One row for each non-null ``object_id``: the first by mapping source and subject."""
    return distinct_on(mappings.where("object_id is not null"), ["object_id"], present(mappings, ["mapping_source", "subject_id"]))


def normalize_edges(edges: DataFrame, mappings: DataFrame) -> DataFrame:
    """Edge ends that a mapping names as ``object_id`` become its ``subject_id``.

    ``original_subject`` and ``original_object`` keep the first value ever, and
    are set only where the id changes. ``_changed`` isn't kept; see ``changed_edges``.
    """
    one = one_mapping_each(mappings).select("object_id", "subject_id")
    columns = edges.columns
    for end in ("subject", "object"):
        to = one.select(F.col("object_id").alias(end), F.col("subject_id").alias("_to"))
        edges = edges.join(to, end, "left")
        moved = F.col("_to").isNotNull() & (F.col("_to") != F.col(end))
        before = F.col(f"original_{end}") if f"original_{end}" in edges.columns else F.lit(None).cast("string")
        edges = edges.withColumns({f"original_{end}": F.when(moved, F.coalesce(before, F.col(end))).otherwise(before), end: F.coalesce("_to", end)}).drop("_to")
    return edges.select(*columns, *[c for c in ("original_subject", "original_object") if c not in columns])


def normalize_counts(edges: DataFrame, mappings: DataFrame) -> DataFrame:
    """One row: edges, edges with a changed end, and mappings left out as repeats of an ``object_id``."""
    one = one_mapping_each(mappings)
    done = edges.select("subject", "object")
    for end in ("subject", "object"):
        done = done.join(one.select(F.col("object_id").alias(end), F.col("subject_id").alias(f"_{end}")), end, "left")
    changed = F.coalesce(F.col("_subject") != F.col("subject"), F.lit(False)) | F.coalesce(F.col("_object") != F.col("object"), F.lit(False))
    counts = done.agg(F.count(F.lit(1)).alias("edges"), F.count_if(changed).alias("changed"))
    repeats = mappings.where("object_id is not null").agg((F.count(F.lit(1)) - F.count_distinct("object_id")).alias("duplicate_mappings"))
    return counts.crossJoin(F.broadcast(repeats))  # one row each


# --- pruning ------------------------------------------------------------------------


def with_missing_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` with ``_no_subject`` and ``_no_object``: the end is null or no node's id."""
    ids = nodes.select(F.col("id")).where("id is not null").distinct()
    for end in ("subject", "object"):
        edges = edges.join(ids.select(F.col("id").alias(f"_{end}_id")), F.col(end) == F.col(f"_{end}_id"), "left")
    return edges.withColumns({f"_no_{end}": F.col(f"_{end}_id").isNull() for end in ("subject", "object")}).drop("_subject_id", "_object_id")


def split_dangling(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dangling): an exact partition of ``edges``; an edge with a null end dangles."""
    there = nodes.select(F.col("id").alias("_node_id"))
    has = [there.where(F.col("_node_id") == F.col(end).outer()).exists() for end in ("subject", "object")]
    return edges.where(has[0] & has[1]), edges.where(~(has[0] & has[1]))


def dangling_counts(edges: DataFrame, nodes: DataFrame, by: str = "file_source") -> DataFrame:
    """For each source: dangling edges, and distinct missing ids."""
    bad = with_missing_ends(edges, nodes).where("_no_subject or _no_object")
    missing = F.array_compact(F.array(F.when(F.col("_no_subject"), F.col("subject")), F.when(F.col("_no_object"), F.col("object"))))
    edges_by = bad.groupBy(by).agg(F.count(F.lit(1)).alias("dangling_edges"))
    ids_by = bad.select(by, F.explode(missing).alias("id")).groupBy(by).agg(F.count_distinct("id").alias("missing_ids"))
    joined = edges_by.alias("e").join(ids_by.alias("i"), F.col(f"e.{by}").eqNullSafe(F.col(f"i.{by}")), "left")
    return joined.select(F.col(f"e.{by}").alias(by), "dangling_edges", F.coalesce("missing_ids", F.lit(0)).alias("missing_ids"))


def split_singletons(nodes: DataFrame, edges: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(connected, singletons): nodes that are an edge's end, and the rest. Without edges every node is single."""
    if edges is None:
        return nodes.limit(0), nodes
    ends = edges.select(F.explode(F.array("subject", "object")).alias("id")).where("id is not null").distinct()
    return nodes.join(ends, "id", "left_semi").select(*nodes.columns), nodes.join(ends, "id", "left_anti").select(*nodes.columns)


def prune_graph(graph: Graph, remove_singletons: bool = False, min_component: int | None = None) -> Graph:
    """Dangling edges go to ``dangling_edges``; then, if asked for, single nodes to ``singleton_nodes``,
    and components of fewer than ``min_component`` nodes go, their nodes to ``small_component_nodes``."""
    nodes, edges, tables = graph.nodes, graph.edges, dict(graph.tables)
    if edges is not None and nodes is not None:
        edges, tables["dangling_edges"] = split_dangling(edges, nodes)
    if nodes is not None and remove_singletons:
        nodes, tables["singleton_nodes"] = split_singletons(nodes, edges)
    if min_component and nodes is not None and edges is not None:
        from .connectivity import node_components

        placed = node_components(nodes, edges)
        big = placed.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_component)
        ids = placed.join(big, "component_id", "left_semi").select("id")
        nodes, tables["small_component_nodes"] = nodes.join(ids, "id", "left_semi"), nodes.join(ids, "id", "left_anti")
        edges = edges.join(ids.withColumnRenamed("id", "subject"), "subject", "left_semi")
    return Graph(nodes, edges, tables)


# --- appending and merging -------------------------------------------------------------


def append(old: DataFrame | None, new: Sequence[DataFrame], deduplicated: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(all rows, archive): new columns are null for old rows. De-duplicates by id, or by triple without ids."""
    rows = union_by_name([f for f in (old, *new) if f is not None])
    if not deduplicated:
        return rows, None
    if "id" in rows.columns:
        return deduplicate(rows)
    return distinct_on(rows, ["subject", "predicate", "object"], present(rows, ["file_source"])), None


def new_columns(old: DataFrame, new: DataFrame) -> list[str]:
    return [c for c in new.columns if c not in old.columns]


@dataclass(frozen=True)
class MergeSteps:
    deduplicate: bool = True
    normalize: bool = True
    prune: bool = True
    remove_singletons: bool = False


def merge_graph(graph: Graph, mappings: DataFrame | None = None, steps: MergeSteps = MergeSteps()) -> Graph:
    """De-duplicate, normalize and prune as one lazy plan."""
    if steps.normalize and mappings is None:
        raise ValueError("normalizing needs mappings")
    if steps.deduplicate:
        graph = deduplicate_graph(graph)
    if steps.normalize and graph.edges is not None:
        graph = Graph(graph.nodes, normalize_edges(graph.edges, mappings), graph.tables)
    return prune_graph(graph, steps.remove_singletons) if steps.prune else graph


# --- splitting ----------------------------------------------------------------------------


def split_memberships(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``df`` with ``_<field>`` values, one row for each combination a row belongs to.

    A list field gives a row for each distinct element; null, or an empty list, is a value of its own. With several
    list fields the combinations are those that some row's lists make side by side, the shorter filled with null; a row
    belongs to each of them whose values are all its own.
    """
    lists = [f for f in fields if isinstance(df.schema[f].dataType, T.ArrayType)]
    if len(lists) > 1:
        at = [F.col("_z")[f] if f in lists else F.col(f) for f in fields]
        filled = df.withColumns({f: F.coalesce(F.col(f), F.array().cast(df.schema[f].dataType)) for f in lists})
        beside = filled.select(*[f for f in fields if f not in lists], F.explode_outer(F.arrays_zip(*lists)).alias("_z")).select(*[x.alias(f"_made_{f}") for x, f in zip(at, fields, strict=True)]).distinct()
        single = reduce(lambda d, f: d.withColumn(f"_{f}", F.explode_outer(F.array_distinct(F.col(f))) if f in lists else F.col(f)), fields, df)
        return single.join(beside, reduce(and_, [F.equal_null(f"_{f}", f"_made_{f}") for f in fields]), "left_semi")
    for f in fields:
        if isinstance(df.schema[f].dataType, T.ArrayType):
            df = df.withColumn(f"_{f}", F.explode_outer(F.array_distinct(F.col(f))))
        else:
            df = df.withColumn(f"_{f}", F.col(f))
    return df
