"""Closure tables, derived edge columns, denormalized frames and information content.

The long closure is the working form; list tables are made for export, since a
root term's list is as long as the ontology.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_of, as_list, is_list, namespace_of, none_if_empty, not_negated, present


def _sorted_list(x: Column) -> Column:
    """All values, nulls included and last."""
    return F.array_sort(F.transform(F.collect_list(F.struct(x.alias("x"))), lambda s: s["x"]))


def closure_ids(closure: DataFrame) -> DataFrame:
    """(id, closure): the ancestors of each subject."""
    return closure.groupBy(F.col("subject_id").alias("id")).agg(_sorted_list(F.col("object_id")).alias("closure"))


def closure_labels(closure: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, closure_label): the names of the ancestors that are nodes."""
    names = nodes.select(F.col("id").alias("object_id"), "name")
    return closure.join(names, "object_id").groupBy(F.col("subject_id").alias("id")).agg(_sorted_list(F.col("name")).alias("closure_label"))


def descendants(closure: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, descendants, descendants_label); labels are null where no descendant is a node."""
    ids = closure.groupBy(F.col("object_id").alias("id")).agg(_sorted_list(F.col("subject_id")).alias("descendants"))
    names = nodes.select(F.col("id").alias("subject_id"), "name")
    labels = closure.join(names, "subject_id").groupBy(F.col("object_id").alias("id")).agg(_sorted_list(F.col("name")).alias("descendants_label"))
    return ids.join(labels, "id", "left")


def with_namespace(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("namespace", namespace_of(F.col("id")))


def evidence_count(edges: DataFrame, fields: Sequence[str]) -> Column:
    """The elements of the evidence lists together; an absent or null list has none, a scalar counts as one."""
    total = F.lit(0)
    for f in present(edges, fields):
        total = total + F.coalesce(F.size(as_list(edges, f)), F.lit(0))
    return total.cast("long")


def grouping_key(edges: DataFrame, fields: Sequence[str]) -> Column:
    """The fields joined by ``|``, nulls left out. ``negated`` says NOT when true, and false or nothing otherwise."""
    parts = []
    for f in present(edges, fields):
        if f == "negated":
            parts.append(F.coalesce(F.replace(F.col(f).cast("string"), F.lit("true"), F.lit("NOT")), F.lit("")))
        else:
            parts.append(F.array_join(f, "|") if is_list(edges, f) else F.col(f))
    return F.concat_ws("|", *parts)


@dataclass(frozen=True)
class Denormalize:
    """Fields to expand, those that get a label only, and the grouping fields."""

    fields: tuple[str, ...] = ("subject", "object")
    label_only: tuple[str, ...] = ()
    taxon: tuple[str, ...] = ("subject", "object")


def _node_columns(nodes: DataFrame, closure: DataFrame | None, field: str, config: Denormalize, wanted: set[str] | None) -> DataFrame:
    """One narrow side for an edge field: its id as ``_key`` and the wanted columns."""
    side = nodes.select("id", *present(nodes, ["name", "category", "in_taxon", "in_taxon_label"]))
    out = {f"{field}_label": F.col("name")}
    if field not in config.label_only:
        if "category" in nodes.columns:
            out[f"{field}_category"] = F.col("category")
        out[f"{field}_namespace"] = namespace_of(F.col("id"))
        if field in config.taxon:
            for c, end in (("in_taxon", "taxon"), ("in_taxon_label", "taxon_label")):
                if c in nodes.columns:
                    out[f"{field}_{end}"] = F.col(c)
        if closure is not None:
            ids, labels = f"{field}_closure", f"{field}_closure_label"
            if wanted is None or ids in wanted:
                side = side.join(closure_ids(closure), "id", "left")
                out[ids] = F.col("closure")
            if wanted is None or labels in wanted:
                side = side.join(closure_labels(closure, nodes), "id", "left")
                out[labels] = F.col("closure_label")
    return side.select(F.col("id").alias("_key"), *[c.alias(n) for n, c in out.items() if wanted is None or n in wanted])


def denormalized_edges(edges: DataFrame, nodes: DataFrame, closure: DataFrame | None = None, config: Denormalize = Denormalize(), wanted: Sequence[str] | None = None) -> DataFrame:
    """Edges with label, category, namespace, closure and taxon of each configured field.

    Only joins that ``wanted`` columns need are made. A list field is exploded to
    its distinct elements, so an edge gives a row for each element that is a
    node, or one row if none is; never a join on list containment.
    """
    keep = set(wanted) if wanted is not None else None
    for field in [f for f in (*config.fields, *config.label_only) if f in edges.columns]:
        side = _node_columns(nodes, closure, field, config, keep)
        made = [c for c in side.columns if c != "_key"]
        if not made:
            continue
        edges = edges.drop(*made)
        if is_list(edges, field):
            # a key of 128 bits from the row's own cells, so that a retried task makes the same one; equal rows share their hits
            cells = [F.to_json(c) if "map<" in edges.schema[c].dataType.simpleString() else F.col(c) for c in edges.columns]
            rows = edges.withColumns({"_row1": F.xxhash64(*cells), "_row2": F.xxhash64(F.lit(1), *cells[::-1])})
            elements = rows.select("_row1", "_row2", F.explode(F.array_distinct(F.col(field))).alias("_element")).distinct()
            hits = elements.join(side, F.col("_element") == F.col("_key")).drop("_element", "_key")
            edges = rows.join(hits, ["_row1", "_row2"], "left").drop("_row1", "_row2")
        else:
            edges = edges.join(side, F.col(field) == F.col("_key"), "left").drop("_key")
    return edges if keep is None else edges.select(*wanted)


def predicate_side_table(edges: DataFrame, nodes: DataFrame, predicate: str, closure: DataFrame | None = None, constraint: str | None = None) -> DataFrame:
    """(id, has_<p>, has_<p>_label, has_<p>_count and, with a closure, has_<p>_closure, _closure_label).

    Edges are filtered and reduced to distinct objects of each subject first.
    ``constraint`` is SQL over the edges, which are named ``e``.
    """
    name = "has_" + predicate.replace("biolink:", "").removeprefix("has_")
    rows = edges.alias("e").where(F.col("e.predicate") == predicate)
    if constraint:
        rows = rows.where(F.expr(constraint))
    pairs = rows.select(F.col("e.subject").alias("id"), F.col("e.object").alias("o")).where("id is not null and o is not null").distinct()
    names = nodes.select(F.col("id").alias("o"), F.col("name").alias("o_name"))
    made = pairs.join(names, "o", "left")
    out = made.groupBy("id").agg(
        F.array_sort(F.collect_set("o")).alias(name), none_if_empty(F.array_sort(F.collect_set("o_name"))).alias(f"{name}_label"), F.count_distinct("o").alias(f"{name}_count")
    )
    if closure is not None:
        up = pairs.join(closure.select(F.col("subject_id").alias("o"), F.col("object_id").alias("a")), "o").select("id", "a").distinct()
        labels = nodes.select(F.col("id").alias("a"), F.col("name").alias("a_name"))
        lists = up.join(labels, "a", "left").groupBy("id").agg(
            F.array_sort(F.collect_set("a")).alias(f"{name}_closure"), none_if_empty(F.array_sort(F.collect_set("a_name"))).alias(f"{name}_closure_label")
        )
        out = out.join(lists, "id", "left")
    return out


def denormalized_nodes(nodes: DataFrame, edges: DataFrame, predicates: Sequence[str], closure: DataFrame | None = None) -> DataFrame:
    """Nodes with a side table for each predicate and, with a closure, has_descendant, _label and _count."""
    out = nodes
    for p in predicates:
        side = predicate_side_table(edges, nodes, p, closure)
        out = out.join(side, "id", "left")
        counts = [c for c in side.columns if c.endswith("_count")]
        out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    if closure is not None:
        below = descendants(closure, nodes).select(
            "id", F.col("descendants").alias("has_descendant"), F.col("descendants_label").alias("has_descendant_label"), F.size("descendants").cast("long").alias("_n")
        )
        out = out.join(below, "id", "left").withColumn("has_descendant_count", F.coalesce("_n", F.lit(0))).drop("_n")
    return out


def information_content(closure: DataFrame, predicates: Sequence[str]) -> DataFrame:
    """(term, ic): -log2(distinct descendants / distinct terms) over the chosen closure predicates."""
    pairs = closure.where(F.col("predicate_id").isin(list(predicates))).select("subject_id", "object_id")
    whole = pairs.agg(F.count_distinct("object_id").alias("_all"))
    terms = pairs.groupBy(F.col("object_id").alias("term")).agg(F.count_distinct("subject_id").alias("_below"))
    return terms.crossJoin(F.broadcast(whole)).select("term", (-F.log2(F.col("_below") / F.col("_all")) + 0.0).alias("ic"))  # one row


def closure_sizes(edges: DataFrame, closure: DataFrame, predicates: Sequence[str], categories: Sequence[str] = (), edge_predicates: Sequence[str] = (), negated: bool = False) -> DataFrame:
    """(entity, size): distinct ancestors of the terms that an entity is associated with."""
    rows = edges
    if categories:
        rows = rows.where(any_of(edges, "category", categories))
    if edge_predicates:
        rows = rows.where(F.col("predicate").isin(list(edge_predicates)))
    if not negated:
        rows = rows.where(not_negated(edges))
    pairs = rows.select(F.col("subject").alias("entity"), F.col("object").alias("subject_id")).distinct()
    up = closure.where(F.col("predicate_id").isin(list(predicates))).select("subject_id", "object_id").distinct()
    return pairs.join(up, "subject_id").groupBy("entity").agg(F.count_distinct("object_id").alias("size"))


def sorted_closure(closure: DataFrame) -> DataFrame:
    """Laid out so that Parquet statistics prune by subject."""
    return closure.repartitionByRange("subject_id").sortWithinPartitions("subject_id", "predicate_id", "object_id")

