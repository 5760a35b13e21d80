"""Connectivity: components of a graph, their node, source and summary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_deprecated, list_text, present
from .components import checkpointed, connected_components
from .reports import first_of_each

BUCKETS = ("LCC", "100+", "10-99", "2-9", "Isolated")


def node_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component_id, component_size): every node; 0 is the largest component, ties by least node id.

    Only edges between nodes count. Components are ranked as rows of one a component.
    """
    ids = nodes.select("id").where("id is not null").distinct()
    inner = edges.select("subject", "object").join(ids.withColumnRenamed("id", "subject"), "subject", "left_semi")
    inner = inner.join(ids.withColumnRenamed("id", "object"), "object", "left_semi")
    joined = connected_components(inner, "subject", "object")
    placed = checkpointed(ids.join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("root")))
    sizes = placed.groupBy("root").agg(F.count(F.lit(1)).alias("component_size"))
    ranked = _ranked(sizes)
    return placed.join(ranked, "root").select("id", "component_id", "component_size")


def _ranked(sizes: DataFrame) -> DataFrame:
    """Component ids by falling size, then by root.

    Equal sizes are cut by range of root, so that no task ranks all single
    nodes: a rank inside the piece follows the rows of all earlier pieces.
    """
    spark = sizes.sparkSession
    pieces = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc("component_size"), F.asc("root")]
    ranged = checkpointed(sizes.repartitionByRange(pieces, *order).withColumn("_piece", F.spark_partition_id()))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_piece").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    inside = Window.partitionBy("_piece").orderBy(*order)
    ranked = ranged.withColumn("_rank", F.row_number().over(inside) - 1).join(starts, "_piece")
    return ranked.select("root", "component_size", (F.col("_start") + F.col("_rank")).cast("long").alias("component_id"))


def cc_nodes(nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """Each node with its component, its columns with lists as text, and ``deprecated``."""
    columns = [list_text(nodes, c).alias(c) for c in nodes.columns]
    named = is_deprecated(F.col("name")) if "name" in nodes.columns else F.lit(False)
    return placed.join(nodes.select(*columns), "id", "left").withColumn("deprecated", named)


def cc_component_sources(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """Edges of each component with more than one node, by the source columns that there are."""
    by = present(edges, ["primary_knowledge_source", "provided_by", "predicate"])
    where = placed.where("component_size > 1").select(F.col("id").alias("subject"), "component_id")
    return edges.join(where, "subject").groupBy("component_id", *by).agg(F.count(F.lit(1)).alias("edge_count"))


def _bucket(size, largest):
    return (
        F.when(size == largest, "LCC").when(size >= 100, "100+").when(size >= 10, "10-99").when(size >= 2, "2-9").otherwise("Isolated")
    )


def cc_components(nodes: DataFrame, edges: DataFrame, placed: DataFrame) -> DataFrame:
    """One row a component: size, deprecated nodes, main category, categories, sources, five sample ids, edges, bucket."""
    full = cc_nodes(nodes, placed)
    for c in ("category", "provided_by"):
        if c not in full.columns:
            full = full.withColumn(c, F.lit(None).cast("string"))
    samples = first_of_each(placed.select("component_id", "id"), ["component_id"], ["id"], 5).groupBy("component_id").agg(F.array_sort(F.collect_list("id")).alias("sample_node_ids"))
    by_node = full.groupBy("component_id").agg(
        F.max("component_size").alias("size"),
        F.count_if("deprecated").alias("deprecated_count"),
        F.mode("category", True).alias("main_category"),
        F.count_distinct("category").alias("n_categories"),
        F.count_distinct("provided_by").alias("n_provided_by"),
    )
    by_edge = cc_component_sources(edges, placed).groupBy("component_id").agg(F.sum("edge_count").alias("edge_count"), F.count(F.lit(1)).alias("source_count"))
    largest = F.broadcast(placed.agg(F.max("component_size").alias("_largest")))  # one row
    zero = F.lit(0).cast("long")
    return (
        by_node.join(samples, "component_id")
        .join(by_edge, "component_id", "left")
        .crossJoin(largest)
        .withColumns({"edge_count": F.coalesce("edge_count", zero), "source_count": F.coalesce("source_count", zero), "bucket": _bucket(F.col("size"), F.col("_largest"))})
        .drop("_largest")
    )


def connectivity_summary(components: DataFrame) -> DataFrame:
    """One row: nodes, components, singletons, deprecated nodes, the largest size and its share (6 digits)."""
    return components.agg(
        F.sum("size").alias("nodes"),
        F.count(F.lit(1)).alias("components"),
        F.count_if(F.col("size") == 1).alias("singletons"),
        F.sum("deprecated_count").alias("deprecated"),
        F.max("size").alias("largest"),
        F.round(F.max("size") / F.sum("size"), 6).alias("lcc_fraction"),
    )


def bucket_distribution(components: DataFrame) -> DataFrame:
    return components.groupBy("bucket").agg(F.count(F.lit(1)).alias("components"), F.sum("size").alias("nodes"))


def top_minor_components(components: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest components besides the largest one, in order."""
    return components.where("component_id > 0").orderBy("component_id").limit(n)


def connectivity_highlights(nodes_placed: DataFrame, sources: DataFrame, categories: int = 20, source_column: str = "provided_by", most_sources: int = 15) -> DataFrame:
    """(section, value, count): the most frequent categories inside and outside the largest component, and the sources with most
    edges outside it; ties by value. ``nodes_placed`` as of ``cc_nodes``, ``sources`` as of ``cc_component_sources``."""
    outside = F.col("component_id") != 0
    by_category = (
        nodes_placed.where("category is not null").groupBy(F.when(outside, "categories outside").otherwise("categories inside").alias("section"), F.col("category").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    )
    by_source = sources.where(outside & F.col(source_column).isNotNull()).groupBy(F.lit("sources outside").alias("section"), F.col(source_column).alias("value")).agg(F.sum("edge_count").alias("count"))
    down = by_category.unionByName(by_source).withColumn("_down", -F.col("count"))
    top = first_of_each(down, ["section"], ["_down", "value"], max(categories, most_sources))
    ranked = top.withColumn("_rank", F.row_number().over(Window.partitionBy("section").orderBy("_down", "value")))
    return ranked.where(F.col("_rank") <= F.when(F.col("section") == "sources outside", most_sources).otherwise(categories)).select("section", "value", "count")
