"""Conformance of edges and node prefixes to a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_list, curie_prefix, prefixed
from .catalogue import Catalogue, default_catalogue
from .components import checkpointed


def _cats(df: DataFrame, column: str) -> Column:
    return F.array_sort(F.transform(as_list(df, column), lambda x: prefixed(x)))


def _small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df`` marked for broadcast if it was counted to have at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def check_edge_types(edges: DataFrame, nodes: DataFrame, catalogue: Catalogue | None = None) -> DataFrame:
    """(association, subject_categories, predicate, object_categories, count, verdict) of each type of edge.

    Edges lacking a category at an end are out of scope. An edge that asserts a
    constrained class is ok, BAD_SUBJECT, BAD_PREDICATE, BAD_OBJECT or
    BAD_COMBINATION; others are ok or NOT_IN_LEGAL_TYPES.

    The model is a few tables, so the plan is the same for a model of any size: a type's categories are
    joined to their ancestors, and these to the constraints, which name classes and not their descendants.
    """
    catalogue = catalogue or default_catalogue()
    cats = nodes.select("id", _cats(nodes, "category").alias("cats"))
    asserted = _cats(edges, "category") if "category" in edges.columns else F.lit(None).cast("array<string>")
    rows = edges.select(F.coalesce(asserted, F.array().cast("array<string>")).alias("association"), "subject", "object", prefixed(F.col("predicate")).alias("predicate"))
    for end in ("subject", "object"):
        rows = rows.join(cats.select(F.col("id").alias(end), F.col("cats").alias(f"{end}_categories")), end)
    by = ["association", "subject_categories", "predicate", "object_categories"]
    types = rows.where("size(subject_categories) > 0 and size(object_categories) > 0").groupBy(*by).agg(F.count(F.lit(1)).alias("count"))
    types = checkpointed(types.withColumn("_type", F.monotonically_increasing_id()))
    model = catalogue.relations(edges.sparkSession)
    lineage = _small(model["lineage"])

    def above(end: str) -> DataFrame:
        own = types.select("_type", F.explode(F.array_distinct(f"{end}_categories")).alias("class"))
        return checkpointed(own.join(lineage, "class").select("_type", F.col("ancestor").alias(end)).distinct())

    subjects, objects = above("subject").withColumn("_s", F.lit(True)), above("object").withColumn("_o", F.lit(True))
    claimed = types.select("_type", F.col("predicate").alias("_p"), F.explode(F.array_distinct("association")).alias("association"))
    bound = claimed.join(_small(model["constraints"]), "association").join(subjects, ["_type", "subject"], "left").join(objects, ["_type", "object"], "left")
    flags = {"s": F.coalesce("_s", F.lit(False)), "p": F.coalesce(F.col("predicate") == F.col("_p"), F.lit(False)), "o": F.coalesce("_o", F.lit(False))}
    # a class counts by what any of its rows says, and a type by what any of its classes says
    each = bound.groupBy("_type", "association").agg(*[F.bool_or(x).alias(k) for k, x in flags.items()])
    judged = each.groupBy("_type").agg(F.bool_or(F.col("s") & F.col("p") & F.col("o")).alias("all"), *[F.bool_or(k).alias(k) for k in flags])
    legal = types.select("_type", "predicate").join(_small(model["legal"]), "predicate").join(subjects, ["_type", "subject"], "left_semi").join(objects, ["_type", "object"], "left_semi")
    fits = legal.select("_type", F.lit(True).alias("fits")).distinct()
    verdict = (
        F.when(F.col("all").isNull(), F.when(F.col("fits"), "ok").otherwise("NOT_IN_LEGAL_TYPES"))
        .when(F.col("all"), "ok").when(~F.col("s"), "BAD_SUBJECT").when(~F.col("p"), "BAD_PREDICATE").when(~F.col("o"), "BAD_OBJECT").otherwise("BAD_COMBINATION")
    )
    return types.join(judged, "_type", "left").join(fits, "_type", "left").select(*by, "count", verdict.alias("verdict"))


def check_prefixes(nodes: DataFrame, catalogue: Catalogue | None = None, examples: int = 5) -> DataFrame:
    """(prefix, categories, count, examples): nodes with a category that constrains prefixes, none of which admits theirs."""
    catalogue = catalogue or default_catalogue()
    rows = nodes.select("id", curie_prefix(F.col("id")).alias("prefix"), F.coalesce(_cats(nodes, "category"), F.array().cast("array<string>")).alias("categories"))
    admitted = _small(catalogue.relations(nodes.sparkSession)["prefixes"].withColumnRenamed("prefix", "_admitted"))
    # the few combinations are judged, and then their nodes looked up
    kinds = rows.select("prefix", "categories").distinct().withColumn("class", F.explode(F.array_distinct("categories"))).join(admitted, "class")
    bad_kinds = kinds.groupBy("prefix", "categories").agg(F.bool_or(F.coalesce(F.col("_admitted") == F.col("prefix"), F.lit(False))).alias("ok")).where("not ok").select(F.col("prefix").alias("_prefix"), F.col("categories").alias("_categories"))
    bad = rows.join(_small(checkpointed(bad_kinds)), F.equal_null("prefix", "_prefix") & (F.col("categories") == F.col("_categories")), "left_semi")
    counted = bad.groupBy("prefix", "categories").agg(F.count_distinct("id").alias("count"))
    from .reports import first_of_each

    some = first_of_each(bad.distinct(), ["prefix", "categories"], ["id"], examples).groupBy("prefix", "categories").agg(F.array_sort(F.collect_list("id")).alias("examples"))
    return counted.join(some, ["prefix", "categories"])
