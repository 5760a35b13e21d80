"""Connected components kept up to date while edges are appended to a store.

Two tables are stored: ``component_labels`` (id, component), to which only ids that are new are
appended, and ``component_roots`` (component, root) of the components that were merged since. A batch
of edges looks up the labels of its own ids, in the files that may hold them; its edges between
labels are a small graph of their own, whose components say which labels merge. So the work follows
the batch, and the merges so far, not the stored graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, stored

LABELS, ROOTS = "component_labels", "component_roots"


def start(store, edges: DataFrame, source: str = "subject", target: str = "object") -> None:
    """Components of ``edges`` from nothing; the least id names a component."""
    store.put(LABELS, connected_components(edges, source, target))
    store.put(ROOTS, store.table(LABELS).select("component", F.col("component").alias("root")).limit(0))


def components(store) -> DataFrame:
    """(id, component) of all edges so far."""
    roots = store.table(ROOTS)
    return store.table(LABELS).join(roots, "component", "left").select("id", F.coalesce("root", "component").alias("component"))


def add_edges(store, edges: DataFrame, source: str = "subject", target: str = "object") -> None:
    """A batch of edges. Repeated edges, and edges inside a component, change nothing; an edge with a null end takes no part in
    merging, and its other end gets a label only if another edge has it."""
    ends, _ = stored(edges.select(F.col(source).alias("u"), F.col(target).alias("v")).where("u is not null and v is not null").distinct(), "update-edges")
    ids = ends.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    known = store.lookup(LABELS, ids).join(store.table(ROOTS), "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    own, _ = stored(ids.join(known, "id", "left").select("id", F.coalesce("component", "id").alias("component"), F.col("component").isNull().alias("new")), "update-ids")
    label = own.select("id", "component")
    between = ends.join(label.toDF("u", "cu"), "u").join(label.toDF("v", "cv"), "v").where("cu <> cv").select("cu", "cv").distinct()
    merged = connected_components(between, "cu", "cv").where("id <> component").select(F.col("id").alias("was"), F.col("component").alias("now"))
    merged, _ = stored(merged, "update-merged")
    fresh = own.where("new").select("id", "component").join(merged, F.col("component") == F.col("was"), "left").select("id", F.coalesce("now", "component").alias("component"))
    # roots so far are led on, and labels that stopped being roots get one; labels of new ids are final already
    roots = store.table(ROOTS)
    led = roots.join(merged, F.col("root") == F.col("was"), "left").select("component", F.coalesce("now", "root").alias("root"))
    stopped = merged.join(own.where("new").select(F.col("component").alias("was")), "was", "left_anti").select(F.col("was").alias("component"), F.col("now").alias("root"))
    roots, _ = stored(led.unionByName(stopped), "update-roots")
    store.append(LABELS, fresh)
    store.put(ROOTS, roots)
