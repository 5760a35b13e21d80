"""Whole operations on a stored graph: read a ``GraphStore``, apply operators, save a new version or write a report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .model import Graph
from .operators import closure as cl
from .operators import connectivity as cc
from .operators import integrity as it
from .operators import modelcheck as mc
from .operators import profile as pf
from .operators import reports as rp
from .operators.catalogue import Catalogue, ensure_slots, export_schema
from .plans.store import GraphStore
from .sources import readers, sinks


def load(spark: SparkSession, store: str, files: Sequence[str], join: bool = False, slots: str | None = None, ensure: dict[str, Sequence[str]] | None = None, **options) -> dict:
    """Files into a new version of the store. With ``join`` ``provided_by`` comes from the files. ``ensure`` names columns of nodes and
    edges that must be there: those that no file has are null, of the type that the model gives them."""
    from dataclasses import replace

    specs = [readers.infer_file_spec(f) for f in readers.discover(files)]
    if slots:
        wanted = readers.slots_of(slots)
        specs = [replace(s, slots=wanted.get(s.table)) if s.format == "jsonl" and not s.slots else s for s in specs]
    loaded = readers.load_graph(spark, specs, provided_by=join, **options)
    have = {t: df for t, df in (("nodes", loaded.graph.nodes), ("edges", loaded.graph.edges)) if df is not None}
    have = {t: ensure_slots(df, (ensure or {}).get(t, ())) for t, df in have.items()}
    target = GraphStore(spark, store)
    target.save(Graph(have.get("nodes"), have.get("edges"), loaded.graph.tables), schema=export_schema(have) if have else None)
    return {"files": loaded.files, "errors": loaded.errors, "rows": target.stats(), "losing": {f: dict(x.get) for f, x in loaded.losing.items()}}


def append(spark: SparkSession, store: str, files: Sequence[str], deduplicate: bool = False) -> dict:
    """Files as new segments of the store's tables; older files stay as they are. With ``deduplicate`` a row whose id, or
    triple without ids, is stored already is left out, and kept in ``duplicate_<table>``."""
    target = GraphStore(spark, store)
    loaded = readers.load_graph(spark, [readers.infer_file_spec(f) for f in readers.discover(files)])
    added, before = {}, target.stats()
    for t in ("nodes", "edges"):
        new = getattr(loaded.graph, t)
        if new is None:
            continue
        done = target.append(t, new, deduplicate)
        added[t] = done.new_columns
        if done.left_out is not None:
            target.append(f"duplicate_{t}", done.left_out)
    if any(added.values()):
        _evolve(target)
    return {"new_columns": added, "errors": loaded.errors, "net_rows": {t: n - before.get(t, 0) for t, n in target.stats().items()}}


def lay_out(spark: SparkSession, store: str) -> None:
    """Copies of the edges in buckets of subject and of object, next to the nodes' buckets of id."""
    target = GraphStore(spark, store)
    for end in ("subject", "object"):
        target.add_layout("edges", f"edges_by_{end}", [end])


def stored_dangling(target: GraphStore) -> DataFrame:
    """The dangling edges of a store that is laid out: each end is looked up bucket by bucket. Only edges that lack
    their object's node are shuffled, to see that they have their subject's and aren't counted twice."""
    ids = target.bucketed("nodes").select("id")
    no_subject = target.bucketed("edges_by_subject").join(ids, F.col("subject") == ids["id"], "left_anti")
    no_object = target.bucketed("edges_by_object").join(ids, F.col("object") == ids["id"], "left_anti")
    return no_subject.unionByName(no_object.join(ids, F.col("subject") == ids["id"], "left_semi"))


def stored_singletons(target: GraphStore) -> DataFrame:
    """Nodes of a store that is laid out that are no edge's end, bucket by bucket."""
    nodes = target.bucketed("nodes")
    for end in ("subject", "object"):
        ends = target.bucketed(f"edges_by_{end}").select(F.col(end).alias("_end"))
        nodes = nodes.join(ends, nodes["id"] == ends["_end"], "left_anti")
    return nodes


def stored_named_edges(target: GraphStore, end: str, columns: Sequence[str] = ("category", "name")) -> DataFrame:
    """Edges with ``<end>_<column>`` of the node at one end, bucket by bucket. Of repeated node ids the first counts."""
    nodes, _ = it.deduplicate(target.bucketed("nodes"))
    named = nodes.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns])
    return target.bucketed(f"edges_by_{end}").join(named, end, "left")


def _changed(spark: SparkSession, store: str, change) -> dict[str, int]:
    target = GraphStore(spark, store)
    target.save(change(target.graph()))
    return target.stats()


def deduplicate(spark: SparkSession, store: str) -> dict[str, int]:
    return _changed(spark, store, it.deduplicate_graph)


def normalize(spark: SparkSession, store: str, mappings: Sequence[str]) -> dict[str, int]:
    maps = readers.read_mappings(spark, mappings)
    return _changed(spark, store, lambda g: Graph(g.nodes, it.normalize_edges(g.edges, maps), {**g.tables, "mappings": it.one_mapping_each(maps)}))


def prune(spark: SparkSession, store: str, remove_singletons: bool = False, min_component: int | None = None) -> dict[str, int]:
    return _changed(spark, store, lambda g: it.prune_graph(g, remove_singletons, min_component))


def merge(
    spark: SparkSession, store: str, files: Sequence[str], mappings: Sequence[str] = (), skip: Sequence[str] = (), remove_singletons: bool = False,
    export: str | None = None, format: str = "tsv", archive: bool = False, compress: bool = False,
) -> dict:
    """Join, de-duplicate, normalize, prune and, with ``export``, write, as one plan.

    A failure is reported and not raised: ``steps`` tells of each step whether it went well, and those after a
    failed one are still tried, on the graph as it was before that step. The store is changed only if all went well.
    """
    done: list[dict] = []

    def step(name: str, f, otherwise=None):
        try:
            out = f()
            done.append({"step": name, "success": True})
            return out
        except Exception as e:
            done.append({"step": name, "success": False, "error": str(e).splitlines()[0]})
            return otherwise

    def normalized(g: Graph) -> Graph:
        if maps is None:
            raise ValueError("normalizing needs mappings")
        return Graph(g.nodes, it.normalize_edges(g.edges, maps), g.tables) if g.edges is not None else g

    if compress and not archive:
        done.append({"step": "options", "success": False, "error": "compress needs archive"})
    loaded = step("join", lambda: readers.join_graphs(spark, [readers.infer_file_spec(f) for f in readers.discover(files)]))
    maps = step("mappings", lambda: readers.read_mappings(spark, mappings)) if mappings else None
    out = {"errors": loaded.errors if loaded else [], "files": [], "rows": {}}
    if loaded:
        graph = loaded.graph
        for name, change in (("deduplicate", it.deduplicate_graph), ("normalize", normalized), ("prune", lambda g: it.prune_graph(g, remove_singletons))):
            if name not in skip:
                graph = step(name, lambda change=change: change(graph), graph)  # noqa: B023
        if all(x["success"] for x in done):
            target = step("save", lambda: GraphStore(spark, store))
            if target and step("write", lambda: target.save(graph) or True):
                out["rows"] = target.stats()
                if export:
                    out["files"] = step("export", lambda: sinks.export_graph(target.graph(), export, format=format, archive=archive, compress=compress), [])
    return {"success": all(x["success"] for x in done), "steps": done, **out}


def split(spark: SparkSession, file: str, folder: str, fields: Sequence[str], format: str | None = None) -> dict[str, str]:
    spec = readers.infer_file_spec(file)
    graph = readers.load_graph(spark, [spec]).graph
    name = spec.source.removesuffix(f"_{spec.table}")
    return sinks.split_files(getattr(graph, spec.table), folder, fields, name, f"_{spec.table}", format or spec.format)


def export(spark: SparkSession, store: str, folder: str, **options) -> list[str]:
    return sinks.export_graph(GraphStore(spark, store, "r").graph(), folder, **options)


def convert(spark: SparkSession, files: Sequence[str], folder: str, name: str = "graph", format: str = "parquet") -> list[str]:
    loaded = readers.load_graph(spark, [readers.infer_file_spec(f) for f in readers.discover(files)])
    return sinks.export_graph(loaded.graph, folder, name, format)


def closurize(
    spark: SparkSession, store: str, closure: str | None = None, evidence: Sequence[str] = ("has_evidence", "publications"), grouping: Sequence[str] = ("subject", "negated", "predicate", "object"), lists: bool = False
) -> dict[str, int]:
    """Namespaces, evidence counts and grouping keys; with a closure file its long table too, and with ``lists`` a row for each
    id with its ancestors, their labels and its descendants. Denormalized frames are views, made when they are asked for."""

    def change(g: Graph) -> Graph:
        edges = g.edges.drop("evidence_count", "grouping_key")
        edges = edges.withColumns({"evidence_count": cl.evidence_count(edges, evidence), "grouping_key": cl.grouping_key(edges, grouping)})
        tables, nodes = dict(g.tables), cl.with_namespace(g.nodes)
        if closure:
            tables["closure"] = cl.sorted_closure(readers.read_closure(spark, closure))
        if lists:
            pairs = tables["closure"]
            tables |= {"closure_id": cl.closure_ids(pairs), "closure_label": cl.closure_labels(pairs, nodes), "descendants_id_label": cl.descendants(pairs, nodes)}
        return Graph(nodes, edges, tables)

    out = _changed(spark, store, change)
    _evolve(GraphStore(spark, store))
    return out


def _evolve(target: GraphStore) -> None:
    """The store's schema as its tables are now."""
    target.set_schema(export_schema({t: target.table(t) for t in ("nodes", "edges") if t in target.tables()}))


def information_content(spark: SparkSession, store: str, predicates: Sequence[str], categories: Sequence[str] = ()) -> dict[str, int]:
    def change(g: Graph) -> Graph:
        c = g.tables["closure"]
        return g.with_tables(information_content=cl.information_content(c, predicates), closure_size=cl.closure_sizes(g.edges, c, predicates, categories))

    return _changed(spark, store, change)


def graph_of(spark: SparkSession, store: str | None, files: Sequence[str] = ()) -> Graph:
    """A store's graph, or files read for a report as they are."""
    if bool(store) == bool(files):
        raise ValueError("either a store or files are needed")
    if store:
        return GraphStore(spark, store, "r").graph()
    have = {}
    for f in readers.discover(files):
        spec = readers.infer_file_spec(f)
        have.setdefault(spec.table, []).append(readers.read_file(spark, spec))
    return Graph(*[it.union_by_name(have[t]) if t in have else None for t in ("nodes", "edges")])


def _with_section(df: DataFrame, section: str) -> DataFrame:
    return df.select(F.lit(section).alias("section"), "source", df.columns[1], "count").toDF("section", "source", "value", "count")


def report(graph: Graph, kind: str) -> DataFrame:
    """qc, graph-stats, schema or connectivity, as rows."""
    tables = {t: df for t, df in {"nodes": graph.nodes, "edges": graph.edges, **graph.tables}.items() if df is not None}
    if kind == "schema":
        return rp.schema_report({t: tables[t] for t in ("nodes", "edges") if t in tables})
    if kind == "graph-stats":
        return it.union_by_name([rp.graph_stats(tables[t], t).withColumn("table_name", F.lit(t)) for t in ("nodes", "edges") if t in tables])
    if kind == "connectivity":
        return cc.cc_components(graph.nodes, graph.edges, cc.node_components(graph.nodes, graph.edges))
    if kind != "qc":
        raise ValueError(f"no report {kind!r}")
    parts = []
    for name, as_table in (("nodes", "nodes"), ("edges", "edges"), ("dangling_edges", "edges"), ("duplicate_nodes", "nodes"), ("duplicate_edges", "edges")):
        df = tables.get(name)
        if df is not None and rp.source_column(df, as_table):
            parts.append(_with_section(rp.by_source(df, as_table), name))
            parts.append(_with_section(rp.namespaces_by_source(df, as_table), f"{name} namespaces"))
    return it.union_by_name(parts)


def _nested(df: DataFrame, table: str) -> list[dict]:
    """For each source, nulls left out: its rows, categories or predicates with counts, and namespaces. One entry a source, read from
    counts that were grouped before."""
    source = rp.source_column(df, table)
    if not source:
        return []
    kind = "category" if table == "nodes" else "predicate"
    out: dict[str, dict] = {}
    for r in rp.graph_stats(df, table).where("source is not null").collect() if kind in df.columns else ():
        entry = out.setdefault(r["source"], {"name": r["source"], "total_number": 0, "categories" if table == "nodes" else "predicates": {}})
        if r["kind"] == kind:
            entry["total_number"] += r["count"]
            entry["categories" if table == "nodes" else "predicates"][str(r["value"])] = r["count"]
    for r in rp.namespaces_by_source(df, table).where("source is not null").collect():
        out.setdefault(r["source"], {"name": r["source"]}).setdefault("namespaces", []).append(r[1])
    for entry in out.values():
        entry["namespaces"] = sorted(x for x in entry.get("namespaces", []) if x is not None)
    return [out[k] for k in sorted(out)]


def qc_report(graph: Graph) -> dict:
    """The nested quality report: totals, and for nodes, edges, dangling and repeated rows what each source has; dangling edges
    also with the distinct ids that are missing. Its size is that of the sources and their categories."""
    tables = {t: df for t, df in {"nodes": graph.nodes, "edges": graph.edges, **graph.tables}.items() if df is not None}
    summary = {f"total_{t}" if t in ("nodes", "edges") else t: tables[t].count() for t in ("nodes", "edges", "dangling_edges", "duplicate_nodes", "duplicate_edges", "singleton_nodes") if t in tables}
    out = {"summary": summary}
    for name, as_table in (("nodes", "nodes"), ("edges", "edges"), ("dangling_edges", "edges"), ("duplicate_nodes", "nodes"), ("duplicate_edges", "edges")):
        if name in tables:
            out[name] = _nested(tables[name], as_table)
    if "dangling_edges" in tables and graph.nodes is not None:
        by = rp.source_column(tables["dangling_edges"], "edges") or "file_source"
        if by in tables["dangling_edges"].columns:
            missing = {r[by]: r["missing_ids"] for r in it.dangling_counts(tables["dangling_edges"], graph.nodes, by).collect()}  # a row a source
            for entry in out["dangling_edges"]:
                entry["missing_ids"] = missing.get(entry["name"], 0)
    return out


def connectivity_tables(graph: Graph, folder: str) -> dict[str, int]:
    """The three tables of the components, ``cc_nodes``, ``cc_components`` and ``cc_component_sources``, as Parquet, with their rows."""
    from .operators.components import stored

    placed, _ = stored(cc.node_components(graph.nodes, graph.edges), "components-placed")
    made = {"cc_nodes": cc.cc_nodes(graph.nodes, placed), "cc_components": cc.cc_components(graph.nodes, graph.edges, placed), "cc_component_sources": cc.cc_component_sources(graph.edges, placed)}
    out = {}
    for name, df in made.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        out[name] = seen.get["n"]
    return out


def profile(graph: Graph, top: int | None = None) -> DataFrame:
    parts = [pf.marginals(df, c, t, top) for t, df in (("nodes", graph.nodes), ("edges", graph.edges)) if df is not None and (c := pf.categorical_columns(df))]
    return it.union_by_name(parts)


def model_check(graph: Graph, model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Edge types and node prefixes that the model, the default one or a YAML file's, doesn't allow."""
    catalogue = None
    if model:
        with open(model) as f:
            catalogue = Catalogue.load(f.read())
    return mc.check_edge_types(graph.edges, graph.nodes, catalogue).where("verdict <> 'ok'"), mc.check_prefixes(graph.nodes, catalogue)
