"""Queries that put the driver's tables through files in the shared folder: scans, sinks and ingest runs."""

from __future__ import annotations

from functools import reduce
from types import SimpleNamespace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import operations
from ..ingest import runner
from ..model import FileSpec, Graph
from ..operators import components_update
from ..operators.closure import sorted_closure
from ..operators.integrity import split_lists
from ..operators.reports import schema_report
from ..sources import archives, delimited, readers, sinks
from ..sources import filesystem as fs
from . import fixture
from .store import GraphStore

#: Text of large files is written and read in turns of so many bytes, or in so many turns if that is fewer; and in so many files a turn.
TURN, TURNS, FILES = 250_000_000, 12, 6

_PUBS = "case when trim(publications) = '' then null else list_filter(string_split(trim(publications), '|'), lambda x: trim(x) <> '') end"


def _put(df: DataFrame, spark: SparkSession, label: str, format: str, compression: str | None = None) -> str:
    path = readers.shared_folder(spark, label)
    sinks.write(df, path, format, compression=compression)
    return path


def tsv_file_scan(spark, g):
    path = _put(split_lists(g.edges, ["publications"]), spark, "edges", "tsv")
    return readers.read_file(spark, FileSpec(path, "tsv", "edges", "edges")).select("id", "subject", "object", "publications", "negated")


def jsonl_file_scan(spark, g):
    path = _put(split_lists(g.edges, ["publications"]), spark, "edges", "jsonl")
    return readers.read_file(spark, FileSpec(path, "jsonl", "edges", "edges")).select("id", "predicate", "publications", "score")


def jsonl_slots_scan(spark, g):
    path = _put(g.nodes.select("id", "name", "in_taxon", F.lit(1).alias("unknown")), spark, "nodes", "jsonl")
    return readers.read_file(spark, FileSpec(path, "jsonl", "nodes", "nodes", ("id", "name")))


def parquet_file_load(spark, g):
    nodes, edges = _put(g.nodes.drop("file_source"), spark, "nodes", "parquet"), _put(g.edges.drop("file_source"), spark, "edges", "parquet")
    loaded = readers.join_graphs(spark, [FileSpec(nodes, "parquet", "nodes", "n_src"), FileSpec(edges, "parquet", "edges", "e_src")])
    return loaded.graph.nodes.select("id", "provided_by", "file_source").unionByName(loaded.graph.edges.select("id", "provided_by", "file_source"))


def csv_file_scan(spark, g):
    """Lines with a comment in each part; cells are stripped and typed, the header is given."""
    cells = F.concat_ws(",", F.concat(F.lit(" "), "id", F.lit(" ")), F.concat(F.lit('"'), F.coalesce("predicate", F.lit("")), F.lit('"')), F.coalesce(F.col("score").cast("string"), F.lit("")))
    path = readers.shared_folder(spark, "csv")
    g.edges.select(F.explode(F.array(cells, F.lit("# a comment"), F.lit(""))).alias("line")).write.text(path)
    form = delimited.CsvFormat(",", "none", ("id", "predicate", "score"), {"score": "float"})
    return delimited.read_csv(spark, [path], form)


def closure_file_scan(spark, g):
    path = readers.shared_folder(spark, "closure")
    g.tables["closure"].write.option("sep", "\t").csv(path)
    return sorted_closure(readers.read_closure(spark, path))


def sssom_files_scan(spark, g):
    """One file for each mapping source; their names become ``mapping_source``."""
    folder, paths = readers.shared_folder(spark, "sssom"), []
    for source in ("m1", "m2", "m3"):
        paths.append(f"{folder}/{source}.sssom.tsv")
        sinks.write(g.tables["mappings"].where(F.col("mapping_source") == source).drop("mapping_source"), paths[-1], "tsv")
    return readers.read_mappings(spark, paths).select("subject_id", "predicate_id", "object_id", "mapping_source")


def _as_documents(lines: DataFrame, spark: SparkSession, label: str, before: str, between: str, after: str, each: int = 2000) -> str:
    """A folder of documents of about ``each`` lines, one a file, written by all tasks."""

    def run(batches):
        import pandas as pd

        found = [x for batch in batches for x in batch["line"]]
        yield pd.DataFrame({"value": [before + between.join(found) + after]})

    path = readers.shared_folder(spark, label)
    parts = max(1, -(-lines.count() // each))
    lines.repartition(parts).mapInPandas(run, "value string").write.text(path)
    return path


def json_file_scan(spark, g):
    """All nodes in documents with their records below two keys."""
    lines = g.nodes.select(F.to_json(F.struct("id", "name"), {"ignoreNullFields": "false"}).alias("line"))
    path = _as_documents(lines, spark, "json", '{"data": {"items": [', ", ", "]}}")
    return readers.read_json(spark, path, ["data", "items"]).select("id", "name")


def yaml_file_scan(spark, g):
    """All nodes in YAML documents; the names are quoted, as YAML reads JSON's strings."""
    lines = g.nodes.select(F.concat(F.lit("- "), F.to_json(F.struct("id", "name"), {"ignoreNullFields": "false"})).alias("line"))
    return readers.read_yaml(spark, _as_documents(lines, spark, "yaml", "", "\n", "\n")).select("id", "name")


def csv_quoted_breaks(spark, g):
    """Cells with line breaks, delimiters and quotes, in few large files that Spark splits.

    The text is many times the tables, so it is written, read and removed in turns, each of the edges with some hashes; what was read is kept.
    """
    note = F.concat(F.lit('say ""'), F.col("id"), F.lit('"",\n# no comment,\n'), F.repeat(F.coalesce("object", F.lit("none")), 12), F.lit("\n\n"), "predicate")
    line = F.concat(F.col("id"), F.lit(',"'), note, F.lit('",'), F.coalesce(F.col("score").cast("string"), F.lit("")))
    size = g.edges.agg(F.sum(F.octet_length(line))).first()[0] or 0
    turns = max(1, min(TURNS, -(-size // TURN)))
    form, kept = delimited.CsvFormat(",", "none", ("id", "note", "score"), {"score": "float"}), []
    for k in range(turns):
        path = readers.shared_folder(spark, "csv")
        kept.append(readers.shared_folder(spark, "read"))
        try:
            g.edges.where(F.pmod(F.xxhash64("id"), F.lit(turns)) == k).select(line.alias("line")).coalesce(FILES).write.text(path)
            read = delimited.read_csv(spark, [path], form).select("id", F.length("note").alias("n_chars"), F.md5("note").alias("note_md5"), "score")
            sinks.write(read, kept[-1], "parquet", compression="zstd")
        finally:
            fs.remove(spark, path)
    return spark.read.schema(read.schema).parquet(*kept)


def archive_members_scan(spark, g):
    """Nodes zipped and edges tarred, a member for each source, by tasks; the ingest's configuration chooses the members."""
    folder, frames = readers.shared_folder(spark, "archives"), []
    for table, ending, columns in ((g.nodes, ".zip", ["id", "name"]), (g.edges, ".tar", ["id", "object"])):
        cells = F.concat_ws("\t", *[F.coalesce(F.regexp_replace(c, "[\t\n\"]", " "), F.lit("")) for c in columns])
        lines = table.select(F.concat(F.col("file_source"), F.lit(".tsv")).alias("member"), cells.alias("value"))
        for archive in sinks.write_archives(lines.repartition(4, "member"), f"{folder}/{columns[1]}", ending, "\t".join(columns)):
            wanted = [m for m in archives.members_of(archive) if m not in ("nation.tsv", "orders.tsv")]
            if wanted:
                read = runner.read_source(spark, {"file_archive": archive, "files": wanted, "comment_char": None})
                frames.append(read.select("id", F.nullif(F.col(columns[1]), F.lit("")).alias("value")))
    return reduce(DataFrame.unionByName, frames)


def first_rows_in_file_order(spark, g):
    """Customers' edges, then orders' in files in the order of their ids; a limit that ends among the orders."""
    files = []
    for source in ("customer", "orders"):
        files.append(readers.shared_folder(spark, source))
        g.edges.where(F.col("file_source") == source).select("id", "score").orderBy("id").write.json(files[-1])
    n = spark.read.json(files[0]).count() + 100
    return runner.read_source(spark, {"files": files, "format": "jsonl", "limit": n}).select("id", "score")


def ingest_running_totals(spark, g):
    """Totals by type of event, gathered over the records of a run, become nodes at its end."""
    source = _put(g.edges.where("file_source = 'events'").select("id", "object", "score"), spark, "events", "jsonl")

    def together(a, b):
        return {k: [x + y for x, y in zip(a.get(k, [0, 0]), b.get(k, [0, 0]), strict=True)] for k in {**a, **b}}

    @runner.state("totals", dict, together)
    def add(value, record):
        return together(value, {record["object"]: [1, round(record["score"] * 100)]})

    @runner.transform_record
    def made(record):
        return [{"subject": record["id"], "predicate": "of_type", "object": record["object"]}]

    @runner.on_data_end
    def ended(context):
        return [{"id": k, "name": f"{n} events", "cents": cents} for k, (n, cents) in context.state["totals"].items()]

    config = {"name": "events", "reader": {"files": [source], "format": "jsonl"}}
    graph = runner.run(spark, config, SimpleNamespace(add=add, made=made, ended=ended))[None]
    return graph.nodes.select("id", "name", "cents")


def counts_while_writing(spark, g):
    """Rows that lose values of a column that keeps one, malformed mappings and long rows, each counted in the pass that writes.
    The edges' JSON is many times their tables, so it is compressed."""
    edges = _put(split_lists(g.edges.drop("file_source"), ["publications"]), spark, "edges", "jsonl", "gzip")
    loaded = readers.load_graph(spark, [FileSpec(edges, "jsonl", "edges", "e")], single=["publications"])
    sssom = f"{readers.shared_folder(spark, 'sssom')}.tsv"
    cells = F.concat_ws("\t", "subject_id", "predicate_id", "object_id")
    odd = F.col("subject_id").startswith("PARTZ")
    lines = g.tables["mappings"].select(F.when(odd, F.concat(cells, F.lit("\tmore"))).otherwise(cells).alias("value"))
    lines.mapInPandas(_with_header("subject_id\tpredicate_id\tobject_id"), "value string").write.text(sssom)
    seen, long = Observation(), Observation()
    mappings = readers.read_mappings(spark, [sssom], seen)
    csv = readers.shared_folder(spark, "csv")
    g.nodes.select(F.concat_ws(",", "id", F.coalesce("in_taxon", F.lit("")), F.when(F.col("category") == "Part", "x")).alias("value")).write.text(csv)
    nodes = delimited.read_csv(spark, [csv], delimited.CsvFormat(",", "none", ("id", "in_taxon"), comment=None), observation=long)
    GraphStore(spark, readers.shared_folder(spark, "store"), buckets=8).save(Graph(nodes, loaded.graph.edges, {"mappings": mappings}))
    counts = {"losing publications": loaded.losing[edges].get["publications"], **{f"mappings {k}": v for k, v in seen.get.items()}, **{f"nodes {k}": v for k, v in long.get.items()}}
    return spark.createDataFrame(list(counts.items()), "what string, n long")


def _with_header(header: str):
    def run(batches):
        import pandas as pd

        first = True
        for batch in batches:
            yield pd.concat([pd.DataFrame({"value": [header]}), batch]) if first else batch
            first = False
        if first:
            yield pd.DataFrame({"value": [header]})

    return run


def required_properties_scan(spark, g):
    return readers.require_paths(g.edges.select("id", "predicate"), ["id", "predicate"])


def ingest_whole_source(spark, g):
    """Orders from a JSONL file become edges; a lookup of mappings and the writer's header are in the configuration."""
    mappings = _put(g.tables["mappings"], spark, "mappings", "jsonl")
    source = _put(g.edges.where("file_source = 'lineitem'"), spark, "lines", "jsonl")
    out = readers.shared_folder(spark, "out")

    @runner.transform
    def made(df, context):
        renamed = context.lookup(df, "object", ["parts"], "subject_id", "object_id")
        return runner.Graph(None, renamed.select("id", "subject", "predicate", F.col("object_id").alias("object"), "provided_by"))

    config = {
        "name": "lines",
        "reader": {"files": [source], "format": "jsonl", "filters": [{"column": "score", "filter_code": "ge", "value": 10}]},
        "mappings": {"parts": {"reader": {"files": [mappings], "format": "jsonl"}, "key": "object_id", "values": ["subject_id"]}},
        "writer": {"format": "jsonl", "edge_properties": ["id", "subject", "predicate", "object", "provided_by", "absent"], "min_edge_count": 1},
    }
    runner.run(spark, config, SimpleNamespace(made=made), out)
    return spark.read.schema("id string, subject string, predicate string, object string, absent string").json(f"{out}/lines_edges.jsonl")


def ingest_records(spark, g):
    """Row-at-a-time: each node becomes a node and an edge; the edges' ends are mapped when they are written."""
    source = _put(g.nodes, spark, "parts", "jsonl")
    sssom = f"{readers.shared_folder(spark, 'sssom')}.tsv"
    sinks.write(g.tables["mappings"].drop("mapping_source"), sssom, "tsv")
    out = readers.shared_folder(spark, "out")

    @runner.transform_record
    def made(record):
        return [{"id": record["id"], "name": record.get("name")}, {"subject": record["id"], "predicate": "is_a", "object": "THING:" + (record.get("category") or "")}]

    config = {"name": "parts", "reader": {"files": [source], "format": "jsonl"}, "writer": {"format": "jsonl", "sssom": {"files": [sssom], "subject_target_prefixes": ["PARTX"]}}}
    runner.run(spark, config, SimpleNamespace(made=made), out)
    return spark.read.schema("subject string, predicate string, object string, original_subject string").json(f"{out}/parts_edges.jsonl")


def export_load_back(spark, g):
    """An export of both tables as TSV, loaded again as a graph."""
    files = sinks.export_graph(Graph(g.nodes.drop("file_source"), split_lists(g.edges.drop("file_source"), ["publications"])), readers.shared_folder(spark, "export"), "g", "tsv")
    back = readers.load_graph(spark, files).graph
    nodes = back.nodes.select("id", F.col("name").alias("label"), F.lit(None).cast("array<string>").alias("publications"), "file_source")
    return nodes.unionByName(back.edges.select("id", F.col("predicate").alias("label"), "publications", "file_source"))


def split_load_back(spark, g):
    """Files split by category and source, read again, with the file that each row came from."""
    folder = readers.shared_folder(spark, "split")
    made = sinks.split_files(g.nodes, folder, ["category", "provided_by"], "n", "_nodes", "jsonl")
    parts = [spark.read.schema("id string, category string").json(p).withColumn("part", F.lit(k)) for k, p in sorted(made.items())]
    return reduce(DataFrame.unionByName, parts)


def store_load_back(spark, g):
    """Two versions of a stored graph; the second drops a table's rows, and is what a reader sees."""
    path = readers.shared_folder(spark, "store")
    GraphStore(spark, path, buckets=8).save(Graph(g.nodes, g.edges))
    store = GraphStore(spark, path)
    store.save(Graph(store.table("nodes").where("category = 'Part'"), store.table("edges")))
    store.vacuum()
    graph = GraphStore(spark, path, "r").graph()
    return graph.nodes.select("id", "file_source").unionByName(graph.edges.select("id", "file_source"))


def append_new_only(spark, g):
    """Events are appended to the stored lines, then again with changed rows of both: what is stored already is left out."""
    store = GraphStore(spark, readers.shared_folder(spark, "store"), buckets=8)
    store.put("edges", g.edges.where("file_source = 'lineitem'"))
    events = g.edges.where("file_source = 'events'")
    store.append("edges", events, unique=True)
    again = events.unionByName(g.edges.where("file_source in ('lineitem', 'customer')")).withColumns({"predicate": F.lit("changed"), "batch": F.lit(2)})
    store.append("edges", again, unique=True)
    return store.table("edges").select("id", "predicate", "file_source", "batch")


def estimates_from_sketches(spark, g):
    """Distinct values and quantiles of edges that came in four segments, from sketches alone, against the exact ones."""
    store = GraphStore(spark, readers.shared_folder(spark, "store"), buckets=8)
    store.put("edges", g.edges.where("file_source = 'lineitem'"))
    store.sketch("edges")
    for source in ("customer", "orders", "events"):
        store.append("edges", g.edges.where(F.col("file_source") == source))
        store.sketch("edges")
    found, edges = {r["column"]: r for r in store.estimates("edges").collect()}, store.table("edges")  # a row a column
    checks = []
    for c, r in found.items():
        near = F.abs(F.count_distinct(c) - r["distinct"]) <= F.lit(1) + 0.04 * F.count_distinct(c)
        ranks = F.lit(True)
        for p, q in zip((0.25, 0.5, 0.75), r["quantiles"] or (), strict=False):
            ranks = ranks & (F.count_if(F.col(c) < q) <= (p + 0.015) * F.count(c)) & (F.count_if(F.col(c) <= q) >= (p - 0.015) * F.count(c))
        checks.append(F.struct(F.lit(c).alias("column_name"), F.lit(r["n"]).alias("n"), near.alias("distinct_near"), ranks.alias("quantiles_near"), F.lit(r["quantiles"] is not None).alias("is_number")))
    return edges.agg(F.array(*checks).alias("x")).select(F.inline("x"))


def _laid_out(spark, g) -> GraphStore:
    store = GraphStore(spark, readers.shared_folder(spark, "store"), buckets=8)
    store.save(Graph(g.nodes, g.edges))
    operations.lay_out(spark, store.path)
    return GraphStore(spark, store.path, "r")


def stored_dangling_edges(spark, g):
    return operations.stored_dangling(_laid_out(spark, g)).select("id", "subject", "predicate", "object")


def stored_singleton_nodes(spark, g):
    return operations.stored_singletons(_laid_out(spark, g)).select("id", "category")


def stored_named_edges(spark, g):
    return operations.stored_named_edges(_laid_out(spark, g), "object").select("id", "object", "object_category", "object_name")


def components_over_appends(spark, g):
    """Components of the lines, brought up to date with customers, orders and events."""
    store = GraphStore(spark, readers.shared_folder(spark, "store"), buckets=8)
    kept = g.edges
    components_update.start(store, kept.where("file_source = 'lineitem'"))
    for source in ("customer", "orders", "events"):
        components_update.add_edges(store, kept.where(F.col("file_source") == source))
    return components_update.components(store)


def schema_of_tables(spark, g):
    return schema_report({"nodes": g.nodes, "edges": g.edges})


_TYPES = {"id": "string", "subject": "string", "predicate": "string", "object": "string", "category": "string", "knowledge_level": "string", "agent_type": "string", "negated": "boolean", "score": "double", "publications": "string", "provided_by": "string", "file_source": "string"}
_NODES = ("id", "category", "name", "in_taxon", "provided_by", "file_source")
_SCHEMA = " union all ".join(
    f"select '{t}' as table_name, '{c}' as column_name, '{kind}' as data_type, count(*) as n_rows, count({c}) as n_values from {t}" for t, cols in (("nodes", dict.fromkeys(_NODES, "string")), ("edges", _TYPES)) for c, kind in cols.items()
)
_BOTH = "both_ways as (select subject_id as f, object_id as t from mappings where predicate_id = 'skos:exactMatch' union all select object_id, subject_id from mappings where predicate_id = 'skos:exactMatch')"


def _labels_sql(rounds: int = 12) -> str:
    """The least id reached, by rounds of least labels of neighbours and then of their labels."""
    steps = ", ".join(
        f"n{k} as materialized (select v as id, min(r) as r from both_ways join l{k} on l{k}.id = u group by 1), l{k + 1} as materialized (select l{k}.id, least(l{k}.r, n{k}.r, j.r) as r from l{k} join n{k} using (id) join l{k} as j on j.id = least(l{k}.r, n{k}.r))"
        for k in range(rounds)
    )
    return f"""with both_ways as materialized (select subject as u, object as v from edges where subject is not null and object is not null union select object, subject from edges where subject is not null and object is not null),
l0 as materialized (select distinct u as id, u as r from both_ways), {steps} select id, r as component from l{rounds}"""


QUERIES = {
    tsv_file_scan: f"select id, subject, object, case when len({_PUBS}) > 0 then array_to_string({_PUBS}, '|') end as publications, cast(negated as varchar) as negated from edges",
    jsonl_file_scan: f"select id, predicate, {_PUBS} as publications, score from edges",
    jsonl_slots_scan: "select id, name from nodes",
    parquet_file_load: "select id, 'n_src' as provided_by, 'n_src' as file_source from nodes union all select id, 'e_src', 'e_src' from edges",
    csv_file_scan: "select id, predicate, score from edges",
    closure_file_scan: "select subject_id, predicate_id, object_id from closure",
    sssom_files_scan: "select subject_id, predicate_id, object_id, mapping_source || '.sssom.tsv' as mapping_source from mappings",
    json_file_scan: "select id, name from nodes",
    yaml_file_scan: "select id, name from nodes",
    csv_quoted_breaks: """select id, length(note) as n_chars, md5(note) as note_md5, score from
(select *, 'say "' || id || '",' || chr(10) || '# no comment,' || chr(10) || repeat(coalesce(object, 'none'), 12) || chr(10) || chr(10) || predicate as note from edges)""",
    archive_members_scan: "select id, name as value from nodes where file_source <> 'nation' union all select id, object from edges where file_source <> 'orders'",
    first_rows_in_file_order: "select id, score from edges where file_source = 'customer' union all (select id, score from edges where file_source = 'orders' order by id limit 100)",
    ingest_running_totals: "select object as id, count(*) || ' events' as name, sum(cast(round(score * 100) as bigint))::bigint as cents from edges where file_source = 'events' group by object",
    counts_while_writing: f"""select 'losing publications' as what, count(*) filter (where len({_PUBS}) > 1) as n from edges
union all select 'mappings rows', count(*) filter (where subject_id not like 'PARTZ%') from mappings union all select 'mappings malformed', count(*) filter (where subject_id like 'PARTZ%') from mappings
union all select 'nodes rows', count(*) from nodes union all select 'nodes long_rows', count(*) filter (where category = 'Part') from nodes""",
    required_properties_scan: "select id, predicate from edges",
    ingest_whole_source: """with m as (select object_id as key, max(subject_id) as value from mappings group by 1)
select e.id, e.subject, e.predicate, coalesce(m.value, e.object) as object, cast(null as varchar) as absent from edges e left join m on e.object = m.key where file_source = 'lineitem' and score >= 10""",
    ingest_records: f"""with {_BOTH}, x as (select f, min(t) as t from both_ways where t like 'PARTX:%' group by 1)
select coalesce(x.t, n.id) as subject, 'is_a' as predicate, 'THING:' || coalesce(n.category, '') as object, case when x.t is not null then n.id end as original_subject from nodes n left join x on n.id = x.f""",
    export_load_back: f"select id, name as label, null::varchar[] as publications, 'g_nodes' as file_source from nodes union all select id, predicate, case when len({_PUBS}) > 0 then {_PUBS} end, 'g_edges' from edges",
    split_load_back: "select id, category, coalesce(category, 'null') || '|' || coalesce(provided_by, 'null') as part from nodes",
    store_load_back: "select id, file_source from nodes where category = 'Part' union all select id, file_source from edges",
    append_new_only: """select distinct id, predicate, file_source, cast(null as integer) as batch from edges where file_source in ('lineitem', 'events')
union all select id, 'changed', file_source, 2 from edges where file_source = 'customer'""",
    estimates_from_sketches: " union all ".join(f"select '{c}' as column_name, count({c}) as n, true as distinct_near, true as quantiles_near, {str(kind == 'double').lower()} as is_number from edges" for c, kind in _TYPES.items()),
    stored_dangling_edges: "select id, subject, predicate, object from edges where subject is null or object is null or subject not in (select id from nodes) or object not in (select id from nodes)",
    stored_singleton_nodes: "select id, category from nodes where id not in (select subject from edges where subject is not null) and id not in (select object from edges)",
    stored_named_edges: """with kept as (select * from (select *, row_number() over (partition by id order by file_source nulls last) as rn from nodes) where rn = 1)
select e.id, e.object, k.category as object_category, k.name as object_name from edges e left join kept k on e.object = k.id""",
    components_over_appends: _labels_sql(),
    schema_of_tables: _SCHEMA,
}


def queries():
    return {f.__name__: (lambda spark, sf_dir, f=f: f(spark, fixture.graph(spark, sf_dir))) for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: fixture.with_views(sql) for f, sql in QUERIES.items()}
