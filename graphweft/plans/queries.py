"""Queries over the graph operators, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.filters import RowFilter, filtered
from ..model import Graph
from ..operators import closure as cl
from ..operators import connectivity as cc
from ..operators import integrity as it
from ..operators import lookup as lk
from ..operators import modelcheck as mc
from ..operators import profile as pf
from ..operators import reports as rp
from ..operators.catalogue import Catalogue
from . import files, fixture

Query = Callable[[Graph], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


NODE_COLS = ["id", "category", "name", "in_taxon", "provided_by", "file_source"]
EDGE_COLS = ["id", "subject", "predicate", "object", "category", "provided_by", "file_source"]
_DEDUPED = "kept as (select * from (select *, row_number() over (partition by id order by file_source nulls last) as rn from nodes) where rn = 1 or id is null)"


def _n(g: Graph) -> DataFrame:
    return it.deduplicate(g.nodes)[0]


# --- union, lists, required fields -------------------------------------------------


@query("select id, name, category, subject, object from (select id, name, category, null as subject, null as object from nodes union all select id, null, category, subject, object from edges)")
def union_by_name(g):
    return it.union_by_name([g.nodes.select("id", "name", "category"), g.edges.select("id", "category", "subject", "object")])


@query("select id, category, cast(null as varchar) as old from nodes where file_source = 'part' union all select id, category, name from nodes where file_source = 'part_b'")
def append_schema_evolution(g):
    old = g.nodes.where("file_source = 'part'").select("id", "category")
    new = g.nodes.where("file_source = 'part_b'").select("id", "category", F.col("name").alias("old"))
    return it.append(old, [new])[0]


@query("""with pairs as (select distinct subject, predicate, object from edges where file_source in ('lineitem', 'events'))
select subject, predicate, object from pairs""")
def append_distinct_on_triple(g):
    cols = ["subject", "predicate", "object", "file_source"]
    old, new = g.edges.where("file_source = 'lineitem'").select(cols), g.edges.where("file_source = 'events'").select(cols)
    return it.append(old, [new], deduplicated=True)[0].select("subject", "predicate", "object")


@query("""select id, predicate, case when trim(publications) = '' then null else list_filter(string_split(trim(publications), '|'), lambda x: trim(x) <> '') end as publications from edges""")
def multivalued_split(g):
    return it.split_lists(g.edges, ["publications"]).select("id", "predicate", "publications")


@query("""select id, predicate, case when trim(publications) = '' then null else list_filter(string_split(trim(publications), '|'), lambda x: trim(x) <> '')[1] end as publications from edges""")
def force_single_valued(g):
    return it.split_lists(g.edges, ["publications"], single=["publications"]).select("id", "predicate", "publications")


@query("""select 'subject' as field, count(*) filter (where subject is null or trim(subject) = '') as missing, count(*) as total from edges
union all select 'publications', count(*) filter (where publications is null or trim(publications) = ''), count(*) from edges
union all select 'absent', count(*), count(*) from edges""")
def required_fields_violations(g):
    return it.missing_required(g.edges, ["subject", "publications", "absent"])


@query("select id, 'loaded' as provided_by, 'file_a' as file_source from nodes")
def provenance_injection(g):
    return it.with_provenance(g.nodes, "file_a", "loaded").select("id", "provided_by", "file_source")


# --- row filters -----------------------------------------------------------------------


@query("select id, score from edges where score > 20 and score <= 40 and predicate = 'supplies'")
def row_filter_include(g):
    return filtered(g.edges, [RowFilter("score", "gt", 20.0), RowFilter("score", "le", 40.0), RowFilter("predicate", "eq", "supplies")]).select("id", "score")


@query("select id, knowledge_level from edges where knowledge_level is not null and knowledge_level <> 'R'")
def row_filter_exclude_nulls(g):
    return filtered(g.edges, [RowFilter("knowledge_level", "in_exact", ["R"], include=False)]).select("id", "knowledge_level")


@query("select id, name from nodes where name is not null and (contains(name, '1') or contains(name, 'obsolete'))")
def row_filter_in_substring(g):
    return filtered(g.nodes, [RowFilter("name", "in", ["1", "obsolete"])]).select("id", "name")


# --- integrity ---------------------------------------------------------------------------


@query(f"with {_DEDUPED} select {', '.join(NODE_COLS)} from kept")
def dedup_nodes(g):
    return _n(g).select(NODE_COLS)


@query(f"select {', '.join(NODE_COLS)} from nodes where id in (select id from nodes group by id having count(*) > 1)")
def duplicate_nodes_archive(g):
    return it.deduplicate(g.nodes)[1].select(NODE_COLS)


_FIRST = "first as (select * from (select *, row_number() over (partition by id order by file_source nulls last, agent_type nulls last, category nulls last, knowledge_level nulls last, negated nulls last, object nulls last, predicate nulls last, provided_by nulls last, publications nulls last, score nulls last, subject nulls last) as rn from edges) where rn = 1 or id is null)"


@query(f"with {_FIRST} select id, subject, predicate, object, category, knowledge_level, agent_type, negated, score, publications, provided_by, file_source from first")
def dedup_edges(g):
    return it.deduplicate(g.edges)[0]


@query("select id, predicate, subject, object from edges where id in (select id from edges group by id having count(*) > 1)")
def duplicate_edges_archive(g):
    return it.deduplicate(g.edges)[1].select("id", "predicate", "subject", "object")


_ONE = "one as (select * from (select *, row_number() over (partition by object_id order by mapping_source nulls last, subject_id nulls last) as rn from mappings) where rn = 1)"


@query(f"with {_ONE} select subject_id, predicate_id, object_id, mapping_source from one")
def mapping_dedup(g):
    return it.one_mapping_each(g.tables["mappings"])


@query(f"""with {_ONE} select e.id, coalesce(s.subject_id, e.subject) as subject, coalesce(o.subject_id, e.object) as object,
case when s.subject_id <> e.subject then e.subject end as original_subject, case when o.subject_id <> e.object then e.object end as original_object
from edges e left join one s on e.subject = s.object_id left join one o on e.object = o.object_id""")
def normalize_edges(g):
    return it.normalize_edges(g.edges, g.tables["mappings"]).select("id", "subject", "object", "original_subject", "original_object")


@query(f"""with {_ONE} select count(*) as edges, count(*) filter (where coalesce(s.subject_id <> e.subject, false) or coalesce(o.subject_id <> e.object, false)) as changed,
(select count(*) - count(distinct object_id) from mappings) as duplicate_mappings
from edges e left join one s on e.subject = s.object_id left join one o on e.object = o.object_id""")
def normalize_changed_count(g):
    return it.normalize_counts(g.edges, g.tables["mappings"])


_BAD = "bad as (select * from edges where subject is null or object is null or subject not in (select id from nodes) or object not in (select id from nodes))"


@query(f"with {_BAD} select id, subject, predicate, object from bad")
def dangling_edges(g):
    return it.split_dangling(g.edges, g.nodes)[1].select("id", "subject", "predicate", "object")


@query("select id, subject, predicate, object from edges where subject in (select id from nodes) and object in (select id from nodes)")
def kept_edges(g):
    return it.split_dangling(g.edges, g.nodes)[0].select("id", "subject", "predicate", "object")


@query(f"""with {_BAD}, missing as (select file_source, unnest([subject, object]) as id from bad)
select b.file_source, b.n as dangling_edges, coalesce(m.n, 0) as missing_ids from (select file_source, count(*) as n from bad group by 1) b
left join (select file_source, count(distinct id) as n from missing where id is not null and id not in (select id from nodes) group by 1) m on b.file_source = m.file_source""")
def dangling_by_source(g):
    return it.dangling_counts(g.edges, g.nodes)


@query("select id, category from nodes where id not in (select subject from edges where subject is not null) and id not in (select object from edges)")
def singleton_nodes(g):
    return it.split_singletons(g.nodes, g.edges)[1].select("id", "category")


@query(f"""with {_DEDUPED}, {_ONE}, {_FIRST},
mapped as (select e.predicate, coalesce(s.subject_id, e.subject) as subject, coalesce(o.subject_id, e.object) as object from first e left join one s on e.subject = s.object_id left join one o on e.object = o.object_id)
select predicate, count(*) as edges from mapped where subject in (select id from kept) and object in (select id from kept) group by predicate""")
def merge_pipeline_counts(g):
    merged = it.merge_graph(Graph(g.nodes, g.edges), g.tables["mappings"])
    return merged.edges.groupBy("predicate").agg(F.count(F.lit(1)).alias("edges"))


@query("select category as _category, file_source as _file_source, count(*) as n from nodes group by all")
def split_value_counts(g):
    return it.split_memberships(g.nodes, ["category", "file_source"]).groupBy("_category", "_file_source").agg(F.count(F.lit(1)).alias("n"))


@query("""with p as (select predicate, case when trim(publications) = '' then null else list_distinct(list_filter(string_split(trim(publications), '|'), lambda x: trim(x) <> '')) end as l from edges),
q as (select predicate, unnest(case when l is null or len(l) = 0 then [null] else l end) as v from p)
select v as _publications, predicate as _predicate, count(*) as n from q group by all""")
def split_multivalued_membership(g):
    rows = it.split_lists(g.edges, ["publications"])
    return it.split_memberships(rows, ["publications", "predicate"]).groupBy("_publications", "_predicate").agg(F.count(F.lit(1)).alias("n"))


# --- closure -------------------------------------------------------------------------------


@query("select subject_id as id, list_sort(list(object_id)) as closure from closure group by 1")
def closure_ids(g):
    return cl.closure_ids(g.tables["closure"])


@query("select subject_id as id, list_sort(list(name)) as closure_label from closure join nodes on nodes.id = object_id group by 1")
def closure_labels(g):
    return cl.closure_labels(g.tables["closure"], g.nodes)


@query("""select a.id, a.descendants, b.descendants_label from (select object_id as id, list_sort(list(subject_id)) as descendants from closure group by 1) a
left join (select object_id as id, list_sort(list(name)) as descendants_label from closure join nodes on nodes.id = subject_id group by 1) b on a.id = b.id""")
def descendants(g):
    return cl.descendants(g.tables["closure"], g.nodes)


_PUBS = "case when trim(publications) = '' then null else list_filter(string_split(trim(publications), '|'), lambda x: trim(x) <> '') end"


@query(f"select id, predicate, coalesce(len({_PUBS}), 0) + case when agent_type is null then 0 else 1 end as evidence_count from edges")
def evidence_count(g):
    edges = it.split_lists(g.edges, ["publications"])
    return edges.select("id", "predicate", cl.evidence_count(edges, ["publications", "agent_type", "absent"]).alias("evidence_count"))


@query("select id, concat_ws('|', subject, coalesce(replace(cast(negated as varchar), 'true', 'NOT'), ''), predicate, object, knowledge_level) as grouping_key from edges")
def grouping_key(g):
    return g.edges.select("id", cl.grouping_key(g.edges, ["subject", "negated", "predicate", "object", "knowledge_level"]).alias("grouping_key"))


@query(f"""with {_DEDUPED}, c as (select subject_id as id, list_sort(list(object_id)) as closure from closure group by 1)
select e.id, e.subject, e.predicate, e.object, s.name as subject_label, s.category as subject_category, o.name as object_label, o.category as object_category,
substr(o.id, 1, instr(o.id, ':') - 1) as object_namespace, o.in_taxon as object_taxon, c.closure as object_closure
from edges e left join kept s on e.subject = s.id left join kept o on e.object = o.id left join c on o.id = c.id""")
def denormalized_edges(g):
    wanted = ["id", "subject", "predicate", "object", "subject_label", "subject_category", "object_label", "object_category", "object_namespace", "object_taxon", "object_closure"]
    return cl.denormalized_edges(g.edges, _n(g), g.tables["closure"], wanted=wanted)


@query("""with r as (select row_number() over () as k, id, predicate, list_distinct([subject, object]) as ends from edges),
hits as (select k, n.name from (select k, unnest(ends) as e from r) x join nodes n on x.e = n.id)
select r.id, r.predicate, h.name as ends_label from r left join hits h on r.k = h.k""")
def denormalized_edges_multivalued(g):
    rows = g.edges.select("id", "predicate", F.array("subject", "object").alias("ends"))
    return cl.denormalized_edges(rows, g.nodes, config=cl.Denormalize(fields=(), label_only=("ends",))).select("id", "predicate", "ends_label")


_SIDE = f"""{_DEDUPED}, pairs as (select distinct subject as id, object as o from edges where predicate = 'located_in' and subject is not null and object is not null),
lists as (select p.id, list_sort(list(distinct o)) as has_located_in, case when count(name) > 0 then list_sort(list(distinct name) filter (where name is not null)) end as has_located_in_label, count(distinct o) as has_located_in_count
  from pairs p left join kept n on p.o = n.id group by 1),
up as (select distinct p.id, c.object_id as a from pairs p join closure c on p.o = c.subject_id),
more as (select u.id, list_sort(list(distinct a)) as has_located_in_closure, case when count(name) > 0 then list_sort(list(distinct name) filter (where name is not null)) end as has_located_in_closure_label
  from up u left join kept n on u.a = n.id group by 1)"""


@query(f"with {_SIDE} select l.*, m.has_located_in_closure, m.has_located_in_closure_label from lists l left join more m on l.id = m.id")
def node_predicate_side_table(g):
    return cl.predicate_side_table(g.edges, _n(g), "located_in", g.tables["closure"])


@query(f"""with {_SIDE}, below as (select object_id as id, list_sort(list(subject_id)) as has_descendant, count(*) as n from closure group by 1)
select k.id, k.category, l.has_located_in, coalesce(l.has_located_in_count, 0) as has_located_in_count, b.has_descendant, coalesce(b.n, 0) as has_descendant_count
from kept k left join lists l on k.id = l.id left join below b on k.id = b.id""")
def denormalized_nodes(g):
    full = cl.denormalized_nodes(_n(g), g.edges, ["located_in"], g.tables["closure"])
    return full.select("id", "category", "has_located_in", "has_located_in_count", "has_descendant", "has_descendant_count")


@query("""select object_id as term, -log2(count(distinct subject_id) / cast((select count(distinct object_id) from closure where predicate_id = 'part_of') as double)) + 0.0 as ic
from closure where predicate_id = 'part_of' group by 1""")
def information_content(g):
    return cl.information_content(g.tables["closure"], ["part_of"])


@query("""select e.subject as entity, count(distinct c.object_id) as size from edges e join closure c on e.object = c.subject_id
where c.predicate_id in ('part_of', 'near') and e.category in ('LocationAssociation') and (negated is null or lower(cast(negated as varchar)) = 'false') group by 1""")
def closure_size(g):
    return cl.closure_sizes(g.edges, g.tables["closure"], ["part_of", "near"], categories=["LocationAssociation"])


# --- reports ---------------------------------------------------------------------------------


_DENORM = f"{_DEDUPED}, d as (select e.*, s.category as subject_category, o.category as object_category, substr(s.id, 1, instr(s.id, ':') - 1) as subject_namespace, substr(o.id, 1, instr(o.id, ':') - 1) as object_namespace from edges e left join kept s on e.subject = s.id left join kept o on e.object = o.id)"


@query(f"""with {_DENORM} select subject_category, subject_namespace, predicate, object_category, object_namespace, knowledge_level, agent_type, provided_by, count(*) as count, count(*) / sum(count(*)) over () as proportion from d group by all""")
def edge_report(g):
    return rp.edge_report(g.edges, _n(g))


@query(f"""with {_DENORM}, p as (select *, {_PUBS} as pubs from d), l as (select predicate, unnest(pubs) as x from p)
select p.predicate, count(*) as count, case when count(knowledge_level) > 0 then list_sort(list(distinct knowledge_level) filter (where knowledge_level is not null)) end as knowledge_level_set,
any_value(q.s) as publications_set, count(*) / (select count(*) from d)::double as proportion
from p left join (select predicate, list_sort(list(distinct x)) as s from l group by 1) q on p.predicate = q.predicate group by 1""")
def edge_report_sets(g):
    return rp.edge_report(it.split_lists(g.edges, ["publications"]), _n(g), columns=["predicate"], sets=["knowledge_level", "publications"])


@query("""with q as (select predicate, score, [0.0, 0.25, 0.5, 0.75, 0.9, 1.0] as f from edges)
select predicate, count(*) as count, round(avg(score), 3) as score_avg, list_transform(quantile_cont(score, [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]), lambda x: round(x, 9)) as score_quantiles, count(*) / (select count(*) from edges)::double as proportion
from q where predicate <> '' group by 1""")
def edge_report_percentiles(g):
    return rp.edge_report(g.edges, _n(g), columns=["predicate"], percentiles=["score"])


@query("select category, provided_by, split_part(id, ':', 1) as namespace, in_taxon, count(*) as count from nodes group by all")
def node_report(g):
    return rp.node_report(g.nodes)


@query(f"with {_DEDUPED}, r as (select id, category, name, row_number() over (partition by category order by id nulls last) as n from kept) select id, category, name from r where n <= 5")
def node_examples(g):
    return rp.node_examples(_n(g)).select("id", "category", "name")


@query(f"""with {_DENORM}, r as (select subject, object, predicate, subject_category, object_category, row_number() over (partition by subject_category, predicate, object_category order by subject nulls last, object nulls last) as n from d)
select subject, object, predicate, subject_category, object_category from r where n <= 5""")
def edge_examples(g):
    return rp.edge_examples(g.edges, _n(g)).select("subject", "object", "predicate", "subject_category", "object_category")


@query("select provided_by as source, category as value, count(*) as count from nodes where provided_by is not null group by all")
def qc_nodes_by_source(g):
    return rp.by_source(g.nodes, "nodes")


@query("select provided_by as source, predicate as value, count(*) as count from edges where provided_by is not null group by all")
def qc_edges_by_source(g):
    return rp.by_source(g.edges, "edges")


@query(f"with {_BAD} select provided_by as source, predicate as value, count(*) as count from bad where provided_by is not null group by all")
def qc_dangling_by_source(g):
    return rp.by_source(it.split_dangling(g.edges, g.nodes)[1], "edges")


@query("select provided_by as source, category as value, count(*) as count from nodes where provided_by is not null and id in (select id from nodes group by id having count(*) > 1) group by all")
def qc_duplicate_nodes_by_source(g):
    return rp.by_source(it.deduplicate(g.nodes)[1], "nodes")


@query("""with x as (select provided_by as source, subject as i from edges union all select provided_by, object from edges)
select source, split_part(i, ':', 1) as namespace, count(*) as count from x where source is not null and i is not null group by all""")
def qc_namespaces(g):
    return rp.namespaces_by_source(g.edges, "edges")


@query("select 'nodes' as table_name, count(*) as row_count from nodes union all select 'edges', count(*) from edges union all select 'closure', count(*) from closure")
def qc_totals(g):
    return rp.totals({"nodes": g.nodes, "edges": g.edges, "closure": g.tables["closure"]})


@query("""select 'category' as kind, category as value, provided_by as source, count(*) as count from nodes group by all
union all select 'id_prefix', split_part(id, ':', 1), provided_by, count(*) from nodes group by all""")
def graph_stats_nodes(g):
    return rp.graph_stats(g.nodes, "nodes")


@query("""select 'category' as kind, category as value, provided_by as source, count(*) as count from edges group by all
union all select 'predicate', predicate, provided_by, count(*) from edges group by all""")
def graph_stats_edges(g):
    return rp.graph_stats(g.edges, "edges")


@query("""select 'category' as column_name, count(distinct category) as distinct_values, count(*) as row_count from nodes
union all select 'in_taxon', count(distinct in_taxon), count(*) from nodes union all select 'file_source', count(distinct file_source), count(*) from nodes""")
def profile_cardinality(g):
    return pf.distinct_counts(g.nodes, ["category", "in_taxon", "file_source"])


@query(f"""with c as (select 'predicate' as column_name, predicate as value, count(*) as count from edges group by all
union all select 'publications', x, count(*) from (select unnest({_PUBS}) as x from edges) group by all)
select 'edges' as table_name, column_name, value, count, count / sum(count) over (partition by column_name) as share from c""")
def profile_marginals(g):
    return pf.marginals(it.split_lists(g.edges, ["publications"]), ["predicate", "publications"], "edges")


# --- connectivity ----------------------------------------------------------------------------------


def _component_sql(rounds: int = 12) -> str:
    """Least labels over all edges between nodes: in each round the least of the neighbours' labels, then that label's own label."""
    steps = [
        f"""b{k} as materialized (select id, min(r) as r from (select id, r from l{k} union all select t.u, l.r from twoway t join l{k} l on t.v = l.id) group by id),
l{k + 1} as materialized (select x.id, y.r from b{k} x join b{k} y on x.r = y.id)"""
        for k in range(rounds)
    ]
    return f"""{_DEDUPED}, vertices as materialized (select * from kept where id is not null),
links as materialized (select distinct subject as u, object as v from edges where subject in (select id from vertices) and object in (select id from vertices)),
twoway as materialized (select u, v from links union select v, u from links),
l0 as (select id, id as r from vertices), {", ".join(steps)},
roots as materialized (select id, r as root from l{rounds}),
sizes as materialized (select root, count(*) as component_size from roots group by root),
ranked as materialized (select root, component_size, row_number() over (order by component_size desc, root) - 1 as component_id from sizes),
placed as materialized (select id, component_id, component_size from roots join ranked on roots.root = ranked.root)"""


_CC = _component_sql()
_CC_ROWS = f"""{_CC}, s as (select component_id, max(component_size) as size from placed group by 1),
d as (select component_id, count(*) filter (where coalesce(name like 'obsolete%', false)) as deprecated_count, count(distinct category) as n_categories, count(distinct provided_by) as n_provided_by from placed join vertices on placed.id = vertices.id group by 1),
m as (select component_id, category from (select component_id, category, row_number() over (partition by component_id order by count(*) desc, category) as r from placed join vertices on placed.id = vertices.id where category is not null group by 1, 2) where r = 1),
e as (select component_id, sum(n)::bigint as edge_count, count(*) as source_count from (select component_id, provided_by, predicate, count(*) as n from edges join placed on placed.id = subject where component_size > 1 group by all) group by 1),
x as (select component_id, list_sort(list(id))[1:5] as sample_node_ids from placed group by 1),
rows as (select s.component_id, s.size, d.deprecated_count, m.category as main_category, d.n_categories, d.n_provided_by, x.sample_node_ids, coalesce(e.edge_count, 0)::bigint as edge_count, coalesce(e.source_count, 0)::bigint as source_count,
case when size = (select max(size) from s) then 'LCC' when size >= 100 then '100+' when size >= 10 then '10-99' when size >= 2 then '2-9' else 'Isolated' end as bucket
from s join d on s.component_id = d.component_id join x on s.component_id = x.component_id left join m on s.component_id = m.component_id left join e on s.component_id = e.component_id)"""


@query(f"with {_CC} select id, component_id, component_size from placed")
def connected_components(g):
    return cc.node_components(_n(g), g.edges)


@query(f"with {_CC} select p.id, component_id, component_size, category, name, coalesce(name like 'obsolete%', false) as deprecated from placed p join vertices v on p.id = v.id")
def cc_nodes(g):
    nodes = _n(g)
    return cc.cc_nodes(nodes, cc.node_components(nodes, g.edges)).select("id", "component_id", "component_size", "category", "name", "deprecated")


@query(f"with {_CC} select component_id, provided_by, predicate, count(*) as edge_count from edges join placed on placed.id = subject where component_size > 1 group by all")
def cc_component_sources(g):
    nodes, edges = _n(g), g.edges
    return cc.cc_component_sources(edges, cc.node_components(nodes, edges))


@query(f"with {_CC_ROWS} select * from rows")
def cc_components(g):
    nodes, edges = _n(g), g.edges
    return cc.cc_components(nodes, edges, cc.node_components(nodes, edges))


@query(f"""with {_CC_ROWS} select sum(size)::bigint as nodes, count(*) as components, count(*) filter (where size = 1) as singletons, sum(deprecated_count)::bigint as deprecated,
max(size) as largest, round(max(size) / sum(size), 6) as lcc_fraction from rows""")
def connectivity_summary(g):
    nodes, edges = _n(g), g.edges
    return cc.connectivity_summary(cc.cc_components(nodes, edges, cc.node_components(nodes, edges)))


@query(f"with {_CC_ROWS} select bucket, count(*) as components, sum(size)::bigint as nodes from rows group by 1")
def cc_buckets(g):
    nodes, edges = _n(g), g.edges
    return cc.bucket_distribution(cc.cc_components(nodes, edges, cc.node_components(nodes, edges)))


@query(f"""with {_CC}, big as (select id from placed where component_size >= 3) select e.id, e.subject, e.predicate, e.object from edges e join big on e.subject = big.id where e.object in (select id from vertices)""")
def prune_small_components(g):
    nodes, edges = _n(g), g.edges
    return it.prune_graph(Graph(nodes, edges), min_component=3).edges.select("id", "subject", "predicate", "object")


# --- model check and lookups --------------------------------------------------------------------------


_MODEL = """
classes:
  entity: {}
  thing: {is_a: entity}
  Supplier: {is_a: thing, id_prefixes: [SUPP]}
  Part: {is_a: thing, id_prefixes: [PARTX]}
  Customer: {is_a: thing, id_prefixes: [CUST, C]}
  Nation: {is_a: thing}
  SupplyAssociation: {is_a: entity, slot_usage: {subject: Supplier, predicate: [supplies], object: Part}}
  LocationAssociation: {is_a: entity, slot_usage: {subject: Supplier, predicate: [located_in], object: Nation}}
predicates:
  placed_by: {domain: thing, range: Nation}
"""


@query(f"""with {_DENORM}, t as (select category, subject_category, predicate, object_category, count(*) as count from d where subject_category is not null and object_category is not null group by all)
select ['biolink:' || category] as association, ['biolink:' || subject_category] as subject_categories, 'biolink:' || predicate as predicate, ['biolink:' || object_category] as object_categories, count,
case when category = 'SupplyAssociation' then case when subject_category = 'Supplier' and object_category = 'Part' then 'ok' when subject_category <> 'Supplier' then 'BAD_SUBJECT' else 'BAD_OBJECT' end
  when category = 'LocationAssociation' then case when subject_category <> 'Supplier' then 'BAD_SUBJECT' when object_category <> 'Nation' then 'BAD_OBJECT' else 'ok' end
  when predicate = 'placed_by' and object_category = 'Nation' then 'ok' else 'NOT_IN_LEGAL_TYPES' end as verdict from t""")
def model_check_edges(g):
    return mc.check_edge_types(g.edges, _n(g), Catalogue.load(_MODEL))


@query(f"""with {_DEDUPED}, b as (select id, split_part(id, ':', 1) as prefix, category from kept where (category = 'Supplier' and split_part(id, ':', 1) <> 'SUPP') or (category = 'Part' and split_part(id, ':', 1) <> 'PARTX') or (category = 'Customer' and split_part(id, ':', 1) not in ('CUST', 'C')))
select prefix, ['biolink:' || category] as categories, count(distinct id) as count, list_sort(list(distinct id))[1:5] as examples from b group by prefix, category""")
def model_check_prefixes(g):
    return mc.check_prefixes(_n(g), Catalogue.load(_MODEL))


@query("""with m as (select object_id as key, max(subject_id) as value from mappings group by 1)
select e.id, e.predicate, coalesce(m.value, e.object) as mapped from edges e left join m on e.object = m.key""")
def lookup(g):
    table = lk.mapping_table(g.tables["mappings"], "object_id", "subject_id")
    return lk.looked_up(g.edges, "object", [table], "mapped").select("id", "predicate", "mapped")


@query("""with b as (select subject_id as f, object_id as t from mappings where predicate_id = 'skos:exactMatch' union all select object_id, subject_id from mappings where predicate_id = 'skos:exactMatch'),
x as (select f, min(t) filter (where t like 'PARTY:%') as y, min(t) filter (where t like 'PARTX:%') as x from b group by 1)
select e.id, e.predicate, coalesce(x.y, x.x, e.object) as object, case when coalesce(x.y, x.x) is not null then e.object end as original_object from edges e left join x on e.object = x.f""")
def sssom_on_write(g):
    return lk.mapped_on_write(g.edges, g.tables["mappings"], ["SUPP"], ["PARTY", "PARTX"]).select("id", "predicate", "object", "original_object")


@query(f"select id, predicate, array_to_string({_PUBS}, '|') as publications from edges")
def export_tsv_cells(g):
    edges = it.split_lists(g.edges, ["publications"])
    return edges.select("id", "predicate", C.tsv_cell(edges, "publications").alias("publications"))


@query(f"with {_CC_ROWS} select * from rows where component_id > 0 order by component_id limit 10")
def top_minor_components(g):
    placed = cc.node_components(_n(g), g.edges)
    return cc.top_minor_components(cc.cc_components(_n(g), g.edges, placed))


@query(f"""with {_CC}, c as (select case when component_id = 0 then 'categories inside' else 'categories outside' end as section, category as value, count(*) as count from placed join vertices using (id) where category is not null group by all
union all select 'sources outside', provided_by, count(*) from edges join placed on placed.id = subject where component_size > 1 and component_id <> 0 and provided_by is not null group by all)
select section, value, count from c qualify row_number() over (partition by section order by count desc, value) <= case section when 'sources outside' then 15 else 20 end""")
def connectivity_highlights(g):
    nodes, edges = _n(g), g.edges
    placed = cc.node_components(nodes, edges)
    return cc.connectivity_highlights(cc.cc_nodes(nodes, placed), cc.cc_component_sources(edges, placed))


@query("""with r as (select predicate, agent_type, row_number() over (partition by predicate, agent_type) as k from edges)
select count(distinct case when predicate is not null and agent_type is not null then predicate || '|' || agent_type end) as types_sampled, count(*) as examples from r where k <= 3""")
def example_types_sampled(g):
    by = ["predicate", "agent_type"]
    return rp.types_sampled(rp.first_of_each(g.edges.select("id", *by), by, ["id"], 3), by)


@query("""with l as (select id, ['a', 'b'] as x, case when id like '%1' then ['u'] else ['u', 'v'] end as y from nodes),
made as (select distinct unnest(x) as x, unnest(y) as y from l)
select l.id, m.x, m.y from l join made m on list_contains(l.x, m.x) and list_contains(l.y, m.y)""")
def split_several_lists(g):
    """Lists side by side make the combinations; a shorter one is filled with null, which is no row's own value."""
    lists = g.nodes.select("id", F.array(F.lit("a"), F.lit("b")).alias("x"), F.when(F.col("id").endswith("1"), F.array(F.lit("u"))).otherwise(F.array(F.lit("u"), F.lit("v"))).alias("y"))
    return it.split_memberships(lists, ["x", "y"]).select("id", F.col("_x").alias("x"), F.col("_y").alias("y"))


@query("""select file_source as filename, 'edges' as table_type, 12 as column_count, 'agent_type, category, file_source, id, knowledge_level, negated, object, predicate, provided_by, publications, score, subject' as columns, count(*) as record_count from edges group by 1
union all select file_source, 'nodes', 6, 'category, file_source, id, in_taxon, name, provided_by', count(*) from nodes group by 1""")
def file_schema_report(g):
    both = []
    for table, df in (("nodes", g.nodes), ("edges", g.edges)):
        counts = df.groupBy(F.col("file_source").alias("filename")).agg(F.count(F.lit(1)).alias("record_count"))
        both.append(counts.select("filename", F.lit(table).alias("table_type"), F.explode(F.array(*map(F.lit, df.columns))).alias("column_name"), "record_count"))
    return rp.file_schemas(it.union_by_name(both))


@query("select count(distinct l) as lists, count(distinct subject) as subjects, bool_or(negated) as any_negated, bool_or(score < 0) as any_below from (select *, case when publications like 'PMID%|%' then string_split(publications, '|') end as l from edges) where l is not null")
def distinct_lists(g):
    """Lists are counted as wholes, in their order."""
    rows = g.edges.where(F.col("publications").contains("|") & F.col("publications").startswith("PMID")).withColumn("l", F.split("publications", "\\|"))
    return rows.agg(F.count_distinct("l").alias("lists"), F.count_distinct("subject").alias("subjects"), F.bool_or("negated").alias("any_negated"), F.bool_or(F.col("score") < 0).alias("any_below"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, f=f: f(fixture.graph(spark, sf_dir))) for n, f in _QUERIES.items()} | files.queries()


def oracle_sql() -> dict[str, str]:
    return {n: fixture.with_views(sql) for n, sql in _SQL.items()} | files.oracle_sql()
