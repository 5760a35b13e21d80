"""The property graph that the registered queries run on, derived from the relational tables.

Each table is one SQL text, run by Spark over DataFrames and, as a common table
expression, by DuckDB. It has duplicate nodes and edges, dangling edges, nulls,
one-to-many mappings and multivalued cells, so every operator has work to do.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: The columns that the views name; with these given, no job is needed to read the files' schemas.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string",
    "events": "event_id long, user_id long, event_type string, value double",
    "documents": "doc_id long, lang string, source string",
}
TABLES = tuple(COLUMNS)
_S = "varchar(400)"

NODES = f"""
select 'CUST:' || cast(c_custkey as {_S}) as id, 'Customer' as category, c_name as name, c_mktsegment as in_taxon, 'infores:crm' as provided_by, 'customer' as file_source from customer
union all select 'SUPP:' || cast(s_suppkey as {_S}), 'Supplier', s_name, cast(null as {_S}), 'infores:erp', 'supplier' from supplier where s_suppkey % 7 <> 0
union all select 'PART:' || cast(p_partkey as {_S}), case when p_partkey % 50 = 0 then null else 'Part' end, case when p_partkey % 40 = 0 then 'obsolete ' || p_name else p_name end, p_brand, 'infores:pim', 'part' from part
union all select 'PART:' || cast(p_partkey as {_S}), 'Part', p_name, p_type, 'infores:pim', 'part_b' from part where p_partkey % 10 = 0
union all select 'NATION:' || cast(n_nationkey as {_S}), 'Nation', n_name, cast(null as {_S}), 'infores:geo', 'nation' from nation
union all select 'REGION:' || cast(r_regionkey as {_S}), 'Region', r_name, cast(null as {_S}), 'infores:geo', 'region' from region
union all select 'DOC:' || cast(doc_id as {_S}), 'Document', cast(null as {_S}), lang, source, 'documents' from documents
"""

_NO = f"cast(null as {_S})"
EDGES = f"""
select 'L:' || cast(l_orderkey as {_S}) || '-' || cast(l_linenumber as {_S}) as id, 'SUPP:' || cast(l_suppkey as {_S}) as subject, 'supplies' as predicate, 'PART:' || cast(l_partkey as {_S}) as object,
  'SupplyAssociation' as category, l_returnflag as knowledge_level, l_linestatus as agent_type, l_returnflag = 'R' as negated, l_quantity as score, 'PMID:' || cast(l_partkey % 5 as {_S}) || '|PMID:' || cast(l_suppkey % 3 as {_S}) as publications,
  'infores:' || lower(l_linestatus) as provided_by, 'lineitem' as file_source from lineitem
union all select 'C:' || cast(c_custkey as {_S}), 'CUST:' || cast(c_custkey as {_S}), 'located_in', 'NATION:' || cast(c_nationkey as {_S}), 'LocationAssociation', {_NO}, 'manual', cast(null as boolean), c_acctbal, ' ', 'infores:crm', 'customer' from customer
union all select 'O:' || cast(o_orderkey as {_S}), 'ORDER:' || cast(o_orderkey as {_S}), 'placed_by', 'CUST:' || cast(o_custkey as {_S}), 'OrderAssociation', o_orderstatus, o_orderpriority, false, o_totalprice, {_NO}, 'infores:sales', 'orders' from orders
union all select 'E:' || cast(event_id as {_S}), case when event_id % 97 = 0 then null else 'USER:' || cast(user_id as {_S}) end, 'performed', 'EVENT:' || event_type, 'EventAssociation', {_NO}, event_type, false, value, '||', {_NO}, 'events' from events
"""

CLOSURE = f"""
select 'NATION:' || cast(n_nationkey as {_S}) as subject_id, 'part_of' as predicate_id, 'NATION:' || cast(n_nationkey as {_S}) as object_id from nation
union all select 'NATION:' || cast(n_nationkey as {_S}), 'part_of', 'REGION:' || cast(n_regionkey as {_S}) from nation
union all select 'NATION:' || cast(n_nationkey as {_S}), 'part_of', 'WORLD:0' from nation
union all select 'REGION:' || cast(r_regionkey as {_S}), 'part_of', 'REGION:' || cast(r_regionkey as {_S}) from region
union all select 'REGION:' || cast(r_regionkey as {_S}), 'part_of', 'WORLD:0' from region
union all select 'WORLD:0', 'part_of', 'WORLD:0' from region where r_regionkey = 0
union all select 'NATION:' || cast(n_nationkey as {_S}), 'near', 'REGION:' || cast((n_regionkey + 1) % 5 as {_S}) from nation
"""

MAPPINGS = f"""
select 'PARTX:' || cast(p_partkey as {_S}) as subject_id, 'skos:exactMatch' as predicate_id, 'PART:' || cast(p_partkey as {_S}) as object_id, 'm1' as mapping_source from part where p_partkey % 5 = 0
union all select 'PARTY:' || cast(p_partkey as {_S}), 'skos:exactMatch', 'PART:' || cast(p_partkey as {_S}), 'm2' from part where p_partkey % 15 = 0
union all select 'PARTZ:' || cast(p_partkey as {_S}), 'skos:broadMatch', 'PART:' || cast(p_partkey as {_S}), 'm3' from part where p_partkey % 11 = 0
union all select 'SUPP:' || cast(s_suppkey as {_S}), 'skos:exactMatch', 'SUPP:' || cast(s_suppkey as {_S}), 'm1' from supplier where s_suppkey % 3 = 0
"""

VIEWS = {"nodes": NODES, "edges": EDGES, "closure": CLOSURE, "mappings": MAPPINGS}


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the tables; a table is read only if the text names it."""
    words = set(sql.replace("\n", " ").replace("(", " ").replace(")", " ").split())
    frames = {t: spark.read.schema(COLUMNS[t]).parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in words}
    for t in frames:
        sql = sql.replace(f"from {t} ", f"from {{{t}}} ").replace(f"from {t}\n", f"from {{{t}}}\n").replace(f"join {t} ", f"join {{{t}}} ")
    return spark.sql(sql, **frames)


class FixtureGraph:
    """The graph of a data folder; each table is planned when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    @cached_property
    def nodes(self) -> DataFrame:
        return relation(self._spark, self._dir, NODES)

    @cached_property
    def edges(self) -> DataFrame:
        return relation(self._spark, self._dir, EDGES)

    @property
    def tables(self) -> FixtureGraph:
        return self

    def __getitem__(self, name: str) -> DataFrame:
        return relation(self._spark, self._dir, VIEWS[name])


def graph(spark: SparkSession, sf_dir: str) -> FixtureGraph:
    return FixtureGraph(spark, sf_dir)


def with_views(sql: str) -> str:
    """``sql`` with the graph's tables as common table expressions, for DuckDB."""
    used = {n: t for n, t in VIEWS.items() if n in sql}
    views = ", ".join(f"{n} as ({t.strip()})" for n, t in used.items())
    body = sql.strip()
    return f"with {views}, {body[5:].strip()}" if body.lower().startswith("with ") else f"with {views} {body}"
