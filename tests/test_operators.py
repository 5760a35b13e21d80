import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphweft.functions import columns as C
from graphweft.functions.filters import RowFilter, filtered
from graphweft.model import Graph, infer_file_spec
from graphweft.operators import closure as cl
from graphweft.operators import connectivity as cc
from graphweft.operators import integrity as it
from graphweft.operators import lookup as lk
from graphweft.operators import modelcheck as mc
from graphweft.operators import profile as pf
from graphweft.operators import reports as rp
from graphweft.operators.catalogue import UnknownSlotsError, default_catalogue, ensure_slots, export_schema
from graphweft.plans import queries as plans


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_columns(spark):
    df = spark.createDataFrame([("a|b",), (" ",), ("||",), ("x",), (None,)], "c string")
    got = [r[0] for r in df.select(C.split_multivalued(F.col("c"))).collect()]
    assert got == [["a", "b"], None, [], ["x"], None]
    one = spark.createDataFrame([("HGNC:1",), ("plain",), (None,)], "c string")
    assert [tuple(r) for r in one.select(C.curie_prefix(F.col("c")), C.namespace_of(F.col("c"))).collect()] == [("HGNC", "HGNC"), ("plain", ""), (None, None)]
    assert C.core_first(["z", "_x", "name", "id", "a"], ["id", "name"]) == ["id", "name", "a", "z", "_x"]


def test_filters(spark):
    df = spark.createDataFrame([(1, "llama"), (5, "cat"), (None, "dog"), (9, None)], "b int, c string")
    assert rows(filtered(df, [RowFilter("b", "gt", 3)]), "b") == [(5,), (9,)]
    assert rows(filtered(df, [RowFilter("b", "gt", 3, include=False)]), "b") == [(1,)]
    assert rows(filtered(df, [RowFilter("c", "in", ["lam", "cat"])]), "c") == [("cat",), ("llama",)]
    assert rows(filtered(df, [RowFilter("c", "in_exact", ["lam", "cat"])]), "c") == [("cat",)]
    assert rows(filtered(df, [RowFilter("c", "ne", "cat", include=False)]), "c") == [("cat",)]
    with pytest.raises(ValueError):
        filtered(df, [RowFilter("absent", "eq", 1)])


def test_file_specs():
    s = infer_file_spec("/x/mondo_nodes.tsv.gz")
    assert (s.format, s.table, s.source) == ("tsv", "nodes", "mondo_nodes")
    with pytest.raises(ValueError):
        infer_file_spec("/x/mondo.tsv")


def test_union_reconciles_types(spark):
    a = spark.createDataFrame([("1", "x|y")], "id string, category string")
    b = spark.createDataFrame([("2", ["z"], 3)], "id string, category array<string>, n int")
    got = it.union_by_name([a, b])
    assert rows(got, "id", "category", "n") == [("1", ["x", "y"], None), ("2", ["z"], 3)]


def test_deduplicate(spark):
    df = spark.createDataFrame([("A", "f2"), ("A", "f1"), ("B", "f1"), ("C", "f3"), ("C", "f1"), ("C", None), (None, "f1"), (None, "f1")], "id string, file_source string")
    kept, archive = it.deduplicate(df)
    assert rows(kept, "id", "file_source") == sorted([("A", "f1"), ("B", "f1"), ("C", "f1"), (None, "f1"), (None, "f1")], key=repr)
    assert archive.count() == 5
    again, none = it.deduplicate(kept)
    assert rows(again, "id", "file_source") == rows(kept, "id", "file_source") and none.count() == 0
    no_id = spark.createDataFrame([("a", "b")], "subject string, object string")
    assert it.deduplicate(no_id)[0].count() == 1


def test_normalize_keeps_the_first_original(spark):
    edges = spark.createDataFrame([("FB:1", "p", "X:1", None), ("FB:2", "p", "FB:1", "OLD:2"), ("N:1", "p", "X:2", None)], "subject string, predicate string, object string, original_subject string")
    maps = spark.createDataFrame([("N:1", "FB:1", "m"), ("N:9", "FB:1", "z"), ("N:2", "FB:2", "m")], "subject_id string, object_id string, mapping_source string")
    got = rows(it.normalize_edges(edges, maps), "subject", "object", "original_subject", "original_object")
    assert got == [("N:1", "X:1", "FB:1", None), ("N:1", "X:2", None, None), ("N:2", "N:1", "OLD:2", "FB:1")]
    counts = it.normalize_counts(edges, maps).first()
    assert (counts.edges, counts.changed, counts.duplicate_mappings) == (3, 2, 1)


def test_prune_partitions_edges_exactly(spark):
    nodes = spark.createDataFrame([("A", "n"), ("B", "n"), ("B", "n"), ("S", "n")], "id string, file_source string")
    edges = spark.createDataFrame([("A", "B", "e"), ("A", "Z", "e"), (None, "A", "e"), ("Y", "Z", "f")], "subject string, object string, file_source string")
    kept, bad = it.split_dangling(edges, nodes)
    assert kept.count() == 1 and bad.count() == 3
    assert rows(it.dangling_counts(edges, nodes), "file_source", "dangling_edges", "missing_ids") == [("e", 2, 1), ("f", 1, 2)]
    graph = it.prune_graph(Graph(nodes, edges), remove_singletons=True)
    assert rows(graph.tables["singleton_nodes"], "id") == [("S",)]
    assert it.split_singletons(nodes, None)[1].count() == 4


def test_append_and_split(spark):
    old = spark.createDataFrame([("1", "n")], "id string, name string")
    new = spark.createDataFrame([("1", "n", "d"), ("2", "m", "d")], "id string, name string, description string")
    both, archive = it.append(old, [new], deduplicated=True)
    assert both.count() == 2 and archive.count() == 2 and it.new_columns(old, new) == ["description"]
    lists = spark.createDataFrame([(1, ["a", "b"], "x"), (2, None, "x"), (3, [], None)], "i int, l array<string>, s string")
    assert rows(it.split_memberships(lists, ["l", "s"]), "i", "_l", "_s") == sorted([(1, "a", "x"), (1, "b", "x"), (2, None, "x"), (3, None, None)], key=repr)


def test_information_content(spark):
    closure = spark.createDataFrame([("A", "p", "A"), ("B", "p", "B"), ("B", "p", "A"), ("B", "q", "A"), ("C", "x", "C")], "subject_id string, predicate_id string, object_id string")
    assert rows(cl.information_content(closure, ["p", "q"]), "term", "ic") == [("A", 0.0), ("B", 1.0)]


def test_denormalized_edges_over_lists_and_collisions(spark):
    nodes = spark.createDataFrame([("A", "a", "X"), ("B", "b", "Y")], "id string, name string, category string")
    edges = spark.createDataFrame([("A", ["A", "B", "Q", "A"], None), ("B", None, None)], "subject string, object array<string>, subject_category string")
    got = cl.denormalized_edges(edges, nodes)
    assert got.columns.count("subject_category") == 1
    assert rows(got, "subject", "subject_category", "object_label") == [("A", "X", "a"), ("A", "X", "b"), ("B", "Y", None)]


def test_components(spark):
    nodes = spark.createDataFrame([(x, "obsolete x" if x == "I1" else "n") for x in ["c1", "c2", "c3", "c4", "c5", "t1", "t2", "t3", "I1", "I2"]], "id string, name string")
    edges = spark.createDataFrame([("c1", "c2"), ("c3", "c2"), ("c3", "c4"), ("c5", "c4"), ("t1", "t2"), ("t2", "t3"), ("t3", "t1"), ("c1", "gone")], "subject string, object string")
    placed = cc.node_components(nodes, edges)
    found = cc.cc_components(nodes, edges, placed)
    assert rows(found, "component_id", "size", "bucket") == [(0, 5, "LCC"), (1, 3, "2-9"), (2, 1, "Isolated"), (3, 1, "Isolated")]
    s = cc.connectivity_summary(found).first()
    assert (s.nodes, s.components, s.singletons, s.deprecated, s.lcc_fraction) == (10, 4, 2, 1, 0.5)


def union_find(ids, pairs):
    """(id, component_id, component_size): 0 is the largest component, ties by least id."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a in root and b in root:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    size = Counter(map(find, ids))
    rank = {r: k for k, r in enumerate(sorted(size, key=lambda r: (-size[r], r)))}
    return sorted((i, rank[find(i)], size[find(i)]) for i in ids)


def test_components_equal_union_find(spark):
    r = random.Random(4)
    ids = [f"n{i}" for i in range(300)]
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(60)] + [("n100", f"n{i}") for i in range(101, 160)]
    pairs += [(f"n{r.randrange(160, 300)}", f"n{r.randrange(160, 300)}") for _ in range(60)] + [("n5", "gone"), ("n5", "n5"), (None, "n7")]
    r.shuffle(pairs)
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    edges = spark.createDataFrame(pairs, "subject string, object string")
    assert rows(cc.node_components(nodes, edges), "id", "component_id", "component_size") == union_find(ids, pairs)


@pytest.fixture(scope="module")
def small(spark):
    """A graph in which every query below would lose rows to a filter on ids or values."""
    nodes = [("P1", "Part", "p", "f1"), ("P1", "Part", "p", "f2"), ("P2", "Part", "p", "f1"), ("S1", "Supplier", "s", "f1"), ("C1", "Customer", "c", "f1"), ("N1", "Nation", "n", "f1"), ("N2", "Nation", "obsolete n", "f1"), ("D1", "Document", None, "f1")]
    edges = [("L:1-1", "S1", "supplies", "P1", 1.0), ("L:1-2", "S1", "supplies", "P2", 9.0), ("C:1", "C1", "located_in", "N1", 5.0), ("L:1-2", "S1", "supplies", "P2", 8.0), ("C:1", "C1", "located_in", "N1", 5.0), ("E:1", None, "performed", "X1", 1.0)]
    return Graph(
        spark.createDataFrame([(*n, "src") for n in nodes], "id string, category string, name string, file_source string, provided_by string"),
        spark.createDataFrame([(*e, "src", "f1") for e in edges], "id string, subject string, predicate string, object string, score double, provided_by string, file_source string"),
        {"mappings": spark.createDataFrame([], "subject_id string, predicate_id string, object_id string, mapping_source string")},
    )


def test_connectivity_queries_cover_the_whole_graph(small):
    q = plans._QUERIES
    ids = {r.id for r in small.nodes.collect()}
    pairs = [(r.subject, r.object) for r in small.edges.collect()]
    want = union_find(ids, pairs)
    of = {i: c for i, c, _ in want}
    assert rows(q["connected_components"](small), "id", "component_id", "component_size") == want
    n_edges = Counter(of[a] for a, _ in pairs if a in of)
    assert rows(q["cc_component_sources"](small), "component_id", "predicate", "edge_count") == [(0, "supplies", 3), (1, "located_in", 2)]
    assert rows(q["cc_components"](small), "component_id", "size", "edge_count") == sorted({(c, s, n_edges[c]) for _, c, s in want})
    assert tuple(q["connectivity_summary"](small).first()) == (7, 4, 2, 1, 3, round(3 / 7, 6))  # one node is deprecated
    assert rows(q["prune_small_components"](small), "subject", "object") == [("S1", "P1"), ("S1", "P2"), ("S1", "P2")]
    labels = rows(q["denormalized_edges_multivalued"](small.__class__(small.nodes.dropDuplicates(["id"]), small.edges.where("id = 'L:1-1'"))), "id", "ends_label")
    assert labels == [("L:1-1", "p"), ("L:1-1", "s")]


def test_merge_counts_keep_one_edge_of_each_repeated_id(small):
    ids, first = {r.id for r in small.nodes.collect()}, {}
    for r in small.edges.collect():
        first.setdefault(r.id, r)
    want = Counter(r.predicate for r in first.values() if r.subject in ids and r.object in ids)
    assert want == {"supplies": 2, "located_in": 1}
    assert rows(plans._QUERIES["merge_pipeline_counts"](small), "predicate", "edges") == sorted(want.items())


def test_reports(spark):
    nodes = spark.createDataFrame([("A", "G"), ("B", "D")], "id string, category string")
    edges = spark.createDataFrame([("A", "B", "p", ["x", "y"]), ("A", "B", "p", ["y"]), ("B", "A", "q", None)], "subject string, object string, predicate string, pubs array<string>")
    got = rp.edge_report(edges, nodes, columns=["subject_category", "predicate", "absent"], sets=["pubs"], percentiles=["pubs"])
    assert rows(got, "subject_category", "predicate", "count", "pubs_set", "pubs_avg") == [("D", "q", 1, None, 0.0), ("G", "p", 2, ["x", "y"], 1.5)]
    assert abs(got.agg(F.sum("proportion")).first()[0] - 1) < 1e-12
    with pytest.raises(ValueError):
        rp.node_report(nodes, ["nothing"])
    sources = spark.createDataFrame([("A", "B", [("infores:a", "primary_knowledge_source")])], "subject string, object string, sources array<struct<resource_id:string,resource_role:string>>")
    assert rp.with_source_roles(sources).first().primary_knowledge_source == "infores:a"


def test_profile(spark):
    df = spark.createDataFrame([(f"N:{i}", "XY"[i % 2], i, ["a", "b"], f"t{i}") for i in range(30)], "id string, kind string, n int, tags array<string>, free string")
    assert pf.categorical_columns(df) == ["kind", "tags"]
    got = pf.marginals(df, ["kind", "tags"])
    assert rows(got, "column_name", "value", "count") == [("kind", "X", 15), ("kind", "Y", 15), ("tags", "a", 30), ("tags", "b", 30)]
    assert {r.share for r in got.collect()} == {0.5}
    assert "50.00%" in pf.render([("kind", "X", 15, 0.5)])


def test_catalogue_and_model_check(spark):
    c = default_catalogue()
    assert c.slot_type("p_value").simpleString() == "double" and c.slot_type("sources").simpleString().startswith("array<struct")
    assert c.slot_type("has_supporting_studies").simpleString().startswith("map<string")
    with pytest.raises(UnknownSlotsError):
        c.schema(["id", "nonsense"], strict=True)
    nodes = spark.createDataFrame([("HGNC:1", ["biolink:Gene"]), ("HGNC:2", ["Gene"]), ("MONDO:1", ["biolink:Disease"]), ("X:1", ["biolink:Gene", "biolink:Disease"]), ("Q:1", None)], "id string, category array<string>")
    edges = spark.createDataFrame([("HGNC:1", "regulates", "HGNC:2", ["biolink:GeneToGeneAssociation"]), ("HGNC:1", "regulates", "MONDO:1", ["biolink:GeneToGeneAssociation"]), ("HGNC:1", "related_to", "MONDO:1", None), ("Q:1", "p", "Q:1", None)], "subject string, predicate string, object string, category array<string>")
    assert rows(mc.check_edge_types(edges, nodes), "verdict", "count") == [("BAD_OBJECT", 1), ("ok", 1), ("ok", 1)]
    assert rows(mc.check_prefixes(nodes), "prefix", "count", "examples") == [("X", 1, ["X:1"])]
    assert ensure_slots(nodes, ["name", "publications"]).columns == ["id", "category", "name", "publications"]
    assert "nodes" in export_schema({"nodes": nodes})


def test_lookups(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    one = lk.mapping_table(spark.createDataFrame([("a", "1"), ("a", "2")], "k string, v string"), "k", "v")
    two = lk.mapping_table(spark.createDataFrame([("a", "9"), ("b", "8")], "k string, v string"), "k", "v")
    assert rows(lk.looked_up(df, "k", [one, two], "x"), "k", "x") == [("a", "2"), ("b", "8"), ("c", "c")]
    with pytest.raises(Exception, match="no mapping"):
        lk.looked_up(df, "k", [one, two], "x", on_failure="error").collect()
    sssom = spark.createDataFrame([("A:123", "skos:exactMatch", "B:987"), ("B:000", "skos:exactMatch", "A:420"), ("A:1", "skos:broadMatch", "B:1")], "subject_id string, predicate_id string, object_id string")
    edges = spark.createDataFrame([("A:123", "p", "A:1"), ("A:420", "p", "A:123")], "subject string, predicate string, object string")
    assert rows(lk.mapped_on_write(edges, sssom, ["B"], ["B"]), "subject", "object", "original_subject") == [("B:000", "B:987", "A:420"), ("B:987", "A:1", "A:123")]
