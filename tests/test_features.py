"""The model as relations, sketches, nested reports, sidecars, several split lists, observed counts."""

import random

import pytest
import yaml
from pyspark.sql import functions as F

from graphweft import operations as op
from graphweft.cli import parser
from graphweft.model import Graph
from graphweft.operators import integrity as it
from graphweft.operators import modelcheck as mc
from graphweft.operators.catalogue import Catalogue, closed
from graphweft.plans.store import GraphStore
from graphweft.sources import readers, sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def large_model(n: int) -> Catalogue:
    r = random.Random(n)
    classes = {"thing": {}}
    for i in range(1, n):
        classes[f"c{i}"] = {"is_a": f"c{r.randrange(max(1, i - 30), i)}" if i > 1 else "thing", **({"mixins": [f"c{r.randrange(1, i)}"]} if i > 50 and i % 7 == 0 else {})}
    for i in range(0, n, 50):
        classes[f"association {i}"] = {"slot_usage": {"subject": f"c{i + 1}", "predicate": [f"p{i}", "q"], "object": f"c{i + 2}"}}
    return Catalogue(classes=classes, predicates={"q": {"domain": "c5", "range": "c9"}})


def by_force(catalogue, association, subject, predicate, object_):
    named = {f"biolink:{''.join(w[:1].upper() + w[1:] for w in c.split())}": c for c in catalogue.classes}
    above = {k: {f"biolink:{''.join(w[:1].upper() + w[1:] for w in a.split())}" for a in catalogue.ancestors(c)} for k, c in named.items()}
    up = lambda cats: set().union(*(above.get(c, set()) for c in cats))
    constraints = {}
    for k, c in named.items():
        use = catalogue.classes[c].get("slot_usage")
        if use:
            camel = lambda x: f"biolink:{''.join(w[:1].upper() + w[1:] for w in x.split())}"
            constraints[k] = (camel(use["subject"]), {f"biolink:{p}" for p in use["predicate"]}, camel(use["object"]))
    bound = [constraints[a] for a in association if a in constraints]
    if not bound:
        legal = [*constraints.values(), ("biolink:C5", {"biolink:q"}, "biolink:C9")]
        return "ok" if any(s in up(subject) and predicate in p and o in up(object_) for s, p, o in legal) else "NOT_IN_LEGAL_TYPES"
    flags = [(s in up(subject), predicate in p, o in up(object_)) for s, p, o in bound]
    if any(map(all, flags)):
        return "ok"
    for k, verdict in enumerate(("BAD_SUBJECT", "BAD_PREDICATE", "BAD_OBJECT")):
        if not any(f[k] for f in flags):
            return verdict
    return "BAD_COMBINATION"


def test_a_model_of_a_thousand_classes(spark):
    catalogue, r = large_model(1000), random.Random(4)
    pick = lambda: f"biolink:C{r.randrange(1, 1000) if r.random() < 0.5 else r.choice((1, 2, 5, 9, 51, 52, 101, 102))}"
    nodes = spark.createDataFrame([(f"N:{i}", [pick() for _ in range(1 + i % 2)]) for i in range(60)], "id string, category array<string>")
    some = [(f"N:{r.randrange(60)}", f"biolink:{r.choice(('q', 'p0', 'p50', 'x'))}", f"N:{r.randrange(60)}", [f"biolink:Association{r.choice((0, 50, 7))}"] if i % 3 else None) for i in range(300)]
    edges = spark.createDataFrame(some, "subject string, predicate string, object string, category array<string>")
    got = mc.check_edge_types(edges, nodes, catalogue)
    found = got.collect()
    assert sum(x["count"] for x in found) == 300 and len({x.verdict for x in found}) >= 4
    for x in found:
        assert x.verdict == by_force(catalogue, x.association, set(x.subject_categories), x.predicate, set(x.object_categories)), x
    few = mc.check_edge_types(edges, nodes, large_model(60))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert abs(size(got) - size(few)) <= 2  # the plan doesn't grow with the model


def test_lineage_of_a_deep_hierarchy_with_a_ring(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("x", "y"), ("y", "x")]
    every = {c for p in chain for c in p}
    got = closed(spark.createDataFrame(chain + [(c, c) for c in every], "class string, ancestor string"))
    assert got.where("class = 'c0'").count() == 41 and got.where("class = 'x'").count() == 2


def test_mixins_are_ancestors():
    c = Catalogue(classes={"a": {}, "m": {}, "b": {"is_a": "a", "mixins": ["m"]}, "d": {"is_a": "b"}})
    assert set(c.ancestors("d")) == {"d", "b", "a", "m"} and c.descendants("m") == ["m", "b", "d"]


def test_sketches_read_new_segments_only(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "s"), buckets=2)
    part = lambda a, b: spark.range(a, b).selectExpr("cast(id as string) id", "id % 500 as k", "cast(id as double) x", "cast(null as double) y", "array(id) l")
    store.put("nodes", part(0, 4000))
    assert store.sketch("nodes") == 1 and store.sketch("nodes") == 0
    store.append("nodes", part(4000, 10000))
    assert store.sketch("nodes") == 1
    got = {r["column"]: r for r in store.estimates("nodes", [0.0, 0.5, 1.0]).collect()}
    assert set(got) == {"id", "k", "x", "y"} and got["id"].n == 10000 and got["y"].n == 0 and got["y"].quantiles is None
    assert abs(got["id"].distinct - 10000) < 300 and abs(got["k"].distinct - 500) < 15
    assert got["x"].quantiles[0] == 0 and got["x"].quantiles[2] == 9999 and abs(got["x"].quantiles[1] - 5000) < 150


@pytest.fixture
def graph(spark):
    nodes = spark.createDataFrame([("A:1", "X", "s1", "f"), ("A:2", "X", "s1", "f"), ("B:1", None, "s2", "f"), ("C:1", "Y", None, "f")], "id string, category string, provided_by string, file_source string")
    edges = spark.createDataFrame([("A:1", "p", "A:2", "t1", "f"), ("A:1", "q", "Z:9", "t1", "f"), ("Z:8", "q", "Z:9", "t2", "f")], "subject string, predicate string, object string, provided_by string, file_source string")
    return it.prune_graph(Graph(nodes, edges))


def test_nested_quality_report(spark, graph, tmp_path):
    report = op.qc_report(graph)
    assert report["summary"] == {"total_nodes": 4, "total_edges": 1, "dangling_edges": 2}
    assert report["nodes"][0] == {"name": "s1", "total_number": 2, "categories": {"X": 2}, "namespaces": ["A"]}
    assert [x["name"] for x in report["nodes"]] == ["s1", "s2"]
    assert [(x["name"], x["missing_ids"]) for x in report["dangling_edges"]] == [("t1", 1), ("t2", 2)]
    sinks.write_yaml(report, str(tmp_path / "r.yaml"))
    assert yaml.safe_load((tmp_path / "r.yaml").read_text()) == report
    assert parser().parse_args(["report", "--format", "yaml"]).format == "yaml"


def test_connectivity_sidecars(spark, graph, tmp_path):
    made = op.connectivity_tables(graph, str(tmp_path))
    assert made == {"cc_nodes": 4, "cc_components": 3, "cc_component_sources": 1}
    assert spark.read.parquet(str(tmp_path / "cc_components.parquet")).where("component_id = 0").first().size == 2


def test_several_split_lists_lie_side_by_side(spark):
    df = spark.createDataFrame([("1", ["a", "b"], ["x", "y"], "s"), ("2", ["b", "a"], ["x", "x"], "s"), ("3", ["a"], None, "t")], "id string, p array<string>, q array<string>, r string")
    got = it.split_memberships(df, ["p", "q", "r"]).select("id", "_p", "_q", "_r")
    # (a, x), (b, y), (b, x) and (a, null) are made; (a, y) never stands side by side
    assert rows(got) == sorted([("1", "a", "x", "s"), ("1", "b", "y", "s"), ("1", "b", "x", "s"), ("2", "a", "x", "s"), ("2", "b", "x", "s"), ("3", "a", None, "t")], key=repr)


def test_dangling_partition_with_nulls_and_repeated_nodes(spark):
    nodes = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "id string")
    edges = spark.createDataFrame([("1", "a", "b"), ("2", None, "b"), ("3", "a", "z"), ("4", None, None), ("1", "a", "b")], "id string, subject string, object string")
    kept, bad = it.split_dangling(edges, nodes)
    assert [r.id for r in kept.collect()] == ["1", "1"] and sorted(r.id for r in bad.collect()) == ["2", "3", "4"]
    assert kept.columns == bad.columns == edges.columns


def test_losing_values_are_counted_while_loading(spark, tmp_path):
    (tmp_path / "a_nodes.tsv").write_text("id\tcategory\tname\nA:1\tX|Y\tn\nA:2\tX\tn\nA:3\tX|Y|Z\tn\n")
    out = op.load(spark, str(tmp_path / "s"), [str(tmp_path / "a_nodes.tsv")], single=["category"])
    assert out["losing"] == {str(tmp_path / "a_nodes.tsv"): {"category": 2}} and out["rows"] == {"nodes": 3}
    assert GraphStore(spark, str(tmp_path / "s"), "r").table("nodes").schema["category"].dataType.simpleString() == "string"


def test_malformed_mappings_are_counted(spark, tmp_path):
    from pyspark.sql import Observation

    (tmp_path / "m.sssom.tsv").write_text("# x\nsubject_id\tpredicate_id\tobject_id\nA\tp\tB\nC\tp\nD\tp\tE\tmore\n")
    seen = Observation()
    assert readers.read_mappings(spark, [str(tmp_path / "m.sssom.tsv")], seen).select(F.col("subject_id")).count() == 1
    assert seen.get == {"rows": 1, "malformed": 2}
