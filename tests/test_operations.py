import json

from graphweft import operations as op
from graphweft.cli import parser
from graphweft.plans.store import GraphStore


def test_a_graph_from_files_to_reports(spark, tmp_path):
    (tmp_path / "a_nodes.tsv").write_text("id\tcategory\tname\nA:1\tX\tone\nA:1\tX\tone\nB:1\tY\ttwo\nC:1\tY\tthree\n")
    (tmp_path / "a_edges.tsv").write_text("id\tsubject\tpredicate\tobject\ne1\tA:1\tp\tB:1\ne2\tA:1\tp\tZ:9\ne3\tC:9\tp\tB:1\n")
    (tmp_path / "m.sssom.tsv").write_text("subject_id\tpredicate_id\tobject_id\nC:1\tskos:exactMatch\tC:9\n")
    (tmp_path / "closure.tsv").write_text("A:1\tsub\tA:1\nB:1\tsub\tB:1\nB:1\tsub\tA:1\n")
    store, files = str(tmp_path / "s"), [str(tmp_path / "a_*.tsv")]
    got = op.merge(spark, store, files, [str(tmp_path / "m.sssom.tsv")], export=str(tmp_path / "out"), archive=True)
    assert got["success"] and got["rows"]["nodes"] == 3 and got["rows"]["edges"] == 2 and got["rows"]["dangling_edges"] == 1
    failed = op.merge(spark, store, files)
    assert failed["success"] is False and [(x["step"], x["success"]) for x in failed["steps"]] == [("join", True), ("deduplicate", True), ("normalize", False), ("prune", True)]
    assert "mappings" in failed["steps"][2]["error"] and GraphStore(spark, store, "r").stats()["edges"] == 2  # the store is as it was
    assert op.closurize(spark, store, str(tmp_path / "closure.tsv"))["closure"] == 3
    op.closurize(spark, store)
    listed = op.closurize(spark, store, lists=True)
    assert listed["closure_id"] == 2 and listed["descendants_id_label"] == 2
    assert "evidence_count" in GraphStore(spark, store, "r").manifest["schema"]
    assert op.information_content(spark, store, ["sub"])["information_content"] == 2
    (tmp_path / "b_nodes.tsv").write_text("id\tcategory\tname\textra\nA:1\tX\tone\tq\nD:1\tX\tfour\tq\n")
    more = op.append(spark, store, [str(tmp_path / "b_nodes.tsv")], deduplicate=True)
    assert "extra" in more["new_columns"]["nodes"] and more["net_rows"]["nodes"] == 1 and more["net_rows"]["duplicate_nodes"] == 1
    assert "extra" in GraphStore(spark, store, "r").manifest["schema"]
    op.load(spark, str(tmp_path / "ensured"), files, ensure={"nodes": ["synonym", "name"]})
    assert GraphStore(spark, str(tmp_path / "ensured"), "r").table("nodes").schema["synonym"].dataType.simpleString() == "array<string>"
    graph = GraphStore(spark, store, "r").graph()
    for kind in ("qc", "graph-stats", "schema", "connectivity"):
        assert op.report(graph, kind).count() > 0
    assert op.profile(graph).count() > 0
    types, prefixes = op.model_check(graph)
    assert types.count() == 2 and prefixes.count() == 0
    assert len(op.convert(spark, files, str(tmp_path / "c"), format="jsonl")) == 2
    assert len(op.split(spark, str(tmp_path / "a_nodes.tsv"), str(tmp_path / "split"), ["category"])) == 2
    assert op.prune(spark, store, remove_singletons=True)["singleton_nodes"] == 1
    assert parser().parse_args(["report", "--store", store]).kind == "qc" and json.dumps(got)
