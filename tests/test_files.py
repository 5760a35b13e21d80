from pathlib import Path
import gzip
import json
import tarfile
import types
import uuid
from types import SimpleNamespace

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from graphweft.ingest import runner
from graphweft.model import FileSpec, Graph
from graphweft.plans import files, fixture
from graphweft.plans.store import GraphStore
from graphweft.sources import archives, delimited, readers, sinks
from graphweft.sources.positions import first_rows
from graphweft.streaming import append as stream


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture
def graph_files(tmp_path):
    (tmp_path / "a_nodes.tsv").write_text("id\tcategory\tname\tprovided_by\nHGNC:1\tX|Y\tone\told\nHGNC:2\t\ttwo\told\n")
    with gzip.open(tmp_path / "b_nodes.jsonl.gz", "wt") as f:
        f.write(json.dumps({"id": "CHEBI:1", "category": ["C"], "name": "c"}) + "\n")
    (tmp_path / "a_edges.tsv").write_text('subject\tpredicate\tobject\tnote\nHGNC:1\tp\tHGNC:2\t"tab\there ""q"""\n')
    return tmp_path


def test_load_join_and_round_trip(spark, graph_files, tmp_path):
    paths = [str(p) for p in sorted(graph_files.glob("*_*"))]
    loaded = readers.load_graph(spark, [*paths, str(tmp_path / "gone_nodes.tsv")])
    assert rows(loaded.graph.nodes, "id", "category", "provided_by", "file_source") == sorted([("HGNC:1", ["X", "Y"], "old", "a_nodes"), ("HGNC:2", None, "old", "a_nodes"), ("CHEBI:1", ["C"], None, "b_nodes")], key=repr)
    assert len(loaded.errors) == 1 and len(loaded.files) == 3
    assert loaded.graph.edges.first().note == 'tab\there "q"'
    joined = readers.join_graphs(spark, paths)
    assert {r.provided_by for r in joined.graph.nodes.collect()} == {"a_nodes", "b_nodes"}
    out = sinks.export_graph(loaded.graph, str(tmp_path / "out"), "g", "tsv")
    back = readers.load_graph(spark, out)
    assert rows(back.graph.nodes, "id", "category") == rows(loaded.graph.nodes, "id", "category")
    assert back.graph.edges.first().note == 'tab\there "q"'
    (archive,) = sinks.export_graph(loaded.graph, str(tmp_path / "tar"), "g", "jsonl", archive=True, compress=True)
    with tarfile.open(archive) as t:
        assert sorted(t.getnames()) == ["g_edges.jsonl", "g_nodes.jsonl"]
    assert archives.members_of(archive) == ["g_nodes.jsonl", "g_edges.jsonl"] and archives.archive_lines(spark, [archive], ["g_nodes.jsonl"]).count() == 3
    with pytest.raises(ValueError, match="lack name"):
        readers.load_graph(spark, paths[:1], required={"edges": ["name"]})


def test_slots_and_strictness(spark, tmp_path):
    path = tmp_path / "x_nodes.jsonl"
    path.write_text('{"id": "A", "category": ["c"], "extra": 1}\n')
    got = readers.load_graph(spark, [FileSpec(str(path), "jsonl", "nodes", "x", ("id", "category"))]).graph.nodes
    assert "extra" not in got.columns
    path.write_text('{"id": "A", "category": "c"}\n')
    with pytest.raises(Exception, match="slots"):
        readers.read_jsonl(spark, str(path), ["id", "category"]).collect()
    with pytest.raises(readers.UnknownSlotsError):
        readers.load_graph(spark, [str(path.with_name("x_nodes.jsonl"))][:1] and [FileSpec(str(path), "jsonl", "nodes", "x", ("id", "nonsense"))])


def read(spark, text, tmp_path, **form):
    path = tmp_path / "d.txt"
    path.write_text(text)
    return delimited.read_csv(spark, [str(path)], delimited.CsvFormat(",", **form))


def test_csv_reader(spark, tmp_path):
    form = {"columns": ("a", "c"), "types": {"a": "int", "c": "float"}}
    with pytest.warns(UserWarning, match="aren't configured"):
        got = read(spark, "# note\n\na, b ,c\n 1 ,x,2.5\n,y,\n", tmp_path, **form)
    assert rows(got, "a", "c") == sorted([(1, 2.5), (None, None)], key=repr)
    with pytest.warns(UserWarning), pytest.raises(Exception, match="not of type int: bad"):
        read(spark, "a,b,c\nbad,x,1\n", tmp_path, **form).collect()
    with pytest.raises(ValueError, match="absent"):
        read(spark, "a,b\n", tmp_path, columns=("z",))
    with pytest.raises(Exception, match="too few cells: 1"):
        read(spark, "a,b\n1\n", tmp_path).collect()
    with pytest.raises(ValueError, match="no header"):
        read(spark, "# only\n\n", tmp_path)
    with pytest.warns(UserWarning, match="another order"):
        read(spark, "b,a\n1,2\n", tmp_path, columns=("a", "b"))


def test_csv_lines_are_told_by_place(spark, tmp_path):
    # a data row equal to the header, or to a skipped line, stays
    assert rows(read(spark, "a,b\n1,2\na,b\n", tmp_path), "a", "b") == [("1", "2"), ("a", "b")]
    assert rows(read(spark, "x,y\na,b\nx,y\n1,2\n", tmp_path, header=1), "a", "b") == [("1", "2"), ("x", "y")]
    # a header after very many comments
    assert rows(read(spark, "# c\n" * 3000 + "a,b\n1,2\n", tmp_path), "a", "b") == [("1", "2")]
    assert rows(read(spark, "#a,b\n1,2\n", tmp_path, header_prefix="#"), "a", "b") == [("1", "2")]
    assert rows(read(spark, "a|b\n1,2\n", tmp_path, header_delimiter="|"), "a", "b") == [("1", "2")]
    # blank lines are skipped, or rows of NaN
    assert read(spark, "a,b\n\n1,2\n", tmp_path).count() == 1
    assert rows(read(spark, "a,b\n\n1,2\n", tmp_path, skip_blank=False), "a", "b") == [("1", "2"), ("NaN", "NaN")]
    # cells beyond the header go, and are counted
    seen = Observation()
    (tmp_path / "d.txt").write_text("a,b\n1,2,3\n4,5\n")
    got = delimited.read_csv(spark, [str(tmp_path / "d.txt")], delimited.CsvFormat(","), observation=seen)
    assert rows(got, "a", "b") == [("1", "2"), ("4", "5")] and seen.get == {"rows": 2, "long_rows": 1}


QUOTED = [
    'a,"b\nc",d', '"x ""y"" z",2,3', '5" pipe,"",6', '"open\n\n# no comment\nstill",1,2', 'say "hi",x,y', '"a""",b,c', '"""",2,3', '"q",w"e,r', '"tail"x,1,2', '"1\n2","3\n4","5\n6"',
]


@pytest.mark.parametrize("most", ["20b", "64b", "1m"])
def test_quoted_line_breaks_over_splits(spark, tmp_path, most):
    import csv
    import io

    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in kept:
        spark.conf.set(k, most)
    try:
        text = "k,l,m\n" + "\n".join(QUOTED * 3) + "\n"
        want = [tuple(c.strip() for c in r) for r in csv.reader(io.StringIO(text, newline=""))][1:]
        assert rows(read(spark, text, tmp_path), "k", "l", "m") == sorted(want, key=repr)
        # the first rows in the order of the file, across its splits
        placed = delimited.read_csv(spark, [str(tmp_path / "d.txt")], delimited.CsvFormat(","), places=True)
        for n in (1, 7, 29, 99):
            assert rows(first_rows(placed, n), "k", "l", "m") == sorted(want[:n], key=repr)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def test_archives_xz_and_web(spark, tmp_path):
    import http.server
    import lzma
    import threading
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.csv", 'a,b\n1,"x\ny"\n')
        z.writestr("dir/two.csv", "a,b\n2,z\n")
        z.writestr("r.json", '{"rows": [{"a": 1}, {"a": 2}]}')
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name in ("one.csv", "two.csv"):
            (tmp_path / name).write_text("a,b\n" + f"{name},q\n")
            t.add(tmp_path / name, name)
    with lzma.open(tmp_path / "x_nodes.jsonl.xz", "wt") as f:
        f.write('{"id": "A", "name": "n"}\n')
    reader = {"file_archive": str(tmp_path / "a.zip"), "files": ["one.csv", "dir/two.csv"], "delimiter": ","}
    assert rows(runner.read_source(spark, reader), "a", "b") == [("1", "x\ny"), ("2", "z")]
    assert rows(runner.read_source(spark, {**reader, "limit": 1}), "a", "b") == [("1", "x\ny")]
    with pytest.raises(FileNotFoundError, match="three"):
        runner.read_source(spark, {**reader, "files": ["three.csv"]})
    assert rows(runner.read_source(spark, {"file_archive": str(tmp_path / "a.zip"), "files": ["r.json"], "format": "json", "json_path": ["rows"]}), "a") == [(1,), (2,)]
    assert rows(runner.read_source(spark, {"files": [str(tmp_path / "a.tar.gz")], "delimiter": ","}), "a") == [("one.csv",), ("two.csv",)]
    assert rows(readers.load_graph(spark, [str(tmp_path / "x_nodes.jsonl.xz")]).graph.nodes, "id", "name") == [("A", "n")]
    handler = lambda *a: http.server.SimpleHTTPRequestHandler(*a, directory=str(tmp_path))
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{server.server_port}/one.csv"
        assert rows(runner.read_source(spark, {"files": [url], "delimiter": ","}), "a") == [("one.csv",)]
        server.shutdown()


def test_written_archives_read_back(spark, tmp_path):
    lines = spark.createDataFrame([("m1", "a"), ("m1", "b"), ("m2", "c")], "member string, value string").repartition(2, "member")
    for ending in (".zip", ".tar", ".tar.gz"):
        made = sinks.write_archives(lines, str(tmp_path / ending[1:]), ending)
        assert rows(archives.archive_lines(spark, made), "member", "value") == [("m1", "a"), ("m1", "b"), ("m2", "c")]


@pytest.mark.parametrize("ending", [".zip", ".tar", ".tar.gz"])
def test_long_members_are_not_held_in_memory(spark, tmp_path, monkeypatch, ending):
    import tracemalloc

    import pandas as pd
    import pyspark

    class Lines:
        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):
            self.run = run
            return self

        def collect(self):
            batches = (pd.DataFrame({"member": ["m1", "m2"] * 500, "value": [f"{k} {i} {'x' * 1000}" for i in range(1000)]}) for k in range(60))
            return [{"path": p} for frame in self.run(batches) for p in frame["path"]]

    monkeypatch.setattr(sinks, "HELD", 2_000_000, raising=False)
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    tracemalloc.start()
    try:
        (made,) = sinks.write_archives(Lines(), str(tmp_path / "a"), ending)
        assert tracemalloc.get_traced_memory()[1] < 20_000_000  # of 60 MB
    finally:
        tracemalloc.stop()
    monkeypatch.undo()
    got = archives.archive_lines(spark, [made]).selectExpr("member", "block", "line", "split(value, ' ')[0] * 1000 + split(value, ' ')[1] as at", "length(value) as n")
    for k, m in enumerate(("m1", "m2")):
        one = [int(r["at"]) for r in got.where(f"member = '{m}' and n > 1000").orderBy("block", "line").collect()]
        assert one == list(range(k, 60_000, 2))


def test_members_of_a_plain_tar_are_split(spark, tmp_path):
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    texts = {"a.csv": 'k,l\n1,"x\ny"\r\n2,ä\n\n3,"long\n\nnote"\n4,\r5,z', "none.csv": "", "b.csv": "k,l\n" + "".join(f"{i},{'v' * (i % 9)}\n" for i in range(50))}
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        for name, text in texts.items():
            (tmp_path / name).write_bytes(text.encode())
            t.add(tmp_path / name, name)
    want = [(n, x) for n, text in texts.items() for x in text.replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n").split("\n") if text]
    try:
        for most in (1, 7, 64, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", f"{most}b")
            lines = archives.archive_lines(spark, [str(tmp_path / "a.tar")])
            assert lines.rdd.getNumPartitions() == sum(-(-len(x.encode()) // most) for x in texts.values())
            assert [(r["member"], r["value"]) for r in lines.orderBy("number", "block", "line").collect()] == want
            if most > 1:
                read = runner.read_source(spark, {"file_archive": str(tmp_path / "a.tar"), "files": ["a.csv", "b.csv"], "delimiter": ","})
                assert rows(read, "k", "l") == rows(spark.createDataFrame([("1", "x\ny"), ("2", "ä"), ("3", "long\n\nnote"), ("4", ""), ("5", "z"), *((str(i), "v" * (i % 9)) for i in range(50))], "k string, l string"), "k", "l")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_counts_while_writing_needs_little_disk_for_its_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "shared_folder", lambda spark, label: str(tmp_path / label))
    g = fixture.graph(spark, "/root/testdata/sf0.001")
    counts = {r["what"]: r["n"] for r in files.counts_while_writing(spark, g).collect()}
    text = g.edges.drop("file_source").select(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0]
    assert sum(p.stat().st_size for p in (tmp_path / "edges").glob("part-*")) < text / 4
    assert counts["nodes rows"] == g.nodes.count() and counts["losing publications"] == g.edges.where("publications like '%|PMID%'").count()


def test_quoted_breaks_never_stand_on_disk_as_a_whole(spark, tmp_path, monkeypatch):
    most, read_csv = [], delimited.read_csv

    def read(spark, paths, form):
        most.append(sum(p.stat().st_size for p in tmp_path.glob("*/part-*.txt")))
        return read_csv(spark, paths, form)

    monkeypatch.setattr(files, "TURN", 400_000, raising=False)
    monkeypatch.setattr(readers, "shared_folder", lambda spark, label: f"{tmp_path}/{label}-{uuid.uuid4().hex}")
    monkeypatch.setattr(delimited, "read_csv", read)
    g = fixture.graph(spark, "/root/testdata/sf0.001")
    got = files.csv_quoted_breaks(spark, g)
    assert len(most) > 2 and max(most) < 600_000 and not list(tmp_path.glob("*/part-*.txt"))
    note = F.concat(F.lit('say "'), F.col("id"), F.lit('",\n# no comment,\n'), F.repeat(F.coalesce("object", F.lit("none")), 12), F.lit("\n\n"), "predicate")
    want = g.edges.select("id", F.length(note).alias("n_chars"), F.md5(note).alias("note_md5"), "score")
    assert got.dtypes == want.dtypes and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_state_over_records(spark):
    add = lambda value, record: value + record["x"]
    states = [runner.State("sum", int, add, lambda a, b: a + b), runner.State("most", lambda: None, lambda v, r: max(v or 0, r["x"]), lambda a, b: max(a or 0, b or 0))]
    df = spark.range(1000).selectExpr("id as x").repartition(40)
    into: dict = {}
    graph = runner.records_to_graph(df, [lambda r: [{"id": str(r["x"]), "name": "n"}]], states=states, into=into)
    assert into == {"sum": 499500, "most": 999} and graph.nodes.count() == 1000
    runner.records_to_graph(df.limit(0), (), "id string", "id string", states, into)
    assert into["sum"] == 0


def test_null_ids_are_never_repeats(spark, tmp_path):
    nodes = spark.createDataFrame([("A", "1"), ("A", "2"), (None, "3"), (None, "4")], "id string, name string")
    assert sinks.write_nodes_and_edges(nodes, None, str(tmp_path), "g") == {"nodes": 3}
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.jsonl").write_text('{"id": null, "name": "x"}\n{"id": null, "name": "y"}\n{"id": "A", "name": "z"}\n')
    for _ in range(2):
        stream.append_stream(spark, str(source), nodes.schema, str(tmp_path / "t"), str(tmp_path / "c"), "nodes").awaitTermination(120)
        assert GraphStore(spark, str(tmp_path / "t"), "r").stats() == {"nodes": 3}


def test_json_yaml_and_mappings(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"x": {"rows": [{"a": 1}, {"a": 2}]}}')
    assert rows(readers.read_json(spark, str(tmp_path / "d.json"), ["x", "rows"]), "a") == [(1,), (2,)]
    (tmp_path / "d.yaml").write_text("rows:\n- {a: 1}\n- {a: 2}\n")
    assert rows(readers.read_yaml(spark, str(tmp_path / "d.yaml"), ["rows"]), "a") == [(1,), (2,)]
    (tmp_path / "m.sssom.tsv").write_text("# head\nsubject_id\tpredicate_id\tobject_id\nA\tskos:exactMatch\tB\n")
    assert rows(readers.read_mappings(spark, [str(tmp_path / "m.sssom.tsv")]), "subject_id", "object_id", "mapping_source") == [("A", "B", "m.sssom.tsv")]


def test_split_files(spark, tmp_path):
    df = spark.createDataFrame([("1", "biolink:Gene"), ("2", None)], "id string, category string")
    made = sinks.split_files(df, str(tmp_path), ["category"], "g", "_nodes", "jsonl")
    assert sorted(made) == ["biolink:Gene", "null"] and sum(spark.read.json(p).count() for p in made.values()) == 2


def test_store(spark, tmp_path):
    df = spark.createDataFrame([("1",)], "id string")
    store = GraphStore(spark, str(tmp_path / "s"))
    store.save(Graph(nodes=df))
    reader = GraphStore(spark, str(tmp_path / "s"), "r")
    store.save(Graph(nodes=reader.graph().nodes.union(df)))
    assert reader.graph().nodes.count() == 1 and store.stats() == {"nodes": 2}
    with pytest.raises(PermissionError):
        reader.save(Graph(nodes=df))
    store.vacuum()
    assert GraphStore(spark, str(tmp_path / "s"), "r").graph().nodes.count() == 2


def test_ingest_run(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("a\tb\tscore\nP1\tP2\t800\nP1\tP3\t100\n")
    module = types.ModuleType("code")

    @runner.transform_record
    def go(r):
        return [{"id": r["a"], "name": r["a"]}, {"id": r["b"], "name": r["b"]}, {"subject": r["a"], "predicate": "p", "object": r["b"]}]

    module.go = go
    reader = {"files": [str(tmp_path / "d.tsv")], "columns": ["a", "b", {"score": "int"}], "filters": [{"column": "score", "filter_code": "lt", "value": 700, "inclusion": "exclude"}]}
    config = {"name": "t", "reader": reader, "writer": {"format": "jsonl", "min_edge_count": 5}}
    graph = runner.run(spark, config, module)[None]
    assert graph.nodes.count() == 2 and graph.edges.count() == 1
    with pytest.raises(ValueError, match="at least 5"):
        runner.run(spark, config, module, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="either"):
        runner.Hooks().check()
    with pytest.raises(ValueError):
        runner.kind_of({"id": "x"})
    assert runner.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_streaming_append(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.jsonl").write_text('{"id": "A", "name": "a"}\n{"id": "A", "name": "b"}\n')
    schema = spark.createDataFrame([], "id string, name string").schema
    for name, n in (("", 1), ("2.jsonl", 2)):
        if name:
            (source / name).write_text('{"id": "A", "name": "z"}\n{"id": "B", "name": "b"}\n')
        stream.append_stream(spark, str(source), schema, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
        assert GraphStore(spark, str(tmp_path / "t"), "r").table("edges").where("id is not null").count() == n


def test_large_exports_are_folders_written_by_all_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "ONE_FILE", 10)
    nodes = spark.range(40).selectExpr("concat('N:', id) as id").repartition(3)
    edges = spark.createDataFrame([("N:1", "N:2")], "subject string, object string")
    large, small = sinks.export_graph(Graph(nodes, edges), str(tmp_path / "out"), "g", "tsv")
    assert len(list(Path(large).glob("part-*"))) == 3 and Path(small).is_file()
    assert spark.read.csv(large, sep="\t", header=True).distinct().count() == 40
    (archive,) = sinks.export_graph(Graph(nodes, edges), str(tmp_path / "tar"), "g", "jsonl", archive=True)
    with tarfile.open(archive) as t:
        assert sum("part-" in n and not n.endswith(".crc") for n in t.getnames()) == 3
    assert sinks.write_report(nodes, str(tmp_path / "report.tsv")) == 40 and (tmp_path / "report.tsv").is_dir()


def test_a_lost_part_file_is_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "write", lambda *a: None)
    with pytest.raises(RuntimeError):
        sinks.write_one_file(spark.range(3), str(tmp_path / "x.tsv"), "tsv")
    assert list(tmp_path.iterdir()) == []
