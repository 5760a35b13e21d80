"""The segment store: appends that write only what is new, lookups by key, joins in buckets, components over appends."""

import pytest
from pyspark.sql import functions as F

from graphweft import operations
from graphweft.model import Graph
from graphweft.operators import components_update
from graphweft.operators.components import connected_components
from graphweft.operators.integrity import split_dangling, split_singletons
from graphweft.plans.store import GraphStore

EDGE = "id string, subject string, predicate string, object string, file_source string"


def edges(spark, ids, source="a", subject="s", object="o"):
    return spark.createDataFrame([(i, f"{subject}{k % 7}", "p", f"{object}{k % 5}", source) for k, i in enumerate(ids)], EDGE)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def store(spark, tmp_path):
    return GraphStore(spark, str(tmp_path / "s"), buckets=4)


def test_append_writes_only_new_files(spark, store):
    store.put("edges", edges(spark, [f"e{i:04}" for i in range(400)]))
    before = store.files("edges")
    done = store.append("edges", edges(spark, ["e0003", "z1", "z1", None, None, "z2"], "b"), unique=True)
    after = store.files("edges")
    assert set(before) < set(after)  # no file was rewritten, and the new rows are in new ones
    assert done.added == 4 and sorted(r.id for r in done.left_out.collect()) == ["e0003", "z1"]
    assert store.stats()["edges"] == 404 and store.table("edges").where("id is null").count() == 2
    assert store.table("edges").where("id = 'e0003'").first().file_source == "a"
    # null ids are never repeats: they come again
    assert store.append("edges", edges(spark, [None]), unique=True).added == 1


def test_only_files_that_may_hold_a_key_are_read(spark, store):
    store.put("edges", edges(spark, [f"e{i:04}" for i in range(400)]))
    assert len(store.append("edges", edges(spark, ["e0007"]), unique=True).files_read) == 1
    # beyond every file's range, then inside the ranges but in no filter
    assert store.append("edges", edges(spark, ["x1", "x2"]), unique=True).files_read == []
    missing = [f"e{i:04}x" for i in range(60)]
    assert len(store.append("edges", edges(spark, missing), unique=True).files_read) < 4
    assert store.lookup("edges", spark.createDataFrame([("e0001",), ("x2",), ("none",), (None,)], "id string")).count() == 2


def test_columns_types_and_failed_writers(spark, store):
    store.put("edges", edges(spark, ["a"]).drop("file_source"))
    done = store.append("edges", edges(spark, ["b"]).withColumn("score", F.lit(1.5)), unique=True)
    assert sorted(done.new_columns) == ["file_source", "score"]
    assert rows(store.table("edges").select("id", "score")) == [("a", None), ("b", 1.5)]
    # text can't hold a list: the table is made new with lists
    store.append("edges", edges(spark, ["c"]).withColumn("predicate", F.array(F.lit("q"))), unique=True)
    assert rows(store.table("edges").select("id", "predicate")) == [("a", ["p"]), ("b", ["p"]), ("c", ["q"])]
    late = GraphStore(spark, store.path)
    store.append("edges", edges(spark, ["d"]).withColumn("predicate", F.array(F.lit("q"))))
    with pytest.raises(FileExistsError):  # the version that this writer would publish is there
        late.append("edges", edges(spark, ["d2"]).withColumn("predicate", F.array(F.lit("q"))))
    assert GraphStore(spark, store.path, "r").stats() == {"edges": 4}
    store.compact("edges")
    store.vacuum()
    assert store.table("edges").count() == 4 and len({f.split("/")[0] for f in store.files("edges")}) == 1


def test_first_unique_append_removes_old_repeats(spark, store):
    store.put("edges", edges(spark, ["a", "a", "b"], "x"))
    assert store.append("edges", edges(spark, ["b", "c"], "y"), unique=True).added == 1
    assert sorted(r.id for r in store.table("edges").collect()) == ["a", "b", "c"]


def test_empty_appends(spark, store):
    assert store.append("edges", edges(spark, []), unique=True).added == 0
    assert store.append("edges", edges(spark, ["a"]), unique=True).added == 1
    assert store.append("edges", edges(spark, []), unique=True).added == 0 and store.table("edges").count() == 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange hashpartitioning")


def test_joins_in_buckets(spark, store):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes = spark.createDataFrame([(f"s{i}", "c", f"n{i}") for i in range(6)] + [("o1", "d", "x"), ("o2", "d", "y"), ("only", "e", "z")], "id string, category string, name string")
        some = edges(spark, [f"e{i}" for i in range(200)]).unionByName(spark.createDataFrame([("n1", None, "p", "o1", "a"), ("n2", "s1", "p", None, "a")], EDGE))
        store.save(Graph(nodes, some))
        operations.lay_out(spark, store.path)
        at = GraphStore(spark, store.path)
        dangling, single = operations.stored_dangling(at), operations.stored_singletons(at)
        assert rows(dangling.select("id")) == rows(split_dangling(some, nodes)[1].select("id"))
        assert rows(single.select("id")) == rows(split_singletons(nodes, some)[1].select("id")) != []
        assert exchanges(single) == 0
        assert exchanges(dangling) <= 1  # of the edges without an object's node alone, above the joins
        named = operations.stored_named_edges(at, "subject", ["name"])
        assert exchanges(named) == 0 and named.count() == 202
        # appends reach the layouts
        at.append("edges", edges(spark, ["more"], subject="q"))
        assert operations.stored_dangling(at).where("id = 'more'").count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_a_hot_key_goes_without_buckets(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "s"), buckets=8)
    store.put("edges", edges(spark, [f"e{i}" for i in range(3000)]).withColumn("subject", F.when(F.col("id") < "e9", "hot").otherwise(F.col("id"))))
    store.add_layout("edges", "edges_by_subject", ["subject"])
    assert store.bucketed("edges_by_subject").groupBy("subject").count().count() > 1
    assert exchanges(store.bucketed("edges_by_subject").groupBy("subject").count()) == 1
    assert exchanges(store.bucketed("edges").groupBy("id").count()) == 0


def test_components_over_appends(spark, store):
    batches = [[("b", "c"), ("d", "e"), ("x", None)], [("c", "d"), ("f", "g"), ("f", "g")], [("a", "g"), ("h", "h")], [("e", "f"), ("z", "y")], []]
    pairs = [spark.createDataFrame(b, "subject string, object string") for b in batches]
    components_update.start(store, pairs[0])
    for i in range(1, len(pairs)):
        components_update.add_edges(store, pairs[i])
        whole = spark.createDataFrame([e for b in batches[: i + 1] for e in b], "subject string, object string")
        assert rows(components_update.components(store).select("id", "component")) == rows(connected_components(whole, "subject", "object").select("id", "component"))
