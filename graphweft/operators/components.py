"""Connected components of an edge list, by local contractions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def _shared(df: DataFrame) -> str:
    context = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="graphweft-"))
        folder = context.getCheckpointDir()
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in ``spark.checkpoint.dir``."""
    _shared(df)
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``df`` cut from its lineage by one write to the shared folder, and its rows, counted while they are written."""
    path, seen = f"{_shared(df)}/{label}-{uuid.uuid4().hex}", Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]


#: Edges that one task may finish, so that the last and smallest rounds don't each cost two jobs.
LAST = 20_000


def _united(batches):
    """(id, to) of the few edges that are left: the roots that joining them one by one gives."""
    import pandas as pd

    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    yield pd.DataFrame({"id": list(parent), "to": [root(x) for x in parent]})


def connected_components(edges: DataFrame, source: str, target: str, max_rounds: int = 200) -> DataFrame:
    """Rows (id, component) for every non-null end of an edge; component is its least id.

    In each round every id that still has edges moves to the one with the least hash among itself and its
    neighbours, under another hash each time; edges between ids that meet are dropped. So about half of the
    ids or more go in a round, whatever the graph's diameter, and a round is one grouped minimum and one
    pass of two joins, each written once. Once no more than ``LAST`` edges are counted, one task ends them. At the end the moves are put together from the last and smallest
    round to the first. Hot ids aren't gathered: a round only keeps minima, combined before the shuffle.
    """
    ends = edges.select(F.col(source).alias("u"), F.col(target).alias("v")).where("u is not null and v is not null")
    # repeated edges go; loops stay for now, as they name ids
    whole, _ = stored(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "components-edges")
    live, moves = whole.where("u <> v"), []
    n = live.count()
    while n:
        if n <= LAST:
            kind = live.schema["u"].dataType.simpleString()
            moves.append(stored(live.coalesce(1).mapInPandas(_united, f"id {kind}, to {kind}"), "components-moves")[0])
            break
        if len(moves) == max_rounds:
            raise RuntimeError(f"no convergence after {max_rounds} rounds")
        hashed = lambda c: F.xxhash64(F.lit(len(moves)), F.col(c))  # noqa: E731, B023
        both = live.select("u", "v").unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("id")).agg(F.min(F.struct(hashed("v").alias("h"), "v")).alias("near"))
        own = F.struct(hashed("id").alias("h"), F.col("id").alias("v"))
        move, _ = stored(least.select("id", F.least("near", own)["v"].alias("to")), "components-moves")
        moves.append(move)
        a, b = (move.select(F.col("id").alias(x), F.col("to").alias(f"to_{x}")) for x in "uv")
        met = live.join(a, "u").join(b, "v").where("to_u <> to_v")
        live, n = stored(met.select(F.least("to_u", "to_v").alias("u"), F.greatest("to_u", "to_v").alias("v")).distinct(), "components-edges")
    ids = whole.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    if not moves:
        return ids.withColumn("component", F.col("id"))
    placed = moves.pop()
    while moves:
        later = placed.select(F.col("id").alias("to"), F.col("to").alias("root"))
        placed = moves.pop().join(later, "to", "left").select("id", F.coalesce("root", "to").alias("to"))
    placed = ids.join(placed, "id", "left").select("id", F.coalesce("to", "id").alias("root"))
    placed, _ = stored(placed, "components-roots")
    named = placed.groupBy("root").agg(F.min("id").alias("component"))
    return placed.join(named, "root").select("id", "component")
