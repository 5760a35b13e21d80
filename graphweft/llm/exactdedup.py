"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical after deleting white space
``[\\x20\\x09-\\x0D]``. Three steps, each on the survivors of the one before:

1. The scan gives each row a narrow key: the code points of its normalised text
   and of the original one, and a hash of the first 64 normalised ones. Rows whose
   length no other row has are unique.
2. The others are grouped by (length, prefix hash); rows alone there are unique.
3. Only rows that survive both are read again in full, and grouped by the SHA-256
   of the normalised text. Which rows to hash is told by their key: a broadcast of
   the surviving keys if these were counted to be few; else every row is hashed in
   the scan, as then most of them survive. A text is never shuffled.

Groups are counted before the shuffle, so a group that holds a third of all rows
makes one row a task; the join that gives rows their group splits hot groups by
adaptive skew handling.

Null counts as the empty text; empty and blank texts are equal to each other. Of a
group the row with the most code points in its original text stays, then the one
with the smallest doc_id, null last. Rows that repeat a doc_id are rows of their
own; of rows equal in doc_id and length any one stays, but only one. An empty
table gives an empty report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small, staged

PREFIX = 64
#: Keys that are broadcast at most, of 16 bytes each.
KEYS = 500_000


def normalised(text: Column) -> Column:
    """``text`` without white space, null as the empty text."""
    bare = F.coalesce(text.cast("string"), F.lit(""))
    for x in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        bare = F.replace(bare, F.lit(x), F.lit(""))
    return bare


def _keyed(docs: DataFrame) -> DataFrame:
    bare = normalised(F.col("text"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("n_chars"),
        F.length(bare).alias("n"),
        F.xxhash64(F.substring(bare, 1, PREFIX)).alias("prefix"),
        bare.alias("_bare"),
    )


def surviving_keys(docs: DataFrame) -> DataFrame:
    """(n, prefix) that more than one row has, found among the lengths that more than one row has."""
    keys = staged(_keyed(docs).groupBy("n", "prefix").agg(F.count(F.lit(1)).alias("k")), "exact-keys")
    lengths = keys.groupBy("n").agg(F.sum("k").alias("rows")).where("rows > 1").select("n")
    return keys.join(small(lengths), "n", "left_semi").where("k > 1").select("n", "prefix")


def hashed_rows(docs: DataFrame, digests: bool = False) -> DataFrame:
    """(doc_id, n_chars, sha256, row) of all rows; the hash is null where length or prefix already tell a row apart.

    ``row`` numbers the rows. With ``digests`` also ``text_sha256`` of every row, for callers that show them.
    """
    keys = checkpointed(surviving_keys(docs))
    rows = _keyed(docs)
    survives = F.lit(True)
    if keys.limit(KEYS + 1).count() <= KEYS:
        rows = rows.join(F.broadcast(keys.withColumn("_again", F.lit(True))), ["n", "prefix"], "left")
        survives = F.col("_again").isNotNull()
    digest = F.sha2(F.encode("_bare", "UTF-8"), 256)
    shown = [digest.alias("text_sha256")] if digests else []
    return staged(rows.select("doc_id", "n_chars", F.when(survives, digest).alias("sha256"), *shown, F.monotonically_increasing_id().alias("row")), "exact")


def grouped(rows: DataFrame) -> DataFrame:
    """``hashed_rows`` with keep_id, group_size and kept."""
    order = F.struct((-F.col("n_chars")).alias("longest"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    groups = (
        rows.where("sha256 is not null")
        .groupBy("sha256")
        .agg(F.count(F.lit(1)).alias("_size"), F.min(order).alias("_first"))
        .where("_size > 1")
        .withColumnRenamed("sha256", "_sha")
    )
    # rows without a hash each go their own way, so that they don't meet in one task of an outer join
    marked = rows.withColumn("_key", F.coalesce("sha256", F.col("row").cast("string")))
    found = marked.join(groups, F.col("_key") == F.col("_sha"), "left")
    single = F.col("_sha").isNull()
    return found.withColumns({
        "keep_id": F.when(single, F.col("doc_id")).otherwise(F.col("_first.doc_id")),
        "group_size": F.coalesce("_size", F.lit(1)).cast("long"),
        "kept": single | (F.col("row") == F.col("_first.row")),
    }).drop("_key", "_sha", "_size", "_first")


def exact_report(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 of the normalised text."""
    return grouped(hashed_rows(docs, digests=True)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def exact_duplicate_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns, whatever their names.

    Rows to drop are told by doc_id, length and hash; where a row that stays has the same
    three, as a repeated row does, one of these rows is taken by an aggregate over them alone.
    """
    def identity(x: str) -> list[Column]:
        return [F.col(f"{x}doc_id").isNull().alias("_no_id"), F.coalesce(f"{x}doc_id", F.lit(0)).cast("long").alias("_id")]

    key = ["_no_id", "_id", "_n_chars", "_sha"]
    judged = grouped(hashed_rows(docs)).where("group_size > 1").select(*identity(""), F.col("n_chars").alias("_n_chars"), F.col("sha256").alias("_sha"), "kept")
    drop = judged.groupBy(*key).agg(F.max("kept").alias("_one"), F.count_if(~F.col("kept")).alias("_gone")).where("_gone > 0").drop("_gone")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.struct(*docs.columns).alias("_doc"), *identity(""), F.length(text).alias("_n_chars"), F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256).alias("_sha"))
    marked = own.join(small(checkpointed(drop)), key, "left")
    stay = marked.where("_one is null").select("_doc")
    one = marked.where("_one").groupBy(*key).agg(F.any_value("_doc").alias("_doc")).select("_doc")
    return stay.unionByName(one).select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
