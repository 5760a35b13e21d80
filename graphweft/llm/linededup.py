"""Line dedup by overlapping windows of three lines. DataFrame functions only.

Lines are the ``\\n``-separated parts of a text, compared without outer white
space; blank ones take no part. Every three consecutive lines of a document
make a window, told by a 128-bit hash. Of a window that comes more than once,
anywhere in the table, the first place by (doc_id, line number) stays; later
places are removed, and overlapping places merge, as each line is covered once.

Only windows are shuffled to their hash, and minima are combined before that;
a window that a third of all documents share makes one row for each task. The
join back splits hot hashes by Spark's skew handling.

Null and empty texts have no lines to remove and keep the empty text. A text of
fewer than three lines has no window. Rows that share a doc_id count as one
document, so a repeated row removes nothing from its twin; rows with a null
doc_id are left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, let

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _bare(text: Column) -> Column:
    return F.filter(F.transform(_lines(text), lambda x: F.btrim(x, F.lit(WHITESPACE))), lambda x: x != "")


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, at, h1, h2): each window of three non-blank lines, ``at`` counting these lines from 0."""

    def hashed(x: Column) -> Column:
        parts = lambda i: [F.get(x, i + k) for k in range(WINDOW)]
        return F.when(
            F.size(x) >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size(x) - WINDOW),
                lambda i: F.struct(i.alias("at"), F.xxhash64(*parts(i)).alias("h1"), F.xxhash64(F.lit(1), *parts(i)[::-1]).alias("h2")),
            ),
        )

    return docs.where("doc_id is not null").select("doc_id", F.inline(let(_bare(F.col("text")), hashed)))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, gone): the sorted numbers, among non-blank lines, of the lines to remove."""
    found = windows(docs)
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = found.join(first, ["h1", "h2"]).where(F.struct("doc_id", "at") > F.col("first"))
    return (
        later.groupBy("doc_id")
        .agg(F.collect_set("at").alias("starts"))
        .select("doc_id", F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda i: F.sequence(i, i + WINDOW - 1))))).alias("gone"))
    )


def _kept(text: Column, gone: Column) -> Column:
    """The lines that stay. ``gone`` numbers non-blank lines, so they are numbered first and blank ones rejoin by place."""
    numbered = F.transform(_lines(text), lambda x, i: F.struct(i.alias("i"), (F.btrim(x, F.lit(WHITESPACE)) != "").alias("full"), x.alias("x")))

    def stay(lines: Column) -> Column:
        places = F.transform(F.filter(lines, lambda e: e["full"]), lambda e: e["i"])
        drop = let(places, lambda p: F.transform(gone, lambda k: F.get(p, k)))
        spans = let(drop, lambda d: F.transform(F.array_except(F.transform(lines, lambda e: e["i"]), d), lambda i: F.get(lines, i)["x"]))
        return spans

    return F.when(gone.isNull(), _lines(text)).otherwise(let(numbered, stay))


def line_deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_kept`` (the lines that stay) and ``_n_lines``."""
    gone = removed_lines(docs)
    joined = docs.join(gone, "doc_id", "left")
    return joined.withColumns({"_kept": _kept(F.col("text"), F.col("gone")), "_n_lines": F.size(_lines(F.col("text")))}).drop("gone")


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of the lines that stay, joined by ``\\n``."""
    kept = line_deduplicated(docs.select("doc_id", "text"))
    return kept.select(
        "doc_id",
        F.col("_n_lines").cast("long").alias("n_lines"),
        (F.col("_n_lines") - F.size("_kept")).cast("long").alias("n_removed"),
        F.sha2(F.array_join("_kept", "\n"), 256).alias("kept_sha256"),
    )


def line_filter(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; null texts stay null. Columns of any other names are kept as they are."""
    kept = line_deduplicated(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_doc")))
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n"))
    return kept.select(*[text.alias("text") if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns])
