"""Mixing to target weights by iterative proportional fitting.

Documents fall into cells by source, language and topic. The token weight of
each cell is raked: in turn, the weights of each margin are scaled so that the
margin's shares equal their targets, until no share is off its target by more
than ``TOLERANCE`` of it. The calibrated factor of a cell, fitted over original
weight, divided by the largest factor, is the probability with which each of its
documents is sampled; so the expected shares of the sample meet the targets. A
document is drawn by a hash of its doc_id, so a run can be repeated and a
retried task draws alike.

Targets are tables of shares, one for each margin. Values without a target have
what the listed ones leave, in proportion to their tokens; shares are scaled to
the values that occur. ``margins`` reports the targets and what was reached; targets that
no weights of the given cells can meet stay off after ``ROUNDS`` rounds.

Only cell totals are shuffled, summed before the shuffle; texts stay where they
are, unless there are more cells than are broadcast. Up to ``one_task`` cells,
counted, are raked in one task; more are raked by joins and aggregates.

Null source or language counts as the empty string, null text as 0 tokens (such
documents have the probability of their cell, 1 where a cell has no tokens, as in
a table of blank texts). Repeated rows share their doc_id's draw; a null doc_id
draws as the empty string. Empty tables give empty results. Clashing columns are
kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, checkpointed, small

MARGINS = ("_source", "_lang", "_topic")
#: Default targets: shares of the tokens of the sample.
TARGETS = {
    "_source": {f"src{i}": 0.05 for i in range(20)},
    "_lang": {"en": 0.5, "de": 0.2, "fr": 0.18, "es": 0.12},
    "_topic": {"prose": 0.9},
}
TOLERANCE, ROUNDS = 1e-12, 200
#: Cells that one task rakes, or that are broadcast, at most.
ONE_TASK = 100_000


def topic_of(text: Column) -> Column:
    """A coarse topic from the whole text's form: legal, table, code-like markup, contact, prose."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.lower(t).rlike("licen[sc]e|copyright"), "legal")
        .when(F.contains(t, F.lit(" | ")), "table")
        .when(F.contains(t, F.lit("@")), "contact")
        .when(F.contains(t, F.lit("\n\n")), "sections")
        .otherwise("prose")
    )


def n_tokens(text: Column) -> Column:
    """Runs of other than white space."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITESPACE))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, "[ \\t-\\r]+"))).cast("long")


def _cells(docs: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.withColumns({"_source": blank("source"), "_lang": blank("lang"), "_topic": topic_of(F.col("text"))})


def targets(cells: DataFrame, margin: str, shares: dict[str, float]) -> DataFrame:
    """Rows (margin, share) of the values that occur; the shares sum to 1, or are all 0 without any tokens."""
    listed = cells.sparkSession.createDataFrame([(v, float(x)) for v, x in shares.items()], f"{margin} string, listed double")
    total = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("tokens")).join(F.broadcast(listed), margin, "left")
    rest = F.sum(F.when(F.col("listed").isNull(), F.col("tokens")))
    whole = total.agg(F.coalesce(rest, F.lit(0.0)).alias("_rest")).withColumn("_k", F.lit(0))  # one row
    left = F.lit(max(0.0, 1.0 - sum(shares.values())))
    share = F.when(F.col("tokens") > 0, F.coalesce("listed", F.try_divide(left * F.col("tokens"), F.col("_rest")), F.lit(0.0))).otherwise(0.0)
    scaled = checkpointed(total.join(F.broadcast(whole), F.lit(0) == F.col("_k")).select(margin, share.alias("share")))
    whole = scaled.agg(F.sum("share").alias("_whole")).withColumn("_k", F.lit(0))  # one row
    return scaled.join(F.broadcast(whole), F.lit(0) == F.col("_k")).select(margin, F.coalesce(F.try_divide("share", "_whole"), F.lit(0.0)).alias("share"))


def _rake(tolerance: float, rounds: int):
    """Rake all cells of one task, ``ONE_TASK`` at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = pd.concat(list(batches), ignore_index=True)
        codes = [pd.factorize(cells[m])[0] for m in MARGINS]
        wanted = [cells[f"{m}_share"].to_numpy(float) for m in MARGINS]
        fitted = cells["tokens"].to_numpy(float)
        for _ in range(rounds):
            for code, share in zip(codes, wanted, strict=True):
                now = np.bincount(code, weights=fitted)[code]
                fitted = np.divide(fitted * share, now, out=np.zeros_like(fitted), where=now > 0)
            off = [np.abs(np.bincount(code, weights=fitted)[code] - share) / np.maximum(share, 1e-300) for code, share in zip(codes, wanted, strict=True)]
            if max((x[cells["tokens"] > 0].max(initial=0.0) for x in off), default=0.0) <= tolerance:
                break
        yield cells[[*MARGINS, "tokens"]].assign(fitted=fitted)

    return run


def raked(cells: DataFrame, shares: dict[str, DataFrame], tolerance: float = TOLERANCE, rounds: int = ROUNDS, one_task: int = ONE_TASK) -> DataFrame:
    """``cells`` (margins, tokens) with ``fitted``: their token shares, raked to the targets (margin, share).

    A margin's value without a target gets 0; one whose cells are all 0 stays 0.
    """
    placed = cells.select(*MARGINS, F.col("tokens").cast("double").alias("tokens"))
    for margin in MARGINS:
        placed = placed.join(shares[margin].select(margin, F.col("share").alias(f"{margin}_share")), margin, "left").fillna({f"{margin}_share": 0.0})
    placed = checkpointed(placed)
    if placed.limit(one_task + 1).count() <= one_task:
        schema = ", ".join([*(f"{m} string" for m in MARGINS), "tokens double, fitted double"])
        return checkpointed(placed.coalesce(1).mapInPandas(_rake(tolerance, rounds), schema)) if not placed.isEmpty() else placed.select(*MARGINS, "tokens", F.lit(0.0).alias("fitted"))
    fitted = placed.withColumn("fitted", F.col("tokens"))
    for _ in range(rounds):
        for margin in MARGINS:
            now = fitted.groupBy(margin).agg(F.sum("fitted").alias("_now"))
            fitted = fitted.join(now, margin).withColumn("fitted", F.coalesce(F.try_divide(F.col("fitted") * F.col(f"{margin}_share"), F.col("_now")), F.lit(0.0))).drop("_now")
        fitted = checkpointed(fitted)
        live = fitted.where("tokens > 0")
        off = [live.groupBy(m).agg((F.abs(F.sum("fitted") - F.max(f"{m}_share")) / F.greatest(F.max(f"{m}_share"), F.lit(1e-300))).alias("off")).agg(F.max("off")).first()[0] for m in MARGINS]
        if max((x or 0.0 for x in off), default=0.0) <= tolerance:
            break
    return fitted.select(*MARGINS, "tokens", "fitted")


def margins(fitted: DataFrame, shares: dict[str, DataFrame]) -> DataFrame:
    """margin, value, tokens, target and reached share of each value of each margin."""
    out = None
    for margin in MARGINS:
        got = fitted.groupBy(margin).agg(F.sum("tokens").alias("tokens"), F.sum("fitted").alias("reached")).join(shares[margin], margin, "left")
        part = got.select(F.lit(margin[1:]).alias("margin"), F.col(margin).alias("value"), "tokens", F.coalesce("share", F.lit(0.0)).alias("target"), "reached")
        out = part if out is None else out.unionByName(part)
    return out


def probabilities(fitted: DataFrame) -> DataFrame:
    factor = fitted.withColumn("_factor", F.try_divide("fitted", "tokens"))
    top = factor.agg(F.max("_factor").alias("_top")).withColumn("_k", F.lit(0))  # one row
    return factor.join(F.broadcast(top), F.lit(0) == F.col("_k")).select(*MARGINS, F.coalesce(F.try_divide("_factor", "_top"), F.lit(1.0)).alias("probability"))


def draw(doc_id: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from the doc_id alone."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def mixed(docs: DataFrame, shares: dict[str, dict[str, float]] | None = None, **options) -> DataFrame:
    """``docs`` with _source, _lang, _topic, ``probability`` and ``sampled``; ``shares``: a table of targets for each margin."""
    placed = _cells(docs)
    cells = checkpointed(placed.groupBy(*MARGINS).agg(F.sum(n_tokens(F.col("text"))).alias("tokens")))
    wanted = {m: targets(cells, m, (shares or TARGETS)[m]) for m in MARGINS}
    chance = checkpointed(probabilities(raked(cells, wanted, **options)))
    joined = placed.join(small(chance, ONE_TASK), list(MARGINS), "left")  # few rows are sent to every task, and texts stay where they are
    return joined.withColumn("sampled", draw(F.col("doc_id")) < F.col("probability"))


def mixture_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability (9 digits), sampled."""
    docs = docs.select("doc_id", "text", "source", "lang")
    return mixed(docs, **options).select(
        "doc_id",
        F.col("_source").alias("source"),
        F.col("_lang").alias("lang"),
        F.col("_topic").alias("topic"),
        n_tokens(F.col("text")).alias("n_tokens"),
        F.round("probability", 9).alias("probability"),
        "sampled",
    )


def mixture_sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``docs``, with the columns of ``docs``."""
    own = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text", "source", "lang")
    return mixed(own, **options).where("sampled").select("_doc.*")
