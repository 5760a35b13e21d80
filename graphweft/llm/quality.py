"""Quality rules with risk-controlled thresholds. DataFrame functions only.

Rules reject a document when a ratio exceeds a cutoff. The cutoffs come from a
labelled holdout. All rules together are tightened along one path that is fixed
beforehand, from no rule at all, one cutoff a step, lenient to strict. A step is
certified in a stratum when an exact binomial test rejects "the rules as tight as
this reject more than ``risk`` of the good documents". Inside a stratum the steps
are tested in their order and testing stops at the first failure, which needs no
correction; the strata share ``delta``, so with a chance of at least 1 - ``delta``
no stratum loses more than ``risk`` of its good documents. Among certified steps
the one that rejects most bad documents, each good one weighing ``good_weight``
bad ones, is used, or none if nothing is gained. As every rule's part is in the
one test, ln(delta / strata) / ln(1 - risk) good rows suffice to begin.

Along the path a document is rejected from some step on, so a stratum's labels are
counted by that step alone.

Null text has no words. Empty tables give empty results; a row whose stratum
has no labels is judged by the base rules alone; repeated rows are judged each
for itself. Columns of the input that clash with ours are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, let, staged

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Candidate cutoffs of each rule, lenient to strict.
GRIDS = {
    "symbol_ratio": (1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "dup_line_ratio": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeat_ratio": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2),
    "upper_ratio": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2),
    "mark_ratio": (1.5, 1.0, 0.75, 0.5, 0.3, 0.2),
}
#: The path: (rule, cutoff) in the order in which cutoffs are tightened, all rules' first ones first.
PATH = tuple((r, g[k]) for k in range(max(map(len, GRIDS.values()))) for r, g in GRIDS.items() if k < len(g))


def _removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITESPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def _covered(hashes: Column) -> Column:
    """Words in windows of three whose hash comes twice or more in the array."""
    ordered = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    starts = let(
        ordered,
        lambda s: F.transform(
            F.filter(
                s,
                lambda e, i: ((i > 0) & (F.get(s, i - 1)["x"] == e["x"])) | (F.coalesce(F.get(s, i + 1)["x"] == e["x"], F.lit(False))),
            ),
            lambda e: e["i"],
        ),
    )
    return F.aggregate(
        F.array_sort(starts),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def _word_counts(text: Column) -> Column:
    """struct(n_words, n_repeat_words). Windows are told apart by a 64-bit hash within one text."""

    def counted(w: Column) -> Column:
        hashes = F.when(
            F.size(w) >= 3,
            F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
        ).otherwise(F.array().cast("array<bigint>"))
        repeated = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated.cast("long").alias("n_repeat_words"))

    return let(_words(text), counted)


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` with one struct column ``_f`` of counts, ratios and the base verdict."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WHITESPACE)) != "")
    base = docs.withColumn(
        "_f",
        F.struct(
            _word_counts(text).alias("words"),
            _removed(text, WHITESPACE).alias("_spaces"),
            F.length(text).alias("n_chars"),
            _removed(text, SYMBOLS).alias("n_symbols"),
            _removed(text, UPPER).alias("n_upper"),
            _removed(text, "!").alias("n_marks"),
            let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        ),
    )
    f = F.col("_f")
    n, chars = f["words"]["n_words"], f["n_chars"] - f["_spaces"]
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return base.withColumn(
        "_f",
        F.struct(
            n.alias("n_words"),
            chars.cast("long").alias("word_chars"),
            f["n_symbols"].cast("long").alias("n_symbols"),
            f["lines"]["dup"].cast("long").alias("n_dup_lines"),
            f["words"]["n_repeat_words"].alias("n_repeat_words"),
            ((n < 50) | (100 * f["words"]["n_repeat_words"] > 50 * n)).alias("base_failed"),
            ratio(f["n_symbols"], n).alias("symbol_ratio"),
            ratio(f["lines"]["dup"], f["lines"]["n"]).alias("dup_line_ratio"),
            ratio(f["words"]["n_repeat_words"], n).alias("repeat_ratio"),
            ratio(f["n_upper"], chars).alias("upper_ratio"),
            ratio(f["n_marks"], n).alias("mark_ratio"),
        ),
    )


def _binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    """P(Binomial(n, p) <= k), summed exactly in logs from the term of 0 upwards."""
    odds = F.log(p / (1 - p))
    return F.aggregate(
        F.sequence(F.lit(0).cast("long"), k),
        F.struct((n * F.log(1 - p)).alias("term"), F.lit(0.0).alias("total")),
        lambda acc, i: F.struct(
            (acc["term"] + F.when(i < n, F.log((n - i).cast("double") / (i + 1)) + odds).otherwise(F.lit(0.0))).alias("term"),
            (acc["total"] + F.exp(acc["term"])).alias("total"),
        ),
        lambda acc: acc["total"],
    )


def first_step(at=F.col) -> Column:
    """The first step, from 1, at which the path rejects a document with these ratios; null if none does."""
    return F.coalesce(*[F.when(at(r) > c, F.lit(i + 1)) for i, (r, c) in enumerate(PATH)])


def thresholds(features: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, good_weight: float = 20.0) -> DataFrame:
    """Rows (stratum, step, n_good, good_lost, bad_caught): the chosen step of each stratum with a certified one.

    ``features``: doc_id, stratum, ratios. ``labels``: doc_id, quality 0 or 1; other labels are not used.
    """
    marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counted = (
        features.where(~F.col("base_failed"))
        .join(marks, "doc_id")
        .groupBy("stratum", first_step().alias("first"))
        .agg(F.sum(F.col("quality").cast("long")).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    )
    # at most len(PATH) + 1 rows a stratum from here on
    reached = F.coalesce(F.col("first") <= F.col("step"), F.lit(False))
    tried = (
        counted.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(PATH)))))
        .groupBy("stratum", "step")
        .agg(F.sum("good").alias("n_good"), F.sum(F.when(reached, F.col("good")).otherwise(0)).alias("good_lost"), F.sum(F.when(reached, F.col("bad")).otherwise(0)).alias("bad_caught"))
    )
    strata = tried.select("stratum").distinct().agg(F.count("*").alias("n_strata")).withColumn("_one", F.lit(0))
    tested = (
        tried.withColumn("_one", F.lit(0))
        .join(F.broadcast(strata), "_one")  # one row
        .withColumn("p_value", _binomial_cdf(F.col("good_lost"), F.col("n_good"), F.lit(risk)))
        .withColumn("passed", (F.col("n_good") > 0) & (F.col("p_value") <= F.lit(delta) / F.col("n_strata")))
    )
    failed = tested.where(~F.col("passed")).groupBy("stratum").agg(F.min("step").alias("failed_at"))
    return (
        tested.join(failed, "stratum", "left")
        .where(F.col("step") < F.coalesce("failed_at", F.lit(len(PATH) + 1)))
        .withColumn("gain", F.col("bad_caught") - good_weight * F.col("good_lost"))
        .where("gain > 0")
        .groupBy("stratum")
        .agg(F.max(F.struct("gain", (-F.col("step")).alias("early"), "n_good", "good_lost", "bad_caught")).alias("x"))
        .select("stratum", (-F.col("x.early")).alias("step"), "x.n_good", "x.good_lost", "x.bad_caught")
    )


def cutoffs(step: int) -> dict[str, float]:
    """The cutoff of each rule that has one at a step."""
    return dict(PATH[:step])


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """``docs`` without ``text``, with the features struct ``_f`` and the verdict ``_kept``; texts aren't shuffled."""
    rows = staged(with_features(docs).drop("text"), "quality")
    features = rows.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), "_f.*")
    chosen = thresholds(features, labels, risk, delta).select(F.col("stratum").alias("_stratum"), F.col("step").alias("_step"))
    rejected = F.coalesce(first_step(lambda r: F.col("_f")[r]) <= F.col("_step"), F.lit(False))
    return (
        rows.withColumn("_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
        .join(chosen, "_stratum", "left")
        .withColumn("_kept", ~F.col("_f")["base_failed"] & ~rejected)
        .drop("_stratum", "_step")
    )


def quality_report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, the four base counts, base_failed, kept."""
    docs = docs.select("doc_id", "text", "lang")
    return judged(docs, labels, **options).select(
        "doc_id",
        *[F.col("_f")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")],
        F.col("_kept").alias("kept"),
    )


def quality_filter(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``, whatever their names."""
    own = docs.select("doc_id", "text", F.col(stratum).alias("stratum"), F.struct(*docs.columns).alias("_doc"))
    return judged(own, labels, stratum="stratum", **options).where("_kept").select("_doc.*")
