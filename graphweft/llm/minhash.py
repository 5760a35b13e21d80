"""MinHash near-duplicate detection: one-permutation hashing with optimal densification.

1. Each document becomes the set of its word shingles, held as 64-bit hashes.
   Documents with equal sets form a class; one document stands for it.
2. One permutation splits the hash range into ``bands * rows`` bins; the least
   hash of each bin is kept and an empty bin borrows from the first occupied bin
   of its own fixed pseudo-random probing order (optimal densification).
3. ``rows`` bins make a band. Classes that agree on a band share a bucket, and a
   bucket gives star-shaped candidates: each member with the bucket's hub, so a
   bucket of n members gives n - 1 pairs.
4. Pairs are confirmed on the full sets, in exact integer arithmetic.
5. A link may have been missed because both its ends were compared with a third
   text only; then their bucket spans several components. The members of all
   such buckets, of any size, are joined by an exact prefix filter: linked sets
   share one of their rarest shingles, at places in the order of rarity from
   which the needed overlap can still be reached. Of each shingle only pairs
   across components are made: the rows outside its largest component, dealt to
   parts, meet the others.

At 32 bands of 4 rows a pair at similarity 0.8 shares no bucket with
probability 5e-8. No link inside a bucket of any size is lost.

Null, empty and blank texts have no shingles, are linked with nothing and make
components of their own. Repeated rows of a doc_id give one row. Ties go to the
smaller doc_id. Of a doc_id with several texts the one with the most shingles
counts (then the one with the larger hash of its set). A null doc_id is dropped,
as it can't name a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import WordHasher, checkpointed, mix64, small, space_words, staged, tidy

BANDS, ROWS = 32, 4
#: Rows of a shingle for each of the parts that its pairs are dealt to.
HOT = 500
_STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def shingle_set(hasher: WordHasher, text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words."""
    words = space_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = hasher(words)
    n = max(1, len(h) - size + 1)
    total = np.full(n, len(h) if len(h) < size else size, np.uint64)
    for k in range(min(size, len(h))):
        total = mix64(total * np.uint64(_STEPS[k % 5] + 2 * (k // 5)) + h[k : k + n])
    return np.unique(total)


def probing_orders(bins: int) -> np.ndarray:
    """For each bin the order in which it looks for an occupied bin, itself first."""
    rng = np.random.default_rng(7)
    orders = np.array([rng.permutation(bins) for _ in range(bins)])
    for i, order in enumerate(orders):
        at = int(np.flatnonzero(order == i)[0])
        order[0], order[at] = order[at], order[0]
    return orders


def signature(hashes: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a non-empty sorted set."""
    bins = len(orders)
    shuffled = np.sort(mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)))
    owner = (shuffled >> np.uint64(64 - (bins - 1).bit_length())).astype(np.int64) % bins
    occupied, first = np.unique(owner, return_index=True)
    least = np.zeros(bins, np.uint64)
    least[occupied] = shuffled[first]
    if len(occupied) < bins:
        has = np.zeros(bins, bool)
        has[occupied] = True
        empty = np.flatnonzero(~has)
        found = orders[empty]
        least[empty] = least[found[np.arange(len(empty)), has[found].argmax(axis=1)]]
    return least


def band_hashes(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = least.reshape(bands, rows)
    total = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        total = mix64(total * np.uint64(_STEPS[1]) + parts[:, k])
    return total.view(np.int64)


def _key(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set."""
    with np.errstate(over="ignore"):
        return int(np.bitwise_xor.reduce(mix64(s)).view(np.int64)), int(np.add.reduce(mix64(s ^ np.uint64(_STEPS[2]))).view(np.int64))


def _signatures(size: int, bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, orders = WordHasher(), probing_orders(bands * rows)
        for batch in batches:
            n, keys, found = [], [], []
            for text in batch["text"]:
                s = shingle_set(hasher, text, size)
                n.append(len(s))
                keys.append(_key(s) if len(s) else (0, 0))
                found.append(band_hashes(signature(s, orders), bands, rows) if len(s) else None)
            low, high = zip(*keys, strict=True) if keys else ((), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": n, "set_low": low, "set_high": high, "bands": found})

    return run


def _sets(size: int):
    """The sets of the rows whose set is the one asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for batch in batches:
            sets = [shingle_set(hasher, t, size) for t in batch["text"]]
            right = [len(s) == n and _key(s) == (low, high) for s, n, low, high in zip(sets, batch["n"], batch["set_low"], batch["set_high"], strict=True)]
            yield pd.DataFrame({"id": batch["doc_id"], "hashes": [s.view(np.int64) for s in sets]})[right]

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    left, right = (sets.select(F.col("id").alias(x), F.col("hashes").alias(f"_{x}")) for x in "ab")
    both = F.size(F.array_intersect("_a", "_b"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("_both", both)
        .where(100 * F.col("_both") >= percent * (F.size("_a") + F.size("_b") - F.col("_both")))
        .select("a", "b")
    )


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per doc_id: n_shingles, component_id (smallest linked doc_id), kept."""
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    signed = staged(
        rows_in.mapInPandas(tidy(_signatures(shingle, bands, rows)), "doc_id long, n_shingles long, set_low long, set_high long, bands array<long>"),
        "minhash",
    )
    key = ["n_shingles", "set_low", "set_high"]
    several = signed.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("_least"), F.max(F.struct(*key)).alias("_best")).where("_least <> _best")
    several = small(checkpointed(several.select("doc_id", "_best")))
    signed = signed.join(several, "doc_id", "left").where(F.col("_best").isNull() | (F.struct(*key) == F.col("_best"))).drop("_best")
    # the least doc_id of each class and its bands, combined before the shuffle: a class may hold a third of all rows
    least = F.min(F.struct("doc_id", "bands")).alias("least")
    reps = checkpointed(signed.where("n_shingles > 0").groupBy(*key).agg(least).select(*key, F.col("least.doc_id").alias("rep"), F.col("least.bands").alias("bands")))
    members = reps.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1")
    # sizes further apart than the similarity can't reach it
    near = (100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")) & (F.col("rep") != F.col("hub.rep"))
    buckets = checkpointed(members.join(shared, "bucket").select("bucket", "rep", "n", "hub"))
    pairs = checkpointed(buckets.where(near).select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct())
    wanted = buckets.select("rep").distinct().join(reps.select("rep", *key), "rep").select(F.col("rep").alias("doc_id"), F.col("n_shingles").alias("n"), "set_low", "set_high")
    sets = rows_in.join(small(checkpointed(wanted)), "doc_id").mapInPandas(tidy(_sets(shingle)), "id long, hashes array<long>")
    sets = staged(sets.dropDuplicates(["id"]), "minhash-sets")
    links = checkpointed(_confirmed(pairs, sets, percent))
    components = connected_components(links, "a", "b")
    mixed = checkpointed(_mixed(buckets, components))
    more = checkpointed(_prefix_pairs(mixed, sets, percent).join(pairs, ["a", "b"], "left_anti"))
    # the links across components, between the components' own ids
    label = components.select(F.col("id"), "component")
    found = _confirmed(more, sets, percent)
    for end in "ab":
        found = found.join(label.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    merged = connected_components(found, "a", "b").select(F.col("id").alias("component"), F.col("component").alias("_root"))
    rep_of = (
        signed.where("n_shingles > 0")
        .join(reps.select(*key, "rep"), key)
        .select("doc_id", "n_shingles", "rep")
        .join(label.withColumnRenamed("id", "rep"), "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component"))
        .join(merged, "component", "left")
        .select("doc_id", "n_shingles", F.coalesce("_root", "component").alias("component_id"))
    )
    alone = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return (
        rep_of.unionByName(alone)
        .groupBy("doc_id")
        .agg(F.max(F.struct("n_shingles", "component_id")).alias("x"))
        .select("doc_id", "x.n_shingles", "x.component_id", (F.col("doc_id") == F.col("x.component_id")).alias("kept"))
    )


def _mixed(buckets: DataFrame, components: DataFrame) -> DataFrame:
    """Distinct (rep, n, component) of the members of the buckets that span several components."""
    own = components.select(F.col("id").alias("rep"), "component")
    placed = buckets.join(own, "rep", "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("component"))
    spread = placed.groupBy("bucket").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high").select("bucket")
    return placed.join(spread, "bucket").select("rep", "n", "component").distinct()


def _prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of ``members`` (rep, n, component) across components, with all that are linked.

    Shingles are ordered by the number of members that hold them. A linked pair
    shares at least ``need`` of n shingles, so its first shared one is among the
    first n - need + 1 of each; after it no more than the shorter rest can be
    shared. Shingles of one member only come first and pair with nothing.
    """
    held = members.join(sets.withColumnRenamed("id", "rep"), "rep").select("rep", "n", "component", F.explode("hashes").alias("h"))
    common = held.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    mine = held.join(common, "h").groupBy("rep", "n", "component").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("common"))
    own = F.col("n") - F.size("common")
    first = F.expr(f"n * {100 - percent} div 100") + 1 - own
    cut = mine.withColumns({"own": own, "first": first.cast("int")}).where("first > 0")
    placed = cut.select("rep", "n", "component", "own", F.posexplode(F.slice("common", F.lit(1), F.col("first"))).alias("at", "x"))
    placed = checkpointed(placed.select("rep", "n", "component", F.col("x.h").alias("h"), (F.col("n") - F.col("own") - F.col("at") - 1).alias("rest")))
    # each shingle's largest component, and the rows outside it
    counted = placed.groupBy("h", "component").agg(F.count(F.lit(1)).alias("k"))
    most = counted.groupBy("h").agg(F.max(F.struct("k", "component")).alias("most"), F.sum("k").alias("k")).where(F.col("k") > F.col("most.k"))
    parts = F.ceil((F.col("k") - F.col("most.k")) / HOT).cast("long").alias("parts")
    placed = checkpointed(placed.join(most.select("h", F.col("most.component").alias("largest"), parts), "h"))
    left = placed.where(F.col("component") != F.col("largest")).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))).drop("parts", "largest")
    right = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    right = right.select("h", "part", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("component").alias("component2"), F.col("rest").alias("rest2"), (F.col("component") == F.col("largest")).alias("in_largest"))
    near = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    enough = (100 + percent) * (1 + F.least("rest", "rest2")) >= percent * (F.col("n") + F.col("n2"))
    once = F.col("in_largest") | (F.col("rep") < F.col("rep2"))
    both = left.join(right, ["h", "part"]).where((F.col("component") != F.col("component2")) & once & near & enough)
    return both.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()


def near_duplicate_filter(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, with the columns of ``docs``.

    Rows that share a doc_id count as one document and stay or go together. Rows
    with a null doc_id aren't compared and stay.
    """
    gone = checkpointed(near_duplicates(docs, **options).where("not kept").select("doc_id"))
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
