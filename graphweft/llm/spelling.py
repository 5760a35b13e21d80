"""Spelling variants: words one edit apart, found by walking a relational trie.

Words are the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased. In every
(doc_id, run) pair whose CRC-32 is a multiple of 199 one code point is deleted, so
that rare misspellings are planted evenly; null texts have no words, and a null
doc_id counts as the empty one there. Words of at least ``min_length`` code points
and ``min_count`` occurrences take part.

The trie is a table of edges (node, ch, child, terminal); a node is the 64-bit hash
of a prefix. States (word, at, node, edits, changed, ch) start at the root and go
down one level a round by a join with the edges of that level:

* without an edit, along the word's own edge; along a smaller one as a replacement;
  or over the word's next code point, which is deleted (of equal ones in a row the last);
* with an edit, along the word's own next edge only.

States that end on a terminal node with their edit made are neighbours. Replacements
by greater code points and insertions are the same pairs seen from the other word, so
each pair comes once. A node has at most 91 edges (the alphabet), so no node's join
grows with the words; the first levels' edges are few and are broadcast once counted.

The walk takes ``levels`` rounds at most. States that are still open then are ended by
one equality join with the words, and words longer than that are compared below it by
one join on their branching prefixes, so that a run of any length costs two joins and
not a round for each code point. Every pair is confirmed on the words themselves.

Ties between forms go to the smallest word in code-point order. Repeated rows count
as often as they come. An empty table gives an empty report.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small, staged

#: The divisor of the hash, and the ratio of a form's count to a word's.
EVERY = 199
RATIO = 5
#: In Latin-1: A-Z become a-z, and what is no letter of the alphabet becomes a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Words, and bytes of text, after which a task's counts are sent on.
_HELD, _HELD_BYTES = 200_000, 128 << 20


def runs(text: str | None) -> list[bytes]:
    """The lower-cased runs of a text, in Latin-1; characters beyond it become ``?``, which is in no run."""
    return (text or "").encode("latin-1", "replace").translate(_LETTERS).split()


def shortened(runs_of_one: list[bytes], doc_id: str) -> dict[bytes, bytes]:
    """The distinct runs of a document that lose a code point, and what is left of them."""
    seed, out = zlib.crc32(f"{doc_id}:".encode()), {}
    for w in set(runs_of_one):
        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), seed)
        if h % EVERY == 0:
            k = h % len(w)
            out[w] = w[:k] + w[k + 1 :]
    return out


def _counts(min_length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[bytes] = Counter()
        read = 0

        def rows() -> pd.DataFrame:
            kept = [(w.decode("latin-1"), n) for w, n in held.items() if n and len(w) >= min_length]
            return pd.DataFrame(kept, columns=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = runs(text)
                held.update(words)
                for w, left in shortened(words, doc_id or "").items():
                    n = words.count(w)
                    held[w] -= n
                    held[left] += n
                read += len(text or "")
                if len(held) > _HELD or read > _HELD_BYTES:
                    yield rows()
                    held, read = Counter(), 0
        yield rows()

    return run


def word_counts(docs: DataFrame, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n) of the words that take part, counted in each task before the shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(_counts(min_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _prefix(n: Column | int) -> Column:
    return F.xxhash64(F.substring("word", F.lit(1), n) if isinstance(n, Column) else F.substring("word", 1, n))


def _char(at: Column) -> Column:
    return F.substring(F.col("word"), at + 1, F.lit(1))


def trie_edges(words: DataFrame, levels: int) -> DataFrame:
    """(level, node, ch, child, terminal): the edges from nodes of the levels 0 to ``levels`` - 1."""
    n = F.length("word")
    steps = words.select("word", F.explode(F.sequence(F.lit(0), F.least(n, F.lit(levels)) - 1)).alias("level"))
    at = F.col("level")
    return steps.groupBy("level", _prefix(at).alias("node"), _char(at).alias("ch"), _prefix(at + 1).alias("child")).agg(F.max(n == at + 1).alias("terminal"))


STATE = ("word", "at", "node", "edits", "changed", "ch")


def _deletions(states: DataFrame) -> DataFrame:
    """States at the same node, over the word's next code point, if it isn't its last; of equal ones in a row only over the last."""
    at = F.col("at")
    here = states.where((F.col("edits") == 0) & (at < F.length("word") - 1) & (_char(at) != _char(at + 1)))
    return here.select("word", (at + 1).alias("at"), "node", F.lit(1).alias("edits"), at.alias("changed"), F.lit("").alias("ch"))


def _target() -> Column:
    """The word that a state with an edit can only end at."""
    at = F.col("changed")
    return F.concat(F.substring(F.col("word"), F.lit(1), at), F.col("ch"), F.substring(F.col("word"), at + 2, F.length("word")))


def _branches(words: DataFrame, levels: int) -> DataFrame:
    """The pairs that differ after their first ``levels`` code points, as (word, target)."""
    n = F.length("word")
    long = words.where(n >= levels).select("word", F.explode(F.sequence(F.lit(levels), n)).alias("at"))
    steps = long.select("word", "at", _prefix(F.col("at")).alias("node"), _char(F.col("at")).alias("next"))
    # at most one for each character of the alphabet, and the empty one where a word ends
    nodes = steps.groupBy("node").agg(F.collect_set("next").alias("edges")).where(F.size("edges") > 1)
    met = steps.join(nodes, "node").withColumnRenamed("at", "changed")
    inside = met.where("next <> ''")
    swaps = inside.select("word", "changed", F.explode(F.filter("edges", lambda c: (c != "") & (c < F.col("next")))).alias("ch"))
    gone = inside.where(_char(F.col("changed")) != _char(F.col("changed") + 1)).select("word", "changed", F.lit("").alias("ch"))
    return swaps.unionByName(gone).select("word", _target().alias("target"))


def neighbours(words: DataFrame, levels: int = 48) -> DataFrame:
    """(a, b): all pairs of distinct ``words`` that are one inserted, deleted or replaced code point apart, once each.

    ``words`` has one row a word.
    """
    words = checkpointed(words.select("word"))
    longest = words.agg(F.max(F.length("word")).alias("n")).first()["n"] or 0
    rounds = min(levels, longest)
    edges = checkpointed(trie_edges(words, rounds)) if rounds else None
    root = F.xxhash64(F.lit(""))
    states = words.select("word", F.lit(0).alias("at"), root.alias("node"), F.lit(0).alias("edits"), F.lit(0).alias("changed"), F.lit("").alias("ch"))
    ends = []
    for level in range(rounds):
        below = small(edges.where(F.col("level") == level).select("node", F.col("ch").alias("edge"), "child", "terminal"))
        met = states.unionByName(_deletions(states)).join(below, "node")
        at, own = F.col("at"), _char(F.col("at"))
        fresh = F.col("edits") == 0
        swap = fresh & (F.col("edge") < own)
        moved = met.where((F.col("edge") == own) | swap).select(
            "word",
            (at + 1).alias("at"),
            F.col("child").alias("node"),
            F.when(swap, 1).otherwise(F.col("edits")).alias("edits"),
            F.when(swap, at).otherwise(F.col("changed")).alias("changed"),
            F.when(swap, F.col("edge")).otherwise(F.col("ch")).alias("ch"),
            "terminal",
        )
        moved = staged(moved, "trie-states")
        left = F.length("word") - F.col("at")
        ends.append(moved.where((F.col("edits") == 1) & (left == 0) & F.col("terminal")).select("word", _target().alias("target")))
        # the node before a word's last code point ends a word too: that one is deleted
        ends.append(moved.where((F.col("edits") == 0) & (left == 1) & F.col("terminal")).select("word", F.substring(F.col("word"), F.lit(1), F.length("word") - 1).alias("target")))
        states = moved.where(left > 0).select(*STATE)
    if not rounds:
        return words.select(F.col("word").alias("a"), F.col("word").alias("b")).limit(0)
    if longest > rounds:
        # open states can only end at one word each; words that agree so far are compared below
        ends += [states.where("edits = 1").select("word", _target().alias("target")), _branches(words, rounds)]
    found = reduce(DataFrame.unionByName, ends)
    return (
        found.distinct()
        .join(words.withColumnRenamed("word", "target"), "target")
        .where(F.levenshtein("word", "target", 1) == 1)
        .select(F.col("word").alias("a"), F.col("target").alias("b"))
    )


def variant_groups(counted: DataFrame, pairs: DataFrame) -> DataFrame:
    """``counted`` (word, n) with form, form_n, n_near and root; ``pairs`` (a, b) has each pair of near words once."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = counted.select(F.col("word").alias("b"), F.col("n").alias("m"))
    # the most frequent, then the smallest: sums and minima, combined before the shuffle
    near = both.join(other, "b").groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "b")).alias("best"))
    far = F.coalesce(-F.col("best.less") >= RATIO * F.col("n"), F.lit(False))
    known = counted.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best.b")).alias("form"), F.when(far, -F.col("best.less")).alias("form_n")
    )
    known = staged(known, "spelling-forms")
    return known.join(small(_roots(known)), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(known: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form. A form is more frequent by ``RATIO`` each time, so there are no
    rings, and the rounds grow with the logarithm of the chains' length."""
    now = checkpointed(known.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = small(now.select(F.col("word").alias("root"), F.col("root").alias("_next")))
        jumped = checkpointed(now.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        now = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, levels: int = 48) -> DataFrame:
    """One row a word: word, form (null without), root, n, n_near, form_n."""
    counted = checkpointed(word_counts(docs, min_length, min_count))
    return variant_groups(counted, neighbours(counted, levels))
