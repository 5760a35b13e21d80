"""Benchmark decontamination over a distributed positional inverted index.

1. One pass counts the corpus frequency of every term of the items.
2. Each window of ``window`` consecutive item words names its ``probes`` rarest terms.
3. A second pass stores the index, once for all items: shards of documents, in
   each the posting lists (term, documents, positions) of the probe terms.
4. Per shard the list of a window's rarest term, adjusted by the term's offset in
   the item, gives diagonals (document, item, shift). These are intersected with
   the next rarest term's offset-adjusted list, and the survivors with the next.
5. Diagonals that survive exactly are checked word by word against their texts.

A document without a surviving diagonal holds no window, because every window
has all its rarest terms on its diagonal. Proximity matches come from the same
lists: a document is near an item if, for some window, the rarest term occurs and
each other probe term lies at most ``slop`` words off its place beside it.

Bounds: a shard has at most about ``SHARD_WORDS`` words, or one document, so a
frequent term's list is dealt to many shards. The items stream through the driver
in blocks of ``block_words`` words; the terms to look for are broadcast as a filter
of fixed size, whose false hits meet no item. Only documents with a surviving
diagonal are shuffled.

Null or empty texts have no words: such documents aren't hit, such items never
occur. An item without an item_id is skipped. Repeated rows and rows with a null
doc_id are judged each for itself. Empty tables give empty results or untouched
documents. Clashing column names can't matter, as only doc_id, item_id and text
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, small, staged, tidy

WINDOW = 10
#: Rarest terms of a window whose posting lists are intersected.
PROBES = 3
#: Words that a probe term may be off its place in a proximity match.
SLOP = 2
#: Words that an item has at least to remove a document.
SHORT_ITEM = 5
BLOCK_WORDS = 200_000
SHARD_WORDS, SHARD_DOCS = 1_000_000, 20_000
#: Bits of a term's hash that number its place in a filter of terms.
FILTER_BITS = 23
#: Diagonals that a task holds at once.
HELD = 500_000


def term_hash(word: bytes) -> int:
    """A signed 64-bit hash, never 0."""
    h = xxhash.xxh64_intdigest(word)
    return (h - (1 << 64) if h >> 63 else h) or 1


class Finder:
    """The hashes of words that pass a filter of terms, 0 for others; forgets all when ``limit`` are held."""

    def __init__(self, packed: bytes, limit: int = 200_000):
        self.passes = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)
        self.limit = limit
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for w in set(words).difference(known):
            h = term_hash(w)
            known[w] = h if self.passes[h & ((1 << FILTER_BITS) - 1)] else 0
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def term_filter(terms: Iterator[int]) -> bytes:
    passes = np.zeros(1 << FILTER_BITS, bool)
    for t in terms:
        passes[t & ((1 << FILTER_BITS) - 1)] = True
    return np.packbits(passes).tobytes()


@dataclass
class Block:
    """Items with words: their keys, and the hashes of their words."""

    keys: list[int]
    terms: list[np.ndarray]

    def windows(self, frequency: dict[int, int], window: int, probes: int) -> pd.DataFrame:
        """Distinct rows (item, t0, o0, t1, o1, ...): each window's probe terms and their offsets, rarest first.

        A window of fewer words than probes repeats its last one.
        """
        found = set()
        for key, terms in zip(self.keys, self.terms, strict=True):
            own = terms.tolist()
            seen = [frequency.get(t, 0) for t in own]
            width = min(window, len(own))
            for start in range(len(own) - width + 1):
                order = sorted(range(start, start + width), key=lambda k: (seen[k], k))[:probes]
                order += order[-1:] * (probes - len(order))
                found.add((key, *(x for k in order for x in (own[k], k))))
        columns = ["item", *(f"{c}{r}" for r in range(probes) for c in "to")]
        return pd.DataFrame(sorted(found), columns=columns, dtype=np.int64).sort_values(["t0", "item", "o0"], ignore_index=True)


def _items(benchmark: DataFrame) -> DataFrame:
    """item (a key), item_id, text of the rows that can occur."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.where("item_id is not null and text is not null").select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").dropDuplicates(["item"])


def blocks_of(items: DataFrame, block_words: int) -> Iterator[Block]:
    """The query set in blocks; each holds at most ``block_words`` words, or one longer item."""
    held, size = Block([], []), 0
    for row in items.toLocalIterator():
        words = alnum_words(row["text"])
        if not words:
            continue
        if size and size + len(words) > block_words:
            yield held
            held, size = Block([], []), 0
        held.keys.append(row["item"])
        held.terms.append(np.array([term_hash(w) for w in words], np.int64))
        size += len(words)
    if size:
        yield held


def term_frequencies(docs: DataFrame, packed: bytes) -> DataFrame:
    """(term, n): occurrences over all documents of the terms that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, held = Finder(shared.value), []
        total = pd.Series(dtype=np.int64)

        def added() -> pd.Series:
            terms, n = np.unique(np.concatenate([*held, np.zeros(0, np.int64)]), return_counts=True)
            return total.add(pd.Series(n[terms != 0], terms[terms != 0]), fill_value=0).astype(np.int64)

        size = 0
        for batch in batches:
            for text in batch["text"]:
                held.append(find(alnum_words(text)))
                size += len(held[-1])
                if size > 500_000:
                    total, held, size = added(), [], 0
        total = added()
        yield pd.DataFrame({"term": total.index.to_numpy(np.int64), "n": total.to_numpy(np.int64)})

    return staged(docs.select("text").mapInPandas(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")), "term-frequencies")


INDEX = "ids array<long>, no_id array<boolean>, row_keys array<long>, n_words array<int>, terms array<long>, starts array<int>, documents array<int>, positions array<int>"


def positional_index(docs: DataFrame, packed: bytes) -> DataFrame:
    """Shards of documents (ids, row_keys, n_words) with the posting lists of the terms that pass the filter.

    The list of ``terms[k]`` is ``documents`` (places in ``ids``) and ``positions`` from
    ``starts[k]`` to ``starts[k + 1]``, in ascending order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Finder(shared.value)
        ids, no_id, keys, n_words, terms, positions = [], [], [], [], [], []
        size = 0

        def shard() -> pd.DataFrame:
            document = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in terms])
            term, position = np.concatenate(terms), np.concatenate(positions)
            order = np.argsort(term, kind="stable")
            distinct, starts = np.unique(term[order], return_index=True)
            row = [ids, no_id, keys, n_words, distinct, np.append(starts, len(term)).astype(np.int32), document[order], position[order]]
            return pd.DataFrame({c.split(" ")[0]: [x] for c, x in zip(INDEX.split(", "), row, strict=True)})

        for batch in batches:
            for doc_id, no, key, text in zip(batch["id"], batch["no_id"], batch["row_key"], batch["text"], strict=True):
                found = find(alnum_words(text))
                at = np.flatnonzero(found)
                ids.append(doc_id)
                no_id.append(no)
                keys.append(key)
                n_words.append(len(found))
                terms.append(found[at])
                positions.append(at.astype(np.int32))
                size += len(found)
                if size >= SHARD_WORDS or len(ids) >= SHARD_DOCS:
                    yield shard()
                    ids, no_id, keys, n_words, terms, positions, size = [], [], [], [], [], [], 0
        if ids:
            yield shard()

    return staged(docs.select("id", "no_id", "row_key", "text").mapInPandas(tidy(run), INDEX), "postings")


def intersected(shard, windows: pd.DataFrame, probes: int, slop: int) -> Iterator[pd.DataFrame]:
    """Diagonals (document, item, shift, exact) of one shard on which a window has its probe terms.

    The rarest term lies at ``shift`` + its offset and the others at most ``slop`` words
    off theirs; ``exact`` where they aren't off at all.
    """
    terms, starts = np.asarray(shard.terms), np.asarray(shard.starts, np.int64)
    if not len(terms) or not len(windows):
        return
    width = int(max(shard.n_words))
    document, position = np.asarray(shard.documents, np.int64), np.asarray(shard.positions, np.int64)
    # one ascending key for each posting: its term's number, document and position
    n_docs = len(shard.ids)
    postings = (np.repeat(np.arange(len(terms)), np.diff(starts)) * n_docs + document) * width + position
    numbers = {}
    for r in range(probes):
        wanted = windows[f"t{r}"].to_numpy()
        at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
        numbers[r] = np.where(terms[at] == wanted, at, -1)
    live = np.flatnonzero(np.all([n >= 0 for n in numbers.values()], axis=0))
    if not len(live):
        return
    lengths = np.diff(starts)[numbers[0][live]]
    items = windows["item"].to_numpy()
    offsets = [windows[f"o{r}"].to_numpy() for r in range(probes)]

    def held(number: np.ndarray, doc: np.ndarray, place: np.ndarray, off: int) -> np.ndarray:
        low, high = np.maximum(place - off, 0), np.minimum(place + off, width - 1)
        base = (number * n_docs + doc) * width
        at = np.minimum(np.searchsorted(postings, base + low), len(postings) - 1)
        return (low <= high) & (postings[at] >= base + low) & (postings[at] <= base + high)

    # so many windows at once as make about HELD diagonals; a longer list is cut in parts
    total = np.cumsum(lengths)
    for begin in range(0, int(total[-1]), HELD):
        end = min(begin + HELD, int(total[-1]))
        first, last = np.searchsorted(total, [begin, end - 1], side="right")
        own = live[first : last + 1]
        low = np.maximum(begin - (total[first : last + 1] - lengths[first : last + 1]), 0)
        high = np.minimum(lengths[first : last + 1], end - (total[first : last + 1] - lengths[first : last + 1]))
        n = high - low
        window = np.repeat(own, n)
        rank = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low + starts[numbers[0][own]], n)
        doc, shift = document[rank], position[rank] - offsets[0][window]
        for r in range(1, probes):
            stay = held(numbers[r][window], doc, shift + offsets[r][window], slop)
            window, doc, shift = window[stay], doc[stay], shift[stay]
        exact = np.ones(len(window), bool)
        for r in range(1, probes):
            exact &= held(numbers[r][window], doc, shift + offsets[r][window], 0)
        yield pd.DataFrame({"document": doc, "item": items[window], "shift": shift, "exact": exact}).drop_duplicates()


def diagonals(index: DataFrame, windows: pd.DataFrame, probes: int, slop: int) -> DataFrame:
    """(id, row_key, item, shift, exact) over all shards, for one block's windows."""
    shared = index.sparkSession.sparkContext.broadcast(windows)  # bounded by the block

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch.itertuples(index=False):
                ids, keys = np.asarray(shard.ids), np.asarray(shard.row_keys)
                for found in intersected(shard, shared.value, probes, slop):
                    yield pd.DataFrame({"id": ids[found["document"]], "row_key": keys[found["document"]], "item": found["item"], "shift": found["shift"], "exact": found["exact"]})

    return index.mapInPandas(tidy(run), "id long, row_key long, item long, shift int, exact boolean")


def hit_words(words: list[bytes], own: list[bytes], shifts: list[int], window: int, hit: np.ndarray) -> bool:
    """Mark in ``hit`` (a difference array) the occurrences of an item's windows on the given diagonals."""
    width, any_found = min(window, len(own)), False
    for shift in shifts:
        low, high = max(0, shift), min(len(words), shift + len(own))
        run = 0
        for p in range(low, high + 1):
            if p < high and words[p] == own[p - shift]:
                run += 1
                continue
            if run >= width:
                hit[p - run] += 1
                hit[p] -= 1
                any_found = True
            run = 0
    return any_found


def _marked(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans, found_items = [], []
            for text, found in zip(batch["text"], batch["found"], strict=True):
                words = alnum_words(text)
                hit, having = np.zeros(len(words) + 1, np.int64), set()
                for x in found:
                    if hit_words(words, alnum_words(x["text"]), x["shifts"], window, hit):
                        having.add(x["item_id"])
                covered = np.cumsum(hit[:-1]) > 0
                spans.append(np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))).tolist())
                found_items.append(sorted(having))
            yield pd.DataFrame({"id": batch["id"], "row_key": batch["row_key"], "spans": spans, "items": found_items})

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, probes: int = PROBES, slop: int = SLOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items, items, hit_spans (word ranges, end exclusive), near_items."""
    key = ["id", "row_key"]
    # equal rows share a key, and have equal answers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("row_key"), "text")
    items = staged(_items(benchmark), "items")
    frequencies = term_frequencies(rows, term_filter(int(t) for block in blocks_of(items, block_words) for x in block.terms for t in x))

    def windows() -> Iterator[pd.DataFrame]:
        for block in blocks_of(items, block_words):
            wanted = docs.sparkSession.createDataFrame(pd.DataFrame({"term": np.unique(np.concatenate(block.terms))}))
            near = dict(map(tuple, frequencies.join(F.broadcast(wanted), "term").collect()))  # a row for each term of the block at most
            yield block.windows(near, window, probes)

    index = positional_index(rows, term_filter(int(t) for w in windows() for r in range(probes) for t in w[f"t{r}"].unique()))
    found = index.sparkSession.createDataFrame([], "id long, row_key long, item long, shift int, exact boolean")
    for part in windows():
        found = found.unionByName(diagonals(index, part, probes, slop))
    shifts = F.collect_set(F.when(F.col("exact"), F.col("shift")))
    by_item = found.groupBy(*key, "item").agg(shifts.alias("shifts")).join(items, "item")
    found = staged(by_item.groupBy(*key).agg(F.collect_list(F.struct("item_id", "text", "shifts")).alias("found")), "found")
    exact = found.select(*key, F.filter("found", lambda x: F.size(x["shifts"]) > 0).alias("found")).where(F.size("found") > 0)
    held = rows.join(small(exact.select(*key)), key, "left_semi").dropDuplicates(key)
    marked = held.join(exact, key).mapInPandas(tidy(_marked(window)), "id long, row_key long, spans array<int>, items array<string>")
    near = found.select(*key, F.array_sort(F.array_distinct("found.item_id")).alias("near_items"))
    every = index.select(F.explode(F.arrays_zip("ids", "no_id", "row_keys", "n_words")).alias("x"))
    every = every.select(F.col("x.ids").alias("id"), F.col("x.no_id").alias("no_id"), F.col("x.row_keys").alias("row_key"), F.col("x.n_words").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    names, spans = F.coalesce("items", none), F.coalesce("spans", F.array().cast("array<int>"))
    ends = F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return (
        every.join(near, key, "left")
        .join(marked, key, "left")
        .select(
            F.when(~F.col("no_id"), F.col("id")).alias("doc_id"),
            "n_words",
            F.aggregate(ends, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_hit"),
            F.size(names).cast("long").alias("n_items"),
            F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
            (F.size(spans) > 0).alias("contaminated"),
            F.size(F.coalesce("near_items", none)).cast("long").alias("n_near_items"),
            names.alias("items"),
            spans.alias("hit_spans"),
            F.coalesce("near_items", none).alias("near_items"),
        )
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_item: int = SHORT_ITEM, **options) -> DataFrame:
    """The rows of ``docs`` without the documents that hold a benchmark passage, with the columns of ``docs``.

    Each item decides alone: one full window of it removes a document, or, for an
    item shorter than a window, all its words in a row. Items of fewer than
    ``min_item`` words never remove a document, as such words meet by chance; op1
    reports them all the same. Rows with a null doc_id stay.
    """
    words = F.regexp_count(F.col("text").cast("string"), F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
    deciding = benchmark.where(words >= min_item).select(F.col("item_id").cast("string").alias("item")).distinct()
    held = contamination(docs, benchmark, **options).where("contaminated").select("doc_id", F.explode("items").alias("item"))
    bad = staged(held.join(deciding, "item", "left_semi").select("doc_id").distinct(), "contaminated")
    return docs.join(small(bad), "doc_id", "left_anti").select(*docs.columns)
