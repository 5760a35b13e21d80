"""Language-model scores by a hierarchical Pitman-Yor model, seated by Gibbs sampling.

The hierarchy: each word has a restaurant for the words that follow it. All of these
share one parent, the word restaurant: a new table of a context restaurant is a
customer there. A new table there draws its word from the spelling restaurants, a
byte after the last three, two, one and no bytes, each context's restaurant sharing
its parent with others, down to the uniform distribution. All words unknown to the
training tokens are one type, as in the base score: a new table with a spelling
outside the vocabulary.

The seating is sampled in sweeps of blocked Gibbs moves: all customers of one word in
one restaurant are removed and seated anew together, their number of tables drawn
from its conditional given everything else, by generalized Stirling numbers (above
``EXACT`` customers, by sequential seating in blocks that grow with those seated).
In a sweep a word's tables in frequent contexts, then its tables in the word restaurant,
are drawn twice in turn; those restaurants' totals are those of the sweep before, so that
words can be sampled in parallel. The tables of the other contexts are drawn before them,
given the word probabilities of the sweep before. After a sweep the discounts are drawn on a grid from
their conditional, given the tables. Predictive probabilities are averaged over the
sweeps after the burn-in; in each of them the probabilities of all words sum to 1 in
every context, as the totals are those of the same seating.

Scale: documents are kept as packs of word numbers. A pack sends each hash range of
words its distinct words once; ranges hold the vocabulary and answer with places. Then
it sends its distinct pairs. What follows one of the ``contexts`` most frequent words,
whose followers may be any words, goes to the follower's range, which knows those
restaurants by totals that are collected and broadcast. Every other pair goes to the
range of its context, which so holds that restaurant whole. ``contexts`` says where a
restaurant is kept, not whether there is one. In a sweep, the ranges of contexts get
the probabilities of the words that they ask for, and send back their tables of them.
The spelling model has a fixed size: contexts are two or three bytes of which the
older ones are hashed to four values; it alone is collected and broadcast besides.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end a text; the
first follows an end. Null and empty texts have just the end. A null doc_id isn't held
out. Repeated rows count, and are scored, each for itself. Without any training rows N
is 0, base scores follow from V = 0, and the model is the spelling prior alone.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from math import lgamma

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, crc32_of_id, id_text, staged, tidy, utf8

FOLDS, HELD_OUT = 7, 2
PACK_BYTES = 16 << 20
RANGE_BYTES = 16 << 20
#: Most frequent words, whose restaurants are spread over the ranges of what follows them.
CONTEXTS = 1023
#: Values to which an older byte of a context is hashed.
OLDER = 4
#: Spelling levels: restaurants with no, one, two and three bytes of context.
LEVELS = (1, 256, 256 * OLDER, 256 * OLDER * OLDER)
BLANK = 32
BURN_IN, SAMPLES = 2, 2
WORD_STRENGTH, CONTEXT_STRENGTH, SPELL_STRENGTH = 10.0, 5.0, 2.0
#: Customers of a dish up to which its tables are drawn from their exact conditional.
EXACT = 50
DISCOUNTS = tuple(round(0.05 * k, 2) for k in range(1, 20))


def contexts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, symbol, restaurant at the deepest level) of every byte of every word and of its end."""
    lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.int64) if words else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    start = np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.arange(len(data))

    def back(k: int) -> np.ndarray:
        return np.where(at - k >= start, data[np.maximum(at - k, 0)], 0 if k > 1 else BLANK)

    hashed = lambda x: (x * 0x9E3779B1 >> 7) % OLDER
    return owner, data, (back(1) * OLDER + hashed(back(2))) * OLDER + hashed(back(3))


@dataclass
class Spelling:
    """Predictive probabilities of each symbol in each deepest restaurant."""

    predictive: np.ndarray

    @classmethod
    def prior(cls) -> Spelling:
        return cls(np.full((LEVELS[3], 256), 1 / 256, np.float32))

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithm of each word's probability, its end included."""
        out = np.zeros(len(words))
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            owner, symbol, place = contexts(part)
            out[i : i + 50_000] = np.bincount(owner, weights=np.log(self.predictive[place, symbol]), minlength=len(part))
        return out


@lru_cache(maxsize=32)
def stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalized Stirling numbers S(c, t) for c and t up to ``EXACT``."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(EXACT + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, EXACT):
            stay = out[c] + np.log(np.maximum(c - discount * t, 0))
            out[c + 1] = np.logaddexp(np.append(-np.inf, out[c, :-1]), stay)
    return out


def seated(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish, drawn given its customers and the weight of a new table for it."""
    tables = (customers > 0).astype(np.int64)
    logs = stirling(discount)
    few = np.flatnonzero((customers > 1) & (customers <= EXACT))
    few = few[np.argsort(customers[few], kind="stable")]
    counts, starts = np.unique(customers[few], return_index=True)
    for c, rows in zip(counts.tolist(), np.split(few, starts[1:]), strict=True) if len(few) else ():
        t = np.arange(1, c + 1)
        p = logs[c, 1 : c + 1] + t * np.log(np.maximum(weight[rows], 1e-300))[:, None]
        p = np.exp(p - p.max(axis=1, keepdims=True)).cumsum(axis=1)
        tables[rows] = 1 + (rng.random(len(rows))[:, None] * p[:, -1:] > p[:, :-1]).sum(axis=1)
    live = np.flatnonzero(customers > EXACT)
    left, own, w, t = customers[live] - 1, np.ones(len(live), np.int64), weight[live], np.ones(len(live), np.int64)
    while len(live):
        block = np.minimum(np.maximum(1, own // 10), left)
        t += rng.binomial(block, w / (w + np.maximum(own - discount * t, 1e-9)))
        own += block
        left -= block
        done = left == 0
        if done.any():
            tables[live[done]] = t[done]
            stay = ~done
            live, left, own, w, t = live[stay], left[stay], own[stay], w[stay], t[stay]
    return tables


def discount_of(ones: int, twos: int) -> float:
    """The usual estimate from the dishes with one and two customers, on the grid of discounts."""
    raw = ones / (ones + 2 * twos) if ones + twos else 0.5
    return min(DISCOUNTS, key=lambda d: abs(d - raw))


def drawn_discount(histogram: dict[tuple[int, int], float], totals: dict[int, float], strength: float, rng: np.random.Generator) -> float:
    """A discount from its conditional on the grid, given how many dishes have c customers at t tables, and how many restaurants have x tables."""
    logs = []
    for d in DISCOUNTS:
        table = stirling(d)
        # the weights of all tables but the first of each restaurant: strength + d, strength + 2 d, ...
        rising = sum(many * (lgamma(strength / d + x) - lgamma(strength / d + 1) + (x - 1) * np.log(d)) for x, many in totals.items() if x > 1)
        logs.append(rising + sum(n * table[c, t] for (c, t), n in histogram.items()))
    p = np.exp(np.array(logs) - max(logs))
    return float(rng.choice(DISCOUNTS, p=p / p.sum()))


def seat_spelling(counts: np.ndarray, before: Spelling, rng: np.random.Generator) -> Spelling:
    """Seat all symbols from the deepest level up, then make the predictive probabilities from the root down."""
    levels: list[tuple[np.ndarray, np.ndarray, float]] = []
    customers, parent = counts.astype(np.int64), before.predictive.astype(float)
    for depth in (3, 2, 1, 0):
        d = discount_of(int((customers == 1).sum()), int((customers == 2).sum()))
        rows, symbols = np.nonzero(customers)
        c = customers[rows, symbols]
        # the parent's probability is approximated by the last sweep's, averaged over the parent's children
        up = _averaged(parent, depth)
        weight = (SPELL_STRENGTH + d * np.bincount(rows, minlength=len(customers)))[rows] * up[_parent_of(rows, depth), symbols]
        tables = np.zeros_like(customers)
        tables[rows, symbols] = seated(c, weight, d, rng)
        levels.append((customers, tables, d))
        parent = up
        if depth:
            customers = np.zeros((LEVELS[depth - 1], 256), np.int64)
            np.add.at(customers, _parent_of(np.arange(LEVELS[depth]), depth), tables)
    p = np.full((1, 256), 1 / 256)
    for depth, (customers, tables, d) in zip((0, 1, 2, 3), reversed(levels), strict=True):
        up = p if depth == 0 else p[_parent_of(np.arange(LEVELS[depth]), depth)]
        whole, spare = customers.sum(axis=1, keepdims=True), SPELL_STRENGTH + d * tables.sum(axis=1, keepdims=True)
        p = (np.maximum(customers - d * tables, 0) + spare * up) / (SPELL_STRENGTH + whole)
    return Spelling(p.astype(np.float32))


def _parent_of(rows: np.ndarray, depth: int) -> np.ndarray:
    return rows // (OLDER if depth > 1 else 256 if depth == 1 else 1)


def _averaged(p: np.ndarray, depth: int) -> np.ndarray:
    """Probabilities of the level above ``depth``, as means over its children."""
    if depth == 0:
        return np.full((1, 256), 1 / 256)
    return p.reshape(LEVELS[depth - 1], -1, 256).mean(axis=1)


# --- packs and words ---------------------------------------------------------

#: tokens: numbers of the pack's words, which are sorted by range and word; n: training tokens of each word.
PACK = "pack long, ids array<string>, held array<boolean>, sizes array<long>, tokens binary, messages array<struct<range:int, words:binary, n_words:int, n:binary>>"
#: A range's words, sorted, with their training tokens; top: its most frequent; replies: places and training tokens of each pack's words.
VOCABULARY = "range int, words binary, n_words int, counts binary, n long, v long, top array<struct<place:int, n:long>>, replies array<struct<pack:long, places:binary, counts:binary>>"
#: keys: place of a word of the range * (contexts + 1) + frequent context; contexts, followers: place of a context of the range, number of a word of any.
MESSAGE = "range int, pack long, keys binary, n binary, contexts binary, followers binary, m binary"
#: followers: place in ``wanted``, which has the followers by their ranges; maps: where a pack's keys and pairs are.
ENTRIES = "range int, keys binary, n binary, contexts binary, followers binary, m binary, wanted array<struct<range:int, places:binary>>, maps array<struct<pack:long, keys:binary, pairs:binary>>"


def _pressed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpressed(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31), kind)


def _steps(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences."""
    return _pressed(np.diff(keys, prepend=0).astype("<u4" if not len(keys) or int(keys[-1]) < 1 << 32 else "<u8"))


def _squeezed(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b" ".join(words))


def _unsqueezed(data: bytes, n: int) -> list[bytes]:
    """``n`` words; the end is the empty word."""
    return zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31).split(b" ") if n else []


def _climbed(data: bytes, n: int) -> np.ndarray:
    """The ``n`` keys of ``_steps``."""
    raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31)
    return np.cumsum(np.frombuffer(raw, "<u4" if len(raw) == 4 * n else "<u8").astype(np.int64))


def _places(data: bytes) -> np.ndarray:
    """Places in a range, which have less than 32 bits."""
    return np.cumsum(_unpressed(data, "<u4").astype(np.int64))


def _keys(row) -> np.ndarray:
    return _climbed(row.keys, len(_unpressed(row.n, "<u4")))


def _packs(ranges: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, count = TaskContext.get().partitionId(), 0
        number: dict[bytes, int] = {b"": 0}
        ids, out, parts, size = [], [], [], 0

        def pack() -> pd.DataFrame:
            words: list[list[bytes]] = [[] for _ in range(ranges)]
            for w in number:
                words[zlib.crc32(w) % ranges].append(w)
            words = [sorted(x) for x in words]
            rank = np.empty(len(number), np.int64)
            rank[np.fromiter((number[w] for x in words for w in x), np.int64, len(number))] = np.arange(len(number))
            sizes = list(map(len, parts))
            tokens = rank[np.concatenate(parts)]
            n = np.bincount(tokens, weights=np.repeat(~np.array(out), sizes), minlength=len(number)).astype("<u4")
            messages, first = [], 0
            for k, x in enumerate(words):
                if x:
                    messages.append({"range": k, "words": _squeezed(x), "n_words": len(x), "n": _pressed(n[first : first + len(x)])})
                    first += len(x)
            return pd.DataFrame({"pack": [(part << 32) + count], "ids": [ids], "held": [out], "sizes": [sizes], "tokens": [_pressed(tokens.astype("<u4"))], "messages": [messages]})

        for batch in batches:
            for doc_id, held_out, text in zip(batch["doc_id"], batch["held_out"], batch["text"], strict=True):
                data = utf8(text)
                tokens = [*data.lower().split(), b""]
                ids.append(doc_id)
                out.append(bool(held_out))
                parts.append(np.fromiter((number.setdefault(t, len(number)) for t in tokens), "<u4", len(tokens)))
                size += len(data)
                if size >= PACK_BYTES:
                    yield pack()
                    number = {b"": 0}
                    ids, out, parts, size, count = [], [], [], 0, count + 1
        if ids:
            yield pack()

    return run


def _vocabulary(most: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """All words of one range, and where those of each pack are."""
        words = sorted({w for row in rows.itertuples(index=False) for w in _unsqueezed(row.words, row.n_words)})
        number = {w: i for i, w in enumerate(words)}
        counts, found = np.zeros(len(words), np.int64), []
        for row in rows.itertuples(index=False):
            at = np.fromiter(map(number.__getitem__, _unsqueezed(row.words, row.n_words)), np.int64, row.n_words)
            counts[at] += _unpressed(row.n, "<u4")
            found.append((int(row.pack), at))
        replies = [{"pack": pack, "places": _steps(at), "counts": _pressed(counts[at])} for pack, at in found]
        top = [{"place": int(i), "n": int(counts[i])} for i in np.argsort(-counts, kind="stable")[:most] if counts[i]]
        own = {"range": int(rows["range"].iloc[0]), "words": _squeezed(words), "n_words": len(words), "counts": _pressed(counts), "n": int(counts.sum()), "v": int((counts > 0).sum())}
        return pd.DataFrame([own | {"top": top, "replies": replies}])

    return run


@dataclass
class Layout:
    """Numbers of all words (a range's first number and the place in it), and those of the frequent contexts, ascending."""

    first: np.ndarray
    frequent: np.ndarray

    @property
    def wide(self) -> int:
        return len(self.frequent) + 1

    def by_range(self, ascending: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(range, begin, end) of each range that has any of the word numbers."""
        cuts = np.searchsorted(ascending, self.first)
        for k in np.flatnonzero(np.diff(cuts)):
            yield int(k), int(cuts[k]), int(cuts[k + 1])


@dataclass
class PackTable:
    """A pack's tokens, its distinct keys (word, frequent context) by range of the word, and its other pairs by range of the context."""

    tokens: np.ndarray
    owner: np.ndarray
    number: np.ndarray
    framed: np.ndarray
    keys: np.ndarray
    in_keys: np.ndarray
    pairs: np.ndarray
    in_pairs: np.ndarray


def _pack_table(row, places: list, layout: Layout) -> PackTable:
    tokens = _unpressed(row.tokens, "<u4").astype(np.int64)
    number = np.concatenate([layout.first[r["range"]] + _places(r["places"]) for r in places])
    at = np.minimum(np.searchsorted(layout.frequent, number), max(layout.wide - 2, 0))
    context = np.where(layout.frequent[at] == number, at, layout.wide - 1) if layout.wide > 1 else np.zeros(len(number), np.int64)
    # each text ends with the end, so the token before a text's first is an end, too
    before = np.concatenate((tokens[-1:], tokens[:-1]))
    framed = context[before] < layout.wide - 1
    keys, in_keys = np.unique(tokens[framed] * layout.wide + context[before[framed]], return_inverse=True)
    pairs, in_pairs = np.unique(before[~framed] * len(number) + tokens[~framed], return_inverse=True)
    sizes = np.asarray(row.sizes, np.int64)
    return PackTable(tokens, np.repeat(np.arange(len(sizes)), sizes), number, framed, keys, in_keys, pairs, in_pairs)


def _pair_messages(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        layout = shared.value
        wide = layout.wide
        for batch in batches:
            for row in batch.itertuples(index=False):
                own = _pack_table(row, sorted(row.replies, key=lambda r: r["range"]), layout)
                training = np.repeat(~np.array(row.held, bool), row.sizes).astype(float)
                n = np.bincount(own.in_keys, weights=training[own.framed], minlength=len(own.keys)).astype("<u4")
                m = np.bincount(own.in_pairs, weights=training[~own.framed], minlength=len(own.pairs)).astype("<u4")
                word, context = own.number[own.keys // wide], own.keys % wide
                before, follower = own.number[own.pairs // len(own.number)], own.number[own.pairs % len(own.number)]
                sent: dict[int, dict] = {}
                none = _steps(np.zeros(0, np.int64))
                for k, a, b in layout.by_range(word):
                    sent[k] = {"keys": _steps((word[a:b] - layout.first[k]) * wide + context[a:b]), "n": _pressed(n[a:b])}
                for k, a, b in layout.by_range(before):
                    wanted = follower[a:b].astype("<u4" if layout.first[-1] < 1 << 32 else "<u8")
                    sent[k] = sent.get(k, {}) | {"contexts": _steps(before[a:b] - layout.first[k]), "followers": _pressed(wanted), "m": _pressed(m[a:b])}
                empty = dict.fromkeys(("keys", "n", "contexts", "followers", "m"), none)
                yield pd.DataFrame([{"range": k, "pack": row.pack} | empty | x for k, x in sent.items()], columns=["range", "pack", *empty])

    return run


def _entries(shared):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """The keys and pairs of one range, and where those of each pack are."""
        layout = shared.value
        total = int(layout.first[-1])
        kind = "<u4" if total < 1 << 32 else "<u8"
        keys, pairs = [], []
        for row in rows.itertuples(index=False):
            keys.append((_keys(row), _unpressed(row.n, "<u4")))
            m = _unpressed(row.m, "<u4")
            pairs.append((_climbed(row.contexts, len(m)) * total + _unpressed(row.followers, kind).astype(np.int64), m))

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
            distinct, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([n for _, n in parts]), minlength=len(distinct)).astype("<u4")
            return distinct, n, [_steps(x) for x in np.split(inverse, np.cumsum([len(k) for k, _ in parts])[:-1])]

        own, n, key_maps = merged(keys)
        both, m, pair_maps = merged(pairs)
        wanted, follower = np.unique(both % total, return_inverse=True)
        asked = [{"range": k, "places": _steps(wanted[a:b] - layout.first[k])} for k, a, b in layout.by_range(wanted)]
        maps = [{"pack": int(p), "keys": a, "pairs": b} for p, a, b in zip(rows["pack"], key_maps, pair_maps, strict=True)]
        out = {"range": int(rows["range"].iloc[0]), "keys": _steps(own), "n": _pressed(n), "contexts": _steps(both // total), "followers": _pressed(follower.astype("<u4")), "m": _pressed(m)}
        return pd.DataFrame([out | {"wanted": asked, "maps": maps}])

    return run


# --- seating -----------------------------------------------------------------


@dataclass
class State:
    """What a sweep starts from, and the totals of the seating that it makes."""

    seed: int
    discounts: tuple[float, float]
    #: tables in each frequent context's restaurant; customers and tables of the word restaurant
    context_tables: np.ndarray
    customers: float
    tables: float
    spelling: Spelling
    after: State | None = None
    known: float = 0.0


@dataclass
class Seating:
    """A range's words and entries, and their tables under a state."""

    words: list[bytes]
    word: np.ndarray
    context: np.ndarray
    n: np.ndarray
    context_tables: np.ndarray
    customers: np.ndarray
    tables: np.ndarray
    spelled: np.ndarray
    count: np.ndarray = field(default_factory=lambda: np.zeros(0))


def seating(row, state: State, wide: int, rest: tuple[np.ndarray, np.ndarray] | None = None) -> Seating:
    """The same tables for the same state, whenever it is asked for.

    ``rest``: all training tokens of each word, and its tables in the contexts that have no keys here.
    Without it, those after context ``wide - 1`` are customers themselves.
    """
    words = _unsqueezed(row.words, row.n_words)
    keys, n = _keys(row), _unpressed(row.n, "<u4").astype(np.int64)
    word, context = keys // wide, keys % wide
    count, others = rest or (np.bincount(word, weights=n, minlength=len(words)), 0)
    spelled = np.exp(np.maximum(state.spelling.log_probability(words), -700))
    rng = np.random.default_rng([state.seed, row.range])
    low, high = state.discounts
    own = context < wide - 1
    fresh = np.append(CONTEXT_STRENGTH + high * state.context_tables, 0.0)[context]
    spare = WORD_STRENGTH + low * state.tables
    p = (count + spare * spelled) / (count.sum() + state.customers + spare)
    context_tables, tables = np.zeros(len(n), np.int64), np.zeros(len(words), np.int64)
    for _ in range(2):
        context_tables = np.where(own, seated(np.where(own, n, 0), fresh * p[word], high, rng), n)
        customers = np.bincount(word, weights=context_tables, minlength=len(words)).astype(np.int64) + others
        tables = seated(customers, spare * spelled, low, rng)
        p = (np.maximum(customers - low * tables, 0) + spare * spelled) / (WORD_STRENGTH + max(state.customers, 1.0))
    return Seating(words, word, context, n, context_tables, customers, tables, spelled, count)


def _rest(row, sums: list) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens of a range's words, and their tables as the ranges of contexts sent them."""
    others = np.zeros(row.n_words, np.int64)
    places = {r["tail"]: r["places"] for r in _listed(row.asked)}
    for r in sums:
        others[_places(places[r["tail"]])] += _unpressed(r["tables"], "<u4")
    return _unpressed(row.counts, "<i8"), others


def _listed(x) -> list:
    return [] if x is None else list(x)


@dataclass
class Restaurants:
    """Whole restaurants of a range's contexts: (context, follower) pairs and their training tokens."""

    context: np.ndarray
    follower: np.ndarray
    m: np.ndarray

    @classmethod
    def of(cls, row) -> Restaurants:
        m = _unpressed(row.m, "<u4").astype(np.int64)
        _, context = np.unique(_climbed(row.contexts, len(m)), return_inverse=True)
        return cls(context, _unpressed(row.followers, "<u4").astype(np.int64), m)

    def seated(self, p: np.ndarray, high: float, rng: np.random.Generator) -> np.ndarray:
        """Tables of each pair given the probability of each follower, drawn twice from one table each."""
        tables = (self.m > 0).astype(np.int64)
        for _ in range(2):
            fresh = CONTEXT_STRENGTH + high * np.bincount(self.context, weights=tables)
            tables = seated(self.m, fresh[self.context] * p[self.follower], high, rng)
        return tables

    def predictive(self, tables: np.ndarray, p: np.ndarray, high: float) -> np.ndarray:
        """The probability of each pair's follower in its context."""
        spare = CONTEXT_STRENGTH + high * np.bincount(self.context, weights=tables)
        whole = CONTEXT_STRENGTH + np.bincount(self.context, weights=self.m)
        return (np.maximum(self.m - high * tables, 0) + spare[self.context] * p[self.follower]) / whole[self.context]


def _joined(parts: list) -> np.ndarray:
    """What the ranges sent of the wanted words, in their order."""
    return np.concatenate([np.zeros(0), *(np.frombuffer(r["p"], "<f4").astype(float) for r in sorted(parts, key=lambda r: r["range"]))])


SPELLED, CONTEXT_TABLES, CONTEXT_CUSTOMERS, TOTALS, LOW, HIGH, RESTAURANTS = range(7)
SEATS = "range int, tables binary, sums array<struct<range:int, tables:binary>>, cells array<struct<kind:int, cell:long, n:double>>"


def _histogram(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    at = (c > 0) & (c <= EXACT)
    return np.bincount(c[at] * (EXACT + 1) + t[at], minlength=(EXACT + 1) ** 2)


def _seats(shared):
    """The tables of the restaurants that a range holds whole, and their sums over contexts for the ranges of words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = shared.value
        for batch in batches:
            for row in batch.itertuples(index=False):
                own, p = Restaurants.of(row), _joined(_listed(row.sent))
                tables = own.seated(p, state.discounts[1], np.random.default_rng([state.seed, row.range, 1]))
                sums = np.bincount(own.follower, weights=tables, minlength=len(p)).astype("<u4")
                cuts = np.cumsum([0, *(len(_places(w["places"])) for w in row.wanted)])
                out = [{"range": w["range"], "tables": _pressed(sums[a:b])} for w, a, b in zip(row.wanted, cuts[:-1], cuts[1:], strict=True)]
                totals = np.bincount(own.context, weights=tables).astype(np.int64)
                cells = [{"kind": k, "cell": int(i), "n": float(x[i])} for k, x in ((HIGH, _histogram(own.m, tables)), (RESTAURANTS, np.bincount(totals))) for i in np.flatnonzero(x)]
                yield pd.DataFrame({"range": [row.range], "tables": [_pressed(tables.astype("<u4"))], "sums": [out], "cells": [cells]})

    return run


def _sweep(shared, wide: int):
    """The totals of the seating of all ranges: (kind, cell, n)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = shared.value
        spelled = np.zeros(LEVELS[3] * 256)
        context_tables, customers, totals = np.zeros(wide - 1), np.zeros(wide - 1), np.zeros(3)
        few = {LOW: np.zeros((EXACT + 1) ** 2), HIGH: np.zeros((EXACT + 1) ** 2)}
        for batch in batches:
            for row in batch.itertuples(index=False):
                s = seating(row, state, wide, _rest(row, _listed(row.sent)))
                context_tables += np.bincount(s.context, weights=s.context_tables, minlength=wide - 1)
                customers += np.bincount(s.context, weights=s.n, minlength=wide - 1)
                totals += [s.customers.sum(), s.tables.sum(), s.spelled[s.count > 0].sum()]
                owner, symbol, place = contexts(s.words)
                spelled += np.bincount(place * 256 + symbol, weights=s.tables[owner], minlength=len(spelled))
                few[LOW] += _histogram(s.customers, s.tables)
                few[HIGH] += _histogram(s.n, s.context_tables)
        for kind, x in ((SPELLED, spelled), (CONTEXT_TABLES, context_tables), (CONTEXT_CUSTOMERS, customers), (TOTALS, totals), *few.items()):
            used = np.flatnonzero(x)
            yield pd.DataFrame({"kind": kind, "cell": used, "n": x[used]})

    return run


def _answers(row, p: np.ndarray) -> pd.DataFrame:
    """The probabilities of the words that ranges of contexts asked for."""
    asked = _listed(row.asked)
    return pd.DataFrame({"tail": [r["tail"] for r in asked], "range": row.range, "p": [p[_places(r["places"])].astype("<f4").tobytes() for r in asked]})


ANSWER = "tail int, range int, p binary"


def _first_answers(n: float):
    """Word probabilities before the first sweep: shares of the training tokens, smoothed by the spelling prior."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                spelled = np.exp(np.maximum(Spelling.prior().log_probability(_unsqueezed(row.words, row.n_words)), -700))
                yield _answers(row, (_unpressed(row.counts, "<i8") + WORD_STRENGTH * spelled) / (n + WORD_STRENGTH))

    return run


def _word_answers(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, customers = shared.value
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield _answers(row, predictive(row, state, customers, _rest(row, _listed(row.sent)))[1])

    return run


@dataclass
class Sample:
    """A state after the burn-in, with its seats and what the word restaurant says under it."""

    state: State
    seats: DataFrame
    answers: DataFrame


def _with(rows: DataFrame, sent: DataFrame, key: str = "range", name: str = "sent") -> DataFrame:
    """``rows`` with a list of what was sent to each range."""
    lists = sent.groupBy(F.col(key).alias("range")).agg(F.collect_list(F.struct(*[c for c in sent.columns if c != key])).alias(name))
    return rows.join(lists, "range", "left")


def _sums(seats: DataFrame) -> DataFrame:
    return seats.select(F.col("range").alias("tail"), F.explode("sums").alias("s")).select("s.range", "tail", "s.tables")


def train(shards: DataFrame, tails: DataFrame, n: int, wide: int, burn_in: int, samples: int) -> tuple[list[Sample], np.ndarray]:
    """The samples after the burn-in, and the customers of each frequent context's restaurant.

    What is collected has at most as many rows as the spelling model and the frequent contexts have
    cells, and one for each number of tables that any other restaurant has.
    """
    context = shards.sparkSession.sparkContext
    state = State(0, (0.5, 0.8), np.zeros(wide - 1), float(n), 0.0, Spelling.prior())
    kept, customers = [], np.zeros(wide - 1)
    answers = shards.mapInPandas(_first_answers(float(n)), ANSWER)
    for sweep in range(burn_in + samples):
        shared = context.broadcast(state)
        seats = staged(_with(tails, answers, "tail").mapInPandas(_seats(shared), SEATS), "lm-seats")
        told = _with(shards, _sums(seats))
        cells = told.mapInPandas(_sweep(shared, wide), "kind int, cell long, n double").unionByName(seats.select(F.explode("cells").alias("c")).select("c.*"))
        rows = cells.groupBy("kind", "cell").agg(F.sum("n").alias("n")).toPandas()
        shared.destroy()

        def dense(kind: int, size: int) -> np.ndarray:
            own, out = rows[rows["kind"] == kind], np.zeros(size)
            out[own["cell"].to_numpy(np.int64)] = own["n"].to_numpy(float)
            return out

        totals, tables, customers = dense(TOTALS, 3), dense(CONTEXT_TABLES, wide - 1), dense(CONTEXT_CUSTOMERS, wide - 1)
        rng = np.random.default_rng([sweep, 77])
        few = {kind: {divmod(int(i), EXACT + 1): x[i] for i in np.flatnonzero(x)} for kind in (LOW, HIGH) for x in [dense(kind, (EXACT + 1) ** 2)]}
        of_contexts = Counter(tables.astype(int).tolist())
        for r in rows[rows["kind"] == RESTAURANTS].itertuples(index=False):
            of_contexts[int(r.cell)] += r.n
        discounts = (drawn_discount(few[LOW], {int(totals[1]): 1}, WORD_STRENGTH, rng), drawn_discount(few[HIGH], of_contexts, CONTEXT_STRENGTH, rng))
        spelling = seat_spelling(dense(SPELLED, LEVELS[3] * 256).reshape(LEVELS[3], 256), state.spelling, rng)
        after = State(sweep + 1, discounts, tables, totals[0], totals[1], spelling)
        state.after, state.known = after, float(totals[2])
        answers = told.mapInPandas(_word_answers(context.broadcast((state, customers))), ANSWER)
        if sweep >= burn_in:
            kept.append(Sample(state, seats, answers))
        state = after
    return kept, customers


def predictive(row, state: State, contexts_customers: np.ndarray, rest: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[Seating, np.ndarray, np.ndarray]:
    """A range's seating, the probability of each word in the word restaurant, and of each entry in its context."""
    wide = len(contexts_customers) + 1
    s, after, (low, high) = seating(row, state, wide, rest), state.after, state.discounts
    base = np.where(s.count > 0, s.spelled, max(1.0 - state.known, 1e-12))
    p = (np.maximum(s.customers - low * s.tables, 0) + (WORD_STRENGTH + low * after.tables) * base) / (WORD_STRENGTH + after.customers)
    tables, customers = np.append(after.context_tables, 0.0)[s.context], np.append(contexts_customers, 0.0)[s.context]
    follows = (np.maximum(s.n - high * s.context_tables, 0) + (CONTEXT_STRENGTH + high * tables) * p[s.word]) / (CONTEXT_STRENGTH + customers)
    return s, p, np.where(s.context < wide - 1, follows, p[s.word])


# --- scores ------------------------------------------------------------------

PLACES, KEYS, PAIRS = range(3)
REPLY = "pack long, kind int, range int, data binary, counts binary"


def _replied(row, kind: int, total: np.ndarray, states: int) -> pd.DataFrame:
    """For each pack, the averaged probabilities (log10) of its keys or pairs."""
    logs = np.log10(np.maximum(total / states, 1e-300)).astype("<f4")
    found = [(int(r["pack"]), kind, row.range, logs[_places(r["keys" if kind == KEYS else "pairs"])].tobytes(), None) for r in row.maps]
    return pd.DataFrame(found, columns=["pack", "kind", "range", "data", "counts"])


def _key_replies(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states, customers = shared.value
        for batch in batches:
            for row in batch.itertuples(index=False):
                total = 0.0
                for i, state in enumerate(states):
                    total = total + predictive(row, state, customers, _rest(row, [r for r in _listed(row.sent) if r["sample"] == i]))[2]
                yield _replied(row, KEYS, total, len(states))

    return run


def _pair_replies(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states, _ = shared.value
        for batch in batches:
            for row in batch.itertuples(index=False):
                own, total = Restaurants.of(row), 0.0
                tables = {r["sample"]: _unpressed(r["tables"], "<u4") for r in row.seats}
                for i, state in enumerate(states):
                    p = _joined([r for r in _listed(row.sent) if r["sample"] == i])
                    total = total + own.predictive(tables[i], p, state.discounts[1])
                yield _replied(row, PAIRS, total, len(states))

    return run


SCORED = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(shared, n: int, v: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                replies = sorted(row.replies, key=lambda r: (r["kind"], r["range"]))
                places, keys, pairs = ([r for r in replies if r["kind"] == k] for k in (PLACES, KEYS, PAIRS))
                own = _pack_table(row, [{"range": r["range"], "places": r["data"]} for r in places], shared.value)
                counts = np.concatenate([_unpressed(r["counts"], "<i8") for r in places])
                logs = np.empty(len(own.tokens))
                for at, inverse, sent in ((own.framed, own.in_keys, keys), (~own.framed, own.in_pairs, pairs)):
                    logs[at] = np.concatenate([np.zeros(0), *(np.frombuffer(r["data"], "<f4") for r in sent)])[inverse]
                base = np.log10((counts + 1) / (n + v + 1))
                added = lambda x: np.bincount(own.owner, weights=x, minlength=len(row.sizes))
                frame = pd.DataFrame({"doc_id": row.ids, "held_out": np.array(row.held, bool), "n_tokens": row.sizes})
                frame["n_known"], frame["train_tokens"] = added(counts[own.tokens] > 0).astype(np.int64), n
                frame["base_score"], frame["score"] = added(base[own.tokens]), added(logs)
                yield frame

    return run


def scores(docs: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES, contexts: int = CONTEXTS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``contexts``: how many restaurants are spread over the ranges of their followers; every word has one in any case.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(crc32_of_id(F.col("doc_id")) % FOLDS == HELD_OUT, F.lit(False))
    rows = docs.select(id_text(F.col("doc_id")).alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    ranges = max(1, -(-size // RANGE_BYTES))
    packs = bucketed(rows.mapInPandas(tidy(_packs(ranges)), PACK), "lm_packs", "pack")
    sent = packs.select("pack", F.explode("messages").alias("m")).select("m.range", "pack", "m.words", "m.n_words", "m.n")
    vocabulary = bucketed(sent.groupBy("range").applyInPandas(_vocabulary(contexts), VOCABULARY), "lm_vocabulary", "range")
    sizes = vocabulary.select("range", "n_words", "n", "v").collect()  # one row for each range
    n, v = sum(r["n"] for r in sizes), sum(r["v"] for r in sizes)
    first = np.zeros(ranges + 1, np.int64)
    first[[r["range"] + 1 for r in sizes]] = [r["n_words"] for r in sizes]
    first = np.cumsum(first)
    common = vocabulary.select("range", F.explode("top").alias("t")).orderBy(F.desc("t.n"), "range", "t.place").limit(contexts).select("range", "t.place").collect()
    layout = Layout(first, np.sort(np.array([first[r["range"]] + r["place"] for r in common], np.int64)))
    shared = spark.sparkContext.broadcast(layout)

    places = vocabulary.select("range", F.explode("replies").alias("r")).select("range", "r.pack", "r.places", "r.counts")
    placed = places.groupBy("pack").agg(F.collect_list(F.struct("range", "places")).alias("replies"))
    pairs = packs.drop("messages", "ids").join(placed, "pack").mapInPandas(tidy(_pair_messages(shared)), MESSAGE)
    entries = bucketed(pairs.groupBy("range").applyInPandas(_entries(shared), ENTRIES), "lm_entries", "range")
    asked = entries.select(F.col("range").alias("tail"), F.explode("wanted").alias("w")).select("w.range", "tail", "w.places")
    words = vocabulary.select("range", "words", "n_words", "counts").join(entries.select("range", "keys", "n"), "range", "left")
    none = F.lit(bytearray(_steps(np.zeros(0, np.int64))))
    words = words.withColumn("keys", F.coalesce("keys", none)).withColumn("n", F.coalesce("n", none))
    shards = bucketed(_with(words, asked, name="asked"), "lm_shards", "range")
    tails = entries.select("range", "contexts", "followers", "m", "wanted")

    kept, customers = train(shards, tails, n, layout.wide, burn_in, samples)
    states = spark.sparkContext.broadcast(([x.state for x in kept], customers))

    def every(part) -> DataFrame:
        return reduce(DataFrame.unionByName, [part(x).withColumn("sample", F.lit(i)) for i, x in enumerate(kept)])

    maps = entries.select("range", "maps")
    key_replies = _with(shards, every(lambda x: _sums(x.seats))).join(maps, "range").mapInPandas(_key_replies(states), REPLY)
    seated_tails = _with(_with(tails, every(lambda x: x.answers), "tail"), every(lambda x: x.seats.select("range", "tables")), name="seats")
    pair_replies = seated_tails.join(maps, "range").mapInPandas(_pair_replies(states), REPLY)
    first_replies = places.select("pack", F.lit(PLACES).alias("kind"), "range", F.col("places").alias("data"), "counts")
    replies = first_replies.unionByName(key_replies).unionByName(pair_replies)
    answered = replies.groupBy("pack").agg(F.collect_list(F.struct("kind", "range", "data", "counts")).alias("replies"))
    scored = packs.drop("messages").join(answered, "pack").mapInPandas(tidy(_scores(shared, n, v)), SCORED)
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))
