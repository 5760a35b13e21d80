"""Toxicity by a linear-chain conditional random field over words.

Tokens are labelled from the documents' labels: a token of a toxic document is
offending when its word, or a prefix of it, is far more frequent in toxic than
in clean documents. The field has two states, emission weights for the word and
its prefixes, and transition weights; it is fitted by gradient ascent on the
regularized conditional likelihood, whose gradient comes from forward-backward
marginals. A document's score is a logistic function, fitted on the same rows,
of its marginals; tokens with a marginal of one half or more give the offsets.

Fitting uses a bounded sample: at most ``sample`` toxic and ``2 * sample`` clean
labelled rows, those first by a hash of their doc_id, and of these the texts of
at most ``sample_words`` words. Scoring reads every row and the whole text. Only
the fitted model, whose size is fixed, is broadcast.

Null and empty texts have no tokens and the score of no marginals. Without both
kinds of labels every score is 0. Repeated rows are scored alike, a null doc_id
counts as not held out, labels other than 0 and 1 aren't used, and of several
labels of one doc_id the larger holds.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, id_text, utf8

#: A-Z become a-z; what isn't a letter or above ASCII becomes a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
BITS = 18
PREFIXES = (4, 5, 6)
FOLDS = 5


def letter_words(text: str | None) -> list[bytes]:
    return utf8(text).translate(LETTERS).split()


def features(word: bytes) -> list[bytes]:
    """The word itself and its prefixes of some characters."""
    if word.isascii():
        return [b"=" + word, *(word[:k] for k in PREFIXES if len(word) >= k)]
    text = word.decode("utf-8", "replace")
    return [b"=" + word, *(text[:k].encode() for k in PREFIXES if len(text) >= k)]


def slots(word: bytes) -> list[int]:
    return [zlib.crc32(f) & ((1 << BITS) - 1) for f in features(word)]


@dataclass
class Field:
    """Emission weights of the offending state, its bias, transition weights, and the document's logistic weights."""

    weights: np.ndarray
    bias: float
    transitions: np.ndarray
    document: np.ndarray | None = None


def marginals(emissions: list[np.ndarray], transitions: np.ndarray, pairs: np.ndarray | None = None) -> list[np.ndarray]:
    """P(offending) of every token. The sequences are worked through side by side, longest first.

    The expected numbers of neighbours in each two states are added to ``pairs``.

    The ratio of the two states' forward, and backward, sums is all that the
    marginals need, so it is all that is carried on.
    """
    order = sorted(range(len(emissions)), key=lambda i: -len(emissions[i]))
    lengths = np.array([len(emissions[i]) for i in order])
    if not len(lengths) or not lengths[0]:
        return [np.zeros(0) for _ in emissions]
    (oo, ot), (to, tt) = np.exp(transitions)
    steps = int(lengths[0])
    grid = np.zeros((steps, len(order)))
    for k, i in enumerate(order):
        grid[: lengths[k], k] = emissions[i]
    grid = np.exp(np.clip(grid, -30, 30))
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than t
    odds = np.zeros_like(grid)
    r = grid[0].copy()
    odds[0] = r
    for t in range(1, steps):
        n = active[t]
        r = r[:n]
        r = np.clip(grid[t, :n] * (ot + r * tt) / (oo + r * to), 1e-30, 1e30)
        odds[t, :n] = r
    b = np.ones(len(order))
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        x = grid[t + 1, :n] * b[:n]
        if pairs is not None:
            r = odds[t, :n]  # still the forward ratio alone
            joint = np.stack([np.full(n, oo), ot * x, to * r, tt * r * x])
            pairs += (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        b[:n] = (to + tt * x) / (oo + ot * x)
        odds[t, :n] *= b[:n]
    p = odds / (1 + odds)
    out: list[np.ndarray] = [np.zeros(0)] * len(order)
    for k, i in enumerate(order):
        out[i] = p[: lengths[k], k]
    return out


def in_groups(lengths: list[int], cells: int = 400_000) -> Iterator[list[int]]:
    """Indices in groups of similar length, each of about ``cells`` padded cells at most."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    at = 0
    while at < len(order):
        n = max(1, min(512, cells // max(1, lengths[order[at]])))
        yield order[at : at + n]
        at += n


def grouped_marginals(emissions: list[np.ndarray], transitions: np.ndarray, pairs: np.ndarray | None = None) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.zeros(0)] * len(emissions)
    for group in in_groups([len(e) for e in emissions]):
        for i, p in zip(group, marginals([emissions[i] for i in group], transitions, pairs), strict=True):
            out[i] = p
    return out


def document_features(p: np.ndarray) -> list[float]:
    """What a document's score is made of: bias, expected offending tokens, the largest marginal, the share of tokens."""
    if not len(p):
        return [1.0, 0.0, 0.0, 0.0]
    return [1.0, float(np.log1p(p.sum())), float(p.max()), float(100 * p.mean())]


def _lexicon(texts: list[list[bytes]], toxic: list[int]) -> set[bytes]:
    """Words and prefixes at least 20 times as frequent, by documents, in toxic as in clean texts."""
    counts = (Counter(), Counter())
    n = [toxic.count(0), toxic.count(1)]
    for words, label in zip(texts, toxic, strict=True):
        counts[label].update({f for w in set(words) for f in features(w)})
    return {f for f, k in counts[1].items() if k >= 4 and (k + 0.5) / (n[1] + 1) >= 20 * (counts[0][f] + 0.5) / (n[0] + 1)}


def fit(rows: list[tuple[str | None, int]], rounds: int = 25, rate: float = 1.0, ridge: float = 1e-4) -> Field | None:
    """Fit on (text, label) rows; None if a label is missing."""
    toxic = [label for _, label in rows]
    if not {0, 1} <= set(toxic):
        return None
    texts = [letter_words(t) for t, _ in rows]
    lexicon = _lexicon(texts, toxic)
    vocabulary = {w: i for i, w in enumerate(sorted({w for x in texts for w in x}))}
    parts = [slots(w) for w in vocabulary]
    word_of_slot = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    slot = np.array([s for x in parts for s in x], np.int64)
    marked = np.array([any(f in lexicon for f in features(w)) for w in vocabulary], bool)
    ids = [np.array([vocabulary[w] for w in x], np.int64) for x in texts]
    gold = [marked[x] & bool(label) for x, label in zip(ids, toxic, strict=True)]
    every = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    truth = np.concatenate(gold)
    want_words = np.bincount(every, weights=truth, minlength=len(vocabulary))
    before, after = [g[:-1] for g in gold], [g[1:] for g in gold]
    want_pairs = np.array([[sum(int(((a == x) & (b == y)).sum()) for a, b in zip(before, after, strict=True)) for y in (False, True)] for x in (False, True)], float)
    field = Field(np.zeros(1 << BITS), -3.0, np.zeros((2, 2)))
    pace, slow = np.full(1 << BITS, 1e-8), np.full(5, 1e-8)
    for _ in range(rounds):
        score = np.bincount(word_of_slot, weights=field.weights[slot], minlength=len(vocabulary)) + field.bias
        got_pairs = np.zeros((2, 2))
        p = grouped_marginals([score[x] for x in ids], field.transitions, got_pairs)
        got_words = np.bincount(every, weights=np.concatenate(p), minlength=len(vocabulary))
        by_word = want_words - got_words
        step = np.bincount(slot, weights=by_word[word_of_slot], minlength=1 << BITS) / len(rows) - ridge * field.weights
        rest = np.append((want_pairs - got_pairs).ravel() / len(rows), by_word.sum() / len(rows))
        rest[0] = 0.0  # one transition weight is free
        pace += step * step
        slow += rest * rest
        field.weights += rate * step / np.sqrt(pace)
        moved = 0.1 * rest / np.sqrt(slow)
        field.transitions = np.clip(field.transitions + moved[:4].reshape(2, 2), -4, 4)
        field.bias += moved[4]
    score = np.bincount(word_of_slot, weights=field.weights[slot], minlength=len(vocabulary)) + field.bias
    x = np.array([document_features(p) for p in grouped_marginals([score[i] for i in ids], field.transitions)])
    field.document = _logistic(x, np.array(toxic, float))
    return field


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, gradient)
    return w


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, sample_words: int) -> list[tuple[str | None, int]]:
    """The bounded sample of rows that aren't held out."""
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(crc32_of_id(F.col("doc_id")) % FOLDS != 0)
    first = lambda label, n: marks.where(F.col("toxic") == label).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(n)
    chosen = F.broadcast(first(1, sample).unionByName(first(0, 2 * sample)))  # at most 3 * sample rows
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").where(F.length(F.coalesce("text", F.lit(""))) <= 8 * sample_words)
    found = rows.select(F.md5("text").alias("h"), "doc_id", "text", "toxic").collect()
    return [(r["text"], r["toxic"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["h"] or ""))]


def _spans(text: str, p: np.ndarray, least: float) -> list[dict[str, int]]:
    """Character ranges of runs of tokens whose marginal is ``least`` or more."""
    data = utf8(text).translate(LETTERS)
    out: list[dict[str, int]] = []
    last = -2
    for k, m in enumerate(_WORD.finditer(data)):
        if p[k] < least:
            continue
        end = len(utf8(text)[: m.end()].decode("utf-8", "surrogatepass"))
        if k == last + 1:
            out[-1]["end"] = end
        else:
            out.append({"start": end - len(data[m.start() : m.end()].decode("utf-8", "replace")), "end": end})
        last = k
    return out


def _scored(shared, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field: Field | None = shared.value
        known: dict[bytes, float] = {}
        for batch in batches:
            if field is None:
                yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": 0.0, "spans": [[] for _ in range(len(batch))]})
                continue
            emissions = []
            for text in batch["text"]:
                words = letter_words(text)
                if len(known) > 1_000_000:
                    known.clear()
                for w in set(words).difference(known):
                    known[w] = float(field.weights[slots(w)].sum()) + field.bias
                emissions.append(np.fromiter(map(known.__getitem__, words), float, len(words)))
            chance = grouped_marginals(emissions, field.transitions)
            z = np.array([document_features(p) for p in chance]) @ field.document
            spans = [_spans(t, p, least) if len(p) and p.max() >= least else [] for t, p in zip(batch["text"], chance, strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": 1 / (1 + np.exp(-np.clip(z, -30, 30))), "spans": spans})

    return run


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 1500, sample_words: int = 4000, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (character offsets of offending runs)."""
    field = fit(training_rows(docs, labels, sample, sample_words))
    shared = docs.sparkSession.sparkContext.broadcast(field)
    held_out = F.coalesce(crc32_of_id(F.col("doc_id")) % FOLDS == 0, F.lit(False))
    rows = docs.select(id_text(F.col("doc_id")).alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    scored = rows.mapInPandas(_scored(shared, least), "doc_id string, held_out boolean, score double, spans array<struct<start:long,end:long>>")
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
