"""Removal of repeated byte strings by bucket-pointer refinement.

Every position of every document is a suffix; what matters is which suffixes
agree on their first 50 bytes. Buckets are refined by the identifiers of later
offsets, and each refinement reuses the last one's:

1. one-byte buckets are refined to q-grams of 2, 4, 8, 16 and 25 bytes, the
   bucket of 2q bytes at p coming from the q-byte buckets at p and p + q. A
   bucket identifier is a 64-bit hash, the same in every task, so that these
   steps need no shuffle;
2. of the 26 25-gram buckets inside each 50-byte string the least is its
   pointer; neighbouring strings with one pointer form a run, told by the
   bucket of its first and last string. Runs are sorted by (pointer bucket, run
   bucket): a run that a smaller document has too is finished, bucket and all,
   and a pointer bucket with a single run holds no repeats;
3. only runs left in pointer buckets with several runs are refined to 50-byte
   buckets, from the 25-gram buckets at p and p + 25, and sorted once more.

Equal strings share pointer, and a string's first document can't be finished in
step 2, so this finds exactly the strings that also start in a document with a
smaller doc_id, up to 64-bit hash collisions inside 64-bit buckets.

Documents are packed, in compressed packs of a bounded size, and each pack sends
the sorter of a key range one message: arrays with each distinct bucket once,
and the smallest doc_id that has it. So a passage that a third of all documents
share makes one entry a pack. The sorters answer with a code for each entry.

Null and empty texts have no bytes. Rows that share a doc_id count as one
document, and each gets its row. Rows with a null doc_id have nothing removed
and count for none. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, utf8

LENGTH, GRAM = 50, 25
WINDOW = LENGTH - GRAM + 1
PACK_BYTES = 8 << 20
#: Bytes of text for each key range that is sorted in one go.
RANGE_BYTES = 16 << 20
SEGMENT = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

NOTHING, FINISHED, OPEN = 0, 1, 2


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bucket of a string from the buckets of two parts of it that cover it."""
    x = a * _A
    x += b
    x ^= x >> np.uint64(31)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


class Runs:
    """The runs of a pack's documents: arrays doc, first, last (byte positions in the pack), pointer, run."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        parts: list[tuple[np.ndarray, ...]] = []
        # segments of whole documents, or of the starts in one long document
        at, n = 0, len(starts)
        while at < n:
            last = at
            while last + 1 < n and ends[last + 1] - starts[at] <= SEGMENT:
                last += 1
            if last > at or ends[at] - starts[at] <= SEGMENT:
                self._add(parts, data, int(starts[at]), int(ends[last]), starts[at : last + 1], ends[at : last + 1], at)
                at = last + 1
            else:
                for s in range(int(starts[at]), int(ends[at]) - LENGTH + 1, SEGMENT):
                    e = min(int(ends[at]), s + SEGMENT + LENGTH - 1)
                    self._add(parts, data, s, e, np.array([s]), np.array([e]), at)
                at += 1
        merged = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
        self.doc, self.first, self.last, self.pointer, self.run = merged
        self.data = data

    @staticmethod
    def _buckets(data: np.ndarray) -> np.ndarray:
        """25-gram buckets."""
        x = _BYTES[data]
        for q in (1, 2, 4, 8):
            x = _joined(x[:-q], x[q:])
        return _joined(x[: -(GRAM - 16)], x[GRAM - 16 :])

    @classmethod
    def _add(cls, parts: list, data: np.ndarray, low: int, high: int, starts: np.ndarray, ends: np.ndarray, doc: int) -> None:
        lengths = ends - starts
        if high - low < LENGTH or lengths.max() < LENGTH:
            return
        grams = cls._buckets(data[low:high])
        n = high - low - LENGTH + 1
        key = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        q = 1
        while 2 * q <= WINDOW:
            key = np.minimum(key[:-q], key[q:])
            q *= 2
        least = np.minimum(key[: len(key) - (WINDOW - q)], key[WINDOW - q :])[:n]
        ok = np.zeros(n + 1, np.int64)
        full = lengths >= LENGTH
        np.add.at(ok, starts[full] - low, 1)
        np.add.at(ok, ends[full] - low - LENGTH + 1, -1)
        at = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
        place = (least[at] & _LOW).astype(np.int64)
        cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(at) != 1)) + 1
        head, tail = np.concatenate(([0], cut)), np.concatenate((cut, [len(at)])) - 1
        first, last = at[head], at[tail]
        strings = lambda p: _joined(grams[p], grams[p + GRAM])
        run = _joined(_joined(strings(first), strings(last)), (last - first).astype(np.uint64))
        parts.append((doc + np.searchsorted(starts - low, first, side="right") - 1, first + low, last + low, grams[place[head]], run))

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run number, position, 50-byte bucket) of every string of the runs ``which``."""
        count = self.last[which] - self.first[which] + 1
        owner = np.repeat(which, count)
        position = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + self.first[owner]
        out = np.zeros(len(position), np.uint64)
        for s in range(0, len(position), 20_000):
            p = position[s : s + 20_000]
            # a run's bytes are few, so they are bucketed again rather than kept
            x = _BYTES[self.data[p[:, None] + np.arange(LENGTH)]]
            for q in (1, 2, 4, 8):
                x = _joined(x[:, :-q], x[:, q:])
            out[s : s + 20_000] = _joined(_joined(x[:, 0], x[:, 9]), _joined(x[:, 25], x[:, 34]))
        return owner, position, out


class Entries:
    """A pack's distinct buckets, each with its least document, and their key ranges."""

    def __init__(self, pointer: np.ndarray, bucket: np.ndarray, doc: np.ndarray, ranges: int):
        # documents ascend, so the first place of a bucket is in its least document
        _, self.at, self.of = np.unique(_joined(pointer, bucket), return_index=True, return_inverse=True)
        self.pointer, self.bucket, self.doc = pointer[self.at], bucket[self.at], doc[self.at]
        self.range = ((self.pointer >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)
        self.order = np.argsort(self.range, kind="stable")
        self.bounds = np.searchsorted(self.range[self.order], np.arange(ranges + 1))

    def messages(self, doc_ids: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
        """(key range, pointers, buckets, document numbers, doc_ids) of each range with entries."""
        for k in np.flatnonzero(np.diff(self.bounds)):
            own = self.order[self.bounds[k] : self.bounds[k + 1]]
            ids, number = np.unique(doc_ids[self.doc[own]], return_inverse=True)
            narrow = np.uint16 if len(ids) <= 1 << 16 else np.uint32
            five = self.bucket[own].view(np.uint8).reshape(-1, 8)[:, :5]
            yield int(k), self.pointer[own].astype(np.uint32).tobytes(), five.tobytes(), number.astype(narrow).tobytes(), ids.tobytes()

    def answers(self, replies: list) -> np.ndarray:
        """The code of each entry."""
        out = np.zeros(len(self.at), np.uint8)
        for reply in replies if replies is not None else ():
            k = reply["range"]
            out[self.order[self.bounds[k] : self.bounds[k + 1]]] = np.frombuffer(zlib.decompress(reply["codes"]), np.uint8)
        return out


MESSAGE = "range int, pack long, pointers binary, buckets binary, numbers binary, ids binary"
REPLY = "range int, pack long, codes binary"


def _sorted_codes(rows: pd.DataFrame) -> pd.DataFrame:
    """The codes of all entries of one key range."""
    sizes = [len(x) // 4 for x in rows["pointers"]]
    pointer = np.frombuffer(b"".join(rows["pointers"]), np.uint32)
    five = np.frombuffer(b"".join(rows["buckets"]), np.uint8).reshape(-1, 5)
    bucket = np.zeros((len(five), 8), np.uint8)
    bucket[:, :5] = five
    bucket = bucket.view(np.uint64).ravel()
    doc = np.concatenate(
        [np.frombuffer(i, np.int64)[np.frombuffer(d, np.uint16 if len(i) <= 8 << 16 else np.uint32)] for i, d in zip(rows["ids"], rows["numbers"], strict=True)]
    )
    order = np.lexsort((doc, bucket, pointer))
    p, b, d = pointer[order], bucket[order], doc[order]
    new_pointer = np.concatenate(([True], p[1:] != p[:-1]))
    new_bucket = new_pointer | np.concatenate(([True], b[1:] != b[:-1]))
    finished = d > d[np.maximum.accumulate(np.where(new_bucket, np.arange(len(d)), 0))]
    group = np.cumsum(new_pointer) - 1
    heads = np.flatnonzero(new_pointer)
    several = np.add.reduceat(new_bucket.astype(np.int64), heads) > 1
    several &= np.minimum.reduceat(d, heads) < np.maximum.reduceat(d, heads)
    codes = np.empty(len(d), np.uint8)
    codes[order] = np.where(finished, FINISHED, np.where(several[group], OPEN, NOTHING))
    ends = np.cumsum(sizes)
    out = [(int(r), int(k), zlib.compress(codes[e - n : e].tobytes(), 1)) for r, k, n, e in zip(rows["range"], rows["pack"], sizes, ends, strict=True) if codes[e - n : e].any()]
    return pd.DataFrame(out, columns=["range", "pack", "codes"])


def _packs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def pack() -> pd.DataFrame:
        held.sort(key=lambda x: x[0])
        blob = zstandard.ZstdCompressor(level=3).compress(b"".join(x for _, x in held))
        return pd.DataFrame({"pack": [(part << 32) + number], "ids": [[i for i, _ in held]], "sizes": [[len(x) for _, x in held]], "blob": [blob]})

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            held.append((int(doc_id), utf8(text)))
            size += len(held[-1][1])
            if size >= PACK_BYTES:
                yield pack()
                held, size, number = [], 0, number + 1
    if held:
        yield pack()


PACK = "pack long, ids array<long>, sizes array<long>, blob binary"


def _opened(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, bytes, starts and ends of the documents of a pack."""
    sizes = np.array(row.sizes, np.int64)
    ends = np.cumsum(sizes)
    raw = zstandard.ZstdDecompressor().decompress(row.blob) if len(sizes) and ends[-1] else b""
    return np.array(row.ids, np.int64), np.frombuffer(raw, np.uint8), ends - sizes, ends


def _frame(pack: int, messages) -> pd.DataFrame:
    found = [(k, pack, *rest) for k, *rest in messages]
    return pd.DataFrame(found, columns=["range", "pack", "pointers", "buckets", "numbers", "ids"])


def _run_messages(ranges: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, data, starts, ends = _opened(row)
                runs = Runs(data, starts, ends)
                yield _frame(row.pack, Entries(runs.pointer, runs.run, runs.doc, ranges).messages(ids))

    return run


class Judged:
    """A pack's runs after step 2: which are finished, and the strings of those that aren't and are open."""

    def __init__(self, row, ranges: int):
        self.ids, self.data, self.starts, self.ends = _opened(row)
        self.runs = Runs(self.data, self.starts, self.ends)
        own = Entries(self.runs.pointer, self.runs.run, self.runs.doc, ranges)
        code = own.answers(row.run_codes)[own.of]
        self.finished = (self.ids[self.runs.doc] > self.ids[own.doc[own.of]]) | (code == FINISHED)
        owner, self.position, bucket = self.runs.strings(np.flatnonzero(~self.finished & (code == OPEN)))
        self.doc = self.runs.doc[owner]
        self.entries = Entries(bucket, self.runs.pointer[owner], self.doc, ranges) if len(owner) else None


def _string_messages(ranges: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                judged = Judged(row, ranges)
                if judged.entries is not None:
                    yield _frame(row.pack, judged.entries.messages(judged.ids))

    return run


def _cleaned(ranges: int, with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                judged = Judged(row, ranges)
                edge = np.zeros(len(judged.data) + 1, np.int64)
                done = judged.finished
                np.add.at(edge, judged.runs.first[done], 1)
                np.add.at(edge, judged.runs.last[done] + LENGTH, -1)
                if judged.entries is not None:
                    own = judged.entries
                    gone = (judged.ids[judged.doc] > judged.ids[own.doc[own.of]]) | (own.answers(row.string_codes)[own.of] == FINISHED)
                    np.add.at(edge, judged.position[gone], 1)
                    np.add.at(edge, judged.position[gone] + LENGTH, -1)
                covered = np.cumsum(edge[:-1]) > 0
                out = []
                for doc_id, s, e in zip(judged.ids.tolist(), judged.starts.tolist(), judged.ends.tolist(), strict=True):
                    c = covered[s:e]
                    n = int(c.sum())
                    kept = judged.data[s:e][~c].tobytes() if n else judged.data[s:e].tobytes()
                    spans = int(c[0]) + int((c[1:] & ~c[:-1]).sum()) if n else 0
                    out.append((doc_id, e - s, n, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
                yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


CLEANED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def repeats_removed(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    packs = staged(rows.where("doc_id is not null").mapInPandas(_packs, PACK), "packs")
    total = packs.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first()["n"] or 0
    ranges = max(1, -(-total // RANGE_BYTES))

    def replies(messages: DataFrame, name: str) -> DataFrame:
        codes = messages.groupBy("range").applyInPandas(_sorted_codes, REPLY)
        return staged(codes, name).groupBy("pack").agg(F.collect_list(F.struct("range", "codes")).alias(name))

    runs = replies(packs.mapInPandas(_run_messages(ranges), MESSAGE), "run_codes")
    judged = packs.join(runs, "pack", "left")
    strings = replies(judged.mapInPandas(_string_messages(ranges), MESSAGE), "string_codes")
    cleaned = packs.join(runs, "pack", "left").join(strings, "pack", "left").mapInPandas(_cleaned(ranges, with_text), CLEANED)
    nameless = rows.where("doc_id is null").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), F.when(F.lit(with_text), F.encode("text", "UTF-8")).alias("kept"),
    )
    return cleaned.unionByName(nameless)
