"""Alignment of two tokenizers over whole texts, in Arrow columns.

Both tokenizers read a space and the text. Where a token of A and a token of B end
at the same byte, they are linked, and the text is cut into groups. In a task:

1. Texts are tokenized by unit (from a space that divides two non-spaces to the
   next), each distinct unit once; both tokenizers start a new token there, so
   units end groups, and a long text is handled in segments of whole units.
2. The ids are two list columns. They are flattened with their parent indices; the
   bytes of the tokens are summed along the column and the sum before the text is
   taken off, which gives each token's end in its text.
3. An Acero hash join on (text, end) gives the links; the distinct ends are the cuts,
   from which list offsets and the digest of the groups follow.
4. ``Table.group_by`` counts the linked id pairs of each text and of the whole slice.

Spark adds the slices' counts up to corpus-wide counts of pairs, finds each B id's
highest, and joins them to the texts' pairs: as a broadcast if the pairs were
counted to be few, else as a shuffled join that splits hot pairs. Results of the
tasks are written before they are read twice.

A text that is null or empty, or that one tokenizer does not give back byte by byte,
has no tokens: zeros, and an empty string for the digest. Rows that repeat a doc_id
are rows of their own, and so are rows without one. Repeated rows count again. An
empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small, staged, tidy
from .tokenbin import UnitEncoder

#: Characters of text that a slice gathers before it is aligned, and units of a segment of one text.
SLICE, SEGMENT = 2_000_000, 200_000
_SCHEMA = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
])
_DDL = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, counts array<long>"


class Tokens:
    """A tokenizer's tokens: their bytes, byte lengths and ids as decimal text."""

    def __init__(self, pieces: list[bytes]):
        self.bytes = pieces
        self.sizes = np.array([len(x) for x in pieces])
        self.lengths = pa.array(self.sizes, pa.int64())
        self.names = pa.array([str(i) for i in range(len(pieces))])


def byte_characters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers. They are loaded once in a Python worker; what they have read is remembered by each task alone."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a_model = Tokenizer.from_file(a_path)
        self.a_model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b_model = SentencePieceProcessor(model_file=b_path)
        alphabet = byte_characters()
        ids = range(self.a_model.get_vocab_size())
        self.a = Tokens([bytes(alphabet.get(c, 0) for c in self.a_model.id_to_token(i)) for i in ids])
        pieces = [self.b_model.id_to_piece(i) for i in range(self.b_model.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("tokens of B reach over spaces")
        self.b = Tokens([bytes([int(p[3:5], 16)]) if self.b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

    def read(self, units: list[str]) -> list[bytes]:
        """The ids of a space and each unit by A and then by B, as little-endian 32-bit integers after the number of A's; empty where bytes differ.

        Units are joined and the ids cut apart again by the tokens' bytes; where that can't be, each is read by itself.
        """
        if len(units) > 1:
            want = [len(u.encode("utf-8", "surrogatepass")) + 1 for u in units]
            text = " ".join(units)
            cut = [
                self._cut(np.array(self.a_model.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, "<u4"), self.a, text, want),
                self._cut(np.array(self.b_model.encode(text), "<u4"), self.b, text, want),
            ]
            if cut[0] is None or cut[1] is None or any(u[:1].isspace() or u[-1:].isspace() for u in units):
                half = len(units) // 2
                return self.read(units[:half]) + self.read(units[half:])
            (a, of_a), (b, of_b) = cut
            n_a = np.diff(np.array(of_a), prepend=0) // 4
            heads = n_a.astype("<u4").tobytes()
            starts_a, starts_b = [0, *of_a], [0, *of_b]
            return [heads[4 * i : 4 * i + 4] + a[starts_a[i] : of_a[i]] + b[starts_b[i] : of_b[i]] for i in range(len(units))]
        (u,) = units
        a, b = self.a_model.encode_batch_fast([" " + u], add_special_tokens=False)[0].ids, self.b_model.encode(u)
        want = b" " + u.encode("utf-8", "surrogatepass")
        if b"".join([self.a.bytes[i] for i in a]) != want or b"".join([self.b.bytes[i] for i in b]) != want:
            return [b""]
        return [np.array([len(a), *a, *b], "<u4").tobytes()]

    @staticmethod
    def _cut(ids: np.ndarray, tokens: Tokens, text: str, want: list[int]) -> tuple[bytes, list[int]] | None:
        """The ids as bytes and the places where the units end in them; None if tokens cross units or give other bytes."""
        ends, wanted = np.cumsum(tokens.sizes[ids]), np.cumsum(want)
        cuts = np.searchsorted(ends, wanted, "right")
        right = len(ends) and np.array_equal(ends[cuts - 1], wanted) and b"".join([tokens.bytes[i] for i in ids.tolist()]) == b" " + text.encode("utf-8", "surrogatepass")
        return (ids.tobytes(), (cuts * 4).tolist()) if right else None


_loaded: dict[tuple[str, str], Tokenizers] = {}


def tokenizers_of(a_path: str, b_path: str) -> Tokenizers:
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Tokenizers(a_path, b_path)
    return _loaded[a_path, b_path]


class Memory:
    """Units that were read, forgotten when their estimated bytes go beyond ``limit``."""

    #: What a unit takes besides its text and ids: two objects and its place in the table.
    ENTRY, TOGETHER = 190, 2000

    def __init__(self, both: Tokenizers, limit: int = 160 << 20):
        self.both, self.limit, self.held = both, limit, 0
        self.known: dict[str, bytes] = {}

    def lookup(self, texts: list[list[str]]) -> list[list[bytes]]:
        """The cells of the units of each text."""
        if self.held > self.limit:
            self.known, self.held = {}, 0
        known = self.known
        new = sorted(set().union(*texts).difference(known))
        for at in range(0, len(new), self.TOGETHER):
            part = new[at : at + self.TOGETHER]
            cells = self.both.read(part)
            known.update(zip(part, cells, strict=True))
            self.held += sum(map(len, part)) + sum(map(len, cells)) + self.ENTRY * len(part)
        return [list(map(known.__getitem__, units)) for units in texts]


def _ends(lists: pa.ListArray, lengths: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Of the flattened tokens: ids, parent indices, and the bytes of the text up to each one's end."""
    ids, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    total = pc.cumulative_sum(pc.take(lengths, ids))
    starts = lists.offsets.slice(0, len(lists))
    padded = pa.concat_arrays([pa.array([0], pa.int64()), total])
    return ids, parent, pc.subtract(total, pc.take(pc.take(padded, starts), parent))


def aligned(a: pa.ListArray, b: pa.ListArray, a_tokens: Tokens, b_tokens: Tokens) -> tuple[pa.Table, pa.Array, pa.Array]:
    """(links, groups, n_groups) of texts that are given as lists of ids, whose bytes agree.

    ``links`` has a row (text, end, a, b) for each pair of tokens that end together; ``groups``
    is the text ``a1,a2|b1;a3|b2,b3`` of each list and ``n_groups`` the number of its groups.
    """
    sides, keys = [], []
    for name, lists, tokens in (("a", a, a_tokens), ("b", b, b_tokens)):
        ids, parent, end = _ends(lists, tokens.lengths)
        sides.append(pa.table({"text": parent, "end": end, name: ids}))
        keys.append(parent.to_numpy().astype(np.int64) << 40 | end.to_numpy())
    links = sides[0].join(sides[1], ["text", "end"], join_type="inner", use_threads=False)
    cuts = np.sort(links["text"].to_numpy().astype(np.int64) << 40 | links["end"].to_numpy())
    cuts = cuts[np.diff(cuts, prepend=-1) > 0]
    joined = []
    for side, name, tokens, key in zip(sides, "ab", (a_tokens, b_tokens), keys, strict=True):
        # a token belongs to the first cut at or after its end; tokens are in that order
        offsets = np.searchsorted(np.searchsorted(cuts, key), np.arange(len(cuts) + 1)).astype(np.int32)
        names = pc.take(tokens.names, side[name].combine_chunks())
        joined.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), names), ","))
    each = pc.binary_join_element_wise(*joined, "|")
    of_text = np.searchsorted(cuts >> 40, np.arange(len(a) + 1)).astype(np.int32)
    return links, pc.binary_join(pa.ListArray.from_arrays(pa.array(of_text), each), ";"), pa.array(np.diff(of_text), pa.int64())


def _lists(texts: list[list[bytes]]) -> tuple[pa.ListArray, pa.ListArray]:
    """The ids of both tokenizers as list columns, from the cells of each text."""
    flat = np.frombuffer(b"".join([b"".join(x) for x in texts]), "<u4").astype(np.int32)
    sizes = np.fromiter((len(c) for x in texts for c in x), np.int64) // 4
    starts = np.cumsum(sizes) - sizes
    n_a = flat[starts]
    side = np.ones(len(flat), np.int8)  # 0: a cell's head, 1: A, 2: B
    bounds = np.zeros(len(flat) + 1, np.int8)
    bounds[starts + 1 + n_a] += 1
    bounds[starts[1:]] -= 1
    side += np.cumsum(bounds[:-1], dtype=np.int8)
    side[starts] = 0
    cells = np.cumsum([0, *map(len, texts)])
    out = []
    for k, each in ((1, n_a), (2, sizes - 1 - n_a)):
        offsets = np.concatenate([[0], np.cumsum(each)])[cells].astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[side == k])))
    return out[0], out[1]


def _pair_lists(links: pa.Table, n: int) -> tuple[pa.ListArray, pa.ListArray, list[int], list[int]]:
    """The distinct pairs of each text with their numbers of links, as two list columns; and those of all texts together."""
    code = pc.bit_wise_or(pc.shift_left(links["a"].cast(pa.int64()), 32), links["b"].cast(pa.int64()))
    coded = pa.table({"text": links["text"], "pair": code})
    each = coded.group_by(["text", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by("text")
    offsets = pa.array(np.searchsorted(each["text"].to_numpy(), np.arange(n + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, each[c].combine_chunks()) for c in ("pair", "count_all")]
    summed = each.group_by("pair", use_threads=False).aggregate([("count_all", "sum")])
    return *lists, summed["pair"].to_pylist(), summed["count_all_sum"].to_pylist()


def _task(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers_of(a_path, b_path)
        memory = Memory(both)
        number = TaskContext.get().partitionId() << 40
        digest, sums = hashlib.sha256(), np.zeros(4, np.int64)
        first = True  # of the segments of a text

        def slice_of(held: list) -> Iterator[pa.RecordBatch]:
            nonlocal digest, sums, first
            a, b = _lists([cells for _, _, cells, _ in held])
            links, groups, n_groups = aligned(a, b, both.a, both.b)
            pairs, counts, slice_pairs, slice_counts = _pair_lists(links, len(held))
            n_links = pc.list_value_length(pairs).to_numpy().astype(np.int64) * 0
            if links.num_rows:
                n_links += np.bincount(links["text"].to_numpy(), minlength=len(held))
            sizes = np.stack([np.diff(a.offsets.to_numpy()), np.diff(b.offsets.to_numpy()), n_groups.to_numpy(), n_links], axis=1).astype(np.int64)
            rows, shown = [], []
            for (row, doc_id, cells, last), text, size in zip(held, groups.to_pylist(), sizes, strict=True):
                if cells:
                    digest.update((text if first else ";" + text).encode())
                    first = False
                sums = sums + size
                rows.append((row, doc_id))
                shown.append((*sums.tolist(), digest.hexdigest() if not first else "") if last else (None,) * 5)
                if last:
                    digest, sums, first = hashlib.sha256(), np.zeros(4, np.int64), True
            columns = [list(x) for x in zip(*[(*r, *s) for r, s in zip(rows, shown, strict=True)], strict=True)]
            arrays = [pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=False)]
            yield pa.RecordBatch.from_arrays([*arrays, pairs, counts.cast(pa.list_(pa.int64()))], schema=_SCHEMA)
            if slice_pairs:
                yield pa.RecordBatch.from_pylist([{"pairs": slice_pairs, "counts": slice_counts}], schema=_SCHEMA)

        def read(texts: list) -> Iterator:
            """(row, doc_id, cells, whether the last) of each segment."""
            units = [[start, *rest] if text else [] for _, _, text in texts for start, rest in [UnitEncoder._units(text or "")]]
            for (row, doc_id, _), cells in zip(texts, memory.lookup(units), strict=True):
                cells = [] if b"" in cells else cells
                for at in range(0, max(1, len(cells)), SEGMENT):
                    yield row, doc_id, cells[at : at + SEGMENT], at + SEGMENT >= len(cells)

        def sliced(texts: list) -> Iterator[pa.RecordBatch]:
            held: list = []
            size = 0
            for x in read(texts):
                held.append(x)
                size += len(x[2])
                if size >= SEGMENT:
                    yield from slice_of(held)
                    held, size = [], 0
            if held:
                yield from slice_of(held)

        texts: list = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                number += 1
                texts.append((number, doc_id, text))
                size += len(text or "")
                if size >= SLICE or len(texts) >= 5000:
                    yield from sliced(texts)
                    texts, size = [], 0
        if texts:
            yield from sliced(texts)

    return run


def token_links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The written results of the tasks: for each text, in its last row, its sizes and digest, with (pairs, counts) in
    each of its rows; and rows without ``row`` that hold the counts of pairs of a slice. A pair is A's id * 2^32 + B's id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged(rows.mapInArrow(tidy(_task(a_path, b_path)), _DDL), "alignment")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best): the corpus-wide number of links of each id pair, and whether no pair of its B id has more."""
    partial = links.where("row is null").select(F.inline(F.arrays_zip("pairs", "counts"))).toDF("pair", "k")
    total = checkpointed(partial.groupBy("pair").agg(F.sum("k").alias("n")).withColumn("b", F.expr("pair & 4294967295")))
    highest = total.groupBy("b").agg(F.max("n").alias("most"))
    return total.join(small(highest), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    links = token_links(docs, a_path, b_path)
    counts = small(checkpointed(pair_counts(links)))
    texts = links.where("row is not null")
    sizes = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    found = texts.select("row", F.inline(F.arrays_zip("pairs", "counts"))).toDF("row", "pair", "k").join(counts, "pair")
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
    whole = texts.where("n_a is not null").select("row", *sizes)
    none = F.lit(0).cast("long")
    return whole.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256"
    )
