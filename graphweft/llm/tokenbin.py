"""Token-id output: per-document zstandard frames under one shared dictionary.

Format, a folder with two Parquet tables that any Spark reader can open:

* ``dictionary``: one row (sha256, dictionary), a zstandard dictionary trained
  on serialized id arrays (little-endian unsigned 32-bit).
* ``shards``: rows (part, shard, dictionary_sha256, n_ids, doc_ids, offsets,
  payload). ``payload`` joins one frame a document; frame k is
  ``payload[offsets[k]:offsets[k + 1]]``, so one short document can be read
  without its neighbours. Documents ascend by doc_id over (part, shard, k).

The dictionary's training sample is bounded: the ``sample_rows`` documents that
come first by a hash of their id, each with at most ``sample_bytes`` of ids.
Everything else covers all rows and whole texts.

A null text is the empty text; every document ends with ``end_id``. Null doc_ids
come first. Rows that share a doc_id are each written, in the order of their
text's hash. An empty table makes shards of no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate, compress
from operator import not_

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import REMEMBERED, id_text, shared_dir, shuffle_partitions, small, tidy

END_ID = 2
SHARD_BYTES = 4 << 20
SHARDS = "part int, shard int, dictionary_sha256 string, n_ids long, doc_ids array<long>, offsets array<long>, payload binary"
_AT_SPACES = re.compile(r"(?<=\S) (?=\S)")
_UNEVEN = re.compile(r" (?:(?=\s)|(?<=\s ))")
#: A word of Latin letters, and ASCII marks after it: the pre-tokenizer makes one piece of each.
_WORD_AND_MARKS = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u017F]+)([!-/:-@\[-`{-~]*)")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Bytes as characters, as a byte-level vocabulary writes them.
_BYTE_LEVEL = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}
_SPACE = _BYTE_LEVEL[32]


class UnitEncoder:
    """Encodes texts as the tokenizer does, remembering the ids of their units.

    The vocabulary's pre-tokenizer always starts a new piece at a single space
    between two non-spaces, so the units between such spaces are encoded each by
    itself, and each distinct unit once. New units that are a word, or a word and marks, are
    made of those two pieces, of which the model encodes each new one. Other new units are encoded joined,
    and cut apart by the byte lengths of the tokens. Forgets all when they take about ``limit`` bytes.
    """

    #: What a unit takes besides its text and ids: two objects and its place in the table.
    ENTRY = 190

    def __init__(self, path: str, limit: int = 320 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        # a byte-level token has one character for each byte
        self.lengths = np.array([len(self.tokenizer.id_to_token(i)) for i in range(self.tokenizer.get_vocab_size())])
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.held = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if self.held > self.limit:
            self.forget()
        known = self.known
        split = [self._units(t) for t in texts]
        found = [list(map(known.get, units)) for _, units in split]
        missing = [list(compress(range(len(ids)), map(not_, ids))) if None in ids else [] for ids in found]
        self._learn({units[i] for (_, units), at in zip(split, missing, strict=True) for i in at})
        firsts = self.tokenizer.encode_batch_fast([first for first, _ in split], add_special_tokens=False)
        out = []
        for e, (_, units), ids, at in zip(firsts, split, found, missing, strict=True):
            for i in at:
                ids[i] = known[units[i]]
            out.append(np.array(e.ids, "<u4").tobytes() + b"".join(ids))
        return out

    def _learn(self, units: set[str]) -> None:
        known, marks, rest = self.known, self.marks, []
        for u in units:
            pieces = _WORD_AND_MARKS.fullmatch(u)
            if pieces is None:
                rest.append(u)
                continue
            word, mark = pieces.groups()
            ids = known.get(word) or self._piece(known, word, _SPACE)
            if mark:
                known[u] = ids = ids + (marks.get(mark) or self._piece(marks, mark, ""))
                self.held += len(u) + len(ids) + self.ENTRY
        self._learn_joined(rest)

    def _piece(self, table: dict[str, bytes], piece: str, before: str) -> bytes:
        """The model's ids of one piece of the pre-tokenizer, kept in ``table``."""
        written = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_LEVEL)
        ids = table[piece] = b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(before + written)])
        self.held += len(piece) + len(ids) + self.ENTRY
        return ids

    def _learn_joined(self, units: list[str]) -> None:
        for i in range(0, len(units), 5000):
            part = units[i : i + 5000]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(self.lengths[ids])
            wanted = np.cumsum([len(u.encode("utf-8", "surrogatepass")) + 1 for u in part])
            cuts = np.searchsorted(ends, wanted)
            if len(ends) == 0 or not np.array_equal(ends[cuts], wanted):
                raise ValueError("the tokenizer doesn't split at spaces as a byte-level one does")
            data, at = ids.tobytes(), 0
            for u, cut in zip(part, ((cuts + 1) * 4).tolist(), strict=True):
                self.known[u] = data[at:cut]
                at = cut
            self.held += sum(map(len, part)) + len(data) + self.ENTRY * len(part)

    @staticmethod
    def _units(text: str) -> tuple[str, list[str]]:
        """The text up to its first dividing space, and the units after dividing spaces."""
        if not text:
            return "", []
        if text[0].isspace() or text[-1].isspace() or _UNEVEN.search(text):
            first, *rest = _AT_SPACES.split(text)
        else:
            first, *rest = text.split(" ")
        return first, rest


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One encoder in each Python worker, whose units are remembered until a task of another operator comes."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    REMEMBERED[f"tokens {path}"] = _encoders[path].forget
    return _encoders[path]


END_BYTES = END_ID.to_bytes(4, "little")


def train_dictionary(docs: DataFrame, path: str, sample_rows: int = 1000, sample_bytes: int = 16_384, size: int = 65_536) -> bytes:
    """A dictionary from the bounded sample; empty if the sample is too small to train on."""
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # only about twice the sample is ordered, however many tasks there are
    share = min(1.0, (2 * sample_rows + 100) / max(1, docs.count()))
    few = docs.where(F.conv(F.substring(order, 1, 8), 16, 10).cast("double") < share * 2**32)
    sample = few.orderBy(order, F.xxhash64("text")).limit(sample_rows).select("text")
    # made by a task, so that the driver holds neither the texts nor the tokenizer
    row = sample.coalesce(1).mapInPandas(tidy(_trained(path, sample_bytes, size)), "dictionary binary").first()
    return bytes(row["dictionary"]) if row else b""


def _trained(path: str, sample_bytes: int, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = UnitEncoder(path)
        samples = [(x + END_BYTES)[:sample_bytes] for batch in batches for x in own.encode(list(batch["text"]))]
        try:
            data = zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:  # too few or too short samples
            data = b""
        yield pd.DataFrame({"dictionary": [data]})

    return run


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _shards(path: str, data: bytes, shard_bytes: int):
    digest = hashlib.sha256(data).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, squeeze = encoder(path), zstandard.ZstdCompressor(level=3, dict_data=_dictionary(data))
        part, shard = TaskContext.get().partitionId(), 0
        ids: list = []
        frames: list[bytes] = []
        held = n_ids = 0

        def row() -> pd.DataFrame:
            offsets = list(accumulate(map(len, frames), initial=0))
            return pd.DataFrame({"part": [part], "shard": [shard], "dictionary_sha256": [digest], "n_ids": [n_ids], "doc_ids": [ids], "offsets": [offsets], "payload": [b"".join(frames)]})

        for batch in batches:
            for at in range(0, len(batch), 200):
                few = batch.iloc[at : at + 200]
                for doc_id, x in zip(few["doc_id"], own.encode([t or "" for t in few["text"]]), strict=True):
                    x += END_BYTES
                    frames.append(squeeze.compress(x))
                    ids.append(None if doc_id is None else int(doc_id))
                    held += len(frames[-1])
                    n_ids += len(x) // 4
                    if held >= shard_bytes:
                        yield row()
                        ids, frames, held, n_ids, shard = [], [], 0, 0, shard + 1
        if frames:
            yield row()

    return run


def write_token_ids(docs: DataFrame, tokenizer_path: str, folder: str, shard_bytes: int = SHARD_BYTES) -> None:
    """Write the ids of all ``docs`` to ``folder``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    data = train_dictionary(rows, tokenizer_path)
    spark.createDataFrame([(hashlib.sha256(data).hexdigest(), bytearray(data))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    ordered = rows.repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    )
    ordered.select(id_text(F.col("doc_id")).alias("doc_id"), "text").mapInPandas(tidy(_shards(tokenizer_path, data, shard_bytes), f"tokens {tokenizer_path}"), SHARDS).write.option("compression", "uncompressed").parquet(f"{folder}/shards")


def _decoded(data: bytes):
    digest = hashlib.sha256(data).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        expand = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.dictionary_sha256 != digest:
                    raise ValueError(f"shard {r.part}/{r.shard} was written under another dictionary")
                sizes, sums = [], []
                payload = memoryview(r.payload)
                for a, b in zip(r.offsets[:-1], r.offsets[1:], strict=True):
                    ids = expand.decompress(payload[a:b])
                    sizes.append(len(ids) // 4)
                    sums.append(zlib.crc32(ids))
                starts = [int(r.start), *(int(r.start) + np.cumsum(sizes)[:-1])]
                yield pd.DataFrame({"doc_id": list(r.doc_ids), "start": starts, "n_tokens": sizes, "ids_crc32": sums})

    return run


def read_dictionary(spark: SparkSession, folder: str) -> bytes:
    row = spark.read.schema("sha256 string, dictionary binary").parquet(f"{folder}/dictionary").first()
    data = bytes(row["dictionary"])
    if hashlib.sha256(data).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary doesn't match its hash")
    return data


def read_token_summary(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in ``folder``, from its frames."""
    data = read_dictionary(spark, folder)
    shards = spark.read.schema(SHARDS).parquet(f"{folder}/shards")
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one row for each written part
    before = list(accumulate((n for _, n in totals), initial=0))
    base = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, before, strict=False)], "part int, base long")
    earlier = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        shards.select("part", "shard", "n_ids")
        .join(base, "part")
        .select("part", "shard", (F.col("base") + F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).alias("start"))
    )
    placed = shards.join(small(starts), ["part", "shard"]).withColumn("doc_ids", F.col("doc_ids").cast("array<string>"))
    found = placed.mapInPandas(tidy(_decoded(data)), "doc_id string, start long, n_tokens long, ids_crc32 long")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """The ids of each row of one document, from its frames alone."""
    expand = zstandard.ZstdDecompressor(dict_data=_dictionary(read_dictionary(spark, folder)))
    place = F.transform("doc_ids", lambda x, i: F.when(x == doc_id, i))
    shards = spark.read.schema(SHARDS).parquet(f"{folder}/shards").where(F.array_contains("doc_ids", doc_id))
    frames = shards.select("part", "shard", F.explode(F.array_compact(place)).alias("k"), "offsets", "payload").select(
        "part", "shard", "k", F.expr("substring(payload, int(offsets[k]) + 1, int(offsets[k + 1] - offsets[k]))").alias("frame")
    )
    return [np.frombuffer(expand.decompress(bytes(r["frame"])), "<u4").tolist() for r in frames.orderBy("part", "shard", "k").collect()]


def token_output(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the ids of ``docs`` to a new folder in the shared one, and summarize what is read back."""
    folder = f"{shared_dir(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    write_token_ids(docs, tokenizer_path, folder)
    return read_token_summary(docs.sparkSession, folder)
