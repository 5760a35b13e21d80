"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word patterns, [\x20\x09-\x0D].
WHITESPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="graphweft-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """``df`` written once as a table of the warehouse in buckets of ``key``, so that joins by it don't move its rows."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").bucketBy(shuffle_partitions(spark), key).saveAsTable(name, format="parquet")
    return spark.table(name)


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df`` marked for broadcast if it was counted to have at most ``rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row.

    A lambda that names a column several times, or from inside a higher-order
    function, would otherwise compute that column's expression again each time.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def id_text(doc_id: Column) -> Column:
    """An id on its way into Python: as text, since a column of integers with a null beside them arrives as floats."""
    return doc_id.cast("long").cast("string")


def crc32_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- memory of Python workers ---------------------------------------------


#: What a Python worker remembers between tasks of one operator: its name, and how to forget it.
REMEMBERED: dict[str, Callable[[], None]] = {}


def tidy(run, operator: str = ""):
    """``run``, a function of an iterator of batches, giving back what it freed when it ends: Python workers live on between tasks,
    and freed memory that they keep counts against their executor. What tasks of other operators remember is forgotten first."""

    def wrapped(batches):
        forget_others(operator)
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def forget_others(operator: str) -> None:
    for name in [n for n in REMEMBERED if n != operator]:
        REMEMBERED.pop(name)()


def give_back() -> None:
    """Hand freed memory back to the operating system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass

# --- words and 64-bit hashes inside tasks ---------------------------------

#: A-Z become a-z; what is neither a letter, a digit nor above ASCII becomes a space.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; none for null."""
    return utf8(text).translate(ALNUM_TABLE).split()


def space_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words ``[^\\x20\\x09-\\x0D]+``; none for null."""
    return utf8(text).lower().split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHasher:
    """64-bit hashes of words, each word hashed once while it is remembered.

    Forgets everything when its words take about ``limit`` bytes, long words too.
    """

    #: What an entry takes besides its word: the key's and the value's headers, and its place in the table.
    ENTRY = 170

    def __init__(self, limit: int = 48 << 20):
        self.limit = limit
        self.held = 0
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        new = [w for w in set(words) if w not in known]
        if new:
            self.held += sum(map(len, new)) + self.ENTRY * len(new)
            if self.held > self.limit and known:
                known.clear()
                new = list(set(words))
                self.held = sum(map(len, new)) + self.ENTRY * len(new)
            known.update(zip(new, (xxhash.xxh64_intdigest(w) for w in new), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
