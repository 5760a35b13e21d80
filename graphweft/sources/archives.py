"""Archive members, .xz files and web addresses as lines, read by executors.

A Python data source with a partition for each zip member, .xz file or address. Files are
opened through Arrow's file systems, so a path may be in any store they know; a zip member is read from
its own range of the file. A tar that isn't compressed is split inside its members, as Spark splits files;
a compressed one can only be read from its start, so its members are one partition. Nothing is unpacked
to a disk.
"""

from __future__ import annotations

import io
import json
import lzma
import tarfile
import urllib.request
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .positions import placed

_SCHEMA = "source string, number int, member string, block long, line long, value string"
#: Characters of lines in a batch, about.
BATCH = 1_000_000
_TAR = (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")


def kind_of(path: str) -> str | None:
    """zip, tar, xz or web; None for what Spark reads by itself."""
    if path.startswith(("http://", "https://")):
        return "web"
    return "zip" if path.endswith(".zip") else "tar" if path.endswith(_TAR) else "xz" if path.endswith(".xz") else None


def _opened(path: str):
    """A seekable binary file of any store."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def _text(stream) -> io.TextIOWrapper:
    return io.TextIOWrapper(stream, "utf-8", newline=None)


class _Range(io.RawIOBase):
    """The bytes from ``at`` to ``end`` of a file."""

    def __init__(self, file, at: int, end: int):
        self._file, self._at, self._end = file, at, end
        file.seek(at)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        found = self._file.read(min(len(into), self._end - self._at))
        into[: len(found)] = found
        self._at += len(found)
        return len(found)


def _line_from(file, at: int, end: int) -> int:
    """Where the first line after the first line feed at ``at`` or later begins; ``end`` if there is none."""
    file.seek(at)
    while at < end and (found := file.read(min(1 << 16, end - at))):
        if (k := found.find(b"\n")) >= 0:
            return at + k + 1
        at += len(found)
    return end


@dataclass
class Piece(InputPartition):
    """Members of a file; or a ``part`` (number, its first byte, its end, where the split begins and ends) of one, of a plain tar."""

    path: str
    kind: str
    members: list[str] | None
    part: tuple[int, int, int, int, int] | None = None


class LinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.members = json.loads(options.get("members") or "null")
        self.whole = options.get("whole") == "true"
        self.most = int(options["most"])

    def partitions(self) -> list[Piece]:
        out = []
        for path in self.paths:
            kind = kind_of(path)
            if kind == "zip":
                with _opened(path) as f, zipfile.ZipFile(f) as z:
                    there = [n for n in z.namelist() if not n.endswith("/")]
                self._check(path, there)
                out += [Piece(path, kind, [n]) for n in there if self.members is None or n in self.members]
            elif kind == "tar" and (parts := self._parts(path)) is not None:
                out += parts
            else:
                out.append(Piece(path, kind, self.members if kind == "tar" else None))
        return out

    def _parts(self, path: str) -> list[Piece] | None:
        """The splits of a plain tar's members; None of a tar that is compressed or has sparse members."""
        out, there = [], []
        if self.whole:
            return None
        with _opened(path) as f:
            try:
                t = tarfile.open(fileobj=f, mode="r:")
            except tarfile.ReadError:
                return None
            with t:
                for i, m in enumerate(t):
                    if m.issparse():
                        return None
                    if m.isfile():
                        there.append(m.name)
                        if self.members is None or m.name in self.members:
                            end = m.offset_data + m.size
                            out += [Piece(path, "tar", [m.name], (i, m.offset_data, end, a, min(a + self.most, end))) for a in range(m.offset_data, end, self.most)]
        self._check(path, there)
        return out

    def _check(self, path: str, there: Sequence[str]) -> None:
        if absent := set(self.members or ()) - set(there):
            raise FileNotFoundError(f"not in {path}: {sorted(absent)}")

    def _streams(self, piece: Piece):
        """(number, member, block, stream): a split has the lines that begin in it, told by line feeds."""
        if piece.kind == "web":
            with urllib.request.urlopen(piece.path, timeout=60) as stream:
                body = stream.read()
            yield 0, "", 0, lzma.open(io.BytesIO(body)) if piece.path.endswith(".xz") else io.BytesIO(body)
            return
        with _opened(piece.path) as f:
            if piece.part:
                number, first, end, a, b = piece.part
                at = first if a == first else _line_from(f, a - 1, end)
                if at < b:
                    yield number, piece.members[0], a - first, io.BufferedReader(_Range(f, at, end if b == end else _line_from(f, b - 1, end)), 1 << 20)
            elif piece.kind == "xz":
                yield 0, "", 0, lzma.open(f)
            elif piece.kind == "zip":
                with zipfile.ZipFile(f) as z:
                    order = z.namelist()
                    for name in piece.members:
                        yield order.index(name), name, 0, z.open(name)
            else:
                there = set()
                with tarfile.open(fileobj=f, mode="r:*") as t:
                    for i, m in enumerate(t):
                        if m.isfile() and (piece.members is None or m.name in piece.members):
                            there.add(m.name)
                            yield i, m.name, 0, t.extractfile(m)
                self._check(piece.path, there)

    def read(self, piece: Piece) -> Iterator:
        import pyarrow as pa

        def batch(number: int, member: str, block: int, line: int, values: list[str]):
            n = len(values)
            same = [pa.repeat(pa.scalar(x, kind), n) for x, kind in ((piece.path, pa.string()), (number, pa.int32()), (member, pa.string()), (block, pa.int64()))]
            return pa.RecordBatch.from_arrays([*same, pa.array(range(line, line + n), pa.int64()), pa.array(values, pa.string())], names)

        names = ["source", "number", "member", "block", "line", "value"]
        for number, member, block, stream in self._streams(piece):
            text = _text(stream)
            if self.whole:
                yield batch(number, member, block, 0, ["\n".join(x.removesuffix("\n") for x in text)])
                continue
            line = 0
            while found := text.readlines(BATCH):
                yield batch(number, member, block, line, [x.removesuffix("\n") for x in found])
                line += len(found)


class LinesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "graphweft_lines"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LinesReader(self.options)


def archive_lines(spark: SparkSession, paths: Sequence[str], members: Sequence[str] | None = None, whole: bool = False) -> DataFrame:
    """(source, number, member, block, line, value) of the lines of archives, .xz files and addresses; with ``whole`` one row for each text.

    ``block`` is where in its member a split begins, and ``line`` counts from there. ``members`` chooses files of the archives, all of which must be there.
    """
    spark.dataSource.register(LinesSource)
    options = {"paths": json.dumps(list(paths)), "members": json.dumps(list(members) if members is not None else None), "whole": str(whole).lower(), "most": str(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())}
    return spark.read.format(LinesSource.name()).options(**options).load()


def text_lines(spark: SparkSession, path: str, members: Sequence[str] | None = None) -> DataFrame:
    """``value`` with the place of each line; a member of an archive is a file of its own, in the archive's order."""
    if kind_of(path) is None:
        return placed(spark.read.text(path))
    lines = archive_lines(spark, [path], members)
    return lines.select("value", F.lit(0).alias("_file_no"), F.concat_ws("!", "source", F.lpad(F.col("number").cast("string"), 8, "0"), "member").alias("_file"), F.col("block").alias("_block"), F.col("line").alias("_at"))


def whole_texts(spark: SparkSession, path: str, members: Sequence[str] | None = None) -> DataFrame:
    """``value``: each file or member as one text."""
    if kind_of(path) is None:
        return spark.read.text(path, wholetext=True)
    return archive_lines(spark, [path], members, whole=True).select("value")


def members_of(path: str) -> list[str]:
    """The files in an archive, in its order. Read on the driver: a zip's directory, or a tar's headers."""
    with _opened(path) as f:
        if kind_of(path) == "zip":
            with zipfile.ZipFile(f) as z:
                return [n for n in z.namelist() if not n.endswith("/")]
        with tarfile.open(fileobj=f, mode="r:*") as t:
            return [m.name for m in t if m.isfile()]
