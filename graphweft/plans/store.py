"""A graph on disk: tables made of segments, and numbered manifests whose appearance is the commit.

    <path>/manifests/<version>.json
    <path>/tables/<table>/seg=<n>/            Parquet part files
    <path>/index/<table>/seg=<n>/files, words  which keys each file may hold

A table with a key is written in ``buckets`` hash buckets of its key, one file a bucket and
segment, sorted by key. So tables with the same key join without a shuffle (``bucketed``), and an
append that keeps keys unique reads only the files that may hold a new key: those whose bucket has
a new key, whose range has it, and whose Bloom filter has it. An append writes one new segment and
never touches an older file. Layouts are further copies of a table in buckets of another column.

The Bloom filters are relations: a key sets five bits of one 64-bit word of its file's filter, and
a row holds a word. Building one is a grouped BIT_OR, asking it an equality join; no task holds a
whole filter and none passes the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Graph
from ..operators.integrity import _as_type, _common_type, _nullable, _ranked, deduplicate, union_by_name
from ..sources import filesystem as fs

#: Keys for each 64-bit word of a filter.
KEYS_A_WORD = 4
#: The size of the sketches of distinct values, as a power of two, and of quantiles.
DISTINCT_LG_K, QUANTILE_K = 14, 800
#: The largest bucket's rows may be so many times the mean's before joins leave the buckets unused.
UNEVEN = 4


@dataclass(frozen=True)
class Appended:
    """What an append did: rows that were added and rows that were left out, new columns, files that were read for keys."""

    added: int
    left_out: DataFrame | None
    new_columns: list[str]
    files_read: list[str]


def _mask(key: Column) -> Column:
    """The five bits of a key in its word."""
    h, bits = F.xxhash64(F.lit(17), key), F.lit(0).cast("long")
    for k in range(5):
        bit = F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return bits


def _word(key: Column, words: Column) -> Column:
    return F.pmod(F.xxhash64(key), words)


class GraphStore:
    """A reader keeps the manifest that it opened. Of two writers of a version one fails.

    ``keys`` names each table's key columns; a table that lacks one is stored without a key. Null keys are
    never repeats.
    """

    KEYS = {"nodes": ("id",), "edges": ("id",), "component_labels": ("id",)}

    def __init__(self, spark: SparkSession, path: str, mode: str = "w", buckets: int | None = None):
        self.spark, self.path, self.mode = spark, path.rstrip("/"), mode
        self._views: dict[tuple[str, int], str] = {}
        found = [n for n in fs.names(spark, f"{self.path}/manifests") if n.endswith(".json")]
        if found:
            self.manifest = json.loads(fs.read_text(spark, f"{self.path}/manifests/{found[-1]}"))
        elif mode == "r":
            raise FileNotFoundError(f"{path} has no manifest")
        else:
            buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self.manifest = {"version": 0, "buckets": buckets, "next": 1, "tables": {}, "views": {}, "schema": None}

    # --- reading -----------------------------------------------------------------

    def tables(self) -> list[str]:
        return sorted(n for n, x in self.manifest["tables"].items() if not x.get("layout_of"))

    def _entry(self, name: str) -> dict:
        return self.manifest["tables"][name]

    def _schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(self._entry(name)["schema"])

    def _folder(self, name: str, n: int) -> str:
        return f"{self.path}/tables/{name}/seg={n}"

    def table(self, name: str) -> DataFrame:
        """All rows; columns that a segment lacks are null in it."""
        segments = self._entry(name)["segments"]
        if not segments:
            return self.spark.createDataFrame([], self._schema(name))
        return self.spark.read.schema(self._schema(name)).parquet(*[self._folder(name, s["n"]) for s in segments])

    def bucketed(self, name: str) -> DataFrame:
        """``table`` with its hash buckets known to the optimizer, so that joins and aggregates by its key need no shuffle.

        A table whose largest bucket is far larger than the others, as with a hot key, comes without them:
        a shuffle that splits hot keys is then the better plan.
        """
        entry = self._entry(name)
        if not entry["key"] or not entry["segments"] or self._uneven(entry):
            return self.table(name)
        known = self._views.get((name, self.manifest["version"]))
        if known:
            return self.spark.table(known).drop("_seg")
        view = self._views[name, self.manifest["version"]] = f"graphweft_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._schema(name))
        key = ", ".join(f"`{c}`" for c in entry["key"])
        self.spark.sql(
            f"create table {view} ({columns}, `_seg` int) using parquet partitioned by (`_seg`) clustered by ({key}) sorted by ({key}) into {self.manifest['buckets']} buckets location '{self.path}/tables/{name}'"
        )
        for s in entry["segments"]:
            self.spark.sql(f"alter table {view} add partition (`_seg` = {s['n']}) location '{self._folder(name, s['n'])}'")
        return self.spark.table(view).drop("_seg")

    def _uneven(self, entry: dict) -> bool:
        largest, rows = sum(s["largest"] for s in entry["segments"]), sum(s["rows"] for s in entry["segments"])
        return largest > 1000 and largest > UNEVEN * rows / self.manifest["buckets"]

    def graph(self) -> Graph:
        have = {t: self.table(t) for t in self.tables()}
        return Graph(have.pop("nodes", None), have.pop("edges", None), have)

    def stats(self) -> dict[str, int]:
        return {t: sum(s["rows"] for s in self._entry(t)["segments"]) for t in self.tables()}

    def files(self, name: str) -> list[str]:
        """The part files of a table."""
        return sorted(f"seg={s['n']}/{f}" for s in self._entry(name)["segments"] for f in fs.names(self.spark, self._folder(name, s["n"])) if f.startswith("part-"))

    # --- writing -----------------------------------------------------------------

    def _commit(self, tables: dict[str, dict], **other) -> None:
        if self.mode == "r":
            raise PermissionError("the store was opened to be read")
        manifest = {**self.manifest, **other, "version": self.manifest["version"] + 1, "tables": tables}
        fs.publish_text(self.spark, f"{self.path}/manifests/{manifest['version']:012d}.json", json.dumps(manifest, indent=1))
        self.manifest = manifest

    def _number(self) -> int:
        """A segment number that no writer took: files of a failed write stay behind unnamed until ``vacuum``."""
        n = max([self.manifest["next"], *(int(x[4:]) + 1 for t in fs.names(self.spark, f"{self.path}/tables") for x in fs.names(self.spark, f"{self.path}/tables/{t}") if x.startswith("seg="))])
        self.manifest["next"] = n + 1
        return n

    def _write(self, name: str, df: DataFrame, key: Sequence[str]) -> dict:
        """One new segment and its index, as the manifest lists it."""
        if self.mode == "r":
            raise PermissionError("the store was opened to be read")
        n = self._number()
        folder, buckets = self._folder(name, n), self.manifest["buckets"]
        if not key:
            df.write.parquet(folder)
            return {"n": n, "rows": self.spark.read.schema(df.schema).parquet(folder).count(), "largest": 0}
        view = f"graphweft_{uuid.uuid4().hex}"
        # a task holds one bucket, so each makes one file of the segment
        df.repartition(buckets, *key).write.format("parquet").bucketBy(buckets, *key).sortBy(*key).option("path", folder).saveAsTable(view)
        self.spark.sql(f"drop table {view}")  # the files stay, as the path was given
        sizes = [r["rows"] for r in self._write_index(name, n, df.schema, key).select("rows").collect()]  # one row a bucket
        return {"n": n, "rows": sum(sizes), "largest": max(sizes, default=0)}

    def _keyed(self, df: DataFrame, key: Sequence[str]) -> DataFrame:
        """``df`` with ``_bucket``, as Spark's bucketed writer deals rows out, and ``_key``, null where it can't repeat."""
        one = F.col(key[0]).cast("string") if len(key) == 1 else F.md5(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}))
        return df.withColumns({"_bucket": F.pmod(F.hash(*key), F.lit(self.manifest["buckets"])), "_key": one})

    def _write_index(self, name: str, n: int, schema: T.StructType, key: Sequence[str]) -> DataFrame:
        """``files`` (bucket, file, rows, words, low, high) and ``words`` (bucket, word, bits) of a segment; returns the files."""
        folder = f"{self.path}/index/{name}/seg={n}"
        kinds = T.StructType([f for f in schema if f.name in key])
        rows = self._keyed(self.spark.read.schema(kinds).parquet(self._folder(name, n)).select(*key, F.col("_metadata.file_name").alias("file")), key)
        words = F.greatest(F.lit(1), F.ceil(F.count("_key") / KEYS_A_WORD)).cast("long")
        files = rows.groupBy(F.col("_bucket").alias("bucket"), "file").agg(F.count(F.lit(1)).alias("rows"), words.alias("words"), F.min("_key").alias("low"), F.max("_key").alias("high"))
        files.coalesce(1).write.parquet(f"{folder}/files")  # one row a bucket
        files = self.spark.read.schema(files.schema).parquet(f"{folder}/files")
        sizes = F.broadcast(files.select(F.col("bucket").alias("_bucket"), "words"))  # one row a bucket
        bits = rows.where("_key is not null").join(sizes, "_bucket").groupBy(F.col("_bucket").alias("bucket"), _word(F.col("_key"), F.col("words")).alias("word")).agg(F.bit_or(_mask(F.col("_key"))).alias("bits"))
        bits.write.parquet(f"{folder}/words")
        return files

    def _key_of(self, name: str, df: DataFrame) -> list[str]:
        return [*self.KEYS.get(name, ())] if set(self.KEYS.get(name, ())) <= set(df.columns) else []

    def _listed(self, name: str, df: DataFrame, key: Sequence[str], segments: list[dict], unique: bool = False) -> dict:
        return {"schema": T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in df.schema]).jsonValue(), "key": list(key), "unique": unique, "segments": segments}

    def save(self, graph: Graph, views: dict | None = None, schema: str | None = None) -> None:
        """All tables of ``graph`` as one new version, each of one segment; layouts go. A failed write leaves the old version in place."""
        listed = {}
        for name, df in {"nodes": graph.nodes, "edges": graph.edges, **graph.tables}.items():
            if df is not None:
                key = self._key_of(name, df)
                listed[name] = self._listed(name, df, key, [self._write(name, df, key)])
        self._commit(listed, views=views or self.manifest["views"], schema=schema or self.manifest["schema"])

    def set_schema(self, schema: str) -> None:
        """Another text of the schema; the tables stay as they are."""
        self._commit(self.manifest["tables"], schema=schema)

    def put(self, name: str, df: DataFrame) -> None:
        """One table in a new version; the others stay as they are."""
        key = self._key_of(name, df)
        self._commit({**self.manifest["tables"], name: self._listed(name, df, key, [self._write(name, df, key)])})

    def add_layout(self, table: str, name: str, key: Sequence[str], columns: Sequence[str] | None = None) -> None:
        """A copy of ``table``, or of some of its columns, in buckets of ``key``; appends to the table reach it too."""
        df = self.table(table)
        df = df.select(*columns) if columns else df
        entry = self._listed(name, df, key, [self._write(name, df, key)])
        self._commit({**self.manifest["tables"], name: {**entry, "layout_of": table, "columns": list(columns) if columns else None}})

    # --- appending -----------------------------------------------------------------

    def append(self, name: str, rows: DataFrame, unique: bool = False, views: dict | None = None) -> Appended:
        """``rows`` as one new segment. With ``unique`` only those whose key is new; of repeats among them the first, as
        ``deduplicate`` orders them. Rows that were stored before stay.

        New columns are null in older rows. A column whose stored type can't take the new values makes
        the whole table new, with the types that ``union_by_name`` gives; so does the first unique append
        to a table that holds repeated keys.
        """
        if name not in self.manifest["tables"]:
            self.put(name, rows.limit(0))
        entry, stored = self._entry(name), self._schema(name)
        kinds = {f.name: f.dataType for f in stored}
        added = [c for c in rows.columns if c not in kinds]
        if any(c in kinds and _common_type([kinds[c], rows.schema[c].dataType]) != _nullable(kinds[c]) for c in rows.columns):
            self.put(name, union_by_name([self.table(name), rows.limit(0)]))
            entry, kinds = self._entry(name), {f.name: f.dataType for f in self._schema(name)}
        rows = rows.select(*[_as_type(rows, c, kinds[c]).alias(c) if c in kinds else F.col(c) for c in rows.columns])
        key, left_out, read = entry["key"], None, []
        if unique and not key:
            raise ValueError(f"{name} has no key")
        if unique:
            if not entry["unique"]:
                self._make_unique(name)
                entry = self._entry(name)
            keyed = self._keyed(rows, key)
            held, read = self._held(name, keyed.select("_key", "_bucket").where("_key is not null").distinct())
            keyed = keyed.drop("_bucket").join(held.withColumn("_is_held", F.lit(True)), "_key", "left")
            fresh, old = keyed.where("_is_held is null").drop("_is_held"), keyed.where("_is_held").drop("_is_held")
            first, repeats = deduplicate(fresh, "_key")
            order = [c for c in ("file_source", "provided_by") if c in repeats.columns][:1]
            later = _ranked(repeats, ["_key"], order).where("_rank > 1").drop("_rank", "_n")
            left_out = old.unionByName(later).drop("_key")
            rows = first.drop("_key")
        segment = self._write(name, rows, key)
        schema = T.StructType([*self._schema(name), *(T.StructField(c, _nullable(rows.schema[c].dataType)) for c in added)])
        tables = {**self.manifest["tables"], name: {**entry, "schema": schema.jsonValue(), "unique": unique, "segments": [*entry["segments"], segment]}}
        written = self.spark.read.schema(rows.schema).parquet(self._folder(name, segment["n"]))
        for other, x in list(tables.items()):
            if x.get("layout_of") == name:
                copy = written.select(*x["columns"]) if x["columns"] else written
                tables[other] = {**x, "schema": schema.jsonValue() if not x["columns"] else x["schema"], "segments": [*x["segments"], self._write(other, copy, x["key"])]}
        self._commit(tables, **({"views": views} if views else {}))
        return Appended(segment["rows"], left_out, added, read)

    def _make_unique(self, name: str) -> None:
        entry = self._entry(name)
        repeated = self._keyed(self.bucketed(name), entry["key"]).where("_key is not null").groupBy(*entry["key"]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if not repeated.isEmpty():
            kept, _ = deduplicate(self._keyed(self.table(name), entry["key"]).drop("_bucket"), "_key")
            self.put(name, kept.drop("_key"))
        self.manifest["tables"][name]["unique"] = True

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of a keyed table whose key is in ``keys``, from the files that may hold them alone."""
        key = self._entry(name)["key"]
        maybe, paths = self._may_hold(name, self._keyed(keys.select(*key), key).select("_key", "_bucket").where("_key is not null").distinct())
        if maybe is not None:
            maybe.unpersist()
        if not paths:
            return self.table(name).limit(0)
        found = self.spark.read.schema(self._schema(name)).parquet(*paths)
        return found.join(keys.select(*key).distinct(), key, "left_semi")

    def _may_hold(self, name: str, keys: DataFrame) -> tuple[DataFrame | None, list[str]]:
        """(the keys that may be held, persisted; the files that may hold one); ``keys`` has _key and _bucket."""
        segments = self._entry(name)["segments"]
        if not segments:
            return None, []
        index = lambda part, kinds: self.spark.read.schema(kinds).option("basePath", f"{self.path}/index/{name}").parquet(*[f"{self.path}/index/{name}/seg={s['n']}/{part}" for s in segments])
        files = index("files", "bucket int, file string, rows long, words long, low string, high string, seg int")
        bits = index("words", "bucket int, word long, bits long, seg int")
        asked = keys.join(files, keys["_bucket"] == files["bucket"]).where((F.col("_key") >= F.col("low")) & (F.col("_key") <= F.col("high")))
        asked = asked.select("_key", "seg", "bucket", "file", _word(F.col("_key"), F.col("words")).alias("word"), _mask(F.col("_key")).alias("mask"))
        maybe = asked.join(bits, ["seg", "bucket", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
        maybe = maybe.select("_key", "seg", "file").persist()
        found = maybe.select("seg", "file").distinct().collect()  # a subset of the files' names
        return maybe, sorted(f"{self._folder(name, r['seg'])}/{r['file']}" for r in found)

    def _held(self, name: str, keys: DataFrame) -> tuple[DataFrame, list[str]]:
        """(the keys that the table holds, the files that were read to know it)."""
        maybe, paths = self._may_hold(name, keys)
        if not paths:
            return keys.select("_key").limit(0), []
        try:
            key = self._entry(name)["key"]
            kinds = T.StructType([f for f in self._schema(name) if f.name in key])
            there = self._keyed(self.spark.read.schema(kinds).parquet(*paths), key).select("_key")
            path = f"{self.path}/scratch/{uuid.uuid4().hex}"
            there.join(maybe.select("_key").distinct(), "_key", "left_semi").distinct().write.parquet(path)
            return self.spark.read.schema("_key string").parquet(path), [p.removeprefix(f"{self.path}/tables/{name}/") for p in paths]
        finally:
            maybe.unpersist()

    # --- sketches ------------------------------------------------------------------

    def sketch(self, name: str) -> int:
        """Sketches of the segments that have none yet: distinct values of each plain column, and quantiles of numbers.
        Returns how many segments were read."""
        plain = [f for f in self._schema(name) if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        read = 0
        for s in self._entry(name)["segments"]:
            folder = f"{self.path}/index/{name}/seg={s['n']}/sketches"
            if fs.exists(self.spark, f"{folder}/_SUCCESS"):
                continue
            cells = []
            for f in plain:
                c = F.col(f.name)
                number = isinstance(f.dataType, T.NumericType)
                quantiles = F.kll_sketch_agg_double(c.cast("double"), F.lit(QUANTILE_K)) if number else F.lit(None).cast("binary")
                cells.append(F.struct(F.lit(f.name).alias("column"), F.count(F.lit(1)).alias("rows"), F.count(c).alias("n"), F.hll_sketch_agg(c.cast("string"), F.lit(DISTINCT_LG_K)).alias("distinct"), quantiles.alias("quantiles")))
            rows = self.spark.read.schema(self._schema(name)).parquet(self._folder(name, s["n"])).agg(F.array(*cells).alias("c")).select(F.inline("c"))
            rows.write.mode("overwrite").parquet(folder)
            read += 1
        return read

    def estimates(self, name: str, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
        """(column, rows, n, distinct, quantiles) from the sketches alone, united over the segments: ``n`` values that aren't
        null; the distinct values with a relative standard error of 0.8 %, the quantiles with a rank error of 0.5 %."""
        kinds = "column string, rows long, n long, distinct binary, quantiles binary"
        kept = self.spark.read.schema(kinds).parquet(*[f"{self.path}/index/{name}/seg={s['n']}/sketches" for s in self._entry(name)["segments"]])
        one = kept.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"), F.count("quantiles").alias("_k"), F.kll_merge_agg_double("quantiles").alias("_q"))
        at = F.kll_sketch_get_quantile_double("_q", F.array(*map(F.lit, quantiles)))
        return one.select("column", "rows", "n", "distinct", F.when((F.col("_k") > 0) & (F.col("n") > 0), at).alias("quantiles"))

    def compact(self, name: str) -> None:
        """The segments of a table, and of its layouts, as one each."""
        tables = dict(self.manifest["tables"])
        for t, x in self.manifest["tables"].items():
            if t == name or x.get("layout_of") == name:
                tables[t] = {**x, "segments": [self._write(t, self.table(t), x["key"])]}
        self._commit(tables)

    def vacuum(self) -> None:
        """Remove what the manifest doesn't name: older versions, failed writes, scratch."""
        fs.remove(self.spark, f"{self.path}/scratch")
        last = f"{self.manifest['version']:012d}.json"
        for m in fs.names(self.spark, f"{self.path}/manifests"):
            if m != last:
                fs.remove(self.spark, f"{self.path}/manifests/{m}")
        for top in ("tables", "index"):
            for t in fs.names(self.spark, f"{self.path}/{top}"):
                named = {f"seg={s['n']}" for s in self.manifest["tables"].get(t, {"segments": []})["segments"]}
                for s in fs.names(self.spark, f"{self.path}/{top}/{t}"):
                    if s not in named:
                        fs.remove(self.spark, f"{self.path}/{top}/{t}/{s}")

