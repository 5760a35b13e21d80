"""Scans: TSV, JSONL, JSON, YAML, Parquet, closure and mapping files, archives; and graph loading."""

from __future__ import annotations

import glob as _glob
import json
import os
import tempfile
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import FileSpec, Graph, infer_file_spec
from ..operators.catalogue import Catalogue, UnknownSlotsError, default_catalogue
from ..operators.integrity import losing_values, missing_required, split_lists, union_by_name, with_provenance
from .archives import kind_of, text_lines, whole_texts
from .delimited import CsvFormat, read_csv, read_delimited

_TSV = {"sep": "\t", "header": True, "inferSchema": False, "quote": '"', "escape": '"', "multiLine": True}


def discover(paths: Iterable[str], endings: Sequence[str] = (".tsv", ".jsonl", ".parquet")) -> list[str]:
    """Folders and globs expanded, in order, each file once."""
    found: dict[str, None] = {}
    for p in paths:
        if os.path.isdir(p) and not p.endswith(".parquet"):
            names = sorted(n for e in endings for n in _glob.glob(os.path.join(p, f"*{e}*")))
        else:
            names = sorted(_glob.glob(p)) if any(c in p for c in "*?[") else [p]
        found.update(dict.fromkeys(names))
    return list(found)


def _text_table(spark: SparkSession, path: str, separator: str, member: str | None = None) -> DataFrame:
    """A delimited file with a header; all columns are text, and empty cells null."""
    if kind_of(path) is None:
        return spark.read.options(**{**_TSV, "sep": separator}).csv(path)
    rows = read_delimited(text_lines(spark, path, [member] if member else None), CsvFormat(separator, comment=None))
    return rows.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in rows.columns if not c.startswith("_")])


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return _text_table(spark, path, "\t")


def read_jsonl(spark: SparkSession, path: str, slots: Sequence[str] | None = None, catalogue: Catalogue | None = None, member: str | None = None) -> DataFrame:
    """Inferred from every record; or with ``slots``, in one pass, other keys dropped and misfits an error."""
    if not slots:
        if kind_of(path):
            return parsed_json(text_lines(spark, path, [member] if member else None).select("value"))
        return spark.read.option("primitivesAsString", False).json(path)
    kinds = (catalogue or default_catalogue()).schema(slots, strict=True)
    wanted = T.StructType([*kinds, T.StructField("_corrupt_record", T.StringType())])
    if kind_of(path):
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
        rows = text_lines(spark, path, [member] if member else None).where("value <> ''").select(F.from_json("value", wanted, options).alias("r")).select("r.*")
    else:
        rows = spark.read.schema(wanted).json(path)
    bad = F.raise_error(F.concat(F.lit("not of the slots' types: "), F.col("_corrupt_record")))
    first, *rest = slots
    return rows.select(F.when(F.col("_corrupt_record").isNotNull(), bad.cast(kinds[first].dataType)).otherwise(F.col(first)).alias(first), *rest)


def read_file(spark: SparkSession, spec: FileSpec, catalogue: Catalogue | None = None) -> DataFrame:
    if spec.format == "tsv":
        return read_tsv(spark, spec.path)
    if spec.format == "csv":
        return _text_table(spark, spec.path, ",")
    if spec.format == "jsonl":
        return read_jsonl(spark, spec.path, spec.slots, catalogue)
    if spec.format == "json":
        return read_json(spark, spec.path)
    if spec.format == "parquet":
        return spark.read.parquet(spec.path)
    if spec.format == "yaml":
        return read_yaml(spark, spec.path)
    raise ValueError(f"no reader for {spec.format}")


def _at(data, path: Sequence[str]) -> list[dict]:
    for key in path:
        data = data[int(key)] if isinstance(data, list) else data[key]
    rows = data if isinstance(data, list) else [data]
    if not all(isinstance(r, dict) for r in rows):
        raise ValueError("records must be objects")
    return rows


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``; below a folder of our own only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphweft-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def parsed_json(lines: DataFrame) -> DataFrame:
    """The records of a one-column frame of JSON texts, with the schema that all of them together have."""
    path = shared_folder(lines.sparkSession, "json")
    lines.write.text(path)
    return lines.sparkSession.read.json(path)


def _documents(texts: DataFrame, at: Sequence[str], parse) -> DataFrame:
    """The records of documents, each parsed by the task that reads it."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for text in batch["value"]:
                yield pd.DataFrame({"value": [json.dumps(r, default=str) for r in _at(parse(text), at)]})

    return parsed_json(texts.mapInPandas(run, "value string"))


def read_yaml(spark: SparkSession, path: str, at: Sequence[str] = (), member: str | None = None) -> DataFrame:
    """The records of YAML documents below the keys ``at``."""
    return _documents(whole_texts(spark, path, [member] if member else None), at, yaml.safe_load)


def read_json(spark: SparkSession, path: str, at: Sequence[str] = (), member: str | None = None) -> DataFrame:
    """The records of a JSON document below the keys ``at``; a list or one object."""
    if kind_of(path):
        return _documents(whole_texts(spark, path, [member] if member else None), at, json.loads)
    rows = spark.read.option("multiLine", True).json(path)
    for key in at:
        kind = rows.schema[key].dataType
        rows = rows.select(F.explode(key).alias("_x")) if isinstance(kind, T.ArrayType) else rows.select(F.col(key).alias("_x"))
        rows = rows.select("_x.*") if isinstance(rows.schema["_x"].dataType, T.StructType) else rows
    return rows


def require_paths(df: DataFrame, paths: Sequence[str]) -> DataFrame:
    """``df``, failing as it is read on a row that lacks one of the dotted paths.

    A key that is there with a null value can't be told from an absent one once records are
    rows, so both fail.
    """
    first = df.columns[0]
    for p in paths:
        if p.split(".")[0] not in df.columns:
            raise ValueError(f"required property {p!r} is absent")
        failed = F.raise_error(F.lit(f"required property {p!r} is absent")).cast(df.schema[first].dataType)
        df = df.withColumn(first, F.when(F.col(p).isNull(), failed).otherwise(F.col(first)))
    return df


def read_closure(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("subject_id string, predicate_id string, object_id string").option("sep", "\t").csv(path)


def read_mappings(spark: SparkSession, paths: Sequence[str], observation: Observation | None = None) -> DataFrame:
    """SSSOM files: the ``#`` header is skipped, ``mapping_source`` is the file's name. Lines with another number of cells
    are left out; ``observation`` gets ``rows`` and ``malformed`` in the pass that uses the rows."""
    frames = []
    for p in paths:
        rows = read_delimited(text_lines(spark, p), CsvFormat("\t"), ragged=True)
        cells = [F.nullif(F.col(c), F.lit("")).alias(c) for c in rows.columns if not c.startswith("_")]
        frames.append(rows.select(*cells, (F.col("_long") | F.col("_short")).alias("_malformed")).withColumn("mapping_source", F.lit(os.path.basename(p))))
    rows = union_by_name(frames)
    if observation is not None:
        rows = rows.observe(observation, F.count_if(~F.col("_malformed")).alias("rows"), F.count_if("_malformed").alias("malformed"))
    return rows.where(~F.col("_malformed")).drop("_malformed")


@dataclass(frozen=True)
class Loaded:
    """``losing`` gives, for each file, how many rows lost values of columns that keep one; it is known once they are written."""

    graph: Graph
    files: list[dict]
    errors: list[dict]
    losing: dict[str, Observation] = field(default_factory=dict)


def load_graph(
    spark: SparkSession, specs: Sequence[FileSpec | str], provided_by: bool = False, required: dict[str, Sequence[str]] | None = None,
    single: Sequence[str] = (), strict: bool = False, catalogue: Catalogue | None = None,
) -> Loaded:
    """Files into nodes and edges, by name. ``provided_by`` overwrites the column with the file's source.

    A file that can't be read is listed in ``errors`` and left out; unknown slots (``strict``) and
    missing required fields abort.
    """
    catalogue = catalogue or default_catalogue()
    parts: dict[str, list[DataFrame]] = {"nodes": [], "edges": []}
    files, errors, losing = [], [], {}
    for spec in [s if isinstance(s, FileSpec) else infer_file_spec(s) for s in specs]:
        try:
            df = read_file(spark, spec, catalogue)
        except UnknownSlotsError:
            raise
        except Exception as e:
            errors.append({"file": spec.path, "error": str(e).splitlines()[0]})
            continue
        if strict:
            catalogue.schema(df.columns, strict=True)
        df = split_lists(with_provenance(df, spec.source, spec.source if provided_by else None), sorted(catalogue.multivalued()))
        many = [c for c in single if c in df.columns and isinstance(df.schema[c].dataType, T.ArrayType)]
        if many:
            losing[spec.path] = Observation()
            df = split_lists(df.observe(losing[spec.path], *[losing_values(df, c).alias(c) for c in many]), (), many)
        if required and required.get(spec.table):
            bad = [r for r in missing_required(df, list(required[spec.table])).collect() if r["missing"]]
            if bad:
                raise ValueError(f"{spec.path}: {', '.join(f'{r.missing} of {r.total} rows lack {r.field}' for r in bad)}")
        files.append({"file": spec.path, "table": spec.table, "source": spec.source, "columns": [(f.name, f.dataType.simpleString()) for f in df.schema]})
        parts[spec.table].append(df)
    made = {t: union_by_name(x) if x else None for t, x in parts.items()}
    return Loaded(Graph(made["nodes"], made["edges"]), files, errors, losing)


def join_graphs(spark: SparkSession, specs: Sequence[FileSpec | str], **options) -> Loaded:
    """``load_graph`` with ``provided_by`` from the files."""
    return load_graph(spark, specs, provided_by=True, **options)


def slots_of(path: str) -> dict[str, tuple[str, ...]]:
    """A slots file: {nodes: [...], edges: [...]}."""
    with open(path) as f:
        data = yaml.safe_load(f)
    if not isinstance(data, dict) or set(data) - {"nodes", "edges"} or not all(isinstance(v, list) and all(isinstance(x, str) for x in v) for v in data.values()):
        raise ValueError(f"{path} must list slots for nodes and edges")
    return {k: tuple(v) for k, v in data.items()}
