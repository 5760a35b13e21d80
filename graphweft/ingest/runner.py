"""The ingest run: read, filter, prepare, transform, split into nodes and edges, write."""

from __future__ import annotations

import importlib.util
import inspect
import json
import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import RowFilter, filtered
from ..model import Graph
from ..operators.components import checkpointed
from ..operators.lookup import looked_up, mapped_on_write, mapping_table
from ..operators.integrity import union_by_name
from ..sources import archives
from ..sources.archives import members_of, text_lines
from ..sources.delimited import CsvFormat, read_delimited
from ..sources.positions import PLACE, first_rows, placed, union_in_order
from ..sources.readers import parsed_json, read_json, read_jsonl, read_mappings, read_yaml, require_paths
from ..sources.sinks import write_nodes_and_edges

# --- hooks -------------------------------------------------------------------


def _hook(kind: str):
    def mark(tag: str | Sequence[str] | Callable | None = None):
        def add(f: Callable, own: str | Sequence[str] | None = None) -> Callable:
            f._ingest_hook = (kind, (own,) if own is None or isinstance(own, str) else tuple(own))
            return f

        return add(tag) if callable(tag) else lambda f: add(f, tag)

    return mark


prepare_data, transform, transform_record, on_data_begin, on_data_end = map(_hook, ("prepare", "transform", "record", "begin", "end"))


@dataclass(frozen=True)
class State:
    """What is gathered over records: ``zero()``, ``add(value, record)`` and ``merge(value, value)``, all of JSON values.

    Each task folds its own records and hands on one value as a row of its output, so a task that is
    tried again is counted once. Records come in no order, so ``merge`` must not depend on it.
    """

    name: str
    zero: Callable
    add: Callable
    merge: Callable


def state(name: str, zero: Callable, merge: Callable, tag: str | None = None):
    """Marks ``add(value, record)`` as the fold of a state that the end hooks find in ``context.state[name]``."""

    def mark(add: Callable) -> Callable:
        add._ingest_hook, add._ingest_state = ("state", (tag,)), State(name, zero, add, merge)
        return add

    return mark


@dataclass
class Hooks:
    prepare: list[Callable] = field(default_factory=list)
    transform: list[Callable] = field(default_factory=list)
    record: list[Callable] = field(default_factory=list)
    begin: list[Callable] = field(default_factory=list)
    end: list[Callable] = field(default_factory=list)
    state: list[Callable] = field(default_factory=list)

    @property
    def states(self) -> list[State]:
        return [f._ingest_state for f in self.state]

    def check(self) -> None:
        if bool(self.transform) == bool(self.record):
            raise ValueError("either one whole-source transform or record transforms are needed")
        if len(self.transform) > 1 or len(self.prepare) > 1:
            raise ValueError("more than one transform or prepare_data")


def hooks_of(module) -> dict[str | None, Hooks]:
    """The decorated functions of a module, by tag."""
    found: dict[str | None, Hooks] = {}
    for f in vars(module).values():
        kind, tags = getattr(f, "_ingest_hook", (None, ()))
        for tag in tags:
            getattr(found.setdefault(tag, Hooks()), kind).append(f)
    return found


def module_at(path: str):
    spec = importlib.util.spec_from_file_location("ingest_code", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


# --- entities -------------------------------------------------------------------


def kind_of(entity: dict) -> str:
    """edges if it has subject, predicate and object; nodes if it has id and name; else an error."""
    if all(k in entity for k in ("subject", "predicate", "object")):
        return "edges"
    if "id" in entity and "name" in entity:
        return "nodes"
    raise ValueError(f"neither a node nor an edge: {entity}")


def _as_dict(entity) -> dict:
    return entity if isinstance(entity, dict) else {k: v for k, v in vars(entity).items() if v is not None}


def _emitted(functions: Sequence[Callable], states: Sequence[State]):
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        values = {s.name: s.zero() for s in states}
        for batch in batches:
            out = []
            for text in batch["record"]:
                record = json.loads(text)
                for s in states:
                    values[s.name] = s.add(values[s.name], record)
                for f in functions:
                    for entity in map(_as_dict, f(record) or ()):
                        out.append((kind_of(entity), json.dumps(entity)))
            yield pd.DataFrame(out, columns=["kind", "entity"])
        if states:
            yield pd.DataFrame([(f"state {k}", json.dumps(v)) for k, v in values.items()], columns=["kind", "entity"])

    return run


def _merged(states: Sequence[State]):
    """The values of a task's rows, merged into one for each state."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        by, values = {f"state {s.name}": s for s in states}, {}
        for batch in batches:
            for kind, text in zip(batch["kind"], batch["entity"], strict=True):
                value = json.loads(text)
                values[kind] = by[kind].merge(values[kind], value) if kind in values else value
        yield pd.DataFrame([(k, json.dumps(v)) for k, v in values.items()], columns=["kind", "entity"])

    return run


def gathered(rows: DataFrame, states: Sequence[State], fan_in: int = 32) -> dict:
    """Each state's value. Tasks' values are merged by tasks, so many at a time, until few are left."""
    found = rows.where(F.col("kind").startswith("state "))
    parts = rows.rdd.getNumPartitions() if states else 0
    while parts > fan_in:
        parts = -(-parts // fan_in)
        found = found.repartition(parts).mapInPandas(_merged(states), "kind string, entity string")
    values = {s.name: s.zero() for s in states}
    by = {f"state {s.name}": s for s in states}
    for r in found.collect() if states else ():  # at most fan_in rows a state
        s = by[r["kind"]]
        values[s.name] = s.merge(values[s.name], json.loads(r["entity"]))
    return values


def _entities(rows: DataFrame, node_schema: str | None, edge_schema: str | None) -> Graph:
    """One table for each kind of entity in rows (kind, JSON)."""
    made = {}
    for kind, schema in (("nodes", node_schema), ("edges", edge_schema)):
        own = rows.where(F.col("kind") == kind).select("entity")
        if schema is None:
            found = parsed_json(own)
            made[kind] = found if found.columns else None
        else:
            made[kind] = own.select(F.from_json("entity", schema).alias("e")).select("e.*")
    return Graph(made["nodes"], made["edges"])


def records_to_graph(df: DataFrame, functions: Sequence[Callable], node_schema: str | None = None, edge_schema: str | None = None, states: Sequence[State] = (), into: dict | None = None) -> Graph:
    """Row-at-a-time Python: each record's entities, as rows (kind, JSON), then one table a kind. ``into`` gets the states' values.

    Schemas are given, or inferred from the entities. Without them, or with states, the emitted rows are kept in a checkpoint.
    """
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record")).mapInPandas(_emitted(functions, states), "kind string, entity string")
    if states or not (node_schema and edge_schema):
        rows = checkpointed(rows)
    if states and into is not None:
        into.update(gathered(rows, states))
    return _entities(rows, node_schema, edge_schema)


def with_entities(graph: Graph, spark: SparkSession, entities: Sequence) -> Graph:
    """``graph`` with what an end hook returned, a list that the driver holds."""
    if not entities:
        return graph
    rows = spark.createDataFrame([(kind_of(x), json.dumps(x)) for x in map(_as_dict, entities)], "kind string, entity string")
    more = _entities(rows, None, None)
    both = [[x for x in (getattr(graph, t), getattr(more, t)) if x is not None] for t in ("nodes", "edges")]
    return Graph(*[union_by_name(x) if x else None for x in both], graph.tables)


# --- configuration ----------------------------------------------------------------


class _Loader(yaml.SafeLoader):
    pass


def _include(loader, node):
    with open(os.path.join(os.path.dirname(loader.name), loader.construct_scalar(node))) as f:
        return yaml.load(f, _Loader)


def _mapping(loader, node, deep=False):
    keys = [loader.construct_object(k, deep=deep) for k, _ in node.value]
    repeated = {k for k in keys if keys.count(k) > 1}
    if repeated:
        raise ValueError(f"repeated keys: {sorted(map(str, repeated))}")
    return yaml.SafeLoader.construct_mapping(loader, node, deep)


_Loader.add_constructor("!include", _include)
_Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, _mapping)


def merged(base: dict, over: dict) -> dict:
    """``over`` laid over ``base``, mappings merged at every depth."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(path: str, overrides: dict | None = None) -> dict:
    with open(path) as f:
        config = yaml.load(f, _Loader)
    return merged(config, overrides or {})


def csv_format(reader: dict) -> CsvFormat:
    columns = reader.get("columns") or []
    names = [next(iter(c)) if isinstance(c, dict) else c for c in columns]
    types = {next(iter(c)): next(iter(c.values())) for c in columns if isinstance(c, dict)}
    return CsvFormat(
        reader.get("delimiter", "\t"), reader.get("header_mode", "infer"), tuple(names), types, reader.get("comment_char", "#"),
        reader.get("header_prefix") or "", reader.get("header_delimiter"), reader.get("skip_blank_lines", True), reader.get("dialect", "excel"),
    )


def _parts(reader: dict) -> list[tuple[str, str | None]]:
    """(file, member) of a reader in order: its files, all members of those that are archives, or the chosen members of ``file_archive``."""
    if archive := reader.get("file_archive"):
        there = members_of(archive)
        if absent := set(reader.get("files") or ()) - set(there):
            raise FileNotFoundError(f"not in {archive}: {sorted(absent)}")
        return [(archive, m) for m in there if not reader.get("files") or m in reader["files"]]
    return [(f, m) for f in reader["files"] for m in (members_of(f) if archives.kind_of(f) in ("zip", "tar") else [None])]


def read_source(spark: SparkSession, reader: dict) -> DataFrame:
    """A reader's configuration: files or members of an archive, format, csv options, json_path, filters, limit.

    ``limit`` takes the first rows that pass the filters, in the order of the files and of their lines.
    """
    kind, keys = reader.get("format", "csv"), reader.get("json_path") or ()
    frames = []
    for path, member in _parts(reader):
        if kind == "csv":
            frames.append(read_delimited(text_lines(spark, path, [member] if member else None), csv_format(reader)).drop("_long"))
            continue
        df = {"jsonl": lambda: read_jsonl(spark, path, member=member), "json": lambda: read_json(spark, path, keys, member), "yaml": lambda: read_yaml(spark, path, keys, member)}[kind]()  # noqa: B023
        frames.append(placed(df) if reader.get("limit") else df)
    df = union_in_order(frames) if kind == "csv" or reader.get("limit") else union_by_name(frames)
    own = [c for c in df.columns if c not in PLACE]
    if reader.get("required_properties"):
        df = require_paths(df, reader["required_properties"])
    rows = [RowFilter(x["column"], x.get("filter_code", "eq"), x["value"], x.get("inclusion", "include") == "include") for x in reader.get("filters", ())]
    df = filtered(df, rows)
    return first_rows(df, reader["limit"]) if reader.get("limit") else df.select(*own)


def mappings_of(spark: SparkSession, config: dict) -> dict[str, dict[str, DataFrame]]:
    """map name to value column to (key, value)."""
    out = {}
    for name, m in (config.get("mappings") or {}).items():
        df = read_source(spark, m["reader"])
        out[name] = {v: mapping_table(df, m["key"], v) for v in m["values"]}
    return out


@dataclass(frozen=True)
class Context:
    """What hooks get besides their frame: the configuration, its metadata, the mappings, and a dictionary of their own.

    ``state`` holds what begin hooks put there and, before the end hooks, the values of the states that were
    gathered over the records; tasks can't read it.
    """

    config: dict
    mappings: dict[str, dict[str, DataFrame]]
    state: dict = field(default_factory=dict)

    @property
    def metadata(self) -> dict:
        return self.config.get("metadata") or {}

    def lookup(self, df: DataFrame, column: str, maps: Sequence[str], value: str, into: str, on_failure: str = "warning") -> DataFrame:
        """``into``: ``column`` translated by the first of the named maps that has it; see ``looked_up``."""
        return looked_up(df, column, [self.mappings[m][value] for m in maps], into, on_failure)


def _called(f: Callable, context: Context, *frames: DataFrame):
    """A hook takes its frames, if any, and after them the context if it has room for it."""
    room = len(inspect.signature(f).parameters) > len(frames)
    return f(*frames, context) if room else f(*frames)


def _written(context: Context, spark: SparkSession, graph: Graph, output: str, name: str) -> None:
    writer = context.config.get("writer") or {}
    edges, sssom = graph.edges, writer.get("sssom")
    if sssom and edges is not None:
        edges = mapped_on_write(edges, read_mappings(spark, sssom["files"]), sssom.get("subject_target_prefixes") or (), sssom.get("object_target_prefixes") or ())
    nodes, edges = (with_properties(df, writer.get(p)) for df, p in ((graph.nodes, "node_properties"), (edges, "edge_properties")))
    limits = {t: (writer.get(f"min_{t[:-1]}_count"), writer.get(f"max_{t[:-1]}_count")) for t in ("nodes", "edges")}
    write_nodes_and_edges(nodes, edges, output, name, writer.get("format", "tsv"), writer.get("dedupe_nodes", True), limits)


def with_properties(df: DataFrame | None, properties: Sequence[str] | None) -> DataFrame | None:
    """Just the listed columns, in a fixed header: those that are missing are null."""
    if df is None or not properties:
        return df
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in properties])


def run(spark: SparkSession, config: dict, module=None, output: str | None = None) -> dict[str | None, Graph]:
    """Run a configuration: for each tagged reader, look up, prepare, transform and, with ``output``, write.

    A reader's ``lookups`` (column, maps, value, into, on_failure) are made before
    the hooks, so record transforms find them as columns. Entities that end hooks return join the graph. ``writer.sssom`` maps edge
    ends by exact match, and ``node_properties`` and ``edge_properties`` fix the header.
    """
    module = module or module_at(config["transform"]["code"])
    readers = config.get("readers") or {None: config["reader"]}
    context = Context(config, mappings_of(spark, config))
    found, out = hooks_of(module), {}
    for tag, reader in readers.items():
        hooks = found.get(tag) or found.get(None) or Hooks()
        hooks.check()
        df = read_source(spark, reader)
        for x in reader.get("lookups") or ():
            df = context.lookup(df, x["column"], x["maps"], x["value"], x["into"], x.get("on_failure", "warning"))
        for f in hooks.begin:
            _called(f, context)
        for f in hooks.prepare:
            df = _called(f, context, df)
        if hooks.transform:
            graph = _called(hooks.transform[0], context, df)
            if hooks.states:
                records_to_graph(df, (), "id string", "id string", hooks.states, context.state)
        else:
            graph = records_to_graph(df, hooks.record, states=hooks.states, into=context.state)
        for f in hooks.end:
            graph = with_entities(graph, spark, _called(f, context) or ())
        out[tag] = graph
        if output:
            _written(context, spark, graph, output, config.get("name", "ingest") + (f"_{tag}" if tag else ""))
    return out


def config_of(code: str, files: Sequence[str], name: str | None = None) -> dict:
    """A configuration from a transform's file and the input files alone: format and delimiter by the files' endings."""
    ending = next(e for f in files for e in (os.path.splitext(f.removesuffix(".gz").removesuffix(".bz2"))[1],))
    kinds = {".jsonl": "jsonl", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".csv": "csv", ".tsv": "csv", ".txt": "csv"}
    if ending not in kinds:
        raise ValueError(f"no format known for {files[0]}")
    reader = {"files": list(files), "format": kinds[ending], "delimiter": "," if ending == ".csv" else "\t"}
    return {"name": name or os.path.splitext(os.path.basename(code))[0], "reader": reader, "transform": {"code": code}}
