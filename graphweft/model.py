"""The property graph and the files it comes from."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from pathlib import PurePosixPath

from pyspark.sql import DataFrame

NODE_COLUMNS = ("id", "category", "name", "description", "xref", "provided_by", "synonym", "in_taxon", "file_source")
EDGE_COLUMNS = ("subject", "predicate", "object", "category", "provided_by", "original_subject", "original_predicate", "original_object", "file_source")
MULTIVALUED = frozenset(("category", "synonym", "xref", "publications", "has_evidence", "aggregator_knowledge_source", "qualifiers"))


@dataclass(frozen=True)
class Graph:
    """Nodes and edges, either of which may be absent, and named further tables (archives, closure tables)."""

    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def with_tables(self, **tables: DataFrame) -> Graph:
        return replace(self, tables={**self.tables, **tables})


@dataclass(frozen=True)
class FileSpec:
    """A file with its format (tsv, jsonl, parquet), table (nodes or edges) and source name."""

    path: str
    format: str
    table: str
    source: str
    slots: tuple[str, ...] | None = None


_FORMATS = {".tsv": "tsv", ".txt": "tsv", ".csv": "csv", ".jsonl": "jsonl", ".json": "json", ".parquet": "parquet", ".yaml": "yaml", ".yml": "yaml"}
_COMPRESSED = (".gz", ".bz2", ".xz")


def infer_file_spec(path: str, table: str | None = None, source: str | None = None) -> FileSpec:
    """Format by extension, below a compression's; table by ``*_nodes`` or ``nodes``; source by the rest of the name."""
    name = PurePosixPath(path).name
    stem = name
    for ending in _COMPRESSED:
        stem = stem.removesuffix(ending)
    suffix = PurePosixPath(stem).suffix
    if suffix not in _FORMATS:
        raise ValueError(f"no format known for {path}")
    stem = stem.removesuffix(suffix)
    found = re.fullmatch(r"(?:(.*)_)?(nodes|edges)", stem)
    if not table and not found:
        raise ValueError(f"{path} names neither nodes nor edges")
    return FileSpec(path, _FORMATS[suffix], table or found[2], source or stem)
