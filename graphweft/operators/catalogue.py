"""The model catalogue: slots, classes and enums, as data; types, strictness and constraints derived from it."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import checkpointed

SCALARS = {
    "integer": T.LongType(), "float": T.DoubleType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "string": T.StringType(), "uriorcurie": T.StringType(), "date": T.StringType(), "datetime": T.StringType(), "time": T.StringType(),
}
INGEST_EXTRAS = ("file_source", "provided_by")

#: A compact default model. A full one can be loaded from YAML.
DEFAULT_MODEL = """
slots:
  id: {range: string, identifier: true}
  name: {range: string}
  description: {range: string}
  category: {range: uriorcurie, multivalued: true, designates_type: true}
  type: {range: string}
  synonym: {range: string, multivalued: true}
  xref: {range: uriorcurie, multivalued: true}
  in_taxon: {range: organism taxon, multivalued: true}
  in_taxon_label: {range: string}
  deprecated: {range: boolean}
  subject: {range: named thing}
  object: {range: named thing}
  predicate: {range: uriorcurie, predicate: true}
  negated: {range: boolean}
  publications: {range: publication, multivalued: true}
  has_evidence: {range: evidence type, multivalued: true}
  knowledge_level: {range: KnowledgeLevelEnum}
  agent_type: {range: AgentTypeEnum}
  knowledge_source: {range: uriorcurie}
  primary_knowledge_source: {range: uriorcurie, is_a: knowledge_source}
  aggregator_knowledge_source: {range: uriorcurie, multivalued: true, is_a: knowledge_source}
  p_value: {range: float}
  has_confidence_score: {range: float}
  evidence_count: {range: integer}
  original_subject: {range: string}
  original_predicate: {range: uriorcurie}
  original_object: {range: string}
  sources: {range: retrieval source, multivalued: true, inlined: true, inlined_as_list: true}
  resource_id: {range: uriorcurie}
  resource_role: {range: ResourceRoleEnum}
  has_supporting_studies: {range: study, multivalued: true, inlined: true}
enums:
  KnowledgeLevelEnum: [knowledge_assertion, logical_entailment, prediction, statistical_association, observation, not_provided]
  AgentTypeEnum: [manual_agent, automated_agent, data_analysis_pipeline, computational_model, text_mining_agent, not_provided]
  ResourceRoleEnum: [primary_knowledge_source, aggregator_knowledge_source, supporting_data_source]
classes:
  entity: {}
  named thing: {is_a: entity}
  gene: {is_a: named thing, id_prefixes: [HGNC, NCBIGene, ENSEMBL]}
  disease: {is_a: named thing, id_prefixes: [MONDO, DOID, OMIM]}
  phenotypic feature: {is_a: named thing, id_prefixes: [HP, MP]}
  organism taxon: {is_a: named thing, id_prefixes: [NCBITaxon]}
  publication: {is_a: named thing}
  evidence type: {is_a: named thing}
  association: {is_a: entity}
  gene to gene association: {is_a: association, slot_usage: {subject: gene, predicate: [regulates, interacts_with], object: gene}}
  gene to disease association: {is_a: association, slot_usage: {subject: gene, predicate: [causes, contributes_to], object: disease}}
  retrieval source: {slots: [resource_id, resource_role]}
  study: {slots: [id, name]}
predicates:
  related_to: {domain: named thing, range: named thing}
  has_phenotype: {domain: disease, range: phenotypic feature}
"""


class UnknownSlotsError(ValueError):
    pass


def snake(name: str) -> str:
    return name.replace(" ", "_")


def camel(name: str) -> str:
    return "".join(w[:1].upper() + w[1:] for w in name.split())


@dataclass(frozen=True)
class Catalogue:
    slots: dict[str, dict] = field(default_factory=dict)
    classes: dict[str, dict] = field(default_factory=dict)
    enums: dict[str, list] = field(default_factory=dict)
    predicates: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def load(cls, text: str) -> Catalogue:
        data = yaml.safe_load(text) or {}
        return cls(
            {snake(k): v or {} for k, v in (data.get("slots") or {}).items()},
            {k: v or {} for k, v in (data.get("classes") or {}).items()},
            data.get("enums") or {},
            {snake(k): v or {} for k, v in (data.get("predicates") or {}).items()},
        )

    # --- inheritance
    def parents(self, name: str) -> list[str]:
        """The classes that a class is derived from: its ``is_a`` and its mixins."""
        x = self.classes.get(name, {})
        return [p for p in (x.get("is_a"), *(x.get("mixins") or ())) if p in self.classes]

    def ancestors(self, name: str) -> list[str]:
        out, open_ = [], [name] if name in self.classes else []
        while open_:
            now = open_.pop(0)
            if now not in out:
                out.append(now)
                open_ += self.parents(now)
        return out

    def descendants(self, name: str) -> list[str]:
        return [c for c in self.classes if name in self.ancestors(c)]

    def slot_ancestors(self, name: str) -> list[str]:
        out = []
        while name and name not in out:
            out.append(name)
            name = snake(self.slots.get(name, {}).get("is_a", ""))
        return out

    # --- types
    def multivalued(self) -> set[str]:
        return {s for s, x in self.slots.items() if x.get("multivalued")}

    def slot_type(self, name: str, depth: int = 0) -> T.DataType:
        """The Spark type of a slot; unknown slots, and classes nested deeper than two, are text."""
        slot = self.slots.get(name)
        if slot is None:
            return T.StringType()
        kind = slot.get("range", "string")
        if kind not in self.classes:
            scalar = SCALARS.get(kind, T.StringType())
            return T.ArrayType(scalar) if slot.get("multivalued") else scalar
        inlined = slot.get("inlined") or slot.get("inlined_as_list")
        if not slot.get("multivalued"):
            return T.StringType()
        if not inlined:
            return T.ArrayType(T.StringType())
        own = self.classes[kind].get("slots", [])
        inner = T.StructType([T.StructField(snake(s), self.slot_type(snake(s), depth + 1)) for s in own]) if own and depth < 2 else T.StringType()
        return T.ArrayType(inner) if slot.get("inlined_as_list") else T.MapType(T.StringType(), inner)

    def schema(self, columns: Iterable[str], strict: bool = False) -> T.StructType:
        columns = list(columns)
        unknown = [c for c in columns if c not in self.slots and c not in INGEST_EXTRAS and not c.startswith("_")]
        if strict and unknown:
            raise UnknownSlotsError(f"not in the model: {', '.join(unknown)}")
        return T.StructType([T.StructField(c, self.slot_type(c)) for c in columns])

    def categorical(self, name: str) -> bool | None:
        """Whether a column is categorical by the model; None leaves it to its values."""
        slot = self.slots.get(name)
        if slot is None:
            return None
        if slot.get("identifier"):
            return False
        if slot.get("designates_type") or slot.get("range") in self.enums or slot.get("range") == "boolean" or slot.get("predicate"):
            return True
        if set(self.slot_ancestors(name)) & {"type", "knowledge_source"}:
            return True
        kind = slot.get("range", "string")
        if kind in ("string", "integer", "float", "double", "date", "datetime", "time"):
            return False
        return False if "entity" in self.ancestors(kind) else None

    # --- constraints
    def class_constraints(self) -> dict[str, dict[str, list[str]]]:
        """Of each association class with slot usage: its subject classes, predicates and object classes."""
        out = {}
        for c, x in self.classes.items():
            use = x.get("slot_usage")
            if use and {"subject", "predicate", "object"} <= set(use):
                predicates = use["predicate"] if isinstance(use["predicate"], list) else [use["predicate"]]
                out[f"biolink:{camel(c)}"] = {
                    "subjects": [f"biolink:{camel(d)}" for d in self.descendants(use["subject"])],
                    "predicates": [f"biolink:{snake(p)}" for p in predicates],
                    "objects": [f"biolink:{camel(d)}" for d in self.descendants(use["object"])],
                }
        return out

    def legal_types(self) -> list[tuple[str, str, str]]:
        """(subject class, predicate, object class) of every class constraint and predicate domain and range."""
        found = {(s, p, o) for x in self.class_constraints().values() for s in x["subjects"] for p in x["predicates"] for o in x["objects"]}
        for p, x in self.predicates.items():
            for s in self.descendants(x["domain"]):
                found |= {(f"biolink:{camel(s)}", f"biolink:{p}", f"biolink:{camel(o)}") for o in self.descendants(x["range"])}
        return sorted(found)

    def relations(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The model as tables, each of the model's own size: ``lineage`` (class, ancestor), ``constraints`` (association, subject,
        predicate, object) and ``legal`` (subject, predicate, object), whose classes stand for their descendants too, and ``prefixes``
        (class, prefix)."""
        named = lambda c: f"biolink:{camel(c)}"
        parents = [(named(c), named(p)) for c in self.classes for p in self.parents(c)] + [(named(c), named(c)) for c in self.classes]
        bound = []
        for c, x in self.classes.items():
            use = x.get("slot_usage")
            if use and {"subject", "predicate", "object"} <= set(use):
                predicates = use["predicate"] if isinstance(use["predicate"], list) else [use["predicate"]]
                bound += [(named(c), named(use["subject"]), f"biolink:{snake(p)}", named(use["object"])) for p in predicates]
        legal = {x[1:] for x in bound} | {(named(x["domain"]), f"biolink:{p}", named(x["range"])) for p, x in self.predicates.items()}
        own = [(c, p) for c, ps in self.prefixes().items() for p in ps]
        made = {
            "constraints": (bound, "association string, subject string, predicate string, object string"),
            "legal": (sorted(legal), "subject string, predicate string, object string"),
            "prefixes": (own, "class string, prefix string"),
            "lineage": (parents, "class string, ancestor string"),
        }
        tables = {k: spark.createDataFrame(rows, kinds) for k, (rows, kinds) in made.items()}
        return {**tables, "lineage": closed(tables["lineage"])}

    def prefixes(self) -> dict[str, list[str]]:
        return {f"biolink:{camel(c)}": x["id_prefixes"] for c, x in self.classes.items() if x.get("id_prefixes")}


def closed(lineage: DataFrame) -> DataFrame:
    """(class, ancestor) with all ancestors, from pairs that include each class with itself. Each round doubles the length of the
    paths that are covered, so the rounds grow with the logarithm of the hierarchy's depth; rings are no trouble."""
    pairs, n = checkpointed(lineage.distinct()), -1
    while n != (n := pairs.count()):
        up = pairs.select(F.col("class").alias("ancestor"), F.col("ancestor").alias("_up"))
        pairs = checkpointed(pairs.join(up, "ancestor").select("class", F.col("_up").alias("ancestor")).distinct())
    return pairs


@lru_cache(maxsize=1)
def default_catalogue() -> Catalogue:
    return Catalogue.load(DEFAULT_MODEL)


def ensure_slots(df: DataFrame, columns: Iterable[str], catalogue: Catalogue | None = None) -> DataFrame:
    """``df`` with the columns that it lacks, null, of their model type."""
    catalogue = catalogue or default_catalogue()
    return df.withColumns({c: F.lit(None).cast(catalogue.slot_type(c)) for c in columns if c not in df.columns})


def export_schema(tables: dict[str, DataFrame], catalogue: Catalogue | None = None) -> str:
    """A standalone YAML schema: a class for each table with its columns' types."""
    catalogue = catalogue or default_catalogue()
    classes = {t: {"slots": list(df.columns)} for t, df in tables.items()}
    slots = {f.name: {"range": catalogue.slots.get(f.name, {}).get("range", "string"), "spark_type": f.dataType.simpleString(), "multivalued": isinstance(f.dataType, (T.ArrayType, T.MapType))} for df in tables.values() for f in df.schema}
    return yaml.safe_dump({"name": "property_graph", "classes": classes, "slots": slots, "enums": catalogue.enums}, sort_keys=False)
