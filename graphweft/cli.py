"""Command line: python -m graphweft.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from . import operations as op
from .operators import profile
from .operators import reports as rp
from .sources import sinks

COMMANDS = (
    "transform", "join", "load", "split", "schema-export", "closurize", "information-content", "profile", "prune", "append", "normalize",
    "deduplicate", "merge", "report", "node-report", "edge-report", "node-examples", "edge-examples", "export", "convert", "model-check", "connectivity",
    "lay-out",
)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphweft")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("files", nargs="*")
    p.add_argument("--store")
    p.add_argument("--output")
    p.add_argument("--format", default="tsv", choices=("tsv", "jsonl", "parquet", "yaml", "text"))
    p.add_argument("--kind", default="qc", choices=("qc", "graph-stats", "schema", "connectivity"))
    p.add_argument("--columns", nargs="*", default=())
    p.add_argument("--sets", nargs="*", default=())
    p.add_argument("--percentiles", nargs="*", default=())
    p.add_argument("--mappings", nargs="*", default=())
    p.add_argument("--predicates", nargs="*", default=())
    p.add_argument("--skip", nargs="*", default=())
    p.add_argument("--closure")
    p.add_argument("--slots")
    p.add_argument("--model")
    p.add_argument("--n", type=int, default=5)
    p.add_argument("--min-component", type=int)
    for flag in ("remove-singletons", "deduplicate-rows", "archive", "compress", "strict"):
        p.add_argument(f"--{flag}", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("graphweft").getOrCreate()
    c = a.command

    def reported(df) -> dict:
        return {"rows": sinks.write_report(df, a.output, a.format), "file": a.output}

    if c in ("join", "load"):
        out = op.load(spark, a.store, a.files, c == "join", a.slots, strict=a.strict)
    elif c == "append":
        out = op.append(spark, a.store, a.files, a.deduplicate_rows)
    elif c == "deduplicate":
        out = op.deduplicate(spark, a.store)
    elif c == "normalize":
        out = op.normalize(spark, a.store, a.mappings)
    elif c == "prune":
        out = op.prune(spark, a.store, a.remove_singletons, a.min_component)
    elif c == "merge":
        out = op.merge(spark, a.store, a.files, a.mappings, a.skip, a.remove_singletons, a.output, a.format, a.archive, a.compress)
    elif c == "split":
        out = op.split(spark, a.files[0], a.output, a.columns, a.format)
    elif c == "export":
        out = op.export(spark, a.store, a.output, format=a.format, archive=a.archive, compress=a.compress)
    elif c == "convert":
        out = op.convert(spark, a.files, a.output, format=a.format)
    elif c == "closurize":
        out = op.closurize(spark, a.store, a.closure)
    elif c == "lay-out":
        op.lay_out(spark, a.store)
        out = {"store": a.store}
    elif c == "information-content":
        out = op.information_content(spark, a.store, a.predicates)
    elif c == "transform":
        from .ingest import runner

        out = {str(t): "written" for t in runner.run(spark, runner.config_of(a.files[0], a.files[1:]) if a.files[0].endswith(".py") else runner.load_config(a.files[0]), output=a.output)}
    else:
        graph = op.graph_of(spark, a.store, a.files)
        if c == "report":
            if a.format == "yaml" and a.kind == "qc":
                sinks.write_yaml(op.qc_report(graph), a.output)
                out = {"file": a.output}
            else:
                out = reported(op.report(graph, a.kind))
        elif c == "connectivity":
            out = op.connectivity_tables(graph, a.output)
        elif c == "profile" and a.format == "text":
            found = op.profile(graph, 50).orderBy("table_name", "column_name", F.desc("count"), "value").collect()  # 50 rows a column at most
            with open(a.output, "w") as f:
                f.write(profile.render([(r["column_name"], r["value"], r["count"], r["share"]) for r in found]) + "\n")
            out = {"file": a.output}
        elif c == "profile":
            out = reported(op.profile(graph))
        elif c == "node-report":
            out = reported(rp.node_report(graph.nodes, a.columns or rp.NODE_REPORT))
        elif c == "edge-report":
            out = reported(rp.edge_report(graph.edges, graph.nodes, a.columns or rp.EDGE_REPORT, a.sets, a.percentiles, exact=False))
        elif c == "node-examples":
            out = reported(rp.node_examples(graph.nodes, a.n))
        elif c == "edge-examples":
            out = reported(rp.edge_examples(graph.edges, graph.nodes, a.n))
        elif c == "schema-export":
            from .operators.catalogue import export_schema

            with open(a.output, "w") as f:
                f.write(export_schema({t: df for t, df in (("nodes", graph.nodes), ("edges", graph.edges)) if df is not None}))
            out = {"file": a.output}
        else:
            types, prefixes = op.model_check(graph, a.model)
            out = {"types": sinks.write_report(types, a.output, a.format), "prefixes": sinks.write_report(prefixes, f"{a.output}.prefixes", a.format)}
    print(json.dumps(out, default=str, indent=1))


if __name__ == "__main__":
    main()
