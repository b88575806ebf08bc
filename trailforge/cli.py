"""Command line: ingest a trace, reconstruct a manifest, evaluate, validate a mapping, export schemas.

User errors end with status 2.
"""

from __future__ import annotations

import argparse
import dataclasses
import importlib
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from trailforge import __version__

ADAPTERS = ("agentframework", "anthropic", "bedrock", "crewai", "generic_jsonl", "langsmith", "mcp", "openai_agents", "otlp", "pydantic_ai")


def session() -> SparkSession:
    active = SparkSession.getActiveSession()
    return active or SparkSession.builder.appName("trailforge").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _put(document: str, path: str, newline: str = "\n") -> None:
    text = json.dumps(json.loads(document), indent=2) + newline
    if path == "-":
        sys.stdout.write(text)
    else:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text)


def _module(name: str):
    return importlib.import_module(f"trailforge.adapters.{name.replace('-', '_')}")


def ingest(args: argparse.Namespace) -> None:
    from trailforge.sources import manifests

    module, spark = _module(args.adapter), session()
    given = {f.name: getattr(args, f.name) for f in dataclasses.fields(module.Options) if getattr(args, f.name, None) is not None}
    more = {"mapping": module.load_mapping(args.mapping)} if args.adapter == "generic-jsonl" else {}
    rows = manifests.manifests(*module.ingest(spark, args.from_file, args.scenario_id, module.Options(**given), **more)).orderBy("scenario_id").collect()
    if len(rows) == 1:
        _put(rows[0].manifest, args.out)
        return
    for r in rows:  # several traces of one file: a manifest each
        _put(r.manifest, str(Path(args.out) / f"{r.scenario_id}.json") if args.out != "-" else "-")


def reconstruct(args: argparse.Namespace) -> None:
    from trailforge.operators import classify, prov
    from trailforge.sources import manifests

    scenarios, fragments = manifests.read_manifests(session(), args.input)
    report = classify.feasibility_json(classify.reconstruct(scenarios, fragments)).first().report
    _put(report, str(Path(args.out) / "feasibility.json"))
    if args.jsonld:
        _put(prov.graphs(prov.nodes(scenarios, fragments)).first().document, str(Path(args.out) / "trace.jsonld"))
    data = json.loads(report)
    print(f"{data['scenario_id']}: {data['fragments']} fragments, {data['units_detected']} units, {data['completeness_pct']} % complete, dominant mode {data['dominant_mode'] or 'none'}")


def _listed(rows, order: str) -> list[dict]:
    """Result rows, in order: a table of cells, properties or scenarios of an evaluation."""
    return [r.asDict(recursive=True) for r in rows.orderBy(order).drop(order).collect()]


def evaluate_synthetic(args: argparse.Namespace) -> None:
    from trailforge.operators import evaluate, prov
    from trailforge.schema import CATEGORIES

    out = Path(args.out)
    out.mkdir(parents=True, exist_ok=True)
    rows = evaluate.evaluate(*evaluate.matrix(session(), args.seeds_per_cell)).cache()
    columns = ["scenario_id", "architecture", "stack_tier", "seed", "fragments", "units_detected", "completeness", "boundary_f1", "unrecoverable_mode_count", "dominant_mode", "dominant_break"]
    cells = evaluate.cells(rows).cache()
    shares = {r["property"]: {c: r[c] for c in CATEGORIES} for r in _listed(evaluate.per_property(rows), "ord")}
    rows.select(*columns).coalesce(1).write.mode("overwrite").parquet(f"file://{out.resolve()}/per_scenario.parquet")
    documents = {"per_scenario.json": _listed(rows.select(*columns, "position"), "position"), "cells.json": _listed(cells, "position"), "per_property.json": shares}
    for name, nodes in (("per_scenario.jsonld", prov.summary_nodes(rows)), ("cells.jsonld", prov.cell_nodes(cells))):
        documents[name] = {"@context": prov.context(), "@graph": [json.loads(r.node) for r in nodes.orderBy("position").collect()]}
    for name, document in documents.items():
        (out / name).write_text(json.dumps(document, indent=2))
    cells.orderBy("position").drop("position").show(50, truncate=False)
    rows.unpersist()


def evaluate_named(args: argparse.Namespace) -> None:
    from trailforge.operators import incidents, prov

    spark, out = session(), Path(args.out)
    out.mkdir(parents=True, exist_ok=True)
    rows = [json.loads(r.report) for r in incidents.incident_rows(spark).orderBy("incident").collect()]
    (out / "named_incidents.json").write_text(json.dumps(rows, indent=2))
    scenarios, fragments = incidents.incidents(spark)
    nodes = prov.nodes(scenarios, fragments).where("part < 3").orderBy("scenario_id", "part", "pos").collect()
    agents = {(r.scenario_id, json.loads(r.node)["@id"]): json.loads(r.node) for r in prov.nodes(scenarios, fragments).where("part = 3").collect()}
    graph = []
    for r in nodes:  # an agent follows the first fragment that is its
        node = json.loads(r.node)
        graph.append(node)
        found = agents.pop((r.scenario_id, node.get("prov:wasAttributedTo", {}).get("@id")), None)
        graph += [found] if found else []
    (out / "named_incidents.jsonld").write_text(json.dumps({"@context": prov.context(), "@graph": graph}, indent=2))
    for r in rows:
        print(f"{r['incident']}: {r['completeness_pct']} %, mode {r['dominant_mode']}")


def validate(args: argparse.Namespace) -> None:
    from trailforge.adapters import generic_jsonl

    mapping = generic_jsonl.load_mapping(args.mapping)
    problems = generic_jsonl.validate_sample(session(), args.sample_from, mapping) if args.sample_from else []
    if problems:
        raise ValueError("; ".join(problems))
    print("mapping is valid")


def export_schemas(args: argparse.Namespace) -> None:
    from trailforge.sources import result_schemas

    for path in result_schemas.export(args.out):
        print(path)


def _tuple(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(",") if x.strip())


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="trailforge")
    parser.add_argument("--version", action="version", version=__version__)
    top = parser.add_subparsers(required=True)
    into = top.add_parser("ingest", help="a trace file to a manifest").add_subparsers(dest="adapter", required=True)
    for name in ADAPTERS:
        sub = into.add_parser(name.replace("_", "-"))
        sub.add_argument("--from-file", required=True)
        sub.add_argument("--scenario-id", default=f"{name}_ingest")
        sub.add_argument("--out", default="-")
        if name == "generic_jsonl":
            sub.add_argument("--mapping", required=True)
        for f in dataclasses.fields(_module(name).Options):  # an option of the adapter is a flag
            flag = "--" + f.name.replace("_", "-")
            kind = str(f.type)
            if kind == "bool":
                sub.add_argument(flag, action=argparse.BooleanOptionalAction, default=None)
            else:
                sub.add_argument(flag, default=None, type=_tuple if kind.startswith("tuple") else int if kind == "int" else float if kind.startswith("float") else str)
        sub.set_defaults(run=ingest)
    sub = top.add_parser("reconstruct", help="a manifest to its report")
    sub.add_argument("input")
    sub.add_argument("--out", default=".")
    sub.add_argument("--jsonld", action="store_true")
    sub.set_defaults(run=reconstruct)
    kinds = top.add_parser("evaluate").add_subparsers(required=True)
    for name, run in (("synthetic", evaluate_synthetic), ("named", evaluate_named)):
        sub = kinds.add_parser(name)
        sub.add_argument("--out", default="results")
        sub.add_argument("--seeds-per-cell", type=int, default=20)
        sub.set_defaults(run=run)
    sub = top.add_parser("validate").add_subparsers(required=True).add_parser("generic-jsonl")
    sub.add_argument("--mapping", required=True)
    sub.add_argument("--sample-from")
    sub.set_defaults(run=validate)
    sub = top.add_parser("export-schemas")
    sub.add_argument("--out", default="schemas")
    sub.set_defaults(run=export_schemas)
    return parser


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    try:
        args.run(args)
    except Exception as e:  # the user's files and options
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
