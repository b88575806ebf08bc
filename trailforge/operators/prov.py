"""Provenance graphs (PROV-O as JSON-LD) of reconstructed scenarios."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailforge.functions.ranges import numbered
from trailforge.functions.scalars import iso_utc
from trailforge.operators import boundary, classify
from trailforge.operators.ordering import order_fragments
from trailforge.sources.scratch import written

# The vocabulary's terms. Its namespaces are parameters of ``context``.
_LISTS = {"perPropertyFeasibility": ("demm:perPropertyFeasibility", None), "members": ("prov:hadMember", "@id"), "fragments": ("prov:wasInfluencedBy", "@id")}
_TYPED = {"property": "@id", "category": None, "gap": None, "completeness": "xsd:decimal", "completenessPct": "xsd:decimal", "dominantMode": "xsd:integer", "dominantBreak": None, "architecture": None, "stackTier": None, "actorId": None, "fragmentKind": None, "boundaryReason": None, "boundaryConfidence": "xsd:decimal"}
_CLASSES = ("DecisionChain", "DecisionUnit", "Fragment", "PropertyFeasibility")


def context(vocabulary: str = "urn:trailforge:vocabulary#", schema: str = "urn:trailforge:schema#") -> dict:
    """The JSON-LD context."""
    out: dict = {"prov": "http://www.w3.org/ns/prov#", "demm": vocabulary, "schema": schema, "xsd": "http://www.w3.org/2001/XMLSchema#"}
    out |= {c: f"demm:{c}" for c in _CLASSES}
    for name, (iri, kind) in _LISTS.items():
        out[name] = {"@id": iri, "@container": "@set"} | ({"@type": kind} if kind else {})
    for name, kind in _TYPED.items():
        out[name] = {"@id": f"demm:{name}"} | ({"@type": kind} if kind else {})
    return out


def _iri(part: str, name: Column | None = None) -> Column:
    own = F.concat(F.lit("trace:"), F.col("scenario_id"))
    return own if name is None else F.concat(own, F.lit(f"#{part}/"), name)


def _node(**fields: Column) -> Column:
    """JSON text of a node; ``__`` in a name stands for ``:`` and a leading ``at_`` for ``@``."""
    named = [c.alias(("@" + k[3:] if k.startswith("at_") else k).replace("__", ":")) for k, c in fields.items()]
    return F.to_json(F.struct(*named), {"ignoreNullFields": "false"})


def _types(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _ref(iri: Column) -> Column:
    return F.struct(iri.alias("@id"))


def _time(seconds: Column) -> Column:
    return F.struct(iso_utc(seconds).alias("@value"), F.lit("xsd:dateTime").alias("@type"))


def feasibility_nodes(rows: DataFrame, owner: Column) -> Column:
    """The struct of one property record of the owner (a chain or a unit)."""
    return F.struct(
        F.concat(owner, F.lit("/feas/"), F.col("property")).alias("@id"), F.lit("PropertyFeasibility").alias("@type"), F.concat(F.lit("schema:"), F.col("property")).alias("property"),
        F.col("category").alias("category"), F.col("gap").alias("gap"), F.col("confidence").alias("demm:confidence"),
    )


def nodes(scenarios: DataFrame, fragments: DataFrame, unit_records: bool = False) -> DataFrame:
    """(scenario_id, part, pos, node): the graph's nodes as JSON text; parts 0 to 3 are chain,
    units, fragments and agents, each agent once, in the order of its first fragment.

    The usual document has no property records at its units; ``unit_records`` adds them."""
    kept = boundary.detect(order_fragments(fragments)).select("scenario_id", "rn", "fragment_id", "timestamp", "kind", "stack_tier", "actor_id", "reason", "unit_idx")
    detected = written(kept, "detected").withColumn("frag", _iri("frag", F.col("fragment_id")))
    fragment_nodes = detected.select(
        "scenario_id", F.lit(2).alias("part"), F.col("rn").cast("long").alias("pos"),
        _node(at_id=F.col("frag"), at_type=_types("prov:Entity", "Fragment"), prov__generatedAtTime=_time(F.col("timestamp")), prov__wasAttributedTo=_ref(_iri("agent", F.col("actor_id"))), fragmentKind=F.col("kind"), demm__stackTier=F.col("stack_tier")).alias("node"),
    )
    agents = detected.groupBy("scenario_id", "actor_id").agg(F.min("rn").cast("long").alias("pos"))
    agent_nodes = agents.select("scenario_id", F.lit(3).alias("part"), "pos", _node(at_id=_iri("agent", F.col("actor_id")), at_type=F.lit("prov:Agent"), actorId=F.col("actor_id")).alias("node"))
    members = detected.groupBy("scenario_id", "unit_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "frag"))), lambda x: x["frag"]).alias("frags"))
    units = boundary.units(detected).join(members, ["scenario_id", "unit_idx"])
    counts = classify.unit_actor_counts(detected)
    per_unit = classify.unit_feasibility(counts, scenarios)
    fields = {}
    if unit_records:
        owner = _iri("unit", F.format_string("unit_%04d", "unit_idx"))
        records = per_unit.groupBy("scenario_id", "unit_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", feasibility_nodes(per_unit, owner).alias("f")))), lambda x: x["f"]).alias("feas"))
        units = units.join(records, ["scenario_id", "unit_idx"])
        fields["perPropertyFeasibility"] = F.col("feas")
    unit_nodes = units.select(
        "scenario_id", F.lit(1).alias("part"), F.col("unit_idx").cast("long").alias("pos"),
        _node(at_id=_iri("unit", F.col("unit_id")), at_type=_types("prov:Activity", "DecisionUnit"), prov__startedAtTime=_time(F.col("start_timestamp")), prov__endedAtTime=_time(F.col("end_timestamp")), prov__wasAssociatedWith=_ref(_iri("agent", F.col("primary_actor"))), boundaryReason=F.col("boundary_reason"), boundaryConfidence=F.col("boundary_confidence"), fragments=F.col("frags"), **fields).alias("node"),
    )
    whole = classify.chains(scenarios, counts)
    chain = classify.chain_feasibility(whole)
    listed = chain.groupBy("scenario_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", feasibility_nodes(chain, F.concat(_iri(""), F.lit("#chain"))).alias("f")))), lambda x: x["f"]).alias("feas"))
    iris = units.groupBy("scenario_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("unit_idx", _iri("unit", F.col("unit_id")).alias("u")))), lambda x: x["u"]).alias("members"))
    chains = classify.reports(whole).join(listed, "scenario_id").join(iris, "scenario_id", "left")
    chain_nodes = chains.select(
        "scenario_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"),
        _node(at_id=_iri(""), at_type=_types("prov:Collection", "DecisionChain"), demm__scenarioId=F.col("scenario_id"), architecture=F.col("architecture"), stackTier=F.col("stack_tier"), completeness=F.bround("completeness", 4), dominantMode=F.col("dominant_mode"), dominantBreak=F.col("dominant_break"), members=F.coalesce("members", F.array().cast("array<string>")), perPropertyFeasibility=F.col("feas")).alias("node"),
    )
    return chain_nodes.unionByName(unit_nodes).unionByName(fragment_nodes).unionByName(agent_nodes)


def bundle(scenarios: DataFrame, fragments: DataFrame) -> DataFrame:
    """(place, node): the nodes of one graph of many chains, in order from 0: chain by chain (``position`` in scenarios), the
    chain, its units, its fragments, and after the first fragment of each agent the agent.

    Rows keep where they belong as a key of four numbers; ranges of that key are sorted and numbered
    by many tasks, so neither a chain nor the graph is gathered."""
    found = nodes(scenarios, fragments).join(scenarios.select("scenario_id", "position"), "scenario_id")
    agent = F.col("part") == 3  # stands behind the fragment of the same number
    keyed = found.select("position", "scenario_id", F.least("part", F.lit(2)).alias("part"), "pos", agent.alias("behind"), "node")
    return numbered(written(keyed.withColumn("all", F.lit(0)), "nodes"), ["all"], ["position", "scenario_id", "part", "pos", "behind"], "place", "n").select("place", "n", "node")


def document_lines(ordered: DataFrame, ld_context: dict | None = None) -> DataFrame:
    """(place, line): the lines of the JSON-LD document of nodes (place, n, node)."""
    spark = ordered.sparkSession
    lines = ordered.select("place", F.when(F.col("place") + 1 < F.col("n"), F.concat("node", F.lit(","))).otherwise(F.col("node")).alias("line"))
    head = json.dumps({"@context": ld_context or context()})[:-1] + ', "@graph": ['
    ends = spark.createDataFrame([(-1, head), (2**62, "]}")], "place bigint, line string")
    return lines.unionByName(ends)


def write_document(lines: DataFrame, folder: str) -> None:
    """Write the lines as text files of consecutive ranges; joined in the order of their names they are the document."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(n, "place").sortWithinPartitions("place").select("line").write.text(folder)


def graphs(node_rows: DataFrame, ld_context: dict | None = None) -> DataFrame:
    """(scenario_id, document): one JSON-LD document for each scenario."""
    listed = node_rows.groupBy("scenario_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "pos", "node"))), lambda x: x["node"]), ",").alias("g"))
    head = json.dumps({"@context": ld_context or context()})[:-1]
    return listed.select("scenario_id", F.concat(F.lit(head + ', "@graph": ['), "g", F.lit("]}")).alias("document"))


def summary_nodes(evaluated: DataFrame) -> DataFrame:
    """(position, node): a summary node for each evaluated scenario."""
    return evaluated.select("position", _node(
        at_id=_iri(""), at_type=_types("prov:Collection", "DecisionChain"), demm__scenarioId=F.col("scenario_id"), architecture=F.col("architecture"), stackTier=F.col("stack_tier"), demm__seed=F.col("seed"), demm__fragmentCount=F.col("fragments"), demm__unitsDetected=F.col("units_detected"), completeness=F.col("completeness"), demm__boundaryF1=F.col("boundary_f1"), demm__unrecoverableModeCount=F.col("unrecoverable_mode_count"), dominantMode=F.col("dominant_mode"), dominantBreak=F.col("dominant_break"),
    ).alias("node"))


def cell_nodes(cells: DataFrame) -> DataFrame:
    """(position, node): a summary node for each cell."""
    iri = F.concat(F.lit("results:cells#"), "architecture", F.lit("/"), "stack_tier")
    return cells.select("position", _node(
        at_id=iri, at_type=F.lit("demm:CellAggregate"), architecture=F.col("architecture"), stackTier=F.col("stack_tier"), demm__n=F.col("n"), completenessPct=F.col("completeness_pct"), demm__completenessCiLow=F.col("completeness_ci_low"), demm__completenessCiHigh=F.col("completeness_ci_high"), demm__boundaryF1=F.col("boundary_f1"), demm__modalMode=F.col("modal_mode"), demm__modalModeShare=F.col("modal_mode_share"), dominantBreak=F.col("dominant_break"),
    ).alias("node"))
