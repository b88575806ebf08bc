"""Traces of the OpenAI Agents SDK."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailforge.adapters.common import BY_TIME, emit, flat, fragment, number, payload, quoted, raw, scenario_rows, value_at
from trailforge.functions.scalars import epoch, filled, first_filled, get, kind_of, matches, truthy
from trailforge.sources.manifests import records


@dataclass(frozen=True)
class Options:
    """Fixed defaults of this format."""

    architecture: str = "single_agent"
    stack_tier: str = "within_stack"
    cross_stack_tools: tuple[str, ...] = ()
    state_mutation_tool_pattern: str | None = None
    actor_override: str | None = None
    store_reasoning: bool = False
    auto_architecture: bool = False
    merge_groups: bool = False


def spans(spark: SparkSession, path: str, merge_groups: bool = False) -> DataFrame:
    """One row a span, with its trace's id and workflow. With ``merge_groups`` the traces of a
    group are one: the first trace's id and workflow hold for all."""
    t = F.col("record")
    rows = records(spark, path, inner="traces")
    rows = rows.select("file", "pos", first_filled(get(t, "$.trace_id"), get(t, "$.traceId"), F.lit("trace_unknown")).alias("trace"), first_filled(get(t, "$.workflow_name"), get(t, "$.workflowName"), F.lit("openai_agents_workflow")).alias("workflow"), first_filled(get(t, "$.group_id"), get(t, "$.groupId")).alias("group"), F.from_json(get(t, "$.spans"), "array<string>").alias("spans"))
    if merge_groups:
        first = rows.where("group is not null").groupBy("group").agg(F.min_by(F.struct("trace", "workflow"), F.struct("file", "pos")).alias("first"))
        rows = rows.join(first, "group", "left").withColumns({"trace": F.coalesce("first.trace", "trace"), "workflow": F.coalesce("first.workflow", "workflow")}).drop("first")
    s = F.col("span")
    rows = rows.select("file", "pos", "trace", "workflow", "group", F.posexplode("spans").alias("n", "span"))
    data = F.coalesce(F.when(truthy(s, "$.span_data"), value_at(s, "$.span_data")), value_at(s, "$.spanData"), F.lit("{}"))
    rows = rows.withColumn("data", data)
    d = F.col("data")
    target = first_filled(get(d, "$.handoff_to"), get(d, "$.handoffTo"))
    return rows.select(
        "file", "pos", "n", "trace", "workflow", "group", "data", "span",
        first_filled(get(s, "$.span_id"), get(s, "$.spanId"), F.lit("span_unknown")).alias("span_id"), first_filled(get(s, "$.parent_id"), get(s, "$.parentId")).alias("parent"),
        epoch(first_filled(get(s, "$.started_at"), get(s, "$.startedAt")), milliseconds=True).alias("ts"), first_filled(get(d, "$.type"), F.lit("custom")).alias("type"), target.alias("target"),
        F.coalesce(F.when(get(d, "$.type") == "handoff", target), filled(get(d, "$.name"))).alias("own"),
    )


def named_ancestors(rows: DataFrame, depth: int = 64) -> DataFrame:
    """(trace, span_id, above): for spans without a name of their own, the name of the nearest
    ancestor that has one. A recursive query over the spans that are still without; ``depth``
    stops a cycle of parents."""
    spark, view = rows.sparkSession, f"spans_{uuid.uuid4().hex}"
    rows.select("trace", "span_id", "parent", "own").createOrReplaceTempView(view)
    return spark.sql(f"""
        WITH RECURSIVE up(trace, span_id, parent, name, level) AS (
          SELECT trace, span_id, parent, own, 0 FROM {view} WHERE own IS NULL
          UNION ALL
          SELECT up.trace, up.span_id, p.parent, p.own, level + 1 FROM up JOIN {view} p ON up.trace = p.trace AND up.parent = p.span_id
          WHERE up.name IS NULL AND level < {depth})
        SELECT trace, span_id, min_by(name, level) AS above FROM up WHERE name IS NOT NULL GROUP BY trace, span_id""")


def ingest(spark: SparkSession, path: str, scenario_id: str, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(scenarios, fragments), sorted by time and id. One trace (or group) is the scenario
    ``scenario_id``; of several, each is one, numbered from 1 in the order of the file (groups: of their ids)."""
    o = options
    rows = spans(spark, path, o.merge_groups)
    key = F.struct(F.coalesce("group", "trace")) if o.merge_groups else F.struct("file", "pos")
    names = rows.groupBy("trace").agg(F.min(key).alias("order"))
    many = names.limit(2).count() > 1
    rank = F.concat(F.lit(f"{scenario_id}_"), F.row_number().over(Window.orderBy("order", "trace")).cast("string"))
    names = names.withColumn("scenario_id", rank if many else F.lit(scenario_id))
    rows = rows.join(names.select("trace", "scenario_id"), "trace")
    if not o.actor_override:
        rows = rows.join(named_ancestors(rows), ["trace", "span_id"], "left")
        rows = rows.withColumn("actor", first_filled(F.col("own"), F.col("above"), F.col("workflow")))
    else:
        rows = rows.withColumn("actor", F.lit(o.actor_override))
    d, s, typ, ts = F.col("data"), F.col("span"), F.col("type"), F.col("ts")
    tool = first_filled(get(d, "$.tool_name"), get(d, "$.name"))
    crosses = typ.isin("web_search", "computer_use") | ((typ == "function") & F.coalesce(tool.isin(*o.cross_stack_tools) if o.cross_stack_tools else F.lit(False), F.lit(False)))
    tier = F.when(crosses, "cross_stack").otherwise(o.stack_tier)
    short = F.coalesce(filled(F.substring(F.replace(F.col("trace"), F.lit("-"), F.lit("")), 1, 10)), F.lit("unknown"))
    given = lambda k: raw(value_at(d, f"$.{k}"))

    def one(suffix, kind, body, offset=0.0, own_tier=None, actor=None):
        name = F.concat(F.lit("openai_"), short, F.lit("_"), "span_id", F.lit(f"_{suffix}"))
        return fragment(name, ts + offset, kind, body, tier if own_tier is None else F.lit(own_tier), F.col("actor") if actor is None else actor, F.col("trace"), F.col("trace"))

    override = (first_filled(get(s, "$.metadata.demm_kind"), get(d, "$.metadata.demm_kind")) == "config_snapshot")
    override = F.coalesce(override, F.lit(False))
    plain = lambda *types: ~override & typ.isin(*types)
    tokens = [get(d, f"$.{k}").try_cast("bigint") for k in ("input_tokens", "output_tokens")]
    summary = first_filled(get(d, "$.output.reasoning.summary"), get(d, "$.output.reasoning.text"))
    reasoning = F.when(kind_of(d, "$.output.reasoning") == "STRING", get(d, "$.output.reasoning")).when(kind_of(d, "$.output.reasoning").startswith("OBJECT"), summary)
    model = payload(
        model_id=quoted(first_filled(get(d, "$.model"), F.lit("openai_undisclosed"))), internal_reasoning=F.lit('"opaque"'), input=given("input"), output=given("output"), token_count=F.when((tokens[0] + tokens[1]).isNotNull(), number(tokens[0] + tokens[1])),
        reasoning_summary_length=F.when(reasoning.isNotNull(), number(F.length(reasoning))), reasoning_summary=F.when(reasoning.isNotNull() & F.lit(o.store_reasoning), quoted(reasoning)),
    )
    known = ("response", "generation", "function", "web_search", "file_search", "computer_use", "agent", "handoff", "guardrail")
    function = F.coalesce(tool, F.lit("function"))
    named = lambda default: quoted(first_filled(get(d, "$.tool_name"), F.lit(default)))
    said = payload(content=payload(input=given("input"), output=given("output")), name=given("name"), span_type=given("type"))
    to = first_filled(F.col("target"), get(d, "$.name"), F.col("actor"))
    still = F.when(F.lower(d).contains("screenshot"), "0.0").otherwise("1.0")
    verdict = F.lower(first_filled(get(d, "$.result"), F.lit("unknown")))
    guard = payload(constraint_activated=(verdict == "passed").cast("string"), policy_id=F.coalesce(F.when(truthy(d, "$.name"), value_at(d, "$.name")), given("guardrail_name")), result=quoted(verdict))
    emitted = [
        emit(override, one("override", "config_snapshot", payload(span_type=quoted(typ), name=given("name")), own_tier=o.stack_tier)),
        emit(plain("response", "generation"), one("model", "model_generation", model)),
        emit(plain("function"), one("tool", "tool_call", payload(tool_name=quoted(function), args=given("input"), output=given("output")))),
        emit(plain("function") & matches(function, o.state_mutation_tool_pattern), one("state", "state_mutation", payload(state_change_magnitude=F.lit("1.0"), event=quoted(F.concat(F.lit("state mutation via "), function))), 0.0001)),
        emit(plain("web_search"), one("web_tool", "tool_call", payload(tool_name=named("web_search"), args=given("input")))),
        emit(plain("web_search"), one("web_retrieval", "retrieval_result", payload(query=given("input"), retrieved=given("output")), 0.0001)),
        emit(plain("file_search"), one("file_search", "retrieval_result", payload(query=given("input"), retrieved=given("output")))),
        emit(plain("computer_use"), one("computer_tool", "tool_call", payload(tool_name=named("computer_use"), args=given("input"), output=given("output")))),
        emit(plain("computer_use"), one("computer_state", "state_mutation", payload(state_change_magnitude=still, event=F.lit('"computer use action executed"')), 0.0001)),
        emit(plain("agent"), one("agent", "agent_message", said)),
        emit(~override & ~typ.isin(*known), one("custom", "agent_message", said)),
        emit(plain("handoff"), one("handoff", "agent_message", payload(content=given("input"), handoff_to=quoted(to)), actor=to)),
        emit(plain("guardrail"), one("guardrail", "policy_snapshot", guard)),
        emit(truthy(s, "$.error"), one("error", "error", payload(error=raw(value_at(s, "$.error"))), 0.0001)),
    ]
    found = flat(rows, emitted, F.col("scenario_id"), ["ts", "span_id", "file", "pos", "n"], BY_TIME)
    if not o.auto_architecture:
        return scenario_rows(found, o.architecture, o.stack_tier), found
    agents = rows.groupBy("scenario_id").agg((F.max(typ == "handoff") | (F.count_distinct(F.when(typ == "agent", filled(get(d, "$.name")))) >= 2)).alias("several"))
    scenarios = agents.select("scenario_id", F.when(F.col("several"), "multi_agent").otherwise(o.architecture).alias("architecture"), F.lit(o.stack_tier).alias("stack_tier"))
    return scenarios, found
