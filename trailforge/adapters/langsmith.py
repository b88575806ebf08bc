"""LangSmith runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailforge.adapters.common import emit, flat, fragment, payload, quoted, raw, scenario_column, scenario_rows
from trailforge.functions.scalars import any_of, epoch, filled, first_filled, matches
from trailforge.functions.variants import get, parsed, truthy, value_at
from trailforge.sources.manifests import records


@dataclass(frozen=True)
class Options:
    """Fixed defaults of this format."""

    architecture: str = "single_agent"
    stack_tier: str = "within_stack"
    skip_run_types: tuple[str, ...] = ("parser", "embedding")
    human_node_pattern: str = "(human|approval|hitl)"
    state_mutation_tool_pattern: str | None = None
    policy_snapshot_tags: tuple[str, ...] = ("policy_snapshot", "policy")
    config_snapshot_tags: tuple[str, ...] = ("config_snapshot", "config")
    actor_override: str | None = None


def fragments(spark: SparkSession, path: str, scenario_id: str, options: Options = Options()) -> DataFrame:
    """Fragments of the runs of a file, in the order of their start times (of equals, of the file)."""
    return from_records(records(spark, path, inner="runs"), scenario_id, options)


def from_records(rows: DataFrame, scenario: str | Column, options: Options = Options()) -> DataFrame:
    """Fragments of runs (file, pos, record), wherever they come from; a scenario's runs are ordered on their own."""
    o, run = options, F.col("record")
    runs = rows.select("file", "pos", parsed("record").alias("record"))
    runs = runs.withColumns({
        "type": F.lower(F.coalesce(get(run, "$.run_type"), F.lit(""))), "id": F.coalesce(get(run, "$.id"), F.lit("None")), "name": filled(get(run, "$.name")), "ts": epoch(get(run, "$.start_time")),
        "tags": F.coalesce(F.try_variant_get(run, "$.tags", "array<string>"), F.array().cast("array<string>")), "parent": get(run, "$.parent_run_id"), "failed": truthy(run, "$.error"), "node": get(run, "$.extra.metadata.langgraph_node"),
    })
    meta = [get(run, f"$.extra.metadata.{k}") for k in ("langgraph_node", "agent_name", "actor_id")]
    actor = F.lit(o.actor_override) if o.actor_override else first_filled(*meta, F.col("name"), F.concat(F.lit("agent_"), F.substring(F.coalesce(get(run, "$.id"), F.lit("")), 1, 8)))
    human = any_of(matches(F.col("name"), o.human_node_pattern), matches(F.col("node"), o.human_node_pattern), F.exists("tags", lambda t: matches(t, o.human_node_pattern)))
    tool = F.coalesce("name", F.lit("unknown_tool"))
    tagged = lambda wanted: F.arrays_overlap("tags", F.array(*[F.lit(t) for t in wanted])) if wanted else F.lit(False)
    runs = runs.withColumns({
        "actor": actor, "human": human, "tool": tool, "policy": tagged(o.policy_snapshot_tags), "config": tagged(o.config_snapshot_tags),
        "tier": F.when(F.array_contains("tags", "cross_stack"), "cross_stack").otherwise(o.stack_tier), "prefix": F.concat(F.lit("ls_"), F.substring(F.replace(F.col("id"), F.lit("-"), F.lit("")), 1, 12), F.lit("_")),
    })
    runs = runs.where(~F.col("type").isin(*o.skip_run_types)) if o.skip_run_types else runs

    def one(suffix, kind, extra, offset=0.0, tier=None):
        body = payload(langsmith_run_type=raw(value_at(run, "$.run_type")), langsmith_run_name=raw(value_at(run, "$.name")), **extra)
        return fragment(F.concat("prefix", F.lit(suffix)), F.col("ts") + offset, kind, body, F.col("tier") if tier is None else tier, F.col("actor"), F.col("parent"))

    ruled, typ = ~F.col("policy") & ~F.col("config"), F.col("type")
    dict_or = lambda *paths: F.coalesce(*[F.when(truthy(run, p), value_at(run, p)) for p in paths], F.lit("{}"))
    model = first_filled(get(run, "$.extra.metadata.ls_model_name"), F.col("name"), F.lit("undisclosed"))
    chain = ruled & typ.isin("chain", "prompt")
    emitted = [
        emit(F.col("policy"), one("policy", "policy_snapshot", {"constraint_activated": F.lit("true"), "policy_id": raw(value_at(run, "$.name"))})),
        emit(~F.col("policy") & F.col("config"), one("config", "config_snapshot", {"config_version": raw(value_at(run, "$.name"))})),
        emit(ruled & (typ == "llm"), one("llm", "model_generation", {"model_id": quoted(model), "internal_reasoning": F.lit('"opaque"'), "token_count": raw(value_at(run, "$.total_tokens"))})),
        emit(ruled & (typ == "tool"), one("tool", "tool_call", {"tool_name": quoted(F.col("tool")), "args": dict_or("$.inputs")})),
        emit(ruled & (typ == "tool") & matches(F.col("tool"), o.state_mutation_tool_pattern), one("state", "state_mutation", {"state_change_magnitude": F.lit("1.0"), "event": quoted(F.concat(F.lit("state mutation via "), "tool"))}, 0.001)),
        emit(ruled & (typ == "retriever"), one("retr", "retrieval_result", {"retrieved": dict_or("$.outputs"), "query": dict_or("$.inputs")})),
        emit(chain & F.col("human"), one("human", F.when(F.col("failed"), "human_rejection").otherwise("human_approval"), {"approved_by": quoted(F.col("actor")), "error": raw(value_at(run, "$.error"))}, tier=F.lit("human"))),
        emit(chain & ~F.col("human"), one("msg", "agent_message", {"content": dict_or("$.inputs", "$.outputs")})),
        emit(ruled & F.col("failed"), one("err", "error", {"error": raw(value_at(run, "$.error"))}, 0.002)),
    ]
    return flat(runs, emitted, scenario_column(scenario), ["ts", "file", "pos"])


def ingest(spark: SparkSession, path: str, scenario_id: str, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(scenarios, fragments)."""
    found = fragments(spark, path, scenario_id, options)
    return scenario_rows(found, options.architecture, options.stack_tier), found
