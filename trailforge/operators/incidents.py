"""Three publicly reported incidents as small scenarios, each one agent across a stack's border."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailforge.operators import classify
from trailforge.sources.manifests import promoted

# What the public accounts say, as seconds after the start, kind, actor, payload.
INCIDENTS = {
    "replit_drop_database_2025_07": (
        "replit", 1_720_000_000.0, -1, [2],
        [
            (0.0, "agent_message", "user_principal", {"content": "user prompt requesting data cleanup (public report)"}),
            (10.0, "model_generation", "replit_agent", {"model_id": "undisclosed", "internal_reasoning": "opaque"}),
            (12.0, "tool_call", "replit_agent", {"tool_name": "sql_exec", "args": {"statement": "DROP DATABASE production_db"}}),
            (12.5, "state_mutation", "production_db", {"state_change_magnitude": 1.0, "event": "database dropped", "rows_affected": "all"}),
        ],
    ),
    "cursor_destructive_command_2025": (
        "cursor", 1_730_000_000.0, -2, [3],
        [
            (0.0, "agent_message", "user_developer", {"content": "developer prompt to refactor project (public report)"}),
            (5.0, "retrieval_result", "cursor_agent", {"retrieved": "project file tree"}),
            (8.0, "model_generation", "cursor_agent", {"model_id": "undisclosed", "reasoning": "opaque"}),
            (10.0, "tool_call", "cursor_agent", {"tool_name": "shell_exec", "args": {"command": "rm -rf ./src"}}),
            (10.2, "state_mutation", "local_filesystem", {"state_change_magnitude": 1.0, "event": "source tree deleted"}),
        ],
    ),
    "claude_code_datatalks_drop_database_2025": (
        "ccdtc", 1_725_000_000.0, -3, [2],
        [
            (0.0, "agent_message", "user_engineer", {"content": "operator prompt requesting database operation during routine engineering task (public first-person account)"}),
            (8.0, "model_generation", "claude_code_agent", {"model_id": "claude_code_session", "internal_reasoning": "opaque"}),
            (11.0, "tool_call", "claude_code_agent", {"tool_name": "shell_exec", "args": {"command": "destructive database operation against production target (sql or migration tooling)"}}),
            (11.4, "state_mutation", "production_db", {"state_change_magnitude": 1.0, "event": "production database dropped", "rows_affected": "all"}),
            (3600.0, "state_mutation", "user_engineer", {"state_change_magnitude": 1.0, "event": "database restored from backup by operator"}),
        ],
    ),
}


def incidents(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(scenarios with seed, truth and position, fragments)."""
    scenarios = [(name, "single_agent", "cross_stack", seed, truth, i) for i, (name, (_, _, seed, truth, _)) in enumerate(sorted(INCIDENTS.items()))]
    rows = [
        (name, k, f"{prefix}_f{k:03d}", start + offset, kind, "cross_stack", actor, json.dumps(body), None, None)
        for name, (prefix, start, _, _, parts) in INCIDENTS.items()
        for k, (offset, kind, actor, body) in enumerate(parts)
    ]
    fragments = spark.createDataFrame(rows, "scenario_id string, seq bigint, fragment_id string, timestamp double, kind string, stack_tier string, actor_id string, payload string, parent_trace_id string, decision_id_hint string")
    return spark.createDataFrame(scenarios, "scenario_id string, architecture string, stack_tier string, seed int, truth array<int>, position int"), promoted(fragments)


def incident_rows(spark: SparkSession) -> DataFrame:
    """(incident, report): each incident's result row as JSON text, the incident's name first."""
    found = classify.feasibility_json(classify.reconstruct(*incidents(spark)))
    return found.select(F.col("scenario_id").alias("incident"), F.regexp_replace("report", r'^\{"scenario_id":', '{"incident":').alias("report"))
