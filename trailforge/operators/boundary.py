"""Decision boundaries and decision units: sessions whose breaks the rows themselves decide."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BoundaryConfig:
    """Fixed defaults of the boundary rules."""

    state_change_threshold: float = 0.5
    tool_call_confidence: float = 0.8
    human_intervention_confidence: float = 1.0
    policy_activation_confidence: float = 0.9
    state_change_confidence: float = 0.6


def boundary_reason(config: BoundaryConfig = BoundaryConfig()) -> Column:
    """The reason for which a fragment is a boundary, or null. The first rule that holds wins."""
    kind = F.col("kind")
    return (
        F.when(kind.isin("human_approval", "human_rejection"), "human")
        .when((kind == "policy_snapshot") & F.col("constraint_activated"), "policy")
        .when(kind == "tool_call", "tool_call")
        .when((kind == "state_mutation") & (F.coalesce("state_change_magnitude", F.lit(0.0)) >= config.state_change_threshold), "state_change")
    )


def _confidence(reason: Column, config: BoundaryConfig) -> Column:
    pairs = {"human": config.human_intervention_confidence, "policy": config.policy_activation_confidence, "tool_call": config.tool_call_confidence, "state_change": config.state_change_confidence}
    out = F.lit(0.5)
    for name, value in pairs.items():
        out = F.when(reason == name, float(value)).otherwise(out)
    return out


def detect(ordered: DataFrame, config: BoundaryConfig = BoundaryConfig()) -> DataFrame:
    """Ordered fragments with ``reason`` (null: no boundary) and ``unit_idx`` from 0.

    A boundary starts a unit, but for a scenario's first row. The running count uses the
    partitioning that the ordering window made: no further exchange.
    """
    running = Window.partitionBy("scenario_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flagged = ordered.withColumn("reason", boundary_reason(config))
    starts = F.when(F.col("reason").isNotNull() & (F.col("rn") > 1), 1).otherwise(0)
    return flagged.withColumn("unit_idx", F.sum(starts).over(running).cast("int"))


def units(detected: DataFrame, config: BoundaryConfig = BoundaryConfig()) -> DataFrame:
    """One row for each unit, with reason and confidence of its first row, its times, and its most
    frequent actor (of equals the one that comes first).

    Two aggregations by keys that start with scenario_id; the actor counts are summed up first,
    so no list of rows is collected.
    """
    actors = detected.groupBy("scenario_id", "unit_idx", "actor_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("rn").alias("first_rn"),
        F.min_by(F.struct("reason"), "rn").alias("first"),
        F.min("timestamp").alias("start_timestamp"),
        F.max("timestamp").alias("end_timestamp"),
    )
    rows = actors.groupBy("scenario_id", "unit_idx").agg(
        F.min_by(F.col("first.reason"), "first_rn").alias("reason"),
        F.sum("n").alias("fragments"),
        F.min("start_timestamp").alias("start_timestamp"),
        F.max("end_timestamp").alias("end_timestamp"),
        F.max_by("actor_id", F.struct("n", -F.col("first_rn"))).alias("primary_actor"),
        F.count(F.lit(1)).alias("actors"),
    )
    reason = F.coalesce("reason", F.lit("initial"))
    return rows.select("scenario_id", "unit_idx", F.format_string("unit_%04d", "unit_idx").alias("unit_id"), reason.alias("boundary_reason"), _confidence(reason, config).alias("boundary_confidence"), "fragments", "start_timestamp", "end_timestamp", "primary_actor", "actors")
