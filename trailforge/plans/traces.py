"""The driver's star-schema tables read as traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailforge.schema import KINDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows over all cores, where their files make fewer tasks than that: for work that costs much more a row than moving it."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def events_as_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments from ``events``: the number in ``props`` picks kind and actor, the value is the
    magnitude. Every branch of the boundary and classification rules occurs."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.element_at(F.array(*[F.lit(x) for x in KINDS]), k % 10 + 1)
    return events.select(
        F.col("user_id").cast("string").alias("scenario_id"),
        F.col("event_id").alias("seq"),
        F.format_string("e%012d", "event_id").alias("fragment_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"),
        kind.alias("kind"),
        F.lit("within_stack").alias("stack_tier"),
        F.concat(F.lit("agent_"), (k % 5).cast("string")).alias("actor_id"),
        F.col("props").alias("payload"),
        F.lit(None).cast("string").alias("parent_trace_id"),
        F.lit(None).cast("string").alias("decision_id_hint"),
        (F.col("value") / 100).alias("state_change_magnitude"),
        (F.expr("(cast(get_json_object(props, '$.k') as int) div 10) % 2") == 0).alias("constraint_activated"),
    )


def events_as_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scenario a user; all pairs of architecture and tier occur."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    arch = F.element_at(F.array(*[F.lit(x) for x in ("single_agent", "multi_agent", "human_in_the_loop", "non_agentic")]), (F.col("user_id") % 4 + 1).cast("int"))
    tier = F.when(F.expr("(user_id div 4) % 2") == 0, "within_stack").otherwise("cross_stack")
    return users.select(F.col("user_id").cast("string").alias("scenario_id"), arch.alias("architecture"), tier.alias("stack_tier"))


def conversations_as_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments from ``conversations``: a turn is a fragment, its role the kind and the actor."""
    turns = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "system", "config_snapshot").when(F.col("role") == "user", "agent_message").otherwise("model_generation")
    return turns.select(
        F.col("conv_id").cast("string").alias("scenario_id"),
        F.col("turn").alias("seq"),
        F.format_string("t%06d", "turn").alias("fragment_id"),
        F.col("turn").cast("double").alias("timestamp"),
        kind.alias("kind"),
        F.lit("within_stack").alias("stack_tier"),
        F.coalesce("role", F.lit("unknown")).alias("actor_id"),
        F.lit("{}").alias("payload"),
        F.lit(None).cast("string").alias("parent_trace_id"),
        F.lit(None).cast("string").alias("decision_id_hint"),
        F.lit(0.0).alias("state_change_magnitude"),
        F.lit(False).alias("constraint_activated"),
    )
