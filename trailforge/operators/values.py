"""The evidence behind findings: a typed value for each property of a unit or a chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailforge.functions.scalars import json_string
from trailforge.operators import classify
from trailforge.schema import FILLERS

#: Shapes of a value: the payload of the first matching fragment, the payloads of all, actors in order, a fixed text.
PAYLOAD, LIST, ACTORS, TEXT = "payload", "list", "actors", "text"
#: What stands for reasoning that nobody sees; a fixed value.
OPAQUE_TEXT = '"<authorization_envelope>"'


def shape(prop: Column, category: Column, matches: Column) -> Column:
    """Which value a finding has; null if none. A finding that is partial only in the chain keeps what its unit had."""
    alone = F.when(matches == 1, PAYLOAD).otherwise(LIST)
    partial = F.when(prop == "operator_identity", F.when(F.col("architecture") == "multi_agent", ACTORS).otherwise(alone)).otherwise(PAYLOAD)
    return F.when(category == classify.OPAQUE, TEXT).when(category == classify.FULL, alone).when(category == classify.PARTIAL, partial)


def _texts(listed: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]"))


def _names(actors: Column) -> Column:
    return _texts(F.transform(F.array_sort(F.collect_set(actors)), json_string))


def _payloads(picks: DataFrame, detected: DataFrame) -> DataFrame:
    """(scenario_id, unit_idx, ord, payload): the picked units' matching payloads as JSON text. A fragment is looked up by the
    properties that it fills, and only those of a picked unit are gathered, where all are wanted."""
    fills = F.array_compact(F.array(*[F.when(F.col("kind").isin(*kinds), i) for i, kinds in enumerate(FILLERS.values())]))
    filling = detected.select("scenario_id", "unit_idx", "rn", "payload", F.explode(fills).alias("ord"))
    rows = filling.join(picks.where(F.col("value_shape").isin(PAYLOAD, LIST)).select("scenario_id", "unit_idx", "ord", "value_shape"), ["scenario_id", "unit_idx", "ord"])
    every = F.array_sort(F.collect_list(F.when(F.col("value_shape") == LIST, F.struct("rn", "payload"))))
    found = rows.groupBy("scenario_id", "unit_idx", "ord").agg(F.min_by("payload", "rn").alias("first"), every.alias("every"))
    text = F.when(F.size("every") > 0, _texts(F.transform("every", lambda x: x["payload"]))).otherwise(F.col("first"))
    return found.select("scenario_id", "unit_idx", "ord", text.alias("_payload"))


def unit_values(scenarios: DataFrame, detected: DataFrame) -> DataFrame:
    """``classify.unit_feasibility`` with ``value_shape`` and ``value``, JSON text; both null where nothing was found."""
    counts = classify.unit_actor_counts(detected)
    found = classify.unit_feasibility(counts, scenarios).join(scenarios.select("scenario_id", "architecture"), "scenario_id")
    found = found.withColumn("value_shape", shape(F.col("property"), F.col("category"), F.col("matches")))
    actors = counts.groupBy("scenario_id", "unit_idx").agg(_names(F.col("actor_id")).alias("_actors"))
    rows = found.join(_payloads(found, detected), ["scenario_id", "unit_idx", "ord"], "left").join(actors, ["scenario_id", "unit_idx"])
    return rows.withColumn("value", _value()).drop("_actors", "_payload", "architecture")


def chain_values(scenarios: DataFrame, detected: DataFrame) -> DataFrame:
    """``classify.chain_feasibility`` with ``value_shape`` and ``value``: of each property the best unit's, found
    first; so payloads of that unit are read and no others. Actors are those of the whole chain where
    the chain's own rule names them, and else its unit's."""
    counts = classify.unit_actor_counts(detected)
    chain = classify.chains(scenarios, counts)
    of_chain = (F.col("architecture") == "multi_agent") & (F.col("actors") >= 3)
    found = classify.chain_feasibility(chain).join(chain.select("scenario_id", "actors"), "scenario_id")
    found = found.withColumn("value_shape", shape(F.col("property"), F.col("category"), F.col("matches")))
    all_actors = counts.groupBy("scenario_id").agg(_names(F.col("actor_id")).alias("_all"))
    unit_actors = counts.groupBy("scenario_id", "unit_idx").agg(_names(F.col("actor_id")).alias("_own"))
    rows = found.join(_payloads(found, detected), ["scenario_id", "unit_idx", "ord"], "left").join(all_actors, "scenario_id", "left").join(unit_actors, ["scenario_id", "unit_idx"], "left")
    return rows.withColumn("_actors", F.when(of_chain, F.col("_all")).otherwise(F.col("_own"))).withColumn("value", _value()).drop("_actors", "_all", "_own", "_payload", "actors")


def _value() -> Column:
    kind = F.col("value_shape")
    return F.when(kind == TEXT, OPAQUE_TEXT).when(kind == ACTORS, F.col("_actors")).when(kind.isNotNull(), F.col("_payload"))
