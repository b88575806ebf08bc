"""Causal order of fragments."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailforge.sources.scratch import written


def order_fragments(fragments: DataFrame, parents: bool = True, per_task: int = 100_000, most_local: int = 1_000_000) -> DataFrame:
    """Fragments with ``rn`` from 1: by timestamp, then id, a parent before its children.

    At each place stands the smallest fragment, by time and id, whose parent is not still to come; if all that are left
    wait for each other, the smallest of them does. An id has come when the first of its rows has; a parent
    that is no fragment is none. ``parents=False`` says that there are no links, and saves the look.

    One window numbers all by time. What links change is a key of three parts, so one more window sorts all: whether a
    fragment hangs on a cycle, the fragment at which that cycle is broken, and the *path of falling
    maxima*: of the ancestors from the top down to the fragment, those that are later than all below them, the
    fragment itself last. (Once a late fragment has come, the earlier ones below it follow at once, before
    anything later; so fragments come in the order of the latest ancestor, then of the latest one
    below that, and so on.) Keys are found by pointer doubling, in rounds whose number is the logarithm of the largest scenario's links.

    Numbers and ids alone are exchanged for that, once: whole scenarios are dealt over tasks of some ``per_task`` fragments, and a
    round is a local sort. Only where a scenario has more than ``most_local`` fragments does each round exchange its rows by fragment.
    """
    by_time = Window.partitionBy("scenario_id").orderBy("timestamp", "fragment_id", "seq")
    ranked = fragments.withColumn("rn", F.row_number().over(by_time))
    if not parents:
        return ranked
    places = _causal_places(ranked.select("scenario_id", "rn", "fragment_id", "parent_trace_id"), per_task, most_local)
    if places is None:
        return ranked
    return ranked.join(places, ["scenario_id", "rn"], "left").withColumn("rn", F.coalesce("_place", "rn")).select(*ranked.columns)


def _causal_places(ranked: DataFrame, per_task: int, most_local: int) -> DataFrame | None:
    """(scenario_id, rn, _place) of the fragments whose place links change; None if no fragment names a parent."""
    ranked = written(ranked, "ranked")
    sizes = ranked.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n"), F.count("parent_trace_id").alias("named"))
    total, largest, named = sizes.agg(F.sum("n"), F.max("n"), F.max("named")).first()
    if not named:
        return None
    tasks = max(ranked.sparkSession.sparkContext.defaultParallelism, ceil(total / per_task))
    rounds, spread = ceil(log2(named + 1)), tasks if largest > most_local else None
    linked = _with_parents(ranked.repartition(tasks, "scenario_id"))
    places = written(_placed(_keys(linked, rounds, spread)), "places")
    several = places.agg(F.max("rows")).first()[0]
    if several and several > 1:
        # rows share an id: the first of them to come is the parent, and places say which that is; each round finds earlier ones
        named_ids = ranked.where("parent_trace_id is not null").select("scenario_id", F.col("rn").alias("v"), F.col("parent_trace_id").alias("id"))
        links = written(named_ids.join(ranked.select("scenario_id", F.col("fragment_id").alias("id"), F.col("rn").alias("p")), ["scenario_id", "id"]).drop("id"), "parent-links")
        chosen = links.groupBy("scenario_id", "v").agg(F.min("p").alias("p"))
        while True:
            came = places.select("scenario_id", F.col("rn").alias("p"), "_place")
            better = written(links.join(came, ["scenario_id", "p"]).groupBy("scenario_id", "v").agg(F.min_by("p", "_place").alias("p")), "parents")
            if not better.join(chosen, ["scenario_id", "v", "p"], "left_anti").take(1):
                break
            chosen = better
            linked = ranked.select("scenario_id", F.col("rn").alias("v")).join(chosen, ["scenario_id", "v"], "left").repartition(tasks, "scenario_id")
            places = written(_placed(_keys(linked.withColumn("rows", F.lit(None).cast("long")), rounds, spread)), "places")
    return places.where("_place <> rn").select("scenario_id", "rn", "_place")


def _with_parents(ranked: DataFrame) -> DataFrame:
    """(scenario_id, v, p, rows): every fragment with the earliest row of its parent's id, null if it has none, and how many rows share that id.
    A fragment stands under its own id and asks under its parent's."""
    own = F.struct(F.col("fragment_id").alias("key"), F.lit(False).alias("asks"))
    asked = F.struct(F.col("parent_trace_id").alias("key"), F.lit(True).alias("asks"))
    asking = F.col("parent_trace_id").isNotNull()
    both = ranked.select("scenario_id", F.col("rn").alias("v"), asking.alias("asking"), F.inline(F.when(asking, F.array(own, asked)).otherwise(F.array(own))))
    one_id = Window.partitionBy("scenario_id", "key")
    there = F.when(~F.col("asks"), F.col("v"))
    found = both.select("scenario_id", "v", "asking", "asks", F.min(there).over(one_id).alias("_first"), F.count(there).over(one_id).alias("_n"))
    found = found.where(F.col("asks") == F.col("asking"))
    return found.select("scenario_id", "v", F.when(F.col("asks"), F.col("_first")).alias("p"), F.when(F.col("asks"), F.col("_n")).alias("rows"))


def _keys(linked: DataFrame, rounds: int, spread: int | None) -> DataFrame:
    """(scenario_id, v, p, rows), one a fragment -> (scenario_id, v, rows, _blocked, _root, _path).

    A fragment knows a stretch of its ancestors, itself first, that doubles each round: ``up``, the one after it, null past the
    top; ``path``, its falling maxima; ``low``, its least; ``cut``, how many of the path stand below the least. In each round a fragment stands
    under its own number and asks under that of ``up``. Where ``up`` is never null a cycle is above.
    """
    start = ("scenario_id", "v", "rows", F.col("p").alias("up"), F.array("v").alias("path"), F.col("v").alias("low"), F.lit(1).alias("cut"))
    state = linked.select(*start)
    own = F.struct(F.col("v").alias("key"), F.lit(False).alias("asks"))
    asked = F.struct(F.col("up").alias("key"), F.lit(True).alias("asks"))
    first = F.first(F.struct("up", "path", "low", "cut")).over(Window.partitionBy("scenario_id", "key").orderBy("asks").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for _ in range(rounds):
        both = state.select("*", F.inline(F.when(F.col("up").isNotNull(), F.array(own, asked)).otherwise(F.array(own))))
        both = both.repartition(spread, "scenario_id", "key") if spread else both
        met = both.withColumn("_a", first).where(F.col("asks") | F.col("up").isNull())
        later = F.when(F.col("asks"), F.filter("_a.path", lambda x: x > F.col("path")[0])).otherwise(F.array().cast("array<int>"))
        met = met.withColumn("_later", later)
        lower = F.col("asks") & (F.col("_a.low") < F.col("low"))
        # of the upper path its first ones stay, of those below its least the ones that are left
        cut = F.greatest(F.lit(0), F.size("_later") - F.size("_a.path") + F.col("_a.cut")) + F.size("path")
        state = met.select(
            "scenario_id", "v", "rows",
            F.when(F.col("asks"), F.col("_a.up")).alias("up"),
            F.concat("_later", "path").alias("path"),
            F.when(lower, F.col("_a.low")).otherwise(F.col("low")).alias("low"),
            F.when(lower, cut).otherwise(F.col("cut")).alias("cut"),
        )
    # whatever waits for a cycle comes after the first of all that it waits for, itself included
    blocked = F.col("up").isNotNull()
    below = F.slice("path", F.size("path") - F.col("cut") + 1, F.col("cut"))
    return state.select("scenario_id", "v", "rows", blocked.alias("_blocked"), F.when(blocked, F.col("low")).otherwise(0).alias("_root"), F.when(blocked, below).otherwise(F.col("path")).alias("_path"))


def _placed(keys: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("scenario_id").orderBy("_blocked", "_root", "_path"))
    return keys.select("scenario_id", F.col("v").alias("rn"), "rows", place.alias("_place"))


def causal_edges(fragments: DataFrame) -> DataFrame:
    """(scenario_id, fragment_id, children): every fragment with the ids of its children in input
    order. Parents that are no fragment are ignored."""
    kids = fragments.where("parent_trace_id <> ''").groupBy("scenario_id", F.col("parent_trace_id").alias("fragment_id"))
    kids = kids.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("fragment_id").alias("id")))), lambda x: x["id"]).alias("children"))
    ids = fragments.select("scenario_id", "fragment_id").distinct()
    return ids.join(kids, ["scenario_id", "fragment_id"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))
