"""CrewAI telemetry events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailforge.adapters.common import BY_TIME, emit, emitted_rows, fragment, numbered, payload, quoted, raw, scenario_column, scenario_rows
from trailforge.functions import scalars
from trailforge.functions.scalars import epoch, filled, first_filled, matches
from trailforge.functions.variants import at, empty, get, parsed, true_text, truthy, value_at
from trailforge.operators.pairing import as_of, fifo
from trailforge.sources.manifests import records
from trailforge.sources.scratch import written

# Fixed values of this format.
EXTERNAL_MEMORY = ("long_term", "entity", "external")
ACTOR_FIELDS = ("agent_role", "assigned_agent", "from_agent", "to_agent")
#: For each kind of paired work its start, its ends, and the field that names its queue.
PAIRED = {"tool": ("tool_usage_started", ("tool_usage_finished", "tool_usage_error"), "tool_name", "tool_unknown"), "llm": ("llm_call_started", ("llm_call_completed",), "model", "model_unknown"), "memory": ("memory_query_started", ("memory_query_completed",), "memory_type", "memory")}
ERRORS = ("crew_kickoff_failed", "agent_execution_failed", "task_failed")


@dataclass(frozen=True)
class Options:
    """Fixed defaults of this format."""

    architecture: str = "multi_agent"
    auto_architecture: bool = False
    stack_tier: str = "within_stack"
    cross_stack_tools_pattern: str | None = None
    state_mutation_tool_pattern: str | None = None
    actor_override: str | None = None
    crew_name: str | None = None
    emit_config_snapshot: bool = True


def slug(name: Column) -> Column:
    return F.coalesce(filled(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))), F.lit("crew"))


def events_of(rows: DataFrame, scenario: str | Column) -> DataFrame:
    """One row an event, numbered in its scenario by file and place. ``body`` answers for a payload
    field, taken from the event itself where the payload lacks it."""
    e = F.col("record")
    rows = rows.select("file", "pos", parsed("record").alias("record"), scenario_column(scenario).cast("string").alias("scenario"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("scenario").orderBy("file", "pos")))
    inner = F.coalesce(F.when(truthy(e, "$.payload"), at(e, "$.payload")), empty())
    rows = rows.select("scenario", "n", e.alias("event"), inner.alias("inner"), first_filled(get(e, "$.event_type"), get(e, "$.eventType"), F.lit("unknown")).alias("type"), first_filled(get(e, "$.event_id"), get(e, "$.id"), F.format_string("event_%04d", "n")).alias("id"), epoch(first_filled(get(e, "$.timestamp"), get(e, "$.ts"))).alias("ts"))
    return rows.withColumn("crew", first_filled(body_text("crew_name"), body_text("crew"), F.lit("crew_default")))


_OWN = ("payload", "timestamp", "ts", "event_type", "eventType", "event_id", "id")


def body_json(field: str, event: str = "event", inner: str = "inner") -> Column:
    """The JSON of a payload field."""
    outer = F.lit(None).cast("string") if field in _OWN else value_at(event, f"$.{field}")
    return F.coalesce(value_at(inner, f"$.{field}"), outer)


def body_text(field: str, event: str = "event", inner: str = "inner") -> Column:
    outer = F.lit(None).cast("string") if field in _OWN else get(F.col(event), f"$.{field}")
    return F.coalesce(get(F.col(inner), f"$.{field}"), outer)


def _with_actors(rows: DataFrame, o: Options) -> DataFrame:
    """Events with ``actor``: the event's own name, else the crew's current actor, which is the last
    that an earlier event set."""
    own = first_filled(*[body_text(f) for f in ACTOR_FIELDS])
    first = F.when(F.col("type") == "manager_agent_invoked", "Manager").when(F.col("type") == "agent_execution_started", first_filled(body_text("agent_role"), body_text("assigned_agent"))).when(F.col("type") == "task_started", filled(body_text("assigned_agent"))).when(F.col("type") == "delegation", filled(body_text("from_agent")))
    own = F.coalesce(first, F.lit(o.actor_override), own)
    keeps = F.col("type").isin("agent_execution_started", "task_started", "consensual_vote_cast", *[x for start, ends, *_ in PAIRED.values() for x in (start, *ends)])
    sets = F.when(F.col("type") == "manager_agent_invoked", "Manager").when(F.col("type") == "delegation", filled(body_text("to_agent"))).when(keeps, own)
    rows = rows.withColumns({"own": own, "sets": sets})
    rows = rows.withColumn("before", F.lag("sets").over(Window.partitionBy("scenario", "crew").orderBy("n")))
    rows = as_of(rows, ["scenario", "crew"], ["n"], "before", "current")
    return rows.withColumn("actor", F.coalesce("own", "current", F.concat(F.lit("agent_"), slug(F.col("crew"))))).drop("own", "sets", "before")


def _paired(rows: DataFrame, kind: str) -> DataFrame:
    """(start, end) of one kind of work: events in columns s_* and e_*, either of them may lack."""
    start, ends, field, default = PAIRED[kind]
    some = rows.where(F.col("type").isin(start, *ends)).withColumns({"queue": first_filled(body_text(field), F.lit(default)), "opens": F.col("type") == start})
    pairs = fifo(some, ["scenario", "crew", "actor", "queue"], ["n"], "n", "opens").select("scenario", "open_id", "close_id")
    side = lambda p: rows.select(*[F.col(c).alias(f"{p}_{c}") for c in rows.columns])
    pairs = pairs.join(side("s"), (F.col("scenario") == F.col("s_scenario")) & (F.col("open_id") == F.col("s_n")), "left")
    return pairs.join(side("e"), (F.col("scenario") == F.col("e_scenario")) & (F.col("close_id") == F.col("e_n")), "left").drop("scenario", "open_id", "close_id")


def ingest(spark: SparkSession, path: str, scenario_id: str, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(scenarios, fragments), sorted by time and id.

    Starts and ends of tool, model and memory work are paired first in, first out; an end without a
    start stands for itself, a start without an end is incomplete. Log lines go to the next model
    call of their crew and actor."""
    source = records(spark, path, inner="events")
    found = from_records(source, scenario_id, options)
    label = _architecture(_of_crew(events_of(source, scenario_id), options), options)
    return scenario_rows(found, label, options.stack_tier), found


def _of_crew(rows: DataFrame, o: Options) -> DataFrame:
    return rows.where(F.col("crew") == o.crew_name) if o.crew_name is not None else rows


def from_records(records_: DataFrame, scenario: str | Column, options: Options = Options()) -> DataFrame:
    """Fragments of event records (file, pos, record), wherever they come from; each scenario's
    events are numbered, paired and named on their own."""
    o = options
    # every kind of work reads the events again: they are parsed, numbered and named once
    rows = written(_with_actors(_of_crew(events_of(records_, scenario), o), o), "events")

    def one(suffix, kind, body, p="", actor="actor", tier=None, offset=0.0):
        c = lambda name: F.col(p + name)
        name = F.concat(F.lit("crewai_"), slug(c("crew")), F.lit("_"), c("id"), F.lit(f"_{suffix}"))
        hint = first_filled(body_text("task_id", p + "event", p + "inner"), c("crew"))
        return fragment(name, c("ts") + offset, kind, body, F.lit(o.stack_tier) if tier is None else tier, F.col(actor), c("crew"), hint)

    j = lambda f: raw(body_json(f))
    listed = lambda f: F.coalesce(F.when(true_text(body_json(f)), body_json(f)), F.lit("[]"))
    flag = lambda f: F.when(true_text(body_json(f)), "true").otherwise("false")
    typ = F.col("type")
    whole = F.concat(F.lit("{"), F.array_join(F.array_compact(F.transform(F.map_entries(F.try_variant_get("event", "$", "map<string,variant>")), lambda kv: F.when(~kv["key"].isin(*_OWN) & ~F.array_contains(F.map_keys(F.try_variant_get("inner", "$", "map<string,variant>")), kv["key"]), F.concat(F.concat(F.lit('"'), kv["key"], F.lit('"')), F.lit(": "), F.to_json(kv["value"]))))), ", "), F.lit("}"))
    inner = F.to_json("inner")
    merged = F.when(inner == "{}", whole).when(whole == "{}", inner).otherwise(F.concat(F.regexp_replace(inner, r"\s*\}\s*$", ", "), F.regexp_replace(whole, r"^\{", "")))
    merged = F.when(body_json("constraint_activated").isNull(), F.when(merged == "{}", '{"constraint_activated": true}').otherwise(F.concat(F.regexp_replace(merged, r"\s*\}\s*$", ""), F.lit(', "constraint_activated": true}')))).otherwise(merged)
    single = [
        emit((typ == "crew_kickoff_started") & F.lit(o.emit_config_snapshot), one("crew_config", "config_snapshot", payload(crew_name=quoted(F.col("crew")), agents=listed("agents"), tasks=listed("tasks"), process=j("process")))),
        emit(typ == "agent_execution_started", one("agent_execution", "agent_message", payload(task_id=j("task_id"), task_description=j("task_description"), tools=listed("tools")))),
        emit(typ == "task_started", one("task_started", "agent_message", payload(task_id=j("task_id"), task_description=j("task_description"), expected_output=j("expected_output"), human_input=flag("human_input"), static_assignment=F.lit("true")))),
        emit(typ == "delegation", one("delegation", "agent_message", payload(delegation=F.lit("true"), from_agent=j("from_agent"), to_agent=j("to_agent"), task=j("task")))),
        emit(typ == "manager_agent_invoked", one("manager_invoked", "agent_message", payload(manager=F.lit("true"), task=j("task")))),
        emit(typ == "consensual_vote_cast", one("vote", "agent_message", payload(vote=j("vote"), proposal=j("proposal")))),
        emit(typ == "demm_policy_snapshot", one("policy_snapshot", "policy_snapshot", merged)),
        emit(typ.isin(*ERRORS), one("scope_error", "error", payload(error=j("error")))),
    ]
    found = emitted_rows(rows, single, F.col("scenario"), ["n"])

    def of(p, f):
        return body_json(f, p + "event", p + "inner")

    def either(f):
        return F.coalesce(of("s_", f), of("e_", f))

    def begun(pairs: DataFrame) -> DataFrame:
        """Pairs with b_*: the start, or the end where there is no start; and the actor: the end's,
        or for a start without an end the start's own."""
        named = pairs.withColumns({f"b_{c}": F.coalesce(f"s_{c}", f"e_{c}") for c in rows.columns})
        alone = first_filled(*[body_text(f, "s_event", "s_inner") for f in ACTOR_FIELDS], F.concat(F.lit("agent_"), slug(F.col("s_crew"))))
        return named.withColumn("actor", F.coalesce("e_actor", F.lit(o.actor_override), alone))

    tools = begun(_paired(rows, "tool"))
    name = body_text("tool_name", "b_event", "b_inner")
    tier = F.when(matches(filled(name), o.cross_stack_tools_pattern, False), "cross_stack").otherwise(o.stack_tier)
    failed = F.col("e_type") == "tool_usage_error"
    args = F.coalesce(F.when(of("b_", "args") != "null", of("b_", "args")), F.lit("{}"))
    error = F.when(failed, of("e_", "error"))
    done = F.coalesce(F.col("e_type") == "tool_usage_finished", F.lit(False))
    call = payload(tool_name=raw(either("tool_name")), args=args, result=F.when(done, raw(of("e_", "output"))), error=error, incomplete=F.when(~done & error.isNull(), "true"))
    changed = matches(filled(F.coalesce(body_text("tool_name", "e_event", "e_inner"), F.when(F.col("e_n").isNull(), name))), o.state_mutation_tool_pattern, False)
    found = found.unionByName(emitted_rows(tools, [
        emit(F.lit(True), one("tool_call", "tool_call", call, "b_", tier=tier)),
        emit(failed, one("tool_error", "error", payload(error=raw(of("e_", "error"))), "e_")),
        emit(changed, one("tool_state", "state_mutation", payload(tool_name=raw(of("b_", "tool_name")), args=args), "b_", tier=tier, offset=0.0001)),
    ], F.col("b_scenario"), ["b_n"]))

    # log lines belong to the next completed model call of their crew and actor, later ones to the first that is left open
    calls = begun(_paired(rows, "llm")).withColumn("key_actor", F.coalesce("e_actor", "s_actor"))
    ends = rows.where("type in ('agent_logs_execution', 'llm_call_completed')")
    after = F.count_if(F.col("type") == "llm_call_completed").over(Window.partitionBy("scenario", "crew", "actor").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("turn", F.coalesce(after, F.lit(0)))
    line = F.substring(F.coalesce(body_text("text"), F.lit("")), 1, 500)
    logs = ends.where("type = 'agent_logs_execution'").groupBy("scenario", "crew", "actor", "turn").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("t")))).alias("lines"))
    logs = logs.select(F.col("scenario").alias("l_scenario"), F.col("crew").alias("l_crew"), F.col("actor").alias("l_actor"), F.col("turn").alias("l_turn"), F.array_join(F.filter(F.transform("lines", lambda x: x["t"]), lambda t: t != ""), "\n").alias("log"))
    turns = ends.where("type = 'llm_call_completed'").select(F.col("scenario").alias("n_scenario"), F.col("n").alias("t_n"), F.col("turn").alias("t_turn"))
    total = ends.groupBy("scenario", "crew", "actor").agg(F.count_if(F.col("type") == "llm_call_completed").alias("t_total")).select(F.col("scenario").alias("t_scenario"), F.col("crew").alias("t_crew"), F.col("actor").alias("t_actor"), "t_total")
    calls = calls.join(turns, (F.col("b_scenario") == F.col("n_scenario")) & (F.col("e_n") == F.col("t_n")), "left").join(total, (F.col("b_scenario") == F.col("t_scenario")) & (F.col("b_crew") == F.col("t_crew")) & (F.col("key_actor") == F.col("t_actor")), "left")
    open_rank = F.row_number().over(Window.partitionBy("b_scenario", "b_crew", "key_actor", F.col("e_n").isNull()).orderBy("b_n"))
    calls = calls.withColumn("open_rank", open_rank)
    turn = F.when(F.col("e_n").isNotNull(), F.col("t_turn")).when(F.col("open_rank") == 1, F.col("t_total"))
    calls = calls.withColumn("own_turn", turn).join(logs, (F.col("b_scenario") == F.col("l_scenario")) & (F.col("b_crew") == F.col("l_crew")) & (F.col("key_actor") == F.col("l_actor")) & (F.col("own_turn") == F.col("l_turn")), "left")
    both = F.col("s_n").isNotNull() & F.col("e_n").isNotNull()
    tokens = F.when(both, of("e_", "tokens"))
    model = payload(model_id=raw(either("model")), messages=F.coalesce(F.when(of("b_", "messages") != "null", of("b_", "messages")), F.lit("[]")), internal_reasoning=F.lit('"opaque"'), output=F.when(both, raw(of("e_", "output"))), token_count=tokens, incomplete=F.when(~both, "true"), agent_visible_log=F.when(F.col("log").isNotNull(), quoted(F.col("log"))))
    calls = calls.withColumn("actor", F.col("key_actor"))
    found = found.unionByName(emitted_rows(calls, [emit(F.lit(True), one("llm_call", "model_generation", model, "b_"))], F.col("b_scenario"), ["b_n"]))

    queries = begun(_paired(rows, "memory"))
    both = F.col("s_n").isNotNull() & F.col("e_n").isNotNull()
    memory = first_filled(body_text("memory_type", "s_event", "s_inner"), body_text("memory_type", "e_event", "e_inner"), F.lit("memory"))
    results = F.when(both, F.when(of("e_", "results") != "null", of("e_", "results")))
    query = payload(query=raw(of("b_", "query")), memory_type=quoted(memory), retrieved=F.coalesce(results, F.lit("[]")), incomplete=F.when(~both, "true"))
    tier = F.when(memory.isin(*EXTERNAL_MEMORY), "cross_stack").otherwise(o.stack_tier)
    found = found.unionByName(emitted_rows(queries, [emit(F.lit(True), one("memory_query", "retrieval_result", query, "b_", tier=tier))], F.col("b_scenario"), ["b_n"]))
    return numbered(found, BY_TIME)


def _architecture(rows: DataFrame, o: Options) -> str:
    if not o.auto_architecture:
        return o.architecture
    human = true_text(body_json("human_input")) | (get(F.col("inner"), "$.tasks").rlike(r'"human_input"\s*:\s*true'))
    roles = F.transform(F.from_json(body_text("agents"), "array<string>"), lambda a: F.coalesce(first_filled(*[scalars.get(a, f"$.{k}") for k in ("role", "agent_role", "name")]), a))
    named = F.concat(F.array(*[filled(body_text(f)) for f in ACTOR_FIELDS]), F.when(F.col("type") == "crew_kickoff_started", F.coalesce(roles, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    actors = rows.select(F.explode(F.array_compact(named)).alias("a")).where("a not in ('Manager', '')").distinct().count()
    seen = rows.agg(F.max(F.coalesce(human, F.lit(False))), F.max_by(F.when(F.col("type") == "crew_kickoff_started", filled(body_text("process"))), F.when((F.col("type") == "crew_kickoff_started") & filled(body_text("process")).isNotNull(), F.col("n")))).first()
    if seen[0]:
        return "human_in_the_loop"
    return "single_agent" if actors <= 1 and (seen[1] or "").lower() == "sequential" else "multi_agent"
