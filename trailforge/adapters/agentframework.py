"""Agent Framework (AutoGen) events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailforge.adapters.common import BY_TIME, emit, flat, fragment, payload, raw, scenario_column, scenario_rows, with_key
from trailforge.functions.scalars import any_of, epoch, filled, first_filled, matches
from trailforge.functions.variants import at, empty, get, parsed, truthy, value_at
from trailforge.operators.pairing import fifo
from trailforge.sources.manifests import records
from trailforge.sources.scratch import written

# Fixed values of this format: senders that are the manager, pairs of events, older field names.
MANAGERS = ("system", "<group_chat_manager>", "manager")
PAIRED = (("agent", "agent_called", "agent_returned"), ("tool", "tool_called", "tool_returned"), ("model", "model_invocation", "model_response"))
OLDER = {"agent_name": "agentName", "agent_id": "agentId", "tool_name": "toolName", "error_type": "errorType", "stack_trace": "stackTrace", "is_human_proxy": "isHumanProxy"}
SINGLE = ("message_published", "speaker_selected", "termination", "content_safety_decision", "error")


@dataclass(frozen=True)
class Options:
    """Fixed defaults of this format."""

    architecture: str = "single_agent"
    auto_architecture: bool = False
    stack_tier: str = "within_stack"
    cross_stack_tools_pattern: str | None = None
    state_mutation_tool_pattern: str | None = None
    actor_override: str | None = None
    runtime: str | None = None
    topic_filter: str | None = None


def _body(doc: Column, field: str) -> Column:
    """The JSON of a payload field, by its name or its older one."""
    own = value_at(doc, f"$.{field}")
    return F.coalesce(own, value_at(doc, f"$.{OLDER[field]}")) if field in OLDER else own


def _text(doc: Column, field: str) -> Column:
    own = get(doc, f"$.{field}")
    return F.coalesce(own, get(doc, f"$.{OLDER[field]}")) if field in OLDER else own


def events_of(rows: DataFrame, scenario: str | Column) -> DataFrame:
    """One row an event, numbered in its scenario by time and place."""
    e = F.col("record")
    rows = rows.select("file", "pos", parsed("record").alias("record"), scenario_column(scenario).cast("string").alias("scenario"))
    rows = rows.withColumn("index", F.row_number().over(Window.partitionBy("file").orderBy("pos")) - 1)
    body = F.coalesce(F.when(truthy(e, "$.payload"), at(e, "$.payload")), empty())
    rows = rows.select(
        "scenario", "index", F.coalesce(get(e, "$.event_type"), get(e, "$.eventType"), F.lit("unknown")).alias("type"), F.coalesce(get(e, "$.message_id"), get(e, "$.messageId"), get(e, "$.id"), F.format_string("event_%04d", F.col("index") + 1)).alias("id"),
        F.coalesce(get(e, "$.trace_id"), get(e, "$.traceId"), F.lit("trace_unknown")).alias("trace"), get(e, "$.topic").alias("topic"), get(e, "$.sender").alias("sender"), get(e, "$.recipient").alias("recipient"),
        value_at(e, "$.topic").alias("topic_json"), value_at(e, "$.recipient").alias("recipient_json"), body.alias("body"), epoch(F.coalesce(get(e, "$.ts"), get(e, "$.timestamp"))).alias("ts"),
    )
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("scenario").orderBy("ts", "index", "id")))


def ingest(spark: SparkSession, path: str, scenario_id: str, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(scenarios, fragments), sorted by time and id.

    Calls and returns are paired first in, first out; a call without a return is incomplete. What a
    round was goes to the trace's next fragment: the row right before it, if that is a round."""
    source = records(spark, path, inner="events")
    found = from_records(source, scenario_id, options)
    label = _architecture(_on_topic(events_of(source, scenario_id), options), options)
    return scenario_rows(found, label, options.stack_tier), found


def _on_topic(rows: DataFrame, o: Options) -> DataFrame:
    if not o.topic_filter:
        return rows
    topic = F.coalesce("topic", get("body", "$.topic"))
    return rows.where(topic.isNull() | topic.rlike(o.topic_filter))


def from_records(records_: DataFrame, scenario: str | Column, options: Options = Options()) -> DataFrame:
    """Fragments of event records (file, pos, record), wherever they come from; each scenario's
    events are numbered and paired on their own."""
    o = options
    rows = _on_topic(events_of(records_, scenario), o)
    b = F.col("body")
    actor = F.lit(o.actor_override) if o.actor_override else F.when(F.lower("sender").isin(*MANAGERS), "manager").otherwise(first_filled(F.col("sender"), _text(b, "agent_id"), _text(b, "agent_name"), F.concat(F.lit("agent_"), F.substring("trace", 1, 8))))
    override = F.when((F.col("type") != "content_safety_decision") & get(b, "$.demm_kind").isin("policy_snapshot", "config_snapshot"), get(b, "$.demm_kind"))
    # both sides of every pair are events: they are parsed, numbered and named once
    rows = written(rows.withColumns({"actor": actor, "override": override}), "events")
    scope = first_filled(_text(b, "agent_id"), _text(b, "agent_name"), F.col("recipient"), F.col("sender"), F.col("id"))
    plain = rows.where("override is null")
    side = lambda p: rows.select(*[F.col(c).alias(f"{p}_{c}") for c in rows.columns])
    work = None
    for phase, (kind, start, end) in enumerate(PAIRED, 1):
        queue = {"agent": scope, "tool": F.concat_ws("\x00", "actor", first_filled(_text(b, "tool_name"), F.lit("tool_unknown"))), "model": F.concat_ws("\x00", "actor", first_filled(get(b, "$.model"), F.lit("model_unknown")))}[kind]
        some = plain.where(F.col("type").isin(start, end)).withColumns({"queue": queue, "opens": F.col("type") == start})
        pairs = fifo(some, ["scenario", "trace", "queue"], ["n"], "n", "opens").select("scenario", "open_id", "close_id").withColumn("kind", F.lit(kind))
        pairs = pairs.withColumn("at", F.when(F.col("close_id").isNull(), F.struct(F.lit(phase).alias("phase"), F.col("open_id").alias("n"))).otherwise(F.struct(F.lit(0).alias("phase"), F.col("close_id").alias("n"))))
        work = pairs if work is None else work.unionByName(pairs)
    single = rows.where(F.col("override").isNotNull() | F.col("type").isin(*SINGLE, "round_completed"))
    kind = F.when(F.col("override").isNotNull(), "snapshot").otherwise(F.col("type"))
    work = work.unionByName(single.select("scenario", F.col("n").alias("open_id"), F.lit(None).cast("int").alias("close_id"), kind.alias("kind"), F.struct(F.lit(0).alias("phase"), F.col("n").alias("n")).alias("at")))
    work = work.join(side("s"), (F.col("scenario") == F.col("s_scenario")) & (F.col("open_id") == F.col("s_n")), "left").join(side("e"), (F.col("scenario") == F.col("e_scenario")) & (F.col("close_id") == F.col("e_n")), "left")
    work = work.withColumns({f"b_{c}": F.coalesce(f"s_{c}", f"e_{c}") for c in rows.columns})
    both = F.col("s_n").isNotNull() & F.col("e_n").isNotNull()
    work = work.withColumns({"done": both, "actor": F.coalesce("e_actor", "s_actor")})
    body = F.col("b_body")
    known = payload(round_num=raw(value_at(body, "$.round_num")), messages_in_round=raw(value_at(body, "$.messages_in_round")))
    before = F.lag(F.when(F.col("kind") == "round_completed", known)).over(Window.partitionBy("scenario", "b_trace").orderBy("at"))
    work = work.withColumn("round", before).where("kind <> 'round_completed'")
    runtime = F.lit(o.runtime) if o.runtime else F.when(F.lower(first_filled(get(body, "$.runtime"), get(body, "$.metadata.runtime"), get(body, "$.metadata.transport"), F.lit(""))).contains("grpc"), "grpc").otherwise("single_threaded")
    tier = F.when(runtime == "grpc", "cross_stack").otherwise(o.stack_tier)
    tool_tier = F.when(matches(filled(_text(body, "tool_name")), o.cross_stack_tools_pattern, False) | F.coalesce(F.lower(get(body, "$.metadata.host")) == "azure_function", F.lit(False)), "cross_stack").otherwise(tier)

    def one(suffix, what, data, own_tier=None, own_actor=None, offset=0.0, context=True):
        name = F.concat(F.lit("agentframework_"), "b_trace", F.lit("_"), "b_id", F.lit("_"), suffix if isinstance(suffix, Column) else F.lit(suffix))
        data = with_key(data, "round_context", F.col("round")) if context else data
        return fragment(name, F.col("b_ts") + offset, what, data, tier if own_tier is None else own_tier, F.col("actor") if own_actor is None else F.lit(own_actor), F.col("b_trace"), F.col("b_id"))

    j = lambda f: raw(_body(body, f))
    end = lambda f: raw(_body(F.col("e_body"), f))
    or_empty = lambda doc, f, empty: F.coalesce(F.when(truthy(doc, f"$.{f}"), value_at(doc, f"$.{f}")), F.lit(empty))
    is_ = lambda k: F.col("kind") == k
    done, open_ = F.col("done"), F.when(~F.col("done"), "true")
    args = or_empty(body, "args", "{}")
    model_id = F.coalesce(F.when(truthy(body, "$.model"), value_at(body, "$.model")), F.when(done, value_at(F.col("e_body"), "$.model")), F.lit("null"))
    client = F.coalesce(F.when(truthy(body, "$.client_type"), value_at(body, "$.client_type")), value_at(body, "$.metadata.client_type"), F.lit("null"))
    # snapshots and errors carry the payload, with the newer names beside the older
    newer = F.array_compact(F.array(*[F.when(value_at(body, f"$.{new}").isNull(), F.concat(F.lit(f'"{new}": '), value_at(body, f"$.{old}"))) for new, old in OLDER.items()]))
    work = work.withColumn("newer", F.array_join(newer, ", "))
    cut = F.regexp_replace(F.to_json(body), r"\s*\}\s*$", "")
    shaped = F.when(F.col("newer") == "", F.to_json(body)).otherwise(F.concat(cut, F.when(cut == "{", "").otherwise(", "), "newer", F.lit("}")))
    work = work.withColumn("shaped", shaped)
    shaped = F.col("shaped")
    safety = F.when(value_at(body, "$.constraint_activated").isNull(), with_key(shaped, "constraint_activated", F.lit("true"))).otherwise(shaped)
    changes = matches(filled(_text(F.coalesce("e_body", "s_body"), "tool_name")), o.state_mutation_tool_pattern, False)
    emitted = [
        emit(is_("snapshot"), one(F.col("b_override"), F.col("b_override"), shaped)),
        emit(is_("message_published"), one("published", "agent_message", payload(content=j("content"), topic=raw(F.col("b_topic_json")), recipient=raw(F.col("b_recipient_json"))))),
        emit(is_("speaker_selected"), one("speaker_selected", "agent_message", payload(role=F.lit('"speaker_select"'), selected=j("selected"), candidates=or_empty(body, "candidates", "[]")), own_actor="manager")),
        emit(is_("termination"), one("termination", "agent_message", payload(terminal=F.lit("true"), reason=j("reason")))),
        emit(is_("content_safety_decision"), one("policy_snapshot", "policy_snapshot", safety)),
        emit(is_("error"), one("error", "error", payload(error=shaped))),
        emit(is_("agent"), one("agent_call", "agent_message", payload(agent_id=j("agent_id"), agent_name=j("agent_name"), input=j("input"), output=F.when(done, end("output")), incomplete=open_))),
        emit(is_("tool"), one("tool_call", "tool_call", payload(tool_name=j("tool_name"), args=args, result=F.when(done, end("result")), incomplete=open_), tool_tier)),
        emit(is_("tool") & changes, one("tool_state", "state_mutation", payload(tool_name=j("tool_name"), args=args), tool_tier, offset=0.0001, context=False)),
        emit(is_("model"), one("model_call", "model_generation", payload(model_id=model_id, messages=or_empty(body, "messages", "[]"), client_type=client, internal_reasoning=F.lit('"opaque"'), choices=F.when(done, or_empty(F.col("e_body"), "choices", "[]")), incomplete=open_))),
    ]
    return flat(work, emitted, F.col("scenario"), ["at"], BY_TIME)


def _architecture(rows: DataFrame, o: Options) -> str:
    if not o.auto_architecture:
        return o.architecture
    b = F.col("body")
    names = [F.lower(F.coalesce(c, F.lit(""))) for c in (_text(b, "agent_name"), _text(b, "agent_id"), F.col("sender"))]
    proxy = truthy(b, "$.is_human_proxy") | truthy(b, "$.isHumanProxy") | any_of(*[n.rlike("human|proxy") for n in names])
    called = F.when(F.col("type") == "agent_called", first_filled(_text(b, "agent_id"), _text(b, "agent_name")))
    seen = rows.agg(F.max(proxy), F.max(F.col("type") == "speaker_selected"), F.count_distinct(called)).first()
    return "human_in_the_loop" if seen[0] else "multi_agent" if seen[1] or seen[2] >= 2 else "single_agent"
