"""Pydantic AI runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailforge.adapters.common import BY_TIME, emit, flat, fragment, payload, quoted, raw, scenario_column, scenario_rows
from trailforge.functions.scalars import epoch, filled, first_filled, matches
from trailforge.functions.variants import empty, first_true, get, items, kind_of, parsed, text_of, truthy, value_at
from trailforge.sources.manifests import records


@dataclass(frozen=True)
class Options:
    """Fixed defaults of this format."""

    architecture: str = "single_agent"
    auto_architecture: bool = False
    stack_tier: str = "within_stack"
    cross_stack_tools_pattern: str | None = None
    state_mutation_tool_pattern: str | None = None
    takeover_tool_pattern: str | None = None
    human_approval_pattern: str | None = None
    emit_system_prompt: bool = False
    actor_override: str | None = None


def _tools(run: Column) -> Column:
    """The run's tool definitions: name, whether people take over, the text of the parameters' schema, and all of it as JSON."""

    def shape(t: Column) -> Column:
        name, schema, over = first_true(t, "tool_name", "name"), first_true(t, "params_schema", "paramsSchema", "json_schema"), truthy(t, "$.is_takeover") | truthy(t, "$.isTakeover")
        whole = payload(tool_name=F.coalesce(text_of(name), F.lit('"tool_unknown"')), description=raw(value_at(t, "$.description")), params_schema=raw(text_of(schema)), is_takeover=F.when(over, "true").otherwise("false"))
        return F.struct(F.coalesce(get(name), F.lit("tool_unknown")).alias("name"), over.alias("takeover"), get(schema).alias("schema"), whole.alias("whole"))

    return F.transform(F.filter(items(first_true(run, "tools", "tool_definitions", "toolDefinitions")), lambda t: kind_of(t).startswith("OBJECT")), shape)


def steps_of(rows: DataFrame, scenario: str | Column) -> DataFrame:
    """One row a step of a run: the run itself (m = -1), each message (p = -1), each part."""
    r = F.col("record")
    rows = rows.select("file", "pos", parsed("record").alias("record"), scenario_column(scenario).cast("string").alias("scenario")).withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("pos")))
    rows = rows.select(
        "scenario", "file", "pos", r.alias("run"), first_filled(get(r, "$.run_id"), get(r, "$.runId"), F.format_string("run_%04d", "k")).alias("run_id"),
        first_filled(get(r, "$.agent_name"), get(r, "$.agentName"), F.lit("pydantic_ai_agent")).alias("agent"), first_filled(get(r, "$.model"), F.lit("unknown_model")).alias("model"),
        epoch(first_filled(get(r, "$.ts_start"), get(r, "$.tsStart"))).alias("began"), epoch(first_filled(get(r, "$.ts_end"), get(r, "$.tsEnd"), get(r, "$.ts_start"), get(r, "$.tsStart"))).alias("ended"),
        items(first_true(r, "messages", "message_history", "all_messages")).alias("messages"),
    )
    # what belongs to the run is read once a run, and only its own row carries it further
    first = lambda *names: raw(text_of(first_true(F.col("run"), *names)))
    own = {"deps_type": first("deps_type", "depsType"), "result_type": first("result_type", "resultType"), "result_schema": first("result_schema", "resultTypeSchema", "result_type_schema"), "result": value_at("run", "$.result"), "usage": F.coalesce(text_of(first_true(F.col("run"), "usage")), F.lit("{}"))}
    rows = rows.withColumns({"tools": _tools(F.col("run")), "own": F.struct(*[c.alias(k) for k, c in own.items()])}).drop("run")
    one = lambda m, message, own: F.struct(m.alias("m"), message.alias("message"), own.alias("whole"))
    none = F.lit(None).cast("struct<deps_type:string,result_type:string,result_schema:string,result:string,usage:string>")
    told = F.concat(F.array(one(F.lit(-1), empty(), F.col("own"))), F.transform("messages", lambda v, i: one(i, v, none)))
    rows = rows.withColumn("q", F.explode(told)).drop("messages", "own").select("*", "q.*").drop("q")
    x = F.col("message")
    both = rows.withColumns({"message_id": first_filled(get(x, "$.message_id"), get(x, "$.messageId"), F.format_string("msg_%04d", F.col("m") + 1)), "kind": F.when(F.col("m") >= 0, first_filled(get(x, "$.kind"), F.lit("request")))})
    said = epoch(get(x, "$.timestamp"))
    both = both.withColumn("said", F.when(said != 0, said).otherwise(F.col("began")))
    parts = F.concat(F.array(F.struct(F.lit(-1).alias("p"), empty().alias("part"))), F.transform(items(x, "$.parts"), lambda v, i: F.struct(i.alias("p"), v.alias("part"))))
    both = both.withColumn("q", F.explode(parts)).select("*", "q.*").drop("q")
    p = F.col("part")
    own = epoch(get(p, "$.timestamp"))
    return both.withColumns({
        "ts": F.when(own != 0, own).otherwise(F.col("said")), "what": F.when(F.col("p") >= 0, first_filled(get(p, "$.part_kind"), get(p, "$.partKind"), F.lit("text"))),
        "tool": first_filled(get(p, "$.tool_name"), get(p, "$.toolName"), F.lit("tool_unknown")), "call_id": first_filled(get(p, "$.tool_call_id"), get(p, "$.toolCallId")),
    })


def ingest(spark: SparkSession, path: str, scenario_id: str, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(scenarios, fragments), sorted by time and id.

    A tool return answers the call right before it among the calls and returns of its id; a call
    that nothing follows is incomplete, one that another call follows is lost. Texts of a response
    are joined into its model fragment. A retry names the last model or tool fragment before it."""
    o, source = options, records(spark, path, inner="runs")
    found, label = from_records(source, scenario_id, o), o.architecture
    if o.auto_architecture:
        label = "multi_agent" if steps_of(source, scenario_id).agg(F.count_distinct("agent")).first()[0] >= 2 else "single_agent"
    return scenario_rows(found, label, o.stack_tier), found


def from_records(records_: DataFrame, scenario: str | Column, options: Options = Options()) -> DataFrame:
    """Fragments of run records (file, pos, record), wherever they come from; a scenario may hold
    several runs, and a run is one record."""
    o = options
    rows = steps_of(records_, scenario)
    x, p = F.col("message"), F.col("part")
    is_call, is_return = F.col("what") == "tool-call", F.col("what") == "tool-return"
    rows = rows.withColumn("call_id", F.when(is_call, F.coalesce("call_id", F.concat_ws("_", F.lit("tool_call"), F.col("m").cast("string"), F.col("p").cast("string")))).when(is_return, F.coalesce("call_id", F.lit(""))))
    # what is read of a message or a part is read here, and only that goes through the windows
    texts = F.filter(items(x, "$.parts"), lambda v: F.coalesce(first_filled(get(v, "$.part_kind"), get(v, "$.partKind")), F.lit("text")) == "text")
    joined = F.array_join(F.array_compact(F.transform(texts, lambda v: get(v, "$.content"))), "\n")
    starts = (F.col("p") == -1) & (F.col("kind") == "response")
    rows = rows.withColumns({
        "args": F.coalesce(F.when(truthy(p, "$.args"), value_at(p, "$.args")), F.lit("{}")), "content": raw(value_at(p, "$.content")), "reply": F.when(is_return, F.coalesce(F.when(truthy(p, "$.content"), get(p, "$.content")), F.lit(""))),
        "text": F.when(starts & (F.size(texts) > 0), quoted(joined)), "model_id": F.when(starts, text_of(first_true(x, "model_name", "modelName"))), "metadata": F.when(starts, text_of(first_true(x, "kind_metadata", "kindMetadata"))),
        "all_tools": F.when(F.col("m") == -1, F.concat(F.lit("["), F.array_join(F.transform("tools", lambda t: t["whole"]), ", "), F.lit("]"))),
        # of the definitions only those that a call or a return may name
        "tools": F.when(is_call | is_return, F.transform("tools", lambda t: t.dropFields("whole"))),
    }).drop("message", "part")
    key = Window.partitionBy("file", "pos", "call_id", is_call | is_return).orderBy("m", "p")
    # each by itself, so that those that nobody reads are not carried
    rows = rows.withColumn("calls", is_call)
    rows = rows.withColumns({**{f"before_{c}": F.lag(c).over(key) for c in ("calls", "tool", "args", "ts")}, "after": F.lead("what").over(key)})
    answered = is_return & F.col("before_calls")
    rows = rows.withColumn("answered", F.coalesce(answered, F.lit(False))).withColumn("open", F.coalesce(is_call & F.col("after").isNull(), F.lit(False)))
    pick = lambda f: F.when(F.col("answered"), F.col(f"before_{f}")).otherwise(F.col(f))
    rows = rows.withColumns({"tool": pick("tool"), "args": pick("args"), "tool_ts": pick("ts")})
    # the run's definition of the tool, the last of that name
    rows = rows.withColumn("definition", F.when(is_call | is_return, F.get(F.reverse(F.filter("tools", lambda t: t["name"] == F.col("tool"))), F.lit(0))))
    base = F.concat(F.lit("pydantic_ai_"), "run_id", F.lit("_"))
    stamp = F.concat(base, "tool", F.lit("_"), (F.col("tool_ts") * 1000).cast("long").cast("string"))
    model_name = F.concat(base, "message_id", F.lit("_model"))
    failure = F.when(starts, F.struct(F.lit("model_generation").alias("kind"), model_name.alias("id"))).when(F.col("answered"), F.struct(F.lit("tool_call").alias("kind"), F.concat(stamp, F.lit("_tool")).alias("id")))
    rows = rows.withColumn("fails", failure)
    rows = rows.withColumn("last", F.last("fails", ignorenulls=True).over(Window.partitionBy("file", "pos").orderBy("m", "p").rowsBetween(Window.unboundedPreceding, -1)))
    actor = F.lit(o.actor_override) if o.actor_override else F.col("agent")
    url = F.col("definition.schema").rlike(r'"[^"]*https?://[^"]*"(?!\s*:)')
    tier = F.when(matches(F.col("tool"), o.cross_stack_tools_pattern, False) | F.coalesce(url, F.lit(False)), "cross_stack").otherwise(o.stack_tier)

    def one(name, kind, at, body, own_tier=None, own_actor=None):
        return fragment(name, at, kind, body, F.lit(o.stack_tier) if own_tier is None else own_tier, actor if own_actor is None else own_actor, F.col("run_id"), F.col("run_id"))

    named = lambda end: F.concat(base, "message_id", F.lit(f"_{end}_"), (F.col("p") + 1).cast("string"))
    config = payload(agent_name=quoted(F.col("agent")), model=quoted(F.col("model")), **{k: F.col(f"whole.{k}") for k in ("deps_type", "result_type", "result_schema")}, tools=F.col("all_tools"))
    model = payload(model_id=F.coalesce("model_id", quoted(F.col("model"))), internal_reasoning=F.lit('"opaque"'), kind_metadata=F.coalesce("metadata", F.lit("{}")), text=F.col("text"))
    is_run, works = F.col("m") == -1, F.col("answered") | F.col("open")
    called = payload(tool_name=quoted(F.col("tool")), args=F.col("args"), result=F.when(F.col("answered"), F.col("content")), incomplete=F.when(F.col("open"), "true"))
    takes_over = F.coalesce("definition.takeover", F.lit(False)) | matches(F.col("tool"), o.takeover_tool_pattern, False)
    reply = F.col("reply")
    verdict = F.when(matches(reply, o.human_approval_pattern, False), "human_approval").otherwise("human_rejection")
    by_tool = {"own_tier": tier, "own_actor": F.col("tool")}
    emitted = [
        emit(is_run & (F.col("p") == -1), one(F.concat(base, F.lit("config")), "config_snapshot", F.col("began"), config)),
        emit(starts, one(model_name, "model_generation", F.col("said"), model)),
        emit((F.col("what") == "system-prompt") & F.lit(o.emit_system_prompt), one(named("system"), "config_snapshot", F.col("ts"), payload(system_prompt=F.col("content")))),
        emit(F.col("what") == "user-prompt", one(named("user"), "agent_message", F.col("ts"), payload(content=F.col("content"), role=F.lit('"user"')))),
        emit(F.col("what") == "retry-prompt", one(named("retry"), "error", F.col("ts"), payload(error=F.col("content"), failed_fragment_kind=quoted(F.col("last.kind")), failed_fragment_id=quoted(F.col("last.id"))))),
        emit(works, one(F.concat(stamp, F.lit("_tool")), "tool_call", F.col("tool_ts"), called, **by_tool)),
        emit(works & matches(filled(F.col("tool")), o.state_mutation_tool_pattern, False), one(F.concat(stamp, F.lit("_state")), "state_mutation", F.col("tool_ts") + 0.0001, payload(tool_name=quoted(F.col("tool")), args=F.col("args")), **by_tool)),
        emit(F.col("answered") & takes_over, one(F.concat(stamp, F.lit("_takeover")), verdict, F.col("tool_ts") + 0.0002, payload(tool_name=quoted(F.col("tool")), content=quoted(reply)), own_tier=F.lit("human"), own_actor=F.col("tool"))),
        emit(is_run & (F.col("p") == -1) & F.col("whole.result").isNotNull(), one(F.concat(base, F.lit("result")), "agent_message", F.when(F.col("ended") != 0, F.col("ended")).otherwise(F.col("began")), payload(result=F.col("whole.result"), usage=F.col("whole.usage")))),
    ]
    return flat(rows, emitted, F.col("scenario"), ["file", "pos", "m", "p"], BY_TIME)
