"""Message rounds (request and response pairs) of the Anthropic API."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailforge.adapters.common import BY_TIME, emit, flat, fragment, number, payload, quoted, raw, scenario_column, scenario_rows
from trailforge.functions.scalars import epoch, first_filled, matches
from trailforge.functions.variants import at, empty, get, items, kind_of, parsed, text_of, truthy, value_at
from trailforge.sources.manifests import records

# Built-in tools and what their actions change.
BUILT_IN = ("computer", "bash", "text_editor")
COMPUTER_CHANGES = ("left_click", "right_click", "middle_click", "double_click", "triple_click", "type", "key", "keydown", "keyup")
EDITOR_CHANGES = ("create", "insert", "replace", "str_replace", "undo_edit")
BASH_READS = r"^(ls|cat|head|tail|pwd|echo|grep|find|stat|whoami|id|date|env|hostname)\b"


@dataclass(frozen=True)
class Options:
    """Fixed defaults of this format."""

    architecture: str = "single_agent"
    stack_tier: str = "within_stack"
    cross_stack_tools_pattern: str | None = None
    state_mutation_tool_pattern: str | None = None
    actor_override: str | None = None
    store_thinking: bool = False
    bash_readonly_pattern: str = BASH_READS


def _without_images(value):
    if isinstance(value, list):
        return [_without_images(v) for v in value]
    if not isinstance(value, dict):
        return value
    if value.get("type") != "image":
        return {k: _without_images(v) for k, v in value.items()}
    source = value.get("source") or {}
    data = str(source.get("data") or "")
    out = {"type": "image", "sha256": hashlib.sha256(data.encode()).hexdigest(), "length": len(data), "media_type": source.get("media_type")}
    return out | {k: source[k] for k in ("width", "height") if source.get(k) is not None}


@F.pandas_udf(T.StringType())
def images_hashed(documents: pd.Series) -> pd.Series:
    """JSON with the data of images, at any depth, replaced by digests."""
    return documents.map(lambda d: None if d is None else json.dumps(_without_images(json.loads(d))))


def rounds_of(rows: DataFrame, scenario: str | Column) -> DataFrame:
    """One row a round; a round without a request or a response is an error."""
    r = F.col("record")
    rows = rows.select("file", "pos", parsed("record").alias("record"), scenario_column(scenario).cast("string").alias("scenario")).withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("pos")))
    whole = truthy(r, "$.request") & truthy(r, "$.response")
    record = F.when(whole, r).otherwise(F.raise_error(F.lit("a round needs a request and a response")))
    rows = rows.withColumn("record", record)
    round_id = first_filled(get(r, "$.round_id"), get(r, "$.roundId"), F.format_string("round_%04d", "n"))
    return rows.select("scenario", "file", "n", round_id.alias("round_id"), epoch(get(r, "$.timestamp")).alias("ts"), at(r, "$.request").alias("request"), at(r, "$.response").alias("response"))


def tool_results(rows: DataFrame) -> DataFrame:
    """(scenario, use_id, result, failed): the last result of each tool use of a scenario, images hashed."""
    messages = rows.select("scenario", "file", "n", F.posexplode(items("request", "$.messages")).alias("m", "message")).where(get("message", "$.role") == "user")
    blocks = messages.select("scenario", "file", "n", "m", F.posexplode(items("message", "$.content")).alias("b", "block"))
    blocks = blocks.where((get("block", "$.type") == "tool_result") & truthy(F.col("block"), "$.tool_use_id"))
    blocks = blocks.select("scenario", get("block", "$.tool_use_id").alias("use_id"), F.struct("file", "n", "m", "b").alias("at"), raw(value_at("block", "$.content")).alias("result"), truthy(F.col("block"), "$.is_error").alias("failed"))
    # each by itself, so that the one that nobody reads is not carried
    return blocks.groupBy("scenario", "use_id").agg(F.max_by("result", "at").alias("result"), F.max_by("failed", "at").alias("failed")).withColumn("result", images_hashed("result"))


def _said(content: Column) -> Column:
    """What a user message says, tool results left out: JSON, or null."""
    blocks = F.filter(items(content), lambda b: get(b, "$.type").isNull() | (get(b, "$.type") != "tool_result"))
    parts = F.transform(blocks, lambda b: F.when(get(b, "$.type") == "text", raw(value_at(b, "$.text"))).otherwise(F.to_json(b)))
    many = F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))
    return F.when(kind_of(content) == "STRING", text_of(content)).when(F.size(parts) > 1, many).when(F.size(parts) == 1, F.get(parts, F.lit(0)))


def ingest(spark: SparkSession, path: str, scenario_id: str, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(scenarios, fragments), sorted by time and id.

    Requests, messages and response blocks are rows of one relation; tool uses are joined with
    their last results by id."""
    found = from_records(records(spark, path, inner="rounds"), scenario_id, options)
    return scenario_rows(found, options.architecture, options.stack_tier), found


def from_records(records_: DataFrame, scenario: str | Column, options: Options = Options()) -> DataFrame:
    """Fragments of round records (file, pos, record), wherever they come from; a tool use is
    answered inside its scenario."""
    o = options
    rows = asked = rounds_of(records_, scenario)
    q, a = F.col("request"), F.col("response")
    first_line = F.get(F.split(F.trim(get(q, "$.system")), "\n"), F.lit(0))
    called = F.regexp_extract(first_line, r"(?i)^You are\s+([^.,:]+)", 1)
    called = F.when(kind_of(q, "$.system") == "STRING", F.replace(F.trim(called), F.lit(" "), F.lit("_")))
    actor = F.lit(o.actor_override) if o.actor_override else first_filled(get(q, "$.metadata.user_id"), called, get(a, "$.model"), F.concat(F.lit("agent_"), F.substring(first_filled(get(a, "$.id"), F.lit("anthropic")), 1, 12)))
    # what is said of a request or a response is made once a round; parts carry only what is theirs
    def marker(b: Column, place: Column) -> Column:
        return F.when(value_at(b, "$.cache_control").isNotNull(), payload(location=place, cache_control=value_at(b, "$.cache_control")))

    marks = F.concat(
        F.transform(items(q, "$.system"), lambda b: marker(b, F.lit('"system"'))),
        F.flatten(F.transform(items(q, "$.messages"), lambda m: F.transform(items(m, "$.content"), lambda b: marker(b, raw(value_at(m, "$.role")))))),
    )
    policy = get(q, "$.metadata.demm_kind") == "policy_snapshot"
    snapshot = payload(
        model=raw(value_at(q, "$.model")), system=raw(value_at(q, "$.system")), tools=F.coalesce(F.when(truthy(q, "$.tools"), value_at(q, "$.tools")), F.lit("[]")), metadata=F.coalesce(F.when(truthy(q, "$.metadata"), value_at(q, "$.metadata")), F.lit("{}")),
        cache_control=F.concat(F.lit("["), F.array_join(F.array_compact(marks), ", "), F.lit("]")), constraint_activated=F.when(policy, "true"), policy_id=F.when(policy, F.coalesce(F.when(truthy(q, "$.metadata.policy_id"), value_at(q, "$.metadata.policy_id")), F.lit('"anthropic_request_policy"'))),
    )
    tokens = [get(a, f"$.usage.{k}").try_cast("bigint") for k in ("input_tokens", "output_tokens")]
    model_id = F.coalesce(F.when(truthy(a, "$.model"), value_at(a, "$.model")), value_at(q, "$.model"), F.lit("null"))
    model = payload(model_id=model_id, internal_reasoning=F.lit('"opaque"'), stop_reason=raw(value_at(a, "$.stop_reason")), token_count=F.when((tokens[0] + tokens[1]).isNotNull(), number(tokens[0] + tokens[1])), usage=F.when(truthy(a, "$.usage"), value_at(a, "$.usage")))
    rows = rows.withColumns({"actor": actor, "trace": first_filled(get(a, "$.id"), F.col("round_id")), "policy": F.coalesce(policy, F.lit(False)), "decision": get(q, "$.metadata.demm_human_approval"), "model_id": model_id, "snapshot": snapshot, "model": model})
    part = lambda name, i, x: F.struct(F.lit(name).alias("part"), i.alias("i"), x.alias("x"))
    parts = F.concat(
        F.array(part("request", F.lit(0), empty())), F.transform(items(q, "$.messages"), lambda x, i: part("message", i, x)),
        F.array(part("response", F.lit(0), empty())), F.transform(items(a, "$.content"), lambda x, i: part("block", i, x)),
    )
    rows = rows.select("scenario", "file", "n", "round_id", "ts", "actor", "trace", "policy", "decision", "model_id", "snapshot", "model", F.explode(parts).alias("p")).select("*", "p.*").drop("p")
    x, i, ts = F.col("x"), F.col("i"), F.col("ts")
    block = F.when(F.col("part") == "block", get(x, "$.type"))
    rows = rows.withColumns({"block": block, "use_id": F.when(block == "tool_use", first_filled(get(x, "$.id"), F.format_string("tool_%d", i + 1))), "tool": first_filled(get(x, "$.name"), F.lit("tool"))})
    def one(suffix, kind, moment, body, tier=None):
        name = F.concat(F.lit("anthropic_"), "round_id", F.lit("_"), suffix if isinstance(suffix, Column) else F.lit(suffix))
        return fragment(name, moment, kind, body, F.lit(tier or o.stack_tier) if tier is None or isinstance(tier, str) else tier, F.col("actor"), F.col("trace"), F.col("trace"))

    thought = F.coalesce(get(x, "$.thinking"), F.lit(""))
    thinking = raw(value_at(x, "$.thinking")) if o.store_thinking else F.to_json(F.struct(F.sha2(thought, 256).alias("sha256"), F.length(thought).alias("length")))
    said = _said(at(x, "$.content"))
    tool, action = F.col("tool"), F.coalesce(get(x, "$.input.action"), F.lit(""))
    tier = F.when(tool.isin(*BUILT_IN) | matches(tool, o.cross_stack_tools_pattern), "cross_stack").otherwise(o.stack_tier)
    command = first_filled(get(x, "$.input.command"), get(x, "$.input.text"), F.lit(" "))
    changes = F.when(tool == "computer", action.isin(*COMPUTER_CHANGES)).when(tool == "bash", ~matches(command, o.bash_readonly_pattern)).when(tool == "text_editor", action.isin(*EDITOR_CHANGES)).otherwise(matches(tool, o.state_mutation_tool_pattern))
    used = ts + 0.0002 + i * 0.00001
    # what is read of a part is read here, and only that goes on to the join
    order = F.array_position(F.array(*[F.lit(p) for p in ("request", "message", "response", "block")]), F.col("part"))
    own = {
        "o": order, "body": F.when(F.col("part") == "request", F.col("snapshot")).when(F.col("part") == "response", F.col("model")), "tier": tier, "changes": (F.col("block") == "tool_use") & changes, "said": F.when((F.col("part") == "message") & (get(x, "$.role") == "user"), said), "thinking": F.when(F.col("block") == "thinking", thinking),
        "words": F.when(F.col("block") == "text", raw(value_at(x, "$.text"))), "args": F.when(F.col("block") == "tool_use", raw(value_at(x, "$.input"))),
    }
    rows = rows.withColumns(own).drop("x", "snapshot", "model").join(tool_results(asked), ["scenario", "use_id"], "left")
    tier, changes, said, thinking = (F.col(c) for c in ("tier", "changes", "said", "thinking"))
    is_request, is_use, decision = F.col("part") == "request", F.col("block") == "tool_use", F.col("decision")
    name = lambda end: F.concat("use_id", F.lit(end))
    emitted = [
        emit(is_request, one("request_snapshot", F.when(F.col("policy"), "policy_snapshot").otherwise("config_snapshot"), ts, F.col("body"))),
        emit(said.isNotNull(), one(F.format_string("user_%d", i + 1), "agent_message", ts + i * 0.00001, payload(content=said, role=F.lit('"user"')))),
        emit(F.col("part") == "response", one("response_model", "model_generation", ts + 0.00005, F.col("body"))),
        emit(F.col("block") == "thinking", one(F.format_string("thinking_%d", i + 1), "model_generation", ts + 0.000051 + i * 0.000001, payload(model_id=F.col("model_id"), internal_reasoning=F.lit('"opaque"'), thinking=thinking))),
        emit(F.col("block") == "text", one(F.format_string("assistant_text_%d", i + 1), "agent_message", ts + 0.0001 + i * 0.000001, payload(content=F.col("words"), role=F.lit('"assistant"')))),
        emit(is_use, one(name("_tool"), "tool_call", used, payload(tool_name=quoted(tool), args=F.col("args"), result=F.col("result")), tier)),
        emit(changes, one(name("_state"), "state_mutation", used + 0.000001, payload(state_change_magnitude=F.lit("1.0"), event=quoted(F.concat(F.lit("state mutation via "), tool))), tier)),
        emit(is_use & F.col("failed"), one(name("_error"), "error", used + 0.000002, payload(error=F.col("result")), tier)),
        emit(is_request & decision.isin("approved", "rejected"), one(F.when(decision == "approved", "human_approval").otherwise("human_rejection"), F.when(decision == "approved", "human_approval").otherwise("human_rejection"), ts + 0.0002, payload(decision=quoted(decision)), "human")),
    ]
    return flat(rows, emitted, F.col("scenario"), ["file", "n", "o", "i"], BY_TIME)
