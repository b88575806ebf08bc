"""OpenTelemetry spans with generative-AI attributes."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailforge.adapters.common import BY_TIME, Each, content, emit, flat, fragment, is_string, number, payload, plain, quoted, raw, scenario_column, scenario_rows
from trailforge.functions.scalars import any_of, filled, first_filled, get, matches

from trailforge.schema import KINDS, STACK_TIERS
from trailforge.sources.manifests import records


@dataclass(frozen=True)
class Options:
    """Fixed defaults of this format."""

    architecture: str = "single_agent"
    stack_tier: str = "within_stack"
    within_stack_services: tuple[str, ...] = ()
    state_mutation_tool_pattern: str | None = None
    actor_override: str | None = None
    accept_sampled: bool = False
    sampling_rate: float | None = None
    store_content: bool = False
    auto_architecture: bool = False


_MAP = "map<string,variant>"
_PAIRS = "array<struct<key:string,value:variant>>"


def _seconds(json_text: Column) -> Column:
    """Seconds from JSON: integers and digit strings are nanoseconds, floats above 1e12 too, other
    floats seconds, other strings ISO-8601. Divided as decimals, so that the double is the nearest."""
    text = plain(json_text)
    whole = text.rlike(r"^\s*-?\d+\s*$")
    nanos = (F.trim(text).try_cast("decimal(20,0)") / F.lit(1_000_000_000).cast("decimal(20,0)")).cast("double")
    real = text.try_cast("double")
    scaled = (F.floor(F.when(real > 1e12, real).otherwise(real * 1e9)).cast("decimal(20,0)") / F.lit(1_000_000_000).cast("decimal(20,0)")).cast("double")
    iso = F.unix_micros(F.try_to_timestamp(F.trim(text))) / F.lit(1e6)
    flag = F.when(text == "true", 1e-9).when(text == "false", 0.0)
    return F.when(text.isNull() | (text == ""), F.lit(0.0)).when(whole, nanos).otherwise(F.coalesce(flag, scaled, iso))


def _attribute_value(v: Column) -> Column:
    """The JSON text of an attribute's value; the typed wrappers of the wire form are taken off
    (lists of scalars too; ``unwrapped`` has taken deeper ones off)."""
    scalar = F.coalesce(
        F.to_json(F.try_variant_get(v, "$.stringValue", "variant")), F.try_variant_get(v, "$.intValue", "bigint").cast("string"),
        F.try_variant_get(v, "$.doubleValue", "double").cast("string"), F.to_json(F.try_variant_get(v, "$.boolValue", "variant")), F.to_json(F.try_variant_get(v, "$.bytesValue", "variant")),
    )
    items = F.try_variant_get(v, "$.arrayValue.values", "array<variant>")
    one = lambda x: F.coalesce(F.to_json(F.try_variant_get(x, "$.stringValue", "variant")), F.try_variant_get(x, "$.intValue", "bigint").cast("string"), F.to_json(F.try_variant_get(x, "$.doubleValue", "variant")), F.to_json(F.try_variant_get(x, "$.boolValue", "variant")), F.to_json(x))
    return F.coalesce(scalar, F.concat(F.lit("["), F.array_join(F.transform(items, one), ", "), F.lit("]")), F.to_json(v))


def _plain_value(value):
    """A wire value without its typed wrappers, at any depth; what has no wrapper is itself. Numbers that do not parse, or
    are not finite, stay as written. The wrappers are walked with a list of open ends, so depth costs no stack."""
    top: list = [None]
    open_ends: list[tuple] = [(top, 0, value)]
    while open_ends:
        holder, place, v = open_ends.pop()
        found, inner = v, None
        if isinstance(v, dict):
            name = next((n for n in ("stringValue", "intValue", "doubleValue", "boolValue", "bytesValue", "arrayValue", "kvlistValue") if n in v), None)
            found = v if name is None else v[name]
            if name in ("intValue", "doubleValue"):
                try:
                    number = int(found) if name == "intValue" else float(found)
                    found = number if math.isfinite(number) else str(found)
                except (TypeError, ValueError, OverflowError):
                    pass
            elif name in ("arrayValue", "kvlistValue"):
                inner = found.get("values") if isinstance(found, dict) else None
                inner = inner if isinstance(inner, list) else []
                if name == "arrayValue":
                    found = [None] * len(inner)
                    open_ends += [(found, i, x) for i, x in enumerate(inner)]
                else:
                    pairs = {str(x["key"]): x.get("value") for x in inner if isinstance(x, dict) and "key" in x}
                    found = dict.fromkeys(pairs)
                    open_ends += [(found, k, x) for k, x in pairs.items()]
        holder[place] = found
    return top[0]


def _named_attributes(text: str | None) -> str | None:
    """A JSON record whose lists of attributes have become objects of plain values; no JSON stays as it is."""
    if text is None:
        return None
    try:
        data = json.loads(text)
        open_ends = [data]
        while open_ends:
            one = open_ends.pop()
            if isinstance(one, list):
                open_ends += one
            elif isinstance(one, dict):
                listed = one.get("attributes")
                if isinstance(listed, list):
                    one["attributes"] = {str(x["key"]): _plain_value(x.get("value")) for x in listed if isinstance(x, dict) and x.get("key") is not None}
                open_ends += [v for k, v in one.items() if k != "attributes"]
        return json.dumps(data)
    except (ValueError, RecursionError):
        return text


@F.pandas_udf(T.StringType())
def _renamed(texts: pd.Series) -> pd.Series:
    return texts.map(_named_attributes)


def unwrapped(record: Column) -> Column:
    """The record with nested values (lists of lists, lists of keys) of attributes made plain. Only records that may have
    some go through Python, as SQL has no words for any depth: those with a list of keys, or more than one list."""
    deep = record.contains('"kvlistValue"') | record.rlike(r'(?s)"arrayValue".*"arrayValue"')
    return F.coalesce(_renamed(F.when(deep, record)), record)


def _attributes(v: Column, path: str) -> Column:
    """Entries (key, JSON text) of an object of attributes or a list of key-value pairs."""
    listed = F.try_variant_get(v, path, _PAIRS)
    named = F.map_entries(F.transform_values(F.try_variant_get(v, path, _MAP), lambda _, x: F.to_json(x)))
    pairs = F.transform(F.filter(listed, lambda p: p["key"].isNotNull()), lambda p: F.struct(p["key"].alias("key"), _attribute_value(p["value"]).alias("value")))
    return F.coalesce(named, pairs, F.array().cast("array<struct<key:string,value:string>>"))


def _mapped(column: str) -> Column:
    """map<string, JSON text> of a column of entries; the last of equal keys wins."""
    entries = F.col(column)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def _id(text: Column, size: int) -> Column:
    """A hex id in lower case; base64 of ``size`` bytes becomes hex."""
    lower = F.lower(text)
    decoded = F.lower(F.hex(F.try_to_binary(text, F.lit("base64"))))
    return F.when(lower.rlike(f"^[0-9a-f]{{{2 * size}}}$"), lower).when(F.length(decoded) == 2 * size, decoded).otherwise(lower)


def spans(spark: SparkSession, path: str) -> DataFrame:
    """One row a span of a file, normalised: ids, times, kind, status, attributes and events."""
    return spans_of(records(spark, path))


def spans_of(rows: DataFrame) -> DataFrame:
    """One row a span of the records (file, pos, record)."""
    rows = rows.select("file", "pos", F.try_parse_json(unwrapped(F.col("record"))).alias("v"))
    # a record is parsed once, whichever of the two forms it has
    listed = lambda v, path: F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    part = lambda v, *paths: F.coalesce(*[F.try_variant_get(v, path, "variant") for path in paths])
    one = lambda p1, p2, p3, v, resource, scope: F.struct(F.array(F.col("pos").cast("long"), *[x.cast("long") for x in (p1, p2, p3)]).alias("at"), v.alias("v"), resource.alias("resource"), scope.alias("scope"))
    zero, deep = F.lit(0), F.try_variant_get("v", "$.resourceSpans", "array<variant>")
    scoped = lambda r, i: F.flatten(F.transform(listed(r, "$.scopeSpans"), lambda s, j: F.transform(listed(s, "$.spans"), lambda v, k: one(i, j, k, v, part(r, "$.resource.attributes"), part(s, "$.scope")))))
    plain_spans = F.coalesce(F.try_variant_get("v", "$.spans", "array<variant>"), F.array("v"))
    found = F.when(deep.isNotNull(), F.flatten(F.transform(deep, scoped))).otherwise(F.transform(plain_spans, lambda v, i: one(i, zero, zero, v, part(v, "$.resource.attributes", "$.resource"), part(v, "$.scope"))))
    rows = rows.select("file", F.explode(found).alias("s")).select("file", "s.at", "s.v", _attributes(F.col("s.resource"), "$").alias("resource"), "s.scope")
    v = F.col("v")
    either = lambda a, b: F.coalesce(F.to_json(F.try_variant_get(v, f"$.{a}", "variant")), F.to_json(F.try_variant_get(v, f"$.{b}", "variant")))
    kind = plain(F.to_json(F.try_variant_get(v, "$.kind", "variant")))
    named = F.lower(F.replace(kind, F.lit("SPAN_KIND_"), F.lit("")))
    code = F.coalesce(F.try_variant_get(v, "$.status.code", "string"), F.when(~F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.status", "variant")).startswith("OBJECT"), F.lit(False)), F.try_variant_get(v, "$.status", "string")), F.lit("OK"))
    start = _seconds(either("start_time_unix_nano", "startTimeUnixNano"))
    found = rows.select(
        "file", "at", "resource", "v",
        _id(plain(either("span_id", "spanId")), 8).alias("span_id"),
        filled(_id(plain(either("parent_span_id", "parentSpanId")), 8)).alias("parent"),
        first_filled(F.try_variant_get(v, "$.name", "string"), F.lit("unnamed_span")).alias("name"),
        F.when(kind.isNull(), "internal").when(kind.rlike(r"^\d+$"), F.coalesce(F.get(F.array(*[F.lit(k) for k in ("internal", "internal", "server", "client", "producer", "consumer")]), kind.try_cast("int")), F.lit("internal"))).otherwise(named).alias("kind"),
        start.alias("ts"),
        F.replace(code, F.lit("STATUS_CODE_"), F.lit("")).alias("code"),
        F.to_json(F.try_variant_get(v, "$.status.message", "variant")).alias("message"),
        F.to_json(F.try_variant_get("scope", "$.name", "variant")).alias("scope_name"),
        F.to_json(F.try_variant_get("scope", "$.version", "variant")).alias("scope_version"),
        _attributes(v, "$.attributes").alias("attrs"),
        F.coalesce(F.try_variant_get(v, "$.events", "array<variant>"), F.array().cast("array<variant>")).alias("events"),
    )
    return found.withColumns({c: _mapped(c) for c in ("resource", "attrs")})


def attribute(key: str) -> Column:
    """The JSON text of a span's attribute, its resource's where the span has none; the older
    ``llm.`` name stands in for ``gen_ai.``; null and empty strings are missing."""
    found = F.col("resource")[key]
    if key.startswith("gen_ai."):
        found = F.coalesce(F.col("attrs")["llm." + key[7:]], F.col("resource")[key])
    found = F.when(F.map_contains_key("attrs", key), F.col("attrs")[key]).otherwise(found)
    return F.when(~found.isin("null", '""'), found)


def _attr_of(event: Column, key: str) -> Column:
    """An event's attribute, from either form."""
    pair = F.get(F.filter(F.try_variant_get(event, "$.attributes", _PAIRS), lambda p: p["key"] == key), F.lit(0))
    return F.coalesce(F.to_json(F.try_variant_get(event, "$.attributes", _MAP)[key]), _attribute_value(pair["value"]))


def fragments(spark: SparkSession, path: str, scenario_id: str, options: Options = Options()) -> DataFrame:
    """Fragments of the spans of a file, sorted by time and id. A trace that says it was sampled at
    less than half is an error, unless that is accepted."""
    return _fragments(spans(spark, path), scenario_id, options)


def from_records(rows: DataFrame, scenario: str | Column, options: Options = Options()) -> DataFrame:
    """Fragments of span records (file, pos, record), wherever they come from."""
    return _fragments(spans_of(rows), scenario, options)


#: The attributes that rules read.
ATTRIBUTES = (
    "demm.fragment_kind",
    "demm.stack_tier",
    "gen_ai.agent.id",
    "gen_ai.agent.name",
    "gen_ai.operation.name",
    "gen_ai.request.model",
    "gen_ai.response.model",
    "gen_ai.system",
    "gen_ai.tool.arguments",
    "gen_ai.tool.call.arguments",
    "gen_ai.tool.name",
    "gen_ai.usage.input_tokens",
    "gen_ai.usage.output_tokens",
    "mcp.session.id",
    "otel.trace.sample_rate",
    "sampling.priority",
    "sampling.rate",
    "server.address",
    "service.name",
    "tool.arguments",
)


def _named(key: str) -> str:
    """The column that holds an attribute."""
    return "a_" + key.replace(".", "_")


def _fragments(rows: DataFrame, scenario: str | Column, o: Options) -> DataFrame:
    # each attribute that a rule asks for is looked up once a span
    rows = rows.withColumns({_named(k): attribute(k) for k in ATTRIBUTES}).drop("attrs", "resource", "v")
    rates = [F.col(_named(k)) for k in ("otel.trace.sample_rate", "sampling.priority", "sampling.rate")]
    if not o.accept_sampled:
        rate = o.sampling_rate
        if rate is None:
            numeric = F.coalesce(*[plain(r).try_cast("double") for r in rates])
            rate = rows.where(numeric.isNotNull()).agg(F.min_by(numeric, F.struct("file", "at"))).first()[0]
        if rate is not None and rate < 0.5:
            raise ValueError(f"the trace was sampled at rate {rate:.3f}; set accept_sampled to use it")
    text = lambda key: plain(F.col(_named(key)))
    tier, address = text("demm.stack_tier"), text("server.address")
    outside = (F.col("kind") == "client") & address.isNotNull() & ~address.isin(*o.within_stack_services) if o.within_stack_services else F.lit(False)
    actor = F.lit(o.actor_override) if o.actor_override else first_filled(text("gen_ai.agent.id"), text("gen_ai.agent.name"), text("service.name"), F.col("name"))
    rows = rows.withColumns({
        "op": F.lower(F.coalesce(text("gen_ai.operation.name"), F.lit(""))), "tool": text("gen_ai.tool.name"), "own_kind": text("demm.fragment_kind"), "actor": actor,
        "tier": F.when(tier.isin(*STACK_TIERS), tier).when(F.col(_named("mcp.session.id")).isNotNull() | outside, "cross_stack").otherwise(o.stack_tier),
        "prefix": F.concat(F.lit("otlp_"), F.coalesce(filled(F.substring(F.replace(F.col("span_id"), F.lit("-"), F.lit("")), 1, 12)), F.lit("unknown")), F.lit("_")),
        "system": F.col(_named("gen_ai.system")),
    })
    rows = rows.withColumn("own_kind", F.when(F.col("own_kind").isin(*KINDS), F.col("own_kind")))
    keep = o.store_content
    event_named = lambda name: F.filter("events", lambda e: F.try_variant_get(e, "$.name", "string") == name)
    said = F.filter(F.transform(event_named("gen_ai.assistant.message"), lambda e: _attr_of(e, "content")), lambda c: c.isNotNull() & (c != "null"))
    rows = rows.withColumn("said", said).withColumn("tool_event", F.get(event_named("gen_ai.tool.message"), F.lit(0)))
    result = F.coalesce(_attr_of(F.col("tool_event"), "content"), F.to_json(F.try_variant_get("tool_event", "$.attributes", "variant")))
    args = F.coalesce(*[F.col(_named(k)) for k in ("gen_ai.tool.call.arguments", "gen_ai.tool.arguments", "tool.arguments")])
    media = F.filter(F.flatten(F.transform("events", lambda e: F.map_entries(F.transform_values(F.try_variant_get(e, "$.attributes", _MAP), lambda _, x: F.to_json(x))))), lambda m: F.lower(m["key"]).rlike("image|audio|video"))
    described = F.transform(media, lambda m: F.to_json(F.struct(m["key"].alias("type"), F.sha2(plain(m["value"]), 256).alias("hash"), F.octet_length(plain(m["value"])).alias("size_bytes"))))
    # digests of non-string content run once a row, outside the lambdas
    rows = rows.withColumns({"result": content(result, keep), "args": content(args, keep), "result_raw": result, "media": F.coalesce(described, F.array().cast("array<string>"))})

    def digest(c: Column) -> Column:
        body = plain(c)
        return c if keep else F.when(c.isNull() | (c == "null"), "null").otherwise(F.to_json(F.struct(F.sha2(body, 256).alias("sha256"), F.length(body).alias("length"))))

    def one(suffix, kind, extra, offset=0.0):
        body = payload(otel_span_name=quoted(F.col("name")), gen_ai_system=raw(F.col("system")), otel_scope_name=raw(F.col("scope_name")), otel_scope_version=raw(F.col("scope_version")), **extra)
        return fragment(F.concat("prefix", suffix if isinstance(suffix, Column) else F.lit(suffix)), F.col("ts") + offset, kind, body, F.col("tier"), F.col("actor"), F.col("parent"))

    usage = lambda key: F.coalesce(text(key).try_cast("double").cast("long"), F.lit(0))
    own, op = F.col("own_kind").isNotNull(), F.col("op")
    chat, tools = ~own & op.isin("chat", "text_completion", "generate_content"), ~own & (op == "execute_tool")
    listed = lambda a: F.concat(F.lit("["), F.array_join(a, ", "), F.lit("]"))
    model = {
        "model_id": F.coalesce(F.col(_named("gen_ai.response.model")), F.col(_named("gen_ai.request.model")), F.lit('"undisclosed"')), "internal_reasoning": F.lit('"opaque"'),
        "token_count": number(usage("gen_ai.usage.input_tokens") + usage("gen_ai.usage.output_tokens")), "assistant_messages": listed(F.transform("said", digest)), "media": F.when(F.size("media") > 0, listed(F.col("media"))),
    }
    tool_name = F.coalesce("tool", F.col("name"))
    retrieved = any_of(*[get("result_raw", f"$.{k}").isNotNull() for k in ("documents", "results", "hits", "retrieved")]) & ~is_string(F.col("result_raw")) if keep else F.lit(False)
    first = [
        emit(own, one(F.col("own_kind"), F.col("own_kind"), {"override": F.lit("true")})),
        emit(chat, one("model", "model_generation", model)),
        emit(tools, one("tool", "tool_call", {"tool_name": quoted(tool_name), "args": F.col("args"), "result": F.col("result")})),
        emit(tools & matches(F.col("tool"), o.state_mutation_tool_pattern), one("state", "state_mutation", {"state_change_magnitude": F.lit("1.0"), "event": quoted(F.concat(F.lit("state mutation via "), tool_name))}, 0.001)),
        emit(tools & retrieved, one("retrieval", "retrieval_result", {"query": F.col("args"), "retrieved": F.col("result")}, 0.0015)),
        emit(~own & (op == "create_agent"), one("config", "config_snapshot", {"config_version": F.coalesce(F.col(_named("gen_ai.agent.id")), F.col(_named("gen_ai.agent.name")), quoted(F.col("name")))})),
        emit(~own & ~op.isin("chat", "text_completion", "generate_content", "execute_tool", "embeddings", "create_agent") & ((op == "invoke_agent") | F.col("system").isNotNull()), one("msg", "agent_message", {"content": quoted(F.col("name"))})),
    ]

    # embeddings give nothing at all; a filter here would read all attributes again below them
    live = own | (op != "embeddings")

    def message(e: Column, i: Column) -> tuple[Column, dict[str, Column]]:
        name = F.try_variant_get(e, "$.name", "string")
        time = F.coalesce(F.to_json(F.try_variant_get(e, "$.time_unix_nano", "variant")), F.to_json(F.try_variant_get(e, "$.timeUnixNano", "variant")))
        at = F.when(_seconds(time) == 0, F.col("ts")).otherwise(_seconds(time))
        made = one(F.concat(F.lit("event_"), i.cast("string")), "agent_message", {"event_name": quoted(name), "role": raw(_attr_of(e, "role")), "content": digest(_attr_of(e, "content"))})
        return emit(live & name.isin("gen_ai.user.message", "gen_ai.system.message"), made | {"timestamp": at})

    failed = emit(live & (F.upper("code") == "ERROR"), one("error", "error", {"error": raw(F.col("message"))}, 0.002))
    emitted = [*first, Each(F.col("events"), message), failed]
    return flat(rows, emitted, scenario_column(scenario), ["ts", "span_id", "file", "at"], BY_TIME)


def ingest(spark: SparkSession, path: str, scenario_id: str, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(scenarios, fragments). With ``auto_architecture``: human fragments, else two agent ids, or an
    agent invoked from a span of another agent (a self-join on span ids), else the option."""
    rows = spans(spark, path)
    found = _fragments(rows, scenario_id, options)
    if not options.auto_architecture:
        return scenario_rows(found, options.architecture, options.stack_tier), found
    agents = rows.select("span_id", "parent", plain(attribute("gen_ai.agent.id")).alias("agent"), F.lower(plain(attribute("gen_ai.operation.name"))).alias("op"))
    above = agents.select(F.col("span_id").alias("parent"), F.col("agent").alias("above"))
    handed = agents.where("op = 'invoke_agent'").join(above, "parent").where("not agent <=> above").limit(1).count()
    several = agents.agg(F.count_distinct("agent")).first()[0] >= 2
    human = F.max(F.col("kind").startswith("human_"))
    label = F.when(human, "human_in_the_loop").otherwise("multi_agent" if handed or several else options.architecture)
    return scenario_rows(found, label, options.stack_tier), found



