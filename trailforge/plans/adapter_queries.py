"""Registered queries that run adapters and statistics over the driver's tables, with their SQL.

Each user's events are taken for one trace of a vendor: the number in ``props`` decides what a
record is, so that every rule of the adapter occurs. The records are JSON text, as in a file; the
adapter gets them as rows, and the SQL says from the numbers what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailforge.adapters import langsmith, mcp, otlp
from trailforge.adapters.common import content, quoted
from trailforge.operators import boundary, classify, evaluate, ordering, prov
from trailforge.plans import traces
from trailforge.plans.queries import _BREAK, _CHAIN, _CONF, _DET, _DOMINANT, _FRAG, _UNITS, _with
from trailforge.plans.traces import table
from trailforge.schema import CATEGORIES, PROPERTIES

FRAGMENT_COLUMNS = ("scenario_id", "seq", "fragment_id", "timestamp", "kind", "stack_tier", "actor_id", "parent_trace_id")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = traces.dealt(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "props"))
    return events.select("event_id", F.col("user_id").cast("string").alias("file"), "ts", F.get_json_object("props", "$.k").cast("int").alias("k"))


def _of(k: Column, *names: str | None) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), k % len(names) + 1)


def _text(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def langsmith_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all kinds, tagged, failed, with and without an agent's name."""
    k = F.col("k")
    tags = F.when(k % 11 == 0, F.array(F.lit("policy"))).when(k % 11 == 1, F.array(F.lit("config"))).when(k % 11 == 2, F.array(F.lit("cross_stack"))).otherwise(F.array().cast("array<string>"))
    run = F.struct(
        F.format_string("r%011d", "event_id").alias("id"), _of(k, "llm", "tool", "retriever", "chain", "prompt", "parser", "embedding").alias("run_type"),
        F.when(k % 5 == 0, "human_review").otherwise(_text("step_", k % 3)).alias("name"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("start_time"), tags.alias("tags"),
        F.when(k % 13 == 0, "boom").alias("error"), F.struct(F.struct(F.when(k % 2 == 0, _text("agent_", k % 4)).alias("agent_name")).alias("metadata")).alias("extra"), F.struct(k.alias("q")).alias("inputs"),
    )
    rows = _numbered(spark, sf_dir).select("file", F.col("event_id").alias("pos"), F.to_json(run).alias("record"))
    found = langsmith.from_records(rows, F.col("file"), langsmith.Options(state_mutation_tool_pattern="step_1"))
    return found.select(*FRAGMENT_COLUMNS)


def otlp_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all operations, with their own kind, sessions and errors."""
    k = F.col("k")
    op = _of(k, "chat", "execute_tool", "create_agent", "embeddings", "invoke_agent", None)
    attributes = F.map_filter(
        F.create_map(
            F.lit("gen_ai.operation.name"), op, F.lit("gen_ai.system"), F.lit("sys"), F.lit("gen_ai.agent.id"), _text("agent_", k % 4),
            F.lit("gen_ai.tool.name"), F.when(op == "execute_tool", _text("tool_", k % 3)), F.lit("mcp.session.id"), F.when(k % 7 == 0, "s"), F.lit("demm.fragment_kind"), F.when(k % 17 == 0, "policy_snapshot"),
        ),
        lambda _, v: v.isNotNull(),
    )
    span = F.struct(
        F.format_string("%012x0000", "event_id").alias("span_id"), F.lit("span").alias("name"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string").alias("start_time_unix_nano"),
        F.when(k % 13 == 0, F.struct(F.lit("STATUS_CODE_ERROR").alias("code"), F.lit("boom").alias("message"))).alias("status"), attributes.alias("attributes"),
    )
    rows = _numbered(spark, sf_dir).select("file", F.col("event_id").alias("pos"), F.to_json(span).alias("record"))
    found = otlp.from_records(rows, F.col("file"), otlp.Options(state_mutation_tool_pattern="tool_1", accept_sampled=True))
    return found.select(*FRAGMENT_COLUMNS)


def mcp_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event a request and its answer, of the methods in turn."""
    k = F.col("k")
    method = _of(k, "initialize", "tools/call", "resources/read", "prompts/get", "tools/list")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts")
    session = F.concat(F.lit("s"), "file").alias("session_id")
    asked = F.struct(seconds, session, F.struct(F.lit("2.0").alias("jsonrpc"), F.col("event_id").alias("id"), method.alias("method"), F.struct(_text("tool_", k % 3).alias("name"), _text("uri_", k % 5).alias("uri")).alias("params")).alias("frame"))
    result = F.struct(F.struct(F.when(method == "initialize", _text("srv_", k % 3)).alias("name")).alias("serverInfo"), (k % 13 == 0).alias("isError"))
    answer = F.struct(seconds, session, F.struct(F.lit("2.0").alias("jsonrpc"), F.col("event_id").alias("id"), result.alias("result")).alias("frame"))
    both = _numbered(spark, sf_dir).select("file", (F.col("event_id") * 2).alias("n"), F.posexplode(F.array(F.to_json(asked), F.to_json(answer))).alias("side", "record"))
    found = mcp.from_records(both.select("file", (F.col("n") + F.col("side")).alias("pos"), "record"), F.col("file"), mcp.Options(state_mutation_tool_pattern="tool_1"))
    return found.select(*FRAGMENT_COLUMNS)


def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What adapters keep of a turn's text: its digest and length."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", content(quoted(F.col("text"))).alias("content"))


def redacted_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON with secrets at two depths, masked."""
    k = F.col("k")
    inner = F.struct(k.alias("n"), _text("v", k % 9).alias("access_token"), F.when(k % 3 == 0, "Bearer x").otherwise("plain").alias("note"))
    document = F.to_json(F.struct(_text("key", k % 7).alias("api_key"), F.array(inner).alias("items")))
    return _numbered(spark, sf_dir).select("event_id", mcp.redacted(document).alias("document"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.reconstruct(traces.events_as_scenarios(spark, sf_dir), traces.events_as_fragments(spark, sf_dir), parents=False)


def _scored(spark: SparkSession, sf_dir: str, tolerance: int) -> DataFrame:
    """(scenario_id, boundary_f1): found boundaries against the places of ``error`` rows."""
    detected = boundary.detect(ordering.order_fragments(traces.events_as_fragments(spark, sf_dir), parents=False))
    truth = detected.where("kind = 'error'").select("scenario_id", (F.col("rn") - 1).cast("int").alias("pos"), F.col("rn").alias("place"))
    return evaluate.boundary_f1(traces.events_as_scenarios(spark, sf_dir), evaluate.detected_positions(detected), truth, tolerance)


def boundary_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched exactly."""
    return _scored(spark, sf_dir, 0).select("scenario_id", "boundary_f1")


def boundary_f1_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched one to one within one fragment."""
    return _scored(spark, sf_dir, 1).select("scenario_id", *[F.col(c).cast("long").alias(c) for c in ("found", "truth", "hits")], "boundary_f1")


def property_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each category for each property, in per cent."""
    return evaluate.per_property(_reports(spark, sf_dir)).select("property", *CATEGORIES)


def _cell_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir).join(boundary_f1(spark, sf_dir), "scenario_id").withColumn("position", F.col("scenario_id").cast("int"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness, F1 and modal mode of each architecture and tier."""
    rows = evaluate.cells(_cell_rows(spark, sf_dir), intervals=False)
    return rows.select("architecture", "stack_tier", "n", "completeness_pct", "boundary_f1", "modal_mode", "modal_mode_share", "dominant_break")


def completeness_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bootstrap interval of each cell's completeness. SQL has no words for the generator's draws: a test holds it to a plain loop."""
    return evaluate.bootstrap_ci(_cell_rows(spark, sf_dir), ["architecture", "stack_tier"], "completeness", "position")


def provenance_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provenance graph of all users' scenarios: its nodes in the order of the document."""
    scenarios = traces.events_as_scenarios(spark, sf_dir).withColumn("position", F.col("scenario_id").cast("long"))
    return prov.bundle(scenarios, traces.events_as_fragments(spark, sf_dir)).select("place", "node")


QUERIES = {f.__name__: f for f in (langsmith_fragments, otlp_fragments, mcp_fragments, content_digest, redacted_payloads, boundary_f1, boundary_f1_near, property_shares, cells, provenance_nodes)}

# --- SQL ---------------------------------------------------------------------------------

_K = "k AS (SELECT user_id::VARCHAR AS scenario_id, event_id, epoch_us(ts) / 1e6 AS t, json_extract_string(props, '$.k')::INTEGER AS k FROM events)"


def _listed(*parts: tuple[int, str, str, str, str, str, str]) -> str:
    """Rows (place in the record, fragment id's end, kind, seconds later, tier, actor, condition)."""
    return "f AS (" + "\nUNION ALL ".join(f"SELECT scenario_id, event_id, {n} AS place, {end} AS tail, {kind} AS kind, t + {later} AS ts, {tier} AS tier, {actor} AS actor, t FROM r WHERE {when}" for n, end, kind, later, tier, actor, when in parts) + ")"


_LANGSMITH = _with(
    _K,
    """r AS (SELECT *, ['llm', 'tool', 'retriever', 'chain', 'prompt', 'parser', 'embedding'][k % 7 + 1] AS typ, CASE WHEN k % 5 = 0 THEN 'human_review' ELSE 'step_' || (k % 3) END AS name,
     k % 11 IN (0, 1) AS tagged, k % 5 = 0 AS human, k % 13 = 0 AS failed, CASE WHEN k % 11 = 2 THEN 'cross_stack' ELSE 'within_stack' END AS tier,
     CASE WHEN k % 2 = 0 THEN 'agent_' || (k % 4) WHEN k % 5 = 0 THEN 'human_review' ELSE 'step_' || (k % 3) END AS actor FROM k WHERE k % 7 < 5)""",
    _listed(
        (0, "'policy'", "'policy_snapshot'", "0.0::DOUBLE", "tier", "actor", "k % 11 = 0"),
        (1, "'config'", "'config_snapshot'", "0.0::DOUBLE", "tier", "actor", "k % 11 = 1"),
        (2, "'llm'", "'model_generation'", "0.0::DOUBLE", "tier", "actor", "NOT tagged AND typ = 'llm'"),
        (3, "'tool'", "'tool_call'", "0.0::DOUBLE", "tier", "actor", "NOT tagged AND typ = 'tool'"),
        (4, "'state'", "'state_mutation'", "0.001::DOUBLE", "tier", "actor", "NOT tagged AND typ = 'tool' AND name = 'step_1'"),
        (5, "'retr'", "'retrieval_result'", "0.0::DOUBLE", "tier", "actor", "NOT tagged AND typ = 'retriever'"),
        (6, "'human'", "CASE WHEN failed THEN 'human_rejection' ELSE 'human_approval' END", "0.0::DOUBLE", "'human'", "actor", "NOT tagged AND typ IN ('chain', 'prompt') AND human"),
        (7, "'msg'", "'agent_message'", "0.0::DOUBLE", "tier", "actor", "NOT tagged AND typ IN ('chain', 'prompt') AND NOT human"),
        (8, "'err'", "'error'", "0.002::DOUBLE", "tier", "actor", "NOT tagged AND failed"),
    ),
) + """SELECT scenario_id, row_number() OVER (PARTITION BY scenario_id ORDER BY t, event_id, place) - 1 AS seq, 'ls_r' || lpad(event_id::VARCHAR, 11, '0') || '_' || tail AS fragment_id, ts AS "timestamp",
  kind, tier AS stack_tier, actor AS actor_id, NULL::VARCHAR AS parent_trace_id FROM f"""

_OTLP = _with(
    _K,
    """r AS (SELECT *, ['chat', 'execute_tool', 'create_agent', 'embeddings', 'invoke_agent', ''][k % 6 + 1] AS op, k % 17 = 0 AS own, CASE WHEN k % 7 = 0 THEN 'cross_stack' ELSE 'within_stack' END AS tier,
     'agent_' || (k % 4) AS actor FROM k)""",
    _listed(
        (0, "'policy_snapshot'", "'policy_snapshot'", "0.0::DOUBLE", "tier", "actor", "own"),
        (1, "'model'", "'model_generation'", "0.0::DOUBLE", "tier", "actor", "NOT own AND op = 'chat'"),
        (2, "'tool'", "'tool_call'", "0.0::DOUBLE", "tier", "actor", "NOT own AND op = 'execute_tool'"),
        (3, "'state'", "'state_mutation'", "0.001::DOUBLE", "tier", "actor", "NOT own AND op = 'execute_tool' AND k % 3 = 1"),
        (5, "'config'", "'config_snapshot'", "0.0::DOUBLE", "tier", "actor", "NOT own AND op = 'create_agent'"),
        (6, "'msg'", "'agent_message'", "0.0::DOUBLE", "tier", "actor", "NOT own AND op IN ('invoke_agent', '')"),
        (7, "'error'", "'error'", "0.002::DOUBLE", "tier", "actor", "k % 13 = 0 AND (own OR op <> 'embeddings')"),
    ),
) + """SELECT scenario_id, row_number() OVER (PARTITION BY scenario_id ORDER BY ts, fragment_id) - 1 AS seq, * EXCLUDE (scenario_id) FROM (
  SELECT scenario_id, 'otlp_' || lpad(lower(to_hex(event_id)), 12, '0') || '_' || tail AS fragment_id, ts AS "timestamp", ts, kind, tier AS stack_tier, actor AS actor_id, NULL::VARCHAR AS parent_trace_id FROM f)"""
_OTLP = "SELECT * EXCLUDE (ts) FROM (" + _OTLP + ")"

_MCP = _with(
    _K,
    "r AS (SELECT *, k % 5 AS m, 'mcp_s' || scenario_id || '_' || event_id || '_' AS head FROM k)",
    _listed(
        (0, "head || 'initialize'", "'config_snapshot'", "0.0::DOUBLE", "'cross_stack'", "'srv_' || (k % 3)", "m = 0"),
        (2, "head || 'tool_call'", "'tool_call'", "0.0::DOUBLE", "'cross_stack'", "'mcp_client'", "m = 1"),
        (3, "head || 'tool_state'", "'state_mutation'", "0.0001::DOUBLE", "'cross_stack'", "'mcp_client'", "m = 1 AND k % 3 = 1"),
        (4, "head || 'tool_error'", "'error'", "0.0::DOUBLE", "'cross_stack'", "'mcp_client'", "m = 1 AND k % 13 = 0"),
        (5, "head || 'resource_read'", "'retrieval_result'", "0.0::DOUBLE", "'cross_stack'", "'mcp_client'", "m = 2"),
        (6, "head || 'prompt_get'", "'agent_message'", "0.0::DOUBLE", "'cross_stack'", "'mcp_client'", "m = 3"),
    ),
) + """SELECT scenario_id, row_number() OVER (PARTITION BY scenario_id ORDER BY ts, tail) - 1 AS seq, tail AS fragment_id, ts AS "timestamp", kind, tier AS stack_tier, actor AS actor_id, 's' || scenario_id AS parent_trace_id FROM f"""

_F1 = """pos AS (SELECT scenario_id, rn - 2 AS p FROM det WHERE reason IS NOT NULL AND rn > 1), tru AS (SELECT scenario_id, rn - 1 AS p FROM det WHERE kind = 'error'),
n AS (SELECT s.scenario_id, (SELECT count(*) FROM pos WHERE pos.scenario_id = s.scenario_id)::DOUBLE AS f, (SELECT count(*) FROM tru WHERE tru.scenario_id = s.scenario_id)::DOUBLE AS t,
      (SELECT count(*) FROM pos JOIN tru USING (scenario_id, p) WHERE scenario_id = s.scenario_id)::DOUBLE AS h FROM (SELECT DISTINCT scenario_id FROM det) s),
f1 AS (SELECT scenario_id, CASE WHEN f = 0 OR t = 0 THEN (f = t)::INTEGER::DOUBLE WHEN h = 0 THEN 0.0::DOUBLE ELSE 2 * (h / f) * (h / t) / (h / f + h / t) END AS boundary_f1 FROM n)"""
_ORD = "CASE property " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(PROPERTIES)) + " END"

_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({0}) % 1000000 = 0 THEN '' ELSE '.' || lpad((epoch_us({0}) % 1000000)::VARCHAR, 6, '0') END || '+00:00'"
_TIME = "'{{\"@value\":\"' || " + _ISO + " || '\",\"@type\":\"xsd:dateTime\"}}'"
_TEXT = "coalesce('\"' || {0} || '\"', 'null')"
_PROV = _with(_FRAG, _DET, _UNITS, _CHAIN, _DOMINANT) + f""",
stamped AS (SELECT det.*, 'trace:' || det.scenario_id AS s, e.ts AS stamp FROM det JOIN events e ON e.event_id = det.seq),
list AS (SELECT scenario_id, unit_idx, min(stamp) AS t0, max(stamp) AS t1, string_agg('"' || s || '#frag/' || fragment_id || '"', ',' ORDER BY rn) AS frags FROM stamped GROUP BY 1, 2),
feas AS (SELECT scenario_id, round_even(sum(tenths) / 70.0, 4)::DOUBLE AS completeness, string_agg('{{"@id":"trace:' || scenario_id || '#chain/feas/' || property || '","@type":"PropertyFeasibility","property":"schema:' || property || '","category":"' || category
  || '","gap":' || {_TEXT.format("gap")} || ',"demm:confidence":' || confidence || '}}', ',' ORDER BY o) AS feas FROM chain GROUP BY 1),
members AS (SELECT scenario_id, string_agg('"trace:' || scenario_id || '#unit/' || unit_id || '"', ',' ORDER BY unit_idx) AS members FROM u GROUP BY 1),
all_nodes AS (
  SELECT scenario_id, 0 AS part, 0 AS pos, 0 AS behind, '{{"@id":"trace:' || scenario_id || '","@type":["prov:Collection","DecisionChain"],"demm:scenarioId":"' || scenario_id || '","architecture":"' || arch || '","stackTier":"' || tier || '","completeness":' || completeness
    || ',"dominantMode":' || coalesce(dominant_mode::VARCHAR, 'null') || ',"dominantBreak":' || {_TEXT.format("(" + _BREAK.format("dominant_mode") + ")")} || ',"members":[' || members || '],"perPropertyFeasibility":[' || feas || ']}}' AS node
  FROM scen JOIN feas USING (scenario_id) JOIN members USING (scenario_id) LEFT JOIN dm USING (scenario_id)
  UNION ALL
  SELECT scenario_id, 1, unit_idx, 0, '{{"@id":"trace:' || scenario_id || '#unit/' || unit_id || '","@type":["prov:Activity","DecisionUnit"],"prov:startedAtTime":' || {_TIME.format("t0")} || ',"prov:endedAtTime":' || {_TIME.format("t1")}
    || ',"prov:wasAssociatedWith":{{"@id":"trace:' || scenario_id || '#agent/' || actor_id || '"}},"boundaryReason":"' || r || '","boundaryConfidence":' || {_CONF} || ',"fragments":[' || frags || ']}}'
  FROM u JOIN pa USING (scenario_id, unit_idx) JOIN list USING (scenario_id, unit_idx)
  UNION ALL
  SELECT scenario_id, 2, rn, 0, '{{"@id":"' || s || '#frag/' || fragment_id || '","@type":["prov:Entity","Fragment"],"prov:generatedAtTime":' || {_TIME.format("stamp")} || ',"prov:wasAttributedTo":{{"@id":"' || s || '#agent/' || actor_id || '"}},"fragmentKind":"' || kind
    || '","demm:stackTier":"within_stack"}}' FROM stamped
  UNION ALL
  SELECT scenario_id, 2, min(rn), 1, '{{"@id":"trace:' || scenario_id || '#agent/' || actor_id || '","@type":"prov:Agent","actorId":"' || actor_id || '"}}' FROM det GROUP BY scenario_id, actor_id)
SELECT row_number() OVER (ORDER BY scenario_id::BIGINT, part, pos, behind) - 1 AS place, node FROM all_nodes"""

ORACLES = {
    "provenance_nodes": _PROV,
    "langsmith_fragments": _LANGSMITH,
    "otlp_fragments": _OTLP,
    "mcp_fragments": _MCP,
    "content_digest": """SELECT conv_id, turn, CASE WHEN text IS NULL THEN 'null' ELSE '{"sha256":"' || sha256(text) || '","length":' || length(text) || '}' END AS content FROM conversations""",
    "redacted_payloads": """SELECT event_id, '{"api_key": "[REDACTED]", "items": [{"n": ' || k || ', "access_token": "[REDACTED]", "note": ' || CASE WHEN k % 3 = 0 THEN '"[REDACTED]"' ELSE '"plain"' END || '}]}' AS document
       FROM (SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events)""",
    "boundary_f1": _with(_FRAG, _DET, _F1) + "SELECT scenario_id, boundary_f1 FROM f1",
    "boundary_f1_near": "WITH RECURSIVE "
    + ",\n".join((_FRAG, _DET))
    + """, ds AS (SELECT scenario_id, rn - 2 AS d, row_number() OVER (PARTITION BY scenario_id ORDER BY rn) AS i FROM det WHERE reason IS NOT NULL AND rn > 1),
    ts AS (SELECT scenario_id, list(rn - 1 ORDER BY rn) AS free, count(*) AS n FROM det WHERE kind = 'error' GROUP BY 1),
    run AS (SELECT scenario_id, free, 0::BIGINT AS i, 0::BIGINT AS hits FROM ts
      UNION ALL SELECT scenario_id, list_filter(free, lambda x: x IS DISTINCT FROM pick), i, hits + (pick IS NOT NULL)::BIGINT FROM (
        SELECT scenario_id, free, ds.i, hits, list_filter(free, lambda x: abs(x - d) <= 1)[1] AS pick FROM run JOIN ds USING (scenario_id) WHERE ds.i = run.i + 1)),
    n AS (SELECT s.scenario_id, coalesce(f, 0) AS found, coalesce(ts.n, 0) AS truth, coalesce(h, 0) AS hits FROM (SELECT DISTINCT scenario_id FROM det) s
      LEFT JOIN (SELECT scenario_id, count(*) AS f FROM ds GROUP BY 1) USING (scenario_id) LEFT JOIN ts USING (scenario_id) LEFT JOIN (SELECT scenario_id, max(hits) AS h FROM run GROUP BY 1) USING (scenario_id))
    SELECT *, CASE WHEN found = 0 OR truth = 0 THEN (found = truth)::INTEGER::DOUBLE WHEN hits = 0 THEN 0.0::DOUBLE
      ELSE 2 * (hits / found::DOUBLE) * (hits / truth::DOUBLE) / (hits / found::DOUBLE + hits / truth::DOUBLE) END AS boundary_f1 FROM n""",
    "property_shares": _with(_FRAG, _DET, _CHAIN) + "SELECT property, " + ", ".join(f"round_even(count(*) FILTER (category = '{c}') / count(*)::DOUBLE * 100, 1) AS {c}" for c in CATEGORIES) + " FROM chain GROUP BY 1",
    "cells": _with(_FRAG, _DET, _CHAIN, _F1)
    + f""", modes AS (SELECT architecture, tier, mode, count(*) AS k, min(scenario_id::INTEGER * 10 + {_ORD}) AS seen FROM chain WHERE mode IS NOT NULL GROUP BY ALL),
modal AS (SELECT architecture, tier, mode, k / sum(k) OVER (PARTITION BY architecture, tier)::DOUBLE AS share FROM modes QUALIFY row_number() OVER (PARTITION BY architecture, tier ORDER BY k DESC, seen) = 1),
per AS (SELECT architecture, tier, scenario_id, sum(tenths) / 70.0 AS c FROM chain GROUP BY ALL)
SELECT architecture, tier AS stack_tier, count(*)::INTEGER AS n, round_even(avg(c) * 100, 1) AS completeness_pct, round_even(avg(boundary_f1), 3) AS boundary_f1, any_value(mode) AS modal_mode,
  round_even(coalesce(any_value(share), 0.0::DOUBLE), 3) AS modal_mode_share, CASE WHEN any_value(mode) IN (1, 2, 5, 6) THEN 'decision_diffusion' WHEN any_value(mode) IN (3, 4) THEN 'evidence_fragmentation' WHEN any_value(mode) = 7 THEN 'responsibility_ambiguity' END AS dominant_break
FROM per JOIN f1 USING (scenario_id) LEFT JOIN modal USING (architecture, tier) GROUP BY architecture, tier""",
}
