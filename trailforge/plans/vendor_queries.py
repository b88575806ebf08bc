"""Registered queries of the adapters with pairs and messages, over ``events``, with their SQL.

As in ``adapter_queries``: each user's events are one trace, the number in ``props`` decides what
a record is. Pairs stand next to each other in a trace; each seventh has no end, in a queue of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailforge.adapters import agentframework, anthropic, crewai, pydantic_ai
from trailforge.plans.adapter_queries import _K, FRAGMENT_COLUMNS, _listed, _numbered, _of, _text
from trailforge.plans.queries import _with

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _iso(ts: Column) -> Column:
    return F.date_format(ts, _ISO)


def _records(rows: DataFrame, first: Column, second: Column) -> DataFrame:
    """(file, pos, record): one or two records an event; a null second one is left out."""
    both = rows.select("file", "event_id", F.posexplode(F.array_compact(F.array(first, second))).alias("side", "record"))
    return both.select("file", (F.col("event_id") * 2 + F.col("side")).alias("pos"), "record")


def anthropic_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds with a thought, a text and a tool use that the same trace answers."""
    k, use_id = F.col("k"), _text("u", F.col("event_id"))
    block = lambda kind, **f: F.to_json(F.struct(F.lit(kind).alias("type"), *[c.alias(n) for n, c in f.items()]))
    listed = lambda *blocks: F.concat(F.lit("["), F.array_join(F.array_compact(F.array(*blocks)), ","), F.lit("]"))
    answer = block("tool_result", tool_use_id=use_id, content=F.lit("done"), is_error=k % 7 == 0)
    told = listed(answer, F.when(k % 3 == 0, block("text", text=F.lit("and?"))))
    meta = F.struct(F.when(k % 2 == 0, _text("agent_", k % 4)).alias("user_id"), F.when(k % 11 == 0, "policy_snapshot").alias("demm_kind"), F.when(k % 13 == 0, "approved").when(k % 13 == 1, "rejected").alias("demm_human_approval"))
    system = F.when(k % 5 == 0, ',"system":"You are helper two, at work."').otherwise("")
    request = F.concat(F.lit('{"model":"m1","metadata":'), F.to_json(meta), system, F.lit(',"messages":[{"role":"user","content":"hello"},{"role":"user","content":'), told, F.lit("}]}"))
    given = F.struct(F.when(k % 3 == 0, "ls -a").otherwise("rm x").alias("command"), F.when(k % 2 == 0, "type").otherwise("insert").alias("action"))
    use = block("tool_use", id=use_id, name=_of(k, "bash", "computer", "text_editor", "step_1", "step_0"), input=given)
    response = F.concat(F.lit('{"id":"m'), F.col("event_id").cast("string"), F.lit('","model":"m1","content":'), listed(block("thinking", thinking=F.lit("hm")), block("text", text=F.lit("so")), use), F.lit("}"))
    record = F.concat(F.lit('{"round_id":"r'), F.col("event_id").cast("string"), F.lit('","timestamp":"'), _iso(F.col("ts")), F.lit('","request":'), request, F.lit(',"response":'), response, F.lit("}"))
    rows = _numbered(spark, sf_dir).select("file", F.col("event_id").alias("pos"), record.alias("record"))
    return anthropic.from_records(rows, F.col("file"), anthropic.Options(state_mutation_tool_pattern="step_1")).select(*FRAGMENT_COLUMNS)


def crewai_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two crews; a third of the actors is named by an earlier event only."""
    k, e = F.col("k"), F.col("event_id")
    kinds = ("crew_kickoff_started", "agent_execution_started", "task_started", "delegation", "manager_agent_invoked", "consensual_vote_cast", "demm_policy_snapshot", "task_failed", "tool_usage_started", "llm_call_started", "memory_query_started")
    alone = F.when(k % 7 == 0, _text("solo_", e))
    role = F.when(k % 3 != 0, _text("role_", k % 4)).alias("agent_role")
    body = F.struct(role, F.when(k % 11 == 3, "boss").alias("to_agent"), F.when(k % 11 == 8, F.coalesce(alone, _text("tool_", k % 3))).alias("tool_name"), F.when(k % 11 == 9, F.coalesce(alone, F.lit("m"))).alias("model"), F.when(k % 11 == 10, F.coalesce(alone, F.when(k % 2 == 0, "long_term").otherwise("short_term"))).alias("memory_type"))

    def event(kind: Column, end: str) -> Column:
        return F.to_json(F.struct(F.concat(_text("e", e), F.lit(end)).alias("event_id"), kind.alias("event_type"), _iso(F.col("ts")).alias("timestamp"), _text("Crew ", k % 2).alias("crew_name"), body.alias("payload")))

    ends = F.when(k % 11 == 8, F.when(k % 13 == 0, "tool_usage_error").otherwise("tool_usage_finished")).when(k % 11 == 9, "llm_call_completed").otherwise("memory_query_completed")
    rows = _records(_numbered(spark, sf_dir), event(_of(k, *kinds), "s"), F.when((k % 11 >= 8) & alone.isNull(), event(ends, "e")))
    options = crewai.Options(cross_stack_tools_pattern="tool_1", state_mutation_tool_pattern="tool_2")
    return crewai.from_records(rows, F.col("file"), options).select(*FRAGMENT_COLUMNS)


def agentframework_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with and without returns, and all single events, on two traces a scenario."""
    k, e = F.col("k"), F.col("event_id")
    begun = ("agent_called", "tool_called", "model_invocation", "message_published", "speaker_selected", "termination", "content_safety_decision", "error", "round_completed")
    alone = F.when(k % 7 == 0, _text("solo_", e))
    body = F.struct(
        F.when(k % 9 == 0, F.coalesce(alone, _text("a_", k % 3))).alias("agent_id"), F.when(k % 9 == 1, F.coalesce(alone, _text("tool_", k % 4))).alias("tool_name"), F.when(k % 9 == 2, F.coalesce(alone, F.lit("m"))).alias("model"),
        F.when(k % 5 == 0, "grpc").alias("runtime"), F.when((k % 17 == 0) & (k % 9 >= 3), "config_snapshot").alias("demm_kind"), F.lit("x").alias("content"),
    )
    sender = F.when(k % 4 == 0, "system").when(k % 4 != 3, _text("agent_", k % 4))

    def event(kind: Column, end: str) -> Column:
        return F.to_json(F.struct(F.concat(_text("e", e), F.lit(end)).alias("message_id"), kind.alias("event_type"), _iso(F.col("ts")).alias("timestamp"), _text("trace_", k % 2).alias("trace_id"), sender.alias("sender"), body.alias("payload")))

    returned = F.when(k % 9 == 0, "agent_returned").when(k % 9 == 1, "tool_returned").otherwise("model_response")
    rows = _records(_numbered(spark, sf_dir), event(_of(k, *begun), "s"), F.when((k % 9 < 3) & alone.isNull(), event(returned, "e")))
    options = agentframework.Options(cross_stack_tools_pattern="tool_1", state_mutation_tool_pattern="tool_2")
    return agentframework.from_records(rows, F.col("file"), options).select(*FRAGMENT_COLUMNS)


def pydantic_ai_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three messages; each fifth leaves its call open and is asked to try again."""
    k, e = F.col("k"), F.col("event_id")
    part = lambda kind, **f: F.to_json(F.struct(F.lit(kind).alias("part_kind"), *[c.alias(n) for n, c in f.items()]))
    message = lambda kind, *parts: F.concat(F.lit(f'{{"kind":"{kind}","parts":['), F.array_join(F.array(*parts), ","), F.lit("]}"))
    tool, call = _text("tool_", k % 4), _text("c", e)
    back = F.when(k % 5 == 0, part("retry-prompt", content=F.lit("again"))).otherwise(part("tool-return", tool_name=tool, tool_call_id=call, content=F.when(k % 2 == 0, "APPROVED").otherwise("no")))
    messages = F.concat_ws(",", message("request", part("system-prompt", content=F.lit("be")), part("user-prompt", content=F.lit("hi"))), message("response", part("text", content=F.lit("so")), part("tool-call", tool_name=tool, tool_call_id=call)), message("request", back))
    head = F.to_json(F.struct(_text("r", e).alias("run_id"), _text("agent_", k % 3).alias("agent_name"), _iso(F.col("ts")).alias("ts_start"), F.when(k % 2 == 0, _iso(F.col("ts") + F.expr("interval 1 second"))).alias("ts_end"), F.when(k % 4 == 0, "fine").alias("result")))
    record = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"messages":['), messages, F.lit("]}"))
    rows = _numbered(spark, sf_dir).select("file", e.alias("pos"), record.alias("record"))
    options = pydantic_ai.Options(cross_stack_tools_pattern="tool_0", state_mutation_tool_pattern="tool_1", takeover_tool_pattern="tool_2", human_approval_pattern="APPROVED", emit_system_prompt=True)
    return pydantic_ai.from_records(rows, F.col("file"), options).select(*FRAGMENT_COLUMNS)


QUERIES = {f.__name__: f for f in (anthropic_fragments, crewai_fragments, agentframework_fragments, pydantic_ai_fragments)}

# --- SQL ---------------------------------------------------------------------------------


def _sorted(head: str, parent: str) -> str:
    """Fragments by time and id; ``head`` and ``parent`` are expressions over a row of k."""
    return f"""SELECT f.scenario_id, row_number() OVER (PARTITION BY f.scenario_id ORDER BY f.ts, {head} || tail) - 1 AS seq, {head} || tail AS fragment_id, f.ts AS "timestamp",
  f.kind, f.tier AS stack_tier, f.actor AS actor_id, {parent} AS parent_trace_id FROM f JOIN k ON k.event_id = f.event_id AND k.scenario_id = f.scenario_id"""


_NOW = "0.0::DOUBLE"
_USE = "0.0002::DOUBLE + 2 * 0.00001::DOUBLE"
_ANTHROPIC = _with(
    _K,
    """r AS (SELECT *, 'u' || event_id AS use_id, CASE WHEN k % 2 = 0 THEN 'agent_' || (k % 4) WHEN k % 5 = 0 THEN 'helper_two' ELSE 'm1' END AS actor, CASE WHEN k % 5 < 3 THEN 'cross_stack' ELSE 'within_stack' END AS tier,
     CASE k % 5 WHEN 0 THEN k % 3 <> 0 WHEN 1 THEN k % 2 = 0 WHEN 2 THEN k % 2 = 1 ELSE k % 5 = 3 END AS changes FROM k)""",
    _listed(
        (0, "'request_snapshot'", "CASE WHEN k % 11 = 0 THEN 'policy_snapshot' ELSE 'config_snapshot' END", _NOW, "'within_stack'", "actor", "true"),
        (1, "'user_1'", "'agent_message'", _NOW, "'within_stack'", "actor", "true"),
        (2, "'user_2'", "'agent_message'", "0.00001::DOUBLE", "'within_stack'", "actor", "k % 3 = 0"),
        (3, "'response_model'", "'model_generation'", "0.00005::DOUBLE", "'within_stack'", "actor", "true"),
        (4, "'thinking_1'", "'model_generation'", "0.000051::DOUBLE", "'within_stack'", "actor", "true"),
        (5, "'assistant_text_2'", "'agent_message'", "0.0001::DOUBLE + 0.000001::DOUBLE", "'within_stack'", "actor", "true"),
        (6, "use_id || '_tool'", "'tool_call'", _USE, "tier", "actor", "true"),
        (7, "use_id || '_state'", "'state_mutation'", _USE + " + 0.000001::DOUBLE", "tier", "actor", "changes"),
        (8, "use_id || '_error'", "'error'", _USE + " + 0.000002::DOUBLE", "tier", "actor", "k % 7 = 0"),
        (9, "CASE WHEN k % 13 = 0 THEN 'human_approval' ELSE 'human_rejection' END", "CASE WHEN k % 13 = 0 THEN 'human_approval' ELSE 'human_rejection' END", "0.0002::DOUBLE", "'human'", "actor", "k % 13 < 2"),
    ),
) + _sorted("'anthropic_r' || f.event_id || '_'", "'m' || f.event_id")

_CREWAI = _with(
    _K,
    """own AS (SELECT *, k % 11 AS typ, k % 2 AS crew, k % 7 = 0 AND k % 11 >= 8 AS solo, CASE WHEN k % 3 <> 0 THEN 'role_' || (k % 4) END AS role FROM k)""",
    """named AS (SELECT *, CASE WHEN typ = 4 THEN 'Manager' WHEN typ = 3 THEN coalesce(role, 'boss') ELSE role END AS mine,
      CASE WHEN typ = 4 THEN 'Manager' WHEN typ = 3 THEN 'boss' WHEN typ IN (1, 2, 5, 8, 9, 10) THEN role END AS sets FROM own)""",
    """acting AS (SELECT *, 'agent_crew_' || crew AS plain, coalesce(mine, last_value(sets IGNORE NULLS) OVER (PARTITION BY scenario_id, crew ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'agent_crew_' || crew) AS now FROM named)""",
    """r AS (SELECT *, CASE WHEN solo AND typ <> 9 THEN coalesce(role, plain) ELSE now END AS actor, CASE WHEN typ = 8 AND NOT solo AND k % 3 = 1 OR typ = 10 AND NOT solo AND k % 2 = 0 THEN 'cross_stack' ELSE 'within_stack' END AS tier FROM acting)""",
    _listed(
        (0, "'s_crew_config'", "'config_snapshot'", _NOW, "tier", "actor", "typ = 0"),
        (1, "'s_agent_execution'", "'agent_message'", _NOW, "tier", "actor", "typ = 1"),
        (2, "'s_task_started'", "'agent_message'", _NOW, "tier", "actor", "typ = 2"),
        (3, "'s_delegation'", "'agent_message'", _NOW, "tier", "actor", "typ = 3"),
        (4, "'s_manager_invoked'", "'agent_message'", _NOW, "tier", "actor", "typ = 4"),
        (5, "'s_vote'", "'agent_message'", _NOW, "tier", "actor", "typ = 5"),
        (6, "'s_policy_snapshot'", "'policy_snapshot'", _NOW, "tier", "actor", "typ = 6"),
        (7, "'s_scope_error'", "'error'", _NOW, "tier", "actor", "typ = 7"),
        (8, "'s_tool_call'", "'tool_call'", _NOW, "tier", "actor", "typ = 8"),
        (9, "'s_tool_state'", "'state_mutation'", "0.0001::DOUBLE", "tier", "actor", "typ = 8 AND NOT solo AND k % 3 = 2"),
        (10, "'e_tool_error'", "'error'", _NOW, "'within_stack'", "actor", "typ = 8 AND NOT solo AND k % 13 = 0"),
        (11, "'s_llm_call'", "'model_generation'", _NOW, "tier", "actor", "typ = 9"),
        (12, "'s_memory_query'", "'retrieval_result'", _NOW, "tier", "actor", "typ = 10"),
    ),
) + _sorted("'crewai_crew_' || (k.k % 2) || '_e' || f.event_id", "'Crew ' || (k.k % 2)")

_AGENTFRAMEWORK = _with(
    _K,
    """r AS (SELECT *, k % 9 AS typ, k % 17 = 0 AND k % 9 >= 3 AND k % 9 <> 6 AS own, CASE WHEN k % 5 = 0 THEN 'cross_stack' ELSE 'within_stack' END AS tier,
     CASE WHEN k % 5 = 0 OR k % 9 = 1 AND k % 7 <> 0 AND k % 4 = 1 THEN 'cross_stack' ELSE 'within_stack' END AS tool_tier,
     CASE WHEN k % 4 = 0 THEN 'manager' WHEN k % 4 <> 3 THEN 'agent_' || (k % 4) WHEN k % 9 = 0 AND k % 7 = 0 THEN 'solo_' || event_id WHEN k % 9 = 0 THEN 'a_' || (k % 3) ELSE 'agent_trace_' || (k % 2) END AS actor FROM k)""",
    _listed(
        (0, "'config_snapshot'", "'config_snapshot'", _NOW, "tier", "actor", "own"),
        (1, "'agent_call'", "'agent_message'", _NOW, "tier", "actor", "typ = 0"),
        (2, "'tool_call'", "'tool_call'", _NOW, "tool_tier", "actor", "typ = 1"),
        (3, "'tool_state'", "'state_mutation'", "0.0001::DOUBLE", "tool_tier", "actor", "typ = 1 AND k % 7 <> 0 AND k % 4 = 2"),
        (4, "'model_call'", "'model_generation'", _NOW, "tier", "actor", "typ = 2"),
        (5, "'published'", "'agent_message'", _NOW, "tier", "actor", "typ = 3 AND NOT own"),
        (6, "'speaker_selected'", "'agent_message'", _NOW, "tier", "'manager'", "typ = 4 AND NOT own"),
        (7, "'termination'", "'agent_message'", _NOW, "tier", "actor", "typ = 5 AND NOT own"),
        (8, "'policy_snapshot'", "'policy_snapshot'", _NOW, "tier", "actor", "typ = 6"),
        (9, "'error'", "'error'", _NOW, "tier", "actor", "typ = 7 AND NOT own"),
    ),
) + _sorted("'agentframework_trace_' || (k.k % 2) || '_e' || f.event_id || 's_'", "'trace_' || (k.k % 2)")

_STAMP = "tool || '_' || trunc(t * 1000)::BIGINT"
_PYDANTIC = _with(
    _K,
    "r AS (SELECT *, 'agent_' || (k % 3) AS actor, 'tool_' || (k % 4) AS tool, CASE WHEN k % 4 = 0 THEN 'cross_stack' ELSE 'within_stack' END AS tier FROM k)",
    _listed(
        (0, "'config'", "'config_snapshot'", _NOW, "'within_stack'", "actor", "true"),
        (1, "'msg_0001_system_1'", "'config_snapshot'", _NOW, "'within_stack'", "actor", "true"),
        (2, "'msg_0001_user_2'", "'agent_message'", _NOW, "'within_stack'", "actor", "true"),
        (3, "'msg_0002_model'", "'model_generation'", _NOW, "'within_stack'", "actor", "true"),
        (4, _STAMP + " || '_tool'", "'tool_call'", _NOW, "tier", "tool", "true"),
        (5, _STAMP + " || '_state'", "'state_mutation'", "0.0001::DOUBLE", "tier", "tool", "k % 4 = 1"),
        (6, _STAMP + " || '_takeover'", "CASE WHEN k % 2 = 0 THEN 'human_approval' ELSE 'human_rejection' END", "0.0002::DOUBLE", "'human'", "tool", "k % 4 = 2 AND k % 5 <> 0"),
        (7, "'msg_0003_retry_1'", "'error'", _NOW, "'within_stack'", "actor", "k % 5 = 0"),
        (8, "'result'", "'agent_message'", "1.0::DOUBLE", "'within_stack'", "actor", "k % 4 = 0"),
    ),
) + _sorted("'pydantic_ai_r' || f.event_id || '_'", "'r' || f.event_id")

ORACLES = {"anthropic_fragments": _ANTHROPIC, "crewai_fragments": _CREWAI, "agentframework_fragments": _AGENTFRAMEWORK, "pydantic_ai_fragments": _PYDANTIC}
