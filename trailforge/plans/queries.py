"""Registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailforge.functions import scalars as S
from trailforge.operators import boundary, classify, evaluate, ordering, pairing, values
from trailforge.plans import traces
from trailforge.plans.traces import table
from trailforge.schema import CATEGORIES, FILLERS, KINDS, PROPERTIES


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.order_fragments(traces.events_as_fragments(spark, sf_dir), parents=False)


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary.detect(_ordered(spark, sf_dir))


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.chains(traces.events_as_scenarios(spark, sf_dir), classify.unit_actor_counts(_detected(spark, sf_dir)))


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.chain_feasibility(_chains(spark, sf_dir))


def order_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, sf_dir).select("scenario_id", "fragment_id", F.col("rn").cast("long").alias("rn"))


def boundary_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir).select("scenario_id", "fragment_id", "reason", F.col("unit_idx").cast("long").alias("unit_idx"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary.units(_detected(spark, sf_dir)).select("scenario_id", "unit_id", "boundary_reason", "boundary_confidence", "fragments", "start_timestamp", "end_timestamp")


def primary_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary.units(_detected(spark, sf_dir)).select("scenario_id", "unit_id", "primary_actor", "actors")


def unit_property_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = values.unit_values(traces.events_as_scenarios(spark, sf_dir), _detected(spark, sf_dir))
    return found.select("scenario_id", F.col("unit_idx").cast("long").alias("unit_idx"), "property", "category", "confidence", "gap", "value_shape", "value")


def chain_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = values.chain_values(traces.events_as_scenarios(spark, sf_dir), _detected(spark, sf_dir))
    return found.select("scenario_id", "property", "category", "confidence", "gap", "value_shape", "value")


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenths = F.sum(F.round(F.col("weight") * 10).cast("long"))
    return _chain(spark, sf_dir).groupBy("scenario_id", "architecture", "tier").agg((tenths / F.lit(70.0)).alias("completeness"))


def failure_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chain(spark, sf_dir).where("mode is not null")
    return rows.select("scenario_id", "property", "mode", classify.mode_break(F.col("mode")).alias("structural_break"))


def dominant_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.reports(_chains(spark, sf_dir)).select("scenario_id", "dominant_mode", "dominant_break", "unrecoverable_mode_count")


def reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify.reconstruct(traces.events_as_scenarios(spark, sf_dir), traces.events_as_fragments(spark, sf_dir), parents=False)
    return found.select("scenario_id", "architecture", "stack_tier", "fragments", "units_detected", *CATEGORIES, "dominant_mode")


def cell_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chain(spark, sf_dir)
    tenths = F.sum(F.round(F.col("weight") * 10).cast("long"))
    return rows.groupBy("architecture", "tier").agg(F.count_distinct("scenario_id").alias("n"), tenths.alias("tenths"), F.count("mode").alias("modes"))


def per_property_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir).groupBy("property").agg(*[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES])


def conversation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boundary.units(boundary.detect(ordering.order_fragments(traces.conversations_as_fragments(spark, sf_dir), parents=False)))
    return found.select("scenario_id", "unit_id", "boundary_reason", "fragments", "primary_actor")


def boundary_f1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found boundaries, and those within one fragment of an ``error`` row (taken for the truth)."""
    detected = _detected(spark, sf_dir)
    near = Window.partitionBy("scenario_id").orderBy("rn").rowsBetween(-1, 1)
    rows = detected.withColumn("near", F.max(F.when(F.col("kind") == "error", 1).otherwise(0)).over(near))
    found = F.col("reason").isNotNull() & (F.col("rn") > 1)
    return rows.groupBy("scenario_id").agg(F.count_if(found).alias("found"), F.count_if(F.col("kind") == "error").alias("truth"), F.count_if(found & (F.col("near") == 1)).alias("near_truth"))


def causal_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's causal children, where an event's parent is the user's event ten before."""
    fragments = traces.events_as_fragments(spark, sf_dir)
    before = F.lag("fragment_id", 10).over(Window.partitionBy("scenario_id").orderBy("timestamp", "fragment_id"))
    edges = ordering.causal_edges(fragments.withColumn("parent_trace_id", before))
    return edges.select("scenario_id", "fragment_id", F.size("children").cast("long").alias("n_children"), F.array_join("children", ",").alias("children"))


def fifo_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's k-th purchase answers the k-th signup before it, first in, first out."""
    events = table(spark, sf_dir, "events").where("event_type in ('signup', 'purchase')")
    marked = events.withColumn("opens", F.col("event_type") == "signup")
    return pairing.fifo(marked, ["user_id"], ["ts", "event_id"], "event_id", "opens").select("user_id", "open_id", "close_id")


def follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its last line item (by number) absorbed, wherever that comes."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    found = pairing.absorb(orders.select("o_orderkey"), "o_orderkey", lines, "l_orderkey", F.struct("l_linenumber", "l_partkey"), F.struct(F.col("l_partkey").alias("partkey"), F.col("l_linenumber").alias("line")))
    return found.select("o_orderkey", F.col("absorbed.partkey").alias("partkey"), F.col("absorbed.line").alias("line"))


def last_known_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value over 50 that the user had up to each event."""
    events = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("value") > 50, F.col("value")))
    return pairing.as_of(events, ["user_id"], ["ts", "event_id"], "v", "known").select("event_id", "known")


def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten events of each user and type."""
    return pairing.first_n(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], 10).select("user_id", "event_type", "event_id")


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("length"))


def epoch_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    events = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).when(F.col("event_id") % 3 == 1, iso).otherwise("")
    return events.select("event_id", S.epoch(text, milliseconds=True).alias("seconds"))


def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation texts with long digit runs and mail addresses masked."""
    masked = F.regexp_replace(F.regexp_replace("text", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", "[REDACTED]"), r"[0-9]{4,}", "[REDACTED]")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(masked, 256).alias("sha256"))


def auto_architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human fragments make a scenario human_in_the_loop, two actors multi_agent, else single_agent."""
    rows = traces.events_as_fragments(spark, sf_dir).groupBy("scenario_id").agg(F.max(F.col("kind").startswith("human_")).alias("human"), F.count_distinct("actor_id").alias("actors"))
    return rows.select("scenario_id", pairing.architecture(F.col("human"), F.col("actors")).alias("architecture"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stable seed of each user's scenario."""
    rows = traces.events_as_scenarios(spark, sf_dir)
    return rows.select("scenario_id", evaluate.stable_seed(F.col("architecture"), F.col("stack_tier"), F.col("scenario_id")).cast("long").alias("seed"))


def causal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose parents are other events of the user, some places later or earlier by their number: chains, clocks that
    disagree, cycles, and what hangs on them."""
    k = F.get_json_object("payload", "$.k").cast("int") % 10
    fragments = traces.events_as_fragments(spark, sf_dir).withColumn("step", F.element_at(F.array(*[F.lit(n) for n in PARENT_STEPS]), k + 1))
    by_time = Window.partitionBy("scenario_id").orderBy("timestamp", "fragment_id", "seq")
    parent = F.coalesce(*[F.when(F.col("step") == n, F.lead("fragment_id", n).over(by_time)) for n in PARENT_STEPS if n])
    linked = fragments.withColumn("parent_trace_id", parent).drop("step")
    return ordering.order_fragments(linked).select("scenario_id", "fragment_id", F.col("rn").cast("long").alias("rn"))


#: Where an event's parent stands, by the last digit of its number; 0: it has none.
PARENT_STEPS = (2, -1, 1, -3, -10, 5, 0, 0, 0, 0)


QUERIES = {
    f.__name__: f
    for f in (
        order_fragments, boundary_flags, units, primary_actor, unit_property_matrix, chain_feasibility, completeness, failure_modes, dominant_break, reconstruct,
        cell_aggregate, per_property_pivot, conversation_units, boundary_f1_counts, causal_children, fifo_pairing, follow_ups, last_known_actor, rate_limited,
        content_hash, epoch_coercion, redaction, auto_architecture, seeds, causal_order,
    )
}

# --- SQL ---------------------------------------------------------------------------------

_KINDS = ", ".join(f"'{k}'" for k in KINDS)
_FRAG = f"""frag AS (
  SELECT user_id::VARCHAR AS scenario_id, event_id AS seq, 'e' || lpad(event_id::VARCHAR, 12, '0') AS fragment_id, epoch_us(ts) / 1e6 AS ts,
         [{_KINDS}][k % 10 + 1] AS kind, 'agent_' || (k % 5)::VARCHAR AS actor_id, value / 100 AS magnitude, (k // 10) % 2 = 0 AS active, user_id, props AS payload, k
  FROM (SELECT *, json_extract_string(props, '$.k')::INTEGER AS k FROM events)),
scen AS (
  SELECT DISTINCT user_id::VARCHAR AS scenario_id, ['single_agent', 'multi_agent', 'human_in_the_loop', 'non_agentic'][user_id % 4 + 1] AS arch,
         CASE WHEN (user_id // 4) % 2 = 0 THEN 'within_stack' ELSE 'cross_stack' END AS tier FROM events)"""
_DET = """ord AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY ts, fragment_id, seq) AS rn FROM frag),
flag AS (SELECT *, CASE WHEN kind IN ('human_approval', 'human_rejection') THEN 'human' WHEN kind = 'policy_snapshot' AND active THEN 'policy'
  WHEN kind = 'tool_call' THEN 'tool_call' WHEN kind = 'state_mutation' AND magnitude >= 0.5 THEN 'state_change' END AS reason FROM ord),
det AS (SELECT *, sum(CASE WHEN reason IS NOT NULL AND rn > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY scenario_id ORDER BY rn)::BIGINT AS unit_idx FROM flag)"""
_PROPS = "props(o, property) AS (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(PROPERTIES)) + ")"
_FILL = "CASE property " + " ".join("WHEN '{}' THEN kind IN ({})".format(p, ", ".join(f"'{k}'" for k in ks)) for p, ks in FILLERS.items()) + " END"
_CHAIN = f"""{_PROPS},
um AS (SELECT scenario_id, unit_idx, o, property, count(*) FILTER ({_FILL}) AS m, count(DISTINCT actor_id) AS a FROM det CROSS JOIN props GROUP BY ALL),
uf AS (SELECT um.*, arch, tier, CASE
    WHEN property = 'reasoning_trace' AND m > 0 THEN {{'c': 'opaque', 'f': 0.9::DOUBLE, 'g': NULL::VARCHAR}}
    WHEN tier = 'cross_stack' AND property IN ('inputs', 'post_condition_state') AND m = 0 THEN {{'c': 'structurally_unfillable', 'f': 0::DOUBLE, 'g': 'cross-stack boundary discards ' || property}}
    WHEN tier = 'cross_stack' AND property IN ('inputs', 'post_condition_state') THEN {{'c': 'partially_fillable', 'f': 0.5::DOUBLE, 'g': 'cross-stack evidence partial'}}
    WHEN arch = 'multi_agent' AND property = 'operator_identity' AND a > 2 THEN {{'c': 'partially_fillable', 'f': 0.5::DOUBLE, 'g': a::VARCHAR || ' actors -- single operator identity ambiguous'}}
    WHEN arch = 'multi_agent' AND property = 'output_action' AND a >= 2 AND m > 0 THEN {{'c': 'partially_fillable', 'f': 0.6::DOUBLE, 'g': 'output action delegated across ' || a::VARCHAR || ' agents'}}
    WHEN arch = 'multi_agent' AND property = 'policy_basis' AND m = 0 THEN {{'c': 'structurally_unfillable', 'f': 0::DOUBLE, 'g': 'policy invoked implicitly across agents (mode 6)'}}
    WHEN m = 0 THEN {{'c': 'structurally_unfillable', 'f': 0::DOUBLE, 'g': 'no ' || property || ' fragment in unit'}}
    ELSE {{'c': 'fully_fillable', 'f': 1::DOUBLE, 'g': NULL::VARCHAR}} END AS x FROM um JOIN scen USING (scenario_id)),
best AS (SELECT * FROM uf QUALIFY row_number() OVER (PARTITION BY scenario_id, o ORDER BY
    CASE x.c WHEN 'fully_fillable' THEN 4 WHEN 'opaque' THEN 3 WHEN 'partially_fillable' THEN 2 ELSE 1 END DESC, x.f DESC, unit_idx) = 1),
ctx AS (SELECT scenario_id, count(DISTINCT actor_id) AS n, count(DISTINCT unit_idx) AS u, count(DISTINCT unit_idx) FILTER (kind = 'policy_snapshot') AS pu FROM det GROUP BY 1),
chain0 AS (SELECT scenario_id, arch, tier, o, property, CASE
    WHEN arch = 'multi_agent' AND property = 'output_action' AND n >= 3 THEN {{'c': 'structurally_unfillable', 'f': 0::DOUBLE, 'g': 'decision diffused across ' || n::VARCHAR || ' agents -- no single authoritative output (mode 1/5)'}}
    WHEN arch = 'multi_agent' AND property = 'policy_basis' AND pu < greatest(1, u // 3) THEN {{'c': 'structurally_unfillable', 'f': 0::DOUBLE, 'g': 'policy invoked implicitly across agents (mode 6)'}}
    WHEN arch = 'multi_agent' AND property = 'operator_identity' AND n >= 3 THEN {{'c': 'partially_fillable', 'f': 0.5::DOUBLE, 'g': n::VARCHAR || ' distinct actors across chain -- no single operator identity (delegation, mode 5)'}}
    WHEN arch = 'human_in_the_loop' AND property = 'operator_identity' AND x.c IN ('fully_fillable', 'partially_fillable') THEN {{'c': 'partially_fillable', 'f': 0.6::DOUBLE, 'g': 'shared authorship agent + operator (mode 7)'}}
    ELSE x END AS y FROM best JOIN ctx USING (scenario_id)),
chain AS (SELECT scenario_id, arch AS architecture, tier, o, property, y.c AS category, y.f AS confidence, y.g AS gap,
    CASE WHEN y.c IN ('fully_fillable', 'opaque') THEN 10 WHEN y.c = 'partially_fillable' THEN round(y.f * 10)::BIGINT ELSE 0 END AS tenths,
    CASE WHEN y.c = 'structurally_unfillable' THEN CASE WHEN tier = 'cross_stack' THEN 3 WHEN arch = 'multi_agent' THEN CASE WHEN property = 'policy_basis' THEN 6 WHEN property IN ('inputs', 'output_action') THEN 5 ELSE 1 END
      WHEN arch = 'human_in_the_loop' THEN 7 WHEN property = 'reasoning_trace' THEN 2 ELSE 4 END END AS mode FROM chain0)"""
_BREAK = "CASE WHEN {0} IN (1, 2, 5, 6) THEN 'decision_diffusion' WHEN {0} IN (3, 4) THEN 'evidence_fragmentation' WHEN {0} = 7 THEN 'responsibility_ambiguity' END"
_DOMINANT = """dom AS (SELECT scenario_id, mode, count(*) AS n, min(o) AS f FROM chain WHERE mode IS NOT NULL GROUP BY 1, 2),
dm AS (SELECT scenario_id, mode AS dominant_mode, sum(n) OVER (PARTITION BY scenario_id)::BIGINT AS modes FROM dom QUALIFY row_number() OVER (PARTITION BY scenario_id ORDER BY n DESC, f) = 1)"""
_CONF = "CASE r WHEN 'human' THEN 1.0 WHEN 'policy' THEN 0.9 WHEN 'tool_call' THEN 0.8 WHEN 'state_change' THEN 0.6 ELSE 0.5 END::DOUBLE"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_UNITS = """u AS (SELECT scenario_id, unit_idx, 'unit_' || lpad(unit_idx::VARCHAR, 4, '0') AS unit_id, coalesce(first(reason ORDER BY rn), 'initial') AS r, count(*) AS fragments,
  min(ts) AS start_timestamp, max(ts) AS end_timestamp, count(DISTINCT actor_id) AS actors FROM det GROUP BY 1, 2),
pa AS (SELECT scenario_id, unit_idx, actor_id FROM det GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY scenario_id, unit_idx ORDER BY count(*) DESC, min(rn)) = 1)"""
_CONV = """frag AS (SELECT conv_id::VARCHAR AS scenario_id, turn AS seq, 't' || lpad(turn::VARCHAR, 6, '0') AS fragment_id, turn::DOUBLE AS ts,
  CASE role WHEN 'system' THEN 'config_snapshot' WHEN 'user' THEN 'agent_message' ELSE 'model_generation' END AS kind, coalesce(role, 'unknown') AS actor_id, 0.0 AS magnitude, false AS active FROM conversations)"""

# what stands behind a finding: every unit's payloads and actors, then the one that its shape asks for
_VALUES = f"""vals AS (SELECT scenario_id, unit_idx, property, first(payload ORDER BY rn) FILTER ({_FILL}) AS one, '[' || string_agg(payload, ', ' ORDER BY rn) FILTER ({_FILL}) || ']' AS every,
  '["' || array_to_string(list_sort(list(DISTINCT actor_id)), '", "') || '"]' AS actors FROM det CROSS JOIN props GROUP BY ALL),
whole AS (SELECT scenario_id, '["' || array_to_string(list_sort(list(DISTINCT actor_id)), '", "') || '"]' AS everyone FROM det GROUP BY 1)"""
_SHAPE = """CASE {c} WHEN 'opaque' THEN 'text' WHEN 'fully_fillable' THEN CASE WHEN {m} = 1 THEN 'payload' ELSE 'list' END
  WHEN 'partially_fillable' THEN CASE WHEN property <> 'operator_identity' THEN 'payload' WHEN arch = 'multi_agent' THEN 'actors' WHEN {m} = 1 THEN 'payload' ELSE 'list' END END"""
_VALUE = "CASE " + _SHAPE + """ WHEN 'text' THEN '"<authorization_envelope>"' WHEN 'payload' THEN one WHEN 'list' THEN every WHEN 'actors' THEN {a} END"""

ORACLES = {
    "order_fragments": _with(_FRAG, _DET) + "SELECT scenario_id, fragment_id, rn FROM det",
    "boundary_flags": _with(_FRAG, _DET) + "SELECT scenario_id, fragment_id, reason, unit_idx FROM det",
    "units": _with(_FRAG, _DET, _UNITS) + f"SELECT scenario_id, unit_id, r AS boundary_reason, {_CONF} AS boundary_confidence, fragments, start_timestamp, end_timestamp FROM u",
    "primary_actor": _with(_FRAG, _DET, _UNITS) + "SELECT scenario_id, unit_id, actor_id AS primary_actor, actors FROM u JOIN pa USING (scenario_id, unit_idx)",
    "unit_property_matrix": _with(_FRAG, _DET, _CHAIN, _VALUES)
    + f"SELECT u.scenario_id, u.unit_idx, u.property, x.c AS category, x.f AS confidence, x.g AS gap, {_SHAPE.format(c='x.c', m='m')} AS value_shape, {_VALUE.format(c='x.c', m='m', a='actors')} AS value FROM uf u JOIN vals USING (scenario_id, unit_idx, property)",
    "chain_feasibility": _with(_FRAG, _DET, _CHAIN, _VALUES)
    + f"""SELECT c.scenario_id, c.property, category, c.confidence, gap, {_SHAPE.format(c='category', m='b.m')} AS value_shape, {_VALUE.format(c='category', m='b.m', a='everyone')} AS value
       FROM chain c JOIN best b USING (scenario_id, property) JOIN vals v ON v.scenario_id = c.scenario_id AND v.property = c.property AND v.unit_idx = b.unit_idx JOIN whole w ON w.scenario_id = c.scenario_id""",
    "completeness": _with(_FRAG, _DET, _CHAIN) + "SELECT scenario_id, architecture, tier, sum(tenths) / 70.0 AS completeness FROM chain GROUP BY ALL",
    "failure_modes": _with(_FRAG, _DET, _CHAIN) + f"SELECT scenario_id, property, mode, {_BREAK.format('mode')} AS structural_break FROM chain WHERE mode IS NOT NULL",
    "dominant_break": _with(_FRAG, _DET, _CHAIN, _DOMINANT) + f"SELECT scenario_id, dominant_mode, {_BREAK.format('dominant_mode')} AS dominant_break, coalesce(modes, 0) AS unrecoverable_mode_count FROM scen LEFT JOIN dm USING (scenario_id)",
    "reconstruct": _with(_FRAG, _DET, _CHAIN, _DOMINANT)
    + """SELECT scenario_id, architecture, tier AS stack_tier, fragments, units_detected, count_if(category = 'fully_fillable')::INTEGER AS fully_fillable, count_if(category = 'partially_fillable')::INTEGER AS partially_fillable,
       count_if(category = 'structurally_unfillable')::INTEGER AS structurally_unfillable, count_if(category = 'opaque')::INTEGER AS opaque, any_value(dominant_mode) AS dominant_mode
       FROM chain JOIN (SELECT scenario_id, count(*)::INTEGER AS fragments, count(DISTINCT unit_idx)::INTEGER AS units_detected FROM det GROUP BY 1) USING (scenario_id) LEFT JOIN dm USING (scenario_id) GROUP BY 1, 2, 3, 4, 5""",
    "cell_aggregate": _with(_FRAG, _DET, _CHAIN) + "SELECT architecture, tier, count(DISTINCT scenario_id) AS n, sum(tenths)::BIGINT AS tenths, count(mode) AS modes FROM chain GROUP BY ALL",
    "per_property_pivot": _with(_FRAG, _DET, _CHAIN) + "SELECT property, " + ", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in CATEGORIES) + " FROM chain GROUP BY 1",
    "conversation_units": _with(_CONV, _DET, _UNITS) + "SELECT scenario_id, unit_id, r AS boundary_reason, fragments, actor_id AS primary_actor FROM u JOIN pa USING (scenario_id, unit_idx)",
    "boundary_f1_counts": _with(_FRAG, _DET)
    + """SELECT scenario_id, count(*) FILTER (b) AS found, count(*) FILTER (kind = 'error') AS truth, count(*) FILTER (b AND near) AS near_truth FROM (
       SELECT *, reason IS NOT NULL AND rn > 1 AS b, max((kind = 'error')::INTEGER) OVER (PARTITION BY scenario_id ORDER BY rn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS near FROM det) GROUP BY 1""",
    "causal_children": _with(_FRAG)
    + """SELECT a.scenario_id, a.fragment_id, count(b.fragment_id) AS n_children, coalesce(string_agg(b.fragment_id, ',' ORDER BY b.seq), '') AS children FROM frag a LEFT JOIN (
       SELECT *, lag(fragment_id, 10) OVER (PARTITION BY scenario_id ORDER BY ts, fragment_id) AS p FROM frag) b ON a.scenario_id = b.scenario_id AND a.fragment_id = b.p GROUP BY 1, 2""",
    "fifo_pairing": """WITH RECURSIVE e AS (
       SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('signup', 'purchase')),
     s AS (SELECT user_id, i, event_id, event_type, (CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)::BIGINT AS waiting, (event_type = 'purchase' AND false) AS pairs FROM e WHERE i = 1
       UNION ALL SELECT e.user_id, e.i, e.event_id, e.event_type, CASE WHEN e.event_type = 'signup' THEN waiting + 1 ELSE greatest(waiting - 1, 0) END, e.event_type = 'purchase' AND waiting > 0 FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1),
     o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM s WHERE event_type = 'signup'),
     c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM s WHERE pairs)
     SELECT user_id, o.event_id AS open_id, c.event_id AS close_id FROM o LEFT JOIN c USING (user_id, k)
     UNION ALL SELECT user_id, NULL, event_id FROM s WHERE event_type = 'purchase' AND NOT pairs""",
    "follow_ups": """SELECT o_orderkey, l_partkey AS partkey, l_linenumber AS line FROM orders LEFT JOIN (
       SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) = 1) ON o_orderkey = l_orderkey""",
    "last_known_actor": "SELECT event_id, last_value(CASE WHEN value > 50 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS known FROM events",
    "rate_limited": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 10",
    "content_hash": "SELECT conv_id, turn, sha256(text) AS sha256, length(text) AS length FROM conversations",
    "epoch_coercion": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN (epoch_us(ts) // 1000) / 1000.0::DOUBLE WHEN 1 THEN epoch_us(ts) / 1e6 ELSE 0.0 END::DOUBLE AS seconds FROM events",
    "redaction": r"""SELECT conv_id, turn, sha256(regexp_replace(regexp_replace(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+', '[REDACTED]', 'g'), '[0-9]{4,}', '[REDACTED]', 'g')) AS sha256 FROM conversations""",
    "auto_architecture": _with(_FRAG) + "SELECT scenario_id, CASE WHEN bool_or(starts_with(kind, 'human_')) THEN 'human_in_the_loop' WHEN count(DISTINCT actor_id) >= 2 THEN 'multi_agent' ELSE 'single_agent' END AS architecture FROM frag GROUP BY 1",
    "seeds": _with(_FRAG) + """SELECT scenario_id, (('0x' || substr(sha256(arch || '|' || tier || '|' || scenario_id), 1, 8))::BIGINT & 2147483647)::BIGINT AS seed FROM scen""",
    # by the rule itself: the smallest that waits for nothing, else the smallest, one after the other
    "causal_order": "WITH RECURSIVE "
    + _FRAG
    + f""", num AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY ts, fragment_id) AS i, count(*) OVER (PARTITION BY scenario_id) AS n, {list(PARENT_STEPS)}[k % 10 + 1] AS step FROM frag),
    par AS (SELECT scenario_id, n, list(CASE WHEN step <> 0 AND i + step BETWEEN 1 AND n THEN i + step ELSE 0 END ORDER BY i) AS ps, list(fragment_id ORDER BY i) AS ids FROM num GROUP BY 1, 2),
    run AS (SELECT scenario_id, n, ps, range(1, n + 1) AS pending, 0::BIGINT AS rn, 0::BIGINT AS i FROM par
      UNION ALL SELECT scenario_id, n, ps, list_filter(pending, lambda x: x <> pick), rn + 1, pick FROM (
        SELECT *, coalesce(list_filter(pending, lambda x: NOT list_contains(pending, ps[x]))[1], pending[1]) AS pick FROM run WHERE rn < n))
    SELECT scenario_id, ids[i] AS fragment_id, rn FROM run JOIN par USING (scenario_id) WHERE rn > 0""",
}
