"""Relations, enumerations and dimensions."""

from __future__ import annotations

from pyspark.sql import types as T

# The labels that traces and reports use, in their defined order.
ARCHITECTURES = ("single_agent", "multi_agent", "human_in_the_loop", "non_agentic")
AGENTIC = ARCHITECTURES[:3]
STACK_TIERS = ("within_stack", "cross_stack", "human")
KINDS = ("tool_call", "model_generation", "human_approval", "human_rejection", "policy_snapshot", "config_snapshot", "agent_message", "retrieval_result", "state_mutation", "error")
CATEGORIES = ("fully_fillable", "partially_fillable", "structurally_unfillable", "opaque")
#: Each property with the kinds of fragment that fill it.
FILLERS = {
    "inputs": ("retrieval_result", "agent_message"),
    "policy_basis": ("policy_snapshot",),
    "operator_identity": ("human_approval", "human_rejection", "agent_message"),
    "authorization_envelope": ("config_snapshot",),
    "reasoning_trace": ("model_generation",),
    "output_action": ("tool_call", "state_mutation"),
    "post_condition_state": ("state_mutation",),
}
PROPERTIES = tuple(FILLERS)
#: The structural break behind each failure mode.
BREAKS = {1: "decision_diffusion", 2: "decision_diffusion", 3: "evidence_fragmentation", 4: "evidence_fragmentation", 5: "decision_diffusion", 6: "decision_diffusion", 7: "responsibility_ambiguity"}

FRAGMENT = T.StructType(
    [
        T.StructField("scenario_id", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("fragment_id", T.StringType(), False),
        T.StructField("timestamp", T.DoubleType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("stack_tier", T.StringType(), False),
        T.StructField("actor_id", T.StringType(), False),
        T.StructField("payload", T.StringType(), False),
        T.StructField("parent_trace_id", T.StringType()),
        T.StructField("decision_id_hint", T.StringType()),
        T.StructField("state_change_magnitude", T.DoubleType()),
        T.StructField("constraint_activated", T.BooleanType()),
    ]
)
FRAGMENT_COLUMNS = tuple(FRAGMENT.names)

SCENARIO = T.StructType(
    [
        T.StructField("scenario_id", T.StringType(), False),
        T.StructField("architecture", T.StringType(), False),
        T.StructField("stack_tier", T.StringType(), False),
    ]
)
