"""The published result rows: their types, ranges, JSON Schemas, and a check of frames against them."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailforge.schema import ARCHITECTURES, BREAKS, CATEGORIES, KINDS, PROPERTIES, STACK_TIERS

_TEXT, _TIER = {"type": "string", "minLength": 1}, {"enum": ["within_stack", "cross_stack", "baseline"]}
_COUNT, _PERCENT, _SHARE = {"type": "integer", "minimum": 0}, {"type": "number", "minimum": 0.0, "maximum": 100.0}, {"type": "number", "minimum": 0.0, "maximum": 1.0}
_ARCH = {"enum": list(ARCHITECTURES)}
_MODE = {"type": ["integer", "null"], "minimum": 1, "maximum": 7}
_BREAK = {"enum": [*sorted(set(BREAKS.values())), None]}


def _object(properties: dict, required: list[str] | None = None) -> dict:
    return {"type": "object", "additionalProperties": False, "properties": properties, "required": required or list(properties)}


CELL = _object({"architecture": _ARCH, "stack_tier": _TIER, "n": {"type": "integer", "minimum": 1}, "completeness_pct": _PERCENT, "completeness_ci_low": _PERCENT, "completeness_ci_high": _PERCENT, "boundary_f1": _SHARE, "modal_mode": _MODE, "modal_mode_share": _SHARE, "dominant_break": _BREAK})
PER_SCENARIO = _object({"scenario_id": _TEXT, "architecture": _ARCH, "stack_tier": _TIER, "seed": {"type": "integer"}, "fragments": _COUNT, "units_detected": _COUNT, "completeness": _SHARE, "boundary_f1": _SHARE, "unrecoverable_mode_count": _COUNT, "dominant_mode": _MODE, "dominant_break": _BREAK})
_ONE = _object({"property": {"enum": list(PROPERTIES)}, "category": {"enum": list(CATEGORIES)}, "gap": {"type": ["string", "null"]}})
INCIDENT = _object({"incident": _TEXT, "architecture": _ARCH, "stack_tier": _TIER, "fragments": _COUNT, "units_detected": _COUNT, "completeness_pct": _PERCENT, "dominant_mode": _MODE, "dominant_break": _BREAK, "feasibility_counts": _object({c: _COUNT for c in CATEGORIES}), "per_property": {"type": "array", "items": _ONE}})
PER_PROPERTY = _object({p: _object({c: _PERCENT for c in CATEGORIES}) for p in PROPERTIES}, [])
_RULE = _object({"absorbed_by_kind": _TEXT, "payload_key": _TEXT, "pair_match_field": _TEXT, "parent_match_field": _TEXT})
MAPPING = _object(
    {
        "schema_version": {"type": "string"}, "source_name": _TEXT, "fields": _object({"timestamp": _TEXT, "fragment_id": {"type": ["string", "null"]}, "actor_id": {"type": ["string", "null"]}, "payload": {"type": ["string", "null"]}}, ["timestamp"]),
        "kind_field": _TEXT, "kind_map": {"type": "object", "minProperties": 1, "additionalProperties": {"enum": list(KINDS)}}, "skip_kinds": {"type": "array", "items": _TEXT},
        "state_mutation_predicate": _object({"field": _TEXT, "matches_regex": _TEXT}), "absorb_followups": {"type": "object", "additionalProperties": _RULE}, "stack_tier_field": {"type": ["string", "null"]}, "stack_tier_default": {"enum": list(STACK_TIERS)}, "architecture": {"enum": [*ARCHITECTURES[:3], "auto"]},
    },
    ["source_name", "fields", "kind_field", "kind_map"],
)
SCHEMAS = {
    "cells": {"type": "array", "items": CELL}, "per_scenario": {"type": "array", "items": PER_SCENARIO}, "named_incidents": {"type": "array", "items": INCIDENT}, "per_property": PER_PROPERTY, "generic_jsonl_mapping": MAPPING,
}


def export(folder: str, base: str = "urn:trailforge:schemas") -> list[Path]:
    """Write a JSON Schema file for each kind of result."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    paths = []
    for name, schema in SCHEMAS.items():
        paths.append(out / f"{name}.schema.json")
        paths[-1].write_text(json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema", "$id": f"{base}:{name}"} | schema, indent=2, sort_keys=True) + "\n")
    return paths


def _fits(column: Column, rule: dict) -> Column:
    nullable = "null" in rule.get("type", []) or None in rule.get("enum", [])
    checks = []
    if "enum" in rule:
        checks.append(column.isin(*[x for x in rule["enum"] if x is not None]))
    if "minimum" in rule:
        checks.append(column >= rule["minimum"])
    if "maximum" in rule:
        checks.append(column <= rule["maximum"])
    if rule.get("minLength"):
        checks.append(F.length(column) >= rule["minLength"])
    ok = column.isNotNull()
    for c in checks:
        ok = ok & c
    return F.coalesce(ok, F.lit(False)) | (column.isNull() & F.lit(nullable))


def violations(rows: DataFrame, schema: dict) -> dict[str, int]:
    """How many rows break the rule of each flat column; columns without a break are left out."""
    flat = {k: v for k, v in schema["properties"].items() if k in rows.columns and v.get("type") not in ("object", "array")}
    counts = rows.agg(*[F.count_if(~_fits(F.col(k), v)).alias(k) for k, v in flat.items()]).first().asDict()
    return {k: n for k, n in counts.items() if n}
