"""Any line JSON, through a mapping file."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailforge.adapters.common import emit, flat, fragment, payload, quoted, raw, scenario_rows, value_at, with_key
from trailforge.functions.scalars import epoch, first_filled, get, kind_of, matches
from trailforge.operators.pairing import architecture
from trailforge.schema import ARCHITECTURES, KINDS, STACK_TIERS
from trailforge.sources import settings
from trailforge.sources.lines import numbered_lines


@dataclass(frozen=True)
class Options:
    architecture: str | None = None
    stack_tier: str | None = None
    strict_unknown_kinds: bool = False
    redact_fields: tuple[str, ...] = ()
    actor_override: str | None = None


@dataclass(frozen=True)
class Mapping:
    """Where a source keeps what. Paths are dotted; a number is a place in a list."""

    source_name: str
    timestamp: str
    kind_field: str
    kind_map: dict[str, str]
    fragment_id: str | None = None
    actor_id: str | None = None
    payload: str | None = None
    skip_kinds: tuple[str, ...] = ()
    mutation_field: str | None = None
    mutation_regex: str | None = None
    follow_ups: dict[str, dict[str, str]] = field(default_factory=dict)
    tier_field: str | None = None
    tier_default: str = "within_stack"
    architecture: str = "single_agent"

    @classmethod
    def of(cls, data: dict) -> Mapping:
        """A checked mapping; unknown keys and labels are errors."""
        known = {"schema_version", "source_name", "fields", "kind_field", "kind_map", "skip_kinds", "state_mutation_predicate", "absorb_followups", "stack_tier_field", "stack_tier_default", "architecture"}
        wrong = [f"unknown key {k}" for k in data if k not in known]
        wrong += [f"missing key {k}" for k in ("source_name", "fields", "kind_field", "kind_map") if not data.get(k)]
        fields, changes = data.get("fields") or {}, data.get("state_mutation_predicate") or {}
        wrong += [f"unknown field {k}" for k in fields if k not in ("timestamp", "fragment_id", "actor_id", "payload")]
        wrong += [] if fields.get("timestamp") else ["missing field timestamp"]
        wrong += [f"unknown kind {v} for {k}" for k, v in (data.get("kind_map") or {}).items() if v not in KINDS]
        parts = ("absorbed_by_kind", "payload_key", "pair_match_field", "parent_match_field")
        wrong += [f"rule {k} needs {', '.join(parts)}" for k, r in (data.get("absorb_followups") or {}).items() if sorted(r) != sorted(parts)]
        tier, label = data.get("stack_tier_default") or "within_stack", data.get("architecture") or "single_agent"
        wrong += [] if tier in STACK_TIERS else [f"unknown tier {tier}"]
        wrong += [] if label in (*ARCHITECTURES[:3], "auto") else [f"unknown architecture {label}"]
        if wrong:
            raise ValueError("mapping: " + "; ".join(wrong))
        return cls(data["source_name"], fields["timestamp"], data["kind_field"], dict(data["kind_map"]), fields.get("fragment_id"), fields.get("actor_id"), fields.get("payload"), tuple(data.get("skip_kinds") or ()), changes.get("field"), changes.get("matches_regex"), dict(data.get("absorb_followups") or {}), data.get("stack_tier_field"), tier, label)

    def mapped_paths(self) -> list[str]:
        return [p for p in (self.kind_field, self.timestamp, self.fragment_id, self.actor_id, self.tier_field) if p]


def load_mapping(path: str) -> Mapping:
    return Mapping.of(settings.load(path))


def json_path(dotted: str) -> str:
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in dotted.split("."))


def _holder(data, parts: list[str]):
    for p in parts:
        if isinstance(data, list) and p.isdigit() and int(p) < len(data):
            data = data[int(p)]
        elif isinstance(data, dict) and p in data:
            data = data[p]
        else:
            return None
    return data


def reshape(inner: str | None, drop: list[str], redact: tuple[str, ...]):
    """A function of JSON records to their payloads: a part of the record, or the record without
    the mapped fields; redacted paths are masked (also where only the parent is there)."""

    def one(text: str) -> str:
        data = json.loads(text)
        if inner:
            *way, last = inner.split(".")
            above = _holder(data, way)
            data = _holder(data, inner.split(".")) if isinstance(above, list | dict) and _has(above, last) else {}
        else:
            for path in drop:
                *way, last = path.split(".")
                above = _holder(data, way)
                if isinstance(above, dict):
                    above.pop(last, None)
                elif isinstance(above, list) and last.isdigit() and int(last) < len(above):
                    above.pop(int(last))
        data = data if isinstance(data, dict) else {"value": data}
        for path in redact:
            *way, last = path.split(".")
            above = _holder(data, way)
            if isinstance(above, dict):
                above[last] = "[REDACTED]"
            elif isinstance(above, list) and last.isdigit() and int(last) < len(above):
                above[int(last)] = "[REDACTED]"
        return json.dumps(data)

    return F.pandas_udf(_mapped(one), T.StringType())


def _mapped(one):
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run


def _has(above, last: str) -> bool:
    return last in above if isinstance(above, dict) else last.isdigit() and int(last) < len(above)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, record): the objects of a line-JSON file with their line numbers from 1, read by splits. A line that is no
    JSON object is an error."""
    text = numbered_lines(spark, path).where(F.trim("line") != "")
    good = F.coalesce(kind_of(F.col("line")).startswith("OBJECT"), F.lit(False))
    bad = F.raise_error(F.concat(F.lit("no JSON object in line "), F.col("n").cast("string")))
    return text.select("n", F.when(good, F.trim("line")).otherwise(bad).alias("record"))


def _needed(text: Column, path: str, what: str) -> Column:
    return F.when(text.isNotNull(), text).otherwise(F.raise_error(F.concat(F.lit(f"{what} field {path!r} is missing in line "), F.col("n").cast("string"))))


def ingest(spark: SparkSession, path: str, scenario_id: str, options: Options = Options(), mapping: Mapping | None = None) -> tuple[DataFrame, DataFrame]:
    """(scenarios, fragments), in the order of the records.

    A follow-up goes to the last parent before it that has its key, else to the first after it; of
    several for one parent and key the last counts."""
    o, m = options, mapping
    at = lambda p, doc="record": get(F.col(doc), json_path(p)) if p else F.lit(None).cast("string")
    rows = lines(spark, path).withColumn("raw_kind", _needed(at(m.kind_field), m.kind_field, "kind"))
    rows = rows.where(~F.col("raw_kind").isin(*m.skip_kinds)) if m.skip_kinds else rows
    kinds = F.create_map(*[F.lit(x) for kv in m.kind_map.items() for x in kv])
    follows = F.col("raw_kind").isin(*m.follow_ups) if m.follow_ups else F.lit(False)
    rows = rows.withColumns({"kind": kinds[F.col("raw_kind")], "follows": follows})
    if o.strict_unknown_kinds:
        rows = rows.withColumn("kind", F.when(F.col("kind").isNotNull() | F.col("follows"), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unmapped kind in line "), F.col("n").cast("string")))))
    shaped = reshape(m.payload, m.mapped_paths(), o.redact_fields)
    rows = rows.withColumn("body", shaped("record")).where(F.col("kind").isNotNull() | F.col("follows"))
    mains = rows.where(~F.col("follows"))
    absorbed = _absorbed(rows, m)
    mains = mains.join(absorbed, "n", "left") if absorbed is not None else mains.withColumn("absorbed", F.lit(None).cast("array<struct<key:string,value:string>>"))
    id_ = first_filled(at(m.fragment_id), F.format_string("generic_jsonl_line_%06d", "n"))
    mains = mains.withColumn("id", id_)
    actor = F.lit(o.actor_override) if o.actor_override is not None else first_filled(at(m.actor_id), F.concat(F.lit("agent_"), F.substring("id", 1, 8)))
    rejects = F.lower("body").rlike("reject|denied|deny")
    kind = F.when((F.col("kind") == "human_approval") & rejects, "human_rejection").otherwise(F.col("kind"))
    tier = first_filled(at(m.tier_field), F.lit(o.stack_tier or m.tier_default))
    r = F.col("record")
    tool = first_filled(get(r, "$.tool"), get(r, "$.tool_name"), get(r, "$.name"))
    body = F.when((kind == "tool_call") & kind_of(F.col("body"), "$.tool_name").isNull() & tool.isNotNull(), with_key(F.col("body"), "tool_name", quoted(tool))).otherwise(F.col("body"))
    mains = mains.withColumns({"final_kind": kind, "actor": actor, "tier": tier}).withColumn("body", body)
    tool_name = raw(value_at("body", "$.tool_name"))
    body = F.col("body")
    # an absorbed value replaces one that is there
    extra = F.map_from_entries(F.coalesce("absorbed", F.array().cast("array<struct<key:string,value:string>>")))
    own = F.map_filter(F.transform_values(F.try_variant_get(F.try_parse_json(body), "$", "map<string,variant>"), lambda _, v: F.to_json(v)), lambda k, _: ~F.map_contains_key(extra, k))
    merged = F.concat(F.lit("{"), F.array_join(F.transform(F.concat(F.map_entries(own), F.map_entries(extra)), lambda e: F.concat(quoted(e["key"]), F.lit(": "), e["value"])), ", "), F.lit("}"))
    body = F.when(F.col("absorbed").isNotNull(), merged).otherwise(body)
    ts = epoch(_needed(at(m.timestamp), m.timestamp, "timestamp"))
    changes = (F.col("kind") == "tool_call") & matches(at(m.mutation_field), m.mutation_regex, False)
    result = F.when(kind_of(r, "$.result").startswith("OBJECT"), value_at(r, "$.result"))
    one = lambda name, what, data: fragment(name, ts, what, data, F.col("tier"), F.col("actor"), F.lit(m.source_name))
    emitted = [emit(F.lit(True), one(F.col("id"), F.col("final_kind"), body)), emit(changes, one(F.concat("id", F.lit("_state")), "state_mutation", payload(tool_name=tool_name, result=result)))]
    found = flat(mains, emitted, F.lit(scenario_id), ["n"])
    label = o.architecture or m.architecture
    if label == "auto":
        label = architecture(F.max(F.col("kind").startswith("human_")), F.count_distinct("actor_id"))
    return scenario_rows(found, label, o.stack_tier or m.tier_default), found


def _absorbed(rows: DataFrame, m: Mapping) -> DataFrame | None:
    """(n, absorbed): for each parent the payload keys and JSON values of its follow-ups."""
    out = None
    for kind, rule in m.follow_ups.items():
        r = F.col("record")
        parents = rows.where(F.col("raw_kind") == rule["absorbed_by_kind"]).select("n", get(r, json_path(rule["pair_match_field"])).alias("key"), F.col("n").alias("parent"), F.lit(None).cast("string").alias("value"))
        direct, name = value_at(r, json_path(rule["payload_key"])), rule["payload_key"]
        only = F.when(F.json_array_length(F.to_json(F.json_object_keys("body"))) == 1, value_at("body", f"$.{name}")) if "." not in name else F.lit(None).cast("string")
        value = F.coalesce(direct, only, F.col("body"))
        followers = rows.where(F.col("raw_kind") == kind).select("n", get(r, json_path(rule["parent_match_field"])).alias("key"), F.lit(None).cast("long").alias("parent"), value.alias("value"))
        both = parents.unionByName(followers).where("key is not null")
        key = Window.partitionBy("key").orderBy("n")
        before = F.last("parent", ignorenulls=True).over(key.rowsBetween(Window.unboundedPreceding, -1))
        after = F.first("parent", ignorenulls=True).over(key.rowsBetween(1, Window.unboundedFollowing))
        both = both.withColumn("to", F.coalesce(before, after)).where("value is not null and `to` is not null")
        last = both.groupBy(F.col("to").alias("n")).agg(F.max_by("value", "n").alias("value")).select("n", F.lit(name).alias("key"), "value")
        out = last if out is None else out.unionByName(last)
    if out is None:
        return None
    return out.groupBy("n").agg(F.collect_list(F.struct("key", "value")).alias("absorbed"))


def validate_sample(spark: SparkSession, path: str, mapping: Mapping, rows: int = 100) -> list[str]:
    """What does not fit in the first ``rows`` records: paths that never occur, lines without a time
    or kind, kinds that are not mapped."""
    m = mapping
    sample = lines(spark, path).orderBy("n").limit(rows)
    there = lambda p: kind_of(F.col("record"), json_path(p)).isNotNull()
    paths = [p for p in (m.fragment_id, m.actor_id, m.payload, m.tier_field, m.mutation_field) if p]
    known = [*m.kind_map, *m.skip_kinds, *m.follow_ups]
    kind = get(F.col("record"), json_path(m.kind_field))
    seen = sample.agg(
        *[F.max(there(p)).alias(f"p{i}") for i, p in enumerate(paths)],
        F.array_sort(F.collect_list(F.when(~there(m.timestamp), F.col("n")))).alias("no_time"), F.array_sort(F.collect_list(F.when(~there(m.kind_field), F.col("n")))).alias("no_kind"),
        F.array_sort(F.collect_set(F.when(kind.isNotNull() & ~kind.isin(*known), kind))).alias("unmapped"), F.count(F.lit(1)).alias("n"),
    ).first()
    if not seen.n:
        return ["no records"]
    out = [f"path {p!r} never occurs" for i, p in enumerate(paths) if not seen[f"p{i}"]]
    out += [f"timestamp {m.timestamp!r} is missing in line {n}" for n in seen.no_time] + [f"kind {m.kind_field!r} is missing in line {n}" for n in seen.no_kind]
    return out + [f"kind {k!r} is not mapped" for k in seen.unmapped]

