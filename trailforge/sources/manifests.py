"""Manifest files and tolerant JSON documents."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailforge.functions.scalars import get, kind_of, truthy
from trailforge.schema import ARCHITECTURES, FRAGMENT_COLUMNS, KINDS, STACK_TIERS


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, body): whole files, for documents that span lines."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("body"))


def records(spark: SparkSession, path: str, inner: str | None = None, skip_bad: bool = False) -> DataFrame:
    """(file, pos, record): the JSON records of files that hold an array, one object, an object
    with the records under ``inner``, or one JSON value a line.

    A file that parses as a whole is one document; else each non-empty line is a record, with its
    place counted in lines. ``skip_bad`` drops lines that are no JSON (a trailing comma is
    allowed there); otherwise such a line is an error. Line-delimited files are split by Spark's
    text reader only where they are read by ``lines``; this reader takes files whole, as a file
    of one trace is.
    """
    # in brackets a second value after the first is an error, as it is no one document then
    one_value = F.try_parse_json(F.concat(F.lit("["), F.col("body"), F.lit("]"))).isNotNull()
    docs = documents(spark, path).withColumn("kind", F.when(one_value, kind_of(F.col("body"))))
    whole = docs.where(F.col("kind").isNotNull())
    element = F.posexplode(F.expr("from_json(case when kind like 'ARRAY%' then body when inner_json like '[%' then inner_json else concat('[', body, ']') end, 'array<string>')"))
    whole = whole.withColumn("inner_json", get(F.col("body"), f"$.{inner}") if inner else F.lit(None).cast("string")).select("file", element.alias("pos", "record"))
    loose = docs.where(F.col("kind").isNull()).select("file", F.posexplode(F.split("body", "\r?\n")).alias("pos", "line")).where(F.trim("line") != "")
    line = F.regexp_replace(F.trim("line"), ",$", "") if skip_bad else F.trim("line")
    good = F.try_parse_json(line).isNotNull()
    record = F.when(good, line)
    if not skip_bad:
        record = F.when(good, line).otherwise(F.raise_error(F.concat(F.lit("not JSON, line "), F.col("pos") + 1, F.lit(" of "), F.col("file"))))
    loose = loose.select("file", "pos", record.alias("record"))
    return whole.unionByName(loose.where(F.col("record").isNotNull()) if skip_bad else loose)


def _checked(value: Column, allowed: tuple[str, ...], name: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.raise_error(F.concat(F.lit(f"invalid {name}: "), F.coalesce(value, F.lit("missing")), F.lit("; valid: " + ", ".join(allowed)))))


def promoted(fragments: DataFrame) -> DataFrame:
    """Fragments with the two payload fields that rules read, in the column order of the relation."""
    magnitude = F.coalesce(get("payload", "$.state_change_magnitude").try_cast("double"), F.lit(0.0))
    out = fragments.withColumn("state_change_magnitude", magnitude).withColumn("constraint_activated", truthy(F.col("payload"), "$.constraint_activated"))
    return out.select(*FRAGMENT_COLUMNS)


def read_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(scenarios, fragments) of manifest files. Missing keys and unknown labels are errors."""
    body = F.col("body")
    docs = documents(spark, path)

    def needed(column: Column, name: str) -> Column:
        return F.when(column.isNotNull(), column).otherwise(F.raise_error(F.lit(f"manifest lacks {name}")))

    top = docs.select(
        needed(get(body, "$.scenario_id"), "scenario_id").alias("scenario_id"),
        _checked(get(body, "$.architecture"), ARCHITECTURES, "architecture").alias("architecture"),
        _checked(get(body, "$.stack_tier"), STACK_TIERS, "stack_tier").alias("stack_tier"),
        needed(get(body, "$.fragments"), "fragments").alias("list"),
    )
    one = F.col("f")
    rows = top.select("scenario_id", F.posexplode(F.from_json("list", "array<string>")).alias("seq", "f"))
    fragments = rows.select(
        "scenario_id",
        F.col("seq").cast("long").alias("seq"),
        needed(get(one, "$.fragment_id"), "fragment_id").alias("fragment_id"),
        needed(get(one, "$.timestamp"), "timestamp").cast("double").alias("timestamp"),
        _checked(get(one, "$.kind"), KINDS, "kind").alias("kind"),
        _checked(get(one, "$.stack_tier"), STACK_TIERS, "stack_tier").alias("stack_tier"),
        needed(get(one, "$.actor_id"), "actor_id").alias("actor_id"),
        F.coalesce(get(one, "$.payload"), F.lit("{}")).alias("payload"),
        get(one, "$.parent_trace_id").alias("parent_trace_id"),
        get(one, "$.decision_id_hint").alias("decision_id_hint"),
    )
    return top.drop("list"), promoted(fragments)


def manifests(scenarios: DataFrame, fragments: DataFrame) -> DataFrame:
    """(scenario_id, manifest): each scenario's wire document as JSON text, fragments in order."""
    one = F.struct("seq", F.struct("fragment_id", "timestamp", "kind", "stack_tier", "actor_id", F.try_parse_json("payload").alias("payload"), "parent_trace_id", "decision_id_hint").alias("f"))
    lists = fragments.groupBy("scenario_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.to_json(one["f"], {"ignoreNullFields": "false"}).alias("f")))).alias("fs"))
    joined = scenarios.join(lists, "scenario_id", "left")
    listed = F.coalesce(F.array_join(F.transform("fs", lambda x: x["f"]), ","), F.lit(""))
    head = F.regexp_replace(F.to_json(F.struct("scenario_id", "architecture", "stack_tier")), r"\}$", "")
    return joined.select("scenario_id", F.concat(head, F.lit(',"fragments":['), listed, F.lit("]}")).alias("manifest"))


def write_manifest(manifest: str, path: str) -> None:
    """One scenario's document, indented, to a local file."""
    Path(path).write_text(json.dumps(json.loads(manifest), indent=2) + "\n")
