"""What all adapters share: one row a vendor record in, zero or more fragments a row out."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailforge.functions.scalars import json_string
from trailforge.sources.manifests import promoted

def null_text() -> Column:
    return F.lit(None).cast("string")


def raw(json: Column) -> Column:
    """A value that is JSON text already."""
    return F.coalesce(json, F.lit("null"))


def quoted(value: Column) -> Column:
    """A string value; null stays JSON null."""
    return F.coalesce(json_string(value.cast("string")), F.lit("null"))


def number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def payload(**fields: Column) -> Column:
    """A JSON object from columns that hold JSON text; a null column leaves its key out."""
    parts = [F.concat(F.lit(f'"{k}": '), v) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit("}"))


def value_at(json: Column | str, path: str) -> Column:
    """The JSON text of the value at a path: strings quoted; null where it is missing. JSON null is null too."""
    column = F.col(json) if isinstance(json, str) else json
    found = F.try_variant_get(F.try_parse_json(column), path, "variant")
    return F.when(F.schema_of_variant(found) != "VOID", F.to_json(found))


def fragment(suffix: Column | str, ts: Column, kind: Column | str, body: Column, tier: Column, actor: Column, parent: Column | None = None, hint: Column | None = None) -> dict[str, Column]:
    """A fragment's columns by name."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return {
        "fragment_id": lit(suffix), "timestamp": ts, "kind": lit(kind), "stack_tier": lit(tier), "actor_id": lit(actor), "payload": body,
        "parent_trace_id": null_text() if parent is None else parent, "decision_id_hint": null_text() if hint is None else hint,
    }


def emit(condition: Column, fields: dict[str, Column]) -> tuple[Column, dict[str, Column]]:
    """A fragment that a row gives where the condition holds."""
    return condition, fields


@dataclass(frozen=True)
class Each:
    """Fragments of a list's items: ``made`` gives the ``emit`` of an item and its place."""

    items: Column
    made: Callable[[Column, Column], tuple[Column, dict[str, Column]]]


def emitted_rows(rows: DataFrame, emitted: list, scenario: Column, order: list) -> DataFrame:
    """One row a fragment: scenario_id, what orders it, and its columns.

    A row is first multiplied by the numbers of what it gives; each column is then one choice by that number, so
    a fragment's expressions are worked out once, and a column that nobody reads (the payload) is not at all."""
    marks, made, place = [], [], F.col("__mark")
    mark = lambda n, condition, i: F.when(condition, F.struct(F.lit(n).alias("n"), i.cast("int").alias("i")))

    def each(n: int, e: Each) -> Column:
        return F.transform(e.items, lambda x, i: mark(n, e.made(x, i)[0], i))

    for n, e in enumerate(emitted):
        if isinstance(e, Each):
            marks.append(each(n, e))
            made.append(e.made(F.get(e.items, place["i"]), place["i"])[1])
        else:
            marks.append(F.array(mark(n, e[0], F.lit(0))))
            made.append(e[1])

    def chosen(name: str) -> Column:
        out = F.when(place["n"] == 0, made[0][name])
        for n, fields in enumerate(made[1:], 1):
            out = out.when(place["n"] == n, fields[name])
        return out

    parts = rows.select("*", F.posexplode(F.array_compact(F.concat(*marks))).alias("__at", "__mark"))
    by = [(F.col(c) if isinstance(c, str) else c).alias(f"__o{i}") for i, c in enumerate(order)]
    return parts.select(scenario.cast("string").alias("scenario_id"), *by, "__at", *[chosen(c).alias(c) for c in made[0]])


def numbered(parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Fragments numbered in their scenario along ``by``, the order of ``emitted_rows`` deciding between equals: one window."""
    order = [*by, *[c for c in parts.columns if c.startswith("__")]]
    seq = F.row_number().over(Window.partitionBy("scenario_id").orderBy(*order)) - 1
    return promoted(parts.withColumn("seq", seq.cast("long")))


def flat(rows: DataFrame, emitted: list, scenario: Column, order: list, by: tuple[str, ...] = ()) -> DataFrame:
    """The fragments of all rows, numbered within the scenario along ``by``, then ``order``, then their order in ``emitted``:
    a list of ``emit`` and ``Each``."""
    return numbered(emitted_rows(rows, emitted, scenario, order), by)


#: What most formats are sorted by.
BY_TIME = ("timestamp", "fragment_id")


def scenario_column(scenario: str | Column) -> Column:
    """A scenario's name: one for all records, or a column of them (the file, a session)."""
    return F.lit(scenario) if isinstance(scenario, str) else scenario


def scenario_rows(fragments: DataFrame, architecture: Column | str, tier: str) -> DataFrame:
    """One scenario row for each scenario among the fragments."""
    arch = F.lit(architecture) if isinstance(architecture, str) else architecture
    return fragments.groupBy("scenario_id").agg(arch.alias("architecture")).withColumn("stack_tier", F.lit(tier))


def plain(json_text: Column) -> Column:
    """A JSON value as text: strings unquoted, the rest as it is; JSON null is null."""
    return F.get_json_object(F.concat(F.lit('{"v":'), json_text, F.lit("}")), "$.v")


def is_string(json_text: Column) -> Column:
    return F.coalesce(json_text.startswith('"'), F.lit(False))


@F.pandas_udf(T.StringType())
def canonical(texts: pd.Series) -> pd.Series:
    """JSON with sorted keys and Python's separators, the form whose digest stands for content."""
    return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), sort_keys=True))


def content(json_text: Column, keep: bool = False) -> Column:
    """A payload value for content: itself with ``keep``, else the digest and length of a string,
    or of any other value's canonical JSON; missing content is JSON null."""
    if keep:
        return F.coalesce(json_text, F.lit("null"))
    body = F.when(is_string(json_text), plain(json_text)).otherwise(canonical(json_text))
    return F.when(json_text.isNull() | (json_text == "null"), "null").otherwise(F.to_json(F.struct(F.sha2(body, 256).alias("sha256"), F.length(body).alias("length"))))


def with_key(json_object: Column, key: str, value: Column) -> Column:
    """A JSON object with one more key at its end; a null value leaves it as it is."""
    body = F.regexp_replace(json_object, r"\s*\}\s*$", "")
    added = F.concat(body, F.when(body.rlike(r"^\s*\{\s*$"), "").otherwise(", "), F.lit(f'"{key}": '), value, F.lit("}"))
    return F.coalesce(added, json_object)
