"""Column expressions shared by the readers and adapters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers above this are taken for milliseconds where the ms heuristic is on.
MILLISECONDS_FROM = 10_000_000_000.0


def get(json: Column | str, path: str) -> Column:
    """The text at a JSON path of a JSON string: strings unquoted, the rest as JSON; null if
    missing or JSON null."""
    return F.get_json_object(json, path)


def kind_of(json: Column, path: str = "$") -> Column:
    """The JSON type at a path: STRING, BIGINT, DOUBLE, DECIMAL(..), BOOLEAN, OBJECT<..>, ARRAY<..>, VOID or null."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), path, "variant"))


def truthy(json: Column, path: str = "$") -> Column:
    """Python's truth of the value at a JSON path: missing, null, false, 0, "", [] and {} are false."""
    kind, text = kind_of(json, path), get(json, path)
    return (
        F.when(kind.isNull() | (kind == "VOID"), False)
        .when(kind == "BOOLEAN", text == "true")
        .when(kind == "STRING", F.length(text) > 0)
        .when(kind.startswith("ARRAY"), text != "[]")
        .when(kind.startswith("OBJECT"), text != "{}")
        .otherwise(~text.rlike(r"^-?0+(\.0*)?([eE][-+]?[0-9]+)?$"))
    )


def filled(col: Column) -> Column:
    """Null where a text is empty."""
    return F.when(F.length(col) > 0, col)


def first_filled(*cols: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[filled(c) for c in cols])


def epoch(text: Column, milliseconds: bool = False) -> Column:
    """Seconds since the epoch from a number, a digit string or an ISO-8601 text; null and empty: 0.

    With ``milliseconds``, numbers above ten thousand million are milliseconds. Texts without a
    zone are in the session's zone. What is none of these is null.
    """
    # only what can be a number is cast: a cast that fails costs an exception a row
    number = F.when(text.rlike(r"^[\s0-9eE.+-]+$"), text.try_cast("double"))
    if milliseconds:
        number = F.when(number > MILLISECONDS_FROM, number / 1000.0).otherwise(number)
    iso = F.unix_micros(F.try_to_timestamp(text)) / F.lit(1e6)
    return F.when(text.isNull() | (text == ""), F.lit(0.0)).otherwise(F.coalesce(number, iso))


def iso_utc(seconds: Column) -> Column:
    """UTC ISO-8601 with the fraction left out where it is zero (session zone UTC)."""
    ts = F.timestamp_micros(F.round(seconds * 1e6).cast("long"))
    return F.when(F.unix_micros(ts) % 1_000_000 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def matches(text: Column, pattern: str | None, ignore_case: bool = True) -> Column:
    """Whether a pattern occurs in a text; an empty pattern never does."""
    if not pattern:
        return F.lit(False)
    return F.coalesce(text.rlike(("(?i)" if ignore_case else "") + pattern), F.lit(False))


def content_digest(text: Column, keep: bool = False) -> Column:
    """A string's digest and length as JSON, or with ``keep`` the string as JSON; null stays null."""
    if keep:
        return F.when(text.isNotNull(), F.regexp_replace(F.to_json(F.struct(text.alias("v"))), r'^\{"v":|\}$', ""))
    return F.when(text.isNotNull(), F.to_json(F.struct(F.sha2(text, 256).alias("sha256"), F.length(text).alias("length"))))


def json_object(**fields: Column) -> Column:
    """A JSON object from columns that already hold JSON; null columns are left out."""
    parts = [F.when(c.isNotNull(), F.concat(F.lit(f'"{name}": '), c.cast("string"))) for name, c in fields.items()]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit("}"))


def json_string(text: Column) -> Column:
    return content_digest(text, keep=True)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
