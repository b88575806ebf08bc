"""Column expressions over parsed JSON: a record is parsed once into a VARIANT, and its fields are read from that.

The functions answer as their namesakes over JSON text in ``scalars`` and ``adapters.common`` do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(json_text: Column | str) -> Column:
    return F.try_parse_json(json_text)


def empty() -> Column:
    """An empty object."""
    return F.parse_json(F.lit("{}"))


def at(v: Column | str, path: str = "$") -> Column:
    """The value at a path; null where it is missing."""
    return F.try_variant_get(v, path, "variant")


def get(v: Column | str, path: str = "$") -> Column:
    """The text of the value at a path: strings unquoted, the rest as JSON; null where it is missing or JSON null."""
    return F.try_variant_get(v, path, "string")


def text_of(v: Column | str) -> Column:
    """The JSON text of a value; JSON null is null."""
    return F.nullif(F.to_json(v), F.lit("null"))


def value_at(v: Column | str, path: str) -> Column:
    """The JSON text of the value at a path: strings quoted; null where it is missing. JSON null is null too."""
    return text_of(at(v, path))


def kind_of(v: Column | str, path: str = "$") -> Column:
    """STRING, BIGINT, DOUBLE, DECIMAL(..), BOOLEAN, OBJECT<..>, ARRAY<..>, VOID or null."""
    return F.schema_of_variant(at(v, path))


def true_text(json_text: Column) -> Column:
    """Python's truth of a JSON value: missing, null, false, 0, "", [] and {} are false."""
    # zeros by their text: a cast that fails costs an exception a row
    return F.coalesce(~json_text.isin("null", "false", '""', "[]", "{}") & ~json_text.rlike(r"^-?0+(\.0*)?([eE][-+]?[0-9]+)?$"), F.lit(False))


def truthy(v: Column | str, path: str = "$") -> Column:
    """Python's truth of the value at a path."""
    return true_text(F.to_json(at(v, path)))


def items(v: Column | str, path: str = "$") -> Column:
    """The items of a list; what is no list has none."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def first_true(v: Column | str, *names: str) -> Column:
    """The first true value among the fields."""
    return F.coalesce(*[F.when(truthy(v, f"$.{n}"), at(v, f"$.{n}")) for n in names])
