"""JSON values as folds and predicates see them: type, number, key text, presence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"


def parsed(payload: str | Column) -> Column:
    return F.try_parse_json(payload)


def member(value: Column, path: str) -> Column:
    """The member at a dot path through objects; null if absent."""
    return F.try_variant_get(value, "$" + "".join(f"['{p}']" for p in path.split(".")), "variant")


def is_null(value: Column) -> Column:
    """Absent, or null in the JSON."""
    return value.isNull() | (F.schema_of_variant(value) == "VOID")


def is_number(value: Column) -> Column:
    return F.coalesce(F.rlike(F.schema_of_variant(value), F.lit(_NUMBER)), F.lit(False))


def number(value: Column) -> Column:
    """The number, or null for anything else; a truth value is no number."""
    return F.when(is_number(value), F.try_variant_get(value, "$", "double"))


def is_rejected(value: Column) -> Column:
    """Present, not null, and no number: what numeric folds count as rejected."""
    return ~is_null(value) & ~is_number(value)


def key_text(value: Column, token: Column) -> Column:
    """The text a value has as a fold key. Truth values are capitalised; the JSON's own
    token keeps 0 and 0.0 apart, and lets 0 and "0" meet."""
    return F.when(is_null(value), F.lit(None)).when(F.schema_of_variant(value) == "BOOLEAN", F.initcap(token)).otherwise(token)


def tokens(payload: str | Column) -> Column:
    """Members of a JSON object as text; members that are null are there, with a null."""
    return F.from_json(payload, "map<string,string>")


def rounded(value: Column, digits: int = 1) -> Column:
    """Half to even."""
    return F.bround(value, digits)


def spoken(payload: Column, name: str) -> Column:
    """A member as text to search: a text itself; a list's texts, or the ``text`` of its
    objects, joined by a space; anything else as JSON."""
    one = member(parsed(payload), name)
    kind = F.schema_of_variant(one)
    items = F.transform(F.try_variant_get(one, "$", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.try_variant_get(x, "$", "string")))
    return F.when(is_null(one), F.lit("")).when(F.startswith(kind, F.lit("ARRAY")), F.array_join(F.array_compact(items), " ")).when(kind == "STRING", F.try_variant_get(one, "$", "string")).otherwise(F.to_json(one))


def payload_text(payload: Column) -> Column:
    """All members that aren't empty, joined by a space, by name."""
    entries = F.array_sort(F.map_entries(tokens(payload)))
    return F.array_join(F.filter(F.transform(entries, lambda e: e["value"]), lambda v: v.isNotNull() & (v != "")), " ")
