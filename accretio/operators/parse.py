"""The parse pipeline: text to lists to records, as column expressions.

A record is a column ``rec``; a step that can't go on makes the record null, and
null records are dropped by the step itself. Lists are array<string>, records
map<string,string>; nested JSON enters through ``explode`` and ``project``.
"""

from __future__ import annotations

from dataclasses import dataclass, field as default

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Skip:
    """Drop records whose text starts with, contains or equals something; a missing field stays."""

    startswith: str | None = None
    contains: str | None = None
    equals: str | None = None
    field: str | None = None


@dataclass(frozen=True)
class Split:
    delim: str | None = None
    max: int | None = None


@dataclass(frozen=True)
class Pick:
    indices: tuple[int, ...]
    names: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rename:
    names: dict[int, str] = default(default_factory=dict)


@dataclass(frozen=True)
class Transform:
    field: str
    strip: str | None = None
    lstrip: str | None = None
    rstrip: str | None = None
    replace: tuple[str, str] | None = None


@dataclass(frozen=True)
class Coerce:
    types: dict[str, str] = default(default_factory=dict)


@dataclass(frozen=True)
class Select:
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Explode:
    path: str
    carry: tuple[str, ...] = ()


@dataclass(frozen=True)
class Project:
    paths: dict[str, str] = default(default_factory=dict)


@dataclass(frozen=True)
class Where:
    path: str
    op: str
    value: str | None = None
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Flatten:
    field: str
    into: str
    extract: tuple[str, ...]


Step = Skip | Split | Pick | Rename | Transform | Coerce | Select | Explode | Project | Where | Flatten
_WHITE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def _kind(rows: DataFrame) -> str:
    return dict(rows.dtypes)["rec"]


def _path(text: Column, path: str) -> Column:
    """A member of JSON text by dot path through objects, as text; null if absent or null."""
    return F.get_json_object(text, "$" + "".join(f"['{p}']" for p in path.split(".")))


def _shown(value: Column) -> Column:
    """A value as the where step compares it: absent is None, truth values are capitalised."""
    return F.coalesce(value, F.lit("None"))


def skip(rows: DataFrame, s: Skip) -> DataFrame:
    is_record = _kind(rows).startswith("map")
    if s.field and not is_record:
        return rows.where(F.lit(False))
    text = F.element_at("rec", s.field) if s.field else F.col("rec").cast("string")
    drop = F.lit(False)
    for given, test in ((s.startswith, F.startswith), (s.contains, F.contains)):
        if given is not None:
            drop = drop | test(text, F.lit(given))
    if s.equals is not None:
        drop = drop | (text == s.equals)
    return rows.where(~F.coalesce(drop, F.lit(False)))


def split(rows: DataFrame, s: Split) -> DataFrame:
    if s.delim is None:
        trimmed = F.regexp_replace("rec", rf"^{_WHITE}|{_WHITE}$", "")
        parts = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _WHITE))
    else:
        parts = F.split("rec", "\\Q" + s.delim.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1 if s.max is None else s.max + 1)
    return rows.withColumn("rec", parts).where(F.col("rec").isNotNull())


def _at(index: int) -> Column:
    return F.get("rec", F.lit(index) if index >= 0 else F.size("rec") + index)


def _inside(indices: list[int]) -> Column:
    out = F.col("rec").isNotNull()
    for i in indices:
        out = out & (F.size("rec") >= (i + 1 if i >= 0 else -i))
    return out


def pick(rows: DataFrame, s: Pick) -> DataFrame:
    good = rows.where(_inside(list(s.indices)))
    if s.names:
        pairs = [x for i, name in zip(s.indices, s.names) for x in (F.lit(name), _at(i))]
        return good.withColumn("rec", F.create_map(*pairs))
    return good.withColumn("rec", F.array(*[_at(i) for i in s.indices]))


def rename(rows: DataFrame, s: Rename) -> DataFrame:
    pairs = [x for i, name in s.names.items() for x in (F.lit(name), _at(i))]
    return rows.where(_inside(list(s.names))).withColumn("rec", F.create_map(*pairs))


def _put(record: Column, name: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(record, lambda k, _: k != name), F.create_map(F.lit(name), value))


def transform(rows: DataFrame, s: Transform) -> DataFrame:
    value = F.element_at("rec", s.field)
    for chars, trim in ((s.strip, F.btrim), (s.lstrip, F.ltrim), (s.rstrip, F.rtrim)):
        if chars is not None:
            value = trim(value, F.lit(chars))
    if s.replace is not None:
        value = F.replace(value, F.lit(s.replace[0]), F.lit(s.replace[1]))
    return rows.where(F.element_at("rec", s.field).isNotNull()).withColumn("rec", _put(F.col("rec"), s.field, value))


def coerced(value: Column, kind: str) -> Column:
    """Text as int, float, bool or str, in one form of writing; null if it can't be."""
    if kind == "int":
        return value.try_cast("bigint").cast("string")
    if kind == "float":
        return value.try_cast("double").cast("string")
    if kind == "bool":
        low = F.lower(value)
        return F.when(low.isin("true", "1", "yes"), F.lit("True")).when(low.isin("false", "0", "no"), F.lit("False"))
    return value


def coerce(rows: DataFrame, s: Coerce) -> DataFrame:
    """Fields must be there and take the type. Text is kept; ``typed`` reads it as columns."""
    for name, kind in s.types.items():
        rows = rows.withColumn("__v", coerced(F.element_at("rec", name), kind)).where(F.col("__v").isNotNull())
        rows = rows.withColumn("rec", _put(F.col("rec"), name, F.col("__v"))).drop("__v")
    return rows


def typed(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """Fields of the records as columns of their types."""
    names = {"int": "bigint", "float": "double", "bool": "boolean", "str": "string"}
    return rows.select("*", *[F.element_at("rec", n).try_cast(names[k]).alias(n) for n, k in types.items()])


def select(rows: DataFrame, s: Select) -> DataFrame:
    return rows.withColumn("rec", F.map_filter("rec", lambda k, _: k.isin(*s.fields))).where(F.size("rec") > 0)


def explode(rows: DataFrame, s: Explode, first_only: bool = False) -> DataFrame:
    """``rec`` is JSON text. A list at the path gives a record for each element, scalars as
    {"_value": x}; anything else passes; fields to carry are copied when not null."""
    at = F.try_variant_get(F.try_parse_json("rec"), "$" + "".join(f"['{p}']" for p in s.path.split(".")), "variant")
    is_list = F.startswith(F.schema_of_variant(at), F.lit("ARRAY"))
    elements = F.transform(F.try_variant_get(at, "$", "array<variant>"), lambda x: F.to_json(x))
    items = F.when(F.coalesce(is_list, F.lit(False)), elements).otherwise(F.array(F.col("rec")))
    if first_only:
        items = F.slice(items, 1, 1)
    out = rows.withColumn("__is_list", F.coalesce(is_list, F.lit(False))).withColumn("__parent", F.col("rec")).withColumn("rec", F.explode(items))
    object_ = F.startswith(F.col("rec"), F.lit("{"))
    rec = F.when(~F.col("__is_list") | object_, F.col("rec")).otherwise(F.concat(F.lit('{"_value":'), F.col("rec"), F.lit("}")))
    for name in s.carry:
        carried = F.to_json(F.try_variant_get(F.try_parse_json("__parent"), f"$['{name}']", "variant"))
        bare = F.expr("substring(rec, 1, length(rec) - 1)")
        more = F.concat(bare, F.when(F.col("rec") == "{}", F.lit("")).otherwise(F.lit(",")), F.lit(f'"{name}":'), carried, F.lit("}"))
        rec_now = rec
        out = out.withColumn("rec", rec_now)
        rec = F.when(F.col("__is_list") & carried.isNotNull() & (carried != "null"), more).otherwise(F.col("rec"))
    return out.withColumn("rec", rec).drop("__is_list", "__parent")


def project(rows: DataFrame, s: Project) -> DataFrame:
    """``rec`` is JSON text; the record has exactly these fields, null where the path leads nowhere."""
    pairs = [x for name, path in s.paths.items() for x in (F.lit(name), _path(F.col("rec"), path))]
    return rows.withColumn("rec", F.create_map(*pairs))


def where(rows: DataFrame, s: Where) -> DataFrame:
    value = _path(F.col("rec"), s.path) if _kind(rows) == "string" else F.element_at("rec", s.path)
    shown = _shown(value)
    tests = {
        "equals": shown == s.value,
        "not_equals": shown != s.value,
        "in_": shown.isin(*s.values),
        "not_in": ~shown.isin(*s.values),
        "exists": value.isNotNull(),
    }
    return rows.where(tests.get(s.op, F.lit(False)))


def flatten(rows: DataFrame, s: Flatten) -> DataFrame:
    """``rec`` is JSON text; a list of objects becomes lines of text, with names if several are taken."""
    items = F.transform(
        F.try_variant_get(F.try_parse_json("rec"), "$" + "".join(f"['{p}']" for p in s.field.split(".")), "array<variant>"), lambda x: F.to_json(x)
    )

    def line(item: Column) -> Column:
        parts = [_path(item, e) if len(s.extract) == 1 else F.concat(F.lit(f"{e}: "), _path(item, e)) for e in s.extract]
        return F.filter(F.array(*parts), lambda p: p.isNotNull())

    text = F.array_join(F.flatten(F.transform(items, line)), "\n")
    return rows.withColumn(s.into, F.coalesce(text, F.lit("")))


_STEPS = {Skip: skip, Split: split, Pick: pick, Rename: rename, Transform: transform, Coerce: coerce, Select: select, Explode: explode, Project: project, Where: where, Flatten: flatten}


def run(rows: DataFrame, steps: list[Step], many: bool = True) -> DataFrame:
    """The steps in order over the column ``rec``. ``many`` False keeps the first of what an explode gives."""
    for s in steps:
        rows = explode(rows, s, not many) if isinstance(s, Explode) else _STEPS[type(s)](rows, s)
    return rows


def has_explode(steps: list[Step]) -> bool:
    return any(isinstance(s, Explode) for s in steps)


def check_flow(steps: list[Step], start: str = "text") -> list[str]:
    """What is wrong with the order of steps: each takes text, a list or a record."""
    takes = {Split: ("text", "list"), Pick: ("list", None), Rename: ("list", "record"), Transform: ("record", "record"), Coerce: ("record", "record"), Select: ("record", "record")}
    now, wrong = start, []
    for n, s in enumerate(steps):
        if type(s) not in takes:
            now = "record" if isinstance(s, Project) else now
            continue
        need, gives = takes[type(s)]
        if now != need:
            wrong.append(f"step {n} ({type(s).__name__.lower()}) takes a {need}, and gets a {now}")
        now = gives or ("record" if s.names else "list")
    return wrong
