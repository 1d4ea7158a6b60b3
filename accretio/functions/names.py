"""Kinds, observers, globs and addresses: names with parts."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

READINGS = "array<struct<kind:string,key:string>>"


def in_kind(kind: Column, wanted: str) -> Column:
    """The kind itself or one below it, parts being split by dots."""
    return (kind == wanted) | F.startswith(kind, F.lit(wanted + "."))


def observer_matches(one: Column, two: Column) -> Column:
    """Equal, or one has no namespace and equals the other's last part."""
    bare = ~F.contains(one, F.lit("/")) | ~F.contains(two, F.lit("/"))
    return (one == two) | (bare & (F.substring_index(one, "/", -1) == F.substring_index(two, "/", -1)))


def routed(kind: Column, routes: list[tuple[str, str]], known: list[str]) -> Column:
    """The loop for a kind: one of its own name, else the first route whose glob fits, else null."""
    out = F.lit(None).cast("string")
    for pattern, loop in reversed(routes):
        out = F.when(F.rlike(kind, F.lit("^" + fnmatch.translate(pattern).replace(r"\Z", r"\z"))), F.lit(loop)).otherwise(out)
    return F.when(kind.isin(*known), kind).otherwise(out) if known else out


def address(text: Column) -> Column:
    """struct(kind, key): split at the first colon, else the first slash, else a bare key; null if a half is empty."""
    colon, slash = F.instr(text, ":"), F.instr(text, "/")
    at = F.when(colon > 0, colon).when(slash > 0, slash)
    kind = F.coalesce(F.substr(text, F.lit(1), at - 1), F.lit(""))
    key = F.when(at.isNull(), text).otherwise(F.substr(text, at + 1))
    good = F.when(at.isNull(), text != "").otherwise((kind != "") & (key != ""))
    return F.when(good, F.struct(kind.alias("kind"), key.alias("key")))


def readings(text: Column) -> Column:
    """Every meaning of an address: with a colon one; with a slash two (kind/key, and a key
    that holds a slash); bare one."""
    colon, slash = F.instr(text, ":"), F.instr(text, "/")

    def one(kind: Column, key: Column) -> Column:
        return F.struct(kind.alias("kind"), key.alias("key"))

    by_colon = one(F.substr(text, F.lit(1), colon - 1), F.substr(text, colon + 1))
    by_slash = one(F.substr(text, F.lit(1), slash - 1), F.substr(text, slash + 1))
    bare = one(F.lit(""), text)
    found = F.when(colon > 0, F.array(by_colon)).when(slash > 0, F.array(by_slash, bare)).otherwise(F.array(bare))
    halves = F.filter(found, lambda r: (r["key"] != "") & ((r["kind"] != "") | (r["key"] == text)))
    return F.coalesce(halves, F.array().cast(READINGS))


def edge_addresses(value: Column, target: str) -> Column:
    """Addresses of a declared edge field: split at commas; with a colon as written, else under the target kind."""
    parts = F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(F.contains(x, F.lit(":")), x).otherwise(F.concat(F.lit(target + ":"), x)))


def reference_list(value: Column) -> Column:
    """References in a comma list: trimmed, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")))


def is_reference(token: Column) -> Column:
    """kind:key without white space and with a kind."""
    return F.rlike(token, F.lit(r"^[^\s:]+:\S+$"))
