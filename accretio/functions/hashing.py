"""Row hashes over canonical JSON, and ULIDs that depend on the row alone."""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the 32 digits of Crockford's base 32, in order.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def canonical_number(x: int | float) -> str:
    """A number as RFC 8785 writes it: the shortest text that reads back, in ECMAScript's form."""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int):
        return str(x)
    if not math.isfinite(x):
        raise ValueError("no JSON number")
    if x == 0:
        return "0"
    sign, text = ("-" if x < 0 else ""), repr(abs(x))
    digits, _, power = text.partition("e")
    whole, _, part = digits.partition(".")
    point = len(whole) + int(power or 0)
    all_digits = (whole + part).lstrip("0")
    point -= len(whole + part) - len((whole + part).lstrip("0"))
    all_digits = all_digits.rstrip("0")
    n = len(all_digits)
    if n <= point <= 21:
        return sign + all_digits + "0" * (point - n)
    if 0 < point <= 21:
        return sign + all_digits[:point] + "." + all_digits[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + all_digits
    exponent = point - 1
    return f"{sign}{all_digits[0]}{'.' + all_digits[1:] if n > 1 else ''}e{'+' if exponent > 0 else '-'}{abs(exponent)}"


def canonical(value) -> str:
    """RFC 8785: members by UTF-16 code units, no white space, numbers as above."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(v)}" for k, v in sorted(value.items(), key=lambda x: x[0].encode("utf-16-be"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, int | float):
        return canonical_number(value)
    return json.dumps(value, ensure_ascii=False)


def _canonical(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else canonical(json.loads(t)) for t in texts.to_pylist()], pa.string())


def canonical_json(text: Column) -> Column:
    """JSON text in canonical form; null for null."""
    return F.arrow_udf(_canonical, "string")(text)


def row_hash(*columns: Column) -> Column:
    """SHA-256 over the canonical JSON of an array of texts; null is null in it."""
    parts = [F.coalesce(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c.cast("string"), r"\\", r"\\\\\\\\"), '"', r'\\\\"'), F.lit('"')), F.lit("null")) for c in columns]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)


def ulid(ts: Column, seed: Column) -> Column:
    """26 digits: 48 bits of milliseconds, then the first 80 bits of the seed's SHA-256."""
    hex_ = F.concat(F.lpad(F.lower(F.hex((ts * 1000).cast("long"))), 12, "0"), F.substring(F.sha2(seed, 256), 1, 20))
    # 128 bits are 26 digits of 5 bits with 2 bits of 0 in front
    bits = F.concat(F.lit("00"), *[F.lpad(F.conv(F.substring(hex_, 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(4)])
    digits = [F.substring(F.lit(CROCKFORD), F.conv(F.substring(bits, 1 + 5 * i, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(26)]
    return F.concat(*digits)
