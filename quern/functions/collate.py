"""The total order of JSON values: null, booleans, numbers, strings, arrays, objects.

Arrays compare element by element and objects member by member (members sorted by name), a prefix before what it begins.
Strings compare by their UTF-8 bytes, which for characters outside the basic plane differs from UTF-16 order. Numbers
that aren't finite count as null. A key is one binary string whose byte order is that order, and it can be decoded.

Typed columns need no key: Spark orders them the same way. Scalars in a VARIANT are ordered by a struct of built-in
expressions (scalar_key); arrays and objects in a VARIANT need the binary key, from an Arrow UDF (binary_key).
"""

from __future__ import annotations

import json
import math
import struct
from datetime import date, datetime, timezone
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL, BOOLEAN, NUMBER, STRING, ARRAY, OBJECT = range(1, 7)
TYPE_NAMES = {"null": NULL, "boolean": BOOLEAN, "number": NUMBER, "string": STRING, "array": ARRAY, "object": OBJECT}


def normalize(value: Any) -> Any:
    """The JSON value that stands for value as a key: dates as ISO strings, numbers that aren't finite as null."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, datetime):
        value = value.astimezone(timezone.utc) if value.tzinfo else value
        return value.strftime("%Y-%m-%dT%H:%M:%S.") + f"{value.microsecond // 1000:03d}Z"
    if isinstance(value, date):
        return value.strftime("%Y-%m-%dT00:00:00.000Z")
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (list, tuple)):
        return [normalize(x) for x in value]
    if isinstance(value, dict):
        return {str(k): normalize(v) for k, v in value.items()}
    return value


def rank(value: Any) -> int:
    value = normalize(value)
    for kind, types in ((BOOLEAN, bool), (NUMBER, (int, float)), (STRING, str), (ARRAY, list), (OBJECT, dict)):
        if isinstance(value, types):
            return kind
    return NULL


def encode(value: Any) -> bytes:
    """The key of a JSON value."""
    value = normalize(value)
    kind = rank(value)
    head = bytes([kind])
    if kind == BOOLEAN:
        return head + bytes([1 + value])
    if kind == NUMBER:
        bits = struct.unpack(">Q", struct.pack(">d", float(value) + 0.0))[0]
        return head + struct.pack(">Q", bits ^ (0xFFFFFFFFFFFFFFFF if bits >> 63 else 1 << 63))
    if kind == STRING:
        return head + value.encode("utf-8", "surrogatepass").replace(b"\1", b"\1\2").replace(b"\0", b"\1\1") + b"\0"
    if kind == ARRAY:
        return head + b"".join(map(encode, value)) + b"\0"
    if kind == OBJECT:
        return head + b"".join(encode(k) + encode(v) for k, v in sorted(value.items())) + b"\0"
    return head


def decode(key: bytes) -> Any:
    """The value whose key this is."""
    value, end = _decode(key, 0)
    if end != len(key):
        raise ValueError("more than one key")
    return value


def _decode(key: bytes, at: int) -> tuple[Any, int]:
    kind, at = key[at], at + 1
    if kind == BOOLEAN:
        return key[at] == 2, at + 1
    if kind == NUMBER:
        bits = struct.unpack_from(">Q", key, at)[0]
        number = struct.unpack(">d", struct.pack(">Q", bits ^ (1 << 63 if bits >> 63 else 0xFFFFFFFFFFFFFFFF)))[0]
        return (int(number) if number.is_integer() and abs(number) < 2**53 else number), at + 8
    if kind == STRING:
        end = key.index(b"\0", at)
        return key[at:end].replace(b"\1\1", b"\0").replace(b"\1\2", b"\1").decode("utf-8", "surrogatepass"), end + 1
    if kind in (ARRAY, OBJECT):
        parts = []
        while key[at]:
            part, at = _decode(key, at)
            parts.append(part)
        return (parts if kind == ARRAY else dict(zip(parts[::2], parts[1::2], strict=True))), at + 1
    return None, at


def compare(a: Any, b: Any) -> int:
    """-1, 0 or 1 as a comes before, with or after b."""
    x, y = encode(a), encode(b)
    return (x > y) - (x < y)


@F.pandas_udf(T.BinaryType())
def _binary_key(values: pd.Series) -> pd.Series:
    return values.map(lambda x: encode(json.loads(x)) if x is not None else None)


def binary_key(variant: Column) -> Column:
    """The key of any VARIANT; null where the value is missing."""
    return _binary_key(F.to_json(variant))


def variant_rank(v: Column) -> Column:
    """The rank of a VARIANT's type; null where the value is missing."""
    kind = F.schema_of_variant(v)
    number = kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)")
    return (
        F.when(v.isNull(), F.lit(None)).when(F.is_variant_null(v), NULL).when(kind == "BOOLEAN", BOOLEAN).when(number, NUMBER).when(kind.startswith("ARRAY"), ARRAY).when(kind.startswith("OBJECT"), OBJECT).otherwise(STRING)
    )


def scalar_key(v: Column) -> Column:
    """An orderable and groupable key of a VARIANT that holds a scalar, from built-in expressions."""
    r = variant_rank(v)
    number = F.when(r == BOOLEAN, F.try_variant_get(v, "$", "boolean").cast("double")).when(r == NUMBER, F.try_variant_get(v, "$", "double"))
    return F.struct(r.alias("rank"), number.alias("number"), F.when(r == STRING, F.try_variant_get(v, "$", "string")).alias("string"))
