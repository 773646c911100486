"""Column functions: identities, headers, keys, samplers, buckets."""

from __future__ import annotations

import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(text: Column) -> Column:
    """Keys sorted, no white space; for values that are strings, integers, booleans and null."""
    return F.to_json(F.parse_json(text))


def canonical_json_exact(text: Column) -> Column:
    """`canonical_json` for texts with fractions or exponents: 1.0 stays 1.0 and 1.10 becomes 1.1. A Python function over Arrow batches."""
    def number(x: float) -> str:
        plain = format(Decimal(repr(x)), "f") if 1e-5 <= abs(x) < 1e16 else repr(x)
        return re.sub(r"e([+-])0*", lambda m: "e" + m[1].strip("+"), plain)

    def write(x) -> str:
        if isinstance(x, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{write(x[k])}" for k in sorted(x)) + "}"
        if isinstance(x, list):
            return "[" + ",".join(map(write, x)) + "]"
        return number(x) if isinstance(x, float) else json.dumps(x, ensure_ascii=False)

    def every(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else write(json.loads(t)))

    return F.pandas_udf(every, "string")(text)


def idempotency_key(namespace: str, canonical: Column) -> Column:
    return F.sha2(F.concat(F.encode(F.lit(namespace), "utf-8"), F.unhex(F.lit("00")), F.encode(canonical, "utf-8")), 256)


def fnv1a64(data: Column) -> Column:
    """64-bit FNV-1a of a string's UTF-8 bytes, as signed bigint (exact in decimals, as ANSI bigints overflow)."""
    wrap, prime = F.lit("18446744073709551616").cast("decimal(38,0)"), 1099511628211
    low32 = F.lit(4294967296).cast("decimal(38,0)")
    byte = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.substring(F.hex(F.encode(data, "utf-8")), i * 2 - 1, F.lit(2)), 16, 10).cast("bigint"))

    def step(h, b):
        low = (h % 256).cast("bigint")
        mixed = h - low + low.bitwiseXOR(b)
        hi, lo = F.floor(mixed / low32).cast("decimal(38,0)"), mixed % low32
        # (hi * 2^32 + lo) * prime modulo 2^64, in parts that stay within 38 digits.
        return ((((hi * F.lit(prime).cast("decimal(20,0)")) % low32) * low32 + lo * F.lit(prime).cast("decimal(20,0)")) % wrap).cast("decimal(38,0)")

    h = F.aggregate(F.when(F.octet_length(data) > 0, byte).otherwise(F.array().cast("array<bigint>")), F.lit("14695981039346656037").cast("decimal(38,0)"), step)
    half = F.lit("9223372036854775808").cast("decimal(38,0)")
    return F.when(h >= half, h - wrap).otherwise(h).cast("bigint")


def reserved(headers: Column, prefix: str = "tidemark-") -> Column:
    """Whether a header map has a name in the reserved space, in whatever case."""
    return F.exists(F.map_keys(headers), lambda k: F.lower(k).startswith(prefix))


def first_wins(headers: Column) -> Column:
    """array<struct<key,value>> to one value per lower-case name: the first; null values don't count."""
    some = F.transform(F.filter(headers, lambda h: h["value"].isNotNull()), lambda h: F.struct(F.lower(h["key"]).alias("key"), h["value"].alias("value")))
    return F.map_from_entries(F.filter(some, lambda h, i: ~F.exists(F.slice(some, F.lit(1), i), lambda g: g["key"] == h["key"])))


def last_wins(headers: Column) -> Column:
    some = F.reverse(F.filter(headers, lambda h: h["value"].isNotNull()))
    return F.map_from_entries(F.filter(some, lambda h, i: ~F.exists(F.slice(some, F.lit(1), i), lambda g: g["key"] == h["key"])))


def entity_key(column: Column, record_key: Column) -> Column:
    return F.coalesce(column, F.try_validate_utf8(record_key.cast("string")))


def sampled(n: Column, rate_millionths: int) -> Column:
    """Whether the n-th success (from 1) is emitted, so that floor(n * rate) are emitted after n."""
    owed = lambda k: F.floor(k * rate_millionths / 1_000_000)
    return owed(n) > owed(n - 1)


def correlation_ok(value: Column) -> Column:
    return value.rlike(r"^[!-~]{1,128}$")


def bucket(value: Column, ends: list[float]) -> Column:
    """The first bucket end that is not below the value; infinity beyond the last."""
    out = F.lit("inf")
    for e in reversed(ends):
        out = F.when(value <= e, F.lit(str(e))).otherwise(out)
    return out
