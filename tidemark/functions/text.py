"""Bounded texts, durations, topic names and cleanup policies as column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of a duration in milliseconds.
UNITS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def bounded_text(text: Column, most: int = 512) -> Column:
    """The text, or its longest prefix of whole characters within `most` bytes and three dots."""
    raw = F.encode(text, "utf-8")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, most - back).cast("string")) for back in range(min(4, most))]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.coalesce(*cuts, F.lit("")), F.lit("...")))


def duration_ms(text: Column) -> Column:
    """Milliseconds of `250ms`, `30s`, `5m`, `1h`, `7d`; null for anything else or beyond a bigint. Zero is a duration."""
    form = r"\A\s*([0-9]+)(ms|s|m|h|d)\s*\z"
    unit = F.regexp_extract(text, form, 2)
    factor = reduce(lambda out, u: F.when(unit == u, F.lit(UNITS[u])).otherwise(out), UNITS, F.lit(None).cast("int")).cast("bigint")
    return F.when(text.rlike(form), F.try_multiply(F.regexp_extract(text, form, 1).try_cast("bigint"), factor))


def prefix_ok(prefix: Column) -> Column:
    """Empty, or [a-z0-9][a-z0-9.-]* that ends in a dot or hyphen."""
    return (prefix == "") | prefix.rlike(r"\A[a-z0-9][a-z0-9.-]*[.-]\z") & prefix.rlike(r"\A[a-z0-9]")


def with_prefix(prefix: str, topic: Column) -> Column:
    return F.concat(F.lit(prefix), topic)


def cleanup_policy(raw: Column) -> Column:
    """Compact, Delete, CompactAndDelete, or Unrecognized (also for an empty list), whatever the order and case."""
    parts = F.filter(F.transform(F.split(raw, ","), lambda p: F.lower(F.trim(p))), lambda p: p != "")
    both = F.array_sort(F.array_distinct(parts))
    name = lambda *p: both == F.array(*map(F.lit, p))
    return F.when(F.size(both) == 0, "Unrecognized").when(name("compact"), "Compact").when(name("delete"), "Delete").when(name("compact", "delete"), "CompactAndDelete").otherwise("Unrecognized")
