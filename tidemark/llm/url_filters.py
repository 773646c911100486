"""URL filters: host-suffix and path-prefix expressions equi-joined with a rule table on short hash prefixes.

Native: DataFrame functions only. A rule is (action, host, path); it fits its host and
every subdomain when the URL's path starts with the rule's path.

Defined cases: a null URL or one without `://` has an empty host and path and fits no
rule; a URL that no rule fits gets `default`; of fitting rules the longest (host plus
path, in characters) wins, then `block` before `allow`, then the text; repeated rows give
repeated results; an empty table gives an empty one; a rule with a null part never fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULE_SCHEMA = "action string, host string, path string"
#: The leading characters of the hexadecimal digest that the join compares.
SHORT = 8
#: Rule tables of at most this many rows are broadcast; larger ones are shuffled.
BROADCAST_RULES = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))
    return host, F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\u0000"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, keep: list[str], url: str = "url", default: str = "allow") -> DataFrame:
    """The columns `keep` of each row of pages, then host, path, rule and verdict."""
    spark = pages.sparkSession
    ready = rules.where("host is not null and path is not null and action is not null").select(
        "action", F.concat("host", "path").alias("rule"), F.length("path").alias("n"), _digest(F.col("host"), F.col("path")).alias("rule_digest")
    )
    # Lengths of rule paths, not rules: as many at most as the longest path has characters.
    size, lengths = ready.count(), [r.n for r in ready.select("n").distinct().orderBy("n").collect()]
    host, path = host_and_path(F.col(url))
    rows = pages.select(
        F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).alias("_keep"), host.alias("_host"), path.alias("_path")
    )
    labels = F.split("_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.transform(F.lit(lengths).cast("array<int>"), lambda n: F.when(F.length("_path") >= n, F.substring(F.col("_path"), F.lit(1), n))), lambda p: p.isNotNull())
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    one = rows.withColumn("_digest", F.explode_outer(F.when(F.col("_host") != "", expressions)))
    ready = ready.withColumn("_short", F.substring("rule_digest", 1, SHORT))
    if size <= BROADCAST_RULES:
        ready = F.broadcast(ready)
    hit = one.withColumn("_short", F.substring("_digest", 1, SHORT)).join(ready, "_short", "left")
    best = F.when(F.col("rule_digest") == F.col("_digest"), F.struct(F.length("rule").alias("n"), F.when(F.col("action") == "block", 1).otherwise(0).alias("b"), F.col("rule"), F.col("action")))
    out = hit.groupBy("_row").agg(F.first("_keep").alias("_keep"), F.first("_host").alias("_host"), F.first("_path").alias("_path"), F.max(best).alias("_best"))
    return out.select(
        *[F.col(f"_keep.k{i}").alias(c) for i, c in enumerate(keep)],
        F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best.rule").alias("rule"), F.coalesce("_best.action", F.lit(default)).alias("verdict"),
    )
