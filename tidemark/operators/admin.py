"""What an operator asks: depth, stuck rows, dead letters, refused records, table access and readiness, over all message types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import outbox, received


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _typed(name: str, side: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(name).alias("message_type"), F.lit(side).alias("side"), *df.columns)


def require(types: list[str], outboxes: dict, receiveds: dict) -> None:
    """Every type needs a ledger on one side at least: an absent queue must not read as an empty one."""
    bad = sorted(t for t in types if t not in outboxes and t not in receiveds)
    if bad:
        raise LookupError(f"no ledger for {', '.join(bad)}")


def depths(outboxes: dict[str, DataFrame], receiveds: dict[str, DataFrame], now: int, max_age: int = 300) -> DataFrame:
    """Depth of every ledger: message_type, side, status, n, oldest_age_s, over_max_age."""
    sides = [_typed(t, "outbox", received.depth(df, now, max_age, outbox.TERMINAL)) for t, df in outboxes.items()]
    return _union(sides + [_typed(t, "received", received.depth(df, now, max_age, ("Processed", "Failed"))) for t, df in receiveds.items()])


def outbox_stuck(ledger: DataFrame, now: int, after: int, limit: int) -> DataFrame:
    """Rows in flight whose lease has been over for longer than `after`."""
    late = ledger.where((F.col("status") == "Publishing") & (F.col("claim_expires_s") < now - after))
    return late.orderBy("claim_expires_s", "created_s", "message_id").limit(limit).withColumn("due_at_s", F.col("claim_expires_s"))


def stuck(outboxes: dict[str, DataFrame], receiveds: dict[str, DataFrame], now: int, after: int = 60, limit: int = 100) -> DataFrame:
    """The longest overdue rows of each ledger; `truncated` says that its page is full."""
    cols = ("message_id", "entity_key", "status", "attempts", "due_at_s")
    pages = [_typed(t, "outbox", outbox_stuck(df, now, after, limit).select(*cols)) for t, df in outboxes.items()]
    rows = _union(pages + [_typed(t, "received", received.stuck(df, now, after, limit).select(*cols)) for t, df in receiveds.items()])
    full = rows.groupBy("message_type", "side").agg((F.count("*") >= limit).alias("truncated"))
    return rows.join(full, ["message_type", "side"])


def dead_letters(receiveds: dict[str, DataFrame], limit: int = 50, **only) -> DataFrame:
    """Dead letters per type: the exact count beside a page of rows with latest_error and error_count (from `errors`, if there)."""

    def page(t, df):
        errors = F.coalesce("errors", F.array().cast("array<string>")) if "errors" in df.columns else F.array().cast("array<string>")
        rows = received.dead_letters(df, limit, **only).select("message_id", "entity_key", "attempts", "last_failed_s", F.try_element_at(errors, F.lit(-1)).alias("latest_error"), F.size(errors).alias("error_count"))
        return _typed(t, "received", rows).crossJoin(received.failed(df, **only).agg(F.count("*").alias("n")))  # one row of count

    return _union([page(t, df) for t, df in receiveds.items()])


def ingest_failures(quarantines: dict[str, DataFrame]) -> DataFrame:
    """Refused records of every registered type, by the topic they were expected on and the kind of failure: n and oldest_s."""
    tally = lambda df: df.groupBy("expected_topic", "failure_kind").agg(F.count("*").alias("n"), F.min("created_s").alias("oldest_s"))
    return _union([tally(df).select(F.lit(t).alias("message_type"), "*") for t, df in quarantines.items()])


def access(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per wanted (schema, table, privileges array): Usable, Denied (a privilege, or the schema's, is lacking), NotATable (a view, say) or Missing.

    catalog: schema, table, kind ('r' or 'p' is a table), granted array, schema_usage boolean. No privileges wanted: presence is enough.
    """
    have = catalog.select("schema", "table", "kind", "granted", "schema_usage")
    each = wanted.join(have, ["schema", "table"], "left").withColumn("p", F.explode_outer("privileges"))
    ok = F.bool_and(F.when(F.col("p").isNull(), True).otherwise(F.array_contains("granted", F.col("p")) & F.col("schema_usage")))
    kind = F.max("kind")
    return each.groupBy("schema", "table").agg(F.when(kind.isNull(), "Missing").when(~kind.isin("r", "p"), "NotATable").when(ok, "Usable").otherwise("Denied").alias("access"))


def readiness(access_rows: DataFrame) -> DataFrame:
    """One row: ready, and the tables that stand against it."""
    return access_rows.agg(F.coalesce(F.bool_and(F.col("access") == "Usable"), F.lit(True)).alias("ready"), F.array_sort(F.collect_list(F.when(F.col("access") != "Usable", F.concat_ws(".", "schema", "table")))).alias("unusable"))
