"""Republishing from current state: pages of keys, what is loaded for them, and the messages to enqueue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .outbox import enqueue, numbered


def check_page(page: list, cursor, size: int) -> None:
    """Keys of a page that someone else gives must be within the size, after the cursor and strictly increasing."""
    if len(page) > size or any(a >= b for a, b in zip(page, page[1:], strict=False)) or (page and cursor is not None and page[0] <= cursor):
        raise ValueError("keys must be strictly increasing, after the cursor, and within the batch size")


def loaded(keys: DataFrame, states: DataFrame, cursor=None) -> DataFrame:
    """Every key after the cursor with what the loader has for it: outcome Enqueue, Skip (no state) or KeyMismatch (the state names another entity).

    keys: entity_key, unique. states: entity_key (what it was loaded for), payload_key (whose it is), payload.
    """
    todo = keys if cursor is None else keys.where(F.col("entity_key") > cursor)
    have = states.select("entity_key", "payload_key", "payload", F.lit(True).alias("_have"))
    out = F.when(F.col("_have").isNull(), "Skip").when(F.col("payload_key").eqNullSafe(F.col("entity_key")), "Enqueue").otherwise("KeyMismatch")
    return todo.join(have, "entity_key", "left").withColumn("outcome", out).drop("_have")


def progress(rows: DataFrame, size: int) -> DataFrame:
    """Per page of `size` keys in order: enqueued, skipped, last_key; a mismatch shows as `mismatched`, and a run stops before it (`before_mismatch`)."""
    keyed = rows.select("entity_key", "outcome")
    # Text has no quantiles: its leading characters give the ranges, the text itself the order.
    lead = F.conv(F.hex(F.substring(F.rpad(F.encode("entity_key", "utf-8"), 6, F.unhex(F.lit("00"))), 1, 6)), 16, 10).cast("double")
    placed = numbered(keyed.withColumn("_lead", lead), "_lead", "entity_key", name="_n")
    tally = lambda o: F.count_if(F.col("outcome") == o)
    page = F.floor((F.col("_n") - 1) / size).cast("long").alias("page")
    return placed.groupBy(page).agg(tally("Enqueue").alias("enqueued"), tally("Skip").alias("skipped"), tally("KeyMismatch").alias("mismatched"), F.max("entity_key").alias("last_key"))


def before_mismatch(rows: DataFrame) -> tuple[DataFrame, str | None]:
    """The rows before the first mismatch in order of keys (those are committed one by one, so they stand), and the key it is at; all rows and None where there is none."""
    stop = rows.where("outcome = 'KeyMismatch'").agg(F.min("entity_key")).first()[0]
    return (rows if stop is None else rows.where(F.col("entity_key") < stop)), stop


def summary(rows: DataFrame, cursor: str | None = None) -> DataFrame:
    """One row: enqueued, skipped, last_key (the cursor where there was nothing to do)."""
    return rows.agg(F.count_if(F.col("outcome") == "Enqueue").alias("enqueued"), F.count_if(F.col("outcome") == "Skip").alias("skipped"), F.coalesce(F.max("entity_key"), F.lit(cursor)).alias("last_key"))


def republish(ledger: DataFrame, keys: DataFrame, states: DataFrame, now: int, cursor: str | None = None) -> DataFrame:
    """The send ledger with the current state of every key enqueued; states carry idempotency_key, headers, partition_key and message_id too.

    Raises if a state names another entity than it was loaded for.
    """
    rows = loaded(keys, states, cursor)
    if not rows.where("outcome = 'KeyMismatch'").isEmpty():
        raise ValueError("a loaded state names another entity")
    facts = states.select("entity_key", "message_id", "partition_key", "idempotency_key", "headers")
    sent = rows.where("outcome = 'Enqueue'").select("entity_key").join(facts, "entity_key").withColumn("seq", F.xxhash64("entity_key"))
    return enqueue(ledger, sent, now)
