"""Ledger-shaped views derived from the provided tables. Times are epoch seconds, so no result depends on a time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The clock that every query is given: 2024-01-31 00:00:00.
NOW = 1706659200


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column | str) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz") if isinstance(ts, str) else ts)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log: topic, part, pos (offset), entity_key, payload, event_s."""
    return read(spark, sf_dir, "events").select(
        F.lit("events").alias("topic"), (F.col("user_id") % 4).cast("int").alias("part"), F.col("event_id").alias("pos"), F.col("user_id").cast("string").alias("entity_key"), F.col("props").alias("payload"), seconds("ts").alias("event_s")
    )


def received(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The receive ledger: message_id, entity_key, status, attempts, created_s, due_s, last_failed_s, kind."""
    kind = F.element_at(F.array(*map(F.lit, ("handler", "decode", "conflict", "contention"))), (F.col("event_id") % 4 + 1).cast("int"))
    status = F.when(F.col("event_type").isin("view", "click"), "Pending").when(F.col("event_type") == "signup", "Retryable").when(F.col("event_type") == "purchase", "Processed").otherwise("Failed")
    out = read(spark, sf_dir, "events").select(F.col("event_id").alias("message_id"), F.col("user_id").cast("string").alias("entity_key"), status.alias("status"), (F.col("event_id") % 5).cast("int").alias("attempts"), seconds("ts").alias("created_s"), kind.alias("k"))
    bad = F.col("status").isin("Failed", "Retryable")
    return out.select(
        "message_id", "entity_key", "status", "attempts", "created_s", F.when(F.col("status") == "Retryable", F.col("created_s") + 30).alias("due_s"),
        F.when(bad, F.col("created_s") + F.col("message_id") % 60).alias("last_failed_s"), F.when(bad, F.col("k")).alias("kind"),
    )


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The send ledger: message_id, entity_key, enqueue_order, status, attempts, created_s, next_attempt_s, claim_expires_s."""
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "Pending").when((F.col("o_orderstatus") == "F") & (key % 97 == 0), "Publishing").otherwise("Published")
    out = read(spark, sf_dir, "orders").select(key.alias("message_id"), F.col("o_custkey").cast("string").alias("entity_key"), key.alias("enqueue_order"), status.alias("status"), seconds("o_orderdate").alias("created_s"))
    return out.select(
        "message_id", "entity_key", "enqueue_order", "status", F.when(F.col("status") == "Publishing", 1).otherwise(0).alias("attempts"), "created_s",
        F.when((F.col("status") == "Pending") & (F.col("message_id") % 5 == 0), F.lit(NOW) + 60).alias("next_attempt_s"),
        F.when(F.col("status") == "Publishing", F.lit(NOW) + F.when(F.col("message_id") % 2 == 0, -300).otherwise(300)).cast("long").alias("claim_expires_s"),
    )


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("MissingPayload", "MissingIdempotencyKey", "InvalidPayload", "InvalidHeader", "UnexpectedTopic", "MessageIdConflict")))
    return read(spark, sf_dir, "events").where("event_id % 13 = 0").select(
        F.col("event_type").alias("message_type"), F.lit("events").alias("expected_topic"), F.element_at(kinds, (F.col("event_id") % 6 + 1).cast("int")).alias("failure_kind"), seconds("ts").alias("created_s")
    )


#: The same views for the oracle, as common table expressions.
_S = "date_diff('second', TIMESTAMP '1970-01-01 00:00:00', CAST({} AS TIMESTAMP))"
CTE = {
    "log": f"log AS (SELECT 'events' AS topic, CAST(user_id % 4 AS INTEGER) AS part, event_id AS pos, CAST(user_id AS VARCHAR) AS entity_key, props AS payload, {_S.format('ts')} AS event_s FROM events)",
    "received": f"""r0 AS (SELECT event_id AS message_id, CAST(user_id AS VARCHAR) AS entity_key, CASE WHEN event_type IN ('view','click') THEN 'Pending' WHEN event_type='signup' THEN 'Retryable' WHEN event_type='purchase' THEN 'Processed' ELSE 'Failed' END AS status,
 CAST(event_id % 5 AS INTEGER) AS attempts, {_S.format('ts')} AS created_s, list_element(['handler','decode','conflict','contention'], event_id % 4 + 1) AS k FROM events),
received AS (SELECT message_id, entity_key, status, attempts, created_s, CASE WHEN status='Retryable' THEN created_s + 30 END AS due_s, CASE WHEN status IN ('Failed','Retryable') THEN created_s + message_id % 60 END AS last_failed_s, CASE WHEN status IN ('Failed','Retryable') THEN k END AS kind FROM r0)""",
    "outbox": f"""o0 AS (SELECT o_orderkey AS message_id, CAST(o_custkey AS VARCHAR) AS entity_key, o_orderkey AS enqueue_order, CASE WHEN o_orderstatus='O' THEN 'Pending' WHEN o_orderstatus='F' AND o_orderkey % 97 = 0 THEN 'Publishing' ELSE 'Published' END AS status, {_S.format('o_orderdate')} AS created_s FROM orders),
outbox AS (SELECT *, CASE WHEN status='Publishing' THEN 1 ELSE 0 END AS attempts, CASE WHEN status='Pending' AND message_id % 5 = 0 THEN {NOW} + 60 END AS next_attempt_s, CASE WHEN status='Publishing' THEN {NOW} + CASE WHEN message_id % 2 = 0 THEN -300 ELSE 300 END END AS claim_expires_s FROM o0)""",
    "quarantine": f"quarantine AS (SELECT event_type AS message_type, 'events' AS expected_topic, list_element(['MissingPayload','MissingIdempotencyKey','InvalidPayload','InvalidHeader','UnexpectedTopic','MessageIdConflict'], event_id % 6 + 1) AS failure_kind, {_S.format('ts')} AS created_s FROM events WHERE event_id % 13 = 0)",
}
