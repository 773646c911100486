"""Records as they come from a broker, decoded into envelopes or refused by the first check that fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import headers, identity, times
from .entities import Entity, json_value, uuid

#: What a refused record is stored as.
KINDS = ("UnexpectedTopic", "MissingPayload", "InvalidPayload", "MissingIdempotencyKey", "InvalidHeader")
#: Columns of a decoded record.
COLUMNS = ("topic", "part", "pos", "record_key", "entity_key", "payload", "message_id", "correlation_id", "causation_id", "idempotency_key", "idempotency_source", "occurred_us", "headers", "traceparent", "tracestate", "failure_kind", "failure_header", "raw_headers", "raw_payload")


def derived_uuid(*of: Column, salt: str) -> Column:
    """An id made from where a record stands, so that reading it again gives the same one."""
    return uuid(F.substring(F.sha2(F.concat_ws("/", F.lit(salt), *of), 256), 1, 32))


def error_text(kind: Column, header: Column) -> Column:
    """What an operator reads about a refused record."""
    said = {"UnexpectedTopic": "the record is on another topic", "MissingPayload": "the record has no payload", "InvalidPayload": "the payload isn't what the entity declares", "MissingIdempotencyKey": "the record has no idempotency key", "MessageIdConflict": "the message id is stored under another key"}
    out = F.when(kind == "InvalidHeader", F.concat(F.lit("header "), F.coalesce(header, F.lit("idempotency-key")), F.lit(" isn't well formed")))
    for k, text in said.items():
        out = out.when(kind == k, text)
    return out


def json_long(payload: Column, field: str) -> Column:
    """A field of a JSON object as a bigint; null where it isn't one."""
    return F.get_json_object(payload, f"$.{field}").try_cast("bigint")


def decode(records: DataFrame, topic: str, prefix: str = headers.PREFIX, entity: Entity | None = None) -> DataFrame:
    """records (topic, partition, offset, key, value, timestamp, headers: what the broker's connector gives) as COLUMNS.

    Checks, in this order: topic, payload there, payload JSON (with an entity: of its type, in sound UTF-8), idempotency key there, its form, then the forms of occurred-at,
    message-id, correlation-id and causation-id where they are there (`failure_header` names the header). An idempotency
    source that isn't JSON is dropped. Missing ids derive from topic, partition and offset, a missing event time is the
    record's own. With an entity the payload comes out as its declared fields, and the entity key is the payload's own.
    """
    # What is costly is computed once a row: nothing that is asked of a generated column moves below its generator, where it would be computed for each mention.
    once = lambda c: F.explode_outer(F.array(c))
    rows = records.withColumn("_h", once(headers.parse(F.col("headers"), prefix))).withColumn("_trace", headers.trace_context(F.col("_h.trace")))
    ours = lambda name: F.try_element_at(F.col("_h.reserved"), F.lit(prefix + name))
    payload = F.make_valid_utf8(F.col("value").cast("string"))
    key, occurred = ours("idempotency-key"), times.parse(ours("occurred-at"))
    bad = lambda name, value: ours(name).isNotNull() & value.isNull()
    if entity is None:
        rows = rows.withColumn("_sound", once(json_value(payload).isNotNull()))
        sound = F.col("_sound")
    else:
        rows = rows.withColumn("_typed", once(entity.judge(payload)))
        sound = F.is_valid_utf8(F.col("value").cast("string")) & F.col("_typed.ok")
    checks = [
        (F.col("topic") != topic, 0, None),
        (F.col("value").isNull(), 1, None),
        (~sound, 2, None),
        (key.isNull(), 3, None),
        (~key.rlike(r"\A[0-9a-fA-F]{64}\z"), 4, "idempotency-key"),
        (bad("occurred-at", occurred), 4, "occurred-at"),
        *((bad(n, uuid(ours(n))), 4, n) for n in ("message-id", "correlation-id", "causation-id")),
    ]
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for test, k, header in reversed(checks):
        kind, name = F.when(test, KINDS[k]).otherwise(kind), F.when(test, F.lit(header).cast("string")).otherwise(name)
    place = [F.col(c).cast("string") for c in ("topic", "partition", "offset")]
    source = ours("idempotency-source")
    whose = identity.entity_key(ours("entity-key"), F.col("key"))
    if entity is not None:
        typed = F.when(F.col("_typed.ok"), F.col("_typed.value"))
        whose, payload = F.coalesce(typed[entity.key].cast("string"), whose), F.coalesce(entity.write(typed), payload)
    return rows.select(
        "topic", F.col("partition").alias("part"), F.col("offset").alias("pos"), F.col("key").alias("record_key"), whose.alias("entity_key"), payload.alias("payload"),
        F.coalesce(uuid(ours("message-id")), derived_uuid(*place, salt="message")).alias("message_id"), F.coalesce(uuid(ours("correlation-id")), derived_uuid(*place, salt="correlation")).alias("correlation_id"),
        uuid(ours("causation-id")).alias("causation_id"), F.lower(key).alias("idempotency_key"), F.when(json_value(source).isNotNull(), source).alias("idempotency_source"),
        F.coalesce(occurred, F.unix_micros("timestamp")).alias("occurred_us"), F.col("_h.user").alias("headers"), F.col("_trace.traceparent").alias("traceparent"), F.col("_trace.tracestate").alias("tracestate"),
        kind.alias("failure_kind"), name.alias("failure_header"), F.col("headers").cast("array<struct<key:string,value:binary>>").alias("raw_headers"), F.col("value").cast("binary").alias("raw_payload"),
    )
