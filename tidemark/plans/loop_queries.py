"""Queries of the loops: decoding, relay outcomes, dispatch of due rows, streams, recovery, quarantine, counters; with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import envelope, identity, text, times
from ..functions.headers import outgoing
from ..operators import admin, cache, dispatch, orders, outbox, received, recovery, telemetry
from ..sources import tables as src
from ..sources.scratch import folder
from ..sources.sinks import wire
from . import roles
from .queries import NOW, query

# Records in


_UUID = "lower(substr({0},1,8)||'-'||substr({0},9,4)||'-'||substr({0},13,4)||'-'||substr({0},17,4)||'-'||substr({0},21,12))"


def _headers(*pairs):
    return F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.encode(v, "utf-8").alias("value")) for k, v in pairs]), lambda h: h["value"].isNotNull())


def _wire_records(s, d):
    """Records as a broker's connector gives them; each check fails for some."""
    e = F.col("event_id")
    ident = lambda k, bad: F.when(e % k == 1, bad).when(e % 4 == 0, F.md5(F.concat(F.lit(f"{k}:"), e.cast("string"))))
    heads = _headers(
        ("Tidemark-Idempotency-Key", F.when(e % 29 == 0, None).when(e % 31 == 0, "zz").otherwise(F.upper(F.sha2(e.cast("string"), 256)))),
        ("tidemark-occurred-at", F.when(e % 37 == 0, "yesterday").when(e % 3 == 0, times.render(times.micros(F.col("ts"))))),
        ("tidemark-message-id", ident(41, "no-uuid")), ("tidemark-correlation-id", ident(43, "{")), ("tidemark-causation-id", ident(47, "x")),
        ("tidemark-idempotency-source", F.when(e % 2 == 0, '["a",1]').otherwise("{half")), ("who", F.col("event_type")),
        ("traceparent", F.when(e % 6 == 0, F.concat(F.lit("00-"), F.md5(e.cast("string")), F.lit("-"), F.substring(F.md5(F.concat(F.lit("s"), e.cast("string"))), 1, 16), F.lit("-00"))).when(e % 6 == 1, "00-broken")), ("tracestate", F.when(e % 6 == 0, "a=1")),
    )
    value = F.when(e % 19 == 0, None).when(e % 23 == 0, "{broken").otherwise(F.col("props"))
    return src.read(s, d, "events").select(
        F.when(e % 17 == 0, "other").otherwise("events").alias("topic"), (e % 4).cast("int").alias("partition"), e.alias("offset"), F.encode(F.col("user_id").cast("string"), "utf-8").alias("key"),
        F.encode(value, "utf-8").alias("value"), F.timestamp_micros(times.micros(F.col("ts")) + 1_000_000).alias("timestamp"), heads.alias("headers"),
    )


_DECODED = f"""r AS (SELECT event_id AS pos, event_id AS e, ts, user_id, props, event_type, CASE WHEN event_id % 17 = 0 THEN 'other' ELSE 'events' END AS topic FROM events),
c AS (SELECT *, CASE WHEN e % 17 = 0 THEN 'UnexpectedTopic' WHEN e % 19 = 0 THEN 'MissingPayload' WHEN e % 23 = 0 THEN 'InvalidPayload' WHEN e % 29 = 0 THEN 'MissingIdempotencyKey'
 WHEN e % 31 = 0 OR e % 37 = 0 OR e % 41 = 1 OR e % 43 = 1 OR e % 47 = 1 THEN 'InvalidHeader' END AS failure_kind,
 CASE WHEN e % 17 = 0 OR e % 19 = 0 OR e % 23 = 0 OR e % 29 = 0 THEN NULL WHEN e % 31 = 0 THEN 'idempotency-key' WHEN e % 37 = 0 THEN 'occurred-at' WHEN e % 41 = 1 THEN 'message-id' WHEN e % 43 = 1 THEN 'correlation-id' WHEN e % 47 = 1 THEN 'causation-id' END AS failure_header,
 topic || '/' || e % 4 || '/' || e AS place FROM r)"""


@query(sql=f"WITH {_DECODED} SELECT pos, failure_kind, failure_header FROM c")
def envelope_checks(s, d):
    return envelope.decode(_wire_records(s, d), "events").select("pos", "failure_kind", "failure_header")


@query(sql=f"""WITH {_DECODED}, m AS (SELECT *, CASE WHEN e % 4 = 0 THEN md5('41:' || e) ELSE substr(sha256('message/' || place), 1, 32) END AS m, CASE WHEN e % 4 = 0 THEN md5('43:' || e) ELSE substr(sha256('correlation/' || place), 1, 32) END AS k, md5('47:' || e) AS w FROM c WHERE failure_kind IS NULL)
SELECT pos, CAST(user_id AS VARCHAR) AS entity_key, props AS payload, {_UUID.format("m")} AS message_id, {_UUID.format("k")} AS correlation_id, CASE WHEN e % 4 = 0 THEN {_UUID.format("w")} END AS causation_id,
 sha256(CAST(e AS VARCHAR)) AS idempotency_key, CASE WHEN e % 2 = 0 THEN '["a",1]' END AS idempotency_source, epoch_us(ts) + CASE WHEN e % 3 = 0 THEN 0 ELSE 1000000 END AS occurred_us, event_type AS who FROM m""")
def envelope_decode(s, d):
    good = envelope.decode(_wire_records(s, d), "events").where("failure_kind is null")
    return good.select("pos", "entity_key", "payload", "message_id", "correlation_id", "causation_id", "idempotency_key", "idempotency_source", "occurred_us", F.try_element_at("headers", F.lit("who")).alias("who"))


@query("outbox", sql=f"""SELECT entity_key AS message_key, '{{"id":' || message_id || '}}' AS payload, {_UUID.format("md5(CAST(message_id AS VARCHAR))")} AS id, sha256('k' || message_id) AS idempotency_key, created_s * 1000000 + 250000 AS occurred_us, entity_key FROM outbox""")
def wire_round_trip(s, d):
    """Send rows to records and back: what was sent is what is received; the entity key travels as a header where the record's key is another one."""
    m = F.col("message_id").cast("string")
    none = F.lit(None).cast("string")
    rows = src.outbox(s, d).select(
        F.lit("orders").alias("topic"), F.when(F.col("message_id") % 2 == 0, "p").alias("partition_key"), "entity_key", F.concat(F.lit('{"id":'), m, F.lit("}")).alias("payload"), F.md5(m).alias("message_id"),
        F.md5(F.concat(F.lit("c"), m)).alias("correlation_id"), times.render(F.col("created_s") * 1_000_000 + 250_000).alias("occurred_at"), F.sha2(F.concat(F.lit("k"), m), 256).alias("idempotency_key"),
        *[none.alias(c) for c in ("idempotency_source", "causation_id", "traceparent", "tracestate")], F.create_map(F.lit("tidemark-entity-key"), F.col("entity_key")).alias("headers"),
    )
    sent = wire(rows, outgoing()).withColumns({"partition": F.lit(0), "offset": F.lit(0).cast("long"), "timestamp": F.timestamp_seconds(F.lit(NOW))})
    back = envelope.decode(sent, "orders").where("failure_kind is null")
    return back.select(F.when(F.col("record_key") == F.encode(F.lit("p"), "utf-8"), F.col("entity_key")).otherwise(F.col("record_key").cast("string")).alias("message_key"), "payload", F.col("message_id").alias("id"), "idempotency_key", "occurred_us", "entity_key")


@query(sql="""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0'), '0') END || 'Z[UTC]' AS rendered,
 epoch_us(ts) AS parsed, epoch_us(ts) - 5400000000 AS ahead FROM events""")
def annotated_times(s, d):
    us = times.micros(F.col("ts"))
    shifted = F.regexp_replace(times.render(us), r"Z\[UTC\]", "+01:30[Europe/Somewhere]")
    return src.read(s, d, "events").select("event_id", times.render(us).alias("rendered"), times.parse(times.render(us)).alias("parsed"), times.parse(shifted).alias("ahead"))


@query(sql="SELECT event_type, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS total, count(*) FILTER (WHERE CAST(props->>'k' AS BIGINT) >= 50) AS large FROM events GROUP BY event_type")
def json_fields(s, d):
    k = envelope.json_long(F.col("props"), "k")
    return src.read(s, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count_if(k >= 50).alias("large"))


@query(sql="SELECT event_id, length(event_type) > 0 AND event_id % 3 <> 0 AS ok FROM events")
def correlation_ids(s, d):
    e = F.col("event_id")
    return src.read(s, d, "events").select("event_id", identity.correlation_ok(F.when(e % 3 == 0, F.concat("event_type", F.lit(" x"))).otherwise(F.col("event_type"))).alias("ok"))


@query(sql="SELECT event_id, CASE WHEN event_id % 2 = 0 THEN repeat('é', 256) ELSE repeat('x', 512) END AS kept, CASE WHEN event_id % 2 = 0 THEN 'a' || repeat('é', 255) || '...' ELSE repeat('y', 512) || '...' END AS cut FROM events")
def bounded_texts(s, d):
    even = F.col("event_id") % 2 == 0
    kept = F.when(even, F.repeat(F.lit("é"), 256)).otherwise(F.repeat(F.lit("x"), 512))
    cut = F.when(even, F.concat(F.lit("a"), F.repeat(F.lit("é"), 300))).otherwise(F.repeat(F.lit("y"), 600))
    return src.read(s, d, "events").select("event_id", text.bounded_text(kept).alias("kept"), text.bounded_text(cut).alias("cut"))


# Send


_FRONT = f"""f AS (SELECT entity_key, enqueue_order FROM outbox c WHERE status='Pending' AND (next_attempt_s IS NULL OR next_attempt_s <= {NOW})
 AND NOT EXISTS (SELECT 1 FROM outbox x WHERE x.entity_key=c.entity_key AND x.status='Publishing') AND NOT EXISTS (SELECT 1 FROM outbox n WHERE n.entity_key=c.entity_key AND n.status='Pending' AND n.enqueue_order>c.enqueue_order) ORDER BY enqueue_order LIMIT 100)"""


@query("outbox", sql=f""", {_FRONT} SELECT message_id, CASE WHEN old THEN 'Superseded' ELSE status END AS status, CASE WHEN old THEN 'superseded by newer pending state for the same entity' END AS last_error
FROM (SELECT o.*, EXISTS (SELECT 1 FROM f WHERE f.entity_key=o.entity_key AND o.status='Pending' AND o.enqueue_order < f.enqueue_order) AS old FROM outbox o)""")
def outbox_collapse_rewrite(s, d):
    return outbox.collapse_into(src.outbox(s, d), NOW, 100).select("message_id", "status", "last_error")


_CLAIM = f"""c AS (SELECT message_id, entity_key, enqueue_order FROM outbox c
WHERE (status='Pending' AND (next_attempt_s IS NULL OR next_attempt_s <= {NOW}) AND NOT EXISTS (SELECT 1 FROM outbox f WHERE f.entity_key=c.entity_key AND f.status='Publishing')
  AND NOT EXISTS (SELECT 1 FROM outbox n WHERE n.entity_key=c.entity_key AND n.status='Pending' AND n.enqueue_order>c.enqueue_order))
 OR (status='Publishing' AND claim_expires_s <= {NOW}) ORDER BY enqueue_order LIMIT 100),
led AS (SELECT o.*, c.message_id IS NOT NULL AS mine, EXISTS (SELECT 1 FROM c x WHERE x.entity_key=o.entity_key AND o.status='Pending' AND o.enqueue_order < x.enqueue_order) AS old FROM outbox o LEFT JOIN c ON c.message_id=o.message_id)"""


class _Picky:
    """A sink that can't take some rows."""

    def write(self, df, batch_id):
        return df.where("message_id % 7 = 0").select("message_id", F.lit("too large").alias("error"))


def _relayed(s, d):
    from ..streaming.jobs import relay

    # Row ids that are 1 modulo 7 are taken over by another worker while the batch is sent, those that are 2 are purged.
    m = F.col("message_id") % 7
    other = lambda df: df.where(~((F.col("claim_id") == "c1") & (m == 2)) | F.col("claim_id").isNull()).withColumn("claim_id", F.when((F.col("claim_id") == "c1") & (m == 1), "c2").otherwise(F.col("claim_id")))
    return relay(src.outbox(s, d), _Picky(), NOW, 100, worker="w1", claim_id="c1", meanwhile=other)


@query("outbox", sql=f""", {_CLAIM} SELECT message_id, CASE WHEN mine AND message_id % 7 = 0 THEN 'Pending' WHEN mine AND message_id % 7 = 1 THEN 'Publishing' WHEN mine THEN 'Published' WHEN old THEN 'Superseded' ELSE status END AS status,
 CASE WHEN mine AND message_id % 7 = 0 THEN {NOW} + 1 ELSE next_attempt_s END AS next_attempt_s, CASE WHEN mine AND message_id % 7 = 1 THEN 'c2' END AS claim_id, CASE WHEN mine AND message_id % 7 = 0 THEN 'too large' END AS last_error,
 CASE WHEN mine AND message_id % 7 > 1 THEN {NOW} END AS published_s FROM led WHERE NOT (mine AND message_id % 7 = 2)""")
def relay_outcomes(s, d):
    return _relayed(s, d)[0].select("message_id", "status", "next_attempt_s", "claim_id", "last_error", "published_s")


@query("outbox", sql=f""", {_CLAIM} SELECT count(*) AS claimed, count(*) FILTER (WHERE message_id % 7 > 2) AS published, count(*) FILTER (WHERE message_id % 7 = 0) AS failed, count(*) FILTER (WHERE message_id % 7 = 1) AS stale, count(*) FILTER (WHERE message_id % 7 = 2) AS missing FROM c""")
def relay_stats(s, d):
    t = _relayed(s, d)[1]
    return s.createDataFrame([(t.claimed, t.published, t.failed, t.stale, t.missing)], "claimed long, published long, failed long, stale long, missing long")


@query("outbox", sql=f""", {_CLAIM} SELECT message_id, row_number() OVER (ORDER BY enqueue_order) - 1 AS "offset" FROM c""")
def relay_captured(s, d):
    """What a sink was given, with the offsets that a broker would have given: in order of enqueue."""
    from ..sources.sinks import CapturingSink
    from ..streaming.jobs import relay

    sink = CapturingSink(folder(s, "captured"))
    relay(src.outbox(s, d), sink, NOW, 100)
    return sink.read(s).select("message_id", "offset")


# Dispatch


def _inbox(s, d):
    """The receive ledger with places: due rows arrive in the order of their offsets, so that each moves the cache unless it fails."""
    m = F.col("message_id")
    return src.received(s, d).select(
        "message_id", (m % 9).cast("string").alias("message_type"), F.lit("events").alias("topic"), F.lit(0).alias("part"), m.alias("pos"), "entity_key", F.concat(F.lit('{"m":'), m.cast("string"), F.lit("}")).alias("payload"),
        "status", "attempts", "created_s", "due_s", "last_failed_s", "kind",
    )


def _dispatched(s, d):
    def after(rows, ctx):
        ctx.enqueue(rows.select(F.col("message_id").alias("cause"), F.col("entity_key"), F.concat(F.lit("sent "), F.col("payload")).alias("payload")))
        return rows.where("message_id % 11 = 0").select("message_id", F.lit("refused").alias("failure"))

    empty = s.createDataFrame([], "entity_key string, payload string, topic string, part int, applied_pos long")
    types = s.createDataFrame([(str(k),) for k in range(8)], "message_type string")
    return dispatch.dispatch_due(_inbox(s, d), empty, NOW, 500, types, "events", after=after, max_attempts=4)


_DUE = f"""due AS (SELECT message_id FROM received WHERE status='Pending' OR (status='Retryable' AND due_s <= {NOW}) ORDER BY created_s, message_id LIMIT 500),
led AS (SELECT r.*, u.message_id IS NOT NULL AS mine, CASE WHEN r.message_id % 9 = 8 THEN 'MissingHandler' WHEN r.message_id % 11 = 0 THEN 'Handler' END AS bad FROM received r LEFT JOIN due u ON u.message_id=r.message_id)"""


@query("received", sql=f""", {_DUE} SELECT message_id, CASE WHEN NOT mine THEN status WHEN bad IS NULL THEN 'Processed' WHEN attempts + 1 >= 4 THEN 'Failed' ELSE 'Retryable' END AS status, CASE WHEN mine AND bad IS NOT NULL THEN attempts + 1 ELSE attempts END AS attempts,
 CASE WHEN NOT mine THEN due_s WHEN bad IS NOT NULL AND attempts + 1 < 4 THEN {NOW} + CAST(least(pow(2, attempts), 300) AS BIGINT) END AS due_s, CASE WHEN mine AND bad IS NOT NULL THEN bad ELSE kind END AS kind, CASE WHEN mine AND bad IS NOT NULL THEN {NOW} ELSE last_failed_s END AS last_failed_s FROM led""")
def dispatch_due_ledger(s, d):
    return _dispatched(s, d).ledger.select("message_id", "status", "attempts", "due_s", "kind", "last_failed_s")


@query("received", sql=f""", {_DUE} SELECT entity_key, max(message_id) AS applied_pos, '{{"m":' || max(message_id) || '}}' AS payload FROM led WHERE mine AND bad IS NULL GROUP BY entity_key""")
def dispatch_due_cache(s, d):
    return _dispatched(s, d).cache.select("entity_key", "applied_pos", "payload")


@query("received", sql=f""", {_DUE} SELECT entity_key, 'sent {{"m":' || message_id || '}}' AS payload FROM led WHERE mine AND bad IS NULL""")
def dispatch_due_sent(s, d):
    """Consume, then produce: messages of handled rows only."""
    return _dispatched(s, d).sent.select("entity_key", "payload")


@query("received", sql=f""", {_DUE}, k AS (SELECT *, message_id % 5 = 0 AS skips, message_id % 7 = 0 AS fails FROM led WHERE mine AND message_id % 9 <> 8)
SELECT message_id, CASE WHEN fails THEN 'too odd' WHEN skips THEN 'Skipped' ELSE 'Applied' END AS outcome FROM k""")
def dispatch_due_before(s, d):
    """A handler before the cache: some rows it fails, some it skips, the others go on."""
    m = F.col("message_id")
    before = lambda rows, ctx: rows.withColumns({"go": m % 5 != 0, "failure": F.when(m % 7 == 0, "too odd")})
    empty = s.createDataFrame([], "entity_key string, payload string, topic string, part int, applied_pos long")
    types = s.createDataFrame([(str(k),) for k in range(8)], "message_type string")
    return dispatch.dispatch_due(_inbox(s, d), empty, NOW, 500, types, "events", before).outcomes.where("outcome <> 'MissingHandler'")


_BASE = "CAST(floor(least(0.25 * pow(1.01, attempts * 100), 30) * 1000000) AS BIGINT)"


@query("received", sql=f"""SELECT message_id, {NOW}000000 + {_BASE} // 2 + (({_BASE} - {_BASE} // 2) * CAST('0x' || substr(md5('7/' || message_id || '/' || attempts * 100), 1, 8) AS BIGINT) >> 32) AS due_us, attempts * 100 + 1 AS attempts FROM received WHERE status='Retryable'""")
def retry_jitter(s, d):
    """Waits in microseconds, between half the backoff and all of it: 250 ms that grow by 1 % for each of up to 400 attempts, up to 30 s."""
    rows = src.received(s, d).where("status = 'Retryable'").withColumns({"failure": F.lit("Handler"), "terminal": F.lit(False), "attempts": F.col("attempts") * 100, "due_us": F.col("due_s") * 1_000_000}).drop("due_s")
    return received.settle(rows, NOW, jitter=7, max_attempts=10_000, initial=0.25, most=30.0, multiplier=1.01).select("message_id", "due_us", "attempts")


@query("received", sql=f""", {_DUE} SELECT count(*) AS claimed, count(*) FILTER (WHERE bad IS NULL) AS processed, count(*) FILTER (WHERE bad IS NOT NULL) AS failed, CAST(0 AS BIGINT) AS panicked FROM led WHERE mine""")
def dispatch_stats(s, d):
    t = _dispatched(s, d).stats
    return s.createDataFrame([(t["claimed"], t["processed"], t["failed"], t["panicked"])], "claimed long, processed long, failed long, panicked long")


# Streams and quarantine


@query(sql="""WITH r AS (SELECT event_id AS pos, CASE WHEN event_id % 4 = 1 THEN event_id - 1 ELSE event_id END AS mid, CASE WHEN event_id % 5 = 0 THEN event_id // 10 * 10 ELSE event_id END AS k, event_id % 13 = 0 AS foreign_topic FROM events),
g AS (SELECT * FROM r WHERE NOT foreign_topic),
a AS (SELECT pos, EXISTS (SELECT 1 FROM g x WHERE x.k=g.k AND x.pos<g.pos) AS dup, EXISTS (SELECT 1 FROM g x WHERE x.mid=g.mid AND x.pos<g.pos) AS taken FROM g)
SELECT pos, 'received' AS place FROM a WHERE NOT dup AND NOT taken UNION ALL SELECT pos, 'MessageIdConflict' FROM a WHERE taken AND NOT dup UNION ALL SELECT pos, 'UnexpectedTopic' FROM r WHERE foreign_topic""")
def stream_ingest(s, d):
    """The ingest stream over two batches: what is stored, and what is refused for which reason."""
    from ..streaming.jobs import REFUSED, STORED, ingest, run, written

    root, events = folder(s, "ingest"), src.read(s, d, "events")
    e = F.col("event_id")
    key = F.when(e % 5 == 0, F.floor(e / 10) * 10).otherwise(e).cast("string")
    rows = events.select(
        F.when(e % 13 == 0, "other").otherwise("events").alias("topic"), F.lit(0).alias("part"), e.alias("pos"), F.col("props").alias("payload"), F.sha2(key, 256).alias("idempotency_key"), F.when(e % 4 == 1, e - 1).otherwise(e).alias("message_id"), F.col("user_id").cast("string").alias("entity_key")
    )
    half = events.agg(F.expr("cast(avg(event_id) as bigint)")).first()[0]
    for older in (True, False):
        rows.where((F.col("pos") <= half) == older).coalesce(1).write.mode("append").parquet(f"{root}/inbox")
    run(ingest(s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/inbox"), root, "events"))
    stored = written(s, f"{root}/received", STORED).select("pos", F.lit("received").alias("place"))
    return stored.unionByName(written(s, f"{root}/quarantine", REFUSED).select("pos", F.col("failure_kind").alias("place")))


@query(sql="SELECT event_id AS pos, 1 AS copies FROM events WHERE event_id % 13 <> 0")
def stream_redelivery(s, d):
    """All records come twice, the second time in another batch and at other places: each is stored once."""
    from ..streaming.jobs import STORED, ingest, run, written

    root, e = folder(s, "again"), F.col("event_id")
    rows = src.read(s, d, "events").where(e % 13 != 0).select(F.lit("events").alias("topic"), F.lit(0).alias("part"), e.alias("pos"), F.col("props").alias("payload"), F.sha2(e.cast("string"), 256).alias("idempotency_key"), e.alias("message_id"), F.col("user_id").cast("string").alias("entity_key"))
    for shift in (0, 10**9):
        rows.withColumn("pos", F.col("pos") + shift).coalesce(1).write.mode("append").parquet(f"{root}/inbox")
    run(ingest(s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/inbox"), root, "events"))
    return written(s, f"{root}/received", STORED).groupBy((F.col("pos") % 10**9).alias("pos")).agg(F.count("*").cast("int").alias("copies"))


_PLACES = "x AS (SELECT 'events' AS topic, CAST(event_id % 4 AS INTEGER) AS part, event_id // 8 AS pos, min(event_type) AS failure_kind, bool_or(event_id % 16 < 8 AND event_id % 4 = 0) AS there FROM events GROUP BY ALL)"


def _refused(s, d):
    e = F.col("event_id")
    new = src.read(s, d, "events").select(F.lit("events").alias("topic"), (e % 4).cast("int").alias("part"), F.floor(e / 8).cast("long").alias("pos"), F.col("event_type").alias("failure_kind"))
    have = new.where("part = 0 and pos % 2 = 0").select("topic", "part", "pos", F.lit("old").alias("failure_kind")).distinct()
    return have, new


@query(sql=f"WITH {_PLACES} SELECT part, pos, failure_kind FROM x WHERE NOT (part = 0 AND pos % 2 = 0)")
def quarantine_insert(s, d):
    """One refused record a place; what is there already stays."""
    have, new = _refused(s, d)
    return received.quarantined(have, new).select("part", "pos", "failure_kind")


@query(sql="SELECT 'events' AS topic, 0 AS part, CAST(4 AS BIGINT) AS pos, 'old' AS failure_kind")
def quarantine_lookup(s, d):
    have, new = _refused(s, d)
    return received.quarantine_at(have.unionByName(received.quarantined(have, new)), "events", 0, 4)


# Derived state, recovery, change log


@query(sql="""WITH o AS (SELECT l_partkey, sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_linestatus='F') AS used FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1),
p AS (SELECT p_partkey AS product_id, CAST(p_size AS BIGINT) * 100 AS on_hand, p_partkey % 5 + 2 AS version FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 3 = 0)),
a AS (SELECT product_id, on_hand, CAST(greatest(on_hand - coalesce(used, 0), 0) AS BIGINT) AS available, CAST(version AS INTEGER) AS version FROM p LEFT JOIN o ON l_partkey=product_id)
SELECT *, CAST(product_id AS VARCHAR) AS entity_key, sha256('tidemark:products' || chr(0) || '["' || product_id || '",' || version || ']') AS idempotency_key, '{"product_id":' || product_id || ',"available":' || available || ',"version":' || version || '}' AS payload FROM a""")
def availability_recompute(s, d):
    line = src.read(s, d, "lineitem")
    fields = F.struct(F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("long").alias("quantity"), F.when(F.col("l_linestatus") == "F", "Fulfilled").otherwise("Placed").alias("status"))
    orders = line.select(F.to_json(fields).alias("payload"), (F.col("l_linenumber") == 3).alias("deleted"))
    products = src.read(s, d, "part").select(F.col("p_partkey").alias("product_id"), (F.col("p_size") * 100).cast("long").alias("on_hand"), (F.col("p_partkey") % 5 + 1).cast("int").alias("version"))
    return cache.recompute(products, orders, line.where("l_orderkey % 3 = 0").select(F.col("l_partkey").alias("product_id")), "tidemark:products")


class _Cached:
    """A source of the cache's entities whose key begins with a digit; entity 120's state names another one where it is told so."""

    def __init__(self, s, d, name, first, wrong=None):
        self.name, log = name, src.log(s, d).where(F.substring("entity_key", 1, 1) == first)
        self.all = log.select("entity_key").distinct()
        self.state = cache.current(log).where(F.col("entity_key").cast("int") % 10 != 3).select(
            "entity_key", F.when(F.col("entity_key") == wrong, "another").otherwise(F.col("entity_key")).alias("payload_key") if wrong else F.col("entity_key").alias("payload_key"), (F.col("entity_key").cast("long") + 10**9).alias("message_id"), F.col("entity_key").alias("partition_key"), F.sha2("entity_key", 256).alias("idempotency_key"), F.create_map().cast("map<string,string>").alias("headers"), "payload"
        )

    def keys(self, after):
        return self.all if after is None else self.all.where(F.col("entity_key") > after)

    def load(self, keys):
        return self.state.join(keys, "entity_key", "left_semi")


@query("log", sql="""SELECT source, status, pages, enqueued, skipped, last_key FROM (
 SELECT 'fives' AS source, 'Done' AS status, CAST(ceil(count(*) / 4.0) AS BIGINT) AS pages, count(*) FILTER (WHERE k % 10 <> 3) AS enqueued, count(*) FILTER (WHERE k % 10 = 3) AS skipped, max(e) AS last_key FROM (SELECT DISTINCT entity_key AS e, CAST(entity_key AS INTEGER) AS k FROM log WHERE entity_key LIKE '5%')
 UNION ALL SELECT 'ones', 'Failed', CAST(ceil(count(*) / 4.0) AS BIGINT), count(*) FILTER (WHERE k % 10 <> 3), count(*) FILTER (WHERE k % 10 = 3), max(e) FROM (SELECT DISTINCT entity_key AS e, CAST(entity_key AS INTEGER) AS k FROM log WHERE entity_key LIKE '1%' AND entity_key < '120'))""")
def recovery_report(s, d):
    """Two sources in pages of 4: one runs to its end, one stops at the key whose state names another entity, with what is before it in its page sent."""
    run = recovery.Recovery(_Cached(s, d, "fives", "5"), _Cached(s, d, "ones", "1", "120"))
    return recovery.Recovery.table(s, run.run(src.outbox(s, d), NOW, recovery.Request(page=4))[1])


@query(sql="""WITH t AS (SELECT k AS kind, n_name AS name, CAST('0x' || substr(sha256(k || ':' || n_name), 1, 10) AS BIGINT) AS band FROM nation, (VALUES ('outbox'), ('received'), ('cache')) v(k))
SELECT 1000 + band * 100 + 1 AS version, 'create ' || kind || ' ' || name AS name, CASE WHEN kind = 'cache' THEN 'SkippedAlreadyApplied' ELSE 'WouldApply' END AS action FROM t UNION ALL SELECT 1, 'init', 'ChecksumMismatch'""")
def change_log_report(s, d):
    names = [r.n_name for r in src.read(s, d, "nation").select("n_name").collect()]
    log = roles.change_log([(k, n) for n in names for k in ("outbox", "received", "cache")])
    history = s.createDataFrame([(c.version, c.checksum) for c in log if "cache" in c.name] + [(1, "old")], "version long, checksum string")
    return roles.dry_run(s, log, history)


@query(sql="""WITH a AS (SELECT p_partkey, CAST(p_size AS BIGINT) * 100 AS available, CASE WHEN p_partkey % 10 = 0 THEN 'Discontinued' ELSE 'Available' END AS status FROM part WHERE p_partkey % 7 <> 0)
SELECT l_orderkey * 10 + l_linenumber AS order_id, CASE WHEN status IS NULL THEN 'UnknownProduct' WHEN status <> 'Available' THEN 'NotAvailable' WHEN available < CAST(l_quantity AS BIGINT) * 40 THEN 'OutOfStock' ELSE 'Placed' END AS outcome,
 CASE WHEN status = 'Available' AND available >= CAST(l_quantity AS BIGINT) * 40 THEN 1 END AS version FROM lineitem LEFT JOIN a ON l_partkey=p_partkey""")
def order_place(s, d):
    products = src.read(s, d, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("product_id"), (F.col("p_size") * 100).cast("long").alias("available"), F.when(F.col("p_partkey") % 10 == 0, "Discontinued").otherwise("Available").alias("status"))
    asked = src.read(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_id"), F.col("l_partkey").alias("product_id"), (F.col("l_quantity").cast("long") * 40).alias("quantity"))
    return orders.place(asked, products).select("order_id", "outcome", "version")


@query(sql="SELECT p_partkey AS product_id, CASE WHEN p_partkey % 2 = 0 OR p_partkey % 3 = 0 THEN 'Discontinued' ELSE 'Available' END AS status, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 <> 0 THEN 2 ELSE 1 END AS version FROM part")
def product_discontinue(s, d):
    k = F.col("p_partkey")
    products = src.read(s, d, "part").select(k.alias("product_id"), F.when(k % 2 == 0, "Discontinued").otherwise("Available").alias("status"), F.lit(1).alias("version"))
    ids = products.where("product_id % 3 = 0").select("product_id")
    return orders.discontinue(products, ids.unionByName(ids.where("product_id % 9 = 0")))


@query(sql="""SELECT p_partkey, '{"a":[' || p_partkey || '.0,true,null],"b":' || (CASE p_partkey % 4 WHEN 0 THEN '1.1' WHEN 1 THEN '-0.0' WHEN 2 THEN '0.00002' ELSE '1e20' END) || ',"é":"x"}' AS canonical FROM part""")
def canonical_numbers(s, d):
    k = F.col("p_partkey")
    b = F.when(k % 4 == 0, "1.10").when(k % 4 == 1, "-0.0").when(k % 4 == 2, "2e-5").otherwise("1E+20")
    raw = F.concat(F.lit('{"é": "x", "b": '), b, F.lit(', "a": [ '), k.cast("string"), F.lit(".0, true ,null]}"))
    return src.read(s, d, "part").select("p_partkey", identity.canonical_json_exact(raw).alias("canonical"))


@query("quarantine", sql="SELECT message_type, expected_topic, failure_kind, count(*) AS n, min(created_s) AS oldest_s FROM quarantine WHERE message_type IN ('view', 'click') GROUP BY ALL")
def admin_ingest_failures(s, d):
    every = src.quarantine(s, d)
    return admin.ingest_failures({t: every.where(F.col("message_type") == t) for t in ("view", "click")})


@query(sql="SELECT n_regionkey AS region, bool_and(n_nationkey % 6 <> 0) AS ready, coalesce(string_agg('app.' || n_name, ',' ORDER BY n_name) FILTER (WHERE n_nationkey % 6 = 0), '') AS unusable FROM nation GROUP BY 1")
def admin_readiness(s, d):
    """Which services (a region's tables each) are ready, and what stands against the others."""
    n = src.read(s, d, "nation").select("n_regionkey", F.lit("app").alias("schema"), F.col("n_name").alias("table"), F.when(F.col("n_nationkey") % 6 == 0, "Denied").otherwise("Usable").alias("access"))
    out = None
    for k in range(5):
        one = admin.readiness(n.where(F.col("n_regionkey") == k)).select(F.lit(k).cast(n.schema["n_regionkey"].dataType).alias("region"), "ready", F.array_join("unusable", ",").alias("unusable"))
        out = one if out is None else out.unionByName(one)
    return out


@query(sql="SELECT n_name AS name, 'Applied' AS first, 'SkippedAlreadyApplied' AS second FROM nation")
def migrate_twice(s, d):
    """A change log that makes one ledger a nation, run two times: the second time there is nothing to do."""
    names = [r.n_name for r in src.read(s, d, "nation").select("n_name").collect()]
    log, history = roles.change_log([("cache", n) for n in names], root=folder(s, "ledgers")), folder(s, "history")
    first, second = roles.migrate(s, log, history), roles.migrate(s, log, history)
    told = s.createDataFrame([(c.version, c.name.removeprefix("create cache ")) for c in log], "version long, name string").where("name <> 'init'")
    return told.join(first.withColumnRenamed("action", "first"), "version").join(second.withColumnRenamed("action", "second"), "version").select("name", "first", "second")


# Counters


@query("outbox", sql=f"SELECT 'outbox' AS side, s.status, coalesce(n, 0) AS depth, coalesce(age, 0) AS oldest_age_s, CAST(40 AS BIGINT) AS sample_age_s FROM (VALUES ('Pending'),('Publishing'),('Published'),('Superseded'),('Failed')) s(status) LEFT JOIN (SELECT status, count(*) AS n, greatest({NOW} - min(created_s), 0) AS age FROM outbox GROUP BY status) r USING (status)")
def telemetry_retained(s, d):
    """A sample that fails leaves the one before, which grows older."""
    calls = []

    def sample(now):
        calls.append(now)
        if len(calls) > 1:
            raise OSError("the ledger can't be read")
        return telemetry.gauges(src.outbox(s, d), received.OUTBOX_STATUSES, now, now, "outbox")

    sampler = telemetry.Sampler(sample)
    sampler.tick(NOW)
    return sampler.tick(NOW + 40)


@query(sql="""WITH e AS (SELECT event_id % 3 AS k, event_type, event_id // 1000 AS batch, event_id % 50 = 0 AS err FROM events)
SELECT 'publish.records' AS instrument, event_type AS topic, CASE k WHEN 0 THEN 'failed' ELSE 'published' END AS outcome, count(*) AS value FROM e GROUP BY ALL
UNION ALL SELECT 'ingest.records', event_type, CASE k WHEN 0 THEN 'inserted' WHEN 1 THEN 'duplicate' ELSE 'skipped' END, count(*) FROM e WHERE NOT err GROUP BY ALL
UNION ALL SELECT 'ingest.commits', event_type, CASE k WHEN 0 THEN 'inserted' WHEN 1 THEN 'duplicate' ELSE 'skipped' END, count(*) FROM e WHERE NOT err GROUP BY ALL
UNION ALL SELECT 'ingest.errors', event_type, 'consume', count(*) FROM e WHERE err GROUP BY ALL""")
def telemetry_records(s, d):
    e, k = src.read(s, d, "events"), F.col("event_id") % 3
    bad = F.col("event_id") % 50 == 0
    sent = e.select(F.col("event_type").alias("topic"), F.when(k == 0, "failed").otherwise("published").alias("outcome"))
    took = e.select(F.col("event_type").alias("topic"), F.when(~bad, F.when(k == 0, "inserted").when(k == 1, "duplicate").otherwise("skipped")).alias("outcome"), F.when(bad, "consume").alias("error"))
    return telemetry.published(sent).unionByName(telemetry.ingested(took))


@query(sql="SELECT status, count(*) AS n, greatest(1706659200000 - min(epoch_us(ts) // 1000), 0) AS oldest_age_ms FROM (SELECT ts, CASE WHEN event_type IN ('view','click') THEN 'Pending' WHEN event_type='signup' THEN 'Retryable' WHEN event_type='purchase' THEN 'Processed' ELSE 'Failed' END AS status FROM events) GROUP BY status")
def received_age_ms(s, d):
    rows = src.received(s, d).select("message_id", "status").join(src.read(s, d, "events").select(F.col("event_id").alias("message_id"), times.micros(F.col("ts")).alias("created_us")), "message_id")
    return received.depth_ms(rows, NOW * 1000)
