"""Queries of whole ledger rewrites, failure handling, operator views, telemetry and header rules, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import headers, problems, text
from ..operators import admin, cache, orders, outbox, received, resync, telemetry
from ..sources import tables as src
from ..sources.scratch import folder
from .queries import NOW, query

# Send side


def _messages(s, d):
    k = F.col("c_custkey")
    return src.read(s, d, "customer").select(
        k.alias("seq"), (k + 100_000_000).alias("message_id"), k.cast("string").alias("entity_key"), F.when(k % 2 == 0, k.cast("string")).otherwise("shared").alias("partition_key"),
        F.when(k % 7 != 0, F.sha2(k.cast("string"), 256)).alias("idempotency_key"), F.create_map(F.when(k % 11 == 0, "Tidemark-Id").otherwise("who"), F.lit("x")).alias("headers"),
    )


_NEW = """m AS (SELECT c_custkey AS seq, c_custkey + 100000000 AS message_id, CAST(c_custkey AS VARCHAR) AS entity_key, c_custkey % 2 = 0 AS same_key, c_custkey % 7 <> 0 AS has_id FROM customer WHERE c_custkey % 11 <> 0),
new AS (SELECT *, (SELECT max(enqueue_order) FROM outbox) + row_number() OVER (ORDER BY seq) AS enqueue_order FROM m)"""


@query("outbox", sql=f"""SELECT message_id, entity_key, enqueue_order, CASE WHEN status='Pending' AND entity_key IN (SELECT entity_key FROM new WHERE has_id) THEN 'Superseded' ELSE status END AS status, CAST(NULL AS VARCHAR) AS last_error, CAST(NULL AS VARCHAR) AS carried FROM outbox
UNION ALL SELECT message_id, entity_key, enqueue_order, CASE WHEN has_id THEN 'Pending' ELSE 'Failed' END, CASE WHEN NOT has_id THEN 'missing idempotency identity' END, CASE WHEN NOT same_key THEN entity_key END FROM new""".replace("SELECT message_id", ", " + _NEW + "\nSELECT message_id", 1))  # fmt: skip
def outbox_enqueue(s, d):
    out = outbox.enqueue(src.outbox(s, d), _messages(s, d), NOW)
    return out.select("message_id", "entity_key", "enqueue_order", "status", "last_error", F.try_element_at("headers", F.lit("tidemark-entity-key")).alias("carried"))


_CLAIMED = f"""c AS (SELECT message_id, entity_key, enqueue_order FROM outbox c
WHERE (status='Pending' AND (next_attempt_s IS NULL OR next_attempt_s <= {NOW}) AND NOT EXISTS (SELECT 1 FROM outbox f WHERE f.entity_key=c.entity_key AND f.status='Publishing')
  AND NOT EXISTS (SELECT 1 FROM outbox n WHERE n.entity_key=c.entity_key AND n.status='Pending' AND n.enqueue_order>c.enqueue_order))
 OR (status='Publishing' AND claim_expires_s <= {NOW}) ORDER BY enqueue_order LIMIT 100),
led AS (SELECT o.*, c.message_id IS NOT NULL AS mine, EXISTS (SELECT 1 FROM c x WHERE x.entity_key=o.entity_key AND o.status='Pending' AND o.enqueue_order < x.enqueue_order) AS old FROM outbox o LEFT JOIN c ON c.message_id=o.message_id)"""


@query("outbox", sql=f", {_CLAIMED}\nSELECT message_id, CASE WHEN mine THEN 'Publishing' WHEN old THEN 'Superseded' ELSE status END AS status, CASE WHEN mine THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN mine THEN {NOW} + 30 WHEN old THEN NULL ELSE claim_expires_s END AS claim_expires_s FROM led")
def outbox_claim_rewrite(s, d):
    return outbox.claim_into(src.outbox(s, d), NOW, 100).select("message_id", "status", "attempts", "claim_expires_s")


@query("outbox", sql=f"""SELECT message_id, CASE WHEN hit AND message_id % 2 = 0 THEN 'Pending' WHEN hit THEN 'Published' ELSE status END AS status, CASE WHEN hit AND message_id % 2 = 0 THEN {NOW} + 1 ELSE next_attempt_s END AS next_attempt_s,
 CASE WHEN hit AND message_id % 2 = 0 THEN 'broker down' END AS last_error, CASE WHEN NOT hit THEN claim_expires_s END AS claim_expires_s FROM (SELECT *, status='Publishing' AND message_id % 3 <> 0 AS hit FROM outbox)""")
def outbox_acknowledge(s, d):
    led, m = src.outbox(s, d), F.col("message_id")
    led = led.withColumn("claim_id", F.when(F.col("status") == "Publishing", "mine"))
    acks = led.where("status = 'Publishing'").select("message_id", F.when(m % 3 == 0, "other").otherwise("mine").alias("claim_id"), F.when(m % 2 == 0, "broker down").alias("error"))
    return outbox.acknowledge(led, acks, NOW).select("message_id", "status", "next_attempt_s", "last_error", "claim_expires_s")


@query("outbox", sql=f", {_CLAIMED}\nSELECT message_id, CASE WHEN mine THEN 'Published' WHEN old THEN 'Superseded' ELSE status END AS status, CASE WHEN mine THEN attempts + 1 ELSE attempts END AS attempts FROM led")
def relay_cycle(s, d):
    from ..sources.sinks import FileSink
    from ..streaming.jobs import relay

    return relay(src.outbox(s, d), FileSink(folder(s, "sent")), NOW, 100)[0].select("message_id", "status", "attempts")


@query("outbox", sql=f"SELECT message_id, status FROM outbox WHERE NOT (status IN ('Published','Superseded') AND created_s < {NOW} - 604800 AND message_id IN (SELECT message_id FROM outbox WHERE status IN ('Published','Superseded') AND created_s < {NOW} - 604800 ORDER BY created_s, message_id LIMIT 1000))")
def outbox_purge(s, d):
    return outbox.purge(src.outbox(s, d), NOW, 604800, 1000).select("message_id", "status")


# Receive side


def _clashing(s, d):
    e = F.col("event_id")
    key = F.when(e % 5 == 0, F.concat(F.lit("k"), (F.floor(e / 10) * 10).cast("string"))).otherwise(F.concat(F.lit("k"), e.cast("string")))
    return src.read(s, d, "events").select(e.alias("pos"), F.when(e % 4 == 1, e - 1).otherwise(e).alias("message_id"), key.alias("idempotency_key"))


@query(sql="""WITH r AS (SELECT event_id AS pos, CASE WHEN event_id % 4 = 1 THEN event_id - 1 ELSE event_id END AS mid, CASE WHEN event_id % 5 = 0 THEN event_id // 10 * 10 ELSE event_id END AS k FROM events),
-- Keys repeat only on rows 5, 15, ... (after row 0, 10, ...), ids only on rows 1, 5, 9, ... (after the row before).
a AS (SELECT pos, mid, k, EXISTS (SELECT 1 FROM r x WHERE x.k=r.k AND x.pos<r.pos) AS dup, EXISTS (SELECT 1 FROM r x WHERE x.mid=r.mid AND x.pos<r.pos) AS taken FROM r)
SELECT pos, CASE WHEN dup THEN 'DuplicateIdempotencyKey' WHEN taken THEN 'MessageIdConflict' ELSE 'Inserted' END AS outcome FROM a""")
def ingest_dedupe_exact(s, d):
    return received.dedupe_exact(_clashing(s, d)).select("pos", "outcome")


@query(sql="""WITH r AS (SELECT event_id AS pos, event_type IN ('view', 'click') AS bad FROM events), n AS (SELECT *, row_number() OVER (ORDER BY pos) AS n FROM r),
g AS (SELECT pos, n - row_number() OVER (ORDER BY pos) AS run, n FROM n WHERE bad), q AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY pos) AS i, count(*) OVER (PARTITION BY run) AS c, min(pos) OVER (PARTITION BY run) AS first_pos FROM g)
SELECT first_pos, pos AS trip_pos, c AS n FROM q WHERE i = 4 AND c >= 4""")
def ingest_breaker(s, d):
    rows = src.read(s, d, "events").select(F.col("event_id").alias("pos"), "event_type")
    return received.skip_runs(rows, F.col("event_type").isin("view", "click"), 4)


@query(sql="""WITH r AS (SELECT event_id AS pos, user_id, event_type='error' AS bad, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE event_id % 6 <> 0),
g AS (SELECT *, n - row_number() OVER (ORDER BY pos) AS run FROM r WHERE bad) SELECT min(pos) AS first_pos, count(DISTINCT user_id) AS "rows" FROM g GROUP BY run HAVING count(DISTINCT user_id) >= 2""")
def dispatch_panic_breaker(s, d):
    e = src.read(s, d, "events")
    cycles = e.select(F.col("event_id").alias("pos"), F.when(F.col("event_id") % 6 != 0, F.col("user_id")).alias("message_id"), (F.col("event_type") == "error").alias("panicked"))
    return received.panic_trips(cycles, 2)


@query("received", sql=f"""SELECT message_id, status, attempts, due_s, kind FROM received WHERE status IN ('Processed','Failed') UNION ALL
SELECT message_id, CASE WHEN ok THEN 'Processed' WHEN message_id % 10 = 3 OR attempts + 1 >= 4 THEN 'Failed' ELSE 'Retryable' END, CASE WHEN ok THEN attempts ELSE attempts + 1 END,
 CASE WHEN NOT ok AND NOT (message_id % 10 = 3 OR attempts + 1 >= 4) THEN {NOW} + CAST(least(pow(2, attempts), 300) AS BIGINT) END, CASE WHEN ok THEN kind ELSE 'MissingHandler' END
FROM (SELECT *, message_id % 3 <> 0 AS ok FROM received WHERE status IN ('Pending','Retryable'))""")
def dispatch_settle(s, d):
    led = src.received(s, d)
    rows = led.where("status in ('Pending', 'Retryable')").withColumn("message_type", (F.col("message_id") % 3).cast("string"))
    types = s.createDataFrame([("1",), ("2",)], "message_type string")
    done = received.settle(received.route(rows, types).withColumn("terminal", F.col("message_id") % 10 == 3), NOW, max_attempts=4)
    cols = ("message_id", "status", "attempts", "due_s", "kind")
    return led.where("status in ('Processed', 'Failed')").select(*cols).unionByName(done.select(*cols))


@query("received", sql="""SELECT r.message_id, CASE WHEN v.message_id IS NOT NULL THEN 'Pending' ELSE status END AS status, CASE WHEN v.message_id IS NULL THEN due_s END AS due_s FROM received r
 LEFT JOIN (SELECT message_id FROM received WHERE status='Failed' AND kind='handler' ORDER BY last_failed_s ASC NULLS LAST, created_s, message_id LIMIT 200) v ON v.message_id=r.message_id""")
def redrive_rewrite(s, d):
    return received.redrive_into(src.received(s, d), 200, kind="handler").select("message_id", "status", "due_s")


@query("received", sql="SELECT least(200, count(*)) AS n FROM received WHERE status='Failed' AND kind='handler'")
def redrive_estimate(s, d):
    return received.redrive_estimate(src.received(s, d), 200, kind="handler")


# Cache and resync


@query("log", sql="""SELECT entity_key, pos AS applied_pos, topic FROM (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY isnew DESC, pos DESC) AS r FROM (SELECT entity_key, pos, pos % 5 = 0 AS isnew, CASE WHEN pos % 5 = 0 THEN 'events' ELSE 'events-old' END AS topic FROM log)) WHERE r = 1""")
def cache_state_migrated(s, d):
    rows = src.log(s, d).withColumns({"topic": F.when(F.col("pos") % 5 == 0, "events").otherwise("events-old"), "arrival": F.col("pos")})
    return cache.state_after(cache.fold(rows, "events")).select("entity_key", "applied_pos", "topic")


@query("log", sql="SELECT entity_key, pos AS applied_pos, topic FROM (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY isnew DESC, pos DESC) AS r FROM (SELECT entity_key, pos, pos % 5 = 0 AS isnew, CASE WHEN pos % 5 = 0 THEN 'events' ELSE 'events-old' END AS topic FROM log)) WHERE r = 1")
def stream_dispatch(s, d):
    from ..streaming.jobs import cached, dispatch, run

    root, events = folder(s, "dispatch"), src.read(s, d, "events")
    # The provided log is one file: halves by age are two files, taken one a batch.
    inbox = f"{root}/inbox"
    half = events.agg(F.expr("cast(avg(event_id) as bigint)")).first()[0]
    for older in (True, False):
        events.where((F.col("event_id") <= half) == older).coalesce(1).write.mode("append").parquet(inbox)
    stream = s.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    e = F.col("event_id")
    log = stream.select(F.col("user_id").cast("string").alias("entity_key"), F.col("props").alias("payload"), F.when(e % 5 == 0, "events").otherwise("events-old").alias("topic"), (F.col("user_id") % 4).cast("int").alias("part"), e.alias("pos"), e.alias("arrival"))
    run(dispatch(log, root, "events"))
    return cached(s, root).select("entity_key", "applied_pos", "topic")


@query("log", sql="SELECT c_custkey AS k, CASE WHEN l.entity_key IS NULL THEN 'Skip' ELSE 'Enqueue' END AS outcome FROM customer LEFT JOIN (SELECT DISTINCT entity_key FROM log) l ON l.entity_key = CAST(c_custkey AS VARCHAR)")
def resync_outcomes(s, d):
    return _loaded(s, d).select(F.col("entity_key").cast("long").alias("k"), "outcome")


def _loaded(s, d):
    states = cache.current(src.log(s, d)).select("entity_key", F.col("entity_key").alias("payload_key"), "payload")
    return resync.loaded(src.read(s, d, "customer").select(F.col("c_custkey").cast("string").alias("entity_key")), states)


@query("log", sql="""SELECT CAST((n - 1) // 100 AS BIGINT) AS page, count(*) FILTER (WHERE hit) AS enqueued, count(*) FILTER (WHERE NOT hit) AS skipped, CAST(0 AS BIGINT) AS mismatched, max(k) AS last_key
 FROM (SELECT *, row_number() OVER (ORDER BY k) AS n FROM (SELECT CAST(c_custkey AS VARCHAR) AS k, l.entity_key IS NOT NULL AS hit FROM customer LEFT JOIN (SELECT DISTINCT entity_key FROM log) l ON l.entity_key = CAST(c_custkey AS VARCHAR))) GROUP BY 1""")
def resync_pages(s, d):
    return resync.progress(_loaded(s, d), 100)


# Operator views


_TERMINAL = {"outbox": "'Published','Superseded','Failed'", "received": "'Processed','Failed'"}
_DEPTHS = " UNION ALL ".join(f"SELECT '{t}' AS message_type, '{v}' AS side, status, count(*) AS n, greatest({NOW} - min(created_s), 0) AS oldest_age_s, (greatest({NOW} - min(created_s), 0) >= 300 AND status NOT IN ({_TERMINAL[v]})) AS over_max_age FROM {v} GROUP BY status" for t, v in (("order", "outbox"), ("event", "received")))


@query("outbox", "received", sql=_DEPTHS)
def admin_depths(s, d):
    return admin.depths({"order": src.outbox(s, d)}, {"event": src.received(s, d)}, NOW)


@query("outbox", "received", sql=f"""SELECT *, count(*) OVER (PARTITION BY message_type, side) >= 100 AS truncated FROM (
(SELECT 'order' AS message_type, 'outbox' AS side, message_id, entity_key, status, attempts, claim_expires_s AS due_at_s FROM outbox WHERE status='Publishing' AND claim_expires_s < {NOW} - 60 ORDER BY claim_expires_s, created_s, message_id LIMIT 100) UNION ALL
(SELECT 'event', 'received', message_id, entity_key, status, attempts, coalesce(due_s, created_s) FROM received WHERE status IN ('Pending','Retryable') AND coalesce(due_s, created_s) < {NOW} - 60 ORDER BY coalesce(due_s, created_s), created_s, message_id LIMIT 100))""")
def admin_stuck(s, d):
    return admin.stuck({"order": src.outbox(s, d)}, {"event": src.received(s, d)}, NOW)


@query("received", sql="SELECT 'event' AS message_type, 'received' AS side, message_id, entity_key, attempts, last_failed_s, kind AS latest_error, 1 AS error_count, (SELECT count(*) FROM received WHERE status='Failed') AS n FROM received WHERE status='Failed' ORDER BY last_failed_s ASC NULLS LAST, created_s, message_id LIMIT 50")
def admin_dead_letters(s, d):
    return admin.dead_letters({"event": src.received(s, d).withColumn("errors", F.array("kind"))})


@query(sql="""SELECT s AS schema, n_name AS "table", CASE WHEN n_nationkey % 7 = 6 THEN 'Missing' WHEN n_nationkey % 5 = 0 THEN 'NotATable' WHEN n_nationkey % 4 = 1 THEN 'Usable' WHEN n_nationkey % 3 = 0 OR s = 'shut' THEN 'Denied' ELSE 'Usable' END AS access
 FROM (SELECT *, CASE WHEN n_regionkey = 2 THEN 'shut' ELSE 'app' END AS s FROM nation)""")
def admin_access(s, d):
    """Views are no tables, a schema without usage denies what wants a privilege, and a table that nothing is wanted of is usable if it is there."""
    k, n = F.col("n_nationkey"), src.read(s, d, "nation").withColumn("schema", F.when(F.col("n_regionkey") == 2, "shut").otherwise("app")).withColumn("table", F.col("n_name"))
    grants = F.when(k % 3 == 0, F.array(F.lit("SELECT"))).otherwise(F.array(F.lit("SELECT"), F.lit("UPDATE")))
    catalog = n.where(k % 7 != 6).select("schema", "table", F.when(k % 5 == 0, "v").when(k % 2 == 0, "p").otherwise("r").alias("kind"), grants.alias("granted"), (F.col("schema") == "app").alias("schema_usage"))
    wanted = F.when(k % 4 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("SELECT"), F.lit("UPDATE")))
    return admin.access(catalog, n.select("schema", "table", wanted.alias("privileges")))


# Telemetry


_LE = " ".join(f"WHEN v <= {e} THEN {e}" for e in telemetry.QUEUE_SECONDS)


@query(sql=f"SELECT event_type, CAST(CASE {_LE} ELSE 'inf'::DOUBLE END AS DOUBLE) AS le, count(*) AS n FROM (SELECT event_type, value AS v FROM events WHERE value >= 0) GROUP BY 1, 2")
def telemetry_histogram(s, d):
    return telemetry.histogram(src.read(s, d, "events"), F.col("value"), telemetry.QUEUE_SECONDS, "event_type").drop("total")


@query(sql="""WITH c AS (SELECT event_type, event_id % 9 = 0 AS err, user_id % 3 AS k FROM events)
SELECT 'scheduler.cycles' AS instrument, 'relay' AS scheduler, event_type AS message_type, CAST(NULL AS VARCHAR) AS status, count(*) AS value FROM c WHERE NOT err GROUP BY event_type
UNION ALL SELECT 'scheduler.errors', 'relay', event_type, NULL, count(*) FROM c WHERE err GROUP BY event_type
UNION ALL SELECT 'scheduler.rows', 'relay', event_type, 'published', CAST(sum(k) AS BIGINT) FROM c WHERE NOT err AND k > 0 GROUP BY event_type""")
def telemetry_scheduler(s, d):
    e = src.read(s, d, "events")
    return telemetry.scheduler(e.select(F.lit("relay").alias("scheduler"), F.col("event_type").alias("message_type"), (F.col("event_id") % 9 == 0).alias("error"), F.create_map(F.lit("published"), F.col("user_id") % 3, F.lit("failed"), F.lit(0).cast("long")).alias("rows")))


@query(sql="""WITH r AS (SELECT event_id AS pos, CASE WHEN event_id % 4 = 1 THEN event_id - 1 ELSE event_id END AS mid, CASE WHEN event_id % 5 = 0 THEN event_id // 10 * 10 ELSE event_id END AS k FROM events),
a AS (SELECT EXISTS (SELECT 1 FROM r x WHERE x.k=r.k AND x.pos<r.pos) AS dup, EXISTS (SELECT 1 FROM r x WHERE x.mid=r.mid AND x.pos<r.pos) AS taken FROM r)
SELECT count(*) AS consumed, count(*) FILTER (WHERE NOT dup AND NOT taken) AS inserted, count(*) FILTER (WHERE dup) AS duplicates, count(*) FILTER (WHERE NOT dup AND taken) AS skipped FROM a""")
def telemetry_ingest_totals(s, d):
    return telemetry.ingest_totals(received.dedupe_exact(_clashing(s, d)))


@query("received", sql=f"SELECT 'received' AS side, s.status, coalesce(n, 0) AS depth, coalesce(age, 0) AS oldest_age_s, CAST(15 AS BIGINT) AS sample_age_s FROM (VALUES ('Pending'),('Retryable'),('Processed'),('Failed')) s(status) LEFT JOIN (SELECT status, count(*) AS n, greatest({NOW} - 15 - min(created_s), 0) AS age FROM received GROUP BY status) r USING (status)")
def telemetry_gauges(s, d):
    return telemetry.gauges(src.received(s, d), received.RECEIVED_STATUSES, NOW, NOW - 15, "received")


# Functions


@query(sql="""SELECT event_id, event_type AS "user", CAST(event_id AS VARCHAR) AS reserved, CASE WHEN event_id % 3 <> 0 THEN '00-' || lpad(hex(event_id + 1), 32, '0') || '-00f067aa0ba902b7-01' END AS parent, CASE WHEN event_id % 3 <> 0 THEN 'a=1,t@v=' || event_id END AS state FROM (SELECT event_id, event_type, lower(to_hex(event_id + 1)) AS h FROM events)""".replace("hex(event_id + 1)", "h", 1))
def header_parse(s, d):
    e = F.col("event_id")
    h = lambda k, v: F.struct(F.lit(k).alias("key"), F.encode(v.cast("string"), "utf-8").alias("value"))
    parent = F.concat(F.lit("00-"), F.lpad(F.lower(F.hex(e + 1)), 32, "0"), F.when(e % 3 == 0, "-0000000000000000-01").otherwise("-00f067aa0ba902b7-01"))
    every = F.array(h("Tidemark-Id", e), h("tidemark-id", F.lit("late")), h("Who", F.lit("x")), h("Who", F.col("event_type")), h("none", F.lit(None)), h("TraceParent", parent), h("traceparent", F.lit("late")), h("tracestate", F.concat(F.lit("a=1 ,, t@v="), e)))
    rows = src.read(s, d, "events").select("event_id", headers.parse(every).alias("p")).withColumn("t", headers.trace_context(F.col("p.trace")))
    return rows.select("event_id", F.col("p.user")["Who"].alias("user"), F.col("p.reserved")["tidemark-id"].alias("reserved"), F.col("t.traceparent").alias("parent"), F.col("t.tracestate").alias("state"))


@query("outbox", sql="SELECT message_id, 'who=x|tidemark-message-id=' || message_id || CASE WHEN message_id % 2 = 0 THEN '|tidemark-causation-id=c' ELSE '' END AS headers FROM outbox")
def header_outgoing(s, d):
    none = F.lit(None).cast("string")
    rows = src.outbox(s, d).withColumns(
        {"headers": F.create_map(F.lit("who"), F.lit("x"), F.lit("TraceState"), F.lit("y")), "causation_id": F.when(F.col("message_id") % 2 == 0, "c"), **{c: none for c in ("correlation_id", "occurred_at", "idempotency_key", "idempotency_source", "traceparent", "tracestate")}}
    )
    return rows.select("message_id", F.array_join(F.transform(headers.outgoing(), lambda h: F.concat(h["key"], F.lit("="), h["value"])), "|").alias("headers"))


@query(sql="""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1000 WHEN 2 THEN p_size * 60000 WHEN 3 THEN p_size * 3600000 WHEN 4 THEN CAST(p_size AS BIGINT) * 86400000 END AS ms FROM part""")
def durations(s, d):
    unit = F.element_at(F.array(*map(F.lit, ("ms", "s", "m", "h", "d", "w"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return src.read(s, d, "part").select("p_partkey", text.duration_ms(F.concat(F.lit(" "), F.col("p_size").cast("string"), unit)).alias("ms"))


@query(sql="SELECT event_id, CASE WHEN event_type='view' THEN 'MissingHandler' WHEN event_type='click' THEN 'Handler' WHEN event_type='signup' THEN 'InvalidPayload' ELSE 'Infrastructure' END AS kind, CASE event_id % 4 WHEN 0 THEN 'constraint' WHEN 1 THEN 'contention' WHEN 2 THEN 'statement' ELSE 'infrastructure' END AS problem FROM events")
def failure_kinds(s, d):
    t = F.col("event_type")
    what = F.when(t == "view", "missing-handler").when(t == "click", "handler-panicked").when(t == "signup", "invalid-payload").when(t == "purchase", "contention").otherwise("unheard-of")
    code = F.element_at(F.array(*map(F.lit, ("23505", "40001", "42501", "08006"))), (F.col("event_id") % 4 + 1).cast("int"))
    return src.read(s, d, "events").select("event_id", problems.kind(problems.uri(what)).alias("kind"), problems.sqlstate(code).alias("problem"))


@query(sql="SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'Compact' WHEN 1 THEN 'CompactAndDelete' WHEN 2 THEN 'Delete' ELSE 'Unrecognized' END AS policy, n_nationkey % 2 = 0 AS prefix_ok FROM nation")
def topic_names(s, d):
    k = F.col("n_nationkey")
    raw = F.element_at(F.array(*map(F.lit, (" Compact,", "delete, COMPACT", "delete,delete", "fast,compact", ""))), (k % 5 + 1).cast("int"))
    return src.read(s, d, "nation").select("n_nationkey", text.cleanup_policy(raw).alias("policy"), text.prefix_ok(F.when(k % 2 == 0, "dev-1.").otherwise("Dev-1")).alias("prefix_ok"))


# Example domain


def _changed(s, d):
    k = F.col("o_orderkey")
    was = F.when(F.col("o_orderstatus") == "O", "Placed").when(F.col("o_orderstatus") == "F", "Fulfilled").otherwise("Cancelled")
    placed = src.read(s, d, "orders").select(k.alias("order_id"), was.alias("status"), (k % 5 + 1).cast("int").alias("version"))
    asked = src.read(s, d, "orders").where(k % 4 != 0).select(F.when(k % 50 == 1, -k).otherwise(k).alias("order_id"), F.when(k % 4 == 1, "Fulfilled").otherwise("Cancelled").alias("to"))
    return orders.change(placed, asked)


_CHANGED = """p AS (SELECT o_orderkey AS order_id, CASE o_orderstatus WHEN 'O' THEN 'Placed' WHEN 'F' THEN 'Fulfilled' ELSE 'Cancelled' END AS status, CAST(o_orderkey % 5 + 1 AS INTEGER) AS version,
 CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 50 = 1 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'Fulfilled' ELSE 'Cancelled' END AS "to" FROM orders),
c AS (SELECT order_id, CASE WHEN ok THEN "to" ELSE status END AS status, CASE WHEN ok THEN version + 1 ELSE version END AS version, CASE WHEN "to" IS NULL THEN 'Unasked' WHEN ok THEN 'Changed' ELSE 'Illegal' END AS outcome
 FROM (SELECT *, coalesce((status = 'Placed' AND "to" <> 'Placed') OR (status = 'Fulfilled' AND "to" = 'Cancelled'), false) AS ok FROM p)
 UNION ALL SELECT -o_orderkey, NULL, NULL, 'NotFound' FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 50 = 1)"""


@query(sql=f"WITH {_CHANGED} SELECT order_id, status, version, outcome FROM c")
def order_change(s, d):
    return _changed(s, d)


@query(sql=f"""WITH {_CHANGED} SELECT order_id, version, CAST(order_id AS VARCHAR) AS entity_key, sha256('tidemark:orders' || chr(0) || '["' || order_id || '",' || version || ']') AS idempotency_key,
 '{{"order_id":' || order_id || ',"status":"' || status || '"}}' AS payload FROM c WHERE outcome = 'Changed'""")
def order_snapshots(s, d):
    return orders.snapshots(_changed(s, d), "tidemark:orders")


@query(sql="SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS placed_s FROM orders ORDER BY o_orderdate, o_orderkey")
def order_list(s, d):
    return orders.listing(src.read(s, d, "orders").select("o_orderkey", src.seconds("o_orderdate").alias("placed_s")), "placed_s", "o_orderkey")
