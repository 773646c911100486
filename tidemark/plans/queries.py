"""Every query of the changelog engine, with its oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity as fn
from ..operators import cache, outbox, received, resync
from ..sources import tables as src

NOW = src.NOW
Q: dict = {}
SQL: dict[str, str] = {}


def query(*views: str, sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = ("WITH " + ",\n".join(src.CTE[v] for v in views) + "\n" if views else "") + sql
        return f

    return put


# Outbox


@query("outbox", sql="SELECT message_id, entity_key, CASE WHEN status='Pending' AND EXISTS (SELECT 1 FROM outbox n WHERE n.entity_key=o.entity_key AND n.status='Pending' AND n.enqueue_order>o.enqueue_order) THEN 'Superseded' ELSE status END AS status FROM outbox o")
def outbox_supersede(s, d):
    return outbox.supersede(src.outbox(s, d)).select("message_id", "entity_key", "status")


_CLAIM = f"""SELECT message_id, entity_key, enqueue_order, attempts + 1 AS attempts FROM outbox c
WHERE (status='Pending' AND (next_attempt_s IS NULL OR next_attempt_s <= {NOW})
  AND NOT EXISTS (SELECT 1 FROM outbox f WHERE f.entity_key=c.entity_key AND f.status='Publishing')
  AND NOT EXISTS (SELECT 1 FROM outbox n WHERE n.entity_key=c.entity_key AND n.status='Pending' AND n.enqueue_order>c.enqueue_order))
 OR (status='Publishing' AND claim_expires_s <= {NOW}) ORDER BY enqueue_order LIMIT 100"""


@query("outbox", sql=_CLAIM)
def outbox_claim_window(s, d):
    return outbox.claim(src.outbox(s, d), NOW, 100).select("message_id", "entity_key", "enqueue_order", "attempts")


@query("outbox", sql=_CLAIM)
def outbox_claim_batch(s, d):
    return outbox.claim_by_joins(src.outbox(s, d), NOW, 100).select("message_id", "entity_key", "enqueue_order", "attempts")


@query("outbox", sql="""SELECT o.message_id, f.enqueue_order AS "by" FROM outbox o JOIN (SELECT entity_key, enqueue_order FROM outbox c WHERE status='Pending'
 AND NOT EXISTS (SELECT 1 FROM outbox x WHERE x.entity_key=c.entity_key AND x.status='Publishing') AND NOT EXISTS (SELECT 1 FROM outbox n WHERE n.entity_key=c.entity_key AND n.status='Pending' AND n.enqueue_order>c.enqueue_order)
 ORDER BY enqueue_order LIMIT 100) f ON o.entity_key=f.entity_key AND o.status='Pending' AND o.enqueue_order<f.enqueue_order""".replace("WHERE status='Pending'\n", f"WHERE status='Pending' AND (next_attempt_s IS NULL OR next_attempt_s <= {NOW})\n"))
def outbox_collapse(s, d):
    return outbox.collapse(src.outbox(s, d), NOW, 100)


@query("outbox", sql="""SELECT a.message_id, CASE WHEN o.status IS NULL THEN 'Missing' WHEN o.status='Publishing' AND a.c = 'w' || o.message_id % 2 THEN 'Updated' ELSE 'StaleClaim' END AS outcome
 FROM (SELECT message_id * CASE WHEN message_id % 11 = 0 THEN -1 ELSE 1 END AS message_id, CASE WHEN message_id % 3 = 0 THEN 'w9' ELSE 'w' || message_id % 2 END AS c FROM outbox WHERE message_id % 97 = 0) a LEFT JOIN outbox o ON a.message_id=o.message_id""")
def outbox_mark_outcome(s, d):
    m = F.col("message_id")
    own = F.concat(F.lit("w"), (m % 2).cast("string"))
    ledger = src.outbox(s, d).withColumn("claim_id", F.when(F.col("status") == "Publishing", own))
    acks = ledger.where("message_id % 97 = 0").select((m * F.when(m % 11 == 0, -1).otherwise(1)).cast("long").alias("message_id"), F.when(m % 3 == 0, "w9").otherwise(own).alias("claim_id"))
    return outbox.mark(ledger, acks)


@query("outbox", sql=f"SELECT message_id, status, created_s FROM outbox WHERE status IN ('Published','Superseded') AND created_s < {NOW} - 604800 ORDER BY created_s, message_id LIMIT 1000")
def outbox_purge_victims(s, d):
    return outbox.purge_victims(src.outbox(s, d), NOW, 604800, 1000).select("message_id", "status", "created_s")


_DEPTH = "SELECT status, count(*) AS n, greatest({now} - min(created_s), 0) AS oldest_age_s, (greatest({now} - min(created_s), 0) >= 300 AND status NOT IN ({t})) AS over_max_age FROM {l} GROUP BY status"


@query("outbox", sql=_DEPTH.format(now=NOW, l="outbox", t="'Published','Superseded','Failed'"))
def outbox_depth(s, d):
    return received.depth(src.outbox(s, d), NOW, 300, outbox.TERMINAL)


@query("received", sql=_DEPTH.format(now=NOW, l="received", t="'Processed','Failed'"))
def received_depth(s, d):
    return received.depth(src.received(s, d), NOW, 300, ("Processed", "Failed"))


@query("outbox", sql=f"SELECT message_id, claim_expires_s FROM outbox WHERE status='Publishing' AND claim_expires_s < {NOW} - 60 ORDER BY claim_expires_s, created_s, message_id LIMIT 100")
def outbox_stuck(s, d):
    return src.outbox(s, d).where((F.col("status") == "Publishing") & (F.col("claim_expires_s") < NOW - 60)).orderBy("claim_expires_s", "created_s", "message_id").limit(100).select("message_id", "claim_expires_s")


@query("outbox", sql="SELECT message_id, row_number() OVER (ORDER BY created_s, message_id) AS enqueue_order FROM outbox")
def enqueue_order_backfill(s, d):
    return outbox.with_enqueue_order(src.outbox(s, d).drop("enqueue_order")).select("message_id", "enqueue_order")


# Received


@query("received", sql="SELECT s.status, coalesce(r.n, 0) AS n FROM (VALUES ('Pending'),('Retryable'),('Processed'),('Failed')) s(status) LEFT JOIN (SELECT status, count(*) AS n FROM received GROUP BY status) r USING (status)")
def received_depth_dense(s, d):
    return received.dense_depth(src.received(s, d), received.RECEIVED_STATUSES)


@query("received", sql=f"SELECT message_id, status, created_s FROM received WHERE status='Pending' OR (status='Retryable' AND due_s <= {NOW}) ORDER BY created_s, message_id LIMIT 500")
def received_due(s, d):
    return received.due(src.received(s, d), NOW, 500).select("message_id", "status", "created_s")


@query("received", sql=f"SELECT message_id, coalesce(due_s, created_s) AS due_at_s FROM received WHERE status IN ('Pending','Retryable') AND coalesce(due_s, created_s) < {NOW} - 60 ORDER BY due_at_s, created_s, message_id LIMIT 100")
def received_stuck(s, d):
    return received.stuck(src.received(s, d), NOW, 60, 100).select("message_id", "due_at_s")


@query("received", sql="SELECT message_id, entity_key, kind, last_failed_s, attempts FROM received WHERE status='Failed' ORDER BY last_failed_s ASC NULLS LAST, created_s, message_id LIMIT 50")
def dlq_list(s, d):
    return received.dead_letters(src.received(s, d), 50).select("message_id", "entity_key", "kind", "last_failed_s", "attempts")


@query("received", sql=f"SELECT kind, count(*) AS n FROM received WHERE status='Failed' AND last_failed_s >= {NOW} - 1296000 GROUP BY kind")
def dlq_count(s, d):
    return received.failed(src.received(s, d), since=NOW - 1296000).groupBy("kind").agg(F.count("*").alias("n"))


@query("received", sql="SELECT entity_key, count(*) AS n, max(last_failed_s) AS last_failed_s, arg_max(kind, last_failed_s * 10000000 + message_id) AS latest_kind FROM received WHERE status='Failed' GROUP BY entity_key")
def dlq_summary_latest_error(s, d):
    return received.failed(src.received(s, d)).groupBy("entity_key").agg(F.count("*").alias("n"), F.max("last_failed_s").alias("last_failed_s"), F.max_by("kind", F.struct("last_failed_s", "message_id")).alias("latest_kind"))


_REDRIVE = "FROM received WHERE status='Failed' AND kind='handler' ORDER BY last_failed_s ASC NULLS LAST, created_s, message_id LIMIT 200"


@query("received", sql=f"SELECT message_id, 'Pending' AS status, attempts, last_failed_s, kind {_REDRIVE}")
def redrive_plan(s, d):
    return received.redrive(src.received(s, d), 200, kind="handler").select("message_id", "status", "attempts", "last_failed_s", "kind")


@query("received", sql=f"SELECT message_id, 'Pending' AS status, 0 AS attempts, CAST(NULL AS BIGINT) AS last_failed_s, CAST(NULL AS VARCHAR) AS kind {_REDRIVE}")
def redrive_clear_history(s, d):
    return received.redrive(src.received(s, d), 200, clear=True, kind="handler").select("message_id", "status", "attempts", "last_failed_s", "kind")


@query("received", sql="SELECT message_id, least(1.0 * pow(2.0, attempts), 8.0) AS base_s, CASE WHEN kind='conflict' OR attempts + 1 >= 5 THEN 'Failed' ELSE 'Retryable' END AS status FROM received WHERE kind IS NOT NULL")
def retry_schedule(s, d):
    rows = src.received(s, d).where("kind is not null")
    return rows.select("message_id", received.backoff(F.col("attempts"), 1.0, 8.0).alias("base_s"), received.after_failure(F.col("attempts"), 5, F.col("kind") == "conflict").alias("status"))


@query("received", sql="""SELECT entity_key, string_agg(kind, '|' ORDER BY message_id) AS errors FROM (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY message_id DESC) AS r FROM received WHERE kind IS NOT NULL) WHERE r <= 20 GROUP BY entity_key""")
def bounded_errors(s, d):
    from pyspark.sql import Window

    # The newest 20 of an entity are picked before any are collected; a rank filter leaves the rest where they are.
    rank = F.row_number().over(Window.partitionBy("entity_key").orderBy(F.desc("message_id")))
    kept = src.received(s, d).where("kind is not null").withColumn("r", rank).where("r <= 20")
    rows = kept.groupBy("entity_key").agg(F.array_sort(F.collect_list(F.struct("message_id", "kind"))).alias("e"))
    return rows.select("entity_key", F.array_join(F.transform("e", lambda e: e["kind"]), "|").alias("errors"))


# Ingest

_RECORDS = """rec AS (SELECT event_id AS pos, CASE WHEN event_id % 17 = 0 THEN 'other' ELSE 'events' END AS topic, CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 23 = 0 THEN '{broken' ELSE props END AS payload,
 CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 31 = 0 THEN 'zz' ELSE sha256(CAST(event_id // 2 AS VARCHAR)) END AS idempotency_key, user_id FROM events)"""


def _records(s, d):
    e = F.col("event_id")
    return src.read(s, d, "events").select(
        e.alias("pos"), F.when(e % 17 == 0, "other").otherwise("events").alias("topic"), F.when(e % 19 == 0, None).when(e % 23 == 0, "{broken").otherwise(F.col("props")).alias("payload"),
        F.when(e % 29 == 0, None).when(e % 31 == 0, "zz").otherwise(F.sha2(F.floor(e / 2).cast("string"), 256)).alias("idempotency_key"), "user_id",
    )


_KIND = "CASE WHEN topic<>'events' THEN 'UnexpectedTopic' WHEN payload IS NULL THEN 'MissingPayload' WHEN NOT json_valid(payload) THEN 'InvalidPayload' WHEN idempotency_key IS NULL THEN 'MissingIdempotencyKey' WHEN NOT regexp_full_match(idempotency_key, '[0-9a-fA-F]{64}') THEN 'InvalidHeader' END"


@query(sql=f"WITH {_RECORDS} SELECT pos, {_KIND} AS failure_kind FROM rec")
def ingest_classify(s, d):
    return received.classify(_records(s, d), "events").select("pos", "failure_kind")


@query(sql=f"WITH {_RECORDS}, k AS (SELECT *, {_KIND} AS failure_kind FROM rec) SELECT pos, lower(idempotency_key) AS idempotency_key, CAST(user_id AS VARCHAR) AS entity_key FROM k WHERE failure_kind IS NULL")
def ingest_decode(s, d):
    good = received.classify(_records(s, d), "events").where("failure_kind is null")
    return good.select("pos", F.lower("idempotency_key").alias("idempotency_key"), fn.entity_key(F.lit(None).cast("string"), F.encode(F.col("user_id").cast("string"), "utf-8")).alias("entity_key"))


@query(sql=f"WITH {_RECORDS}, k AS (SELECT *, {_KIND} AS failure_kind FROM rec) SELECT pos, CASE WHEN row_number() OVER (PARTITION BY idempotency_key ORDER BY pos) > 1 THEN 'DuplicateIdempotencyKey' ELSE 'Inserted' END AS outcome FROM k WHERE failure_kind IS NULL")
def ingest_dedupe(s, d):
    good = received.classify(_records(s, d), "events").where("failure_kind is null").withColumn("message_id", F.col("pos"))
    return received.dedupe(good).select("pos", "outcome")


@query("quarantine", sql="SELECT message_type, expected_topic, failure_kind, count(*) AS n, min(created_s) AS oldest_s FROM quarantine GROUP BY ALL")
def quarantine_summary(s, d):
    return src.quarantine(s, d).groupBy("message_type", "expected_topic", "failure_kind").agg(F.count("*").alias("n"), F.min("created_s").alias("oldest_s"))


@query(sql="SELECT event_id, event_type AS first_value, CAST(user_id AS VARCHAR) AS last_value, event_id % 3 = 0 AS reserved FROM events")
def header_rules(s, d):
    e = src.read(s, d, "events")
    h = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    heads = F.array(h("X-Kind", F.lit(None)), h("X-Kind", F.col("event_type")), h("x-kind", F.lit("late")), h("who", F.lit("early")), h("who", F.col("user_id")))
    names = F.create_map(F.when(F.col("event_id") % 3 == 0, "TideMark-Id").otherwise("id"), F.lit("v"))
    return e.select("event_id", fn.first_wins(heads)["x-kind"].alias("first_value"), fn.last_wins(heads)["who"].alias("last_value"), fn.reserved(names).alias("reserved"))


@query(sql="SELECT event_id, sha256('tidemark:v1' || chr(0) || '{\"id\":' || event_id || ',\"user\":' || user_id || '}') AS idempotency_key FROM events")
def idempotency_key(s, d):
    text = F.concat(F.lit('{"user": '), F.col("user_id"), F.lit(', "id": '), F.col("event_id"), F.lit("}"))
    return src.read(s, d, "events").select("event_id", fn.idempotency_key("tidemark:v1", fn.canonical_json(text)).alias("idempotency_key"))


@query(sql="""WITH b AS (SELECT c_custkey, list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length('events/' || c_custkey) + 1), lambda i: ord(substr('events/' || c_custkey, i, 1))::HUGEINT)) AS l FROM customer),
h AS (SELECT c_custkey, list_reduce(l, lambda a, x: (xor(a, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM b)
SELECT c_custkey, CAST(CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END AS BIGINT) AS lock_key FROM h""")
def fnv_lock_key(s, d):
    return src.read(s, d, "customer").select("c_custkey", fn.fnv1a64(F.concat(F.lit("events/"), F.col("c_custkey").cast("string"))).alias("lock_key"))


@query(sql="SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS entity_key FROM events")
def entity_key_resolution(s, d):
    e = F.col("event_id")
    key = F.when(e % 3 == 0, F.unhex(F.lit("FF"))).otherwise(F.encode(F.col("user_id").cast("string"), "utf-8"))
    return src.read(s, d, "events").select("event_id", fn.entity_key(F.when(e % 2 == 0, F.col("event_type")), key).alias("entity_key"))


# Cache


@query("log", sql="SELECT entity_key, arg_max(payload, pos) AS payload, max(pos) AS applied_pos, arg_max(part, pos) AS part FROM log GROUP BY entity_key")
def cache_state(s, d):
    return cache.current(src.log(s, d))


_SHUFFLED = "(pos * 7919) % 10007"


@query("log", sql=f"SELECT pos, CASE WHEN m IS NULL OR pos > m THEN 'Applied' ELSE 'Ignored' END AS outcome FROM (SELECT pos, max(pos) OVER (PARTITION BY entity_key ORDER BY {_SHUFFLED}, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM log)")
def cache_apply_outcome(s, d):
    # Arrival by the shuffled number, then by pos, as one number.
    return cache.outcomes(src.log(s, d).withColumn("arrival", F.expr(f"cast(({_SHUFFLED}) as bigint) * 1000000000000 + pos")), "arrival").select("pos", "outcome")


@query("log", sql="""SELECT pos, CASE WHEN pos = first THEN 'Applied' WHEN NOT isnew AND news_before > 0 THEN 'Ignored' WHEN NOT isnew THEN 'Applied' WHEN isnew AND news_before = 0 THEN 'Migrated' ELSE 'Applied' END AS outcome FROM (
 SELECT pos, isnew, min(pos) OVER (PARTITION BY entity_key) AS first, coalesce(sum(CASE WHEN isnew THEN 1 ELSE 0 END) OVER (PARTITION BY entity_key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS news_before
 FROM (SELECT *, pos % 5 = 0 AS isnew FROM log))""")
def cache_apply_migration(s, d):
    rows = src.log(s, d).withColumns({"topic": F.when(F.col("pos") % 5 == 0, "events").otherwise("events-old"), "arrival": F.col("pos")})
    return cache.fold(rows, "events").select("pos", "outcome")


@query("log")
def stream_cache_state(s, d):
    from ..sources.scratch import folder
    from ..streaming.cache_stream import run_to_end

    path, root = f"{d}/events.parquet", folder(s, "stream")
    stream = s.readStream.schema(s.read.parquet(path).schema).parquet(f"{d}/events.parque[t]")
    log = stream.select(F.col("user_id").cast("string").alias("entity_key"), F.col("event_id").alias("pos"), F.col("props").alias("payload"), (F.col("user_id") % 4).cast("int").alias("part"))
    return run_to_end(s, log, root).select("entity_key", "payload", "applied_pos", "part")


SQL["stream_cache_state"] = SQL["cache_state"]


@query("log", sql="SELECT DISTINCT entity_key FROM log WHERE entity_key > '1' ORDER BY entity_key LIMIT 50")
def resync_page(s, d):
    return cache.page(src.log(s, d).select("entity_key").distinct(), "entity_key", "1", 50)


@query("log", sql="SELECT CAST(floor((r - 1) / 50) AS BIGINT) AS page, count(*) AS enqueued, max(entity_key) AS last_key FROM (SELECT entity_key, row_number() OVER (ORDER BY entity_key) AS r FROM (SELECT DISTINCT entity_key FROM log)) GROUP BY 1")
def resync_progress(s, d):
    keys = src.log(s, d).select("entity_key").distinct().withColumn("outcome", F.lit("Enqueue"))
    return resync.progress(keys, 50).select("page", "enqueued", "last_key")


@query(sql="SELECT n_name AS topic, CASE WHEN n_nationkey % 10 = 5 THEN 'PartitionsUndeclared' WHEN n_nationkey % 5 = 0 THEN 'Create' WHEN n_nationkey % 5 = 1 THEN 'PolicyMismatch' WHEN n_nationkey % 10 = 2 THEN 'PartitionDrift' ELSE 'Ok' END AS outcome FROM nation")
def topic_reconcile(s, d):
    key = F.col("n_nationkey")
    n, k = src.read(s, d, "nation"), key % 5
    declared = n.select(F.col("n_name").alias("topic"), F.when(key % 10 < 5, 4).alias("partitions"), F.lit("compact").alias("policy"))
    observed = n.where(k != 0).select(F.col("n_name").alias("topic"), F.when(k == 2, 8).otherwise(4).alias("partitions"), F.when(k == 1, "compact, Delete").otherwise(" Compact,compact").alias("policy"))
    # Two types on one topic declare it twice.
    return cache.reconcile(declared.unionByName(declared.where(k < 3)), observed, "create")


def _availability(s, d):
    products = src.read(s, d, "part").select(F.col("p_partkey").alias("product_id"), (F.col("p_size") * 100).cast("long").alias("on_hand"))
    orders = src.read(s, d, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("long").alias("quantity"), (F.col("l_linestatus") == "F").alias("fulfilled"), "l_orderkey", "l_linenumber")
    return cache.availability(products, orders), orders


_AVAIL = """a AS (SELECT p_partkey AS product_id, CAST(p_size AS BIGINT) * 100 AS on_hand, CAST(coalesce(q, 0) AS BIGINT) AS fulfilled_quantity, CAST(greatest(CAST(p_size AS BIGINT) * 100 - coalesce(q, 0), 0) AS BIGINT) AS available
 FROM part LEFT JOIN (SELECT l_partkey, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem WHERE l_linestatus='F' GROUP BY 1) ON l_partkey=p_partkey)"""


@query(sql=f"WITH {_AVAIL} SELECT * FROM a")
def availability(s, d):
    return _availability(s, d)[0]


@query(sql=f"WITH {_AVAIL} SELECT l_orderkey, l_linenumber, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem JOIN a ON product_id=l_partkey WHERE l_linestatus<>'F' AND available >= CAST(l_quantity AS BIGINT) AND product_id % 10 <> 0")
def order_admission(s, d):
    cached, orders = _availability(s, d)
    cached = cached.select("product_id", "available", F.when(F.col("product_id") % 10 == 0, "Discontinued").otherwise("Available").alias("status"))
    return cache.admit(orders.where("not fulfilled").select("l_orderkey", "l_linenumber", "product_id", "quantity"), cached)


@query(sql="SELECT o_orderkey, o_orderstatus || '>' || (CASE WHEN o_orderkey % 3 = 0 THEN 'F' WHEN o_orderkey % 3 = 1 THEN 'P' ELSE 'O' END) IN ('O>F', 'O>P', 'F>P') AS legal FROM orders")
def legal_transitions(s, d):
    k = F.col("o_orderkey") % 3
    to = F.when(k == 0, "F").when(k == 1, "P").otherwise("O")
    return src.read(s, d, "orders").select("o_orderkey", F.concat("o_orderstatus", F.lit(">"), to).isin("O>F", "O>P", "F>P").alias("legal"))


@query(sql="SELECT event_id FROM events WHERE floor((event_id + 1) * 25 / 1000.0) > floor(event_id * 25 / 1000.0)")
def success_sampler(s, d):
    return src.read(s, d, "events").where(fn.sampled(F.col("event_id") + 1, 25_000)).select("event_id")


@query(sql="SELECT CASE WHEN value <= 0.5 THEN '0.5' WHEN value <= 5.0 THEN '5.0' WHEN value <= 50.0 THEN '50.0' WHEN value <= 500.0 THEN '500.0' ELSE 'inf' END AS le, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_buckets(s, d):
    return src.read(s, d, "events").where("value is not null").groupBy(fn.bucket(F.col("value"), [0.5, 5.0, 50.0, 500.0]).alias("le")).agg(F.count("*").alias("n"))
