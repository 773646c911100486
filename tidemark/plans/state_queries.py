"""Queries of what loops keep: rows without status, contained handlers, stores, whole quarantine rows, carried trace context, counts from the loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import envelope, headers
from ..operators import dispatch, outbox
from ..operators.telemetry import Recorder
from ..sources import tables as src
from ..sources.scratch import folder
from . import roles
from .loop_queries import _CLAIM, _DECODED, _DUE, _inbox, _wire_records
from .queries import NOW, query


@query("outbox", sql="""SELECT step, count(*) + CASE step WHEN 'enqueue' THEN 25 ELSE 0 END AS n, count(*) FILTER (WHERE message_id % 13 = 0) AS unlabelled FROM outbox, (VALUES ('claim'), ('acknowledge'), ('enqueue'), ('collapse'), ('supersede')) s(step) GROUP BY step""")
def ledger_rows_without_status(s, d):
    """Rows whose status is null pass every rewrite of the ledger."""
    ledger = src.outbox(s, d).withColumn("status", F.when(F.col("message_id") % 13 != 0, F.col("status")))
    acks = ledger.where("status = 'Publishing'").select("message_id", F.lit("none").alias("claim_id"), F.lit(None).cast("string").alias("error"))
    nation = src.read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("seq"), (F.col("n_nationkey") + 10**9).cast("long").alias("message_id"), F.col("n_name").alias("entity_key"), F.col("n_name").alias("partition_key"), F.col("n_name").alias("idempotency_key"), F.create_map().cast("map<string,string>").alias("headers"))
    steps = {"claim": outbox.claim_into(ledger, NOW, 100), "acknowledge": outbox.acknowledge(ledger, acks, NOW), "enqueue": outbox.enqueue(ledger, nation, NOW), "collapse": outbox.collapse_into(ledger, NOW, 100), "supersede": outbox.supersede(ledger)}
    out = None
    for name, after in steps.items():
        one = after.select(F.lit(name).alias("step"), "status")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("step").agg(F.count("*").alias("n"), F.count_if(F.col("status").isNull()).alias("unlabelled"))


def _empty_cache(s):
    return s.createDataFrame([], "entity_key string, payload string, topic string, part int, applied_pos long")


def _types(s):
    return s.createDataFrame([(str(k),) for k in range(8)], "message_type string")


@query("received", sql=f""", {_DUE} SELECT message_id, CASE WHEN message_id % 9 = 8 THEN 'MissingHandler' WHEN message_id % 101 = 0 THEN 'HandlerPanicked' WHEN message_id % 7 = 0 THEN 'too odd' WHEN message_id % 5 = 0 THEN 'Skipped' ELSE 'Applied' END AS outcome FROM led WHERE mine""")
def dispatch_row_handler(s, d):
    """A handler over single rows: what it raises at one of them concerns that row alone."""

    def judge(row):
        if row["message_id"] % 101 == 0:
            raise KeyError(row["message_id"])
        if row["message_id"] % 7 == 0:
            raise dispatch.Refused("too odd")
        return row["message_id"] % 5 != 0

    return dispatch.dispatch_due(_inbox(s, d), _empty_cache(s), NOW, 500, _types(s), "events", dispatch.by_row(judge)).outcomes


@query("received", sql=f""", {_DUE}, x AS (SELECT min(message_id) AS poison FROM led WHERE mine AND message_id % 9 <> 8)
SELECT CASE WHEN NOT mine THEN status WHEN message_id % 9 = 8 OR message_id = poison THEN CASE WHEN attempts + 1 >= 10 THEN 'Failed' ELSE 'Retryable' END ELSE 'Processed' END AS status, count(*) AS n FROM led, x GROUP BY 1""")
def dispatch_poison_row(s, d):
    """One row of 500 that makes a handler over frames raise: it fails alone."""
    poison = dispatch.received.due(_inbox(s, d), NOW, 500).where("message_id % 9 <> 8").agg(F.min("message_id")).first()[0]
    fails = lambda rows, ctx: rows.select("message_id", F.when(F.col("message_id") == poison, F.raise_error(F.lit("poison")).cast("string")).alias("failure"))
    done = dispatch.dispatch_due(_inbox(s, d), _empty_cache(s), NOW, 500, _types(s), "events", after=fails)
    return done.ledger.groupBy("status").agg(F.count("*").alias("n"))


@query("outbox", sql=f""", {_CLAIM} SELECT message_id, CASE WHEN mine THEN 'Published' WHEN old THEN 'Superseded' ELSE status END AS status, CASE WHEN mine THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN mine THEN {NOW} END AS published_s FROM led""")
def store_relay(s, d):
    """A relay cycle on a store of the ledger: the same rows as the rewritten ledger, from two small deltas."""
    from ..sources.sinks import FileSink
    from ..sources.store import Store
    from ..streaming.jobs import relay, shaped

    root = folder(s, "store")
    store = Store(s, root, roles.LEDGERS["outbox"], order="enqueue_order")
    store.add(shaped(src.outbox(s, d), store))
    relay(store, FileSink(f"{root}-sent"), NOW, 100)
    return store.rows().select("message_id", "status", "attempts", "published_s")


def _ingested(s, d, recorder=None):
    """All wire records through decoding and the ingest stream."""
    from ..streaming.jobs import ingest, run

    root = folder(s, "wire")
    rows = _wire_records(s, d)
    rows.coalesce(1).write.parquet(f"{root}/inbox")
    decoded = envelope.decode(s.readStream.schema(rows.schema).parquet(f"{root}/inbox"), "events")
    run(ingest(decoded, root, "events", max_skips=10**9, recorder=recorder, now_us=lambda: NOW * 1_000_000))
    return root


@query(sql=f"""WITH {_DECODED} SELECT topic, CAST(e % 4 AS INTEGER) AS part, pos, CAST(user_id AS VARCHAR) AS record_key, CASE WHEN e % 19 = 0 THEN NULL WHEN e % 23 = 0 THEN '{{broken' ELSE props END AS payload, failure_kind, 'events' AS expected_topic, {NOW}000000 AS created_us,
 2 + CASE WHEN e % 29 = 0 THEN 0 ELSE 1 END + CASE WHEN e % 37 = 0 OR e % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN e % 41 = 1 OR e % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN e % 43 = 1 OR e % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN e % 47 = 1 OR e % 4 = 0 THEN 1 ELSE 0 END + CASE e % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS headers,
 CASE failure_kind WHEN 'UnexpectedTopic' THEN 'the record is on another topic' WHEN 'MissingPayload' THEN 'the record has no payload' WHEN 'InvalidPayload' THEN 'the payload isn''t what the entity declares' WHEN 'MissingIdempotencyKey' THEN 'the record has no idempotency key' ELSE 'header ' || failure_header || ' isn''t well formed' END AS error
FROM c WHERE failure_kind IS NOT NULL""")
def quarantine_rows(s, d):
    """Refused records as they were: key, headers, bytes, and why."""
    from ..streaming.jobs import REFUSED, written

    rows = written(s, f"{_ingested(s, d)}/quarantine", REFUSED)
    return rows.select("topic", "part", "pos", F.col("record_key").cast("string").alias("record_key"), F.col("payload").cast("string").alias("payload"), "failure_kind", "expected_topic", "created_us", F.size("headers").alias("headers"), "error")


@query(sql=f"""WITH {_DECODED}, k AS (SELECT *, '00-' || md5(CAST(e AS VARCHAR)) || '-' || substr(md5('s' || e), 1, 16) || '-00' AS parent, sha256('dispatch/' || e) AS h FROM c WHERE failure_kind IS NULL)
SELECT pos, CASE WHEN e % 6 = 0 THEN parent END AS traceparent, CASE WHEN e % 6 = 0 THEN 'a=1' END AS tracestate, CASE WHEN e % 6 = 0 THEN '00-' || substr(parent, 4, 32) || '-' || substr(h, 1, 16) || '-00' ELSE '00-' || substr(h, 33, 32) || '-' || substr(h, 1, 16) || '-01' END AS parented,
 '00-' || substr(h, 33, 32) || '-' || substr(h, 1, 16) || CASE WHEN e % 6 = 0 THEN '-00' ELSE '-01' END AS linked, CASE WHEN e % 6 = 0 THEN parent END AS link, e % 4 = 0 AS caused FROM k""")
def trace_handoff(s, d):
    """Trace context from the record to the stored row, and the contexts of the step that handles it, parented and linked."""
    from ..streaming.jobs import STORED, written

    rows = written(s, f"{_ingested(s, d)}/received", STORED)
    trace, of = F.struct("traceparent", "tracestate"), [F.lit("dispatch"), F.col("pos").cast("string")]
    linked = headers.child(trace, "linked", *of)
    return rows.select("pos", "traceparent", "tracestate", headers.child(trace, "parented", *of)["traceparent"].alias("parented"), linked["traceparent"].alias("linked"), linked["link"].alias("link"), F.col("causation_id").isNotNull().alias("caused"))


@query(sql=f"""WITH {_DECODED}, t AS (SELECT count(*) FILTER (WHERE failure_kind IS NULL) AS inserted, count(*) FILTER (WHERE failure_kind IS NOT NULL) AS skipped FROM c)
SELECT i AS instrument, 'events' AS topic, 'inserted' AS outcome, inserted AS value FROM t, (VALUES ('ingest.records'), ('ingest.commits')) v(i) UNION ALL SELECT i, 'events', 'skipped', skipped FROM t, (VALUES ('ingest.records'), ('ingest.commits')) v(i)""")
def ingest_recorded(s, d):
    """What the ingest loop reports by itself: records when they are classified, commits when the batch is done."""
    recorder = Recorder()
    _ingested(s, d, recorder)
    return recorder.frame(s).select("instrument", F.col("attributes")["topic"].alias("topic"), F.col("attributes")["outcome"].alias("outcome"), "value")
