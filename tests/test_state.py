"""Typed entities, containment per row, what a service keeps from cycle to cycle, counts from the loops, locks, and times in microseconds."""

import math
import threading

import pytest
from pyspark.sql import functions as F
from tidemark.functions import entities, headers
from tidemark.operators import dispatch, outbox, received
from tidemark.operators.telemetry import Recorder
from tidemark.plans import config, roles, runtime
from tidemark.sources.sinks import CapturingSink
from tidemark.sources.store import Files, Lock, Store
from tidemark.streaming import jobs

U = "67e55044-10b1-426f-9247-bb680e5fe0c8"
GOOD = '{"product_id":"%s","name":"n","price_cents":5,"status":"Available","available":3}' % U


def test_payloads_are_checked_by_type(spark):
    cases = {
        GOOD: 1, GOOD.replace("}", ',"more":[1]}'): 1, GOOD.replace("Available", "Withdrawn"): 1, '["%s","n",5,"Available",3]' % U.upper(): 1, " " + GOOD + "\n": 1, GOOD.replace(U, "{" + U + "}"): 1,
        '["%s","n",5,"Available",3,4]' % U: 0, "[1,2]": 0, '"text"': 0, "7": 0, GOOD + " x": 0, GOOD + GOOD: 0, "1],[2": 0, '1,"y":2': 0, GOOD.replace("5,", '"5",'): 0, GOOD.replace("5,", "5.0,"): 0, GOOD.replace("5,", "5e0,"): 0,
        GOOD.replace('"n"', "null"): 0, GOOD.replace('"name":"n",', ""): 0, GOOD.replace(U, "nope"): 0, GOOD.replace("5,", "9223372036854775808,"): 0, GOOD.replace("5,", "true,"): 0, "null": 0, "": 0, GOOD.replace('"n"', '"n","name":"m"'): 0, GOOD.replace('"n"', "{}"): 0, GOOD[:-1]: 0,
    }
    df = spark.createDataFrame([*cases.items(), (None, 0)], "j string, w int")
    got = df.select("w", entities.PRODUCT.conforms(F.col("j")).cast("int").alias("ok"), entities.PRODUCT.write(entities.PRODUCT.read(F.col("j"))).alias("n"), "j").collect()
    assert [r for r in got if r.w != r.ok] == []
    assert {r.n for r in got if r.w} == {GOOD, GOOD.replace("Available", "Withdrawn")} and all(r.n is None for r in got if not r.w)


def test_nested_lists_and_optional_fields(spark):
    S, K = entities.Struct, entities
    t = entities.Entity("t", "t", S(("k", K.TEXT), ("s", S(("a", K.List(K.INT)), ("b", K.Optional(S(("x", K.DOUBLE)))), ("c", K.BOOL)))), "k")
    cases = {'{"a":[1,2],"c":true}': '{"a":[1,2],"b":null,"c":true}', '{"a":[1,2.5],"c":true}': None, '{"a":[],"b":null,"c":true}': '{"a":[],"b":null,"c":true}', '{"a":[3000000000],"c":true}': None, '{"a":{},"c":true}': None, '{"a":[1],"b":{"x":3},"c":false}': '{"a":[1],"b":{"x":3.0},"c":false}', '{"a":[1],"b":{"x":"3"},"c":false}': None, '{"a":[null],"c":true}': None}
    df = spark.createDataFrame([(f'{{"k":"1","s":{j}}}', w and f'{{"k":"1","s":{w}}}') for j, w in cases.items()], "j string, w string")
    assert [r for r in df.select("j", "w", t.write(t.read(F.col("j"))).alias("n")).collect() if r.w != r.n] == []


def test_registry(spark):
    r = entities.contracts()
    assert r.of_topic("orders") is entities.ORDER and [x.message_type for x in r.types(spark).collect()] == ["order_snapshot", "product_snapshot"]
    assert spark.range(1).select(r.conforms(F.lit("product_snapshot"), F.lit(GOOD)).alias("a"), r.conforms(F.lit("other"), F.lit(GOOD)).alias("b")).first() == (True, False)
    for wrong in (lambda: r.add(entities.PRODUCT), lambda: r.of_topic("x"), lambda: entities.Entity("x", "x", entities.Struct(("a", entities.TEXT)), "b")):
        with pytest.raises((ValueError, LookupError)):
            wrong()


RECEIVED = "message_id long, message_type string, topic string, part int, pos long, entity_key string, payload string, status string, attempts int, created_s long, due_us long, last_failed_s long, kind string"
CACHE = "entity_key string, payload string, topic string, part int, applied_pos long"


def inbox(spark, n):
    rows = spark.createDataFrame([(i, "t", "t", 0, i, f"e{i}", f"p{i}", "Pending", 0, i, None, None, None) for i in range(n)], RECEIVED)
    return rows, spark.createDataFrame([], CACHE), spark.createDataFrame([("t",)], "message_type string")


def test_one_poison_row_of_500_fails_alone(spark):
    calls = []

    def after(rows, ctx):
        calls.append(1)
        ctx.enqueue(rows.select(F.col("message_id").alias("cause"), "payload"))
        return rows.select("message_id", F.when(F.col("message_id") == 321, F.raise_error(F.lit("poison")).cast("string")).alias("failure"))

    got = dispatch.dispatch_due(*inbox(spark, 500)[:2], 1000, 500, inbox(spark, 1)[2], "t", after=after)
    assert got.stats == {"claimed": 500, "processed": 499, "failed": 1, "panicked": 1} and got.panicked == (321,)
    assert len(calls) - 1 <= 2 * math.ceil(math.log2(500)) + 1
    assert got.sent.count() == 499 and got.ledger.where("status = 'Processed'").count() == 499 and got.cache.count() == 499


def test_a_handler_that_always_raises_leaves_rows_for_later(spark):
    def before(rows, ctx):
        raise RuntimeError("deployed wrongly")

    ledger, cached, types = inbox(spark, 40)
    got = dispatch.dispatch_due(ledger, cached, 1000, 40, types, "t", before, reruns=12)
    assert 0 < got.stats["panicked"] == got.stats["claimed"] < 40
    assert got.ledger.where("status = 'Pending'").count() == 40 - got.stats["claimed"] and got.ledger.count() == 40 and got.cache.count() == 0


def test_row_handlers(spark):
    def judge(row):
        if row["payload"] == "p3":
            raise dispatch.Refused("no")
        if row["payload"] == "p4":
            return 1 / 0
        return row["payload"] != "p5"

    got = dispatch.dispatch_due(*inbox(spark, 8)[:2], 1000, 50, inbox(spark, 1)[2], "t", dispatch.by_row(judge))
    assert {r.message_id: r.outcome for r in got.outcomes.collect()} == {0: "Applied", 1: "Applied", 2: "Applied", 3: "no", 4: "HandlerPanicked", 5: "Skipped", 6: "Applied", 7: "Applied"}


def test_backoff_in_microseconds(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(received.backoff(F.lit(0), 0.25, 30, 1.01)) == 0.25 and abs(one(received.backoff(F.lit(400), 1.0, 300, 1.01)) - 1.01**400) < 1e-6
    assert one(received.backoff(F.lit(10**6), 1.0, 300, 2.0)) == 300 and one(received.backoff(F.lit(-5), 1.0, 300, 2.0)) == 1
    rows = inbox(spark, 200)[0].withColumns({"failure": F.lit("Handler"), "terminal": F.lit(False)})
    waits = [r.due_us - 5_500_000 for r in received.settle(rows, 5.5, initial=0.25, jitter=3).collect()]
    assert all(125_000 <= w <= 250_000 for w in waits) and len(set(waits)) > 150
    later = received.settle(rows, 5.5, initial=0.25)
    assert received.due(later, 5.74, 10).count() == 0 and received.due(later, 5.75, 10).count() == 10


class Nowhere:
    def write(self, df, batch_id):
        return None


def service(spark, tmp_path, handler, n, stored, **settings):
    r = roles.Roles().handle_before("t", "t", handler)
    ledger, cached, _ = inbox(spark, n)
    tables = {("received", "t"): ledger, ("cache", "t"): cached}
    if stored:
        for kind, frame in (("received", ledger), ("cache", cached)):
            store = roles.opened(spark, str(tmp_path / "tables"), kind, "t")
            store.add(jobs.shaped(frame, store))
            tables[kind, "t"] = store
    return runtime.Service(r, tables, Nowhere(), config.resolve(settings, env={}), batch=10)


@pytest.mark.parametrize("stored", [False, True])
def test_breaker_counts_different_rows_over_cycles(spark, tmp_path, stored):
    """Rows 0 to 5 and 20 on panic; the limit is 14, so the first streak (6 rows) doesn't trip and the second does, in the cycle that holds its 14th row."""

    def judge(row):
        assert 6 <= row["message_id"] < 20

    s = service(spark, tmp_path, dispatch.by_row(judge), 40, stored, dispatcher={"max_consecutive_panicking_rows": 14}, retry={"initial_backoff": "100s", "max_backoff": "100s"}, observability={"sample_success": 0.3})
    s.cycle(spark, 1000, {"dispatcher"})
    assert len(s.kept["t"].streak) == 0 and s.stats["dispatcher", "t"]["panicked"] == 6
    s.cycle(spark, 1001, {"dispatcher"})
    s.cycle(spark, 1002, {"dispatcher"})
    assert len(s.kept["t"].streak) == 10
    with pytest.raises(runtime.PanicLimit):
        s.cycle(spark, 1003, {"dispatcher"})
    table = s.tables["received", "t"]
    rows = table.rows() if stored else table
    assert {r.status: r["count"] for r in rows.groupBy("status").count().collect()} == {"Processed": 14, "Retryable": 26}
    # floor(14 x 0.3) successes were told, over cycles.
    assert len(s.told) == 4 and s.kept["t"].successes == 14
    counts = {(r.instrument, r.attributes.get("status")): r.value for r in s.recorder.frame(spark).collect()}
    assert counts["scheduler.cycles", None] == 4 and counts["scheduler.errors", None] == 1 and counts["scheduler.rows", "panicked"] == 26 and counts["scheduler.rows", "processed"] == 14
    assert sum(r.n for r in s.recorder.durations(spark).collect()) == 4


def test_one_poison_row_never_trips_the_breaker(spark, tmp_path):
    def judge(row):
        raise KeyError

    s = service(spark, tmp_path, dispatch.by_row(judge), 1, False, dispatcher={"max_consecutive_panicking_rows": 2}, retry={"initial_backoff": "1ms", "max_attempts": 4})
    for k in range(6):
        s.cycle(spark, 1000 + k, {"dispatcher"})
    assert s.tables["received", "t"].first().status == "Failed" and s.kept["t"].streak == {0}


def test_service_on_stores_relays_and_measures(spark, tmp_path):
    def after(rows, ctx):
        ctx.enqueue(rows.select(F.col("message_id").alias("cause"), F.col("message_id").alias("seq"), (F.col("message_id") + 500).alias("message_id"), "entity_key", F.col("entity_key").alias("partition_key"), F.sha2("payload", 256).alias("idempotency_key"), F.create_map().cast("map<string,string>").alias("headers"), "payload"))

    r = roles.Roles().handle("t", "t", after).publish("o", "orders")
    tables = {t: roles.opened(spark, str(tmp_path), *t) for t in r.tables()}
    tables["received", "t"].add(jobs.shaped(inbox(spark, 6)[0], tables["received", "t"]))
    sink = CapturingSink(str(tmp_path / "sent"))
    s = runtime.Service(r, tables, sink, config.resolve({"purge": {"older_than": "10s"}}, env={}), sends="o")
    s.cycle(spark, 1000)
    assert sorted(x.message_id for x in sink.read(spark).collect()) == list(range(500, 506)) and s.stats["relay", "o"].published == 6 and s.stats["purger", "o"].deleted == 0
    assert {(x.status, x.depth) for x in s.stats["metrics", "outbox/o"] if x.depth} == {("Published", 6)} and tables["cache", "t"].rows().count() == 6
    s.cycle(spark, 1020)
    assert s.stats["purger", "o"].deleted == 6 and tables["outbox", "o"].rows().count() == 0 and s.stats["stuck", "t"] == []
    got = {(x.instrument, tuple(sorted(x.attributes.items()))): x.value for x in s.recorder.frame(spark).collect()}
    assert got["publish.records", (("outcome", "published"), ("topic", "orders"))] == 6


RECORDS = "pos long, topic string, payload string, idempotency_key string, message_id long, entity_key string"


def test_ingest_counts_are_disjoint_and_commits_follow(spark, tmp_path):
    key = lambda n: f"{n:064x}"
    rows = [(1, "t", GOOD, key(1), 1, "e"), (2, "t", GOOD, key(1), 2, "e"), (3, "t", "[1,2]", key(3), 3, "e"), (4, "x", GOOD, key(4), 4, "e"), (5, "t", GOOD, key(5), 1, "e"), (6, "t", GOOD, key(6), 6, "e")]
    spark.createDataFrame(rows, RECORDS).coalesce(1).write.parquet(str(tmp_path / "in"))
    recorder, down = Recorder(), [True]

    def crash(n):
        if down:
            down.pop()
            raise OSError("before the commit")

    go = lambda: jobs.run(jobs.ingest(spark.readStream.schema(RECORDS).parquet(str(tmp_path / "in")), str(tmp_path / "r"), "t", entity=entities.PRODUCT, recorder=recorder, before_commit=crash))
    with pytest.raises(Exception, match="before the commit"):
        go()
    go()
    got = {(i, dict(a)["outcome"]): n for (i, a), n in recorder.counts.items()}
    assert got == {("ingest.records", "inserted"): 4, ("ingest.records", "duplicates"): 2, ("ingest.records", "skipped"): 6, ("ingest.errors", "consume"): 1, ("ingest.commits", "inserted"): 2, ("ingest.commits", "duplicates"): 1, ("ingest.commits", "skipped"): 3}
    bad = {r.pos: (r.failure_kind, r.message_type, r.expected_topic, r.payload.decode()) for r in jobs.written(spark, str(tmp_path / "r/quarantine"), jobs.REFUSED).collect()}
    assert bad == {3: ("InvalidPayload", "product_snapshot", "t", "[1,2]"), 4: ("UnexpectedTopic", "product_snapshot", "t", GOOD), 5: ("MessageIdConflict", "product_snapshot", "t", GOOD)}


def test_migrations_side_by_side_apply_once(spark, tmp_path):
    ran, lock = [], threading.Lock()

    def step(name):
        def run(s):
            with lock:
                ran.append(name)

        return run

    log = [roles.Change(k, f"c{k}", "x", run=step(k)) for k in range(1, 4)]
    out = []
    threads = [threading.Thread(target=lambda: out.append(sorted(r.action for r in roles.migrate(spark, log, str(tmp_path / "h")).collect()))) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(ran) == [1, 2, 3] and sorted(out) == [["Applied"] * 3, ["SkippedAlreadyApplied"] * 3]


def test_locks_pass_on(spark, tmp_path):
    files, now = Files(spark, str(tmp_path / "l")), [0.0]
    a, b = (Lock(files, "m", lease=10, clock=lambda: now[0]) for _ in range(2))
    with a:
        assert not b.take()
    assert b.take() and not a.take()
    now[0] = 11.0  # b's holder is gone
    assert a.take() and a.held == 3


def test_child_contexts(spark):
    parent = f"00-{'a' * 32}-{'b' * 16}-00"
    df = spark.createDataFrame([(1, parent, "x=1"), (2, None, None)], "k long, traceparent string, tracestate string")
    trace = F.struct("traceparent", "tracestate")
    got = {r.k: (r.p, r.l) for r in df.select("k", headers.child(trace, "parented", F.col("k").cast("string")).alias("p"), headers.child(trace, "linked", F.col("k").cast("string")).alias("l")).collect()}
    p, linked = got[1]
    assert p.traceparent.startswith(f"00-{'a' * 32}-") and p.traceparent.endswith("-00") and "b" * 16 not in p.traceparent and p.tracestate == "x=1" and p.link is None
    assert not linked.traceparent.startswith(f"00-{'a' * 32}") and linked.link == parent and linked.tracestate is None
    assert got[2][0] == got[2][1] and got[2][0].link is None and len({got[2][0].traceparent, p.traceparent, linked.traceparent}) == 3
    assert spark.range(1).select(*[headers.traceparent(F.lit(x.traceparent)).isNotNull() for x in (p, linked, got[2][0])]).first() == (True, True, True)
    with pytest.raises(ValueError):
        headers.child(trace, "other")


def test_rows_without_status_stay(spark):
    ledger = spark.createDataFrame([(1, "a", 1, None, 0, 0, None, None), (2, "b", 2, "Pending", 0, 0, None, None)], "message_id long, entity_key string, enqueue_order long, status string, attempts int, created_s long, next_attempt_s long, claim_expires_s long")
    sent = spark.createDataFrame([(1, 9, "a", "a", "k", {})], "seq long, message_id long, entity_key string, partition_key string, idempotency_key string, headers map<string,string>")
    acks = spark.createDataFrame([], "message_id long, claim_id string, error string")
    for after, n in ((outbox.claim_into(ledger, 9, 5), 2), (outbox.acknowledge(ledger, acks, 9), 2), (outbox.enqueue(ledger, sent, 9), 3), (outbox.collapse_into(ledger, 9, 5), 2)):
        assert after.count() == n and after.where("status is null").count() == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_keyed_ingest_is_the_sequential_rule(spark, tmp_path, seed):
    """Ids and keys that mix over batches, refused records that come again: as one record after the other would have it."""
    import random

    rng = random.Random(seed)
    keys, ids, want, bad, batches, pos = set(), set(), {}, {}, [], 0
    for _ in range(4):
        rows = []
        for _ in range(12):
            pos += 1
            k, m, topic = (rng.randrange(30), rng.randrange(30), "t") if rng.random() < 0.5 else (100 + (n := rng.randrange(25)), 100 + n, "t" if rng.random() < 0.9 else "x")
            rows.append((pos, topic, "{}", f"{k:064x}", m, "e"))
            if topic == "x":
                bad[pos] = "UnexpectedTopic"
            elif k in keys:
                want[pos] = "DuplicateIdempotencyKey"
            elif m in ids:
                bad[pos] = "MessageIdConflict"
            else:
                want[pos] = "Inserted"
                keys.add(k)
                ids.add(m)
        again = [r for b in batches for r in b if r[0] in bad][:2]
        batches.append(rows + again)
    for rows in batches:
        spark.createDataFrame(rows, RECORDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    recorder, root = Recorder(), str(tmp_path / "r")
    jobs.run(jobs.ingest_keyed(source, root, "t", 10**6, recorder=recorder))
    assert {r.pos for r in jobs.written(spark, f"{root}/received", jobs.STORED).collect()} == {p for p, o in want.items() if o == "Inserted"}
    got = [(r.pos, r.failure_kind) for r in jobs.written(spark, f"{root}/quarantine", jobs.REFUSED).collect()]
    assert sorted(got) == sorted(bad.items())
    assert recorder.counts["ingest.commits", (("outcome", "inserted"), ("topic", "t"))] == list(want.values()).count("Inserted")


def test_keyed_ingest_reads_nothing_stored(spark, tmp_path, monkeypatch):
    """Plain records and their redelivery are settled by state: neither the store nor the quarantine is read, in whatever batch."""
    read = []
    monkeypatch.setattr(jobs, "written", lambda spark, path, *a: read.append(path) or 1 / 0)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for b in range(5):
            rows = [(100 * b + k, "t" if k else "x", "{}", f"{100 * b + k:064x}", 100 * b + k, "e") for k in range(4)] + [(100 * b + 50, "t", "{}", f"{1:064x}", 1, "e")] * (b > 0)
            spark.createDataFrame(rows, RECORDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.run(jobs.ingest_keyed(source, str(tmp_path / "r"), "t", 10**6))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert read == [] and spark.read.parquet(str(tmp_path / "r/received")).count() == 15 and spark.read.parquet(str(tmp_path / "r/quarantine")).count() == 5
