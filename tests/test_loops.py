"""Streams, resync, roles, configuration, text and header rules in small defined cases."""

import random

import pytest
from pyspark.sql import functions as F
from tidemark.functions import envelope, headers, text, times
from tidemark.operators import admin, cache, dispatch, outbox, received, recovery, resync
from tidemark.plans import config, roles, runtime
from tidemark.sources.sinks import CapturingSink, FileSink
from tidemark.streaming import jobs


def one(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


@pytest.mark.parametrize("seed", range(3))
def test_exact_dedupe_is_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"m{rng.randrange(25)}", f"k{rng.randrange(25)}") for i in range(120)]
    keys, ids, want = set(), set(), {}
    for pos, m, k in rows:
        want[pos] = "DuplicateIdempotencyKey" if k in keys else "MessageIdConflict" if m in ids else "Inserted"
        if want[pos] == "Inserted":
            keys.add(k)
            ids.add(m)
    df = spark.createDataFrame(rows, "pos long, message_id string, idempotency_key string").repartition(3)
    assert {r.pos: r.outcome for r in received.dedupe_exact(df).collect()} == want
    assert received.dedupe_exact(df.limit(0)).count() == 0


RECORDS = "pos long, topic string, payload string, idempotency_key string, message_id long, entity_key string"


def source(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def key(n):
    return f"{n:064x}"


def test_ingest_stream(spark, tmp_path):
    good = lambda pos, k, m: (pos, "t", "{}", key(k), m, "e")
    batches = [[good(1, 1, 1), good(2, 1, 2), (3, "t", "{broken", key(3), 3, "e")], [good(4, 1, 9), good(5, 5, 1), good(6, 5, 6), good(7, 7, 1)]]
    root = str(tmp_path / "r")
    jobs.run(jobs.ingest(source(spark, str(tmp_path / "in"), batches, RECORDS), root, "t"))
    assert sorted(r.pos for r in jobs.written(spark, f"{root}/received", jobs.STORED).collect()) == [1, 6]
    got = {r.pos: r.failure_kind for r in jobs.written(spark, f"{root}/quarantine", jobs.REFUSED).collect()}
    assert got == {3: "InvalidPayload", 5: "MessageIdConflict", 7: "MessageIdConflict"}


def test_ingest_breaker_stops_before_the_commit(spark, tmp_path):
    rows = [(i, "other", "{}", key(i), i, "e") for i in range(3)]
    root = str(tmp_path / "r")
    with pytest.raises(Exception, match="in a row refused"):
        jobs.run(jobs.ingest(source(spark, str(tmp_path / "in"), [rows], RECORDS), root, "t", max_skips=3))
    assert jobs.written(spark, f"{root}/quarantine", jobs.REFUSED).count() == 3


def test_dispatch_stream_with_handlers(spark, tmp_path):
    schema = "entity_key string, payload string, topic string, part int, pos long, arrival long"
    batches = [[("a", "1", "t", 0, 5, 1), ("b", "1", "t", 0, 1, 2)], [("a", "0", "t", 0, 4, 3), ("a", "2", "t", 0, 6, 4), ("b", "no", "t", 0, 9, 5), ("b", "x", "t", 1, 10, 6)]]
    root, seen = str(tmp_path / "r"), []
    before = lambda df: df.withColumn("go", (F.col("payload") != "no") | F.col("previous").isNull())
    jobs.run(jobs.dispatch(source(spark, str(tmp_path / "in"), batches, schema), root, "t", before, lambda df, n: seen.extend((n, r.entity_key, r.pos) for r in df.collect())))
    assert sorted((r.entity_key, r.payload, r.applied_pos) for r in jobs.cached(spark, root).collect()) == [("a", "2", 6), ("b", "1", 1)]
    assert sorted((r.arrival, r.outcome) for r in spark.read.parquet(f"{root}/outcomes").collect()) == [(1, "Applied"), (2, "Applied"), (3, "Ignored"), (4, "Applied"), (5, "Skipped"), (6, "CacheOriginMismatch")]
    assert sorted(seen) == [(0, "a", 5), (0, "b", 1), (1, "a", 6)]


LEDGER = "message_id long, entity_key string, enqueue_order long, status string, attempts int, created_s long, next_attempt_s long, claim_expires_s long"
MESSAGES = "seq long, message_id long, entity_key string, partition_key string, idempotency_key string, headers map<string,string>"


def test_enqueue_and_relay(spark, tmp_path):
    ledger = spark.createDataFrame([(1, "a", 1, "Pending", 0, 0, None, None), (2, "b", 2, "Publishing", 1, 0, None, 500)], LEDGER)
    sent = spark.createDataFrame([(1, 10, "a", "a", "k", {}), (2, 11, "a", "p", "k2", None), (3, 12, "c", "c", None, {}), (4, 13, "d", "d", "k4", {"TIDEMARK-x": "1"})], MESSAGES)
    out = outbox.enqueue(ledger, sent, 100)
    assert {r.message_id: (r.status, r.enqueue_order) for r in out.collect()} == {1: ("Superseded", 1), 2: ("Publishing", 2), 10: ("Superseded", 3), 11: ("Pending", 4), 12: ("Failed", 5)}
    assert {r.message_id: r["headers"] for r in out.where("message_id >= 10").collect()}[11] == {"tidemark-entity-key": "a"}
    sink = FileSink(str(tmp_path / "sent"))
    done, total = jobs.drain(out, sink, 100, limit=1)
    assert total == jobs.RelayStats(1, 1)
    assert {r.message_id: r.status for r in done.collect()} == {1: "Superseded", 2: "Publishing", 10: "Superseded", 11: "Published", 12: "Failed"}
    assert [r.message_id for r in sink.read(spark).collect()] == [11]

    class Down:
        def write(self, df, batch_id):
            raise OSError("down")

    failed, stats = jobs.relay(out, Down(), 100)
    row = failed.where("message_id = 11").first()
    assert (stats, row.status, row.last_error, row.next_attempt_s, row.claim_expires_s, row.attempts) == (jobs.RelayStats(1, 0, 1), "Pending", "down", 101, None, 1)
    with pytest.raises(ValueError):
        outbox.redrive(ledger)


def test_relay_takes_only_its_own_claim_and_settles_rows_one_by_one(spark, tmp_path):
    rows = [(i, f"e{i}", i, "Pending", 0, 0, None, None) for i in range(1, 6)]
    ledger = outbox.claim_into(spark.createDataFrame(rows, LEDGER), 100, 2, claim_id="other", worker="w2")
    sink = CapturingSink(str(tmp_path / "sent"))

    class Poisoned:
        def write(self, df, batch_id):
            sink.write(df.where("message_id <> 4"), batch_id)
            return df.where("message_id = 4").selectExpr("message_id", "'too large' as error")

    # While rows are sent, somebody takes row 5 over.
    stolen = lambda df: df.withColumn("claim_id", F.when(F.col("message_id") == 5, "thief").otherwise(F.col("claim_id"))).where("message_id <> 3")
    after, stats = jobs.relay(ledger, Poisoned(), 100, limit=10, worker="w1", meanwhile=stolen)
    assert stats == jobs.RelayStats(3, 0, 1, 1, 1)
    assert sorted((r.message_id, r.offset) for r in sink.read(spark).collect()) == [(3, 0), (5, 1)]
    got = {r.message_id: (r.status, r.claim_id, r.last_error) for r in after.collect()}
    assert got == {1: ("Publishing", "other", None), 2: ("Publishing", "other", None), 4: ("Pending", None, "too large"), 5: ("Publishing", "thief", None)}


RECEIVED = "message_id long, message_type string, topic string, part int, pos long, entity_key string, payload string, status string, attempts int, created_s long, due_s long, last_failed_s long, kind string"
CACHE = "entity_key string, payload string, topic string, part int, applied_pos long"


def due_rows(spark):
    row = lambda i, e, pos, payload, part=0, **kw: (i, kw.get("type", "t"), "t", part, pos, e, payload, kw.get("status", "Pending"), kw.get("attempts", 0), i, kw.get("due"), None, None)
    rows = [row(1, "a", 5, "a5"), row(2, "a", 6, "bad"), row(3, "a", 6, "a6"), row(4, "b", 1, "b1", part=1), row(5, "c", 1, "c1", type="x"), row(6, None, 1, "n"), row(7, "d", 2, "skip"), row(8, "e", 1, "e1", status="Retryable", due=999), row(9, "f", 1, "f1", status="Retryable", due=1, attempts=9)]
    cached = spark.createDataFrame([("b", "b0", "t", 0, 0), ("d", "d0", "t", 0, 1), ("f", "f9", "t", 0, 9)], CACHE)
    return spark.createDataFrame(rows, RECEIVED), cached, spark.createDataFrame([("t",)], "message_type string")


def test_dispatch_of_due_rows(spark):
    ledger, cached, types = due_rows(spark)
    before = lambda rows, ctx: rows.withColumns({"go": F.col("payload") != "skip", "failure": F.lit(None).cast("string")})

    def after(rows, ctx):
        ctx.enqueue(rows.select(F.col("message_id").alias("cause"), F.concat("payload", F.lit("!")).alias("payload")))
        return rows.where("payload = 'bad'").select("message_id", F.lit("no").alias("failure"))

    got = dispatch.dispatch_due(ledger, cached, 100, 50, types, "t", before, after)
    assert {r.message_id: r.outcome for r in got.outcomes.collect()} == {1: "Applied", 2: "no", 3: "Applied", 4: "CacheOriginMismatch", 5: "MissingHandler", 6: "MissingEntityKey", 7: "Skipped", 9: "Ignored"}
    rows = {r.message_id: (r.status, r.attempts, r.kind, r.due_s) for r in got.ledger.collect()}
    assert rows == {
        1: ("Processed", 0, None, None), 2: ("Retryable", 1, "Handler", 101), 3: ("Processed", 0, None, None), 4: ("Failed", 1, "CacheOriginMismatch", None), 5: ("Retryable", 1, "MissingHandler", 101),
        6: ("Failed", 1, "MissingEntityKey", None), 7: ("Processed", 0, None, None), 8: ("Retryable", 0, None, 999), 9: ("Processed", 9, None, None),
    }
    assert {(r.entity_key, r.payload, r.applied_pos) for r in got.cache.collect()} == {("a", "a6", 6), ("b", "b0", 0), ("d", "d0", 1), ("f", "f9", 9)}
    assert sorted(r.payload for r in got.sent.collect()) == ["a5!", "a6!"]
    assert got.stats == {"claimed": 8, "processed": 4, "failed": 4, "panicked": 0}


def test_dispatch_contains_panics_and_hooks(spark):
    ledger, cached, types = due_rows(spark)
    got = dispatch.dispatch_due(ledger, cached, 100, 50, types, "t", dispatch.fault("panic", F.col("payload") == "a5"), jitter=3)
    # Row 1 panics alone; the other failures are a mismatch, a type without handler and a row without entity.
    assert got.stats == {"claimed": 8, "processed": 4, "failed": 4, "panicked": 1} and got.panicked == (1,)
    assert {r.message_id: r.status for r in got.ledger.where("message_id in (1, 2, 3, 7, 9)").collect()} == {1: "Retryable", 2: "Processed", 3: "Processed", 7: "Processed", 9: "Processed"}
    assert {(r.entity_key, r.payload) for r in got.cache.where("entity_key = 'a'").collect()} == {("a", "bad")}
    late = lambda rows, ctx: rows.select("message_id", F.raise_error(F.lit("late")).cast("string").alias("failure"))
    assert dispatch.dispatch_due(ledger, cached, 100, 1, types, "t", after=late).stats["panicked"] == 1
    for kind, n in (("off", 0), ("error", 1), ("constraint", 1)):
        assert dispatch.dispatch_due(ledger, cached, 100, 1, types, "t", dispatch.fault(kind, F.col("payload") == "a5")).stats["failed"] == n

    def stop():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        dispatch.dispatch_due(ledger, cached, 100, 1, types, "t", hooks=dispatch.Hooks(before_record=stop))


def test_ingest_breaker_counts_over_batches(spark, tmp_path):
    bad = lambda i: (i, "other", "{}", key(i), i, "e")
    batches = [[bad(1), bad(2)], [bad(3)], [(4, "t", "{}", key(4), 4, "e"), bad(5)], [bad(6), bad(7), bad(8)]]
    root = str(tmp_path / "r")
    jobs.run(jobs.ingest(source(spark, str(tmp_path / "in"), batches[:3], RECORDS), root, "t", max_skips=4))
    spark.createDataFrame(batches[3], RECORDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="limit of 4 was met at 8"):
        jobs.run(jobs.ingest(spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), root, "t", max_skips=4))


def test_dispatch_stream_keeps_whole_copies_of_the_cache(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT", 2)
    schema = "entity_key string, payload string, topic string, part int, pos long, arrival long"
    batches = [[(f"e{k}", f"v{k}", "t", 0, k, k), ("all", f"v{k}", "t", 0, k, 100 + k)] for k in range(5)]
    root = str(tmp_path / "r")
    jobs.run(jobs.dispatch(source(spark, str(tmp_path / "in"), batches, schema), root, "t"))
    want = {(f"e{k}", f"v{k}") for k in range(5)} | {("all", "v4")}
    assert {(r.entity_key, r.payload) for r in jobs.cached(spark, root).collect()} == want
    assert {r.batch for r in jobs.written(spark, f"{root}/snapshot", jobs.MOVED).where("batch >= 0").select("batch").distinct().collect()} == {1, 3}
    assert {r.payload for r in jobs.cached(spark, root, 3).where("entity_key = 'all'").collect()} == {"v2"}


class Source:
    def __init__(self, name, spark, keys, states):
        self.name, self.all = name, spark.createDataFrame([(k,) for k in keys], "entity_key string")
        self.states = spark.createDataFrame([(k, p, 1000 + i, k, f"key-{k}", {}, "{}") for i, (k, p) in enumerate(states)], "entity_key string, payload_key string, message_id long, partition_key string, idempotency_key string, headers map<string,string>, payload string")

    def keys(self, after):
        return self.all if after is None else self.all.where(F.col("entity_key") > after)

    def load(self, keys):
        return self.states.join(keys, "entity_key", "left_semi")


def test_recovery(spark):
    good = Source("good", spark, "abcde", [(k, k) for k in "abde"])
    bad = Source("bad", spark, "uvwxyz", [(k, "other" if k == "x" else k) for k in "uvwxyz"])
    last = Source("last", spark, "q", [("q", "q")])
    ledger = spark.createDataFrame([(1, "a", 1, "Pending", 0, 0, None, None)], LEDGER)
    out, report = recovery.Recovery(good, bad, last).run(ledger, 9, recovery.Request(page=2))
    assert [tuple(r) for r in recovery.Recovery.table(spark, report).collect()] == [("good", "Done", 3, 4, 1, "e"), ("bad", "Failed", 2, 3, 0, "w")]
    assert {r.entity_key for r in out.where("status = 'Pending'").collect()} == set("abdeuvw") and out.where("message_id = 1").first().status == "Superseded"
    bad.states = bad.states.withColumn("payload_key", F.col("entity_key"))
    out, again = recovery.Recovery(good, bad, last).run(out, 9, recovery.resumed(recovery.Request(page=2), report[-1]))
    assert again == [recovery.Outcome("bad", "Done", 2, 3, 0, "z")] and out.where("status = 'Pending'").count() == 10
    for wrong in (lambda: recovery.Recovery(), lambda: recovery.Recovery(good, good), lambda: recovery.Recovery(good).check(recovery.Request(("x",))), lambda: recovery.Recovery(good, bad).check(recovery.Request(after="a")), lambda: recovery.Recovery(good).check(recovery.Request(page=0)), lambda: recovery.redrive(ledger, recovery.Request(max_rows=0))):
        with pytest.raises(ValueError):
            wrong()


def test_topics_converge(spark):
    declared = spark.createDataFrame([("a", 4, "compact"), ("b", 4, "compact"), ("a", 4, "compact")], "topic string, partitions int, policy string")
    seen = spark.createDataFrame([("b", 8, "COMPACT")], declared.schema)
    made = []

    def create(new):
        made.extend(r.topic for r in new.collect())
        return new.withColumn("partitions", F.lit(3))

    assert {r.topic: r.outcome for r in cache.converge(declared, seen, "create", create).collect()} == {"a": "PartitionDrift", "b": "PartitionDrift"} and made == ["a"]
    assert {r.outcome for r in cache.converge(declared, seen, "off").collect()} == {"Skipped"}
    for wrong in (lambda: cache.converge(declared, seen, "verify"), lambda: cache.converge(declared.withColumn("partitions", F.lit(None).cast("int")), seen, "create", create), lambda: cache.converge(declared, declared.withColumn("policy", F.lit("delete")), "create", create)):
        with pytest.raises(ValueError):
            wrong()


def test_times_and_ids(spark):
    cases = {"2024-01-31T00:00:00Z": 1706659200000000, "2024-01-31T00:00:00.25Z[UTC]": 1706659200250000, "2024-01-31t02:00:00.1234567+02:00[Europe/Paris]": 1706659200123456, "2024-01-30T00:30:00-23:30": 1706659200000000, "2024-01-31 00:00:00Z": None, "2024-02-30T00:00:00Z": None, "2024-01-31T00:00:00": None, "": None, "x": None}
    assert one(spark, *[times.parse(F.lit(v)) for v in cases]) == list(cases.values())
    assert one(spark, *[times.render(F.lit(v)) for v in (1706659200250000, 0, -1, 1706659200000000)]) == ["2024-01-31T00:00:00.25Z[UTC]", "1970-01-01T00:00:00Z[UTC]", "1969-12-31T23:59:59.999999Z[UTC]", "2024-01-31T00:00:00Z[UTC]"]
    u = "67e55044-10b1-426f-9247-bb680e5fe0c8"
    forms = [u, u.upper(), u.replace("-", ""), "{" + u + "}", "urn:uuid:" + u]
    assert one(spark, *[envelope.uuid(F.lit(v)) for v in [*forms, u[:-1], "{" + u, ""]]) == [u] * 5 + [None] * 3


def test_resync(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "entity_key string")
    facts = "entity_key string, payload_key string, payload string, message_id long, partition_key string, idempotency_key string, headers map<string,string>"
    states = spark.createDataFrame([("a", "a", "{}", 5, "a", "k", {}), ("c", "c", "{}", 6, "c", "k2", {})], facts)
    rows = resync.loaded(keys, states, "a")
    assert resync.summary(rows, "a").first() == (1, 1, "c")
    assert resync.summary(rows.limit(0), "a").first() == (0, 0, "a")
    ledger = spark.createDataFrame([(1, "a", 1, "Pending", 0, 0, None, None)], LEDGER)
    assert {r.message_id: r.status for r in resync.republish(ledger, keys, states, 9).collect()} == {1: "Superseded", 5: "Pending", 6: "Pending"}
    with pytest.raises(ValueError):
        resync.republish(ledger, keys, states.withColumn("payload_key", F.lit("z")), 9)
    resync.check_page(["a", "b"], None, 2)
    for page, cursor in ((["b", "a"], None), (["a"], "a"), (["a", "b", "c"], None)):
        with pytest.raises(ValueError):
            resync.check_page(page, cursor, 2)


def test_trace_rules(spark):
    ids = f"{'1' * 32}-{'2' * 16}-01"
    good = [f"00-{ids}", f"01-{ids}", f"01-{ids}-aa", f"cc-{ids}" + "-x" * 12]
    bad = [f"00-{ids}-aa", f"ff-{ids}", f"01-{ids}-", f"01-{ids}-aa-", f"cc-{ids}" + "-x" * 13, f"00-{'0' * 32}-{'2' * 16}-01", f"00-{ids.replace('1', 'A')}", "", f"00-{ids}\n"]
    assert one(spark, *[headers.traceparent(F.lit(v)) for v in good + bad]) == good + [None] * len(bad)
    long = ",".join(f"k{i}=v" for i in range(40))
    cases = {"a=1": "a=1", " a=1 ,, b@c=2\t": "a=1,b@c=2", "a=1,a=2": None, "A=1": None, "1a@v=x": "1a@v=x", "1a=x": None, "a@b@c=1": None, "a=": None, "a=b=c": None, "": None, ",": None, long: ",".join(long.split(",")[:32]), long + ",k3=v": None, "a=" + "v" * 257: None, "x=" + "v" * 2050: None}
    assert one(spark, *[headers.tracestate(F.lit(v)) for v in cases]) == list(cases.values())


def test_text_rules(spark):
    for t in ("short", "x" * 512, "é" * 300, "a" + "é" * 300, "𝄞" * 200, "aa" + "𝄞" * 200):
        raw = t.encode()
        want = t if len(raw) <= 512 else raw[:512].decode(errors="ignore") + "..."
        assert one(spark, text.bounded_text(F.lit(t)))[0] == want
    assert one(spark, *[text.duration_ms(F.lit(v)) for v in ("250ms", " 30s ", "0s", "1w", "-1s", "5", "", "99999999999999999999d")]) == [250, 30000, 0, None, None, None, None, None]
    assert one(spark, *[text.prefix_ok(F.lit(v)) for v in ("", "dev-", "a.", "a", "-", ".a.", "Dev-")]) == [True, True, True, False, False, False, False]


def test_roles_and_change_log(spark, tmp_path):
    r = roles.Roles().publish("order", "orders").cache("product", "products").publish("product", "products").handle_before("event", "events", len).handle("event", "events", len)
    assert r.tables() == [("received", "event"), ("cache", "event"), ("outbox", "order"), ("outbox", "product"), ("received", "product"), ("cache", "product")]
    assert r.subsystems({"relay"}) == [("relay", "order"), ("relay", "product")]
    for wrong in (lambda: r.cache("event", "events"), lambda: r.handle("product", "products", len), lambda: r.handle("event", "events", len), lambda: r.publish("order", "other"), lambda: r.subsystems({"x"})):
        with pytest.raises(ValueError):
            wrong()
    log = roles.change_log(r.tables())
    assert len(log) == 7 and len({c.version for c in log}) == 7
    with pytest.raises(ValueError):
        roles.change_log(r.tables(), band_of=lambda k, n: 7)
    extra = [*log, roles.Change(log[-1].version + 1, "only here", "x", frozenset({"prod"}))]
    path = str(tmp_path / "history")
    assert {a.action for a in roles.migrate(spark, extra, path).collect()} == {"Applied", "SkippedContext"}
    again = {a.version: a.action for a in roles.migrate(spark, extra, path, {"prod"}).collect()}
    assert list(again.values()).count("SkippedAlreadyApplied") == 7 and again[extra[-1].version] == "Applied"
    changed = [roles.Change(1, "init", "another"), *extra[1:]]
    history = spark.createDataFrame([(c.version, c.checksum) for c in extra], "version long, checksum string")
    assert roles.dry_run(spark, changed, history, {"prod"}).where("action = 'ChecksumMismatch'").count() == 1
    with pytest.raises(ValueError):
        roles.migrate(spark, changed, path)


def test_change_log_makes_ledgers_and_replays_once(spark, tmp_path):
    root, history = str(tmp_path / "tables"), str(tmp_path / "history")
    log = roles.change_log([("received", "event"), ("outbox", "order"), ("cache", "event")], root=root)
    roles.migrate(spark, log, history)
    path = roles.ledger_path(root, "received", "event")
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(roles.ledger_path(root, "outbox", "order")).columns[0] == "message_id"
    rows = spark.createDataFrame([(i, "Failed", 3, i) for i in range(4)], "message_id long, status string, attempts int, created_s long")
    rows.withColumns({c: F.lit(None).cast(t) for c, t in (f.split(" ") for f in roles.LEDGERS["received"].split(", ")) if c not in rows.columns}).select(*spark.read.parquet(path).columns).write.mode("append").parquet(path)
    replay = roles.replay(log[-1].version + 1, "replay of May", path, 3, frozenset({"prod"}))
    assert {r.action for r in roles.dry_run(spark, [*log, replay], spark.createDataFrame([], "version long, checksum string"), {"prod"}).collect()} == {"WouldApply"}
    roles.migrate(spark, [*log, replay], history)
    assert spark.read.parquet(path).where("status = 'Failed'").count() == 4
    roles.migrate(spark, [*log, replay], history, {"prod"})
    assert spark.read.parquet(path).where("status = 'Failed'").count() == 1
    roles.migrate(spark, [*log, replay], history, {"prod"})
    assert spark.read.parquet(path).where("status = 'Failed'").count() == 1
    with pytest.raises(ValueError):
        roles.replay(1, "x", path, 10_001)


def test_service_runs_its_roles(spark, tmp_path):
    """Events are dispatched to a handler that sends orders, which the next loop of the same cycle relays."""
    ledger, cached, _ = due_rows(spark)

    def handle(rows, ctx):
        assert set(ctx.caches) == {"t"}
        ctx.enqueue(rows.select(F.col("message_id").alias("cause"), F.col("message_id").alias("seq"), (F.col("message_id") + 500).alias("message_id"), "entity_key", F.col("entity_key").alias("partition_key"), F.sha2("payload", 256).alias("idempotency_key"), F.create_map().cast("map<string,string>").alias("headers")))

    r = roles.Roles().handle("t", "t", handle).publish("order", "orders")
    old = spark.createDataFrame([(1, "z", 1, "Published", 1, 0, None, None), (2, "y", 2, "Published", 1, 950, None, None)], LEDGER)
    config_ = config.resolve({"purge": {"older_than": "100s"}}, env={})
    sink = CapturingSink(str(tmp_path / "sent"))
    with pytest.raises(LookupError):
        runtime.Service(r, {}, sink, config_)
    service = runtime.Service(r, {("received", "t"): ledger, ("cache", "t"): cached, ("outbox", "order"): old}, sink, config_, sends="order")
    service.cycle(spark, 1000)
    assert service.stats["dispatcher", "t"]["processed"] == 6 and service.stats["relay", "order"].published == 3 and service.stats["purger", "order"].deleted == 1
    assert {x.message_id: x.status for x in service.tables["outbox", "order"].collect()} == {2: "Published", 501: "Superseded", 502: "Published", 507: "Published", 508: "Published"}
    assert sorted(x.message_id for x in sink.read(spark).collect()) == [502, 507, 508]
    service.cycle(spark, 1001, {"relay"})
    assert service.stats["relay", "order"].claimed == 0


def test_configuration(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "app.toml").write_text('[retry]\nmax_attempts = 3\n[retry.overrides.order]\ninitial_backoff = "5s"\n[topics]\nprefix = "dev-"\n[app]\nport = 80\n')
    c = config.load(config.discover("app.toml", tmp_path / "a"), required={"app.port": int}, env={})
    assert (c.policy("retry", "order").initial_backoff, c.policy("retry", "order").max_attempts, c.policy("retry", "x").initial_backoff, c.topic_prefix) == (5, 3, 1, "dev-")
    assert config.resolve({}, env={"TIDEMARK_TOPIC_PREFIX": "ci."}).topic_prefix == "ci."
    bad = {"retry": {"max_attempts": 0, "initial_backoff": "0s", "multiplier": 0.5, "what": 1}, "relay": {"lease_for": "x"}, "recovery": {"max_redrive_rows": 10_001}, "observability": {"sample_success": 2.0}, "topics": {"prefix": "Dev"}}
    with pytest.raises(config.ConfigErrors) as e:
        config.resolve(bad, required={"app.port": int}, env={})
    assert {k for k, _ in e.value.issues} == {"retry.max_attempts", "retry.initial_backoff", "retry.multiplier", "retry.what", "relay.lease_for", "recovery.max_redrive_rows", "observability.sample_success", "topics.prefix", "app.port"}


def test_admin(spark):
    with pytest.raises(LookupError):
        admin.require(["a", "b"], {"a": None}, {})
    rows = spark.createDataFrame([("s", "t", "Usable"), ("s", "u", "Missing")], "schema string, `table` string, access string")
    assert admin.readiness(rows).first() == (False, ["s.u"])
    assert admin.readiness(rows.limit(0)).first() == (True, [])
