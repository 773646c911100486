"""Golden values and models of the changelog engine."""

import random

import pytest
from pyspark.sql import functions as F
from tidemark.functions import identity as fn
from tidemark.operators import cache, outbox, received


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_pinned_digest(spark):
    for text in ('{"a":1,"b":2}', '{"b": 2, "a": 1}'):
        assert one(spark, fn.idempotency_key("tidemark:test:v1", fn.canonical_json(F.lit(text))))[0] == "d43f2a385b8854b4d41134a411b4c551fb75a4a03851a93b8db0ee0fc4b605b6"


def test_backoff_and_exhaustion(spark):
    got = one(spark, *[received.backoff(F.lit(a), 1.0, 8.0) for a in (0, 1, 2, 3, 60, 5000)])
    assert list(got) == [1, 2, 4, 8, 8, 8]
    j = spark.range(200).select(received.jittered(F.lit(8.0), 3, "id").alias("j")).agg(F.min("j"), F.max("j")).first()
    assert 4 <= j[0] <= j[1] <= 8
    assert list(one(spark, received.after_failure(F.lit(3), 5, F.lit(False)), received.after_failure(F.lit(4), 5, F.lit(False)), received.after_failure(F.lit(0), 5, F.lit(True)))) == ["Retryable", "Failed", "Failed"]


def test_bounded_errors(spark):
    e = F.array(*[F.lit(str(i)) for i in range(5)])
    assert list(one(spark, received.bounded(e, F.lit("n"), 3), received.bounded(F.lit(None).cast("array<string>"), F.lit("n"), 3))) == [["3", "4", "n"], ["n"]]


@pytest.mark.parametrize("text", ["", "a", "foobar", "é/7"])
def test_fnv(spark, text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    assert one(spark, fn.fnv1a64(F.lit(text)))[0] == (h - 2**64 if h >= 2**63 else h)


def model(rows, declared):
    state, out = {}, []
    for key, arrival, topic, part, pos in sorted(rows, key=lambda r: r[1]):
        s = state.get(key)
        if s is None:
            o = "Applied"
        elif s[:2] == (topic, part):
            o = "Applied" if pos > s[2] else "Ignored"
        elif s[0] == topic:
            o = "CacheOriginMismatch"
        elif topic == declared:
            o = "Migrated"
        else:
            o = "Ignored" if s[0] == declared else "CacheOriginMismatch"
        if o in ("Applied", "Migrated"):
            state[key] = (topic, part, pos)
        out.append((key, arrival, o))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_fold_is_the_sequential_model(spark, seed):
    rng = random.Random(seed)
    rows = [(f"e{rng.randrange(9)}", i, rng.choice(["new", "old", "older"]), rng.randrange(2), rng.randrange(30)) for i in range(300)]
    df = spark.createDataFrame(rows, "entity_key string, arrival long, topic string, part int, pos long").repartition(4)
    assert sorted((r.entity_key, r.arrival, r.outcome) for r in cache.fold(df, "new").collect()) == model(rows, "new")


def test_dedupe_by_order(spark):
    # The conflict of key k2 under id m1 leaves k2 free: the later row with k2 is inserted.
    rows = [("m1", "k1", 1), ("m1", "k2", 2), ("m2", "k2", 3), ("m3", "k1", 4)]
    got = received.dedupe_exact(spark.createDataFrame(rows, "message_id string, idempotency_key string, pos long"))
    assert [r.outcome for r in got.orderBy("pos").collect()] == ["Inserted", "MessageIdConflict", "Inserted", "DuplicateIdempotencyKey"]


def test_claim_blocks(spark):
    schema = "message_id long, entity_key string, enqueue_order long, status string, attempts int, created_s long, next_attempt_s long, claim_expires_s long"
    rows = [
        (1, "a", 1, "Pending", 0, 0, None, None), (2, "a", 2, "Pending", 0, 0, 999, None),  # the newer one waits and blocks
        (3, "b", 3, "Publishing", 1, 0, None, 500), (4, "b", 4, "Pending", 0, 0, None, None),  # in flight blocks
        (5, "c", 5, "Publishing", 1, 0, None, 5), (6, "c", 6, "Pending", 0, 0, None, None),  # lease over: only the row itself
        (7, None, 7, "Pending", 0, 0, None, None), (8, None, 8, "Pending", 0, 0, None, None),  # no entity: no block
    ]
    ledger = spark.createDataFrame(rows, schema)
    for claim in (outbox.claim, outbox.claim_by_joins):
        assert [r.message_id for r in claim(ledger, 100, 10).orderBy("enqueue_order").collect()] == [5, 7, 8]
    assert {r.message_id: r.status for r in outbox.supersede(ledger).collect()}[1] == "Superseded"
    assert outbox.purge(ledger, 100, 10, 5).count() == 8


def test_headers_and_samples(spark):
    n = spark.range(1, 1001).where(fn.sampled(F.col("id"), 333_333)).count()
    assert n == 333
    assert list(one(spark, fn.correlation_ok(F.lit("abc-1")), fn.correlation_ok(F.lit("a b")), fn.entity_key(F.lit(None).cast("string"), F.unhex(F.lit("FF"))))) == [True, False, None]


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
