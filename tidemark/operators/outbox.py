"""Send side: supersede, claim, collapse, acknowledge, purge. A ledger goes in, the rewritten ledger (or the rows picked) comes out.

An entity's rows are looked at in one window over the entity instead of self-joins. A null
entity never blocks or overtakes another row.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import headers, identity

TERMINAL = ("Published", "Superseded", "Failed")
#: Columns that a row has while a worker holds it.
LEASE = ("claim_expires_s", "claim_id", "claimed_by")
#: What a row says that another one has overtaken.
OVERTAKEN = "superseded by newer pending state for the same entity"


def other_than(*statuses: str) -> Column:
    """Rows of none of the statuses, those without a status among them."""
    return F.col("status").isNull() | ~F.col("status").isin(*statuses)


def _entity():
    """Rows without entity stand alone."""
    return Window.partitionBy(F.coalesce(F.concat(F.lit("e"), "entity_key"), F.concat(F.lit("m"), F.col("message_id").cast("string"))))


def supersede(ledger: DataFrame) -> DataFrame:
    """Pending rows overtaken by a newer pending row of their entity become Superseded and lose their lease. Only pending rows are grouped and joined."""
    newest = ledger.where("status = 'Pending' and entity_key is not null").groupBy("entity_key").agg(F.max("enqueue_order").alias("_newest"))
    waiting = ledger.where("status = 'Pending'").join(newest, "entity_key", "left").withColumn("_old", F.coalesce(F.col("enqueue_order") < F.col("_newest"), F.lit(False)))
    out = waiting.withColumns({"status": F.when(F.col("_old"), "Superseded").otherwise("Pending"), **{c: F.when(~F.col("_old"), F.col(c)) for c in LEASE if c in ledger.columns}})
    return ledger.where(other_than("Pending")).unionByName(out.select(*ledger.columns))


def with_lease(ledger: DataFrame) -> DataFrame:
    """The ledger with all columns of a lease."""
    return ledger.withColumns({c: F.lit(None).cast("string") for c in ("claim_id", "claimed_by", "last_error") if c not in ledger.columns})


def claimable(ledger: DataFrame, now: int) -> DataFrame:
    """Due pending rows without in-flight sibling or newer pending sibling, and in-flight rows whose lease is over."""
    w = _entity()
    flying = F.max((F.col("status") == "Publishing").cast("int")).over(w)
    newest = F.max(F.when(F.col("status") == "Pending", F.col("enqueue_order"))).over(w)
    due = F.col("next_attempt_s").isNull() | (F.col("next_attempt_s") <= now)
    # Terminal rows are read neither by the window nor by its shuffle.
    live = ledger.where(F.col("status").isin("Pending", "Publishing")).withColumns({"_flying": flying, "_newest": newest})
    pending = (F.col("status") == "Pending") & due & (F.col("_flying") == 0) & (F.col("enqueue_order") == F.col("_newest"))
    return live.where(pending | ((F.col("status") == "Publishing") & (F.col("claim_expires_s") <= now))).drop("_flying", "_newest")


def claim(ledger: DataFrame, now: int, limit: int, lease: int = 30) -> DataFrame:
    """The batch to publish, in enqueue order: Publishing, one attempt more, a lease from now."""
    picked = claimable(ledger, now).orderBy("enqueue_order").limit(limit)
    return picked.withColumns({"status": F.lit("Publishing"), "attempts": F.col("attempts") + 1, "claim_expires_s": F.lit(now + lease).cast("long")})


def claim_by_joins(ledger: DataFrame, now: int, limit: int, lease: int = 30) -> DataFrame:
    """`claim` by two anti joins: the form to use where most rows are live and entities are few and hot."""
    flying = ledger.where("status = 'Publishing'").select("entity_key").distinct()
    newer = ledger.where("status = 'Pending'").select(F.col("entity_key").alias("_e"), F.col("enqueue_order").alias("_o"))
    due = ledger.where((F.col("status") == "Pending") & (F.col("next_attempt_s").isNull() | (F.col("next_attempt_s") <= now)))
    pending = due.join(flying, "entity_key", "left_anti").join(newer, (F.col("entity_key") == F.col("_e")) & (F.col("_o") > F.col("enqueue_order")), "left_anti")
    expired = ledger.where((F.col("status") == "Publishing") & (F.col("claim_expires_s") <= now))
    picked = pending.select(*ledger.columns).unionByName(expired).orderBy("enqueue_order").limit(limit)
    return picked.withColumns({"status": F.lit("Publishing"), "attempts": F.col("attempts") + 1, "claim_expires_s": F.lit(now + lease).cast("long")})


def collapse(ledger: DataFrame, now: int, limit: int) -> DataFrame:
    """Older pending rows of the first `limit` due newest-pending rows whose entity has nothing in flight: message_id, by."""
    live = ledger.where(F.col("status").isin("Pending", "Publishing") & F.col("entity_key").isNotNull())
    per = live.groupBy("entity_key").agg(F.bool_or(F.col("status") == "Publishing").alias("_fly"), F.max_by(F.struct("enqueue_order", "next_attempt_s"), F.when(F.col("status") == "Pending", F.col("enqueue_order"))).alias("_new"))
    front = per.where((~F.col("_fly")) & F.col("_new").isNotNull() & (F.col("_new.next_attempt_s").isNull() | (F.col("_new.next_attempt_s") <= now)))
    front = front.select("entity_key", F.col("_new.enqueue_order").alias("by")).orderBy("by").limit(limit)
    return live.where("status = 'Pending'").join(F.broadcast(front), "entity_key").where("enqueue_order < by").select("message_id", "by")  # limit rows


def collapse_into(ledger: DataFrame, now: int, limit: int) -> DataFrame:
    """The whole ledger after a collapse: the older rows are Superseded, hold no lease and say why."""
    ledger = with_lease(ledger)
    old = collapse(ledger, now, limit).select("message_id", F.lit(True).alias("_old"))
    waiting = ledger.where("status = 'Pending'").join(old, "message_id", "left").withColumn("_old", F.coalesce("_old", F.lit(False)))
    out = waiting.withColumns({"status": F.when(F.col("_old"), "Superseded").otherwise("Pending"), "last_error": F.when(F.col("_old"), OVERTAKEN).otherwise(F.col("last_error")), **{c: F.when(~F.col("_old"), F.col(c)) for c in LEASE}})
    return ledger.where(other_than("Pending")).unionByName(out.select(*ledger.columns))


def mark(ledger: DataFrame, acks: DataFrame) -> DataFrame:
    """What each acknowledgement (message_id, claim_id) does: Updated, StaleClaim or Missing."""
    held = with_lease(ledger).select("message_id", "status", F.col("claim_id").alias("_claim"))
    ok = (F.col("status") == "Publishing") & (F.col("_claim") == F.col("claim_id"))
    return acks.join(held, "message_id", "left").select("message_id", F.when(F.col("status").isNull(), "Missing").when(ok, "Updated").otherwise("StaleClaim").alias("outcome"))


def purge_victims(ledger: DataFrame, now: int, older_than: int, limit: int, failed: bool = False) -> DataFrame:
    """The oldest terminal rows created strictly before now - older_than."""
    kinds = TERMINAL if failed else TERMINAL[:2]
    return ledger.where(F.col("status").isin(*kinds) & (F.col("created_s") < now - older_than)).orderBy("created_s", "message_id").limit(limit)


class PurgeStats(NamedTuple):
    deleted: int


def purge(ledger: DataFrame, *args, **kwargs) -> DataFrame:
    return ledger.join(purge_victims(ledger, *args, **kwargs).select("message_id"), "message_id", "left_anti")


def with_enqueue_order(ledger: DataFrame) -> DataFrame:
    """Numbers legacy rows 1, 2, ... by (created_s, message_id)."""
    return numbered(ledger, "created_s", "message_id")


def numbered(rows: DataFrame, by: str, *ties: str, start: int = 0, name: str = "enqueue_order") -> DataFrame:
    """Numbers rows start+1, start+2, ... by a numeric column and tie-breaks: per-range counts and a running offset, no single-task sort."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.approxQuantile(by, [i / n for i in range(1, n)], 0.01) if n > 1 else []
    rows = rows.withColumn("_p", F.size(F.filter(F.lit(sorted(set(cuts))).cast("array<double>"), lambda c: c < F.col(by))))
    count = rows.groupBy("_p").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = F.broadcast(count.select("_p", before.alias("_before")))  # as many rows as shuffle partitions
    place = F.row_number().over(Window.partitionBy("_p").orderBy(by, *ties))
    return rows.join(offset, "_p").withColumn(name, (place + F.col("_before") + start).cast("long")).drop("_p", "_before")


def rejection(prefix: str = headers.PREFIX) -> Column:
    """Why a message can't be sent, or null: ReservedHeader (leaves no row), MissingIdempotencyKey (leaves a Failed row)."""
    return F.when(F.coalesce(identity.reserved(F.col("headers"), prefix), F.lit(False)), "ReservedHeader").when(F.col("idempotency_key").isNull(), "MissingIdempotencyKey")


def enqueued(live: DataFrame, messages: DataFrame, now: int, top: int, prefix: str = headers.PREFIX) -> DataFrame:
    """Rows that messages (see `enqueue`) add or change, given the pending rows and the highest number so far: the new ones, and those that they supersede."""
    sent = messages.withColumn("_why", rejection(prefix)).where("_why is null or _why <> 'ReservedHeader'")
    new = numbered(sent, "seq", "message_id", start=top).withColumns(
        {
            "status": F.when(F.col("_why").isNull(), "Pending").otherwise("Failed"),
            "last_error": F.when(F.col("_why").isNotNull(), "missing idempotency identity"),
            "headers": headers.carry_entity(F.col("headers"), F.col("partition_key"), F.col("entity_key"), prefix),
            "attempts": F.lit(0),
            "created_s": F.lit(now).cast("long"),
        }
    )
    new = new.drop("_why", "seq").withColumn("_new", F.lit(True))
    waiting = live.where("status = 'Pending'").withColumn("_new", F.lit(False)).unionByName(new, allowMissingColumns=True)
    newest = new.where("status = 'Pending'").groupBy("entity_key").agg(F.max("enqueue_order").alias("_newest"))
    out = waiting.join(newest, "entity_key", "left").withColumn("_old", F.coalesce((F.col("status") == "Pending") & (F.col("enqueue_order") < F.col("_newest")), F.lit(False)))
    return out.withColumns({"status": F.when(F.col("_old"), "Superseded").otherwise(F.col("status")), **{c: F.when(~F.col("_old"), F.col(c)) for c in LEASE if c in out.columns}}).drop("_newest")


def enqueue(ledger: DataFrame, messages: DataFrame, now: int, prefix: str = headers.PREFIX) -> DataFrame:
    """The ledger with messages (seq, message_id, entity_key, partition_key, idempotency_key, headers map) added in order of seq.

    Messages with reserved headers leave no row and those without identity a Failed one; `rejection` tells the caller which.
    Every pending row of an entity that gets a later message becomes Superseded and loses its lease. Only
    pending rows meet the new ones; the others pass by unshuffled.
    """
    top = ledger.agg(F.coalesce(F.max("enqueue_order"), F.lit(0))).first()[0]
    return ledger.where(other_than("Pending")).unionByName(enqueued(ledger, messages, now, top, prefix).drop("_old", "_new"), allowMissingColumns=True)


def _claimed(ledger: DataFrame, now: int, limit: int, lease: int, claim_id: str, worker: str) -> DataFrame:
    """The live rows after a claim, with `_is` (claimed) and `_old` (superseded by it)."""
    batch = claim(ledger, now, limit, lease)
    picked = batch.select("message_id", F.lit(True).alias("_mine"), F.col("claim_expires_s").alias("_until"))
    front = batch.where("entity_key is not null").groupBy("entity_key").agg(F.max("enqueue_order").alias("_front"))
    live = ledger.where(F.col("status").isin("Pending", "Publishing")).join(picked, "message_id", "left").join(front, "entity_key", "left")
    mine, old = F.col("_mine").isNotNull(), F.coalesce((F.col("status") == "Pending") & (F.col("enqueue_order") < F.col("_front")), F.lit(False))
    held = lambda c, v: F.when(mine, v).when(~old, F.col(c))
    return live.withColumns({"_is": mine, "_old": old}).withColumns(
        {
            "attempts": F.when(mine, F.col("attempts") + 1).otherwise(F.col("attempts")),
            "claim_expires_s": held("claim_expires_s", F.col("_until")), "claim_id": held("claim_id", F.lit(claim_id)), "claimed_by": held("claimed_by", F.lit(worker)),
            "status": F.when(mine, "Publishing").when(old, "Superseded").otherwise(F.col("status")),
        }
    )


def claim_into(ledger: DataFrame, now: int, limit: int, lease: int = 30, claim_id: str = "claim", worker: str = "relay") -> DataFrame:
    """The whole ledger after a claim: the batch is Publishing under its lease, older pending rows of its entities are Superseded."""
    ledger = with_lease(ledger)
    return ledger.where(other_than("Pending", "Publishing")).unionByName(_claimed(ledger, now, limit, lease, claim_id, worker).select(*ledger.columns))


def claimed(live: DataFrame, now: int, limit: int, lease: int = 30, claim_id: str = "claim", worker: str = "relay") -> DataFrame:
    """Only the rows that a claim changes: the batch, and what it supersedes."""
    return _claimed(with_lease(live), now, limit, lease, claim_id, worker).where("_is or _old").select(*with_lease(live).columns)


def _acknowledged(ledger: DataFrame, acks: DataFrame, now: int, retry_after: float) -> DataFrame:
    """The rows in flight after acknowledgements, with `_hit`: it was this row's claim."""
    ack = acks.select("message_id", F.col("claim_id").alias("_claim"), F.col("error").alias("_error"))
    flying = ledger.where("status = 'Publishing'").join(ack, "message_id", "left").withColumn("_hit", F.coalesce(F.col("_claim") == F.col("claim_id"), F.lit(False)))
    bad, hit = F.col("_error").isNotNull(), F.col("_hit")
    return flying.withColumns(
        {
            "status": F.when(hit, F.when(bad, "Pending").otherwise("Published")).otherwise(F.col("status")),
            "next_attempt_s": F.when(hit & bad, F.lit(now + retry_after).cast("long")).otherwise(F.col("next_attempt_s")),
            "last_error": F.when(hit & bad, F.col("_error")).otherwise(F.col("last_error")),
            "published_s": F.when(hit & ~bad, F.lit(now).cast("long")).otherwise(F.col("published_s")),
            **{c: F.when(~hit, F.col(c)) for c in LEASE},
        }
    )


def _with_published(ledger: DataFrame) -> DataFrame:
    ledger = with_lease(ledger)
    return ledger if "published_s" in ledger.columns else ledger.withColumn("published_s", F.lit(None).cast("long"))


def acknowledge(ledger: DataFrame, acks: DataFrame, now: int, retry_after: int = 1) -> DataFrame:
    """The whole ledger after acknowledgements (message_id, claim_id, error or null), each on its own.

    Published without error; with one, Pending again `retry_after` seconds later. Stale or unknown claims change
    nothing (`mark` says which they are).
    """
    ledger = _with_published(ledger)
    return ledger.where(other_than("Publishing")).unionByName(_acknowledged(ledger, acks, now, retry_after).select(*ledger.columns))


def acknowledged(live: DataFrame, acks: DataFrame, now: int, retry_after: int = 1) -> DataFrame:
    """Only the rows that acknowledgements change."""
    live = _with_published(live)
    return _acknowledged(live, acks, now, retry_after).where("_hit").select(*live.columns)


def redrive(*_, **__) -> DataFrame:
    """A sent record is never replayed, as it would win with stale data; republish current state instead (`resync.republish`)."""
    raise ValueError("outbox rows can't be redriven; republish current state")
