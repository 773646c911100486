"""Current state per entity: the offset-guarded fold of a change log, and what is derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.envelope import json_long
from ..functions.identity import idempotency_key
from ..functions.text import cleanup_policy


def current(log: DataFrame) -> DataFrame:
    """Newest payload per entity of a log with one origin per entity: one partial aggregation, no sort."""
    return log.groupBy("entity_key").agg(F.max_by("payload", "pos").alias("payload"), F.max("pos").alias("applied_pos"), F.max_by("part", "pos").alias("part"))


def outcomes(log: DataFrame, arrival: str) -> DataFrame:
    """Applied or Ignored for each record in order of arrival (a number, different within an entity), by the strict offset guard of one origin."""
    seen = _seen(log, ["entity_key"], arrival)
    return seen.withColumn("outcome", F.when(F.col("_seen").isNull() | (F.col("pos") > F.col("_seen")), "Applied").otherwise("Ignored")).drop("_seen")


def _seen(log: DataFrame, keys: list[str], arrival: str, few: bool = False) -> DataFrame:
    """Adds `_seen`, the highest pos of earlier records with the same keys. few: the log is a bounded batch, one window does.

    Records are cut into ranges of arrival, each range of a key is ordered on its own and the maxima of earlier
    ranges are joined, so that a key with a large share of the log is spread over tasks.
    """
    if few:
        return log.withColumn("_seen", F.max("pos").over(Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)))
    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(log.approxQuantile(arrival, [i / n for i in range(1, n)], 0.01))) if n > 1 else []
    rows = log.withColumn("_range", F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c < F.col(arrival))))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*keys, "_range").agg(F.max("pos").alias("_top")).select(*keys, "_range", F.max("_top").over(before).alias("_base"))
    inside = F.max("pos").over(Window.partitionBy(*keys, "_range").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_in", inside).join(tops, [*keys, "_range"]).withColumn("_seen", F.greatest("_in", "_base")).drop("_range", "_in", "_base")


def fold(log: DataFrame, declared: str, arrival: str = "arrival", few: bool = False) -> DataFrame:
    """Each record with its outcome (Applied, Ignored, Migrated, CacheOriginMismatch) for logs with several origins.

    Arrival is a number, different within an entity; entity, topic and part are never null.

    The rule is sequential per entity: a first record applies; the same topic and part needs a higher pos;
    another part of the same topic is a mismatch; a record of the declared topic migrates a state from
    another one; a straggler after that is ignored; anything else is a mismatch. An entity has therefore
    two origins at most, that of its first record and that of its first record of the declared topic, and
    within an origin the guard is a running maximum: no entity's records are collected.
    """
    ours, at = F.col("topic") == declared, F.col(arrival)
    firsts = log.groupBy("entity_key").agg(
        F.min(at).alias("_at"), F.min_by(F.struct("topic", "part"), at).alias("_first"), F.min(F.when(ours, at)).alias("_ours_at"), F.min_by("part", F.when(ours, at)).alias("_ours_part")
    )
    rows = _seen(log, ["entity_key", "topic", "part"], arrival, few).join(firsts, "entity_key")
    guard = F.when(F.col("_seen").isNull() | (F.col("pos") > F.col("_seen")), "Applied").otherwise("Ignored")
    late = F.coalesce(at > F.col("_ours_at"), F.lit(False))
    out = (
        F.when(at == F.col("_at"), "Applied")
        .when(at == F.col("_ours_at"), "Migrated")
        .when(late & ours, F.when(F.col("part") == F.col("_ours_part"), guard).otherwise("CacheOriginMismatch"))
        .when(late, "Ignored")
        .when((F.col("topic") == F.col("_first.topic")) & (F.col("part") == F.col("_first.part")), guard)
        .otherwise("CacheOriginMismatch")
    )
    return rows.withColumn("outcome", out).select(*log.columns, "outcome")


def state_after(outcomes: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Cache rows (entity_key, payload, topic, part, applied_pos) left by records with outcomes of `fold`."""
    top = F.max_by(F.struct("payload", "topic", "part", "pos"), arrival).alias("s")
    rows = outcomes.where(F.col("outcome").isin("Applied", "Migrated")).groupBy("entity_key").agg(top)
    return rows.select("entity_key", "s.payload", "s.topic", "s.part", F.col("s.pos").alias("applied_pos"))


def advance(cached: DataFrame, batch: DataFrame, declared: str, arrival: str = "arrival", few: bool = False) -> DataFrame:
    """Outcomes of a batch of records on a cache: the cached rows of its entities come first, as records of their own (outcome Cached)."""
    have = cached.join(batch.select("entity_key").distinct(), "entity_key", "left_semi").withColumn("pos", F.col("applied_pos")).withColumn(arrival, F.lit(-1).cast("long"))
    both = have.select("entity_key", "payload", "topic", "part", "pos", arrival).unionByName(batch.select("entity_key", "payload", "topic", "part", "pos", arrival))
    return fold(both, declared, arrival, few).withColumn("outcome", F.when(F.col(arrival) < 0, "Cached").otherwise(F.col("outcome")))


def availability(products: DataFrame, orders: DataFrame) -> DataFrame:
    """products (product_id, on_hand), orders (product_id, quantity, fulfilled): fulfilled_quantity and available, never below 0."""
    used = orders.where("fulfilled").groupBy("product_id").agg(F.sum("quantity").alias("used"))
    used_or_0 = F.coalesce("used", F.lit(0)).cast("long")
    return products.join(used, "product_id", "left").select("product_id", "on_hand", used_or_0.alias("fulfilled_quantity"), F.greatest(F.col("on_hand") - used_or_0, F.lit(0)).alias("available"))


def recompute(products: DataFrame, orders: DataFrame, touched: DataFrame, namespace: str) -> DataFrame:
    """Products (product_id, on_hand, version) after their fulfilled orders changed: available, the next version, and the snapshot to publish.

    orders is a cache (payload: JSON with product_id, quantity, status; deleted); touched: product_id, repeats allowed. Products that
    aren't touched don't come out, and touched ones that aren't there have nothing to recompute.
    """
    live = orders.where("not deleted").select(json_long(F.col("payload"), "product_id").alias("product_id"), json_long(F.col("payload"), "quantity").alias("quantity"), F.get_json_object("payload", "$.status").alias("status"))
    used = live.where("status = 'Fulfilled'").groupBy("product_id").agg(F.sum("quantity").alias("used"))
    left = F.greatest(F.col("on_hand") - F.coalesce("used", F.lit(0)), F.lit(0)).cast("long")
    out = products.join(touched.select("product_id").distinct(), "product_id", "left_semi").join(used, "product_id", "left").withColumns({"available": left, "version": F.col("version") + 1})
    canonical = F.concat(F.lit('["'), F.col("product_id").cast("string"), F.lit('",'), F.col("version").cast("string"), F.lit("]"))
    return out.select("product_id", "on_hand", "available", "version", F.col("product_id").cast("string").alias("entity_key"), idempotency_key(namespace, canonical).alias("idempotency_key"), F.to_json(F.struct("product_id", "available", "version")).alias("payload"))


def admit(orders: DataFrame, cached: DataFrame) -> DataFrame:
    """Orders whose cached product is Available in the quantity asked for."""
    return orders.join(cached, "product_id").where("status = 'Available' and available >= quantity").select(*orders.columns)


def page(keys: DataFrame, key: str, cursor, size: int) -> DataFrame:
    """The next page of keys after the cursor, ascending."""
    return (keys.where(F.col(key) > cursor) if cursor is not None else keys).orderBy(key).limit(size)


def reconcile(declared: DataFrame, observed: DataFrame, mode: str) -> DataFrame:
    """Outcome per declared topic (topic, partitions or null, policy) against observed ones: the policy must agree, partitions may drift.

    Types that share a topic declare it once: the first by partitions and policy counts. Create needs a declared number of partitions.
    """
    once = declared.groupBy("topic").agg(F.min(F.struct("partitions", "policy")).alias("d")).select("topic", "d.partitions", "d.policy")
    seen = observed.select("topic", F.col("partitions").alias("_n"), F.col("policy").alias("_p"))
    new = F.when(F.col("partitions").isNull(), "PartitionsUndeclared").otherwise("Create") if mode == "create" else F.lit("Missing")
    out = (
        F.when(F.lit(mode) == "off", "Skipped")
        .when(F.col("_p").isNull(), new)
        .when(cleanup_policy(F.col("policy")) != cleanup_policy(F.col("_p")), "PolicyMismatch")
        .when(F.col("partitions") != F.col("_n"), "PartitionDrift")
        .otherwise("Ok")
    )
    return once.join(seen, "topic", "left").select("topic", out.alias("outcome"))


def converge(declared: DataFrame, observed: DataFrame, mode: str, create=None) -> DataFrame:
    """`reconcile`, then topics to create go to create(DataFrame of topic, partitions, policy), which returns them as observed afterwards; those are verified in turn.

    Raises for what can't be mended: a missing topic, another policy, or no number of partitions to create with. Drift is returned.
    """
    found = reconcile(declared, observed, mode)
    new = declared.join(found.where("outcome = 'Create'").select("topic"), "topic", "left_semi").dropDuplicates(["topic"])
    if create is not None and not new.isEmpty():
        found = found.where("outcome <> 'Create'").unionByName(reconcile(new, create(new), "verify"))
    wrong = found.where("outcome in ('Missing', 'PolicyMismatch', 'PartitionsUndeclared')").orderBy("topic").limit(20).collect()
    if wrong:
        raise ValueError(", ".join(f"{r.topic}: {r.outcome}" for r in wrong))
    return found
