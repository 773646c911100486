"""Receive side: ingest checks and dedupe, retry, dead letters, redrive; and summaries of either ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.entities import Entity, json_value
from ..sources.scratch import cut
from .outbox import numbered

OUTBOX_STATUSES = ("Pending", "Publishing", "Published", "Superseded", "Failed")
RECEIVED_STATUSES = ("Pending", "Retryable", "Processed", "Failed")


def depth(ledger: DataFrame, now: int, most: int, terminal: tuple) -> DataFrame:
    """Rows, age of the oldest (never negative) and whether it is over `most`, per status."""
    out = ledger.groupBy("status").agg(F.count("*").alias("n"), F.min("created_s").alias("oldest_s"))
    age = F.greatest(F.lit(now) - F.col("oldest_s"), F.lit(0))
    return out.select("status", "n", age.cast("long").alias("oldest_age_s"), ((age >= most) & ~F.col("status").isin(*terminal)).alias("over_max_age"))


def depth_ms(ledger: DataFrame, now_ms: int) -> DataFrame:
    """Rows and age of the oldest in milliseconds, per status, of a ledger with created_us."""
    age = F.greatest(F.lit(now_ms) - F.floor(F.min("created_us") / 1000), F.lit(0)).cast("long")
    return ledger.groupBy("status").agg(F.count("*").alias("n"), age.alias("oldest_age_ms"))


def dense_depth(ledger: DataFrame, statuses: tuple) -> DataFrame:
    """Rows per status, 0 for those that don't occur."""
    every = ledger.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return every.join(ledger.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def due_column(ledger: DataFrame) -> tuple[str, int]:
    """Where a ledger keeps when a row is due, and how many of its units are a second: due_us, or due_s where it has no other."""
    return ("due_us", 1_000_000) if "due_us" in ledger.columns else ("due_s", 1)


def due(ledger: DataFrame, now: float, limit: int) -> DataFrame:
    name, unit = due_column(ledger)
    ready = (F.col("status") == "Pending") | ((F.col("status") == "Retryable") & (F.col(name) <= int(now * unit)))
    return ledger.where(ready).orderBy("created_s", "message_id").limit(limit)


def stuck(ledger: DataFrame, now: int, after: int, limit: int) -> DataFrame:
    """Overdue rows, longest first."""
    name, unit = due_column(ledger)
    at = F.coalesce(F.floor(F.col(name) / unit) if unit > 1 else F.col(name), F.col("created_s"))
    return ledger.where(F.col("status").isin("Pending", "Retryable")).withColumn("due_at_s", at).where(F.col("due_at_s") < now - after).orderBy("due_at_s", "created_s", "message_id").limit(limit)


def failed(ledger: DataFrame, since: int | None = None, kind: str | None = None) -> DataFrame:
    out = ledger.where("status = 'Failed'")
    if since is not None:
        out = out.where(F.col("last_failed_s") >= since)
    return out.where(F.col("kind") == kind) if kind is not None else out


def dead_letters(ledger: DataFrame, limit: int, **only) -> DataFrame:
    return failed(ledger, **only).orderBy(F.col("last_failed_s").asc_nulls_last(), "created_s", "message_id").limit(max(0, limit))


def redrive(ledger: DataFrame, limit: int, clear: bool = False, **only) -> DataFrame:
    """The ledger's rows that go back to Pending; attempts and failure facts stay unless cleared."""
    out = dead_letters(ledger, limit, **only).withColumns({"status": F.lit("Pending"), due_column(ledger)[0]: F.lit(None).cast("long")})
    if clear:
        out = out.withColumns({"attempts": F.lit(0), "last_failed_s": F.lit(None).cast("long"), "kind": F.lit(None).cast("string")})
    return out


def backoff(attempts: Column, initial: float = 1.0, most: float = 300.0, multiplier: float = 2.0) -> Column:
    """Seconds before the next attempt without jitter, by the attempts made before this failure: the power may become infinite, the least of it and `most` doesn't."""
    return F.least(F.lit(float(initial)) * F.pow(F.lit(float(multiplier)), F.greatest(attempts, F.lit(0)).cast("double")), F.lit(float(most)))


def jittered(base_us: Column, seed: int, *of: Column | str) -> Column:
    """Microseconds between half the base and all of it, by a hash of the columns: a row's retries differ, reading it again doesn't change them."""
    h = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in of])), 1, 8), 16, 10).cast("long")
    half = F.floor(base_us / 2)
    return half + F.shiftright((base_us - half).cast("long") * h, 32)


def after_failure(attempts: Column, most: int, terminal: Column) -> Column:
    return F.when(terminal | (attempts + 1 >= most), "Failed").otherwise("Retryable")


def bounded(errors: Column, new: Column, most: int) -> Column:
    """Errors with the new one appended, the newest `most` kept in order."""
    every = F.concat(F.coalesce(errors, F.array().cast("array<string>")), F.array(new))
    return F.slice(every, F.greatest(F.size(every) - most + 1, F.lit(1)), F.lit(most))


def classify(records: DataFrame, topic: str, entity: Entity | None = None) -> DataFrame:
    """First failing check of each record (topic, payload, idempotency_key), or null; with an entity the payload has to be of its type; `envelope.decode` checks whole records with their headers."""
    bad = (
        F.when(F.col("topic") != topic, "UnexpectedTopic")
        .when(F.col("payload").isNull(), "MissingPayload")
        .when(json_value(F.col("payload")).isNull() if entity is None else ~entity.conforms(F.col("payload")), "InvalidPayload")
        .when(F.col("idempotency_key").isNull(), "MissingIdempotencyKey")
        .when(~F.col("idempotency_key").rlike(r"\A[0-9a-fA-F]{64}\z"), "InvalidHeader")
    )
    return records.withColumn("failure_kind", bad)


def dedupe(records: DataFrame) -> DataFrame:
    """Outcome of each record (message_id, idempotency_key, pos) in order of pos, where message ids are unique or tied to keys.

    Inserted for the first of a key, DuplicateIdempotencyKey after it, MessageIdConflict for a new key under
    a message id that another key has taken. `dedupe_exact` settles what one conflict changes for others.
    """
    key = F.row_number().over(Window.partitionBy("idempotency_key").orderBy("pos"))
    mid = F.row_number().over(Window.partitionBy("message_id").orderBy("pos"))
    out = records.withColumns({"_k": key, "_m": mid})
    return out.withColumn("outcome", F.when(F.col("_k") > 1, "DuplicateIdempotencyKey").when(F.col("_m") > 1, "MessageIdConflict").otherwise("Inserted")).drop("_k", "_m")


def dedupe_exact(records: DataFrame) -> DataFrame:
    """Outcome of each record (message_id, idempotency_key, pos; none null) by the sequential rule, for any mix of ids and keys.

    A record is inserted when no earlier inserted one has its key or its id. Each round inserts the records
    that come first both under their key and under their id and lets go of all that share either with them;
    rounds go on over what is left (nothing, as a rule, after the first). At the end a record is a duplicate when
    an earlier inserted one has its key, else a conflict.
    """
    left, placed = records.select("pos", "message_id", "idempotency_key"), None
    while True:
        first = lambda c: F.min("pos").over(Window.partitionBy(c))
        ranked = cut(left.withColumns({"_k": first("idempotency_key"), "_m": first("message_id")}), "dedupe")
        won = ranked.where("pos = _k and pos = _m").select("pos", "message_id", "idempotency_key")
        placed = won if placed is None else placed.unionByName(won)
        left = ranked.drop("_k", "_m").join(won.select("idempotency_key"), "idempotency_key", "left_anti").join(won.select("message_id"), "message_id", "left_anti")
        if left.isEmpty():
            break
    owner = placed.select("idempotency_key", F.col("pos").alias("_by"))
    out = records.join(owner, "idempotency_key", "left")
    return out.withColumn("outcome", F.when(F.col("_by") == F.col("pos"), "Inserted").when(F.col("_by") < F.col("pos"), "DuplicateIdempotencyKey").otherwise("MessageIdConflict")).select(*records.columns, "outcome")


def skip_runs(records: DataFrame, skipped: Column, limit: int, before: int = 0) -> DataFrame:
    """Runs of at least `limit` skipped records in a row, in order of pos: first_pos, trip_pos (of the record that trips the breaker), n.

    before: skipped records in a row that came right before these.
    """
    rows = numbered(records.select("pos", skipped.alias("_skip")), "pos", name="_n")
    bad = numbered(rows.where("_skip"), "pos", name="_i").withColumn("_run", F.col("_n") - F.col("_i"))
    runs = bad.groupBy("_run").agg(F.min("pos").alias("first_pos"), F.min("_i").alias("_i0"), F.count("*").alias("n"))
    have = F.when(F.col("_run") == 0, F.lit(before)).otherwise(F.lit(0))
    trip = bad.select(F.col("_run"), F.col("_i"), F.col("pos").alias("trip_pos"))
    long = runs.withColumn("n", F.col("n") + have).where(F.col("n") >= limit).withColumn("_i", F.col("_i0") + F.greatest(limit - have, F.lit(1)) - 1)
    return long.join(trip, ["_run", "_i"]).select("first_pos", "trip_pos", "n")


def open_run(records: DataFrame, skipped: Column, before: int = 0) -> int:
    """How many skipped records in a row the records end with, those right before them included."""
    last = records.agg(F.max(F.when(~skipped, F.col("pos"))).alias("at")).first()["at"]
    n = (records if last is None else records.where(F.col("pos") > last)).where(skipped).count()
    return n + (before if last is None else 0)


def panic_trips(cycles: DataFrame, limit: int) -> DataFrame:
    """Streaks of dispatch cycles (pos, message_id or null when idle, panicked) in which at least `limit` different rows panicked: first_pos, rows.

    A claimed row that doesn't panic ends a streak; an idle cycle doesn't.
    """
    busy = numbered(cycles.where("message_id is not null"), "pos", name="_n")
    bad = numbered(busy.where("panicked"), "pos", name="_i")
    return bad.groupBy((F.col("_n") - F.col("_i")).alias("_run")).agg(F.min("pos").alias("first_pos"), F.count_distinct("message_id").alias("rows")).where(F.col("rows") >= limit).drop("_run")


def quarantined(have: DataFrame, new: DataFrame) -> DataFrame:
    """The refused records to add: one for each (topic, part, pos) that isn't there yet; of several the first by failure_kind."""
    place = ["topic", "part", "pos"]
    rest = [c for c in new.columns if c not in place]
    first = new.groupBy(*place).agg(F.min_by(F.struct(*rest), F.struct("failure_kind", F.xxhash64(*rest))).alias("r"))
    return first.select(*place, "r.*").join(have.select(*place), place, "left_anti").select(*new.columns)


def quarantine_at(quarantine: DataFrame, topic: str, part: int, pos: int) -> DataFrame:
    """The refused record at a place, or nothing."""
    return quarantine.where((F.col("topic") == topic) & (F.col("part") == part) & (F.col("pos") == pos))


def route(rows: DataFrame, types: DataFrame) -> DataFrame:
    """Adds `failure`: MissingHandler for rows whose message_type isn't among the registered types (a table, at most one row per type)."""
    known = types.select("message_type", F.lit(True).alias("_known")).dropDuplicates(["message_type"])
    return rows.join(known, "message_type", "left").withColumn("failure", F.when(F.col("_known").isNull(), "MissingHandler")).select(*rows.columns, "failure")


def settle(rows: DataFrame, now: float, max_attempts: int = 10, initial: float = 1.0, most: float = 300.0, multiplier: float = 2.0, errors_limit: int = 20, stored: str = "kind", jitter: int | None = None) -> DataFrame:
    """Ledger rows after dispatch, from `failure` (null: handled or ignored) and `terminal`.

    Handled rows are Processed. Failed ones count an attempt, keep the newest errors, and are Retryable at
    now plus the backoff (with jitter, a seed: between half of it and all; in microseconds where the ledger has due_us, else
    rounded up to seconds), or Failed when terminal or out of attempts.
    """
    bad = F.col("failure").isNotNull()
    status = F.when(~bad, "Processed").otherwise(after_failure(F.col("attempts"), max_attempts, F.coalesce("terminal", F.lit(False))))
    base = F.floor(backoff(F.col("attempts"), initial, most, multiplier) * 1_000_000).cast("long")
    wait = base if jitter is None else jittered(base, jitter, "message_id", "attempts")
    name, unit = due_column(rows)
    at = F.lit(int(now * 1_000_000)) + wait
    at = at if unit > 1 else F.ceil(at / 1_000_000).cast("long")
    errors = F.col("errors") if "errors" in rows.columns else F.lit(None).cast("array<string>")
    out = rows.withColumn("_status", status)
    return out.withColumns(
        {
            name: F.when(F.col("_status") == "Retryable", at),
            "errors": F.when(bad, bounded(errors, F.col("failure"), errors_limit)).otherwise(errors),
            "last_failed_s": F.when(bad, F.lit(int(now)).cast("long")).otherwise(F.col("last_failed_s")),
            stored: F.when(bad, F.col("failure")).otherwise(F.col(stored)),
            "attempts": F.when(bad, F.col("attempts") + 1).otherwise(F.col("attempts")),
            "status": F.col("_status"),
        }
    ).drop("_status", "failure", "terminal")


def redrive_into(ledger: DataFrame, limit: int, clear: bool = False, **only) -> DataFrame:
    """The whole ledger after a redrive."""
    back = redrive(ledger, limit, clear, **only)
    return ledger.join(back.select("message_id"), "message_id", "left_anti").select(*ledger.columns).unionByName(back.select(*ledger.columns))


def redrive_estimate(ledger: DataFrame, limit: int, **only) -> DataFrame:
    """How many rows a redrive of at most `limit` would move."""
    return failed(ledger, **only).limit(max(0, limit)).agg(F.count("*").alias("n"))
