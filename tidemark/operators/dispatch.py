"""Due rows of the receive ledger: routed, folded into the cache, given to handlers, and settled one by one.

A row that fails, for whatever reason, takes back what it did to the cache and waits or dies by itself; the rows
around it are handled as if it had not been there. Handlers are functions over DataFrames, or over single rows (`by_row`). A row that
makes its handler raise fails alone: a function over rows is caught at the row, one over DataFrames is
asked again with halves of its rows until those that it can't take stand alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import problems
from ..sources.scratch import cut
from . import cache, received
from .outbox import numbered


@dataclass
class HandlerCtx:
    """What a handler can see and do: the cache before this batch, other caches by name, and messages to send."""

    cache: DataFrame
    caches: dict[str, DataFrame] = field(default_factory=dict)
    sent: list[DataFrame] = field(default_factory=list)

    def enqueue(self, messages: DataFrame) -> None:
        """Messages as `outbox.enqueue` takes them, and `cause`, the message_id of the row they follow from: they go out only if that row is handled."""
        self.sent.append(messages)


#: Rows with `previous` (the cached payload) to rows with `go` (else the row is skipped) and `failure` (null: none).
Before = Callable[[DataFrame, HandlerCtx], DataFrame]
#: Rows that moved the cache to (message_id, failure) of those that failed, or None.
After = Callable[[DataFrame, HandlerCtx], DataFrame | None]


@dataclass
class Hooks:
    """Called on the driver between the steps; tests let them raise."""

    before_record: Callable[[], None] = lambda: None
    after_handlers: Callable[[], None] = lambda: None


class Dispatched(NamedTuple):
    ledger: DataFrame
    cache: DataFrame
    #: message_id, outcome: Applied, Migrated, Ignored, Skipped, or the failure.
    outcomes: DataFrame
    #: Messages of handled rows, or None.
    sent: DataFrame | None
    #: claimed, processed, failed, panicked (the last are among the failed).
    stats: dict[str, int]
    #: Of the ledger and of the cache only the rows that have changed.
    settled: DataFrame
    moved: DataFrame
    #: message_ids of rows that panicked.
    panicked: tuple[int, ...] = ()
    #: message_ids of all rows of the cycle, in their order.
    order: tuple[int, ...] = ()


SAID = "message_id long, go boolean, failure string"
FAILED = "message_id long, failure string"
PANIC = "HandlerPanicked"
#: Up to so many rows a cycle, they and what is said of them are held as one local frame instead of written tables.
LOCAL = 10_000


class Refused(Exception):
    """A row handler's own word that its row failed; anything else that it raises is a panic."""


def by_row(handle: Callable[[dict], bool | None]) -> Callable[[DataFrame, HandlerCtx], DataFrame]:
    """A handler over one row, as a handler before or after the cache. It returns whether the row goes on (None: yes) and raises Refused to fail it.

    Rows are given as dicts, in batches of Arrow inside tasks; whatever one of them raises concerns it alone.
    """

    def apply(batches):
        import pyarrow as pa

        for batch in batches:
            ids, go, failure = [], [], []
            for row in batch.to_pylist():
                said, why = True, None
                try:
                    said = handle(row) is not False
                except Refused as e:
                    why = str(e) or "Handler"
                except Exception:  # the row's own fault
                    why = PANIC
                ids.append(row["message_id"])
                go.append(said)
                failure.append(why)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(go, pa.bool_()), pa.array(failure, pa.string())], ["message_id", "go", "failure"])

    return lambda rows, ctx: rows.mapInArrow(apply, SAID)


def _held(df: DataFrame, limit: int) -> DataFrame:
    """A frame of a cycle's rows, computed once."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema) if limit <= LOCAL else cut(df, "cycle")


def contained(rows: DataFrame, handler: Callable[[DataFrame, HandlerCtx], DataFrame | None], ctx: HandlerCtx, limit: int, reruns: int | None = None) -> tuple[DataFrame, set[int]]:
    """What a handler says of rows (SAID; those it doesn't name go on), and the rows that it wasn't asked about in the end.

    If it raises, be it only when its result is computed, it is asked again with each half of its rows; a row that makes it raise by itself panics. One such
    row among n costs 2 log2(n) further calls. After `reruns` of them (8 log2(n) + 8) the rows that are still together are left for another cycle.
    What it sends in a call that raises is void.
    """
    spark = rows.sparkSession
    ids = [r.message_id for r in rows.select("message_id").orderBy("arrival").collect()]
    left = (8 * math.ceil(math.log2(len(ids) + 1)) + 8) if reruns is None else reruns
    said, todo, undecided = [], [ids] if ids else [], set()
    while todo:
        part = todo.pop()
        if left < 0:
            undecided.update(part)
            continue
        some = rows if len(part) == len(ids) else _held(rows.where(F.col("message_id").isin(part)), limit)
        sent = len(ctx.sent)
        try:
            got = handler(some, ctx)
            if got is not None:
                go = F.coalesce("go", F.lit(True)) if "go" in got.columns else F.lit(True)
                said += [tuple(r) for r in got.select(F.col("message_id").cast("long"), go.alias("go"), "failure").where("not go or failure is not null").collect()]
        except Exception:  # a handler may raise anything; that is a failure of its rows, not of the loop
            del ctx.sent[sent:]
            left -= 1 if len(part) == len(ids) else 0
            if len(part) == 1:
                said.append((part[0], True, PANIC))
            else:
                todo += [part[len(part) // 2 :], part[: len(part) // 2]]
        left -= len(part) < len(ids)
    return spark.createDataFrame(said, SAID), undecided


def dispatch_due(
    ledger: DataFrame, cached: DataFrame, now: int, limit: int, types: DataFrame, declared: str,
    before: Before | None = None, after: After | None = None, caches: dict[str, DataFrame] | None = None, hooks: Hooks | None = None, reruns: int | None = None, **policy,
) -> Dispatched:
    """One cycle over the first `limit` due rows (created_s, then message_id) of ledger (message_id, message_type, topic, part, pos, entity_key, payload, status, attempts, created_s, due_s, last_failed_s, kind).

    cached: entity_key, payload, topic, part, applied_pos. types: message_type. policy goes to `received.settle`. Rows that `contained` leaves undecided are as if they hadn't been claimed.
    """
    hooks, spark = hooks or Hooks(), ledger.sparkSession
    rows = received.due(ledger, now, limit)
    if limit <= LOCAL:
        number = StructType([*rows.schema.fields, StructField("arrival", LongType())])
        rows = spark.createDataFrame([(*r, i) for i, r in enumerate(rows.collect(), 1)], number)
    else:
        rows = cut(numbered(rows, "created_s", "message_id", name="arrival"), "due")
    ctx = HandlerCtx(cached, caches or {})
    routed = received.route(rows, types).withColumn("failure", F.coalesce("failure", F.when(F.col("entity_key").isNull(), "MissingEntityKey")))
    failed = _held(routed.where("failure is not null").select("message_id", "failure"), limit)
    good = rows.join(failed, "message_id", "left_anti")
    # The cache's rows of these entities are as many as the rows at most.
    cached_here = _held(cached.join(rows.select("entity_key").distinct(), "entity_key", "left_semi"), limit)
    skipped, late = spark.createDataFrame([], "message_id long"), set()
    if before:
        seen = _held(good.join(cached_here.select("entity_key", F.col("payload").alias("previous")), "entity_key", "left"), limit)
        judged, late = contained(seen, before, ctx, limit, reruns)
        skipped = judged.where("failure is null and not go").select("message_id")
        failed = failed.unionByName(judged.where("failure is not null").select("message_id", "failure"))
        good = good.where(~F.col("message_id").isin(list(late))).join(failed, "message_id", "left_anti").join(skipped, "message_id", "left_anti")
    told: set[int] = set()
    while True:
        left = good.where(~F.col("message_id").isin(list(late))).join(failed, "message_id", "left_anti")
        done = _held(cache.advance(cached_here, left, declared, few=limit <= LOCAL).join(rows.select("arrival", "message_id"), "arrival", "left"), limit)
        if after is None:
            break
        moved = [r.message_id for r in done.where("outcome in ('Applied', 'Migrated')").select("message_id").collect()]
        fresh = set(moved) - told
        if not fresh:
            break
        # A row that fails is left out of another fold, which may let rows move that were overtaken by it before.
        bad, more = contained(_held(rows.where(F.col("message_id").isin(list(fresh))), limit), after, ctx, limit, reruns)
        told, late = told | fresh, late | more
        bad = bad.where("failure is not null").select("message_id", "failure")
        if bad.isEmpty() and not more:
            break
        failed = failed.unionByName(bad)
    rows = rows.where(~F.col("message_id").isin(list(late)))
    hooks.after_handlers()
    refused = done.where("outcome = 'CacheOriginMismatch'").select("message_id", F.col("outcome").alias("failure"))
    failed = _held(failed.unionByName(refused).where(~F.col("message_id").isin(list(late))).dropDuplicates(["message_id"]), limit)
    new = done.where("outcome <> 'Cached'").select("message_id", "outcome").unionByName(skipped.withColumn("outcome", F.lit("Skipped")))
    outcomes = rows.select("message_id").join(failed, "message_id", "left").join(new, "message_id", "left").select("message_id", F.coalesce("failure", "outcome").alias("outcome"))
    hooks.before_record()
    # Stored kinds are few: whatever a handler says is Handler.
    own = F.col("failure").isin("MissingHandler", "InvalidPayload", *problems.TERMINAL)
    judged_rows = rows.join(failed, "message_id", "left").withColumn("terminal", problems.terminal(F.col("failure"))).withColumn("failure", F.when(own | F.col("failure").isNull(), F.col("failure")).otherwise("Handler"))
    settled = _held(received.settle(judged_rows, now, **policy).select(*ledger.columns), limit)
    state = _held(cache.state_after(done), limit)
    sent = None
    if ctx.sent:
        sent = ctx.sent[0]
        for more in ctx.sent[1:]:
            sent = sent.unionByName(more)
        handled = outcomes.join(failed, "message_id", "left_anti").select(F.col("message_id").alias("cause"))
        sent = sent.join(handled, "cause", "left_semi").drop("cause")
    bad_rows = failed.collect()
    n, panics = len(bad_rows), tuple(sorted(r.message_id for r in bad_rows if r.failure == PANIC))
    order = tuple(r.message_id for r in rows.select("message_id").orderBy("arrival").collect())
    total = len(order)
    return Dispatched(
        ledger.join(rows.select("message_id"), "message_id", "left_anti").select(*ledger.columns).unionByName(settled),
        cached.join(state.select("entity_key"), "entity_key", "left_anti").unionByName(state, allowMissingColumns=True).select(*cached.columns),
        outcomes, sent, {"claimed": total, "processed": total - n, "failed": n, "panicked": len(panics)}, settled, state.select(*[c if c in state.columns else F.lit(None).cast(cached.schema[c].dataType).alias(c) for c in cached.columns]), panics, order,
    )


def fault(kind: str, hit) -> Before:
    """A handler for tests that fails the rows where `hit` (a column) holds: off, error, panic, constraint, contention or statement."""

    def before(rows: DataFrame, ctx: HandlerCtx) -> DataFrame:
        if kind == "panic" and not rows.where(hit).isEmpty():
            raise RuntimeError("a handler panicked")
        return rows.withColumns({"go": F.lit(True), "failure": F.when(hit, kind) if kind not in ("off", "panic") else F.lit(None).cast("string")})

    return before
