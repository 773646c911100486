"""Roles at work: one cycle of the loops that a service's message types ask for."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators import dispatch, outbox, received
from ..operators.telemetry import Recorder, gauges
from ..sources.scratch import cut
from ..sources.sinks import Sink
from ..sources.store import Store
from ..streaming.jobs import drain, purge, run, send, shaped
from .config import Config
from .roles import Roles


class PanicLimit(RuntimeError):
    """Too many different rows panicked with none between them that got through."""


@dataclass
class Kept:
    """What a loop of a message type keeps from cycle to cycle: the rows of the streak of panics, and how many successes there were."""

    streak: set[int] = field(default_factory=set)
    successes: int = 0


@dataclass
class Service:
    """tables: the ledgers by (kind, message type), as `Roles.tables` lists them, frames or stores. What handlers send goes to the outbox of `sends`; a cycle dispatches `batch` due rows a type.

    `recorder` gets what the loops did, `quarantine` and `streams` are asked for by the ingester: streams[name]() gives a query writer that ends when its source has nothing more.
    """

    roles: Roles
    tables: dict[tuple[str, str], DataFrame | Store]
    sink: Sink
    config: Config
    sends: str | None = None
    batch: int = 500
    stats: dict[tuple[str, str], object] = field(default_factory=dict)
    kept: dict[str, Kept] = field(default_factory=dict)
    recorder: Recorder = field(default_factory=Recorder)
    streams: dict[str, Callable] = field(default_factory=dict)
    #: (message type, message_id) of the handled rows whose success was due to be told.
    told: list[tuple[str, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        missing = [t for t in self.roles.tables() if t not in self.tables]
        if missing:
            raise LookupError(f"no ledger for {missing}")

    def cycle(self, spark: SparkSession, now: float, only: set[str] | None = None) -> None:
        """Takes in records, dispatches due rows, relays what is pending, purges what is old and takes gauges, for all types or the loops chosen. Frames are replaced by those after it.

        Raises PanicLimit once its rows are settled, if a type's streak has met its limit.
        """
        chosen = self.roles.subsystems(only)
        for loop, name in chosen:
            if loop == "ingester" and name in self.streams:
                self.timed(loop, name, lambda name=name: run(self.streams[name]()))
        for loop, name in chosen:
            if loop == "dispatcher":
                self.timed(loop, name, lambda name=name: self._dispatch(spark, name, now))
        for loop, name in chosen:
            if loop in ("relay", "purger"):
                self.timed(loop, name, lambda loop=loop, name=name: getattr(self, f"_{loop}")(name, now))
        if ("metrics", "*") in chosen:
            self.gauges(spark, now)

    def timed(self, loop: str, name: str, work: Callable[[], None]) -> None:
        """A cycle counts once it is over; one that raises counts as an error, but for a tripped breaker, whose cycle is settled."""
        started = time.monotonic()
        try:
            work()
        except PanicLimit:
            self.recorder.cycle(loop, name, self._rows(loop, name), time.monotonic() - started)
            self.recorder.error(loop, name)
            raise
        except Exception:
            self.recorder.error(loop, name)
            raise
        self.recorder.cycle(loop, name, self._rows(loop, name), time.monotonic() - started)

    def _rows(self, loop: str, name: str) -> dict[str, int]:
        stats = self.stats.get((loop, name))
        return {} if stats is None else dict(stats) if isinstance(stats, dict) else stats._asdict() if hasattr(stats, "_asdict") else vars(stats)

    def gauges(self, spark: SparkSession, now: float) -> None:
        """Depth and oldest age of every ledger, what is over max_queue_age, and rows overdue by stuck_after: left in stats under metrics, old and stuck."""
        for (kind, name), table in self.tables.items():
            if kind in ("outbox", "received"):
                frame = table.rows() if isinstance(table, Store) else table
                statuses = received.OUTBOX_STATUSES if kind == "outbox" else received.RECEIVED_STATUSES
                self.stats["metrics", f"{kind}/{name}"] = gauges(frame, statuses, int(now), int(now), kind).collect()
                policy, terminal = self.config.policy("observability", name), outbox.TERMINAL if kind == "outbox" else ("Processed", "Failed")
                self.stats["old", f"{kind}/{name}"] = received.depth(frame, int(now), math.ceil(policy.max_queue_age), terminal).where("over_max_age").collect()
                if kind == "received":
                    self.stats["stuck", name] = received.stuck(frame, int(now), math.ceil(policy.stuck_after), self.batch).collect()

    def _relay(self, name: str, now: float) -> None:
        relay, key = self.config.policy("relay", name), ("outbox", name)
        self.tables[key], done = drain(self.tables[key], self.sink, int(now), relay.batch_limit, lease=math.ceil(relay.lease_for), retry_after=math.ceil(relay.retry_after))
        self.stats["relay", name] = done
        topic = self.roles.entries[name].topic
        self.recorder.records("publish.records", topic, {"published": done.published, "failed": done.failed, "stale": done.stale, "missing": done.missing})

    def _purger(self, name: str, now: float) -> None:
        policy, key = self.config.policy("purge", name), ("outbox", name)
        table, args = self.tables[key], (int(now), math.ceil(policy.older_than), policy.batch_size, policy.include_failed)
        if isinstance(table, Store):
            self.stats["purger", name] = outbox.PurgeStats(purge(table, *args))
            return
        victims = outbox.purge_victims(table, *args).count()
        self.tables[key] = cut(outbox.purge(table, *args), "purged")
        self.stats["purger", name] = outbox.PurgeStats(victims)

    def _dispatch(self, spark: SparkSession, name: str, now: float) -> None:
        entry, retry = self.roles.entries[name], self.config.policy("retry", name)
        whole = lambda t: t.rows() if isinstance(t, Store) else t
        ledger, cached = self.tables["received", name], self.tables["cache", name]
        caches = {n: whole(df) for (kind, n), df in self.tables.items() if kind == "cache"}
        known = spark.createDataFrame([(n,) for n, e in self.roles.entries.items() if e.consumes], "message_type string")
        done = dispatch.dispatch_due(
            ledger.live() if isinstance(ledger, Store) else ledger, caches[name], now, self.batch, known, entry.topic, entry.before, entry.after, caches,
            max_attempts=retry.max_attempts, initial=retry.initial_backoff, most=retry.max_backoff, multiplier=retry.multiplier, errors_limit=retry.errors_limit, jitter=int(now),
        )
        if done.sent is not None and self.sends:
            # Before the rows are settled: a crash between sends again, and receivers know the message by its key.
            outbox_ = self.tables["outbox", self.sends]
            if isinstance(outbox_, Store):
                send(outbox_, done.sent, int(now))
            else:
                self.tables["outbox", self.sends] = cut(outbox.enqueue(outbox_, done.sent, int(now)), "outbox")
        self.tables["cache", name] = self._changed(cached, done.moved, done.cache)
        self.tables["received", name] = self._changed(ledger, done.settled, done.ledger)
        self.stats["dispatcher", name] = done.stats
        self._keep(name, done)

    def _changed(self, table: DataFrame | Store, rows: DataFrame, whole: DataFrame) -> DataFrame | Store:
        if isinstance(table, Store):
            table.change(lambda live, v: shaped(rows, table))
            return table
        return cut(whole, "table")

    def _keep(self, name: str, done: dispatch.Dispatched) -> None:
        """Successes that are due to be told, and the streak of panics over this cycle's rows in their order; raises at the limit."""
        kept, policy = self.kept.setdefault(name, Kept()), self.config.policy("observability", name)
        limit, millionths = self.config.policy("dispatcher", name).max_consecutive_panicking_rows, round(policy.sample_success * 1_000_000)
        panicked, failed = set(done.panicked), {r.message_id for r in done.settled.where("status in ('Retryable', 'Failed')").select("message_id").collect()}
        tripped = False
        for m in done.order:
            if m in panicked:
                kept.streak.add(m)
                tripped = tripped or len(kept.streak) >= limit
            else:
                kept.streak.clear()
            if m not in failed:
                kept.successes += 1
                if policy.lifecycle == "per-message" or kept.successes * millionths // 1_000_000 > (kept.successes - 1) * millionths // 1_000_000:
                    self.told.append((name, m))
        if tripped:
            raise PanicLimit(f"{limit} different rows of {name} panicked in a row")
