"""Recovery: current state of several sources enqueued again, page by page, with a cursor and a report."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import received, resync


class Resync(Protocol):
    """A source of current state: its keys, and for some of them the state as a message."""

    name: str

    def keys(self, after: str | None) -> DataFrame:
        """entity_key, unique, of everything after the cursor."""

    def load(self, keys: DataFrame) -> DataFrame:
        """entity_key (asked for), payload_key (found), message_id, partition_key, idempotency_key, headers, payload of those that have a state."""


@dataclass(frozen=True)
class Request:
    """sources: names to run (none: all), in the order they were given. after: the cursor to go on from, for one source only."""

    sources: tuple[str, ...] = ()
    after: str | None = None
    page: int = 500
    max_rows: int = 10_000


@dataclass(frozen=True)
class Outcome:
    source: str
    status: str
    pages: int = 0
    enqueued: int = 0
    skipped: int = 0
    last_key: str | None = None


class Recovery:
    """Up to seven sources under names of their own."""

    def __init__(self, *sources: Resync):
        names = [s.name for s in sources]
        if not 1 <= len(sources) <= 7 or len(set(names)) != len(names) or not all(names):
            raise ValueError("one to seven sources with different names")
        self.sources = {s.name: s for s in sources}

    def check(self, request: Request) -> list[Resync]:
        unknown = [n for n in request.sources if n not in self.sources]
        if unknown:
            raise ValueError(f"no source {', '.join(unknown)}")
        chosen = [self.sources[n] for n in dict.fromkeys(request.sources)] or list(self.sources.values())
        if request.after is not None and len(chosen) != 1:
            raise ValueError("a cursor needs one source")
        if not 1 <= request.page <= 10_000 or not 1 <= request.max_rows <= 10_000:
            raise ValueError("pages and rows are 1 to 10000")
        return chosen

    def run(self, ledger: DataFrame, now: int, request: Request = Request()) -> tuple[DataFrame, list[Outcome]]:
        """The send ledger with everything enqueued, and what each source did: Done, or Failed with the last key before the one that it stopped at.

        A state that names another entity fails its source: keys before it are sent, it and those after it aren't. Pages count as far as they were begun.
        Sources after it don't start.
        """
        report: list[Outcome] = []
        for source in self.check(request):
            keys = source.keys(request.after)
            states = source.load(keys)
            rows = resync.loaded(keys, states)
            good, stop = resync.before_mismatch(rows)
            t = resync.progress(good, request.page).agg(F.count("*").alias("n"), F.sum("enqueued").alias("e"), F.sum("skipped").alias("s"), F.max("last_key").alias("k")).first()
            last = t.k if t.n else request.after
            if t.n:
                upto = keys if stop is None else keys.where(F.col("entity_key") < stop)
                ledger = resync.republish(ledger, upto, states.join(upto, "entity_key", "left_semi"), now)
            report.append(Outcome(source.name, "Done" if stop is None else "Failed", t.n, t.e or 0, t.s or 0, last))
            if stop is not None:
                break
        return ledger, report

    @staticmethod
    def table(spark: SparkSession, report: list[Outcome]) -> DataFrame:
        return spark.createDataFrame([(o.source, o.status, o.pages, o.enqueued, o.skipped, o.last_key) for o in report], "source string, status string, pages long, enqueued long, skipped long, last_key string")


def redrive(ledger: DataFrame, request: Request = Request(), clear: bool = False, **only) -> tuple[DataFrame, Outcome]:
    """Dead letters of a receive ledger back to Pending: 1 to 10000 rows."""
    if not 1 <= request.max_rows <= 10_000:
        raise ValueError("1 to 10000 rows")
    n = received.redrive_estimate(ledger, request.max_rows, **only).first().n
    return received.redrive_into(ledger, request.max_rows, clear, **only), Outcome("received", "Done", enqueued=n)


def resumed(request: Request, last: Outcome) -> Request:
    """The request that goes on where a source stopped."""
    return replace(request, sources=(last.source,), after=last.last_key)
